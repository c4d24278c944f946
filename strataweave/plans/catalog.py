"""All registered queries; importing this module fills the registry."""

from strataweave.plans import catalog_graph, catalog_ingest, catalog_scope, catalog_text  # noqa: F401
from strataweave.plans.registry import JOBS, SQL

__all__ = ["JOBS", "SQL"]
