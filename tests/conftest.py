import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from strataweave.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=f"file://{shared}",
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def graph(spark):
    """Nodes and edges from text such as ``"AB AC BD"``."""

    def build(text, nodes=""):
        pairs = [(p[0], p[1]) for p in text.split()]
        ids = sorted({x for p in pairs for x in p} | set(nodes))
        return (
            spark.createDataFrame([(i,) for i in ids], "id string"),
            spark.createDataFrame(pairs, "src string, dst string"),
        )

    return build


SAMPLE = "AB AC BD CD CE DF EF"
CYCLIC = "AB BC CA CD DE EF FD"
LINEAR = "AB BC CD"
