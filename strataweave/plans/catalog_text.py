"""Registered queries on statement texts, spans, proposals, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.operators import adjacency as adj
from strataweave.operators import communities, cycles, proposals, sentences, snapshots, spans
from strataweave.plans.catalog_graph import _SCC, NODE, _deg, _propagation, _reach
from strataweave.plans.catalog_ingest import _LINE, PREFIX, _sboms
from strataweave.plans.catalog_scope import C
from strataweave.plans.graphs import LATEST_SQL, MODULAR_SQL, PEAK_SQL, latest_edges, modular_edges, part_nodes, peak_edges, table
from strataweave.plans.inputs import COMPONENT_SQL, MEMBERSHIP_SQL, components, layout, saved
from strataweave.plans.registry import query
from strataweave.scratch import Scratch
from strataweave.streaming import jobs

# ---- statement texts: one sentence per order line, its form chosen by line number and flags -----

# (line number, return flag) -> sentence; {p} part, {s} supplier, {n} quantity
SENTENCES = {
    (1, "A"): "there must be $$$part-{p}$$$",
    (1, "N"): "$$$part-{p}$$$  should   exist",
    (1, "R"): "parts should exist",
    (2, "A"): "$$$part-{p}$$$ must be in $$$sup_{s}$$$",
    (2, "N"): "Every $$$part-{p}$$$ should be contained in $$$sup_{s}$$$",
    (2, "R"): "$$$sup_{s}$$$ must contain $$$part-{p}$$$",
    (3, "A"): "all $$$part-{p}$$$ must not depend on $$$sup_{s}$$$",
    (3, "N"): "$$$part-{p}$$$ should not depend on anything",
    (3, "R"): "$$$part-{p}$$$ is important",
    (4, "A"): "there must be at least {n} $$$part-{p}$$$",
    (4, "N"): "There should be fewer than {n} $$$part-{p}$$$",
    (4, "R"): "there must be exactly {n}$$$part-{p}$$$",
    (5, "A"): "all components must have an owner on $$$sup_{s}$$$",
    (5, "N"): "every $$$part-{p}$$$ should be covered by $$$sup_{s}$$$",
    (5, "R"): "every component in the system must belong to a group on $$$sup_{s}$$$",
    (6, "A"): "$$$part-{p}$$$ corresponds with $$$sup_{s}$$$",
    (6, "N"): "$$$part-{p}$$$ must correspond to $$$sup_{s}$$$",
    (6, "R"): "part services are important",
    (7, "A"): "$$$part-{p}$$$ refines $$$sup_{s}$$$",
    (7, "N"): "$$$part-{p}$$$ must be a refinement of $$$sup_{s}$$$",
    (7, "R"): "$$$part-{p}$$$ nests within $$$sup_{s}$$$",
}

# what each sentence means: type, status, first, second, operator, modality
MEANING = {
    (1, "A"): ("existence", "formal", "part", None, None, "must"),
    (1, "N"): ("existence", "formal", "part", None, None, "should"),
    (1, "R"): ("existence", "semi_formal", None, None, None, None),
    (2, "A"): ("containment", "formal", "part", "sup", None, "must"),
    (2, "N"): ("containment", "formal", "part", "sup", None, "should"),
    (2, "R"): ("containment", "formal", "part", "sup", None, "must"),
    (3, "A"): ("exclusion", "formal", "part", "sup", None, "must"),
    (3, "N"): ("exclusion", "semi_formal", None, None, None, None),
    (3, "R"): (None, "semi_formal", None, None, None, None),
    (4, "A"): ("cardinality", "formal", "part", None, ">=", "must"),
    (4, "N"): ("cardinality", "formal", "part", None, "<", "should"),
    (4, "R"): ("cardinality", "formal", "part", None, "==", "must"),
    (5, "A"): ("coverage", "formal", "*", "sup", None, "must"),
    (5, "N"): ("coverage", "formal", "part", "sup", None, "should"),
    (5, "R"): ("coverage", "formal", "*", "sup", None, "must"),
    (6, "A"): ("correspondence", "formal", "part", "sup", None, None),
    (6, "N"): ("correspondence", "formal", "part", "sup", None, "must"),
    (6, "R"): (None, "informal", None, None, None, None),
    (7, "A"): ("refinement", "formal", "part", "sup", None, None),
    (7, "N"): ("refinement", "formal", "part", "sup", None, "must"),
    (7, "R"): ("refinement", "formal", "part", "sup", None, None),
}


def _texts(spark, folder):
    """(id, text): the sentence of every distinct order line."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    sentence = None
    for (number, flag), text in SENTENCES.items():
        test = (F.col("l_linenumber") == number) & (F.col("l_returnflag") == flag)
        sentence = F.when(test, text) if sentence is None else sentence.when(test, text)
    for mark, column in (("{p}", "l_partkey"), ("{s}", "l_suppkey"), ("{n}", "_n")):
        sentence = F.replace(sentence, F.lit(mark), F.col(column).cast("string"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    line = line.withColumn("_n", F.col("l_quantity").cast("long"))
    return line.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").agg(
        F.max("_n").alias("_n")
    ).select(key.alias("id"), sentence.alias("text"))


def _case(index: int) -> str:
    words = {"part": "'part-' || p", "sup": "'sup_' || s", None: "NULL"}
    picks = []
    for (number, flag), meaning in MEANING.items():
        value = meaning[index]
        value = words.get(value, f"'{value}'")
        picks.append(f"WHEN n = {number} AND f = '{flag}' THEN {value}")
    return f"CASE {' '.join(picks)} END"


_SENTENCE_SQL = f"""
    line AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag AS id, l_linenumber AS n,
             l_returnflag AS f, l_partkey AS p, l_suppkey AS s, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3, 4, 5),
    meant AS (SELECT id, {_case(0)} AS type, {_case(1)} AS status, {_case(2)} AS first, {_case(3)} AS second, {_case(4)} AS operator,
              CASE WHEN n = 4 THEN q END AS value, {_case(5)} AS modality FROM line)"""


@query("p01_p02_classify_statements", f"WITH {_SENTENCE_SQL} SELECT id, type, status, first, second, operator, value, modality FROM meant")
def classify(spark, folder):
    return sentences.classify_statements(_texts(spark, folder)).drop("refs")


@query(
    "p01_status_counts",
    f"WITH {_SENTENCE_SQL} SELECT type, status, count(*) AS statements FROM meant GROUP BY 1, 2",
)
def _(spark, folder):
    return classify(spark, folder).groupBy("type", "status").agg(F.count("*").alias("statements"))


@query(
    "p03_references",
    f"""WITH {_SENTENCE_SQL} SELECT id, CASE WHEN n = 2 AND f = 'R' THEN 'sup_' || s || ',part-' || p WHEN (n, f) IN ((1, 'R'), (6, 'R')) THEN '' WHEN (n, f) IN ((5, 'A'), (5, 'R')) THEN 'sup_' || s
      WHEN n IN (1, 4) OR (n, f) IN ((3, 'N'), (3, 'R')) THEN 'part-' || p ELSE 'part-' || p || ',sup_' || s END AS refs FROM line""",
)
def _(spark, folder):
    t = _texts(spark, folder)
    return t.select("id", F.array_join(sentences.references(F.col("text")), ",").alias("refs"))


@query(
    "p01_formal_json",
    f"""WITH {_SENTENCE_SQL} SELECT id, CASE type WHEN 'existence' THEN '{{"type":"existence","reference":"' || first || '"}}'
      WHEN 'containment' THEN '{{"type":"containment","subject":"' || first || '","container":"' || second || '"}}'
      WHEN 'exclusion' THEN '{{"type":"exclusion","subject":"' || first || '","excluded":"' || second || '"}}'
      WHEN 'cardinality' THEN '{{"type":"cardinality","operator":"' || operator || '","value":' || value || ',"reference":"' || first || '"}}'
      WHEN 'coverage' THEN '{{"type":"coverage","subject":"' || first || '","layer":"' || second || '"}}'
      WHEN 'correspondence' THEN '{{"type":"correspondence","layer_a":"' || first || '","layer_b":"' || second || '"}}'
      WHEN 'refinement' THEN '{{"type":"refinement","fine":"' || first || '","coarse":"' || second || '"}}' END AS expression FROM meant""",
)
def _(spark, folder):
    return classify(spark, folder).select("id", sentences.formal_json().alias("expression"))


@query(
    "p04_classify_tagged",
    """WITH l AS (SELECT DISTINCT doc_id, source, lang, n_chars FROM documents),
    x AS (SELECT doc_id AS id, n_chars, lang, CASE WHEN n_chars < 500 THEN 'exclusion' WHEN n_chars < 1500 THEN 'containment' WHEN n_chars < 4000 THEN 'cardinality' ELSE 'existence' END AS type,
      CASE WHEN lang = 'en' THEN 2 WHEN lang = 'fr' THEN 1 ELSE 0 END AS k FROM l)
    SELECT id, type, CASE WHEN k = 0 THEN 'informal' WHEN k = 1 AND type IN ('exclusion', 'containment') THEN 'semi_formal' WHEN type = 'cardinality' AND n_chars >= 3000 THEN 'semi_formal' ELSE 'formal' END AS status,
      CASE WHEN k > 0 THEN lang END AS first, CASE WHEN k = 2 AND type IN ('exclusion', 'containment') THEN 'doc-' || id END AS second,
      CASE WHEN k > 0 AND type = 'cardinality' AND n_chars < 3000 THEN '<=' END AS operator, CASE WHEN k > 0 AND type = 'cardinality' AND n_chars < 3000 THEN n_chars END AS value FROM x""",
)
def _(spark, folder):
    """A sentence about every document, with its language and id marked as references."""
    d = table(spark, folder, "documents")
    size = F.col("n_chars")
    sentence = (
        F.when(size < 500, "The document MUST NOT CALL another one, it belongs to nobody")
        .when(size < 1500, "each is part of a whole")
        .when(size < 3000, F.concat(F.lit("No more than "), size.cast("string"), F.lit(" characters")))
        .when(size < 4000, F.concat(F.lit("no fewer than "), size.cast("string")))
        .otherwise("documents are here")
    )
    second = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    tags = (
        F.when(F.col("lang") == "en", F.array("lang", second, F.col("lang")))
        .when(F.col("lang") == "fr", F.array("lang", "lang"))
        .otherwise(F.array().cast("array<string>"))
    )
    return sentences.classify_tagged(d.select(F.col("doc_id").alias("id"), sentence.alias("text"), tags.alias("tags")))


@query("p05_rank_templates")
def rank_templates(spark, folder):
    return sentences.rank_templates(_texts(spark, folder))


@query(
    "p06_classify_definitions",
    """WITH p AS (SELECT p_partkey AS id, lower(p_type) AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
    SELECT id, CASE t WHEN 'small' THEN 'layer' WHEN 'medium' THEN 'explicit_list' ELSE 'tag_expression' END AS type,
      CASE t WHEN 'economy' THEN '{"tag":"' || a || '"}' WHEN 'standard' THEN '{"and":["' || a || '","' || b || '","x y"]}' WHEN 'promo' THEN '{"or":["' || a || '","' || b || '"]}' WHEN 'large' THEN '{"not":{"tag":"' || b || '"}}' END AS expression,
      CASE WHEN t = 'small' THEN a || '-' || id END AS layer, CASE WHEN t = 'medium' THEN a || '|' || b || ':' || id END AS members FROM p""",
)
def _(spark, folder):
    p = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.lower("p_type").alias("t"), F.substring_index("p_name", " ", 1).alias("a"), F.substring_index("p_name", " ", -1).alias("b")
    )
    forms = {
        "economy": F.concat(F.lit("Components tagged with  '"), "a", F.lit("'")),
        "standard": F.concat(F.lit("components tagged with '"), "a", F.lit("' AND \""), "b", F.lit("\" and 'x y'")),
        "promo": F.concat(F.lit("components tagged with "), "a", F.lit(" or "), "b"),
        "large": F.concat(F.lit("components tagged with not "), "b"),
        "small": F.concat(F.lit("groups on layer $$$"), "a", F.lit("-"), F.col("id").cast("string"), F.lit("$$$")),
        "medium": F.concat(F.lit("components: "), "a", F.lit(" , "), "b", F.lit(":"), F.col("id").cast("string")),
    }
    text = None
    for kind, form in forms.items():
        text = F.when(F.col("t") == kind, form) if text is None else text.when(F.col("t") == kind, form)
    out = sentences.classify_definitions(p.select("id", text.alias("text")))
    return out.withColumn("members", F.array_join("members", "|"))


# ---- spans: one annotation per order line, placed by quantity and line number ---------------------


def _spans(spark, folder):
    line = table(spark, folder, "lineitem")
    start = F.col("l_quantity").cast("long")
    return line.select(
        F.col("l_orderkey").alias("doc"), start.alias("start"), (start + F.col("l_linenumber") * 4 - 4).alias("end"), F.col("l_returnflag").alias("tag")
    )


_SPAN = """
    s AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_quantity AS BIGINT) AS "start", CAST(l_quantity AS BIGINT) + l_linenumber * 4 - 4 AS "end", l_returnflag AS tag FROM lineitem),
    c AS (SELECT * FROM s WHERE "start" < "end" AND "end" <= 60)"""


def _clean(spark, folder):
    lengths = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(60).alias("length"))
    return spans.clean_spans(_spans(spark, folder), lengths)


@query("p07_clean_spans", f'WITH {_SPAN} SELECT doc, "start", "end", tag FROM c')
def _(spark, folder):
    return _clean(spark, folder)


@query(
    "p08_j12_span_structure",
    f"""WITH {_SPAN} SELECT a.doc, a."start", a."end", a.tag,
      (SELECT count(*) - 1 FROM c b WHERE b.doc = a.doc AND b."start" >= a."start" AND b."end" <= a."end") AS nesting_level,
      EXISTS (SELECT 1 FROM c b WHERE b.doc = a.doc AND b."start" < a."end" AND b."end" > a."start"
        AND ((b."start" < a."start" AND b."end" < a."end") OR (b."start" > a."start" AND b."end" > a."end"))) AS crosses FROM c a""",
)
def span_structure(spark, folder):
    return spans.span_structure(saved(spark, _clean(spark, folder)))


# ---- proposals --------------------------------------------------------------------------------------


def _graph(spark, folder):
    n, e = saved(spark, part_nodes(spark, folder)), saved(spark, latest_edges(spark, folder))
    return n, e, components(spark, folder)


@query(
    "b01_b07_cycle_breaks",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL}, {_deg("latest")}, {_reach("latest")}, {_SCC}, {COMPONENT_SQL},
    m AS (SELECT scc_id, count(*) AS size, avg(coupling_score) AS mc, string_agg(key, ' -> ' ORDER BY key) AS members, list_sort(list(key)) AS ks
          FROM scc JOIN metric USING (id) JOIN component USING (id) WHERE scc_size > 1 GROUP BY 1)
    SELECT CAST(scc_id AS VARCHAR) AS subject, size, round(mc, 6)::DOUBLE AS mean_coupling, 'Break cyclic dependency involving ' || size || ' services' AS summary,
      'Cyclic dependency detected: ' || array_to_string(ks[1:5], ' -> ') || CASE WHEN size > 5 THEN ' -> ... (' || size || ' total)' ELSE '' END AS root_cause FROM m""",
)
def _(spark, folder):
    n, e, nodes = _graph(spark, folder)
    out = proposals.cycle_breaks(nodes, e, cycles.scc(n, e), adj.node_degrees(n, e))
    return out.select("subject", "size", F.round("mean_coupling", 6).alias("mean_coupling"), "summary", "root_cause")


@query(
    "b02_shared_concepts",
    f"""{C} SELECT type, split_part(key, ':', 1) AS concept FROM component UNION SELECT type, CASE WHEN ends_with(key, '-service') THEN 'service' WHEN ends_with(key, '-api') THEN 'api' WHEN ends_with(key, '-core') THEN 'core' ELSE 'common' END
    FROM component WHERE type IN ('economy', 'standard', 'promo', 'small')""",
)
def _(spark, folder):
    return proposals.concepts(components(spark, folder), "type")


_HIGH = """
    ranked AS (SELECT coupling_score AS s, row_number() OVER (ORDER BY coupling_score) - 1 AS i, count(*) OVER () AS n FROM metric),
    cut AS (SELECT s FROM ranked WHERE i = least(CAST(floor(n * 90.0 / 100.0) AS BIGINT), n - 1)),
    high AS (SELECT metric.*, key FROM metric, cut, component WHERE component.id = metric.id AND coupling_score >= s AND fan_in >= 3)"""


@query(
    "b03_api_stabilisations",
    f"""WITH {NODE}, {MODULAR_SQL}, {_deg("modular")}, {COMPONENT_SQL}, {_HIGH}
    SELECT key AS subject, fan_in + 1 AS size, round(coupling_score, 6)::DOUBLE AS mean_coupling, 'Stabilize API for ' || key || ' (' || fan_in || ' consumers)' AS summary, fan_in AS fan_in_before, fan_out AS fan_out_before FROM high""",
)
def _(spark, folder):
    n, e, nodes = part_nodes(spark, folder), saved(spark, modular_edges(spark, folder)), components(spark, folder)
    out = proposals.api_stabilisations(nodes, adj.node_degrees(n, e))
    return out.select("subject", "size", F.round("mean_coupling", 6).alias("mean_coupling"), "summary", "fan_in_before", "fan_out_before")


def _candidates(spark, folder):
    n, e, nodes = _graph(spark, folder)
    components_ = cycles.scc(n, e)
    labels = saved(spark, communities.label_propagation(n, e))
    d = saved(spark, adj.node_degrees(n, e))
    found = [
        proposals.cycle_breaks(nodes, e, components_, d),
        proposals.api_stabilisations(nodes, d),
        proposals.boundary_changes(nodes, e, labels, d),
    ]
    return found, nodes, e, components_, labels


_BACKLOG = f"""
    m AS (SELECT scc_id, count(*) AS size, avg(coupling_score) AS mc FROM scc JOIN metric USING (id) WHERE scc_size > 1 GROUP BY 1),
    q AS (SELECT community, count(*) AS size, avg(coupling_score) AS mc, list_sort(list_distinct(list(split_part(key, ':', 1)))) AS pre FROM p10 JOIN metric USING (id) JOIN component USING (id) GROUP BY 1),
    every AS (SELECT 0 AS k, 'cycle_break' AS proposal_type, CAST(scc_id AS VARCHAR) AS subject, size, mc FROM m
      UNION ALL SELECT 1, 'api_stabilization', key, fan_in + 1, coupling_score FROM high
      UNION ALL SELECT 2, 'boundary_redefinition', CAST(community AS VARCHAR), size, mc FROM q WHERE size >= 3 AND len(pre) > 1),
    numbered AS (SELECT *, row_number() OVER (ORDER BY k, size DESC, subject) AS r FROM every),
    backlog AS (SELECT ['CYC', 'API', 'BND'][k + 1] || '-' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS proposal_id, proposal_type, subject, size,
      CASE WHEN size >= 5 OR mc >= 10 THEN 'high' WHEN size >= 3 OR mc >= 5 THEN 'medium' ELSE 'low' END AS impact,
      CASE k WHEN 0 THEN CASE WHEN size <= 3 THEN 'medium' ELSE 'high' END WHEN 1 THEN CASE WHEN size <= 5 THEN 'low' ELSE 'medium' END ELSE 'medium' END AS risk FROM numbered)"""

_BACKLOG_FROM = f"WITH RECURSIVE {NODE}, {LATEST_SQL}, {_deg('latest')}, {_reach('latest')}, {_SCC}, {COMPONENT_SQL}, {_HIGH}, {_propagation('latest', 10)}, {_BACKLOG}"


@query(
    "b05_b06_b08_w03_backlog",
    f"{_BACKLOG_FROM} SELECT proposal_id, proposal_type, subject, size, impact, risk FROM backlog",
)
def backlog(spark, folder):
    found, *_ = _candidates(spark, folder)
    return proposals.backlog(found).select("proposal_id", "proposal_type", "subject", "size", "impact", "risk")


@query(
    "b04_boundary_changes",
    f"""{_BACKLOG_FROM} SELECT CAST(community AS VARCHAR) AS subject, size, round(mc, 6)::DOUBLE AS mean_coupling,
      'Redefine boundaries for ' || size || ' services across ' || len(pre) || ' domains' AS summary, 'Mixed domain prefixes in cluster: ' || array_to_string(pre, ', ') || chr(10) || 'Services with different responsibilities grouped together' AS root_cause
    FROM q WHERE size >= 3 AND len(pre) > 1""",
)
def _(spark, folder):
    n, e, nodes = _graph(spark, folder)
    labels = saved(spark, communities.label_propagation(n, e))
    out = proposals.boundary_changes(nodes, e, labels, adj.node_degrees(n, e))
    return out.select("subject", "size", F.round("mean_coupling", 6).alias("mean_coupling"), "summary", "root_cause")


@query(
    "b08_proposal_scope",
    f"""{_BACKLOG_FROM},
    users AS (SELECT proposal_id, s.key, row_number() OVER (PARTITION BY proposal_id ORDER BY s.key) AS r FROM backlog JOIN component t ON t.key = subject JOIN latest ON dst = t.id JOIN component s ON s.id = src WHERE proposal_type = 'api_stabilization'),
    mates AS (SELECT proposal_id, key, row_number() OVER (PARTITION BY proposal_id ORDER BY key) AS r FROM backlog JOIN p10 ON CAST(community AS VARCHAR) = subject JOIN component USING (id) WHERE proposal_type = 'boundary_redefinition')
    SELECT proposal_id, key FROM backlog JOIN scc ON CAST(scc_id AS VARCHAR) = subject AND scc_size > 1 JOIN component USING (id) WHERE proposal_type = 'cycle_break'
    UNION ALL SELECT proposal_id, subject FROM backlog WHERE proposal_type = 'api_stabilization' UNION ALL SELECT proposal_id, key FROM users WHERE r <= 5 UNION ALL SELECT proposal_id, key FROM mates WHERE r <= 10""",
)
def _(spark, folder):
    found, nodes, e, components_, labels = _candidates(spark, folder)
    listed = saved(spark, proposals.backlog(found))
    return proposals.proposal_scope(listed, nodes, e, components_, labels)


def _steps_sql(kind: str, subject: str, source: str, texts: list[str], gain: str, first: str | None = None) -> str:
    said = [f"({i}, '{t}')" for i, t in enumerate(texts, 1 if first is None else 2)]
    rows = f"SELECT '{kind}' AS proposal_type, {subject} AS subject, v.step, v.text, '{gain}' AS expected_improvement FROM {source}, (VALUES {', '.join(said)}) AS v(step, text)"
    return rows if first is None else f"{rows} UNION ALL SELECT '{kind}', {subject}, 1, {first}, '{gain}' FROM {source}"


@query(
    "b07_steps",
    f"""{_BACKLOG_FROM} {_steps_sql("cycle_break", "CAST(scc_id AS VARCHAR)", "m", proposals.CYCLE_STEPS, proposals.CYCLE_GAIN)}
    UNION ALL {_steps_sql("api_stabilization", "key", "high", proposals.API_STEPS, proposals.API_GAIN, "'Identify stable vs volatile API contracts for ' || key")}""",
)
def _(spark, folder):
    n, e, nodes = _graph(spark, folder)
    d = saved(spark, adj.node_degrees(n, e))
    found = proposals.cycle_breaks(nodes, e, cycles.scc(n, e), d).unionByName(proposals.api_stabilisations(nodes, d))
    return proposals.steps(found)


@query(
    "b08_run_rows",
    f"""{_BACKLOG_FROM}, run AS (SELECT (SELECT count(*) FROM node) AS total_projects, (SELECT count(*) FROM m) AS total_sccs, (SELECT count(*) FROM q) AS total_clusters,
      (SELECT count(*) FROM backlog) AS proposals_generated, 'completed' AS status)
    SELECT *, false AS dry_run, proposals_generated AS saved FROM run UNION ALL SELECT *, true, 0 FROM run""",
)
def _(spark, folder):
    """A run and a dry run, each with the number of proposals it saves."""
    n, e, nodes = _graph(spark, folder)
    parts = saved(spark, cycles.scc(n, e)), saved(spark, communities.label_propagation(n, e)), saved(spark, adj.node_degrees(n, e))
    out = None
    for dry in (False, True):
        run, kept = proposals.run_backlog(nodes, e, *parts, dry_run=dry)
        row = run.join(kept.agg(F.count("*").alias("saved")))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "b10_cycles_before_after",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL}, kept AS MATERIALIZED (SELECT DISTINCT src, dst FROM latest_scoped WHERE scope = 'compile'),
    ra AS (SELECT src, dst FROM latest UNION SELECT r.src, e.dst FROM ra r JOIN latest e ON r.dst = e.src),
    rb AS (SELECT src, dst FROM kept UNION SELECT r.src, e.dst FROM rb r JOIN kept e ON r.dst = e.src),
    ca AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS c FROM ra a JOIN ra b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1),
    cb AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS c FROM rb a JOIN rb b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1),
    x AS (SELECT 'cyclic_sccs' AS metric, (SELECT count(DISTINCT c) FROM ca) AS before, (SELECT count(DISTINCT c) FROM cb) AS after
      UNION ALL SELECT 'cyclic_nodes', (SELECT count(*) FROM ca), (SELECT count(*) FROM cb)
      UNION ALL SELECT 'largest_scc', (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM ca GROUP BY c)), (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM cb GROUP BY c)))
    SELECT metric, before, after, after - before AS delta FROM x""",
)
def _(spark, folder):
    """The cycles that are left when run-time dependencies are cut."""
    n, e, _ = _graph(spark, folder)
    return proposals.cycles_before_after(cycles.scc(n, e), cycles.scc(n, e.where("scope = 'compile'")))


@query("a07_type_counts", f"{_BACKLOG_FROM} SELECT t.proposal_type, count(proposal_id) AS proposals FROM (SELECT unnest(['cycle_break', 'service_extraction', 'api_stabilization', 'boundary_redefinition']) AS proposal_type) t LEFT JOIN backlog USING (proposal_type) GROUP BY 1")
def _(spark, folder):
    return proposals.type_counts(backlog(spark, folder))


@query(
    "f17_filter_backlog",
    f"""{_BACKLOG_FROM}, o AS (SELECT o_orderkey, o_orderdate FROM orders)
    SELECT proposal_id, impact, size FROM backlog WHERE proposal_type = 'boundary_redefinition' AND impact = 'high' ORDER BY size DESC, proposal_id LIMIT 50""",
)
def _(spark, folder):
    rows = backlog(spark, folder).withColumn("created_at", F.timestamp_seconds(F.col("size")))
    out = proposals.filter_backlog(rows, proposal_type="boundary_redefinition", impact="high")
    return out.select("proposal_id", "impact", "size")


@query(
    "b09_proposal_states",
    f"""{_BACKLOG_FROM} SELECT proposal_id, CASE WHEN impact = 'high' THEN 'accepted' ELSE 'pending' END AS status FROM backlog""",
)
def _(spark, folder):
    rows = saved(spark, backlog(spark, folder).withColumn("status", F.lit("pending")))
    change = rows.select("proposal_id", F.when(F.col("impact") == "high", "accepted").otherwise("no such state").alias("status"))
    return proposals.set_status(rows, change).select("proposal_id", "status")


@query(
    "b10_before_after",
    f"""WITH {NODE}, {PEAK_SQL}, {_deg("peak")}, kept AS (SELECT DISTINCT src, dst FROM peak_scoped WHERE scope = 'compile'),
    i AS (SELECT dst AS id, count(*) AS n FROM kept GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM kept GROUP BY 1),
    x AS (SELECT deg.id, fan_in, fan_out, coalesce(i.n, 0) AS i2, coalesce(o.n, 0) AS o2 FROM deg LEFT JOIN i USING (id) LEFT JOIN o USING (id))
    SELECT id, 'fan_in' AS metric, fan_in::DOUBLE AS before, i2::DOUBLE AS after, (i2 - fan_in)::DOUBLE AS delta FROM x WHERE i2 <> fan_in
    UNION ALL SELECT id, 'fan_out', fan_out, o2, o2 - fan_out FROM x WHERE o2 <> fan_out""",
)
def _(spark, folder):
    n, e = part_nodes(spark, folder), peak_edges(spark, folder)
    return proposals.before_after(
        adj.degrees(n, e), adj.degrees(n, e.where("scope = 'compile'")), ["fan_in", "fan_out"]
    )


# ---- layouts and snapshots -----------------------------------------------------------------------------

_LAYOUT = f"""{COMPONENT_SQL}, {MEMBERSHIP_SQL},
    lay AS (SELECT DISTINCT 'v-' || layer AS vision_id, layer AS layer_id, upper(layer) AS name, CASE layer WHEN 'by-type' THEN 2 WHEN 'by-brand' THEN 1 ELSE 0 END AS ord FROM membership),
    grp AS (SELECT DISTINCT layer AS layer_id, layer || '/' || grp AS group_id, grp AS key, upper(grp) AS name FROM membership),
    mem AS (SELECT layer || '/' || grp AS group_id, id FROM membership),
    pos AS (SELECT 'by-type' AS layer_id, id, size::DOUBLE AS x, price AS y FROM component WHERE group_key IS NOT NULL)"""

_SNAP = """
    snap AS (SELECT vision_id, 'layer' AS kind, layer_id AS path FROM lay
      UNION ALL SELECT vision_id, 'group', group_id FROM grp JOIN lay USING (layer_id)
      UNION ALL SELECT vision_id, 'member', group_id || '/' || c.key FROM mem JOIN grp USING (group_id) JOIN lay USING (layer_id) JOIN component c USING (id)
      UNION ALL SELECT vision_id, 'position', layer_id || '/' || c.key FROM pos JOIN lay USING (layer_id) JOIN component c USING (id))"""


@query("v01_snapshot", f"WITH {_LAYOUT}, {_SNAP} SELECT vision_id, kind, path FROM snap")
def _(spark, folder):
    nodes = components(spark, folder)
    return snapshots.snapshot(*layout(nodes), nodes).drop("payload")


@query(
    "v07_j14_snapshot_delta",
    f"""WITH {_LAYOUT}, {_SNAP},
    old AS (SELECT id, key FROM component WHERE group_key IS NOT NULL AND size <= 40), new AS (SELECT id, key FROM component WHERE group_key IS NOT NULL AND size >= 5)
    SELECT vision_id, kind, path, CASE WHEN EXISTS (SELECT 1 FROM old WHERE ends_with(path, '/' || key)) THEN 'removed' ELSE 'added' END AS change FROM snap
    WHERE kind IN ('member', 'position') AND (EXISTS (SELECT 1 FROM old WHERE ends_with(path, '/' || key)) <> EXISTS (SELECT 1 FROM new WHERE ends_with(path, '/' || key)))
    UNION ALL SELECT 'v-' || layer, 'group', layer || '/' || grp, CASE WHEN bool_or(size <= 40) THEN 'removed' ELSE 'added' END FROM membership JOIN component USING (id)
    GROUP BY layer, grp HAVING bool_or(size <= 40) <> bool_or(size >= 5)""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    before = snapshots.snapshot(*layout(nodes.where("size <= 40")), nodes)
    after = snapshots.snapshot(*layout(nodes.where("size >= 5")), nodes)
    return snapshots.snapshot_delta(before, after).select("vision_id", "kind", "path", "change")


def _documents(spark, folder):
    """(doc, document): a stored layout per order line."""
    line = table(spark, folder, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    key = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    other = F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"))
    spot = lambda k, x: F.struct(k.alias("project_key"), F.array(x.cast("double"), F.lit(2.0)).alias("position"))
    strings = F.array().cast("array<string>")
    group = lambda k, members: F.struct(F.lit(k).alias("key"), members.alias("members"))
    no_groups = F.expr("CAST(array() AS array<struct<key:string,members:array<string>>>)")
    layer = lambda k, groups, spots: F.struct(F.lit(k).alias("key"), groups.alias("groups"), spots.alias("node_positions"))
    document = F.to_json(
        F.struct(
            F.array(
                layer("first", F.array(group("g", F.array(key, other)), group("none", strings)), F.array(spot(key, F.col("l_linenumber")))),
                layer("empty", no_groups, F.array(spot(key, F.lit(77)), spot(other, F.lit(8)))),
            ).alias("layers")
        )
    )
    return line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("doc"), document.alias("document"))


_DOC = "d AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS doc, 'part-' || l_partkey AS p, 'supplier-' || l_suppkey AS s, l_linenumber AS n FROM lineitem)"


@query(
    "v02_restore",
    f"""WITH {_DOC} SELECT doc, 'first' AS layer_key, 0 AS ord, 'g' AS group_key, p AS member FROM d UNION ALL SELECT doc, 'first', 0, 'g', s FROM d
    UNION ALL SELECT doc, 'first', 0, 'none', NULL FROM d UNION ALL SELECT doc, 'empty', 1, NULL, NULL FROM d""",
)
def _(spark, folder):
    return snapshots.restore(_documents(spark, folder))


@query(
    "g34_snapshot_positions",
    f"WITH {_DOC} SELECT doc, p AS member, n::DOUBLE AS x, 2.0::DOUBLE AS y FROM d UNION ALL SELECT doc, s, 8.0, 2.0 FROM d",
)
def _(spark, folder):
    return snapshots.restored_positions(_documents(spark, folder))


@query(
    "v03_duplicate_vision",
    f"WITH {_LAYOUT} SELECT 'copy-' || group_id AS group_id, id FROM mem WHERE starts_with(group_id, 'by-brand/')",
)
def _(spark, folder):
    layers, groups, members, _ = layout(components(spark, folder))
    return snapshots.duplicate_vision(layers, groups, members, "v-by-brand", "copy")[2]


@query(
    "v03_duplicate_tables",
    f"""WITH {_LAYOUT} SELECT 'layer' AS kind, 'copy' AS parent, 'copy-' || layer_id AS child, layer_id AS key, name FROM lay WHERE vision_id = 'v-by-brand'
    UNION ALL SELECT 'group', 'copy-' || layer_id, 'copy-' || group_id, key, name FROM grp WHERE layer_id = 'by-brand'
    UNION ALL SELECT 'member', 'copy-' || group_id, CAST(id AS VARCHAR), NULL, NULL FROM mem WHERE starts_with(group_id, 'by-brand/')""",
)
def _(spark, folder):
    layers, groups, members, _ = layout(components(spark, folder))
    return _tables(*snapshots.duplicate_vision(layers, groups, members, "v-by-brand", "copy"))


def _tables(layers, groups, members):
    """The three tables of a layout as one list of rows."""
    none = F.lit(None).cast("string")
    rows = layers.select(F.lit("layer").alias("kind"), F.col("vision_id").alias("parent"), F.col("layer_id").alias("child"), "key", "name")
    rows = rows.unionByName(groups.select(F.lit("group").alias("kind"), F.col("layer_id").alias("parent"), F.col("group_id").alias("child"), "key", "name"))
    return rows.unionByName(members.select(
        F.lit("member").alias("kind"), F.col("group_id").alias("parent"), F.col("id").cast("string").alias("child"), none.alias("key"), none.alias("name")))


@query(
    "v06_delete_tables",
    f"""WITH {_LAYOUT} SELECT 'layer' AS kind, vision_id AS parent, layer_id AS child, layer_id AS key, name FROM lay WHERE vision_id <> 'v-by-both'
    UNION ALL SELECT 'group', layer_id, group_id, key, name FROM grp WHERE layer_id <> 'by-both'
    UNION ALL SELECT 'member', group_id, CAST(id AS VARCHAR), NULL, NULL FROM mem WHERE NOT starts_with(group_id, 'by-both/')""",
)
def _(spark, folder):
    layers, groups, members, _ = layout(components(spark, folder))
    gone = layers.where("vision_id = 'v-by-both'").select("vision_id")
    return _tables(*snapshots.delete_vision(layers, groups, members, gone))


@query(
    "v04_save_layout",
    f"""WITH {_LAYOUT} SELECT layer_id, id, x, y FROM pos WHERE id NOT IN (SELECT id FROM component WHERE type = 'promo')
    UNION ALL SELECT 'by-type', id, 1.0, 2.0 FROM component WHERE type = 'promo'""",
)
def _(spark, folder):
    nodes = components(spark, folder)
    sent = nodes.where("type = 'promo'").select(F.lit("by-type").alias("layer_id"), "id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    return snapshots.save_layout(layout(nodes)[3], sent)


@query(
    "v04_keep_groups",
    f"WITH {_LAYOUT} SELECT layer_id, group_id, key, name FROM grp WHERE layer_id <> 'by-brand' OR key IN (SELECT brand FROM component WHERE size = 9)",
)
def _(spark, folder):
    nodes = components(spark, folder)
    sent = nodes.where("size = 9").select(F.lit("by-brand").alias("layer_id"), F.col("brand").alias("key")).distinct()
    return snapshots.keep_groups(layout(nodes)[1], sent)


@query(
    "v05_add_members",
    f"WITH {_LAYOUT} SELECT 'by-type/promo' AS group_id, id FROM component WHERE size > 30 AND NOT (type = 'promo' AND group_key IS NOT NULL)",
)
def _(spark, folder):
    nodes = components(spark, folder)
    wanted = nodes.where("size > 30").select(F.lit("by-type/promo").alias("group_id"), "id")
    wanted = wanted.unionByName(nodes.select(F.lit("by-type/promo").alias("group_id"), (-F.col("id") - 1).alias("id")))
    return snapshots.add_members(layout(nodes)[2], wanted, nodes)


@query("v05_remove_members", f"WITH {_LAYOUT} SELECT group_id, id FROM mem WHERE NOT (group_id = 'by-type/large' AND id IN (SELECT id FROM component WHERE size < 10))")
def _(spark, folder):
    nodes = components(spark, folder)
    return snapshots.remove_members(
        layout(nodes)[2], nodes.where("size < 10").select(F.lit("by-type/large").alias("group_id"), "id")
    )


@query("v06_delete_vision", f"WITH {_LAYOUT} SELECT group_id, id FROM mem WHERE NOT starts_with(group_id, 'by-both/')")
def _(spark, folder):
    layers, groups, members, _ = layout(components(spark, folder))
    gone = layers.where("vision_id = 'v-by-both'").select("vision_id")
    return snapshots.delete_vision(layers, groups, members, gone)[2]


_SHOWN = "shown AS (SELECT id, layer_key, group_key FROM (SELECT id, layer_id AS layer_key, grp.key AS group_key, row_number() OVER (PARTITION BY id ORDER BY ord, lay.name, grp.name) AS r FROM mem JOIN grp USING (group_id) JOIN lay USING (layer_id) WHERE layer_id <> 'by-both') WHERE r = 1)"


@query("w01_first_membership", f"WITH {_LAYOUT}, {_SHOWN} SELECT id, layer_key, group_key FROM shown")
def _(spark, folder):
    layers, groups, members, _ = layout(components(spark, folder))
    shown = groups.where("layer_id <> 'by-both'")
    return snapshots.first_membership(layers, shown, members)


@query("g33_vision_graph", f"WITH {_LAYOUT}, {PEAK_SQL}, {_SHOWN} SELECT src, dst FROM peak WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)")
def _(spark, folder):
    layers, groups, members, _ = layout(components(spark, folder))
    return snapshots.vision_graph(layers, groups.where("layer_id <> 'by-both'"), members, peak_edges(spark, folder))[1]


@query("g33_vision_nodes", f"WITH {_LAYOUT}, {_SHOWN} SELECT id, layer_key, group_key FROM shown")
def _(spark, folder):
    layers, groups, members, _ = layout(components(spark, folder))
    return snapshots.vision_graph(layers, groups.where("layer_id <> 'by-both'"), members, peak_edges(spark, folder))[0]


_VISIONS = """
    vision AS (SELECT c_custkey AS vision_id, c_name AS name, CASE WHEN c_acctbal < 2000 THEN 'draft' ELSE 'shared' END AS status FROM customer),
    vl AS (SELECT o_custkey AS vision_id, count(*) AS n FROM orders GROUP BY 1),
    vs AS (SELECT o_custkey AS vision_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


def _visions(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders").withColumnRenamed("o_custkey", "vision_id")
    status = F.when(F.col("c_acctbal") < 2000, "draft").otherwise("shared")
    v = c.select(F.col("c_custkey").alias("vision_id"), F.col("c_name").alias("name"), status.alias("status"))
    return v, o, o.where("o_orderstatus = 'F'")


@query(
    "a06_vision_list",
    f"WITH {_VISIONS} SELECT vision_id, name, status, coalesce(vl.n, 0) AS layers, coalesce(vs.n, 0) AS statements FROM vision LEFT JOIN vl USING (vision_id) LEFT JOIN vs USING (vision_id)",
)
def _(spark, folder):
    return snapshots.vision_list(*_visions(spark, folder))


@query(
    "f18_vision_list_by_status",
    f"WITH {_VISIONS} SELECT vision_id, name, status, coalesce(vl.n, 0) AS layers, coalesce(vs.n, 0) AS statements FROM vision LEFT JOIN vl USING (vision_id) LEFT JOIN vs USING (vision_id) WHERE status = 'draft'",
)
def _(spark, folder):
    return snapshots.vision_list(*_visions(spark, folder), status="draft")


@query(
    "v09_run_trend",
    """SELECT o_custkey AS scope, o_orderkey AS run_id, round(o_totalprice, 2) AS total, round(round(o_totalprice, 2) - lag(round(o_totalprice, 2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS total_change FROM orders""",
)
def _(spark, folder):
    runs = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("finished_at"), F.round("o_totalprice", 2).alias("total")
    )
    return snapshots.run_trend(runs, ["total"]).select("scope", "run_id", "total", F.round("total_change", 2).alias("total_change"))


# ---- streams ---------------------------------------------------------------------------------------------


@query(
    "x02_activity_stream",
    """SELECT user_id, max(ts) AS last_seen, CAST(count(*) AS BIGINT) AS events,
    CASE WHEN max(ts) > TIMESTAMP '2024-02-28' - INTERVAL 30 DAY THEN 'active_30d' WHEN max(ts) > TIMESTAMP '2024-02-28' - INTERVAL 90 DAY THEN 'stale_30_90d' ELSE 'dormant_90d_plus' END AS bucket
    FROM events GROUP BY 1""",
)
def activity_stream(spark, folder):
    """The event table replayed as a stream into daily windows, then bucketed on read.

    Update mode keeps every window's newest count, so nothing is held back by the watermark.
    """
    e = table(spark, folder, "events").select("user_id", "ts", "event_id")
    ts = e.schema["ts"].dataType.simpleString()
    place = Scratch(spark, "stream").base
    e.select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{place}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{place}/in")
    jobs.run_activity(stream, "user_id", f"{place}/out", f"{place}/checkpoint").awaitTermination()
    status = jobs.activity_status(jobs.newest_windows(spark, f"{place}/out", "user_id"), "user_id", "2024-02-28")
    return status.withColumn("last_seen", F.col("last_seen").cast(ts))


@query(
    "x01_ingest_stream",
    f"""WITH {_LINE}
    SELECT 'component' AS kind, any_value('org.shop.' || brand || ':' || part_name) AS key, any_value('org.shop.' || brand || '.' || part_name) AS name,
           first(v ORDER BY doc) AS version, true AS internal, any_value(brand) AS group_key, NULL AS dst FROM good GROUP BY part
    UNION ALL SELECT 'component', any_value('com.supply:' || supplier_name), any_value('com.supply.' || supplier_name), '9', false, NULL, NULL FROM good GROUP BY supplier
    UNION ALL SELECT DISTINCT 'edge', 'org.shop.' || brand || ':' || part_name, NULL, NULL, NULL, NULL, 'com.supply:' || supplier_name FROM good
    UNION ALL SELECT DISTINCT 'reject', doc, NULL, NULL, NULL, NULL, 'unreadable document' FROM line WHERE flag = 'R'""",
)
def ingest_stream(spark, folder):
    """The order-line documents arriving as files in at least three batches, appended batch by batch."""
    place = Scratch(spark, "ingest").base
    files = 3 * spark.sparkContext.defaultParallelism
    _sboms(spark, folder).repartition(files, "doc").write.parquet(f"{place}/in")
    stream = spark.readStream.schema("doc string, text string").option("maxFilesPerTrigger", files // 3).parquet(f"{place}/in")
    jobs.ingest_sboms(stream, f"{place}/out", f"{place}/checkpoint", PREFIX).awaitTermination()
    none = F.lit(None).cast("string")
    found = jobs.stored_components(spark, f"{place}/out").select(F.lit("component").alias("kind"), "key", *jobs.FIELDS, none.alias("dst"))
    edges = jobs.stored_edges(spark, f"{place}/out").select(F.lit("edge").alias("kind"), F.col("src").alias("key"), "dst")
    bad = jobs.stored_rejects(spark, f"{place}/out").select(F.lit("reject").alias("kind"), F.col("doc").alias("key"), F.col("error").alias("dst"))
    return found.unionByName(edges, True).unionByName(bad, True)
