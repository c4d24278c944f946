"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.operators import adjacency as adj
from strataweave.operators import centrality, clusters, communities, cycles, density, ordering, reports, snapshots
from strataweave.plans.graphs import (
    BOTH_SQL, DIRECTED_SQL, LATEST_SQL, MODULAR_SQL, ORDERED_SQL, PEAK_SQL, directed_edges, latest_edges, modular_edges,
    ordered_edges, part_nodes, peak_edges, table,
)
from strataweave.plans.inputs import COMPONENT_SQL, components, saved
from strataweave.plans.registry import query

NODE = "node AS (SELECT p_partkey AS id FROM part)"


def _deg(g: str) -> str:
    """Degrees of every node of graph ``g``."""
    return f"""
deg AS (
  SELECT id, CAST(coalesce(i, 0) AS BIGINT) AS fan_in, CAST(coalesce(o, 0) AS BIGINT) AS fan_out
  FROM node LEFT JOIN (SELECT dst AS id, count(*) AS i FROM {g} GROUP BY 1) USING (id)
            LEFT JOIN (SELECT src AS id, count(*) AS o FROM {g} GROUP BY 1) USING (id)),
metric AS (
  SELECT *, 0.6 * fan_in + 0.4 * fan_out AS coupling_score,
         CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out)::DOUBLE ELSE 0.0 END AS instability,
         (fan_in + fan_out) / (2.0 * ((SELECT count(*) FROM node) - 1)) AS degree_centrality,
         fan_in * 2 + fan_out AS hub_score
  FROM deg)"""


def _reach(g: str) -> str:
    return f"reach AS (SELECT src, dst FROM {g} UNION SELECT r.src, e.dst FROM reach r JOIN {g} e ON r.dst = e.src)"


_SCC = """
scc AS (
  SELECT id, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size
  FROM (SELECT id, coalesce(least(id, m), id) AS scc_id
        FROM node LEFT JOIN (SELECT a.src AS id, min(a.dst) AS m FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) USING (id)))"""


def _scc(g: str) -> str:
    return _reach(g) + "," + _SCC


def _big_scc(g: str) -> str:
    """The component of the busiest node by two plain searches, closures on the rest only."""
    return f"""
seed AS MATERIALIZED (SELECT src AS id FROM {g} GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1),
fw AS (SELECT id FROM seed UNION SELECT dst FROM fw JOIN {g} ON src = fw.id),
bw AS (SELECT id FROM seed UNION SELECT src FROM bw JOIN {g} ON dst = bw.id),
giant AS MATERIALIZED (SELECT id FROM fw WHERE id IN (SELECT id FROM bw)),
rest AS MATERIALIZED (SELECT src, dst FROM {g} WHERE src NOT IN (SELECT id FROM giant) AND dst NOT IN (SELECT id FROM giant)),
reach AS (SELECT src, dst FROM rest UNION SELECT r.src, e.dst FROM reach r JOIN rest e ON r.dst = e.src),
low AS (SELECT a.src AS id, min(a.dst) AS m FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
scc AS MATERIALIZED (
  SELECT id, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size
  FROM (SELECT id, CASE WHEN id IN (SELECT id FROM giant) THEN (SELECT min(id) FROM giant) ELSE coalesce(least(id, m), id) END AS scc_id
        FROM node LEFT JOIN low USING (id)))"""


def _wcc(g: str) -> str:
    return f"""
und AS MATERIALIZED (SELECT src AS a, dst AS b FROM {g} UNION SELECT dst, src FROM {g}),
start AS MATERIALIZED (SELECT a AS id FROM und GROUP BY 1 ORDER BY count(*) DESC, a LIMIT 1),
most AS (SELECT id FROM start UNION SELECT b FROM most JOIN und ON a = most.id),
lab AS (SELECT id AS n, id AS l FROM node WHERE id NOT IN (SELECT id FROM most)
        UNION SELECT u.b, c.l FROM lab c JOIN und u ON u.a = c.n WHERE c.l < u.b),
wcc AS (SELECT n AS id, min(l) AS component FROM lab GROUP BY 1 UNION ALL SELECT id, (SELECT min(id) FROM most) FROM most),
info AS (SELECT component, count(*) AS size FROM wcc GROUP BY 1),
main AS (SELECT component FROM info ORDER BY size DESC, component LIMIT 1)"""


def _peak(spark, folder):
    return saved(spark, part_nodes(spark, folder)), saved(spark, peak_edges(spark, folder))


def _modular(spark, folder):
    return saved(spark, part_nodes(spark, folder)), saved(spark, modular_edges(spark, folder))


def _directed(spark, folder):
    return saved(spark, part_nodes(spark, folder)), saved(spark, directed_edges(spark, folder))


def _latest(spark, folder):
    return saved(spark, part_nodes(spark, folder)), saved(spark, latest_edges(spark, folder))


def _ordered(spark, folder):
    return saved(spark, part_nodes(spark, folder)), saved(spark, ordered_edges(spark, folder))


@query("g01_adjacency", f"WITH {NODE}, {PEAK_SQL} SELECT id, dst FROM node LEFT JOIN peak ON id = src")
def _(spark, folder):
    return adj.adjacency(part_nodes(spark, folder), peak_edges(spark, folder))


@query("g02_undirected", f"WITH {PEAK_SQL} SELECT src, dst FROM peak UNION SELECT dst, src FROM peak")
def _(spark, folder):
    return adj.undirected(peak_edges(spark, folder))


@query(
    "g18_g19_g20_node_degrees",
    f"""WITH {NODE}, {PEAK_SQL}, {_deg("peak")}
    SELECT id, fan_in, fan_out, round(coupling_score, 6) AS coupling_score, round(instability, 6) AS instability,
           round(degree_centrality, 6) AS degree_centrality, hub_score FROM metric""",
)
def node_degrees(spark, folder):
    d = adj.node_degrees(part_nodes(spark, folder), peak_edges(spark, folder))
    return d.select(
        "id", "fan_in", "fan_out", F.round("coupling_score", 6).alias("coupling_score"),
        F.round("instability", 6).alias("instability"), F.round("degree_centrality", 6).alias("degree_centrality"), "hub_score",
    )


@query(
    "o01_most_coupled",
    f"""WITH {NODE}, {PEAK_SQL}, {_deg("peak")}
    SELECT id, fan_in, fan_out, round(coupling_score, 6) AS coupling_score FROM metric ORDER BY metric.coupling_score DESC, id LIMIT 20""",
)
def most_coupled(spark, folder):
    d = adj.node_degrees(part_nodes(spark, folder), peak_edges(spark, folder))
    return d.orderBy(F.desc("coupling_score"), "id").limit(20).select(
        "id", "fan_in", "fan_out", F.round("coupling_score", 6).alias("coupling_score")
    )


@query(
    "a14_high_coupling",
    f"""WITH {NODE}, {PEAK_SQL}, {_deg("peak")},
    ranked AS (SELECT coupling_score AS s, row_number() OVER (ORDER BY coupling_score) - 1 AS i, count(*) OVER () AS n FROM metric),
    cut AS (SELECT s FROM ranked WHERE i = least(CAST(floor(n * 90.0 / 100.0) AS BIGINT), n - 1))
    SELECT id, fan_in, fan_out, round(coupling_score, 6) AS coupling_score FROM metric, cut WHERE coupling_score >= s""",
)
def _(spark, folder):
    d = adj.node_degrees(part_nodes(spark, folder), peak_edges(spark, folder))
    return adj.at_or_above_percentile(d, "coupling_score", 90).select(
        "id", "fan_in", "fan_out", F.round("coupling_score", 6).alias("coupling_score")
    )


@query(
    "f22_highlight_percentile",
    f"""WITH {NODE}, {PEAK_SQL}, {_deg("peak")},
    ranked AS (SELECT hub_score AS s, row_number() OVER (ORDER BY hub_score) - 1 AS i, count(*) OVER () AS n FROM metric),
    cut AS (SELECT s FROM ranked WHERE i = least(CAST(floor(n * 75.0 / 100.0) AS BIGINT), n - 1))
    SELECT id, hub_score FROM metric, cut WHERE hub_score >= s""",
)
def _(spark, folder):
    d = adj.node_degrees(part_nodes(spark, folder), peak_edges(spark, folder))
    return adj.at_or_above_percentile(d, "hub_score", 75).select("id", "hub_score")


@query("g06_connected_components", f"WITH RECURSIVE {NODE}, {PEAK_SQL}, {_wcc('peak')} SELECT id, component FROM wcc")
def connected(spark, folder):
    return clusters.connected_components(*_peak(spark, folder))


@query(
    "g07_cluster_info",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_wcc('peak')}
    SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS rank, component = (SELECT component FROM main) AS is_main
    FROM info""",
)
def _(spark, folder):
    c = clusters.connected_components(*_peak(spark, folder))
    return clusters.ranked_clusters(c).select("component", "size", "rank", "is_main")


@query(
    "a02_connectivity_counts",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_wcc('peak')},
    f AS (SELECT id, component = (SELECT component FROM main) AS in_main, id IN (SELECT dst FROM peak) AS used FROM wcc)
    SELECT count(*) AS total, count(*) FILTER (in_main) AS main_cluster, count(*) FILTER (NOT in_main) AS disconnected,
           count(*) FILTER (NOT used) AS unused, count(*) FILTER (used) AS used FROM f""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    return clusters.connectivity_counts(n, e, clusters.connected_components(n, e))


@query(
    "u06_disconnected_used",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_wcc('peak')}
    SELECT id FROM wcc WHERE component <> (SELECT component FROM main) AND id IN (SELECT dst FROM peak)""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    c = clusters.connected_components(n, e)
    return clusters.connectivity_flags(n, e, c).where("NOT in_main AND used").select("id")


@query(
    "a17_a23_cluster_report",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_deg("peak")}, {_wcc('peak')}, {COMPONENT_SQL}
    SELECT w.component, count(*) AS size, first(name ORDER BY hub_score DESC, id) AS hub, max(hub_score) AS hub_score
    FROM wcc w JOIN metric USING (id) JOIN (SELECT id, name FROM component) USING (id)
    GROUP BY w.component ORDER BY size DESC, w.component LIMIT 10""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    return clusters.cluster_report(
        components(spark, folder), adj.node_degrees(n, e), clusters.connected_components(n, e)
    )


@query(
    "a17_cluster_members",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_wcc('peak')},
    top AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) AS rank FROM info ORDER BY rank LIMIT 10)
    SELECT rank, component, id FROM top JOIN wcc USING (component)""",
)
def _(spark, folder):
    return clusters.cluster_members(clusters.connected_components(*_peak(spark, folder)))


@query("g03_scc", f"WITH RECURSIVE {NODE}, {PEAK_SQL}, {_big_scc('peak')} SELECT id, scc_id, scc_size FROM scc")
def strongly_connected(spark, folder):
    return cycles.scc(*_peak(spark, folder))


@query(
    "g04_condense",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL}, {_scc('latest')}
    SELECT DISTINCT a.scc_id AS src_scc, b.scc_id AS dst_scc FROM latest JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.scc_id <> b.scc_id""",
)
def _(spark, folder):
    n, e = _latest(spark, folder)
    return cycles.condense(e, cycles.scc(n, e))


@query(
    "g05_cycle_edges",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_big_scc('peak')}
    SELECT src, dst FROM peak JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.scc_id = b.scc_id AND (a.scc_size > 1 OR src = dst)""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    return cycles.cycle_edges(e, cycles.scc(n, e))


@query(
    "a15_scc_summary",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_big_scc('peak')}, s AS (SELECT scc_id, count(*) AS size FROM scc GROUP BY 1)
    SELECT count(*) AS total_sccs, count(*) FILTER (size > 1) AS cyclic_sccs, max(size) AS largest_scc FROM s""",
)
def _(spark, folder):
    return cycles.scc_summary(cycles.scc(*_peak(spark, folder)))


@query(
    "a15_largest_sccs",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_big_scc('peak')},
    s AS (SELECT scc_id, count(*) AS size FROM scc GROUP BY 1 HAVING count(*) > 1 ORDER BY size DESC, scc_id LIMIT 5)
    SELECT scc_id, size, id FROM s JOIN scc USING (scc_id)""",
)
def _(spark, folder):
    return cycles.largest_sccs(cycles.scc(*_peak(spark, folder)))


@query(
    "g36_scc_ranking",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_big_scc('peak')},
    x AS (SELECT a.scc_id AS sa, b.scc_id AS sb FROM peak JOIN scc a ON a.id = src JOIN scc b ON b.id = dst),
    s AS (SELECT scc_id, count(*) AS size FROM scc GROUP BY 1 HAVING count(*) > 1)
    SELECT row_number() OVER (ORDER BY size DESC, scc_id) AS rank, scc_id, size, (SELECT count(*) FROM x WHERE sa = scc_id AND sb = scc_id) AS internal_edges,
           (SELECT count(*) FROM x WHERE sa <> sb AND (sa = scc_id OR sb = scc_id)) AS external_edges FROM s""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    return cycles.scc_ranking(e, cycles.scc(n, e))


def _cycles_sql(g: str, length: int) -> str:
    return f"""
    path AS (SELECT src AS start, dst AS last, [src, dst] AS p FROM {g} WHERE dst > src
             UNION ALL SELECT start, e.dst, list_append(p, e.dst) FROM path JOIN {g} e ON e.src = last
             WHERE e.dst > start AND NOT list_contains(p, e.dst) AND len(p) < {length})
    SELECT array_to_string(p, '>') AS cycle, len(p) AS length FROM path JOIN {g} e ON e.src = last AND e.dst = start"""


# more than 25 cycles have at most 3 nodes, so the SQL need not look for longer ones
@query("g15_enumerate_cycles", f"WITH RECURSIVE {PEAK_SQL}, {_cycles_sql('peak', 3)} ORDER BY length, p LIMIT 25")
def bounded_cycles(spark, folder):
    n, e = _peak(spark, folder)
    found = cycles.enumerate_cycles(e, cycles.scc(n, e), 8, max_cycles=25)
    return found.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "length")


@query("g16_cycles_up_to_length_10", f"WITH RECURSIVE {LATEST_SQL}, {_cycles_sql('latest', 10)}")
def _(spark, folder):
    n, e = _latest(spark, folder)
    found = cycles.enumerate_cycles(e, cycles.scc(n, e), 10, self_loops=True)
    return found.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "length")


@query(
    "g17_cycle_steps_checked",
    f"""WITH {BOTH_SQL},
    claim AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM latest a JOIN latest b ON a.dst = b.src WHERE a.src <> b.dst),
    step AS (SELECT x, y, z, x AS src, y AS dst FROM claim UNION ALL SELECT x, y, z, y, z FROM claim UNION ALL SELECT x, y, z, z, x FROM claim)
    SELECT CAST(x AS VARCHAR) || '>' || y || '>' || z AS cycle, src, dst FROM step WHERE (src, dst) NOT IN (SELECT src, dst FROM peak)""",
)
def _(spark, folder):
    """Every two-step path of one graph, claimed to close, checked against the other graph."""
    e = latest_edges(spark, folder).select("src", "dst").distinct()
    a, b = e.toDF("x", "y"), e.toDF("y", "z")
    claims = a.join(b, "y").where("x <> z").select(F.array("x", "y", "z").alias("cycle"))
    bad = cycles.invalid_cycle_steps(claims, peak_edges(spark, folder))
    return bad.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "src", "dst")


def _hubs_sql(n: int) -> str:
    return f"hub AS (SELECT id FROM metric ORDER BY hub_score DESC, id LIMIT {n})"


def _bfs(name: str, g: str, start: str, depth: int) -> str:
    return f"""
    {name} AS (SELECT id, 0 AS d FROM {start} UNION SELECT e.b, d + 1 FROM {name} JOIN {g} e ON e.a = {name}.id WHERE d < {depth})"""


@query(
    "g08_traverse_down",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_deg("peak")}, {_hubs_sql(1)}, way AS (SELECT src AS a, dst AS b FROM peak), {_bfs("walk", "way", "hub", 20)}
    SELECT (SELECT id FROM hub) AS start, id, CAST(min(d) AS BIGINT) AS depth FROM walk GROUP BY id""",
)
def traverse_down(spark, folder):
    n, e = _peak(spark, folder)
    start = reports.top_hubs(components(spark, folder), adj.node_degrees(n, e), 1)
    return ordering.traverse(e, start, "down")


@query(
    "g08_traverse_up_depth_4",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_deg("peak")}, {_hubs_sql(1)}, way AS (SELECT dst AS a, src AS b FROM peak), {_bfs("walk", "way", "hub", 4)}
    SELECT (SELECT id FROM hub) AS start, id, CAST(min(d) AS BIGINT) AS depth FROM walk GROUP BY id""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    start = reports.top_hubs(components(spark, folder), adj.node_degrees(n, e), 1)
    return ordering.traverse(e, start, "up", max_depth=4)


@query(
    "g08_reach_of_every_node",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL},
    walk AS (SELECT id AS start, id, 0 AS d FROM node UNION SELECT start, e.dst, d + 1 FROM walk JOIN latest e ON e.src = walk.id WHERE d < 40),
    best AS (SELECT start, id, min(d) AS d FROM walk GROUP BY 1, 2)
    SELECT start, count(*) AS reached, CAST(max(d) AS BIGINT) AS deepest FROM best GROUP BY 1""",
)
def _(spark, folder):
    n, e = _latest(spark, folder)
    r = ordering.traverse(e, n, "down")
    return r.groupBy("start").agg(F.count("*").alias("reached"), F.max("depth").alias("deepest"))


@query(
    "g09_expand_degree_2",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_deg("peak")}, {_hubs_sql(20)},
    way AS (SELECT src AS a, dst AS b FROM peak UNION SELECT dst, src FROM peak), {_bfs("walk", "way", "hub", 2)}
    SELECT id, CAST(min(d) AS BIGINT) AS depth FROM walk GROUP BY id""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    return ordering.expand(e, reports.top_hubs(components(spark, folder), adj.node_degrees(n, e), 20), 2)


_STUCK = """
    stuck AS (SELECT src AS id FROM reach WHERE src = dst UNION SELECT dst FROM reach WHERE src IN (SELECT src FROM reach WHERE src = dst))"""


def _topo(g: str) -> str:
    return f"""{_STUCK},
    free AS (SELECT src, dst FROM {g} WHERE dst NOT IN (SELECT id FROM stuck)),
    climb AS (SELECT id, 0 AS k FROM node WHERE id NOT IN (SELECT id FROM stuck) UNION SELECT dst, k + 1 FROM climb JOIN free ON src = climb.id),
    placed AS (SELECT id, CAST(max(k) AS BIGINT) AS wave FROM climb GROUP BY 1),
    ord AS (SELECT id, wave, row_number() OVER (ORDER BY wave, id) - 1 AS position FROM placed)"""


_LONGEST = """
    climb AS (SELECT id, 0 AS k FROM node UNION SELECT dst, k + 1 FROM climb JOIN directed ON src = climb.id),
    placed AS (SELECT id, CAST(max(k) AS BIGINT) AS wave FROM climb GROUP BY 1),
    ord AS (SELECT id, wave, row_number() OVER (ORDER BY wave, id) - 1 AS position FROM placed)"""


@query(
    "g10_w04_topological_order",
    f"WITH RECURSIVE {NODE}, {DIRECTED_SQL}, {_LONGEST} SELECT id, wave, position FROM node LEFT JOIN ord USING (id)",
)
def topological_order(spark, folder):
    return ordering.topological_order(*_directed(spark, folder))


@query(
    "g10_residual_edges",
    f"""WITH RECURSIVE {NODE}, {PEAK_SQL}, {_big_scc('peak')},
    stuck AS (SELECT id FROM fw WHERE (SELECT count(*) FROM giant) > 1 UNION SELECT src FROM reach WHERE src = dst
              UNION SELECT dst FROM reach WHERE src IN (SELECT src FROM reach WHERE src = dst))
    SELECT src, dst FROM peak WHERE src IN (SELECT id FROM stuck)""",
)
def _(spark, folder):
    return ordering.residual_edges(*_peak(spark, folder))


@query(
    "g10_is_dag",
    f"""WITH RECURSIVE {NODE}, {ORDERED_SQL}, {PEAK_SQL[PEAK_SQL.index("peak_scoped"):]}, {_big_scc('peak')}
    SELECT 'peak' AS graph, (SELECT count(*) FROM giant) <= 1 AND NOT EXISTS (SELECT 1 FROM reach WHERE src = dst) AS is_dag
    UNION ALL SELECT 'ordered', true""",
)
def _(spark, folder):
    """A graph that is mostly one cycle, and one whose edges all point to the larger id."""
    n, e = _peak(spark, folder)
    found = ordering.is_dag(n, e).select(F.lit("peak").alias("graph"), "is_dag")
    n, e = _ordered(spark, folder)
    return found.unionByName(ordering.is_dag(n, e).select(F.lit("ordered").alias("graph"), "is_dag"))


_LAYERS = """
    dag AS (SELECT DISTINCT a.scc_id AS src, b.scc_id AS dst FROM latest JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.scc_id <> b.scc_id),
    rise AS (SELECT DISTINCT scc_id AS id, 0 AS k FROM scc UNION SELECT dst, k + 1 FROM rise JOIN dag ON src = rise.id),
    layer AS (SELECT id, CAST(max(k) AS BIGINT) AS layer FROM rise GROUP BY 1)"""


@query(
    "g11_topological_layers",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL}, {_scc('latest')}, {_LAYERS}
    SELECT scc.id, layer FROM scc JOIN layer ON layer.id = scc_id""",
)
def topological_layers(spark, folder):
    n, e = _latest(spark, folder)
    return ordering.topological_layers(n, e, cycles.scc(n, e))


_REDUNDANT = """
    dag AS (SELECT DISTINCT a.scc_id AS src, b.scc_id AS dst FROM latest JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.scc_id <> b.scc_id),
    down AS (SELECT src, dst FROM dag UNION SELECT d.src, e.dst FROM down d JOIN dag e ON d.dst = e.src),
    red AS (SELECT DISTINCT g.src, g.dst FROM dag g JOIN dag o ON o.src = g.src AND o.dst <> g.dst JOIN down r ON r.src = o.dst AND r.dst = g.dst),
    flag AS (SELECT l.src, l.dst, l.src = l.dst OR red.src IS NOT NULL AS transitive
             FROM latest l JOIN scc a ON a.id = l.src JOIN scc b ON b.id = l.dst LEFT JOIN red ON red.src = a.scc_id AND red.dst = b.scc_id)"""


@query(
    "g12_transitive_edges",
    f"WITH RECURSIVE {NODE}, {LATEST_SQL}, {_scc('latest')}, {_REDUNDANT} SELECT src, dst, transitive FROM flag",
)
def transitive(spark, folder):
    n, e = _latest(spark, folder)
    return ordering.transitive_edges(n, e, cycles.scc(n, e))


@query(
    "g12_transitive_edges_acyclic",
    f"""WITH RECURSIVE {ORDERED_SQL}, {_reach('ordered')}
    SELECT o.src, o.dst, EXISTS (SELECT 1 FROM ordered w JOIN reach r ON r.src = w.dst WHERE w.src = o.src AND w.dst <> o.dst AND r.dst = o.dst) AS transitive
    FROM ordered o""",
)
def _(spark, folder):
    n, e = _ordered(spark, folder)
    return ordering.transitive_edges(n, e, cycles.scc(n, e))


@query("g13_louvain")
def louvain(spark, folder):
    return communities.louvain(*_peak(spark, folder))


def _propagation(g: str, rounds: int) -> str:
    parts = [f"pairs AS (SELECT src AS a, dst AS b FROM {g} UNION SELECT dst, src FROM {g})", "p0 AS (SELECT id, id AS community FROM node)"]
    for k in range(rounds):
        parts.append(
            f"""p{k + 1} AS MATERIALIZED (
      SELECT id, coalesce(pick, community) AS community FROM p{k} LEFT JOIN (
        SELECT id, community AS pick FROM (
          SELECT b AS id, community, row_number() OVER (PARTITION BY b ORDER BY count(*) DESC, community) AS r
          FROM pairs JOIN p{k} ON p{k}.id = a GROUP BY b, community) WHERE r = 1) USING (id))"""
        )
    return ",\n".join(parts)


@query("g14_label_propagation", f"WITH {NODE}, {PEAK_SQL}, {_propagation('peak', 10)} SELECT id, community FROM p10")
def propagation(spark, folder):
    return communities.label_propagation(*_peak(spark, folder))


@query(
    "g14_main_cluster",
    f"""WITH RECURSIVE {NODE}, {MODULAR_SQL}, {_wcc('modular')}, {_propagation('modular', 10)}
    SELECT id, community FROM p10 JOIN wcc USING (id) WHERE component = (SELECT component FROM main) AND (SELECT max(size) FROM info) > 10""",
)
def _(spark, folder):
    n, e = _modular(spark, folder)
    return communities.main_cluster_communities(n, e, clusters.connected_components(n, e))


@query(
    "g37_modularity",
    f"""WITH {NODE}, {PEAK_SQL}, {_propagation('peak', 10)},
    m AS (SELECT count(*) / 2.0 AS m FROM pairs),
    x AS (SELECT p.community AS ca, q.community AS cb FROM pairs JOIN p10 p ON p.id = a JOIN p10 q ON q.id = b),
    per AS (SELECT ca AS community, CAST(count(*) FILTER (ca = cb) / 2 AS BIGINT) AS internal, count(*) FILTER (ca <> cb) AS external, count(*) AS ends FROM x GROUP BY 1),
    s AS (SELECT community, count(*) AS size FROM p10 GROUP BY 1)
    SELECT community, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external,
           round(CASE WHEN internal + external > 0 THEN internal / (internal + external)::DOUBLE ELSE 0.0 END, 6) AS cohesion,
           round(coalesce(internal, 0) / m - pow(coalesce(ends, 0) / (2 * m), 2), 6) AS modularity
    FROM s LEFT JOIN per USING (community), m""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    m = communities.modularity(e, communities.label_propagation(n, e))
    return m.withColumn("cohesion", F.round("cohesion", 6)).withColumn("modularity", F.round("modularity", 6))


@query(
    "a20_community_edges",
    f"""WITH {NODE}, {PEAK_SQL}, {_propagation('peak', 10)},
    x AS (SELECT p.community AS ca, q.community AS cb FROM peak JOIN p10 p ON p.id = src JOIN p10 q ON q.id = dst)
    SELECT ca AS community, count(*) FILTER (ca = cb) AS internal, count(*) FILTER (ca <> cb) AS external,
           round(count(*) FILTER (ca = cb) / greatest(count(*) FILTER (ca <> cb), 1)::DOUBLE, 6) AS ratio FROM x GROUP BY 1""",
)
def _(spark, folder):
    n, e = _peak(spark, folder)
    c = communities.community_edges(e, communities.label_propagation(n, e))
    return c.withColumn("ratio", F.round("ratio", 6))


def _between(g: str, depth: int) -> str:
    return f"""
    walk AS (SELECT src AS s, dst AS t, 1 AS d, 1.0::DOUBLE AS c FROM {g}
             UNION ALL SELECT s, e.dst, d + 1, c FROM walk JOIN {g} e ON e.src = t WHERE d < {depth}),
    dist AS (SELECT s, t, min(d) AS d FROM walk WHERE s <> t GROUP BY 1, 2),
    sp AS (SELECT w.s, w.t, w.d, sum(c) AS n FROM walk w JOIN dist x ON x.s = w.s AND x.t = w.t AND x.d = w.d GROUP BY 1, 2, 3),
    mid AS (SELECT a.t AS id, sum(a.n * b.n / st.n) AS raw FROM sp a JOIN sp b ON b.s = a.t JOIN sp st ON st.s = a.s AND st.t = b.t
            WHERE a.d + b.d = st.d AND a.s <> b.t GROUP BY 1),
    bet AS (SELECT id, coalesce(raw, 0.0) / ((SELECT count(*) FROM node) - 1.0) / ((SELECT count(*) FROM node) - 2.0) AS betweenness
            FROM node LEFT JOIN mid USING (id))"""


@query(
    "g21_betweenness",
    f"WITH RECURSIVE {NODE}, {LATEST_SQL}, {_between('latest', 14)} SELECT id, round(betweenness, 9) AS betweenness, true AS exact FROM bet",
)
def betweenness(spark, folder):
    b = centrality.betweenness(*_latest(spark, folder))
    return b.withColumn("betweenness", F.round("betweenness", 9))


@query(
    "g22_all_metrics",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL}, {_deg("latest")}, {_scc('latest')}, {_topo('latest')}, {_LAYERS}, {_between('latest', 14)}
    SELECT metric.id, fan_in, fan_out, round(coupling_score, 6) AS coupling_score, round(instability, 6) AS instability,
           round(degree_centrality, 6) AS degree_centrality, round(betweenness, 9) AS betweenness, position, layer.layer
    FROM metric JOIN bet USING (id) LEFT JOIN ord USING (id) JOIN scc USING (id) JOIN layer ON layer.id = scc_id""",
)
def all_metrics(spark, folder):
    n, e = _latest(spark, folder)
    m = centrality.all_metrics(n, e, saved(spark, cycles.scc(n, e)))
    six = [F.round(c, 6).alias(c) for c in ("coupling_score", "instability", "degree_centrality")]
    return m.select("id", "fan_in", "fan_out", *six, F.round("betweenness", 9).alias("betweenness"), "position", "layer")


@query(
    "a16_hotspots",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL}, {_deg("latest")}, {_between('latest', 14)},
    a AS (SELECT 'instability' AS report, id, instability AS score FROM metric WHERE instability > 0.7 ORDER BY instability DESC, id LIMIT 5),
    b AS (SELECT 'betweenness' AS report, id, betweenness AS score FROM bet ORDER BY betweenness DESC, id LIMIT 5),
    c AS (SELECT 'coupling' AS report, id, coupling_score AS score FROM metric ORDER BY coupling_score DESC, id LIMIT 5)
    SELECT report, id, round(score, 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
)
def _(spark, folder):
    n, e = _latest(spark, folder)
    m = adj.node_degrees(n, e).join(centrality.betweenness(n, e), "id")
    return centrality.hotspots(m).withColumn("score", F.round("score", 9))


@query(
    "g23_closeness",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL},
    walk AS (SELECT src AS s, dst AS t, 1 AS d FROM latest UNION SELECT s, e.dst, d + 1 FROM walk JOIN latest e ON e.src = t WHERE d < 40),
    dist AS (SELECT s, t, min(d) AS d FROM walk WHERE s <> t GROUP BY 1, 2),
    far AS (SELECT s AS id, count(*) AS r, sum(d) AS far FROM dist GROUP BY 1)
    SELECT id, round(coalesce(r / far::DOUBLE * r / ((SELECT count(*) FROM node) - 1), 0.0), 9) AS score FROM node LEFT JOIN far USING (id)""",
)
def closeness(spark, folder):
    return centrality.closeness(*_latest(spark, folder)).withColumn("score", F.round("score", 9))


@query("g23_closeness_sketched")
def closeness_sketched(spark, folder):
    """Every node of the whole listing; an estimate, held against the exact form in tests."""
    return centrality.closeness_sketched(*_peak(spark, folder))


def _power(g: str, rounds: int) -> str:
    parts = ["v0 AS (SELECT id, 1.0 / sqrt(CAST((SELECT count(*) FROM node) AS DOUBLE)) AS s FROM node)"]
    for k in range(rounds):
        parts.append(
            f"""r{k + 1} AS MATERIALIZED (SELECT id, sum(s) AS s FROM (SELECT id, s FROM v{k} UNION ALL SELECT dst, s FROM {g} JOIN v{k} ON v{k}.id = src) GROUP BY id),
    v{k + 1} AS MATERIALIZED (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM r{k + 1}) AS s FROM r{k + 1})"""
        )
    return ",\n".join(parts)


@query("g24_eigenvector", f"WITH {NODE}, {PEAK_SQL}, {_power('peak', 20)} SELECT id, round(s, 7) AS score FROM v20")
def eigenvector(spark, folder):
    return centrality.eigenvector(*_peak(spark, folder)).withColumn("score", F.round("score", 7))


@query(
    "g25_o02_top_hubs",
    f"""WITH {NODE}, {PEAK_SQL}, {_deg("peak")}, {COMPONENT_SQL}
    SELECT id, name, fan_in, fan_out, hub_score FROM metric JOIN component USING (id) ORDER BY hub_score DESC, id LIMIT 20""",
)
def _(spark, folder):
    n, e = part_nodes(spark, folder), peak_edges(spark, folder)
    return reports.top_hubs(components(spark, folder), adj.node_degrees(n, e))


_ANCHOR_SQL = f"""
    named AS (
      SELECT id, name, lower(replace(replace(name, ' ', '-'), '_', '-')) AS plain,
        CASE {" ".join(f"WHEN ends_with(lower(name), '{s}') THEN left(lower(name), length(name) - {len(s)})" for s in reports.DOMAIN_SUFFIXES)}
             {" ".join(f"WHEN starts_with(lower(name), '{s}') THEN substr(lower(name), {len(s) + 1})" for s in reports.DOMAIN_PREFIXES)}
             ELSE split_part(lower(name), '-', 1) END AS domain
      FROM component),
    word AS (SELECT *, CASE WHEN contains(domain, '-') THEN split_part(domain, '-', 1) ELSE left(domain, 4) END AS word FROM named),
    coh AS (SELECT dst AS id, count(*) FILTER (t.word <> '' AND contains(s.plain, t.word)) AS hits, count(*) AS deps
            FROM modular JOIN word t ON t.id = dst JOIN word s ON s.id = src GROUP BY 1),
    judged AS (
      SELECT id, domain, fan_in AS n, fan_out AS o,
        CASE WHEN fan_in > 0 THEN fan_in / (fan_out + 1)::DOUBLE ELSE 0.0 END AS ratio,
        CASE WHEN domain <> '' AND deps > 0 THEN hits / deps::DOUBLE ELSE 0.0 END AS coherent,
        {" OR ".join(f"regexp_matches(plain, '{p}')" for p in reports.ANCHOR_PATTERNS)} AS name_match,
        {" OR ".join(f"regexp_matches(plain, '{p}')" for p in reports.INFRASTRUCTURE_PATTERNS)} AS infra
      FROM word JOIN deg USING (id) LEFT JOIN coh USING (id)),
    anchor AS (
      SELECT *, CASE WHEN (name_match AND n >= 2 AND NOT infra) OR (coherent >= 0.3 AND n >= 3)
                       OR (ratio >= 5 AND n >= 5 AND NOT infra AND coherent >= 0.2) THEN 'domain_anchor'
                     WHEN infra AND ratio >= 3 AND n >= 5 THEN 'infrastructure' END AS kind FROM judged)"""


@query(
    "g26_g27_domain_anchors",
    f"""WITH {NODE}, {MODULAR_SQL}, {_deg("modular")}, {COMPONENT_SQL}, {_ANCHOR_SQL}
    SELECT id, kind, domain, n AS in_degree, o AS out_degree, round_even(ratio, 2) AS anchor_ratio, round_even(coherent, 2) AS name_coherence, name_match
    FROM anchor WHERE kind IS NOT NULL""",
)
def domain_anchors(spark, folder):
    n, e = _modular(spark, folder)
    return reports.domain_anchors(components(spark, folder), e, adj.node_degrees(n, e))


@query(
    "g28_cluster_by_anchors",
    f"""WITH RECURSIVE {NODE}, {MODULAR_SQL}, {_deg("modular")}, {COMPONENT_SQL}, {_ANCHOR_SQL},
    own AS (SELECT id, n FROM anchor WHERE kind = 'domain_anchor'),
    walk AS (SELECT id AS start, id, 0 AS d FROM node WHERE id NOT IN (SELECT id FROM own)
             UNION SELECT start, dst, d + 1 FROM walk JOIN modular ON src = walk.id WHERE d < 4 AND walk.id NOT IN (SELECT id FROM own)),
    hit AS (SELECT start AS id, own.id AS anchor_id, row_number() OVER (PARTITION BY start ORDER BY n DESC, own.id) AS r FROM walk JOIN own ON own.id = walk.id)
    SELECT node.id, CASE WHEN own.id IS NOT NULL THEN own.id ELSE hit.anchor_id END AS anchor_id, own.id IS NOT NULL AS is_anchor
    FROM node LEFT JOIN own ON own.id = node.id LEFT JOIN hit ON hit.id = node.id AND hit.r = 1""",
)
def _(spark, folder):
    n, e = _modular(spark, folder)
    nodes = components(spark, folder)
    found = reports.domain_anchors(nodes, e, adj.node_degrees(n, e)).where("kind = 'domain_anchor'")
    return reports.cluster_by_anchors(n, e, saved(spark, found))


_DBSCAN_SQL = """
    pt AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
    near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id <> b.id AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2
             AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.5),
    core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 2),
    link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    grow AS (SELECT id AS n, id AS l FROM core UNION SELECT b, l FROM grow JOIN link ON a = n WHERE l < b),
    seed AS (SELECT n AS id, min(l) AS first FROM grow GROUP BY 1),
    num AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT DISTINCT first FROM seed)),
    cored AS (SELECT id, cluster FROM seed JOIN num USING (first)),
    edge AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN cored ON cored.id = b WHERE a NOT IN (SELECT id FROM core) GROUP BY 1),
    clustered AS (SELECT pt.id, coalesce(cored.cluster, edge.cluster) AS cluster FROM pt LEFT JOIN cored ON cored.id = pt.id LEFT JOIN edge ON edge.id = pt.id)"""


def _points(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")
    )


@query("f23_ungrouped_points", f"WITH {COMPONENT_SQL} SELECT id, CAST(size AS DOUBLE) AS x, price AS y FROM component WHERE group_key IS NULL")
def _(spark, folder):
    nodes = components(spark, folder).select("id", "group_key", F.col("size").cast("double").alias("x"), F.col("price").alias("y"))
    return density.ungrouped_points(nodes)


@query("g29_j11_dbscan", f"WITH RECURSIVE {_DBSCAN_SQL} SELECT id, cluster FROM clustered")
def dbscan(spark, folder):
    return density.dbscan(_points(spark, folder), 1.5, 2)


@query(
    "g31_w05_grid_layout",
    f"""WITH RECURSIVE {_DBSCAN_SQL},
    c AS (SELECT cluster, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS i FROM clustered WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
    k AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS cols FROM c),
    g AS (SELECT cluster, n, CAST(ceil(sqrt(n)) AS BIGINT) AS inn, 200 + (i % cols) * 400 AS gx, 200 + (i // cols) * 300 AS gy FROM c, k),
    m AS (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS j FROM clustered)
    SELECT id, cluster, round(gx + (j % inn - inn / 2.0) * 80, 6) AS x, round(gy + (j // inn - n / inn::DOUBLE / 2.0) * 60, 6) AS y FROM m JOIN g USING (cluster)""",
)
def _(spark, folder):
    out = density.grid_layout(saved(spark, density.dbscan(_points(spark, folder), 1.5, 2)))
    return out.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query(
    "g32_graph_document",
    f"""WITH RECURSIVE {NODE}, {LATEST_SQL}, {_scc('latest')}, {_REDUNDANT}
    SELECT f.src, f.dst, to_json({{'id': CAST(f.src AS VARCHAR) || '-' || f.dst, 'source': f.src, 'target': f.dst, 'transitive': transitive,
           'in_cycle': a.scc_id = b.scc_id AND (a.scc_size > 1 OR f.src = f.dst)}})::VARCHAR AS json
    FROM flag f JOIN scc a ON a.id = f.src JOIN scc b ON b.id = f.dst""",
)
def _(spark, folder):
    n, e = _latest(spark, folder)
    c = saved(spark, cycles.scc(n, e))
    return snapshots.graph_document(components(spark, folder), e, cycles.cycle_edges(e, c), ordering.transitive_edges(n, e, c))[1]


@query(
    "g32_graph_nodes",
    f"""WITH {COMPONENT_SQL} SELECT id, CASE WHEN group_key IS NULL THEN to_json({{'id': id, 'label': name}})
    ELSE to_json({{'id': id, 'label': name, 'parent': group_key}}) END::VARCHAR AS json FROM component""",
)
def _(spark, folder):
    n, e = _latest(spark, folder)
    c = saved(spark, cycles.scc(n, e))
    none = e.select("src", "dst").distinct().withColumn("transitive", F.lit(False))
    return snapshots.graph_document(components(spark, folder), e, cycles.cycle_edges(e, c), none)[0]
