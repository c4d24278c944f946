import itertools
import math
import random

import pytest
from conftest import CYCLIC, LINEAR, SAMPLE
from pyspark.sql import functions as F

from strataweave.operators import adjacency as adj
from strataweave.operators import centrality, clusters, communities, cycles, ordering
from strataweave.operators import spread as spread_


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def random_graph(spark, n, m, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    return spark.range(n).select("id"), e, pairs


def closure(n, pairs):
    reach = {i: set() for i in range(n)}
    for a, b in pairs:
        reach[a].add(b)
    for k, i in itertools.product(range(n), range(n)):
        if k in reach[i]:
            reach[i] |= reach[k]
    return reach


def test_traversal_depths(graph):
    n, e = graph(SAMPLE)
    start = n.where("id = 'A'")
    assert rows(ordering.traverse(e, start), "id", "depth") == [("A", 0), ("B", 1), ("C", 1), ("D", 2), ("E", 2), ("F", 3)]
    up = ordering.traverse(e, n.where("id = 'F'"), "up")
    assert dict(rows(up, "id", "depth")) == {"F": 0, "D": 1, "E": 1, "B": 2, "C": 2, "A": 3}
    assert rows(ordering.traverse(e, start, max_depth=1), "id", "depth") == [("A", 0), ("B", 1), ("C", 1)]


def test_traversal_unknown_start_and_both_ways(spark, graph):
    _, e = graph(LINEAR)
    unknown = spark.createDataFrame([("Z",)], "id string")
    assert rows(ordering.traverse(e, unknown), "id", "depth") == [("Z", 0)]
    both = ordering.traverse(e, spark.createDataFrame([("B",)], "id string"), "both")
    assert rows(both, "id", "depth") == [("A", 1), ("B", 0), ("C", 1), ("D", 2)]


def test_components_and_counts(graph):
    n, e = graph("AB CD", "E")
    c = clusters.connected_components(n, e)
    assert rows(c, "id", "component") == [("A", "A"), ("B", "A"), ("C", "C"), ("D", "C"), ("E", "E")]
    counts = clusters.connectivity_counts(n, e, c).first().asDict()
    assert counts == {"total": 5, "main_cluster": 2, "disconnected": 3, "unused": 3, "used": 2}


def test_scc_condensation_and_cycle_edges(graph):
    n, e = graph(CYCLIC)
    c = cycles.scc(n, e)
    assert dict(rows(c, "id", "scc_id")) == {x: "A" for x in "ABC"} | {x: "D" for x in "DEF"}
    assert rows(cycles.condense(e, c), "src_scc", "dst_scc") == [("A", "D")]
    inner = rows(cycles.cycle_edges(e, c), "src", "dst")
    assert ("C", "D") not in inner and len(inner) == 6


def test_self_loop(graph):
    n, e = graph("AA AB")
    c = cycles.scc(n, e)
    assert {r.scc_size for r in c.collect()} == {1}
    assert rows(cycles.cycle_edges(e, c), "src", "dst") == [("A", "A")]
    assert rows(cycles.enumerate_cycles(e, c, 3, self_loops=True).withColumn("c", F.array_join("cycle", "")), "c") == [("A",)]
    assert ordering.residual_edges(n, e).count() == 2


def test_topological_order(graph):
    n, e = graph(SAMPLE)
    at = dict(rows(ordering.topological_order(n, e), "id", "position"))
    assert sorted(at.values()) == list(range(6))
    assert all(at[p[0]] < at[p[1]] for p in SAMPLE.split())
    n, e = graph(CYCLIC)
    assert all(r.position is None for r in ordering.topological_order(n, e).collect())
    assert ordering.residual_edges(n, e).count() == 7


@pytest.mark.parametrize(
    "text,expected",
    [
        (SAMPLE, {"A": 0, "B": 1, "C": 1, "D": 2, "E": 2, "F": 3}),
        ("AB BC CD AD DE", {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4}),
        (CYCLIC, {"A": 0, "B": 0, "C": 0, "D": 1, "E": 1, "F": 1}),
    ],
)
def test_layers(graph, text, expected):
    n, e = graph(text)
    assert dict(rows(ordering.topological_layers(n, e, cycles.scc(n, e)), "id", "layer")) == expected


def test_transitive(graph):
    n, e = graph(SAMPLE)
    assert not any(r.transitive for r in ordering.transitive_edges(n, e, cycles.scc(n, e)).collect())
    n, e = graph(SAMPLE + " AD")
    marked = ordering.transitive_edges(n, e, cycles.scc(n, e)).where("transitive")
    assert rows(marked, "src", "dst") == [("A", "D")]


def test_degrees_and_cut(graph):
    n, e = graph(SAMPLE)
    d = adj.node_degrees(n, e).where("id = 'D'").first()
    assert (d.fan_in, d.fan_out) == (2, 1)
    assert math.isclose(d.coupling_score, 1.6) and math.isclose(d.instability, 1 / 3)
    assert math.isclose(d.degree_centrality, 3 / 10)


def test_percentile_cut_matches_sorted_index(spark):
    scores = [3, 9, 1, 4, 4, 7, 2, 2, 8, 0]
    df = spark.createDataFrame([(s,) for s in scores], "s int")
    for p in (0, 50, 90, 100):
        expected = sorted(scores)[min(int(len(scores) * p / 100), len(scores) - 1)]
        assert adj.value_at_percentile(df, "s", p).first()[0] == expected


def test_betweenness_linear(graph):
    n, e = graph(LINEAR)
    b = {i: round(v, 9) for i, v in rows(centrality.betweenness(n, e), "id", "betweenness")}
    assert b == {"A": 0.0, "B": round(2 / 6, 9), "C": round(2 / 6, 9), "D": 0.0}
    split = {i: round(v, 9) for i, v in rows(centrality.betweenness(n, e, batches=3), "id", "betweenness")}
    assert split == b


@pytest.mark.parametrize("seed", [2])
def test_random_graph_against_brute_force(spark, seed):
    n, e, pairs = random_graph(spark, 24, 34, seed)
    reach = closure(24, pairs)
    c = cycles.scc(n, e)
    expected = {i: min([i] + [j for j in reach[i] if i in reach[j]]) for i in range(24)}
    assert dict(rows(c, "id", "scc_id")) == expected
    und = closure(24, pairs | {(b, a) for a, b in pairs})
    wcc = clusters.connected_components(n, e)
    assert dict(rows(wcc, "id", "component")) == {i: min({i} | und[i]) for i in range(24)}
    ids = sorted(set(expected.values()))
    dag = {(expected[a], expected[b]) for a, b in pairs if expected[a] != expected[b]}
    down = {i: {b for a, b in dag if a == i} for i in ids}
    full = {i: set(down[i]) for i in ids}
    for _ in ids:
        for i in ids:
            for j in list(full[i]):
                full[i] |= full[j]
    redundant = {(u, v) for u, v in dag if any(v in full[w] for w in down[u] if w != v)}
    marked = {(a, b) for a, b, t in rows(ordering.transitive_edges(n, e, c), "src", "dst", "transitive") if t}
    assert marked == {(a, b) for a, b in pairs if a == b or (expected[a], expected[b]) in redundant}


def test_cycles_against_brute_force(spark):
    n, e, pairs = random_graph(spark, 9, 22, 5)
    expected = set()
    for k in range(2, 6):
        for path in itertools.permutations(range(9), k):
            if path[0] == min(path) and all((path[i], path[(i + 1) % k]) in pairs for i in range(k)):
                expected.add(path)
    found = cycles.enumerate_cycles(e, cycles.scc(n, e), 5)
    assert {tuple(r.cycle) for r in found.collect()} == expected
    assert cycles.invalid_cycle_steps(found, e).count() == 0
    assert cycles.enumerate_cycles(e, cycles.scc(n, e), 5, max_cycles=2).count() == min(2, len(expected))


def test_duplicate_edges_change_nothing(spark):
    n, e, _ = random_graph(spark, 12, 20, 7)
    twice = e.unionByName(e)
    assert rows(cycles.scc(n, e), "id", "scc_id") == rows(cycles.scc(n, twice), "id", "scc_id")
    assert rows(adj.degrees(n, e), "id", "fan_in", "fan_out") == rows(adj.degrees(n, twice), "id", "fan_in", "fan_out")


def test_communities_are_sound(spark):
    left = [(a, b) for a in range(4) for b in range(4) if a < b]
    right = [(a + 4, b + 4) for a, b in left]
    e = spark.createDataFrame(left + right + [(8, 9)], "src long, dst long")
    n = spark.range(11).select("id")
    labels = communities.louvain(n, e)
    assert labels.select("id").distinct().count() == 11
    got = dict(rows(labels, "id", "community"))
    assert len({got[i] for i in range(4)}) == 1 and got[0] != got[4] and got[10] == 10
    assert rows(labels, "id", "community") == rows(communities.louvain(n, e), "id", "community")
    total = communities.modularity(e, labels).agg(F.sum("modularity")).first()[0]
    alone = communities.modularity(e, n.select("id", F.col("id").alias("community"))).agg(F.sum("modularity")).first()[0]
    assert total > alone


def test_eigenvector_is_normalised(spark):
    n, e, _ = random_graph(spark, 15, 40, 3)
    s = centrality.eigenvector(n, e, 8)
    assert math.isclose(s.agg(F.sum(F.col("score") ** 2)).first()[0], 1.0, rel_tol=1e-9)


def ladder(spark, n, ring):
    """A path (or ring) of ``n`` nodes."""
    last = f" UNION ALL SELECT {n - 1}L, 0L" if ring else ""
    spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst").createOrReplaceTempView("path")
    return spark.range(n).select("id"), spark.sql(f"SELECT src, dst FROM path{last}")


def test_long_chain_and_ring_end_in_few_rounds(spark, monkeypatch):
    from strataweave.scratch import Scratch

    saves = []
    real = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **k: saves.append(1) or real(self, *a, **k))
    n, e = ladder(spark, 100_000, True)
    assert cycles.scc(n, e).groupBy("scc_id", "scc_size").count().collect() == [(0, 100_000, 100_000)]
    assert len(saves) < 60
    saves.clear()
    n, e = ladder(spark, 100_000, False)
    c = cycles.scc(n, e)
    assert c.where("scc_size > 1 OR scc_id <> id").isEmpty()
    layers = ordering.topological_layers(n, e, c)
    assert layers.where("layer <> id").isEmpty() and layers.count() == 100_000
    assert len(saves) < 120


@pytest.mark.parametrize("seed", [1, 3])
def test_chains_against_closures(spark, monkeypatch, seed):
    """Paths, rings and loops in sparse graphs: components, waves and what lies after a cycle."""
    monkeypatch.setattr("strataweave.operators.chains.FEW", 1)
    monkeypatch.setattr("strataweave.operators.chains.SHORT", 0)
    r = random.Random(seed)
    size = 24
    pairs = {(r.randrange(size), r.randrange(size)) for _ in range(14 + 3 * seed)} | {(i, i + 1) for i in range(5, 12)}
    pairs |= {(20, 21), (21, 22), (22, 20), (23, 23)}
    n, e = spark.range(size).select("id"), spark.createDataFrame(sorted(pairs), "src long, dst long")
    reach = closure(size, pairs)
    want = {i: min([i, *(j for j in range(size) if j in reach[i] and i in reach[j])]) for i in range(size)}
    assert dict(rows(cycles.scc(n, e), "id", "scc_id")) == want
    after = {i for i in range(size) if i in reach[i] or any(i in reach[c] for c in range(size) if c in reach[c])}
    wave = {}
    while len(wave) + len(after) < size:
        for i in set(range(size)) - after - set(wave):
            before = [a for a, b in pairs if b == i]
            if all(a in wave for a in before):
                wave[i] = max([wave[a] + 1 for a in before], default=0)
    got = {x.id: x.wave for x in ordering.topological_order(n, e).collect()}
    assert got == {i: wave.get(i) for i in range(size)}


def test_cycle_report_goes_on_while_it_is_too_short(spark):
    ring = [(i, (i + 1) % 6) for i in range(6)] + [(10, 11), (11, 10)]
    n, e = spark.range(12).select("id"), spark.createDataFrame(ring, "src long, dst long")
    got = cycles.enumerate_cycles(e, cycles.scc(n, e), 8, max_cycles=25).collect()
    assert [(r.length, list(r.cycle)) for r in got] == [(2, [10, 11]), (6, [0, 1, 2, 3, 4, 5])]
    one = cycles.enumerate_cycles(e, cycles.scc(n, e), 8, max_cycles=1).collect()
    assert [r.length for r in one] == [2]


def test_sketched_closeness_is_near_the_exact_one(spark):
    n, e, _ = random_graph(spark, 400, 1000, 5)
    exact = dict(rows(centrality.closeness(n, e), "id", "score"))
    got = dict(rows(centrality.closeness_sketched(n, e), "id", "score"))
    assert got.keys() == exact.keys()
    assert all(abs(got[i] - exact[i]) <= 0.08 * exact[i] + 1e-9 for i in exact)
    mean = sum(abs(got[i] - exact[i]) / exact[i] for i in exact if exact[i]) / sum(1 for i in exact if exact[i])
    assert mean < 0.02
    lonely = centrality.closeness_sketched(spark.range(3).select("id"), e.limit(0))
    assert rows(lonely, "id", "score", "reached") == [(i, 0.0, 1) for i in range(3)]


def test_dense_graphs_are_searched_by_few_of_their_edges(spark, monkeypatch):
    r = random.Random(11)
    inside = lambda lo, hi, m: {(r.randrange(lo, hi), r.randrange(lo, hi)) for _ in range(m)}
    # two dense components, one way between them, a dense part without cycles, and a ring that few edges do not show
    pairs = inside(0, 60, 2500) | inside(60, 100, 1200) | {(a, b) for a, b in inside(0, 100, 1500) if a < b}
    pairs |= {(min(p) + 100, max(p) + 100) for p in inside(0, 40, 900) if p[0] != p[1]}
    pairs |= {(200, 201), (201, 202), (202, 200), (99, 200), (202, 300)}
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in sorted(pairs)], "src string, dst string")
    n = spark.createDataFrame([("lonely",)], "id string")
    spread_over = []
    plain = cycles.spread
    monkeypatch.setattr(cycles, "spread", lambda seeds, edges, *a, **k: spread_over.append(edges.count()) or plain(seeds, edges, *a, **k))
    found = {x["id"]: (x["scc_id"], x["scc_size"]) for x in cycles.scc(n, e, dense=500).collect()}
    assert spread_over and max(spread_over) < len(pairs)  # both ways of all edges would be twice as many
    reach = closure(301, pairs)
    ids = sorted({x for p in pairs for x in p})
    for i in ids:
        mates = [j for j in ids if j == i or (j in reach[i] and i in reach[j])]
        assert found[f"n{i:03}"] == (f"n{mates[0]:03}", len(mates))
    assert found["lonely"] == ("lonely", 1) and len(found) == len(ids) + 1


def test_a_round_of_labels_is_shuffled_once(spark):
    _, e, _ = random_graph(spark, 300, 3000, 5)
    scratch = communities.Scratch(spark, "test")
    outward, hot = communities._outward(adj.undirected(e).where("src <> dst"), scratch)
    state = scratch.save(e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    votes = communities._sent(state.hint("merge"), outward, hot).groupBy("id", "community").agg(F.count("*").alias("n"))
    choice = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("pick"))
    choice.write.format("noop").mode("overwrite").save()
    plan = choice._jdf.queryExecution().executedPlan().toString()
    assert hot is None and plan.count("Exchange hashpartitioning") <= 2  # the state's, by id, and the messages'
    scratch.clear()


def test_dense_graphs_are_contracted_by_some_of_their_links(spark):
    r = random.Random(5)
    # two dense parts, a thin tail on the smaller one and a node alone
    pairs = {(r.randrange(0, 30), r.randrange(0, 30)) for _ in range(600)} | {(r.randrange(40, 70), r.randrange(40, 70)) for _ in range(600)}
    pairs |= {(i, i + 1) for i in range(69, 80)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = clusters.connected_components(spark.range(90).select("id"), e, dense=1)
    owner = {i: i for i in range(90)}
    for _ in range(90):
        for a, b in pairs:
            owner[a] = owner[b] = min(owner[a], owner[b])
    assert rows(got, "id", "component") == sorted(owner.items())


def test_eigenvector_reads_links_from_buckets(spark, monkeypatch):
    made = []
    save = centrality.Scratch.save_bucketed
    monkeypatch.setattr(centrality.Scratch, "save_bucketed", lambda self, df, key, n: made.append((key, n)) or save(self, df, key, n))
    n, e, pairs = random_graph(spark, 12, 40, 4)
    got = dict(rows(centrality.eigenvector(n, e, 3), "id", "score"))
    assert made == [("id", spark.sparkContext.defaultParallelism)]
    v = {i: 1.0 for i in range(12)}
    for _ in range(3):
        v = {i: v[i] + sum(v[a] for a, b in pairs if b == i) for i in v}
    length = math.sqrt(sum(x * x for x in v.values()))
    assert all(math.isclose(got[i], v[i] / length, rel_tol=1e-9) for i in v)


@pytest.mark.parametrize("least", [1, 1_000_000])
def test_waves_send_every_edge_once(spark, monkeypatch, least):
    """Paths of several written tables, a cycle, what hangs on it, and a node without edges; bucketed and not."""
    monkeypatch.setattr(spread_, "BUCKETED", least)
    pairs = [(i, i + k) for i in range(20) for k in (1, 3)] + [(30, 31), (31, 30), (31, 32), (0, 33), (5, 33), (33, 32)]
    e = spark.createDataFrame([(a, b, 2 if b == 33 else 1) for a, b in pairs], "src long, dst long, steps long")
    got = {r.id: r.wave for r in spread_.waves(spark.createDataFrame([(40,), (0,)], "id long"), e).collect()}
    wanted = {i: i for i in range(21)} | {21: 19, 22: 20, 30: None, 31: None, 32: None, 33: 7, 40: 0}
    assert got == wanted


def test_components_trim_every_edge_once(spark, monkeypatch):
    """Edges are only searched backwards where a cycle was found before them."""
    searched = []
    plain = cycles.waves
    monkeypatch.setattr(cycles, "waves", lambda ids, edges: (searched.append(edges.count()), plain(ids, edges))[1])
    acyclic = [(i, i + k) for i in range(12) for k in (1, 2)]
    cyclic = [(20, 21), (21, 20), (21, 22), (22, 23), (19, 20), (18, 19), (23, 24), (24, 23), (24, 25)]
    for pairs, more, wanted in ((acyclic, [24], {}), (acyclic + cyclic, [33], {20: 20, 21: 20, 23: 23, 24: 23})):
        searched.clear()
        e = spark.createDataFrame(pairs, "src long, dst long")
        got = {r.id: r.scc_id for r in cycles.scc(spark.range(2).select("id"), e).collect()}
        assert got == {i: wanted.get(i, i) for pair in pairs for i in pair}
        assert searched[0] == len(pairs) and len(searched) <= 1 + 2 * len(wanted)
    assert sum(searched[:2]) < 2 * len(acyclic + cyclic)


@pytest.mark.parametrize("fronts", [0, 1_000_000])
def test_betweenness_reads_what_sending_sources_saw(spark, monkeypatch, fronts):
    """Against brute force, on ways of different lengths, a cycle and a tail; all waves filtered by source or none."""
    monkeypatch.setattr(centrality, "FEW_FRONTS", fronts)
    n, e, pairs = random_graph(spark, 14, 24, 5)
    tail = {(i, i + 1) for i in range(13, 19)} | {(3, 13)}
    pairs = {p for p in pairs | tail if p[0] != p[1]}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    score = dict.fromkeys(range(20), 0.0)
    for s in range(20):
        depth, paths, layer = {s: 0}, {s: 1}, [s]
        order = [s]
        while layer:
            fresh = {}
            for a in layer:
                for x, y in pairs:
                    if x == a and y not in depth:
                        fresh[y] = fresh.get(y, 0) + paths[a]
            depth.update(dict.fromkeys(fresh, depth[layer[0]] + 1))
            paths.update(fresh)
            layer = list(fresh)
            order += layer
        delta = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x, z in pairs:
                if z == y and x in depth and depth[x] + 1 == depth[y]:
                    delta[x] += paths[x] / paths[y] * (1 + delta[y])
            if y != s:
                score[y] += delta[y]
    got = dict(rows(centrality.betweenness(spark.range(20).select("id"), e), "id", "betweenness"))
    assert all(math.isclose(got[i], score[i] / (19 * 18), abs_tol=1e-12) for i in range(20))


def test_sketches_are_not_sent_along_edges(spark, monkeypatch):
    """A hub of more edges than a piece, reaches beyond a list and small ones; no table holds a sketch."""
    from strataweave.operators import sketches
    from strataweave.scratch import Scratch

    monkeypatch.setattr(sketches, "SLICE_BYTES", 100_000)  # several slices a task
    monkeypatch.setattr(sketches, "BLOCK", 1000)
    written = []
    real = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, *a, **k: written.append(df.columns) or real(self, df, *a, **k))
    r = random.Random(9)
    pairs = {(r.randrange(900), r.randrange(900)) for _ in range(2700)} | {(0, i) for i in range(1, 700)}
    pairs |= {(2000 + a, 2000 + b) for a, b in ((0, 1), (1, 2), (0, 3), (3, 3))} | {(3000, 0)}
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in sorted(pairs)], "src string, dst string")
    n = spark.createDataFrame([("n2000",), ("lonely",)], "id string")
    got = {x.id: (x.score, x.reached) for x in centrality.closeness_sketched(n, e.unionByName(e)).collect()}
    assert not any("sketch" in columns for columns in written)
    exact = dict(rows(centrality.closeness(n, e), "id", "score"))
    assert got.keys() == exact.keys()
    assert all(abs(got[i][0] - exact[i]) <= 0.08 * exact[i] + 1e-9 for i in exact)
    assert got["n0"][1] > 700 and got["lonely"] == (0.0, 1)
    assert [got[f"n{i}"] for i in (2000, 2001, 2002)] == [(exact["n2000"], 4), (exact["n2001"], 2), (0.0, 1)]
    # two hops from the hub are as far as they are exactly
    near = {x.id: x.reached for x in centrality.closeness_sketched(n, e, max_hops=1).collect()}
    assert near["n2000"] == 3 and near["n3000"] == 2 and abs(near["n0"] - 700) < 60


def test_louvain_asks_without_a_shuffle_of_links(spark, monkeypatch):
    """Communities that are broadcast and ones that are sent give the same partition; the former shuffle no links."""
    n, e, _ = random_graph(spark, 60, 150, 13)
    e = e.unionByName(spark.createDataFrame([(100, 101), (101, 100), (102, 102)], "src long, dst long"))
    n = n.unionByName(spark.createDataFrame([(200,)], "id long"))
    sent = []
    plain = communities._sent
    monkeypatch.setattr(communities, "_sent", lambda *a, **k: sent.append(1) or plain(*a, **k))
    asked = dict(rows(communities.louvain(n, e), "id", "community"))
    assert not sent
    monkeypatch.setattr(communities, "FEW_NODES", 0)
    assert dict(rows(communities.louvain(n, e), "id", "community")) == asked
    assert sent and asked[200] == 200 and asked[102] == 102 and asked[100] == asked[101]


def test_cycle_report_looks_no_further_than_it_has_to(spark, monkeypatch):
    """Cycles of two nodes are listed without longer paths, longer ones by start; the report is that of all cycles."""
    monkeypatch.setattr(cycles, "FIRST_STARTS", 1)
    monkeypatch.setattr(cycles, "MORE_STARTS", 2)
    asked = []
    plain = cycles._cycles_up_to
    monkeypatch.setattr(cycles, "_cycles_up_to", lambda inner, loops, length, *a: asked.append(length) or plain(inner, loops, length, *a))
    pairs = {(0, 1), (1, 0), (2, 3), (3, 2), (4, 4)} | {(a, (a + b) % 9 + 10) for a in range(10, 19) for b in (1, 2)}
    n, e = spark.range(20).select("id"), spark.createDataFrame(sorted(pairs), "src long, dst long")
    c = saved_here(cycles.scc(n, e))
    report = lambda k, length=5: [tuple(x.cycle) for x in cycles.enumerate_cycles(e, c, length, max_cycles=k, self_loops=True).collect()]
    assert report(2) == [(4,), (0, 1)] and asked == [2]
    every = sorted((tuple(x.cycle) for x in cycles.enumerate_cycles(e, c, 4, self_loops=True).collect()), key=lambda x: (len(x), x))
    assert len(every) > 5 and max(map(len, every)) == 4
    asked.clear()
    assert report(4) == every[:4] and len(asked) > 1
    assert report(10_000, 4) == every


def saved_here(df):
    from strataweave.scratch import Scratch

    return Scratch(df.sparkSession, "test").save(df)


def test_labels_are_not_sent_before_they_meet_or_where_nothing_moves(spark, monkeypatch):
    sent = []
    plain = communities._sent
    monkeypatch.setattr(communities, "_sent", lambda *a, **k: sent.append(1) or plain(*a, **k))
    n, e, pairs = random_graph(spark, 40, 70, 21)
    near = {i: {b for a, b in pairs if a == i and b != i} | {a for a, b in pairs if b == i and a != i} for i in range(40)}

    def plainly(rounds):
        label = {i: i for i in range(40)}
        for _ in range(rounds):
            votes = {i: [label[j] for j in near[i]] for i in near}
            label = {i: min(votes[i], key=lambda x: (-votes[i].count(x), x)) if votes[i] else label[i] for i in near}
        return label

    label = lambda rounds: dict(rows(communities.label_propagation(n, e, rounds), "id", "community"))
    assert label(1) == plainly(1) and not sent
    monkeypatch.setattr(communities, "FEW_MOVES", 0.5)  # half of the nodes are few
    assert label(8) == plainly(8)
    monkeypatch.setattr(communities, "FEW_MOVES", 0)
    sent.clear()
    assert label(5) == plainly(5) and not sent


def test_slices_of_registers_are_those_of_the_sketch(spark):
    e = spark.createDataFrame([(i, (i * k + 1) % 1000) for i in range(1000) for k in (1, 7, 13)], "src long, dst long")
    got = {x.reached for x in centrality.closeness_sketched(spark.range(1000).select("id"), e).collect()}
    halves = spark.range(1000).groupBy(F.col("id") % 2).agg(F.hll_sketch_agg("id", F.lit(12)).alias("s"))
    # merged twice, as sketches of a node's successors are
    merged = halves.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")).first().n
    assert got == {merged}


def test_ranking_counts_both_ends_of_an_edge(graph, monkeypatch):
    """In one pass over the edges."""
    from strataweave.scratch import Scratch

    n, e = graph("AB BA BC CD DC DE EE FA")
    c = cycles.scc(n, e)
    plans = []
    real = Scratch.save
    monkeypatch.setattr(
        Scratch, "save", lambda self, df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(self, df, *a, **k)
    )
    got = rows(cycles.scc_ranking(e, c, min_size=1), "scc_id", "size", "internal_edges", "external_edges")
    assert sorted(got) == [("A", 2, 2, 2), ("C", 2, 2, 2), ("E", 1, 1, 1), ("F", 1, 0, 1)]
    assert plans and not any("Union" in plan for plan in plans)
