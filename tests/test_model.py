import re

import pytest
from pyspark.sql import functions as F

from strataweave.operators import clusters, intent, layers, linking, proposals, reports, scope, snapshots
from strataweave.sources import documents as docs
from strataweave.sources import tables
from strataweave.streaming import jobs

KEYS = ["payment-api", "payment-worker", "user-api", "gateway"]


@pytest.fixture(scope="module")
def case(spark):
    nodes = spark.createDataFrame(
        [(1, KEYS[0], ["payment", "api"]), (2, KEYS[1], ["payment"]), (3, KEYS[2], ["api"]), (4, KEYS[3], [])],
        "id long, key string, tags array<string>",
    )
    member = spark.createDataFrame(
        [("domains", "payment-domain", 1), ("domains", "payment-domain", 2), ("domains", "user-domain", 3),
         ("teams", "t1", 1), ("teams", "t1", 2), ("teams", "t2", 3), ("fine", "f1", 1), ("fine", "f2", 2), ("fine", "f3", 3)],
        "layer string, grp string, id long",
    )
    definitions = spark.createDataFrame(
        [("PaymentServices", "tag_expression", '"payment"', None, None), ("Nothing", "informal", None, None, None),
         ("Listed", "explicit_list", None, ["user-api", "no-such"], None), ("Domains", "layer", None, None, "domains")],
        "set_id string, kind string, expression string, members array<string>, layer string",
    )
    edges = spark.createDataFrame([(4, 1), (1, 3)], "src long, dst long")
    return nodes, member, definitions, edges


def test_sets(case):
    nodes, member, definitions, _ = case
    got = {(r.set_id, r.id) for r in intent.resolve_sets(definitions, nodes, member).collect()}
    assert got == {("PaymentServices", 1), ("PaymentServices", 2), ("Listed", 3), ("Domains", 1), ("Domains", 2), ("Domains", 3)}


STATEMENTS = [
    ("existence", "PaymentServices", None, None, None, True),
    ("existence", "Nothing", None, None, None, False),
    ("containment", "PaymentServices", "payment-domain", None, None, True),
    ("containment", "PaymentServices", "user-domain", None, None, False),
    ("containment", "PaymentServices", "absent", None, None, False),
    ("containment", "Nothing", "payment-domain", None, None, True),
    ("containment", "Nothing", "absent", None, None, True),
    ("exclusion", "PaymentServices", "Listed", None, None, False),
    ("exclusion", "Listed", "PaymentServices", None, None, True),
    ("exclusion", "Nothing", "Listed", None, None, True),
    ("cardinality", "PaymentServices", None, "==", 2, True),
    ("cardinality", "PaymentServices", None, ">", 2, False),
    ("cardinality", "PaymentServices", None, "=>", 2, False),
    ("coverage", "PaymentServices", "domains", None, None, True),
    ("coverage", "*", "domains", None, None, False),
    ("correspondence", "domains", "teams", None, None, True),
    ("correspondence", "domains", "fine", None, None, False),
    ("refinement", "fine", "teams", None, None, True),
    ("refinement", "teams", "fine", None, None, False),
    (None, None, None, None, None, None),
]


def test_statements_that_cannot_be_judged(spark, case):
    nodes, member, definitions, edges = case
    kinds = ["existence", "containment", "exclusion", "cardinality", "coverage", "correspondence", "refinement"]
    rows = [(f"semi-{k}", k, None, None, None, None, "semi_formal") for k in kinds]
    rows += [("part", "containment", "PaymentServices", None, None, None, "semi_formal"), ("told", "existence", "x", None, None, None, "informal")]
    rows += [(f"absent-{k}", k, "absent", "absent", None, None, "formal") for k in kinds[4:]]
    st = spark.createDataFrame(rows, "statement_id string, type string, first string, second string, operator string, value long, status string")
    found = intent.resolve_sets(definitions, nodes, member)
    out = {r.statement_id: r.is_satisfied for r in intent.evaluate_statements(st, found, member, nodes, edges).collect()}
    assert out.pop("part") is False
    assert set(out.values()) == {None} and len(out) == len(rows) - 1


def test_statement_truth(spark, case):
    nodes, member, definitions, edges = case
    rows = [(i, *s[:5], "informal" if s[0] is None else "formal") for i, s in enumerate(STATEMENTS)]
    st = spark.createDataFrame(rows, "statement_id int, type string, first string, second string, operator string, value long, status string")
    found = intent.resolve_sets(definitions, nodes, member)
    out = intent.evaluate_statements(st, found, member, nodes, edges)
    assert {r.statement_id: r.is_satisfied for r in out.collect()} == {i: s[5] for i, s in enumerate(STATEMENTS)}
    counts = intent.statement_summary(out).first()
    assert counts.total == len(STATEMENTS) and counts.not_evaluated == 1
    bad = intent.statement_witnesses(st, found, member, nodes, edges)
    got = {(r.type, r.witness, r.other) for r in bad.collect()}
    assert ("exclusion", "1", "3") in got and ("coverage", "4", None) in got and ("refinement", "t1", None) in got


def test_layer_violations(spark):
    keys = ["app:api", "app:web", "domain:user", "domain:order", "infra:db"]
    nodes = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    rules = layers.layer_rules(
        spark.createDataFrame([(0, "infrastructure", "infra:.*"), (1, "domain", "^domain:.*"), (2, "application", "app:.*")], "level int, name string, pattern string")
    )
    given = layers.assign_layers(nodes, rules)
    assert {r.id: r.level for r in given.collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 0}
    e = spark.createDataFrame([(0, 2), (2, 4), (2, 0), (4, 2), (2, 3)], "src long, dst long")
    out = {(r.src, r.dst): r.severity for r in layers.layer_violations(e, given).collect()}
    assert out == {(2, 0): "critical", (4, 2): "critical", (2, 3): "info"}


def test_filters(spark):
    nodes = spark.createDataFrame(
        [(1, "a", "g1", "active", True, ["t"]), (2, "b", None, "active", True, []), (3, "c", "g2", "stale", True, ["u"]), (4, "d", None, "active", False, [])],
        "id long, name string, group_key string, status string, internal boolean, tags array<string>",
    )
    e = spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long")
    c = clusters.connected_components(nodes, e)
    ids = lambda **config: {r.id for r in scope.apply_filter(nodes, e, c, config).collect()}
    assert ids() == {2}
    assert ids(groups=["g1"], tags=["t"]) == {1, 2}
    assert ids(groups=["g1"], include_ungrouped=False, tags=["t"]) == {1}
    assert ids(statuses=[]) == set()
    assert ids(include_external=True, include_main_cluster=False, include_disconnected=True) == {4}
    assert ids(include_external=True, include_disconnected=True) == {2, 4}
    assert ids(include_unused=False) == {2}
    with pytest.raises(ValueError):
        scope.bulk_status(nodes, nodes, "no-such-status")


def test_sbom_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"components":[{"bom-ref":"pkg:maven/org.x/lib@1.0"},{"bom-ref":"pkg:maven/org.x.core/app@2","version":"9"},{"name":"no ref"}],'
        '"dependencies":[{"ref":"pkg:maven/org.x.core/app@2","dependsOn":["pkg:maven/org.x/lib@7","pkg:maven/gone/gone@1"]}]}'
    )
    (tmp_path / "b.json").write_text('{"components":[{"bom-ref":"pkg:maven/org.x/lib@3.0"}]}')
    (tmp_path / "c.json").write_text("{not json")
    good, bad = docs.read_sboms(spark, str(tmp_path))
    found = docs.sbom_components(docs.sbom_packages(good, "pkg:maven/org.x"))
    got = {r.key: (r.version, r.internal, r.group_key) for r in found.collect()}
    assert got == {"org.x:lib": ("1.0", True, None), "org.x.core:app": ("2", True, "core")}
    e = docs.sbom_edges(good, found).collect()
    assert [(r.src, r.dst) for r in e] == [("pkg:maven/org.x.core/app", "pkg:maven/org.x/lib")]
    assert bad.count() == 1


def test_sbom_files_are_opened_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"components":[{"bom-ref":"a@1"}]}')
    (tmp_path / "b.json").write_text("{not json")
    good, bad = docs.read_sboms(spark, str(tmp_path))
    for name in ("a.json", "b.json"):
        (tmp_path / name).unlink()
    assert [r.doc.rsplit("/", 1)[1] for r in good.unionByName(bad, allowMissingColumns=True).orderBy("doc").collect()] == ["a.json", "b.json"]


def test_longest_prefix_deals_files_first(spark):
    files = [("a/b/c/x",), ("a/b/c/x",), ("a/q",), ("a",), ("z/b",), ("", ), (None,), ("n/m/x",)]
    paths = [("1", "a"), ("2", "a/b"), ("3", "a/b"), (None, "a/b"), ("4", "a/bc"), ("5", None), (None, "n/m"), ("6", "n")]
    files, projects = spark.createDataFrame(files, "file string"), spark.createDataFrame(paths, "project string, path string")
    found = linking.longest_prefix(files, projects)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "1"), ("a/b/c/x", "3"), ("a/q", "1"), ("n/m/x", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "RepartitionByExpression [file" in plan


def test_package_urls_are_cut_once(spark):
    rows = [("1", '{"components": [{"bom-ref": "pkg:maven/org.x.y/a@1@2"}, {"bom-ref": "pkg:npm/b@"}, {"bom-ref": "c@3"}]}')]
    good, _ = docs.parse_sboms(spark.createDataFrame(rows, "doc string, text string"))
    found = jobs.first_packages(good, "pkg:maven/org.x")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.key, r.name, r.version, r.group_key) for r in found.collect()) == [
        ("b", "b", "", None), ("c", "c", "3", None), ("org.x.y:a", "org.x.y.a", "2", "y"),
    ]


def test_pom_files(spark, tmp_path):
    for name, body in {
        "one": "<parent><groupId>org.p</groupId></parent><artifactId>one</artifactId><modules><module>m</module></modules>"
        "<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>"
        "<dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies>",
        "two": "<groupId>org.p</groupId>",
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "pom.xml").write_text(f'<project xmlns="http://maven.apache.org/POM/4.0.0">{body}</project>')
    good, bad = docs.read_poms(spark, str(tmp_path))
    row = good.first()
    assert (row.key, row.name, row.modules) == ("org.p:one", "one", ["m"])
    assert [(r.target_key, r.scope) for r in docs.pom_dependencies(good).collect()] == [("g:a", "compile")]
    assert [r.error for r in bad.collect()] == ["no artifactId"]


def test_module_that_names_itself_ends(spark):
    m = spark.createDataFrame([("root", "a"), ("root/a", "a"), ("root/a/a", "b")], "path string, module string")
    assert {r.path for r in docs.module_tree(m).collect()} == {"root", "root/a", "root/a/a", "root/a/a/b"}


def test_rewrite_table_read_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    tables.rewrite(tables.read_table(spark, path).where("id > 1"), path)
    assert tables.read_table(spark, path).count() == 3


def test_streamed_documents_arrive_in_two_batches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text(
        '{"components":[{"bom-ref":"pkg:maven/o/a@1"}],"dependencies":[{"ref":"pkg:maven/o/a@1","dependsOn":["pkg:maven/o/b@1"]}]}'
    )
    run = lambda: jobs.ingest_sboms(jobs.sbom_stream(spark, str(source)), target, str(tmp_path / "cp")).awaitTermination()
    run()
    assert jobs.stored_edges(spark, target).count() == 0
    (source / "b.json").write_text('{"components":[{"bom-ref":"pkg:maven/o/b@1"}]}')
    (source / "c.json").write_text("broken")
    run()
    assert {r.key for r in spark.read.parquet(f"{target}/component").collect()} == {"o:a", "o:b"}
    assert [(r.src, r.dst) for r in jobs.stored_edges(spark, target).collect()] == [("o:a", "o:b")]
    assert spark.read.parquet(f"{target}/reject").count() == 1


def test_ingest_is_the_same_however_documents_are_split(spark, tmp_path):
    texts = {
        "a": '{"components":[{"bom-ref":"pkg:maven/o/x@1"},{"bom-ref":"pkg:maven/o/x@9"}],"dependencies":[{"ref":"pkg:maven/o/x@1","dependsOn":["pkg:maven/o/y@1"]}]}',
        "b": '{"components":[{"bom-ref":"pkg:maven/o/y@2"},{"bom-ref":"pkg:maven/o/x@2"}]}',
        "c": "broken",
        "d": '{"components":[{"bom-ref":"pkg:maven/o/y@1"}]}',
    }
    found = []
    for n, batches in enumerate((["abcd"], ["a", "b", "c", "d"], ["d", "cb", "a"])):
        source, target = tmp_path / f"in{n}", str(tmp_path / f"out{n}")
        source.mkdir()
        for batch in batches:
            for name in batch:
                spark.createDataFrame([(name, texts[name])], "doc string, text string").coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema("doc string, text string").parquet(str(source))
            jobs.ingest_sboms(stream, target, str(tmp_path / f"cp{n}")).awaitTermination()
        found.append([
            sorted(map(str, jobs.stored_components(spark, target).collect())),
            sorted(map(str, jobs.stored_edges(spark, target).collect())),
            sorted(map(str, jobs.stored_rejects(spark, target).collect())),
        ])
    assert found[0] == found[1] == found[2]
    assert "version='1'" in next(r for r in found[0][0] if "o:x" in r) and len(found[0][2]) == 1


def test_upsert_and_matching(spark):
    schema = "key string, name string, version string, internal boolean, group_key string"
    old = spark.createDataFrame([("k1", "n1", "1", True, "g"), ("k2", "n2", "1", False, None)], schema)
    new = spark.createDataFrame([("k1", "", "2", False, None), ("k3", "n3", "1", True, None)], schema)
    got = {r.key: (r.name, r.version, r.internal, r.group_key, r.action) for r in linking.upsert_components(old, new).collect()}
    assert got == {"k1": ("n1", "2", False, "g", "updated"), "k2": ("n2", "1", False, None, "kept"), "k3": ("n3", "1", True, None, "created")}


def test_group_tree(spark):
    g = linking.group_hierarchy(spark.createDataFrame([("foo.bar_x.baz",)], "group_key string"))
    assert {(r.key, r.name, r.parent_key, r.depth) for r in g.collect()} == {
        ("foo", "Foo", None, 0), ("foo.bar_x", "Bar X", "foo", 1), ("foo.bar_x.baz", "Baz", "foo.bar_x", 2)
    }
    far = linking.group_paths(g).where("distance = 2").first()
    assert (far.key, far.ancestor, far.full_path) == ("foo.bar_x.baz", "foo", "Foo / Bar X / Baz")


def test_nested_snapshot_and_restore(spark):
    v = spark.createDataFrame([(1, "v")], "vision_id int, name string")
    l = spark.createDataFrame([(1, 10, "l1", "L1", 0), (1, 11, "l2", "L2", 1)], "vision_id int, layer_id int, key string, name string, ord int")
    g = spark.createDataFrame([(10, 100, "g1", "G1"), (10, 101, "g2", "G2")], "layer_id int, group_id int, key string, name string")
    m = spark.createDataFrame([(100, 1), (100, 2)], "group_id int, id int")
    n = spark.createDataFrame([(1, "a"), (2, "b")], "id int, key string")
    stored = snapshots.nested_snapshot(v, l, g, m, n).select(F.col("vision_id").alias("doc"), "document")
    got = {(r.layer_key, r.group_key, r.member) for r in snapshots.restore(stored).collect()}
    assert got == {("l1", "g1", "a"), ("l1", "g1", "b"), ("l1", "g2", None), ("l2", None, None)}


def test_scoring(spark):
    df = spark.createDataFrame([("cycle_break", 2, 1.0), ("cycle_break", 4, 6.0), ("api_stabilization", 6, 1.0), ("service_extraction", 1, 12.0)], "t string, n int, c double")
    got = df.select(proposals.impact(F.col("n"), F.col("c")).alias("i"), proposals.risk(F.col("t"), F.col("n")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("low", "medium"), ("medium", "high"), ("high", "medium"), ("high", "high")]


def test_domain_names(spark):
    names = ["payment-domain", "common-auth", "order-service-x", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(reports.domain_name(F.col("n")).alias("d"))
    assert [r.d for r in df.collect()] == ["payment", "auth", "order", "plain"]


def test_witnesses_broadcast_no_component_tables(case):
    nodes, member, definitions, edges = case
    found = intent.resolve_sets(definitions, nodes, member)
    st = nodes.sparkSession.createDataFrame(
        [("containment", "Listed", "payment-domain"), ("coverage", "*", "teams"), ("exclusion", "Listed", "Domains")],
        "type string, first string, second string",
    )
    bad = intent.statement_witnesses(st, found, member, nodes, edges)
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[[^\]]*\b(id|src|dst)#", plan) is None and "SortMergeJoin" in plan
    assert bad.count() > 0
