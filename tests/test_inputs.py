from strataweave.plans import graphs


def test_only_latest_orders_are_listed(spark, tmp_path, monkeypatch):
    """Orders that are the latest of some part, whole, and the order without a key; repeated lines count once."""
    lines = [
        (1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10), (2, 2, 11), (2, 2, 11), (2, 3, 10), (3, 1, 11), (3, 2, 13), (3, 3, None),
        (4, 1, 12), (4, 2, 12), (4, 3, 10), (None, 1, 14), (None, 2, 10), (None, None, 14), (None, 3, None), (0, 1, 12), (0, 2, 11),
    ]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    listed = []
    plain = graphs.following
    monkeypatch.setattr(graphs, "following", lambda table, *a: (listed.extend(table.collect()), plain(table, *a))[1])
    got = {(r.src, r.dst, r.scope) for r in graphs.latest_edges(spark, str(tmp_path)).collect()}
    # 10 ends order 4, 11 and 13 are last met in order 3, 12 in 4 (first line), 14 only without an order
    assert got == {(11, 13, "compile"), (12, 10, "runtime"), (14, 10, "compile")}
    assert {r.o for r in listed} == {3, 4, None}
    assert len(listed) == len(set(listed)) == 10
