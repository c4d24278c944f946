import random

import pytest
from pyspark.sql import functions as F

import strataweave.skew as skew
from strataweave.operators import clusters, cycles, ordering


def test_hot_keys_and_salted_join(spark):
    big = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(300)], "k long, v long")
    small = spark.createDataFrame([(i, i * 10) for i in range(150)], "k long, w long")
    hot = skew.hot_keys(big, "k", floor=50)
    assert [r.k for r in hot.collect()] == [0]
    assert skew.hot_keys(big, "k") is None
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, big.join(small, "k", how).collect()), key=repr)
        salted = sorted(map(tuple, skew.skew_join(big, small, "k", how, hot_left=hot).collect()), key=repr)
        assert plain == salted
    both = skew.skew_join(big, big.withColumnRenamed("v", "u"), "k", hot_left=hot, hot_right=hot)
    assert both.count() == big.join(big.withColumnRenamed("v", "u"), "k").count()


def test_hot_right_needs_an_inner_join(spark):
    small = spark.createDataFrame([(0, 1), (1, 2)], "k long, v long")
    big = spark.createDataFrame([(0, i) for i in range(5)], "k long, w long")
    hot = skew.hot_keys(big, "k", floor=2)
    for how in ("left", "left_semi", "left_anti"):
        with pytest.raises(ValueError):
            skew.skew_join(small, big, "k", how, hot_right=hot)
    assert skew.skew_join(small, big, "k", hot_right=hot).count() == 5


def test_following_rows_across_slices(spark):
    r = random.Random(1)
    data = sorted({(r.choice([0, 0, 0, 1, 2]), r.randrange(500), r.randrange(50)) for _ in range(900)})
    df = spark.createDataFrame(data, "o long, n long, p long")
    plain = skew.following(df, "o", ["n", "p"], "p", 2)
    split = skew.following(df, "o", ["n", "p"], "p", 2, floor=60)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, split.collect()))


def test_number_rows(spark):
    df = spark.createDataFrame([((i * 37) % 101,) for i in range(101)], "x long")
    assert sorted((r.x, r.position) for r in skew.number_rows(df, ["x"]).collect()) == [(i, i) for i in range(101)]


def test_loops_with_hot_hub(spark, monkeypatch):
    """A hub with most edges goes through the salted paths and gives the same answers."""
    pairs = [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 10)] + [(i, i + 1) for i in range(40, 50)] + [(39, 40)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    n = spark.range(60).select("id")
    plain = [
        sorted(map(tuple, f().collect()))
        for f in (
            lambda: cycles.scc(n, e),
            lambda: clusters.connected_components(n, e),
            lambda: ordering.traverse(e, n.where("id = 3")),
        )
    ]
    real = skew.hot_keys
    low = lambda table, key, floor=None: real(table, key, 5)
    from strataweave.operators import spread

    for module in (skew, cycles, clusters, spread):
        monkeypatch.setattr(module, "hot_keys", low)
    monkeypatch.setattr(clusters, "HOT_ROWS", 5)
    hot = [
        sorted(map(tuple, f().collect()))
        for f in (
            lambda: cycles.scc(n, e),
            lambda: clusters.connected_components(n, e),
            lambda: ordering.traverse(e, n.where("id = 3")),
        )
    ]
    assert plain == hot


def test_scratch_uses_the_configured_folder(spark):
    from strataweave.scratch import Scratch, shared_root

    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    scratch = Scratch(spark, "t")
    saved = scratch.save(spark.range(3))
    assert saved.inputFiles()[0].startswith("file:") and saved.agg(F.sum("id")).first()[0] == 3
    scratch.drop(saved)
