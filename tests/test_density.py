import math
import random

import pytest

from strataweave.operators import density


def reference_clusters(points, eps, k):
    """Brute force: core links, border to the lowest cluster."""
    near = {i: [j for j in range(len(points)) if j != i and math.dist(points[i], points[j]) <= eps] for i in range(len(points))}
    core = {i for i in near if len(near[i]) >= k}
    label, count = {}, 0
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j in label:
                continue
            label[j] = count
            todo += [x for x in near[j] if x in core]
        count += 1
    for i in near:
        if i not in core:
            found = [label[j] for j in near[i] if j in core]
            label[i] = min(found) if found else None
    return label


@pytest.mark.parametrize("seed,eps,k", [(1, 1.0, 2), (2, 0.4, 3)])
def test_dbscan_matches_brute_force(spark, seed, eps, k):
    r = random.Random(seed)
    points = [(r.uniform(0, 12), r.uniform(0, 12)) for _ in range(110)] + [(r.gauss(3, 0.2), r.gauss(3, 0.2)) for _ in range(60)]
    points += [points[0]] * 3
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    got = {row.id: row.cluster for row in density.dbscan(df, eps, k).collect()}
    assert got == reference_clusters(points, eps, k)


def test_distance_bounds(spark):
    r = random.Random(9)
    points = [(r.uniform(-5, 5), r.uniform(0, 3)) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    every = [math.dist(a, b) for i, a in enumerate(points) for b in points[i + 1 :]]
    low, high = density.distance_bounds(df)
    assert math.isclose(low, min(every), rel_tol=1e-9) and math.isclose(high, max(every), rel_tol=1e-9)


def test_optimal_eps_finds_the_target(spark):
    points = [(10.0 * c + dx, 0.1 * dx) for c in range(4) for dx in (0.0, 0.3, 0.6, 0.9)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    eps = density.optimal_eps(df, target=4, steps=4)
    found = {r.cluster for r in density.dbscan(df, eps, 2).collect()} - {None}
    assert len(found) == 4
    assert density.optimal_eps(df.limit(1)) == 150.0


def test_grid_layout(spark):
    rows = [(i, i // 3) for i in range(9)] + [(9, None)]
    out = density.grid_layout(spark.createDataFrame(rows, "id long, cluster long")).collect()
    at = {r.id: (r.x, r.y) for r in out}
    assert len(at) == 9 and 9 not in at
    assert at[0] == (200 - 80, 200 - 45) and at[3][0] == 600 - 80 and at[6] == (200 - 80, 500 - 45)
