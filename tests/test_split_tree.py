"""Nearest points by a split tree against all pairs."""

import numpy as np
import pytest

from loadgrid.operators import places, split_tree as st


def clustered(rng, n, sphere):
    """Clusters of very unequal size, repeats, far points and, on the sphere, poles and both sides of the date line."""
    centres = rng.uniform((-80, -170), (80, 170), (6, 2))
    p = centres[rng.choice(6, n, p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02])] + rng.normal(0, 0.3, (n, 2))
    p[: n // 10] = p[rng.integers(0, n, n // 10)]
    p[n // 10 : n // 5] = np.round(p[n // 10 : n // 5], 1)
    if sphere:
        p[-40:-20, 1] = 180 - rng.uniform(-0.5, 0.5, 20)
        p[-20:] = np.stack([rng.choice([-1, 1], 20) * (90 - rng.uniform(0, 0.2, 20)), rng.uniform(-180, 180, 20)], 1)
        p[:, 0] = np.clip(p[:, 0], -90, 90)
    return p


def frames(spark, a, b):
    left = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], "location_id long, lat double, lon double")
    right = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(b)], "weather_id long, w_lat double, w_lon double")
    return left, right


@pytest.mark.parametrize(("metric", "leaf", "block"), [("planar", 16, 64), ("sphere", 16, 8192), ("sphere", 300, 50)])
def test_all_pairs(spark, monkeypatch, metric, leaf, block):
    monkeypatch.setattr(places, "FEW_POINTS", 0)
    monkeypatch.setattr(st, "LEAF", leaf)
    monkeypatch.setattr(st, "BLOCK", block)
    rng = np.random.default_rng(leaf)
    a, b = clustered(rng, 900, metric == "sphere"), clustered(rng, 700, metric == "sphere")
    left, right = frames(spark, a, b)
    right = right.unionByName(spark.createDataFrame([(9000, None, 1.0), (9001, float("nan"), 1.0)], right.schema))
    left = left.unionByName(spark.createDataFrame([(9000, 1.0, None)], left.schema))
    found = places.nearest(left, right, metric=metric)
    far = np.round(st.kilometres(a[:, 0, None], a[:, 1, None], b[None, :, 0], b[None, :, 1], metric), 9)
    want = {k: (int(far[k].argmin()), float(far[k].min())) for k in range(len(a))}
    got = {r.location_id: (r.weather_id, r.km) for r in found.collect()}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bound_is_not_below_the_distance():
    rng = np.random.default_rng(5)
    a, b = clustered(rng, 500, True), clustered(rng, 500, True)
    for metric in ("planar", "sphere"):
        km = st.kilometres(a[:, 0], a[:, 1], b[:, 0], b[:, 1], metric)
        gap = np.sqrt(((st.embedded(a[:, 0], a[:, 1], metric) - st.embedded(b[:, 0], b[:, 1], metric)) ** 2).sum(1))
        assert (st.straight(km, metric) >= gap).all() and (st.straight(km, metric) <= gap * 1.001 + 1e-8).all()


def test_no_points_and_no_places(spark, monkeypatch):
    left, right = frames(spark, [(1.0, 2.0)], [(3.0, 4.0)])
    for few in (0, 10):
        monkeypatch.setattr(places, "FEW_POINTS", few)
        assert places.nearest(left, right.limit(0)).count() == 0 and places.nearest(left.limit(0), right).count() == 0
        assert [tuple(r) for r in places.nearest(left, right).select("location_id", "weather_id").collect()] == [(0, 0)]
