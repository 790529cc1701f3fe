"""A location that holds most rows is swept in buckets: same results, spread over tasks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgrid.operators import distributions as ds, forecast as fc, intervals as iv, resample as rs, windows as wn
from loadgrid.operators import running as rn
from loadgrid.operators.running import running

SETS = "location_id long, start long, stop long"


@pytest.fixture(autouse=True)
def _split_series(monkeypatch):
    """Tables here are small, but are to be split as large ones are."""
    monkeypatch.setattr(rn, "ONE_TASK", 0)


def minutes(rows):
    """Covered minutes of each location."""
    return {(r[0], m) for r in rows for m in range(r[1], r[2])}


def joined(points):
    """Clean intervals of covered minutes."""
    out = []
    for loc, m in sorted(points):
        if out and out[-1][0] == loc and out[-1][2] == m:
            out[-1] = (loc, out[-1][1], m + 1)
        else:
            out.append((loc, m, m + 1))
    return sorted(out)


def test_running_over_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), t, rng.choice([None, *range(-5, 9)])) for t in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, t long, v long").withColumn("b", F.floor(F.col("t") / 37))
    for own in (True, False):
        found = running(df, ["k"], "b", ["t"], {"s": F.col("v")}, {"m": F.col("v")}, {"l": F.col("v")}, own)
        assert found.columns == ["k", "t", "v", "b", "s", "m", "l"]
        for r in found.collect():
            upto = [v for k, t, v in sorted(rows, key=lambda x: x[1]) if k == r.k and (t < r.t or own and t == r.t) and v is not None]
            assert (r.s, r.m, r.l) == (sum(upto), max(upto, default=None), upto[-1] if upto else None)


def test_running_past_buckets_that_begin_with_ties(spark):
    """Any of the rows that begin a bucket together may come first after a shuffle."""
    rows = [(k, 0, 5) for k in range(20)] + [(k, t, None) for k in range(20) for t in (100, 200, 300) for _ in range(20)]
    df = spark.createDataFrame(rows, "k long, t long, v long").withColumn("b", F.floor(F.col("t") / 37)).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running(df, ["k"], "b", ["t"], {"s": F.col("v")}, {"m": F.col("v")}, {"l": F.col("v")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 1220 and all((r.s, r.m, r.l) == (5, 5, 5) for r in found)


def test_sweeps_in_narrow_buckets(spark, monkeypatch):
    monkeypatch.setattr(iv, "BUCKET", 7)
    rng = random.Random(2)
    sets = [[(rng.choice([1, 1, 1, 2, 3]), a := rng.randrange(-50, 400), a + rng.randrange(-2, 30)) for _ in range(120)] for _ in range(2)]
    a, b = (spark.createDataFrame(x, SETS) for x in sets)
    x, y = map(minutes, sets)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(iv.clean(a)) == joined(x)
    assert rows(iv.union(a, b)) == joined(x | y)
    assert rows(iv.subtract(a, b)) == joined(x - y)
    assert rows(iv.intersect(a, b)) == joined(x & y)
    gaps = rows(iv.invert(a))
    for loc in {r[0] for r in sets[0] if r[2] > r[1]}:
        own = [r for r in joined(x) if r[0] == loc]
        assert [g[1:] for g in gaps if g[0] == loc] == list(zip([-iv.FAR, *(r[2] for r in own)], [*(r[1] for r in own), iv.FAR], strict=True))
    points = spark.createDataFrame([(rng.choice([1, 2, 4]), rng.randrange(-60, 450), k) for k in range(300)], "location_id long, t long, k long")
    for r in iv.covered(points, iv.clean(a)).collect():
        assert r.inside == ((r.location_id, r.t) in x)
    over = {(r.location_id, r.start, r.previous_stop) for r in iv.overlaps(a).collect()}
    want = set()
    for loc in {r[0] for r in sets[0]}:
        upto = None
        for _, s, e in sorted(r for r in sets[0] if r[0] == loc):
            if upto is not None and s < upto:
                want.add((loc, s, upto))
            upto = e if upto is None else max(upto, e)
    assert over == want


def test_no_task_gets_a_whole_location(spark):
    """A location with most rows: the windows that sweep it see one bucket at a time."""
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, 2).otherwise(1).cast("long").alias("location_id"), (F.col("id") * 3600).alias("start"), (F.col("id") * 3600 + 1800).alias("stop"))
    found = iv.clean(df)
    assert found.count() == 20_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert windows and all(w.startswith("location_id") and "__b" in w for w in windows)


@pytest.mark.parametrize("limit", [0, 2**40])
def test_shuffles_of_a_series_state_their_partitions(spark, monkeypatch, limit):
    """Else adaptive execution joins them by compressed size, and one task gets all events."""
    monkeypatch.setattr(rn, "ONE_TASK", limit)
    a = spark.range(100).select((F.col("id") % 5).alias("location_id"), (F.col("id") * 3600).alias("start"), (F.col("id") * 3600 + 1800).alias("stop"))
    for found in (iv.clean(a), iv.invert(a), iv.with_coverage(a, 86400, 43200, 4320), iv.locate(a, a, "start")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        kinds = re.findall(r"Exchange hashpartitioning\(.*\), (\w+)", plan)
        # the last stop of each location is an aggregation of its own
        assert kinds and sum(k != "REPARTITION_BY_NUM" for k in kinds) <= 1
    assert rn.tasks_of(a, 10**6) > rn.tasks_of(a)


def test_spans_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(rs, "BUCKET", 10)
    rng = random.Random(3)
    times = sorted(rng.sample(range(200), 150))
    df = spark.createDataFrame([(1, t, float(t)) for t in times] + [(2, 5, 5.0)], "k long, ts long, value double")
    got = sorted((r.k, r.start_time, r.num_values, tuple(r["values"])) for r in rs.to_spans(df, 1, ["k"], most=8).collect())
    want, run = [], []
    for t in [*times, None]:
        if run and (t is None or t != run[-1] + 1):
            want += [(1, run[i], len(run[i : i + 8]), tuple(map(float, run[i : i + 8]))) for i in range(0, len(run), 8)]
            run = []
        run.append(t)
    assert got == sorted([*want, (2, 5, 1, (5.0,))])


def test_spans_are_shuffled_once_and_joined_at_bucket_ends(spark, monkeypatch):
    """Values travel once until they are packed; runs over many buckets, null keys and several parts come out as they should."""
    monkeypatch.setattr(rs, "BUCKET", 10)
    stored, real = [], rs.written
    monkeypatch.setattr(rs, "written", lambda df: stored.append(df) or real(df))
    times = {1: [*range(5, 48), *range(50, 60), 69, 70], 2: [3, 4, 9, 11], None: [*range(8, 22)]}
    df = spark.createDataFrame([(k, t, float(t)) for k, own in times.items() for t in own], "k long, t long, value double").repartition(3)
    got = {(r.k, r.start_time, tuple(r["values"])) for r in rs.to_spans(df.withColumnRenamed("t", "ts"), 1, ["k"], most=16).collect()}
    want = set()
    for k, own in times.items():
        starts = [i for i, t in enumerate(own) if i == 0 or own[i - 1] != t - 1]
        for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
            want |= {(k, own[i], tuple(map(float, own[i : min(b, i + 16)]))) for i in range(a, b, 16)}
    assert got == want
    plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_weather_rows_are_not_shuffled_by_feature(spark):
    from loadgrid.sources import release

    wide = spark.createDataFrame([(1, 0, [1.0], [2.0])], "weather_location_id long, start_time long, a array<double>, b array<double>")
    units = spark.createDataFrame([("a", "m")], "feature_name string, feature_unit string")
    rows = release.to_weather_rows(wide, ["a", "b"], units, ["weather_location_id", "start_time"])
    assert "hashpartitioning(feature_name" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.feature_name, r.feature_unit, r["values"][0]) for r in rows.collect()} == {("a", "m", 1.0), ("b", "unknown", 2.0)}


def test_distributions_and_mixture_backtests(spark):
    rows = [(k, [(float(np.log(0.3)), 2.0, 5.0 + k), (float(np.log(0.7)), 1.0, -3.0)]) for k in range(5)]
    df = spark.createDataFrame(rows, "k long, components array<struct<logpi:double,sigma:double,mu:double>>").withColumn("g", F.lit(1))
    import math

    ends = ds.bounds(df, ["g"]).first()
    got = {(r.k, r.pos): (r.x, r.reached) for r in ds.distributions(df, ["k"], ["g"], 9).collect()}
    assert len(got) == 45
    for (k, pos), (x, reached) in got.items():
        assert abs(x - (ends.low + (ends.high - ends.low) * pos / 8)) < 1e-9
        w = np.array([0.3, 0.7]) + 1e-6
        z = [(x - m - 1e-6) / (s + 1e-6) / math.sqrt(2) for _, s, m in rows[k][1]]
        assert abs(reached - sum(p / w.sum() * (1 + math.erf(v)) / 2 for p, v in zip(w, z, strict=True))) < 1e-9
    given = spark.createDataFrame([(1, [0.0, 2.0, 7.0, -1.0, 3.0, 9.0])], "k long, values array<double>")
    assert [tuple(c) for c in fc.mixtures(given).first().components] == [(0.0, 2.0, 7.0), (-1.0, 3.0, 9.0)]


def test_available_takes_the_latest_version_that_was_known(spark):
    windows = spark.createDataFrame([("a", 2 * 86400 + 21600)], "location string, horizon long")
    versions = spark.createDataFrame([("a", 86400, 0, 1.0), ("a", 86400, 100, 2.0), ("a", 86400, 300_000, 3.0), ("a", 9 * 86400, 0, 4.0), ("b", 86400, 0, 5.0)], "location string, ts long, available_at long, value double")
    got = wn.available(wn.horizon_windows(windows, 2, 1), versions, 2).collect()
    assert [(r.ts, r.available_at, r.value) for r in got] == [(86400, 100, 2.0)]
