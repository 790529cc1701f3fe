"""Selection of percentiles, permuted batches, mergeable hashes, two-phase reading, safe appends, pooling with halos."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgrid.functions import scalars as fn
from loadgrid.operators import places, resample as rs, running as rn, scores as sc, selection as sel, windows as wn
from loadgrid.sources import files, release


def test_percentiles_by_refinement(spark, monkeypatch):
    monkeypatch.setattr(sel, "BINS", 4)
    monkeypatch.setattr(sel, "FEW", 5)
    rng = random.Random(1)
    rows = []
    for g in range(6):
        n = [1, 2, 7, 400, 900, 300][g]
        for _ in range(n):
            rows.append((g, [rng.gauss(0, 1), rng.randrange(4) * 1.0, rng.expovariate(1) ** 8, -5.0, rng.uniform(0, 1e300), rng.choice([1e308, -1e308, 3.0])][g]))
    rows += [(3, None), (3, float("nan")), (7, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    fractions = {"a": 0.01, "b": 0.5, "c": 0.99, "d": 1.0, "e": 0.0}
    monkeypatch.setattr(rn, "ONE_TASK", 0)
    got = {r.g: r for r in sel.percentiles(df, ["g"], "v", fractions).collect()}
    assert sorted(got) == list(range(6))
    for g, r in got.items():
        x = np.sort([v for k, v in rows if k == g and v is not None and v == v])
        for name, f in fractions.items():
            at = (len(x) - 1) * f
            lo, hi = int(np.floor(at)), int(np.ceil(at))
            assert r[name] == pytest.approx(x[lo] if lo == hi else x[lo] * (1 - (at - lo)) + x[hi] * (at - lo), rel=1e-12)


def test_mae_of_long_runs_is_that_of_short_ones(spark, monkeypatch, tmp_path):
    rng = random.Random(2)
    rows = [("x", run, q, t, rng.gauss(5, 2), rng.choice([None, rng.gauss(5, 2)])) for run in range(3) for q in (0.1, 0.9) for t in range(200)]
    spark.createDataFrame(rows, "location string, run long, quantile double, ts long, value double, truth double").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    want = {r.quantile: r.mae for r in sc.mae(df, ["location"]).collect()}
    monkeypatch.setattr(sel, "FEW", 10)
    monkeypatch.setattr(rn, "ONE_TASK", 0)
    got = {r.quantile: r.mae for r in sc.mae(df, ["location"]).collect()}
    assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q], rel=1e-12) for q in want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_shuffle_is_one_to_one_and_can_be_undone(spark, n):
    df = spark.range(n).select("id", fn.shuffled(F.col("id"), n, 7).alias("at"), fn.shuffled(F.col("id"), n, 8).alias("other"))
    rows = df.withColumn("back", fn.shuffled(F.col("at"), n, 7, back=True)).collect()
    assert sorted(r["at"] for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n >= 97:
        assert sum(r["at"] == r.other for r in rows) < n / 10 and sum(abs(r["at"] - r.id) for r in rows) / n > n / 5


def test_a_batch_reads_by_itself(spark):
    rows = spark.range(1003).select((F.col("id") * 7 % 1003).alias("k"))
    numbered = wn.numbered_rows(rows, ["k"])
    n = numbered.count()
    whole = wn.batches(numbered, ["k"], 16, 3, 1, 4, number="number")
    assert whole.count() == n and sorted((r.rank, r.batch, r.place) for r in whole.collect()) == sorted((p % 3, p // 3 // 16, p // 3 % 16) for p in range(n))
    for rank, batch in ((0, 0), (2, 5), (1, 20)):
        want = {(r.k, r.place) for r in whole.where((F.col("rank") == rank) & (F.col("batch") == batch)).collect()}
        assert want == {(r.k, r.place) for r in wn.one_batch(numbered, n, rank, batch, 16, 3, 1, 4).collect()}
    plan = wn.batches(numbered, ["k"], 16, 3, 1, 5, number="number")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert wn.batches(rows.limit(0), ["k"], 4).count() == 0


def test_hashes_of_parts_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice("st"), k, k * 900, [rng.choice([None, float("nan"), rng.gauss(0, 9)]) for _ in range(5)]) for k in range(40)]
    schema = "source string, location_id long, start_time long, values array<double>"
    df = spark.createDataFrame(rows, schema)
    whole = release.content_hash(df).first()[0]
    parts = [release.content_state(spark.createDataFrame(p, schema)) for p in (rows[:7], rows[7:30], rows[30:])]
    assert release.hash_of_state(release.merged_states(*parts)).first()[0] == whole and len(whole) == 64
    import hashlib

    each = {}
    for s, loc, t, v in rows:
        text = ",".join("null" if x is None or x != x else f"{float(np.float32(x)):.9e}" for x in v)
        n, total = each.get(s, (0, 0))
        each[s] = (n + 1, (total + int(hashlib.sha256(f"{loc}|{t}|{text}".encode()).hexdigest(), 16)) % 2**256)
    want = sum(int(hashlib.sha256(f"{n}:{total:064x}".encode()).hexdigest(), 16) for n, total in each.values()) % 2**256
    assert whole == f"{want:064x}"
    assert release.content_hash(df.limit(0)).first()[0] == "0" * 64


def test_only_files_with_wanted_spans_are_read(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [(loc, start * 900, 900, 4, [1.0, 2.0, 3.0, 4.0]) for loc in range(20) for start in range(0, 400, 4)]
    df = spark.createDataFrame(rows, "location_id long, start_time long, sample_interval_s int, num_values long, values array<double>")
    release.write_measurements(df, path, coordinates=False, files=10)
    found = release.wanted_values(spark, path, [3, 4], 90_000, 100_000)
    want = sorted((r[0], r[1]) for r in rows if r[0] in (3, 4) and r[1] < 100_000 and r[1] + 3600 > 90_000)
    assert sorted((r.location_id, r.start_time) for r in found.collect()) == want and want
    assert 1 <= len(found.inputFiles()) <= 3 and len(spark.read.parquet(path).inputFiles()) == 10
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = release.wanted_values(spark, path, [3, 4], 90_000, 100_000)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(start_time" in plan
    assert release.wanted_values(spark, path, [99], 0, 10**9).count() == 0 and release.wanted_values(spark, path, [1], 10**9, 10**9 + 1).count() == 0


def test_an_iteration_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    row = lambda i, v: spark.createDataFrame([(i, "a", v, 0.5), (i, "b", float("inf"), None)], "iteration long, location string, crps double, `mae_0.5` double")
    for i, v in ((1, 1.0), (2, 2.0), (2, 3.0)):
        files.append_metrics(row(i, v), path, "x")
    files.append_metrics(row(2, 9.0), path, "y")
    read = lambda i, run: sorted(map(tuple, files.read_metrics(spark, path, i, ["crps", "mae_0.5"], run).collect()))
    assert read(1, "x") == [("a", 1.0, 0.5), ("b", None, None)] and read(2, "x") == [("a", 3.0, 0.5), ("b", None, None)]
    assert read(2, "y")[0] == ("a", 9.0, 0.5) and len(read(2, None)) == 4


def plain_pool(values, kernel, stride, q, dilation, padding):
    """{window: quantile} of a dict of positions."""
    n = max(values) + 1
    have = values | {p: 0.0 for p in (*range(-padding, 0), *range(n, n + padding))}
    out = {}
    for k in range((n + 2 * padding) // stride + 1):
        own = [have.get(k * stride - padding + i * dilation, "gap") for i in range(kernel)]
        if "gap" not in own:
            x = [v for v in own if v is not None]
            out[k] = float(np.quantile(x, q)) if x else None
    return out


@pytest.mark.parametrize(("kernel", "stride", "dilation", "padding"), [(5, 3, 2, 2), (1, 1, 1, 0), (30, 7, 1, 10), (4, 50, 3, 0), (12, 1, 5, 3)])
def test_pooling_over_blocks(spark, monkeypatch, kernel, stride, dilation, padding):
    monkeypatch.setattr(rs, "POOLED", 40)
    monkeypatch.setattr(rs, "CELLS", 60)
    rng = random.Random(kernel)
    series = {k: {p: rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)]) for p in range(n) if k != "c" or rng.random() < 0.98} for k, n in (("a", 700), ("b", 9), ("c", 300))}
    df = spark.createDataFrame([(k, p, v) for k, s in series.items() for p, v in s.items()], "location string, pos long, value double").repartition(4)
    got = {(r.location, r.window): r.value for r in rs.pool_quantile(df, ["location"], kernel, stride, 0.9, dilation, padding).collect()}
    want = {(k, w): v for k, s in series.items() for w, v in plain_pool(s, kernel, stride, 0.9, dilation, padding).items()}
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v, rel=1e-12)) for k, v in want.items())


def test_upsampling_of_clipped_spans(spark):
    spans = spark.createDataFrame([("a", 100, 100, [1.0, None, 3.0, 4.0, float("nan"), 6.0]), ("b", 0, 100, [None, None]), ("c", 950, 100, [1.0, 2.0])], "location string, start_time long, sample_interval_s int, values array<double>")
    rows = lambda low, high: sorted(tuple(r) for r in rs.upsample(spans, 50, ["location"], low, high).where("location = 'a'").select("ts", "value").collect())
    assert rows(None, None) == [(100, 1.0), (150, 1.5), (200, 2.0), (250, 2.5), (300, 3.0), (350, 3.5), (400, 4.0), (450, 4.5), (500, 5.0), (550, 5.5), (600, 6.0)]
    assert rows(200, 501) == [(200, None), (250, None), (300, 3.0), (350, 3.5), (400, 4.0), (450, 4.0), (500, 4.0)]
    assert rows(5000, None) == []
    assert [r.value for r in rs.upsample(spans, 50, ["location"]).where("location = 'b'").collect()] == [None] * 3
    assert sorted((r.ts, r.value) for r in rs.upsample(spans, 100, ["location"]).where("location = 'c'").collect()) == [(900, None), (1000, None)]


def test_first_rows_by_a_stated_order(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 5, "only"), ("a", 1, "zero")], "name string, place int, what string")
    assert {tuple(r) for r in places.first_of(rows, ["name"], ["place"]).select("name", "what").collect()} == {("a", "first"), ("b", "only")}
    catalogue = rows.select("name", "place", F.col("place").cast("double").alias("lon"), F.lit(1.0).alias("lat"))
    series = spark.createDataFrame([("a",), ("c",)], "location string")
    got = {r.location: (r.lon, r.lat) for r in files.with_catalogue(series, catalogue, order=["place"]).collect()}
    assert got == {"a": (1.0, 1.0), "c": (None, None)}


def test_catalogue_keeps_the_order_of_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,lon,lat\nx,9,1\ny,2,2\nx,3,3\n")
    for path in (str(tmp_path / "c.csv"), f"file://{tmp_path}/c.csv", f"file:{tmp_path}/*.csv"):
        table = files.read_catalogue(spark, path)
        series = spark.createDataFrame([("x",), ("y",)], "location string")
        assert {(r.location, r.lon) for r in files.with_catalogue(series, table, order=["place"]).collect()} == {("x", 9.0), ("y", 2.0)}
