"""Rules of windows, masks, resampling, distributions and sources, on small cases computed by hand or in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgrid.functions import scalars as fn
from loadgrid.operators import distributions as ds, forecast as fc, places, resample as rs, scores as sc, windows as wn
from loadgrid.operators.ranks import with_rank
from loadgrid.sources import buffer, files, release


def one(spark, expr, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_location_id_is_little_endian_sha(spark):
    import hashlib

    for name in ("location_a", "", "é"):
        want = int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "little") & (2**31 - 1)
        assert one(spark, fn.location_id(F.lit(name))) == want


def test_names_that_share_an_id_are_all_listed(spark):
    import hashlib

    first, pair = {}, None
    for k in range(400_000):
        name = f"Customer#{k:09d}"
        i = int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "little") & (2**31 - 1)
        if i in first:
            pair = {(first[i], i), (name, i)}
            break
        first[i] = name
    names = spark.createDataFrame([(n,) for n, _ in pair] * 2 + [("other",)], "name string")
    got = {tuple(r) for r in fn.name_ids(names).collect()}
    assert len(got) == 3 and pair <= got
    with pytest.raises(Exception, match="share id"):
        fn.checked_ids(names).collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_densities_are_made_in_batches(spark):
    rows = [(1, [(0.0, 1.0, 0.0), (0.0, 2.0, 3.0)]), (2, [(0.0, None, 1.0)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "k long, components array<struct<logpi:double,sigma:double,mu:double>>").withColumn("g", F.lit(1))
    found = ds.densities(df, ["k"], ["g"], 5)
    assert "MapInArrow" in _plan(found)
    got = {(r.k, r.pos): (r.x, r.density) for r in found.collect()}
    assert len(got) == 20
    x, d = got[1, 2]
    one_ = lambda m, s: math.exp(-(((x - m - 1e-6) / (s + 1e-6)) ** 2) / 2) / ((s + 1e-6) * math.sqrt(2 * math.pi))
    assert d == pytest.approx((one_(0, 1) + one_(3, 2)) / 2, rel=1e-9)
    assert all(got[3, p][1] == 0.0 and got[4, p][1] is None for p in range(5))


def test_chosen_makes_the_forecast_once(spark):
    made = spark.range(3).mapInArrow(lambda batches: batches, "id long").withColumn("quantile", F.explode(F.array(F.lit(0.1), F.lit(0.5))))
    found = ds.chosen(made, [0.5])
    assert "MapInArrow" not in _plan(found)
    assert sorted(r.id for r in found.collect()) == [0, 1, 2]


def test_a_batch_place_is_made_once(spark):
    rows = spark.range(100).withColumn("f", F.lit(1))
    found = wn.batches(rows, ["id"], 8, 2, 1, 0, drop_last=True, features="f")
    assert _plan(found).count("ArrowEvalPython") == 1 and found.count() == 96
    with pytest.raises(Exception, match="mixes"):
        wn.batches(rows.withColumn("f", F.col("id") % 2), ["id"], 8, 2, 1, 0, features="f").collect()


def test_stretch_is_aligned_at_the_corners(spark):
    v = [1.0, 3.0, None, 5.0, 9.0]
    assert one(spark, rs.stretch(F.col("v"), 5), v=v) == v
    x = np.arange(7.0) ** 2
    found = one(spark, rs.stretch(F.col("v"), 20), v=x.tolist())
    assert np.allclose(found, np.interp(np.linspace(0, 6, 20), np.arange(7), x))


def test_medians_are_the_lower_ones_and_nulls_pass(spark):
    v = [0.0, 1.0, 2.0, 3.0] * 10
    assert one(spark, wn.calm(F.col("v"), 4), v=v)
    assert not one(spark, wn.calm(F.col("v"), 4), v=v + [0.0, 50.0, 0.0, 50.0])
    assert one(spark, wn.calm(F.col("v"), 2), v=[1.0, 2.0, None, None])


def test_masks(spark):
    x, y = wn.prediction_masks(F.col("v"), 2)
    v = [1.0, None, 3.0, None, 5.0]
    assert one(spark, x, v=v) == [1, 0, 1, 0, 0] and one(spark, y, v=v) == [0, 0, 0, 0, 1]
    df = spark.range(200).select("id", F.array(*(F.lit(float(i)) for i in range(21))).alias("v"))
    xm, ym = wn.patch_masks(F.col("v"), 5, 0.3, 1, ["id"])
    rows = df.select(xm.alias("xm"), ym.alias("ym")).collect()
    for r in rows:
        assert all(a + b == 1 for a, b in zip(r.xm, r.ym, strict=True)) and sum(r.ym) >= 5 and r.ym[20] == 0
        assert all(len(set(r.ym[i : i + 5])) == 1 for i in range(0, 20, 5))
    assert 0.25 < np.mean([sum(r.ym) / 20 for r in rows]) < 0.5


def test_padding_refuses_longer_contexts(spark):
    assert one(spark, wn.left_padded(F.col("v"), 4), v=[1.0, 2.0]) == [0, 0, 1, 2]
    with pytest.raises(Exception, match="longer"):
        one(spark, wn.left_padded(F.col("v"), 1), v=[1.0, 2.0])


def test_ranks_and_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("location_id"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("stop"))
    assert sorted(r["rank"] for r in with_rank(df, [F.col("location_id")]).collect()) == list(range(1000))
    first = lambda x: sorted(r.location_id for r in wn.random_split(x, 20, 3)[0].collect())
    assert first(df) == first(df.repartition(9)) and len(first(df)) == 200
    a, b = wn.location_split(df, 30, 1)
    ids = [{r.location_id for r in x.collect()} for x in (a, b)]
    assert len(ids[0]) == 300 and not ids[0] & ids[1] and len(ids[1]) == 700


def test_batches_are_whole_and_disjoint(spark):
    df = spark.range(1003).withColumn("n_features", F.lit(2))
    rows = wn.batches(df, ["id"], 16, 3, seed=1, epoch=2, drop_last=True, features="n_features").collect()
    assert len({r.id for r in rows}) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r["rank"], r.batch] = sizes.get((r["rank"], r.batch), 0) + 1
    assert set(sizes.values()) == {16}
    other = wn.batches(df, ["id"], 16, 3, seed=1, epoch=3, drop_last=True).collect()
    assert [r.id for r in sorted(rows, key=lambda r: (r["rank"], r.batch, r.place))] != [r.id for r in sorted(other, key=lambda r: (r["rank"], r.batch, r.place))]
    with pytest.raises(Exception, match="mixes"):
        wn.batches(df.withColumn("n_features", F.col("id") % 2), ["id"], 16, features="n_features").collect()


def test_topped_up_keeps_the_number(spark):
    df = spark.range(50).withColumn("ok", F.col("id") % 3 == 0)
    rows = wn.topped_up(df, F.col("ok"), 4, ["id"]).collect()
    assert sorted(r.slot for r in rows) == list(range(50)) and all(r.id % 3 == 0 for r in rows) and {r.id for r in rows} >= {0, 3, 48}
    assert wn.topped_up(df, F.lit(False), 4, ["id"]).count() == 0


def test_quantiles_of_mixtures_match_a_scan_of_the_grid(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i, [(float(np.log(w)), float(s), float(m)) for w, s, m in zip(rng.dirichlet([1, 1]), rng.uniform(0.5, 3, 2), rng.normal(0, 5, 2), strict=True)]) for g in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, i int, components array<struct<logpi:double,sigma:double,mu:double>>")
    levels = [0.01, 0.5, 0.99, 1.0]
    found = {(r.g, r.i, r["quantile"]): r.value for r in ds.quantiles(df, ["g", "i"], ["g"], levels).collect()}
    for g in (1, 2):
        comps = [c for gg, _, cs in rows if gg == g for c in cs]
        low, high = min(m - 4 * s for _, s, m in comps), max(m + 4 * s for _, s, m in comps)
        low, high = low - 0.2 * (high - low), high + 0.2 * (high - low)
        xs = np.linspace(low, high, 1000)
        for gg, i, cs in rows:
            if gg != g:
                continue
            w = np.exp([c[0] for c in cs]) + 1e-6
            cdf = sum(p / w.sum() * 0.5 * (1 + np.array([math.erf((x - m - 1e-6) / ((s + 1e-6) * math.sqrt(2))) for x in xs])) for p, (_, s, m) in zip(w, cs, strict=True))
            for q in levels:
                hit = np.flatnonzero(cdf >= q)
                assert abs(found[g, i, q] - xs[hit[0] if len(hit) else -1]) <= (high - low) / 999 + 1e-9


def test_limits_below_zero_turn_the_comparison(spark):
    rows = [("a", 1, t, 0.5, v, y, lim) for t, (v, y, lim) in enumerate([(5.0, 6.0, 4.0), (3.0, 6.0, 4.0), (5.0, 1.0, 4.0)])]
    df = spark.createDataFrame(rows, "location string, run int, ts int, quantile double, value double, truth double, limit double")
    r = sc.exceedance(df, ["location"]).first()
    assert (r.precision, r.recall) == (0.5, 0.5)
    r = sc.exceedance(df.withColumn("limit", F.lit(-2.0)).withColumn("truth", -F.col("truth")).withColumn("value", -F.col("value")), ["location"]).first()
    assert r.precision == pytest.approx(2 / 3) and r.recall == 1.0
    r = sc.exceedance(df.withColumn("limit", F.lit(99.0)), ["location"]).first()
    assert (r.precision, r.recall, r.fbeta) == (0.0, 0.0, 0.0)


def test_nearest_by_tree_equals_nearest_of_few(spark, monkeypatch):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 4, (60, 2)))], "location_id int, lat double, lon double")
    right = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 2, (40, 2)))], "weather_id int, w_lat double, w_lon double")
    for metric in ("planar", "sphere"):
        want = sorted(tuple(r) for r in places.nearest(left, right, metric=metric).collect())
        monkeypatch.setattr(places, "FEW_POINTS", 5)
        assert sorted(tuple(r) for r in places.nearest(left, right, metric=metric).collect()) == want
        monkeypatch.undo()


def test_nearest_by_tree_finds_far_points_and_those_beyond_the_date_line(spark, monkeypatch):
    left = spark.createDataFrame([(0, 52.0, 5.0), (1, -40.0, 20.0), (2, 10.0, 179.9), (3, 10.0, -179.9), (4, 89.5, 0.0), (5, 10.0, 359.0)], "location_id int, lat double, lon double")
    right = spark.createDataFrame([(0, 35.0, 140.0), (1, 10.0, -179.5), (2, 10.5, 179.2), (3, 89.0, 170.0), (4, -80.0, -100.0), (5, 10.2, -1.5)], "weather_id int, w_lat double, w_lon double")
    for metric in ("planar", "sphere"):
        want = sorted(tuple(r) for r in places.nearest(left, right, metric=metric).collect())
        assert len(want) == 6
        monkeypatch.setattr(places, "FEW_POINTS", 2)
        assert sorted(tuple(r) for r in places.nearest(left, right, metric=metric).collect()) == want
        monkeypatch.undo()


def test_flat_buffer(spark, tmp_path):
    data = np.arange(24, dtype="<f4").reshape(12, 2)
    data[3, 1] = np.nan
    data.tofile(tmp_path / "values.np")
    spans = spark.createDataFrame([(0, 5, 1000, 4, 60), (4, 6, 2000, 5, 60), (9, 99, 0, 3, 60)], "id long, location long, datetime_start long, num_values long, sample_interval_s long")
    locations = spark.createDataFrame([(5, "x"), (6, "y")], "location_id long, name string")
    rows = buffer.read_buffer(spark, str(tmp_path / "values.np"), spans, locations, ["a", "b"], ["b"]).collect()
    assert len(rows) == 9
    by = {r.ts: r.b for r in rows}
    assert by[1000] == 1.0 and by[1180] is None and by[2240] == 17.0


def test_content_hash_ignores_order_and_sees_values(spark):
    rows = [("s", 1, 0, [1.0, None]), ("s", 1, 900, [2.0]), ("t", 2, 0, [3.0])]
    schema = "source string, location_id long, start_time long, values array<double>"
    h = lambda r: release.content_hash(spark.createDataFrame(r, schema).repartition(3)).first()[0]
    assert h(rows) == h(rows[::-1])
    assert h(rows) != h([*rows[:2], ("t", 2, 0, [3.5])])


def test_incomplete_weather_is_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 2, "a", [1.0, 2.0]), (1, 0, 2, "b", [1.0, 2.0]), (2, 0, 2, "a", [1.0, 2.0])], "weather_location_id long, start_time long, num_values int, feature_name string, values array<double>")
    assert release.from_weather_rows(rows.where("weather_location_id = 1"), ["a", "b"]).count() == 1
    with pytest.raises(Exception, match="location 2"):
        release.from_weather_rows(rows, ["a", "b"]).collect()
    with pytest.raises(Exception, match="no coordinates"):
        release.write_measurements(spark.createDataFrame([(1, None, 2.0, 0)], "location_id long, lat double, lon double, start_time long"), "/tmp/never-written")


def test_predictor_shape_is_checked(spark):
    df = spark.createDataFrame([(1, [1.0, None], [1, 0]), (2, [3.0, 4.0, 5.0], [1, 1, 1])], "k long, x array<double>, xm array<int>")
    rows = fc.predicted(df, lambda x, m: np.nan_to_num(x)[:, :, None] * 2, ["k"]).collect()
    assert sorted((r.k, r.pos, r["values"][0]) for r in rows) == [(1, 0, 2.0), (1, 1, 0.0), (2, 0, 6.0), (2, 1, 8.0), (2, 2, 10.0)]
    with pytest.raises(Exception, match="predictor returned"):
        fc.predicted(df, lambda x, m: x[:, :, None], ["k"], outputs=2).collect()
