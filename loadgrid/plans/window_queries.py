"""Registered queries of windows, splits, masks, normalisation and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadgrid.operators import distributions as ds, intervals as iv, normalise as nm, places, resample as rs, windows as wn
from loadgrid.plans.inputs import EVENTS, SETS, SITES, STATIONS, STEP, events, quantiles_sql, reached_sql, samples, samples_sql, set_all, shuffled_sql, sites, stations, sweep, table, uniform_sql
from loadgrid.plans.interval_queries import CLEAN, GAPS, coverage_sql
from loadgrid.plans.series_queries import r5, r6

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


LENGTH, PREDICT = 172800, 48
N = LENGTH // STEP


def windows(s, d):
    """Windows of two days, one from each day of an event type's samples."""
    day = lambda t: t - t % 86400
    ends = samples(s, d).groupBy("location").agg(day(F.min("ts")).alias("a"), day(F.max("ts")).alias("b"))
    return ends.select("location", F.explode(F.sequence("a", "b", F.lit(86400).cast("long"))).alias("window_start"))


def read(s, d):
    return wn.read_windows(samples(s, d), windows(s, d), LENGTH, STEP)


WIN = f"""{EVENTS}, {samples_sql()}, w AS (SELECT location, window_start, unnest(range(0, {N})) AS pos FROM (SELECT location, unnest(range(min(ts) // 86400 * 86400, max(ts) + 1, 86400)) AS window_start FROM s GROUP BY 1)),
v AS (SELECT w.location, w.window_start, w.pos, s.value FROM w LEFT JOIN s ON s.location = w.location AND s.ts = w.window_start + w.pos * {STEP})"""


def long(df, keys, **arrays):
    """Arrays of equal length as rows with pos."""
    zipped = F.arrays_zip(*(F.col(c).alias(n) for n, c in arrays.items()))
    return df.select(*keys, F.posexplode(zipped).alias("pos", "z")).select(*keys, F.col("pos").cast("long").alias("pos"), *(F.col(f"z.{n}").alias(n) for n in arrays))


KEYS = ["location", "window_start"]
query("d6_read_windows", f"WITH {WIN} SELECT location, window_start, pos, round(value + 1.37e-8, 6) + 0.0 AS value FROM v")(lambda s, d: long(read(s, d), KEYS, value="values").withColumn("value", r6(F.col("value"))))


TYPES = ("click", "error", "purchase", "signup", "view")


def wide(s, d):
    """Windows of all sources at the same times, one column of values each."""
    return read(s, d).groupBy("window_start").pivot("location", list(TYPES)).agg(F.first("values"))


def several(s, d, shape=lambda c: c):
    """The sum of all sources that a window has."""
    none = F.array_repeat(F.lit(None).cast("double"), N)
    return wide(s, d).withColumn("m", wn.merged(*(shape(F.coalesce(F.col(t), none)) for t in TYPES)))


query("d8_merged", f"WITH {WIN} SELECT window_start, pos, round(CASE WHEN count(value) > 0 THEN sum(coalesce(value, 0) ORDER BY location) END + 1.37e-8, 6) + 0.0 AS value FROM v GROUP BY 1, 2")(
    lambda s, d: long(several(s, d), ["window_start"], value="m").withColumn("value", r6(F.col("value")))
)
_LIMITS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in wn.CONTEXT_LIMITS.items())
query("g1_context_pairs", f"""WITH {EVENTS}, l(i, a, b) AS (VALUES {_LIMITS}), p AS (SELECT d::INTEGER AS context_days, i::INTEGER AS interval_minutes, (d * 1440 // i)::INTEGER AS points
FROM (SELECT unnest({list(wn.CONTEXT_DAYS)}) AS d), l WHERE d BETWEEN a AND b AND d * 1440 % i = 0 AND d * 1440 // i >= 32), q AS (SELECT *, max(points) OVER () AS padded_length FROM p),
r AS (SELECT user_id AS location, max(t) - min(t) AS reach FROM e GROUP BY 1)
SELECT location, context_days, interval_minutes, points, padded_length - points AS pad_left, padded_length, reach // (context_days * 86400) AS contexts FROM r JOIN q ON reach >= context_days * 86400""")(
    lambda s, d: wn.fitting_pairs(wn.context_pairs(s), events(s, d).groupBy(F.col("user_id").alias("location")).agg((F.max("t") - F.min("t")).alias("reach")))
)

SINCE = 1705000000


def held(s, d):
    return set_all(s, d).where("location_id % 7 = 0").select("location_id")


BENCH = f"""h0 AS (SELECT location_id, greatest(start, {SINCE}) AS start, stop FROM w WHERE location_id % 7 = 0), {sweep('h1', 'h0', 'x > 0')},
h2 AS (SELECT location_id, start, stop - 7200 AS stop FROM h1 WHERE stop - 7200 > start), {sweep('rest', 'w', 'x > 0 AND y = 0', 'h1')}"""
query("g2_benchmark_split", f"WITH {SETS}, {BENCH} SELECT 'benchmark' AS part, location_id, start, stop FROM h2 UNION ALL SELECT 'rest', location_id, start, stop FROM rest")(
    lambda s, d: wn.benchmark_parts(set_all(s, d), held(s, d), SINCE, 7200)
)
query("g3_training_starts", f"""WITH {SETS}, {CLEAN}, {GAPS}, {sweep('f', 'gu', 'x > 0')}, {coverage_sql('f', 86400, 51840, 4320, 'cv')}
SELECT location_id, start, stop - 86400 AS stop FROM cv WHERE stop - 86400 > start""")(lambda s, d: wn.training_starts(set_all(s, d), 1, 25, 0.6))


def both(pair):
    return pair[0].withColumn("part", F.lit("first")).unionByName(pair[1].withColumn("part", F.lit("second")))


query("g4_random_split", f"""WITH {SETS}, {CLEAN}, n AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql(3, 'location_id', 'start', 'stop')}, location_id, start) - 1 AS k, floor(0.2::DOUBLE * count(*) OVER ()) AS most FROM c)
SELECT location_id, start, stop, CASE WHEN k < most THEN 'first' ELSE 'second' END AS part FROM n""")(lambda s, d: both(wn.random_split(iv.clean(set_all(s, d)), 20, 3)))
query("g5_location_split", f"""WITH {SETS}, i AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql(3, 'location_id')}, location_id) - 1 AS k, count(*) OVER () * 30 // 100 AS most FROM (SELECT DISTINCT location_id FROM w))
SELECT w.location_id, start, stop, CASE WHEN k < most THEN 'first' ELSE 'second' END AS part FROM w JOIN i USING (location_id)""")(lambda s, d: both(wn.location_split(set_all(s, d), 30, 3)))
query("g6_split_windows", f"""WITH {SETS}, {BENCH}, v0 AS (SELECT location_id, greatest(start, 1705500000) AS start, stop FROM rest), {sweep('va', 'v0', 'x > 0')}, {sweep('tr', 'rest', 'x > 0 AND y = 0', 'va')},
al AS (SELECT 'train' AS part, * FROM tr UNION ALL SELECT 'validation', * FROM va UNION ALL SELECT 'benchmark', * FROM h2)
SELECT part, location_id, unnest(range((start + 3599) // 3600 * 3600, stop, 3600)) AS t FROM al""")(
    lambda s, d: wn.dated_split_windows(set_all(s, d), held(s, d), SINCE, 7200, 1705500000, iv.FAR, 3600)
)
SMALL = 48
query("g7_window_sample", f"""WITH {WIN}, h AS (SELECT j, (j * {N - 1} / {SMALL - 1}.0)::DOUBLE AS p FROM (SELECT unnest(range(0, {SMALL})) AS j)), g AS (SELECT j, floor(p)::BIGINT AS low, p - floor(p) AS share FROM h),
i AS (SELECT x.location, x.window_start, j, CASE WHEN share = 0 THEN x.value ELSE x.value * (1 - share) + y.value * share END AS x FROM g JOIN v x ON x.pos = low JOIN v y ON y.location = x.location AND y.window_start = x.window_start AND y.pos = least(low + 1, {N - 1}))
SELECT window_start, j AS pos, round(CASE WHEN count(x) > 0 THEN sum(coalesce(x, 0) ORDER BY location) END + 1.37e-7, 5) + 0.0 AS value, '{SMALL}' AS context_length FROM i GROUP BY 1, 2""")(
    lambda s, d: long(several(s, d, lambda c: rs.stretch(c, SMALL)), ["window_start"], value="m").withColumn("value", r5(F.col("value"))).withColumn("context_length", F.lit(str(SMALL)))
)


def by_station(s, d):
    """Samples of 25 weather points."""
    e = events(s, d)
    return e.groupBy((F.col("user_id") % 25).alias("weather_id"), (F.col("t") - F.pmod("t", F.lit(3600))).alias("ts")).agg(F.avg("value").alias("value"))


def weather_windows(s, d):
    near = places.nearest(sites(s, d), stations(s, d)).select("location_id", "weather_id")
    # a window from each day that a point has samples of
    days = by_station(s, d).select("weather_id", (F.col("ts") - F.col("ts") % 86400).alias("window_start")).distinct()
    wanted = near.join(days, "weather_id")
    found = wn.read_windows(by_station(s, d), wanted, 86400, 3600, "weather_id")
    return long(wanted.join(found, ["weather_id", "window_start"]), ["location_id", "weather_id", "window_start"], value="values").withColumn("value", r6(F.col("value")))


query("g8_weather_windows", f"""WITH {EVENTS}, {SITES}, {STATIONS}, n AS (SELECT location_id, arg_min(weather_id, (round(sqrt((lat - w_lat) * (lat - w_lat) + (lon - w_lon) * (lon - w_lon)), 9), weather_id)) AS weather_id FROM si CROSS JOIN st GROUP BY 1),
b AS (SELECT user_id % 25 AS weather_id, t - t % 3600 AS ts, avg(value) AS value FROM e GROUP BY 1, 2)
SELECT n.location_id, n.weather_id, window_start, pos, round(b.value + 1.37e-8, 6) + 0.0 AS value FROM n JOIN (SELECT DISTINCT weather_id, ts - ts % 86400 AS window_start FROM b) dy ON dy.weather_id = n.weather_id CROSS JOIN (SELECT unnest(range(0, 24)) AS pos)
LEFT JOIN b ON b.weather_id = n.weather_id AND b.ts = window_start + pos * 3600""")(weather_windows)


def masked(s, d):
    x, y = wn.prediction_masks(F.col("values"), PREDICT)
    return read(s, d).withColumn("xm", x).withColumn("ym", y)


MASK = f"m AS (SELECT *, CASE WHEN value IS NULL OR pos >= {N - PREDICT} THEN 0 ELSE 1 END AS xm, CASE WHEN value IS NULL OR pos < {N - PREDICT} THEN 0 ELSE 1 END AS ym FROM v)"
query("g9_prediction_masks", f"WITH {WIN}, {MASK} SELECT location, window_start, pos, xm, ym FROM m")(lambda s, d: long(masked(s, d), KEYS, xm="xm", ym="ym"))
_WIDTH = f"greatest(96, floor({N} * ({uniform_sql(5, 'location', 'window_start')} * (0.6::DOUBLE - 0.2::DOUBLE) + 0.2::DOUBLE))::INTEGER)"
query("g10_variable_masks", f"""WITH {WIN}, x AS (SELECT *, {_WIDTH} AS width FROM v) SELECT location, window_start, width, pos, CASE WHEN value IS NULL OR pos >= {N} - width THEN 0 ELSE 1 END AS xm, CASE WHEN value IS NULL OR pos < {N} - width THEN 0 ELSE 1 END AS ym FROM x""")(
    lambda s, d: (lambda w: long(w.withColumn("xm", wn.prediction_masks(F.col("values"), F.col("width"))[0]).withColumn("ym", wn.prediction_masks(F.col("values"), F.col("width"))[1]), [*KEYS, "width"], xm="xm", ym="ym"))(
        read(s, d).withColumn("width", wn.variable_width(5, F.size("values"), KEYS, 0.2, 0.6, 96))
    )
)
query("g11_patch_masks", f"""WITH {WIN}, u AS (SELECT location, window_start, p, {uniform_sql(5, 'location', 'window_start', 'p')} AS u FROM (SELECT DISTINCT location, window_start FROM v), (SELECT unnest(range(0, {N // 8})) AS p)),
x AS (SELECT *, min(u) OVER (PARTITION BY location, window_start) AS least FROM u), y AS (SELECT v.*, CASE WHEN value IS NOT NULL AND u <= greatest(0.3::DOUBLE, least) THEN 1 ELSE 0 END AS ym FROM v JOIN x ON x.location = v.location AND x.window_start = v.window_start AND x.p = v.pos // 8)
SELECT location, window_start, pos, 1 - ym AS xm, ym FROM y""")(
    lambda s, d: long(read(s, d).withColumn("xm", wn.patch_masks(F.col("values"), 8, 0.3, 5, KEYS)[0]).withColumn("ym", wn.patch_masks(F.col("values"), 8, 0.3, 5, KEYS)[1]), KEYS, xm="xm", ym="ym")
)
query("g12_enough", f"WITH {WIN}, {MASK} SELECT location, window_start, sum(xm) >= 70 AND sum(ym) >= 10 AS ok FROM m GROUP BY 1, 2")(
    lambda s, d: masked(s, d).select(*KEYS, (wn.enough(F.col("xm"), F.col("ym")) & wn.enough(F.col("xm"), F.col("xm"), 70)).alias("ok"))
)
CALM = f"""c AS (SELECT location, window_start, quantile_cont(value, 0.99) FILTER (pos < {N - PREDICT}) - quantile_cont(value, 0.01) FILTER (pos < {N - PREDICT}) + 1e-6 AS spread,
max(value) FILTER (pos >= {N - PREDICT}) - min(value) FILTER (pos >= {N - PREDICT}) AS r, quantile_disc(value, 0.5) FILTER (pos < {N - PREDICT}) AS mx, quantile_disc(value, 0.5) FILTER (pos >= {N - PREDICT}) AS my FROM v GROUP BY 1, 2)"""
query("g13_calm", f"WITH {WIN}, {CALM} SELECT location, window_start, NOT (coalesce(r / spread > 0.8, false) OR coalesce(abs(my - mx) / spread > 0.1, false)) AS ok FROM c")(
    lambda s, d: read(s, d).select(*KEYS, wn.calm(F.col("values"), PREDICT, 0.8, 0.1).alias("ok"))
)
query("g14_topped_up", f"""WITH {WIN}, {CALM}, k AS (SELECT location, window_start, NOT (coalesce(r / spread > 0.8, false) OR coalesce(abs(my - mx) / spread > 0.1, false)) AS ok FROM c),
g AS (SELECT location, window_start, row_number() OVER (ORDER BY location, window_start) - 1 AS n FROM k WHERE ok), m AS (SELECT (SELECT count(*) FROM g) AS good, (SELECT count(*) FROM k) AS whole),
s2 AS (SELECT unnest(range(0, whole)) AS slot, good FROM m), t2 AS (SELECT slot, CASE WHEN slot < good THEN slot ELSE floor({uniform_sql(11, 'slot')} * good)::BIGINT END AS n FROM s2)
SELECT slot, location, window_start FROM t2 JOIN g USING (n)""")(lambda s, d: wn.topped_up(read(s, d), wn.calm(F.col("values"), PREDICT, 0.8, 0.1), 11, KEYS).select("slot", *KEYS))
query("g15_left_padded", f"WITH {WIN} SELECT location, window_start, pos + 8 AS pos, round(value + 1.37e-8, 6) + 0.0 AS value FROM v UNION ALL SELECT location, window_start, pos, 0.0 FROM v WHERE pos < 8")(
    lambda s, d: long(read(s, d).withColumn("p", wn.left_padded(F.col("values"), N + 8)), KEYS, value="p").withColumn("value", r6(F.col("value")))
)
query("g16_applied", f"WITH {WIN}, {MASK} SELECT location, window_start, pos, round(coalesce(value, 0) * xm + 1.37e-8, 6) + 0.0 AS x, round(coalesce(value, 0) * ym + 1.37e-8, 6) + 0.0 AS y FROM m")(
    lambda s, d: long(masked(s, d).withColumn("x", wn.applied(F.col("values"), F.col("xm"))).withColumn("y", wn.applied(F.col("values"), F.col("ym"))), KEYS, x="x", y="y").withColumns({c: r6(F.col(c)) for c in "xy"})
)
query("g17_target_times", f"WITH {SETS} SELECT DISTINCT unnest(range(t0, t0 + 2 * 86400, 21600)) AS ts FROM (SELECT start - start % 86400 + 4 * 86400 AS t0 FROM w) ORDER BY 1")(
    lambda s, d: wn.target_times(set_all(s, d).select((F.col("start") - F.col("start") % 86400).alias("t")), 3, 2, 2, 21600)
)
_G18 = f"nu AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS number FROM events), {shuffled_sql('sh', 'nu', 'number', 'count(*) FROM events', 1 + 2 * wn.EPOCH)}"
query("g18_batches", f"""WITH RECURSIVE {_G18}, k AS (SELECT event_id, spot, (SELECT count(*) FROM events) AS whole FROM nu JOIN sh USING (number))
SELECT event_id, 3::BIGINT AS n_features, (spot % 4)::INTEGER AS rank, spot // 4 // 32 AS batch, (spot // 4 % 32)::INTEGER AS place FROM k WHERE spot // 4 // 32 < ((whole - 1 - spot % 4) // 4 + 1) // 32""")(lambda s, d: wn.batches(events(s, d).select("event_id", (F.col("user_id") * 0 + 3).alias("n_features")), ["event_id"], 32, 4, 1, 2, drop_last=True, features="n_features"))
query("g18_one_batch", f"""WITH RECURSIVE {_G18} SELECT event_id, (spot // 4 % 32)::INTEGER AS place FROM nu JOIN sh USING (number) WHERE spot % 4 = 3 AND spot // 4 // 32 = 5""")(
    lambda s, d: (lambda rows: wn.one_batch(rows, rows.count(), 3, 5, 32, 4, 1, 2).select("event_id", "place"))(wn.numbered_rows(events(s, d).select("event_id"), ["event_id"]))
)
query("g19_variates", f"""WITH {WIN}, x AS (SELECT t.window_start, l.location, p.pos FROM (SELECT DISTINCT window_start FROM v) t, (SELECT unnest({list(TYPES)}) AS location) l, (SELECT unnest(range(0, {N})) AS pos) p)
SELECT x.window_start, x.location AS variate, x.pos, CASE WHEN x.location <> 'click' OR x.pos < {N - PREDICT} THEN round(value + 1.37e-8, 6) + 0.0 END AS value FROM x LEFT JOIN v ON v.window_start = x.window_start AND v.location = x.location AND v.pos = x.pos""")(
    lambda s, d: variates(wide(s, d))
)


def variates(w):
    """Every source of a window, clicks being the target."""
    w = w.select("window_start", *(F.coalesce(F.col(t), F.array_repeat(F.lit(None).cast("double"), N)).alias(t) for t in TYPES))
    w = w.withColumns({f"{t}_m": wn.prediction_masks(F.col(t), PREDICT, target=t == "click")[0] for t in TYPES})
    return long(wn.variates(w, ["window_start"], {t: (t, f"{t}_m") for t in TYPES}, "click", PREDICT), ["window_start", "variate"], value="values").withColumn("value", r6(F.col("value")))


def horizons(s, d):
    """Six in the morning of every day on which a source has events."""
    return events(s, d).select(F.col("event_type").alias("location"), (F.col("t") - F.col("t") % 86400 + 21600).alias("horizon")).distinct()


_HZ = "h AS (SELECT DISTINCT event_type AS location, t // 86400 * 86400 + 21600 AS horizon FROM e)"
query("g20_horizon_windows", f"WITH {EVENTS}, {_HZ} SELECT location, horizon, horizon // 86400 * 86400 - 3 * 86400 AS window_start, horizon // 86400 * 86400 AS predict_start FROM h")(
    lambda s, d: wn.horizon_windows(horizons(s, d), 4, 1)
)


def versions(s, d):
    """Weather versions: each hour's value is published on the evenings of the three days before."""
    e = events(s, d)
    v = e.groupBy((F.col("t") - F.col("t") % 3600).alias("ts"), F.col("event_type").alias("location"), (F.col("event_id") % 3).alias("k")).agg(F.avg("value").alias("value"))
    return v.select("location", "ts", (F.col("ts") - F.col("ts") % 86400 - F.col("k") * 86400 - 64800 + 86400).alias("available_at"), "value")


VERSIONS = f"""x AS (SELECT event_type AS location, t - t % 3600 AS ts, t - t % 86400 - (event_id % 3) * 86400 + 21600 AS available_at, avg(value) AS value FROM e GROUP BY 1, 2, 3), {_HZ},
av AS (SELECT location, horizon, ts, available_at, value FROM (SELECT h.location, h.horizon, ts, available_at, value, row_number() OVER (PARTITION BY h.location, horizon, ts ORDER BY available_at DESC) AS n FROM h JOIN x ON x.location = h.location AND available_at <= horizon
AND ts >= horizon // 86400 * 86400 - 3 * 86400 AND ts < horizon // 86400 * 86400 + 86400) WHERE n = 1)"""
query("g20_available", f"WITH {EVENTS}, {VERSIONS} SELECT location, horizon, ts, available_at, round(value + 1.37e-8, 6) + 0.0 AS value FROM av")(
    lambda s, d: wn.available(wn.horizon_windows(horizons(s, d), 4, 1), versions(s, d), 4).select("location", "horizon", "ts", "available_at", r6(F.col("value")).alias("value"))
)
query("g20_horizon_inputs", f"""WITH {EVENTS}, {VERSIONS}, hs AS (SELECT event_type AS location, t - t % 3600 AS ts, avg(value) AS value FROM e GROUP BY 1, 2),
g AS (SELECT location, horizon, pos, horizon // 86400 * 86400 - 3 * 86400 + pos * 3600 AS ts FROM h, (SELECT unnest(range(0, 96)) AS pos))
SELECT g.location, g.horizon, g.pos, g.ts, CASE WHEN pos < 72 THEN round(coalesce(hs.value, 0) + 1.37e-8, 6) + 0.0 ELSE 0.0 END AS load, CASE WHEN pos < 72 AND hs.value IS NOT NULL THEN 1 ELSE 0 END AS load_mask,
round(coalesce(av.value, 0) + 1.37e-8, 6) + 0.0 AS weather, CASE WHEN av.value IS NULL THEN 0 ELSE 1 END AS weather_mask, pos >= 72 AS target
FROM g LEFT JOIN hs ON hs.location = g.location AND hs.ts = g.ts LEFT JOIN av ON av.location = g.location AND av.horizon = g.horizon AND av.ts = g.ts""")(
    lambda s, d: horizon_rows(wn.horizon_inputs(samples(s, d, step=3600), horizons(s, d), 4, 1, 3600, {"weather": versions(s, d)}))
)


def horizon_rows(w):
    """Horizon inputs as one row for each time."""
    rows = long(w, ["location", "horizon", "target_ts"], ts="ts", load="load", load_mask="load_mask", weather="weather", weather_mask="weather_mask")
    return rows.select("location", "horizon", "pos", "ts", r6(F.col("load")).alias("load"), "load_mask", r6(F.col("weather")).alias("weather"), "weather_mask", F.array_contains("target_ts", F.col("ts")).alias("target"))


# normalisation
STATS = "sx AS (SELECT location, window_start, avg(value) FILTER (xm = 1) AS mean, stddev_samp(value) FILTER (xm = 1) + 1.0 AS std FROM m GROUP BY 1, 2)"


def normed(s, d):
    return masked(s, d).withColumn("st", nm.statistics(F.col("values"), F.col("xm")))


query("h1_statistics", f"WITH {WIN}, {MASK}, {STATS} SELECT location, window_start, round(mean + 1.37e-8, 6) + 0.0 AS mean, round(std + 1.37e-8, 6) + 0.0 AS std FROM sx")(lambda s, d: normed(s, d).select(*KEYS, r6(F.col("st.mean")).alias("mean"), r6(F.col("st.std")).alias("std")))
_CL = "coalesce(CASE WHEN {v} IS NOT NULL THEN least(greatest({v}, -2.0), 2.0) END, 0.0)"
query("h2_normalised", f"WITH {WIN}, {MASK}, {STATS}, n AS (SELECT location, window_start, pos, CASE WHEN xm = 1 THEN (value - mean) / std ELSE value END AS x FROM m JOIN sx USING (location, window_start)) SELECT location, window_start, pos, round({_CL.format(v='x')} + 1.37e-7, 5) + 0.0 AS value FROM n")(
    lambda s, d: long(normed(s, d).withColumn("n", nm.normalised(F.col("values"), F.col("xm"), F.col("st"), 2.0)), KEYS, value="n").withColumn("value", r5(F.col("value")))
)
query("h3_normalised_target", f"WITH {WIN}, {MASK}, {STATS}, n AS (SELECT location, window_start, pos, CASE WHEN ym = 1 THEN (value - mean) / std ELSE value END AS x FROM m JOIN sx USING (location, window_start)) SELECT location, window_start, pos, round({_CL.format(v='x')} + 1.37e-7, 5) + 0.0 AS value FROM n")(
    lambda s, d: long(normed(s, d).withColumn("n", nm.normalised(F.col("values"), F.col("ym"), F.col("st"), 2.0)), KEYS, value="n").withColumn("value", r5(F.col("value")))
)
query("h4_restored", f"WITH {WIN}, {MASK}, {STATS} SELECT location, window_start, q AS pos, round((q - 1.37) * std + mean + 1.37e-7, 5) + 0.0 AS value FROM sx, (SELECT unnest(range(0, 3)) AS q)")(
    lambda s, d: long(normed(s, d).withColumn("q", nm.restored(F.array(*map(F.lit, (-1.37, 1 - 1.37, 2 - 1.37))), F.col("st"))), KEYS, value="q").withColumn("value", r5(F.col("value")))
)
query("h4_restored_mixture", f"WITH {WIN}, {MASK}, {STATS} SELECT location, window_start, round(2 * std + 1.37e-7, 5) + 0.0 AS sigma, round(std + mean + 1.37e-7, 5) + 0.0 AS mu FROM sx")(
    lambda s, d: normed(s, d).select(*KEYS, nm.restored_mixture(F.array(F.struct(F.lit(0.0).alias("logpi"), F.lit(2.0).alias("sigma"), F.lit(1.0).alias("mu"))), F.col("st"))[0].alias("c")).select(*KEYS, r5(F.col("c.sigma")).alias("sigma"), r5(F.col("c.mu")).alias("mu"))
)


# distributions
def mixtures(s, d):
    """A mixture of two normals from each order line, grouped by supplier."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("x"), F.min("l_tax").alias("t"))
    part = lambda w, sg, m: F.struct(F.log(w).alias("logpi"), sg.alias("sigma"), m.alias("mu"))
    q, x, t = F.col("q").cast("double"), F.col("x").cast("double"), F.col("t").cast("double")
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", F.array(part(0.2 + x * 5, 1 + t * 10, q), part(0.8 - x * 5, 0.5 + x * 10, q / 2 + 3)).alias("components"))


MIX = """mx AS (SELECT min(l_suppkey) AS l_suppkey, l_orderkey, l_linenumber, min(l_quantity)::DOUBLE AS q, min(l_discount)::DOUBLE AS x, min(l_tax)::DOUBLE AS t FROM lineitem GROUP BY 2, 3),
co AS (SELECT *, 0.2 + x * 5 AS w1, 1 + t * 10 AS s1, q AS m1, 0.8 - x * 5 AS w2, 0.5 + x * 10 AS s2, q / 2 + 3 AS m2 FROM mx),
bo AS (SELECT l_suppkey, min(least(m1 - 4 * s1, m2 - 4 * s2)) AS a, max(greatest(m1 + 4 * s1, m2 + 4 * s2)) AS b FROM co GROUP BY 1)"""
query("i1_bounds", f"WITH {MIX} SELECT l_suppkey, round(a - (b - a) * 0.2 + 1.37e-8, 6) + 0.0 AS low, round(b + (b - a) * 0.2 + 1.37e-8, 6) + 0.0 AS high FROM bo")(lambda s, d: ds.bounds(mixtures(s, d), ["l_suppkey"]).select("l_suppkey", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high")))
_PDF = " + ".join(f"(w{i} + 1e-6) / (w1 + w2 + 2e-6) * exp(-power((x0 - m{i} - 1e-6) / (s{i} + 1e-6), 2) / 2) / ((s{i} + 1e-6) * sqrt(2 * pi()))" for i in (1, 2))
query("i3_densities", f"""WITH {MIX}, g AS (SELECT co.*, pos, (a - (b - a) * 0.2) + ((b + (b - a) * 0.2) - (a - (b - a) * 0.2)) * pos / 9 AS x0 FROM co JOIN bo USING (l_suppkey), (SELECT unnest(range(0, 10)) AS pos))
SELECT l_orderkey, l_linenumber, pos::INTEGER AS pos, round(x0 + 1.37e-8, 6) + 0.0 AS x, round({_PDF} + 1.37e-8, 6) + 0.0 AS density FROM g""")(
    lambda s, d: ds.densities(mixtures(s, d), ["l_orderkey", "l_linenumber"], ["l_suppkey"], 10).select("l_orderkey", "l_linenumber", "pos", r6(F.col("x")).alias("x"), r6(F.col("density")).alias("density"))
)
#: Weights are multiples of 0.05: at such a level between components the last bit of a sum would decide.
LEVELS = [0.05, 0.49, 0.95]
_GRID = f"""g AS (SELECT co.*, a - (b - a) * 0.2 AS low, b + (b - a) * 0.2 AS high FROM co JOIN bo USING (l_suppkey))"""
_LEVEL = f"WITH RECURSIVE {MIX}, {_GRID}, {quantiles_sql('qu', 'g', 'l_orderkey, l_linenumber', LEVELS)} SELECT l_orderkey, l_linenumber, quantile, round(value + 1.37e-8, 6) + 0.0 AS value FROM qu"


def levels(s, d):
    return ds.quantiles(mixtures(s, d), ["l_orderkey", "l_linenumber"], ["l_suppkey"], LEVELS).withColumn("value", r6(F.col("value")))


query("i4_quantiles", _LEVEL)(levels)
query("i2_distributions", f"""WITH {MIX}, {_GRID}, x AS (SELECT *, low + (high - low) * pos / 9 AS x0 FROM g, (SELECT unnest(range(0, 10)) AS pos)), r AS ({reached_sql('x0', 'x')})
SELECT l_orderkey, l_linenumber, pos::INTEGER AS pos, round(x0 + 1.37e-8, 6) + 0.0 AS x, round(reached + 1.37e-8, 6) + 0.0 AS reached FROM r""")(
    lambda s, d: ds.distributions(mixtures(s, d), ["l_orderkey", "l_linenumber"], ["l_suppkey"], 10).withColumns({c: r6(F.col(c)) for c in ("x", "reached")})
)
query("i5_chosen", f"{_LEVEL} WHERE quantile = 0.49")(lambda s, d: ds.chosen(levels(s, d), [0.49]))
