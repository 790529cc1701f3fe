"""Registered queries of scores and forecast jobs. The forecast is the same time on the day before, spread by quantile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loadgrid.functions import scalars as fn
from loadgrid.operators import distributions as ds, forecast as fc, intervals as iv, places, resample as rs, scores as sc, windows as wn
from loadgrid.plans import series_queries as sq
from loadgrid.plans.inputs import EVENTS, SITES, STATIONS, quantiles_sql, samples_sql, samples, sites, stations, events
from loadgrid.plans.series_queries import r5, r6
from loadgrid.plans.window_queries import KEYS, MIX, WIN, long, masked, mixtures, read

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


LEVELS = [0.01, 0.25, 0.5, 0.75, 0.99]
SPREAD = 20.0


def truth(s, d):
    return samples(s, d)


def forecast(s, d):
    """Yesterday's value, moved by the distance of the level from a half."""
    rows = samples(s, d).select("location", (F.col("ts") + 86400).alias("ts"), F.col("value"))
    q = F.explode(F.array(*map(F.lit, LEVELS)))
    return rows.withColumn("quantile", q).withColumn("value", F.col("value") + (F.col("quantile") - 0.5) * SPREAD)


def limits(s, d):
    """A limit of each source, and which of its peaks matter."""
    at = F.col("location")
    sign = F.when(at == "click", "LDN").when(at == "view", "ODN").otherwise("BOTH")
    return truth(s, d).select("location").distinct().withColumns({"limit": F.when(at == "error", -1.0).otherwise(60.0), "sign": sign})


def pairs(s, d):
    p = sc.paired(forecast(s, d), truth(s, d), ["location"]).withColumn("run", F.floor(F.col("ts") / 86400))
    return sc.with_limits(p, limits(s, d))


P = f"""{EVENTS}, {samples_sql()}, qs AS (SELECT unnest({LEVELS}::DOUBLE[]) AS quantile),
p AS (SELECT t.location, t.ts, quantile, y.value + (quantile - 0.5) * {SPREAD} AS value, t.value AS truth, t.ts // 86400 AS run, CASE WHEN t.location = 'error' THEN -1.0::DOUBLE ELSE 60.0::DOUBLE END AS "limit"
FROM s t JOIN s y ON y.location = t.location AND y.ts + 86400 = t.ts CROSS JOIN qs)"""
PIN = "CASE WHEN truth >= value THEN quantile * (truth - value) ELSE (quantile - 1) * (truth - value) END"
query("j1_crps", f"WITH {P} SELECT location, round(2 * avg({PIN}) + 1.37e-8, 6) + 0.0 AS crps FROM p GROUP BY 1")(lambda s, d: sc.crps(pairs(s, d), ["location"]).withColumn("crps", r6(F.col("crps"))))
query("j2_mae", f"""WITH {P}, r AS (SELECT location, run, quantile, avg(abs(truth - value)) AS e, abs(quantile_cont(truth, 0.99) - quantile_cont(truth, 0.01)) AS w FROM p GROUP BY 1, 2, 3)
SELECT location, quantile, round(coalesce(avg(CASE WHEN w <> 0 THEN e / w END), 0) + 1.37e-8, 6) + 0.0 AS mae FROM r GROUP BY 1, 2""")(lambda s, d: sc.mae(pairs(s, d), ["location"]).withColumn("mae", r6(F.col("mae"))))
_X = "(CASE WHEN \"limit\" >= 0 THEN {c} > \"limit\" ELSE {c} <= \"limit\" END)"
EXC = f"""x AS (SELECT location, run, quantile, count(*) FILTER ({_X.format(c='truth')} AND {_X.format(c='value')}) AS hit, count(*) FILTER ({_X.format(c='value')}) AS said, count(*) FILTER ({_X.format(c='truth')}) AS is_real FROM p GROUP BY 1, 2, 3),
y AS (SELECT location, quantile, avg(CASE WHEN said > 0 THEN hit / said ELSE 0 END) AS pr, avg(CASE WHEN is_real > 0 THEN hit / is_real ELSE 0 END) AS re FROM x GROUP BY 1, 2)"""
query("j3_precision", f"WITH {P}, {EXC} SELECT location, quantile, round(pr + 1.37e-8, 6) + 0.0 AS precision FROM y")(lambda s, d: sc.exceedance(pairs(s, d), ["location"]).select("location", "quantile", r6(F.col("precision")).alias("precision")))
query("j4_recall", f"WITH {P}, {EXC} SELECT location, quantile, round(re + 1.37e-8, 6) + 0.0 AS recall FROM y")(lambda s, d: sc.exceedance(pairs(s, d), ["location"]).select("location", "quantile", r6(F.col("recall")).alias("recall")))
query("j5_fbeta", f"WITH {P}, {EXC} SELECT location, quantile, round(CASE WHEN pr + re > 0 THEN 101 * re * pr / (100 * pr + re) ELSE 0 END + 1.37e-8, 6) + 0.0 AS fbeta FROM y")(
    lambda s, d: sc.exceedance(pairs(s, d), ["location"]).select("location", "quantile", r6(F.col("fbeta")).alias("fbeta"))
)


def placed(s, d, level):
    p = rs.numbered(pairs(s, d).where(F.col("quantile") == level), ["location"])
    return p.select("location", "pos", "value"), p.select("location", "pos", F.col("truth").alias("value"))


for _name, _level, _low in (("j6_ldn_mape", 0.99, False), ("j7_odn_mape", 0.01, True)):
    _f = "min" if _low else "max"
    query(_name, f"""WITH {P}, o AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ts) - 1 AS pos FROM p WHERE quantile = {_level}),
m AS (SELECT location, pos // 30 AS k, {_f}(value) AS pred, {_f}(truth) AS gt FROM o GROUP BY 1, 2 HAVING count(*) = 30)
SELECT location, round(avg(CASE WHEN gt <> 0 THEN abs(gt - pred) / gt END) + 1.37e-8, 6) + 0.0 AS mape FROM m WHERE location <> '{"click" if _low else "view"}' GROUP BY 1""")(
        lambda s, d, level=_level, low=_low: sc.for_sign(sc.monthly_mape(*placed(s, d, level), ["location"], 30, 30, low), limits(s, d), low).withColumn("mape", r6(F.col("mape")))
    )


def report(s, d):
    """Enabled and valid scores as (iteration, location, metric, quantile, value)."""
    names = sc.valid_metrics(True, True, 1, dict.fromkeys(sc.ALL, True))
    p = pairs(s, d)
    parts = []
    if "crps" in names:
        parts.append(sc.crps(p, ["location"]).select("location", F.lit("crps").alias("metric"), F.lit(None).cast("double").alias("quantile"), F.col("crps").alias("value")))
    if "mae" in names:
        parts.append(sc.mae(p, ["location"]).select("location", F.lit("mae").alias("metric"), "quantile", F.col("mae").alias("value")))
    if "recall" in names:
        parts.append(sc.exceedance(p, ["location"]).select("location", F.lit("recall").alias("metric"), "quantile", F.col("recall").alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumn("iteration", F.lit(1)).withColumn("value", r6(F.col("value")))


REPORT = f"""{P}, {EXC}, mr AS (SELECT location, run, quantile, avg(abs(truth - value)) AS e, abs(quantile_cont(truth, 0.99) - quantile_cont(truth, 0.01)) AS w FROM p GROUP BY 1, 2, 3),
re AS (SELECT 1 AS iteration, location, 'crps' AS metric, NULL::DOUBLE AS quantile, round(2 * avg({PIN}) + 1.37e-8, 6) + 0.0 AS value FROM p GROUP BY location
UNION ALL SELECT 1, location, 'mae', quantile, round(coalesce(avg(CASE WHEN w <> 0 THEN e / w END), 0) + 1.37e-8, 6) + 0.0 FROM mr GROUP BY location, quantile
UNION ALL SELECT 1, location, 'recall', quantile, round(re + 1.37e-8, 6) + 0.0 FROM y)"""
query("j8_valid_metrics", f"WITH {REPORT} SELECT * FROM re")(report)
query("j9_pinball_loss", f"WITH {P} SELECT location, round(avg(l) + 1.37e-8, 6) + 0.0 AS loss FROM (SELECT location, quantile, avg({PIN}) AS l FROM p WHERE ts % 1800 = 0 GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: sc.pinball_loss(pairs(s, d).withColumn("mask", (F.col("ts") % 1800 == 0).cast("int")), ["location"]).withColumn("loss", r6(F.col("loss")))
)
_T = "(-ln(greatest(s{i} * s{i}, 1e-6)) / 2 - power({y} - m{i}, 2) / greatest(s{i} * s{i}, 1e-6) / 2 + ln(w{i}))"
_NLL = "-ln(exp({a}) + exp({b}))"


def _nll(y):
    return _NLL.format(a=_T.format(i=1, y=y), b=_T.format(i=2, y=y))


query("j10_mixture_loss", f"WITH {MIX} SELECT l_suppkey, round((sum({_nll('(q + 1)')}) + sum(CASE WHEN l_orderkey % 20 = 0 THEN {_nll('(q - 2)')} ELSE 0 END)) / (count(*) + count(*) FILTER (l_orderkey % 20 = 0)) + 0.1 * sum(s1 * s1 + s2 * s2) / (2 * count(*)) + 1.37e-7, 5) + 0.0 AS loss FROM co GROUP BY 1")(
    lambda s, d: sc.mixture_loss(mixtures(s, d).withColumn("targets", F.array(F.col("components")[0]["mu"] + 1, F.col("components")[0]["mu"] - 2)).withColumn("masks", F.array(F.lit(1), (F.col("l_orderkey") % 20 == 0).cast("int"))), ["l_suppkey"], 0.1).withColumn("loss", r5(F.col("loss")))
)
query("j11_weighted_loss", f"""WITH {P}, n AS (SELECT location, avg(power(truth - value, 2)) AS m, avg({PIN}) AS k FROM p GROUP BY 1) SELECT location, round(2 * m / (1 + 0.01 * m) + 0.5 * k + 1.37e-8, 6) + 0.0 AS loss FROM n""")(
    lambda s, d: (lambda n: sc.weighted_loss(
        n.select("location", F.lit("mse").alias("name"), sc.soft_clip(F.col("m"), 0.01).alias("loss")).unionByName(n.select("location", F.lit("pinball").alias("name"), F.col("k").alias("loss"))).unionByName(n.select("location", F.lit("other").alias("name"), F.col("k").alias("loss"))),
        {"mse": 2.0, "pinball": 0.5}, ["location"],
    ))(pairs(s, d).groupBy("location").agg(F.avg(sc.mse(F.col("truth"), F.col("value"))).alias("m"), F.avg(sc.pinball(F.col("quantile"), F.col("truth"), F.col("value"))).alias("k"))).withColumn("loss", r6(F.col("loss")))
)
query("j12_last_days", f"WITH {WIN} SELECT location, window_start, pos, round(value + 1.37e-8, 6) + 0.0 AS value FROM v WHERE pos >= 96")(lambda s, d: sc.last_days(long(read(s, d), KEYS, value="values"), 192, 96).withColumn("value", r6(F.col("value"))))
query("j13_with_limits", f"""WITH {P} SELECT location, ts, quantile, "limit", CASE location WHEN 'click' THEN 'LDN' WHEN 'view' THEN 'ODN' ELSE 'BOTH' END AS sign FROM p""")(lambda s, d: pairs(s, d).select("location", "ts", "quantile", "limit", "sign"))
_NAMES = ["crps", *(f"mae_{q}" for q in LEVELS), *(f"recall_{q}" for q in LEVELS)]
_PIV = ", ".join(["max(value) FILTER (metric = 'crps') AS crps"] + [f"max(value) FILTER (metric = '{m}' AND quantile = {q}) AS \"{m}_{q}\"" for m in ("mae", "recall") for q in LEVELS])
query("j14_wide_report", f"WITH {REPORT} SELECT iteration, location, {_PIV} FROM re GROUP BY 1, 2")(lambda s, d: sc.to_wide(report(s, d), ["iteration", "location"], _NAMES))
query("j14_long_report", f"WITH {REPORT} SELECT * FROM re")(lambda s, d: sc.to_long(sc.to_wide(report(s, d), ["iteration", "location"], _NAMES), ["iteration", "location"], _NAMES))
query("e8_summary", f"""WITH {REPORT} SELECT 'all' AS "group", quantile, metric, round(avg(value) + 1.37e-8, 6) + 0.0 AS value FROM re WHERE metric IN ('mae', 'recall') GROUP BY 2, 3""")(
    lambda s, d: sc.summary(report(s, d).withColumn("group", F.lit("all")).withColumn("availability", F.lit("D-1")), ["mae", "recall"], "D-1").withColumn("value", r6(F.col("value")))
)
query("e9_mean_absolute", f"WITH {REPORT} SELECT round(avg(abs(value)) + 1.37e-8, 6) + 0.0 AS value FROM re WHERE metric = 'crps'")(lambda s, d: sc.mean_absolute(report(s, d), "crps").withColumn("value", r6(F.col("value"))))
query("b18_symmetric_bands", f"""WITH {P}, lo AS (SELECT location, ts, quantile AS low, round(1 - quantile, 6) AS high, value AS lower FROM p WHERE quantile < 0.5), hi AS (SELECT location, ts, round(quantile, 6) AS high, value AS upper FROM p WHERE quantile > 0.5)
SELECT location, ts, low, high, round(lower + 1.37e-8, 6) + 0.0 AS lower, round(upper + 1.37e-8, 6) + 0.0 AS upper FROM lo JOIN hi USING (location, ts, high)""")(
    lambda s, d: fn.symmetric_bands(pairs(s, d), ["location", "ts"]).withColumns({"lower": r6(F.col("lower")), "upper": r6(F.col("upper"))})
)

# forecast jobs
query("k1_inference_frame", f"""WITH {EVENTS}, {samples_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ts DESC) AS n FROM s)
SELECT location, ts, round(value + 1.37e-8, 6) + 0.0 AS value FROM n WHERE n <= 20 UNION ALL SELECT location, m + 900 * k, NULL FROM (SELECT location, max(ts) AS m FROM s GROUP BY 1), (SELECT unnest(range(1, 9)) AS k)""")(
    lambda s, d: fc.inference_frame(samples(s, d), 20, 8, 900, ["value"]).withColumn("value", r6(F.col("value")))
)
query("k2_inference_mask", f"WITH {WIN} SELECT location, window_start, pos, CASE WHEN value IS NULL OR pos >= 150 THEN 0 ELSE 1 END AS mask FROM v")(
    lambda s, d: long(read(s, d), KEYS, value="values").select(*KEYS, "pos", fc.inference_mask(F.col("value"), F.col("pos"), 150).alias("mask"))
)


def spread_day(x: np.ndarray, xm: np.ndarray) -> np.ndarray:
    """The unmasked values of the last hidden part's day before, at three levels."""
    seen = np.where(xm > 0, np.nan_to_num(x), 0.0)
    return seen[:, -144:-96, None] + np.array([-10.0, 0.0, 10.0])


def scored(s, d):
    return fc.predicted(masked(s, d), spread_day, KEYS, "values", "xm", 3)


K3 = f"k AS (SELECT location, window_start, pos - 48 AS pos, CASE WHEN value IS NULL THEN 0 ELSE value END AS value FROM v WHERE pos >= 48 AND pos < 96)"
query("k3_predicted", f"WITH {WIN}, {K3} SELECT location, window_start, pos, i AS q, round(value + (i - 1) * 10 + 1.37e-8, 6) + 0.0 AS value FROM k, (SELECT unnest(range(0, 3)) AS i)")(
    lambda s, d: scored(s, d).select(*KEYS, "pos", F.posexplode("values").alias("q", "value")).withColumn("q", F.col("q").cast("long")).withColumn("value", r6(F.col("value")))
)
query("k4_timed", f"WITH {WIN}, {K3} SELECT location, window_start + 129600 + pos * 900 AS ts, [0.1, 0.5, 0.9][i + 1]::DOUBLE AS quantile, round(value + (i - 1) * 10 + 1.37e-8, 6) + 0.0 AS value FROM k, (SELECT unnest(range(0, 3)) AS i)")(
    lambda s, d: fc.timed(scored(s, d).withColumn("forecast_start", F.col("window_start") + 129600), ["location"], [0.1, 0.5, 0.9], 900).withColumn("value", r6(F.col("value")))
)


def backtest(s, d):
    """Windows, predictions and scores of all locations in one job."""
    fore = fc.timed(scored(s, d).withColumn("forecast_start", F.col("window_start") + 129600), KEYS, [0.1, 0.5, 0.9], 900)
    p = sc.paired(fore, samples(s, d), ["location"]).withColumn("run", F.col("window_start"))
    return sc.crps(p, ["location"]).join(sc.mae(p, ["location"]).where("quantile = 0.5").select("location", "mae"), "location").withColumns({"crps": r6(F.col("crps")), "mae": r6(F.col("mae"))})


query("k5_backtest", f"""WITH {WIN}, {K3}, f AS (SELECT location, window_start, window_start + 129600 + pos * 900 AS ts, [0.1, 0.5, 0.9][i + 1]::DOUBLE AS quantile, value + (i - 1) * 10 AS value FROM k, (SELECT unnest(range(0, 3)) AS i)),
p AS (SELECT f.*, s.value AS truth FROM f JOIN s ON s.location = f.location AND s.ts = f.ts),
m AS (SELECT location, window_start, avg(abs(truth - value)) AS e, abs(quantile_cont(truth, 0.99) - quantile_cont(truth, 0.01)) AS w FROM p WHERE quantile = 0.5 GROUP BY 1, 2)
SELECT c.location, c.crps, n.mae FROM (SELECT location, round(2 * avg({PIN}) + 1.37e-8, 6) + 0.0 AS crps FROM p GROUP BY 1) c JOIN (SELECT location, round(coalesce(avg(CASE WHEN w <> 0 THEN e / w END), 0) + 1.37e-8, 6) + 0.0 AS mae FROM m GROUP BY 1) n USING (location)""")(backtest)


def backtest_mixtures(s, d):
    """As k5_backtest, the predictor giving a mixture of two normals around the day before."""

    def around(x, xm):
        mu = spread_day(x, xm)[:, :, 1]
        one = np.ones_like(mu)
        return np.stack([np.log(0.7) * one, 5 * one, mu, np.log(0.3) * one, 20 * one, mu + 10], -1)

    given = fc.mixtures(fc.predicted(masked(s, d), around, KEYS, "values", "xm", 6))
    levels = ds.quantiles(given.withColumn("ts", F.col("window_start") + 129600 + F.col("pos") * 900), [*KEYS, "ts"], KEYS, [0.1, 0.5, 0.9])
    p = sc.paired(levels, samples(s, d), ["location"]).withColumn("run", F.col("window_start"))
    return sc.crps(p, ["location"]).join(sc.mae(p, ["location"]).where("quantile = 0.5").select("location", "mae"), "location").withColumns({"crps": r6(F.col("crps")), "mae": r6(F.col("mae"))})


query("k5_backtest_mixtures", f"""WITH RECURSIVE {WIN}, {K3}, c AS (SELECT *, 0.7 AS w1, 5.0 AS s1, value AS m1, 0.3 AS w2, 20.0 AS s2, value + 10 AS m2 FROM k),
bo AS (SELECT location, window_start, min(least(m1 - 20, m2 - 80)) AS a, max(greatest(m1 + 20, m2 + 80)) AS b FROM c GROUP BY 1, 2),
g AS (SELECT c.location, c.window_start, pos, w1::DOUBLE AS w1, s1::DOUBLE AS s1, m1, w2::DOUBLE AS w2, s2::DOUBLE AS s2, m2, a - (b - a) * 0.2 AS low, b + (b - a) * 0.2 AS high FROM c JOIN bo ON bo.location = c.location AND bo.window_start = c.window_start),
{quantiles_sql('qu', 'g', 'location, window_start, pos', [0.1, 0.5, 0.9])},
p AS (SELECT f.location, f.window_start, f.quantile, f.value, s.value AS truth FROM qu f JOIN s ON s.location = f.location AND s.ts = f.window_start + 129600 + f.pos * 900),
m AS (SELECT location, window_start, avg(abs(truth - value)) AS e, abs(quantile_cont(truth, 0.99) - quantile_cont(truth, 0.01)) AS w FROM p WHERE quantile = 0.5 GROUP BY 1, 2)
SELECT c.location, c.crps, n.mae FROM (SELECT location, round(2 * avg({PIN}) + 1.37e-8, 6) + 0.0 AS crps FROM p GROUP BY 1) c JOIN (SELECT location, round(coalesce(avg(CASE WHEN w <> 0 THEN e / w END), 0) + 1.37e-8, 6) + 0.0 AS mae FROM m GROUP BY 1) n USING (location)""")(backtest_mixtures)


def explored(s, d):
    """The busiest user's hourly mean next to the scaled hourly series of the nearest weather point."""
    sp = sq.spans(s, d, "user_id")
    top = rs.most_samples(sp, "location")
    mine = sp.join(F.broadcast(top.select("location")), "location")
    power = rs.downsample(mine, 3600, ["location"]).where("value IS NOT NULL").groupBy("location", "ts").agg(F.avg("value").alias("power"))
    near = places.nearest(sites(s, d).withColumn("location_id", F.col("location_id")), stations(s, d)).select(F.col("location_id").alias("site"), "weather_id")
    linked = power.withColumn("site", F.col("location") % 100).join(near, "site")
    e = events(s, d)
    weather = e.groupBy((F.col("user_id") % 25).alias("weather_id"), (F.col("t") - F.col("t") % 3600).alias("ts")).agg(F.avg("value").alias("w"))
    scaled = rs.unit_scale(weather, ["weather_id"], "w")
    return linked.join(scaled, ["weather_id", "ts"]).select("location", "ts", r6(F.col("power")).alias("power"), r6(F.col("w")).alias("weather"))


query("k6_explored", f"""WITH {EVENTS}, {samples_sql('user_id')}, {SITES}, {STATIONS},
sr AS (SELECT *, sum(CASE WHEN ts - p = 900 THEN 0 ELSE 1 END) OVER (PARTITION BY location ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY location ORDER BY ts) AS p FROM s)),
top AS (SELECT location FROM s GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 1),
pw AS (SELECT location, ts, avg(value) AS power FROM (SELECT location, run, ts - ts % 3600 AS ts, avg(value) AS value FROM sr WHERE location IN (SELECT location FROM top) GROUP BY 1, 2, 3) GROUP BY 1, 2),
n AS (SELECT location_id, arg_min(weather_id, (round(sqrt((lat - w_lat) * (lat - w_lat) + (lon - w_lon) * (lon - w_lon)), 9), weather_id)) AS weather_id FROM si CROSS JOIN st GROUP BY 1),
w AS (SELECT user_id % 25 AS weather_id, t - t % 3600 AS ts, avg(value) AS w FROM e GROUP BY 1, 2),
sw AS (SELECT weather_id, ts, (w - min(w) OVER x) / (max(w) OVER x - min(w) OVER x) AS w FROM w WINDOW x AS (PARTITION BY weather_id))
SELECT pw.location, pw.ts, round(power + 1.37e-8, 6) + 0.0 AS power, round(w + 1.37e-8, 6) + 0.0 AS weather FROM pw JOIN n ON n.location_id = pw.location % 100 JOIN sw ON sw.weather_id = n.weather_id AND sw.ts = pw.ts""")(explored)
query("k7_fetched_spans", f"WITH {EVENTS} SELECT user_id % 25 AS location_id, min(t - t % 3600) AS start_time, 3600 AS sample_interval_s, ((max(t) - min(t)) // 3600 + 24)::BIGINT AS num_values FROM e GROUP BY 1")(
    lambda s, d: (lambda e: fc.fetched_spans(
        e.join(e.groupBy("location_id").agg(F.floor((F.max("t") - F.min("t")) / 3600).alias("hours")), "location_id").select("location_id", (F.col("t") - F.col("t") % 3600).alias("ts"), "hours"), F.col("hours")
    ))(events(s, d).withColumn("location_id", F.col("user_id") % 25))
)
