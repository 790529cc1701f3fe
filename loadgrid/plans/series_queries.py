"""Registered queries of scalar functions, resampling, pooling and places."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loadgrid.functions import scalars as fn
from loadgrid.operators import intervals as iv, places, resample as rs
from loadgrid.plans.inputs import EVENTS, SITES, STATIONS, STEP, events, samples, samples_sql, sites, stations, sweep, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r6(c):
    """c to six digits. Means of a few decimals often end in a five there, so all are moved off such ties, in SQL too."""
    return F.round(c + 1.37e-8, 6) + 0.0  # no negative zero


def r5(c):
    return F.round(c + 1.37e-7, 5) + 0.0


# scalar functions
query("b1_unix_time", f"WITH {EVENTS} SELECT event_id, t, t - t % 86400 AS day_start FROM e")(
    lambda s, d: events(s, d).select("event_id", "t", fn.to_unix(F.date_trunc("day", fn.from_unix(F.col("t")))).alias("day_start"))
)
HEX = "sha256(n)"
_ID = f"(('0x' || substr({HEX}, 7, 2) || substr({HEX}, 5, 2) || substr({HEX}, 3, 2) || substr({HEX}, 1, 2))::BIGINT & 2147483647)"
query("b2_location_id", f"SELECT n AS name, {_ID} AS location_id FROM (SELECT s_name AS n FROM supplier UNION SELECT c_name FROM customer)")(
    lambda s, d: fn.name_ids(table(s, d, "supplier").select(F.col("s_name").alias("name")).unionByName(table(s, d, "customer").select(F.col("c_name").alias("name"))))
)
query("b3_pack", f"WITH {EVENTS} SELECT event_id, user_id * 4294967296 + t AS key, user_id AS location, t FROM e")(
    lambda s, d: events(s, d).select("event_id", fn.pack(F.col("user_id"), F.col("t")).alias("key")).select("event_id", "key", fn.packed_location(F.col("key")).alias("location"), fn.packed_time(F.col("key")).alias("t"))
)
query("b5_sensor_unit", "SELECT o_orderkey, CASE WHEN upper(trim(u)) IN ('P', 'I', 'X') THEN upper(trim(u)) ELSE 'X' END AS unit FROM (SELECT o_orderkey, ' ' || lower(o_orderstatus) || ' ' AS u FROM orders)")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", fn.sensor_unit(F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" "))).alias("unit"))
)
_MT = "CASE c_mktsegment WHEN 'BUILDING' THEN ' Native-Aggregate' WHEN 'MACHINERY' THEN 'pseudo aggregate' ELSE c_mktsegment END"


def raw_types(s, d):
    seg = F.col("c_mktsegment")
    raw = F.when(seg == "BUILDING", " Native-Aggregate").when(seg == "MACHINERY", "pseudo aggregate").otherwise(seg)
    return table(s, d, "customer").select("c_custkey", "c_name", fn.measurement_type(raw, F.col("c_nationkey") % 5 == 0, F.when(F.col("c_nationkey") % 3 == 0, F.lit(None).cast("boolean")).otherwise(False)).alias("kind"))


_KIND = f"""k AS (SELECT c_custkey, c_name, CASE WHEN v IN ('pseudo_aggregate', 'native_aggregate') THEN v WHEN c_nationkey % 5 = 0 THEN 'native_aggregate' ELSE 'pseudo_aggregate' END AS kind
FROM (SELECT *, replace(replace(lower(trim({_MT})), '-', '_'), ' ', '_') AS v FROM customer))"""
query("b6_measurement_type", f"WITH {_KIND} SELECT c_custkey, kind FROM k")(lambda s, d: raw_types(s, d).select("c_custkey", "kind"))
query("b7_public_name", f"""WITH {_KIND} SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'native_aggregate_' || c_custkey ELSE kind || '_' || CASE WHEN c_custkey < 100000 THEN lpad(c_custkey::VARCHAR, 5, '0') ELSE c_custkey::VARCHAR END END AS name FROM k""")(
    lambda s, d: raw_types(s, d).select("c_custkey", fn.public_name(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit(" native_aggregate_"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name")), F.col("kind"), F.col("c_custkey")).alias("name"))
)
query("b8_tolerant_cast", "SELECT o_orderkey, try_cast(v AS DOUBLE) AS number FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_custkey::VARCHAR END AS v FROM orders)")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", fn.tolerant(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")), "double").alias("number"))
)
_D, _Y = 86400.0, 365.25 * 86400


def _cyc(n, p):
    return f"round(sin(2 * pi() * (t % {p:.1f}) / {p:.1f}) + 1.37e-8, 6) + 0.0 AS sin_{n}, round(cos(2 * pi() * (t % {p:.1f}) / {p:.1f}) + 1.37e-8, 6) + 0.0 AS cos_{n}"


query("b11_time_features", f"""WITH {EVENTS} SELECT event_id, {_cyc('day', _D)}, {_cyc('weeks', 21 * _D)}, {_cyc('year', _Y)},
round(tanh(((t - 1325376000.0) / {_Y} - 6.5) / 6.5) + 1.37e-8, 6) + 0.0 AS trend FROM (SELECT event_id, t::DOUBLE AS t FROM e)""")(
    lambda s, d: (lambda f: f.select("event_id", *(r6(F.col(c)).alias(c) for c in f.columns if c != "event_id")))(events(s, d).select("event_id", *fn.time_features(F.col("t"))))
)
query("b12_centred", f"WITH {SITES} SELECT location_id, round(lat - 52.15 + 1.37e-8, 6) + 0.0 AS lat, round(lon - 5.25 + 1.37e-8, 6) + 0.0 AS lon FROM si")(
    lambda s, d: sites(s, d).select("location_id", *(r6(c).alias(n) for c, n in zip(fn.centred(F.col("lat"), F.col("lon")), ("lat", "lon"), strict=True)))
)


def window_features(s, d):
    """(unix time, lat, lon) at each hour of a day from a site's first morning."""
    from loadgrid.operators import windows as wn

    starts = sites(s, d).select("location_id", "lat", "lon", (F.lit(1704067200) + F.col("location_id") % 7 * 86400).alias("window_start"))
    return wn.time_source(starts, 86400, 3600)


query("b13_time_source", f"WITH {SITES} SELECT location_id, window_start, pos::BIGINT AS pos, window_start + pos * 3600 AS unixtime, lat AS latitude, lon AS longitude FROM (SELECT *, 1704067200 + location_id % 7 * 86400 AS window_start, unnest(range(0, 24)) AS pos FROM si)")(window_features)
query("b14_coordinate_key", f"WITH {SITES} SELECT lat, lon, count(*) AS n FROM (SELECT round(lat, 6) AS lat, round(lon, 6) AS lon FROM si) GROUP BY 1, 2")(
    lambda s, d: sites(s, d).groupBy(fn.coordinate_key(F.col("lat"), F.col("lon")).alias("k")).agg(F.count("*").alias("n")).select("k.lat", "k.lon", "n")
)
_GC = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin((radians(w_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(w_lat)) * power(sin((radians(w_lon) - radians(lon)) / 2), 2))))"
_PL = "sqrt((lat - w_lat) * (lat - w_lat) + (lon - w_lon) * (lon - w_lon)) * 111.0"
query("b15_great_circle", f"WITH {SITES}, {STATIONS} SELECT location_id, weather_id, round({_GC} + 1.37e-8, 6) + 0.0 AS km FROM si JOIN st ON s_nationkey = weather_id")(
    lambda s, d: sites(s, d).join(stations(s, d), F.col("s_nationkey") == F.col("weather_id")).select("location_id", "weather_id", r6(fn.great_circle_km(*map(F.col, ("lat", "lon", "w_lat", "w_lon")))).alias("km"))
)
query("b16_planar", f"WITH {SITES}, {STATIONS} SELECT location_id, weather_id, round({_PL} + 1.37e-8, 6) + 0.0 AS km FROM si JOIN st ON s_nationkey = weather_id")(
    lambda s, d: sites(s, d).join(stations(s, d), F.col("s_nationkey") == F.col("weather_id")).select("location_id", "weather_id", r6(fn.planar_km(*map(F.col, ("lat", "lon", "w_lat", "w_lon")))).alias("km"))
)
_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("b17_feature_names", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *fn.feature_names(_LINE_FEATURES, ["l_quantity", "l_extendedprice", "l_tax"], target="l_quantity"))
)

# nearest points and links
_NEAR = f"SELECT location_id, (arg_min(weather_id, (round({_PL}, 9), weather_id)))::BIGINT AS weather_id, round(min({_PL}) + 1.37e-8, 6) + 0.0 AS km FROM si CROSS JOIN st GROUP BY 1"
query("d5_nearest", f"WITH {SITES}, {STATIONS} {_NEAR}")(lambda s, d: places.nearest(sites(s, d), stations(s, d)).withColumn("km", r6(F.col("km"))))
query("d5_nearest_or_first", f"WITH {SITES}, {STATIONS}, n AS ({_NEAR}) SELECT c_custkey AS location_id, coalesce(n.weather_id, (SELECT weather_id FROM n ORDER BY location_id LIMIT 1)) AS weather_id FROM customer LEFT JOIN n ON n.location_id = c_custkey")(
    lambda s, d: places.nearest_or_first(sites(s, d), stations(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("location_id")))
)


def stated(s, d):
    k = F.col("location_id")
    moved = sites(s, d).withColumn("stated_id", F.when(k % 5 == 0, (k % 40).cast("long")))
    at = stations(s, d).select(F.col("weather_id").alias("__w"), "w_lat", "w_lon")
    joined = moved.join(at, (k % 5 == 1) & (F.col("s_nationkey") == F.col("__w")), "left")
    return joined.select("location_id", F.coalesce("w_lat", "lat").alias("lat"), F.coalesce("w_lon", "lon").alias("lon"), "stated_id")


query("d4_link_weather", f"""WITH {SITES}, {STATIONS},
l AS (SELECT location_id, coalesce(w_lat, lat) AS lat, coalesce(w_lon, lon) AS lon, CASE WHEN location_id % 5 = 0 THEN location_id % 40 END AS stated_id FROM si LEFT JOIN st ON location_id % 5 = 1 AND s_nationkey = weather_id),
x AS (SELECT round(w_lat, 6) AS a, round(w_lon, 6) AS o, min(weather_id) AS exact_id FROM st GROUP BY 1, 2 HAVING count(*) = 1),
n AS (SELECT location_id, arg_min(weather_id, (round({_GC}, 9), weather_id)) AS near_id FROM l CROSS JOIN st GROUP BY 1)
SELECT l.location_id, CASE WHEN stated_id IS NOT NULL THEN CASE WHEN stated_id IN (SELECT weather_id FROM st) THEN stated_id END ELSE coalesce(exact_id, near_id) END AS weather_id,
       CASE WHEN stated_id IS NOT NULL THEN CASE WHEN stated_id IN (SELECT weather_id FROM st) THEN 'stated' ELSE 'invalid' END WHEN exact_id IS NOT NULL THEN 'exact' ELSE 'nearest' END AS method
FROM l LEFT JOIN x ON round(l.lat, 6) = a AND round(l.lon, 6) = o JOIN n ON n.location_id = l.location_id""")(lambda s, d: places.link_weather(stated(s, d), stations(s, d)))
query("d1_with_location", f"""WITH {EVENTS}, {SITES} SELECT event_id, location_id, name, lat, lon FROM e JOIN si ON user_id = location_id""")(
    lambda s, d: places.with_location(events(s, d).select("event_id", F.col("user_id").alias("location_id")), sites(s, d).select("location_id", "name", "lat", "lon"))
)
query("d2_with_weather", f"""WITH {SITES}, {STATIONS} SELECT s_nationkey::BIGINT AS weather_location_id, location_id, w_lat, w_lon FROM si JOIN st ON s_nationkey = weather_id""")(
    lambda s, d: places.with_weather(sites(s, d).select("location_id", F.col("s_nationkey").cast("long").alias("weather_location_id")), stations(s, d).withColumnRenamed("weather_id", "weather_location_id"))
)
query("e4_first_seen_ids", f"""WITH {SITES} SELECT lat, lon, 999999 + row_number() OVER (ORDER BY m, lat, lon) AS weather_id FROM (SELECT lat, lon, min(location_id) AS m FROM si GROUP BY 1, 2)""")(
    lambda s, d: places.first_seen_ids(sites(s, d), "location_id")
)
query("e5_grid_cells", f"""WITH {SITES} SELECT round(c1 * 0.25 + 1.37e-8, 6) + 0.0 AS cell_lat, round(c2 * 0.25 + 1.37e-8, 6) + 0.0 AS cell_lon, list_aggregate(list_sort(list(location_id)), 'string_agg', ',') AS ids,
list_aggregate(list_sort(list_distinct(list(name))), 'string_agg', ',') AS names, round(avg(lat) + 1.37e-8, 6) + 0.0 AS lat, round(avg(lon) + 1.37e-8, 6) + 0.0 AS lon, count(*) AS n FROM (SELECT *, round_even(lat / 0.25, 0) AS c1, round_even(lon / 0.25, 0) AS c2 FROM si) GROUP BY c1, c2""")(
    lambda s, d: places.grid_cells(sites(s, d)).select(r6(F.col("cell_lat")).alias("cell_lat"), r6(F.col("cell_lon")).alias("cell_lon"), F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), F.concat_ws(",", "names").alias("names"), r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "n")
)

# spans and resampling
S = samples_sql()
SPANS = f"""{EVENTS}, {S}, sr AS (SELECT *, sum(CASE WHEN ts - p = {STEP} THEN 0 ELSE 1 END) OVER (PARTITION BY location ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY location ORDER BY ts) AS p FROM s)),
sp AS (SELECT location, min(ts) AS start_time, count(*) AS num_values, list(value ORDER BY ts) AS v FROM sr GROUP BY location, run),
q AS (SELECT location, ts, value, min(ts) OVER (PARTITION BY location, run) AS span FROM sr)"""


def spans(s, d, key="event_type"):
    return rs.to_spans(samples(s, d, key), STEP, ["location"])


query("a3_to_spans", f"WITH {SPANS} SELECT location, start_time, {STEP} AS sample_interval_s, num_values, round(list_sum(v), 4) AS total, round(v[1] + 1.37e-8, 6) + 0.0 AS first_value FROM sp")(
    lambda s, d: spans(s, d).select("location", "start_time", "sample_interval_s", "num_values", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), r6(F.col("values")[0]).alias("first_value"))
)
query("f1_to_samples", f"WITH {SPANS} SELECT location, ts, round(value + 1.37e-8, 6) + 0.0 AS value FROM q")(lambda s, d: rs.to_samples(spans(s, d), ["location"]).withColumn("value", r6(F.col("value"))))
LOW, HIGH = 1704500000, 1705500000
query("f2_downsample", f"""WITH {SPANS}, k AS (SELECT location, span, ts - ts % 3600 AS ts, avg(value) AS value FROM q WHERE ts >= {LOW} AND ts < {HIGH} GROUP BY 1, 2, 3),
g AS (SELECT location, span, unnest(range(a, b + 1, 3600)) AS ts FROM (SELECT location, span, min(ts) AS a, max(ts) + 3600 AS b FROM k GROUP BY 1, 2))
SELECT g.location, g.span, g.ts, round(k.value + 1.37e-8, 6) + 0.0 AS value FROM g LEFT JOIN k ON k.location = g.location AND k.span = g.span AND k.ts = g.ts""")(
    lambda s, d: rs.downsample(spans(s, d), 3600, ["location"], LOW, HIGH, separators=True).withColumn("value", r6(F.col("value")))
)
query("f3_upsample", f"""WITH {SPANS}, h AS (SELECT location, span, unnest(range(min(ts), max(ts) + 1, 300)) AS ts FROM q GROUP BY location, span),
n AS (SELECT h.location, h.span, h.ts, h.ts - (h.ts - h.span) % {STEP} AS a FROM h)
SELECT n.location, n.span, n.ts, round(x.value + CASE WHEN y.value IS NULL THEN 0 ELSE (y.value - x.value) * (n.ts - n.a) / {STEP}.0 END + 1.37e-8, 6) + 0.0 AS value
FROM n JOIN q x ON x.location = n.location AND x.ts = n.a LEFT JOIN q y ON y.location = n.location AND y.span = n.span AND y.ts = n.a + {STEP}""")(
    lambda s, d: rs.upsample(spans(s, d), 300, ["location"]).withColumn("value", r6(F.col("value")))
)
query("f4_stretch", f"""WITH {SPANS}, g AS (SELECT location, start_time, v, unnest(range(0, 24)) AS j FROM sp), h AS (SELECT *, j * (len(v) - 1) / 23.0 AS p FROM g)
SELECT location, start_time, j::INTEGER AS pos, round(CASE WHEN p = floor(p) THEN v[floor(p)::BIGINT + 1] ELSE v[floor(p)::BIGINT + 1] * (1 - (p - floor(p))) + v[least(floor(p)::BIGINT + 2, len(v))] * (p - floor(p)) END, 5) AS value FROM h""")(
    lambda s, d: spans(s, d).select("location", "start_time", F.posexplode(rs.stretch(F.col("values"), 24)).alias("pos", "value")).withColumn("value", F.round("value", 5))
)


query("f3_upsample_clipped", f"""WITH {SPANS}, c AS (SELECT * FROM q WHERE ts >= {LOW} AND ts < {HIGH}), h AS (SELECT location, span, unnest(range(min(ts), max(ts) + 1, 300)) AS ts FROM c GROUP BY location, span),
n AS (SELECT h.location, h.span, h.ts, h.ts - (h.ts - h.span) % {STEP} AS a FROM h)
SELECT n.location, n.span, n.ts, round(x.value + CASE WHEN y.value IS NULL THEN 0 ELSE (y.value - x.value) * (n.ts - n.a) / {STEP}.0 END + 1.37e-8, 6) + 0.0 AS value
FROM n JOIN c x ON x.location = n.location AND x.ts = n.a LEFT JOIN c y ON y.location = n.location AND y.span = n.span AND y.ts = n.a + {STEP}""")(
    lambda s, d: rs.upsample(spans(s, d), 300, ["location"], LOW, HIGH).withColumn("value", r6(F.col("value")))
)
# a window of a month of quarter hours over a series of all events, each day
query("f5_pool_month", f"""WITH {EVENTS}, u AS (SELECT 0::BIGINT AS location, event_id // 3 AS pos, avg(value) AS value FROM e GROUP BY 2), n AS (SELECT max(pos) + 1 AS n FROM u),
w AS (SELECT unnest(range(0, greatest(0, (n - 2880) // 96 + 1))) AS win FROM n)
SELECT location, win::BIGINT AS "window", round(quantile_cont(value, 0.99) + 1.37e-8, 6) + 0.0 AS value FROM w JOIN u ON pos >= win * 96 AND pos < win * 96 + 2880 GROUP BY 1, 2 HAVING count(*) = 2880""")(
    lambda s, d: rs.pool_quantile(events(s, d).groupBy(F.lit(0).cast("long").alias("location"), F.floor(F.col("event_id") / 3).alias("pos")).agg(F.avg("value").alias("value")), ["location"], 2880, 96, 0.99).withColumn("value", r6(F.col("value")))
)


def numbered(s, d):
    """Samples of each user with their position."""
    return rs.numbered(samples(s, d, "user_id"), ["location"])


U = f"{EVENTS}, {samples_sql('user_id')}, u AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ts) - 1 AS pos FROM s)"
query("f5_pool_quantile", f"""WITH {U}, z AS (SELECT location, pos, value FROM u UNION ALL SELECT location, p, 0.0 FROM (SELECT location, unnest([-2, -1, max(pos) + 1, max(pos) + 2]) AS p FROM u GROUP BY location)),
k AS (SELECT z.location, (z.pos + 2 - i * 2) // 3 AS win, value FROM z, (SELECT unnest(range(0, 5)) AS i) WHERE z.pos + 2 - i * 2 >= 0 AND (z.pos + 2 - i * 2) % 3 = 0)
SELECT location, win::BIGINT AS "window", round(quantile_cont(value, 0.9) + 1.37e-8, 6) + 0.0 AS value FROM k GROUP BY 1, 2 HAVING count(*) = 5""")(
    lambda s, d: rs.pool_quantile(numbered(s, d), ["location"], 5, 3, 0.9, dilation=2, padding=2).withColumn("value", r6(F.col("value")))
)
query("f6_pool_extremes", f"""WITH {U} SELECT location, (pos // 8)::BIGINT AS "window", round(min(value) + 1.37e-8, 6) + 0.0 AS low, round(max(value) + 1.37e-8, 6) + 0.0 AS high FROM u GROUP BY 1, 2 HAVING count(*) = 8""")(
    lambda s, d: rs.pool_extremes(numbered(s, d), ["location"], 8).select("location", "window", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))
)
query("f7_extremes", f"""WITH {U} SELECT location, coalesce(min(value) FILTER (location % 10 <> 0), 1e308) AS low, coalesce(max(value) FILTER (location % 10 <> 0), -1e308) AS high FROM (SELECT location, round(value + 1.37e-8, 6) + 0.0 AS value FROM u) GROUP BY 1""")(
    lambda s, d: rs.extremes(numbered(s, d).withColumn("value", F.when(F.col("location") % 10 == 0, F.lit(float("nan"))).otherwise(r6(F.col("value")))), ["location"]).select(
        "location", F.greatest(F.lit(-1e308), F.least(F.lit(1e308), F.col("low"))).alias("low"), F.greatest(F.lit(-1e308), F.least(F.lit(1e308), F.col("high"))).alias("high")
    )
)
query("f8_unit_scale", f"""WITH {U} SELECT location, ts, round(CASE WHEN h > l THEN (value - l) / (h - l) ELSE value END + 1.37e-8, 6) + 0.0 AS value FROM (SELECT *, min(value) OVER (PARTITION BY location) AS l, max(value) OVER (PARTITION BY location) AS h FROM u)""")(
    lambda s, d: rs.unit_scale(samples(s, d, "user_id"), ["location"]).withColumn("value", r6(F.col("value")))
)
query("f9_every", f"WITH {U} SELECT location, ts, round(value + 1.37e-8, 6) + 0.0 AS value FROM u WHERE pos % 7 = 0")(lambda s, d: rs.every(samples(s, d, "user_id"), ["location"], 7).withColumn("value", r6(F.col("value"))))
query("f10_envelope", f"""WITH {U} SELECT location, (pos // 6)::BIGINT AS "window", round(min(value) + 1.37e-8, 6) + 0.0 AS low, round(max(value) + 1.37e-8, 6) + 0.0 AS high, (pos // 6 * 6 + 3)::BIGINT AS centre FROM u GROUP BY 1, 2, 5 HAVING count(*) = 6""")(
    lambda s, d: rs.envelope(numbered(s, d), ["location"], 6).select("location", "window", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "centre")
)
query("m1_most_samples", f"WITH {SPANS} SELECT location, sum(num_values)::BIGINT AS num_values FROM sp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(lambda s, d: rs.most_samples(spans(s, d), "location"))
query("m2_in_order", f"WITH {SPANS} SELECT location, start_time, num_values FROM sp ORDER BY 1, 2")(lambda s, d: rs.in_order(spans(s, d).select("location", "start_time", "num_values"), ["location", "start_time"]))
query("m3_tail", f"WITH {U} SELECT location, ts, round(value + 1.37e-8, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ts DESC) AS n FROM s) WHERE n <= 5")(
    lambda s, d: rs.tail(samples(s, d, "user_id"), ["location"], 5).withColumn("value", r6(F.col("value")))
)


def daily(s, d, shifted: bool):
    """Daily order totals of customers as spans with coordinates; the other copy lacks, moves and changes some."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 86400).alias("ts"), F.col("o_totalprice").alias("value"))
    if shifted:
        o = o.where("k % 50 <> 1").withColumn("value", F.when(F.col("k") % 20 == 2, F.col("value") + 1).otherwise(F.col("value"))).withColumn("ts", F.when(F.col("k") % 30 == 3, F.col("ts") + 86400).otherwise(F.col("ts")))
    else:
        o = o.where("k % 50 <> 4")
    sp = rs.to_spans(o, 86400, ["k"])
    return sp.select((50 + F.col("k") / 1000).alias("lat"), F.lit(5.0).alias("lon"), "start_time", "sample_interval_s", "num_values", "values")


def _daily_sql(n: str, ts: str, value: str, keep: str) -> str:
    return f"""{n}o AS (SELECT k, ts, min(value) AS value FROM (SELECT o_custkey AS k, {ts} AS ts, {value} AS value FROM orders WHERE {keep}) GROUP BY 1, 2),
{n}r AS (SELECT *, sum(CASE WHEN ts - p = 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY k ORDER BY ts) AS p FROM {n}o)),
{n} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY min(ts)) AS i, min(ts) AS st, count(*) AS nv, list(value ORDER BY ts) AS v FROM {n}r GROUP BY k, run)"""


_T = "date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400"
query("d9_compare", f"""WITH {_daily_sql('x', _T, 'o_totalprice', 'o_custkey % 50 <> 4')},
{_daily_sql('y', f'{_T} + CASE WHEN o_custkey % 30 = 3 THEN 86400 ELSE 0 END', 'CASE WHEN o_custkey % 20 = 2 THEN o_totalprice + 1 ELSE o_totalprice END', 'o_custkey % 50 <> 1')},
j AS (SELECT x.st AS s1, y.st AS s2, x.nv AS n1, y.nv AS n2, x.v AS v1, y.v AS v2 FROM x FULL JOIN y ON x.k = y.k AND x.i = y.i WHERE coalesce(x.k, y.k) IN (SELECT k FROM x) AND coalesce(x.k, y.k) IN (SELECT k FROM y)),
c AS (SELECT 'only_left' AS "check", (SELECT count(DISTINCT k) FROM x WHERE k NOT IN (SELECT k FROM y)) AS n
UNION ALL SELECT 'only_right', (SELECT count(DISTINCT k) FROM y WHERE k NOT IN (SELECT k FROM x))
UNION ALL SELECT 'span', (SELECT count(*) FROM j WHERE NOT coalesce(s1 = s2 AND n1 = n2, false)) UNION ALL SELECT 'interval', 0
UNION ALL SELECT 'value', (SELECT count(*) FROM j WHERE coalesce(s1 = s2 AND n1 = n2, false) AND len(list_filter(list_zip(v1, v2), lambda z: abs(z[1] - z[2]) > 1e-5 + 1e-5 * abs(z[2]))) > 0))
SELECT "check", n = 0 AS passed, n FROM c""")(lambda s, d: places.compare_spans(daily(s, d, False), daily(s, d, True)))


BRIDGE = 43200


def coverage(s, d):
    """Samples to spans to intervals to window starts: gaps of up to half a day bridged, how much data windows of a day, every six hours, cover."""
    data = iv.of_spans(spans(s, d).withColumn("location_id", F.col("location")))
    bridged = iv.bridged(data, BRIDGE)
    found = iv.count_starts(iv.add_duration(bridged, -86400, tidy=True), 21600, tidy=True)
    minutes = F.col("n") * 96 * (STEP // 60)
    return found.select(F.col("location_id").alias("location"), F.col("n").alias("windows"), minutes.alias("minutes"), r6(minutes / 1440).alias("days"), r6(minutes / 525960).alias("years"))


query("e7_coverage_summary", f"""WITH {SPANS}, sb AS (SELECT location AS location_id, start_time AS start, start_time + num_values * {STEP} + {BRIDGE} AS stop FROM sp), {sweep('br', 'sb', 'x > 0')},
i AS (SELECT location_id AS location, start AS a, stop - {BRIDGE} - 86400 AS b FROM br), n AS (SELECT location, sum(len(range((a + 21599) // 21600 * 21600, b, 21600)))::BIGINT AS n FROM i WHERE b > a GROUP BY 1)
SELECT location, n AS windows, n * 1440 AS minutes, round(n * 1440 / 1440.0 + 1.37e-8, 6) + 0.0 AS days, round(n * 1440 / 525960.0 + 1.37e-8, 6) + 0.0 AS years FROM n WHERE n > 0""")(coverage)
