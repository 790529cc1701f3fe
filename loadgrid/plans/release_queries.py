"""Registered queries of readers, writers and releases. What they read is written from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loadgrid.functions import scalars as fn
from loadgrid.operators import resample as rs, scores as sc
from loadgrid.operators.tables import shared_dir, written
from loadgrid.plans import score_queries as scq, series_queries as sq
from loadgrid.plans.inputs import EVENTS, SITES, events, samples, samples_sql, sites, table
from loadgrid.plans.series_queries import r6
from loadgrid.sources import buffer, files, release

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def raw_series(s, d, kind: str, locators=lambda path: path):
    path = folder(s, "series")
    rows = events(s, d).select("event_type", F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("load"))
    out = rows.write.partitionBy("event_type")
    out.parquet(path) if kind == "parquet" else out.option("header", "true").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    return files.read_series(s, locators(path), "time", "load", kind, r"/event_type=([^/]+)/")


_RAW = f"WITH {EVENTS} SELECT event_type AS location, t AS ts, round(value + 1.37e-8, 6) + 0.0 AS value FROM e"
query("a1_read_series_parquet", _RAW)(lambda s, d: raw_series(s, d, "parquet").withColumn("value", r6(F.col("value"))))
query("a1_read_series_csv", _RAW)(lambda s, d: raw_series(s, d, "csv").withColumn("value", r6(F.col("value"))))


def several_locators(path: str) -> list[str]:
    """The folders of all event types by a URI where the path is local, by alternatives, and by letters."""
    return [f"{path if '://' in path or path.startswith('file:') else 'file://' + path}/event_type=click", f"{path}/event_type={{view,error}}", f"{path}/event_type=[ps]*"]


query("a15_locators", _RAW)(lambda s, d: raw_series(s, d, "csv", several_locators).withColumn("value", r6(F.col("value"))))
query("a2_with_catalogue", f"WITH {SITES} SELECT c_name AS location, lon, lat FROM customer LEFT JOIN (SELECT replace(name, 'Supplier', 'Customer') AS n, lon, lat FROM si) ON n = c_name")(
    lambda s, d: files.with_catalogue(table(s, d, "customer").select(F.col("c_name").alias("location")), sites(s, d).select(F.replace("name", F.lit("Supplier"), F.lit("Customer")).alias("name"), "lon", "lat"))
)


def flat_buffer(s, d):
    """Means and numbers of events in 15 minutes as a flat file of two features, read again for all types but sign-ups."""
    e = events(s, d)
    rows = e.groupBy(F.col("event_type").alias("location"), (F.col("t") - F.pmod("t", F.lit(900))).alias("ts")).agg(F.struct(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n")).alias("value"))
    spans = buffer.placed(rs.to_spans(rows, 900, ["location"]), ["location", "start_time"])
    path = folder(s, "values") + ".np"
    stored = written(spans.select("id", "location", F.col("start_time").alias("datetime_start"), "num_values", "sample_interval_s", F.col("values")["mean"].alias("mean"), F.col("values")["n"].alias("n")))
    buffer.write_buffer(stored.select("id", "mean", "n"), path, ["mean", "n"])
    raw = F.ascii("location")
    known = e.where("event_type <> 'signup'").groupBy(F.col("event_type").alias("location")).agg(F.count("*"))
    table = stored.select("id", raw.alias("location"), "datetime_start", "num_values", "sample_interval_s")
    return buffer.read_buffer(s, path, table, known.select(raw.alias("location_id"), F.col("location").alias("name")), ["mean", "n"])


query("a4_read_buffer", f"""WITH {EVENTS} SELECT {sq._ID.replace(sq.HEX, 'sha256(event_type)')} AS location_id, t - t % 900 AS ts, round(avg(value)::FLOAT::DOUBLE + 1.37e-5, 3) + 0.0 AS mean, count(*)::DOUBLE AS n
FROM e WHERE event_type <> 'signup' GROUP BY event_type, 2""")(lambda s, d: flat_buffer(s, d).withColumn("mean", F.round(F.col("mean") + 1.37e-5, 3) + 0.0))
FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def weather(s, d):
    """Daily means of three columns of order lines as wide spans of suppliers."""
    li = table(s, d, "lineitem").withColumn("ts", F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long") * 86400)
    days = li.groupBy(F.col("l_suppkey").alias("weather_location_id"), "ts").agg(*(F.avg(f).alias(f) for f in FEATURES))
    spans = rs.to_spans(days.withColumn("value", F.struct(*FEATURES)), 86400, ["weather_location_id"])
    return spans.select("weather_location_id", "start_time", "sample_interval_s", "num_values", *(F.col("values")[f].alias(f) for f in FEATURES))


def units(s):
    return s.createDataFrame([("l_quantity", "pieces"), ("l_discount", "share")], "feature_name string, feature_unit string")


KEYS = ["weather_location_id", "start_time", "sample_interval_s", "num_values"]
W = """dy AS (SELECT l_suppkey AS k, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 86400 AS ts, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2),
dr AS (SELECT *, sum(CASE WHEN ts - p = 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY k ORDER BY ts) AS p FROM dy)),
wt AS (SELECT k AS weather_location_id, min(ts) AS start_time, count(*) AS num_values, sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice, sum(l_discount) AS l_discount FROM dr GROUP BY k, run)"""
_TOTAL = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4) + 0.0
query("a10_to_weather_rows", f"""WITH {W} SELECT weather_location_id, start_time, 86400 AS sample_interval_s, num_values, feature_name, CASE feature_name WHEN 'l_quantity' THEN 'pieces' WHEN 'l_discount' THEN 'share' ELSE 'unknown' END AS feature_unit, round(v, 4) + 0.0 AS total
FROM (UNPIVOT wt ON l_quantity, l_extendedprice, l_discount INTO NAME feature_name VALUE v)""")(
    lambda s, d: release.to_weather_rows(weather(s, d), FEATURES, units(s), KEYS).withColumn("total", _TOTAL("values")).drop("values")
)


def weather_back(s, d):
    path = folder(s, "weather")
    release.write_weather(weather(s, d), FEATURES, units(s), KEYS, path)
    return release.from_weather_rows(s.read.parquet(path), FEATURES, ["l_quantity", "l_discount"])


query("a6_from_weather_rows", f"WITH {W} SELECT weather_location_id, start_time, num_values, round(l_quantity, 4) + 0.0 AS l_quantity, round(l_discount, 4) + 0.0 AS l_discount FROM wt")(
    lambda s, d: weather_back(s, d).withColumns({c: _TOTAL(c) for c in ("l_quantity", "l_discount")})
)
query("a7_sideload", f"""WITH {EVENTS}, x AS (SELECT user_id, (round_even(t / 3600.0, 0) * 3600)::BIGINT AS ts, value, event_id FROM e), l AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM x GROUP BY 1, 2),
g AS (SELECT user_id, unnest(range(min(ts), max(ts) + 1, 3600)) AS ts FROM l GROUP BY user_id)
SELECT user_id, g.ts, round(coalesce(l.value, 0) / 1e6, 9) + 0.0 AS value FROM g LEFT JOIN l USING (user_id, ts)""")(
    lambda s, d: files.sideload(events(s, d), 3600, ["user_id"], "event_id", "t").withColumn("value", F.round("value", 9) + 0.0)
)


def descriptor(s, d):
    """Sites as one JSON document, read again; every fifth name is missing."""
    place = F.struct(F.when(F.col("location_id") % 5 != 0, F.col("name")).alias("name"), "lon", "lat")
    whole = sites(s, d).groupBy((F.col("location_id") % 10).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("location_id").cast("string"), place))).alias("locations"))
    path = folder(s, "descriptor")
    whole.select("locations").repartition(10).write.json(path)
    return files.read_descriptor(s, path)


query("a8_read_descriptor", f"WITH {SITES} SELECT location_id, CASE WHEN location_id % 5 = 0 THEN location_id::VARCHAR ELSE name END AS name, lat, lon, NULL::VARCHAR AS sign FROM si")(descriptor)


def location_meta(s, d):
    k = F.col("location_id")
    kind = fn.measurement_type(F.when(k % 4 == 0, "native-aggregate"), k % 3 == 0, F.lit(False))
    return sites(s, d).select(
        "location_id", fn.public_name(F.col("name"), kind, k).alias("location_name"), F.col("lat"), F.col("lon"), fn.sensor_unit(F.when(k % 3 == 0, " p ").when(k % 3 == 1, "i").otherwise("other")).alias("sensor_unit"), kind.alias("measurement_type")
    )


def measurements(s, d):
    """Spans of 15-minute samples of the users that are sites, every seventh value missing, with their metadata."""
    sp = sq.spans(s, d, "user_id").withColumnRenamed("location", "location_id")
    holes = F.transform("values", lambda v, i: F.when((F.col("start_time") / 900 + i).cast("long") % 7 != 0, v))
    return release.prepared(sp.withColumn("values", holes), location_meta(s, d))


MEAS = f"""{EVENTS}, {samples_sql('user_id')}, {SITES}, sr AS (SELECT *, sum(CASE WHEN ts - p = 900 THEN 0 ELSE 1 END) OVER (PARTITION BY location ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY location ORDER BY ts) AS p FROM s)),
me AS (SELECT location AS location_id, min(ts) AS start_time, count(*) AS num_values, count(*) FILTER ((ts // 900) % 7 = 0) AS missing FROM sr WHERE location IN (SELECT location_id FROM si) GROUP BY location, run),
lm AS (SELECT location_id, CASE location_id % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'I' ELSE 'X' END AS sensor_unit, CASE WHEN location_id % 4 = 0 OR location_id % 3 = 0 THEN 'native_aggregate' ELSE 'pseudo_aggregate' END AS measurement_type, lat, lon FROM si),
ln AS (SELECT *, measurement_type || '_' || lpad(location_id::VARCHAR, 5, '0') AS location_name FROM lm)"""


def stored(s, d):
    path = folder(s, "measurements")
    release.write_measurements(measurements(s, d), path)
    return path




def n_missing():
    return F.size(F.filter("values", lambda v: v.isNull())).cast("long")


query("a9_write_measurements", f"WITH {MEAS} SELECT location_id, start_time, num_values, missing, location_name, sensor_unit, measurement_type, lat, lon FROM me JOIN ln USING (location_id)")(
    lambda s, d: s.read.parquet(stored(s, d)).select("location_id", "start_time", "num_values", n_missing().alias("missing"), "location_name", "sensor_unit", "measurement_type", "lat", "lon")
)
query("a5_read_measurements", f"WITH {MEAS} SELECT DISTINCT location_id, location_name, lat, lon, sensor_unit, measurement_type FROM me JOIN ln USING (location_id)")(lambda s, d: release.read_measurements(s, stored(s, d))[1])
query("a11_wanted_values", f"WITH {MEAS} SELECT location_id, start_time, num_values FROM me WHERE location_id IN (1, 2, 3, 5, 8) AND start_time < 1705300000 AND start_time + num_values * 900 > 1704600000")(
    lambda s, d: release.wanted_values(s, stored(s, d), [1, 2, 3, 5, 8], 1704600000, 1705300000).select("location_id", "start_time", "num_values")
)
query("e1_totals", f"WITH {MEAS} SELECT count(*) AS spans, sum(num_values)::BIGINT AS samples, sum(missing)::BIGINT AS missing, (sum(num_values) - sum(missing))::BIGINT AS valid FROM me")(lambda s, d: release.totals(measurements(s, d)).select("spans", "samples", F.col("missing").cast("long").alias("missing"), F.col("valid").cast("long").alias("valid")))
query("e2_unit_counts", f"WITH {MEAS} SELECT u AS sensor_unit, (SELECT count(*) FROM ln WHERE sensor_unit = u) AS n FROM (SELECT unnest(['P', 'I', 'X']) AS u)")(lambda s, d: release.unit_counts(location_meta(s, d)))
query("e2_type_counts", f"WITH {MEAS} SELECT measurement_type, count(*) AS n FROM ln GROUP BY 1")(lambda s, d: release.type_counts(location_meta(s, d)))
query("e3_checked_cover", f"""WITH {EVENTS}, {samples_sql('user_id')} SELECT min(ts) AS first, max(ts) + 900 AS last, min(ts) - 86400 AS weather_first, max(ts) + 900 + 86400 AS weather_last FROM s""")(
    lambda s, d: (lambda sp: release.checked_cover(sp, sp.withColumns({"start_time": F.col("start_time") - 86400, "num_values": F.col("num_values") + 192})))(sq.spans(s, d, "user_id"))
)


def _sums_sql(digest: str) -> str:
    """SQL of the sums of a digest's limbs of 32 bits, the lowest first."""
    return ", ".join(f"sum(('0x' || substr({digest}, {8 * (7 - k) + 1}, 8))::BIGINT)::HUGEINT AS l{k}" for k in range(8))


def _wide_sql(rows: str) -> str:
    """SQL that adds wide, the hexadecimal number of summed limbs modulo 2^256, limb after limb."""
    out = f"SELECT *, 0::HUGEINT AS c0 FROM {rows}"
    for k in range(8):
        out = f"SELECT *, lower(lpad(to_hex(((l{k} + c{k}) % 4294967296)::BIGINT), 8, '0')) AS h{k}, (l{k} + c{k}) // 4294967296 AS c{k + 1} FROM ({out})"
    return f"SELECT *, {' || '.join(f'h{k}' for k in range(7, -1, -1))} AS wide FROM ({out})"


def sources(s, d):
    """Measurements as two sources: of even and of odd locations."""
    return measurements(s, d).withColumn("source", F.when(F.col("location_id") % 2 == 0, "even").otherwise("odd"))


def added(s, d):
    """The states of spans of the first days and of those that came later, put together."""
    rows = sources(s, d)
    both = release.merged_states(release.content_state(rows.where("start_time < 1705000000")), release.content_state(rows.where("start_time >= 1705000000")))
    return release.with_wide(both).select("source", "n", "wide")


_STATE = f"""{MEAS}, sv AS (SELECT location AS location_id, run, ts, CASE WHEN (ts // 900) % 7 = 0 THEN 'null' ELSE printf('%.9e', value::FLOAT::DOUBLE) END AS x FROM sr WHERE location IN (SELECT location_id FROM si)),
sd AS (SELECT location_id, sha256(location_id || '|' || min(ts) || '|' || string_agg(x, ',' ORDER BY ts)) AS h FROM sv GROUP BY location_id, run),
sw AS (SELECT CASE location_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n, {_sums_sql('h')} FROM sd GROUP BY 1)"""
query("e6_content_hash", f"WITH {_STATE}, so AS (SELECT sha256(n || ':' || wide) AS h FROM ({_wide_sql('sw')})), al AS (SELECT {_sums_sql('h')} FROM so) SELECT wide AS hash FROM ({_wide_sql('al')})")(lambda s, d: release.content_hash(sources(s, d)))
query("e6_added_spans", f"WITH {_STATE} SELECT source, n, wide FROM ({_wide_sql('sw')})")(added)
query("a14_record_tables", f"""WITH {MEAS}, t AS (SELECT count(*) AS spans, sum(num_values)::BIGINT AS samples, sum(missing)::BIGINT AS missing, (sum(num_values) - sum(missing))::BIGINT AS valid FROM me)
SELECT 'sensor_unit_counts' AS record, u AS key, (SELECT count(*) FROM ln WHERE sensor_unit = u)::VARCHAR AS value FROM (SELECT unnest(['P', 'I', 'X']) AS u)
UNION ALL SELECT 'measurement_type_counts', measurement_type, count(*)::VARCHAR FROM ln GROUP BY measurement_type
UNION ALL SELECT 'totals', name, v::VARCHAR FROM (UNPIVOT t ON spans, samples, missing, valid INTO NAME name VALUE v)
UNION ALL SELECT 'locations', location_id::VARCHAR, '{{"location_name":"' || location_name || '","sensor_unit":"' || sensor_unit || '","measurement_type":"' || measurement_type || '"}}' FROM ln""")(
    lambda s, d: release.record_tables(measurements(s, d), location_meta(s, d))
)


def predictions(s, d):
    path = folder(s, "predictions")
    files.write_predictions(scq.forecast(s, d), path, scq.LEVELS)
    cols = {str(q): f"q{i}" for i, q in enumerate(scq.LEVELS)}
    return s.read.parquet(path).select("location", "ts", *(r6(F.col(f"`{c}`")).alias(n) for c, n in cols.items()))


query("a12_write_predictions", f"""WITH {EVENTS}, {samples_sql()} SELECT location, ts + 86400 AS ts, {', '.join(f'round(value + ({q} - 0.5) * {scq.SPREAD} + 1.37e-8, 6) + 0.0 AS q{i}' for i, q in enumerate(scq.LEVELS))} FROM s""")(predictions)


def metric_log(s, d):
    """Two iterations appended, the second one twice, and read again."""
    path, names = folder(s, "metrics"), ["crps", "mae_0.5"]
    wide = sc.to_wide(scq.report(s, d), ["iteration", "location"], names)
    files.append_metrics(wide, path)
    later = wide.withColumn("iteration", F.lit(2)).withColumn("crps", F.when(F.col("location") == "view", float("inf")).otherwise(F.col("crps")))
    for _ in range(2):  # as a rerun does
        files.append_metrics(later, path)
    return files.read_metrics(s, path, 2, names).withColumnRenamed("mae_0.5", "mae")


query("a13_metric_log", f"WITH {scq.REPORT} SELECT location AS substation, max(value) FILTER (metric = 'crps' AND location <> 'view') AS crps, max(value) FILTER (metric = 'mae' AND quantile = 0.5) AS mae FROM re GROUP BY 1")(metric_log)
