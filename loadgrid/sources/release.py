"""Releases: measurement and weather tables of spans with nested values, and the record tables that describe them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadgrid.functions.scalars import UNITS
from loadgrid.operators.resample import BUCKET, bare
from loadgrid.operators.places import first_of
from loadgrid.operators.running import bucket_of, running

#: Wanted locations up to which each one's range of starts reaches the scan; beyond, one range for all.
SEPARATE = 100
META = ["location_id", "location_name", "lat", "lon", "sensor_unit", "measurement_type", "weather_location_id"]


def write_measurements(spans: DataFrame, path: str, coordinates: bool = True, files: int | None = None) -> None:
    """Spans as zstd Parquet in order of location and start. Wanted coordinates that are missing are an error."""
    if coordinates:
        ok = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        spans = spans.withColumn("lat", F.when(ok, F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("no coordinates of location "), F.col("location_id").cast("string")))).cast("double"))
    else:
        spans = spans.drop("lat", "lon")
    keys = ["location_id", "start_time"]
    ranged = spans.repartitionByRange(files, *keys) if files else spans.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_measurements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Spans and location metadata, that of a location's first span by start counting. An empty release is an error."""
    rows = spark.read.parquet(path)
    if rows.isEmpty():
        raise ValueError("the release has no measurements")
    meta = first_of(rows, ["location_id"], ["start_time"], [c for c in META if c in rows.columns])
    return rows.select("location_id", "start_time", "sample_interval_s", "num_values", "values"), meta


def wanted_values(spark: SparkSession, path: str, locations: list[int], low: int, high: int) -> DataFrame:
    """Spans of some locations that overlap [low, high), in two phases.

    The first reads metadata columns alone, with the filters pushed to the scan, and gives the files that hold wanted
    spans and the range of their starts. The second reads values from these files only, and there only row groups and
    pages whose statistics meet the starts of a wanted location: spans that end before low, which no statistic tells,
    are not decoded for it.
    """
    rows = spark.read.parquet(path)
    columns = ["location_id", "start_time", "sample_interval_s", "num_values", "values"]
    overlap = F.col("location_id").isin(locations) & (F.col("start_time") < high) & (F.col("start_time") + F.col("num_values") * F.col("sample_interval_s") > low)
    meta = rows.where(overlap).select("location_id", "start_time", F.col("_metadata.file_path").alias("file"))
    # a row for each file, and one for each wanted location
    found = meta.groupBy("location_id").agg(F.min("start_time").alias("a"), F.max("start_time").alias("b"), F.collect_set("file").alias("files")).collect()
    if not found:
        return rows.where("false").select(*columns)
    files = sorted({f for r in found for f in r["files"]})
    near = reduce(lambda x, y: x | y, [(F.col("location_id") == r["location_id"]) & F.col("start_time").between(r["a"], r["b"]) for r in found]) if len(found) <= SEPARATE else F.col("location_id").isin([r["location_id"] for r in found]) & F.col("start_time").between(min(r["a"] for r in found), max(r["b"] for r in found))
    return spark.read.schema(rows.schema).parquet(*files).where(near & overlap).select(*columns)


def to_weather_rows(wide: DataFrame, features: list[str], units: DataFrame, keys: list[str]) -> DataFrame:
    """Wide spans (keys, an array per feature) as one row per feature (keys, feature_name, feature_unit, values)."""
    each = F.array(*(F.struct(F.lit(f).alias("feature_name"), F.col(f).alias("values")) for f in features))
    rows = wide.select(*keys, F.inline(each))
    # units have a row for each feature: a shuffle by feature would put all spans into a few tasks
    return rows.join(F.broadcast(units), "feature_name", "left").select(*keys, "feature_name", F.coalesce("feature_unit", F.lit("unknown")).alias("feature_unit"), "values")


def write_weather(wide: DataFrame, features: list[str], units: DataFrame, keys: list[str], path: str) -> None:
    to_weather_rows(wide, features, units, keys).repartitionByRange("weather_location_id", "start_time").sortWithinPartitions("weather_location_id", "start_time").write.mode("overwrite").option("compression", "zstd").parquet(path)


def from_weather_rows(rows: DataFrame, features: list[str], wanted: list[str] | None = None, key: str = "weather_location_id") -> DataFrame:
    """(key, start_time, num_values, an array per feature). A span that lacks a feature, has one twice, or has features
    of different lengths raises an error; features: all that the release has, in order."""
    chosen = [f for f in features if wanted is None or f in wanted]
    checks = [F.count("*").alias("__n"), F.size(F.collect_set("feature_name")).alias("__f"), F.min("num_values").alias("__low"), F.max("num_values").alias("num_values")]
    picked = [F.first(F.when(F.col("feature_name") == f, F.col("values")), ignorenulls=True).alias(f) for f in chosen]
    spans = rows.groupBy(key, "start_time").agg(*checks, *picked)
    bad = (F.col("__n") != len(features)) | (F.col("__f") != len(features)) | (F.col("__low") != F.col("num_values"))
    message = F.concat(F.lit("incomplete weather of location "), F.col(key).cast("string"))
    return spans.select(key, F.when(bad, F.raise_error(message)).otherwise(F.col("start_time")).cast("long").alias("start_time"), "num_values", *chosen)


def totals(spans: DataFrame) -> DataFrame:
    """(spans, samples, missing, valid): a value that is null or NaN is missing."""
    missing = F.size(F.filter("values", lambda v: v.isNull() | F.isnan(v)))
    sums = spans.agg(F.count("*").alias("spans"), F.coalesce(F.sum("num_values"), F.lit(0)).alias("samples"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing"))
    return sums.withColumn("valid", F.col("samples") - F.col("missing"))


def unit_counts(meta: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(sensor_unit, n): locations per unit, all units being listed."""
    spark = spark or meta.sparkSession
    listed = spark.createDataFrame([(u,) for u in UNITS], "sensor_unit string")
    counts = meta.groupBy("location_id").agg(F.min("sensor_unit").alias("sensor_unit")).groupBy("sensor_unit").agg(F.count("*").alias("n"))
    return listed.join(counts, "sensor_unit", "left").select("sensor_unit", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def type_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("location_id").agg(F.min("measurement_type").alias("measurement_type")).groupBy("measurement_type").agg(F.count("*").alias("n"))


def date_range(spans: DataFrame) -> DataFrame:
    """(first, last): the earliest start and the latest end."""
    return spans.agg(F.min("start_time").alias("first"), F.max(F.col("start_time") + F.col("num_values") * F.col("sample_interval_s")).alias("last"))


def checked_cover(measurements: DataFrame, weather: DataFrame) -> DataFrame:
    """(first, last, weather_first, weather_last); reading it raises an error if weather doesn't cover the measurements."""
    both = date_range(measurements).crossJoin(date_range(weather).toDF("weather_first", "weather_last"))  # one row each
    ok = (F.col("weather_first") <= F.col("first")) & (F.col("weather_last") >= F.col("last"))
    return both.withColumn("first", F.when(ok, F.col("first")).otherwise(F.raise_error(F.lit("weather does not cover the measurements"))).cast("long"))


#: A digest of 256 bits as so many limbs of 32 bits, the lowest first.
LIMBS = 8


def _limbs(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 8 * (LIMBS - 1 - k) + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(LIMBS)]


def _total(digest: Column) -> list[Column]:
    return [F.sum(x).cast("decimal(38,0)").alias(f"l{k}") for k, x in enumerate(_limbs(digest))]


def _wide(names: list[str]) -> Column:
    """The hexadecimal number of summed limbs, modulo 2^256."""
    base, carry, out = F.lit(2**32).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"), []
    for n in names:
        # what a limb holds beyond 32 bits goes on to the next one
        t = (F.col(n) + carry).cast("decimal(38,0)")
        out.append(F.lpad(F.lower(F.hex((t % base).cast("long"))), 8, "0"))
        carry = F.floor(t / base).cast("decimal(38,0)")
    return F.concat(*reversed(out))


def content_state(spans: DataFrame, source: str = "source", keys: tuple = ("location_id", "start_time")) -> DataFrame:
    """(source, n, l0, ...): number of spans of each source, and the sum of their SHA-256 digests in limbs of 32 bits.

    A digest stands for a span's keys and values, these as float32 in ten digits. Sums don't depend on order, so that a
    source is a partial aggregation whatever its size, and states of spans that come later are added with merged_states().
    """
    text = F.transform("values", lambda v: F.when(v.isNull() | F.isnan(v), "null").otherwise(F.format_string("%.9e", v.cast("float").cast("double"))))
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys), F.concat_ws(",", text)).cast("binary"), 256)
    return spans.groupBy(source).agg(F.count("*").alias("n"), *_total(digest))


def merged_states(*states: DataFrame, source: str = "source") -> DataFrame:
    """States of disjoint sets of spans as that of all of them."""
    whole = reduce(DataFrame.unionByName, states)
    return whole.groupBy(source).agg(F.sum("n").alias("n"), *(F.sum(f"l{k}").cast("decimal(38,0)").alias(f"l{k}") for k in range(LIMBS)))


def with_wide(state: DataFrame) -> DataFrame:
    """state with wide, its sum as a hexadecimal number."""
    return state.withColumn("wide", _wide([f"l{k}" for k in range(LIMBS)]))


def hash_of_state(state: DataFrame) -> DataFrame:
    """(hash): one hash of all sources: each source's sum modulo 2^256 and number of spans give a digest, and these are summed alike."""
    names = [f"l{k}" for k in range(LIMBS)]
    each = state.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), _wide(names)).cast("binary"), 256).alias("h"))
    return each.agg(*_total(F.col("h"))).select(F.coalesce(_wide(names), F.lit("0" * 64)).alias("hash"))


def content_hash(spans: DataFrame, source: str = "source", keys: tuple = ("location_id", "start_time")) -> DataFrame:
    """(hash): one hash of the spans of all sources, whatever their names, order or partitioning: a multiset hash."""
    return hash_of_state(content_state(spans, source, keys))


def record_tables(spans: DataFrame, meta: DataFrame) -> DataFrame:
    """(record, key, value): units, types, totals and locations of a release, nested values as JSON."""
    as_rows = lambda df, record, key, value: df.select(F.lit(record).alias("record"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    sums = totals(spans)
    parts = [
        as_rows(unit_counts(meta), "sensor_unit_counts", F.col("sensor_unit"), F.col("n")),
        as_rows(type_counts(meta), "measurement_type_counts", F.col("measurement_type"), F.col("n")),
        *(as_rows(sums, "totals", F.lit(c), F.col(c)) for c in ("spans", "samples", "missing", "valid")),
        as_rows(meta, "locations", F.col("location_id"), F.to_json(F.struct("location_name", "sensor_unit", "measurement_type"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def prepared(samples_spans: DataFrame, meta: DataFrame) -> DataFrame:
    """Release rows: spans with their location's metadata; overlapping spans raise an error."""
    stop = F.col("start_time") + F.col("num_values") * F.col("sample_interval_s")
    rows = samples_spans.withColumns({"__b": bucket_of(F.col("start_time"), BUCKET), "__stop": stop})
    rows = running(rows, ["location_id"], "__b", ["start_time", "__stop"], maxes={"__before": F.col("__stop")}, own=False)
    bad = F.col("start_time") < F.col("__before")
    message = F.concat(F.lit("overlapping spans of location "), F.col("location_id").cast("string"))
    guarded = rows.withColumn("start_time", F.when(bad, F.raise_error(message)).otherwise(F.col("start_time")).cast("long")).drop("__b", "__stop", "__before")
    return guarded.withColumn("values", F.transform("values", lambda v: bare(v.cast("double")).cast("float"))).join(meta, "location_id")
