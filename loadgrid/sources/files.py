"""Raw series, descriptors, sideloaded series, predictions and metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from loadgrid.functions.scalars import to_unix
from loadgrid.operators.places import first_of
from loadgrid.operators.resample import bare

STEM = r"([^/]+)\.(?:csv|parquet)$"


def located(*locators: str) -> list[str]:
    """Locators as paths that Spark reads: s3: goes by the s3a file system; local paths, file:, globs and other file systems stay.

    A web address raises an error: it can't be listed, nor read in ranges by many tasks.
    """
    for x in locators:
        if x.startswith(("http://", "https://")):
            raise ValueError(f"not on a file system: {x}")
    return ["s3a://" + x.removeprefix("s3://") if x.startswith("s3://") else x for x in locators]


def read_series(spark: SparkSession, folder: str | list[str], time_col: str, target_col: str, kind: str = "parquet", location: str = STEM) -> DataFrame:
    """(location, ts, value) of folders, given by locators, with one file or folder per location; location: a pattern of the path whose group is its name."""
    reader, paths = spark.read.option("recursiveFileLookup", "true"), located(*([folder] if isinstance(folder, str) else folder))
    rows = reader.parquet(*paths) if kind == "parquet" else reader.option("header", "true").schema(f"`{time_col}` timestamp, `{target_col}` double").csv(paths)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), location, 1).alias("location"), to_unix(F.col(time_col)).alias("ts"), bare(F.col(target_col).cast("double")).alias("value"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, lon, lat, place) of a catalogue in CSV; place is a line's position: its file, then its offset in it."""
    rows = spark.read.option("header", "true").schema("name string, lon double, lat double").csv(path)
    return rows.withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def with_catalogue(series: DataFrame, locations: DataFrame, name: str = "location", order: list[str] | None = None) -> DataFrame:
    """series with lon and lat by name; an unknown name keeps nulls. Of several rows of a name the first by order counts,
    such as place of read_catalogue(); without an order that with the least values."""
    first = first_of(locations, ["name"], order or [], [c for c in locations.columns if c not in (order or [])])
    return series.join(first.withColumnRenamed("name", name), name, "left")


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    """(location_id, name, lat, lon, sign) of a descriptor in JSON; a name that is missing is the id."""
    place = T.StructType([T.StructField("name", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("sign", T.StringType())])
    schema = T.StructType([T.StructField("locations", T.MapType(T.StringType(), place))])
    rows = spark.read.schema(schema).option("multiLine", "true").json(located(path)).select(F.explode("locations").alias("id", "p"))
    return rows.select(F.col("id").cast("long").alias("location_id"), F.coalesce("p.name", "id").alias("name"), "p.lat", "p.lon", "p.sign")


def sideload(rows: DataFrame, step: int, keys: list[str], order: str, ts: str = "time", value: str = "value") -> DataFrame:
    """(keys, ts, value): watts as megawatts on a full grid from the first to the last time, missing values 0.

    Times are rounded to the grid, ties to even multiples; of several values at one time the last in the given order counts.
    """
    w = Window.partitionBy(*keys, "ts").orderBy(F.desc(order))
    rounded = rows.select(*keys, (F.bround(F.col(ts) / step) * step).cast("long").alias("ts"), (bare(F.col(value).cast("double")) / 1e6).alias("value"), order)
    last = rounded.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, "ts", "value")
    grid = last.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(*keys, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("ts"))
    return grid.join(last, [*keys, "ts"], "left").select(*keys, "ts", F.coalesce("value", F.lit(0.0)).alias("value"))


def write_predictions(forecast: DataFrame, path: str, levels: list[float], key: str = "location") -> None:
    """One folder per location, a row per time, a column per quantile."""
    forecast.groupBy(key, "ts").pivot("quantile", levels).agg(F.first("value")).write.partitionBy(key).mode("overwrite").parquet(path)


def append_metrics(wide: DataFrame, path: str, run: str = "0") -> None:
    """Adds the wide metric rows of some iterations of a run, with a header in each file.

    A run's iteration is a partition, and a partition that is written again replaces the old one: neither a rerun nor a
    retried job doubles rows, and other iterations and runs stay. So all rows of an iteration come in one call.
    """
    named = wide.withColumn("run", F.lit(str(run)))
    named.write.partitionBy("run", "iteration").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true").csv(path)


def read_metrics(spark: SparkSession, path: str, iteration: int, names: list[str], run: str | None = None) -> DataFrame:
    """(substation, names) of one iteration, of one run if given; infinite values are missing. Only its partition is read."""
    columns = ["location", *names]
    rows = spark.read.option("header", "true").csv(path).where(F.col("iteration") == iteration)
    if run is not None:
        rows = rows.where(F.col("run") == str(run))
    typed = rows.select(*(F.col(f"`{c}`").cast("string" if c == "location" else "double").alias(c) for c in columns))
    return typed.select(F.col("location").alias("substation"), *(F.when(F.abs(F.col(f"`{n}`")) != float("inf"), F.col(f"`{n}`")).alias(n) for n in names))
