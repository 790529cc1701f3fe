"""Joins of measurements with places and weather, and comparison of releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.functions.scalars import coordinate_key
from loadgrid.operators.running import bucket_of, running
from loadgrid.operators.split_tree import nearest_of_few, nearest_points
from loadgrid.operators.tables import written

#: Points up to which the right side of a nearest match goes to all tasks (240 kB).
FEW_POINTS = 10_000


def first_of(rows: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The row of each keys that comes first by the given order, ties to the least values of the other columns."""
    columns = columns or rows.columns
    rest = [c for c in columns if c not in keys]
    first = F.min(F.struct(*(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), *rest)).alias("__first")
    return rows.groupBy(*keys).agg(first).select(*(c if c in keys else F.col("__first")[c].alias(c) for c in columns))


def with_location(spans: DataFrame, locations: DataFrame, key: str = "location_id", order: list[str] | None = None) -> DataFrame:
    """Spans with the columns of their location; spans of unknown locations go. Of several rows of a location the first by
    order counts; without one that with the least values, column by column."""
    return spans.join(first_of(locations, [key], order or [], [c for c in locations.columns if c not in (order or [])]), key)


def with_weather(measurements: DataFrame, weather: DataFrame, key: str = "weather_location_id") -> DataFrame:
    return measurements.join(weather, key)


def nearest(left: DataFrame, right: DataFrame, left_id: str = "location_id", right_id: str = "weather_id", metric: str = "planar") -> DataFrame:
    """(left_id, right_id, km): for each left point (lat, lon) the nearest right point (w_lat, w_lon), ties to the smaller id.

    A right side of at most FEW_POINTS goes to all tasks. Beyond, a tree of splits partitions the points, see
    split_tree. Points without coordinates have no row.
    """
    known = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a)) & ~F.isnan(F.col(b))
    as_double = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    rows = left.select(left_id, *as_double("lat", "lon")).where(known("lat", "lon"))
    # several locations at one place share the work
    places = rows.select("lat", "lon").distinct()
    points = right.select(F.col(right_id).cast("long").alias("id"), *as_double("w_lat", "w_lon")).where(known("w_lat", "w_lon"))
    few = points.limit(FEW_POINTS + 1).collect()
    found = nearest_of_few(places, [tuple(p) for p in few], metric, "bigint") if len(few) <= FEW_POINTS else nearest_points(places, points, metric)
    return rows.join(found, ["lat", "lon"]).select(left_id, F.col("id").cast(right.schema[right_id].dataType).alias(right_id), "km")


def nearest_or_first(left: DataFrame, right: DataFrame, wanted: DataFrame, key: str = "location_id", right_id: str = "weather_id") -> DataFrame:
    """wanted(location_id) with the nearest point; a location without coordinates takes that of the smallest known one."""
    pairs = nearest(left, right, key, right_id).select(key, right_id)
    first = pairs.agg(F.min(F.struct(key, right_id)).alias("f")).select(F.col(f"f.{right_id}").alias("__first"))
    return wanted.join(pairs, key, "left").crossJoin(F.broadcast(first)).select(key, F.coalesce(right_id, "__first").alias(right_id))


def link_weather(locations: DataFrame, stations: DataFrame, stated: str = "stated_id") -> DataFrame:
    """(location_id, weather_id, method): the stated id, else the point at the same coordinates, else the nearest one.

    stations are (weather_id, w_lat, w_lon). Coordinates that several stations share match none. A stated id that no
    station has gives method invalid, a location without any match missing; both have no weather_id.
    """
    ids = stations.select(F.col("weather_id").alias("__known")).distinct()
    key = coordinate_key(F.col("w_lat"), F.col("w_lon"))
    exact = stations.withColumn("key", key).groupBy("key").agg(F.count("*").alias("n"), F.min("weather_id").alias("exact_id")).where("n = 1 AND key IS NOT NULL").drop("n")
    near = nearest(locations, stations, metric="sphere").select("location_id", F.col("weather_id").alias("near_id"))
    rows = locations.withColumn("key", coordinate_key(F.col("lat"), F.col("lon"))).join(exact, "key", "left").join(near, "location_id", "left")
    rows = rows.join(ids, rows[stated] == F.col("__known"), "left")
    has = F.col(stated).isNotNull()
    method = F.when(has & F.col("__known").isNull(), "invalid").when(has, "stated").when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "nearest").otherwise("missing")
    return rows.select("location_id", F.when(method != "invalid", F.coalesce(stated, "exact_id", "near_id")).alias("weather_id"), method.alias("method"))


def first_seen_ids(points: DataFrame, order: str, first: int = 1_000_000) -> DataFrame:
    """(lat, lon, weather_id): distinct coordinates numbered from first in the order in which they appear."""
    from loadgrid.operators.ranks import with_rank

    seen = points.groupBy("lat", "lon").agg(F.min(order).alias("__seen"))
    return with_rank(seen, [F.col("__seen"), F.col("lat"), F.col("lon")], "__rank").select("lat", "lon", (F.col("__rank") + first).alias("weather_id"))


def grid_cells(points: DataFrame, size: float = 0.25, id_col: str = "location_id", name_col: str = "name") -> DataFrame:
    """One row per cell: its corner, ids, distinct names that aren't empty, mean coordinates and count."""
    snapped = points.withColumns({"cell_lat": F.bround(F.col("lat") / size) * size, "cell_lon": F.bround(F.col("lon") / size) * size})
    names = F.array_sort(F.array_distinct(F.collect_list(F.when(F.col(name_col) != "", F.col(name_col)))))
    return snapped.groupBy("cell_lat", "cell_lon").agg(
        F.array_sort(F.collect_list(id_col)).alias("ids"), names.alias("names"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n")
    )


def close(a: Column, b: Column, atol: float = 1e-5, rtol: float = 1e-5) -> Column:
    """Whether two arrays have the same length and elements within tolerance of each other; missing equals missing."""
    # NaN and null count alike
    bare = lambda x: F.when(~F.isnan(x), x)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(bare(x) - bare(y)) <= atol + rtol * F.abs(bare(y)), bare(x).isNull() & bare(y).isNull()))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda ok: ok)


def compare_spans(left: DataFrame, right: DataFrame, atol: float = 1e-5) -> DataFrame:
    """(check, passed, n): coordinates that one side lacks, spans that differ in start or length, and in values.

    Both sides are spans (lat, lon, start_time, sample_interval_s, num_values, values); spans are matched by rank within their place.
    """

    def ranked(x: DataFrame, s: str) -> DataFrame:
        rows = x.withColumn("key", coordinate_key(F.col("lat"), F.col("lon"))).withColumn("__b", bucket_of(F.col("start_time"), 90 * 86400))
        rows = running(rows, ["key"], "__b", ["start_time", "num_values"], sums={"rank": F.lit(1).cast("long")})
        return rows.select("key", "rank", *(F.col(c).alias(f"{c}_{s}") for c in ("start_time", "num_values", "sample_interval_s", "values")))

    # read for places and for spans
    a, b = written(ranked(left, "a")), written(ranked(right, "b"))
    places = a.select("key").distinct().withColumn("in_a", F.lit(1)).join(b.select("key").distinct().withColumn("in_b", F.lit(1)), "key", "full")
    shared = places.where("in_a = 1 AND in_b = 1").select("key")
    joined = a.join(b, ["key", "rank"], "full").join(shared, "key", "left_semi")
    same = F.coalesce((F.col("start_time_a") == F.col("start_time_b")) & (F.col("num_values_a") == F.col("num_values_b")), F.lit(False))
    step = F.coalesce(F.col("sample_interval_s_a") == F.col("sample_interval_s_b"), F.lit(False))
    checks = joined.agg(F.count_if(~same).alias("span"), F.count_if(same & ~step).alias("interval"), F.count_if(same & ~close(F.col("values_a"), F.col("values_b"), atol)).alias("value"))
    counts = places.agg(F.count_if(F.col("in_b").isNull()).alias("only_left"), F.count_if(F.col("in_a").isNull()).alias("only_right"))
    wide = checks.crossJoin(counts)
    each = F.array(*(F.struct(F.lit(c).alias("check"), (F.col(c) == 0).alias("passed"), F.col(c).alias("n")) for c in ("only_left", "only_right", "span", "interval", "value")))
    return wide.select(F.inline(each))
