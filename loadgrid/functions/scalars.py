"""Scalar functions on columns: time, ids, labels of a release, features of time and place."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

UNITS = ("P", "I", "X")
MEASUREMENT_TYPES = ("pseudo_aggregate", "native_aggregate")
EARTH_KM = 6371.0088
DAY, YEAR = 86400.0, 365.25 * 86400.0
#: The time from which the trend feature counts, and its range in years.
TREND_FROM, TREND_HALF_RANGE = 1325376000.0, 6.5
CENTRE_LAT, CENTRE_LON = 52.15, 5.25


def to_unix(ts: Column) -> Column:
    """Unix seconds of a timestamp; a time without zone counts as UTC under a UTC session."""
    return F.unix_seconds(ts.cast("timestamp"))


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def uniform(seed: int, *keys) -> Column:
    """A number from [0, 1) that depends on seed and keys alone: the first 48 bits of an MD5 sum."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


#: Rounds of a shuffle, and how often a number is moved on at most until it is within bounds.
ROUNDS, WALKS = 6, 64


#: Numbers of a side of the network up to which a task keeps the hashes that it has made (8 MB for each round).
KEPT = 1 << 20


def shuffled(number: Column, n: int, seed: int, back: bool = False) -> Column:
    """The place of a number from [0, n) in a shuffle of all of them; with back, the number at a place.

    A Feistel network over pairs (number % a, number // a) of about the root of n each: every round moves one of the two
    by a hash of the other (48 bits of an MD5 sum of seed, round and number), which can be undone. Pairs beyond n are sent
    through it again until they are within, which keeps it one to one. So a row's place takes no sort, and any batch can be
    read by itself. A round has as many different hashes as the root of n, so they are made once a task.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    order = range(ROUNDS)[::-1] if back else range(ROUNDS)
    sign = -1 if back else 1
    kept: dict[int, np.ndarray] = {}

    def made(k: int, x: np.ndarray) -> np.ndarray:
        return np.array([int(hashlib.md5(f"{seed}:{k}:{v}".encode()).hexdigest()[:12], 16) for v in x.tolist()], dtype=np.int64)

    def mixed(k: int, x: np.ndarray) -> np.ndarray:
        if max(a, b) > KEPT:
            own, inverse = np.unique(x, return_inverse=True)
            return made(k, own)[inverse]
        known = kept.setdefault(k, np.full(max(a, b), -1, dtype=np.int64))
        fresh = np.unique(x[known[x] < 0])
        known[fresh] = made(k, fresh)
        return known[x]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x % a, x // a
        for k in order:
            if k % 2 == 0:
                left = (left + sign * (mixed(k, right) % a)) % a
            else:
                right = (right + sign * (mixed(k, left) % b)) % b
        return right * a + left

    def places(numbers: pa.Array) -> pa.Array:
        if numbers.null_count:
            raise ValueError("no place found")
        x = once(numbers.to_numpy(zero_copy_only=False))
        # fewer than a of a * b numbers are beyond n
        for _ in range(min(WALKS, a * b - n)):
            beyond = np.flatnonzero(x >= n)
            if not len(beyond):
                break
            x[beyond] = once(x[beyond])
        if (x >= n).any():
            raise ValueError("no place found")
        return pa.array(x)

    # so declared, it is evaluated once, however often its column is used
    return F.arrow_udf(places, "long").asNondeterministic()(number.cast("long"))


def location_id(name: Column) -> Column:
    """The first four bytes of the name's SHA-256, little-endian, without the sign bit. Null stays null."""
    h = F.sha2(name, 256)
    little = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(little, 16, 10).cast("long").bitwiseAND(F.lit(2**31 - 1))


def name_ids(names: DataFrame, name_col: str = "name", id_col: str = "location_id") -> DataFrame:
    """Distinct names with their ids. Ids have 31 bits, so that of some 50,000 names two are likely to share one."""
    return names.select(name_col).distinct().withColumn(id_col, location_id(F.col(name_col)))


def checked_ids(names: DataFrame, name_col: str = "name", id_col: str = "location_id") -> DataFrame:
    """name_ids(), raising if two names share an id: for uses that take ids as keys."""
    ids = name_ids(names, name_col, id_col)
    bad = F.count("*").over(Window.partitionBy(id_col)) > 1
    return ids.withColumn("__bad", bad).select(name_col, F.when(F.col("__bad"), F.raise_error(F.concat(F.lit("two names share id "), F.col(id_col).cast("string")))).otherwise(F.col(id_col)).cast("long").alias(id_col))


def pack(location: Column, seconds: Column) -> Column:
    return F.shiftleft(location.cast("long"), 32) + seconds


def packed_location(key: Column) -> Column:
    return F.shiftright(key, 32)


def packed_time(key: Column) -> Column:
    return key.bitwiseAND(F.lit(2**32 - 1))


def sensor_unit(value: Column) -> Column:
    unit = F.upper(F.trim(value))
    return F.when(unit.isin(*UNITS), unit).otherwise("X")


def measurement_type(value: Column, is_total: Column, is_aggregated: Column) -> Column:
    named = F.translate(F.lower(F.trim(value)), "- ", "__")
    flagged = F.coalesce(is_total, F.lit(False)) | F.coalesce(is_aggregated, F.lit(False))
    return F.when(named.isin(*MEASUREMENT_TYPES), named).when(flagged, "native_aggregate").otherwise("pseudo_aggregate")


def public_name(name: Column, kind: Column, location: Column) -> Column:
    """A name that gives no place away: prefixed ones stay, others are made of type and id."""
    bare = F.trim(name)
    safe = bare.startswith("pseudo_aggregate_") | bare.startswith("native_aggregate_")
    return F.when(safe, bare).otherwise(F.concat(kind, F.lit("_"), F.when(location < 100000, F.lpad(location.cast("string"), 5, "0")).otherwise(location.cast("string"))))


def tolerant(value: Column, kind: str) -> Column:
    """value as that type; what can't be read is null."""
    return value.try_cast(kind)


def cycle(seconds: Column, period: float) -> tuple[Column, Column]:
    angle = F.pmod(seconds.cast("double"), F.lit(period)) * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def time_features(seconds: Column) -> list[Column]:
    """Sine and cosine of the day, of three weeks and of the year, and the trend."""
    named = []
    for name, period in (("day", DAY), ("weeks", 21 * DAY), ("year", YEAR)):
        s, c = cycle(seconds, period)
        named += [s.alias(f"sin_{name}"), c.alias(f"cos_{name}")]
    trend = F.tanh(((seconds - TREND_FROM) / YEAR - TREND_HALF_RANGE) / TREND_HALF_RANGE)
    return [*named, trend.alias("trend")]


def centred(lat: Column, lon: Column) -> tuple[Column, Column]:
    return lat - CENTRE_LAT, lon - CENTRE_LON


def coordinate_key(lat: Column, lon: Column) -> Column:
    """Both rounded to six digits, as one key; null if either is."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(F.bround(lat, 6).alias("lat"), F.bround(lon, 6).alias("lon")))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    r = F.radians
    h = F.sin((r(lat2) - r(lat1)) / 2) ** 2 + F.cos(r(lat1)) * F.cos(r(lat2)) * F.sin((r(lon2) - r(lon1)) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) ** 2 + (lon1 - lon2) ** 2) * 111.0


def feature_names(available: list[str], wanted: list[str] | None = None, target: str | None = None, kind: str = "series") -> list[str]:
    """Ordered feature names of a source: the wanted ones, else all; of a time source its three. The target is left out."""
    names = ["unixtime", "latitude", "longitude"] if kind == "time" else list(wanted if wanted is not None else available)
    missing = [n for n in names if kind != "time" and n not in available]
    if missing:
        raise ValueError(f"unknown features: {missing}")
    return [n for n in names if n != target]


def symmetric_bands(forecast: DataFrame, keys: list[str], quantile: str = "quantile", value: str = "value") -> DataFrame:
    """Rows (keys, low, high, lower, upper) for each pair of quantiles (q, 1 - q) with q < 1 / 2."""
    q = F.round(F.col(quantile), 6)
    low = forecast.where(q < 0.5).select(*keys, F.round(1 - q, 6).alias("high"), q.alias("low"), F.col(value).alias("lower"))
    high = forecast.where(q > 0.5).select(*keys, q.alias("high"), F.col(value).alias("upper"))
    return low.join(high, [*keys, "high"]).select(*keys, "low", "high", "lower", "upper")
