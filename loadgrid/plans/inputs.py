"""Tables and derived inputs of the registered queries, for Spark and as SQL.

events are taken as irregular measurements of a user: averaged to a 15-minute grid they are samples, and each event also
opens an interval of hours. Suppliers and nations get coordinates that are derived from their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadgrid.functions.scalars import to_unix

STEP = 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("t", to_unix(F.col("ts")))


EVENTS = "e AS (SELECT *, epoch_us(ts) // 1000000 AS t FROM events)"


def set_all(spark, d) -> DataFrame:
    """Six hours from each event."""
    return events(spark, d).select(F.col("user_id").alias("location_id"), F.col("t").alias("start"), (F.col("t") + 21600).alias("stop"))


def set_a(spark, d) -> DataFrame:
    """Six hours from each event but every third."""
    return events(spark, d).where("event_id % 3 <> 0").select(F.col("user_id").alias("location_id"), F.col("t").alias("start"), (F.col("t") + 21600).alias("stop"))


def set_b(spark, d) -> DataFrame:
    """Two hours from every third event."""
    return events(spark, d).where("event_id % 3 = 0").select(F.col("user_id").alias("location_id"), F.col("t").alias("start"), (F.col("t") + 7200).alias("stop"))


SETS = f"""{EVENTS},
w AS (SELECT user_id AS location_id, t AS start, t + 21600 AS stop FROM e),
a AS (SELECT user_id AS location_id, t AS start, t + 21600 AS stop FROM e WHERE event_id % 3 <> 0),
b AS (SELECT user_id AS location_id, t AS start, t + 7200 AS stop FROM e WHERE event_id % 3 = 0)"""


def sweep(name: str, a: str, keep: str, b: str | None = None) -> str:
    """SQL of clean intervals where keep holds, over counts x of open intervals of a and y of those of b."""
    rows = [f"SELECT location_id, start AS t, 1 AS da, 0 AS db FROM {a} WHERE stop > start UNION ALL SELECT location_id, stop, -1, 0 FROM {a} WHERE stop > start"]
    if b:
        rows.append(f"SELECT location_id, start, 0, 1 FROM {b} WHERE stop > start UNION ALL SELECT location_id, stop, 0, -1 FROM {b} WHERE stop > start")
    return f"""{name}_n AS (SELECT location_id, t, sum(da) AS da, sum(db) AS db FROM ({' UNION ALL '.join(rows)}) GROUP BY 1, 2),
{name}_r AS (SELECT location_id, t, sum(da) OVER w AS x, sum(db) OVER w AS y FROM {name}_n WINDOW w AS (PARTITION BY location_id ORDER BY t)),
{name}_k AS (SELECT location_id, t, ({keep}) AS k, coalesce(lag({keep}) OVER (PARTITION BY location_id ORDER BY t), false) AS p FROM {name}_r),
{name} AS (SELECT location_id, t::BIGINT AS start, stop::BIGINT AS stop FROM (SELECT location_id, t, k, lead(t) OVER (PARTITION BY location_id ORDER BY t) AS stop FROM {name}_k WHERE k <> p) WHERE k)"""


def samples(spark, d, key: str = "event_type", step: int = STEP) -> DataFrame:
    """(location, ts, value) on a grid of step seconds."""
    e = events(spark, d)
    return e.groupBy(F.col(key).alias("location"), (F.col("t") - F.pmod("t", F.lit(step))).alias("ts")).agg(F.avg("value").alias("value"))


def samples_sql(key: str = "event_type", name: str = "s") -> str:
    return f"{name} AS (SELECT {key} AS location, t - t % {STEP} AS ts, avg(value) AS value FROM e GROUP BY 1, 2)"


def uniform_sql(seed: int, *keys: str) -> str:
    """SQL of scalars.uniform()."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def erf_sql(z: str) -> str:
    """SQL of the error function of a column, by a series of positive terms; beyond 6 it is 1 to double precision."""
    term = f"exp((2 * n + 1) * ln(abs({z})) - {z} * {z} + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2))"
    return f"CASE WHEN {z} = 0 THEN 0.0 WHEN abs({z}) > 6 THEN sign({z}) ELSE sign({z}) * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda n: {term})) END"


def reached_sql(x: str, rows: str) -> str:
    """SQL that adds reached, the distribution of mixtures (w1, s1, m1, w2, s2, m2) at x, to the rows of a table."""
    z = ", ".join(f"({x} - m{i} - 1e-6) / ((s{i} + 1e-6) * sqrt(2)) AS z{i}" for i in (1, 2))
    parts = " + ".join(f"(w{i} + 1e-6) / (w1 + w2 + 2e-6) * 0.5 * (1 + {erf_sql(f'z{i}')})" for i in (1, 2))
    return f"SELECT *, {parts} AS reached FROM (SELECT *, {z} FROM {rows})"


def quantiles_sql(name: str, rows: str, keys: str, levels: list[float], n: int = 1000) -> str:
    """SQL, to follow WITH RECURSIVE, of the first of n values between low and high at which mixtures reach each level, by bisection."""
    fixed = f"{keys}, quantile, low, high, w1, s1, m1, w2, s2, m2"
    return f"""{name}_b AS (SELECT {fixed}, 0 AS a, {n - 1} AS z, 0 AS k FROM {rows}, (SELECT unnest({levels}::DOUBLE[]) AS quantile)
UNION ALL SELECT {fixed}, CASE WHEN a < z AND reached < quantile THEN m + 1 ELSE a END, CASE WHEN a < z AND reached >= quantile THEN m ELSE z END, k + 1
FROM ({reached_sql('x0', f"(SELECT *, (a + z) // 2 AS m, low + (a + z) // 2 * ((high - low) / {n - 1}) AS x0 FROM {name}_b WHERE k < {(n - 1).bit_length()})")})),
{name} AS (SELECT {keys}, quantile, low + a * ((high - low) / {n - 1}) AS value FROM {name}_b WHERE k = {(n - 1).bit_length()})"""


def shuffled_sql(name: str, rows: str, number: str, n: str, seed: int, rounds: int = 6) -> str:
    """SQL, to follow WITH RECURSIVE, of scalars.shuffled(): rows (number, spot) with the place of each number among n."""

    def once(src: str) -> str:
        out = f"SELECT *, spot % a AS l, spot // a AS r FROM {src}"
        for k in range(rounds):
            own, other, base = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
            moved = f"({own} + ('0x' || substr(md5('{seed}:{k}:' || {other}), 1, 12))::BIGINT % {base}) % {base}"
            out = f"SELECT {number}, a, b, n, {other}, {moved} AS {own} FROM ({out})"
        return f"SELECT {number}, a, b, n, r * a + l AS spot FROM ({out})"

    return f"""{name}_0 AS (SELECT {number}, a, (n + a - 1) // a AS b, n, {number} AS spot FROM (SELECT {number}, (SELECT {n})::BIGINT AS n, (floor(sqrt((SELECT {n}) - 1)) + 1)::BIGINT AS a FROM {rows})),
{name}_w AS ({once(f'{name}_0')} UNION ALL {once(f"(SELECT {number}, a, b, n, spot FROM {name}_w WHERE spot >= n)")}),
{name} AS (SELECT {number}, spot FROM {name}_w WHERE spot < n)"""


def place(key: Column, lat_step: int, lon_step: int) -> tuple[Column, Column]:
    return 50 + (key * lat_step % 400) / 100.0, 4 + (key * lon_step % 300) / 100.0


def sites(spark, d) -> DataFrame:
    """Suppliers as measuring points."""
    k = F.col("s_suppkey")
    lat, lon = place(k, 37, 53)
    return table(spark, d, "supplier").select(k.alias("location_id"), F.col("s_name").alias("name"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), "s_nationkey", "s_acctbal")


def stations(spark, d) -> DataFrame:
    """Nations as weather points."""
    k = F.col("n_nationkey").cast("long")
    lat, lon = place(k, 61, 83)
    return table(spark, d, "nation").select(k.alias("weather_id"), lat.cast("double").alias("w_lat"), lon.cast("double").alias("w_lon"))


SITES = "si AS (SELECT s_suppkey AS location_id, s_name AS name, 50 + (s_suppkey * 37 % 400)::DOUBLE / 100.0 AS lat, 4 + (s_suppkey * 53 % 300)::DOUBLE / 100.0 AS lon, s_nationkey, s_acctbal FROM supplier)"
STATIONS = "st AS (SELECT n_nationkey::BIGINT AS weather_id, 50 + (n_nationkey * 61 % 400)::DOUBLE / 100.0 AS w_lat, 4 + (n_nationkey * 83 % 300)::DOUBLE / 100.0 AS w_lon FROM nation)"
