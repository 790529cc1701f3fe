"""Registered queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadgrid.operators import intervals as iv
from loadgrid.plans.inputs import SETS, events, set_a, set_all, set_b, sweep, uniform_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _with(*parts: str, select: str) -> str:
    return f"WITH {SETS}, " + ", ".join(parts) + " " + select if parts else f"WITH {SETS} {select}"


#: Clean sets: of all events, and of those that are not in the other set.
CLEAN, CLEAN_A = sweep("c", "w", "x > 0"), sweep("c", "a", "x > 0")
ALL = "SELECT location_id, start, stop FROM r"

query("c1_clean", _with(sweep("r", "w", "x > 0"), select=ALL))(lambda s, d: iv.clean(set_all(s, d)))
query("c2_union", _with(sweep("r", "a", "x > 0 OR y > 0", "b"), select=ALL))(lambda s, d: iv.union(set_a(s, d), set_b(s, d)))
query("c3_subtract", _with(sweep("r", "a", "x > 0 AND y = 0", "b"), select=ALL))(lambda s, d: iv.subtract(set_a(s, d), set_b(s, d)))
query("c4_intersect", _with(sweep("r", "a", "x > 0 AND y > 0", "b"), select=ALL))(lambda s, d: iv.intersect(set_a(s, d), set_b(s, d)))

LOW, HIGH = 1704600000, 1705300000
query("c5_clip", _with(CLEAN, select=f"SELECT location_id, greatest(start, {LOW}) AS start, least(stop, {HIGH}) AS stop FROM c WHERE start < {HIGH} AND stop > {LOW}"))(
    lambda s, d: iv.clip(iv.clean(set_all(s, d)), LOW, HIGH)
)
query("c6_invert", _with(CLEAN, select=f"""
SELECT location_id, coalesce(lag(stop) OVER (PARTITION BY location_id ORDER BY start), -{2**62}) AS start, start AS stop FROM c
UNION ALL SELECT location_id, max(stop), {2**62} FROM c GROUP BY location_id"""))(lambda s, d: iv.invert(set_all(s, d)))
query("c7_add_duration", _with("m AS (SELECT location_id, start, stop - 9000 AS stop FROM w)", sweep("r", "m", "x > 0"), select=ALL))(lambda s, d: iv.add_duration(set_all(s, d), -9000))
query("c8_align", _with(CLEAN, "m AS (SELECT location_id, (start + 3599) // 3600 * 3600 AS start, stop // 3600 * 3600 AS stop FROM c)", sweep("r", "m", "x > 0"), select=ALL))(
    lambda s, d: iv.align(iv.clean(set_all(s, d)), 3600, tidy=True)
)
query("c9_align_start", _with(CLEAN, "m AS (SELECT location_id, (start - 900 + 21599) // 21600 * 21600 + 900 AS start, stop FROM c)", sweep("r", "m", "x > 0"), select=ALL))(
    lambda s, d: iv.align_start(iv.clean(set_all(s, d)), 21600, 900, tidy=True)
)
query("c10_indexable", _with(
    "m AS (SELECT location_id, start, stop - 14400 AS stop FROM a)", "n AS (SELECT location_id, start - 14401 AS start, stop - 14401 + 3599 AS stop FROM b)",
    sweep("r", "m", "x > 0 AND y = 0", "n"), select=ALL,
))(lambda s, d: iv.indexable(set_a(s, d), set_b(s, d), 10800, 3600))


def spans(s, d):
    """Clean intervals as spans of 15-minute samples."""
    c = iv.align(iv.clean(set_a(s, d)), 900, tidy=True)
    return c.select("location_id", F.col("start").alias("start_time"), F.lit(900).alias("sample_interval_s"), ((F.col("stop") - F.col("start")) / 900).cast("long").alias("num_values"))


SPANS = f"{CLEAN_A}, m9 AS (SELECT location_id, (start + 899) // 900 * 900 AS start, stop // 900 * 900 AS stop FROM c), {sweep('g', 'm9', 'x > 0')}"
query("c11_to_intervals", _with(SPANS, select="SELECT location_id, start, stop FROM g"))(lambda s, d: iv.of_spans(spans(s, d)))
query("c12_to_spans", _with(SPANS, "h AS (SELECT location_id, greatest(start, 1704600000) AS start, least(stop, 1705320000) AS stop FROM g WHERE start < 1705320000 AND stop > 1704600000)", select="""
SELECT h.location_id, h.start, (h.start - g.start) // 900 AS "offset", (h.stop - h.start) // 900 AS num_values FROM h JOIN g ON g.location_id = h.location_id AND h.start >= g.start AND h.start < g.stop"""))(
    lambda s, d: iv.to_spans(iv.clip(iv.of_spans(spans(s, d)), 1704600000, 1705320000), spans(s, d))
)


def coverage_sql(src: str, length: int, least: int, res: int, out: str = "r") -> str:
    n, m = round(length / res), round(least / res)
    return f"""{out}_e AS (SELECT location_id, t - k * {res} AS t, sum(d) AS d FROM (SELECT location_id, start AS t, 1 AS d FROM {src} UNION ALL SELECT location_id, stop, -1 FROM {src}), (SELECT unnest(range(0, {n})) AS k) GROUP BY 1, 2),
{out}_v AS (SELECT location_id, t, sum(d) OVER w AS n, lead(t) OVER w AS nx FROM {out}_e WINDOW w AS (PARTITION BY location_id ORDER BY t)),
{out}_u AS (SELECT location_id, t AS start, nx + {res} + 1 AS stop FROM {out}_v WHERE n >= {m} AND nx IS NOT NULL UNION ALL SELECT location_id, start, stop - {least} FROM {src}),
{sweep(out, f'{out}_u', 'x > 0')}"""


GAPS = """gp AS (SELECT location_id, stop AS start, lead(start) OVER (PARTITION BY location_id ORDER BY start) AS stop FROM c),
gu AS (SELECT location_id, start, stop FROM c UNION ALL SELECT location_id, start, stop FROM gp WHERE stop - start <= 21600)"""
query("c13_fill_gaps", _with(CLEAN, GAPS, sweep("f", "gu", "x > 0"), coverage_sql("f", 86400, 51840, 4320), select=ALL))(lambda s, d: iv.fill_gaps(set_all(s, d), 6, 1, 0.6))
query("c14_coverage", _with(CLEAN, coverage_sql("c", 172800, 60000, 8640), select=ALL))(lambda s, d: iv.with_coverage(iv.clean(set_all(s, d)), 172800, 60000, 8640))


def exact_sql(src: str, length: int, least: int, out: str = "r") -> str:
    """SQL of starts with enough coverage: slopes summed to a piecewise linear function, cut where it is high enough."""
    return f"""{out}_e AS (SELECT location_id, t, sum(d) AS d FROM (SELECT location_id, start - {length} AS t, 1 AS d FROM {src} UNION ALL SELECT location_id, stop - {length}, -1 FROM {src}
UNION ALL SELECT location_id, start, -1 FROM {src} UNION ALL SELECT location_id, stop, 1 FROM {src}) GROUP BY 1, 2),
{out}_s AS (SELECT *, sum(d) OVER o AS k, lead(t) OVER o AS nx FROM {out}_e WINDOW o AS (PARTITION BY location_id ORDER BY t)),
{out}_f AS (SELECT *, coalesce(sum(k * (nx - t)) OVER (PARTITION BY location_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM {out}_s),
{out}_p AS (SELECT location_id, (CASE WHEN k = 1 THEN greatest(t, t + {least} - f) ELSE t END)::BIGINT AS start, (CASE WHEN k = -1 THEN least(nx, t + f - {least} + 1) ELSE nx END)::BIGINT AS stop FROM {out}_f WHERE nx IS NOT NULL AND (k = 1 OR f >= {least})),
{sweep(out, f'{out}_p', 'x > 0')}"""


query("c13_fill_gaps_exact", _with(CLEAN, GAPS, sweep("f", "gu", "x > 0"), exact_sql("f", 86400, 51840), select=ALL))(lambda s, d: iv.fill_gaps(set_all(s, d), 6, 1, 0.6, exact=True))
query("c14_coverage_exact", _with(CLEAN, exact_sql("c", 172800, 60000), select=ALL))(lambda s, d: iv.covered_starts(set_all(s, d), 172800, 60000))
query("c15_all_points", _with(CLEAN, "m AS (SELECT location_id, (start + 3599) // 3600 * 3600 AS start, stop // 3600 * 3600 AS stop FROM c)", sweep("r", "m", "x > 0"), select="SELECT location_id, unnest(range(start, stop + 1, 3600)) AS t FROM r"))(
    lambda s, d: iv.all_points(iv.clean(set_all(s, d)), 3600, tidy=True)
)
STARTS = "m AS (SELECT location_id, (start - 900 + 3599) // 3600 * 3600 + 900 AS start, stop FROM c)"
query("c16_window_starts", _with(CLEAN, STARTS, sweep("r", "m", "x > 0"), select="SELECT location_id, unnest(range(start, stop, 3600)) AS t FROM r"))(lambda s, d: iv.window_starts(iv.clean(set_all(s, d)), 3600, 900, tidy=True))
query("c16_count_starts", _with(CLEAN, STARTS, sweep("r", "m", "x > 0"), select="SELECT location_id, sum(len(range(start, stop, 3600)))::BIGINT AS n FROM r GROUP BY 1"))(
    lambda s, d: iv.count_starts(iv.clean(set_all(s, d)), 3600, 900, tidy=True)
)
DRAWN = f"""{CLEAN}, pt AS (SELECT *, sum(stop - start) OVER (ORDER BY location_id, start) AS upto FROM c), tt AS (SELECT max(upto)::BIGINT AS total FROM pt),
dw AS (SELECT k AS draw, floor({uniform_sql(7, "'interval'", 'k')} * total)::BIGINT AS u FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS k), tt),
fd AS (SELECT draw, location_id, (start + 899) // 900 * 900 AS low, stop // 900 * 900 AS high FROM dw ASOF JOIN (SELECT *, (upto - (stop - start))::BIGINT AS base FROM pt) x ON u >= base)"""
query("c17_sample_points", _with(DRAWN, select=f"SELECT draw, location_id, low + (floor({uniform_sql(7, chr(39) + 'point' + chr(39), 'draw')} * greatest(high - low, 0) / 900) * 900)::BIGINT AS t FROM fd"))(lambda s, d: iv.sample_points(set_all(s, d), s.read.parquet(f"{d}/events.parquet").count(), 900, 7))


def points(s, d):
    return events(s, d).select(F.col("user_id").alias("location_id"), "t", "event_id")


POINTS = "p AS (SELECT user_id AS location_id, t, event_id FROM e)"
query("c18_covered", _with(CLEAN_A, POINTS, select="SELECT p.location_id, p.t, p.event_id, c.start IS NOT NULL AS inside FROM p LEFT JOIN c ON c.location_id = p.location_id AND p.t >= c.start AND p.t < c.stop"))(
    lambda s, d: iv.covered(points(s, d), iv.clean(set_a(s, d)))
)
query("c19_overlaps", _with(select="""SELECT location_id, start, previous_stop FROM (SELECT location_id, start, max(stop) OVER (PARTITION BY location_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_stop FROM w) WHERE start < previous_stop"""))(
    lambda s, d: iv.overlaps(set_all(s, d))
)
query("c20_overlapping", _with(CLEAN, select=f"SELECT location_id, start, stop FROM c WHERE start < {HIGH} AND stop > {LOW}"))(lambda s, d: iv.overlapping(iv.clean(set_all(s, d)), LOW, HIGH))
query("d3_locate", _with(SPANS, POINTS, select="SELECT p.location_id, p.t, p.event_id, coalesce((p.t - g.start) // 900, -1)::BIGINT AS index FROM p LEFT JOIN g ON g.location_id = p.location_id AND p.t >= g.start AND p.t < g.stop"))(
    lambda s, d: iv.to_index(points(s, d), spans(s, d))
)
query("d7_common", _with(sweep("u", "a", "x > 0 OR y > 0", "b"), "v AS (SELECT user_id AS location_id, t - 86400 AS start, t + 3600 AS stop FROM e WHERE event_type = 'view')", sweep("r", "u", "x > 0 AND y > 0", "v"), select=ALL))(
    lambda s, d: iv.common([[set_a(s, d), set_b(s, d)], [events(s, d).where("event_type = 'view'").select(F.col("user_id").alias("location_id"), (F.col("t") - 86400).alias("start"), (F.col("t") + 3600).alias("stop"))]])
)
query("b4_lengths", _with(CLEAN, select="SELECT location_id, start, stop, stop - start AS length FROM c"))(lambda s, d: iv.lengths(iv.clean(set_all(s, d))))
query("b10_year", _with(sweep("y", "w", "x > 0"), "m AS (SELECT location_id, greatest(start, 1704067200) AS start, least(stop, 1735689600) AS stop FROM y)", sweep("r", "m", "x > 0"), select=ALL))(lambda s, d: iv.in_year(set_all(s, d), 2024))
query("b10_from_date", _with("m AS (SELECT location_id, greatest(start, 1705000000) AS start, stop FROM w)", sweep("r", "m", "x > 0"), select=ALL))(lambda s, d: iv.from_date(set_all(s, d), 1705000000))
query("b9_split_locations", _with(select="SELECT location_id, start, stop, location_id % 7 = 0 AS listed FROM w"))(
    lambda s, d: (lambda pair: pair[0].withColumn("listed", F.lit(True)).unionByName(pair[1].withColumn("listed", F.lit(False))))(
        iv.split_locations(set_all(s, d), set_all(s, d).where("location_id % 7 = 0"))
    )
)
