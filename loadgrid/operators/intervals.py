"""Set algebra on half-open intervals [start, stop) per location.

All sets are DataFrames (location_id, start, stop) of longs; times are Unix seconds. A sweep sees starts and stops of any number of sets as
events, summed where they fall together, with a counter for each set, and keeps a condition on the counters; so jobs of
several set operations are one pass over the events. Its windows see a location's bucket of BUCKET seconds, counts being
carried from bucket to bucket, so that no task gets all of a location, unless the whole table is small. Results are
clean: sorted out, disjoint and not adjacent. Rows with a null are no intervals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.functions.scalars import location_id, uniform
from loadgrid.operators.running import bucket_of, in_one_task, running, tasks_of
from loadgrid.operators.tables import written

LOC, START, STOP = "location_id", "start", "stop"
FAR = 2**62
#: Seconds of a location that one task sweeps at a time.
BUCKET = 86400
#: Ranges into which the sum of all lengths is cut for draws.
PARTS = 4096


def _events(x: DataFrame, **steps: int) -> DataFrame:
    """Starts and stops of x as events (location_id, t, ...): each named counter goes up by its step at a start and down at a stop."""
    real = x.where(F.col(STOP) > F.col(START))
    ends = F.array(*(F.struct(F.col(c).alias("t"), *(F.lit(sign * step).cast("long").alias(n) for n, step in steps.items())) for c, sign in ((START, 1), (STOP, -1))))
    return real.select(LOC, F.inline(ends))


def _turns(events: DataFrame, counters: list[str], turn: Callable[[dict, dict, Column], tuple[Column, Column, Column]], times: int = 1) -> tuple[DataFrame, bool]:
    """(location_id, t, begins): where a condition on running sums of counters begins or ends to hold; and whether they
    are dealt by bucket too, as running() takes it. times: events of a row that Spark's estimate doesn't count.

    turn(before, own, previous) gets the sums before an event, what the event itself adds, and the time of the event
    before it, and gives whether there is a turn, its time, and whether the condition begins to hold.
    """
    dealt = events.withColumn("__b", bucket_of(F.col("t"), BUCKET))
    # dealt out once for the sums and the windows
    tasks, split = tasks_of(events, times), not in_one_task(events)
    dealt = dealt.repartition(tasks, LOC, "__b") if split else dealt.repartition(tasks, LOC)
    net = dealt.groupBy(LOC, "__b", "t").agg(*(F.sum(c).alias(c) for c in counters)).where(" OR ".join(f"{c} <> 0" for c in counters))
    sums = {f"__{c}": F.col(c) for c in counters}
    rows = running(net, [LOC], "__b", ["t"], sums=sums, lasts={"__previous": F.col("t")}, own=False, tasks=tasks, dealt=split)
    there, t, begins = turn({c: F.col(f"__{c}") for c in counters}, {c: F.col(c) for c in counters}, F.col("__previous"))
    return rows.where(there).select(LOC, "__b", t.cast("long").alias("t"), begins.alias("begins")), split


def _held(turns: DataFrame, split: bool) -> DataFrame:
    """The intervals between turns that begin and those that follow: each end knows the last beginning before it."""
    found = running(turns, [LOC], "__b", ["t"], lasts={START: F.when(F.col("begins"), F.col("t"))}, dealt=split).where(~F.col("begins"))
    return found.select(LOC, START, F.col("t").alias(STOP))


def _where(keep: Callable[..., Column]):
    """A turn where keep of the counters changes, at the event itself."""

    def turn(before: dict, own: dict, previous: Column):
        was, now = keep(*before.values()), keep(*(before[c] + own[c] for c in before))
        return was != now, F.col("t"), now

    return turn


def sweep(sets: list[DataFrame], keep: Callable[..., Column]) -> DataFrame:
    """Clean intervals where keep holds of the numbers of open intervals of each set: one pass over the events of all,
    whatever the condition and however many sets. Sets need not be clean; keep must not hold where all numbers are 0."""
    names = [f"n{k}" for k in range(len(sets))]
    events = [_events(x, **{n: int(k == j) for j, n in enumerate(names)}) for k, x in enumerate(sets)]
    return _held(*_turns(reduce(DataFrame.unionByName, events), names, _where(keep)))


def sweep_parts(sets: list[DataFrame], keeps: dict[str, Callable[..., Column]]) -> DataFrame:
    """(part, location_id, start, stop): sweep() of several conditions on the same sets at once, named by part."""
    names = [f"n{k}" for k in range(len(sets))]
    events = reduce(DataFrame.unionByName, [_events(x, **{n: int(k == j) for j, n in enumerate(names)}) for k, x in enumerate(sets)])
    states = list(keeps)

    def turn(before: dict, own: dict, previous: Column):
        # the parts that change, with whether they begin
        changes = []
        for p in states:
            was, now = keeps[p](*before.values()), keeps[p](*(before[c] + own[c] for c in before))
            changes.append(F.when(was != now, F.struct(F.lit(p).alias("part"), now.alias("begins"))))
        changed = F.array_compact(F.array(*changes))
        return F.size(changed) > 0, F.col("t"), changed

    turns, split = _turns(events, names, turn)
    turns = turns.select(LOC, "__b", "t", F.inline("begins"))
    # dealt by location, so by part and location too
    found = running(turns, ["part", LOC], "__b", ["t"], lasts={START: F.when(F.col("begins"), F.col("t"))}, dealt=split).where(~F.col("begins"))
    return found.select("part", LOC, START, F.col("t").alias(STOP))


def clean(a: DataFrame) -> DataFrame:
    """Drops empty and reversed intervals and merges those that overlap or touch."""
    return sweep([a], lambda x: x > 0)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return clean(a.select(LOC, START, STOP).unionByName(b.select(LOC, START, STOP)))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep([a, b], lambda x, y: (x > 0) & (y == 0))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep([a, b], lambda x, y: (x > 0) & (y > 0))


def clip(a: DataFrame, low: int | Column, high: int | Column) -> DataFrame:
    """Each interval within [low, high), those that stay not empty; not merged."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return a.select(LOC, F.greatest(START, low).alias(START), F.least(STOP, high).alias(STOP)).where(F.col(STOP) > F.col(START))


def invert(a: DataFrame) -> DataFrame:
    """The gaps of each location, with open ends at plus and minus 2**62."""
    turns, split = _turns(_events(a, n=1), ["n"], _where(lambda x: x > 0))
    before = running(turns, [LOC], "__b", ["t"], lasts={"ended": F.when(~F.col("begins"), F.col("t"))}, dealt=split).where("begins")
    gaps = before.select(LOC, F.coalesce("ended", F.lit(-FAR)).alias(START), F.col("t").alias(STOP))
    last = turns.groupBy(LOC).agg(F.max("t").alias(START)).select(LOC, START, F.lit(FAR).alias(STOP))
    return gaps.unionByName(last)


def _tidied(moved: DataFrame, tidy: bool) -> DataFrame:
    """Moved intervals, clean again; those of a clean set that only got shorter are so once empty ones go."""
    return moved.where(F.col(STOP) > F.col(START)) if tidy else clean(moved)


def add_duration(a: DataFrame, seconds: int | Column, tidy: bool = False) -> DataFrame:
    """Stops moved by so many seconds. tidy: a is clean and seconds aren't positive, so nothing can meet."""
    return _tidied(a.select(LOC, START, (F.col(STOP) + seconds).alias(STOP)), tidy)


def shift(a: DataFrame, seconds: int) -> DataFrame:
    return a.select(LOC, (F.col(START) + seconds).alias(START), (F.col(STOP) + seconds).alias(STOP))


def bridged(a: DataFrame, seconds: int) -> DataFrame:
    """a with gaps of up to so many seconds filled: stops move out, what meets merges, stops move back."""
    return add_duration(add_duration(a.where(F.col(STOP) > F.col(START)), seconds), -seconds, tidy=True)


def ceil_to(t: Column, step: int) -> Column:
    return t + F.pmod(-t, F.lit(step))


def floor_to(t: Column, step: int) -> Column:
    return t - F.pmod(t, F.lit(step))


def align(a: DataFrame, step: int, tidy: bool = False) -> DataFrame:
    """Starts move up, stops down to multiples of step. tidy: a is clean."""
    return _tidied(a.select(LOC, ceil_to(F.col(START), step).alias(START), floor_to(F.col(STOP), step).alias(STOP)), tidy)


def align_start(a: DataFrame, step: int, phase: int = 0, tidy: bool = False) -> DataFrame:
    """Starts move up to multiples of step plus phase; stops stay. tidy: a is clean."""
    p = phase % step
    return _tidied(a.select(LOC, (ceil_to(F.col(START) - p, step) + p).alias(START), STOP), tidy)


def indexable(a: DataFrame, bad: DataFrame, context: int, predict: int) -> DataFrame:
    """Starts from which context + predict can be read in a, with the predicted part clear of bad: one sweep of moved events."""
    need = context + predict
    readable = a.select(LOC, START, (F.col(STOP) - need).alias(STOP))
    blocked = bad.select(LOC, (F.col(START) - need - 1).alias(START), (F.col(STOP) - need - 1 + predict - 1).alias(STOP))
    return subtract(readable, blocked)


def of_spans(spans: DataFrame, start: str = "start_time", count: str = "num_values", step: str = "sample_interval_s", carry: list[str] | None = None) -> DataFrame:
    """Intervals of spans, with the columns of spans named by carry."""
    return spans.select(LOC, F.col(start).alias(START), (F.col(start) + F.col(count).cast("long") * F.col(step)).alias(STOP), *(carry or []))


def locate(points: DataFrame, a: DataFrame, t: str = "t", carry: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """points with hit_start and hit_stop of the interval of a that holds them, null if none does.

    carry names further columns of a to bring along. a must be disjoint within a location. An as-of join: points and
    starts are sorted together within buckets of so much time, and the last start before a point, in its bucket or one
    before, is its candidate.
    """
    carry = carry or []
    payload = F.struct(F.col(START).alias("hit_start"), F.col(STOP).alias("hit_stop"), *carry)
    left = points.select(F.col(LOC).alias("__loc"), F.col(t).alias("__t"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__row"))
    starts = a.where(F.col(STOP) > F.col(START)).select(F.col(LOC).alias("__loc"), F.col(START).alias("__t"), F.lit(0).alias("__kind"), payload.alias("__iv"))
    both = left.unionByName(starts, allowMissingColumns=True)
    both = both.withColumn("__b", bucket_of(F.col("__t"), bucket))
    found = running(both, ["__loc"], "__b", ["__t", "__kind"], lasts={"__iv": F.col("__iv")}).where("__kind = 1")
    hit = F.when(F.col("__t") < F.col("__iv.hit_stop"), F.col("__iv"))
    return found.select("__row.*", *(hit[c].alias(c) for c in ("hit_start", "hit_stop", *carry)))


def to_index(points: DataFrame, spans: DataFrame, t: str = "t", step: str = "sample_interval_s") -> DataFrame:
    """points with index, the place of the sample in its span that holds t, -1 if none does."""
    named = of_spans(spans.withColumn("__step", F.col(step)), step=step, carry=["__step"])
    found = locate(points, named, t, ["__step"])
    index = F.coalesce(F.floor((F.col(t) - F.col("hit_start")) / F.col("__step")), F.lit(-1)).cast("long")
    return found.withColumn("index", index).drop("hit_start", "hit_stop", "__step")


def covered(points: DataFrame, a: DataFrame, t: str = "t") -> DataFrame:
    """points with inside, whether an interval of a holds them."""
    return locate(points, a, t).withColumn("inside", F.col("hit_start").isNotNull()).drop("hit_start", "hit_stop")


def to_spans(a: DataFrame, spans: DataFrame, step: str = "sample_interval_s") -> DataFrame:
    """Intervals within spans back as rows (location_id, start, offset, num_values): where in the span they lie."""
    found = locate(a, of_spans(spans.withColumn("__step", F.col(step)), step=step, carry=["__step"]), START, ["__step"]).where("hit_start IS NOT NULL")
    samples = lambda seconds: F.floor(seconds / F.col("__step")).cast("long")
    return found.select(LOC, START, samples(F.col(START) - F.col("hit_start")).alias("offset"), samples(F.col(STOP) - F.col(START)).alias("num_values"))


def covered_starts(a: DataFrame, length: int, least: int) -> DataFrame:
    """Points x with at least `least` seconds of [x, x + length) in a, exactly.

    Coverage is a continuous function of x whose slope is 1 where only x + length is in a, -1 where only x is: each
    clean interval changes the slope at its start and stop, and at both less length. With the running sums of these
    changes d and of d * t, coverage at t is t * sum(d) - sum(d * t), and where it crosses `least` between two changes
    follows from the slope. So each interval gives four events, whatever the length.
    """
    c = clean(a)
    if least <= 0:  # from the first change to the last
        ends = c.groupBy(LOC).agg(F.min(START).alias(START), F.max(STOP).alias(STOP))
        return ends.select(LOC, (F.col(START) - length).alias(START), STOP)
    changes = ((F.col(START) - length, 1), (F.col(STOP) - length, -1), (F.col(START), -1), (F.col(STOP), 1))
    events = c.select(LOC, F.inline(F.array(*(F.struct(t.alias("t"), F.lit(d).cast("long").alias("d"), (t * d).alias("dt")) for t, d in changes))))

    def turn(before: dict, own: dict, previous: Column):
        at = lambda t: t * before["d"] - before["dt"]
        was, now = F.coalesce(at(previous), F.lit(0)), at(F.col("t"))
        crossed = F.when(now >= least, previous + (least - was)).otherwise(previous + (was - least) + 1)
        return (was >= least) != (now >= least), crossed, now >= least

    return _held(*_turns(events, ["d", "dt"], turn))


def with_coverage(a: DataFrame, length: int, least: int, resolution: int) -> DataFrame:
    """Points x with at least `least` of [x, x + length) in a, to within resolution: coverage counted at steps of it.

    covered_starts() gives the exact ones, from four events of an interval instead of length / resolution times two.
    """
    shifts = F.sequence(F.lit(0), F.lit((round(length / resolution) - 1) * resolution), F.lit(resolution))
    ends = F.array(F.struct(F.col(START).alias("t"), F.lit(1).alias("d")), F.struct(F.col(STOP).alias("t"), F.lit(-1).alias("d")))
    events = a.select(LOC, F.inline(ends)).withColumn("s", F.explode(shifts)).select(LOC, (F.col("t") - F.col("s")).alias("t"), F.col("d").cast("long").alias("n"))
    wanted = round(least / resolution)
    if wanted > 0:
        rows = _held(*_turns(events, ["n"], _where(lambda n: n >= wanted), max(1, round(length / resolution))))
    else:  # from the first event to the last
        rows = events.groupBy(LOC).agg(F.min("t").alias(START), F.max("t").alias(STOP))
    return union(a.select(LOC, START, (F.col(STOP) - least).alias(STOP)), rows.withColumn(STOP, F.col(STOP) + resolution + 1))


def fill_gaps(a: DataFrame, gap_hours: int, context_days: int, valid_ratio: float, exact: bool = False) -> DataFrame:
    """Starts of contexts with enough data once gaps of up to gap_hours are bridged; coverage to within a twentieth of the context, or exact."""
    context = context_days * 86400
    whole, least = bridged(a, gap_hours * 3600), int(context * valid_ratio)
    return covered_starts(whole, context, least) if exact else with_coverage(whole, context, least, int(context * 0.05))


def all_points(a: DataFrame, step: int, tidy: bool = False) -> DataFrame:
    """(location_id, t): every multiple of step from a's aligned starts to its stops, both included."""
    return align(a, step, tidy).select(LOC, F.explode(F.sequence(START, STOP, F.lit(step).cast("long"))).alias("t"))


def window_starts(a: DataFrame, step: int, phase: int = 0, tidy: bool = False) -> DataFrame:
    """(location_id, t): starts of windows, on multiples of step plus phase, the stop excluded."""
    return align_start(a, step, phase, tidy).select(LOC, F.explode(F.sequence(F.col(START), F.col(STOP) - 1, F.lit(step).cast("long"))).alias("t"))


def count_starts(a: DataFrame, step: int, phase: int = 0, tidy: bool = False) -> DataFrame:
    """(location_id, n): how many starts window_starts() gives, without making them."""
    n = F.floor((F.col(STOP) - F.col(START) - 1) / step) + 1
    return align_start(a, step, phase, tidy).groupBy(LOC).agg(F.sum(n).cast("long").alias("n"))


def sample_points(a: DataFrame, n: int, step: int, seed: int) -> DataFrame:
    """(draw, location_id, t): n draws with replacement, intervals by length, points on multiples of step.

    Lengths are summed per location, then over locations; draws find their location, then their interval, by as-of joins
    on these running sums, in ranges of equal width. A draw's numbers are MD5 sums of seed and draw alone.
    """
    c = clean(a).withColumn("size", F.col(STOP) - F.col(START))
    sized = written(c)
    by_loc = sized.groupBy(LOC).agg(F.sum("size").alias("size")).select(F.lit(0).cast("long").alias("__all"), LOC, "size", F.shiftright(LOC, 16).alias("__b"))
    upto = written(running(by_loc, ["__all"], "__b", [LOC], sums={"upto": F.col("size")}))
    total = upto.agg(F.max("upto")).first()[0] or 0
    draws = a.sparkSession.range(n if total else 0).select(F.col("id").alias("draw")).withColumn("u", F.floor(uniform(seed, F.lit("interval"), F.col("draw")) * total).cast("long"))
    whole = upto.select(F.col("__all").alias(LOC), (F.col("upto") - F.col("size")).alias(START), F.col("upto").alias(STOP), F.col(LOC).alias("own"))
    width = max(1, total // PARTS)
    at_loc = locate(draws.withColumn(LOC, F.lit(0).cast("long")), whole, "u", ["own"], width)
    inside = at_loc.select("draw", F.col("own").alias(LOC), (F.col("u") - F.col("hit_start")).alias("u"))
    ordered = running(sized.withColumn("__b", bucket_of(F.col(START), BUCKET)), [LOC], "__b", [START], sums={"upto": F.col("size")})
    parts = ordered.select(LOC, F.col(START).alias("iv_start"), F.col(STOP).alias("iv_stop"), (F.col("upto") - F.col("size")).alias(START), F.col("upto").alias(STOP))
    drawn = locate(inside, parts, "u", ["iv_start", "iv_stop"], width)
    first, last = ceil_to(F.col("iv_start"), step), floor_to(F.col("iv_stop"), step)
    t = first + (F.floor(uniform(seed, F.lit("point"), F.col("draw")) * F.greatest(last - first, F.lit(0)) / step) * step).cast("long")
    return drawn.select("draw", LOC, t.alias("t"))


def in_year(a: DataFrame, year: int, tidy: bool = False) -> DataFrame:
    low, high = (F.unix_seconds(F.to_timestamp(F.lit(f"{y:04d}-01-01 00:00:00"))) for y in (year, year + 1))
    return _tidied(clip(a, low, high), tidy)


def from_date(a: DataFrame, seconds: int, tidy: bool = False) -> DataFrame:
    return _tidied(clip(a, seconds, FAR), tidy)


def split_locations(a: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose location is among locations(location_id), and the others."""
    ids = locations.select(LOC).distinct()
    return a.join(ids, LOC, "left_semi"), a.join(ids, LOC, "left_anti")


def of_location(a: DataFrame, name: str) -> DataFrame:
    return a.where(F.col(LOC) == location_id(F.lit(name)))


def overlapping(spans: DataFrame, low: int, high: int, start: str = START, stop: str = STOP) -> DataFrame:
    return spans.where((F.col(start) < high) & (F.col(stop) > low))


def overlaps(a: DataFrame) -> DataFrame:
    """(location_id, start, previous_stop) of intervals that begin before an earlier one of their location stops."""
    return _previous(a).where(F.col(START) < F.col("previous_stop")).select(LOC, START, "previous_stop")


def _previous(a: DataFrame) -> DataFrame:
    """a with previous_stop, the greatest stop of those before it by start, then stop; null for the first one."""
    rows = a.withColumn("__b", bucket_of(F.col(START), BUCKET))
    return running(rows, [LOC], "__b", [START, STOP], maxes={"previous_stop": F.col(STOP)}, own=False).drop("__b")


def checked_disjoint(a: DataFrame) -> DataFrame:
    """a; reading it raises an error that names a location with overlapping intervals."""
    bad = F.col(START) < F.col("previous_stop")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("overlapping spans of location "), F.col(LOC).cast("string")))).otherwise(F.col(START)).cast("long")
    return _previous(a).withColumn(START, checked).drop("previous_stop")


def common(groups: list[list[DataFrame]]) -> DataFrame:
    """What all groups of sources have, each group being the union of its sources: one sweep with a counter for each group."""
    whole = [reduce(DataFrame.unionByName, [x.select(LOC, START, STOP) for x in sources]) for sources in groups]
    return sweep(whole, lambda *n: reduce(lambda x, y: x & y, [c > 0 for c in n]))


def lengths(a: DataFrame) -> DataFrame:
    return a.withColumn("length", F.col(STOP) - F.col(START))
