"""Spans and samples, resampling, pooling and scaling.

samples are (series, ts, value), spans (series, start_time, sample_interval_s, num_values, values). Missing values are
null; NaN becomes null on the way in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loadgrid.operators.running import bucket_of, in_one_task, running, tasks_of
from loadgrid.operators.tables import written

#: Values of a span at most: longer runs are cut, so that no row grows with a series.
MOST_VALUES = 105_408
#: Seconds of a series that one task looks at when it is cut into runs.
BUCKET = 7 * 86400
#: Steps that a bucket has at least: coarse series get wider ones.
STEPS = 4096
#: Window starts of a block that one task pools, and values that it sorts at a time.
POOLED, CELLS = 65_536, 2_000_000


def bare(x: Column) -> Column:
    """x with NaN as null."""
    return F.when(~F.isnan(x), x)


def to_spans(samples: DataFrame, step: int, keys: list[str], ts: str = "ts", value: str = "value", most: int = MOST_VALUES) -> DataFrame:
    """Contiguous runs of samples as rows (keys, start_time, sample_interval_s, num_values, values).

    A run ends where the next sample isn't one step later, and after most values. Of several samples at one time the
    smallest counts.
    """
    width = BUCKET * max(1, -(-step * STEPS // (7 * 86400)))
    whole, tasks, t = in_one_task(samples), tasks_of(samples), F.col(ts)
    dealt = samples.withColumn("__b", bucket_of(t, width))
    # dealt out once for the values of a time, the runs and their lists
    dealt = dealt.repartition(tasks, *keys) if whole else dealt.repartition(tasks, *keys, "__b")
    one = dealt.groupBy(*keys, "__b", ts).agg(F.min(value).alias(value))
    dealt_by = Window.partitionBy(*keys, *([] if whole else ["__b"])).orderBy(ts)
    begun = one.withColumn("__begins", F.when(t - F.lag(ts).over(dealt_by) == step, None).otherwise(t))
    runs = begun.withColumn("__run", F.max("__begins").over(dealt_by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(ts, value))).alias("rows")
    if whole:
        lists = runs.withColumn("__part", F.floor((t - F.col("__run")) / (step * most))).groupBy(*keys, "__run", "__part").agg(rows)
    else:
        lists = _joined(runs.groupBy(*keys, "__b", "__run").agg(rows, F.max(ts).alias("__last")), step, keys, most, width)
    return lists.select(
        *keys, F.col("rows")[0][ts].alias("start_time"), F.lit(step).alias("sample_interval_s"), F.size("rows").cast("long").alias("num_values"), F.transform("rows", lambda r: r[value]).alias("values")
    )


def _joined(pieces: DataFrame, step: int, keys: list[str], most: int, width: int) -> DataFrame:
    """(keys, rows): pieces of runs (keys, __b, __run, __last, rows), each within one bucket, put together and cut after most values.

    Pieces that reach neither end of their bucket are whole. Of the others only places and ends go along the series.
    """
    low = F.col("__b") * width
    reaches = (F.col("__run") - step < low) | (F.col("__last") + step >= low + width)
    stored = written(pieces.withColumn("__edge", F.coalesce(reaches, F.lit(False))))

    def cut(found: DataFrame, ahead: Column) -> DataFrame:
        """Each piece as its parts, ahead being how many values of its run come before it."""
        found = found.withColumn("__ahead", ahead)
        upto = F.floor((F.col("__ahead") + F.size("rows") - 1) / most)
        parts = found.withColumn("__part", F.explode(F.sequence(F.floor(F.col("__ahead") / most), upto)))
        first = F.greatest(F.col("__part") * most - F.col("__ahead"), F.lit(0)).cast("int")
        end = ((F.col("__part") + 1) * most - F.col("__ahead")).cast("int")
        return parts.withColumn("rows", F.slice("rows", first + 1, end - first))

    inner = cut(stored.where(~F.col("__edge")), F.lit(0).cast("long")).select(*keys, "rows")
    edges = stored.where("__edge")
    ends = edges.select(*keys, "__run", "__last", F.floor(F.col("__b") / STEPS).alias("__c"))
    last = running(ends, keys, "__c", ["__run"], maxes={"__before": F.col("__last")}, own=False)
    begins = F.when(F.col("__run") - F.col("__before") == step, None).otherwise(F.col("__run"))
    placed = running(last.withColumn("__begins", begins), keys, "__c", ["__run"], maxes={"__whole": F.col("__begins")})
    # keys may be null
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    both = edges.alias("x").join(placed.alias("y"), [*same, F.col("x.__run") == F.col("y.__run")]).select("x.*", "y.__whole")
    grouped = cut(both, F.floor((F.col("__run") - F.col("__whole")) / step)).groupBy(*keys, "__whole", "__part").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))
    # stored, since Spark takes a join for as large as the product of its sides
    return inner.unionByName(written(grouped.select(*keys, "rows")))


def to_samples(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, value) of spans."""
    rows = spans.select(*keys, "start_time", "sample_interval_s", F.posexplode("values").alias("pos", "value"))
    return rows.select(*keys, (F.col("start_time") + F.col("pos").cast("long") * F.col("sample_interval_s")).alias("ts"), bare(F.col("value")).alias("value"))


def _clipped(spans: DataFrame, keys: list[str], low: int | None, high: int | None) -> DataFrame:
    """Samples with the span's start, within [low, high)."""
    rows = to_samples(spans.withColumn("__span", F.col("start_time")), [*keys, "__span"])
    if low is not None:
        rows = rows.where(F.col("ts") >= low)
    return rows if high is None else rows.where(F.col("ts") < high)


def downsample(spans: DataFrame, step: int, keys: list[str], low: int | None = None, high: int | None = None, separators: bool = False) -> DataFrame:
    """(keys, span, ts, value): the mean of each bucket of step seconds of each span; a bucket without values is null.

    separators: one null row, a step after its last one, follows each span.
    """
    rows = _clipped(spans, keys, low, high).withColumn("ts", F.col("ts") - F.pmod("ts", F.lit(step)))
    buckets = rows.groupBy(*keys, "__span", "ts").agg(F.avg("value").alias("value"))
    last = F.max("ts") + (step if separators else 0)
    ends = buckets.groupBy(*keys, "__span").agg(F.min("ts").alias("__from"), last.alias("__to"))
    grid = ends.select(*keys, "__span", F.explode(F.sequence("__from", "__to", F.lit(step).cast("long"))).alias("ts"))
    return grid.join(buckets, [*keys, "__span", "ts"], "left").withColumnRenamed("__span", "span")


def upsample(spans: DataFrame, step: int, keys: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """(keys, span, ts, value): linear interpolation in time on a grid of step seconds from each span's first bucket.

    Only samples that fall on the grid, and within [low, high), are anchors; the grid reaches over what is left of the
    span. After the last anchor its value is held, before the first there is none. A span is a row with all its values,
    so nothing is shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "span long, ts long, value double"])
    lows, highs = (-(2**62) if low is None else low), (2**62 if high is None else high)

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                start, every = b.column(len(keys))[at].as_py(), b.column(len(keys) + 1)[at].as_py()
                values = b.column(len(keys) + 2)[at].values
                ts = start + np.arange(0 if values is None else len(values), dtype=np.int64) * every
                inside = (ts >= lows) & (ts < highs)
                if not inside.any():
                    continue
                own, x = ts[inside], values.to_numpy(zero_copy_only=False).astype(float)[inside]
                grid = np.arange(own[0] - own[0] % step, own[-1] - own[-1] % step + 1, step)
                anchor = (own % step == 0) & ~np.isnan(x)
                y = np.full(len(grid), np.nan)
                if anchor.any():
                    y = np.interp(grid, own[anchor], x[anchor])
                    y[grid < own[anchor][0]] = np.nan
                same = pa.array(np.full(len(grid), at))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(same) for k in range(len(keys))), pa.array(np.full(len(grid), start)), pa.array(grid), pa.array(y, from_pandas=True)], names=[*keys, "span", "ts", "value"])

    rows = spans.select(*keys, F.col("start_time").cast("long"), F.col("sample_interval_s").cast("long"), F.col("values").cast("array<double>"))
    return rows.mapInArrow(run, fields)


def stretch(values: Column, n: int) -> Column:
    """An array resampled to n elements by linear interpolation between aligned corners; null next to a null neighbour."""
    size = F.size(values)

    def at(j: Column) -> Column:
        pos = j * (size - 1) / F.lit(float(max(n - 1, 1)))
        low = F.floor(pos).cast("int")
        share = pos - low
        a, b = F.get(values, low), F.get(values, F.least(low + 1, size - 1))
        return F.when(share == 0, a * 1.0).otherwise(a * (1 - share) + b * share)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def _quantiles(values: np.ndarray, quantile: float) -> np.ndarray:
    """Linearly interpolated quantile of each row's values that aren't NaN; NaN where there is none."""
    ordered = np.sort(values, axis=1)  # NaN last
    n = np.count_nonzero(~np.isnan(ordered), axis=1)
    at = np.maximum(n - 1, 0) * quantile
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    rows = np.arange(len(values))
    a, b = ordered[rows, low], ordered[rows, high]
    return np.where(low == high, a, (high - at) * a + (at - low) * b)


def pool_quantile(rows: DataFrame, keys: list[str], kernel: int, stride: int, quantile: float, dilation: int = 1, padding: int = 0, pos: str = "pos", value: str = "value") -> DataFrame:
    """(keys, window, value): a linearly interpolated quantile of each full window of kernel positions, dilation apart.

    Windows start every stride positions; padding adds that many zeros on both sides; what doesn't fill a window goes.
    Missing values don't count, a window of none but these is null. Of several values at one position one counts.

    A series is dealt out in blocks of window starts, each with a halo of what its last windows reach over: a row goes to
    two blocks at most, whatever the kernel, and a long series to many tasks. A task sorts strided views of one block.
    """
    reach = (kernel - 1) * dilation
    width = max(POOLED, reach + 1, stride)
    body = rows.select(*keys, F.col(pos).cast("long").alias("__pos"), bare(F.col(value).cast("double")).alias("__v"))
    if padding:
        size = rows.groupBy(*keys).agg((F.max(pos) + 1).cast("long").alias("__n"))
        pads = size.select(*keys, F.explode(F.concat(F.sequence(F.lit(-padding).cast("long"), F.lit(-1).cast("long")), F.sequence(F.col("__n"), F.col("__n") + padding - 1))).alias("__pos"), F.lit(0.0).alias("__v"))
        body = body.unionByName(pads)
    # window k starts at stride * k - padding and belongs to block (stride * k) // width
    first, last = (F.floor((F.col("__pos") + padding - far) / width) for far in (reach, 0))
    dealt = body.withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    order = [*keys, "__block", "__pos"]
    dealt = dealt.withColumn("__group", F.xxhash64(*keys, "__block")).repartition(*keys, "__block").sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    k = len(keys)

    def pooled(t: pa.Table):
        group, block = t.column("__group").to_numpy(), t.column("__block").to_numpy()
        at, v = t.column("__pos").to_numpy(), t.column("__v").to_numpy(zero_copy_only=False).astype(float)
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(group)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begin = -(-int(block[a]) * width // stride)  # the first window of the block
            end = -(-(int(block[a]) + 1) * width // stride)
            low = begin * stride - padding
            span = max(0, (end - 1 - begin) * stride + reach + 1)
            dense, there = np.full(span, np.nan), np.zeros(span, bool)
            slot = at[a:b] - low
            inside = (slot >= 0) & (slot < span)
            dense[slot[inside]], there[slot[inside]] = v[a:b][inside], True
            if span <= reach:
                continue
            view = lambda x: np.lib.stride_tricks.sliding_window_view(x, reach + 1)[::stride, ::dilation]
            full = np.flatnonzero(view(there).all(1))
            windows = view(dense)
            for c in range(0, len(full), max(1, CELLS // kernel)):
                own = full[c : c + max(1, CELLS // kernel)]
                same = pa.array(np.full(len(own), a))
                yield pa.RecordBatch.from_arrays([*(t.column(i).combine_chunks().take(same) for i in range(k)), pa.array(begin + own), pa.array(_quantiles(windows[own], quantile), from_pandas=True)], names=[*keys, "window", "value"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            group = t.column("__group").to_numpy()
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield from pooled(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield from pooled(held)

    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "window long, value double"]))


def pool_extremes(rows: DataFrame, keys: list[str], kernel: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """(keys, window, low, high): least and greatest value of each kernel positions, the last ones dropped if fewer."""
    v = bare(F.col(value).cast("double"))
    windows = rows.groupBy(*keys, F.floor(F.col(pos) / kernel).alias("window")).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("__have"))
    return windows.where(F.col("__have") == kernel).drop("__have")


def envelope(rows: DataFrame, keys: list[str], kernel: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """pool_extremes() with centre, the position in the middle of each window."""
    return pool_extremes(rows, keys, kernel, pos, value).withColumn("centre", F.col("window") * kernel + kernel // 2)


def extremes(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, low, high) over values that are there; plus and minus infinity where there are none."""
    v = bare(F.col(value).cast("double"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(v), F.lit(float("inf"))).alias("low"), F.coalesce(F.max(v), F.lit(float("-inf"))).alias("high"))


def unit_scale(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """rows with value scaled to [0, 1] over the finite values of its series; unchanged if all are equal or none is."""
    v = F.col(value).cast("double")
    fine = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    # one row per series comes back: a long series isn't gathered in one window
    ends = rows.groupBy(*keys).agg(F.min(fine).alias("__low"), F.max(fine).alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (v - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(v)
    return rows.join(ends, keys).withColumn(value, scaled).drop("__low", "__high")


def numbered(rows: DataFrame, keys: list[str], order: str = "ts", name: str = "pos", width: int = BUCKET) -> DataFrame:
    """rows with their position in their series, from 0; a long series is counted in buckets of order, a number, so wide."""
    counted = running(rows.withColumn("__b", bucket_of(F.col(order), width)), keys, "__b", [order], sums={name: F.lit(1).cast("long")}, own=False)
    return counted.drop("__b")


def every(rows: DataFrame, keys: list[str], k: int, order: str = "ts") -> DataFrame:
    """Each k-th row of a series, from the first."""
    return numbered(rows, keys, order, "__n").where(F.col("__n") % k == 0).drop("__n")


def tail(rows: DataFrame, keys: list[str], n: int, order: str = "ts") -> DataFrame:
    """The last n rows of each series."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")


def most_samples(spans: DataFrame, key: str = "location_id") -> DataFrame:
    """The series with most samples, ties to the smallest key."""
    return spans.groupBy(key).agg(F.sum("num_values").alias("num_values")).orderBy(F.desc("num_values"), key).limit(1)


def in_order(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partitioned and sorted by keys, so that files written from it are in order."""
    return spans.repartitionByRange(*keys).sortWithinPartitions(*keys)
