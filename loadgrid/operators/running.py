"""Running sums, maxima and last values along a series that may be too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes, by Spark's estimate before anything runs, up to which a whole table may be one task's series.
ONE_TASK = 64_000_000
#: Bytes, by the same estimate, that one task of a series' shuffles gets. Adaptive execution would join partitions by their
#: compressed size, which tells little: series of times compress to a hundredth of what a window holds of them.
TASK = 2_000_000
#: Tasks of such a shuffle at least, and how many times spark.sql.shuffle.partitions at most.
FEWEST, MOST = 8, 16


def _size(*tables: DataFrame) -> int:
    """Bytes of tables by Spark's estimate; far more than any real one where a session has none."""
    try:
        return sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    except (AttributeError, TypeError):
        return 2**62


def tasks_of(rows: DataFrame, times: int = 1) -> int:
    """A number of partitions for rows, times: how many rows come of one that the estimate doesn't count. It grows with
    the input, and stated in repartition() it holds. A table without an estimate gets spark.sql.shuffle.partitions."""
    usual, size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _size(rows)
    return usual if size > 2**50 else max(min(size * times // TASK + 1, MOST * usual), min(FEWEST, usual))


def in_one_task(*tables: DataFrame) -> bool:
    """Whether tables are so small, all together, that no series in them needs to be split: no job runs to find out.

    The estimate comes from the sizes of files, and joins multiply it, so that it errs towards splitting; where a
    session has none, series are split.
    """
    return _size(*tables) <= ONE_TASK


def running(rows: DataFrame, keys: list[str], bucket: str, order: list[str], sums: dict | None = None, maxes: dict | None = None, lasts: dict | None = None, own: bool = True, tasks: int | None = None, dealt: bool | None = None) -> DataFrame:
    """rows with a column for each entry of sums, maxes and lasts (name: column): the sum, the greatest and the last
    value that isn't null, over all rows of its keys up to the row itself, or up to the one before if not own.

    order sorts the rows of a key; bucket is a column that rises with it, and no more rows than one bucket has meet in
    a task. A row's result is that of its bucket up to it, and that of all buckets before. These come from one row for
    each bucket: the first one, which alone stands in the key's window over buckets. So rows are shuffled, but the
    plan has one branch only, and a key with a third of all rows is spread like any other. A small table (ONE_TASK) goes
    by its keys alone, which gives the same.

    tasks: partitions of the shuffles, else tasks_of(rows). dealt: rows are partitioned already, by keys alone (False)
    or by keys and bucket (True).
    """
    tasks = tasks or tasks_of(rows)
    if in_one_task(rows) if dealt is None else not dealt:
        rows = rows.repartition(tasks, *keys) if dealt is None else rows
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        each = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in (sums or {}).items()}
        each |= {n: F.max(c).over(upto) for n, c in (maxes or {}).items()} | {n: F.last(c, True).over(upto) for n, c in (lasts or {}).items()}
        return rows.withColumns(each)
    named = [(n, F.sum, c) for n, c in (sums or {}).items()] + [(n, F.max, c) for n, c in (maxes or {}).items()] + [(n, lambda x: F.last(x, True), c) for n, c in (lasts or {}).items()]
    rows = rows.repartition(tasks, *keys, bucket) if dealt is None else rows
    sorted_ = Window.partitionBy(*keys, bucket).orderBy(*order)
    upto = sorted_.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    whole = sorted_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = rows.withColumns({f"__{k}_upto": f(c).over(upto) for k, (_, f, c) in enumerate(named)} | {f"__{k}_all": f(c).over(whole) for k, (_, f, c) in enumerate(named)} | {"__place": F.row_number().over(sorted_)})
    first = F.col("__place") == 1
    local = local.withColumns({"__first": first, "__own": F.when(~first, F.col(bucket))}).repartition(tasks, *keys, "__own", "__first")
    first = F.col("__first")
    before = Window.partitionBy(*keys, "__own", "__first").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = local.withColumns({f"__{k}_before": F.when(first, f(F.col(f"__{k}_all")).over(before)) for k, (_, f, _) in enumerate(named)}).drop("__first", "__own", "__place").repartition(tasks, *keys, bucket)
    # the first row of a bucket hands on what it has got: the others have null there, and any row that ties with it may
    # come first now
    got = [F.first(F.col(f"__{k}_before"), True).over(whole) for k in range(len(named))]
    out = {}
    for k, (name, f, _) in enumerate(named):
        mine = F.col(f"__{k}_upto")
        if name in (sums or {}):
            out[name] = F.coalesce(got[k], F.lit(0)) + F.coalesce(mine, F.lit(0))
        elif name in (maxes or {}):
            out[name] = F.greatest(got[k], mine)
        else:
            out[name] = F.coalesce(mine, got[k])
    return carried.withColumns(out).drop(*(f"__{k}_{s}" for k in range(len(named)) for s in ("upto", "all", "before")))


def bucket_of(t: Column, width: int) -> Column:
    return F.floor(t / width)
