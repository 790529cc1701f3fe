"""Row numbers over a whole table, without a window that pulls all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadgrid.operators.tables import written


def with_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with a row number from 0 in the given order.

    Rows are range-partitioned by the order, numbered inside their partition, and shifted by the number of rows before
    it; only one count per partition is joined back. The ranges come from a sample, so their numbers are written once
    and read by both branches. The order should be total, else ties are numbered arbitrarily. Nulls come first. An order
    by the name of a column is not written a second time.
    """
    keys = [c if isinstance(c, str) else f"__key{i}" for i, c in enumerate(order)]
    made = {k: c for k, c in zip(keys, order, strict=True) if not isinstance(c, str)}
    rows = df.withColumns(made)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    # one row per range: at most n
    joined = ranged.withColumn("__own", own).join(F.broadcast(before), "__part")
    return joined.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before", *made)
