"""Exact percentiles of groups of any size, without a buffer of a group's values."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window, functions as F

from loadgrid.operators.resample import bare
from loadgrid.operators.running import in_one_task
from loadgrid.operators.tables import written

#: Bins of a range in a round, and values that are sorted at last.
BINS, FEW = 1024, 4096


def percentiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(keys, a column for each of fractions): linearly interpolated percentiles of the values that aren't missing.

    An interpolated percentile needs the values of two ranks. The range of a group is cut into BINS, whose counts say
    which bin a rank is in; the range of that bin's values is cut in turn, until it holds one value or FEW. Each round
    is one partial aggregation for all groups and ranks at once, so that memory grows with ranks, not with values, and
    a group of 10^9 values takes two or three. Infinite values count as the largest doubles. Small tables are sorted.
    """
    most = sys.float_info.max
    body = rows.select(*keys, bare(F.col(value).cast("double")).alias("__v")).where("__v IS NOT NULL")
    if in_one_task(rows):
        return body.groupBy(*keys).agg(*(F.percentile("__v", F.lit(f)).alias(n) for n, f in fractions.items()))
    body = written(body.withColumn("__v", F.greatest(F.lit(-most), F.least(F.lit(most), F.col("__v")))))
    sizes = body.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    wanted = F.array(*(F.struct(F.lit(n).alias("__name"), ((F.col("__n") - 1) * F.lit(f)).alias("__at")) for n, f in fractions.items()))
    named = written(sizes.select(*keys, "__n", "__low", "__high", F.inline(wanted)))
    ranks = named.select(*keys, "__low", "__high", F.col("__n").alias("__count"), F.explode(F.array(F.floor("__at"), F.ceil("__at"))).alias("__rank")).distinct()
    # __below: how many values of the group are below the range
    state = written(ranks.withColumn("__below", F.lit(0).cast("long")))
    open_ = "__count > {0} AND __low < __high".format(FEW)
    settled = []
    while not (rest := state.where(open_)).isEmpty():
        settled.append(state.where(f"NOT ({open_})"))
        ranges = rest.select(*keys, "__low", "__high", "__below").distinct()
        half = lambda a, b: F.col(a) / 2 - F.col(b) / 2  # noqa: E731  differences of the largest doubles overflow
        place = F.least(F.floor(half("__v", "__low") / half("__high", "__low") * BINS), F.lit(BINS - 1))
        inside = body.join(ranges, keys).where("__v BETWEEN __low AND __high")
        bins = inside.groupBy(*keys, "__low", "__high", "__below", place.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        upto = F.sum("__c").over(Window.partitionBy(*keys, "__low", "__high").orderBy("__bin"))  # BINS rows at most
        bins = bins.withColumn("__upto", F.col("__below") + upto).drop("__below")
        found = rest.join(bins, [*keys, "__low", "__high"]).where("__rank < __upto AND __rank >= __upto - __c")
        state = written(found.select(*keys, F.col("__a").alias("__low"), F.col("__b").alias("__high"), F.col("__c").alias("__count"), "__rank", (F.col("__upto") - F.col("__c")).alias("__below")))
    for s in settled:
        state = state.unionByName(s)
    state = written(state)
    same = state.where("__low = __high").select(*keys, "__rank", F.col("__low").alias("__value"))
    few = state.where("__low < __high")
    lists = body.join(few.select(*keys, "__low", "__high").distinct(), keys).where("__v BETWEEN __low AND __high").groupBy(*keys, "__low", "__high").agg(F.array_sort(F.collect_list("__v")).alias("__list"))
    chosen = few.join(lists, [*keys, "__low", "__high"]).select(*keys, "__rank", F.get("__list", (F.col("__rank") - F.col("__below")).cast("int")).alias("__value"))
    values = written(same.unionByName(chosen))
    side = lambda s: values.select(*keys, F.col("__rank").alias(f"__{s}"), F.col("__value").alias(f"__v{s}"))
    both = named.withColumns({"__lo": F.floor("__at"), "__hi": F.ceil("__at")}).join(side("lo"), [*keys, "__lo"]).join(side("hi"), [*keys, "__hi"])
    share = F.col("__at") - F.col("__lo")
    between = F.when(F.col("__lo") == F.col("__hi"), F.col("__vlo")).otherwise(F.col("__vlo") * (1 - share) + F.col("__vhi") * share)
    return both.groupBy(*keys).agg(*(F.max(F.when(F.col("__name") == n, between)).alias(n) for n in fractions))
