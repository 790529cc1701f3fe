"""Mixing sources to target weights.

Sizes are summed per source, each source gets a target share of all words, and target / size is its repetition rate.
Every document is taken floor(rate) times, plus one copy with a probability equal to the fraction. The draws of a source
are hash-seeded and systematic: its documents stand in order of size, and a document gets its copy where the running sum
of fractions, from an offset that is a hash of seed and source, passes a whole number. So each document's copy is a
Bernoulli draw of that probability, while the words that a source gives are within one document's size of its target,
which independent coins miss by the root of the number of documents. Reruns and other partitionings draw alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.llm.common import SPACES, unused, written
from loadgrid.operators.ranks import with_rank

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix"
#: 2**48: coins are the first 48 bits of an MD5.
COIN = float(1 << 48)


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    # a white space that follows no other one ends a word
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.regexp_count(bare, F.lit(f"[{SPACES}]+")) + 1).cast("long")


def coin(seed: str, key: Column) -> Column:
    """A number from [0, 1) that depends on seed and key alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(COIN)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), one row per source.

    Sources by code point, null last, weigh weights in turn. They share the sum of all sizes by weight; a target stops at
    max_repeats times its source's size, and the excess is shared again by weight among the others until none is above.
    Only sums come to the driver. A sharing raises the level at which sources stop, so it ends after as many rounds as
    there are distinct levels at most, in practice a few.
    """
    ranked = with_rank(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", max_repeats * F.col("source_size"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped, left, open_weight = 0, total, None
    level = 0.0
    while True:
        # most <= level * weight: the source stops
        stops = F.col("most") <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(stops, F.col("most"))), F.sum(F.when(~stops, F.col("weight")))).first()
        now, weight_now = row[0] or 0, row[1] or 0
        if (now, weight_now) == (capped, open_weight) or not weight_now:
            break
        capped, open_weight = now, weight_now
        left = total - capped
        level = left / open_weight
    return ranked.select("source", "source_size", F.when(F.col("most") <= F.lit(level) * F.col("weight"), F.col("most").cast("double")).otherwise(F.lit(float(level)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(id_col, source, spot, size, source_size, target, repeats) for each row of docs: how often the mix takes it.

    A null text has size 0, a null source is a source of its own that comes last. Rows without a size are taken as often
    as their source's rate says; in a source without any size, where no rate exists, never. Documents of one size stand
    in the order of a hash of their ids. Rows that agree in id, source and text may be taken differently often; spot is
    a hash of these three. Other columns have no effect. Sizes are summed before the shuffle; rows without texts are
    put in order by ranges, so that a source with a third of all rows is many tasks' work.
    """
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), source.alias("source"), spot_of(id_col, source_col, text_col).alias("spot"), n_words(text).alias("size"), F.monotonically_increasing_id().alias("row"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats).withColumnRenamed("source", "__source")
    # a row's own number only tells rows apart that are alike
    order = [F.col("source").isNull(), "source", "size", coin(seed, F.col("id")), F.col("id"), "spot", "row"]
    ranked = with_rank(rows, order, "k")
    mixed = ranked.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    share = rate - F.floor(rate)
    upto = lambda k: F.floor(k * share + coin(f"{seed}:source", F.col("source")))
    repeats = (F.floor(rate) + upto(F.col("k") + 1) - upto(F.col("k"))).cast("long")
    return mixed.select(F.col("id").alias(id_col), "source", "spot", "size", "source_size", "target", repeats.alias("repeats"))


def spot_of(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Each row of docs as often as mix() takes it; columns, whatever their names, stay as they are.

    Rows that agree in id, source and text are one document that occurs several times: one of them stands for all.
    """
    key, copies, rows, each = unused(docs, "__spot", "__copies", "__rows", "__copy")
    drawn = mix(docs, id_col, text_col, source_col, weights, max_repeats, seed)
    counts = written(drawn.groupBy(F.col("spot").alias(key)).agg(F.sum("repeats").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0))
    joined = docs.withColumn(key, spot_of(id_col, source_col, text_col)).join(counts, key)
    if not counts.where(F.col(rows) > 1).isEmpty():
        joined = joined.where(F.col(rows) == 1).unionByName(joined.where(F.col(rows) > 1).dropDuplicates([key]))
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
