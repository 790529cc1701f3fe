"""A corpus from raw documents to packed training sequences, in stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadgrid.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from loadgrid.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. A null text is scored as an empty one; rows with a null id and repeated ones are scored one by one."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, the one with the largest id; null texts equal empty ones. Of rows that repeat id and text one stays."""
    return exact_dedup.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return near_dedup.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A null source is one of its own; a source without any word is not taken."""
    return mixing.taken(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token sequences in packed sequences; a null or empty text is its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("minhash_near_dedup", without_near_copies), ("source_mix", mixed), ("best_fit_packing", packed)]

#: A trained model and sketches are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. An empty table gives an empty result; columns that documents may have beside its own stay."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
