"""Written intermediate results."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that this process has written and not removed, the latest last.
_LEFT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one on a local master alone, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loadgrid-{uuid.uuid4().hex}"
    _LEFT.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that are written within, once the block ends: a job that has stored its result there needs
    none of them any more. DataFrames from within can't be read afterwards.

        with scratch(spark):
            near_groups(docs).write.parquet(path)
    """
    before = len(_LEFT)
    try:
        yield
    finally:
        mine, _LEFT[before:] = _LEFT[before:], []
        for path in mine:
            _remove(spark, path)
