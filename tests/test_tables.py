"""Written tables and their removal."""

import os

import pytest

from loadgrid.operators import tables
from loadgrid.operators.ranks import with_rank


def left(spark):
    folder = tables.shared_dir(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith("loadgrid-")}


def test_scratch_removes_what_a_job_wrote(spark, tmp_path):
    kept = tables.written(spark.range(5).toDF("k"))
    before = left(spark)
    with tables.scratch(spark):
        with_rank(kept, ["k"]).write.parquet(str(tmp_path / "out"))
        with tables.scratch(spark):
            tables.written(spark.range(3).toDF("k"))
            assert len(left(spark)) == len(before) + 2
        assert len(left(spark)) == len(before) + 1
    assert left(spark) == before and kept.count() == 5
    assert sorted(r.rank for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError), tables.scratch(spark):
        tables.written(spark.range(3).toDF("k"))
        raise ZeroDivisionError
    assert left(spark) == before
