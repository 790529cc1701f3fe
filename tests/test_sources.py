"""Readers and writers whose mechanism matters: what is read at all, and what a rerun leaves."""

import numpy as np
import pytest

from loadgrid.sources import buffer, files


def flat(spark, tmp_path, spans, count, width=3):
    data = np.arange(count * width, dtype="<f4").reshape(count, width)
    data.tofile(tmp_path / "flat.np")
    return data, spark.createDataFrame(spans, "id long, location long, datetime_start long, num_values long, sample_interval_s long")


def test_flat_records_in_many_parts_and_chunks(spark, tmp_path, monkeypatch):
    spans = [(0, 1, 0, 700, 60), (700, 2, 9, 1, 60), (701, 1, 900_000, 300, 60), (1001, 3, 0, 50, 60), (1051, 2, 1000, 949, 30)]
    data, table = flat(spark, tmp_path, spans, 2000)
    places = spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei")], "location_id long, name string")
    whole = sorted(map(tuple, buffer.read_buffer(spark, f"file://{tmp_path}/flat.np", table, places, ["a", "b", "c"], ["c", "a"]).collect()))
    assert len(whole) == 1950
    want = []
    for first, loc, start, n, step in spans:
        if loc != 3:
            want += [(start + k * step, float(data[first + k, 0]), float(data[first + k, 2])) for k in range(n)]
    assert sorted(r[1:] for r in whole) == sorted(want)
    # whatever the sizes of tasks, pieces and gaps
    for task, chunk, gap in ((1200, 120, 0), (600, 36, 24), (10**9, 12, 10**6)):
        monkeypatch.setattr(buffer, "TASK_BYTES", task)
        monkeypatch.setattr(buffer, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(buffer, "GAP_BYTES", gap)
        options = {"path": f"{tmp_path}/flat.np", "spans": str(tmp_path / f"spans{task}"), "features": "a,b,c"}
        known = table.where("location <> 3").selectExpr("location AS location_id", "id AS first", "num_values", "datetime_start AS start_time", "sample_interval_s")
        known.repartition(2).write.parquet(options["spans"])
        from pyspark.sql.types import DoubleType, LongType, StructType

        reader = buffer.Reader(StructType().add("location_id", LongType()).add("ts", LongType()).add("a", DoubleType()).add("c", DoubleType()), options)
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns[1:]))]
        assert sorted(rows) == sorted(want) and (len(parts) > 10) == (task < 10**9)


def test_records_of_unwanted_spans_are_not_read(spark, tmp_path):
    """The file is cut off behind the wanted span: reading anything else would fail."""
    _, table = flat(spark, tmp_path, [(0, 1, 0, 10, 60), (10, 2, 0, 10, 60)], 10)
    one, both = ([(1, "one")], [(1, "one"), (2, "two")])
    read = lambda names: buffer.read_buffer(spark, f"{tmp_path}/flat.np", table, spark.createDataFrame(names, "location_id long, name string"), ["a", "b", "c"])
    assert read(one).count() == 10
    with pytest.raises(Exception, match="the file ends before"):
        read(both).collect()
    assert read([(9, "nine")]).count() == 0


def test_flat_records_round_trip(spark, tmp_path):
    rows = [("x", 5, [1.0, None, 3.0]), ("a", 7, [4.0]), ("a", 2, [5.0, 6.0])]
    spans = spark.createDataFrame(rows, "location string, start long, v array<double>").selectExpr("*", "size(v) AS num_values")
    placed = buffer.placed(spans, ["location", "start"])
    assert {(r.location, r.start): r.id for r in placed.collect()} == {("a", 2): 0, ("a", 7): 2, ("x", 5): 3}
    assert buffer.write_buffer(placed.select("id", "v"), f"file://{tmp_path}/out.np", ["v"]) == 6
    got = np.fromfile(tmp_path / "out.np", "<f4")
    assert got[:4].tolist() == [5, 6, 4, 1] and np.isnan(got[4]) and got[5] == 3
    with pytest.raises(ValueError, match="gaps or overlap"):
        buffer.write_buffer(placed.where("start <> 7").select("id", "v"), f"{tmp_path}/gap.np", ["v"])


def test_locators(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.csv").write_text(f"t,v\n2024-01-01 00:00:00,{ord(name)}\n")
    read = lambda *paths: sorted((r.location, r.value) for r in files.read_series(spark, list(paths), "t", "v", "csv").collect())
    assert read(f"file://{tmp_path}/a.csv", f"{tmp_path}/[bc].csv") == read(str(tmp_path)) == [("a", 97.0), ("b", 98.0), ("c", 99.0)]
    assert files.located("s3://bucket/key", "hdfs://x/y") == ["s3a://bucket/key", "hdfs://x/y"]
    with pytest.raises(ValueError, match="not on a file system"):
        files.located("https://x/y")
