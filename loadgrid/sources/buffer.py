"""Flat files of little-endian float32 records, as a Spark data source.

A table of spans says which records belong to what. Partitions are byte ranges, planned from the statistics in the footers
of that table's Parquet files alone: one for each row group, or several where its spans hold more than TASK_BYTES. A task
reads its own spans and, of the flat file, only the bytes that these name; neighbours are read together. So spans that
were filtered out of the table cost nothing, no record is shuffled, and the driver sees neither spans nor records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loadgrid.functions.scalars import location_id
from loadgrid.operators.tables import written

FORMAT = "float32_records"
#: Bytes of the flat file that a task reads at about this number.
TASK_BYTES = 64_000_000
#: Bytes that a task holds at a time.
CHUNK_BYTES = 4_000_000
#: Spans that are this near to each other are read in one go.
GAP_BYTES = 65_536


def opened(path: str):
    """(file system, path) of a path or URI, for any file system that Arrow knows."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def span_files(path: str) -> list[str]:
    from pyarrow import fs

    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class Range(InputPartition):
    """Share `part` of `parts` of each span in a row group."""

    def __init__(self, file: str, group: int, part: int, parts: int):
        self.file, self.group, self.part, self.parts = file, group, part, parts


class Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.spans = schema, options["path"], options["spans"]
        self.features = options["features"].split(",")
        self.names = [f.name for f in schema.fields][2:]

    def partitions(self):
        """From footers only: a row group's records reach from its least to its greatest span."""
        import pyarrow.parquet as pq

        system, _ = opened(self.spans)
        width, found = 4 * len(self.features), []
        for file in span_files(self.spans):
            with system.open_input_file(file) as f:
                meta = pq.ParquetFile(f).metadata
            column = {meta.schema.column(k).name: k for k in range(len(meta.schema))}
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                first, count = (group.column(column[c]).statistics for c in ("first", "num_values"))
                if not group.num_rows:
                    continue
                known = first is not None and count is not None and first.has_min_max and count.has_min_max
                # whichever bound is lower: all spans as long as the longest, or the records between the first and the last span
                most = min(count.max * group.num_rows, first.max + count.max - first.min) * width if known else TASK_BYTES
                parts = max(1, -(-most // TASK_BYTES))
                found += [Range(file, g, k, parts) for k in range(parts)]
        return found or [Range("", 0, 0, 1)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not partition.file:
            return
        system, _ = opened(self.spans)
        with system.open_input_file(partition.file) as f:
            table = pq.ParquetFile(f).read_row_group(partition.group).sort_by("first")
        location, first, n, start, step = (table.column(c).to_numpy() for c in ("location_id", "first", "num_values", "start_time", "sample_interval_s"))
        low, high = n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts
        width, at = len(self.features), [self.features.index(c) for c in self.names]
        most = max(1, CHUNK_BYTES // (4 * width))
        # pieces of a span that fit, in order of their place
        pieces = [(k, a, min(a + most, high[k])) for k in range(len(n)) for a in range(int(low[k]), int(high[k]), most)]
        buffer_system, path = opened(self.path)
        with buffer_system.open_input_file(path) as f:
            i = 0
            while i < len(pieces):
                k, a, b = pieces[i]
                begin = end = int(first[k] + a)
                j = i
                while j < len(pieces):
                    k2, a2, b2 = pieces[j]
                    far = int(first[k2] + b2)
                    if int(first[k2] + a2) - end > GAP_BYTES // (4 * width) or (j > i and far - begin > most):
                        break
                    end, j = max(end, far), j + 1
                raw = f.read_at((end - begin) * 4 * width, begin * 4 * width)
                if len(raw) != (end - begin) * 4 * width:
                    raise ValueError(f"the file ends before record {end} of a span of location {location[k]}")
                x = np.frombuffer(raw, "<f4").reshape(-1, width)
                for k2, a2, b2 in pieces[i:j]:
                    own = x[int(first[k2] + a2) - begin : int(first[k2] + b2) - begin]
                    ts = start[k2] + np.arange(a2, b2, dtype=np.int64) * int(step[k2])
                    columns = [pa.array(own[:, c].astype(float), from_pandas=True) for c in at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), location[k2])), pa.array(ts), *columns], names=["location_id", "ts", *self.names])
                i = j


class FlatRecords(DataSource):
    """Options: path of the flat file, spans (a folder of Parquet with location_id, first, num_values, start_time, sample_interval_s), features (names by comma)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return ", ".join(["location_id long", "ts long", *(f"`{c}` double" for c in self.options["features"].split(","))])

    def reader(self, schema):
        return Reader(schema, self.options)


def read_buffer(spark: SparkSession, path: str, spans: DataFrame, locations: DataFrame, features: list[str], wanted: list[str] | None = None) -> DataFrame:
    """Samples (location_id, ts, features) of a flat float32 file; NaN becomes null.

    spans are (id, location, datetime_start, num_values, sample_interval_s), id being the offset of the first sample.
    Raw locations become the ids of their names; spans of unknown locations go, and are not read. wanted: some of the
    features. A span beyond the end of the file raises an error.
    """
    named = locations.select(F.col("location_id").alias("location"), location_id(F.col("name")).alias("hashed")).groupBy("location").agg(F.min("hashed").alias("hashed"))
    known = spans.join(named, "location").where("num_values > 0")
    plan = known.select(F.col("hashed").alias("location_id"), F.col("id").cast("long").alias("first"), F.col("num_values").cast("long").alias("num_values"), F.col("datetime_start").cast("long").alias("start_time"), F.col("sample_interval_s").cast("long").alias("sample_interval_s"))
    # in order of place, so that a row group's records are near each other
    table = written(plan.repartitionByRange("first").sortWithinPartitions("first"))
    spark.dataSource.register(FlatRecords)
    columns = [f for f in features if wanted is None or f in wanted]
    fields = ", ".join(["location_id long", "ts long", *(f"`{c}` double" for c in columns)])
    folder = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else ""
    if not folder:
        return spark.createDataFrame([], fields)
    return spark.read.format(FORMAT).schema(fields).option("path", path).option("spans", folder).option("features", ",".join(features)).load()


def write_buffer(spans: DataFrame, path: str, features: list[str]) -> int:
    """Spans (id, an array for each of features) as a flat float32 file on a shared file system; returns the number of records.

    id is the offset of a span's first record. Every task writes its spans at their places, so that a task that runs
    again writes the same bytes again. Null becomes NaN.
    """
    import os

    width = 4 * len(features)
    local = path.removeprefix("file://").removeprefix("file:")
    records = spans.agg(F.max(F.col("id") + F.size(features[0]))).first()[0] or 0
    with open(local, "wb") as f:
        f.truncate(records * width)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        done = 0
        with open(local, "r+b") as f:
            for b in batches:
                for k, at in enumerate(b.column(0).to_pylist()):
                    rows = np.array([b.column(1 + c)[k].values.to_numpy(zero_copy_only=False).astype("<f4") for c in range(len(features))]).T
                    f.seek(at * width)
                    f.write(np.ascontiguousarray(rows).tobytes())
                    done += len(rows)
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["n"])

    wrote = spans.select("id", *(F.col(c).cast("array<double>") for c in features)).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if wrote != records:
        raise ValueError(f"spans leave gaps or overlap: {wrote} of {records} records")
    return records


def placed(spans: DataFrame, order: list[str], count: str = "num_values") -> DataFrame:
    """spans with id, the offset of their first record when they are written one after the other in the given order."""
    from loadgrid.operators.ranks import with_rank
    from loadgrid.operators.running import running

    ranked = written(with_rank(spans, order, "__rank").withColumns({"__all": F.lit(0), "__b": F.floor(F.col("__rank") / 4096)}))
    return running(ranked, ["__all"], "__b", ["__rank"], sums={"id": F.col(count).cast("long")}, own=False).drop("__rank", "__all", "__b")
