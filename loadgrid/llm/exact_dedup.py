"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z only. Of equal texts one row is live, the one with the
largest id; its SHA-256 digest is in the index. A digest that comes again is a hit: the filter's fingerprint points to
an entry whose whole digest is compared, and the later or smaller row is dropped. When a row with a larger id comes,
the live entry is deleted and the new one inserted.

Work is dealt out in two steps, so that no group of copies meets in one task: every task indexes its own rows and
passes on one entry for each digest, then the entries of a digest meet in one bucket. Rows find their group by a join on
the digest, which Spark may split where one digest is hot.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadgrid.llm.common import unused, written

SLOTS = 4
#: Entries of one task's index before it passes them on; bounds the memory of a task. In the second step, which passes
#: nothing on early, a task gets half of it on average.
MAX_ENTRIES = 400_000
ROWS = 500


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints, each pointing to a stored entry [key, *values].

    lookup() verifies hits against the stored key, so there are no false answers. insert() resizes from the stored keys
    when it finds no room. Keys are bytes of 16 or more that are spread evenly, such as digests.
    """

    def __init__(self, buckets: int = 1024):
        self.entries: list = []
        self.free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("q", bytes(8 * SLOTS * buckets))

    def __len__(self) -> int:
        return len(self.entries) - len(self.free)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _find(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.entries[self.refs[slot]][0] == key:
                    return slot
        return -1

    def lookup(self, key: bytes) -> list | None:
        slot = self._find(key)
        return None if slot < 0 else self.entries[self.refs[slot]]

    def insert(self, key: bytes, *values) -> list:
        entry = [key, *values]
        if self.free:
            ref = self.free.pop()
            self.entries[ref] = entry
        else:
            ref = len(self.entries)
            self.entries.append(entry)
        if not self._place(key, ref):
            self._grow()
        return entry

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        ref, self.marks[slot] = self.refs[slot], 0
        self.entries[ref] = None
        self.free.append(ref)
        return True

    def _place(self, key: bytes, ref: int) -> bool:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.refs[slot] = mark, ref
                    return True
        bucket = first
        for turn in range(200):  # move others out of the way
            slot = bucket * SLOTS + turn % SLOTS
            mark, self.marks[slot] = self.marks[slot], mark
            ref, self.refs[slot] = self.refs[slot], ref
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.refs[slot] = mark, ref
                    return True
        return False  # the entry in hand isn't lost: it is stored, and _grow() places all

    def _grow(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(e[0], ref) for ref, e in enumerate(self.entries) if e is not None):
                return

    def live(self):
        return (e for e in self.entries if e is not None)


def later(id_a, row_a, id_b, row_b) -> bool:
    """Whether a stays rather than b: the larger id, nulls last; of repeated rows the one that comes first."""
    if id_a is None or id_b is None:
        return id_b is None and (id_a is not None or row_a < row_b)
    return id_a > id_b or (id_a == id_b and row_a < row_b)


def _index(most: int | None):
    """Passes (digest, id, row, size) on with one row for each digest, whose id and row are the live one's.

    With most, an index of more entries is passed on early, so a digest may come again: only for what is merged later.
    """

    def out(index):
        entries = list(index.live())
        for i in range(0, len(entries), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in entries[i : i + 50_000]], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                names=["digest", "keep_id", "keep_row", "size"],
            )

    def run(rows):
        index = CuckooIndex()
        for batch in rows:
            for key, i, row, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = index.lookup(key)
                if entry is None:
                    index.insert(key, i, row, size)
                elif later(i, row, entry[1], entry[2]):
                    total = entry[3] + size
                    index.delete(key)
                    index.insert(key, i, row, total)
                else:
                    entry[3] += size
            if most is not None and len(index) > most:
                yield from out(index)
                index = CuckooIndex()
        yield from out(index)

    return run


def _parts(batches):
    """The batches in slices of ROWS, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _digests(batches):
    for b in _parts(batches):
        keys = [hashlib.sha256((t or b"").lower()).digest() for t in b.column(1).to_pylist()]  # bytes.lower() is A-Z only
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["id", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): the SHA-256 of every text, A-Z lower-cased; null counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_digests, "id long, digest binary")


def live_index(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, size) of rows (digest, id, row, size): one live entry for each digest.

    The result is itself such rows, so an index that was written can be updated with live_index(index union new).
    """
    schema = "digest binary, keep_id long, keep_row long, size long"
    own = written(rows.select("digest", "id", "row", "size").mapInArrow(_index(MAX_ENTRIES), schema))
    # nobody merges what the second step passes on: its indexes are bounded by their number, which is set, so that none is joined to another
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * own.count() // MAX_ENTRIES))
    return own.repartition(parts, "digest").mapInArrow(_index(None), schema)


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the entries whose digest is among gone(digest): deletion of live digests."""
    return index.join(gone.select("digest").distinct(), "digest", "left_anti")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. The row with the largest id stays; a null id is
    less than any other; of rows with the same id and equal texts exactly one is kept. Other columns of docs, whatever
    their names, have no effect. An empty table gives an empty result.
    """
    rows = written(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    index = live_index(rows.withColumn("size", F.lit(1).cast("long")))
    return rows.join(index, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops; columns and other rows stay as they are."""
    from pyspark.sql import types as T

    at = docs.columns.index(text_col)
    digest, keep, kept_digest = unused(docs, "__digest", "__keep", "__kept")

    def tag(batches):
        for b in _parts(batches):
            keys = [hashlib.sha256((t or "").encode("utf-8").lower()).digest() for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, digest])

    tagged = docs.mapInArrow(tag, T.StructType([*docs.schema.fields, T.StructField(digest, T.BinaryType())]))
    kept = exact_dedup(docs.select(id_col, text_col), id_col, text_col).where("kept").select(F.col(id_col).alias(keep), F.unhex("text_sha256").alias(kept_digest))
    same = F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(digest) == F.col(kept_digest))
    return tagged.join(kept, same, "left_semi").dropDuplicates([id_col, digest]).drop(digest)
