"""Substring dedup over windows of words by super-k-mers.

Every window of WINDOW words has a minimiser, the least hash of its runs of RUN words. Consecutive windows with one
minimiser overlap nearly all their words, so they travel as one packed string, a super-k-mer, and equal windows have
equal minimisers, so they meet in one bucket.

1. One pass over the texts describes each super-k-mer: minimiser, 128-bit digest of its packed string, document, place.
   Equal strings are summed up to one, with the least document and where it stands there, before anything is sorted: a
   passage that many documents share is a few rows of each task.
2. A bucket with one distinct string is done: its windows first start in the string's least document. Strings of other
   buckets are packed from the texts and travel to their buckets, where windows are sorted exactly: ranks of runs of
   1, 2, 4, ... words give ranks of twice as many, and those of windows. Buckets are dealt out in groups of bounded size.
3. A bucket of more than HOT strings, a common phrase in ever different surroundings, would be one task's work. Its
   windows travel one by one, as digests, and are counted by these.
4. Strings with a window that starts in a smaller document go back to their places, and the words covered are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadgrid.llm.common import mixed, written

WINDOW = 50
#: Words of the runs whose hashes are minimisers.
RUN = 8
#: Windows that one super-k-mer holds at most.
MOST = WINDOW - RUN + 1
CHUNK_BYTES = 2_000_000
#: Distinct strings of a bucket that are sorted together; a bucket of more is counted by digests of windows.
HOT = 2048
#: Distinct strings that meet in one task at about this number.
DEALT = 4096
DEALT_BYTES = 2_000_000


def _batches(batch: pa.RecordBatch, column: int):
    """(first row, texts as lists of words in UTF-8) of slices of a batch of about CHUNK_BYTES."""
    texts, size, first = [], 0, 0
    for k, t in enumerate(batch.column(column)):
        t = (t.as_py() or "").encode("utf-8", "surrogatepass")
        # exactly ASCII white space
        texts.append(t.split())
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, texts
            texts, size, first = [], 0, k + 1
    if texts:
        yield first, texts


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every width consecutive values, from those of powers of two."""
    least, span = x, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, start, number of windows) of each run of windows of a text with one minimiser, cut at MOST windows."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = word_hashes(words)
    runs = np.zeros(len(words) - RUN + 1, np.uint64)
    for j in range(RUN):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(runs)]
    least = _sliding_least(mixed(runs, 5), MOST)
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    # a run of more windows is cut from its own beginning, so that equal texts are cut alike
    lengths = np.diff(np.append(begins, n))
    pieces = -(-lengths // MOST)
    owner = np.repeat(np.arange(len(begins)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begins[owner] + nth * MOST
    return least[start], start, np.minimum(MOST, begins[owner] + lengths[owner] - start)


def _described(batches):
    names = ["doc", "text_hash", "bucket", "string", "start", "windows"]
    for b in batches:
        for first, texts in _batches(b, 2):
            rows, buckets, strings, starts, windows = [], [], [], [], []
            for k, words in enumerate(texts):
                key, start, count = super_kmers(words)
                rows.append(np.full(len(key), first + k))
                buckets.append(key)
                starts.append(start)
                windows.append(count)
                strings += [hashlib.blake2b(b" ".join(words[s : s + c + WINDOW - 1]), digest_size=16).digest() for s, c in zip(start.tolist(), count.tolist(), strict=True)]
            rows = pa.array(np.concatenate(rows))
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(buckets).view(np.int64)), pa.array(strings, pa.binary()), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(windows).astype(np.int32))], names
                )


def _packed(batches):
    """Packed strings of the places (bucket, string, start, windows) of each text."""
    for b in batches:
        for first, texts in _batches(b, 0):
            out = [[], [], [], []]
            for k, words in enumerate(texts):
                for place in b.column(1)[first + k].as_py():
                    out[0].append(place["bucket"])
                    out[1].append(place["string"])
                    out[2].append(place["least"])
                    out[3].append(b" ".join(words[place["start"] : place["start"] + place["windows"] + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["bucket", "string", "least", "packed"])


def _digests(batches):
    """A row for each window of packed strings: (string, at, least, window), a window being named by 128 bits."""
    for b in batches:
        owner, offsets, digests = [], [], []
        for k, packed in enumerate(b.column(1)):
            words = packed.as_py().split(b" ")
            for s in range(len(words) - WINDOW + 1):
                owner.append(k)
                offsets.append(s)
                digests.append(hashlib.blake2b(b" ".join(words[s : s + WINDOW]), digest_size=16).digest())
        owner = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(owner), pa.array(offsets, pa.int32()), b.column(2).take(owner), pa.array(digests, pa.binary())], ["string", "at", "least", "window"])


def window_ranks(words: np.ndarray) -> np.ndarray:
    """Equal numbers for equal windows of WINDOW word codes, at every place, by sorting pairs of ranks of shorter runs."""
    rank, span = words.astype(np.int64), 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        pairs = rank[: len(rank) - step] * (rank.max() + 1) + rank[step:]
        _, rank = np.unique(pairs, return_inverse=True)
        span += step
    return rank


def _sorted(table: pa.Table) -> pa.Table:
    """Windows of whole buckets that start in a document before their string's: rows (string, at, windows, first) for runs of windows with one first document."""
    strings = [s.as_py().split(b" ") for s in table.column("packed")]
    codes = pa.array([w for s in strings for w in s], pa.binary()).dictionary_encode().indices.to_numpy()
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    rank = window_ranks(codes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(rank)]
    place = np.arange(len(rank)) - (ends - sizes)[owner]
    inside = place <= sizes[owner] - WINDOW
    rank, owner, place = rank[inside], owner[inside], place[inside]
    least = table.column("least").to_numpy()
    first = np.full(rank.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, rank, least[owner])
    first = first[rank]
    begins = np.concatenate([[True], (first[1:] != first[:-1]) | (owner[1:] != owner[:-1])])
    change = np.flatnonzero(begins)
    lengths = np.diff(np.append(change, len(first)))
    earlier = first[change] < least[owner[change]]
    change, lengths = change[earlier], lengths[earlier]
    rows = table.select(["string"]).take(pa.array(owner[change]))
    return rows.append_column("at", pa.array(place[change].astype(np.int32))).append_column("windows", pa.array(lengths.astype(np.int32))).append_column("first", pa.array(first[change]))


def _kept(batches):
    """(id, n_words, n_removed, kept_text) of each text, from its covered intervals."""
    for b in batches:
        for start, texts in _batches(b, 1):
            n, removed, kept = [], [], []
            for k, words in enumerate(texts):
                gone, size = b.column(2)[start + k].as_py(), len(words)
                if gone:
                    cover = np.zeros(size + 1, np.int64)
                    ends = np.array([(g["lo"], g["hi"]) for g in gone])
                    np.add.at(cover, ends[:, 0], 1)
                    np.add.at(cover, ends[:, 1], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
                n.append(size)
                removed.append(size - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(n)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)], ["id", "n_words", "n_removed", "kept_text"])


def removed_spans(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc, text_hash, spans): word intervals [lo, hi) of each document that are covered by windows whose words also start in
    a document with a smaller id; intervals may overlap. Documents without such windows have no row."""
    rows = docs.where(F.col(id_).isNotNull()).select(F.col(id_).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # WINDOW words have so many characters at least
    rows = rows.where(F.length("text") >= 2 * WINDOW - 1)
    described = written(rows.mapInArrow(_described, "doc long, text_hash long, bucket long, string binary, start int, windows int"))
    # the least document of each string, and where it stands there
    strings = described.groupBy("string").agg(F.min(F.struct("doc", "text_hash", "start", "windows", "bucket")).alias("place"), F.max("doc").alias("last"))
    strings = written(strings.select("string", "place.*", "last"))
    buckets = written(strings.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    places = strings.join(buckets.hint("merge"), "bucket", "left_semi").select("doc", "text_hash", F.struct("bucket", "string", F.col("doc").alias("least"), "start", "windows").alias("place"))
    places = places.groupBy("doc", "text_hash").agg(F.collect_list("place").alias("places"))
    # repeated rows pack the same strings again, which changes nothing
    packed = written(rows.join(places, ["doc", "text_hash"]).select("text", "places").mapInArrow(_packed, "bucket long, string binary, least long, packed binary"))
    hot = buckets.where(F.col("size") > HOT).select("bucket")
    usual = packed.join(hot, "bucket", "left_anti")
    n, size = usual.agg(F.count("*"), F.coalesce(F.sum(F.length("packed")), F.lit(0))).first()
    parts = max(1, -(-n // DEALT), -(-size // DEALT_BYTES))
    result = "string binary, at int, windows int, first long"
    found = usual.groupBy(F.pmod("bucket", F.lit(parts)).alias("deal")).applyInArrow(_sorted, result)
    windows = written(packed.join(hot, "bucket", "left_semi").select("string", "packed", "least").mapInArrow(_digests, "string binary, at int, least long, window binary"))
    firsts = windows.groupBy("window").agg(F.min("least").alias("first"), F.max("least").alias("final")).where("first < final").drop("final")
    by_window = windows.join(firsts, "window").where("first < least").select("string", "at", F.lit(1).alias("windows"), "first")
    # all windows of a string start in its least document
    own = strings.where("doc < last").select("string", F.lit(0).alias("at"), "windows", F.col("doc").alias("first"))
    firsts = found.unionByName(by_window).unionByName(own)
    firsts = written(firsts.groupBy("string").agg(F.collect_list(F.struct("at", F.col("windows").alias("n"), "first")).alias("firsts")))
    earlier = F.filter("firsts", lambda f: f["first"] < F.col("doc"))
    hits = described.drop("bucket").join(firsts.hint("merge"), "string").select("doc", "text_hash", "start", earlier.alias("firsts")).where(F.size("firsts") > 0)
    spans = F.transform("firsts", lambda f: F.struct((F.col("start") + f["at"]).alias("lo"), (F.col("start") + f["at"] + f["n"] + (WINDOW - 1)).alias("hi")))
    return hits.select("doc", "text_hash", spans.alias("spans")).groupBy("doc", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, kept_text): each document without the words of windows that also start in a document with a smaller id.

    Words are runs of anything but ASCII white space, kept ones are joined by one space. Windows are judged on the input.
    A null text has no words; texts of fewer than WINDOW words lose none. A row with a null id loses nothing and takes
    nothing from others. Rows that repeat an id are judged each by its own text, and take nothing from each other. A
    window that a document repeats itself stays. An empty table gives no rows. Other columns are ignored.
    """
    spans = written(removed_spans(docs, text, id_))
    rows = docs.select(F.col(id_).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[id_]
    # spans grow with the input, as do shared buckets and repeated strings: no size of them is sent to all executors
    return rows.join(spans.hint("merge"), ["doc", "text_hash"], "left").select("doc", "text", "spans").mapInArrow(_kept, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_)
