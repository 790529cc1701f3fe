"""Best-fit packing of token sequences.

Documents are tokenized, longer ones cut, and the pieces packed by a bounded-space online best fit: a fixed number of
open bins, counted by their free space, with one bit per free space that occurs. A piece goes where it leaves least
room; when it fits nowhere and the bound is reached, the fullest open bin closes first.

Pieces are dealt by a hash into shards of about pieces_per_shard, each packed on its own, longest first. A shard leaves
a few bins half empty, so sequences exceed the least number by roughly one in pieces_per_shard / 10.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loadgrid.llm.common import chunks, written

CAPACITY = 2048
OPEN_BINS = 4096
PIECES_PER_SHARD = 8192
#: The id that ends a document.
END = 0
#: Bytes of text that are tokenized at a time.
CHUNK_BYTES = 2_000_000
#: White space next to white space or to an end: there the split at single spaces isn't that of the tokenizer.
UNEVEN = r"^[\t-\r\x1c-\x1f \x{85}\p{Z}]|[\t-\r\x1c-\x1f \x{85}\p{Z}]$|[\t-\r\x1c-\x1f \x{85}\p{Z}]{2}|\x01"


class Ids:
    """Token ids of many texts at once, equal to those of the byte-level BPE in a tokenizers file.

    Its pre-tokenizer never joins what stands before a single space or a line break with what follows it, if no other
    white space is near. So texts are split there, and each distinct part of a batch is encoded once.

    With added, literals of the file's added tokens become their ids, as the tokenizer does by default; else they are
    plain text, as with its encode_special_tokens.
    """

    def __init__(self, path: str, added: bool = False):
        import json

        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        kind, model = spec["pre_tokenizer"], spec["model"]
        tokens = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if (kind["type"], kind["use_regex"], kind["add_prefix_space"], model["type"], model["ignore_merges"]) != ("ByteLevel", True, False, "BPE", False):
            raise ValueError("only byte-level BPE without a prefix space is known here")
        if any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only added tokens that take nothing around them are known here")
        self.added = list(tokens) if added else []
        shown = byte_letters()
        ranks = {bytes(shown[c] for c in word): i for word, i in model["vocab"].items() if word not in tokens}
        self.bpe = tiktoken.Encoding("ids", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=tokens)
        (self.line,) = self.bpe.encode_ordinary("\n")

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offset of each text's first one, with one offset more at the end."""
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        for token in self.added:
            uneven = uneven | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if uneven.any():
            return self._mixed(texts, uneven)
        return self._even(texts)

    def _mixed(self, texts: pa.Array, uneven: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = self._even(texts.filter(pa.array(~uneven)))
        parts, k = [], 0
        for text, whole in zip(texts.to_pylist(), uneven, strict=True):
            if whole:
                parts.append(self.bpe.encode_to_numpy(text, allowed_special=set(self.added), disallowed_special=()))
            else:
                parts.append(own[at[k] : at[k + 1]])
                k += 1
        sizes = np.array([len(p) for p in parts], np.int64)
        return (np.concatenate(parts) if parts else own).astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
        lists = pc.split_pattern(cut, "\x01")
        coded = lists.values.dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        blank = pc.or_(pc.equal(words, ""), pc.equal(words, "\n")).to_numpy(zero_copy_only=False)
        ids = self.bpe.encode_to_numpy("\n".join(words.filter(pa.array(~blank)).to_pylist()), disallowed_special=())
        ends = np.concatenate([np.flatnonzero(ids == self.line), [len(ids)]])  # a part holds no line break
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[~blank] = np.concatenate([[0], ends[:-1] + 1])[: (~blank).sum()]
        sizes[~blank] = (ends - np.concatenate([[0], ends[:-1] + 1]))[: (~blank).sum()]
        breaks = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
        ids = np.append(ids, self.line)
        starts[breaks], sizes[breaks] = len(ids) - 1, 1
        n = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(upto[-1]) + np.repeat(starts[codes] - upto[:-1], n)
        return ids[take].astype("<u4"), upto[lists.offsets.to_numpy()]


#: Fixed value: the public pattern by which such tokenizers split a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary shows each byte: printable ones themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(1)
def _ids(tokenizer: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(tokenizer, added=True)


def _pieces_of(tokenizer: str, capacity: int, end: int):
    def run(batches):
        encode = _ids(tokenizer)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for at, n in chunks(texts, CHUNK_BYTES):
                yield piece_table(b.column(0).slice(at, n), *encode(texts.slice(at, n)), capacity, end)

    return run


def piece_table(ids: pa.Array, tokens: np.ndarray, offsets: np.ndarray, capacity: int, end: int) -> pa.RecordBatch:
    """The pieces of each document: the first one takes what the whole capacities leave."""
    last = np.array([end], "<u4").tobytes()
    rows, docs = [], []
    for k in range(len(offsets) - 1):
        data = tokens[offsets[k] : offsets[k + 1]].tobytes() + last
        length = len(data) // 4
        start, size = 0, (length - 1) % capacity + 1
        piece = 0
        while start < length:
            rows.append((piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])))
            docs.append(k)
            start, size, piece = start + size, capacity, piece + 1
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(docs, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
        names=["id", "piece", "start", "length", "ids_crc32"],
    )


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; a null text counts as empty and is its end id alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces_of(tokenizer, capacity, end), "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in turn."""
    bits, by_free = 0, [[] for _ in range(capacity + 1)]
    n_open = made = 0
    bins, offsets = [], []

    def take(free: int) -> int:
        nonlocal bits, n_open
        b = by_free[free].pop()
        n_open -= 1
        if not by_free[free]:
            bits &= ~(1 << free)
        return b

    for size in sizes:
        fits = bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = take(free)
        else:
            if n_open >= open_bins:
                take((bits & -bits).bit_length() - 1)  # the fullest closes
            b, free, made = made, capacity, made + 1
        bins.append(b)
        offsets.append(capacity - free)
        left = free - size
        if left:
            by_free[left].append(b)
            bits |= 1 << left
            n_open += 1
    return bins, offsets


def _pack(capacity: int, open_bins: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(rows["length"].to_pylist(), capacity, open_bins)
        first = rows["shard"][0].as_py() << 32
        rows = rows.append_column("sequence_id", pa.array(np.array(bins, np.int64) + first))
        return rows.append_column("offset", pa.array(offsets, pa.int64())).drop_columns("shard")

    return run


def pack(parts: DataFrame, n_shards: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """parts (id, piece, start, length, ids_crc32) with sequence_id and offset, packed in n_shards shards."""
    shard = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(n_shards)).cast("long")
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return parts.withColumn("shard", shard).groupBy("shard").applyInArrow(_pack(capacity, open_bins), schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Places of all pieces of docs: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is packed as its end id alone. Rows with a null id, or with an id and a text that occur again,
    are packed like any other, so every row of docs has its pieces. Other columns have no effect. An empty table gives
    an empty result.
    """
    # tokenized once; shards are counted by pieces, of which a long document has many
    parts = written(pieces(docs, tokenizer, id_col, text_col, capacity))
    packed = pack(parts, max(1, round(parts.count() / pieces_per_shard)), capacity, open_bins)
    return packed.withColumnRenamed("id", id_col)
