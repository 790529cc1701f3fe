"""MinHash near-dedup with fast similarity sketching.

A document's set is its distinct word shingles. Its sketch has t coordinates: in each of up to t rounds every shingle is
hashed to one coordinate and a value; a coordinate keeps the least (round, value). Rounds end once all coordinates are
filled; t further rounds that fill one coordinate each guarantee that (Dahlgaard, Knudsen and Thorup, 2017). Two sets
agree in a coordinate with a probability equal to their Jaccard similarity, sharply concentrated. Coordinates are cut
into bands; documents that share a band are candidates, and a candidate pair is a link once the full sets confirm it.

Large groups of copies cost no pairs within the group:
1. Equal sets form a class, which takes part once.
2. The leader of a bucket is the member that shares buckets with most others, so that a group of near copies has its
   middle as leader in most of its buckets. Every other member is compared with it in full, once for each leader. That
   gives its links, and its difference from the leader: shingles that only one of the two sets has.
3. Members of a group (a leader and those compared with it) that are still in different components are tried by their
   differences: what two sets don't share is what their differences don't share. Two members that are no link of the
   leader both have differences that are mostly their own, while a link needs half of them in common. So differences
   are ordered by how many members have each element, elements of one component alone first, and a pair is a candidate
   only if it shares an element early enough in both (a prefix filter, which loses nothing). Candidates are compared in full.
Every pair that shares a bucket is thus linked, in the same component, or surely no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from loadgrid.llm.common import chunks, components, mixed, unused, written

BANDS, ROWS = 24, 4
#: A pair at the threshold of 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6.
CHUNK_BYTES = 2_000_000
#: Members that one task compares with a leader at a time, and bytes of their texts and of the leader's beside each.
GROUP, GROUP_BYTES = 64, 32_000_000
#: A leader's members meet its number of parts in up to so many tasks.
SALTS = 256
#: Places of candidates' texts are sent to all executors up to this many (24 MB), else joined by a shuffle.
FEW_PLACES = 1_000_000
EMPTY = np.uint64(2**64 - 1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, between ASCII white space, and the offsets of each text's."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(texts)))
    coded = pc.list_flatten(lists).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    if blank.any():  # a text without words is split into one empty word
        keep = ~blank[codes]
        owner = np.repeat(np.arange(len(counts)), counts)
        codes, counts = codes[keep], np.bincount(owner[keep], minlength=len(counts))
    return hashes[codes], np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and the offsets of each text's."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    times = np.uint64(0xD6E8FEB86659FD93)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        runs = runs * times + words[j : j + len(runs)]
    runs = mixed(runs)
    sets, sizes = [], np.zeros(len(n), np.int64)
    for d in range(len(n)):
        if n[d] >= width:
            own = np.unique(runs[at[d] : at[d + 1] - width + 1])
        elif n[d]:
            whole = int(n[d])
            for w in words[at[d] : at[d + 1]].tolist():
                whole = (whole * int(times) + w) % 2**64
            own = mixed(np.array([whole], np.uint64), 7)
        else:
            continue
        sets.append(own)
        sizes[d] = len(own)
    return np.concatenate(sets) if sets else runs[:0], np.concatenate([[0], np.cumsum(sizes)])


def sketches(values: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each set; an empty set's are EMPTY."""
    n = np.diff(at)
    out = np.full(len(n) * t, EMPTY)
    owner = np.repeat(np.arange(len(n)), n)
    for turn in range(2 * t):
        if not len(values):
            break
        h = mixed(values, turn)
        place = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if turn < t else np.uint64(turn - t)
        value = (np.uint64(turn) << np.uint64(56)) | (mixed(h, 1) >> np.uint64(8))
        np.minimum.at(out, owner * t + place.astype(np.int64), value)
        lacks = (out.reshape(-1, t) == EMPTY).any(1)
        more = lacks[owner]
        if not more.all():
            values, owner = values[more], owner[more]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r], 3)
    return key.view(np.int64)


_SKETCHED = "id long, spot long, n_shingles long, key1 long, key2 long, bands array<long>"


def _sketch(width: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            texts = pc.fill_null(b.column(2), "")
            for start, count in chunks(texts, CHUNK_BYTES):
                values, at = shingle_sets(texts.slice(start, count), width)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values, salt))]) for salt in (11, 12)]
                keys = [pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums]
                found = band_keys(sketches(values, at, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * bands), pa.array(found.ravel()))
                own = [b.column(k).slice(start, count) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), *keys, lists], names=["id", "spot", "n_shingles", "key1", "key2", "bands"])

    return run


_COMPARED = "a long, b long, n_a long, n_b long, common long, apart array<long>"


def _compare(width: int, apart: bool):
    """Sizes of the leader's set, each member's and their intersection; the leader's row comes with member null.

    With apart also the shingles that only one of the two has.
    """

    def run(rows: pa.Table) -> pa.Table:
        own = pc.is_null(rows["member"].combine_chunks())
        leader, _ = shingle_sets(rows["text"].filter(own).combine_chunks().slice(0, 1), width)
        others = rows.filter(pc.invert(own))
        texts = others["text"].combine_chunks()
        common, sizes, lists = [], [], []
        for start, count in chunks(texts, CHUNK_BYTES):
            values, at = shingle_sets(texts.slice(start, count), width)
            for d in range(count):
                mine = values[at[d] : at[d + 1]]
                spot = np.searchsorted(leader, mine)
                spot[spot == len(leader)] = 0
                both = leader[spot] == mine
                common.append(int(both.sum()))
                sizes.append(len(mine))
                if apart:
                    lists.append(np.concatenate([mine[~both], np.delete(leader, spot[both])]).view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists] if apart else np.zeros(len(sizes)))]).astype(np.int32)
        flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
        return pa.table({
            "a": others["leader"], "b": others["member"], "n_a": pa.array([len(leader)] * len(sizes), pa.int64()), "n_b": pa.array(sizes, pa.int64()),
            "common": pa.array(common, pa.int64()), "apart": pa.ListArray.from_arrays(pa.array(ends), flat),
        })

    return run


def dealt(pairs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leader, member, part) of pairs (a, b), and (leader, parts); sizes are (node, bytes) of texts.

    A part has about GROUP members, fewer of long texts: about GROUP_BYTES of theirs and of their leader's once for
    each, since a member's difference can be as large as both. So no part grows with the input.
    """
    salt = F.pmod(F.xxhash64("b", F.lit(0)), F.lit(SALTS)).alias("salt")
    known = pairs.join(sizes, pairs["b"] == sizes["node"]).select("a", "b", "bytes", salt)
    salted = known.groupBy("a", "salt").agg(F.count("*").alias("n"), F.sum("bytes").alias("own"))
    sums = salted.groupBy("a").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    held = F.col("own") + F.col("n") * F.col("bytes")
    parts = F.ceil(F.greatest(F.col("n") / GROUP, held / GROUP_BYTES)).alias("parts")
    counts = sums.join(sizes, sums["a"] == sizes["node"]).select(F.col("a").alias("leader"), parts)
    spread = salted.select("a", "salt").join(counts, F.col("a") == F.col("leader")).drop("a")
    members = known.join(spread, (F.col("a") == F.col("leader")) & (known["salt"] == spread["salt"]))
    members = members.select("leader", F.col("b").alias("member"), F.pmod(F.xxhash64("b"), "parts").alias("part"))
    return members, counts


def compared(pairs: DataFrame, texts: DataFrame, width: int, apart: bool = False) -> DataFrame:
    """pairs (a, b) of nodes with n_a, n_b, common: the sizes of their full sets and of the intersection; with apart also the difference.

    texts are (node, text, bytes). The pairs of an a are dealt into parts of bounded size, each with a's text.
    """
    members, counts = dealt(pairs, texts.select("node", "bytes"))
    members = members.join(texts, members["member"] == texts["node"]).select("leader", "part", "member", "text")
    leaders = counts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    leaders = leaders.join(texts, leaders["leader"] == texts["node"]).select("leader", "part", F.lit(None).cast("long").alias("member"), "text")
    return members.unionByName(leaders).groupBy("leader", "part").applyInArrow(_compare(width, apart), _COMPARED)


def _stars(classes: DataFrame) -> DataFrame:
    """(a, b): every class b that shares a bucket with others, with the bucket's leader a; classes are (node, bands)."""
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    inside = written(spread.join(sizes, "bucket"))
    central = inside.groupBy("node").agg(F.sum("members").alias("shared"))
    leading = inside.join(central, "node").groupBy("bucket").agg(F.max(F.struct("shared", (-F.col("node")).alias("minus"))).alias("first"))
    pairs = inside.join(leading.select("bucket", (-F.col("first.minus")).alias("a")), "bucket").select("a", F.col("node").alias("b"))
    return written(pairs.where("a <> b").distinct())


def _candidates(first: DataFrame, parts: DataFrame, is_link, percent: int) -> DataFrame:
    """(a, b) of classes in different parts (node, component) whose differences from a common leader allow a link.

    A link's sets differ by at most slack * (sum of both sizes) shingles, slack = (100 - percent) / (100 + percent). So
    differences of sizes d_x and d_y need at least (d_x + d_y - slack * (n_x + n_y)) / 2 elements in common.
    """
    over, under = 100 + percent, 100 - percent
    named = first.join(parts, first["b"] == parts["node"], "left").withColumn("part", F.coalesce("component", "b"))
    named = named.select("a", "b", "n_a", "n_b", F.size("apart").alias("d"), "part", is_link.alias("linked"), "apart")
    several = named.groupBy("a").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("a")
    held = written(named.join(several, "a", "left_semi").withColumn("e", F.explode("apart")).drop("apart"))
    often = held.groupBy("a", "e").agg(F.count("*").alias("often"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    alive = held.join(often.select("a", "e", "often"), ["a", "e"])
    own = Window.partitionBy("a", "b")
    # place of the element in the order, counted from 0; those that no other part has come first
    at = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "e")) - 1
    alive = alive.withColumn("at", at)
    least = lambda x: F.greatest(F.lit(1), F.ceil(x / (2 * over) - 1e-9))
    # a partner that is no link of the leader has more than slack * (n + n_a) elements; one that is has none at least
    alone = F.col("d") * over - under * F.col("n_b")
    short = F.col("at") <= F.col("d") - least(alone + under * F.col("n_a"))
    long = F.col("at") <= F.col("d") - least(alone - under * F.col("n_a"))
    alive = written(alive.withColumn("short", short).where(short | (long & ~F.col("linked"))))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("b", "n_b", "d", "part", "at")]
    x, y = alive.where("NOT linked").select("a", "e", *side("x")), alive.where("short").select("a", "e", *side("y"))
    need = least((F.col("d_x") + F.col("d_y")) * over - under * (F.col("n_b_x") + F.col("n_b_y")))
    fits = 100 * F.least("n_b_x", "n_b_y") >= percent * F.greatest("n_b_x", "n_b_y")
    early = (F.col("at_x") <= F.col("d_x") - need) & (F.col("at_y") <= F.col("d_y") - need)
    pairs = x.join(y, ["a", "e"]).where((F.col("part_x") != F.col("part_y")) & fits & early)
    return pairs.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()


def labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_groups() as (id, spot, n_shingles, component_id, kept), spot being a hash of the text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("spot"), F.col(text_col).cast("string").alias("text"))
    seen = written(base.mapInArrow(_sketch(width, bands, rows), _SKETCHED))
    key = ["key1", "key2", "n_shingles"]
    grouped = seen.where("n_shingles > 0").groupBy(*key).agg(F.min("id").alias("low"), F.first(F.struct("id", "spot")).alias("place"), F.first("bands").alias("bands"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()))
    stars = _stars(classes)

    # one text of each class that has a candidate
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    wanted = written(ends.join(classes, "node").select("node", F.col("place.id").alias("at_id"), F.col("place.spot").alias("at_spot")))
    if wanted.count() <= FEW_PLACES:
        wanted = F.broadcast(wanted)
    texts = base.join(wanted, (F.col("spot") == F.col("at_spot")) & F.col("id").eqNullSafe(F.col("at_id")))
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")).withColumn("bytes", F.octet_length("text").cast("long")))

    is_link = F.expr(f"100 * common >= {percent} * (n_a + n_b - common)")
    first = written(compared(stars, texts, width, apart=True))
    parts = components(first.where(is_link).select("a", "b"))
    rest = written(compared(_candidates(first, parts, is_link, percent), texts, width).where(is_link).select("a", "b"))
    if not rest.isEmpty():
        parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))

    ids = parts.join(classes.select("node", "low"), "node")
    lowest = ids.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(parts.join(lowest, "component").select("node", "component_id"))
    roots = classes.join(named, "node", "left").select(*key, F.when(named["node"].isNull(), F.col("low")).otherwise(F.col("component_id")).alias("root"))
    found = seen.select("id", "spot", *key).join(roots, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("root"))
    return found.select("id", "spot", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their sets of width-word shingles; a text
    with fewer words is one shingle. component_id is the smallest id that links reach, kept says that it is the row's
    own. Null and empty texts and texts of white space have no shingles and are linked with nothing. Ids should be
    unique. Rows that repeat an id are documents of their own: each has the component of its own text. Rows with a null
    id are linked like others; their component has a null id, and they are kept, only if no row in it has an id. Other
    columns have no effect. An empty table gives an empty result.
    """
    found = labelled(docs, id_col, text_col, width, percent, bands, rows)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with the rows that near_groups() keeps; columns and other rows stay as they are.

    Rows that repeat both id and text stay or go together. An empty table gives an empty result.
    """
    keep, spot = unused(docs, "__keep", "__spot")
    kept = labelled(docs.select(id_col, text_col), id_col, text_col, width, percent).where("kept").select(F.col("id").alias(keep), F.col("spot").alias(spot)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(spot))
    return docs.join(kept, same, "left_semi")
