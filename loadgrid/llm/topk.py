"""Exact top-k search by inner product over cover trees of queries and data.

Vectors are dealt into cells around pivots and cells into blocks of bounded size; each block of queries and each block
of data becomes a cover tree: a node is a ball around one of its points, and its children cover it at a smaller scale.
Two trees are searched together. A pair of nodes is dropped when its bound - inner product of the centres plus what
both radii can add - is below the worst kth score among the node's queries. Blocks of queries are tried in the same way
against whole cells, then against the blocks of the cells that are left, after each has met the data of its own cell.
Bounds only prune, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loadgrid.operators.tables import written

#: Rows of a block at most, about: a salt splits larger cells.
DATA_ROWS, QUERY_ROWS = 8192, 1024
#: Blocks of data that one task searches in turn for a group of queries.
BLOCKS_PER_TASK = 2
#: Blocks of queries that a block of data travels to together.
QUERY_BLOCKS = 16
#: Pivots are drawn from at most so many rows; they decide where rows go, not what is found. There is about one for each
#: ROWS_PER_PIVOT rows, within these bounds.
PIVOT_SAMPLE, PIVOTS, ROWS_PER_PIVOT = 4096, (16, 512), 4 * DATA_ROWS
#: Scores that a long can't hold count as the nearest one that it can.
LOWEST, HIGHEST = -(2**63), 2**63 - 1
LEAF = 256
#: Scales of successive levels of a tree.
BASE = 1.3


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x) of each component; vectors that are null or hold null, NaN or infinity go."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False)) & (F.size(x) > 0) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def pivots_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: points of a bounded sample, each the farthest from those before it."""
    most = min(max(PIVOTS[0], vectors.count() // ROWS_PER_PIVOT), PIVOTS[1])
    by_dim: dict[int, list] = {}
    for row in vectors.limit(PIVOT_SAMPLE).collect():
        by_dim.setdefault(len(row["v"]), []).append(row["v"])
    found = {}
    for dim, rows in by_dim.items():
        points = np.array(sorted(rows), np.float64)
        chosen, far = [0], ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(most, len(points)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
        found[dim] = points[chosen]
    return found


def matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _cells(pivots: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            cell = np.zeros(len(sizes), np.int32)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                if dim in pivots:
                    p = pivots[dim]
                    x = matrix(b.column(1).take(pa.array(at)), int(dim)).astype(np.float64)
                    cell[at] = ((p**2).sum(1) - 2 * x @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(cell)], names=["id", "v", "dim", "cell"])

    return run


class CoverTree:
    """points in the tree's order, ids likewise; nodes (start, stop, centre, radius, children)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        self.x = points.astype(np.float64)
        self.order, self.nodes = order, []
        self.most = int(max(abs(int(points.max())), abs(int(points.min()))))
        middle = self.x.mean(0)
        self._add(0, len(points), int(((self.x - middle) ** 2).sum(1).argmin()))
        self.x, self.ids = self.x[self.order], ids[self.order]
        self.whole = points[self.order] if self.most * self.most * points.shape[1] >= 2**53 else None

    def _add(self, start: int, stop: int, centre: int) -> int:
        own = self.order[start:stop]
        far = np.sqrt(((self.x[own] - self.x[centre]) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append(None)
        children, radius = [], float(far.max())
        if len(own) > LEAF and radius > 0:
            groups = self._cover(own, centre, radius / BASE)
            if groups and len(groups) <= max(2, len(own) // 8):  # else the points don't cluster at this scale
                at = start
                for c, members in groups:
                    self.order[at : at + len(members)] = members
                    at += len(members)
                at = start
                for c, members in groups:
                    children.append(self._add(at, at + len(members), c))
                    at += len(members)
        self.nodes[me] = (start, stop, self.x[centre], radius, children)
        return me

    def _cover(self, own: np.ndarray, centre: int, scale: float):
        """Greedy net: every point is within scale of its group's centre. None if that takes too many groups."""
        left, groups = own, []
        while len(left):
            if len(groups) > max(2, len(own) // 8):
                return None
            c = centre if not groups else int(left[0])
            near = ((self.x[left] - self.x[c]) ** 2).sum(1) <= scale * scale
            if near.any():
                groups.append((c, left[near]))
            left = left[~near]
        return groups if len(groups) > 1 else None


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.worst = np.full(n, -np.inf)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            at = np.flatnonzero(scores >= max(self.worst[q], np.partition(scores, -self.k)[-self.k]))
        else:
            at = np.flatnonzero(scores >= self.worst[q])
        if not len(at):
            return
        s, i = np.concatenate([self.scores[q], scores[at].astype(np.int64)]), np.concatenate([self.ids[q], ids[at]])
        top = np.lexsort((i, ~s))[: self.k]  # ~s falls as s grows, and can't overflow
        self.scores[q], self.ids[q] = s[top], i[top]
        if len(top) == self.k:
            self.worst[q] = np.nextafter(float(s[top[-1]]), -np.inf) if abs(s[top[-1]]) >= 2**53 else s[top[-1]]


def products(queries: CoverTree, data: CoverTree, qs: slice, ds: slice) -> np.ndarray:
    """Inner products, exact: by doubles where these hold all of them, else by whole numbers, within the range of a long."""
    if queries.most * data.most * queries.x.shape[1] < 2**53:
        return queries.x[qs] @ data.x[ds].T
    own = lambda t, at: (t.x[at].astype(np.int64) if t.whole is None else t.whole[at]).astype(object)
    return np.clip(own(queries, qs) @ own(data, ds).T, LOWEST, HIGHEST).astype(np.int64)


def search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Offers best what the dual-tree walk doesn't prune."""
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        qs, qe, qc, qr, qkids = queries.nodes[a]
        ds, de, dc, dr, dkids = data.nodes[b]
        bound = qc @ dc + qr * np.sqrt(dc @ dc) + dr * np.sqrt(qc @ qc) + qr * dr
        if bound + 1e-6 * abs(bound) + 1 < best.worst[qs:qe].min():
            continue
        if dkids and (not qkids or dr >= qr):
            # nearest last, so that it is searched first
            stack += [(a, c) for c in sorted(dkids, key=lambda c: qc @ data.nodes[c][2])]
        elif qkids:
            stack += [(c, b) for c in qkids]
        else:
            scores = products(queries, data, slice(qs, qe), slice(ds, de))
            ids = data.ids[ds:de]
            for q in range(qs, qe):
                row = scores[q - qs]
                own = ids == queries.ids[q]
                best.offer(q, *((row[~own], ids[~own]) if own.any() else (row, ids)))


BLOCK = "dim int, cell int, salt long, n long, centre binary, radius double, ids binary, rows binary, data binary, kind string"


def _block(rows: pa.Table) -> pa.Table:
    dim = rows["dim"][0].as_py()
    x, ids, places = matrix(rows["v"], dim), rows["id"].to_numpy(), rows["row"].to_numpy()
    turn = np.lexsort((places, ids))
    x, ids, places = x[turn], ids[turn], places[turn]
    kind = next(t for t in ("int16", "int32", "int64") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
    fine = x.astype(np.float64)
    centre = fine.mean(0)
    radius = float(np.sqrt(((fine - centre) ** 2).sum(1).max()))
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "cell": rows["cell"].slice(0, 1), "salt": rows["salt"].slice(0, 1), "n": pa.array([len(ids)], pa.int64()),
        "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [radius], "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "rows": pa.array([places.astype(np.int64).tobytes()], pa.binary()),
        "data": pa.array([x.astype(kind).tobytes()], pa.binary()), "kind": [kind],
    })


def blocks(cells: DataFrame, rows: int) -> DataFrame:
    """One row per block of cells (id, row, v, dim, cell); a cell is salted into as many blocks as its rows need."""
    counts = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).alias("salts"))
    salted = cells.join(F.broadcast(counts), ["dim", "cell"])  # at most PIVOTS rows for each dimension
    return salted.select("id", "row", "v", "dim", "cell", F.pmod(F.xxhash64("id", "row"), "salts").alias("salt")).groupBy("dim", "cell", "salt").applyInArrow(_block, BLOCK)


FOUND = "query_row long, query_id long, vec_id long, score long, dim int, cell int, salt long"


def _search(k: int):
    """Some blocks of queries (side 0) against some of data (side 1), each with the queries' blocks that it is for; the
    queries' present worst scores are in worst. A block's tree is made once."""

    def tree(row: dict) -> CoverTree:
        ids = np.frombuffer(row["ids"], np.int64)
        return CoverTree(np.frombuffer(row["data"], row["kind"]).astype(np.int64).reshape(len(ids), -1), ids)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("cell", "ascending"), ("salt", "ascending"), ("d_cell", "ascending"), ("d_salt", "ascending")]).to_pylist()
        asking = {}
        for row in rows:
            if row["side"] == 0:
                queries = tree(row)
                best = Best(len(queries.ids), k)
                best.worst[:] = -np.inf if row["worst"] is None else row["worst"]
                asking[row["cell"], row["salt"]] = queries, best, row
        for row in rows[len(asking) :]:
            data = tree(row)
            for q in row["wanted"]:
                queries, best, _ = asking[q["cell"], q["salt"]]
                search(queries, data, best)
        parts = []
        for queries, best, row in asking.values():
            n = [len(i) for i in best.ids]
            places = np.frombuffer(row["rows"], np.int64)[queries.order]
            total = sum(n)
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int64), pa.int64())
            parts.append(pa.table({
                "query_row": pa.array(np.repeat(places, n), pa.int64()), "query_id": pa.array(np.repeat(queries.ids, n), pa.int64()), "vec_id": cat(best.ids), "score": cat(best.scores),
                "dim": pa.array([row["dim"]] * total, pa.int32()), "cell": pa.array([row["cell"]] * total, pa.int32()), "salt": pa.array([row["salt"]] * total, pa.int64()),
            }))
        return pa.concat_tables(parts)

    return run


def searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the data of its block's pairs (dim, cell, salt, d_cell, d_salt, worst).

    Neighbouring blocks of queries form groups of QUERY_BLOCKS, and a task takes a group and BLOCKS_PER_TASK blocks of
    data: a data block travels once for each group, whose queries are far smaller than it.
    """
    payload = ["n", "ids", "rows", "data", "kind"]
    # windows over blocks, of which there is one for some thousand rows
    groups = queries.select("dim", "cell", "salt", F.floor((F.row_number().over(Window.partitionBy("dim").orderBy("cell", "salt")) - 1) / QUERY_BLOCKS).alias("group"))
    wanted = pairs.join(groups, ["dim", "cell", "salt"]).groupBy("dim", "group", "d_cell", "d_salt").agg(F.collect_list(F.struct("cell", "salt", "worst")).alias("wanted"))
    tasks = written(wanted.withColumn("task", F.floor((F.row_number().over(Window.partitionBy("dim", "group").orderBy("d_cell", "d_salt")) - 1) / BLOCKS_PER_TASK)))
    right = tasks.join(data.select("dim", F.col("cell").alias("d_cell"), F.col("salt").alias("d_salt"), *payload), ["dim", "d_cell", "d_salt"])
    right = right.withColumns({"side": F.lit(1), "cell": F.lit(-1), "salt": F.lit(-1).cast("long"), "worst": F.lit(None).cast("double")})
    left = tasks.select("dim", "group", "task", F.inline("wanted")).groupBy("dim", "group", "task", "cell", "salt").agg(F.max("worst").alias("worst"))
    left = left.join(queries.select("dim", "cell", "salt", *payload), ["dim", "cell", "salt"]).withColumns({"side": F.lit(0), "d_cell": F.lit(-1), "d_salt": F.lit(-1).cast("long"), "wanted": F.lit(None).cast(tasks.schema["wanted"].dataType)})
    return right.unionByName(left).groupBy("dim", "group", "task").applyInArrow(_search(k), FOUND)


def bounded(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Those pairs of a block of queries (q_centre, q_radius, worst) and a set of data (d_centre, d_radius) that can give anything; only keep of their columns."""

    def run(batches):
        for b in batches:
            fits = []
            for q, qr, d, dr, worst in zip(*(b.column(c).to_pylist() for c in ("q_centre", "q_radius", "d_centre", "d_radius", "worst")), strict=True):
                q, d = np.frombuffer(q), np.frombuffer(d)
                bound = q @ d + qr * np.sqrt(d @ d) + dr * np.sqrt(q @ q) + qr * dr
                fits.append(worst is None or bound + 1e-6 * abs(bound) + 1 >= worst)
            yield b.filter(pa.array(fits, pa.bool_())).select(keep)

    return pairs.mapInArrow(run, pairs.select(keep).schema)


def cells_of(data: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, d_cell, d_centre, d_radius): a ball around all blocks of each cell; at most PIVOTS for each dimension."""

    def reach(batches):
        for b in batches:
            far, centres = [], []
            for dim, cell, centre, radius in zip(*(b.column(c).to_pylist() for c in ("dim", "cell", "centre", "radius")), strict=True):
                middle = pivots[dim][cell] if dim in pivots else np.zeros(dim)
                far.append(float(np.sqrt(((np.frombuffer(centre) - middle) ** 2).sum())) + radius)
                centres.append(middle.astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(centres, pa.binary()), pa.array(far, pa.float64())], names=["dim", "d_cell", "d_centre", "d_radius"])

    each = data.select("dim", "cell", "centre", "radius").mapInArrow(reach, "dim int, d_cell int, d_centre binary, d_radius double")
    return each.groupBy("dim", "d_cell").agg(F.min("d_centre").alias("d_centre"), (F.max("d_radius") * (1 + 1e-9) + 1e-6).alias("d_radius"))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best rows for each query: query_id, rank from 1, vec_id, score; all others, if there are fewer than k.

    is_query: a condition on id_col. Components become floor(scale * x), scores are inner products, ties go to the
    smaller id. Components and scores beyond 64 bits count as the nearest number of 64 bits. Vectors that are null,
    empty, or hold null or non-finite components take no part, nor do rows with a null id; vectors of different
    dimensions are not compared. Rows that share the query's id are the query's own; other rows that share an id compete
    one by one. Each row with a query's id is a query of its own, so a repeated id has its ranks as often. Other columns
    have no effect. An empty table gives an empty result.
    """
    rows = quantised(vectors.select(id_col, vector_col), id_col, vector_col, scale)
    pivots = pivots_of(rows)
    cells = written(rows.mapInArrow(_cells(pivots), "id long, v array<long>, dim int, cell int").withColumn("row", F.monotonically_increasing_id()))
    data = written(blocks(cells, DATA_ROWS))
    queries = written(blocks(cells.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id"), QUERY_ROWS))
    # descriptions only; the stated query set meets all data, block by block
    described = data.select("dim", F.col("cell").alias("d_cell"), F.col("salt").alias("d_salt"), F.col("centre").alias("d_centre"), F.col("radius").alias("d_radius"))
    wanted = queries.select("dim", "cell", "salt", F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"))
    home = wanted.join(described, (wanted["dim"] == described["dim"]) & (F.col("cell") == F.col("d_cell"))).select(wanted["dim"], "cell", "salt", "d_cell", "d_salt", F.lit(None).cast("double").alias("worst"))
    own = written(searched(home, queries, data, k))
    kth = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") == k)
    have = kth.groupBy("dim", "cell", "salt").agg(F.min("score").cast("double").alias("worst"), F.count("*").alias("have"))
    # a block's bound holds only if all its queries have k rows
    have = queries.select("dim", "cell", "salt", "n").join(have, ["dim", "cell", "salt"]).where("have = n").select("dim", "cell", "salt", "worst")
    open_ = wanted.join(have, ["dim", "cell", "salt"], "left")
    # at most PIVOTS cells for each dimension
    cell_pairs = open_.join(F.broadcast(cells_of(data, pivots)), "dim").where(F.col("cell") != F.col("d_cell"))
    cell_pairs = written(bounded(cell_pairs, ["dim", "cell", "salt", "q_centre", "q_radius", "worst", "d_cell"]))
    others = bounded(cell_pairs.join(described, ["dim", "d_cell"]), ["dim", "cell", "salt", "d_cell", "d_salt", "worst"])
    rest = searched(written(others), queries, data, k)
    ranked = own.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
