"""Nearest points by a tree of splits that partitions space.

The tree comes from a bounded sample of the points and only says which points go together: every point is dealt to its
leaf, and each leaf's box is that of all its points. A point that looks for its nearest one tries its own leaf first,
which bounds the distance, and then just those leaves whose boxes reach within that bound. Points meet in groups of one
leaf and a block of those that look into it, so neither a hot leaf nor a hot place is one task's work.

Distances in the plane are those of degrees; on the sphere boxes are of unit vectors, whose straight distance rises with
the way on the surface, so that poles and the date line need no care.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadgrid.functions.scalars import EARTH_KM
from loadgrid.operators.tables import written

#: Points of a leaf at about this number, and leaves at most: the tree and its boxes stay below 10 MB.
LEAF, LEAVES = 1024, 65_536
#: Points of the sample that the splits come from.
SAMPLE = 200_000
#: Points that look into a leaf together, and of these at a time.
BLOCK, ROWS = 8192, 256
#: Distances that agree to so many digits of a kilometre are ties.
DIGITS = 9


def embedded(lat: np.ndarray, lon: np.ndarray, metric: str) -> np.ndarray:
    """Coordinates in which straight distances order points as the metric does."""
    if metric == "planar":
        return np.stack([lat, lon], 1)
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)


def kilometres(lat1, lon1, lat2, lon2, metric: str) -> np.ndarray:
    if metric == "planar":
        return np.sqrt((lat1 - lat2) ** 2 + (lon1 - lon2) ** 2) * 111.0
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def straight(km: np.ndarray, metric: str) -> np.ndarray:
    """The distance between embedded points that are so far apart, not less."""
    far = km / 111.0 if metric == "planar" else 2 * np.sin(np.minimum(km / EARTH_KM, np.pi) / 2)
    return far * (1 + 1e-9) + 1e-11


class Tree:
    """Splits by position: node k has children 2k+1 and 2k+2; leaves are numbered by their node."""

    def __init__(self, sample: np.ndarray, leaves: int):
        depth = max(0, int(leaves - 1).bit_length())
        self.first = 2**depth - 1  # of the lowest level
        self.axis, self.at = np.zeros(self.first, np.int64), np.zeros(self.first)
        parts = [sample]
        for level in range(depth):
            below = []
            for k, own in enumerate(parts):
                node = 2**level - 1 + k
                if len(own):
                    self.axis[node] = axis = int(np.argmax(np.ptp(own, axis=0)))
                    self.at[node] = np.median(own[:, axis])
                left = own[:, self.axis[node]] <= self.at[node]
                below += [own[left], own[~left]]
            parts = below
        self.low = self.high = None

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < self.first:  # all are on one level
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.at[node])
        return node

    def boxed(self, rows: list, width: int) -> Tree:
        """With the boxes (leaf, lows, highs) of leaves, and those of all nodes above."""
        self.low, self.high = np.full((2 * self.first + 1, width), np.inf), np.full((2 * self.first + 1, width), -np.inf)
        for leaf, *ends in rows:
            self.low[leaf], self.high[leaf] = ends[:width], ends[width:]
        for k in range(self.first - 1, -1, -1):
            self.low[k], self.high[k] = np.minimum(self.low[2 * k + 1], self.low[2 * k + 2]), np.maximum(self.high[2 * k + 1], self.high[2 * k + 2])
        return self

    def gap(self, node: int, x: np.ndarray) -> np.ndarray:
        """The distance of points from a node's box, infinite if it holds no point."""
        if self.low[node, 0] > self.high[node, 0]:
            return np.full(len(x), np.inf)
        return np.sqrt((np.maximum(0, np.maximum(self.low[node] - x, x - self.high[node])) ** 2).sum(1))

    def home(self, x: np.ndarray) -> np.ndarray:
        """A leaf with points near each point: that with the nearer box at each split."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, own = stack.pop()
            if node >= self.first:
                out[own] = node
            elif len(own):
                p = x[own]
                a, b = self.gap(2 * node + 1, p), self.gap(2 * node + 2, p)
                right = (b < a) | ((a == b) & (p[:, self.axis[node]] > self.at[node]))
                stack += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]
        return out

    def within(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves whose box is within that distance of a point."""
        points, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, own = stack.pop()
            own = own[self.gap(node, x[own]) <= far[own]]
            if len(own) and node >= self.first:
                points.append(own)
                leaves.append(np.full(len(own), node))
            elif len(own):
                stack += [(2 * node + 1, own), (2 * node + 2, own)]
        return np.concatenate(points), np.concatenate(leaves)


def _met(looking: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """(lat, lon, km, id) of looking (lat, lon, leaf): the nearest point of points (leaf, id, w_lat, w_lon) in that leaf."""
    looking = written(looking)
    # a row for each leaf: LEAVES at most
    blocks = F.broadcast(looking.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    left = looking.join(blocks, "leaf").select("lat", "lon", "leaf", F.pmod(F.xxhash64("lat", "lon"), "blocks").cast("int").alias("block"))
    right = points.join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "w_lat", "w_lon")

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")  # of equal distances the first one is the smaller id
        lat, lon = (a.column(c).to_numpy() for c in ("lat", "lon"))
        w_lat, w_lon = (b.column(c).to_numpy() for c in ("w_lat", "w_lon"))
        km, at = np.zeros(len(lat)), np.zeros(len(lat), np.int64)
        for k in range(0, len(lat) if len(w_lat) else 0, ROWS):
            far = np.round(kilometres(lat[k : k + ROWS, None], lon[k : k + ROWS, None], w_lat[None], w_lon[None], metric), DIGITS)
            at[k : k + ROWS] = far.argmin(1)
            km[k : k + ROWS] = far[np.arange(len(far)), at[k : k + ROWS]]
        if not len(w_lat):
            a = a.slice(0, 0)
            km, at = km[:0], at[:0]
        return pa.table({"lat": a.column("lat"), "lon": a.column("lon"), "km": pa.array(km), "id": b.column("id").take(pa.array(at))})

    kind = points.schema["id"].dataType.simpleString()
    return left.groupBy("leaf", "block").cogroup(right.groupBy("leaf", "block")).applyInArrow(meet, f"lat double, lon double, km double, id {kind}")


def nearest_points(places: DataFrame, points: DataFrame, metric: str = "planar") -> DataFrame:
    """(lat, lon, id, km) of distinct places (lat, lon): the nearest of points (id, w_lat, w_lon), ties to the smaller id.

    None of the coordinates may be null or NaN. Without points there are no rows.
    """
    names = [f"c{k}" for k in range(2 if metric == "planar" else 3)]
    kind = points.schema["id"].dataType.simpleString()
    # of points at one place the smallest id counts
    single = written(points.groupBy("w_lat", "w_lon").agg(F.min("id").alias("id")))
    n = single.count()
    sample = single.sample(fraction=min(1.0, SAMPLE / max(n, 1)), seed=1).select("w_lat", "w_lon").limit(2 * SAMPLE).toPandas()
    tree = Tree(embedded(sample["w_lat"].to_numpy(), sample["w_lon"].to_numpy(), metric), int(np.clip(-(-n // LEAF), 1, LEAVES)))

    def dealt(batches):
        for b in batches:
            x = embedded(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), metric)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(x)), *(pa.array(x[:, k]) for k in range(len(names)))], names=["w_lat", "w_lon", "id", "leaf", *names])

    leaved = written(single.select("w_lat", "w_lon", "id").mapInArrow(dealt, f"w_lat double, w_lon double, id {kind}, leaf long, " + ", ".join(f"{c} double" for c in names)))
    boxes = leaved.groupBy("leaf").agg(*(F.min(c) for c in names), *(F.max(c) for c in names)).collect()  # LEAVES at most
    if not boxes:
        return places.sparkSession.createDataFrame([], f"lat double, lon double, id {kind}, km double")
    tree.boxed([tuple(r) for r in boxes], len(names))

    def at_home(batches):
        for b in batches:
            x = embedded(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), metric)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.home(x))], names=["lat", "lon", "leaf"])

    def further(batches):
        for b in batches:
            lat, lon, km = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = embedded(lat, lon, metric)
            point, leaf = tree.within(x, straight(km + 10.0**-DIGITS, metric))
            new = leaf != tree.home(x)[point]
            yield pa.RecordBatch.from_arrays([pa.array(lat[point[new]]), pa.array(lon[point[new]]), pa.array(leaf[new])], names=["lat", "lon", "leaf"])

    schema = "lat double, lon double, leaf long"
    first = written(_met(places.select("lat", "lon").mapInArrow(at_home, schema), leaved, metric))
    second = _met(first.select("lat", "lon", "km").mapInArrow(further, schema), leaved, metric)
    best = first.unionByName(second).groupBy("lat", "lon").agg(F.min(F.struct("km", "id")).alias("best"))
    return best.select("lat", "lon", F.col("best.id").alias("id"), F.col("best.km").alias("km"))


def nearest_of_few(places: DataFrame, points: list[tuple], metric: str, kind: str) -> DataFrame:
    """nearest_points() with all points (id, w_lat, w_lon) in each task."""
    points = sorted(points)
    w_lat, w_lon = (np.array([p[k] for p in points], float) for k in (1, 2))
    ids = [p[0] for p in points]

    def run(batches):
        for b in batches:
            lat, lon = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for k in range(0, len(lat), ROWS):
                far = np.round(kilometres(lat[k : k + ROWS, None], lon[k : k + ROWS, None], w_lat[None], w_lon[None], metric), DIGITS)
                at = far.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(lat[k : k + ROWS]), pa.array(lon[k : k + ROWS]), pa.array([ids[j] for j in at.tolist()], pa.int64() if kind == "bigint" else None), pa.array(far[np.arange(len(at)), at])], names=["lat", "lon", "id", "km"])

    schema = f"lat double, lon double, id {kind}, km double"
    return places.select("lat", "lon").mapInArrow(run, schema) if points else places.sparkSession.createDataFrame([], schema)
