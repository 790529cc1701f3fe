"""Embedding whitening by spectrum slicing.

The covariance of all distinct vectors is summed exactly, in whole numbers: each task centres its vectors on one whole
vector near the mean and multiplies in blocks whose products a double holds exactly. Its size is that of the dimensions,
never that of the rows, so the eigenproblem is one small matrix for the driver:

1. Symmetric elimination of V - s, the factors L D L^T with pivots of one or two rows (Bunch and Parlett, 1971), has as
   many positive pivots as V has eigenvalues above s (Sylvester's law of inertia). Halving an interval by such counts
   isolates the k-th largest eigenvalue.
2. Rayleigh quotient iteration inside the interval converges cubically to its vector.
3. Counts on both sides of the result certify that it is number k; else the interval is halved further.

Eigenvalues that no double tells apart share an interval; their vectors are made orthogonal to each other.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadgrid.llm.common import written

#: Vectors that one block product takes at most.
BLOCK = 2048
EXACT = 2**53
LONG = 2**63
EPS = float(np.finfo(float).eps)


def positive_pivots(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are above 0: the inertia of its factors L D L^T.

    A pivot is the largest diagonal entry, or a block of two rows around the largest entry beside the diagonal where
    that is much larger; such a block has one eigenvalue of either sign.
    """
    a = np.array(a, float)
    found = 0
    while len(a):
        d = np.abs(np.diag(a))
        p = int(d.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        i, j = divmod(int(off.argmax()), len(a))
        if d[p] == 0 and off[i, j] == 0:
            break
        if d[p] >= 0.6404 * off[i, j]:
            found += a[p, p] > 0
            rest = np.arange(len(a)) != p
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p], a[p, rest] / a[p, p])
        else:
            found += 1
            rest = np.ones(len(a), bool)
            rest[[i, j]] = False
            side = a[rest][:, [i, j]]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_([i, j], [i, j])], side.T)
    return int(found)


def above(v: np.ndarray, s: float) -> int:
    return positive_pivots(v - s * np.eye(len(v)))


def _refined(v: np.ndarray, shift: float, known: list[np.ndarray], scale: float) -> tuple[float, np.ndarray]:
    """The eigenvalue near shift and its unit vector, orthogonal to the known ones: inverse iteration, then Rayleigh quotients."""
    n = len(v)
    x = np.cos(np.arange(1, n + 1) * (1.0 + 0.37 * len(known)))
    best, least = None, np.inf
    for turn in range(24):
        for u in known:
            x = x - u * (u @ x)
        x = x / np.linalg.norm(x)
        theta = float(x @ v @ x)
        lacks = float(np.linalg.norm(v @ x - theta * x))
        if turn > 2 and lacks >= least:
            break
        if turn > 2 or lacks < least:
            best, least = (theta, x), lacks
        if lacks == 0:
            break
        s = shift if turn < 3 else theta
        while True:
            try:
                y = np.linalg.solve(v - s * np.eye(n), x)
                if np.isfinite(y).all():
                    break
            except np.linalg.LinAlgError:
                pass
            s += 4 * EPS * scale  # exactly an eigenvalue
        x = y / np.linalg.norm(y)
    return best


def leading(v: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues of a covariance matrix and their unit vectors, up to count and as many as are above 0."""
    scale = float(np.trace(v))
    if not scale > 0:
        return []
    top = scale * (1 + 1e-12)
    floor = len(v) * EPS * scale
    found: list[tuple[float, np.ndarray]] = []
    for k in range(1, min(count, len(v)) + 1):
        if above(v, floor) < k:
            break
        low, high = floor, top  # eigenvalue k is above low and not above high
        while True:
            middle = (low + high) / 2
            narrow = high - low <= 64 * EPS * scale
            if not narrow and (above(v, high) < k - 1 or above(v, low) > k):
                if above(v, middle) >= k:
                    low = middle
                else:
                    high = middle
                continue
            theta, x = _refined(v, middle, [u for _, u in found], scale)
            slack = 64 * EPS * scale
            sure = narrow or (low - slack <= theta <= high + slack and above(v, theta + slack) < k <= above(v, theta - slack))
            if sure:
                found.append((theta, x))
                break
            if above(v, middle) >= k:
                low = middle
            else:
                high = middle
    return found


def quantised(embeddings: DataFrame, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(id, x): vectors without a null or a component that isn't finite, as whole numbers floor(256 * c)."""
    c = F.col(vector)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return embeddings.where(c.isNotNull() & (F.size(c) > 0) & ~bad).select(F.col(id_).alias("__id"), F.transform(c, lambda e: F.floor(e.cast("double") * 256).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(batches):
    """A task's sum of each dimension: rows (k, n, part)."""
    n, sums = 0, 0
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            n, sums = n + len(x), sums + (x.sum(0) if max(abs(int(x.max())), abs(int(x.min()))) * len(x) < LONG else x.astype(object).sum(0)).astype(object)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array([str(v) for v in sums])], ["k", "n", "part"])


def _scatter(centre: list[int]):
    """Sums of d and of d d^T over a task's vectors, d being the distance from centre, as rows (i, j, total): exact."""
    m = np.array(centre, object)

    def run(batches):
        n, sums, products = 0, 0, 0
        for b in batches:
            x = _matrix(b.column(0))
            for at in range(0, len(x), BLOCK):
                own = x[at : at + BLOCK]
                d = own.astype(object) - m if max(abs(int(own.max())), abs(int(own.min())), *map(abs, centre)) >= LONG // 2 else own - m.astype(np.int64)
                most = max(int(d.max()), -int(d.min()))
                if most * most * len(d) < EXACT:
                    f = d.astype(float)
                    pairs = (f.T @ f).astype(np.int64).astype(object)
                elif most * most * len(d) < LONG:
                    d = d.astype(np.int64)
                    pairs = (d.T @ d).astype(object)
                else:
                    d = d.astype(object)
                    pairs = d.T @ d
                n, sums, products = n + len(d), sums + d.astype(object).sum(0), products + pairs
        if n:
            size = len(centre)
            i, j = np.tril_indices(size)
            rows = [(-1, -1, n), *((-1, k, sums[k]) for k in range(size)), *zip(i.tolist(), j.tolist(), products[i, j], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([str(r[2]) for r in rows])], ["i", "j", "part"])

    return run


class Spectrum:
    """What whitening needs of the fit list: n, sums, mean, trace, leading eigenvalues and vectors, all small."""

    def __init__(self, n: int, sums: list[int], trace: float, pairs: list[tuple[float, np.ndarray]]):
        self.n, self.sums, self.trace, self.pairs = n, sums, trace, pairs


def fit(distinct: DataFrame, length: int, count: int) -> Spectrum:
    """The spectrum of the distinct vectors x of that length. Only sums come to the driver: length * (length + 1) / 2 products."""
    about = distinct.select("x").mapInArrow(_sums, "k int, n long, part string").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    centre = [int(s) // n for _, n, s in sorted(about)]
    parts = distinct.select("x").mapInArrow(_scatter(centre), "i int, j int, part string")
    # sums of 38 digits; what doesn't fit raises an error instead of being wrong
    total = {(i, j): int(t) for i, j, t in parts.groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("t")).collect()}
    n = total[-1, -1]
    d = [total[-1, k] for k in range(length)]
    v = np.empty((length, length))
    for i in range(length):
        for j in range(i + 1):
            v[i, j] = v[j, i] = float(Fraction(n * total[i, j] - d[i] * d[j], n * n))
    trace = float(sum((Fraction(n * total[k, k] - d[k] * d[k], n * n) for k in range(length)), Fraction(0)))
    return Spectrum(n, [d[k] + n * centre[k] for k in range(length)], trace, leading(v, count))


def _deviations(spectrum: Spectrum):
    """Sums over the dimensions of (n * x - S)^2, of each vector of a batch, as whole numbers of any size."""
    n, sums = spectrum.n, spectrum.sums
    squares = sum(s * s for s in sums)
    high, low = (np.array(p, object) for p in zip(*(divmod(s, 2**20) for s in sums), strict=True))

    def of(x: np.ndarray) -> list[int]:
        # n^2 x.x - 2 n x.S + S.S, with products of vectors in longs where these can't overflow
        most = max(abs(int(x.max())), abs(int(x.min())), 2**20)
        kind = np.int64 if most * max(most, *map(abs, high)) * len(sums) < LONG else object
        x = x.astype(kind)
        parts = ((x * x).sum(1), x @ high.astype(kind), x @ low.astype(kind))
        return [n * n * q - 2 * n * (h * 2**20 + w) + squares for q, h, w in zip(*(p.tolist() for p in parts), strict=True)]

    return of


def _projected(spectrum: Spectrum):
    """The whitened components of each vector of a batch."""
    n, sums = spectrum.n, spectrum.sums
    whole = [s // n for s in sums]
    rest = np.array([float(Fraction(s - w * n, n)) for s, w in zip(sums, whole, strict=True)])
    basis = np.array([u / np.sqrt(e) for e, u in spectrum.pairs]).reshape(len(spectrum.pairs), len(sums)).T

    def of(x: np.ndarray) -> np.ndarray:
        wide = max(abs(int(x.max())), abs(int(x.min())), *map(abs, whole)) >= LONG // 2
        near = (x.astype(object) - np.array(whole, object)).astype(float) if wide else (x - np.array(whole, np.int64)).astype(float)
        return (near - rest) @ basis

    return of


def whitened(embeddings: DataFrame, count: int = 4, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each vector on the leading components.

    Rows whose vector is null or empty, or holds a null, NaN or infinity, give no rows. A null or repeated id is kept as
    it is, and rows that repeat a vector count once in n, sums and covariance. If vectors differ in length, those of the
    most frequent length (ties: the longer one) take part and others give no rows. Components whose eigenvalue is
    numerically 0 (constant or dependent dimensions, one vector alone) have null in whitened; explained is null where
    the trace is 0, identity_error where no component has an eigenvalue. A deviation beyond 64 bits is null. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = quantised(embeddings, vector, id_)
    schema = f"{id_} {dict(embeddings.dtypes)[id_]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    # equal vectors meet before they are counted: a hot vector is one row of each task
    distinct = written(rows.select("x").distinct())
    by_length = distinct.groupBy(F.size("x").alias("len")).count().orderBy(F.desc("count"), F.desc("len")).first()
    if by_length is None:
        return spark.createDataFrame([], schema)
    length = by_length["len"]
    distinct = distinct.where(F.size("x") == length)
    spectrum = fit(distinct, length, count)
    found, shown = len(spectrum.pairs), min(count, length)
    projected, deviations = _projected(spectrum), _deviations(spectrum)

    def project(batches):
        for b in batches:
            if b.num_rows:
                w = projected(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(found)], [f"w{k}" for k in range(found)])

    error = None
    if found:
        w = distinct.select("x").mapInArrow(project, ", ".join(f"w{k} double" for k in range(found)))
        # covar_pop centres what it multiplies
        pairs = [F.covar_pop(f"w{i}", f"w{j}") - (1.0 if i == j else 0.0) for i in range(found) for j in range(i + 1)]
        error = w.agg(F.greatest(*(F.abs(p) for p in pairs), F.lit(0.0)).alias("e")).first()[0]
    n = spectrum.n
    explained = [e / spectrum.trace for e, _ in spectrum.pairs] + [0.0 if spectrum.trace > 0 else None] * (shown - found)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, size = _matrix(b.column(1)), b.num_rows
            deviation = [d if d < LONG else None for d in deviations(x)]
            w = np.concatenate([projected(x), np.zeros((size, shown - found))], 1)
            known = np.tile(np.arange(shown) < found, size)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(size), shown))),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * shown, n)),
                    pa.array([d for d in deviation for _ in range(shown)], pa.int64()),
                    pa.array(w.ravel(), mask=~known),
                    pa.array(explained * size, pa.float64()),
                    pa.array([error] * (size * shown), pa.float64()),
                ],
                [id_, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == length).select(F.col("__id").alias(id_), "x").mapInArrow(run, schema)
