"""Predicted mixtures of normal distributions: bounds, densities and quantiles.

A mixture is an array of components (logpi, sigma, mu). Mixtures of one group share the grid of values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadgrid.operators.tables import written

#: What is added to weights, means and deviations; the values of a grid between the bounds.
EPS = 1e-6
GRID = 1000
#: How many deviations a grid reaches beyond a mean, and by what share of its range it is padded.
SCALE, PAD = 4.0, 0.2


def bounds(mixtures: DataFrame, group: list[str], components: str = "components", scale: float = SCALE, pad: float = PAD) -> DataFrame:
    """(group, low, high): the range that all mixtures of a group reach, padded on both sides."""
    reach = lambda s: F.transform(components, lambda c: c["mu"] + s * scale * c["sigma"])
    ends = mixtures.groupBy(*group).agg(F.min(F.array_min(reach(-1))).alias("a"), F.max(F.array_max(reach(1))).alias("b"))
    return ends.select(*group, (F.col("a") - (F.col("b") - F.col("a")) * pad).alias("low"), (F.col("b") + (F.col("b") - F.col("a")) * pad).alias("high"))


_ERF = np.vectorize(math.erf, otypes=[float])


def cdf(weights: np.ndarray, sigma: np.ndarray, mu: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distribution of mixtures (rows, components) at x (rows, points)."""
    w = np.nan_to_num(weights) + EPS
    w = w / w.sum(1, keepdims=True)
    z = (x[:, None, :] - np.nan_to_num(mu)[:, :, None] - EPS) / (np.nan_to_num(sigma)[:, :, None] + EPS)
    return (w[:, :, None] * 0.5 * (1 + _ERF(z / math.sqrt(2)))).sum(1)


def density(weights: np.ndarray, sigma: np.ndarray, mu: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Density of mixtures (rows, components) at x (rows, points)."""
    w = np.nan_to_num(weights) + EPS
    sigma = np.nan_to_num(sigma)[:, :, None] + EPS
    z = (x[:, None, :] - np.nan_to_num(mu)[:, :, None] - EPS) / sigma
    return ((w / w.sum(1, keepdims=True))[:, :, None] * np.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))).sum(1)


def _by_size(lists: pa.Array):
    """For each number of components: which rows have it, and their weights, deviations and means as (rows, components)."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(at)).flatten()
        logpi, sigma, mu = (flat.field(f).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size) for f in ("logpi", "sigma", "mu"))
        yield at, np.exp(logpi), sigma, mu


def _on_bounds(mixtures: DataFrame, keys: list[str], group: list[str], components: str, each, fields: str) -> DataFrame:
    """(keys, fields): each(lists, low, high) gives the columns of fields, so many rows for each mixture, from its group's bounds."""
    joined = mixtures.join(bounds(mixtures, group, components), group).select(*keys, components, "low", "high")
    k = len(keys)
    names = [*keys, *(f.split()[0] for f in fields.split(", "))]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                columns = each(part.column(k), *(part.column(k + j).to_numpy(zero_copy_only=False) for j in (1, 2)))
                rep = pa.array(np.repeat(np.arange(part.num_rows), len(columns[0]) // part.num_rows))
                yield pa.RecordBatch.from_arrays([*(part.column(j).take(rep) for j in range(k)), *columns], names=names)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:k])
    return joined.mapInArrow(run, f"{own}, {fields}")


def quantiles(mixtures: DataFrame, keys: list[str], group: list[str], levels: list[float], n: int = GRID, components: str = "components") -> DataFrame:
    """(keys, quantile, value): the first of n values between the group's bounds at which the distribution reaches the
    level, the last one if none does. The distribution rises, so each level is found by bisection."""

    def each(lists, low, high):
        out = np.full((len(lists), len(levels)), np.nan)
        for at, w, sigma, mu in _by_size(lists):
            step = (high[at] - low[at]) / (n - 1)
            for j, q in enumerate(levels):
                a, z = np.zeros(len(at), int), np.full(len(at), n - 1)
                while (a < z).any():
                    m = (a + z) // 2
                    reached = cdf(w, sigma, mu, (low[at] + m * step)[:, None])[:, 0] >= q
                    z, a = np.where(reached & (a < z), m, z), np.where(~reached & (a < z), m + 1, a)
                out[at, j] = low[at] + a * step
        return pa.array(np.tile(np.array(levels, float), len(lists))), pa.array(out.ravel(), from_pandas=True)

    return _on_bounds(mixtures, keys, group, components, each, "quantile double, value double")


def distributions(mixtures: DataFrame, keys: list[str], group: list[str], n: int = 50, components: str = "components") -> DataFrame:
    """(keys, pos, x, reached): the distribution of each mixture on n values between its group's bounds."""

    def each(lists, low, high):
        x = low[:, None] + (high - low)[:, None] * np.arange(n) / max(n - 1, 1)
        out = np.full(x.shape, np.nan)
        for at, w, sigma, mu in _by_size(lists):
            out[at] = cdf(w, sigma, mu, x[at])
        return pa.array(np.tile(np.arange(n, dtype=np.int32), len(lists))), pa.array(x.ravel(), from_pandas=True), pa.array(out.ravel(), from_pandas=True)

    return _on_bounds(mixtures, keys, group, components, each, "pos int, x double, reached double")


def densities(mixtures: DataFrame, keys: list[str], group: list[str], n: int = 50, components: str = "components") -> DataFrame:
    """(keys, pos, x, density) on n values between the group's bounds; a mixture without components has density 0."""

    def each(lists, low, high):
        x = low[:, None] + (high - low)[:, None] * np.arange(n) / max(n - 1, 1)
        out = np.where(lists.is_null().to_numpy(zero_copy_only=False)[:, None], np.nan, np.zeros(x.shape))
        for at, w, sigma, mu in _by_size(lists):
            out[at] = density(w, sigma, mu, x[at])
        return pa.array(np.tile(np.arange(n, dtype=np.int32), len(lists))), pa.array(x.ravel(), from_pandas=True), pa.array(out.ravel(), from_pandas=True)

    return _on_bounds(mixtures, keys, group, components, each, "pos int, x double, density double")


def chosen(forecast: DataFrame, levels: list[float], quantile: str = "quantile") -> DataFrame:
    """Rows of the wanted levels; reading it raises an error if the forecast lacks a level."""
    level = F.round(quantile, 6)
    wanted = [round(q, 6) for q in levels]
    if not wanted:
        return forecast.where("false")
    # read for the check and for the rows: a forecast takes long to make
    rows = written(forecast.where(level.isin(wanted)))
    have = rows.select(level.alias("q")).agg(F.sort_array(F.collect_set("q")).alias("have"))
    missing = F.array_except(F.array(*map(F.lit, wanted)), "have")
    # one row, at most one entry for each wanted level
    checked = have.select(F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("forecast lacks quantiles "), missing.cast("string"))).cast("boolean")).otherwise(F.lit(True)).alias("__ok"))
    return rows.join(F.broadcast(checked), F.col("__ok"), "inner").drop("__ok")
