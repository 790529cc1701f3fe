"""Normalisation of windows: columns of arrays in, columns out. Missing elements are null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def statistics(values: Column, mask: Column | None = None, eps: float = 1.0) -> Column:
    """(mean, std): over the elements that are there and unmasked; std is the sample one plus eps, null below two."""
    seen = values if mask is None else F.zip_with(values, mask, lambda v, m: F.when(m == 1, v))
    seen = F.filter(seen, lambda v: v.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = F.try_divide(total(seen), F.size(seen))
    spread = total(F.transform(seen, lambda v: (v - mean) * (v - mean)))
    std = F.when(F.size(seen) > 1, F.sqrt(spread / (F.size(seen) - 1))) + eps
    return F.struct(mean.alias("mean"), std.alias("std"))


def _clamped(v: Column, clamp: float | None) -> Column:
    return v if clamp is None else F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(-clamp)), F.lit(clamp)))


def normalised(values: Column, mask: Column, stats: Column, clamp: float | None = None) -> Column:
    """Unmasked elements scaled, others as they are, all clamped; null becomes 0. Also for targets, with input statistics."""
    scaled = F.zip_with(values, mask, lambda v, m: F.when(m == 1, (v - stats["mean"]) / stats["std"]).otherwise(v))
    return F.transform(scaled, lambda v: F.coalesce(_clamped(v, clamp), F.lit(0.0)))


def restored(values: Column, stats: Column) -> Column:
    """Normalised quantiles back on the scale of the data."""
    return F.transform(values, lambda v: v * stats["std"] + stats["mean"])


def restored_mixture(components: Column, stats: Column) -> Column:
    """Mixture components (logpi, sigma, mu) back on the scale of the data."""
    return F.transform(components, lambda c: F.struct(c["logpi"].alias("logpi"), (c["sigma"] * stats["std"]).alias("sigma"), (c["mu"] * stats["std"] + stats["mean"]).alias("mu")))
