"""Scores of probabilistic forecasts.

forecasts are long (keys, ts, quantile, value), truth (keys, ts, value). Runs of one location are scored one by one and
averaged where the scores say so. All quantiles are scored in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.operators.places import first_of
from loadgrid.operators.resample import bare
from loadgrid.operators.running import in_one_task
from loadgrid.operators.selection import percentiles

#: Fixed value: the weight of recall in the F score.
BETA = 10.0
ALL = ("crps", "mae", "precision", "recall", "fbeta", "ldn_monthly_mape", "odn_monthly_mape", "loss")


def paired(forecast: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, quantile, value, truth) at times that both have."""
    return forecast.join(truth.select(*keys, "ts", F.col("value").alias("truth")), [*keys, "ts"])


def fine(x: Column) -> Column:
    """x, zero where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def pinball(q: Column, truth: Column, value: Column) -> Column:
    error = truth - value
    return F.when(error >= 0, q * error).otherwise((q - 1) * error)


def crps(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, crps): twice the mean pinball loss over levels, averaged over times."""
    return pairs.groupBy(*keys).agg((2 * F.avg(pinball(F.col("quantile"), F.col("truth"), F.col("value")))).alias("crps"))


def mae(pairs: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """(keys, quantile, mae): mean error over the range of the truth between its 0.01 and 0.99 quantiles, per run, averaged
    over runs; missing values count as 0 in errors, and not in the range. A run may be of any length, see percentiles()."""
    zero = lambda c: F.coalesce(bare(F.col(c)), F.lit(0.0))
    group = [*keys, run, "quantile"]
    error = F.avg(F.abs(zero("truth") - zero("value"))).alias("e")
    low, high = 0.01, 0.99
    if in_one_task(pairs):
        truth = bare(F.col("truth"))
        each = pairs.groupBy(*group).agg(error, F.abs(F.percentile(truth, F.lit(high)) - F.percentile(truth, F.lit(low))).alias("range"))
    else:
        ends = percentiles(pairs, group, "truth", {"__low": low, "__high": high})
        each = pairs.groupBy(*group).agg(error).join(ends, group, "left").withColumn("range", F.abs(F.col("__high") - F.col("__low")))
    return each.groupBy(*keys, "quantile").agg(fine(F.avg(F.try_divide("e", "range"))).alias("mae"))


def exceedance(pairs: DataFrame, keys: list[str], run: str = "run", limit: str = "limit", beta: float = BETA) -> DataFrame:
    """(keys, quantile, precision, recall, fbeta) of crossing the limit: above it, or at or below a negative one.

    Precision and recall are taken per run, 0 where nothing could be right, and averaged over runs.
    """
    crosses = lambda c: F.when(F.col(limit) >= 0, F.col(c) > F.col(limit)).otherwise(F.col(c) <= F.col(limit))
    hit, said, real = crosses("truth") & crosses("value"), crosses("value"), crosses("truth")
    each = pairs.groupBy(*keys, run, "quantile").agg(F.count_if(hit).alias("hit"), F.count_if(said).alias("said"), F.count_if(real).alias("real"))
    share = lambda of: F.coalesce(F.try_divide(F.col("hit"), F.col(of)), F.lit(0.0))
    mean = each.groupBy(*keys, "quantile").agg(F.avg(share("said")).alias("precision"), F.avg(share("real")).alias("recall"))
    b = beta**2
    return mean.withColumn("fbeta", fine(F.try_divide((1 + b) * F.col("recall") * F.col("precision"), b * F.col("precision") + F.col("recall"))))


def monthly_mape(forecast: DataFrame, truth: DataFrame, keys: list[str], kernel_forecast: int, kernel_truth: int, low: bool = False) -> DataFrame:
    """(keys, mape): peaks of kernel_forecast predicted steps against peaks of kernel_truth true ones, mean of |gt - pred| / gt.

    forecast and truth are (keys, pos, value), the forecast being the level that stands for peaks; low: troughs. Windows
    that aren't full are left out. A negative truth stays negative in the denominator.
    """
    peak = F.min if low else F.max

    def pooled(rows: DataFrame, k: int, name: str) -> DataFrame:
        w = rows.groupBy(*keys, F.floor(F.col("pos") / k).alias("month")).agg(peak("value").alias(name), F.count("*").alias("n"))
        return w.where(F.col("n") == k).drop("n")

    joined = pooled(forecast, kernel_forecast, "pred").join(pooled(truth, kernel_truth, "gt"), [*keys, "month"])
    return joined.groupBy(*keys).agg(F.avg(F.try_divide(F.abs(F.col("gt") - F.col("pred")), F.col("gt"))).alias("mape"))


def pinball_loss(pairs: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """(keys, loss): the mean over masked points for each level, averaged over levels."""
    each = pairs.where(F.col(mask) == 1).groupBy(*keys, "quantile").agg(F.avg(pinball(F.col("quantile"), F.col("truth"), F.col("value"))).alias("loss"))
    return each.groupBy(*keys).agg(F.avg("loss").alias("loss"))


def mixture_nll(components: Column, truth: Column, eps: float = 1e-6) -> Column:
    """Negative log likelihood of truth under a mixture, without the constant of 2 pi; variances are at least eps."""

    def one(c: Column) -> Column:
        var = F.greatest(c["sigma"] * c["sigma"], F.lit(eps))
        return c["logpi"] - (F.log(var) + (truth - c["mu"]) * (truth - c["mu"]) / var) / 2

    terms = F.transform(components, one)
    top = F.array_max(terms)
    return -(top + F.log(F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.exp(t - top))))


def mixture_loss(rows: DataFrame, keys: list[str], factor: float = 0.0, components: str = "components", targets: str = "targets", mask: str = "masks") -> DataFrame:
    """(keys, loss): mean over masked targets, any number of them for a mixture, plus factor times the mean variance."""
    each = F.transform(F.filter(F.arrays_zip(F.col(targets).alias("y"), F.col(mask).alias("m")), lambda z: z["m"] == 1), lambda z: mixture_nll(F.col(components), z["y"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    var = total(F.transform(components, lambda c: c["sigma"] * c["sigma"]))
    parts = rows.select(*keys, total(each).alias("s"), F.size(each).alias("n"), var.alias("v"), F.size(components).alias("k"))
    return parts.groupBy(*keys).agg((F.try_divide(F.sum("s"), F.sum("n")) + factor * F.try_divide(F.sum("v"), F.sum("k"))).alias("loss"))


def mse(truth: Column, value: Column) -> Column:
    return (truth - value) * (truth - value)


def soft_clip(loss: Column, alpha: float) -> Column:
    return loss / (1 + alpha * loss)


def weighted_loss(losses: DataFrame, weights: dict[str, float], keys: list[str], name: str = "name", value: str = "loss") -> DataFrame:
    """(keys, loss): weighted sum of named losses; names without a weight are ignored. No weight at all is an error."""
    active = {k: v for k, v in weights.items() if v}
    if not active:
        raise ValueError("no active loss")
    pairs = F.create_map(*(F.lit(x) for kv in active.items() for x in kv))
    return losses.where(F.col(name).isin(*active)).groupBy(*keys).agg(F.sum(pairs[F.col(name)] * F.col(value)).alias("loss"))


def valid_metrics(single_rate: bool, has_limit: bool, predict_days: int, enabled: dict[str, bool], month_days: int = 30) -> list[str]:
    """Names of the scores that are enabled and make sense."""
    needs = {"precision": has_limit and single_rate, "recall": has_limit and single_rate, "fbeta": has_limit and single_rate, "crps": single_rate, "mae": single_rate}
    needs |= {"ldn_monthly_mape": predict_days >= month_days, "odn_monthly_mape": predict_days >= month_days}
    return [m for m in ALL if enabled.get(m, False) and needs.get(m, True)]


def last_days(rows: DataFrame, total: int, keep: int, pos: str = "pos") -> DataFrame:
    """The last keep of total positions of each window: windows laid end to end make one series."""
    return rows.where(F.col(pos) >= total - keep)


def with_limits(rows: DataFrame, limits: DataFrame, key: str = "location", order: list[str] | None = None) -> DataFrame:
    """rows with limit and sign of their location, null if it has none. Of several rows of a location the first by order
    counts; without one that with the least values, column by column."""
    return rows.join(first_of(limits, [key], order or [], [c for c in limits.columns if c not in (order or [])]), key, "left")


def for_sign(scores: DataFrame, limits: DataFrame, low: bool, key: str = "location") -> DataFrame:
    """Scores of those locations whose sign asks for them: troughs (low) where it is ODN or BOTH, peaks where LDN or BOTH."""
    wanted = limits.where(F.col("sign").isin("BOTH", "ODN" if low else "LDN")).select(key).distinct()
    return scores.join(wanted, key, "left_semi")


def to_wide(report: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, quantile, value) as one column for each of names, metric_quantile or metric."""
    name = F.when(F.col("quantile").isNull(), F.col("metric")).otherwise(F.concat_ws("_", "metric", F.col("quantile").cast("string")))
    return report.withColumn("__name", name).groupBy(*keys).pivot("__name", names).agg(F.first("value"))


def to_long(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """to_wide() undone; missing values are left out."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names))
    rows = wide.select(*keys, F.inline(each)).where("value IS NOT NULL")
    level = F.regexp_extract("name", r"_([0-9.]+)$", 1)
    return rows.select(*keys, F.regexp_replace("name", r"_[0-9.]+$", "").alias("metric"), F.when(level != "", level.cast("double")).alias("quantile"), "value")


def summary(report: DataFrame, metrics: list[str], availability: str, group: str = "group", column: str = "availability") -> DataFrame:
    """(group, quantile, metric, value): means of the wanted metrics at one availability; no such row is an error."""
    rows = report.where(F.col("metric").isin(*metrics) & (F.col(column) == availability))
    if rows.isEmpty():
        raise ValueError("no such metric in the report")
    return rows.groupBy(group, "quantile", "metric").agg(F.avg("value").alias("value"))


def mean_absolute(report: DataFrame, metric: str) -> DataFrame:
    """(value): the mean of a metric's absolute values over locations."""
    return report.where(F.col("metric") == metric).agg(F.avg(F.abs("value")).alias("value"))
