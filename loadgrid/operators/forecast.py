"""Forecast jobs: frames for inference, scoring with a user's predictor, timestamped quantile tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def inference_frame(samples: DataFrame, context: int, predict: int, step: int, features: list[str], key: str = "location") -> DataFrame:
    """The last context rows of each series and predict rows more, whose features are null. (key, ts, *features).

    samples must have exactly these columns, else an error is raised.
    """
    if set(samples.columns) != {key, "ts", *features}:
        raise ValueError(f"expected columns {sorted([key, 'ts', *features])}, got {sorted(samples.columns)}")
    w = Window.partitionBy(key).orderBy(F.desc("ts"))
    known = samples.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= context).drop("__n")
    last = samples.groupBy(key).agg(F.max("ts").alias("__last"))
    future = last.select(key, F.explode(F.sequence(F.col("__last") + step, F.col("__last") + step * predict, F.lit(step).cast("long"))).alias("ts"))
    return known.select(key, "ts", *features).unionByName(future, allowMissingColumns=True)


def inference_mask(value: Column, pos: Column, context: int, target: bool = True) -> Column:
    """1 where a value is there, 0 for the target from context on."""
    return F.when(value.isNull() | ((pos >= context) & F.lit(target)), 0).otherwise(1)


def predicted(windows: DataFrame, predictor: Callable, keys: list[str], x: str = "x", xm: str = "xm", outputs: int = 1, batch: int = 256) -> DataFrame:
    """(keys, pos, values): what predictor(X, Xm), arrays (rows, time), returns as an array (rows, steps, outputs).

    Rows are scored in batches within a task; the predictor travels once with the task. Null elements are NaN. Windows
    of different lengths are scored in batches of their own.
    """
    k = len(keys)
    rows = windows.select(*keys, x, xm)

    def run(batches):
        for b in batches:
            sizes = b.column(k).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes == sizes]):
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), batch):
                    part = b.take(pa.array(at[i : i + batch]))
                    get = lambda c, part=part, size=int(size): part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                    out = np.asarray(predictor(get(k), get(k + 1)), float)
                    n, steps, width = out.shape
                    if (n, width) != (part.num_rows, outputs):
                        raise ValueError(f"predictor returned {out.shape} for {part.num_rows} rows and {outputs} outputs")
                    rep = pa.array(np.repeat(np.arange(n), steps))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(rep) for c in range(k)), pa.array(np.tile(np.arange(steps), n)), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float64()))],
                        names=[*keys, "pos", "values"],
                    )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:k])
    return rows.mapInArrow(run, f"{fields}, pos long, values array<double>")


def mixtures(forecast: DataFrame, values: str = "values") -> DataFrame:
    """forecast with components, a mixture of normals, in place of values: (logpi, sigma, mu) of each in turn."""
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 3).cast("int") - 1), lambda i: F.struct(*(F.get(F.col(values), i * 3 + k).alias(n) for k, n in enumerate(("logpi", "sigma", "mu")))))
    return forecast.withColumn("components", each).drop(values)


def timed(forecast: DataFrame, keys: list[str], levels: list[float], step: int, first: str = "forecast_start") -> DataFrame:
    """(keys, ts, quantile, value) of (keys, first, pos, values), values being in the order of levels."""
    rows = forecast.select(*keys, (F.col(first) + F.col("pos") * step).alias("ts"), F.posexplode("values").alias("__q", "value"))
    return rows.select(*keys, "ts", F.element_at(F.array(*map(F.lit, levels)), F.col("__q") + 1).alias("quantile"), "value")


def fetched_spans(rows: DataFrame, hours: Column, key: str = "location_id") -> DataFrame:
    """Span rows of downloaded hourly weather: (key, start_time, sample_interval_s, num_values), a day more than hours."""
    return rows.groupBy(key).agg(F.min("ts").alias("start_time"), F.max(hours + 24).cast("long").alias("num_values")).withColumn("sample_interval_s", F.lit(3600))
