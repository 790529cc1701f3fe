"""Windows of samples for training and backtests: reading, splits, masks, filters, padding and batches.

A window is a row with a location, window_start and arrays of values; missing elements are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loadgrid.functions.scalars import shuffled, uniform
from loadgrid.operators import intervals as iv
from loadgrid.operators.ranks import with_rank
from loadgrid.operators.resample import bare
from loadgrid.operators.tables import written

DAY = 86400
#: What an epoch adds to a seed.
EPOCH = 1_000_003
#: For an interval in minutes, the least and most days of context; the days and intervals that are tried.
CONTEXT_LIMITS = {5: (7, 10), 10: (7, 14), 15: (11, 32), 30: (16, 64), 60: (16, 64), 1440: (32, 364), 10080: (64, 364)}
CONTEXT_DAYS, INTERVALS = (7, 10, 14, 16, 32, 64, 364), (5, 10, 15, 30, 60, 1440, 10080)


def time_source(windows: DataFrame, length: int, step: int) -> DataFrame:
    """(location_id, window_start, pos, unixtime, latitude, longitude) of windows (location_id, window_start, lat, lon)."""
    rows = windows.select("location_id", "window_start", "lat", "lon", F.posexplode(F.sequence(F.col("window_start"), F.col("window_start") + length - step, F.lit(step).cast("long"))).alias("pos", "unixtime"))
    return rows.select("location_id", "window_start", F.col("pos").cast("long").alias("pos"), "unixtime", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


def context_pairs(spark: SparkSession, days=CONTEXT_DAYS, intervals=INTERVALS, min_points: int = 32, most: int | None = None, limits: dict | None = CONTEXT_LIMITS) -> DataFrame:
    """(context_days, interval_minutes, points, pad_left, padded_length) of the valid pairs; reading none raises an error."""
    pairs = spark.createDataFrame([(d, i, *(limits or {}).get(i, (None, None))) for d in days for i in intervals], "context_days int, interval_minutes int, least int, most int")
    points = F.col("context_days") * 1440 / F.col("interval_minutes")
    ok = F.coalesce(F.col("context_days").between(F.col("least"), F.col("most")), F.lit(True)) & (F.col("context_days") * 1440 % F.col("interval_minutes") == 0) & (points >= min_points)
    valid = pairs.where(ok & (points <= most) if most else ok).select("context_days", "interval_minutes", points.cast("int").alias("points"))
    if valid.isEmpty():
        raise ValueError("no valid pair of context and interval")
    longest = F.lit(most).cast("int") if most else F.max("points").over(Window.partitionBy())  # a handful of rows
    return valid.withColumn("padded_length", longest).withColumn("pad_left", F.col("padded_length") - F.col("points"))


def benchmark_parts(a: DataFrame, locations: DataFrame, since: int, context: int) -> DataFrame:
    """(part, location_id, start, stop): intervals of the named locations from a time on, shortened by the context
    ("benchmark"), and all the rest of a ("rest"), by one sweep. Both are clean."""
    held = iv.clip(a.join(locations.select("location_id").distinct(), "location_id", "left_semi"), since, iv.FAR)
    parts = iv.sweep_parts([a, held], {"benchmark": lambda x, h: h > 0, "rest": lambda x, h: (x > 0) & (h == 0)})
    return parts.withColumn("stop", F.when(F.col("part") == "benchmark", F.col("stop") - context).otherwise(F.col("stop"))).where("stop > start")


def benchmark_split(a: DataFrame, locations: DataFrame, since: int, context: int) -> tuple[DataFrame, DataFrame]:
    """The two parts of benchmark_parts() by themselves."""
    parts = benchmark_parts(a, locations, since, context)
    return tuple(parts.where(F.col("part") == p).drop("part") for p in ("benchmark", "rest"))


def training_starts(a: DataFrame, context_days: int, gap_percent: float, valid_ratio: float, shorten: bool = True, exact: bool = False) -> DataFrame:
    """Starts of contexts of so many days, gaps up to gap_percent of the context bridged; shortened once more by default."""
    filled = iv.fill_gaps(a, int(24 * context_days * gap_percent / 100), context_days, valid_ratio, exact)
    return iv.add_duration(filled, -context_days * DAY, tidy=True) if shorten else filled


def random_split(a: DataFrame, percent: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """int(percent of the intervals), drawn without replacement, and the others."""
    ranked = with_rank(a, [uniform(seed, "location_id", "start", "stop"), F.col("location_id"), F.col("start")], "__rank")
    n = int(percent / 100 * ranked.count())
    return ranked.where(F.col("__rank") < n).drop("__rank"), ranked.where(F.col("__rank") >= n).drop("__rank")


def location_split(a: DataFrame, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows of n * percent // 100 of the n locations, and those of the others."""
    ids = with_rank(a.select("location_id").distinct(), [uniform(seed, "location_id"), F.col("location_id")], "__rank")
    return iv.split_locations(a, ids.where(F.col("__rank") < ids.count() * percent // 100))


def split_windows(rest: DataFrame, validation: DataFrame, benchmark: DataFrame, step: int) -> DataFrame:
    """(part, location_id, t): window starts of train (rest without validation), validation and benchmark, for any validation set."""
    parts = {"train": iv.subtract(rest, validation), "validation": iv.clean(validation), "benchmark": iv.clean(benchmark)}
    named = [iv.window_starts(x, step, tidy=True).withColumn("part", F.lit(name)) for name, x in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).select("part", "location_id", "t")


def dated_split_windows(a: DataFrame, locations: DataFrame, since: int, context: int, low: int, high: int, step: int) -> DataFrame:
    """split_windows() of benchmark_parts(), validation being the rest within [low, high): the whole split from one sweep.

    A clean set that is cut at two times stays clean, so that train and validation need no sweep of their own.
    """
    parts = benchmark_parts(a, locations, since, context)
    piece = lambda name, begin, end: F.struct(F.lit(name).alias("part"), F.greatest(F.col("start"), F.lit(begin)).alias("start"), F.least(F.col("stop"), F.lit(end)).alias("stop"))
    cut = F.array(piece("train", -iv.FAR, low), piece("validation", low, high), piece("train", high, iv.FAR))
    pieces = F.when(F.col("part") == "rest", cut).otherwise(F.array(piece("benchmark", -iv.FAR, iv.FAR)))
    cut = parts.select("location_id", F.inline(pieces)).where("stop > start")
    aligned = cut.withColumn("start", iv.ceil_to(F.col("start"), step)).where("stop > start")
    return aligned.select("part", "location_id", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(step).cast("long"))).alias("t"))


def day_blocks(samples: DataFrame, step: int, key: str = "location", block: int = DAY) -> DataFrame:
    """(key, day, values): samples on a grid of step seconds, one array per block, null where there is none.

    Of several samples at one time the least counts.
    """
    day = F.floor(F.col("ts") / block)
    slot = ((F.col("ts") - day * block) / step).cast("int")
    one = samples.where(F.pmod("ts", F.lit(step)) == 0).groupBy(key, day.alias("day"), slot.alias("slot")).agg(F.min(bare(F.col("value").cast("double"))).alias("value"))
    packed = one.groupBy(key, "day").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    return packed.select(key, "day", F.transform(F.sequence(F.lit(0), F.lit(block // step - 1)), lambda i: F.try_element_at("m", i)).alias("values"))


def read_windows(samples: DataFrame, windows: DataFrame, length: int, step: int, key: str = "location", block: int = DAY) -> DataFrame:
    """(key, window_start, values) of distinct windows (key, window_start): length / step values at the native rate.

    Windows look up the blocks that they touch by an equi-join, never samples by a range; starts are multiples of step.
    """
    low, high = F.floor(F.col("window_start") / block), F.floor((F.col("window_start") + length - 1) / block)
    wanted = windows.select(key, "window_start").distinct().withColumn("day", F.explode(F.sequence(low, high)))
    joined = wanted.join(day_blocks(samples, step, key, block), [key, "day"], "left")
    none = F.array_repeat(F.lit(None).cast("double"), block // step)
    rows = joined.groupBy(key, "window_start").agg(F.array_sort(F.collect_list(F.struct("day", F.coalesce("values", none).alias("values")))).alias("days"))
    whole = F.flatten(F.transform("days", lambda d: d["values"]))
    first = ((F.col("window_start") - F.floor(F.col("window_start") / block) * block) / step).cast("int") + 1
    return rows.select(key, "window_start", F.slice(whole, first, F.lit(length // step)).alias("values"))


def merged(*sources: Column) -> Column:
    """Element-wise sum of arrays of the same length, null only where all are."""
    total = sources[0]
    for other in sources[1:]:
        total = F.zip_with(total, other, lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))
    return total


def prediction_masks(values: Column, predict: Column | int, target: bool = True) -> tuple[Column, Column]:
    """Input and output mask of an array: the last predict elements of the target are hidden from the input and asked of
    the output. Null elements are in neither."""
    first = F.size(values) - predict

    def mask(ahead: int, before: int) -> Column:
        return F.transform(values, lambda v, i: F.when(v.isNull(), 0).when((i >= first) & F.lit(target), ahead).otherwise(before))

    return mask(0, 1), mask(1, 0)


def variable_width(seed: int, size: Column, keys: list, low: float, high: float, per_day: int) -> Column:
    """Width of the predicted part: at least a day, else a share of size drawn per window between low and high."""
    return F.greatest(F.lit(per_day), F.floor(size * (uniform(seed, *keys) * (high - low) + low)).cast("int"))


def patch_masks(values: Column, patch: int, share: float, seed: int, keys: list) -> tuple[Column, Column]:
    """Input and output mask: each whole patch is asked with probability share, at least the one with the least draw.

    Null elements are not asked; the input mask is the complement.
    """
    patches = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(values) / patch).cast("int") - 1)), lambda p: uniform(seed, *keys, p))
    least = F.array_min(patches)
    asked = F.transform(values, lambda v, i: F.when(v.isNull(), 0).when(F.get(patches, F.floor(i / patch).cast("int")) <= F.greatest(F.lit(share), least), 1).otherwise(0))
    return F.transform(asked, lambda m: 1 - m), asked


def enough(mask_in: Column, mask_out: Column, least: int = 10) -> Column:
    count = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x)
    return (count(mask_in) >= least) & (count(mask_out) >= least)


def _sorted(values: Column) -> Column:
    return F.array_sort(F.filter(values, lambda v: v.isNotNull()))


def _quantile(ordered: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def calm(values: Column, predict: int, peak: float = 10.0, offset: float = 0.8, eps: float = 1e-6) -> Column:
    """Whether the last predict values stay near the others: not much more volatile, medians not far apart.

    Medians are the lower ones. Comparisons with nothing pass.
    """
    x, y = _sorted(F.slice(values, F.lit(1), F.greatest(F.lit(0), F.size(values) - predict))), _sorted(F.slice(values, F.greatest(F.lit(1), F.size(values) - predict + 1), F.lit(predict)))
    spread = _quantile(x, 0.99) - _quantile(x, 0.01) + eps
    middle = lambda v: F.get(v, F.floor((F.size(v) - 1) / 2).cast("int"))
    ratio = (F.get(y, F.size(y) - 1) - F.get(y, F.lit(0))) / spread
    moved = F.abs(middle(y) - middle(x)) / spread
    return ~(F.coalesce(ratio > peak, F.lit(False)) | F.coalesce(moved > offset, F.lit(False)))


def topped_up(windows: DataFrame, valid: Column, seed: int, keys: list[str]) -> DataFrame:
    """As many rows as windows: the valid ones, and in place of each other one a valid one, drawn with replacement.

    slot numbers the rows, the valid ones first, in the order of keys. Without any valid row the result is empty.
    """
    rows = written(windows.withColumn("__valid", F.coalesce(valid, F.lit(False))))
    good = written(with_rank(rows.where("__valid").drop("__valid"), [F.col(k) for k in keys], "__rank"))
    n_good, n_all = good.count(), rows.count()
    if not n_good:
        return good.withColumnRenamed("__rank", "slot")
    more = windows.sparkSession.range(n_good, n_all).select(F.col("id").alias("slot"), F.floor(uniform(seed, "id") * n_good).cast("long").alias("__rank"))
    slots = good.select(F.col("__rank").alias("slot"), "__rank").unionByName(more)
    return slots.join(good, "__rank").drop("__rank")


def left_padded(values: Column, length: int) -> Column:
    """values with zeros before it up to length; longer ones raise an error."""
    short = F.lit(length) - F.size(values)
    zero = F.lit(0.0)
    padded = F.concat(F.array_repeat(zero, F.greatest(short, F.lit(0))), F.transform(values, lambda v: v.cast("double")))
    return F.when(short < 0, F.raise_error(F.lit("context is longer than the padded length"))).otherwise(padded)


def applied(values: Column, mask: Column) -> Column:
    """values times mask, null as zero."""
    return F.zip_with(values, mask, lambda v, m: F.coalesce(v, F.lit(0.0)) * m)


def target_times(starts: DataFrame, input_days: int, predict_days: int, days_ahead: int, step: int, t: str = "t") -> DataFrame:
    """(ts): distinct times, ascending, of days_ahead days from each start plus input and all but one predicted day."""
    first = F.col(t) + (input_days + predict_days - 1) * DAY
    return starts.select(F.explode(F.sequence(first, first + (days_ahead * DAY // step - 1) * step, F.lit(step).cast("long"))).alias("ts")).distinct().orderBy("ts")


def numbered_rows(rows: DataFrame, keys: list[str], name: str = "number") -> DataFrame:
    """rows with a number from 0 in the order of keys, once for all epochs."""
    return written(with_rank(rows, list(keys), name))


def batches(rows: DataFrame, keys: list[str], size: int, world: int = 1, seed: int = 0, epoch: int = 0, shuffle: bool = True, drop_last: bool = False, features: str | None = None, number: str | None = None) -> DataFrame:
    """rows with rank, batch and place: shuffled by seed and epoch, dealt to world ranks in turn.

    The shuffle permutes row numbers (scalars.shuffled()), so that an epoch takes no sort. number: a column that
    numbers rows from 0 without gaps, as numbered_rows() does; without one rows are numbered by keys. A batch has size
    rows of one rank; drop_last leaves out a rank's last, incomplete one. features: a column that must be the same
    within a batch, else reading raises an error.
    """
    named = rows if number else numbered_rows(rows, keys, "__n")
    n = named.count()
    at = F.col(number or "__n")
    dealt = named.withColumn("__at", shuffled(at, n, seed + epoch * EPOCH) if shuffle and n else at)
    own = F.floor(F.col("__at") / world)
    dealt = dealt.withColumns({"rank": (F.col("__at") % world).cast("int"), "batch": F.floor(own / size).cast("long"), "place": (own % size).cast("int")})
    if drop_last:
        whole = F.floor((F.floor((F.lit(n) - 1 - F.col("rank")) / world) + 1) / size)
        dealt = dealt.where(F.col("batch") < whole)
    if features:
        own = Window.partitionBy("rank", "batch")  # size rows
        dealt = dealt.withColumn("__mixed", F.min(features).over(own) != F.max(features).over(own))
        dealt = dealt.withColumn("batch", F.when(F.col("__mixed"), F.raise_error(F.lit("a batch mixes numbers of features"))).otherwise(F.col("batch")).cast("long")).drop("__mixed")
    return dealt.drop("__n", "__at")


def one_batch(numbered: DataFrame, n: int, rank: int, batch: int, size: int, world: int = 1, seed: int = 0, epoch: int = 0, number: str = "number") -> DataFrame:
    """The rows of one batch of batches() with their place, from numbered_rows() of n rows: the shuffle run backwards
    gives the size numbers that it holds, and rows are looked up by these."""
    places = numbered.sparkSession.range(size).select(F.col("id").cast("int").alias("place"), ((F.lit(batch) * size + F.col("id")) * world + rank).alias("__at")).where(F.col("__at") < n)
    wanted = places.select("place", shuffled(F.col("__at"), n, seed + epoch * EPOCH, back=True).alias(number))
    return numbered.join(F.broadcast(wanted), number)  # size rows


def variates(windows: DataFrame, keys: list[str], features: dict[str, tuple[str, str]], target: str, predict: int) -> DataFrame:
    """(group, keys, variate, values): one row for each feature (name: values column, mask column) of a window.

    Masked elements are null, as are the last predict ones of the target. group numbers windows by a hash of keys.
    """
    each = []
    for name, (values, mask) in features.items():
        shown = F.zip_with(F.col(values), F.col(mask), lambda v, m: F.when(m == 1, v))
        if name == target:
            last = F.size(values) - predict
            shown = F.transform(shown, lambda v, i: F.when(i < last, v))  # noqa: B023
        each.append(F.struct(F.lit(name).alias("variate"), shown.alias("values")))
    return windows.select(F.xxhash64(*keys).alias("group"), *keys, F.inline(F.array(*each)))


def fitting_pairs(pairs: DataFrame, places: DataFrame, reach: str = "reach") -> DataFrame:
    """places (key, reach in seconds) times those pairs of context_pairs() that reach can fill, with the number of whole contexts."""
    given = pairs.collect()  # a handful of rows
    each = F.array(*(F.struct(*(F.lit(v).cast("int").alias(n) for n, v in p.asDict().items())) for p in given))
    rows = places.select("*", F.inline(each)).withColumn("contexts", F.floor(F.col(reach) / (F.col("context_days") * DAY)))
    return rows.where("contexts > 0").drop(reach)


def horizon_windows(horizons: DataFrame, context_days: int, predict_days: int, key: str = "location", horizon: str = "horizon") -> DataFrame:
    """(key, horizon, window_start, predict_start): a context that ends predict_days after the horizon's day begins."""
    day = F.floor(F.col(horizon) / DAY) * DAY
    return horizons.select(key, horizon, (day - (context_days - predict_days) * DAY).alias("window_start"), day.alias("predict_start"))


def available(windows: DataFrame, versions: DataFrame, days: int, key: str = "location", horizon: str = "horizon", published: str = "available_at", ts: str = "ts") -> DataFrame:
    """(key, horizon, *versions): of each time in a window of so many days the latest version that was available at the horizon.

    Windows meet versions by key and day only, so that a version is read for the horizons around it, not for all.
    """
    first = F.floor(F.col("window_start") / DAY)
    spread = windows.select(key, horizon, F.explode(F.sequence(first, first + days - 1)).alias("__day"))
    known = spread.join(versions.withColumn("__day", F.floor(F.col(ts) / DAY)), [key, "__day"]).where(F.col(published) <= F.col(horizon))
    rest = [c for c in versions.columns if c not in (key, ts)]
    return known.groupBy(key, horizon, ts).agg(F.max_by(F.struct(*rest), F.col(published)).alias("__v")).select(key, horizon, ts, "__v.*")


def horizon_inputs(load: DataFrame, horizons: DataFrame, context_days: int, predict_days: int, step: int, weather: dict[str, DataFrame] | None = None, key: str = "location", horizon: str = "horizon") -> DataFrame:
    """(key, horizon, ts, load, load_mask, target_ts), and for each name of weather (versions) its values and mask: what a model gets at each horizon.

    Arrays cover context_days in steps, predict_days of them after the horizon's day begins; there the load is masked.
    Masked and missing elements are 0. target_ts are the times that are asked for.
    """
    windows = written(horizon_windows(horizons, context_days, predict_days, key, horizon))
    n, ahead = context_days * DAY // step, predict_days * DAY // step
    rows = windows.join(read_windows(load, windows, context_days * DAY, step, key).withColumnRenamed("values", "load"), [key, "window_start"])
    names = {"load": True}
    for name, versions in (weather or {}).items():
        known = available(windows, versions, context_days, key, horizon).join(windows, [key, horizon])
        slot = ((F.col("ts") - F.col("window_start")) / step).cast("int")
        packed = known.where(F.pmod(F.col("ts") - F.col("window_start"), F.lit(step)) == 0).groupBy(key, horizon).agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("slot"), F.col("value")))).alias("m"))
        values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("m", i))
        none = F.array_repeat(F.lit(None).cast("double"), n)
        rows = rows.join(packed.select(key, horizon, values.alias(name)), [key, horizon], "left").withColumn(name, F.coalesce(name, none))
        names[name] = False
    rows = rows.withColumns({f"{c}_mask": prediction_masks(F.col(c), ahead, target)[0] for c, target in names.items()})
    rows = rows.withColumns({c: applied(F.col(c), F.col(f"{c}_mask")) for c in names})
    ts = F.sequence(F.col("window_start"), F.col("window_start") + (n - 1) * step, F.lit(step).cast("long"))
    return rows.withColumn("ts", ts).select(key, horizon, "ts", *(x for c in names for x in (c, f"{c}_mask")), F.slice("ts", n - ahead + 1, ahead).alias("target_ts"))
