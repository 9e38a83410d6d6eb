"""Projection, filtering and reshaping of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIAL = ("dataset", "trial")

def ordered() -> WindowSpec:
    return W.partitionBy(*TRIAL).orderBy("i")


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def explode_trials(wide: DataFrame) -> DataFrame:
    """Array rows to samples with finite time and value; trials left empty drop out and later ones move up."""
    rows = wide.select("dataset", F.col("trial").alias("trial_orig"), F.posexplode(F.arrays_zip("t", "y")).alias("i", "p")).select("dataset", "trial_orig", "i", "p.t", "p.y").where(finite("t") & finite("y"))
    numbers = rows.select("dataset", "trial_orig").distinct().withColumn("trial", F.row_number().over(W.partitionBy("dataset").orderBy("trial_orig")) - 1)
    return rows.join(numbers, ["dataset", "trial_orig"])


def select_datasets(samples: DataFrame, first: int | None = None, named: list | None = None) -> DataFrame:
    """The named datasets, or all in order; then the first N."""
    out = samples.select("dataset").distinct()
    out = out.where(F.col("dataset").isin(named)) if named is not None else out
    return out.orderBy("dataset").limit(first) if first is not None else out


def select_trials(samples: DataFrame, chosen: DataFrame, strict: bool = False) -> DataFrame:
    """Samples of the chosen (dataset, trial) rows. With `strict` a chosen trial that is not there is an error."""
    wanted = chosen.select(*TRIAL).distinct()
    if strict:
        there = samples.select(*TRIAL).distinct().withColumn("_there", F.lit(True))
        known = wanted.join(there, list(TRIAL), "left")
        wanted = known.select("dataset", F.when(F.col("_there").isNull(), F.raise_error(F.format_string("no trial %s of %s", F.col("trial").cast("string"), F.col("dataset").cast("string"))).cast("long")).otherwise(F.col("trial")).alias("trial"))
    return samples.join(wanted, list(TRIAL), "left_semi")


def epoch_slice(samples: DataFrame, first: int, stop: int) -> DataFrame:
    """Samples of the trials from `first` to before `stop`."""
    return samples.where((F.col("trial") >= first) & (F.col("trial") < stop))


def bounds(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*TRIAL).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def strictly(bad: Column, value: Column, message: str, strict: bool) -> Column:
    """The value; where `bad` holds and `strict`, an error."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value) if strict else value


def trim_to_window(samples: DataFrame, windows: DataFrame, tolerance: float = 1e-6, strict: bool = False) -> DataFrame:
    """Samples inside their trial's set window, both ends closed and widened by the tolerance.

    With `strict` a window that is not finite, does not end after its start or holds no sample is an error; else its trial drops out.
    """
    good = finite("start_s") & finite("end_s") & (F.col("end_s") > F.col("start_s"))
    if strict:
        windows = windows.withColumn("start_s", strictly(~good, F.col("start_s"), "a window must be finite and end after its start", True))
        inside = F.col("t").between(F.col("start_s") - tolerance, F.col("end_s") + tolerance)
        rows = samples.join(windows, list(TRIAL)).withColumn("_in", inside).withColumn("_any", F.max("_in").over(W.partitionBy(*TRIAL)))
        return rows.where(strictly(~F.col("_any"), F.col("_in"), "a window holds no sample", True)).drop("_in", "_any")
    return samples.join(windows.where(good), list(TRIAL)).where(F.col("t").between(F.col("start_s") - tolerance, F.col("end_s") + tolerance))


def resolve_windows(samples: DataFrame, windows: DataFrame, strict: bool = False) -> DataFrame:
    """A window for every trial: the set one, else the whole trial. With `strict` one that does not end after its start is an error."""
    both = bounds(samples).join(windows, list(TRIAL), "left")
    out = both.select(*TRIAL, F.when(finite("start_s"), F.col("start_s")).otherwise(F.col("first_t")).alias("start_s"), F.when(finite("end_s"), F.col("end_s")).otherwise(F.col("last_t")).alias("end_s"))
    return out.withColumn("end_s", strictly(F.col("end_s") <= F.col("start_s"), F.col("end_s"), "a window must end after its start", strict))


def clip_windows(samples: DataFrame, windows: DataFrame, strict: bool = False) -> DataFrame:
    """Windows cut to their trial; those left empty drop out, or with `strict` are an error."""
    both = bounds(samples).join(windows, list(TRIAL)).select(*TRIAL, F.greatest("start_s", "first_t").alias("start_s"), F.least("end_s", "last_t").alias("end_s"))
    both = both.withColumn("end_s", strictly(F.col("end_s") <= F.col("start_s"), F.col("end_s"), "a window is empty inside its trial", strict))
    return both.where("end_s > start_s")


def snippet_window(samples: DataFrame, start: float | None = None, duration: float | None = None, end: float | None = None, least: int = 2, strict: bool = False) -> DataFrame:
    """Per trial the part [a, z] of its finite samples between the times `start` and `end`, with their number `n`.

    `start` and `end` are times on the trial's own axis, its first and last time unless given; without `end` the part lasts `duration`. Both are
    cut to the trial, which `start_clamped` and `end_clamped` tell. A trial whose part is empty or has fewer than `least` samples
    drops out, or with `strict` is an error.
    """
    good = samples.where(finite("t") & finite("y"))
    b = good.groupBy(*TRIAL).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("_all"))
    asked = F.lit(float(start)) if start is not None else F.col("first_t")
    b = b.withColumn("a", F.greatest(asked, "first_t")).withColumn("start_clamped", asked < F.col("first_t"))
    until = F.lit(float(end)) if end is not None else F.col("a") + float(duration) if duration is not None else F.col("last_t")
    b = b.withColumn("_z", until).withColumn("z", F.least("_z", "last_t")).withColumn("end_clamped", F.col("_z") > F.col("last_t"))
    parts = b.join(good.select(*TRIAL, "t"), list(TRIAL)).groupBy(*TRIAL, "a", "z", "start_clamped", "end_clamped").agg(F.count_if(F.col("t").between(F.col("a"), F.col("z"))).alias("n"))
    bad = (F.col("z") <= F.col("a")) | (F.col("n") < least)
    return parts.withColumn("n", strictly(bad, F.col("n"), "a snippet is empty or has too few samples", strict)).where(F.col("n") >= (least if strict else F.when(bad, None).otherwise(least)))


def mask_to_windows(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """All samples; values outside every valid window of the trial become null, without windows nothing changes."""
    spans = windows.where("end_s > start_s").groupBy(*TRIAL).agg(F.collect_list(F.struct("start_s", "end_s")).alias("spans"))
    hit = F.exists("spans", lambda w: F.col("t").between(w["start_s"], w["end_s"]))
    return samples.join(spans, list(TRIAL), "left").select(*TRIAL, "i", "t", F.when(F.coalesce(hit, F.lit(True)), F.col("y")).alias("y"))


def spikes_in_windows(spikes: DataFrame, windows: DataFrame) -> DataFrame:
    """Events in any closed window of their trial, each once."""
    w = windows.select(F.col("dataset").alias("wd"), F.col("trial").alias("wt"), "start_s", "end_s")
    return spikes.join(w, (F.col("dataset") == F.col("wd")) & (F.col("trial") == F.col("wt")) & F.col("s").between(F.col("start_s"), F.col("end_s")), "left_semi")


def finite_rows(rows: DataFrame, arrays: list[str], told: Observation | None = None) -> DataFrame:
    """Rows whose arrays are finite throughout. `told` gets the numbers of `rows` and of those `dropped` when the result is computed."""
    keep = F.lit(True)
    for a in arrays:
        keep = keep & F.coalesce(F.forall(a, finite), F.lit(False))
    if told is None:
        return rows.where(keep)
    return rows.withColumn("_keep", keep).observe(told, F.count("*").alias("rows"), F.count_if(~F.col("_keep")).alias("dropped")).where("_keep").drop("_keep")


def pad_trials(wide: DataFrame, mode: str = "nan", fallback_dt: float = 1.0) -> DataFrame:
    """Arrays padded on the right to the dataset's longest: nulls, or (edge) time at the median step and the last value."""
    longest = wide.groupBy("dataset").agg(F.max(F.size("y")).alias("longest"))
    rows = wide.join(longest, "dataset").withColumn("valid_length", F.size("y")).withColumn("more", F.col("longest") - F.size("y"))
    if mode == "nan":
        tail = lambda c: F.concat(c, F.array_repeat(F.lit(None).cast("double"), F.col("more").cast("int")))
        return rows.select(*TRIAL, "valid_length", tail(F.col("t")).alias("t"), tail(F.col("y")).alias("y"))
    steps = F.array_sort(F.zip_with(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), lambda b, a: b - a))
    rows = rows.withColumn("steps", steps).withColumn("dt", F.coalesce((F.get("steps", F.floor((F.size("steps") - 1) / 2).cast("int")) + F.get("steps", F.floor(F.size("steps") / 2).cast("int"))) / 2, F.lit(fallback_dt)))
    late = F.when(F.col("more") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("more"), F.lit(1))), lambda k: F.element_at("t", -1) + k * F.col("dt"))).otherwise(F.array().cast("array<double>"))
    return rows.select(*TRIAL, "valid_length", F.concat("t", late).alias("t"), F.concat("y", F.array_repeat(F.element_at("y", -1), F.col("more").cast("int"))).alias("y"))


def mask_padding(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Values at or beyond the trial's valid length become null."""
    return frames.join(lengths, list(TRIAL)).withColumn("y", F.when(F.col("i") < F.col("valid_length"), F.col("y"))).drop("valid_length")


def flatten_trials(samples: DataFrame, bins: int = 4096) -> DataFrame:
    """All samples of a dataset on one axis in the order of time, trial and i; `k` is the place in it.

    Places are counted inside `bins` stretches of time of a dataset and added to the counts of those before.
    """
    span = samples.groupBy("dataset").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    rows = samples.join(F.broadcast(span), "dataset").withColumn("bin", F.coalesce(F.floor(F.try_divide(F.col("t") - F.col("a"), F.col("z") - F.col("a")) * bins), F.lit(0)))
    before = W.partitionBy("dataset").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("dataset", "bin").count().select("dataset", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("dataset", "bin").orderBy("t", "trial", "i")) - 1
    return rows.withColumn("k", place).join(starts, ["dataset", "bin"]).select("dataset", "t", "y", (F.col("k") + F.col("start")).alias("k"))


def shift_left_for_method(preds: DataFrame, right_labelled: list[str]) -> DataFrame:
    """For the right-labelled methods each value is the next one's and the last is 0, in trials of two samples or more."""
    w = W.partitionBy(*TRIAL, "method").orderBy("i")
    n = F.count("*").over(W.partitionBy(*TRIAL, "method"))
    last = F.row_number().over(w) == n
    moved = F.when(last, F.lit(0.0)).otherwise(F.lead("prob").over(w))
    return preds.withColumn("prob", F.when(F.col("method").isin(right_labelled) & (n >= 2), moved).otherwise(F.col("prob")))


def normalize_01(samples: DataFrame, value: str = "y") -> DataFrame:
    """Min-max scaling inside each trial over finite values; a constant trial becomes 0."""
    w, v = W.partitionBy(*TRIAL), F.when(finite(value), F.col(value))
    low, high = F.min(v).over(w), F.max(v).over(w)
    return samples.withColumn(value, F.when(finite(value), F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))))


def robust_scale(samples: DataFrame, height: float = 1.0, unit: float = 1.0) -> DataFrame:
    """(y - median) / ((p99 - p1) / height) in each trial; `unit` where the span is 0."""
    q = samples.groupBy(*TRIAL).agg(F.percentile("y", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q"))
    span = (F.col("q")[2] - F.col("q")[0]) / height
    both = samples.join(q, list(TRIAL)).withColumn("span", F.when(span > 0, span).otherwise(F.lit(unit)))
    scaled = lambda c: (c - F.col("q")[1]) / F.col("span")
    return both.select(*TRIAL, "i", scaled(F.col("y")).alias("y"), scaled(F.col("q")[0]).alias("low"), scaled(F.col("q")[2]).alias("high"))


def threshold_rates(rates: DataFrame, mode: int | None, peak: float = 0.0, reach: int = 2) -> DataFrame:
    """None: as they are. 0: negative to 0. 1: also 0 farther than `reach` samples from any value above peak / e."""
    clipped = F.greatest("y", F.lit(0.0))
    if mode is None:
        return rates
    if mode == 0:
        return rates.withColumn("y", clipped)
    near = F.max((F.col("y") > peak / 2.718281828459045).cast("int")).over(ordered().rowsBetween(-reach, reach))
    return rates.withColumn("near", near).withColumn("y", F.when(F.col("near") == 1, clipped).otherwise(F.lit(0.0))).drop("near")


def pad_prediction_edges(preds: DataFrame, width: int, before: float, pad: float = 0.0) -> DataFrame:
    """The first int(before w) and the last int((1 - before) w) samples of a trial become the padding value."""
    a, z = int(before * width), int((1 - before) * width)
    n = F.count("*").over(W.partitionBy(*TRIAL))
    return preds.withColumn("y", F.when((F.col("i") < a) | (F.col("i") >= n - z), F.lit(pad)).otherwise(F.col("y")))


def clean_nonfinite(samples: DataFrame) -> DataFrame:
    """Samples with 0 in the place of values that are not finite and times interpolated by index; the end times repeat beyond the finite ones."""
    order = W.partitionBy(*TRIAL).orderBy("i")
    here = F.when(finite("t"), F.struct("i", "t"))
    rows = samples.withColumn("_p", F.last(here, True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.first(here, True).over(order.rowsBetween(0, W.unboundedFollowing)))
    between = F.col("_p.t") + (F.col("_n.t") - F.col("_p.t")) * (F.col("i") - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))
    time = F.when(finite("t"), F.col("t")).otherwise(F.coalesce(between, F.col("_p.t"), F.col("_n.t")))
    return rows.withColumn("t", time).withColumn("y", F.when(finite("y"), F.col("y")).otherwise(F.lit(0.0))).drop("_p", "_n")


def bad_percent(samples: DataFrame) -> DataFrame:
    """Per dataset, the percentages of times and of values that are not finite."""
    share = lambda c: (F.avg(F.when(finite(c), 0.0).otherwise(1.0)) * 100).alias(f"bad_{c}")
    return samples.groupBy("dataset").agg(share("t"), share("y"))


def refractory_filter(spikes: DataFrame, gap: float = 0.001) -> DataFrame:
    """Drops an event closer than `gap` to the event before it in the original list."""
    prev = F.lag("s").over(W.partitionBy(*TRIAL).orderBy("s"))
    return spikes.withColumn("prev", prev).where(F.col("prev").isNull() | (F.col("s") - F.col("prev") >= gap)).drop("prev")


def expand_places(counts: DataFrame, fs: float) -> DataFrame:
    """A count c > 0 at place i becomes ceil(c) events at (i + 1) / fs; counts that are not finite become none."""
    rows = counts.where(finite("c")).where("c > 0")
    return rows.select(*TRIAL, F.explode(F.array_repeat((F.col("i") + 1) / F.lit(float(fs)), F.ceil("c").cast("int"))).alias("s"))


def expand_counts(counts: DataFrame) -> DataFrame:
    """A count c at time t becomes rint(c) events at t."""
    return counts.where(finite("c")).select(*TRIAL, "t", F.rint("c").cast("int").alias("n")).where("n > 0").select(*TRIAL, F.explode(F.array_repeat("t", F.col("n"))).alias("s"))


def display_snippet(samples: DataFrame, spikes: DataFrame, duration: float | None = None, anchor: str = "spikes", explicit: tuple[float, float] | None = None, segments: DataFrame | None = None, start: float | None = None, strict: bool = False) -> DataFrame:
    """A window in each trial, inside the trial and inside all `segments(dataset, trial, seg_start, seg_end)` of its methods; where these do
    not meet in the trial, inside the trial alone.

    Either the explicit one, clamped, or one of `duration`, shortened to what there is: from the time `start` on, at the beginning (anchor
    start), around the median of the events inside (spikes; the middle without any) or around the middle. What is empty after clamping
    drops out, or with `strict` is an error.
    """
    b = bounds(samples)
    if segments is not None:
        common = segments.groupBy(*TRIAL).agg(F.max("seg_start").alias("_a"), F.min("seg_end").alias("_z"))
        b = b.join(common, list(TRIAL), "left").withColumn("_a", F.greatest("first_t", "_a")).withColumn("_z", F.least("last_t", "_z"))
        meet = F.col("_z") > F.col("_a")
        b = b.select(*TRIAL, F.when(meet, F.col("_a")).otherwise(F.col("first_t")).alias("first_t"), F.when(meet, F.col("_z")).otherwise(F.col("last_t")).alias("last_t"))
    clip = lambda x, low, high: F.least(F.greatest(x, low), high)
    if explicit is not None:
        if not explicit[1] > explicit[0]:
            raise ValueError("an explicit window ends after its start")
        out = b.select(*TRIAL, clip(F.lit(float(explicit[0])), F.col("first_t"), F.col("last_t")).alias("start_s"), clip(F.lit(float(explicit[1])), F.col("first_t"), F.col("last_t")).alias("end_s"))
    else:
        if duration is None or not duration > 0:
            raise ValueError("a duration above 0 is needed")
        b = b.withColumn("_d", F.least(F.lit(float(duration)), F.col("last_t") - F.col("first_t")))
        middle = (F.col("first_t") + F.col("last_t")) / 2
        if start is not None:
            begin = F.lit(float(start))
        elif anchor == "start":
            begin = F.col("first_t")
        elif anchor == "spikes":
            inside = spikes.join(b, list(TRIAL)).where(F.col("s").between(F.col("first_t"), F.col("last_t")))
            b = b.join(inside.groupBy(*TRIAL).agg(F.percentile("s", F.lit(0.5)).alias("_mid")), list(TRIAL), "left")
            begin = F.coalesce("_mid", middle) - F.col("_d") / 2
        else:
            begin = middle - F.col("_d") / 2
        begin = clip(begin, F.col("first_t"), F.col("last_t") - F.col("_d"))
        out = b.select(*TRIAL, begin.alias("start_s"), (begin + F.col("_d")).alias("end_s"))
    return out.withColumn("end_s", strictly(F.col("end_s") <= F.col("start_s"), F.col("end_s"), "the snippet is empty", strict)).where("end_s > start_s")
