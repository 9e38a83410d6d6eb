"""Operators on ordered series: segments, smoothing, frames, grids and resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.operators.match import neighbours

TRIAL = ("dataset", "trial")

def ordered() -> WindowSpec:
    return W.partitionBy(*TRIAL).orderBy("i")


def sampling_rate(samples: DataFrame, strict: bool = False) -> DataFrame:
    """1 / median of the positive differences of consecutive times. A trial without any drops out, or with `strict` is an error."""
    d = samples.withColumn("d", F.col("t") - F.lag("t").over(ordered()))
    if not strict:
        return d.where("d > 0").groupBy(*TRIAL).agg((1 / F.median("d")).alias("fs"))
    rates = d.groupBy(*TRIAL).agg((1 / F.median(F.when(F.col("d") > 0, F.col("d")))).alias("fs"))
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in TRIAL])
    return rates.withColumn("fs", F.when(F.col("fs").isNull(), F.raise_error(F.concat(F.lit("no positive step in "), name))).otherwise(F.col("fs")))


def without_rate(samples: DataFrame) -> DataFrame:
    """Trials without a positive step, which have no sampling rate, with their number of samples."""
    d = samples.withColumn("d", F.col("t") - F.lag("t").over(ordered()))
    return d.groupBy(*TRIAL).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("_up")).where("_up = 0").drop("_up")


def gap_segments(samples: DataFrame, rates: DataFrame | None = None, gap_factor: float = 4.0, by: tuple[str, ...] = TRIAL, name: str = "seg") -> DataFrame:
    """Number of the segment of each sample; a new one starts where t - prev > gap_factor / fs. Without `rates` the samples have fs. A rate that is
    not above 0 is an error."""
    rows = samples if rates is None else samples.join(rates, list(TRIAL))
    order = W.partitionBy(*by).orderBy("i")
    fs = F.when(F.col("fs") <= 0, F.raise_error(F.lit("a sampling rate must be above 0"))).otherwise(F.col("fs"))
    gap = F.col("t") - F.lag("t").over(order) > gap_factor / fs
    return rows.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(name, F.sum("_new").over(order)).drop("_new")


def gap_segments_resetting(samples: DataFrame, factor: float = 5.0, floor: float = 1e-9) -> DataFrame:
    """A new segment where the step is not positive or above max(factor * median positive step, floor)."""
    d = samples.withColumn("d", F.col("t") - F.lag("t").over(ordered()))
    limit = d.where("d > 0").groupBy(*TRIAL).agg(F.greatest(factor * F.median("d"), F.lit(floor)).alias("limit"))
    rows = d.join(limit, list(TRIAL), "left")
    return rows.withColumn("_new", F.coalesce((F.col("d") <= 0) | (F.col("d") > F.col("limit")), F.lit(False)).cast("int")).withColumn("seg", F.sum("_new").over(ordered())).drop("_new", "limit", "d")


def segment_bounds(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*TRIAL, "seg").agg(F.min("t").alias("seg_start"), F.max("t").alias("seg_end"), F.count("*").alias("n"))


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Weights of radius int(4 sigma + 0.5), normalised; one tap for sigma 0."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def inverse_gaussian_kernel(fs: float, smoothing: float = 5.0, taps: int = 199) -> np.ndarray:
    """Causal kernel: the inverse-Gaussian density of mean 2 smoothing / fs that begins at 101 / fs, its peak moved, normalised."""
    mu = 2.0 * smoothing / fs
    x = np.arange(taps) / fs - 101 / fs
    pdf, on = np.zeros(taps), x > 0
    pdf[on] = np.exp(-((x[on] - mu) ** 2) / (2 * x[on] * mu**2)) / np.sqrt(2 * np.pi * x[on] ** 3)
    pdf = np.roll(pdf, int((99 - pdf.argmax()) / 1.5))
    return pdf / pdf.sum()


PAD = {"reflect": {"mode": "symmetric"}, "nearest": {"mode": "edge"}, "constant": {"mode": "constant"}}


def convolved(y: np.ndarray, kernel: np.ndarray, edges: str = "reflect") -> np.ndarray:
    r = len(kernel) // 2
    return np.convolve(np.pad(y, r, **PAD[edges]), kernel, mode="valid") if len(y) else y


def convolve_arrays(wide: DataFrame, kernel: np.ndarray, edges: str = "reflect", column: str = "y") -> DataFrame:
    """An array column convolved with the kernel, row by row in Arrow batches; null spreads over the radius."""

    def run(frames):
        for f in frames:
            f[column] = [None if v is None else convolved(np.asarray(v, dtype=float), kernel, edges).tolist() for v in f[column]]
            yield f

    return wide.mapInPandas(run, wide.schema)


def gaussian_smooth(wide: DataFrame, sigma: float, edges: str = "reflect") -> DataFrame:
    return convolve_arrays(wide, gaussian_kernel(sigma), edges)


def causal_smooth(wide: DataFrame, fs: float) -> DataFrame:
    return convolve_arrays(wide, inverse_gaussian_kernel(fs), "constant")


def smooth_rows(rows: DataFrame, by: list[str], sigma: float | Column, value: str, carry: tuple[str, ...] = (), edges: str = "reflect") -> DataFrame:
    """Long rows smoothed in each group in the order of `k`; `sigma` in samples, a number or a column of the group.

    The `carry` columns of the rows stay beside the value; only values and widths pass through Python.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def smooth(values: pd.Series, sigmas: pd.Series) -> pd.Series:
        return pd.Series([convolved(np.asarray([np.nan if x is None else x for x in v], dtype=float), gaussian_kernel(s), edges) for v, s in zip(values, sigmas)])

    width = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", F.col(value).cast("double").alias(value), *carry))).alias("a"), F.max(width).alias("_sigma"))
    smoothed = packed.withColumn("v", smooth(F.col(f"a.{value}"), F.col("_sigma")))
    return smoothed.select(*by, F.explode(F.arrays_zip("a", "v")).alias("p")).select(*by, "p.a.k", F.col("p.v").alias(value), *[f"p.a.{c}" for c in carry])


def sliding_frames(samples: DataFrame, width: int, before: float) -> DataFrame:
    """The `width` values around each sample, from int(before * width - 1) before it; null where incomplete."""
    start = int(before * width - 1)
    frame = F.collect_list("y").over(ordered().rowsBetween(-start, width - 1 - start))
    return samples.withColumn("frame", F.when(F.size(frame) == width, frame))


def centred_frames(samples: DataFrame, width: int) -> DataFrame:
    """The `width` values around each sample, from width // 2 before it; 0 beyond the ends of the trial."""
    first = F.collect_list("y").over(ordered().rowsBetween(-(width // 2), width - 1 - width // 2))
    lacks = F.greatest(F.lit(width // 2) - F.col("i"), F.lit(0)).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), lacks), first)
    return samples.withColumn("frame", F.concat(padded, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(padded))))


def overlap_add(frames: DataFrame, width: int) -> DataFrame:
    """Frame predictions added at their places around each sample, divided by the width everywhere."""
    n = F.count("*").over(W.partitionBy(*TRIAL))
    spread = frames.withColumn("n", n).select(*TRIAL, "i", "n", F.posexplode("frame").alias("k", "v")).withColumn("at", F.col("i") + F.col("k") - width // 2)
    return spread.where("at >= 0 and at < n").groupBy(*TRIAL, F.col("at").alias("i")).agg((F.sum("v") / width).alias("y"))


def dilate(samples: DataFrame, flag: Column, before: int, after: int) -> Column:
    """True if the flag holds for any sample from `before` before to `after` after."""
    return F.max(flag.cast("int")).over(ordered().rowsBetween(-before, after)) == 1


def support_runs(samples: DataFrame, least: float, reach: int) -> DataFrame:
    """Contiguous runs, as [first, stop) places with their sum, of samples within `reach` of one above `least`."""
    on = samples.withColumn("on", dilate(samples, F.col("y") > least, reach, reach))
    on = on.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy(*TRIAL, "on").orderBy("i"))).where("on")
    return on.groupBy(*TRIAL, "run").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("stop"), F.sum("y").alias("total")).drop("run")


def active_slices(samples: DataFrame, least: float, longest: int = 500) -> DataFrame:
    """Runs of values >= least, cut after `longest` samples; a run that touches either end of the trial is left out."""
    on = samples.withColumn("on", F.col("y") >= least).withColumn("last_i", F.max("i").over(W.partitionBy(*TRIAL)))
    on = on.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy(*TRIAL, "on").orderBy("i"))).where("on")
    whole = W.partitionBy(*TRIAL, "run")
    on = on.withColumn("a", F.min("i").over(whole)).withColumn("z", F.max("i").over(whole)).where("a > 0 and z < last_i")
    return on.groupBy(*TRIAL, "a", F.floor((F.col("i") - F.col("a")) / longest).alias("part")).agg(F.min("i").alias("first"), (F.max("i") + 1).alias("stop"), F.sum("y").alias("total")).drop("a", "part")


def interpolate(samples: DataFrame, points: DataFrame, at: str, value: str = "y") -> DataFrame:
    """Linear interpolation at each point; the end values outside."""
    near = neighbours(samples, points, at, [value], strict=False)
    t0, v0, t1, v1 = F.col("prev.t"), F.col(f"prev.{value}"), F.col("next.t"), F.col(f"next.{value}")
    slope = F.try_divide((v1 - v0) * (F.col(at) - t0), t1 - t0)
    return near.withColumn(value, F.coalesce(v0 + F.coalesce(slope, F.lit(0.0)), v0, v1)).drop("prev", "next")


def even_grid(samples: DataFrame, fs: float, least: int = 2) -> DataFrame:
    """max(least, rint(duration * fs) + 1) even points from the first to the last time of each trial."""
    b = samples.groupBy(*TRIAL).agg(F.min("t").alias("a"), F.max("t").alias("z"))
    n = F.greatest(F.lit(least), F.rint((F.col("z") - F.col("a")) * fs) + 1).cast("int")
    grid = b.withColumn("n", n).select(*TRIAL, "a", "z", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return grid.select(*TRIAL, "k", (F.col("a") + F.col("k") * (F.col("z") - F.col("a")) / (F.col("n") - 1)).alias("q"))


def block_means(samples: DataFrame, block: int) -> DataFrame:
    """Mean time and value of blocks of `block` samples; the tail is dropped."""
    n = F.count("*").over(W.partitionBy(*TRIAL))
    rows = samples.withColumn("n", n).withColumn("block", F.floor(F.col("i") / block)).where(F.col("block") < F.greatest(F.floor(F.col("n") / block), F.lit(1)))
    return rows.groupBy(*TRIAL, "block").agg(F.avg("t").alias("t"), F.avg("y").alias("y"))


def resample_to(samples: DataFrame, fs: float, tolerance: float = 2e-3, slower: bool = True) -> DataFrame:
    """Each trial at `fs`: unchanged where its rate is within `tolerance` of `fs` relative to it, or it has one sample or no positive
    duration or median step; block means at an integer ratio; else even grid and interpolation. Where a trial is shorter than a block its
    first sample stays. Without `slower` trials below `fs` stay too."""
    step = F.col("t") - F.lag("t").over(ordered())
    rates = samples.withColumn("_d", step).groupBy(*TRIAL).agg(F.try_divide(F.lit(1.0), F.median("_d")).alias("fs"), F.count("*").alias("n"), (F.max_by("t", "i") - F.min_by("t", "i")).alias("span"))
    ratio = F.col("fs") / fs
    block = F.rint(ratio)
    same = F.col("fs").isNull() | (F.col("fs") <= 0) | (F.abs(F.col("fs") - fs) <= tolerance * fs) | ((F.col("fs") <= fs) & (F.lit(not slower) | (F.col("span") <= 0)))
    how = F.when(same, "same").when((F.col("fs") > fs) & (F.abs(ratio - block) <= 1e-6 + 1e-5 * block), "block").when(F.col("span") <= 0, "same").otherwise("grid")
    rows = samples.join(rates.select(*TRIAL, how.alias("how"), block.alias("B"), "n"), list(TRIAL))
    same = rows.where("how = 'same'").select(*TRIAL, F.col("i").cast("long").alias("k"), "t", "y")
    cut = rows.where("how = 'block'").withColumn("k", F.floor(F.col("i") / F.col("B"))).where("k < floor(n / B) or (n < B and i = 0)")
    blocks = cut.groupBy(*TRIAL, "k").agg(F.avg("t").alias("t"), F.avg("y").alias("y"))
    rest = rows.where("how = 'grid'").select(*TRIAL, "i", "t", "y")
    grid = interpolate(rest, even_grid(rest, fs), "q").select(*TRIAL, F.col("k").cast("long").alias("k"), F.col("q").alias("t"), "y")
    return same.unionByName(blocks.select(*same.columns)).unionByName(grid)


def event_grid(windows: DataFrame, fs: Column | float) -> DataFrame:
    """Grid of each window(start_s, end_s): ceil(duration * fs) + 1 points from start to end."""
    rate = fs if isinstance(fs, Column) else F.lit(float(fs))
    n = (F.ceil((F.col("end_s") - F.col("start_s")) * rate) + 1).cast("int")
    g = windows.withColumn("fs", rate).withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return g.withColumn("q", F.col("start_s") + F.col("k") * (F.col("end_s") - F.col("start_s")) / F.greatest(F.col("n") - 1, F.lit(1)))


def event_rates(grid: DataFrame, spikes: DataFrame, binning: str = "linear") -> DataFrame:
    """Events per grid point before smoothing. linear: split between the floor and the next bin; round: half-even; floor."""
    windows = grid.select(*TRIAL, "start_s", "end_s", "fs", "n").distinct()
    x = (F.col("s") - F.col("start_s")) * F.col("fs")
    at = spikes.join(windows, list(TRIAL)).where("s between start_s and end_s").withColumn("x", x)
    low = F.floor("x")
    if binning == "linear":
        parts = F.explode(F.array(F.struct(low.alias("k"), (1 - (F.col("x") - low)).alias("v")), F.struct((low + 1).alias("k"), (F.col("x") - low).alias("v")))).alias("p")
    else:
        parts = F.explode(F.array(F.struct((F.rint("x") if binning == "round" else low).cast("long").alias("k"), F.lit(1.0).alias("v")))).alias("p")
    sums = at.select(*TRIAL, "start_s", "end_s", "n", parts).where("p.k < n").groupBy(*TRIAL, "start_s", "end_s", F.col("p.k").cast("int").alias("k")).agg(F.sum("p.v").alias("rate"))
    return grid.join(sums, [*TRIAL, "start_s", "end_s", "k"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def align_piecewise(segments: DataFrame, grid: DataFrame, value: str = "y", by: tuple[str, ...] = TRIAL, piece: str = "seg") -> DataFrame:
    """Value at each grid point by interpolation inside its gap segment; null between segments."""
    near = neighbours(segments, grid, "q", [value, piece], strict=False, by=by)
    t0, v0, t1, v1 = F.col("prev.t"), F.col(f"prev.{value}"), F.col("next.t"), F.col(f"next.{value}")
    inside = F.col(f"prev.{piece}") == F.col(f"next.{piece}")
    at = F.when(t0 == F.col("q"), v0).when(inside, v0 + (v1 - v0) * (F.col("q") - t0) / (t1 - t0))
    return near.withColumn(value, at).drop("prev", "next")


def remap_timebase(samples: DataFrame, length: int) -> DataFrame:
    """Times of each trial stretched to `length` points by relative position; a single time is repeated."""
    n = F.count("*").over(W.partitionBy(*TRIAL))
    place = samples.withColumn("n", n).select(*TRIAL, (F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))).alias("t"), F.col("t").alias("y"))
    points = place.select(*TRIAL).distinct().select(*TRIAL, F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")).withColumn("q", F.col("k") / F.lit(float(length - 1)))
    return interpolate(place, points, "q").select(*TRIAL, "k", F.col("y").alias("t"))


def remap_segments(preds: DataFrame, rates: DataFrame, raw: DataFrame) -> DataFrame:
    """Predictions(dataset, i, t, y) of a dataset with the times of its raw trials(dataset, trial, t array), segment by segment.

    Only where there are as many segments as trials: each segment's samples then take the trial's times by relative position, and
    `trial` is set. Other datasets keep their times, with a null trial. `rates(dataset, fs)`.
    """
    cut = gap_segments(preds.join(rates, "dataset"), by=("dataset",)).drop("fs")
    n = cut.groupBy("dataset").agg(F.countDistinct("seg").alias("n_seg"))
    trials = raw.withColumn("seg", F.row_number().over(W.partitionBy("dataset").orderBy("trial")) - 1)
    trials = trials.withColumn("n_trials", F.count("*").over(W.partitionBy("dataset"))).select("dataset", "trial", "seg", "n_trials", F.col("t").alias("times"))
    own = W.partitionBy("dataset", "seg")
    rows = cut.withColumn("k", F.row_number().over(own.orderBy("i")) - 1).withColumn("n", F.count("*").over(own)).join(n, "dataset").join(trials, ["dataset", "seg"], "left")
    at = F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1) * (F.size("times") - 1)).otherwise(F.lit(0.0))
    low, high = F.get("times", F.floor(at).cast("int")), F.get("times", F.ceil(at).cast("int"))
    fits = F.coalesce(F.col("n_seg") == F.col("n_trials"), F.lit(False))
    return rows.select("dataset", F.when(fits, F.col("trial")).alias("trial"), "i", F.when(fits, low + (high - low) * (at - F.floor(at))).otherwise(F.col("t")).alias("t"), "y")


def band_limited(y: np.ndarray, m: int) -> np.ndarray:
    """`y` at `m` points by its Fourier series."""
    n = len(y)
    if n == 0 or m == 0:
        return np.zeros(0)
    spectrum, half = np.fft.rfft(y), np.zeros(m // 2 + 1, dtype=complex)
    k = min(n, m) // 2 + 1
    half[:k] = spectrum[:k]
    if min(n, m) % 2 == 0 and n != m:  # the Nyquist bin is shared by both signs of the frequency
        half[k - 1] *= 0.5 if m > n else 1.0
        if m < n:
            half[k - 1] = half[k - 1].real * 2 if m % 2 == 0 else half[k - 1]
    return np.fft.irfft(half, m) * (m / n)


def fourier_resample(wide: DataFrame, fs: float | None, target: float) -> DataFrame:
    """Band-limited resampling of array rows to round(n * target / fs) samples; the time axis starts at the first time.

    Without `fs` the rows have it as a column.
    """

    def run(frames):
        for f in frames:
            f["y"] = [band_limited(np.asarray(y, dtype=float), int(round(len(y) * target / x))).tolist() for y, x in zip(f["y"], [fs] * len(f) if fs is not None else f["fs"])]
            f["t"] = [(t[0] + np.arange(len(y)) / target).tolist() if len(y) else [] for t, y in zip(f["t"], f["y"])]
            yield f

    return wide.mapInPandas(run, wide.schema)


def slice_axis(axis: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of a flat axis(dataset, k, ...) in each of the cuts(dataset, trial, first, stop), with their place `i` in it.

    Both sides meet in stretches of the axis as long as a mean cut, so a sample meets few cuts.
    """
    sizes = cuts.groupBy("dataset").agg(F.greatest(F.ceil(F.avg(F.col("stop") - F.col("first"))), F.lit(1)).alias("size"))
    near = cuts.where("stop > first").join(F.broadcast(sizes), "dataset")
    near = near.select("dataset", "trial", "first", "stop", F.explode(F.sequence(F.floor(F.col("first") / F.col("size")), F.floor((F.col("stop") - 1) / F.col("size")))).alias("stretch"))
    placed = axis.join(F.broadcast(sizes), "dataset").withColumn("stretch", F.floor(F.col("k") / F.col("size"))).drop("size")
    return placed.join(near, ["dataset", "stretch"]).where("k >= first and k < stop").withColumn("i", F.col("k") - F.col("first")).drop("first", "stop", "stretch")


def slice_by_length(axis: DataFrame, lengths: DataFrame) -> DataFrame:
    """A flat axis(dataset, k) cut into trials by running sums of lengths(dataset, trial, n)."""
    end = F.sum("n").over(W.partitionBy("dataset").orderBy("trial"))
    return slice_axis(axis, lengths.withColumn("stop", end).select("dataset", "trial", (F.col("stop") - F.col("n")).alias("first"), "stop"))


def slice_trials(axis: DataFrame, lengths: DataFrame, wanted: DataFrame) -> DataFrame:
    """The part of a flat axis(dataset, k, t) of each of the wanted(dataset, trial, expected) trials.

    By running sums of the dataset's lengths(dataset, trial, n), if these are those of trials 0, 1, 2, ... without a hole; else the
    segment of the trial's number, cut where time does not advance or jumps; else the trial's place among parts of the expected
    length; else the whole axis.
    """
    size = axis.groupBy("dataset").agg(F.count("*").alias("size"))
    by = W.partitionBy("dataset").orderBy("trial")
    sums = lengths.withColumn("end", F.sum("n").over(by)).withColumn("whole", F.max("trial").over(W.partitionBy("dataset")) + 1 == F.count("*").over(W.partitionBy("dataset")))
    sums = sums.where("whole and n > 0").select("dataset", "trial", F.struct((F.col("end") - F.col("n")).alias("first"), F.col("end").alias("stop")).alias("a"))
    segs = gap_segments_resetting(axis.select("dataset", F.lit(0).alias("trial"), F.col("k").alias("i"), "t")).groupBy("dataset", F.col("seg").cast("long").alias("trial")).agg(F.struct(F.min("i").cast("long").alias("first"), (F.max("i") + 1).cast("long").alias("stop")).alias("b"))
    both = wanted.join(size, "dataset").join(sums, ["dataset", "trial"], "left").join(segs, ["dataset", "trial"], "left")
    fixed = F.when((F.col("expected") > 0) & (F.col("trial") * F.col("expected") < F.col("size")), F.struct((F.col("trial") * F.col("expected")).cast("long").alias("first"), ((F.col("trial") + 1) * F.col("expected")).cast("long").alias("stop")))
    all_ = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("stop"))
    cut = F.coalesce(F.when(F.col("a.first") < F.col("size"), F.struct(F.col("a.first").cast("long").alias("first"), F.col("a.stop").cast("long").alias("stop"))), F.col("b"), fixed, all_)
    cuts = both.withColumn("c", cut).select("dataset", "trial", F.col("c.first").alias("first"), F.least("c.stop", "size").alias("stop"))
    return slice_axis(axis, cuts)


def fit_events(v: np.ndarray, kernel: np.ndarray) -> list[int]:
    """Places of the events whose smoothed sum fits `v`: one at the peak if the sum is 0.5 or more, then the best-fitting one
    while the squared error falls by 1e-8 or more.

    An event at k changes the error by |shape_k|^2 - 2 <shape_k, left>; both are convolutions, updated around each event.
    """
    r, n = len(kernel) // 2, len(v)
    norm = np.convolve(np.ones(n), kernel[::-1] ** 2, mode="full")[r : r + n]
    left = v.astype(float).copy()

    def add(k: int) -> None:
        a, z = max(0, k - r), min(n, k + r + 1)
        left[a:z] -= kernel[a - k + r : z - k + r]

    events = [int(v.argmax())] if v.sum() >= 0.5 else []
    for k in events:
        add(k)
    while n:
        change = norm - 2 * np.convolve(left, kernel[::-1], mode="full")[r : r + n]
        k = int(change.argmin())
        if -change[k] < 1e-8:
            break
        events.append(k)
        add(k)
    return events


def rates_to_counts(slices: DataFrame, sigma: float) -> DataFrame:
    """Events(dataset, trial, first, at) of each slice(values) by `fit_events` with a Gaussian of `sigma` samples, zero beyond the slice."""

    def run(frames):
        kernel = gaussian_kernel(sigma)
        for f in frames:
            out = [(d, t, a, a + k) for d, t, a, v in zip(f["dataset"], f["trial"], f["first"], f["values"]) for k in fit_events(np.asarray(v, dtype=float), kernel)]
            yield pd.DataFrame(out, columns=["dataset", "trial", "first", "at"])

    return slices.select(*TRIAL, "first", "values").mapInPandas(run, "dataset long, trial long, first long, at long")


def radius(sigma: float) -> int:
    return math.floor(4 * sigma + 0.5)
