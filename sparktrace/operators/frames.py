"""Training frames cut from recordings, and the random choice among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.operators import series, stats

TRIAL = ("dataset", "trial")
#: Samples of a recording that share a row while frames are cut.
STRETCH = 4096
#: Stretches of a random number in which rows are counted before the smallest are taken.
BINS = 1 << 16


def frames_at(arrays: DataFrame, starts: DataFrame, width: int, columns: dict[str, str], by: tuple[str, ...] = TRIAL) -> DataFrame:
    """`starts(*by, i, ...)` with the `width` values from place i on of each array column of `arrays`, as `columns[array]`.

    Arrays are cut into overlapping stretches, which the starts inside them meet, so no row holds more than the frames of a stretch.
    """
    rest = [c for c in starts.columns if c not in by]
    last = F.floor((F.size(next(iter(columns))) - 1) / STRETCH).cast("int")
    cut = lambda b: F.struct(b.alias("b"), *[F.slice(c, b * STRETCH + 1, F.lit(STRETCH + width - 1)).alias(c) for c in columns])
    stretches = arrays.where(F.size(next(iter(columns))) > 0).select(*by, F.explode(F.transform(F.sequence(F.lit(0), last), cut)).alias("p")).select(*by, "p.*")
    asked = starts.groupBy(*by, F.floor(F.col("i") / STRETCH).cast("int").alias("b")).agg(F.collect_list(F.struct(*rest)).alias("asked"))
    frame = lambda c, i: F.slice(c, (i - F.col("b") * STRETCH + 1).cast("int"), F.lit(width))
    each = F.transform("asked", lambda a: F.struct(*[a[c].alias(c) for c in rest], *[frame(c, a["i"]).alias(n) for c, n in columns.items()]))
    return asked.join(stretches, [*by, "b"]).select(*by, F.inline(each))


def smallest(rows: DataFrame, key: Column, ties: list[str], k: int) -> DataFrame:
    """The `k` rows with the smallest `key`, a number in [0, 1); equal keys by `ties`. No task sees more than a stretch of the keys' range.

    Counts of BINS stretches tell in which one the k-th row lies; rows below it are kept, only its own rows are ordered.
    """
    rows = rows.withColumn("_key", key).withColumn("_bin", F.floor(F.col("_key") * BINS))
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(W.orderBy("_bin")))  # BINS rows at most
    edge = upto.where(F.col("_upto") >= k).agg(F.min("_bin").alias("_edge"), F.min_by(F.col("_upto") - F.col("_n"), "_bin").alias("_before"))
    marked = rows.crossJoin(F.broadcast(edge))
    below = marked.where(F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))
    at = marked.where(F.col("_bin") == F.col("_edge")).withColumn("_r", F.row_number().over(W.partitionBy("_bin").orderBy("_key", *ties)))
    return below.drop("_bin", "_edge", "_before").unionByName(at.where(F.col("_r") <= k - F.col("_before")).drop("_bin", "_edge", "_before", "_r"))


def balanced_training_set(
    frames: DataFrame, events: str, width: int, uniform, before: float = 0.5, rows: float = 15e6, kept: int = 5_000_000, smooth: float = 2.0, causal_fs: float | None = None, seed: int = 3, leave_out: tuple = ()
) -> DataFrame:
    """Frames of `width` values with the label at place int(before * width), in random order, `kept` at most: dataset, trial, i, frame, label.

    Frames begin at the places i = 0, 1, .. of a recording, as many as its length without nulls exceeds `width`. The label is the column
    `events` of counts, smoothed by a Gaussian of `smooth` samples reflected at the ends or, with `causal_fs`, by the causal kernel. A
    dataset that has f > 1 times its share of `rows` keeps a random 1 / f of the frames of each recording, rounded down. Of all,
    the `kept` with the smallest random numbers stay; those without a label are dropped then. `leave_out`: datasets that are not used.
    `uniform(seed, *keys)` draws a number in (0, 1).
    """
    used = frames.where(~F.col("dataset").isin(list(leave_out))) if leave_out else frames
    packed = used.groupBy(*TRIAL).agg(F.sort_array(F.collect_list(F.struct("i", F.col("y").cast("double").alias("y"), F.col(events).cast("double").alias("e")))).alias("a"))
    wide = packed.select(*TRIAL, F.col("a.y").alias("trace"), F.transform("a", lambda p: F.nanvl(p["e"], F.lit(None).cast("double"))).alias("y"))
    kernel, edges = (series.gaussian_kernel(smooth), "reflect") if causal_fs is None else (series.inverse_gaussian_kernel(causal_fs), "constant")
    wide = series.convolve_arrays(wide, kernel, edges).withColumnRenamed("y", "label")
    full = F.size(F.filter("trace", lambda v: v.isNotNull() & ~F.isnan(v)))
    wide = wide.withColumn("frames", F.greatest(full - width, F.lit(0)))
    share = wide.groupBy("dataset").agg(F.sum(F.size("trace")).alias("n")).withColumn("f", F.greatest(F.col("n") * F.count("*").over(W.partitionBy(F.lit(1))) / rows, F.lit(1.0)))
    wide = wide.join(F.broadcast(share.select("dataset", "f")), "dataset")  # a row for each dataset
    starts = wide.where("frames > 0").select(*TRIAL, "frames", "f", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("i"))
    rank = F.row_number().over(W.partitionBy(*TRIAL).orderBy(uniform(seed, *TRIAL, "i"), "i"))
    starts = starts.withColumn("_r", rank).where(F.col("_r") <= F.floor(F.col("frames") / F.col("f"))).select(*TRIAL, "i")
    chosen = smallest(starts, uniform(seed + 1, *TRIAL, "i"), [*TRIAL, "i"], kept)
    place = int(before * width)
    labelled = chosen.select(*TRIAL, (F.col("i") + place).alias("i"), "_key")
    labels = frames_at(wide, labelled, 1, {"label": "label"}).select(*TRIAL, (F.col("i") - place).cast("int").alias("i"), "_key", F.get("label", 0).alias("label")).where(F.col("label").isNotNull() & ~F.isnan("label"))
    return frames_at(wide, labels, width, {"trace": "frame"}).orderBy("_key", *TRIAL, "i").select(*TRIAL, "i", "frame", "label")


def recording(t: np.ndarray, y: np.ndarray, s: np.ndarray, fs: float) -> tuple | None:
    """Trace and event counts of one recording at `fs`, half a second cut off both ends, with its rate, events a second and noise.

    None where no event remains at one of the steps. Event times are counted from one sample before the first.
    """
    ok = ~np.isnan(t)
    t, y = t[ok], y[ok]
    if len(t) < 2:
        return None
    rate = 1 / np.mean(np.diff(t))
    s = s[(s >= t[0]) & (s <= t[-1])] - t[0] + 1 / rate
    m = int(round(len(y) * fs / rate))
    if not len(s) or m < 2:
        return None
    y, times = series.band_limited(y, m), np.arange(m) * (t[1] - t[0]) * len(t) / m + 1 / rate
    times = times * (1 / np.mean(np.diff(times))) / fs
    now = 1 / np.mean(np.diff(times))
    first, m = int(np.ceil(0.5 * now)), m - int(np.floor(now))
    y, times = y[first : first + max(m, 0)], times[first : first + max(m, 0)]
    if not len(times):
        return None
    s = s[(s >= times[0]) & (s <= times[-1])] - times[0] + 1 / now
    times = times - times[0] + 1 / now
    if not len(s):
        return None
    counts = np.histogram(s, np.append(times, times[-1] + 0.5 / now) - 0.5 / now)[0]
    return y, counts.astype(float), float(rate), float(counts.sum() * now / (len(times) + 1)), float(np.median(np.abs(np.diff(y))) * 100 / np.sqrt(rate)) if len(y) > 1 else None, len(times) / now


RECORDING = "trace array<double>, counts array<double>, rates array<double>, rate double, firing_rate double, noise double, elapsed double"


def recordings(wide: DataFrame, spikes: DataFrame, fs: float, width: int = 96, smooth: float = 0.025, causal: bool = False) -> DataFrame:
    """Per trial with events: the resampled and trimmed trace and counts, half a frame of zeros at both ends of each, the smoothed counts
    `rates`, and the recording's rate, firing_rate, noise and length in seconds.

    `wide(dataset, trial, t, y)`, `spikes(dataset, trial, s)`. `smooth`: deviation of the Gaussian in seconds; `causal`: the causal kernel.
    """
    events = spikes.groupBy(*TRIAL).agg(F.collect_list("s").alias("s"))
    kernel, edges = (series.inverse_gaussian_kernel(fs), "constant") if causal else (series.gaussian_kernel(smooth * fs), "reflect")
    pad = np.zeros(width // 2)

    def run(batches):
        for f in batches:
            out = []
            for d, k, t, y, s in zip(f["dataset"], f["trial"], f["t"], f["y"], f["s"]):
                found = recording(np.asarray(t, dtype=float), np.asarray(y, dtype=float)[: len(t)], np.asarray(s, dtype=float), fs)
                if found is not None:
                    trace, counts = (np.concatenate((pad, v, pad)) for v in found[:2])
                    out.append((d, k, trace, counts, series.convolved(counts, kernel, edges), *found[2:]))
            yield pd.DataFrame(out, columns=["dataset", "trial", *[c.split()[0] for c in RECORDING.split(", ")]])

    kinds = dict(wide.dtypes)
    return wide.join(events, list(TRIAL)).select(*TRIAL, "t", "y", "s").mapInPandas(run, f"dataset {kinds['dataset']}, trial {kinds['trial']}, {RECORDING}")


def segment_training_set(recorded: DataFrame, width: int = 96, classes: int = 6) -> DataFrame:
    """A frame at every sample of `recordings`, the sample at its centre: dataset, trial, i, frame, counts, rates, and the centre's `n`,
    `rate` and `class`, the count of its events below `classes`."""
    starts = recorded.select(*TRIAL, F.explode(F.sequence(F.lit(0), F.size("trace") - 2 * (width // 2) - 1)).alias("i"))
    cut = frames_at(recorded, starts, width, {"trace": "frame", "counts": "counts", "rates": "rates"})
    n = F.get("counts", width // 2).cast("long")
    return cut.select(*TRIAL, "i", "frame", "counts", "rates", n.alias("n"), F.get("rates", width // 2).alias("rate"), F.least(n, F.lit(classes - 1)).alias("class"))


def segment_statistics(wide: DataFrame, spikes: DataFrame, recorded: DataFrame, width: int = 96) -> DataFrame:
    """Per dataset: recordings used, mean of their rates, their samples, events, and seconds; and of all raw recordings, one after the other,
    the firing rate (events over the sum of last times) and the noise of the steps."""
    raw = wide.select(*TRIAL, F.filter(F.arrays_zip("t", "y"), lambda p: p["t"].isNotNull() & ~F.isnan(p["t"])).alias("a")).where(F.size("a") > 0)
    raw = raw.withColumn("before", F.lag(F.element_at("a", -1)["y"]).over(W.partitionBy("dataset").orderBy("trial")))
    values = F.concat(F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array().cast("array<double>")), F.col("a.y"))
    steps = raw.select("dataset", F.explode(F.zip_with(F.slice(values, F.lit(2), F.size(values)), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: F.abs(b - a))).alias("d"))
    half = stats.quantiles(steps, ["dataset"], "d", [0.5]).select("dataset", F.col("q")[0].alias("step"))
    length = raw.groupBy("dataset").agg(F.sum(F.element_at("a", -1)["t"]).alias("seconds"))
    events = spikes.groupBy("dataset").agg(F.count("*").alias("spikes"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    used = recorded.groupBy("dataset").agg(F.count("*").alias("recordings"), F.avg("rate").alias("rate"), F.sum(F.size("trace") - 2 * (width // 2)).alias("samples"), F.sum(total("counts")).cast("long").alias("events"), F.sum("elapsed").alias("elapsed"))
    both = used.join(length, "dataset").join(half, "dataset", "left").join(events, "dataset", "left")
    return both.select("dataset", "recordings", "rate", "samples", "events", "elapsed", F.try_divide(F.coalesce("spikes", F.lit(0)), "seconds").alias("firing_rate"), (F.col("step") * 100 / F.sqrt("rate")).alias("noise"))
