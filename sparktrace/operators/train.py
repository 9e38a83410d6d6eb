"""Training sets: noise calibration, replicas, balanced frames and segments; user predictors per trial."""

from __future__ import annotations

import hashlib
import traceback
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.operators import binning, match, reshape, series
from sparktrace.sources.io import shared_path

TRIAL = ["dataset", "trial"]


def uniform(seed: int, *keys) -> Column:
    """Number in (0, 1) fixed by the seed and the keys, so that a task that runs again draws the same: from their MD5."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))
    return (F.conv(F.substring(text, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def hashed_normal(*keys, seed: int) -> Column:
    """Standard normal number fixed by seed and keys."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *keys))


def normals(seed: int, keys: str, places: list[str], last: str) -> np.ndarray:
    """What `hashed_normal` gives for the keys (joined by colons), each place and the last key."""

    def draws(k: int) -> np.ndarray:
        start, end = f"{k}:{keys}:".encode(), f":{last}".encode()
        digests = b"".join([hashlib.md5(start + i + end).digest()[:8] for i in map(str.encode, places)])
        return ((np.frombuffer(digests, ">u8") >> 16) + 0.5) / float(1 << 48)

    return np.sqrt(-2 * np.log(draws(seed))) * np.cos(2 * 3.141592653589793 * draws(seed + 1))


def median_step(values: np.ndarray, null: np.ndarray) -> float | None:
    """Median absolute difference of consecutive values; null without any. NaN is greater than all numbers, null (true in `null`) than NaN."""
    unknown = null[1:] | null[:-1]
    steps = np.sort(np.abs(np.diff(values))[~unknown])
    at = 0.5 * (len(unknown) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    return float(steps[low] + (steps[high] - steps[low]) * (at - low)) if 0 <= low and high < len(steps) else None


def calibrate_noise(frames: DataFrame, fs: float, target: float, levels: int = 20, most: int | None = 500, rows: float | None = 8e5, replicas: bool = True, seed: int = 1) -> DataFrame:
    """Per trial: base noise, the deviation `added` that reaches the target noise, and the number of noisy replicas.

    Normal noise of level / 100 sqrt(fs) is added at each level, the noise measured and the level interpolated at the target; null where the
    levels do not reach it. Replicas are ceil(1.2 (target / base)^2), one with `replicas` off, none where the base is above the target; at
    most `most`, and so few that the replicas of a dataset's trials, as long as this one, stay within `rows` samples. Without `most` and
    `rows` (None) there are as many as that, however many; null where the base is 0, as no number is enough.
    """
    root = fs**0.5
    keys = F.concat_ws(":", *[F.col(c).cast("string") for c in TRIAL]).alias("keys")
    per = frames.groupBy(*TRIAL).agg(F.sort_array(F.collect_list(F.struct("i", F.col("y").cast("double").alias("y")))).alias("a"))
    per = per.select(*TRIAL, keys, F.col("a.i").cast("array<string>").alias("i"), F.transform("a", lambda p: F.coalesce(p["y"], F.lit(0.0))).alias("y"), F.transform("a", lambda p: p["y"].isNull()).alias("null"))

    def measured(places, y, null, name):
        """Noise at each level, up to the first that is above the target after one that is not; later ones do not count."""
        noise = []
        for level in range(levels):
            noisy = y + level / 100 * root * normals(seed, name, places, str(level)) if level else y
            x = median_step(noisy, null)
            noise.append(None if x is None else x * 100 / root)
            below = noise[-1] is not None and noise[-1] <= target
            if not below and (level == 0 or noise[-1] is not None and noise[-2] is not None and noise[-2] <= target):
                break
        return noise

    def run(batches):
        for f in batches:
            values = lambda c: (x.values.to_numpy(zero_copy_only=False) for x in f[c])
            with np.errstate(invalid="ignore"):
                noise = [measured(*trial) for trial in zip(f["i"].to_pylist(), values("y"), values("null"), f["keys"].to_pylist())]
            # Arrow, as pandas would make NaN null.
            yield pa.RecordBatch.from_arrays([f["dataset"], f["trial"], pc.list_value_length(f["y"]), pa.array(noise, pa.list_(pa.float64()))], [*TRIAL, "n", "noise"])

    kinds = dict(frames.dtypes)
    n = per.mapInArrow(run, f"dataset {kinds['dataset']}, trial {kinds['trial']}, n int, noise array<double>")
    n = n.withColumn("base", F.get("noise", 0))
    found = F.get(F.filter(F.transform("noise", lambda x, i: F.when((x <= target) & (F.get("noise", i + 1) > target), i + (target - x) / (F.get("noise", i + 1) - x))), lambda x: x.isNotNull()), 0)
    copies = F.ceil(1.2 * F.pow(F.try_divide(F.lit(float(target)), "base"), 2)) if replicas else F.lit(1)
    copies = F.when(F.col("base") > target, 0).otherwise(copies if most is None or not replicas else F.least(F.lit(most), copies))
    if rows is not None:
        # Trials are counted when they are short rows, so no arrays are dealt by dataset.
        n = n.withColumn("trials", F.count("*").over(W.partitionBy("dataset")))
        copies = F.floor(F.floor(F.least(F.lit(float(rows)), F.col("trials") * F.col("n") * copies) / F.col("n")) / F.col("trials"))
    return n.select(*TRIAL, "base", copies.cast("long").alias("replicas"), F.when(F.col("base") <= target, found / 100 * root).alias("added"))


def noisy_replicas(frames: DataFrame, spikes: DataFrame, calibration: DataFrame, fs: float, target_fs: float, seed: int = 2) -> DataFrame:
    """Each trial repeated with noise of the calibrated deviation, scaled by sqrt(|y + 1|) over its median, and `events` beside it: those
    around each time. Trials are first resampled, and the noise scaled by the root of the ratio, where the rates differ by more than 5 %.
    Trials without replicas are left out first, by a stored table of the others.
    """
    calibration.where("replicas > 0 and added is not null").select(*TRIAL, "replicas", "added").write.parquet(table := shared_path(frames.sparkSession, "calibration"))
    kinds = dict(calibration.dtypes)
    used = frames.sparkSession.read.schema(", ".join(f"{c} {kinds[c]}" for c in (*TRIAL, "replicas", "added"))).parquet(table)
    frames, spikes = (rows.join(used.select(*TRIAL), TRIAL, "left_semi") for rows in (frames, spikes))
    scale = 1.0
    if abs(target_fs - fs) / fs > 0.05:
        wide = frames.groupBy(*TRIAL).agg(F.sort_array(F.collect_list(F.struct("i", "t", "y"))).alias("a")).select(*TRIAL, F.col("a.t").alias("t"), F.col("a.y").alias("y"))
        frames = series.fourier_resample(wide, fs, target_fs).select(*TRIAL, F.posexplode(F.arrays_zip("t", "y")).alias("i", "p")).select(*TRIAL, "i", "p.t", "p.y")
        scale, fs = (target_fs / fs) ** 0.5, target_fs
    events = binning.frame_histogram(frames, spikes, tail=0.0).withColumnRenamed("n", "events")
    level = F.sqrt(F.abs(F.col("y") + 1))
    shot = frames.groupBy(*TRIAL).agg(F.median(level).alias("shot"))
    # Trials become replicas last, so the joins see (and may broadcast) a row for each trial only.
    rows = frames.join(events, [*TRIAL, "i"]).join(shot, TRIAL).join(used, TRIAL).withColumn("replica", F.explode(F.sequence(F.lit(1).cast("long"), F.col("replicas"))))
    return rows.withColumn("y", F.col("y") + F.col("added") * scale * level / F.col("shot") * hashed_normal(*TRIAL, "i", "replica", seed=seed)).drop("shot", "added", "replicas")


def run_methods(wide: DataFrame, methods: dict[str, Callable], done: DataFrame | None = None) -> DataFrame:
    """Each predictor on each trial(t, y): dataset, trial, method, prob, error. A failure is recorded and others go on.

    `methods`: name -> function(t, y) -> values. Pairs in `done(dataset, trial, method)` are skipped.
    """
    work = wide.select(*TRIAL, "t", "y", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    work = work.join(done, [*TRIAL, "method"], "left_anti") if done is not None else work

    def run(frames):
        for f in frames:
            prob, errors = [], []
            for m, t, y in zip(f["method"], f["t"], f["y"]):
                try:
                    prob.append([float(v) for v in methods[m](t, y)])
                    errors.append(None)
                except Exception:  # a user's function may fail in any way; the row says how
                    prob.append(None)
                    errors.append(traceback.format_exc(limit=1))
            yield pd.DataFrame({"dataset": f["dataset"], "trial": f["trial"], "method": f["method"], "prob": prob, "error": errors})

    kinds = dict(wide.dtypes)
    return work.mapInPandas(run, f"dataset {kinds['dataset']}, trial {kinds['trial']}, method string, prob array<double>, error string")


def ensemble_score(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean over an ensemble's linear members of the dot product with each frame.

    `weights(noise_level, member, w array)` go to frames of their noise level.
    """
    dot = F.aggregate(F.zip_with("frame", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return frames.join(weights, "noise_level").groupBy(*TRIAL, "i").agg(F.avg(dot).alias("y"))


def predict(samples: DataFrame, noise: DataFrame, members: DataFrame, width: int, before: float, scorer: Callable | None = None, threshold: int | None = None, peak: float = 0.0, reach: int = 2, pad: float | None = None) -> DataFrame:
    """Rates of trials by the ensemble for their noise: dataset, trial, i, y.

    Trials are routed by noise(dataset, trial, noise) to the noise levels of members(model, noise_level, member, w array); each member
    scores each frame of `width` samples; the mean over members is thresholded, and the edges without a whole frame become `pad`.
    `scorer(batch, w)` scores a batch of frames with a member's weights, a row each; without one it is the dot product.
    """
    levels = members.select("model", "noise_level").distinct()
    routed = match.route_by_noise(noise, levels).select(*TRIAL, "noise_level")
    frames = series.sliding_frames(samples, width, before)
    whole = frames.where("frame is not null").join(routed, TRIAL)
    weights = members.select("noise_level", "member", "w")
    if scorer is None:
        rates = ensemble_score(whole, weights)
    else:
        both = whole.join(weights, "noise_level").select(*TRIAL, "i", "frame", "w")

        def run(batches):
            for f in batches:
                f = f.reset_index(drop=True)
                score = np.zeros(len(f))
                for _, rows in f.groupby(f["w"].map(tuple), sort=False):
                    score[rows.index] = scorer(np.stack(rows["frame"]), np.asarray(rows["w"].iloc[0], dtype=float))
                yield f[[*TRIAL, "i"]].assign(score=score)

        kinds = dict(both.dtypes)
        scored = both.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*TRIAL, "i")) + ", score double")
        rates = scored.groupBy(*TRIAL, "i").agg(F.avg("score").alias("y"))
    rates = reshape.threshold_rates(rates, threshold, peak, reach)
    if pad is None:
        return rates.select(*TRIAL, "i", "y")
    every = samples.select(*TRIAL, "i").join(routed.select(*TRIAL), TRIAL, "left_semi").join(rates, [*TRIAL, "i"], "left")
    return every.select(*TRIAL, "i", F.coalesce("y", F.lit(float(pad))).alias("y"))
