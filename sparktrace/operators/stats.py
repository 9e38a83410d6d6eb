"""Aggregates over trials, recordings and posterior samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIAL = ("dataset", "trial")


def steps(samples: DataFrame, value: str = "y") -> DataFrame:
    """Differences of consecutive values in each trial."""
    d = F.col(value) - F.lag(value).over(W.partitionBy(*TRIAL).orderBy("i"))
    return samples.withColumn("d", d).where("d is not null")


def pearson(x: Column, y: Column) -> Column:
    """Correlation of pairs finite on both sides; null for fewer than two pairs or a constant side."""
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(ok, x), F.when(ok, y)
    return F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def noise_level(samples: DataFrame, rates: DataFrame) -> DataFrame:
    """Median absolute difference of consecutive values / sqrt(fs) * 100."""
    return steps(samples).groupBy(*TRIAL).agg(F.median(F.abs("d")).alias("m")).join(rates, list(TRIAL)).select(*TRIAL, (F.col("m") / F.sqrt("fs") * 100).alias("noise"))


def sorted_quantile(ordered: Column, q: float | Column) -> Column:
    """Quantile of a sorted array, linear between the two nearest: low * (1 - d) + high * d.

    The first product is not rounded before it is added, as in DuckDB's quantile_cont: where neighbours are equal but for rounding, that
    decides which of them lie between two quantiles.
    """
    q = q if isinstance(q, Column) else F.lit(float(q))
    at = q * (F.size(ordered) - 1)
    d = at - F.floor(at)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - d, high * d).cast("double")
    return F.when(d == 0, low).when(low.isNotNull() & high.isNotNull(), between)


def robust_diff_std(samples: DataFrame, low: float = 0.05, high: float = 0.95, empty: float | None = 0.0) -> DataFrame:
    """1.4826 * MAD of the differences between two quantiles; their population deviation where the MAD is 0; `empty` without any, and no row
    where that is None.

    All from one sorted array of the differences of a trial.
    """
    d = F.col("y") - F.lag("y").over(W.partitionBy(*TRIAL).orderBy("i"))
    per = samples.withColumn("d", d).groupBy(*TRIAL).agg(F.sort_array(F.collect_list("d")).alias("d"))
    per = per.withColumn("lo", sorted_quantile(F.col("d"), low)).withColumn("hi", sorted_quantile(F.col("d"), high))
    per = per.select(*TRIAL, F.filter("d", lambda x: x.between(F.col("lo"), F.col("hi"))).alias("d"))
    per = per.withColumn("m", sorted_quantile(F.col("d"), 0.5)).withColumn("mean", F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("d"), F.lit(0)))
    mad = 1.4826 * sorted_quantile(F.array_sort(F.transform("d", lambda x: F.abs(x - F.col("m")))), 0.5)
    sd = F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.size("d"), F.lit(0)))
    per = per.select(*TRIAL, mad.alias("mad"), sd.alias("sd"))
    spread = F.coalesce(F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd")), F.lit(empty))
    # Not a filter, which would be moved down and work out all the above again.
    return per.select(*TRIAL, spread.alias("spread")) if empty is not None else per.select(*TRIAL, F.explode(F.array_compact(F.array(spread))).alias("spread"))


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], bins: int = 1024, number: str | None = None) -> DataFrame:
    """Exact quantiles `q` (an array in the order of `probs`) of the finite values of each group, however few and large the groups are; `number`
    names a column for how many there are.

    Equal values of a group are counted before all else, in one pass over the rows. Counts in `bins` equal stretches of a group's range
    then tell in which stretches the ranks lie; only their values are ordered, each stretch on its own.
    """
    keys = by or ["_all"]
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, *([] if by else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    rows = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.sum("_c").alias("_n"))
    placed = rows.join(span.withColumnsRenamed({k: f"_of_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).drop(*[f"_of_{k}" for k in keys])
    placed = placed.withColumn("_bin", F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_a"), F.col("_z") - F.col("_a")) * bins), F.lit(0)), F.lit(bins - 1)))
    counts = placed.groupBy(*keys, "_bin", "_n").agg(F.sum("_c").alias("_b"))
    counts = counts.withColumn("_before", F.sum("_b").over(W.partitionBy(*keys).orderBy("_bin")) - F.col("_b"))
    ends = lambda p: (F.lit(p) * (F.col("_n") - 1), F.floor(F.lit(p) * (F.col("_n") - 1)), F.ceil(F.lit(p) * (F.col("_n") - 1)))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(lo, hi) for _, lo, hi in map(ends, probs)])))
    needed = counts.withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_b")))).where(F.size("_ranks") > 0)
    needed = needed.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bin").alias("_of_bin"), "_before", "_ranks")
    values = placed.join(needed, [*[F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_bin") == F.col("_of_bin")]).select(*keys, "_bin", "_v", "_c", "_before", "_ranks", "_n")
    last = F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_bin").orderBy("_v"))
    hits = values.withColumn("_last", last).select(*keys, "_n", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_last") - F.col("_c")) & (r < F.col("_last")))).alias("_r"))
    per = hits.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))

    def one(p: float) -> Column:
        at, lo, hi = ends(p)
        return F.element_at("_m", lo) + (F.element_at("_m", hi) - F.element_at("_m", lo)) * (at - lo)

    return per.select(*by, F.array(*map(one, probs)).alias("q"), *([F.col("_n").alias(number)] if number else []))


def drift_sigma(samples: DataFrame, rates: DataFrame, quiet: DataFrame) -> DataFrame:
    """clip(0.25 * spread / sqrt(1 / fs), 5e-4, 5e-2) over quiet samples; over all where fewer than two are quiet."""
    n = quiet.where("low").groupBy(*TRIAL).count()
    marked = samples.join(quiet, [*TRIAL, "i"]).join(n, list(TRIAL), "left").where("low or coalesce(count, 0) < 2")
    spread = robust_diff_std(marked.select(*TRIAL, "i", "y"))
    sigma = 0.25 * F.col("spread") / F.sqrt(1 / F.col("fs"))
    return spread.join(rates, list(TRIAL)).select(*TRIAL, F.least(F.greatest(sigma, F.lit(5e-4)), F.lit(5e-2)).alias("sigma"))


def corr_nan_moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Correlation from each column's own mean and deviation over its finite values."""
    own = pairs.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    both = pairs.join(own, by).groupBy(*by).agg(F.avg((F.col("x") - F.col("mx")) * (F.col("y") - F.col("my"))).alias("c"), F.max(F.col("sx") * F.col("sy")).alias("s"))
    return both.select(*by, F.try_divide("c", F.nullif("s", F.lit(0.0))).alias("r"))


def fixed_bins(spikes: DataFrame, bounds: DataFrame, width: float) -> DataFrame:
    """Counts in bins of `width` from the first time until the last time is covered; the last bin holds its end, empty bins stay."""
    cut = bounds.select(*TRIAL, "first_t", (F.ceil((F.col("last_t") + width - F.col("first_t")) / width) - 1).alias("bins"))
    bins = cut.where("bins > 0").select(*TRIAL, F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("k"))
    inside = (F.col("s") >= F.col("first_t")) & (F.col("s") <= F.col("first_t") + F.col("bins") * width)
    hits = spikes.join(cut, list(TRIAL)).where(inside).groupBy(*TRIAL, F.least(F.floor((F.col("s") - F.col("first_t")) / width), F.col("bins") - 1).alias("k")).count()
    return bins.join(hits, [*TRIAL, "k"], "left").select(*TRIAL, "k", F.coalesce("count", F.lit(0)).alias("n"))


def epoch_rate_stats(bounds: DataFrame, spikes: DataFrame, width: float, tolerance: float = 1e-9) -> DataFrame:
    """Start, end, events, mean rate and the greatest rate of a bin (0 without events or bins) for each trial."""
    if width <= 0:
        raise ValueError("the bin width must be above 0")
    near = spikes.join(bounds, list(TRIAL)).where(F.col("s").between(F.col("first_t") - tolerance, F.col("last_t") + tolerance))
    inside = near.groupBy(*TRIAL).agg(F.count("*").alias("n"))
    peak = fixed_bins(near.select(*TRIAL, "s"), bounds, width).groupBy(*TRIAL).agg((F.max("n") / width).alias("peak"))
    both = bounds.join(inside, list(TRIAL), "left").join(peak, list(TRIAL), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("peak", F.coalesce("peak", F.lit(0.0)))
    return both.withColumn("mean_rate", F.col("n") / F.greatest(F.col("last_t") - F.col("first_t"), F.lit(tolerance)))


def latent_rate_metrics(bounds: DataFrame, spikes: DataFrame, width: float, smooth_s: float, share: float) -> DataFrame:
    """p99 of each trial's binned rate after a Gaussian of `smooth_s` seconds (edges repeated), the time in which its autocorrelation falls,
    and the share of bins above `share` of p99 (0 where p99 <= 0). Without duration p99 and duty are 0 and the time is null."""
    from sparktrace.operators import series

    rates = fixed_bins(spikes, bounds, width).withColumn("rate", F.col("n") / width)
    if smooth_s > 0:
        rates = series.smooth_rows(rates, list(TRIAL), smooth_s / width, "rate", edges="nearest")
    per = rates.groupBy(*TRIAL).agg(F.sort_array(F.collect_list("rate")).alias("r"))
    p99 = sorted_quantile(F.col("r"), 0.99)
    above = F.size(F.filter("r", lambda x: x > share * F.col("p99"))) / F.size("r")
    per = per.withColumn("p99", p99).withColumn("duty", F.when(F.col("p99") > 0, above).otherwise(F.lit(0.0))).drop("r")
    tau = autocorr_time(rates.select(*TRIAL, F.col("k").alias("i"), F.col("rate").alias("y")), width)
    out = bounds.select(*TRIAL).join(per, list(TRIAL), "left").join(tau, list(TRIAL), "left")
    return out.select(*TRIAL, F.coalesce("p99", F.lit(0.0)).alias("p99"), "tau", F.coalesce("duty", F.lit(0.0)).alias("duty"))


def autocorr_time(series: DataFrame, dt: float, threshold: float = float(np.exp(-1))) -> DataFrame:
    """First lag at which the normalised autocorrelation is at most the threshold, times dt; else the whole length.

    Over finite values; null for fewer than two of them or a constant series. All lags of a trial come from one transform.
    """

    @F.pandas_udf("double")
    def tau(values: pd.Series) -> pd.Series:
        def one(v) -> float | None:
            x = np.asarray([a for a in v if a is not None], dtype=float)
            x = x[np.isfinite(x)]
            if len(x) < 2:
                return None
            x = x - x.mean()
            total = float(x @ x)
            if not total > 0 or not np.isfinite(total):
                return None
            size = 1 << int(2 * len(x) - 1).bit_length()
            auto = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(x)] / total
            low = np.flatnonzero(auto <= threshold)
            return float((low[0] if len(low) else len(x) - 1) * dt)

        return pd.Series([one(v) for v in values], dtype=float)

    per = series.groupBy(*TRIAL).agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("a"))
    return per.select(*TRIAL, F.nanvl(tau(F.col("a.y")), F.lit(None)).alias("tau"))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one), min, quartiles and max of the finite values."""
    some = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    some = some.join(quantiles(rows, by, value, [0.25, 0.5, 0.75]), by)
    return some.select(*by, "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max")


def pooled_rates(per_trial: DataFrame) -> DataFrame:
    """Total events over total duration of a dataset, and the greatest of the trials' greatest rates."""
    return per_trial.groupBy("dataset").agg(F.try_divide(F.sum("n"), F.sum(F.col("last_t") - F.col("first_t"))).alias("rate"), F.max("peak").alias("peak"))


def recording_qc(samples: DataFrame, spikes: DataFrame, rates: DataFrame, bounds: DataFrame, strict: float | None = None) -> DataFrame:
    """fs, duration, events, rate and share of events inside the time range (1 without events) of each trial.

    With `strict` a trial whose share is below it is an error.
    """
    s = spikes.join(bounds, list(TRIAL)).groupBy(*TRIAL).agg(F.count("*").alias("events"), F.avg(F.when(F.col("s").between(F.col("first_t"), F.col("last_t")), 1.0).otherwise(0.0)).alias("inside"))
    out = bounds.join(rates, list(TRIAL)).join(s, list(TRIAL), "left").withColumn("duration", F.col("last_t") - F.col("first_t"))
    out = out.withColumn("events", F.coalesce("events", F.lit(0))).withColumn("inside", F.coalesce("inside", F.lit(1.0)))
    if strict is not None:
        out = out.withColumn("inside", F.when(F.col("inside") >= strict, F.col("inside")).otherwise(F.raise_error(F.lit("events outside the time range")).cast("double")))
    return out.withColumn("rate", F.try_divide("events", "duration")).drop("first_t", "last_t")


def qc_overall(per_trial: DataFrame, least: float = 1.0) -> DataFrame:
    """Over all trials: number, median, mean, min and max of the share of events inside, how many are below `least`, and the worst trial."""
    worst = F.min(F.struct("inside", "dataset", "trial"))
    one = per_trial.agg(F.count("*").alias("trials"), F.avg("inside").alias("mean"), F.min("inside").alias("min"), F.max("inside").alias("max"), F.count_if(F.col("inside") < least).alias("bad"), worst.alias("w"))
    half = quantiles(per_trial, [], "inside", [0.5]).select(F.col("q")[0].alias("median"))
    return one.crossJoin(F.broadcast(half)).select("trials", "median", "mean", "min", "max", "bad", F.col("w.dataset").alias("worst_dataset"), F.col("w.trial").alias("worst_trial"))


def dataset_profile(per_trial: DataFrame, samples: DataFrame, noise: DataFrame) -> DataFrame:
    """Mean fs, noise(dataset, trial, noise) and rate, neurons, trials, samples and minutes of each dataset.

    Where the trials name their `neuron`, fs, noise and rate are first averaged over the trials of a neuron.
    """
    n = samples.groupBy("dataset").agg(F.count("*").alias("samples"))
    per_trial = per_trial.join(noise, list(TRIAL), "left")
    if "neuron" in per_trial.columns:
        per = per_trial.groupBy("dataset", "neuron").agg(*[F.avg(c).alias(c) for c in ("fs", "noise", "rate")], F.count("*").alias("trials"), F.sum("duration").alias("duration"))
        out = per.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in ("fs", "noise", "rate")], F.count("*").alias("neurons"), F.sum("trials").alias("trials"), (F.sum("duration") / 60).alias("minutes"))
        return out.join(n, "dataset")
    return per_trial.groupBy("dataset").agg(F.avg("fs").alias("fs"), F.avg("noise").alias("noise"), F.avg("rate").alias("rate"), F.count("*").alias("trials"), (F.sum("duration") / 60).alias("minutes")).join(n, "dataset")


def retained(posterior: DataFrame, burn_in: int) -> DataFrame:
    """Samples from the burn-in on, which is clamped so that the last sample always stays."""
    last = posterior.groupBy("tag").agg(F.max("sample").alias("last"))
    return posterior.join(last, "tag").where(F.col("sample") >= F.least(F.lit(burn_in), F.col("last"))).drop("last")


def posterior_mean_std(posterior: DataFrame, burn_in: int) -> DataFrame:
    """Mean and population deviation of each bin's trajectory over retained samples."""
    of = [f(c).alias(f"{c}_{n}") for c in ("burst", "b", "s", "c") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return retained(posterior, burn_in).groupBy("tag", "bin").agg(*of).withColumn("reconstruction", F.col("c_mean") + F.col("b_mean"))


def posterior_param_mean(params: DataFrame, burn_in: int, names: list[str]) -> DataFrame:
    """Mean of each parameter of `params(tag, sample, ...)` from the burn-in on; one that is negative or above the number of samples counts as 0."""
    rows = params.withColumn("_n", F.count("*").over(W.partitionBy("tag"))).withColumn("_k", F.row_number().over(W.partitionBy("tag").orderBy("sample")) - 1)
    start = F.when((F.lit(burn_in) < 0) | (F.lit(burn_in) > F.col("_n")), 0).otherwise(F.lit(burn_in))
    return rows.where(F.col("_k") >= start).groupBy("tag").agg(*[F.avg(c).alias(c) for c in names])


def map_sample(logp: DataFrame, burn_in: int) -> DataFrame:
    """The retained sample of greatest log-probability, the first of equals."""
    r = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("logp"), "sample"))
    return retained(logp, burn_in).withColumn("r", r).where("r = 1").drop("r")


def compare_chains(values: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """Means, population deviations, mean difference, KS statistic and its p of sides 'a' and 'b' of each group.

    The running shares are those of the distinct values, whose counts are taken first.
    """
    a, b = F.col(side) == "a", F.col(side) == "b"
    both = values.where(a | b)
    one = lambda f, c: f(F.when(c, F.col(value)))
    out = both.groupBy(*by).agg(one(F.avg, a).alias("mean_a"), one(F.avg, b).alias("mean_b"), one(F.stddev_pop, a).alias("std_a"), one(F.stddev_pop, b).alias("std_b"), F.count_if(a).alias("na"), F.count_if(b).alias("nb")).where("na > 0 and nb > 0")
    upto = W.partitionBy(*by).orderBy(value)
    steps = both.groupBy(*by, value).agg(F.count_if(a).alias("ca"), F.count_if(b).alias("cb"))
    steps = steps.withColumn("ca", F.sum("ca").over(upto)).withColumn("cb", F.sum("cb").over(upto)).join(out.select(*by, "na", "nb"), by)
    out = out.join(steps.groupBy(*by).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks")), by)
    root = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("ks")
    terms = [2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * root * root) for k in range(1, 21)]
    p = F.least(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)), F.lit(1.0))
    return out.select(*by, "mean_a", "mean_b", "std_a", "std_b", (F.col("mean_a") - F.col("mean_b")).alias("difference"), "ks", F.when(root < 0.2, F.lit(1.0)).otherwise(p).alias("p"))


def trace_agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.groupBy(*by).agg(pearson(F.col("x"), F.col("y")).alias("r"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def binary_agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Jaccard of positive bins (1 without any), share of equal flags, share of equal values."""
    x, y = F.col("x") > 0, F.col("y") > 0
    return pairs.groupBy(*by).agg(F.coalesce(F.try_divide(F.count_if(x & y), F.count_if(x | y)), F.lit(1.0)).alias("jaccard"), F.avg((x == y).cast("double")).alias("same_flag"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("same_value"))


def max_abs_diff_of(left: DataFrame, right: DataFrame, by: list[str], place: str) -> DataFrame:
    """Greatest absolute difference `d` of two arrays(*by, place, v) over places finite on both sides, of all groups of both: null where the
    places differ, as the shapes do then, or none is finite on both sides."""
    both = left.select(*by, place, F.col("v").alias("x"), F.lit(1).alias("_l")).join(right.select(*by, place, F.col("v").alias("y"), F.lit(1).alias("_r")), [*by, place], "full_outer")
    d = F.abs(F.nanvl(F.col("x").cast("double"), F.lit(None)) - F.nanvl(F.col("y").cast("double"), F.lit(None)))
    d = F.when(d < float("inf"), d)
    return both.groupBy(*by).agg(F.when(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()) == 0, F.max(d)).alias("d"))


def max_abs_diff(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("d"))


def total_counts(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    return counts.groupBy(*by).agg(F.coalesce(F.sum(value).cast("long"), F.lit(0)).alias("n"))


def noise_histogram(levels: DataFrame, bins: int = 100) -> DataFrame:
    """Density of noise levels in equal bins from the least to the greatest, and the 99.9th percentile."""
    r = levels.agg(F.min("noise").alias("a"), F.max("noise").alias("z"), F.count("*").alias("n")).crossJoin(quantiles(levels, [], "noise", [0.999]).select(F.col("q")[0].alias("limit")))
    k = F.least(F.floor((F.col("noise") - F.col("a")) / (F.col("z") - F.col("a")) * bins), F.lit(bins - 1))
    return levels.crossJoin(F.broadcast(r)).where("z > a").groupBy(k.alias("bin"), "limit").agg((F.count("*") / F.max("n") / F.max((F.col("z") - F.col("a")) / bins)).alias("density"))


def shared_window(bounds: DataFrame, by: list[str]) -> DataFrame:
    """Latest start and earliest end of two or more runs; none if they do not meet. Where `bounds` has them, with warnings:

    `clipped`: a run reaches beyond the window; `iterations`: runs(iterations) differ in their number; `disjoint`: runs(names array) share no name.
    """
    more = {}
    if "iterations" in bounds.columns:
        more["iterations"] = F.countDistinct("iterations") > 1
    if "names" in bounds.columns:
        more["disjoint"] = F.size(F.aggregate(F.collect_list("names"), F.first("names"), F.array_intersect)) == 0
    out = bounds.groupBy(*by).agg(F.max("first_t").alias("start_s"), F.min("last_t").alias("end_s"), F.count("*").alias("runs"), ((F.min("first_t") < F.max("first_t")) | (F.max("last_t") > F.min("last_t"))).alias("clipped"), *[c.alias(k) for k, c in more.items()])
    return out.where("runs >= 2 and end_s > start_s")


def representative_trial(scores: DataFrame, by: list[str]) -> DataFrame:
    """The trial whose scores are nearest to every series' median, summed; the lowest of equals. All series must have it."""
    scores = scores.where("correlation is not null").groupBy(*by, "method", "trial").agg(F.avg("correlation").alias("v"))
    m = scores.groupBy(*by, "method").agg(F.median("v").alias("m"))
    n = scores.groupBy(*by).agg(F.countDistinct("method").alias("k"))
    d = scores.join(m, [*by, "method"]).groupBy(*by, "trial").agg(F.sum(F.abs(F.col("v") - F.col("m"))).alias("d"), F.count("*").alias("c")).join(n, by).where("c = k")
    return d.groupBy(*by).agg(F.min(F.struct(F.round("d", 9).alias("d"), "trial")).alias("best")).select(*by, "best.trial")


def trajectory_loglik(traj: DataFrame, params: dict[str, float], dt: float, drift: float) -> DataFrame:
    """Log-likelihood of each sample: first bin, then burst transitions, Poisson counts, drift and residual of later bins."""
    w = W.partitionBy("tag", "sample").orderBy("bin")
    p = {k: F.lit(float(v)) for k, v in params.items()}
    prev, prev_b = F.lag("burst").over(w), F.lag("b").over(w)
    up, down = p["w01"] * dt, p["w10"] * dt
    move = F.when(F.col("p") == 0, F.when(F.col("burst") == 0, 1 - up).otherwise(up)).otherwise(F.when(F.col("burst") == 1, 1 - down).otherwise(down))
    rate = F.when(F.col("burst") == 0, p["r0"] * dt).otherwise(p["r1"] * dt)
    first = -0.5 * F.pow(F.col("b") / 1e-4, 2) - 0.5 * F.pow(F.col("y") - F.col("b"), 2) / p["sigma2"]
    later = F.log(move) + F.col("s") * F.log(rate) - rate - F.log(F.factorial(F.col("s").cast("int")).cast("double")) - 0.5 * F.pow((F.col("b") - F.col("pb")) / (drift * dt**0.5), 2) - 0.5 * F.pow(F.col("y") - F.col("c") - F.col("b"), 2) / p["sigma2"]
    return traj.withColumn("p", prev).withColumn("pb", prev_b).groupBy("tag", "sample").agg(F.sum(F.when(F.col("p").isNull(), first).otherwise(later)).alias("loglik"))


def param_logprior(params: DataFrame, priors: dict[str, tuple[float, float]]) -> DataFrame:
    """Sum of -0.5 z^2 against the prior means and deviations."""
    z = [-0.5 * F.pow((F.col(c) - m) / s, 2) for c, (m, s) in priors.items()]
    return params.withColumn("logprior", sum(z[1:], z[0]))


def validate(samples: DataFrame, spikes: DataFrame) -> DataFrame:
    """Per dataset: trials, samples, nulls, value range, median step and events, with the count of errors (steps that do not advance) and
    of warnings (trials without a finite value)."""
    d = F.col("t") - F.lag("t").over(W.partitionBy(*TRIAL).orderBy("i"))
    rows = samples.withColumn("d", d)
    per = rows.groupBy(*TRIAL).agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("nulls"), F.min("y").alias("least"), F.max("y").alias("most"), F.count_if(F.col("d") <= 0).alias("errors"))
    per = per.groupBy("dataset").agg(F.count("*").alias("trials"), F.sum("n").alias("samples"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("errors").alias("errors"), F.count_if(F.col("nulls") == F.col("n")).alias("warnings"))
    half = quantiles(rows, ["dataset"], "d", [0.5]).select("dataset", F.col("q")[0].alias("dt"))
    return per.join(half, "dataset", "left").join(spikes.groupBy("dataset").agg(F.count("*").alias("events")), "dataset", "left")
