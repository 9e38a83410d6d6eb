"""Reports over score tables, rankings, upserts and catalogues."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.functions import text
from sparktrace.operators import stats


def corr_vs_sigma(scores: DataFrame, series: list[str], reduce: str = "trial") -> DataFrame:
    """Mean, standard error (0 below two) and n of each series at each sigma, over trials or over dataset means."""
    rows = scores.where("correlation is not null")
    if reduce == "dataset":
        rows = rows.groupBy(*series, "corr_sigma_ms", "dataset", "smoothing", *[c for c in ("run",) if c not in series]).agg(F.avg("correlation").alias("correlation"))
    n = F.count("*")
    return rows.groupBy(*series, "corr_sigma_ms").agg(F.avg("correlation").alias("mean"), F.when(n >= 2, F.stddev_samp("correlation") / F.sqrt(n)).otherwise(F.lit(0.0)).alias("sem"), n.alias("n"))


def rank_at_anchor(curves: DataFrame, series: list[str], limit: float) -> DataFrame:
    """Rank of each series' mean, linearly interpolated at min(its greatest sigma, limit); nulls last, key as tie-break."""
    w = W.partitionBy(*series).orderBy("corr_sigma_ms")
    c = curves.withColumn("anchor", F.least(F.max("corr_sigma_ms").over(W.partitionBy(*series)), F.lit(limit)))
    c = c.withColumn("x1", F.lead("corr_sigma_ms").over(w)).withColumn("y1", F.lead("mean").over(w))
    hit = (F.col("corr_sigma_ms") <= F.col("anchor")) & ((F.col("x1") > F.col("anchor")) | F.col("x1").isNull())
    low = F.row_number().over(w) == 1
    y = F.when(F.col("x1").isNull() | (F.col("corr_sigma_ms") > F.col("anchor")), F.col("mean")).otherwise(F.col("mean") + (F.col("y1") - F.col("mean")) * (F.col("anchor") - F.col("corr_sigma_ms")) / (F.col("x1") - F.col("corr_sigma_ms")))
    at = c.withColumn("low", low).where(hit | (F.col("low") & (F.col("corr_sigma_ms") > F.col("anchor")))).select(*series, y.alias("score"))
    return rank(at, "score", series)


def series_labels(rows: DataFrame, label: str, run: str) -> DataFrame:
    """`shown`: the label, with the run behind it where several series have the same label."""
    n = F.count("*").over(W.partitionBy(label))
    return rows.withColumn("shown", F.when(n > 1, F.concat(F.col(label), F.lit(" ("), F.col(run), F.lit(")"))).otherwise(F.col(label)))


def rank(rows: DataFrame, score: str, key: list[str], by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Place by score descending, nulls last, key as tie-break; in each group of `by`.

    Scores that agree in `digits` decimals are equal, so means that differ only by the order in which their values were added are.
    """
    order = [F.desc_nulls_last(score if digits is None else F.round(score, digits)), *key]
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*(by or [])).orderBy(*order)))


def at_sigma(scores: DataFrame, sigma: float) -> DataFrame:
    """Finite scores at one sigma."""
    return scores.where((F.abs(F.col("corr_sigma_ms") - sigma) <= 1e-6 + 1e-5 * sigma) & F.col("correlation").isNotNull())


def score_distribution(scores: DataFrame, series: list[str], sigma: float, reduce: str = "trial") -> DataFrame:
    """Percentiles 5, 25, 50, 75, 95 of each (series, smoothing) at one sigma, over trials or over the means of each dataset and run, and
    `place`: the rank of the series by its median over all smoothings."""
    rows = at_sigma(scores, sigma)
    if reduce == "dataset":
        runs = [c for c in ("run",) if c in rows.columns and c not in series]  # the run is part of the bucket, as runs of a series are scored apart
        rows = rows.groupBy(*series, "smoothing", "dataset", *runs).agg(F.avg("correlation").alias("correlation"))
    # One pass for both: of each series and smoothing, and of each series over all smoothings (a null one).
    both = rows.where("smoothing is not null").withColumn("_s", F.explode(F.array("smoothing", F.lit(None).cast("string"))))
    q = stats.quantiles(both, [*series, "_s"], "correlation", [0.05, 0.25, 0.5, 0.75, 0.95], number="n")
    median = F.max(F.when(F.col("_s").isNull(), F.col("q")[2])).over(W.partitionBy(*series))
    placed = q.withColumn("_m", median).withColumn("place", F.dense_rank().over(W.orderBy(F.desc_nulls_last("_m"), *series))).where("_s is not null")
    return placed.select(*series, F.col("_s").alias("smoothing"), "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("p5", "p25", "p50", "p75", "p95"))], "place")


def dotplot_stats(scores: DataFrame, by: list[str]) -> DataFrame:
    rows = scores.where("correlation is not null")
    q = stats.quantiles(rows, by, "correlation", [0.25, 0.5, 0.75], number="n")
    return q.select(*by, "n", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"))


def directory_eval(scores: DataFrame, model: str) -> DataFrame:
    return scores.groupBy(model).agg(F.count("*").alias("datasets"), F.count("correlation").alias("finite"), F.avg("correlation").alias("mean"), F.median("correlation").alias("median"), F.min("correlation").alias("min"), F.max("correlation").alias("max"))


def leaderboard(models: DataFrame, name: str, score: str, top: int = 10, key: str | None = None) -> DataFrame:
    """The best models among those whose names parse, with their parameters; then the first `baseline...` by name, with `baseline` true.

    Of models that share a name the first by `key` counts first.
    """
    ties = [key] if key else []
    p = text.model_parameters(F.col(name))
    rows = models.select("*", *[c.alias(k) for k, c in p.items()])
    best = rows.where("k is not null").orderBy(F.desc_nulls_last(score), name, *ties).limit(top).withColumn("baseline", F.lit(False))
    base = rows.where(F.col(name).startswith("baseline")).orderBy(name, *ties).limit(1).withColumn("baseline", F.lit(True))
    return best.unionByName(base)


def sweep_heatmap(models: DataFrame, order: str, duties: list[float]) -> DataFrame:
    """Per (k, rate, smooth) a column for each duty; the last row by `order` wins a cell."""
    return models.groupBy("k", "rate", "smooth").pivot("duty", duties).agg(F.max_by("score", order))


def best_by_k(models: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Greatest and median score and number of each k; a `baseline` beside them where one is given.

    `baselines(score, rate, folder_rate)`: one whose recorded rate differs from that of its folder is dropped; the best of the rest counts.
    """
    out = models.groupBy("k").agg(F.max("score").alias("best"), F.median("score").alias("median"), F.count("*").alias("n"))
    if baselines is None:
        return out
    agrees = F.coalesce(F.abs(F.col("rate") - F.col("folder_rate")) <= 1e-6 * F.abs("folder_rate"), F.lit(True))
    return out.crossJoin(F.broadcast(baselines.where(agrees).agg(F.max("score").alias("baseline"))))


def timing_summary(timings: DataFrame, baseline: str | None = None) -> DataFrame:
    """n, mean, median, min, max, population deviation and speed-up against the baseline of each backend.

    Without a name the baseline is `cpu`, else the first backend by name; a name that no backend has is an error.
    """
    per = timings.groupBy("backend").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.min("seconds").alias("min"), F.max("seconds").alias("max"), F.when(F.count("*") > 1, F.stddev_pop("seconds")).otherwise(F.lit(0.0)).alias("std"))
    if baseline is None:
        base = per.agg(F.coalesce(F.max(F.when(F.col("backend") == "cpu", F.col("mean"))), F.min_by("mean", "backend")).alias("base"))
    else:
        base = per.agg(F.max(F.when(F.col("backend") == baseline, F.col("mean"))).alias("base"))
        base = base.select(F.when(F.col("base").isNull(), F.raise_error(F.lit(f"no backend {baseline}"))).otherwise(F.col("base")).alias("base"))
    return per.crossJoin(F.broadcast(base)).withColumn("speed_up", F.try_divide("base", "mean")).drop("base")


def latest_per_key(rows: DataFrame, key: str, newest: Column, tie: str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(newest.desc(), tie))).where("r = 1").drop("r")


def default_seed(name: str, fraction: float) -> int:
    """A seed for a named collection and a fraction: the first 32 bits of the SHA-256 of `name|fraction` with six decimals."""
    return int(hashlib.sha256(f"{name}|{float(fraction):.6f}".encode()).hexdigest()[:8], 16)


def seeded_subset(rows: DataFrame, by: list[str], item: str, fraction: float, seed: int | None = None, name: str = "") -> DataFrame:
    """max(1, ceil(fraction * n)) items of each group, the same for the same seed: those with the least MD5 of `<seed>:<item>`.

    Without a seed that of `name` and the fraction is taken; a fraction of 1 or more keeps all.
    """
    if fraction >= 1:
        return rows
    seed = default_seed(name, fraction) if seed is None else seed
    w = W.partitionBy(*by)
    r = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string"))), item))
    return rows.withColumn("n", F.count("*").over(w)).withColumn("r", r).where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * fraction))).drop("n", "r")


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], line: str, on_conflict: str = "replace") -> DataFrame:
    """Rows of both by key. replace: the last incoming row, else the last base row. keep: the last base row, else the first incoming."""
    both = base.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    if on_conflict == "replace":
        order = [F.desc("_new"), F.desc(line)]
    else:
        order = [F.col("_new"), F.when(F.col("_new") == 0, -F.col(line)).otherwise(F.col(line))]
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r", "_new")


def union_families(main: DataFrame | None, single: DataFrame | None = None) -> DataFrame:
    """Rows of both families of runs with their `kind`, main or single; either may be None, but not both."""
    parts = [rows.withColumn("kind", F.lit(kind)) for rows, kind in ((main, "main"), (single, "single")) if rows is not None]
    if not parts:
        raise ValueError("both families are skipped")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def union_method_outputs(outputs: DataFrame, second: DataFrame, label: str, sep: str = "::") -> DataFrame:
    """Outputs(method, ...) and those of a second model under the names `<method><sep><label>`. A name that the first outputs have is an error."""
    named = second.withColumn("method", F.concat_ws(sep, "method", F.lit(label)))
    taken = outputs.select("method").distinct().withColumn("_taken", F.lit(True))
    checked = named.join(taken, "method", "left").withColumn("method", F.when(F.col("_taken"), F.raise_error(F.concat(F.lit("there are outputs of "), "method"))).otherwise(F.col("method"))).drop("_taken")
    return outputs.unionByName(checked)


def overridden(was: Column, now: Column) -> Column:
    """The entries of `now`, and those of `was` whose keys it lacks; null counts as empty."""
    kept = F.map_filter(was, lambda k, v: ~F.array_contains(F.map_keys(now), k))
    return F.when(was.isNull(), now).when(now.isNull(), was).otherwise(F.map_concat(kept, now))


def upsert_summary(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Summaries(key, correlations map, trialwise map, windows): new methods override, others stay, new windows replace old ones."""
    maps = [c for c in ("correlations", "trialwise") if c in old.columns and c in new.columns]
    rest = [c for c in ("windows",) if c in old.columns and c in new.columns]
    names = [*maps, *rest]
    both = old.select(key, *[F.col(c).alias(f"was_{c}") for c in names]).join(new.select(key, *[F.col(c).alias(f"now_{c}") for c in names]), key, "full_outer")
    return both.select(key, *[overridden(F.col(f"was_{c}"), F.col(f"now_{c}")).alias(c) for c in maps], *[F.coalesce(f"now_{c}", f"was_{c}").alias(c) for c in rest])


def upsert_method_entries(old: DataFrame, new: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries(by, method, place, config map, cache_key, ...) with the new ones in the place of the same method's or behind all others, and
    `methods_run` of each group, every method once in the order of places.

    A new entry whose key is not the signature of its config is an error. Of several new entries of a method the last by place counts.
    """
    wrong = F.col("cache_key") != text.config_signature(F.col("config"))
    checked = new.withColumn("cache_key", F.when(wrong, F.raise_error(F.concat(F.lit("the key is not that of the config: "), "cache_key"))).otherwise(F.col("cache_key")))
    checked = upsert(checked.limit(0), checked, [*by, "method"], "place")
    places = old.groupBy(*by, "method").agg(F.min("place").alias("_own"))
    ends = old.groupBy(*by).agg(F.max("place").alias("_end"))
    moved = checked.join(places, [*by, "method"], "left").join(ends, by, "left").withColumn("place", F.coalesce("_own", F.coalesce("_end", F.lit(-1)) + 1 + F.col("place"))).drop("_own", "_end")
    entries = old.join(checked.select(*by, "method").distinct(), [*by, "method"], "left_anti").unionByName(moved)
    first = entries.groupBy(*by, "method").agg(F.min("place").alias("place"))
    run = first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "method"))), lambda x: x["method"]).alias("methods_run"))
    return entries, run


def ordered_distinct(rows: DataFrame, token: str, place: str) -> DataFrame:
    """Trimmed tokens that are not empty, by first occurrence."""
    return rows.select(F.trim(token).alias("token"), place).where("token <> ''").groupBy("token").agg(F.min(place).alias("first"))


def status_counts(rows: DataFrame, by: list[str], status: Column) -> DataFrame:
    return rows.groupBy(*by, status.alias("status")).agg(F.count("*").alias("n"))
