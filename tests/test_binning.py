"""Bins of uneven frames and of series of known length, against numpy and a loop over the definition."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrace.operators import binning
from sparktrace.sources import views

SAMPLES = "dataset long, trial long, i int, t double"


def counts(spark, times, events, **how):
    samples = spark.createDataFrame([(1, 1, i, float(t)) for i, t in enumerate(times)], SAMPLES)
    spikes = spark.createDataFrame([(1, 1, float(s)) for s in events], "dataset long, trial long, s double")
    rows = binning.frame_histogram(samples, spikes, **how).collect()
    return [r["n"] for r in sorted(rows, key=lambda r: r["i"])]


def test_frames_are_numpys_bins(spark):
    draw = np.random.default_rng(4)
    for times in ([0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.5, 3.5], np.cumsum(draw.uniform(0.1, 2, 40)), [5.0, 6.0, 6.0, 7.0]):
        times = np.asarray(times, dtype=float)
        events = np.concatenate((times, times - 0.5, times + 0.5, [1.8, -0.5, 3.5, -9.0, 99.0], draw.uniform(times[0] - 1, times[-1] + 1, 50)))
        edges = np.append(times - 0.5, times[-1] + 0.5)
        assert counts(spark, times, events, dt=1.0) == np.histogram(events, edges)[0].tolist()
        assert counts(spark, times, events, dt=1.0, tail=0.0) == np.histogram(events, np.append(times - 0.5, times[-1]))[0].tolist()
        step = np.diff(times).mean()
        assert counts(spark, times, events) == np.histogram(events, np.append(times - step / 2, times[-1] + step / 2))[0].tolist()


def test_event_at_the_last_edge(spark):
    assert counts(spark, [0, 1, 2, 3], [-0.5, 3.5], dt=1.0) == [1, 0, 0, 1]
    assert counts(spark, [0, 1, 2.5, 3.5], [1.8], dt=1.0) == [0, 1, 0, 0]


def test_edges_of_groups_without_events(spark):
    edges = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 4.0), ("a", 2, 4.0), ("a", 3, 9.0), ("b", 0, 0.0), ("b", 1, 1.0)], "g string, k int, at double")
    spikes = spark.createDataFrame([("a", 4.0), ("a", 9.0), ("a", 1.0), ("c", 1.0)], "g string, s double")
    assert sorted(tuple(r) for r in binning.edge_counts(edges, spikes, ("g",)).collect()) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 2), ("b", 0, 0)]


def looped(values, freq_in, freq_out):
    n = len(values)
    times = np.linspace(0, n / freq_in, n) if n > 1 else [n / freq_in]
    bins, c = [0], 1
    for t, v in zip(times, values):
        while t > c / freq_out:
            bins.append(0)
            c += 1
        bins[c - 1] += v > 0
    return bins


@pytest.mark.parametrize("freq_in,freq_out", [(10.0, 4.0), (10.0, 25.0), (30.0, 30.0), (121.9, 7.3)])
def test_rebinned_flags(spark, freq_in, freq_out):
    draw = np.random.default_rng(6)
    series = {g: draw.integers(-1, 3, n).tolist() for g, n in (("a", 1), ("b", 2), ("c", 57), ("d", 200))}
    rows = spark.createDataFrame([(g, i, v) for g, vs in series.items() for i, v in enumerate(vs)], "g string, i int, x int")
    found = Counter((r["g"], r["k"], r["x"]) for r in binning.rebin_flags(rows, ["g"], freq_in, freq_out).collect())
    assert found == Counter((g, k, x) for g, vs in series.items() for k, x in enumerate(looped(vs, freq_in, freq_out)))


def test_rebinned_correlation(spark):
    draw = np.random.default_rng(8)
    a, b = draw.integers(0, 2, 90), draw.integers(0, 2, 90)
    frame = lambda v: spark.createDataFrame([("g", i, int(x)) for i, x in enumerate(v)], "g string, i int, x int")
    x, y = (np.array(looped(v, 10.0, 25.0), dtype=float) for v in (a, b))
    assert binning.rebinned_correlation(frame(a), frame(b), ["g"], 10.0, 25.0).first()["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    k = np.exp(-0.5 * ((np.arange(len(x))[:, None] - np.arange(len(x))) / 25.0 / 0.3) ** 2)
    k /= k.sum(axis=1, keepdims=True)
    assert binning.rebinned_correlation(frame(a), frame(b), ["g"], 10.0, 25.0, 0.3).first()["r"] == pytest.approx(np.corrcoef(k @ x, k @ y)[0, 1])
    with pytest.raises(Exception, match="number of bins"):
        binning.rebinned_correlation(frame(a), frame(b[:50]), ["g"], 10.0, 4.0).collect()


def test_partitions_of_the_posterior_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "PARTITION_ROWS", 500, raising=False)
    posterior = views.Tables(spark, "/root/testdata/sf0.001").posterior
    assert posterior.rdd.getNumPartitions() >= posterior.count() / 500


def test_rebinning_stays_in_the_partitions_of_a_series(spark):
    posterior = views.Tables(spark, "/root/testdata/sf0.001").posterior
    flags = [posterior.select("tag", "sample", F.col("bin").alias("i"), F.col(c).alias("x")) for c in ("s", "burst")]
    plan = binning.rebinned_correlation(*flags, ["tag", "sample"], 10.0, 25.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_partitions_of_the_samples_follow_their_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "PARTITION_ROWS", 50, raising=False)
    samples = views.Tables(spark, "/root/testdata/sf0.001").samples
    assert samples.rdd.getNumPartitions() >= samples.count() / 50
