"""Training frames against loops over their definition; the noise bank over several runs."""

from collections import Counter
from datetime import datetime

import duckdb
import numpy as np
import pytest

from sparktrace.operators import frames, noise_bank, series, stats, train
from sparktrace.plans import catalogue

ROWS = "dataset long, trial long, i int, t double, y double, n double"


def reflected(y, sigma):
    k = series.gaussian_kernel(sigma)
    return np.convolve(np.pad(y, len(k) // 2, mode="symmetric"), k, mode="valid")


@pytest.mark.parametrize("stretch", [7, 4096])
@pytest.mark.parametrize("before,kept", [(0.5, 10**6), (0.25, 45)])
def test_balanced_frames(spark, monkeypatch, before, kept, stretch):
    monkeypatch.setattr(frames, "STRETCH", stretch)
    monkeypatch.setattr(frames, "BINS", 8)
    draw = np.random.default_rng(3)
    traces = {(d, k): (draw.normal(size=n), draw.integers(0, 3, n).astype(float)) for d, k, n in ((1, 1, 40), (1, 2, 9), (2, 1, 60), (3, 1, 30))}
    rows = [(*key, i, i / 10, float(v), float(c)) for key, (y, e) in traces.items() for i, (v, c) in enumerate(zip(y, e))]
    found = frames.balanced_training_set(spark.createDataFrame(rows, ROWS).repartition(4), "n", 8, train.uniform, before, rows=90, kept=kept, leave_out=(3,)).collect()
    share = {1: 49 * 2 / 90, 2: 60 * 2 / 90}
    for r in found:
        y, e = traces[r["dataset"], r["trial"]]
        assert r["frame"] == pytest.approx(y[r["i"] : r["i"] + 8]) and r["label"] == pytest.approx(reflected(e, 2.0)[r["i"] + int(before * 8)])
    want = {key: int((len(traces[key][0]) - 8) / max(share[key[0]], 1)) for key in traces if key[0] != 3}
    n = Counter((r["dataset"], r["trial"]) for r in found)
    assert len({(r["dataset"], r["trial"], r["i"]) for r in found}) == len(found) == min(kept, sum(want.values()))
    assert kept < 100 or n == Counter(want)


def test_smallest_equals_order_and_limit(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(frames, "BINS", 16)
    rows = spark.range(500).withColumn("u", (F.col("id") * 7919 % 97) / 97).repartition(6)
    for k in (0, 1, 77, 499, 500, 900):
        assert sorted(r["id"] for r in frames.smallest(rows, F.col("u"), ["id"], k).collect()) == sorted(r["id"] for r in rows.orderBy("u", "id").limit(k).collect())


def centred(y, counts, width, smooth):
    """A frame at every sample by the definition: half a frame of zeros at both ends."""
    z = np.zeros(width // 2)
    y, counts = np.concatenate((z, y, z)), np.concatenate((z, counts, z))
    rates = reflected(counts, smooth)
    return [(i, y[i : i + width], counts[i : i + width], rates[i : i + width]) for i in range(len(y) - width)]


@pytest.mark.parametrize("fs", [20.0, 13.0])
def test_centred_frames(spark, fs):
    draw = np.random.default_rng(9)
    t, y = 3 + np.arange(120) / 20, draw.normal(size=120)
    s = np.sort(draw.uniform(2.5, 9.5, 25))
    wide = spark.createDataFrame([(1, 1, t.tolist(), y.tolist()), (1, 2, t.tolist(), y.tolist()), (1, 3, [0.0], [1.0])], "dataset long, trial long, t array<double>, y array<double>")
    spikes = spark.createDataFrame([(1, 1, float(x)) for x in s] + [(1, 2, 99.0), (1, 3, 0.0)], "dataset long, trial long, s double")
    recorded = frames.recordings(wide, spikes, fs, 10, 2 / fs)
    (r,) = recorded.collect()
    assert r["trial"] == 1 and r["rate"] == pytest.approx(20)
    m = round(120 * fs / 20)
    low, step = series.band_limited(y, m), 1 / fs
    cut, kept = int(np.ceil(0.5 * fs - 1e-9)), m - int(np.floor(fs + 1e-9))
    low = low[cut : cut + kept]
    inside = s[(s >= 3) & (s <= t[-1])] - 3 + 0.05
    begins = (0.05 * fs / fs) if fs == 20.0 else 0.05
    times = begins + (cut + np.arange(kept)) * step
    inside = inside[(inside >= times[0]) & (inside <= times[-1])]
    counts = np.histogram(inside - times[0], np.append(np.arange(kept) * step - step / 2, (kept - 1) * step))[0]
    assert r["trace"][5:-5] == pytest.approx(low) and r["counts"][5:-5] == pytest.approx(counts) and r["elapsed"] == pytest.approx(kept / fs)
    found = sorted(frames.segment_training_set(recorded, 10, 3).collect(), key=lambda x: x["i"])
    want = centred(low, counts, 10, 2.0)
    assert len(found) == kept == len(want)
    for f, (i, frame, around, rates) in zip(found, want):
        assert (f["i"], f["n"], f["class"]) == (i, counts[i], min(counts[i], 2))
        assert f["frame"] == pytest.approx(frame) and f["counts"] == pytest.approx(around) and f["rates"] == pytest.approx(rates) and f["rate"] == pytest.approx(rates[5])


def test_noise_bank_redoes_only_what_changed(spark, tmp_path):
    path, kinds = "file://" + str(tmp_path / "bank"), "dataset string, trial long, t array<double>, y array<double>"
    y = [float(i) for i in range(40)]
    rows = [("a", 1, [i / 10 for i in range(40)], y), ("a", 2, None, y * 10), ("b", 1, [i / 4 for i in range(40)], y), ("b", 2, [0.0], [1.0]), ("b", 3, [], []), ("b", 4, [0.0, 0.1, float("nan"), 0.2], [1.0, 2.0, 3.0, 6.0])]
    run = lambda rows, fs=5.0: {(r["dataset"], r["trial"]): r for r in noise_bank.prepare_noise_bank(spark.createDataFrame(rows, kinds), fs, path).collect()}
    first = run(rows)
    assert {r["run"] for r in first.values()} == {1} and len(first) == 6
    assert first["a", 1]["y"] == [i * 2 + 0.5 for i in range(20)]
    n = int(np.round(399 / 121.9 * 5)) + 1
    assert first["a", 2]["y"] == pytest.approx(np.interp(np.linspace(0, 399 / 121.9, n), np.arange(400) / 121.9, y * 10))
    assert first["b", 1]["y"] == y and first["b", 2]["y"] == [1.0] and first["b", 3]["y"] == []
    assert first["b", 4]["y"] == [1.5]
    files = sorted(p.name for p in (tmp_path / "bank" / "data").iterdir())
    assert {r["run"] for r in run(rows).values()} == {1} and sorted(p.name for p in (tmp_path / "bank" / "data").iterdir()) == files
    rows[0] = ("a", 1, rows[0][2], [v + 1 for v in y])
    again = run(rows)
    assert {k for k, r in again.items() if r["run"] == 2} == {("a", 1)} and again["a", 1]["y"][0] == 1.5
    assert {r["run"] for r in run(rows, 2.5).values()} == {3} and {r["run"] for r in run(rows).values()} == {1, 2}
    with pytest.raises(ValueError, match="share"):
        run([rows[0], rows[0]])
    with pytest.raises(ValueError, match="no traces"):
        run([])


def test_trials_without_differences_between_the_quantiles(spark):
    rows = spark.createDataFrame([(0, k, i, v) for k, vs in enumerate([[1.0], [0.0, 1.0, 3.0], [0.0, 1.0, 3.0, 6.0], [None, 2.0]]) for i, v in enumerate(vs)], "dataset long, trial long, i int, y double")
    assert {r["trial"] for r in stats.robust_diff_std(rows, empty=None).collect()} == {2}
    assert {r["trial"]: r["spread"] for r in stats.robust_diff_std(rows).collect() if r["trial"] != 2} == {0: 0.0, 1: 0.0, 3: 0.0}


def test_differences_that_equal_a_quantile_but_for_rounding(spark, tmp_path):
    trials = [[13.19, 16.26, 15.26, 12.19, 15.26, 13.19], [32.01, 86.66, 85.66, 31.01, 85.66, 85.66, 53.44], [128.77, 189.99, 190.99, 128.77, 189.99, 127.77, 190.99, 128.77]]
    rows = [(100 * k + i, datetime(2024, 1, 1, i), k, "view", v, "{}") for k, vs in enumerate(trials) for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    mine = catalogue.QUERIES["d4_robust_diff_std"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, mine)) == sorted(duck.execute(catalogue.SQL["d4_robust_diff_std"]).fetchall())
    assert {r["trial"]: r["spread"] for r in mine} == {0: 3.017091, 1: 23.884686, 2: 46.864986}
