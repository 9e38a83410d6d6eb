"""Small cases with answers worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrace.functions import text
from sparktrace.operators import match, report, reshape, score, series, stats, train
from sparktrace.sources import io


def samples(spark, t, y=None, trial=0):
    y = t if y is None else y
    return spark.createDataFrame([(0, trial, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y))], "dataset long, trial long, i int, t double, y double")


def spikes(spark, s):
    return spark.createDataFrame([(0, 0, float(x)) for x in s], "dataset long, trial long, s double")


def column(df, c, by="i"):
    return [r[c] for r in df.orderBy(by).collect()]


def test_assign_is_strict(spark):
    assert column(match.assign_spikes(samples(spark, [0, 1, 2, 3]), spikes(spark, [0, 0.5, 1, 3, 3.5])), "n") == [2, 0, 1, 0]


def test_blocks_drop_the_tail(spark):
    out = series.resample_to(samples(spark, np.arange(7) / 60, range(7)), 30.0)
    assert column(out, "y", "k") == [0.5, 2.5, 4.5]


def test_gap_of_exactly_four_does_not_split(spark):
    rates = spark.createDataFrame([(0, 0, 1.0)], "dataset long, trial long, fs double")
    assert column(series.gap_segments(samples(spark, [0, 1, 2, 3, 8, 9]), rates), "seg") == [0, 0, 0, 0, 1, 1]
    assert column(series.gap_segments(samples(spark, [0, 1, 5, 6]), rates), "seg") == [0, 0, 0, 0]


@pytest.mark.parametrize("edges", ["reflect", "nearest"])
def test_smoothing_a_constant_changes_nothing(edges):
    assert np.allclose(series.convolved(np.full(20, 3.0), series.gaussian_kernel(2.0), edges), 3.0)


def test_short_series_reflects_more_than_once():
    y, kernel = np.array([1.0, 2.0, 4.0]), series.gaussian_kernel(2.0)
    r = len(kernel) // 2
    at = [[((i + k) % 6 + 6) % 6 for k in range(-r, r + 1)] for i in range(3)]
    want = [sum(w * y[j if j < 3 else 5 - j] for w, j in zip(kernel, row)) for row in at]
    assert np.allclose(series.convolved(y, kernel), want)


def test_event_between_bins_is_split(spark):
    w = spark.createDataFrame([(0, 0, 0.0, 4.0)], "dataset long, trial long, start_s double, end_s double")
    out = series.event_rates(series.event_grid(w, 1.0), spikes(spark, [2.25]))
    assert column(out, "rate", "k") == [0, 0, 0.75, 0.25, 0]


def test_equal_overlaps_take_the_first(spark):
    seg = spark.createDataFrame([(0, 0, k, float(4 * k), 4.0 * k + 2) for k in range(3)], "dataset long, trial long, seg int, seg_start double, seg_end double")
    win = spark.createDataFrame([(0, 0, 0, 0.0, 6.0)], "dataset long, trial long, k int, start_s double, end_s double")
    assert match.match_segment(seg, win).first()["seg"] == 0


def test_burn_in_keeps_the_last_sample(spark):
    p = spark.createDataFrame([("a", s, 0) for s in range(3)], "tag string, sample int, bin int")
    assert [r["sample"] for r in stats.retained(p, 100).collect()] == [2]


def test_constant_prediction_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert df.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_ks_with_ties(spark):
    rows = [("g", "a", v) for v in (1.0, 2.0, 2.0, 5.0)] + [("g", "b", v) for v in (2.0, 3.0, 4.0)]
    out = stats.compare_chains(spark.createDataFrame(rows, "k string, side string, v double"), ["k"], "side", "v").first()
    assert abs(out["ks"] - 5 / 12) < 1e-9 and 0 <= out["p"] <= 1


@pytest.mark.parametrize("how, line", [("replace", 2), ("keep", 1)])
def test_upsert_of_repeated_incoming_rows(spark, how, line):
    none = spark.createDataFrame([], "key int, line int")
    two = spark.createDataFrame([(1, 1), (1, 2)], "key int, line int")
    out = report.upsert(none, two, ["key"], "line", how)
    assert [r["line"] for r in out.collect()] == [line]
    assert report.upsert(out, out, ["key"], "line", how).count() == 1


def test_events_per_bin(spark):
    df = spark.createDataFrame([(0, 30.0), (1, 10.0), (2, 60.0), (3, None)], "i int, fs double")
    assert column(df.select("i", text.events_per_bin(F.col("fs"), 120.0).alias("n")), "n") == [4, 7, 3, 2]


def test_mask_without_windows_changes_nothing(spark):
    s = samples(spark, [0, 1, 2])
    none = spark.createDataFrame([], "dataset long, trial long, start_s double, end_s double")
    assert column(reshape.mask_to_windows(s, none), "y") == [0, 1, 2]


def test_fourier_keeps_a_slow_wave(spark):
    t = np.arange(60) / 30
    wide = spark.createDataFrame([(0, 0, t.tolist(), np.sin(2 * np.pi * t).tolist())], "dataset long, trial long, t array<double>, y array<double>")
    for fs in (15.0, 60.0):
        out = series.fourier_resample(wide, 30.0, fs).first()
        assert len(out["y"]) == 2 * fs and np.allclose(out["y"], np.sin(2 * np.pi * np.array(out["t"])), atol=1e-9)


def test_one_smoothed_event_is_found_again(spark):
    v = series.convolved(np.eye(1, 15, 7)[0], series.gaussian_kernel(1.0), "constant").tolist()
    sl = spark.createDataFrame([(0, 0, 100, v)], "dataset long, trial long, first long, values array<double>")
    assert [r["at"] for r in series.rates_to_counts(sl, 1.0).collect()] == [107]


def test_causal_kernel_sums_to_one():
    k = series.inverse_gaussian_kernel(30.0)
    assert len(k) == 199 and abs(k.sum() - 1) < 1e-12


def test_failing_method_does_not_stop_others(spark):
    wide = spark.createDataFrame([(0, 0, [0.0, 1.0], [1.0, 2.0])], "dataset long, trial long, t array<double>, y array<double>")
    methods = {"good": lambda t, y: y, "bad": lambda t, y: 1 / 0}
    out = {r["method"]: r for r in train.run_methods(wide, methods).collect()}
    assert out["good"]["prob"] == [1.0, 2.0] and "ZeroDivisionError" in out["bad"]["error"]
    done = spark.createDataFrame([(0, 0, "good")], "dataset long, trial long, method string")
    assert [r["method"] for r in train.run_methods(wide, methods, done).collect()] == ["bad"]


def test_seeded_subset_is_the_same_again(spark):
    rows = spark.createDataFrame([("a", i) for i in range(4)], "g string, x int")
    one, two = (sorted(r["x"] for r in report.seeded_subset(rows, ["g"], "x", 0.5, 123).collect()) for _ in range(2))
    assert len(one) == 2 and one == two


def test_readers(spark, tmp_path):
    (tmp_path / "traj").mkdir()
    (tmp_path / "traj" / "traj_samples_rec_1_trial3.dat").write_text("index,burst,B,S,C,Y\n0,0,-0.25,0,0.125,0.5\n0,0,0.1,1,0.2,0.3\n1,1,0,0,0,0\n1,0,0,2,0,0\n")
    got = io.read_posterior(spark, str(tmp_path / "traj"), 2).orderBy("sample", "bin").collect()
    assert [(r["tag"], r["trial"], r["sample"], r["bin"], r["s"]) for r in got] == [("rec_1", 3, 0, 0, 0), ("rec_1", 3, 0, 1, 1), ("rec_1", 3, 1, 0, 0), ("rec_1", 3, 1, 1, 2)]
    with pytest.raises(Exception, match="no multiple"):
        io.read_posterior(spark, str(tmp_path / "traj"), 3).collect()
    leaf = tmp_path / "tree" / "run1" / "d1" / "30Hz"
    leaf.mkdir(parents=True)
    (leaf / "summary.json").write_text(json.dumps({"correlations": {"sampler": 0.5, "unet": None}, "gt_count": 3}))
    tree = io.read_run_tree(spark, str(tmp_path / "tree"), runs=["run1"]).collect()
    assert sorted((r["run"], r["dataset"], r["smoothing"], r["method"], r["correlation"]) for r in tree) == [("run1", "d1", "30Hz", "sampler", 0.5), ("run1", "d1", "30Hz", "unet", None)]
    bad = spark.createDataFrame([('{"a": [1, -2]}',)], "json string")
    with pytest.raises(Exception, match="invalid trials"):
        io.read_trial_selection(bad).collect()
    (tmp_path / "p.csv").write_text("alpha,gamma\n1,2\n3,4\n")
    assert {(r["sample"], r["name"], r["value"]) for r in io.read_params(spark, str(tmp_path / "p.csv")).collect()} == {(0, "alpha", 1.0), (1, "alpha", 3.0), (0, "gamma", 2.0), (1, "gamma", 4.0)}
    assert io.file_fingerprints(spark, str(tmp_path / "p.csv")).count() == 1
    head = io.TRIALWISE.replace(" string", "").replace(" double", "").replace(" int", "").replace(", ", ",")
    (tmp_path / "s.csv").write_text(head + "\nr,d,raw,m,m,50,1,0,1,0.5\n")
    assert io.read_trialwise_csv(spark, str(tmp_path / "s.csv")).first()["correlation"] == 0.5


def test_write_replaces_only_its_partitions(spark, tmp_path):
    row = "dataset string, method string, i int, prob double"
    path = str(tmp_path / "out")
    io.write_results(spark.createDataFrame([("a", "m", 0, 1.0), ("b", "m", 0, 2.0)], row), path)
    io.write_results(spark.createDataFrame([("a", "m", 0, 9.0)], row), path)
    assert {(r["dataset"], r["prob"]) for r in spark.read.parquet(path).collect()} == {("a", 9.0), ("b", 2.0)}


def brute_rate(events, start, end, fs, sigma):
    """Smoothed event rate on the grid of a window: events split between two bins, edges reflected."""
    n = int(np.ceil((end - start) * fs)) + 1
    v = np.zeros(n)
    for s in events:
        if start <= s <= end:
            x = (s - start) * fs
            k = int(np.floor(x))
            v[k] += 1 - (x - k)
            if k + 1 < n:
                v[k + 1] += x - k
    return np.linspace(start, end, n), brute_smooth(v, sigma)


def brute_smooth(v, sigma):
    r, n = int(4 * sigma + 0.5), len(v)
    w = [np.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    place = lambda k: k % (2 * n) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
    return np.array([sum(a * v[place(k + d)] for a, d in zip(w, range(-r, r + 1))) / sum(w) for k in range(n)])


def brute_pieces(t, fs):
    cuts = [0, *[i for i in range(1, len(t)) if t[i] - t[i - 1] > 4 / fs], len(t)]
    return [list(range(a, z)) for a, z in zip(cuts, cuts[1:]) if z > a]


def brute_align(t, y, grid, fs):
    out = np.full(len(grid), np.nan)
    for p in brute_pieces(t, fs):
        inside = (grid >= t[p[0]]) & (grid <= t[p[-1]])
        if inside.any():
            out[inside] = np.interp(grid[inside], [t[i] for i in p], [y[i] for i in p])
    return out


def brute_pearson(x, y):
    ok = np.isfinite(x) & np.isfinite(y)
    if ok.sum() < 2 or np.std(x[ok]) == 0 or np.std(y[ok]) == 0:
        return None
    return float(np.corrcoef(x[ok], y[ok])[0, 1])


def score_case(windows):
    """A recording of two segments with a gap, holes of one and of six values, events and two methods."""
    rng = np.random.default_rng(8)
    t = np.concatenate([np.arange(60) / 10, 9 + np.arange(50) / 10])
    y = rng.random(110)
    y[20] = np.nan
    y[70:76] = np.nan
    events = [0.33, 1.0, 2.71, 2.75, 9.5, 11.1, 12.0]
    return t, {"right": y, "plain": rng.random(110)}, events, windows


def frames_of(spark, t, values, events, windows):
    preds = [(0, 0, i, float(a), m, float(b)) for m, v in values.items() for i, (a, b) in enumerate(zip(t, v))]
    return (
        spark.createDataFrame(preds, "dataset long, trial long, i int, t double, method string, prob double"),
        spark.createDataFrame([(0, 0, s) for s in events], "dataset long, trial long, s double"),
        spark.createDataFrame([(0, 0, k, a, z) for k, (a, z) in enumerate(windows)], "dataset long, trial long, k int, start_s double, end_s double"),
        spark.createDataFrame([(0, 0, 10.0)], "dataset long, trial long, fs double"),
    )


@pytest.mark.parametrize(
    "windows",
    [
        [(0.0, 5.9), (9.0, 13.0)],  # as many as segments: by place
        [(9.0, 13.0), (0.0, 5.9)],  # by place although they lie elsewhere
        [(0.5, 3.0), (3.0, 10.0), (9.5, 12.5)],  # by overlap
        [(0.0, 13.9)],
        [(20.0, 30.0), (None, 5.0), (4.0, 4.0), (1.0, 5.0)],  # outside, not set, empty
    ],
)
def test_scores_of_windows(spark, windows):
    t, values, events, windows = score_case(windows)
    preds, spikes_, wins, rates = frames_of(spark, t, values, events, windows)
    pairs = score.window_pairs(preds, spikes_, wins, rates, 10.0, 150.0, ("right",)).cache()
    got = {(r["method"], r["k"]): r["correlation"] for r in score.corr_per_trial(pairs, wins, preds).collect()}
    pooled = {r["method"]: r["correlation"] for r in score.corr_pooled(pairs).collect()}
    segments = brute_pieces(t, 10.0)
    for m, y in values.items():
        xs, ys = [], []
        for k, (a, z) in enumerate(windows):
            want = None
            if a is not None and z > a:
                grid, rate = brute_rate(events, a, z, 10.0, 1.5)
                overlaps = [min(t[p[-1]], z) - max(t[p[0]], a) for p in segments]
                seg = k if len(segments) == len(windows) else int(np.argmax(overlaps)) if max(overlaps) > 0 else None
                aligned = np.full(len(grid), np.nan)
                if seg is not None:
                    keep = [i for i in segments[seg] if np.isfinite(y[i])]
                    v = y[keep]
                    v = np.append(v[1:], 0.0) if m == "right" else v
                    aligned = brute_align(t[keep], brute_smooth(v, 1.5), grid, 10.0)
                want = brute_pearson(rate, aligned)
                xs.append(rate)
                ys.append(aligned)
            assert got[m, k] == (None if want is None else pytest.approx(want, abs=1e-9)), (m, k)
        want = brute_pearson(np.concatenate(xs), np.concatenate(ys))
        assert pooled[m] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_scores_on_a_global_grid(spark):
    windows = [(0.5, 3.0), (9.5, 12.5), (None, 1.0)]
    t, values, events, _ = score_case(windows)
    preds, spikes_, wins, rates = frames_of(spark, t, values, events, windows)
    grid, rate = brute_rate(events, 0.0, 13.9, 10.0, 1.5)
    ref = spark.createDataFrame([(0, 0, float(q), float(v)) for q, v in zip(grid, rate)], "dataset long, trial long, q double, rate double")
    pairs = score.global_pairs(preds, ref, rates, 150.0).cache()
    whole = {r["method"]: r["correlation"] for r in score.corr_global(pairs).collect()}
    cut = {r["method"]: r["correlation"] for r in score.corr_global(pairs, wins).collect()}
    each = {(r["method"], r["k"]): r["correlation"] for r in score.corr_global_per_window(pairs, wins).collect()}
    for m, y in values.items():
        aligned = brute_align(t, brute_smooth(y, 1.5), grid, 10.0)
        masks = [(grid >= a) & (grid <= z) if a is not None else np.zeros(len(grid), bool) for a, z in windows]
        assert whole[m] == pytest.approx(brute_pearson(rate, aligned), abs=1e-9)
        assert cut[m] == pytest.approx(brute_pearson(rate, np.where(masks[0] | masks[1], aligned, np.nan)), abs=1e-9)
        for k, mask in enumerate(masks):
            want = brute_pearson(rate, np.where(mask, aligned, np.nan))
            assert each[m, k] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_events_per_bin(spark):
    rates = [None, 120.0, 30.0, 30.09, 30.2, 29.2, 10.0, 9.8, 60.0, 240.0]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(rates)], "i int, r double").select("i", text.events_per_bin(F.col("r"), 120.0).alias("n"))
    assert column(rows, "n") == [2, 2, 4, 4, 5, 6, 7, 14, 3, 3]
    with pytest.raises(Exception, match="above 0"):
        spark.createDataFrame([(0.0,)], "r double").select(text.events_per_bin(F.col("r"), 120.0)).collect()


def test_last_bin_holds_its_end(spark):
    bounds = spark.createDataFrame([(0, 0, 0.0, 3.0), (0, 1, 0.0, 2.5), (0, 2, 1.0, 1.0)], "dataset long, trial long, first_t double, last_t double")
    events = spark.createDataFrame([(0, 0, 0.0), (0, 0, 3.0), (0, 1, 2.5), (0, 2, 1.0)], "dataset long, trial long, s double")
    got = {(r["trial"], r["k"]): r["n"] for r in stats.fixed_bins(events, bounds, 1.0).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (0, 2): 1, (1, 0): 0, (1, 1): 0, (1, 2): 1}
    per = {r["trial"]: (r["n"], r["peak"]) for r in stats.epoch_rate_stats(bounds, events, 1.0).collect()}
    assert per == {0: (2, 1.0), 1: (1, 1.0), 2: (1, 0.0)}
    latent = {r["trial"]: (r["p99"], r["duty"]) for r in stats.latent_rate_metrics(bounds, events, 1.0, 0.0, 0.1).collect()}
    assert latent[2] == (0.0, 0.0) and latent[1] == (pytest.approx(0.98), pytest.approx(1 / 3))


def test_slow_and_constant_series(spark):
    slow = np.cos(np.arange(200) / 200 * np.pi)
    x = slow - slow.mean()
    auto = [float(x[: len(x) - k] @ x[k:] / (x @ x)) for k in range(200)]
    first = next(k for k, a in enumerate(auto) if a <= np.exp(-1))
    rows = samples(spark, range(200), slow).unionByName(samples(spark, range(5), [2.0] * 5, 1)).unionByName(samples(spark, [0], [1.0], 2))
    got = {r["trial"]: r["tau"] for r in stats.autocorr_time(rows, 0.5).collect()}
    assert first > 20 and got == {0: first * 0.5, 1: None, 2: None}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), [1e9], np.repeat(0.25, 100)])
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0), ("b", None)], "g string, v double")
    got = {r["g"]: r["q"] for r in stats.quantiles(rows, ["g"], "v", [0.0, 0.05, 0.5, 0.999, 1.0], 16).collect()}
    assert got["a"] == pytest.approx(list(np.quantile(values, [0.0, 0.05, 0.5, 0.999, 1.0]))) and got["b"] == [3.0] * 5


def test_tag_that_begins_with_the_marker(spark):
    rows = spark.createDataFrame([("_s1_ms2_x",), ("rec_s1_ms2",)], "tag string").select(text.tag_epoch(F.col("tag")).alias("e"))
    assert {r["e"] for r in rows.collect()} == {"_s1_ms2_x", "rec"}


def test_model_of_a_tag(spark):
    models = spark.createDataFrame([("m1", True, "t", []), ("t", True, None, []), ("m2", True, "u", ["w"]), ("m3", True, "v", ["w"])], "model string, has_checkpoint boolean, run_tag string, synthetic array<string>")
    assert [r["model"] for r in match.model_by_tag(models, "t", True).collect()] == ["t"]
    assert [r["model"] for r in match.model_by_tag(models, "u", True).collect()] == ["m2"]
    for tag in ("w", "none"):
        with pytest.raises(ValueError):
            match.model_by_tag(models, tag, True)


def test_strict_windows_and_trials(spark):
    rows = samples(spark, [0, 1, 2, 3])
    window = lambda a, z: spark.createDataFrame([(0, 0, a, z)], "dataset long, trial long, start_s double, end_s double")
    assert reshape.trim_to_window(rows, window(1.0, 2.0), strict=True).count() == 2
    for a, z in ((2.0, 1.0), (None, 1.0), (7.0, 9.0)):
        assert reshape.trim_to_window(rows, window(a, z)).count() == 0
        with pytest.raises(Exception, match="window"):
            reshape.trim_to_window(rows, window(a, z), strict=True).collect()
    for strict in (reshape.resolve_windows, reshape.clip_windows):
        with pytest.raises(Exception, match="window"):
            strict(rows, window(3.0, 1.0), strict=True).collect()
    with pytest.raises(Exception, match="no trial"):
        reshape.select_trials(rows, spark.createDataFrame([(0, 5)], "dataset long, trial long"), strict=True).collect()
    with pytest.raises(Exception, match="empty"):
        reshape.display_snippet(rows, spikes(spark, [1]), explicit=(8.0, 9.0), strict=True).collect()
    assert reshape.display_snippet(rows, spikes(spark, [1]), 1.0, "start").select("start_s", "end_s").first() == (0.0, 1.0)


def test_components_must_agree_in_time(spark):
    row = lambda c, t: spark.createDataFrame([(0, t, 1.0)], f"k int, t double, {c} double")
    assert match.align_components(row("a", 1.0), row("b", 1.0), ["k"], "t").count() == 1
    with pytest.raises(Exception, match="differ in time"):
        match.align_components(row("a", 1.0), row("b", 2.0), ["k"], "t").collect()


def brute_events(v, sigma):
    """Events by trying every place with the smoothed sum computed anew."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    smooth = lambda e: np.convolve(np.pad(e, r), w / w.sum(), mode="valid")
    e = np.zeros(len(v))
    if v.sum() >= 0.5:
        e[int(v.argmax())] = 1
    while True:
        errors = [((v - smooth(e + np.eye(len(v))[k])) ** 2).sum() for k in range(len(v))]
        if ((v - smooth(e)) ** 2).sum() - min(errors) < 1e-8:
            return e
        e[int(np.argmin(errors))] += 1


@pytest.mark.parametrize("seed", range(6))
def test_events_that_fit_a_rate(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    v = np.convolve(rng.poisson(0.2, n) * rng.random(n), [0.2, 0.5, 0.3], mode="same") * (0.1 if seed == 5 else 1.5)
    assert np.bincount(series.fit_events(v, series.gaussian_kernel(1.2)), minlength=n).tolist() == brute_events(v, 1.2).tolist()


def test_segments_take_the_times_of_their_trials(spark):
    preds = spark.createDataFrame([(d, i, float(i + 10 * (i > 1)), float(i)) for d in (0, 1) for i in range(5)], "dataset long, i int, t double, y double")
    raw = spark.createDataFrame([(0, 0, [0.0, 4.0, 8.0]), (0, 1, [20.0, 21.0]), (1, 0, [0.0, 1.0])], "dataset long, trial long, t array<double>")
    got = series.remap_segments(preds, spark.createDataFrame([(0, 1.0), (1, 1.0)], "dataset long, fs double"), raw).orderBy("dataset", "i").collect()
    assert [(r["trial"], r["t"]) for r in got] == [(0, 0.0), (0, 8.0), (1, 20.0), (1, 20.5), (1, 21.0), *[(None, float(i + 10 * (i > 1))) for i in range(5)]]


def test_trace_hash_is_that_of_the_bytes(spark):
    import hashlib

    t, y = [0.5, 0.1, 0.9], [1.0, 2.5, -3.0]
    rows = spark.createDataFrame([(7, 1, i, t[i], y[i]) for i in (2, 0, 1)], "dataset long, trial long, i int, t double, y double")
    want = hashlib.sha256(np.array(t).tobytes() + np.array(y, dtype=np.float32).tobytes()).hexdigest()
    assert [tuple(r) for r in io.trace_hashes(rows).collect()] == [(7, 1, want)]


def test_posterior_is_cut_to_its_log_probabilities(spark, tmp_path):
    for trial, logs in ((1, "-1.5\n-2.5\n"), (2, "-1.0\n-2.0\n-3.0\n-4.0\n")):
        rows = "".join(f"{s},{s % 2},0.1,{b},0.2,0.3\n" for s in range(3) for b in range(2))
        (tmp_path / f"traj_samples_x_epoch1_trial{trial}.dat").write_text("index,burst,B,S,C,Y\n" + rows)
        (tmp_path / f"logp_x_epoch1_trial{trial}.dat").write_text(logs)
    got = io.read_posterior(spark, str(tmp_path), logp=True).orderBy("trial", "sample", "bin").collect()
    assert [(r["trial"], r["sample"], r["bin"], r["s"], r["logp"]) for r in got] == [(1, s, b, b, -1.5 - s) for s in range(2) for b in range(2)] + [(2, s, b, b, -1.0 - s) for s in range(3) for b in range(2)]
    (tmp_path / "logp_x_epoch1_trial1.dat").unlink()
    with pytest.raises(Exception, match="no log-probabilities"):
        io.read_posterior(spark, str(tmp_path), logp=True).collect()


def test_equal_headers(spark):
    row = lambda *names: spark.createDataFrame([("f", 0, n, 1.0) for n in names], "file string, sample long, name string, value double")
    assert io.equal_headers(row("a", "b"), row("b", "a")) and not io.equal_headers(row("a", "b"), row("a"))


def test_prediction_shapes_must_agree(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0], [1.0])], "dataset long, t array<double>, p array<double>")
    with pytest.raises(Exception, match="differ in shape"):
        io.read_predictions(rows, ["dataset"], "t", "p").collect()
    with pytest.raises(ValueError):
        io.read_predictions(rows.withColumn("t", F.array("t")), ["dataset"], "t", "p")


def test_missing_columns_and_summaries_are_errors(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "dataset long, trial long").write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="missing columns: t, y"):
        io.read_traces(spark, str(tmp_path / "x"))
    leaf = tmp_path / "tree" / "r" / "d" / "raw"
    leaf.mkdir(parents=True)
    (leaf / "comparison.json").write_text("{}")
    assert io.read_run_tree(spark, str(tmp_path / "tree")).count() == 0
    with pytest.raises(Exception, match="no summary in/r/d/raw"):
        io.read_run_tree(spark, str(tmp_path / "tree"), on_missing="raise").collect()


def test_method_entries_need_the_key_of_their_config(spark):
    schema = "g int, method string, place int, config map<string,string>, cache_key string"
    new = spark.createDataFrame([(1, "m", 0, {"a": "1"}, "wrong")], schema)
    with pytest.raises(Exception, match="not that of the config"):
        report.upsert_method_entries(new.limit(0), new, ["g"])[0].collect()


def test_baselines_of_one_name(spark):
    rows = spark.createDataFrame([(k, "baseline_x", k / 100) for k in range(40, 2, -1)], "id int, name string, score double").repartition(8)
    assert report.leaderboard(rows, "name", "score", key="id").first()["id"] == 3


def test_means_that_differ_by_rounding_share_a_rank(spark):
    rows = spark.createDataFrame([("b", 0.1 + 0.2), ("a", 0.3), ("c", None), ("d", 0.3 + 1e-9)], "method string, score double")
    assert column(report.rank(rows, "score", ["method"], digits=12), "method", "place") == ["d", "a", "b", "c"]


def test_rates_leave_python_in_bounded_frames(spark):
    wins = spark.createDataFrame([(0, 0, 0.0, 20000.0), (0, 1, 0.0, 4.0)], "dataset long, trial long, start_s double, end_s double")
    found = score.reference(wins, spikes(spark, [1.0, 19999.0]), 10.0, 0.0)
    assert found.count() == 200_001 + 41 and found.where("rate > 0").count() == 2 + 0
    sizes = [len(f) for f in score.framed([("a", {"k": 1, "q": np.zeros(n), "rate": np.zeros(n)}) for n in (30_000, 30_000, 10)], ["g"], ["k", "i", "q", "rate"], "i", "q")]
    assert sizes == [60_000, 10]
