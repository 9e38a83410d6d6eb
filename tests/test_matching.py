"""Hand cases of lookups, segments, snippets, artefact files and imports."""

import os

import numpy as np
import pytest

from sparktrace.operators import artefacts, match, report, reshape, series


def test_tags_map_to_whole_parts_only(spark):
    tags = spark.createDataFrame([("rec12_s1_ms2", 0), ("rec1", None), ("rec1_s1", 2), ("recx", 0)], "tag string, trial long")
    stems = spark.createDataFrame([("rec1",), ("rec",), ("rec1_s1_more",)], "stem string")
    assert {tuple(r) for r in artefacts.remap_tags(tags, stems).collect()} == {("rec1", None, "rec1", "rec1_epoch1"), ("rec1_s1", 2, "rec1", "rec1_epoch3")}


def test_lookup_stays_in_the_folder(spark):
    kinds = "method string, folder string, key string, config map<string,string>, dataset string, cache_tag string, trace_hash string, file string"
    store = [("m", "dataB", "k", {}, "dataB", None, "h", "b.json"), ("m", "dataA", "k", {}, "other", "other", "h2", "z.json"), ("n", "dataA", "k", {}, "dataA", None, "h", "a.json"), ("m", "dataA", "k", {}, "other", None, "h", "a.json")]
    request = spark.createDataFrame([(1, "m", "dataA", "k", "h")], "id int, method string, dataset string, key string, trace_hash string")
    found = lambda rows, any_trace: [r["file"] for r in match.lookup_result(request, spark.createDataFrame(rows, kinds), any_trace).collect()]
    assert found(store, False) == [] and found(store, True) == ["z.json"]
    named = ("m", "dataA", "k", {}, "wrong", None, "h", "k.json")
    assert found([*store, named], True) == []  # the file of the key's name is the only candidate
    assert found([*store, ("m", "dataA", "k", {}, "dataA", None, "h", "k.json")], False) == ["k.json"]


def test_parents_with_most_samples_and_parameters(spark):
    files = lambda parent, **n: [("t", parent, kind, k) for kind, c in n.items() for k in range(c)]
    rows = spark.createDataFrame(files("a", traj=5, param=1) + files("b", traj=2, param=2, logp=9) + files("c", traj=90), "tag string, parent string, kind string, trial int")
    assert artefacts.complete_sets(rows).first().asDict() == {"tag": "t", "required": 6, "files": 6, "parent": "a"}


def test_overlays_fall_back_inside_a_run(spark):
    kinds = "run string, label string, tag string, trial int, epoch string"
    offered = spark.createDataFrame([("r", "x", "t9_epoch1", 1, None, "d"), ("r", "y", "t", 1, None, "b"), ("r", "z", "t", 1, "e", "a"), ("s", "l", "t", 1, None, "q")], kinds + ", display string")
    ask = lambda *row: [tuple(r)[1:] for r in match.match_overlay(spark.createDataFrame([(1, *row)], "id int, " + kinds), offered).collect()]
    assert ask("r", "x", "other", 5, None) == [("d", 0)]  # the same label under another tag
    assert ask("r", "l", "t", 1, None) == [("b", 1)] and ask("r", "l", "t", 1, "e") == [("a", 1)]
    assert ask("r", "l", "w", 0, "t9_epoch1") == [("d", 2)] and ask("r", "l", "w", 0, None) == []


def test_series_are_named_once(spark):
    specs = lambda *texts: match.parse_series(spark.createDataFrame([(s,) for s in texts], "spec string"))
    assert {tuple(r) for r in specs("ens", "a@b", "Shown = a @ c ", " ").collect()} == {("ens", "ens", None), ("a@b", "a", "b"), ("Shown", "a", "c")}
    entries = spark.createDataFrame([("a", "b")], "method string, run string")
    for bad, why in ((("a@b", "a@b"), "repeated key"), (("x=a", "y=a"), "repeated method and run"), (("a@",), "empty run"), (("k=",), "empty method")):
        with pytest.raises(Exception, match=why):
            match.resolve_series(entries, specs(*bad)).collect()


def test_means_are_those_of_a_run(spark):
    rows = [("m", "raw", "d", run, 30.0, c) for run, cs in (("A", (0.0, 0.0, 0.0)), ("B", (1.0,))) for c in cs]
    scores = spark.createDataFrame(rows, "method string, smoothing string, dataset string, run string, corr_sigma_ms double, correlation double")
    r = report.score_distribution(scores, ["method"], 30.0, "dataset").first()
    assert (r["n"], r["p50"], r["p95"]) == (2, 0.5, pytest.approx(0.95))


def test_segment_that_must_touch(spark):
    seg = spark.createDataFrame([(0, 0, 0, 0.0, 1.0), (0, 0, 1, 5.0, 9.0)], "dataset long, trial long, seg int, seg_start double, seg_end double")
    win = spark.createDataFrame([(0, 0, 0, 6.0, 7.0), (0, 0, 1, 0.5, 8.0), (0, 0, 2, None, 1.0)], "dataset long, trial long, k int, start_s double, end_s double")
    at = lambda w, **how: {r["k"]: r["seg"] for r in match.match_segment(seg, w, **how).collect()}
    assert at(win) == {0: 1, 1: 1, 2: None}
    assert at(win.where("k < 2")) == {0: 0, 1: 1} and at(win.where("k < 2"), touching=True) == {0: 1, 1: 1}
    draw = np.random.default_rng(5)
    for _ in range(30):
        edges = np.sort(draw.integers(0, 40, 12)).astype(float)
        a, z, n = edges[::2], edges[1::2], 6
        start = draw.integers(-2, 40, 9).astype(float)
        end = start + draw.integers(0, 30, 9)
        want = []
        for s, e in zip(start, end):
            o = [min(e, y) - max(s, x) for x, y in zip(a, z)]
            want.append(int(np.argmax(o)) if max(o) > 0 else None)
        assert match.segments_of_windows(a, z, np.arange(n), start, end, np.arange(9), False) == want


def test_noise_finds_its_level(spark):
    models = spark.createDataFrame([("u", 2.0), ("u", 3.0), ("u", 9.0), ("v", 4.0)], "model string, noise_level double")
    noise = spark.createDataFrame([(i, x) for i, x in enumerate((-50.0, 2.49, 2.5, 3.5, 8.5, 700.0, float("nan"), None))], "id int, noise double")
    found = {(r["id"], r["model"], r["noise_level"]) for r in match.route_by_noise(noise, models).collect()}
    assert {x for x in found if x[1] == "u"} == {(0, "u", 2.0), (1, "u", 2.0), (2, "u", 3.0), (4, "u", 9.0), (5, "u", 9.0)}
    assert {x[0] for x in found if x[1] == "v"} == set(range(6))


def test_snippets_on_the_own_axis(spark):
    rows = spark.createDataFrame([(0, 0, i, 100.0 + i, None if i == 3 else 1.0) for i in range(20)], "dataset long, trial long, i int, t double, y double")
    one = lambda **how: [tuple(r)[2:] for r in reshape.snippet_window(rows, **how).collect()]
    assert one(start=105.0, duration=5.0) == [(105.0, 110.0, False, False, 6)]
    assert one(start=50.0, end=104.0) == [(100.0, 104.0, True, False, 4)] and one() == [(100.0, 119.0, False, False, 19)]
    assert one(start=118.0, duration=9.0) == [(118.0, 119.0, False, True, 2)] and one(start=300.0) == [] and one(start=102.5, end=103.5) == []
    with pytest.raises(Exception, match="snippet"):
        one(start=300.0, strict=True)


def test_close_rates_are_relative(spark):
    rows = spark.createDataFrame([(0, 0, i, i / 0.102, float(i)) for i in range(30)] + [(0, 1, i, i / 0.1001, float(i)) for i in range(30)] + [(0, 2, i, i / 3.0, float(i)) for i in range(4)], "dataset long, trial long, i int, t double, y double")
    n = {r["trial"]: r["n"] for r in series.resample_to(rows, 0.1).groupBy("trial").agg(__import__("pyspark.sql.functions", fromlist=["count"]).count("*").alias("n"), __import__("pyspark.sql.functions", fromlist=["max"]).max("t").alias("t")).collect()}
    assert n == {0: 29, 1: 30, 2: 1}  # a trial shorter than a block keeps its first sample


def test_files_of_artefacts(spark, tmp_path):
    names = ["traj_samples_a_trial1.dat", "traj_samples_a_trial12.dat", "traj_samples_a.dat", "param_samples_a_trialx.dat", "logp_.dat", "logp_b_trial_trial3.dat", "traj_samples_c.csv", "x_traj_samples_c.dat"]
    for k, name in enumerate(names):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1000 + k // 2, 1000 + k // 2))
    files = artefacts.catalogue(artefacts.listed(spark, str(tmp_path)))
    assert {(r["name"], r["kind"], r["tag"], r["trial"]) for r in files.collect()} == {
        (names[0], "traj", "a", 1), (names[1], "traj", "a", 12), (names[2], "traj", "a", None), (names[3], "param", "a_trialx", None), (names[5], "logp", "b_trial", 3)}
    assert [r["name"] for r in artefacts.newest(files, ["kind"], "traj_*_trial*.dat").collect()] == [names[0]]
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "a", 7), (4, "a_trialx", None)], "id int, tag string, trial long")
    pick = lambda kind: {r["id"]: r["path"].rsplit("/", 1)[1] for r in artefacts.pick_trial_files(asked, files, kind).collect()}
    assert pick("traj") == {1: names[0], 2: names[0]} and pick("param") == {4: names[3]}
    (tmp_path / names[0]).unlink()
    files = artefacts.catalogue(artefacts.listed(spark, str(tmp_path)))
    assert {r["id"]: r["path"].rsplit("/", 1)[1] for r in artefacts.pick_trial_files(asked, files, "traj").collect()} == {1: names[1], 2: names[1]}


def test_counters_of_an_import_overlap(spark):
    entries = spark.createDataFrame([("f", "rec1_epoch1_s1_ms2", "a"), ("f", "rec1_s1_ms2", "b"), ("f", "rec12_s1_ms2", "c"), ("f", "rec2_s1_ms2", "d")], "folder string, tag string, key string")
    epochs = spark.createDataFrame([(e,) for e in ("rec1_epoch1", "rec1_epoch2", "rec2_epoch1")], "epoch string")
    files = spark.createDataFrame([("rec1_s1_ms2", "p", kind, t) for kind in ("traj", "param") for t in (0, 1, 2)], "tag string, parent string, kind string, trial int")
    existing = spark.createDataFrame([("f", "b_trial1"), ("g", "a")], "folder string, key string")
    targets = artefacts.import_targets(entries, epochs, files, existing)
    assert {(r["key"], r["target_key"], r["epoch"], r["target_tag"], r["outputs"], r["exists"]) for r in targets.collect()} == {
        ("a", "a", "rec1_epoch1", "rec1_epoch1_s1_ms2", 0, False), ("b", "b_trial0", "rec1_epoch1", "rec1_epoch1_s1_ms2", 2, False), ("b", "b_trial1", "rec1_epoch2", "rec1_epoch2_s1_ms2", 2, True),
        ("c", None, None, None, None, None), ("d", "d_trial0", "rec2_epoch1", "rec2_epoch1_s1_ms2", 0, False)}
    assert artefacts.import_counters(targets).first().asDict() == {"scanned": 4, "unmatched": 0, "missing_epoch": 1, "remapped": 2, "skipped_existing": 1, "imported": 3, "missing_outputs": 2}
    assert artefacts.import_counters(artefacts.import_targets(entries, epochs, files, existing, need_outputs=True, overwrite=True)).first().asDict() == {"scanned": 4, "unmatched": 3, "missing_epoch": 0, "remapped": 1, "skipped_existing": 0, "imported": 2, "missing_outputs": 0}
    assert artefacts.import_counters(artefacts.import_targets(entries, epochs.limit(0), files, existing)).first()["imported"] == 4


def test_complete_trials_of_the_chosen_parent(spark):
    files = [("t", "a", "traj", 1), ("t", "a", "param", 1), ("t", "a", "traj", 2), ("t", "a", "param", 3), ("t", "b", "traj", 1), ("t", "b", "param", 1), ("u", "c", "traj", 1), ("u", "c", "param", 2)]
    rows = artefacts.sets_with_trials(spark.createDataFrame(files, "tag string, parent string, kind string, trial int")).collect()
    assert {(r["tag"], r["parent"], r["required"], r["complete"]) for r in rows} == {("t", "a", 4, 1), ("u", "c", 2, 0)}
