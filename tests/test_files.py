"""Numbered lines at any split size, and the documents of runs."""

import json
import random

import pytest

from sparktrace.sources import io
from sparktrace.sources.lines import numbered_lines


@pytest.fixture(params=[1024, 100, 1 << 30])
def splits(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, request.param)
    yield request.param
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def test_lines_keep_their_numbers(spark, tmp_path, splits):
    draw = random.Random(1)
    texts = {"a.txt": "".join(f"line {i} {'x' * draw.randrange(90)}\n" + "\n" * draw.randrange(2) for i in range(300)), "b.txt": "only", "c.txt": "\r\n1\r\n \r\n2\r\n", "d.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    found = {(r["path"].rsplit("/", 1)[1], r["number"], r["value"].strip()) for r in numbered_lines(spark, str(tmp_path)).collect()}
    assert found == {(name, k, x.strip()) for name, text in texts.items() for k, x in enumerate(x for x in text.splitlines() if x.strip())}


def test_large_posterior_files(spark, tmp_path, splits):
    sizes = {("x_epoch1", 1): (40, 7, 39), ("x_epoch1", 2): (3, 50, 9), ("y", 1): (1, 200, 1)}
    want = set()
    for (tag, trial), (samples, bins, logs) in sizes.items():
        rows = [f"{s},{(s + b) % 2},{s}.25,{b},0.5,{s * b}" for s in range(samples) for b in range(bins)]
        (tmp_path / f"traj_samples_{tag}_trial{trial}.dat").write_text("index,burst,B,S,C,Y\n" + "\n".join(rows) + "\n")
        (tmp_path / f"logp_{tag}_trial{trial}.dat").write_text("".join(f"{-s - 0.5}\n" for s in range(logs)))
        want |= {(tag, trial, s, b, (s + b) % 2, s + 0.25, b, 0.5, float(s * b), -s - 0.5) for s in range(min(samples, logs)) for b in range(bins)}
    found = io.read_posterior(spark, str(tmp_path), logp=True).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    plain = io.read_posterior(spark, str(tmp_path)).where("tag = 'x_epoch1' and trial = 1")
    assert plain.count() == 280 and plain.columns[-1] == "y"


def test_posterior_files_are_read_once(spark, tmp_path):
    want = set()
    for tag in range(40):
        (tmp_path / f"traj_samples_{tag}_trial1.dat").write_text("\ufeffindex,burst,B,S,C,Y\r\n" + "".join(f"{s},{b},{tag}.5, 2 ,0.25,1\r\n\r\n" for s in range(2) for b in range(3)), newline="")
        (tmp_path / f"logp_{tag}_trial1.dat").write_text("-1\n-2" if tag % 2 else "-1\n")
        want |= {(str(tag), 1, s, b, b, tag + 0.5, 2, 0.25, 1.0, -1.0 - s) for s in range(1 + tag % 2) for b in range(3)}
    rows = io.read_posterior(spark, str(tmp_path), logp=True)
    for file in tmp_path.iterdir():
        file.unlink()
    found = rows.collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("most", [100_000, 1])
def test_lines_of_the_posterior_are_never_broadcast(spark, tmp_path, monkeypatch, most):
    for tag in range(3):
        (tmp_path / f"traj_samples_{tag}_trial1.dat").write_text("index,burst,B,S,C,Y\n" + "0,1,2,3,4,5\n1,1,2,3,4,6\n" * 1)
        (tmp_path / f"logp_{tag}_trial1.dat").write_text("-1\n-2\n")
    monkeypatch.setattr(io, "BROADCAST_RANGES", most, raising=False)
    rows = io.read_posterior(spark, str(tmp_path), logp=True)
    assert sorted((r["tag"], r["sample"], r["y"], r["logp"]) for r in rows.collect()) == [(str(t), s, 5.0 + s, -1.0 - s) for t in range(3) for s in range(2)]
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BuildLeft" not in plan and "SortMergeJoin" not in plan and ("ShuffledHashJoin" in plan) == (most == 1)


def test_large_parameter_files(spark, tmp_path, splits):
    want = set()
    for name, columns in (("p.csv", ["a", "b"]), ("q.csv", ["b"])):
        rows = [[i + k / 4 for k in range(len(columns))] for i in range(150)]
        (tmp_path / name).write_text(" , ".join(columns) + "\n" + "\n".join(",".join(map(str, r)) for r in rows))
        want |= {(name, i, c, v) for i, r in enumerate(rows) for c, v in zip(columns, r)}
    found = io.read_params(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def documents(spark, scores, methods, **more):
    by = "run string, dataset string, smoothing string"
    counts = spark.createDataFrame([("r", d, "10Hz", None, 50.0, n) for d, n in (("d", 7), ("empty", None))], f"{by}, downsample_target string, corr_sigma_ms double, gt_count long")
    scores = spark.createDataFrame([("r", "d", "10Hz", m, c) for m, c in scores], f"{by}, method string, correlation double")
    methods = spark.createDataFrame([("r", "d", "10Hz", *m) for m in methods], f"{by}, label string, method string, cache_tag string, cache_key string, config map<string,string>, sampling_rate double, samples long, details map<string,string>")
    trialwise = spark.createDataFrame([("r", "d", "10Hz", "m", k, c) for k, c in more.get("trials", [])], f"{by}, method string, trial long, correlation double")
    windows = spark.createDataFrame([("r", "d", "10Hz", k, 0.5 * k, 1.0 * k) for k, _ in more.get("trials", [])], f"{by}, trial long, start_s double, end_s double")
    return io.run_documents(scores, methods, counts, trialwise, windows)


def test_documents_of_a_run(spark, tmp_path):
    path = "file://" + str(tmp_path / "runs")
    entry = lambda label: (label, "m", "t", "k", {'q"uote': "v\n"}, 30.0, 4, {"best": 'x"y', "none": None})
    first = documents(spark, [("m", 0.25), ("gone", 1.0)], [entry("m"), entry("a}0b")], trials=[(2, 0.5), (1, float("nan")), (11, None)])
    io.write_run_documents(first, path)
    leaf = tmp_path / "runs" / "r" / "d" / "10Hz"
    summary = json.loads((leaf / "summary.json").read_text())
    assert summary["methods_run"] == ["a}0b", "m"] and summary["correlations"] == {"gone": 1.0, "m": 0.25} and summary["gt_count"] == 7
    assert summary["trialwise_correlations"] == {"m": [None, 0.5, None]} and summary["trial_windows_s"] == [[0.5, 1.0], [1.0, 2.0], [5.5, 11.0]]
    assert summary["m_cache"] == {'q"uote': "v\n"} and summary["m_samples"] == 4 and summary["m_best"] == 'x"y' and summary["m_none"] is None and summary["a}0b_best"] == 'x"y'
    assert summary["downsample_target"] == "10Hz" and summary["resample_tag"] == "r" and summary["corr_sigma_ms"] == 50.0
    comparison = json.loads((leaf / "comparison.json").read_text())
    assert [m["label"] for m in comparison["methods"]] == ["a}0b", "m"] and comparison["artifacts"] == {"summary": "r/d/10Hz/summary.json"}
    assert json.loads((tmp_path / "runs" / "r" / "empty" / "10Hz" / "summary.json").read_text())["correlations"] == {}
    docs = io.read_run_documents(spark, path)
    assert {(r["label"], r["config"]['q"uote'], r["place"]) for r in io.method_rows(docs).collect()} == {("a}0b", "v\n", 0), ("m", "v\n", 1)}
    assert sorted((r["place"], r["correlation"], r["start_s"]) for r in io.trialwise_rows(docs).collect()) == [(0, None, 0.5), (1, 0.5, 1.0), (2, None, 5.5)]
    io.write_run_documents(documents(spark, [("m", None)], []), path)
    again = json.loads((leaf / "summary.json").read_text())
    assert again["correlations"] == {"m": None} and again["methods_run"] == [] and "m_cache" not in again
    assert sorted(p.name for p in leaf.iterdir()) == ["comparison.json", "summary.json"]
    assert {(r["method"], r["correlation"]) for r in io.read_run_tree(spark, path).collect()} == {("m", None)}
