"""Hand cases of validation, counts of what is left out, strict modes, tags and other small parts."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sparktrace.functions import text
from sparktrace.operators import match, report, reshape, series, stats
from sparktrace.sources import validate

ROWS = "dataset long, trial long, i int, t double, y double"


def test_findings_on_files(spark, tmp_path):
    good = spark.createDataFrame([("d", 1, [0.0, 1.0], [1.0, 2.0], [0.5])], "dataset string, trial long, t array<double>, y array<float>, ap_times array<double>")
    good.coalesce(1).write.parquet(str(tmp_path / "good"))
    good.drop("ap_times", "t").withColumn("trial", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / "bad"))
    (tmp_path / "broken.parquet").write_text("no table")
    rows = {(r["file"].split("/")[-1 if "broken" in r["file"] else -2], r["level"], r["code"], r["detail"]) for r in validate.file_findings(spark, str(tmp_path)).collect()}
    assert {x[:3] for x in rows} == {("bad", "error", "missing_column"), ("bad", "warning", "missing_optional"), ("bad", "error", "wrong_type"), ("broken.parquet", "error", "unreadable")}
    assert {x[3] for x in rows if x[2] in ("missing_column", "missing_optional")} == {"t", "ap_times"} and {x[3] for x in rows if x[2] == "wrong_type"} == {"trial: string"}


def test_findings_on_trials(spark):
    nan = float("nan")
    rows = [("a", 1, [0.0, 1.0], [1.0]), ("a", 2, [0.0, 0.0, 2.0, 1.0], [1.0] * 4), ("a", 3, [nan, 4.0], [1.0, 2.0]), ("a", 4, [0.0, 1.0], [nan, None]), ("b", 1, None, None), ("b", 2, [nan], [1.0]), ("c", 1, [0.0, 1.0, 2.0], [1.0, 2.0, 3.0])]
    wide = spark.createDataFrame(rows, "dataset string, trial long, t array<double>, y array<double>")
    spikes = spark.createDataFrame([("a", 0.5), ("c", nan)], "dataset string, s double")
    found = validate.trial_findings(wide, spikes)
    assert {tuple(r) for r in found.collect()} == {
        ("a", 1, "warning", "shape", "2 times, 1 values"), ("a", 2, "error", "step", "2"), ("a", 3, "note", "single_time", "4.0"), ("a", 4, "warning", "no_values", None),
        ("b", 1, "note", "no_times", None), ("b", 2, "note", "no_times", None), ("b", None, "error", "no_epochs", None), ("b", None, "note", "no_spikes", None), ("c", None, "note", "no_spikes", None)}
    out = {r["dataset"]: (r["epochs"], r["samples"], r["dt"], r["first_t"], r["last_t"], r["least"], r["most"], r["events"], r["errors"], r["warnings"]) for r in validate.inspected(wide, spikes, found).collect()}
    assert out["c"] == (1, 3, 1.0, 0.0, 2.0, 1.0, 3.0, 1, 0, 0) and out["b"][:2] == (0, 0) and out["b"][-2:] == (1, 0) and out["a"][-2:] == (1, 2)


def test_dropped_rows_are_counted(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, [None]), (4, None), (5, [float("inf")])], "k int, a array<double>")
    told = Observation()
    assert [r["k"] for r in reshape.finite_rows(rows, ["a"], told).collect()] == [1] and told.get == {"rows": 5, "dropped": 4}
    assert reshape.finite_rows(rows, ["a"]).count() == 1


def test_trials_without_a_rate(spark):
    rows = spark.createDataFrame([(0, 0, i, float(i), 0.0) for i in range(3)] + [(0, 1, i, 5.0, 0.0) for i in range(2)] + [(0, 2, 0, 1.0, 0.0)], ROWS)
    assert [r["trial"] for r in series.sampling_rate(rows).collect()] == [0]
    assert {(r["trial"], r["n"]) for r in series.without_rate(rows).collect()} == {(1, 2), (2, 1)}
    with pytest.raises(Exception, match="no positive step in 0/"):
        series.sampling_rate(rows, strict=True).collect()
    assert series.sampling_rate(rows.where("trial = 0"), strict=True).first()["fs"] == 1.0
    for fs in (0.0, -1.0):
        with pytest.raises(Exception, match="above 0"):
            series.gap_segments(rows.withColumn("fs", F.lit(fs))).collect()


def test_strict_labels(spark):
    labels = lambda *x: spark.createDataFrame([(v,) for v in x], "s string").select(text.smoothing_hz(F.col("s"), 60.0, strict=True).alias("hz"))
    assert [r["hz"] for r in labels("raw", " RAW ", "30", "30hz", "12p5Hz").collect()] == [60.0, 60.0, 30.0, 30.0, 12.5]
    for bad in ("fast", "", "0Hz", None, "-3"):
        with pytest.raises(Exception, match="invalid smoothing level"):
            labels(bad).collect()


def test_numbers_in_tags(spark):
    values = [9.0, 1.3, 0.35, 1e-5, 123456.0, 1234567.0, 0.0001234567, -2.5, 0.0, 100.0, 99999.96, 999999.6, 1e100, 0.00009999996]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", text.number_text(F.col("v")).alias("a"), text.number_text(F.col("v"), 3).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(f"{v:g}", f"{v:.3g}") for v in values] + [(None, None)]


def test_tags_of_a_sweep_round_trip(spark):
    rows = spark.createDataFrame([("my run", 9.0, 1.3, 0.35, 11000), ("r_s1", 12.5, 1e-5, 2e6, 0)], "run string, rate double, smooth double, duty double, seed long")
    tag = text.combo_tag(*[F.col(c) for c in ("run", "rate", "smooth", "duty", "seed")])
    made = rows.select("*", tag.alias("tag")).select("*", *[c.alias(f"p_{k}") for k, c in text.parse_combo(F.col("tag")).items()]).collect()
    assert [r["tag"] for r in made] == ["my_run_r9_s1p3_d0p35_sb11000", "r_s1_r12p5_s1e-05_d2e+06_sb0"]
    assert all(r[f"p_{c}"] == r[c] for r in made for c in ("rate", "smooth", "duty", "seed")) and made[1]["p_run"] == "r_s1"


def test_run_tags(spark):
    order = [("a", "a"), ("b", "b|in"), ("c", "c")]
    tag = lambda methods, a=None, b=None: spark.range(1).select(text.run_tag(F.array(*map(F.lit, methods)).cast("array<string>"), order, {"a": F.lit(a).cast("double"), "b": F.lit(b).cast("double")}, {"a": F.lit("_ms3")}).alias("t")).first()["t"]
    assert tag(["c", "a"]) == "araw_ms3_c" and tag(["a", "b"], 30.0, 7.5) == "a30p0_ms3_b7p5" and tag(["b"]) == "bin" and tag([]) == "no_methods"


def test_parameter_specs(spark):
    sets = spark.createDataFrame([(0, "/p/param_samples_x.dat"), (1, "y.dat")], "place int, name string")
    rows = match.parameter_specs([9.0], [1.3, 2.0], [0.5], sets, "r", 100, 10).orderBy("combo", "place").collect()
    assert [(r["combo_id"], r["tag"], r["noise_seed"], r["noise_fraction"]) for r in rows] == [
        ("r_r9_s1p3_d0p5_sb100", "bio_ml_x__r_r9_s1p3_d0p5_sb100", 100, 0.5), ("r_r9_s1p3_d0p5_sb100", "bio_ml_y__r_r9_s1p3_d0p5_sb100", 101, 0.5),
        ("r_r9_s2_d0p5_sb110", "bio_ml_x__r_r9_s2_d0p5_sb110", 110, 0.5), ("r_r9_s2_d0p5_sb110", "bio_ml_y__r_r9_s2_d0p5_sb110", 111, 0.5)]
    assert match.parameter_specs([9.0], [1.0], [0.5], sets, "r", noise_fraction=0.3).first()["noise_fraction"] == 0.3
    for rates, some in (([], sets), ([1.0], sets.limit(0))):
        with pytest.raises(ValueError):
            match.parameter_specs(rates, [1.0], [1.0], some, "r")


def test_counts_at_places_are_rounded_up(spark):
    rows = spark.createDataFrame([(0, 0, i, c) for i, c in enumerate((0.0, 1.0, 2.4, -3.0, float("nan")))], "dataset long, trial long, i int, c double")
    assert sorted(r["s"] for r in reshape.expand_places(rows, 2.0).collect()) == [1.0, 1.5, 1.5, 1.5]


def test_snippets_inside_methods(spark):
    rows = spark.createDataFrame([(0, 0, i, float(i), 0.0) for i in range(101)], ROWS)
    spikes = spark.createDataFrame([(0, 0, s) for s in (1.0, 2.0, 3.0, 60.0)], "dataset long, trial long, s double")
    seg = lambda *pairs: spark.createDataFrame([(0, 0, a, z) for a, z in pairs], "dataset long, trial long, seg_start double, seg_end double")
    one = lambda **how: tuple(reshape.display_snippet(rows, spikes, **how).select("start_s", "end_s").first() or ())
    assert one(duration=10.0, segments=seg((50.0, 90.0), (40.0, 80.0))) == (55.0, 65.0)  # the median of the events inside, not of all
    assert one(duration=10.0, segments=seg((0.0, 20.0), (70.0, 90.0))) == (0.0, 10.0)  # segments that do not meet count for nothing
    assert one(duration=500.0, segments=seg((50.0, 90.0))) == (50.0, 90.0) and one(duration=10.0, start=97.0) == (90.0, 100.0) and one(duration=10.0, start=-5.0) == (0.0, 10.0)
    assert one(explicit=(95.0, 300.0)) == (95.0, 100.0) and one(explicit=(300.0, 400.0)) == ()
    for wrong in ({"explicit": (5.0, 5.0)}, {"duration": 0.0}, {}):
        with pytest.raises(ValueError):
            one(**wrong)


def test_differences_of_shapes(spark):
    side = lambda *v: spark.createDataFrame([(g, i, x) for g, xs in zip("abcd", v) for i, x in enumerate(xs)], "g string, i int, v double")
    nan = float("nan")
    out = {r["g"]: r["d"] for r in stats.max_abs_diff_of(side([1.0, 2.0], [1.0], [nan], [1.0, nan, 5.0]), side([1.5, 0.0], [1.0, 2.0], [1.0], [4.0, 9.0, float("inf")]), ["g"], "i").collect()}
    assert out == {"a": 2.0, "b": None, "c": None, "d": 3.0}


def test_default_baseline_and_seed(spark):
    times = lambda *names: spark.createDataFrame([(n, 1.0 + k) for k, n in enumerate(names)], "backend string, seconds double")
    speed = lambda rows, *how: {r["backend"]: r["speed_up"] for r in report.timing_summary(rows, *how).collect()}
    assert speed(times("gpu", "cpu")) == {"gpu": 2.0, "cpu": 1.0} and speed(times("b", "a"))["b"] == 2.0 and speed(times("b", "a"), "b")["a"] == 0.5
    with pytest.raises(Exception, match="no backend x"):
        speed(times("a"), "x")
    items = spark.range(20).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    kept = lambda **how: sorted(r["k"] for r in report.seeded_subset(items, ["g"], "k", **how).collect())
    assert kept(fraction=0.3, name="x") == kept(fraction=0.3, seed=report.default_seed("x", 0.3)) != kept(fraction=0.3, name="y") and len(kept(fraction=1.0)) == 20 and len(kept(fraction=0.01, name="x")) == 1


def test_skipped_families_and_second_models(spark):
    rows = spark.createDataFrame([("m", 1)], "method string, v int")
    assert [r["kind"] for r in report.union_families(None, rows).collect()] == ["single"] and [r["kind"] for r in report.union_families(rows).collect()] == ["main"]
    with pytest.raises(ValueError):
        report.union_families(None)
    assert sorted(r["method"] for r in report.union_method_outputs(rows, rows, "x").collect()) == ["m", "m::x"]
    with pytest.raises(Exception, match="there are outputs of m::x"):
        report.union_method_outputs(report.union_method_outputs(rows, rows, "x"), rows, "x").collect()


def test_a_single_time_is_repeated(spark):
    rows = spark.createDataFrame([(0, 0, 0, 7.0, 1.0), (0, 1, 0, 1.0, 1.0), (0, 1, 1, 3.0, 1.0)], ROWS)
    assert {(r["trial"], r["k"], r["t"]) for r in series.remap_timebase(rows, 3).collect()} == {(0, k, 7.0) for k in range(3)} | {(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)}


def test_numbers_with_half_way_decimals(spark):
    values = [1.000025, 1.000055, 1.000085, 1.000015, 0.1234565, 2.5, 0.5, 1234565.0, 1234575.0, 0.015625, 0.0000152587890625]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(text.number_text(F.col("v")).alias("a"), text.number_text(F.col("v"), 1).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(f"{v:g}", f"{v:.1g}") for v in values] and rows[0]["a"] == "1.00002"
