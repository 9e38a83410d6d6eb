"""Noise calibration and replicas on odd trials, against loops over the definition."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from sparktrace.operators import train
from sparktrace.plans import catalogue

FS, TARGET = 30.0, 8.0


def normal(seed, *keys):
    u = [(int(hashlib.md5(":".join(map(str, (k, *keys))).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) for k in (seed, seed + 1)]
    return math.sqrt(-2 * math.log(u[0])) * math.cos(2 * math.pi * u[1])


def noise(dataset, trial, y, level):
    noisy = [None if v is None else v + level / 100 * FS**0.5 * normal(1, dataset, trial, i, level) for i, v in enumerate(y)]
    steps = [None if a is None or b is None else abs(b - a) for a, b in zip(noisy, noisy[1:])]
    steps = sorted(steps, key=lambda v: (v is None, v is not None and math.isnan(v), v if v is not None and not math.isnan(v) else 0))
    if not steps:
        return None
    at = (len(steps) - 1) / 2
    low, high = steps[math.floor(at)], steps[math.ceil(at)]
    return None if low is None or high is None else (low + (high - low) * (at - math.floor(at))) * 100 / FS**0.5


def above(x):
    return x is not None and (math.isnan(x) or x > TARGET)


TRIALS = {
    (0, 1): [0.01 * math.sin(k) for k in range(40)],
    (0, 2): [0.2 * math.sin(9 * k) for k in range(40)],
    (0, 3): [5.0 * math.sin(9 * k) for k in range(40)],
    (0, 4): [0.1 * math.cos(5 * k) if k % 5 else None for k in range(31)],
    (0, 5): [None] * 30 + [0.1, 0.2],
    (1, 6): [float("nan")] * 30 + [0.1, 0.2],
    (1, 7): [0.1 * math.cos(5 * k) if k % 7 else float("nan") for k in range(31)],
    (1, 8): [0.5],
    (1, 9): [0.0, 0.01, 0.0],
}


@pytest.fixture
def frames(spark):
    rows = [(d, t, i, i / FS, v) for (d, t), y in TRIALS.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "dataset long, trial long, i int, t double, y double")


def test_calibration_of_odd_trials(frames):
    found = {(r["dataset"], r["trial"]): r for r in train.calibrate_noise(frames, FS, TARGET).collect()}
    assert set(found) == set(TRIALS)
    for (d, t), y in TRIALS.items():
        x = [noise(d, t, y, level) for level in range(20)]
        r = found[d, t]
        if x[0] is None:
            assert r["base"] is None and r["added"] is None
            continue
        assert r["base"] == pytest.approx(x[0], nan_ok=True)
        at = next((k for k in range(19) if x[k] is not None and x[k] <= TARGET and above(x[k + 1])), None)
        if above(x[0]) or at is None:
            assert r["added"] is None and (not above(x[0]) or r["replicas"] == 0)
        else:
            assert r["added"] == pytest.approx((at + (TARGET - x[at]) / (x[at + 1] - x[at])) / 100 * FS**0.5, nan_ok=True)


def test_no_arrays_are_dealt_by_dataset(frames):
    plan = train.calibrate_noise(frames, FS, TARGET)._jdf.queryExecution().executedPlan().toString()
    window = plan.split("Exchange hashpartitioning(dataset")[1]
    assert window.index("MapInArrow") >= 0 and "collect_list" not in window.split("MapInArrow")[0]


def test_replicas_of_few_trials_leave_the_others_out(frames, spark):
    spikes = frames.where("i = 3").select("dataset", "trial", F.col("t").alias("s"))
    calibration = spark.createDataFrame([(0, 1, 2, 0.1), (0, 2, 0, 0.1), (1, 9, 3, None)], "dataset long, trial long, replicas long, added double")
    out = train.noisy_replicas(frames, spikes, calibration, FS, FS)
    shot = sorted(math.sqrt(abs(v + 1)) for v in TRIALS[0, 1])
    shot = (shot[19] + shot[20]) / 2
    found = {(r["trial"], r["i"], r["replica"]): (r["y"], r["events"]) for r in out.collect()}
    assert set(found) == {(1, i, k) for i in range(40) for k in (1, 2)}
    for (t, i, k), (y, events) in found.items():
        v = TRIALS[0, t][i]
        assert y == pytest.approx(v + 0.1 * math.sqrt(abs(v + 1)) / shot * normal(2, 0, t, i, k)) and events == (i == 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2


def test_replicas_without_limits(spark):
    trials = {1: [0.0, 0.01] * 20, 2: [0.0, 0.2] * 20, 3: [1.0] * 40, 4: [0.0, 9.0] * 20, 5: [0.5]}
    rows = spark.createDataFrame([(0, t, i, i / FS, v) for t, y in trials.items() for i, v in enumerate(y)], "dataset long, trial long, i int, t double, y double")
    found = lambda **limits: {r["trial"]: r["replicas"] for r in train.calibrate_noise(rows, FS, TARGET, **limits).collect()}
    wanted = {t: math.ceil(1.2 * (TARGET / (d * 100 / FS**0.5)) ** 2) for t, d in ((1, 0.01), (2, 0.2))}
    assert found(most=None, rows=None) == {**wanted, 3: None, 4: 0, 5: None} and wanted[1] > 500
    assert {t: found(most=500, rows=None)[t] for t in (1, 2, 3, 4)} == {1: 500, 2: wanted[2], 3: 500, 4: 0}
    assert {t: found(most=500, rows=4000)[t] for t in (1, 2, 3, 4)} == {1: 20, 2: wanted[2], 3: 20, 4: 0}


def test_query_gives_all_replicas(spark, tmp_path):
    vectors = [[0.0, 0.0164] * 200, [0.3] * 64, [0.1 * math.sin(9 * k) for k in range(64)]]
    spark.createDataFrame([(k, v, 3) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = duck.execute(catalogue.SQL["k2_noisy_replicas"])
    columns = [c[0] for c in cursor.description]
    mine = catalogue.QUERIES["k2_noisy_replicas"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, mine)) == sorted(cursor.fetchall())
    # 857 replicas of 400 samples: more than 500, and than 300,000 samples.
    number = math.ceil(1.2 * (8 / (0.0164 * 100 / 30**0.5)) ** 2)
    assert number * 400 > 3e5 and [(r["trial"], r["n"]) for r in mine].count((0, 400)) == number
    assert {r["trial"] for r in mine} == {0, 2}
