"""Queries of aggregates and scores."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.operators import binning as B
from sparktrace.operators import match as M
from sparktrace.operators import reshape as R
from sparktrace.operators import score as C
from sparktrace.operators import series as S
from sparktrace.operators import stats as D
from sparktrace.plans.registry import add
from sparktrace.plans.series_plans import FS, REFLECT, SEG, kernel, noise_models  # noqa: F401
from sparktrace.sources import validate as V

TRIAL = ["dataset", "trial"]
STEP = "d AS (SELECT dataset, trial, i, t, y, y - lag(y) OVER (PARTITION BY dataset, trial ORDER BY i) AS d FROM {0})"


def corr(x: str, y: str) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL THEN {y} END) >= 2 THEN round(covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0), 6) + 0 END"


add("d1_sampling_rate", lambda t: S.sampling_rate(t.samples), "samples", f"WITH {FS} SELECT dataset, trial, round(fs, 6) AS fs FROM fs")
add("d2_block_mean_downsample", lambda t: S.block_means(t.samples, 3), "samples",
    "SELECT dataset, trial, i//3 AS block, round(avg(t), 6) AS t, round(avg(y), 6) AS y FROM (SELECT *, count(*) OVER (PARTITION BY dataset, trial) AS n FROM samples) WHERE i//3 < greatest(n//3, 1) GROUP BY ALL")
add("d3_noise_level", lambda t: D.noise_level(t.frames, S.sampling_rate(t.frames)), "frames",
    f"WITH {STEP.format('frames')}, f AS (SELECT dataset, trial, 1/median(u) AS fs FROM (SELECT dataset, trial, t - lag(t) OVER (PARTITION BY dataset, trial ORDER BY i) AS u FROM frames) WHERE u > 0 GROUP BY ALL) SELECT d.dataset, d.trial, round(median(abs(d))/sqrt(any_value(fs))*100, 6) AS noise FROM d JOIN f ON f.trial = d.trial AND f.dataset = d.dataset GROUP BY ALL")
ROBUST = """q AS (SELECT dataset, trial, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM d GROUP BY ALL), kept AS (SELECT d.dataset, d.trial, d.d FROM d JOIN q ON q.trial = d.trial AND q.dataset = d.dataset WHERE d.d BETWEEN lo AND hi),
       m AS (SELECT dataset, trial, median(d) AS m, stddev_pop(d) AS sd FROM kept GROUP BY ALL), r AS (SELECT kept.dataset, kept.trial, 1.4826e0*median(abs(d - m)) AS mad, max(sd) AS sd FROM kept JOIN m ON m.trial = kept.trial AND m.dataset = kept.dataset GROUP BY ALL)"""
add("d4_robust_diff_std", lambda t: D.robust_diff_std(t.samples, empty=None), "samples", f"WITH {STEP.format('samples')}, {ROBUST} SELECT dataset, trial, round(CASE WHEN mad > 0 THEN mad ELSE sd END, 6) AS spread FROM r")
add("d5_drift_sigma", lambda t: D.drift_sigma(t.samples.withColumn("y", F.col("y") / 1000), S.sampling_rate(t.samples), M.low_activity_mask(t.samples, t.spikes, 4.0)), "samples spikes",
    f"""WITH {FS}, low AS (SELECT x.dataset, x.trial, x.i, x.t, x.y/1000 AS y, coalesce(min(abs(x.t - s.s)) >= 4, true) AS low FROM samples x LEFT JOIN spikes s ON s.trial = x.trial AND s.dataset = x.dataset GROUP BY ALL),
       c AS (SELECT *, count_if(low) OVER (PARTITION BY dataset, trial) AS nl FROM low), base AS (SELECT * FROM c WHERE low OR nl < 2), {STEP.format('base')}, {ROBUST}
       SELECT fs.dataset, fs.trial, round(least(greatest(0.25e0*coalesce(CASE WHEN mad > 0 THEN mad ELSE sd END, 0)/sqrt(1/fs), 5e-4), 5e-2), 6) AS sigma FROM fs LEFT JOIN r ON r.trial = fs.trial AND r.dataset = fs.dataset""")

FSREF, SIGMA = 0.2, 10000.0


def windows(t):
    """Two windows in every trial, not set in some trials."""
    w = t.windows.select(*TRIAL, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("start_s") + 168 * k).alias("start_s"), (F.col("end_s") - 168 * (1 - k)).alias("end_s")) for k in (0, 1)])).alias("w"))
    return w.select(*TRIAL, "w.*")


def pairs(t):
    return C.window_pairs(t.preds, t.spikes, windows(t), S.sampling_rate(t.samples), FSREF, SIGMA, ("sampler",))


def grid_pairs(t):
    spans = R.bounds(t.samples).select(*TRIAL, F.col("first_t").alias("start_s"), F.col("last_t").alias("end_s"))
    return C.global_pairs(t.preds, C.reference(spans, t.spikes, FSREF, SIGMA), S.sampling_rate(t.samples), SIGMA)


def ref_sql(spans: str, key: str) -> str:
    """The event rates `ref(.., k, q, rate)` on the grids of `spans`, smoothed with a kernel reflected at both ends."""
    return f"""g0 AS (SELECT {key}, start_s, end_s, CAST(ceil((end_s - start_s)*{FSREF}e0) AS BIGINT) + 1 AS n FROM {spans}),
  x AS (SELECT {", ".join("g0." + c.strip() for c in key.split(","))}, g0.n, (s - start_s)*{FSREF}e0 AS x FROM spikes s JOIN g0 ON s.trial = g0.trial AND s.dataset = g0.dataset WHERE s BETWEEN start_s AND end_s),
  v AS (SELECT {key}, k, sum(v) AS v FROM (SELECT {key}, n, CAST(floor(x) AS BIGINT) AS k, 1 - (x - floor(x)) AS v FROM x UNION ALL SELECT {key}, n, CAST(floor(x) AS BIGINT) + 1, x - floor(x) FROM x) WHERE k < n GROUP BY ALL),
  raw AS (SELECT g.*, coalesce(v, 0) AS v FROM (SELECT *, unnest(range(0, n)) AS k, start_s + unnest(range(0, n))*(end_s - start_s)/greatest(n - 1, 1) AS q FROM g0) g LEFT JOIN v USING ({key}, k)),
  tap AS (SELECT unnest(range(-8, 9)) AS d), wt AS (SELECT d, exp(-0.5e0*power(d/{SIGMA / 1000 * FSREF}e0, 2)) AS w FROM tap),
  ref AS (SELECT {", ".join("a." + c.strip() for c in key.split(","))}, a.k AS place, a.q, sum(w*b.v)/sum(w) AS rate FROM (SELECT raw.*, d, w, ((k + d) % (2*n) + 2*n) % (2*n) AS r FROM raw, wt) a
          JOIN raw b ON {" AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in key.split(","))} AND b.k = CASE WHEN a.r < a.n THEN a.r ELSE 2*a.n - 1 - a.r END GROUP BY ALL)"""


WIN = """win AS (SELECT dataset, trial, w AS win, start_s + 168*w AS start_s, end_s - 168*(1 - w) AS end_s FROM windows, (VALUES (0), (1)) v(w)), okwin AS (SELECT * FROM win WHERE end_s > start_s),
  cut AS (SELECT p.*, fs, t - lag(t) OVER (PARTITION BY p.dataset, p.trial, method ORDER BY i) > 4/fs AS gap FROM preds p JOIN fs ON fs.trial = p.trial AND fs.dataset = p.dataset),
  sg AS (SELECT *, coalesce(sum(CAST(gap AS INT)) OVER (PARTITION BY dataset, trial, method ORDER BY i), 0) AS seg FROM cut)"""


def smooth_sql(rows: str, key: str) -> str:
    """`sm`: `rows(<key>, p, n, t, y, fs, piece)` smoothed over all rows of a key; null where a value within the radius is."""
    on = " AND ".join(f"b.{c.strip()} = a.{c.strip()}" for c in key.split(","))
    return f"""taps AS (SELECT *, {SIGMA / 1000}e0*fs AS sg FROM {rows}), ta AS (SELECT *, unnest(range(-CAST(floor(4*sg + 0.5e0) AS BIGINT), CAST(floor(4*sg + 0.5e0) AS BIGINT) + 1)) AS d FROM taps),
  tr AS (SELECT *, exp(-0.5e0*(d/sg)*(d/sg)) AS w, ((p + d) % (2*n) + 2*n) % (2*n) AS r FROM ta),
  sm AS (SELECT {", ".join("a." + c.strip() for c in key.split(","))}, a.p, a.t, a.piece, CASE WHEN count(b.y) = count(*) THEN sum(w*b.y)/sum(w) END AS y FROM tr a JOIN {rows} b ON {on} AND b.p = CASE WHEN r < a.n THEN r ELSE 2*a.n - 1 - r END GROUP BY ALL)"""


def align_sql(points: str, key: str) -> str:
    """`pr`: the points with `y` interpolated between two rows of `sm` in one piece."""
    on = " AND ".join(f"p.{c.strip()} = s.{c.strip()}" for c in key.split(","))
    return f"""n0 AS (SELECT p.*, s.t AS t0, s.y AS v0, s.piece AS p0 FROM {points} p ASOF LEFT JOIN sm s ON {on} AND p.q >= s.t),
  n1 AS (SELECT p.*, s.t AS t1, s.y AS v1, s.piece AS p1 FROM n0 p ASOF LEFT JOIN sm s ON {on} AND p.q <= s.t),
  pr AS (SELECT *, CASE WHEN t0 = q THEN v0 WHEN p0 = p1 THEN v0 + (v1 - v0)*(q - t0)/(t1 - t0) END AS y FROM n1)"""


PAIRS = f"""{FS}, {WIN}, {ref_sql("okwin", "dataset, trial, win")},
  sb AS (SELECT dataset, trial, method, seg, min(t) AS a, max(t) AS z, count(*) OVER (PARTITION BY dataset, trial, method) AS n_seg FROM sg GROUP BY dataset, trial, method, seg),
  pick AS (SELECT win.*, method, seg, row_number() OVER (PARTITION BY win.dataset, win.trial, win.win, method ORDER BY least(z, end_s) - greatest(a, start_s) DESC, seg) AS r
           FROM win JOIN sb ON sb.trial = win.trial AND sb.dataset = win.dataset WHERE CASE WHEN n_seg = 2 THEN seg = win.win ELSE least(z, end_s) > greatest(a, start_s) END),
  fin AS (SELECT *, count(*) OVER (PARTITION BY dataset, trial, method, seg) AS n FROM sg WHERE prob IS NOT NULL),
  sh AS (SELECT *, row_number() OVER w - 1 AS p, CASE WHEN method = 'sampler' THEN coalesce(lead(prob) OVER w, 0) ELSE prob END AS y, t - lag(t) OVER w > 4/fs AS jump FROM fin WHERE n >= 2 WINDOW w AS (PARTITION BY dataset, trial, method, seg ORDER BY i)),
  pl AS (SELECT *, coalesce(sum(CAST(jump AS INT)) OVER (PARTITION BY dataset, trial, method, seg ORDER BY i), 0) AS piece FROM sh),
  {smooth_sql("pl", "dataset, trial, method, seg")},
  pts AS (SELECT ref.*, pick.method, pick.seg FROM ref JOIN pick ON pick.dataset = ref.dataset AND pick.trial = ref.trial AND pick.win = ref.win WHERE r = 1), {align_sql("pts", "dataset, trial, method, seg")}"""
add("d6_corr_pooled_windows", lambda t: C.corr_pooled(pairs(t)), "samples spikes windows preds", f"WITH {PAIRS} SELECT dataset, method, {corr('rate', 'y')} AS correlation FROM pr GROUP BY ALL")
add("d7_corr_per_trial", lambda t: C.corr_per_trial(pairs(t), windows(t), t.preds), "samples spikes windows preds",
    f"WITH {PAIRS}, co AS (SELECT dataset, trial, win, method, {corr('rate', 'y')} AS correlation FROM pr GROUP BY ALL) SELECT a.dataset, a.trial, a.method, a.win AS k, correlation FROM (SELECT DISTINCT win.dataset, win.trial, win.win, method FROM win JOIN preds ON preds.trial = win.trial AND preds.dataset = win.dataset) a LEFT JOIN co ON co.dataset = a.dataset AND co.trial = a.trial AND co.win = a.win AND co.method = a.method")
GLOBAL = f"""{FS}, {WIN}, span AS (SELECT dataset, trial, min(t) AS start_s, max(t) AS end_s FROM samples GROUP BY ALL), {ref_sql("span", "dataset, trial")},
  al AS (SELECT *, prob AS y, seg AS piece, row_number() OVER (PARTITION BY dataset, trial, method ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY dataset, trial, method) AS n FROM sg),
  {smooth_sql("al", "dataset, trial, method")},
  pts AS (SELECT ref.*, m.method FROM ref, (SELECT DISTINCT method FROM preds) m), {align_sql("pts", "dataset, trial, method")}"""
add("d8_corr_global", lambda t: C.corr_global(grid_pairs(t), windows(t)), "samples spikes windows preds",
    f"WITH {GLOBAL}, mk AS (SELECT pr.*, EXISTS (SELECT 1 FROM okwin w WHERE w.dataset = pr.dataset AND w.trial = pr.trial AND pr.q BETWEEN w.start_s AND w.end_s) AS hit FROM pr) SELECT dataset, trial, method, {corr('rate', 'y')} AS correlation FROM (SELECT * REPLACE (CASE WHEN hit THEN y END AS y) FROM mk) GROUP BY ALL")
add("d8_corr_global_whole", lambda t: C.corr_global(grid_pairs(t)), "samples spikes windows preds", f"WITH {GLOBAL} SELECT dataset, trial, method, {corr('rate', 'y')} AS correlation FROM pr GROUP BY ALL")
add("d9_corr_global_per_trial", lambda t: C.corr_global_per_window(grid_pairs(t), windows(t)), "samples spikes windows preds",
    f"WITH {GLOBAL} SELECT pr.dataset, pr.trial, pr.method, win AS k, {corr('rate', 'CASE WHEN q BETWEEN win.start_s AND win.end_s THEN y END')} AS correlation FROM pr JOIN win ON win.dataset = pr.dataset AND win.trial = pr.trial GROUP BY ALL")


def two(t):
    p = t.preds.groupBy(*TRIAL, "i").pivot("method", ["sampler", "cnn"]).agg(F.max("prob"))
    return p.select(*TRIAL, "i", F.col("sampler").alias("x"), F.col("cnn").alias("y"))


TWO = "two AS (SELECT a.dataset, a.trial, a.i, a.prob AS x, b.prob AS y FROM preds a JOIN preds b ON a.trial = b.trial AND a.dataset = b.dataset AND a.i = b.i WHERE a.method = 'sampler' AND b.method = 'cnn')"
add("d10_corr_nan_moments", lambda t: D.corr_nan_moments(two(t), TRIAL), "preds", f"WITH {TWO}, m AS (SELECT dataset, trial, avg(x) AS mx, avg(y) AS my, stddev_pop(x)*stddev_pop(y) AS s FROM two GROUP BY ALL) SELECT two.dataset, two.trial, round(avg((x - mx)*(y - my))/nullif(max(s), 0), 6) + 0 AS r FROM two JOIN m ON m.trial = two.trial AND m.dataset = two.dataset GROUP BY ALL")
BINS = """bd AS (SELECT dataset, trial, min(t) AS f, max(t) AS l FROM samples GROUP BY ALL), nb AS (SELECT *, CAST(ceil((l + 24 - f)/24) AS BIGINT) - 1 AS m FROM bd), bn AS (SELECT *, unnest(range(0, m)) AS k FROM nb),
  hb AS (SELECT bn.dataset, bn.trial, bn.k, count(s.s) AS n FROM bn LEFT JOIN spikes s ON s.trial = bn.trial AND s.dataset = bn.dataset AND s.s >= f + k*24 AND (s.s < f + (k + 1)*24 OR (k = m - 1 AND s.s = f + m*24)) GROUP BY ALL)"""
ERS = f"{BINS}, ev AS (SELECT dataset, trial, count(*) AS n FROM spikes GROUP BY ALL), er AS (SELECT bd.dataset, bd.trial, f AS first_t, l AS last_t, coalesce(any_value(ev.n), 0) AS n, coalesce(max(hb.n)/24e0, 0) AS peak, coalesce(any_value(ev.n), 0)/greatest(l - f, 1e-9) AS mean_rate FROM bd LEFT JOIN hb ON hb.trial = bd.trial AND hb.dataset = bd.dataset LEFT JOIN ev ON ev.trial = bd.trial AND ev.dataset = bd.dataset GROUP BY bd.dataset, bd.trial, f, l)"


def ers(t):
    return D.epoch_rate_stats(R.bounds(t.samples), t.spikes, 24.0)


def tau_sql(rows: str, dt: str) -> str:
    """`tau` of `rows(dataset, trial, i, y)`: from the products of all pairs of samples."""
    return f"""am AS (SELECT dataset, trial, i, y - avg(y) OVER w AS x, count(*) OVER w AS n FROM {rows} WINDOW w AS (PARTITION BY dataset, trial)),
  ac AS (SELECT a.dataset, a.trial, b.i - a.i AS lag, sum(a.x*b.x) AS c, max(a.n) AS n FROM am a JOIN am b ON b.trial = a.trial AND b.dataset = a.dataset AND b.i >= a.i GROUP BY ALL),
  az AS (SELECT dataset, trial, c AS c0, n FROM ac WHERE lag = 0), af AS (SELECT ac.dataset, ac.trial, min(lag) AS lag FROM ac JOIN az ON az.trial = ac.trial AND az.dataset = ac.dataset WHERE c <= 0.36787944117144233e0*c0 GROUP BY ALL),
  tau AS (SELECT az.dataset, az.trial, CASE WHEN n >= 2 AND c0 > 0 THEN coalesce(lag, n - 1)*{dt} END AS tau FROM az LEFT JOIN af ON af.trial = az.trial AND af.dataset = az.dataset)"""


add("d11_epoch_rate_stats", ers, "samples spikes", f"WITH {ERS} SELECT dataset, trial, round(first_t, 6) AS first_t, round(last_t, 6) AS last_t, n, round(peak, 6) AS peak, round(mean_rate, 6) AS mean_rate FROM er")
add("d12_latent_rate_metrics", lambda t: D.latent_rate_metrics(R.bounds(t.samples), t.spikes, 24.0, 36.0, 0.1), "samples spikes",
    f"""WITH {BINS}, hn AS (SELECT hb.*, m FROM hb JOIN nb ON nb.trial = hb.trial AND nb.dataset = hb.dataset), hs AS (SELECT a.dataset, a.trial, a.k, sum(w*b.n)/sum(w)/24e0 AS r FROM (SELECT *, exp(-0.5e0*power(d/15e-1, 2)) AS w FROM hn, (SELECT unnest(range(-6, 7)) AS d)) a
         JOIN hn b ON b.trial = a.trial AND b.dataset = a.dataset AND b.k = least(greatest(a.k + d, 0), a.m - 1) GROUP BY ALL),
       p AS (SELECT dataset, trial, quantile_cont(r, 0.99) AS p99 FROM hs GROUP BY ALL), du AS (SELECT p.dataset, p.trial, max(p99) AS p99, avg(CASE WHEN p99 > 0 AND r > 0.1e0*p99 THEN 1e0 ELSE 0 END) AS duty FROM hs JOIN p ON p.trial = hs.trial AND p.dataset = hs.dataset GROUP BY ALL),
       ti AS (SELECT dataset, trial, k AS i, r AS y FROM hs), {tau_sql("ti", "24e0")}
       SELECT bd.dataset, bd.trial, round(coalesce(p99, 0), 6) AS p99, round(tau, 6) AS tau, round(coalesce(duty, 0), 6) AS duty FROM bd LEFT JOIN du ON du.trial = bd.trial AND du.dataset = bd.dataset LEFT JOIN tau ON tau.trial = bd.trial AND tau.dataset = bd.dataset""")
add("d13_autocorr_time", lambda t: D.autocorr_time(t.frames, 1 / 30), "frames", f"WITH {tau_sql('frames', '1/30e0')} SELECT dataset, trial, round(tau, 6) AS tau FROM tau")
DIST = "count({0}) AS n, round(avg({0}), 6) + 0 AS mean, round(coalesce(stddev_samp({0}), 0), 6) AS std, round(min({0}), 6) AS min, round(quantile_cont({0}, 0.25), 6) AS p25, round(median({0}), 6) AS median, round(quantile_cont({0}, 0.75), 6) AS p75, round(max({0}), 6) AS max"
add("d14_distribution_summary", lambda t: D.distribution(t.trialwise, ["run", "method"], "correlation"), "trialwise", f"SELECT run, method, {DIST.format('correlation')} FROM trialwise WHERE correlation IS NOT NULL GROUP BY run, method")
add("d15_pooled_rate_stats", lambda t: D.pooled_rates(ers(t)), "samples spikes", f"WITH {ERS} SELECT dataset, round(sum(n)/nullif(sum(last_t - first_t), 0), 6) AS rate, round(max(peak), 6) AS peak FROM er GROUP BY dataset")


def cut(t):
    """Time ranges without their first day, so that some events stand outside."""
    return R.bounds(t.samples).withColumn("first_t", F.col("first_t") + 24)


def qc(t):
    return D.recording_qc(t.samples, t.spikes, S.sampling_rate(t.samples), cut(t))


QC = f"""{FS}, bd AS (SELECT dataset, trial, min(t) + 24 AS f, max(t) AS l FROM samples GROUP BY ALL), qc AS (SELECT bd.dataset, bd.trial, any_value(fs) AS fs, count(s.s) AS events, coalesce(count_if(s.s BETWEEN f AND l)/nullif(count(s.s), 0), 1) AS inside, any_value(l - f) AS duration, count(s.s)/any_value(l - f) AS rate
  FROM bd JOIN fs ON fs.trial = bd.trial AND fs.dataset = bd.dataset LEFT JOIN spikes s ON s.trial = bd.trial AND s.dataset = bd.dataset GROUP BY bd.dataset, bd.trial)"""
add("d16_recording_qc", qc, "samples spikes", f"WITH {QC} SELECT dataset, trial, round(fs, 6) AS fs, events, round(inside, 6) AS inside, round(duration, 6) AS duration, round(rate, 6) AS rate FROM qc")
add("d16_recording_qc_overall", lambda t: D.qc_overall(qc(t)), "samples spikes",
    f"WITH {QC} SELECT count(*) AS trials, round(median(inside), 6) AS median, round(avg(inside), 6) AS mean, round(min(inside), 6) AS min, round(max(inside), 6) AS max, count_if(inside < 1) AS bad, arg_min(dataset, (inside, dataset, trial)) AS worst_dataset, arg_min(trial, (inside, dataset, trial)) AS worst_trial FROM qc")
add("d17_dataset_profile", lambda t: D.dataset_profile(qc(t), t.samples, D.noise_level(t.samples, S.sampling_rate(t.samples))), "samples spikes",
    f"WITH {QC}, {STEP.format('samples')}, no AS (SELECT d.dataset, d.trial, median(abs(d))/sqrt(any_value(fs))*100 AS noise FROM d JOIN fs ON fs.trial = d.trial AND fs.dataset = d.dataset GROUP BY ALL), n AS (SELECT dataset, count(*) AS samples FROM samples GROUP BY dataset) SELECT qc.dataset, round(avg(fs), 6) AS fs, round(avg(noise), 6) AS noise, round(avg(rate), 6) AS rate, count(*) AS trials, round(sum(duration)/60, 6) AS minutes, any_value(samples) AS samples FROM qc JOIN n ON n.dataset = qc.dataset LEFT JOIN no ON no.trial = qc.trial AND no.dataset = qc.dataset GROUP BY qc.dataset")
RET = "la AS (SELECT tag, max(sample) AS last FROM {0} GROUP BY tag), ret AS (SELECT p.* FROM {0} p JOIN la ON la.tag = p.tag WHERE sample >= least({1}, last))"
add("d18_posterior_mean_std", lambda t: D.posterior_mean_std(t.posterior, 2), "posterior",
    "WITH " + RET.format("posterior", 2) + " SELECT tag, bin, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("burst", "b", "s", "c")) + ", round(avg(c) + avg(b), 6) AS reconstruction FROM ret GROUP BY ALL")
add("d19_map_sample", lambda t: D.map_sample(t.logp, 2), "logp", "WITH " + RET.format("logp", 2) + " SELECT tag, sample, logp FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY logp DESC, sample) AS r FROM ret) WHERE r = 1")
def chains(t):
    """All rows of a tag as one chain of parameter samples."""
    return t.posterior.withColumn("sample", F.row_number().over(W.partitionBy("tag").orderBy("sample", "bin")) - 1)


SIX = ["burst", "b", "s", "c", "y", "bin"]
for burn in (100, 2, -1):
    add(f"d20_posterior_param_mean_{'reset' if burn < 0 else burn}", lambda t, burn=burn: D.posterior_param_mean(chains(t), burn, SIX), "posterior",
        f"WITH r AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n, row_number() OVER (PARTITION BY tag ORDER BY sample, bin) - 1 AS k FROM posterior) SELECT tag, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in SIX) + f" FROM r WHERE k >= CASE WHEN {burn} < 0 OR {burn} > n THEN 0 ELSE {burn} END GROUP BY tag")
add("d21_compare_param_chains", lambda t: D.compare_chains(t.trialwise.where("correlation is not null").select("dataset", F.when(F.col("run") == "A", "a").when(F.col("run") == "N", "b").alias("side"), F.col("correlation").alias("v")), ["dataset"], "side", "v"), "trialwise",
    """WITH v AS (SELECT dataset, run, correlation AS v FROM trialwise WHERE correlation IS NOT NULL AND run IN ('A', 'N')), n AS (SELECT dataset, count_if(run = 'A') AS na, count_if(run = 'N') AS nb FROM v GROUP BY ALL),
       g AS (SELECT v.dataset, v, run, na, nb, abs(count_if(run = 'A') OVER w / na - count_if(run = 'N') OVER w / nb) AS gap FROM v JOIN n ON n.dataset = v.dataset WHERE na > 0 AND nb > 0 WINDOW w AS (PARTITION BY v.dataset ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       k AS (SELECT dataset, avg(CASE WHEN run = 'A' THEN v END) AS ma, avg(CASE WHEN run = 'N' THEN v END) AS mb, stddev_pop(CASE WHEN run = 'A' THEN v END) AS sa, stddev_pop(CASE WHEN run = 'N' THEN v END) AS sb, max(gap) AS ks, max(sqrt(na*nb/(na + nb))*gap) AS root FROM g GROUP BY dataset),
       p AS (SELECT dataset, sum(2*(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END)*exp(-2e0*j*j*root*root)) AS p FROM k, (SELECT unnest(range(1, 21)) AS j) GROUP BY dataset)
       SELECT k.dataset, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(sa, 6) AS std_a, round(sb, 6) AS std_b, round(ma - mb, 6) + 0 AS difference, round(ks, 6) AS ks, round(CASE WHEN root < 0.2e0 THEN 1 ELSE least(greatest(p, 0), 1) END, 6) AS p FROM k JOIN p ON p.dataset = k.dataset""")
add("d22_trace_agreement", lambda t: D.trace_agreement(two(t), TRIAL), "preds", f"WITH {TWO} SELECT dataset, trial, {corr('x', 'y')} AS r, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y)*(x - y))), 6) AS rmse FROM two GROUP BY ALL")
add("d23_binary_agreement", lambda t: D.binary_agreement(t.posterior.select("tag", F.col("s").alias("x"), F.col("burst").alias("y")), ["tag"]), "posterior",
    "SELECT tag, round(coalesce(count_if(s > 0 AND burst > 0)/nullif(count_if(s > 0 OR burst > 0), 0), 1), 6) AS jaccard, round(avg(CASE WHEN (s > 0) = (burst > 0) THEN 1e0 ELSE 0 END), 6) AS same_flag, round(avg(CASE WHEN s = burst THEN 1e0 ELSE 0 END), 6) AS same_value FROM posterior GROUP BY tag")
add("d24_max_abs_diff", lambda t: D.max_abs_diff(two(t), TRIAL), "preds", f"WITH {TWO} SELECT dataset, trial, round(max(abs(x - y)), 6) AS d FROM two GROUP BY ALL")
add("d34_total_counts", lambda t: D.total_counts(t.posterior, ["tag", "sample"], "s"), "posterior", "SELECT tag, sample, CAST(coalesce(sum(s), 0) AS BIGINT) AS n FROM posterior GROUP BY ALL")
add("d35_fixed_bin_histogram", lambda t: D.fixed_bins(t.spikes, R.bounds(t.samples), 24.0), "samples spikes", f"WITH {BINS} SELECT dataset, trial, k, n FROM hb")


def edge_events(t):
    """Events on, beside and beyond the edges of uneven frames 8 seconds wide: at each error, and around the trials' first and last times."""
    at = F.explode(F.array(*[F.col("first_t") + F.lit(x) for x in (-4.0, -4.5)], *[F.col("last_t") + F.lit(x) for x in (0.0, 3.5, 4.0, 4.25)])).alias("s")
    return t.spikes.union(t.spikes.select(*TRIAL, F.col("s") + 3.75)).union(R.bounds(t.samples).select(*TRIAL, at))


def frame_sql(step: str, tail: str) -> str:
    return f"""WITH bd AS (SELECT dataset, trial, min(t) AS f, max(t) AS l, (max(t) - min(t))/(count(*) - 1) AS mean FROM samples GROUP BY ALL),
       ev AS (SELECT dataset, trial, s FROM spikes UNION ALL SELECT dataset, trial, s + 375e-2 FROM spikes UNION ALL SELECT dataset, trial, f + x FROM bd, (VALUES (-4e0), (-45e-1)) v(x) UNION ALL SELECT dataset, trial, l + x FROM bd, (VALUES (0e0), (35e-1), (4e0), (425e-2)) v(x)),
       ed AS (SELECT x.dataset, x.trial, i, t - {step}/2 AS a, coalesce(lead(t) OVER w - {step}/2, t + {tail}) AS z, lead(i) OVER w IS NULL AS last FROM samples x JOIN bd ON bd.trial = x.trial AND bd.dataset = x.dataset WINDOW w AS (PARTITION BY x.dataset, x.trial ORDER BY i))
       SELECT ed.dataset, ed.trial, i, count(s) AS n FROM ed LEFT JOIN ev ON ev.trial = ed.trial AND ev.dataset = ed.dataset AND s >= a AND (s < z OR (last AND s = z)) GROUP BY ed.dataset, ed.trial, i"""


add("d36_frame_centred_histogram", lambda t: B.frame_histogram(t.samples, edge_events(t), 8.0), "samples spikes", frame_sql("8e0", "4e0"))
add("d36_frame_histogram_mean_step", lambda t: B.frame_histogram(t.samples, edge_events(t), tail=0.0), "samples spikes", frame_sql("mean", "0"))
add("d37_noise_histogram", lambda t: D.noise_histogram(D.noise_level(t.samples, S.sampling_rate(t.samples)), 20), "samples",
    f"""WITH {FS}, {STEP.format('samples')}, l AS (SELECT d.dataset, d.trial, median(abs(d))/sqrt(any_value(fs))*100 AS noise FROM d JOIN fs ON fs.trial = d.trial AND fs.dataset = d.dataset WHERE d IS NOT NULL GROUP BY ALL),
       r AS (SELECT min(noise) AS a, max(noise) AS z, count(*) AS n, quantile_cont(noise, 0.999) AS lim FROM l) SELECT CAST(least(floor((noise - a)/(z - a)*20), 19) AS BIGINT) AS bin, round(any_value(lim), 6) AS "limit", round(count(*)/any_value(n)/any_value((z - a)/20), 6) AS density FROM l, r GROUP BY 1""")
def runs(t):
    b = R.bounds(t.samples.withColumn("t", F.col("t") - 1000.0 * F.col("trial")))
    return b.withColumn("iterations", F.when(F.col("dataset") % 2 == 0, F.col("trial") % 2).otherwise(F.lit(5))).withColumn("names", F.array(F.lit("x"), F.when(F.col("dataset") % 3 == 0, F.col("trial").cast("string")).otherwise(F.lit("y")))).withColumn("names", F.when(F.col("dataset") % 3 == 0, F.slice("names", 2, 1)).otherwise(F.col("names")))


add("d38_shared_window", lambda t: D.shared_window(runs(t), ["dataset"]), "samples",
    """WITH b AS (SELECT dataset, trial, min(t - 1e3*trial) AS f, max(t - 1e3*trial) AS l FROM samples GROUP BY ALL) SELECT dataset, round(max(f), 6) AS start_s, round(min(l), 6) AS end_s, count(*) AS runs, min(f) < max(f) OR max(l) > min(l) AS clipped,
       count(DISTINCT CASE WHEN dataset % 2 = 0 THEN trial % 2 ELSE 5 END) > 1 AS iterations, dataset % 3 = 0 AND count(DISTINCT trial) > 1 AS disjoint FROM b GROUP BY dataset HAVING count(*) >= 2 AND min(l) > max(f)""")
add("d39_representative_trial", lambda t: D.representative_trial(t.trialwise.withColumn("trial", F.col("trial") % 100), ["dataset"]), "trialwise",
    """WITH s AS (SELECT dataset, method, trial % 100 AS trial, avg(correlation) AS v FROM trialwise WHERE correlation IS NOT NULL GROUP BY ALL), m AS (SELECT dataset, method, median(v) AS m FROM s GROUP BY ALL), n AS (SELECT dataset, count(DISTINCT method) AS k FROM s GROUP BY ALL),
       d AS (SELECT s.dataset, s.trial, sum(abs(v - m)) AS d, count(*) AS c FROM s JOIN m ON m.dataset = s.dataset AND m.method = s.method GROUP BY ALL) SELECT dataset, trial FROM (SELECT d.*, row_number() OVER (PARTITION BY d.dataset ORDER BY round(d, 9), trial) AS r FROM d JOIN n ON n.dataset = d.dataset WHERE c = k) WHERE r = 1""")
add("d40_trajectory_loglik", lambda t: D.trajectory_loglik(t.posterior, {"w01": 0.5, "w10": 2.0, "r0": 3.0, "r1": 8.0, "sigma2": 0.04}, 0.1, 0.2), "posterior",
    """WITH l AS (SELECT *, lag(burst) OVER w AS p, lag(b) OVER w AS pb, CASE WHEN burst = 0 THEN 0.3e0 ELSE 0.8e0 END AS rate FROM posterior WINDOW w AS (PARTITION BY tag, sample ORDER BY bin))
       SELECT tag, sample, round(sum(CASE WHEN p IS NULL THEN -0.5e0*power(b/1e-4, 2) - 0.5e0*power(y - b, 2)/0.04e0 ELSE ln(CASE WHEN p = 0 THEN CASE WHEN burst = 0 THEN 0.95e0 ELSE 0.05e0 END ELSE CASE WHEN burst = 1 THEN 0.8e0 ELSE 0.2e0 END END)
         + s*ln(rate) - rate - ln(CAST(factorial(CAST(s AS INT)) AS DOUBLE)) - 0.5e0*power((b - pb)/(0.2e0*sqrt(0.1e0)), 2) - 0.5e0*power(y - c - b, 2)/0.04e0 END), 6) AS loglik FROM l GROUP BY ALL""")
add("d41_param_logprior", lambda t: D.param_logprior(t.posterior.select("tag", "sample", "bin", "b", "c"), {"b": (0.04, 0.02), "c": (0.05, 0.03)}).select("tag", "sample", "bin", "logprior"), "posterior", "SELECT tag, sample, bin, round(-0.5e0*power((b - 0.04e0)/0.02e0, 2) - 0.5e0*power((c - 0.05e0)/0.03e0, 2), 6) + 0 AS logprior FROM posterior")


def flags(t, *names: str):
    """Each posterior sample as a series, its values under the names given."""
    return t.posterior.select("tag", "sample", F.col("bin").alias("i"), *[F.col(c).alias(n) for c, n in zip(("s", "burst"), names)])


def bins_sql(rate: str) -> str:
    """`rb`: counts of positive `s` and `burst` in bins of a rate, by the first bound that is not below a sample's time."""
    return f"""ax AS (SELECT *, CASE WHEN p < n - 1 THEN p*(n/10e0/(n - 1)) ELSE n/10e0 END AS t FROM (SELECT tag, sample, s, burst, count(*) OVER (PARTITION BY tag, sample) AS n, row_number() OVER (PARTITION BY tag, sample ORDER BY bin) - 1 AS p FROM posterior)),
  pl AS (SELECT *, list_filter(range(1, CAST(n/10e0*{rate} AS BIGINT) + 3), lambda c: t <= c/{rate})[1] - 1 AS k FROM ax), sc AS (SELECT tag, sample, unnest(range(0, last + 1)) AS k FROM (SELECT tag, sample, max(k) AS last FROM pl GROUP BY ALL)),
  rb AS (SELECT sc.tag, sc.sample, sc.k, count(*) FILTER (s > 0) AS x, count(*) FILTER (burst > 0) AS y FROM sc LEFT JOIN pl ON pl.tag = sc.tag AND pl.sample = sc.sample AND pl.k = sc.k GROUP BY ALL)"""


for label, rate in (("", 4.0), ("_finer", 25.0)):
    add(f"d43_rebin_flags{label}", lambda t, rate=rate: B.rebin_flags(flags(t, "x", "y"), ["tag", "sample"], 10.0, rate, ("x", "y")), "posterior", f"WITH {bins_sql(f'{rate}::DOUBLE')} SELECT tag, sample, k, x, y FROM rb")
add("d44_rebinned_correlation", lambda t: B.rebinned_correlation(flags(t, "x"), t.posterior.select("tag", "sample", F.col("bin").alias("i"), F.col("burst").alias("x")), ["tag", "sample"], 10.0, 4.0, 0.5), "posterior",
    f"WITH {bins_sql('4e0')}, w AS (SELECT a.tag, a.sample, a.k, sum(exp(-0.5e0*power((a.k - b.k)/4e0/0.5e0, 2))*b.x)/sum(exp(-0.5e0*power((a.k - b.k)/4e0/0.5e0, 2))) AS x, sum(exp(-0.5e0*power((a.k - b.k)/4e0/0.5e0, 2))*b.y)/sum(exp(-0.5e0*power((a.k - b.k)/4e0/0.5e0, 2))) AS y FROM rb a JOIN rb b ON b.tag = a.tag AND b.sample = a.sample GROUP BY ALL) SELECT tag, sample, {corr('x', 'y')} AS r FROM w GROUP BY ALL")
add("d44_rebinned_correlation_plain", lambda t: B.rebinned_correlation(flags(t, "x"), t.posterior.select("tag", "sample", F.col("bin").alias("i"), F.col("burst").alias("x")), ["tag", "sample"], 10.0, 25.0), "posterior", f"WITH {bins_sql('25e0')} SELECT tag, sample, {corr('x', 'y')} AS r FROM rb GROUP BY ALL")
add("a12_validate_traces", lambda t: D.validate(t.samples, t.spikes), "samples spikes",
    """WITH d AS (SELECT dataset, trial, y, t - lag(t) OVER (PARTITION BY dataset, trial ORDER BY i) AS d FROM samples), e AS (SELECT dataset, count(*) AS events FROM spikes GROUP BY ALL), w AS (SELECT dataset, count_if(c = 0) AS warnings FROM (SELECT dataset, trial, count(y) AS c FROM samples GROUP BY ALL) GROUP BY ALL)
       SELECT d.dataset, count(DISTINCT trial) AS trials, count(*) AS samples, count_if(y IS NULL) AS nulls, round(min(y), 6) AS least, round(max(y), 6) AS most, round(median(d), 6) AS dt, count_if(d <= 0) AS errors, any_value(w.warnings) AS warnings, any_value(events) AS events FROM d JOIN w ON w.dataset = d.dataset JOIN e ON e.dataset = d.dataset GROUP BY d.dataset""")


def spoilt(t):
    """Trials with missing or unequal arrays, a time that goes back, one time or none, and datasets that lack all times."""
    k, times = F.col("trial"), F.col("t")
    short = F.slice("t", 1, 9)
    t_ = F.when((F.col("dataset") == 7) | (k % 11 == 3), F.transform("t", lambda x: F.lit(float("nan")))).when(k % 11 == 4, F.slice("t", 1, 1)).when(k % 11 == 5, short).when(k % 11 == 6, F.transform("t", lambda x, i: F.when(i == 5, 0.0).otherwise(x))).when(k % 11 == 7, F.lit(None)).otherwise(times)
    y = F.when(k % 11 == 8, F.transform("y", lambda x: F.lit(None).cast("double"))).when(k % 11 == 4, F.slice("y", 1, 1)).otherwise(F.col("y"))
    return t.wide.withColumn("t", t_).withColumn("y", y)


def few_spikes(t):
    return t.frames.where("y > 0.3 and dataset <> 4").select("dataset", F.col("t").alias("s"))


SPOILT = """w AS (SELECT DISTINCT dataset, trial, trial % 11 AS m FROM frames), c AS (SELECT *, CASE WHEN m = 4 AND dataset <> 7 THEN 1 WHEN m = 5 AND dataset <> 7 THEN 9 WHEN m = 7 AND dataset <> 7 THEN 0 WHEN m = 3 OR dataset = 7 THEN 0 ELSE 64 END AS finite, CASE WHEN m = 3 OR dataset = 7 THEN 64 WHEN m = 4 THEN 1 WHEN m = 5 THEN 9 WHEN m = 7 THEN 0 ELSE 64 END AS nt, CASE WHEN m = 4 THEN 1 ELSE 64 END AS ny FROM w),
  fi AS (SELECT dataset, trial, 'warning' AS level, 'shape' AS code, nt || ' times, ' || ny || ' values' AS detail FROM c WHERE nt <> ny UNION ALL SELECT dataset, trial, 'note', 'no_times', NULL FROM c WHERE finite = 0 UNION ALL SELECT dataset, trial, 'note', 'single_time', '0.0' FROM c WHERE finite = 1
         UNION ALL SELECT dataset, trial, 'warning', 'no_values', NULL FROM c WHERE m = 8 AND finite > 0 UNION ALL SELECT dataset, trial, 'error', 'step', '1' FROM c WHERE m = 6 AND dataset <> 7 UNION ALL SELECT 7, NULL, 'error', 'no_epochs', NULL UNION ALL SELECT 4, NULL, 'note', 'no_spikes', NULL)"""
add("a12_trial_findings", lambda t: V.trial_findings(spoilt(t), few_spikes(t)), "frames", f"WITH {SPOILT} SELECT dataset, trial, level, code, detail FROM fi")
add("a12_inspected", lambda t: V.inspected(spoilt(t), few_spikes(t), V.trial_findings(spoilt(t), few_spikes(t))), "frames",
    f"""WITH {SPOILT}, f AS (SELECT f.dataset, f.trial, i, CASE WHEN m = 6 AND i = 5 THEN 0 ELSE t END AS t, y, m, CASE WHEN f.dataset = 7 OR m IN (3, 7) THEN false WHEN m = 4 THEN i = 0 WHEN m = 5 THEN i < 9 ELSE true END AS ok, NOT (m = 8 OR (m = 4 AND i > 0)) AS yok FROM frames f JOIN w ON w.dataset = f.dataset AND w.trial = f.trial),
       st AS (SELECT dataset, t - lag(t) OVER (PARTITION BY dataset, trial ORDER BY i) AS d FROM f WHERE ok), h AS (SELECT dataset, median(d) AS dt FROM st GROUP BY dataset),
       p AS (SELECT dataset, count(DISTINCT CASE WHEN ok THEN trial END) AS epochs, count_if(ok) AS samples, min(CASE WHEN ok THEN t END) AS first_t, max(CASE WHEN ok THEN t END) AS last_t, min(CASE WHEN yok THEN y END) AS least, max(CASE WHEN yok THEN y END) AS most FROM f GROUP BY dataset)
       SELECT p.dataset, epochs, samples, round(first_t, 6) AS first_t, round(last_t, 6) AS last_t, round(least, 6) AS least, round(most, 6) AS most, round(dt, 6) AS dt, (SELECT count(*) FROM frames x WHERE x.dataset = p.dataset AND x.y > 0.3e0 AND x.dataset <> 4) AS events,
         (SELECT count(*) FROM fi WHERE fi.dataset = p.dataset AND level = 'error') AS errors, (SELECT count(*) FROM fi WHERE fi.dataset = p.dataset AND level = 'warning') AS warnings FROM p LEFT JOIN h ON h.dataset = p.dataset""")


def ragged(t):
    """Two arrays of each trial: of unequal length in some, without a common finite value in others."""
    both = t.frames.select(*TRIAL, "i", F.col("y").alias("v"))
    other = both.where("not (trial % 7 = 2 and i > 40)").withColumn("v", F.when(F.col("trial") % 7 == 3, F.lit(float("nan"))).when(F.col("trial") % 7 == 4, F.lit(None)).otherwise(F.col("v") * 2))
    return both, other


add("d24_max_abs_diff_of_shapes", lambda t: D.max_abs_diff_of(*ragged(t), TRIAL, "i"), "frames", "SELECT dataset, trial, CASE WHEN trial % 7 NOT IN (2, 3, 4) THEN round(max(abs(y)), 6) END AS d FROM frames GROUP BY dataset, trial")
add("d17_dataset_profile_by_neuron", lambda t: D.dataset_profile(qc(t).withColumn("neuron", F.col("trial") % 3), t.samples, D.noise_level(t.samples, S.sampling_rate(t.samples))), "samples spikes",
    f"""WITH {QC}, {STEP.format('samples')}, no AS (SELECT d.dataset, d.trial, median(abs(d))/sqrt(any_value(fs))*100 AS noise FROM d JOIN fs ON fs.trial = d.trial AND fs.dataset = d.dataset GROUP BY ALL), n AS (SELECT dataset, count(*) AS samples FROM samples GROUP BY dataset),
       ne AS (SELECT qc.dataset, qc.trial % 3 AS neuron, avg(fs) AS fs, avg(noise) AS noise, avg(rate) AS rate, count(*) AS trials, sum(duration) AS duration FROM qc LEFT JOIN no ON no.trial = qc.trial AND no.dataset = qc.dataset GROUP BY ALL)
       SELECT ne.dataset, round(avg(fs), 6) AS fs, round(avg(noise), 6) AS noise, round(avg(rate), 6) AS rate, count(*) AS neurons, CAST(sum(trials) AS BIGINT) AS trials, round(sum(duration)/60, 6) AS minutes, any_value(samples) AS samples FROM ne JOIN n ON n.dataset = ne.dataset GROUP BY ne.dataset""")
