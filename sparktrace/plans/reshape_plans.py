"""Queries of projection, filtering and reshaping, text and scalar functions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.functions import text as X
from sparktrace.operators import match as M
from sparktrace.operators import reshape as R
from sparktrace.plans.registry import add

add("b1_explode_trials", lambda t: R.explode_trials(t.wide), "frames",
    "SELECT dataset, trial AS trial_orig, i, round(t, 6) AS t, round(y, 6) AS y, dense_rank() OVER (PARTITION BY dataset ORDER BY trial) - 1 AS trial FROM frames WHERE isfinite(y)")
add("b2_select_datasets", lambda t: R.select_datasets(t.samples, first=4), "samples", "SELECT DISTINCT dataset FROM samples ORDER BY dataset LIMIT 4")
add("b3_select_trials", lambda t: R.select_trials(t.samples, t.windows.where("trial % 3 = 0")).select("dataset", "trial", "i", "y"), "samples",
    "SELECT dataset, trial, i, round(y, 6) AS y FROM samples WHERE trial % 3 = 0")
add("b4_trim_to_window", lambda t: R.trim_to_window(t.samples, t.windows).select("dataset", "trial", "i", "t", "y"), "samples windows",
    "SELECT s.dataset, s.trial, i, round(t, 6) AS t, round(y, 6) AS y FROM samples s JOIN windows w ON s.trial = w.trial AND s.dataset = w.dataset WHERE t BETWEEN start_s - 1e-6 AND end_s + 1e-6")
add("b5_resolve_windows", lambda t: R.resolve_windows(t.samples, t.windows), "samples windows",
    "SELECT dataset, trial, round(coalesce(any_value(start_s), min(t)), 6) AS start_s, round(coalesce(any_value(end_s), max(t)), 6) AS end_s FROM samples JOIN windows USING (dataset, trial) GROUP BY dataset, trial")
add("b6_clip_windows", lambda t: R.clip_windows(t.samples, t.windows.withColumn("end_s", F.col("end_s") + 500)), "samples windows",
    """SELECT dataset, trial, round(a, 6) AS start_s, round(z, 6) AS end_s FROM (
       SELECT dataset, trial, greatest(any_value(start_s), min(t)) AS a, least(any_value(end_s) + 500, max(t)) AS z FROM samples JOIN windows USING (dataset, trial) GROUP BY dataset, trial) WHERE z > a""")
def own_axis(t):
    """Samples with times from each trial's number on, so that one start lies before, in and after different trials; some values are missing."""
    return t.samples.withColumn("t", F.col("t") - 1000.0 * F.col("trial") + F.col("trial") % 50).withColumn("y", F.when(F.col("event_id") % 9 > 0, F.col("y")))


SNIP = """b AS (SELECT dataset, trial, t - 1e3*trial + trial % 50 AS t FROM samples WHERE event_id % 9 > 0), c AS (SELECT dataset, trial, min(t) AS f, max(t) AS l FROM b GROUP BY ALL), d AS (SELECT dataset, trial, greatest({start}, f) AS a, {start} < f AS start_clamped, {end} AS z0, l FROM c)
  SELECT b.dataset, b.trial, round(a, 6) AS a, round(least(z0, l), 6) AS z, start_clamped, z0 > l AS end_clamped, count(*) AS n FROM b JOIN d ON d.dataset = b.dataset AND d.trial = b.trial WHERE t BETWEEN a AND least(z0, l) AND least(z0, l) > a GROUP BY b.dataset, b.trial, a, z0, l, start_clamped HAVING count(*) >= 2"""
add("b7_snippet_window", lambda t: R.snippet_window(own_axis(t), 30.0, 120.0), "samples", "WITH " + SNIP.format(start="30e0", end="greatest(30e0, f) + 120"))
add("b7_snippet_window_to_an_end", lambda t: R.snippet_window(own_axis(t), end=700.0), "samples", "WITH " + SNIP.format(start="f", end="700e0"))
add("b8_mask_to_windows", lambda t: R.mask_to_windows(t.samples, t.windows), "samples windows",
    """SELECT dataset, trial, i, round(t, 6) AS t, CASE WHEN start_s IS NULL OR t BETWEEN start_s AND end_s THEN round(y, 6) END AS y FROM samples JOIN windows USING (dataset, trial)""")
add("b9_spikes_in_windows", lambda t: R.spikes_in_windows(t.spikes, t.windows), "spikes windows",
    "SELECT dataset, trial, round(s, 6) AS s FROM spikes JOIN windows USING (dataset, trial) WHERE s BETWEEN start_s AND end_s")
add("b10_finite_rows", lambda t: R.finite_rows(t.wide.withColumn("z", F.transform("y", lambda v: F.try_divide(F.lit(1.0), F.when(F.abs(v) > 0.001, v)))), ["t", "y", "z"]).select("dataset", "trial"), "frames",
    "SELECT dataset, trial FROM frames GROUP BY dataset, trial HAVING count_if(NOT abs(y) > 0.001e0) = 0")
add("b11_pad_trials", lambda t: R.pad_trials(t.wide.withColumn("t", F.slice("t", 1, F.lit(40) + (F.col("trial") % 20).cast("int"))).withColumn("y", F.slice("y", 1, F.lit(40) + (F.col("trial") % 20).cast("int"))), "edge").select("dataset", "trial", "valid_length", F.size("y").alias("n"), F.element_at("t", -1).alias("last_t"), F.element_at("y", -1).alias("last_y")), "frames",
    """WITH c AS (SELECT * FROM frames WHERE i < 40 + trial % 20), v AS (SELECT dataset, trial, count(*) AS valid_length, max_by(y, i) AS last_y, max(t) AS lt FROM c GROUP BY ALL)
       SELECT dataset, trial, valid_length, max(valid_length) OVER (PARTITION BY dataset) AS n, round(lt + (max(valid_length) OVER (PARTITION BY dataset) - valid_length)/30e0, 6) AS last_t, round(last_y, 6) AS last_y FROM v""")
add("b12_mask_padding", lambda t: R.mask_padding(t.frames, t.wide.select("dataset", "trial", (F.lit(40) + F.col("trial") % 20).alias("valid_length"))).select("dataset", "trial", "i", "y"), "frames",
    "SELECT dataset, trial, i, CASE WHEN i < 40 + trial % 20 THEN round(y, 6) END AS y FROM frames")
add("b13_flatten_trials", lambda t: R.flatten_trials(t.samples), "samples", "SELECT dataset, round(t, 6) AS t, round(y, 6) AS y, row_number() OVER (PARTITION BY dataset ORDER BY t, trial, i) - 1 AS k FROM samples")
add("b14_shift_left", lambda t: R.shift_left_for_method(t.preds, ["sampler"]), "preds",
    """SELECT dataset, trial, i, round(t, 6) AS t, method, round(CASE WHEN method = 'sampler' AND count(*) OVER (PARTITION BY dataset, trial, method) >= 2 THEN
         CASE WHEN i = max(i) OVER (PARTITION BY dataset, trial, method) THEN 0 ELSE lead(prob) OVER (PARTITION BY dataset, trial, method ORDER BY i) END ELSE prob END, 6) AS prob FROM preds""")
add("b15_normalize_01", lambda t: R.normalize_01(t.samples).select("dataset", "trial", "i", "y"), "samples",
    "SELECT dataset, trial, i, round(coalesce((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 0), 6) AS y FROM samples WINDOW w AS (PARTITION BY dataset, trial)")
add("b16_robust_scale", lambda t: R.robust_scale(t.samples, 2.0), "samples",
    """WITH q AS (SELECT dataset, trial, quantile_cont(y, 0.01) AS a, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.99) AS z FROM samples GROUP BY ALL),
       p AS (SELECT *, CASE WHEN (z - a)/2e0 > 0 THEN (z - a)/2e0 ELSE 1 END AS span FROM q)
       SELECT dataset, trial, i, round((y - m)/span, 6) AS y, round((a - m)/span, 6) AS low, round((z - m)/span, 6) AS high FROM samples JOIN p USING (dataset, trial)""")
add("b17_threshold_rates", lambda t: R.threshold_rates(t.frames, 1, 0.5).select("dataset", "trial", "i", "y"), "frames",
    """SELECT dataset, trial, i, round(CASE WHEN max(CASE WHEN y > 0.5e0/2.718281828459045e0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, trial ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 THEN greatest(y, 0) ELSE 0 END, 6) AS y FROM frames""")
add("b18_pad_prediction_edges", lambda t: R.pad_prediction_edges(t.frames, 16, 0.4).select("dataset", "trial", "i", "y"), "frames",
    "SELECT dataset, trial, i, CASE WHEN i < 6 OR i >= count(*) OVER (PARTITION BY dataset, trial) - 9 THEN 0 ELSE round(y, 6) END AS y FROM frames")
def holes(t):
    return t.samples.withColumn("y", F.when(F.col("event_id") % 11 != 0, F.col("y"))).withColumn("t", F.when(F.col("event_id") % 7 != 0, F.col("t")))


HOLES = "h AS (SELECT dataset, trial, i, CASE WHEN event_id % 11 <> 0 THEN y END AS y, CASE WHEN event_id % 7 <> 0 THEN t END AS t FROM samples)"
add("b19_clean_nonfinite", lambda t: R.clean_nonfinite(holes(t)).select("dataset", "trial", "i", "t", "y"), "samples",
    f"""WITH {HOLES}, g AS (SELECT dataset, trial, i, t FROM h WHERE t IS NOT NULL), p AS (SELECT h.*, a.i AS i0, a.t AS t0 FROM h ASOF LEFT JOIN g a ON a.dataset = h.dataset AND a.trial = h.trial AND h.i >= a.i), q AS (SELECT p.*, b.i AS i1, b.t AS t1 FROM p ASOF LEFT JOIN g b ON b.dataset = p.dataset AND b.trial = p.trial AND p.i <= b.i)
       SELECT dataset, trial, i, round(coalesce(t, t0 + (t1 - t0)*(i - i0)/(i1 - i0), t0, t1), 6) AS t, round(coalesce(y, 0), 6) AS y FROM q""")
add("b19_bad_percent", lambda t: R.bad_percent(holes(t)), "samples", f"WITH {HOLES} SELECT dataset, round(avg(CASE WHEN t IS NULL THEN 1e0 ELSE 0 END)*100, 6) AS bad_t, round(avg(CASE WHEN y IS NULL THEN 1e0 ELSE 0 END)*100, 6) AS bad_y FROM h GROUP BY dataset")
add("b20_refractory_filter", lambda t: R.refractory_filter(t.spikes, 10.0), "spikes",
    "SELECT dataset, trial, round(s, 6) AS s FROM (SELECT *, lag(s) OVER (PARTITION BY dataset, trial ORDER BY s) AS p FROM spikes) WHERE p IS NULL OR s - p >= 10")
add("b21_smoothing_label", lambda t: t.trialwise.select("smoothing").union(t.read("part").select(F.concat(F.col("p_size").cast("string"), F.lit("p5Hz")))).distinct().select("smoothing", X.smoothing_hz(F.col("smoothing"), 120.0).alias("hz"), X.smoothing_label(X.smoothing_hz(F.col("smoothing"))).alias("again")), "trialwise",
    """WITH l AS (SELECT smoothing FROM trialwise UNION SELECT p_size || 'p5Hz' FROM part), h AS (SELECT smoothing, TRY_CAST(replace(regexp_extract(lower(smoothing), '^([0-9]+(?:p[0-9]+)?)(?:hz)?$', 1), 'p', '.') AS DOUBLE) AS x FROM l)
       SELECT smoothing, coalesce(x, 120e0) AS hz, CASE WHEN x IS NULL THEN 'raw' ELSE smoothing END AS again FROM h""")
add("b22_expand_counts", lambda t: R.expand_counts(t.samples.select("dataset", "trial", "t", (F.col("y") / 10).alias("c"))), "samples",
    "SELECT dataset, trial, round(t, 6) AS s FROM (SELECT dataset, trial, t, unnest(range(0, CAST(round_even(y/10, 0) AS BIGINT))) FROM samples)")
add("b22_expand_places", lambda t: R.expand_places(t.samples.select("dataset", "trial", "i", (F.col("y") / 20 - 1).alias("c")), 30.0), "samples",
    "SELECT dataset, trial, round((i + 1)/30e0, 6) AS s FROM (SELECT dataset, trial, i, unnest(range(0, CAST(greatest(ceil(y/20 - 1), 0) AS BIGINT))) FROM samples)")
add("b23_method_key", lambda t: t.trialwise.select("method", "smoothing").distinct().withColumn("key", X.method_key(F.col("method"), F.when(F.col("smoothing") != "raw", F.col("smoothing")))).select("key", X.method_base(F.col("key")).alias("base"), X.method_variant(F.col("key")).alias("variant"), X.method_rank(F.col("key"), ["sampler", "unet", "cnn"]).alias("rank")), "trialwise",
    """WITH k AS (SELECT DISTINCT method, CASE WHEN smoothing = 'raw' THEN '' ELSE smoothing END AS v FROM trialwise)
       SELECT method || CASE WHEN v = '' THEN '' ELSE '::' || v END AS key, method AS base, v AS variant, CAST(list_position(['sampler', 'unet', 'cnn'], method) AS BIGINT) AS rank FROM k""")
add("b24_display_snippet", lambda t: R.display_snippet(t.samples, t.spikes, 96.0), "samples spikes",
    """WITH m AS (SELECT dataset, trial, quantile_cont(s, 0.5) AS mid FROM spikes GROUP BY ALL), b AS (SELECT dataset, trial, min(t) AS f, max(t) AS l FROM samples GROUP BY ALL),
       c AS (SELECT dataset, trial, f, l, coalesce(mid, (f + l)/2) AS mid FROM b LEFT JOIN m USING (dataset, trial)), d AS (SELECT *, greatest(least(mid - 48, l - 96), f) AS a FROM c)
       SELECT dataset, trial, round(a, 6) AS start_s, round(least(a + 96, l), 6) AS end_s FROM d WHERE least(a + 96, l) > a""")


def supports(t):
    """Two segments of methods in most trials, which overlap in some and lie apart in others."""
    b = R.bounds(t.samples)
    a = F.when(F.col("trial") % 3 == 0, 400.0).otherwise(100.0)
    one = F.array(F.struct((F.col("first_t") + a).alias("seg_start"), F.col("last_t").alias("seg_end")), F.struct(F.col("first_t").alias("seg_start"), (F.col("first_t") + 300).alias("seg_end")))
    return b.where("trial % 5 > 0").select("dataset", "trial", F.explode(one).alias("s")).select("dataset", "trial", "s.*")


COMMON = """b AS (SELECT dataset, trial, min(t) AS f0, max(t) AS l0 FROM samples GROUP BY ALL), m0 AS (SELECT *, CASE WHEN trial % 5 = 0 THEN f0 ELSE f0 + CASE WHEN trial % 3 = 0 THEN 400 ELSE 100 END END AS a, CASE WHEN trial % 5 = 0 THEN l0 ELSE least(l0, f0 + 300) END AS z FROM b),
  m1 AS (SELECT dataset, trial, CASE WHEN z > a THEN a ELSE f0 END AS f, CASE WHEN z > a THEN z ELSE l0 END AS l FROM m0), m2 AS (SELECT *, least(150e0, l - f) AS d FROM m1)"""
add("b24_snippet_inside_segments", lambda t: R.display_snippet(t.samples, t.spikes, 150.0, segments=supports(t)), "samples spikes",
    f"""WITH {COMMON}, q AS (SELECT s.dataset, s.trial, quantile_cont(s, 0.5) AS mid FROM spikes s JOIN m2 ON m2.dataset = s.dataset AND m2.trial = s.trial WHERE s BETWEEN f AND l GROUP BY ALL), r AS (SELECT m2.*, greatest(f, least(coalesce(mid, (f + l)/2) - d/2, l - d)) AS a FROM m2 LEFT JOIN q ON q.dataset = m2.dataset AND q.trial = m2.trial)
       SELECT dataset, trial, round(a, 6) AS start_s, round(a + d, 6) AS end_s FROM r""")
add("b24_snippet_from_a_start", lambda t: R.display_snippet(t.samples, t.spikes, 150.0, segments=supports(t), start=25120.0), "samples spikes", f"WITH {COMMON}, r AS (SELECT *, least(greatest(25120e0, f), l - d) AS a FROM m2) SELECT dataset, trial, round(a, 6) AS start_s, round(a + d, 6) AS end_s FROM r")



def config():
    return F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))


def named():
    """Model names of the parts; every ninth is a baseline."""
    model = F.format_string("k%d_r%d_s%dp%d_d0p%d_sb%d", F.col("p_size"), F.col("p_partkey") % 30, F.col("p_size") % 5, F.col("p_partkey") % 10, F.col("p_partkey") % 7, F.col("p_partkey"))
    return F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("baseline_"), F.col("p_name"))).otherwise(model)


def tag():
    epoch = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_epoch"), (F.col("p_partkey") % 5).cast("string"))).otherwise(F.lit(""))
    head = F.when(F.col("p_partkey") % 10 != 1, F.concat(F.lit("rec"), F.col("p_size").cast("string"), epoch)).otherwise(F.lit(""))
    return F.concat(head, F.format_string("_s0p%d_ms%d_trial%d", F.col("p_partkey") % 8, F.col("p_partkey") % 3, F.col("p_partkey") % 11))


add("h1_config_signature", lambda t: t.read("part").select("p_partkey", X.config_signature(config()).alias("key")), "",
    """SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":"' || p_size || '"}'), 1, 16) AS key FROM part""")
MODEL_SQL = "CASE WHEN p_partkey % 9 = 0 THEN 'baseline_' || p_name ELSE 'k' || p_size || '_r' || p_partkey % 30 || '_s' || p_size % 5 || 'p' || p_partkey % 10 || '_d0p' || p_partkey % 7 || '_sb' || p_partkey END"
add("h4_parse_model_name", lambda t: t.read("part").select("p_partkey", *[c.alias(k) for k, c in X.model_parameters(named()).items()]), "",
    """SELECT p_partkey, CASE WHEN ok THEN CAST(p_size AS DOUBLE) END AS k, CASE WHEN ok THEN CAST(p_partkey % 30 AS DOUBLE) END AS rate, CASE WHEN ok THEN round(p_size % 5 + (p_partkey % 10)/1e1, 6) END AS smooth,
       CASE WHEN ok THEN round((p_partkey % 7)/1e1, 6) END AS duty, CASE WHEN ok THEN CAST(p_partkey AS DOUBLE) END AS seed_base FROM (SELECT *, p_partkey % 9 <> 0 AS ok FROM part)""")
add("h5_parse_cache_tag", lambda t: t.read("part").select("p_partkey", tag().alias("tag")).select("p_partkey", X.tag_epoch(F.col("tag")).alias("epoch"), X.tag_stem(F.col("tag")).alias("stem"), X.tag_trial(F.col("tag")).alias("trial")), "",
    """WITH w AS (SELECT *, '_s0p' || p_partkey % 8 || '_ms' || p_partkey % 3 || '_trial' || p_partkey % 11 AS whole, p_partkey % 10 = 1 AS bare FROM part)
       SELECT p_partkey, CASE WHEN bare THEN whole ELSE 'rec' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_epoch' || p_partkey % 5 ELSE '' END END AS epoch, CASE WHEN bare THEN whole ELSE 'rec' || p_size END AS stem, p_partkey % 11 AS trial FROM w""")
add("h6_infer_dataset_name", lambda t: t.read("part").select("p_partkey", X.infer_dataset(F.concat(F.lit("/data/"), F.when(F.col("p_partkey") % 2 == 0, F.lit("Set_")).otherwise(F.lit("x_")), F.col("p_size").cast("string"), F.lit(".mat")), "^Set_(.+)$").alias("dataset")), "",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x_' END || p_size AS dataset FROM part")
def files(t):
    return t.read("part").select("p_partkey", F.concat(F.lit("/data/pred-"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("_x")).otherwise(F.lit("")), F.lit(".mat")).alias("name"))


add("h6_infer_known_dataset", lambda t: M.infer_known(files(t), t.read("nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("pred-")).otherwise(F.lit("")), F.col("n_nationkey").cast("string")).alias("dataset")), "([0-9]+)").drop("name"), "",
    """SELECT p_partkey, CASE WHEN p_size < 25 AND p_size % 2 = 1 THEN CAST(p_size AS VARCHAR) ELSE 'pred-' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '_x' ELSE '' END END AS dataset FROM part""")
add("h7_build_tag", lambda t: t.read("part").select("p_partkey", X.tag_token(F.concat_ws("_", "p_name", F.col("p_retailprice").cast("string"))).alias("tag")), "",
    "SELECT p_partkey, replace(replace(p_name || '_' || CAST(p_retailprice AS VARCHAR), '.', 'p'), ' ', '_') AS tag FROM part")
add("h8_max_events_per_bin", lambda t: t.read("part").select("p_partkey", X.events_per_bin(F.when(F.col("p_size") % 6 != 0, F.col("p_size") + (F.col("p_partkey") % 5) / F.lit(20.0)), 120.0).alias("n")), "",
    """SELECT p_partkey, CAST(CASE WHEN x IS NULL OR abs(x - 120) <= 1e-8 + 12e-4 THEN 2 WHEN abs(x - 30) <= 0.1e0 + 3e-4 THEN greatest(4, ceil(r/2) + 1) WHEN abs(x - 10) <= 0.1e0 + 1e-4 THEN greatest(7, ceil(r/2))
       ELSE greatest(3, ceil(r) + 1) END AS BIGINT) AS n FROM (SELECT p_partkey, x, greatest(120e0/x, 1) AS r FROM (SELECT p_partkey, CASE WHEN p_size % 6 <> 0 THEN p_size + (p_partkey % 5)/20e0 END AS x FROM part))""")
add("h9_sample_units_to_seconds", lambda t: t.read("events").groupBy((F.col("user_id") % 10).alias("dataset")).agg(F.sort_array(F.collect_list("event_id")).alias("at")).select("dataset", F.posexplode(X.seconds(F.col("at"))).alias("k", "s")), "",
    "SELECT user_id % 10 AS dataset, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS k, round(event_id/1e4, 6) AS s FROM events")
add("h10_json_to_rows", lambda t: t.samples.select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("key", "value")), "", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events")


def combos(t):
    rate, smooth, duty = F.col("p_retailprice") / 7, F.col("p_size") / 8, F.col("p_partkey") * 1e-6
    made = t.read("part").select("p_partkey", X.combo_tag(F.col("p_name"), rate, smooth, duty, F.col("p_partkey") * 100).alias("tag"))
    return made.select("p_partkey", "tag", *[c.alias(k) for k, c in X.parse_combo(F.col("tag")).items()])


TOKEN = "replace(replace(replace(trim({0}), ' ', '_'), '.', 'p'), '/', '_')"
add("h7_combo_tag_round_trip", combos, "",
    f"""WITH p AS (SELECT p_partkey, {TOKEN.format("p_name")} AS run, printf('%g', p_retailprice/7) AS r, printf('%g', p_size/8e0) AS s, printf('%g', p_partkey*1e-6) AS d FROM part)
       SELECT p_partkey, run || '_r' || replace(r, '.', 'p') || '_s' || replace(s, '.', 'p') || '_d' || replace(d, '.', 'p') || '_sb' || p_partkey*100 AS tag, run, CAST(r AS DOUBLE) AS rate, CAST(s AS DOUBLE) AS smooth, round(CAST(d AS DOUBLE), 6) AS duty, p_partkey*100 AS seed FROM p""")


def tags_of_runs(t):
    k = F.col("p_partkey")
    methods = F.filter(F.array(F.when(k % 2 == 0, "sampler"), F.when(k % 3 == 0, "cnn"), F.when(k % 5 == 0, "unet")), lambda x: x.isNotNull())
    rates = {"sampler": F.when(k % 4 != 0, F.col("p_size") / 4), "cnn": F.when(k % 9 != 0, F.col("p_size"))}
    marks = {"sampler": F.concat(F.when(k % 8 == 0, F.concat(F.lit("_ms"), (k % 7).cast("string"))).otherwise(F.lit("")), F.when(k % 16 == 0, "_c0y").otherwise("")), "cnn": F.when(k % 6 == 0, "_nodisc")}
    run = X.run_tag(methods, [("sampler", "sampler"), ("cnn", "cnn|in"), ("unet", "unet")], rates, marks)
    cache = X.cache_tag(F.col("p_brand"), F.col("p_type"), F.col("p_size"), rates["sampler"], F.col("p_retailprice") / 68731)
    return t.read("part").select("p_partkey", run.alias("run"), cache.alias("cache"))


add("h7_run_and_cache_tags", tags_of_runs, "",
    """WITH p AS (SELECT *, CASE WHEN p_partkey % 4 <> 0 THEN p_size/4e0 END AS fs FROM part)
       SELECT p_partkey, coalesce(nullif(concat_ws('_', CASE WHEN p_partkey % 2 = 0 THEN 'sampler' || coalesce(replace(CAST(fs AS VARCHAR), '.', 'p'), 'raw') || CASE WHEN p_partkey % 8 = 0 THEN '_ms' || p_partkey % 7 ELSE '' END || CASE WHEN p_partkey % 16 = 0 THEN '_c0y' ELSE '' END END,
         CASE WHEN p_partkey % 3 = 0 THEN 'cnn' || CASE WHEN p_partkey % 9 <> 0 THEN p_size || 'p0' ELSE 'in' END || CASE WHEN p_partkey % 6 = 0 THEN '_nodisc' ELSE '' END END, CASE WHEN p_partkey % 5 = 0 THEN 'unet' END), ''), 'no_methods') AS run,
         p_brand || '_s' || replace(replace(p_type, '.', 'p'), ' ', '_') || '_ms' || p_size || '_rs' || coalesce(replace(printf('%g', fs), '.', 'p'), 'raw') || '_bm' || replace(printf('%.3g', p_retailprice/68731e0), '.', 'p') AS cache FROM p""")
add("f2_natural_sort", lambda t: t.read("part").select("p_brand").distinct().select("p_brand", F.row_number().over(W.orderBy(X.natural_key(F.col("p_brand")))).alias("place")), "",
    "SELECT p_brand, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
