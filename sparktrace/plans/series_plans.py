"""Queries of joins and of operators on ordered series."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.functions import text as X
from sparktrace.operators import artefacts as A
from sparktrace.operators import match as M
from sparktrace.operators import reshape as R
from sparktrace.operators import series as S
from sparktrace.plans.registry import add

TRIAL = ["dataset", "trial"]
FS = "fs AS (SELECT dataset, trial, 1/median(d) AS fs FROM (SELECT dataset, trial, t - lag(t) OVER (PARTITION BY dataset, trial ORDER BY i) AS d FROM samples) WHERE d > 0 GROUP BY ALL)"
SEG = FS + """, seg AS (SELECT * EXCLUDE (g), sum(g) OVER (PARTITION BY dataset, trial ORDER BY i) AS seg FROM (
  SELECT s.dataset, s.trial, i, t, y, CASE WHEN t - lag(t) OVER (PARTITION BY s.dataset, s.trial ORDER BY i) > 4/fs THEN 1 ELSE 0 END AS g FROM samples s JOIN fs ON s.trial = fs.trial AND s.dataset = fs.dataset))"""


def segments(t):
    return S.gap_segments(t.samples, S.sampling_rate(t.samples))


def pieces(t):
    """Three windows in every trial."""
    b = R.bounds(t.samples)
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    w = b.select(*TRIAL, "first_t", (F.col("last_t") - F.col("first_t")).alias("d"), k)
    return w.select(*TRIAL, "k", (F.col("first_t") + F.col("k") * F.col("d") / 3).alias("start_s"), (F.col("first_t") + (F.col("k") + 1) * F.col("d") / 3).alias("end_s"))


PIECES = "b AS (SELECT dataset, trial, min(t) AS f, max(t) AS l FROM samples GROUP BY ALL), pieces AS (SELECT dataset, trial, k, f + k*(l - f)/3 AS start_s, f + (k + 1)*(l - f)/3 AS end_s FROM b, (VALUES (0), (1), (2)) v(k))"

add("c1_assign_spikes", lambda t: M.assign_spikes(t.samples, t.spikes), "samples spikes",
    """WITH nx AS (SELECT dataset, trial, i, t, lead(t) OVER (PARTITION BY dataset, trial ORDER BY i) AS u FROM samples)
       SELECT x.dataset, x.trial, x.i, count(s.s) AS n FROM nx x LEFT JOIN spikes s ON s.trial = x.trial AND s.dataset = x.dataset AND s.s > x.t AND s.s <= x.u GROUP BY ALL""")
add("c2_low_activity_mask", lambda t: M.low_activity_mask(t.samples, t.spikes, 12.0), "samples spikes",
    "SELECT x.dataset, x.trial, x.i, coalesce(min(abs(x.t - s.s)) >= 12, true) AS low FROM samples x LEFT JOIN spikes s ON s.trial = x.trial AND s.dataset = x.dataset GROUP BY ALL")
add("c3_match_segment_to_window", lambda t: M.match_segment(S.segment_bounds(segments(t)), pieces(t)), "samples",
    f"""WITH {SEG}, {PIECES}, sb AS (SELECT dataset, trial, seg, min(t) AS a, max(t) AS z, count(*) OVER (PARTITION BY dataset, trial) AS ns FROM seg GROUP BY dataset, trial, seg),
       m AS (SELECT p.dataset, p.trial, p.k, sb.seg, row_number() OVER (PARTITION BY p.dataset, p.trial, p.k ORDER BY least(end_s, z) - greatest(start_s, a) DESC, seg) AS r
             FROM pieces p JOIN sb ON p.trial = sb.trial AND p.dataset = sb.dataset WHERE (ns = 3 AND sb.seg = p.k) OR (ns <> 3 AND least(end_s, z) - greatest(start_s, a) > 0))
       SELECT p.dataset, p.trial, p.k, m.seg FROM pieces p LEFT JOIN m ON p.trial = m.trial AND p.dataset = m.dataset AND p.k = m.k AND m.r = 1""")
def shifted(t):
    """Windows of thirds whose numbers are turned by one, so the segment of a window's place may not touch it; not set in some trials."""
    w = pieces(t).withColumn("k", (F.col("k") + 1) % 3)
    return w.withColumn("start_s", F.when(F.col("trial") % 11 > 0, F.col("start_s")))


add("c3_match_touching_segment", lambda t: M.match_segment(S.segment_bounds(segments(t)), shifted(t), touching=True), "samples",
    f"""WITH {SEG}, {PIECES}, sh AS (SELECT dataset, trial, (k + 1) % 3 AS k, CASE WHEN trial % 11 > 0 THEN start_s END AS start_s, end_s FROM pieces), sb AS (SELECT dataset, trial, seg, min(t) AS a, max(t) AS z, count(*) OVER (PARTITION BY dataset, trial) AS ns FROM seg GROUP BY dataset, trial, seg),
       m AS (SELECT p.dataset, p.trial, p.k, sb.seg, ns = 3 AND sb.seg = p.k AND z >= start_s AND a <= end_s AS own, least(end_s, z) - greatest(start_s, a) AS o FROM sh p JOIN sb ON p.trial = sb.trial AND p.dataset = sb.dataset WHERE start_s IS NOT NULL),
       r AS (SELECT *, row_number() OVER (PARTITION BY dataset, trial, k ORDER BY own DESC, o DESC, seg) AS r FROM m WHERE own OR o > 0)
       SELECT p.dataset, p.trial, p.k, r.seg FROM sh p LEFT JOIN r ON p.trial = r.trial AND p.dataset = r.dataset AND p.k = r.k AND r.r = 1""")
add("c4_snap_window_to_samples", lambda t: M.snap_windows(t.samples, t.windows), "samples windows",
    """WITH e AS (SELECT dataset, trial, 'a' AS e, start_s AS x FROM windows WHERE start_s IS NOT NULL UNION ALL SELECT dataset, trial, 'z', end_s FROM windows WHERE end_s IS NOT NULL),
       n AS (SELECT e.dataset, e.trial, e, arg_min(t, [abs(t - x), t]) AS t FROM e JOIN samples s ON s.trial = e.trial AND s.dataset = e.dataset GROUP BY ALL)
       SELECT dataset, trial, round(max(CASE WHEN e = 'a' THEN t END), 6) AS start_s, round(max(CASE WHEN e = 'z' THEN t END), 6) AS end_s FROM n GROUP BY ALL""")
add("c5_missing_windows", lambda t: M.missing_windows(t.samples.select(*TRIAL).distinct(), t.windows), "windows", "SELECT dataset, trial FROM windows WHERE start_s IS NULL OR end_s IS NULL")


def specs(t):
    return M.parse_series(t.spark.createDataFrame([(s,) for s in ("first = sampler@A", " any=sampler", "unet ", "cnn@R", "")], "spec string"))


add("c6_resolve_series", lambda t: M.resolve_series(t.trialwise, specs(t)).groupBy("method", "run", "key").agg(F.count("*").alias("n")), "trialwise",
    "SELECT method, run, CASE WHEN method = 'sampler' AND run = 'A' THEN 'first' WHEN method = 'sampler' THEN 'any' WHEN method = 'cnn' THEN 'cnn@R' ELSE 'unet' END AS key, count(*) AS n FROM trialwise WHERE method IN ('sampler', 'unet') OR (method = 'cnn' AND run = 'R') GROUP BY ALL")
add("c7_common_trials", lambda t: M.common_trials(t.trialwise.where("correlation is not null"), ["trial"], F.col("method"), 3), "trialwise", "SELECT trial FROM trialwise WHERE correlation IS NOT NULL GROUP BY trial HAVING count(DISTINCT method) = 3")


def noise_models(t):
    return t.spark.range(2, 9).select(F.lit("universal").alias("model"), F.col("id").alias("noise_level"))


add("c8_route_by_noise_level", lambda t: M.route_by_noise(t.samples.groupBy(*TRIAL).agg((F.stddev_pop("y") / 4).alias("noise")), noise_models(t)).select(*TRIAL, "noise_level"), "samples",
    "SELECT dataset, trial, CAST(least(8, greatest(2, floor(stddev_pop(y)/4 + 0.5))) AS BIGINT) AS noise_level FROM samples GROUP BY ALL")


def cached(t, methods=None):
    """Orders as manifest entries: with and without a tag and a key; results under tags and keys, some of them signatures."""
    config = F.create_map(F.lit("status"), F.col("o_orderstatus"))
    entries = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("dataset"), F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderkey") % 3 == 0, "None").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")).alias("cache_tag"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("cache_key"), config.alias("config"))
    keys = t.read("orders").groupBy(F.col("o_orderstatus").alias("tag"), F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"))
    signed = t.read("orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("tag"), X.config_signature(config).alias("key")).agg((-F.count("*")).alias("n"))
    return M.resolve_cached(entries, keys.union(signed), methods)


CACHED = """e AS (SELECT o_orderkey, o_custkey AS dataset, o_orderstatus AS method, o_orderpriority AS label, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS tag, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE substr(sha256('{"status":"' || o_orderstatus || '"}'), 1, 16) END AS key FROM orders),
  r AS (SELECT o_orderstatus AS tag, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT o_orderstatus, substr(sha256('{"status":"' || o_orderstatus || '"}'), 1, 16), -count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)"""
add("c9_resolve_cached_results", lambda t: cached(t, ["F", "5-LOW"]).select("o_orderkey", "tag", "key", "n", "resolved"), "", f"WITH {CACHED} SELECT o_orderkey, e.tag, e.key, n, n IS NOT NULL AS resolved FROM e LEFT JOIN r USING (tag, key) WHERE method = 'F' OR label = '5-LOW'")
add("c9_unresolved_entries", lambda t: M.unresolved(cached(t)).groupBy("dataset", "method").agg(F.count("*").alias("n")), "", f"WITH {CACHED} SELECT dataset, method, count(*) AS n FROM e LEFT JOIN r USING (tag, key) WHERE n IS NULL GROUP BY ALL".replace("count(*) AS n FROM e LEFT JOIN r USING (tag, key) WHERE n IS NULL", "count(*) AS n FROM e LEFT JOIN (SELECT tag, key, n AS found FROM r) r USING (tag, key) WHERE found IS NULL"))


def stored(t):
    """Suppliers as files of two methods' folders: some without a key, some of another dataset that may be their own cache tag, some named like their key."""
    config = F.create_map(F.lit("nation"), (F.col("s_nationkey") % 5).cast("string"))
    k = F.col("s_suppkey")
    own = X.config_signature(config)
    return t.read("supplier").select(
        F.when(k % 2 == 0, "sampler").otherwise("unet").alias("method"), (k % 3).cast("string").alias("folder"), F.when(k % 3 != 1, own).alias("key"), config.alias("config"), F.when(k % 4 == 0, "other").otherwise((k % 3).cast("string")).alias("dataset"),
        F.when(k % 8 == 0, "other").alias("cache_tag"), F.when(k % 5 < 3, "BUILDING").otherwise("MACHINERY").alias("trace_hash"), F.when(k % 7 == 0, F.concat(own, F.lit(".json"))).otherwise(F.concat("s_name", F.lit(".json"))).alias("file"), k.alias("supplier"),
    )


def wanted(t):
    key = X.config_signature(F.create_map(F.lit("nation"), (F.col("c_nationkey") % 5).cast("string")))
    return t.read("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "sampler").otherwise("unet").alias("method"), (F.col("c_custkey") % 3).cast("string").alias("dataset"), key.alias("key"), F.col("c_mktsegment").alias("trace_hash"))


def lookup_sql(trace: str) -> str:
    sign = lambda c: f"substr(sha256('{{\"nation\":\"' || {c} % 5 || '\"}}'), 1, 16)"
    return f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 2 AS m, s_suppkey % 3 AS folder, {sign("s_nationkey")} AS key, CASE WHEN s_suppkey % 7 = 0 THEN {sign("s_nationkey")} ELSE s_name END AS name, CASE WHEN s_suppkey % 5 < 3 THEN 'BUILDING' ELSE 'MACHINERY' END AS trace FROM supplier),
       c AS (SELECT c_custkey AS id, c_custkey % 2 AS m, c_custkey % 3 AS folder, {sign("c_nationkey")} AS key, c_mktsegment AS trace FROM customer),
       f AS (SELECT c.id, s.name, s.k, c.key, EXISTS (SELECT 1 FROM s x WHERE x.m = c.m AND x.folder = c.folder AND x.name = c.key) AS alone FROM c JOIN s ON s.m = c.m AND s.folder = c.folder AND s.key = c.key AND {trace} AND (s.k % 4 <> 0 OR s.k % 8 = 0))
       SELECT id, min(name) || '.json' AS file FROM f WHERE NOT alone OR name = key GROUP BY id"""


add("c10_lookup_result", lambda t: M.lookup_result(wanted(t), stored(t)).select("id", "file"), "", lookup_sql("s.trace = c.trace"))
add("c10_lookup_any_trace", lambda t: M.lookup_result(wanted(t), stored(t), True).select("id", "file"), "", lookup_sql("true"))
add("c11_match_run_overlay", lambda t: M.match_overlay(
    t.read("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("run"), F.col("c_mktsegment").alias("label"), F.format_string("n%d_epoch%d_s1_ms2", "c_nationkey", F.col("c_custkey") % 2).alias("tag"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 4).alias("trial"), F.when(F.col("c_custkey") % 6 == 0, F.lit("n1_epoch1")).alias("epoch")),
    t.read("supplier").select((F.col("s_suppkey") % 3).alias("run"), F.when(F.col("s_suppkey") % 9 == 0, "BUILDING").otherwise(F.col("s_name")).alias("label"), F.format_string("n%d_epoch%d_s1_ms2", "s_nationkey", F.col("s_suppkey") % 2).alias("tag"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 4).alias("trial"), F.when(F.col("s_suppkey") % 7 == 0, F.lit("n1_epoch1")).alias("epoch"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("display"))), "",
    """WITH b AS (SELECT s_suppkey % 3 AS run, CASE WHEN s_suppkey % 9 = 0 THEN 'BUILDING' ELSE s_name END AS label, 'n' || s_nationkey || '_epoch' || s_suppkey % 2 AS tag, nullif(s_suppkey % 4, 0) AS trial, CASE WHEN s_suppkey % 7 = 0 THEN 'n1_epoch1' END AS epoch, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'n' || s_nationkey || '_epoch' || s_suppkey % 2 || '_s1_ms2' END AS shown FROM supplier),
       a AS (SELECT c_custkey AS id, c_custkey % 3 AS run, c_mktsegment AS label, 'n' || c_nationkey || '_epoch' || c_custkey % 2 AS tag, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 END AS trial, CASE WHEN c_custkey % 6 = 0 THEN 'n1_epoch1' END AS epoch FROM customer),
       m AS (SELECT id, shown AS match, CASE WHEN a.label = b.label THEN 0 WHEN a.tag = b.tag AND a.trial IS NOT DISTINCT FROM b.trial AND a.epoch IS NOT DISTINCT FROM b.epoch THEN 1 WHEN coalesce(a.epoch, a.tag) = coalesce(b.epoch, b.tag) THEN 2 END AS how FROM a JOIN b ON a.run = b.run)
       SELECT id, match, how FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY how, match) AS r FROM m WHERE how IS NOT NULL) WHERE r = 1""")


def artefacts(t):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "traj").when(F.col("l_linenumber") % 3 == 1, "param").otherwise("logp")
    return t.read("lineitem").select(F.col("l_suppkey").alias("tag"), F.col("l_returnflag").alias("parent"), (F.col("l_orderkey") % 50).alias("trial"), kind.alias("kind"))


add("c12_complete_artefact_set", lambda t: A.sets_with_trials(artefacts(t)), "",
    """WITH s AS (SELECT l_suppkey AS tag, l_returnflag AS parent, l_orderkey % 50 AS trial, count_if(l_linenumber % 3 = 0) AS traj, count_if(l_linenumber % 3 = 1) AS param, count(*) AS n FROM lineitem GROUP BY ALL),
       p AS (SELECT tag, parent, count_if(traj > 0 AND param > 0) AS complete, CAST(sum(traj) AS BIGINT) AS traj, CAST(sum(param) AS BIGINT) AS param, CAST(sum(n) AS BIGINT) AS files FROM s GROUP BY ALL)
       SELECT tag, complete, required, files, parent FROM (SELECT *, traj + param AS required, row_number() OVER (PARTITION BY tag ORDER BY traj + param DESC, files DESC, parent DESC) AS r FROM p WHERE traj > 0 AND param > 0) WHERE r = 1""")


def tag_sets(t):
    """Complete sets of parts of the customers' tags with an epoch, looked up by tags that lack one, or its trial."""
    sets = t.read("customer").where("c_custkey % 3 <> 0").select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit("_epoch2")).otherwise(F.lit(""))).alias("tag"), F.col("c_custkey").alias("parent"))
    tags = t.read("customer").select(F.concat("c_name", F.when(F.col("c_custkey") % 4 < 2, F.lit("_epoch2_trial1")).otherwise(F.lit("_epoch2"))).alias("tag"))
    return A.sets_of_tags(tags, sets)


add("c12_sets_of_tags", tag_sets, "",
    "SELECT c_name || CASE WHEN c_custkey % 4 < 2 THEN '_epoch2_trial1' ELSE '_epoch2' END AS tag, c_name || CASE WHEN c_custkey % 2 = 0 THEN '_epoch2' ELSE '' END AS found_as, c_custkey AS parent FROM customer WHERE c_custkey % 3 <> 0")


def customer_tags(t):
    """Tags `Customer#000000_<number>_s1_ms2`, some the stem itself, some with the number run together."""
    n, k = F.substring("c_name", 16, 3), F.col("c_custkey")
    tail = F.when(k % 7 == 0, F.lit("")).when(k % 5 == 0, F.concat(n, F.lit("_x"))).otherwise(F.concat(F.lit("_"), n, F.lit("_s1_ms2")))
    return t.read("customer").select(F.concat(F.substring("c_name", 1, 15), tail).alias("tag"), F.when(k % 2 == 0, k % 5).alias("trial"))


def customer_stems(t):
    """Stems that are whole parts of tags, and ones that end inside a part, which are no tag's."""
    names = t.read("customer")
    stem = F.substring("c_name", 1, 15)
    n = F.substring("c_name", 16, 3)
    return names.select(stem.alias("stem")).union(names.select(F.substring("c_name", 1, 14))).union(names.select(F.concat(stem, F.lit("_"), F.substring("c_name", 16, 2)))).union(names.where("c_custkey % 3 = 0").select(F.concat(stem, F.lit("_"), n))).distinct()


TAGS = """c AS (SELECT substr(c_name, 1, 15) AS s, substr(c_name, 16, 3) AS n, c_custkey AS k FROM customer), sm AS (SELECT s AS stem FROM c UNION SELECT substr(s, 1, 14) FROM c UNION SELECT s || '_' || substr(n, 1, 2) FROM c UNION SELECT s || '_' || n FROM c WHERE k % 3 = 0),
  tg AS (SELECT s || CASE WHEN k % 7 = 0 THEN '' WHEN k % 5 = 0 THEN n || '_x' ELSE '_' || n || '_s1_ms2' END AS tag, CASE WHEN k % 2 = 0 THEN k % 5 END AS trial FROM c),
  r AS (SELECT tag, trial, (SELECT stem FROM sm WHERE tag = stem OR starts_with(tag, stem || '_') ORDER BY length(stem) DESC LIMIT 1) AS stem FROM tg), e AS (SELECT *, stem || '_epoch' || (coalesce(trial, 0) + 1) AS epoch FROM r WHERE stem IS NOT NULL)"""
add("c13_remap_tags_to_epochs", lambda t: A.remap_tags(customer_tags(t), customer_stems(t)), "", f"WITH {TAGS} SELECT tag, trial, stem, epoch FROM e")
add("c13_remap_tags_to_valid_epochs", lambda t: A.remap_tags(customer_tags(t), customer_stems(t), customer_stems(t).select(F.explode(F.array(*[F.concat("stem", F.lit(f"_epoch{k}")) for k in (1, 3)])).alias("epoch")).where(~F.col("epoch").endswith("7_epoch1"))), "",
    f"""WITH {TAGS}, v AS (SELECT stem || '_epoch' || k AS epoch FROM sm, (VALUES (1), (3)) x(k) WHERE NOT ends_with(stem || '_epoch' || k, '7_epoch1'))
       SELECT tag, trial, stem, CASE WHEN epoch IN (SELECT epoch FROM v) THEN epoch ELSE stem || '_epoch1' END AS epoch FROM e WHERE epoch IN (SELECT epoch FROM v) OR stem || '_epoch1' IN (SELECT epoch FROM v)""")
add("c14_align_components", lambda t: M.align_components(t.posterior.select("tag", "sample", "bin", "b"), t.posterior.where("bin < 10").select("tag", "sample", "bin", "c"), ["tag", "sample", "bin"]), "posterior",
    "SELECT tag, sample, bin, round(b, 6) AS b, round(c, 6) AS c FROM posterior WHERE bin < 10")
add("c15_sweep_grid", lambda t: M.sweep_grid(t.read("region").select(F.col("r_regionkey").cast("double").alias("rate")), t.read("nation").where("n_nationkey < 3").select((F.col("n_nationkey") / 2).alias("smooth")), t.read("nation").where("n_nationkey < 4").select((F.col("n_nationkey") / 10).alias("duty")), t.read("supplier").select(F.col("s_suppkey").alias("cell")), 11000, 100), "",
    """SELECT *, 11000 + combo*100 + cell AS seed FROM (SELECT *, row_number() OVER (ORDER BY rate, smooth, duty) - 1 AS combo FROM
         (SELECT CAST(r_regionkey AS DOUBLE) AS rate FROM region), (SELECT n_nationkey/2e0 AS smooth FROM nation WHERE n_nationkey < 3), (SELECT n_nationkey/10e0 AS duty FROM nation WHERE n_nationkey < 4)), (SELECT s_suppkey AS cell FROM supplier)""")
add("c15_parameter_specs", lambda t: M.parameter_specs([9.0, 12.5], [1.3, 2.0, 0.00001], [0.35], t.read("supplier").select((F.col("s_suppkey") - 1).alias("place"), F.concat(F.lit("/x/param_samples_"), F.regexp_replace("s_name", "#", "_"), F.lit(".dat")).alias("name")), "my run/1", 11000, 100), "",
    """WITH c AS (SELECT *, row_number() OVER (ORDER BY a, b) - 1 AS combo FROM (VALUES (0, 9e0, '9'), (1, 125e-1, '12p5')) r(a, rate, rt), (VALUES (0, 13e-1, '1p3'), (1, 2e0, '2'), (2, 1e-5, '1e-05')) s(b, smooth, st)), i AS (SELECT *, 11000 + combo*100 AS seed_base, 'my_run_1_r' || rt || '_s' || st || '_d0p35_sb' || (11000 + combo*100) AS combo_id FROM c)
       SELECT combo, combo_id, rate, round(smooth, 6) AS smooth, 35e-2 AS duty, seed_base, s_suppkey - 1 AS place, 'bio_ml_' || replace(s_name, '#', '_') || '__' || combo_id AS tag, seed_base + s_suppkey - 1 AS noise_seed, round(1/(SELECT count(*) FROM supplier), 6) AS noise_fraction FROM supplier, i""")
add("c16_resolve_model_by_tag", lambda t: M.model_by_tag(t.read("orders").select(F.col("o_orderkey").alias("model"), (F.col("o_orderkey") % 4 != 0).alias("has_checkpoint"), F.col("o_orderstatus").alias("run_tag"), F.split("o_orderpriority", "-").alias("synthetic")), "LOW").select("model"), "",
    "SELECT o_orderkey AS model FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderpriority LIKE '%-LOW'")

add("e1_gap_segments", lambda t: segments(t).select(*TRIAL, "i", "seg"), "samples", f"WITH {SEG} SELECT dataset, trial, i, CAST(seg AS BIGINT) AS seg FROM seg")
add("e2_gap_segments_resetting", lambda t: S.gap_segments_resetting(t.samples).select(*TRIAL, "i", "seg"), "samples",
    """WITH d AS (SELECT dataset, trial, i, t - lag(t) OVER (PARTITION BY dataset, trial ORDER BY i) AS d FROM samples), m AS (SELECT dataset, trial, greatest(5*median(d), 1e-9) AS lim FROM d WHERE d > 0 GROUP BY ALL)
       SELECT d.dataset, d.trial, i, CAST(sum(CASE WHEN d <= 0 OR d > lim THEN 1 ELSE 0 END) OVER (PARTITION BY d.dataset, d.trial ORDER BY i) AS BIGINT) AS seg FROM d JOIN m ON d.trial = m.trial AND d.dataset = m.dataset""")
add("e3_segment_bounds", lambda t: S.segment_bounds(segments(t)), "samples", f"WITH {SEG} SELECT dataset, trial, CAST(seg AS BIGINT) AS seg, round(min(t), 6) AS seg_start, round(max(t), 6) AS seg_end, count(*) AS n FROM seg GROUP BY ALL")


def kernel(sigma: float) -> str:
    r = S.radius(sigma)
    return f"ker AS (SELECT k, exp(-0.5e0*(k/{sigma!r}::DOUBLE)*(k/{sigma!r}::DOUBLE)) / sum(exp(-0.5e0*(k/{sigma!r}::DOUBLE)*(k/{sigma!r}::DOUBLE))) OVER () AS w FROM (SELECT unnest(range(-{r}, {r + 1}))::DOUBLE AS k))"


REFLECT = "CASE WHEN ((i + k) % (2*n) + 2*n) % (2*n) < n THEN ((i + k) % (2*n) + 2*n) % (2*n) ELSE 2*n - 1 - ((i + k) % (2*n) + 2*n) % (2*n) END"
add("e4_gaussian_smooth", lambda t: S.gaussian_smooth(t.wide, 1.5).select(*TRIAL, F.posexplode("y").alias("i", "y")), "frames",
    f"""WITH {kernel(1.5)}, p AS (SELECT f.dataset, f.trial, f.i, w, CAST({REFLECT} AS BIGINT) AS j FROM (SELECT *, count(*) OVER (PARTITION BY dataset, trial) AS n FROM frames) f, (SELECT CAST(k AS BIGINT) AS k, w FROM ker))
       SELECT p.dataset, p.trial, p.i, round(sum(w*g.y), 6) + 0 AS y FROM p JOIN frames g ON g.trial = p.trial AND g.dataset = p.dataset AND g.i = p.j GROUP BY ALL""")
CAUSAL = """x AS (SELECT i, (i - 101)/30e0 AS x, 10/30e0 AS m FROM (SELECT unnest(range(0, 199)) AS i)), pdf AS (SELECT i, CASE WHEN x > 0 THEN exp(-power(x - m, 2)/(2*x*m*m))/sqrt(2*pi()*power(x, 3)) ELSE 0 END AS f FROM x),
  top AS (SELECT CAST(trunc((99 - arg_max(i, f))/15e-1) AS BIGINT) AS s, sum(f) AS total FROM pdf), ker AS (SELECT ((i + s) % 199 + 199) % 199 AS i, f/total AS w FROM pdf, top)"""
add("e5_causal_smooth", lambda t: S.causal_smooth(t.wide, 30.0).select(*TRIAL, F.posexplode("y").alias("i", "y")), "frames",
    f"WITH {CAUSAL} SELECT a.dataset, a.trial, a.i, round(sum(w*b.y), 6) + 0 AS y FROM frames a JOIN frames b ON b.trial = a.trial AND b.dataset = a.dataset JOIN ker ON ker.i = a.i - b.i + 99 GROUP BY ALL")
add("e6_sliding_frames", lambda t: S.sliding_frames(t.frames, 16, 0.5).where("frame is not null").select(*TRIAL, "i", F.get("frame", 0).alias("first"), F.get("frame", 15).alias("last"), F.aggregate("frame", F.lit(0.0), lambda a, x: a + x).alias("total")), "frames",
    """SELECT dataset, trial, i, round(a, 6) AS first, round(z, 6) AS last, round(s, 6) + 0 AS total FROM (SELECT dataset, trial, i, lag(y, 7) OVER w AS a, lead(y, 8) OVER w AS z, sum(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 8 FOLLOWING) AS s FROM frames WINDOW w AS (PARTITION BY dataset, trial ORDER BY i)) WHERE a IS NOT NULL AND z IS NOT NULL""")
add("e6_centred_frames", lambda t: S.centred_frames(t.frames, 16).select(*TRIAL, "i", F.size("frame").alias("n"), F.get("frame", 0).alias("first"), F.get("frame", 15).alias("last"), F.aggregate("frame", F.lit(0.0), lambda a, x: a + x).alias("total")), "frames",
    """SELECT dataset, trial, i, 16 AS n, round(coalesce(lag(y, 8) OVER w, 0), 6) + 0 AS first, round(coalesce(lead(y, 7) OVER w, 0), 6) + 0 AS last, round(sum(y) OVER (w ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING), 6) + 0 AS total FROM frames WINDOW w AS (PARTITION BY dataset, trial ORDER BY i)""")
add("e7_overlap_add", lambda t: S.overlap_add(t.frames.select(*TRIAL, "i", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("y") * (k + 1)).alias("frame")), 8), "frames",
    """SELECT dataset, trial, p AS i, round(sum(v)/8, 6) + 0 AS y FROM (SELECT dataset, trial, i + k - 4 AS p, y*(k + 1) AS v, count(*) OVER (PARTITION BY dataset, trial)/8 AS n FROM frames, (SELECT unnest(range(0, 8)) AS k)) WHERE p >= 0 AND p < n GROUP BY ALL""")
add("e8_dilate_mask", lambda t: t.frames.withColumn("on", S.dilate(t.frames, F.col("y") > 0.2, 3, 3)).select(*TRIAL, "i", "on"), "frames",
    "SELECT dataset, trial, i, max(CASE WHEN y > 0.2e0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, trial ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS on FROM frames".replace(" AS on", ' AS "on"'))
add("e9_support_runs", lambda t: S.support_runs(t.frames, 0.2, 2), "frames",
    """WITH o AS (SELECT *, max(CASE WHEN y > 0.2e0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, trial ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM frames), r AS (SELECT *, i - row_number() OVER (PARTITION BY dataset, trial, o ORDER BY i) AS r FROM o)
       SELECT dataset, trial, min(i) AS first, max(i) + 1 AS stop, round(sum(y), 6) + 0 AS total FROM r WHERE o = 1 GROUP BY dataset, trial, r""")
add("e10_active_slices", lambda t: S.active_slices(t.frames, 0.05, 3), "frames",
    """WITH r AS (SELECT *, i - row_number() OVER (PARTITION BY dataset, trial, y >= 0.05e0 ORDER BY i) AS r, max(i) OVER (PARTITION BY dataset, trial) AS l FROM frames), q AS (SELECT *, min(i) OVER (PARTITION BY dataset, trial, r) AS a, max(i) OVER (PARTITION BY dataset, trial, r) AS z FROM r WHERE y >= 0.05e0)
       SELECT dataset, trial, min(i) AS first, max(i) + 1 AS stop, round(sum(y), 6) + 0 AS total FROM q WHERE a > 0 AND z < l GROUP BY dataset, trial, a, (i - a)//3""")


def interp_sql(grid: str) -> str:
    return f"""{grid}, ends AS (SELECT dataset, trial, arg_min(y, i) AS y0, arg_max(y, i) AS y1 FROM samples GROUP BY ALL),
       n AS (SELECT g.*, a.t AS t0, a.y AS v0 FROM g ASOF LEFT JOIN samples a ON g.dataset = a.dataset AND g.trial = a.trial AND g.q >= a.t),
       m AS (SELECT n.*, b.t AS t1, b.y AS v1 FROM n ASOF LEFT JOIN samples b ON n.dataset = b.dataset AND n.trial = b.trial AND n.q <= b.t),
       o AS (SELECT m.*, CASE WHEN t0 IS NULL THEN y0 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0)*(q - t0)/(t1 - t0) END AS y FROM m JOIN ends e ON e.trial = m.trial AND e.dataset = m.dataset)"""


add("e11_interp_linear", lambda t: S.interpolate(t.samples, t.spikes.withColumn("q", F.col("s") + 0.5), "q").select(*TRIAL, "q", "y"), "samples spikes",
    f"WITH {interp_sql('g AS (SELECT dataset, trial, s + 0.5e0 AS q FROM spikes)')} SELECT dataset, trial, round(q, 6) AS q, round(y, 6) AS y FROM o")
GRID13 = "eb AS (SELECT dataset, trial, min(t) AS a, max(t) AS z, greatest(2, CAST(round_even((max(t) - min(t))*0.1e0, 0) AS BIGINT) + 1) AS n FROM samples GROUP BY ALL), g AS (SELECT dataset, trial, k, a + k*(z - a)/(n - 1) AS q FROM (SELECT *, unnest(range(0, n)) AS k FROM eb))"
add("e13_even_grid", lambda t: S.even_grid(t.samples, 0.1), "samples", f"WITH {GRID13} SELECT dataset, trial, k, round(q, 6) AS q FROM g")
add("e12_resample_to_fs", lambda t: S.resample_to(t.frames, 10.0), "frames",
    "SELECT dataset, trial, i//3 AS k, round(avg(t), 6) + 0 AS t, round(avg(y), 6) + 0 AS y FROM (SELECT *, count(*) OVER (PARTITION BY dataset, trial) AS n FROM frames) WHERE i//3 < n//3 GROUP BY dataset, trial, i//3")
add("e12_resample_grid", lambda t: S.resample_to(t.samples, 0.1), "samples",
    f"""WITH {FS}, how AS (SELECT dataset, trial, fs, CASE WHEN abs(fs - 0.1e0) <= 2e-3*0.1e0 THEN 'same' WHEN fs > 0.1e0 AND abs(fs/0.1e0 - round_even(fs/0.1e0, 0)) <= 1e-6 + 1e-5*round_even(fs/0.1e0, 0) THEN 'block' ELSE 'grid' END AS how, CAST(round_even(fs/0.1e0, 0) AS BIGINT) AS b FROM fs),
       {interp_sql(GRID13)}, lone AS (SELECT s.* FROM samples s WHERE NOT EXISTS (SELECT 1 FROM how h WHERE h.trial = s.trial AND h.dataset = s.dataset))
       SELECT o.dataset, o.trial, k, round(q, 6) AS t, round(y, 6) + 0 AS y FROM o JOIN how h ON h.trial = o.trial AND h.dataset = o.dataset WHERE how = 'grid'
       UNION ALL SELECT s.dataset, s.trial, i, round(t, 6), round(y, 6) + 0 FROM samples s JOIN how h ON h.trial = s.trial AND h.dataset = s.dataset WHERE how = 'same'
       UNION ALL SELECT dataset, trial, i, round(t, 6), round(y, 6) + 0 FROM lone
       UNION ALL SELECT dataset, trial, i//b, round(avg(t), 6), round(avg(y), 6) + 0 FROM (SELECT s.*, b, count(*) OVER (PARTITION BY s.dataset, s.trial) AS n FROM samples s JOIN how h ON h.trial = s.trial AND h.dataset = s.dataset WHERE how = 'block') WHERE i//b < n//b GROUP BY dataset, trial, i//b""")
GRID14 = "g0 AS (SELECT dataset, trial, start_s, end_s, CAST(ceil((end_s - start_s)*0.2e0) AS BIGINT) + 1 AS n FROM windows WHERE start_s IS NOT NULL), g AS (SELECT dataset, trial, start_s, k, start_s + k*(end_s - start_s)/greatest(n - 1, 1) AS q, n FROM (SELECT *, unnest(range(0, n)) AS k FROM g0))"
RATE14 = """x AS (SELECT s.dataset, s.trial, g0.n, (s - start_s)*0.2e0 AS x FROM spikes s JOIN g0 ON s.trial = g0.trial AND s.dataset = g0.dataset WHERE s BETWEEN start_s AND end_s),
       v AS (SELECT dataset, trial, k, sum(v) AS v FROM (SELECT dataset, trial, n, CAST(floor(x) AS BIGINT) AS k, 1 - (x - floor(x)) AS v FROM x UNION ALL SELECT dataset, trial, n, CAST(floor(x) AS BIGINT) + 1, x - floor(x) FROM x) WHERE k < n GROUP BY ALL)"""


def rates(t):
    return S.event_rates(S.event_grid(t.windows.where("start_s is not null"), 0.2), t.spikes)


add("e14_event_rate_grid", lambda t: rates(t).select(*TRIAL, "k", "q", "rate"), "spikes windows",
    f"WITH {GRID14}, {RATE14} SELECT g.dataset, g.trial, g.k, round(q, 6) AS q, round(coalesce(v, 0), 6) AS rate FROM g LEFT JOIN v ON g.trial = v.trial AND g.dataset = v.dataset AND g.k = v.k")
for how, place in (("round", "CAST(round_even(x, 0) AS BIGINT)"), ("floor", "CAST(floor(x) AS BIGINT)")):
    add(f"e14_event_rate_{how}_smoothed", lambda t, how=how: S.smooth_rows(S.event_rates(S.event_grid(t.windows.where("start_s is not null"), 0.2), t.spikes, how), TRIAL, 1.5, "rate").select(*TRIAL, "k", "rate"), "spikes windows",
        f"""WITH {GRID14}, {RATE14.split("v AS")[0].rstrip().rstrip(",")}, v AS (SELECT dataset, trial, {place} AS k, count(*) AS v FROM x WHERE {place} < n GROUP BY ALL), raw AS (SELECT g.dataset, g.trial, g.k, g.n, coalesce(v, 0) AS v FROM g LEFT JOIN v ON g.trial = v.trial AND g.dataset = v.dataset AND g.k = v.k),
            e AS (SELECT raw.*, d, exp(-0.5e0*power(d/15e-1, 2)) AS w, ((k + d) % (2*n) + 2*n) % (2*n) AS r FROM raw, (SELECT unnest(range(-6, 7)) AS d))
            SELECT e.dataset, e.trial, e.k, round(sum(w*b.v)/sum(w), 6) + 0 AS rate FROM e JOIN raw b ON b.trial = e.trial AND b.dataset = e.dataset AND b.k = CASE WHEN r < e.n THEN r ELSE 2*e.n - 1 - r END GROUP BY ALL""")
ALIGN = f"""{GRID14}, n AS (SELECT g.*, a.t AS t0, a.y AS v0, a.seg AS s0 FROM g ASOF LEFT JOIN seg a ON g.dataset = a.dataset AND g.trial = a.trial AND g.q >= a.t),
       m AS (SELECT n.*, b.t AS t1, b.y AS v1, b.seg AS s1 FROM n ASOF LEFT JOIN seg b ON n.dataset = b.dataset AND n.trial = b.trial AND n.q <= b.t)"""
add("e15_align_piecewise", lambda t: S.align_piecewise(segments(t), S.event_grid(t.windows.where("start_s is not null"), 0.2).select(*TRIAL, "k", "q")), "samples windows",
    f"WITH {SEG}, {ALIGN} SELECT dataset, trial, k, round(q, 6) AS q, round(CASE WHEN t0 = q THEN v0 WHEN s0 = s1 THEN v0 + (v1 - v0)*(q - t0)/(t1 - t0) END, 6) AS y FROM m")
add("e16_remap_timebase", lambda t: S.remap_timebase(t.frames, 127), "frames", "SELECT dataset, trial, k, round(k*(max(t)/126e0), 6) AS t FROM frames, (SELECT unnest(range(0, 127)) AS k) GROUP BY dataset, trial, k")
FOURIER = """n AS (SELECT *, count(*) OVER (PARTITION BY dataset, trial) AS n FROM frames), m AS (SELECT *, CAST(round_even(n/2e0, 0) AS BIGINT) AS m FROM n),
  f AS (SELECT dataset, trial, k, any_value(n) AS n, any_value(m) AS m, sum(y*cos(-2*pi()*k*i/n)) AS re, sum(y*sin(-2*pi()*k*i/n)) AS im FROM (SELECT *, unnest(range(0, m//2 + 1)) AS k FROM m) GROUP BY ALL),
  w AS (SELECT *, CASE WHEN k = 0 OR 2*k = m THEN 1 ELSE 2 END * CASE WHEN 2*k = m THEN 2 ELSE 1 END AS c, CASE WHEN 2*k = m THEN 0 ELSE im END AS im2 FROM f)"""
add("e17_fourier_resample", lambda t: S.fourier_resample(t.wide, 30.0, 15.0).select(*TRIAL, F.posexplode("y").alias("i", "y")), "frames",
    f"WITH {FOURIER} SELECT dataset, trial, j AS i, round(sum(c*(re*cos(2*pi()*k*j/m) - im2*sin(2*pi()*k*j/m)))/any_value(n), 6) + 0 AS y FROM (SELECT *, unnest(range(0, m)) AS j FROM w) GROUP BY dataset, trial, j")
add("e18_slice_by_cumulative_length", lambda t: S.slice_by_length(R.flatten_trials(t.samples), t.samples.groupBy(*TRIAL).agg(F.count("*").alias("n"))).select("dataset", "trial", "i", "t"), "samples",
    "SELECT dataset, trial, i, round(t, 6) AS t FROM samples")


def axis(t):
    return R.flatten_trials(t.samples).select("dataset", "k", "t")


def sliced(t):
    """Datasets with lengths of all their trials, with a hole in them (cut at gaps or by the expected length), or with none."""
    rank = t.samples.groupBy(*TRIAL).agg(F.count("*").alias("n"), F.min("t").alias("f")).withColumn("trial", F.row_number().over(W.partitionBy("dataset").orderBy("f")) - 1)
    lengths = rank.where("dataset % 3 = 0 or (dataset % 3 = 1 and trial <> 1)").select("dataset", "trial", "n")
    wanted = rank.select("dataset", F.explode(F.array(F.lit(0), F.lit(2), F.lit(500))).alias("trial"), F.lit(3).alias("expected")).distinct()
    return S.slice_trials(axis(t), lengths, wanted).groupBy("dataset", "trial").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("i").alias("last"))


add("e18_slice_trials", sliced, "samples",
    """WITH ax AS (SELECT dataset, t, row_number() OVER (PARTITION BY dataset ORDER BY t, trial, i) - 1 AS k FROM samples), sz AS (SELECT dataset, count(*) AS size FROM ax GROUP BY ALL),
       rk AS (SELECT dataset, n, row_number() OVER (PARTITION BY dataset ORDER BY f) - 1 AS trial FROM (SELECT dataset, trial, count(*) AS n, min(t) AS f FROM samples GROUP BY ALL)),
       ln AS (SELECT * FROM rk WHERE dataset % 3 = 0 OR (dataset % 3 = 1 AND trial <> 1)), ok AS (SELECT dataset FROM ln GROUP BY dataset HAVING max(trial) + 1 = count(*)),
       le AS (SELECT dataset, trial, n, sum(n) OVER (PARTITION BY dataset ORDER BY trial) AS stop FROM ln WHERE dataset IN (SELECT dataset FROM ok)),
       d AS (SELECT dataset, k, t - lag(t) OVER (PARTITION BY dataset ORDER BY k) AS d FROM ax), m AS (SELECT dataset, greatest(5*median(d), 1e-9) AS lim FROM d WHERE d > 0 GROUP BY ALL),
       sg AS (SELECT d.dataset, k, sum(CASE WHEN d <= 0 OR d > lim THEN 1 ELSE 0 END) OVER (PARTITION BY d.dataset ORDER BY k) AS seg FROM d JOIN m ON m.dataset = d.dataset), sb AS (SELECT dataset, seg, min(k) AS a, max(k) + 1 AS z FROM sg GROUP BY ALL),
       w AS (SELECT sz.dataset, size, trial FROM sz, (VALUES (0), (2), (500)) v(trial)),
       c AS (SELECT w.dataset, w.trial, size, CASE WHEN le.n IS NOT NULL AND le.stop - le.n < size THEN le.stop - le.n WHEN sb.a IS NOT NULL THEN sb.a WHEN w.trial*3 < size THEN w.trial*3 ELSE 0 END AS a,
             CASE WHEN le.n IS NOT NULL AND le.stop - le.n < size THEN le.stop WHEN sb.a IS NOT NULL THEN sb.z WHEN w.trial*3 < size THEN w.trial*3 + 3 ELSE size END AS z FROM w LEFT JOIN le ON le.dataset = w.dataset AND le.trial = w.trial LEFT JOIN sb ON sb.dataset = w.dataset AND sb.seg = w.trial)
       SELECT dataset, trial, CAST(least(z, size) - a AS BIGINT) AS n, CAST(a AS BIGINT) AS first, CAST(least(z, size) - a - 1 AS BIGINT) AS last FROM c""")
