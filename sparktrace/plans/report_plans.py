"""Queries of reports, rankings, upserts, catalogues and training sets."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.functions import text as X
from sparktrace.operators import artefacts as A
from sparktrace.operators import frames as N
from sparktrace.operators import match as M
from sparktrace.operators import noise_bank as NB
from sparktrace.operators import report as P
from sparktrace.operators import reshape as R
from sparktrace.operators import series as S
from sparktrace.operators import stats as D
from sparktrace.operators import train as K
from sparktrace.plans.registry import add
from sparktrace.plans.reshape_plans import MODEL_SQL, named
from sparktrace.sources import io as IO

TRIAL = ["dataset", "trial"]
CVS = "SELECT method, corr_sigma_ms, round(avg(correlation), 6) AS mean, round(CASE WHEN count(*) >= 2 THEN stddev_samp(correlation)/sqrt(count(*)) ELSE 0 END, 6) AS sem, count(*) AS n FROM {0} GROUP BY method, corr_sigma_ms"
add("d25_corr_vs_sigma", lambda t: P.corr_vs_sigma(t.trialwise, ["method"]), "trialwise", CVS.format("(SELECT * FROM trialwise WHERE correlation IS NOT NULL)"))
add("d25_corr_vs_sigma_by_dataset", lambda t: P.corr_vs_sigma(t.trialwise, ["method"], "dataset"), "trialwise", CVS.format("(SELECT method, corr_sigma_ms, avg(correlation) AS correlation FROM trialwise WHERE correlation IS NOT NULL GROUP BY method, corr_sigma_ms, dataset, smoothing, run)"))
add("d26_rank_series_at_anchor", lambda t: P.rank_at_anchor(P.corr_vs_sigma(t.trialwise, ["method", "run"]), ["method", "run"], 35.0), "trialwise",
    """WITH c AS (SELECT method, run, corr_sigma_ms AS x, avg(correlation) AS m FROM trialwise WHERE correlation IS NOT NULL GROUP BY ALL), y AS (SELECT a.method, a.run, a.m + (b.m - a.m)*5/10e0 AS score FROM c a JOIN c b ON a.method = b.method AND a.run = b.run AND a.x = 30 AND b.x = 40)
       SELECT method, run, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, method, run) AS place FROM y""")
PCT = ", ".join(f"round(quantile_cont(correlation, {q / 100}), 6) AS p{q}" for q in (5, 25, 50, 75, 95))
DIS = "WITH r AS ({0}), pl AS (SELECT method, row_number() OVER (ORDER BY median(correlation) DESC, method) AS place FROM r GROUP BY method) SELECT r.method, smoothing, count(*) AS n, " + PCT + ", any_value(place) AS place FROM r JOIN pl ON pl.method = r.method GROUP BY r.method, smoothing"
add("d27_score_distribution", lambda t: P.score_distribution(t.trialwise, ["method"], 30.0), "trialwise", DIS.format("SELECT * FROM trialwise WHERE correlation IS NOT NULL AND corr_sigma_ms = 30"))
add("d27_score_distribution_by_dataset", lambda t: P.score_distribution(t.trialwise, ["method"], 30.0, "dataset"), "trialwise", DIS.format("SELECT method, smoothing, avg(correlation) AS correlation FROM trialwise WHERE correlation IS NOT NULL AND corr_sigma_ms = 30 GROUP BY method, smoothing, dataset, run"))
add("d26_series_labels", lambda t: P.series_labels(t.trialwise.groupBy("method", "run").agg(F.count("*").alias("n")).where("not (method = 'cnn' and run <> 'A')"), "method", "run").select("method", "run", "shown"), "trialwise",
    "WITH m AS (SELECT DISTINCT method, run FROM trialwise WHERE NOT (method = 'cnn' AND run <> 'A')) SELECT method, run, CASE WHEN count(*) OVER (PARTITION BY method) > 1 THEN method || ' (' || run || ')' ELSE method END AS shown FROM m")
add("d28_run_dotplot_stats", lambda t: P.dotplot_stats(t.trialwise, ["run", "method", "smoothing"]), "trialwise",
    "SELECT run, method, smoothing, count(*) AS n, round(median(correlation), 6) AS median, round(quantile_cont(correlation, 0.25), 6) AS q1, round(quantile_cont(correlation, 0.75), 6) AS q3 FROM trialwise WHERE correlation IS NOT NULL GROUP BY ALL")
add("d29_directory_eval", lambda t: P.directory_eval(t.trialwise, "dataset"), "trialwise",
    "SELECT dataset, count(*) AS datasets, count(correlation) AS finite, round(avg(correlation), 6) AS mean, round(median(correlation), 6) AS median, min(correlation) AS min, max(correlation) AS max FROM trialwise GROUP BY dataset")


def models(t):
    rows = t.read("part").withColumn("name", named()).withColumn("score", F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice") % 97 / 97))
    return rows.select("p_partkey", "name", "score")


MODELS = f"md AS (SELECT p_partkey, {MODEL_SQL} AS name, CASE WHEN p_partkey % 13 <> 0 THEN (p_retailprice % 97)/97 END AS score, p_partkey % 9 <> 0 AS ok, CAST(p_size AS DOUBLE) AS k, CAST(p_partkey % 30 AS DOUBLE) AS rate, p_size % 5 + (p_partkey % 10)/10e0 AS smooth, (p_partkey % 7)/10e0 AS duty FROM part)"
add("d30_leaderboard", lambda t: P.leaderboard(models(t), "name", "score", key="p_partkey").select("name", "score", "k", "rate", "baseline"), "",
    f"WITH {MODELS}, a AS (SELECT name, round(score, 6) AS score, k, rate, false AS baseline FROM md WHERE ok ORDER BY md.score DESC NULLS LAST, name LIMIT 10), b AS (SELECT name, round(score, 6) AS score, CAST(NULL AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS rate, true AS baseline FROM md WHERE NOT ok ORDER BY name LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b")


def parsed(t):
    return models(t).select("p_partkey", "score", *[c.alias(k) for k, c in X.model_parameters(F.col("name")).items()]).where("k is not null")


add("d31_sweep_heatmap", lambda t: P.sweep_heatmap(parsed(t), "p_partkey", [0.1, 0.3, 0.5]).withColumnsRenamed({"0.1": "duty_1", "0.3": "duty_3", "0.5": "duty_5"}), "",
    f"WITH {MODELS} SELECT k, rate, round(smooth, 6) AS smooth, " + ", ".join(f"round(arg_max_null(score, p_partkey) FILTER (duty = {d}), 6) AS duty_{str(d)[-1]}" for d in (0.1, 0.3, 0.5)) + " FROM md WHERE ok GROUP BY k, rate, md.smooth")
def baselines(t):
    """The unparsed models; every fourth records a rate that is not its folder's."""
    return models(t).where("name like 'baseline%'").select("score", F.when(F.col("p_partkey") % 4 == 0, 10.0).otherwise(30.0).alias("rate"), F.lit(30.0).alias("folder_rate"))


add("d32_best_by_k", lambda t: P.best_by_k(parsed(t), baselines(t)), "",
    f"WITH {MODELS} SELECT k, round(max(score), 6) AS best, round(median(score), 6) AS median, count(*) AS n, (SELECT round(max(score), 6) FROM md WHERE NOT ok AND p_partkey % 4 <> 0) AS baseline FROM md WHERE ok GROUP BY k")
add("d33_timing_summary", lambda t: P.timing_summary(t.read("orders").select(F.col("o_orderpriority").alias("backend"), (F.col("o_totalprice") / 1000).alias("seconds")), "5-LOW"), "",
    """WITH p AS (SELECT o_orderpriority AS backend, count(*) AS n, avg(o_totalprice/1000) AS mean, median(o_totalprice/1000) AS median, min(o_totalprice/1000) AS min, max(o_totalprice/1000) AS max, CASE WHEN count(*) > 1 THEN stddev_pop(o_totalprice/1000) ELSE 0 END AS std FROM orders GROUP BY ALL)
       SELECT backend, n, round(mean, 6) AS mean, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std, round((SELECT mean FROM p WHERE backend = '5-LOW')/mean, 6) AS speed_up FROM p""")


add("d33_timing_against_the_first", lambda t: P.timing_summary(t.read("orders").select(F.col("o_orderpriority").alias("backend"), F.col("o_totalprice").alias("seconds"))).select("backend", "n", "speed_up"), "",
    "WITH p AS (SELECT o_orderpriority AS backend, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY ALL) SELECT backend, n, round((SELECT mean FROM p ORDER BY backend LIMIT 1)/mean, 6) AS speed_up FROM p")
add("f4_subset_by_name", lambda t: P.seeded_subset(t.read("part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 0.1, name="parts"), "",
    f"SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(('0x' || substr(sha256('parts|0.100000'), 1, 8))::BIGINT AS VARCHAR) || ':' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r <= greatest(1, ceil(n*0.1e0))")


def _entries(t):
    """Cache entries of the suppliers: tags with a valid epoch, with another one, and stems that only look alike (`rec1` and `rec12`)."""
    s, k = t.read("supplier"), F.col("s_suppkey")
    return s.select((k % 2).alias("folder"), F.concat(F.format_string("rec%d", "s_nationkey"), F.when(k % 3 == 0, F.concat(F.lit("_epoch"), (k % 5 + 1).cast("string"))).otherwise(F.lit("")), F.lit("_s1_ms2_id"), k.cast("string")).alias("tag"), F.concat(F.lit("k"), (k % 40).cast("string")).alias("key"), k.alias("k"))


def _targets(t, need_outputs: bool = False):
    """Files of the trials 0..3 of most entries, some without parameters; keys that exist already."""
    rows = _entries(t)
    kinds = F.explode(F.array(F.lit("traj"), F.lit("param"), F.lit("logp"))).alias("kind")
    files = rows.where("k % 4 <> 1").select("tag", "k", F.explode(F.sequence(F.lit(0), (F.col("k") % 4).cast("int"))).alias("trial"), F.lit("/out").alias("parent")).select("*", kinds)
    files = files.where("not (kind = 'param' and trial = 2 and k % 3 = 1)").select("tag", "parent", "kind", F.when(F.col("k") % 8 != 0, F.col("trial")).alias("trial"))
    epochs = t.read("nation").where("n_nationkey % 6 <> 5").select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("e"), "n_nationkey").where("not (n_nationkey % 4 = 3 and e = 1)").select(F.format_string("rec%d_epoch%d", "n_nationkey", "e").alias("epoch"))
    existing = t.read("nation").select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("folder"), F.format_string("k%d%s", "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("_trial1")).alias("key"))
    return A.import_targets(rows.drop("k"), epochs, files, existing, need_outputs)


def targets_sql(need: str) -> str:
    return f"""WITH e AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 2 AS folder, 'k' || s_suppkey % 40 AS key, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 + 1 END AS own, '_s1_ms2_id' || s_suppkey AS tail FROM supplier),
  v AS (SELECT n_nationkey AS n, x AS e FROM nation, (VALUES (1), (2), (3)) v(x) WHERE n_nationkey % 6 <> 5 AND NOT (n_nationkey % 4 = 3 AND x = 1)), st AS (SELECT DISTINCT n FROM v),
  t0 AS (SELECT k, unnest(range(0, k % 4 + 1)) AS trial FROM e WHERE k % 4 <> 1), f AS (SELECT k, kind, CASE WHEN k % 8 <> 0 THEN trial ELSE 0 END AS trial FROM t0, (VALUES ('traj'), ('param'), ('logp')) v(kind) WHERE NOT (kind = 'param' AND trial = 2 AND k % 3 = 1)),
  total AS (SELECT k, count(*) AS n FROM f GROUP BY k), bt AS (SELECT k, trial, count(*) AS n FROM f GROUP BY ALL HAVING count_if(kind = 'traj') > 0 AND count_if(kind = 'param') > 0),
  a AS (SELECT e.*, {need} AND total.k IS NULL AS unmatched, coalesce(total.n, 0) AS every, own IS NOT NULL AND EXISTS (SELECT 1 FROM v WHERE v.n = e.n AND v.e = own) AS direct, st.n IS NOT NULL AS stem FROM e LEFT JOIN total ON total.k = e.k LEFT JOIN st ON st.n = e.n),
  m AS (SELECT a.k, bt.trial, bt.n FROM a JOIN bt ON bt.k = a.k JOIN v ON v.n = a.n AND v.e = bt.trial + 1 WHERE stem AND NOT direct AND NOT unmatched AND own IS NULL),
  z AS (SELECT a.k, 0 AS trial, coalesce(bt.n, 0) AS n FROM a JOIN v ON v.n = a.n AND v.e = 1 LEFT JOIN bt ON bt.k = a.k AND bt.trial = 0 WHERE stem AND NOT direct AND NOT unmatched AND own IS NULL AND a.k NOT IN (SELECT k FROM m)),
  om AS (SELECT a.k, bt.trial, bt.n FROM a JOIN bt ON bt.k = a.k JOIN v ON v.n = a.n AND v.e = bt.trial + 1 WHERE stem AND NOT direct AND NOT unmatched AND own IS NOT NULL), oz AS (SELECT a.k, 0 AS trial, coalesce(bt.n, 0) AS n FROM a JOIN v ON v.n = a.n AND v.e = 1 LEFT JOIN bt ON bt.k = a.k AND bt.trial = 0 WHERE stem AND NOT direct AND NOT unmatched AND own IS NOT NULL AND a.k NOT IN (SELECT k FROM om)),
  tg AS (SELECT k, CAST(NULL AS BIGINT) AS trial, every AS n, false AS remapped FROM a WHERE direct AND NOT unmatched UNION ALL SELECT *, true FROM m UNION ALL SELECT *, true FROM z UNION ALL SELECT *, true FROM om UNION ALL SELECT *, true FROM oz),
  ex AS (SELECT 'k' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '_trial1' END AS key FROM nation),
  r AS (SELECT a.folder, 'rec' || a.n || CASE WHEN own IS NOT NULL THEN '_epoch' || own ELSE '' END || tail AS tag, a.key, unmatched, CASE WHEN tg.k IS NOT NULL THEN 'rec' || a.n || '_epoch' || CASE WHEN remapped THEN tg.trial + 1 ELSE own END END AS epoch, a.key || CASE WHEN remapped THEN '_trial' || tg.trial ELSE '' END AS target_key, tg.trial, tg.n AS outputs, remapped,
        CASE WHEN remapped THEN 'rec' || a.n || '_epoch' || (tg.trial + 1) || CASE WHEN own IS NOT NULL THEN '_epoch' || own ELSE '' END || tail WHEN tg.k IS NOT NULL THEN 'rec' || a.n || '_epoch' || own || tail END AS target_tag FROM a LEFT JOIN tg ON tg.k = a.k),
  res AS (SELECT *, CASE WHEN epoch IS NOT NULL THEN target_key IN (SELECT key FROM ex) END AS "exists" FROM r)"""


add("d42_import_targets", lambda t: _targets(t).select("folder", "tag", "key", "unmatched", "epoch", "target_tag", "target_key", "trial", "remapped", "outputs", "exists"), "", f"{targets_sql('false')} SELECT folder, tag, key, unmatched, epoch, target_tag, CASE WHEN epoch IS NOT NULL THEN target_key END AS target_key, trial, remapped, outputs, \"exists\" FROM res")
COUNTERS = """SELECT count(DISTINCT tag) AS scanned, count(DISTINCT CASE WHEN unmatched THEN tag END) AS unmatched, count(DISTINCT CASE WHEN epoch IS NULL AND NOT unmatched THEN tag END) AS missing_epoch, count(DISTINCT CASE WHEN remapped THEN tag END) AS remapped,
  count(CASE WHEN "exists" THEN 1 END) AS skipped_existing, count(CASE WHEN NOT "exists" THEN 1 END) AS imported, count(CASE WHEN NOT "exists" AND outputs = 0 THEN 1 END) AS missing_outputs FROM res"""
add("d42_import_reconciliation", lambda t: A.import_counters(_targets(t)), "", f"{targets_sql('false')} {COUNTERS}")
add("d42_import_reconciliation_of_a_run", lambda t: A.import_counters(_targets(t, True)), "", f"{targets_sql('true')} {COUNTERS}")
add("f1_latest_per_key", lambda t: P.latest_per_key(t.read("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", F.col("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey"), "",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
add("f3_top_datasets", lambda t: R.select_datasets(t.samples, 4), "samples", "SELECT DISTINCT dataset FROM samples ORDER BY dataset LIMIT 4")
add("f3_top_models", lambda t: P.leaderboard(models(t), "name", "score", 3).where("not baseline").select("name", "score"), "", f"WITH {MODELS} SELECT name, round(score, 6) AS score FROM md WHERE ok ORDER BY md.score DESC NULLS LAST, name LIMIT 3")
add("f4_seeded_subset", lambda t: P.seeded_subset(t.read("part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 0.25, 123), "",
    "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('123:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r <= greatest(1, ceil(n*0.25e0))")
add("f5_rank_methods", lambda t: P.rank(t.trialwise.groupBy("run", "dataset", "method").agg(F.avg("correlation").alias("score")), "score", ["method"], ["run", "dataset"], digits=12).drop("score"), "trialwise",
    "SELECT run, dataset, method, row_number() OVER (PARTITION BY run, dataset ORDER BY s DESC NULLS LAST, method) AS place FROM (SELECT run, dataset, method, avg(correlation) AS s FROM trialwise GROUP BY ALL)")


def lines(t):
    return t.read("orders").select((F.col("o_custkey") % 400).alias("key"), F.col("o_orderkey").alias("line"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 3).alias("part"))


for how, order in (("replace", "new DESC, line DESC"), ("keep", "new, CASE WHEN new = 0 THEN -line ELSE line END")):
    add(f"g1_merge_trialwise_{how}", lambda t, how=how: P.upsert(lines(t).where("part <> 2 and key % 5 <> 0").drop("part"), lines(t).where("part = 2 or key % 5 = 0").drop("part"), ["key"], "line", how), "",
        f"""SELECT key, line, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS r FROM (SELECT o_custkey % 400 AS key, o_orderkey AS line, o_totalprice AS v,
            CASE WHEN o_orderkey % 3 = 2 OR (o_custkey % 400) % 5 = 0 THEN 1 ELSE 0 END AS new FROM orders)) WHERE r = 1""")
add("g2_union_run_families", lambda t: P.union_families(t.trialwise.where("method = 'sampler'"), t.trialwise.where("method <> 'sampler'")).groupBy("kind", "run").agg(F.count("*").alias("n")), "trialwise", "SELECT CASE WHEN method = 'sampler' THEN 'main' ELSE 'single' END AS kind, run, count(*) AS n FROM trialwise GROUP BY ALL")


def summary(t, methods):
    """Per dataset: correlation and trial-wise correlations by method, and windows of the number of methods."""
    m = t.trialwise.where(F.col("method").isin(methods) & F.col("correlation").isNotNull()).groupBy("dataset", "method").agg(F.max("correlation").alias("v"), F.count("*").alias("n"))
    pairs = F.collect_list(F.struct("method", "v")), F.collect_list(F.struct("method", F.array("v", F.col("n").cast("double"))))
    return m.groupBy("dataset").agg(F.map_from_entries(pairs[0]).alias("correlations"), F.map_from_entries(pairs[1]).alias("trialwise"), F.array(F.count("*")).alias("windows"))


def upserted(t):
    new = summary(t, ["unet", "cnn"]).where("dataset % 3 <> 0").withColumn("correlations", F.transform_values("correlations", lambda k, v: v + 1))
    out = P.upsert_summary(summary(t, ["sampler", "unet"]), new, "dataset")
    return out.select("dataset", F.explode("correlations").alias("method", "v"), "trialwise", "windows").select("dataset", "method", "v", F.get(F.element_at("trialwise", F.col("method")), 1).alias("n"), F.get("windows", 0).alias("w"))


add("g3_upsert_summary", upserted, "trialwise",
    """WITH m AS (SELECT dataset, method, max(correlation) AS v, count(*) AS n FROM trialwise WHERE correlation IS NOT NULL GROUP BY ALL), o AS (SELECT dataset, method, v, n, count(*) OVER (PARTITION BY dataset) AS w FROM m WHERE method IN ('sampler', 'unet')),
       nw AS (SELECT dataset, method, v + 1 AS v, n, count(*) OVER (PARTITION BY dataset) AS w FROM m WHERE method IN ('unet', 'cnn') AND dataset % 3 <> 0),
       a AS (SELECT * FROM nw UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.dataset = o.dataset AND nw.method = o.method))
       SELECT a.dataset, method, round(v, 6) AS v, CAST(n AS DOUBLE) AS n, coalesce((SELECT max(w) FROM nw WHERE nw.dataset = a.dataset), w) AS w FROM a""")
add("g4_ordered_distinct", lambda t: P.ordered_distinct(t.read("part"), "p_name", "p_partkey"), "", "SELECT trim(p_name) AS token, min(p_partkey) AS first FROM part WHERE trim(p_name) <> '' GROUP BY ALL")


def method_entries(t):
    """Of every customer the order statuses as methods: old entries by priority, new ones with a key of their config."""
    rows = t.read("orders").select("o_custkey", F.col("o_orderstatus").alias("method"), F.col("o_orderkey").alias("place"), F.create_map(F.lit("total"), F.col("o_totalprice").cast("string")).alias("config"))
    rows = rows.withColumn("cache_key", X.config_signature(F.col("config")))
    return P.upsert_method_entries(rows.where("place % 4 <> 1"), rows.where("place % 4 = 1"), ["o_custkey"])


ENTRY = """o AS (SELECT o_custkey, o_orderstatus AS method, o_orderkey AS place FROM orders WHERE o_orderkey % 4 <> 1), n0 AS (SELECT o_custkey, o_orderstatus AS method, max(o_orderkey) AS place FROM orders WHERE o_orderkey % 4 = 1 GROUP BY ALL),
  n AS (SELECT n0.o_custkey, n0.method, coalesce((SELECT min(o.place) FROM o WHERE o.o_custkey = n0.o_custkey AND o.method = n0.method), coalesce((SELECT max(o.place) FROM o WHERE o.o_custkey = n0.o_custkey), -1) + 1 + n0.place) AS place, n0.place AS src FROM n0),
  en AS (SELECT o.o_custkey, o.method, o.place, o.place AS src FROM o WHERE NOT EXISTS (SELECT 1 FROM n0 WHERE n0.o_custkey = o.o_custkey AND n0.method = o.method) UNION ALL SELECT * FROM n)"""
add("g5_upsert_method_entry", lambda t: method_entries(t)[0].select("o_custkey", "method", "place", "cache_key"), "",
    f"""WITH {ENTRY} SELECT en.o_custkey, method, place, substr(sha256('{{"total":"' || CAST(o_totalprice AS VARCHAR) || '"}}'), 1, 16) AS cache_key FROM en JOIN orders ON o_orderkey = src""")
add("g5_methods_run", lambda t: method_entries(t)[1].select("o_custkey", F.array_join("methods_run", ",").alias("methods")), "",
    f"WITH {ENTRY} SELECT o_custkey, string_agg(method, ',' ORDER BY place, method) AS methods FROM (SELECT o_custkey, method, min(place) AS place FROM en GROUP BY ALL) GROUP BY ALL")
add("g6_union_method_outputs", lambda t: P.union_method_outputs(t.preds, t.preds.where("method <> 'sampler'").withColumn("prob", F.col("prob") * 2), "custom").select("dataset", "trial", "i", "t", "method", "prob"), "preds",
    "SELECT dataset, trial, i, round(t, 6) AS t, method, round(prob, 6) AS prob FROM preds UNION ALL SELECT dataset, trial, i, round(t, 6), method || '::custom', round(2*prob, 6) FROM preds WHERE method <> 'sampler'")


def catalogue(t):
    """Some trials without values, some with one too few."""
    y = F.when(F.col("trial") % 13 == 1, F.lit(None)).when(F.col("trial") % 13 == 2, F.slice("y", 1, 5)).otherwise(F.col("y"))
    return M.epoch_catalogue(t.wide.withColumn("y", y), t.frames.where("y > 0.3").select(*TRIAL, F.col("t").alias("s")))


add("a13_epoch_catalogue", lambda t: catalogue(t)[0], "frames",
    "SELECT dataset, trial, count(*) OVER (PARTITION BY dataset) AS epochs, dataset || '_epoch' || (trial + 1) AS epoch_id, dataset || ' (epoch ' || (trial + 1) || ' of ' || count(*) OVER (PARTITION BY dataset) || ')' AS display, has_spikes FROM (SELECT dataset, trial, max(y) > 0.3e0 AS has_spikes FROM frames WHERE trial % 13 NOT IN (1, 2) GROUP BY ALL)")
add("a13_epoch_errors", lambda t: catalogue(t)[1], "frames", "SELECT DISTINCT dataset, trial, CASE WHEN trial % 13 = 1 THEN 'no arrays' ELSE 'times and values differ in length' END AS reason FROM frames WHERE trial % 13 IN (1, 2)")
def _artefact_files(t):
    """Written files with names of all kinds, some without a trial, some of other names; the catalogue of their folder."""
    path = IO.shared_path(t.spark, "artefacts")
    rows = t.read("supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array(*map(F.lit, ("traj_samples", "param_samples", "logp", "other")))).alias("kind")).where("not (kind = 'logp' and k % 3 = 0) and k <= 60")
    name = F.format_string("d%d/%s_x_trial_%d%s.dat", F.col("k") % 4, "kind", F.col("k") % 20, F.when(F.col("k") % 5 > 0, F.concat(F.lit("_trial"), (F.col("k") % 7).cast("string"))).otherwise(F.lit("")))
    IO.write_texts(rows.groupBy(name.alias("path")).agg(F.count("*").cast("string").alias("text")), path)
    return A.catalogue(A.listed(t.spark, path))


FILES = """f AS (SELECT DISTINCT s_suppkey % 4 AS d, kind, 'x_trial_' || s_suppkey % 20 AS tag, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 7 END AS trial FROM supplier, (VALUES ('traj'), ('param'), ('logp')) v(kind) WHERE s_suppkey <= 60 AND NOT (kind = 'logp' AND s_suppkey % 3 = 0))"""
add("a14_artefact_catalogue", lambda t: A.index(_artefact_files(t)), "", f"WITH {FILES} SELECT tag, trial, count_if(kind = 'traj') AS traj, count_if(kind = 'param') AS param, count_if(kind = 'logp') AS logp FROM f GROUP BY ALL")


def _newest(t):
    """Files whose times of change are given by their folder; the newest of each tag by a pattern, the first path of equals."""
    changed = F.timestamp_seconds(F.regexp_extract("path", "/d([0-9])/", 1).cast("int") % 2)
    return A.newest(_artefact_files(t).withColumn("changed", changed), ["tag"], "traj_samples_*_trial*.dat").select("tag", F.regexp_extract("path", "(d[0-9]/[^/]*)$", 1).alias("file"))


add("f1_newest_file_by_pattern", _newest, "",
    f"""WITH {FILES}, p AS (SELECT tag, d, 'd' || d || '/traj_samples_' || tag || CASE WHEN trial IS NULL THEN '' ELSE '_trial' || trial END || '.dat' AS file FROM f WHERE kind = 'traj')
       SELECT tag, file FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY d % 2 DESC, file) AS r FROM p) WHERE r = 1""")
add("j1_run_methods_per_trial", lambda t: K.run_methods(t.wide, {"mean": lambda x, y: [sum(y) / len(y)] * len(y), "fail": lambda x, y: [1 / 0]}).select(*TRIAL, "method", F.size("prob").alias("n"), F.get("prob", 0).alias("first"), F.col("error").isNotNull().alias("failed")), "frames",
    "SELECT dataset, trial, 'mean' AS method, count(*) AS n, round(avg(y), 6) + 0 AS first, false AS failed FROM frames GROUP BY ALL UNION ALL SELECT DISTINCT dataset, trial, 'fail', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), true FROM frames")
MEMBERS = "(VALUES (2, 1, [0.1e0, 0.2e0, 0.3e0, 0.4e0]), (2, 2, [0.4e0, 0.3e0, 0.2e0, 0.1e0]), (3, 1, [1e0, 0e0, 0e0, 0e0]), (4, 1, [0e0, 0.5e0, -0.5e0, 1e0])) v(level, member, w)"


def members(t):
    return t.spark.sql("SELECT 'm' AS model, CAST(level AS BIGINT) AS noise_level, member, w FROM VALUES (2, 1, array(0.1D, 0.2D, 0.3D, 0.4D)), (2, 2, array(0.4D, 0.3D, 0.2D, 0.1D)), (3, 1, array(1D, 0D, 0D, 0D)), (4, 1, array(0D, 0.5D, -0.5D, 1D)) AS v(level, member, w)")


def predicted(t, **options):
    noise = D.noise_level(t.frames, S.sampling_rate(t.frames))
    return K.predict(t.frames, noise.withColumn("noise", F.col("noise") / 2), members(t), 4, 0.5, threshold=0, pad=-1.0, **options)


NOISE = """fn AS (SELECT dataset, trial, median(abs(d))*100/sqrt(1/median(u))/2 AS noise FROM (SELECT dataset, trial, y - lag(y) OVER w AS d, t - lag(t) OVER w AS u FROM frames WINDOW w AS (PARTITION BY dataset, trial ORDER BY i)) GROUP BY ALL)"""
PRED = f"""WITH {NOISE}, fr AS (SELECT dataset, trial, i, lag(y) OVER w AS a, y AS b, lead(y) OVER w AS c, lead(y, 2) OVER w AS d FROM frames WINDOW w AS (PARTITION BY dataset, trial ORDER BY i)),
  sc AS (SELECT fr.dataset, fr.trial, i, avg(w[1]*a + w[2]*b + w[3]*c + w[4]*d) AS y FROM fr JOIN fn ON fn.trial = fr.trial AND fn.dataset = fr.dataset JOIN {MEMBERS} ON level = least(4, greatest(2, floor(noise + 0.5e0))) GROUP BY ALL)
  SELECT dataset, trial, i, round(CASE WHEN y IS NULL THEN -1 ELSE greatest(y, 0) END, 6) + 0 AS y FROM sc"""
add("j2_ensemble_score", predicted, "frames", PRED)
add("j2_ensemble_score_with_a_scorer", lambda t: predicted(t, scorer=lambda batch, w: batch @ w), "frames", PRED)


def bumps(t):
    rows = S.active_slices(t.frames, 0.05)
    return t.frames.join(rows.select(*TRIAL, "first", "stop"), TRIAL).where("i >= first and i < stop").groupBy(*TRIAL, F.col("first").cast("long").alias("first")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda x: x["y"] * 5).alias("values"))


add("j3_rate_to_counts", lambda t: S.rates_to_counts(bumps(t), 1.0))
def normal(seed: int, *keys: str) -> str:
    """The SQL twin of `hashed_normal`."""
    u = lambda s: "((('0x' || substr(md5('" + str(s) + ":' || " + " || ':' || ".join(keys) + "), 1, 12))::BIGINT + 0.5e0)/281474976710656e0)"
    return f"sqrt(-2*ln({u(seed)}))*cos(2*3.141592653589793e0*{u(seed + 1)})"


CAL = f"""nz AS (SELECT dataset, trial, l, i, y + l/100e0*sqrt(30e0)*{normal(1, "dataset", "trial", "i", "l")} AS v FROM frames, (SELECT unnest(range(0, 20)) AS l)),
  lv AS (SELECT dataset, trial, l, count(*) + 1 AS n, median(abs(d))*100/sqrt(30e0) AS x FROM (SELECT dataset, trial, l, v - lag(v) OVER (PARTITION BY dataset, trial, l ORDER BY i) AS d FROM nz) WHERE d IS NOT NULL GROUP BY ALL),
  nx AS (SELECT *, lead(x) OVER w AS x1, first_value(x) OVER w AS base FROM lv WINDOW w AS (PARTITION BY dataset, trial ORDER BY l)), ft AS (SELECT dataset, trial, min(CASE WHEN x <= 8 AND x1 > 8 THEN l END) AS l FROM nx GROUP BY ALL),
  tr AS (SELECT dataset, count(DISTINCT trial) AS m FROM frames GROUP BY ALL),
  ca AS (SELECT z.dataset, z.trial, z.base, CASE WHEN z.base > 8 THEN 0 ELSE floor(floor(least(3e5, m*z.n*least(500, ceil(1.2e0*power(8/z.base, 2))))/z.n)/m) END AS replicas, CASE WHEN z.base <= 8 THEN (h.l + (8 - h.x)/(h.x1 - h.x))/100*sqrt(30e0) END AS added
         FROM nx z JOIN tr ON tr.dataset = z.dataset JOIN ft ON ft.trial = z.trial AND ft.dataset = z.dataset LEFT JOIN nx h ON h.trial = z.trial AND h.dataset = z.dataset AND h.l = ft.l WHERE z.l = 0)"""
#: The same without limits: all replicas of a trial, in a dataset of any size.
ALL = CAL.replace("floor(floor(least(3e5, m*z.n*least(500, ceil(1.2e0*power(8/z.base, 2))))/z.n)/m) END AS replicas", "ceil(1.2e0*power(8/nullif(z.base, 0), 2)) END AS replicas")


def calibration(t, **limits):
    return K.calibrate_noise(t.frames, 30.0, 8.0, **limits)


def high(t):
    return t.frames.where("y > 0.3").select(*TRIAL, F.col("t").alias("s"))


add("k1_noise_calibration", lambda t: calibration(t, rows=3e5), "frames", f"WITH {CAL} SELECT dataset, trial, round(base, 6) AS base, CAST(replicas AS BIGINT) AS replicas, round(added, 6) AS added FROM ca")
add("k2_noisy_replicas", lambda t: K.noisy_replicas(t.frames, high(t), calibration(t, most=None, rows=None), 30.0, 30.5).groupBy(*TRIAL, "replica").agg(F.count("*").alias("n"), F.sum("events").alias("events"), F.sum("y").alias("total")), "frames",
    f"""WITH {ALL}, rp AS (SELECT dataset, trial, added, unnest(range(1, CAST(replicas AS BIGINT) + 1)) AS replica FROM ca WHERE added IS NOT NULL), sh AS (SELECT dataset, trial, median(sqrt(abs(y + 1))) AS shot FROM frames GROUP BY ALL),
       ev AS (SELECT dataset, trial, count_if(y > 0.3e0) AS events FROM frames GROUP BY ALL), nr AS (SELECT f.dataset, f.trial, replica, y + added*sqrt(abs(y + 1))/shot*{normal(2, "f.dataset", "f.trial", "i", "replica")} AS y FROM frames f JOIN rp ON rp.trial = f.trial AND rp.dataset = f.dataset JOIN sh ON sh.trial = f.trial AND sh.dataset = f.dataset)
       SELECT nr.dataset, nr.trial, replica, count(*) AS n, any_value(events) AS events, round(sum(y), 6) + 0 AS total FROM nr JOIN ev ON ev.trial = nr.trial AND ev.dataset = nr.dataset GROUP BY nr.dataset, nr.trial, replica""")
def hashed(seed: int, *keys: str) -> str:
    """The SQL twin of `uniform`."""
    return f"((('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(keys) + "), 1, 12))::BIGINT + 0.5e0)/281474976710656e0)"


def flagged(t):
    """High values as events; no value at the end of some recordings, no event count in others."""
    return t.frames.withColumn("n", F.when((F.col("trial") % 7 > 0) | (F.col("i") < 60), (F.col("y") > 0.2).cast("double"))).withColumn("y", F.when((F.col("trial") % 5 > 0) | (F.col("i") < 50), F.col("y")))


total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
add("k3_balanced_training_set", lambda t: N.balanced_training_set(flagged(t), "n", 16, K.uniform, rows=2e4, kept=4000, leave_out=(3,)).select(*TRIAL, "i", "label", total("frame").alias("total")), "frames",
    f"""WITH f AS (SELECT dataset, trial, i, CASE WHEN trial % 5 > 0 OR i < 50 THEN y END AS y, CASE WHEN trial % 7 > 0 OR i < 60 THEN CASE WHEN y > 0.2e0 THEN 1e0 ELSE 0e0 END END AS n FROM frames WHERE dataset <> 3),
       sz AS (SELECT dataset, greatest(count(*)*(count(*) OVER ())/2e4, 1) AS f FROM f GROUP BY dataset), ln AS (SELECT dataset, trial, count(*) AS c, count(y) AS m FROM f GROUP BY ALL),
       tp AS (SELECT f.*, c, d, exp(-0.5e0*power(d/2e0, 2)) AS w, ((i + d) % (2*c) + 2*c) % (2*c) AS r FROM f JOIN ln ON ln.dataset = f.dataset AND ln.trial = f.trial, (SELECT unnest(range(-8, 9)) AS d)),
       lb AS (SELECT a.dataset, a.trial, a.i, CASE WHEN count(b.n) = count(*) THEN sum(w*b.n)/sum(w) END AS label FROM tp a JOIN f b ON b.dataset = a.dataset AND b.trial = a.trial AND b.i = CASE WHEN r < c THEN r ELSE 2*c - 1 - r END GROUP BY ALL),
       st AS (SELECT f.dataset, f.trial, f.i, m - 16 AS used, row_number() OVER (PARTITION BY f.dataset, f.trial ORDER BY {hashed(3, "f.dataset", "f.trial", "f.i")}, f.i) AS r FROM f JOIN ln ON ln.dataset = f.dataset AND ln.trial = f.trial WHERE f.i < m - 16),
       ch AS (SELECT st.dataset, trial, i FROM st JOIN sz ON sz.dataset = st.dataset WHERE r <= floor(used/f) ORDER BY {hashed(4, "st.dataset", "trial", "i")}, st.dataset, trial, i LIMIT 4000)
       SELECT ch.dataset, ch.trial, ch.i, round(label, 6) + 0 AS label, round(sum(f.y), 6) + 0 AS total FROM ch JOIN lb ON lb.dataset = ch.dataset AND lb.trial = ch.trial AND lb.i = ch.i + 8 JOIN f ON f.dataset = ch.dataset AND f.trial = ch.trial AND f.i BETWEEN ch.i AND ch.i + 15
       WHERE label IS NOT NULL GROUP BY ch.dataset, ch.trial, ch.i, label""")


def late(t):
    """An event a little after each high value, but for some recordings."""
    return t.frames.where("y > 0.2 and trial % 6 > 0").select(*TRIAL, (F.col("t") + 0.01).alias("s"))


def recorded(t):
    return N.recordings(t.wide, late(t), 30.0, 16, 1 / 30)


#: First sample and number of samples that remain of 64 at 30 a second without half a second at each end.
KEPT = (15, 34)
RECORDED = f"""ev AS (SELECT dataset, trial, i - {KEPT[0]} AS i FROM frames WHERE y > 0.2e0 AND trial % 6 > 0 AND i BETWEEN {KEPT[0]} AND {sum(KEPT) - 2}), ok AS (SELECT DISTINCT dataset, trial FROM ev),
  tr AS (SELECT f.dataset, f.trial, f.i - {KEPT[0]} AS i, y, CAST(ev.i IS NOT NULL AS INT) AS n FROM frames f JOIN ok ON ok.dataset = f.dataset AND ok.trial = f.trial LEFT JOIN ev ON ev.dataset = f.dataset AND ev.trial = f.trial AND ev.i = f.i - {KEPT[0]} WHERE f.i BETWEEN {KEPT[0]} AND {sum(KEPT) - 1}),
  pd AS (SELECT dataset, trial, i + 8 AS p, y, n FROM tr UNION ALL SELECT dataset, trial, x, 0, 0 FROM ok, (SELECT unnest(range(0, 8)) AS x UNION ALL SELECT unnest(range({KEPT[1] + 8}, {KEPT[1] + 16}))) v),
  ra AS (SELECT a.dataset, a.trial, a.p, sum(w*b.n)/sum(w) AS rate FROM (SELECT pd.*, exp(-0.5e0*d*d) AS w, ((p + d) % {2 * KEPT[1] + 32} + {2 * KEPT[1] + 32}) % {2 * KEPT[1] + 32} AS r FROM pd, (SELECT unnest(range(-4, 5)) AS d)) a
         JOIN pd b ON b.dataset = a.dataset AND b.trial = a.trial AND b.p = CASE WHEN r < {KEPT[1] + 16} THEN r ELSE {2 * KEPT[1] + 31} - r END GROUP BY ALL)"""
add("k4_segment_training_set", lambda t: N.segment_training_set(recorded(t), 16, 2).select(*TRIAL, "i", total("frame").alias("total"), total("counts").cast("long").alias("events"), total("rates").alias("rates"), "n", "rate", "class"), "frames",
    f"""WITH {RECORDED} SELECT tr.dataset, tr.trial, tr.i, round(sum(pd.y), 6) + 0 AS total, CAST(sum(pd.n) AS BIGINT) AS events, round(sum(w.rate), 6) + 0 AS rates, any_value(tr.n) AS n, round(any_value(c.rate), 6) + 0 AS rate, least(any_value(tr.n), 1) AS class
       FROM tr JOIN pd ON pd.dataset = tr.dataset AND pd.trial = tr.trial AND pd.p BETWEEN tr.i AND tr.i + 15 JOIN ra w ON w.dataset = pd.dataset AND w.trial = pd.trial AND w.p = pd.p JOIN ra c ON c.dataset = tr.dataset AND c.trial = tr.trial AND c.p = tr.i + 8 GROUP BY tr.dataset, tr.trial, tr.i""")
add("k4_segment_statistics", lambda t: N.segment_statistics(t.wide, late(t), recorded(t), 16), "frames",
    f"""WITH {RECORDED}, us AS (SELECT dataset, count(DISTINCT trial) AS recordings, count(*) AS samples, CAST(sum(n) AS BIGINT) AS events, count(*)/30e0 AS elapsed FROM tr GROUP BY dataset),
       dd AS (SELECT dataset, abs(y - lag(y) OVER (PARTITION BY dataset ORDER BY trial, i)) AS d FROM frames), sc AS (SELECT dataset, sum(l) AS seconds FROM (SELECT dataset, trial, max(t) AS l FROM frames GROUP BY ALL) GROUP BY dataset),
       sp AS (SELECT dataset, count(*) AS n FROM frames WHERE y > 0.2e0 AND trial % 6 > 0 GROUP BY dataset)
       SELECT us.dataset, recordings, 30e0 AS rate, samples, events, round(elapsed, 6) AS elapsed, round(any_value(sp.n/seconds), 6) AS firing_rate, round(median(d)*100/sqrt(30e0), 6) AS noise FROM us JOIN dd ON dd.dataset = us.dataset JOIN sc ON sc.dataset = us.dataset JOIN sp ON sp.dataset = us.dataset GROUP BY us.dataset, recordings, samples, events, elapsed""")
def _bank(t):
    """Traces with and without times."""
    return t.wide.select(*TRIAL, F.when(F.col("trial") % 4 != 1, F.col("t")).alias("t"), "y")


def _twice(t):
    """A second run finds some traces changed and one dataset added; a third finds nothing to do."""
    path = IO.shared_path(t.spark, "noise")
    NB.prepare_noise_bank(_bank(t).where("dataset <> 3"), 7.5, path)
    now = _bank(t).withColumn("y", F.when(F.col("trial") % 5 == 0, F.transform("y", lambda v: v + 1)).otherwise(F.col("y")))
    NB.prepare_noise_bank(now, 7.5, path)
    return NB.prepare_noise_bank(now, 7.5, path).select(*TRIAL, "run", F.size("y").alias("n"), F.element_at("t", -1).alias("last_t"), total("y").alias("total"))


add("k5_downsample_noise_bank", _twice, "frames",
    """WITH f AS (SELECT dataset, trial, i, t, y + CASE WHEN trial % 5 = 0 THEN 1 ELSE 0 END AS y FROM frames),
       b AS (SELECT dataset, trial, i//4 AS k, avg(t) AS t, avg(y) AS y FROM f WHERE trial % 4 <> 1 GROUP BY ALL),
       g AS (SELECT a.dataset, a.trial, k, k/4e0*63/1219e-1 AS t, a.y + coalesce((c.y - a.y)*(k*1575e-2 - floor(k*1575e-2)), 0) AS y FROM (SELECT unnest(range(0, 5)) AS k) JOIN f a ON a.i = CAST(floor(k*1575e-2) AS BIGINT) LEFT JOIN f c ON c.dataset = a.dataset AND c.trial = a.trial AND c.i = a.i + 1 WHERE a.trial % 4 = 1)
       SELECT dataset, trial, CASE WHEN dataset = 3 OR trial % 5 = 0 THEN 2 ELSE 1 END AS run, count(*) AS n, round(max(t), 6) AS last_t, round(sum(y), 6) + 0 AS total FROM (SELECT * FROM b UNION ALL SELECT * FROM g) GROUP BY dataset, trial""")


def _manifest(t):
    rows = t.read("orders").select(F.col("o_custkey").alias("model"), F.when(F.col("o_orderkey") % 3 == 0, "training").otherwise("synthetic").alias("kind"), F.col("o_orderkey").alias("updated"))
    old = rows.where("updated % 2 = 0")
    return IO.append_manifest(old, rows.where("updated % 2 = 1").drop("updated"), F.lit(10**9).cast("long")).groupBy("model", "kind").agg(F.count("*").alias("n"), F.max("updated").alias("updated"))


add("h2_trace_hash", lambda t: IO.trace_hashes(t.samples))
add("h11_manifest_append", lambda t: _manifest(t), "",
    """SELECT o_custkey AS model, CASE WHEN o_orderkey % 3 = 0 THEN 'training' ELSE 'synthetic' END AS kind, CASE WHEN any_value(o_orderkey % 3 = 0) THEN 1 ELSE count(*) END AS n,
       max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 1000000000 END) AS updated FROM orders GROUP BY ALL""")
add("a4_read_trial_selection", lambda t: IO.read_trial_selection(t.trialwise.groupBy("dataset").agg(F.collect_list((F.col("trial") % 50).cast("int")).alias("a")).select(F.to_json(F.map_from_entries(F.array(F.struct(F.concat(F.lit("d"), F.col("dataset").cast("string")), "a")))).alias("json"))).select("dataset", F.explode("trials").alias("trial")), "trialwise",
    "SELECT DISTINCT 'd' || dataset AS dataset, trial % 50 AS trial FROM trialwise")


def _through_csv(t):
    path = IO.shared_path(t.spark, "scores")
    rows = t.trialwise.select("run", F.concat(F.lit("d"), F.col("dataset").cast("string")).alias("dataset"), "smoothing", "method", F.col("method").alias("label"), "corr_sigma_ms", F.col("trial").cast("int").alias("trial"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), "correlation")
    rows.write.csv(path, header=True)
    return IO.read_trialwise_csv(t.spark, path).groupBy("dataset", "method").agg(F.count("*").alias("n"), F.avg("correlation").alias("mean"))


def _through_partitions(t):
    """Twice, the second time only one method: its partitions are replaced, the others stay."""
    path = IO.shared_path(t.spark, "results")
    IO.write_results(t.preds, path)
    IO.write_results(t.preds.where("method = 'cnn'").withColumn("prob", F.col("prob") + 1), path)
    return t.spark.read.parquet(path).groupBy("method", F.col("dataset").cast("long").alias("dataset")).agg(F.count("*").alias("n"), F.sum("prob").alias("total"))


add("a5_read_trialwise_csv", _through_csv, "trialwise", "SELECT 'd' || dataset AS dataset, method, count(*) AS n, round(avg(correlation), 6) AS mean FROM trialwise GROUP BY ALL")
add("a11_write_results", _through_partitions, "preds", "SELECT method, dataset, count(*) AS n, round(sum(prob + CASE WHEN method = 'cnn' THEN 1 ELSE 0 END), 6) AS total FROM preds GROUP BY ALL")


def _through_param_files(t):
    path = IO.shared_path(t.spark, "params")
    t.posterior.select("b", "c").write.csv(path, header=True)
    return IO.read_params(t.spark, path).groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


add("a8_read_params", _through_param_files, "posterior", "SELECT 'b' AS name, count(*) AS n, round(sum(b), 6) AS total FROM posterior UNION ALL SELECT 'c', count(*), round(sum(c), 6) FROM posterior")


def _through_traces(t):
    path = IO.shared_path(t.spark, "traces")
    t.wide.withColumn("other", F.lit(1)).write.parquet(path)
    return IO.read_traces(t.spark, path).select(*TRIAL, F.size("t").alias("n"), F.element_at("t", -1).alias("last_t"), F.element_at("y", 1).alias("first_y"))


add("a1_read_traces", _through_traces, "frames", "SELECT dataset, trial, count(*) AS n, round(max(t), 6) AS last_t, round(min_by(y, i), 6) + 0 AS first_y FROM frames GROUP BY ALL")


def _event_lists(t):
    """Each dataset's events as a list an epoch, as one list, or as two lists, by dataset."""
    rows = t.spikes.withColumn("epoch", F.col("trial") % F.when(F.col("dataset") % 3 == 0, 3).when(F.col("dataset") % 3 == 1, 1).otherwise(2))
    lists = rows.groupBy("dataset", "epoch").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return lists.groupBy("dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch", "s"))), lambda e: F.concat(e["s"], F.array(F.lit(float("nan"))))).alias("ap"))


add("a2_read_spikes", lambda t: IO.read_spikes(_event_lists(t), t.spikes.select("dataset", F.lit(3).alias("n")).distinct()), "spikes",
    """WITH l AS (SELECT dataset, s, trial % 3 AS e FROM spikes), k AS (SELECT dataset, count(DISTINCT CASE WHEN dataset % 3 = 0 THEN e WHEN dataset % 3 = 1 THEN 0 ELSE trial % 2 END) AS lists FROM (SELECT *, trial % 3 AS e FROM spikes) GROUP BY ALL)
       SELECT l.dataset, e AS trial, round(s, 6) AS s FROM l JOIN k ON k.dataset = l.dataset WHERE lists = 3 UNION ALL SELECT l.dataset, x, round(s, 6) FROM l JOIN k ON k.dataset = l.dataset, (VALUES (0), (1), (2)) v(x) WHERE lists <> 3""")


def _through_window_json(t):
    """One object a dataset, of the windows of its trials in order."""
    rows = t.windows.groupBy("dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("trial", "start_s", "end_s"))), lambda w: F.array(w["start_s"], w["end_s"])).alias("w"))
    return IO.read_windows(rows.select(F.to_json(F.map_from_entries(F.array(F.struct(F.concat(F.lit("d"), F.col("dataset").cast("string")), "w")))).alias("json")))


add("a3_read_windows", _through_window_json, "windows", "SELECT 'd' || dataset AS dataset, row_number() OVER (PARTITION BY dataset ORDER BY trial) - 1 AS trial, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM windows")


def _through_tree(t):
    path = IO.shared_path(t.spark, "tree")
    per = t.trialwise.groupBy("run", (F.col("dataset") % 4).alias("d"), "smoothing", "method").agg(F.max("correlation").alias("v"))
    tree = per.groupBy("run", "d", "smoothing").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("method", "v"))).alias("correlations"), F.lit(30.0).alias("corr_sigma_ms"))).alias("text"))
    place = lambda kind: F.concat_ws("/", "run", F.concat(F.lit("d"), F.col("d").cast("string")), "smoothing", F.lit(f"{kind}.json")).alias("path")
    IO.write_texts(tree.where("not (d = 3 and smoothing = 'raw')").select(place("summary"), "text").union(tree.where("d % 2 = 1").select(place("comparison"), F.lit('{"methods": []}'))), path)
    return IO.read_run_tree(t.spark, path, runs=["A", "N"], smoothings=["raw", "30Hz"], methods=["cnn", "absent"])


add("a6_read_run_tree", _through_tree, "trialwise",
    """SELECT run, 'd' || d AS dataset, smoothing, m AS method, CASE WHEN m = 'cnn' THEN round(v, 6) END AS correlation, CASE WHEN d % 2 = 1 THEN '{"methods": []}' END AS manifest
       FROM (SELECT run, dataset % 4 AS d, smoothing, max(CASE WHEN method = 'cnn' THEN correlation END) AS v FROM trialwise GROUP BY ALL), (VALUES ('cnn'), ('absent')) x(m)
       WHERE run IN ('A', 'N') AND smoothing IN ('raw', '30Hz') AND NOT (d = 3 AND smoothing = 'raw')""")


def _through_posterior_files(t):
    """All rows of a tag as up to four samples of equal length; the files of log-probabilities lack the last sample of odd tags."""
    path = IO.shared_path(t.spark, "posterior")
    rows = t.posterior.withColumn("k", F.row_number().over(W.partitionBy("tag").orderBy("sample", "bin")) - 1).withColumn("n", F.count("*").over(W.partitionBy("tag")))
    samples = F.when(F.col("n") % 4 == 0, 4).when(F.col("n") % 3 == 0, 3).when(F.col("n") % 2 == 0, 2).otherwise(1)
    rows = rows.withColumn("bins", (F.col("n") / samples).cast("long")).withColumn("sample", F.floor(F.col("k") / F.col("bins"))).withColumn("bin", F.col("k") % F.col("bins"))
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("sample", "burst", "b", "s", "c", "y")])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sample", "bin", line.alias("line")))), lambda x: x["line"]), "\n")
    files = rows.groupBy("tag").agg(F.concat(F.lit("index,burst,B,S,C,Y\n"), text).alias("text"), F.max("sample").alias("last"))
    file = lambda kind, text: F.struct(F.format_string(f"{kind}_%d_trial1.dat", "tag").alias("path"), text.alias("text"))
    logs = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last").cast("int") - F.when((F.col("tag") % 2 == 1) & (F.col("last") > 0), 1).otherwise(0)), lambda k: (-k).cast("string")), "\n")
    IO.write_texts(files.select(F.inline(F.array(file("traj_samples", F.col("text")), file("logp", logs)))), path)
    return IO.read_posterior(t.spark, path, logp=True).withColumn("tag", F.col("tag").cast("long"))


add("a7_read_posterior", _through_posterior_files, "posterior",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sample, bin) - 1 AS k, count(*) OVER (PARTITION BY tag) AS n FROM posterior), c AS (SELECT *, n//CASE WHEN n % 4 = 0 THEN 4 WHEN n % 3 = 0 THEN 3 WHEN n % 2 = 0 THEN 2 ELSE 1 END AS bins FROM k),
       l AS (SELECT tag, k//bins AS sample, k % bins AS bin, burst, b, s, c, y, max(k//bins) OVER (PARTITION BY tag) AS last FROM c)
       SELECT tag, 1 AS trial, sample, bin, burst, round(b, 6) AS b, s, round(c, 6) AS c, round(y, 6) AS y, CAST(-sample AS DOUBLE) AS logp FROM l WHERE NOT (tag % 2 = 1 AND last > 0 AND sample = last)""")



def _shapes(t):
    """Predictions of each dataset as one array, with shared times and with times of each trial."""
    rows = t.wide.withColumn("t", F.transform("t", lambda x, i: F.when((i == 3) & (F.col("trial") % 5 == 0), F.lit(float("nan"))).otherwise(x)))
    flat = IO.read_predictions(rows.where("trial % 3 = 0").select("dataset", F.col("trial").alias("id"), F.col("t").alias("time"), F.col("y").alias("p")), ["dataset", "id"], "time", "p", {"recon": "p", "none": "absent"})
    shared = IO.read_predictions(rows.where("trial % 3 = 1").select("dataset", F.col("trial").alias("id"), F.col("t").alias("time"), F.array("y", "y").alias("p")), ["dataset", "id"], "time", "p", {"recon": "p"})
    own = IO.read_predictions(rows.where("trial % 3 = 2").select("dataset", F.col("trial").alias("id"), F.array("t", "t").alias("time"), F.array("y", "y").alias("p")), ["dataset", "id"], "time", "p", {"recon": "p"})
    return flat.union(shared).union(own).groupBy("dataset", "id", "trial").agg(F.count("*").alias("n"), F.max("i").alias("last"), F.sum("prob").alias("total"), F.sum("recon").alias("recon"))


add("a9_read_predictions", _shapes, "frames",
    """SELECT dataset, f.trial AS id, k AS trial, count(*) AS n, count(*) - 1 AS last, round(sum(y), 6) + 0 AS total, round(sum(y), 6) + 0 AS recon FROM frames f, (VALUES (0), (1)) v(k) WHERE (k = 0 OR f.trial % 3 > 0) AND NOT (i = 3 AND f.trial % 5 = 0) GROUP BY ALL""")


def _through_bundles(t):
    """Bundles of up to four recordings, with an event in tenths of milliseconds at each high value."""
    one = F.struct(F.col("t").alias("fluo_time"), F.col("y").alias("fluo_mean"), F.transform(F.filter(F.arrays_zip("t", "y"), lambda p: p["y"] > 0.3), lambda p: p["t"] * 1e4).alias("events_AP"))
    rows = t.wide.groupBy("dataset", F.floor(F.col("trial") / 4).alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("trial", one.alias("b")))), lambda x: x["b"]).alias("recordings"))
    got = IO.read_bundles(rows.select(F.concat_ws("/", F.col("dataset").cast("string"), F.col("part").cast("string")).alias("dataset"), "recordings"))
    return got.select("dataset", "trial", "frame_rate", F.size("t").alias("n"), F.size("spikes_s").alias("events"), F.aggregate("spikes_s", F.lit(0.0), lambda a, x: a + x).alias("total"))


add("a10_read_bundles", _through_bundles, "frames",
    """WITH r AS (SELECT dataset, trial, (count(*) - 1)/(max(t) - min(t)) AS fr, count(*) AS n, count_if(y > 0.3e0) AS events, coalesce(sum(CASE WHEN y > 0.3e0 THEN t END), 0) AS total FROM frames GROUP BY ALL)
       SELECT dataset || '/' || trial//4 AS dataset, row_number() OVER (PARTITION BY dataset, trial//4 ORDER BY trial) - 1 AS trial, round(fr, 6) AS frame_rate, n, events, round(total, 6) AS total FROM r""")


def _through_summary(t):
    path = IO.shared_path(t.spark, "summary")
    scores = t.trialwise.groupBy("run", "dataset", "smoothing", "method").agg(F.max("correlation").alias("correlation")).where("correlation is not null")
    IO.write_summary(scores, path)
    maps = t.spark.read.schema("run string, dataset long, smoothing string, correlations map<string,double>").json(f"{path}/json").select("run", "dataset", "smoothing", F.explode("correlations").alias("method", "correlation"))
    lines = t.spark.read.csv(f"{path}/csv", header=True, schema="run string, dataset long, smoothing string, method string, again double")
    return maps.join(lines, ["run", "dataset", "smoothing", "method"], "full_outer")


add("a11_write_summary", _through_summary, "trialwise", "SELECT run, dataset, smoothing, method, round(max(correlation), 6) AS correlation, round(max(correlation), 6) AS again FROM trialwise WHERE correlation IS NOT NULL GROUP BY run, dataset, smoothing, method")


def _documents(t, shift: float = 0.0, unet: bool = True):
    """The documents of three runs from tables of scores, scores by trial, windows, counts and methods."""
    by = ["run", F.format_string("d%d", F.col("dataset") % 4).alias("dataset"), "smoothing"]
    rows = t.trialwise.select(*by, "method", (F.col("trial") % 5).alias("trial"), "correlation", "corr_sigma_ms").where(F.lit(unet) | (F.col("method") != "unet"))
    by = ["run", "dataset", "smoothing"]
    folder = F.concat_ws("/", *by)
    scores = rows.groupBy(*by, "method").agg((F.avg("correlation") + shift).alias("correlation"))
    trialwise = rows.groupBy(*by, "method", "trial").agg(F.max(F.when(F.col("trial") != 3, F.col("correlation"))).alias("correlation"))
    windows = rows.groupBy(*by, "trial").agg(F.min("corr_sigma_ms").alias("start_s"), F.max("corr_sigma_ms").alias("end_s"))
    counts = rows.groupBy(*by).agg(F.max("corr_sigma_ms").alias("corr_sigma_ms"), F.count("*").alias("gt_count")).withColumn("downsample_target", F.when(F.col("smoothing") != "raw", F.col("smoothing")))
    config = F.create_map(F.lit("folder"), folder, F.lit('a "b"'), F.col("method"))
    methods = rows.groupBy(*by, "method").agg(F.count("*").alias("samples")).withColumn("config", config)
    methods = methods.select(*by, F.concat(F.lit("my "), "method").alias("label"), "method", folder.alias("cache_tag"), X.config_signature(F.col("config")).alias("cache_key"), "config", F.lit(30.0).alias("sampling_rate"), "samples", F.create_map(F.lit("note"), folder).alias("details"))
    return IO.run_documents(scores, methods, counts, trialwise, windows)


def _through_documents(t):
    """Written, then written again without one method and with other scores: what is read is the second, by every field."""
    path = IO.shared_path(t.spark, "documents")
    IO.write_run_documents(_documents(t), path)
    IO.write_run_documents(_documents(t, 1.0, False), path)
    docs = IO.read_run_documents(t.spark, path)
    by = ["run", "dataset", "smoothing"]
    each = IO.trialwise_rows(docs).groupBy(*by, "method").agg(F.count("*").alias("trials"), F.sum("correlation").alias("total"), F.sum("start_s").alias("starts"), F.sum("end_s").alias("ends"))
    got = IO.correlation_rows(docs).join(IO.method_rows(docs), [*by, "method"]).join(each, [*by, "method"])
    field = lambda name: F.try_element_at(F.from_json("summary_json", "map<string,string>"), F.concat(F.lit("my "), F.col("method"), F.lit(f"_{name}")))
    rest = docs.select(*by, "summary_json", F.col("summary.dataset").alias("d"), F.col("summary.downsample_target").alias("target"), F.col("summary.resample_tag").alias("tag"), F.array_join("summary.methods_run", ",").alias("ran"), F.col("summary.gt_count").alias("n"), F.col("comparison.run_tag").alias("run_tag"), F.col("comparison.artifacts")["summary"].alias("artifact"))
    both = got.join(rest, by)
    return both.select(*by, "method", "correlation", "corr_sigma_ms", "trials", "total", "starts", "ends", "place", "label", "cache_tag", "cache_key", F.col("config")["folder"].alias("folder"), F.col("config")['a "b"'].alias("quoted"), "sampling_rate",
                       "d", "target", "tag", "ran", "n", "run_tag", "artifact", field("samples").cast("long").alias("samples"), field("note").alias("note"), F.get_json_object(field("cache"), "$.folder").alias("cached"))


add("a11_run_documents", _through_documents, "trialwise",
    """WITH r AS (SELECT run, 'd' || (dataset % 4) AS dataset, smoothing, method, trial % 5 AS trial, correlation, corr_sigma_ms, run || '/d' || (dataset % 4) || '/' || smoothing AS f FROM trialwise WHERE method <> 'unet'),
       c AS (SELECT run, dataset, smoothing, max(corr_sigma_ms) AS sigma, count(*) AS n, string_agg(DISTINCT 'my ' || method, ',' ORDER BY 'my ' || method) AS ran FROM r GROUP BY ALL), w AS (SELECT run, dataset, smoothing, trial, min(corr_sigma_ms) AS a, max(corr_sigma_ms) AS z FROM r GROUP BY ALL),
       tw AS (SELECT run, dataset, smoothing, method, trial, max(CASE WHEN trial <> 3 THEN correlation END) AS v, row_number() OVER (PARTITION BY run, dataset, smoothing, method ORDER BY trial) AS p FROM r GROUP BY run, dataset, smoothing, method, trial),
       wp AS (SELECT *, row_number() OVER (PARTITION BY run, dataset, smoothing ORDER BY trial) AS p FROM w), e AS (SELECT tw.run, tw.dataset, tw.smoothing, tw.method, count(*) AS trials, sum(v) AS total, sum(a) AS starts, sum(z) AS ends FROM tw LEFT JOIN wp ON wp.run = tw.run AND wp.dataset = tw.dataset AND wp.smoothing = tw.smoothing AND wp.p = tw.p GROUP BY ALL),
       m AS (SELECT run, dataset, smoothing, method, f, avg(correlation) + 1 AS correlation, count(*) AS samples FROM r GROUP BY ALL)
       SELECT m.run, m.dataset, m.smoothing, m.method, round(correlation, 6) AS correlation, sigma AS corr_sigma_ms, trials, round(total, 6) AS total, round(starts, 6) AS starts, round(ends, 6) AS ends, row_number() OVER (PARTITION BY m.run, m.dataset, m.smoothing ORDER BY m.method) - 1 AS place, 'my ' || m.method AS label,
         f AS cache_tag, substr(sha256('{"a \\"b\\"":"' || m.method || '","folder":"' || f || '"}'), 1, 16) AS cache_key, f AS folder, m.method AS quoted, 30e0 AS sampling_rate, m.dataset AS d, m.smoothing AS target, m.run AS tag, ran, n, m.run AS run_tag, f || '/summary.json' AS artifact, samples, f AS note, f AS cached
       FROM m JOIN c ON c.run = m.run AND c.dataset = m.dataset AND c.smoothing = m.smoothing JOIN e ON e.run = m.run AND e.dataset = m.dataset AND e.smoothing = m.smoothing AND e.method = m.method""")


def _through_export(t):
    path = IO.shared_path(t.spark, "export")
    cut = t.frames.where("i < 40 + trial % 20")
    IO.export_downsampled(cut, t.frames.where("y > 0.3").select(*TRIAL, F.col("t").alias("s")), 10.0, path)
    return t.spark.read.parquet(path).select(F.col("dataset").cast("long").alias("dataset"), "trial", "valid_length", F.size("y").alias("n"), F.aggregate(F.slice("y", F.lit(1), F.col("valid_length")), F.lit(0.0), lambda a, x: a + x).alias("total"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("events"))


add("a11_export_downsampled", _through_export, "frames",
    """WITH c AS (SELECT * FROM frames WHERE i < 40 + trial % 20), n AS (SELECT dataset, trial, count(*)//3 AS b FROM c GROUP BY ALL), m AS (SELECT c.dataset, c.trial, i//3 AS k, avg(y) AS y, avg(t) AS t, any_value(b) AS b FROM c JOIN n ON n.trial = c.trial AND n.dataset = c.dataset WHERE i//3 < b GROUP BY c.dataset, c.trial, i//3),
       f AS (SELECT dataset, trial, min(t) AS f, any_value(b) AS b, sum(y) AS total FROM m GROUP BY ALL), e AS (SELECT f.dataset, f.trial, count(*) AS events FROM f JOIN frames s ON s.trial = f.trial AND s.dataset = f.dataset AND s.y > 0.3e0 AND floor((s.t - f)/(1/10e0) + 0.5e0) BETWEEN 0 AND b - 1 GROUP BY ALL)
       SELECT f.dataset, f.trial, b AS valid_length, max(b) OVER (PARTITION BY f.dataset) AS n, round(total, 6) + 0 AS total, coalesce(events, 0) AS events FROM f LEFT JOIN e ON e.trial = f.trial AND e.dataset = f.dataset""")


def _through_fingerprints(t):
    """Equal texts have equal fingerprints; the folder's is one for all its files."""
    path = IO.shared_path(t.spark, "files")
    IO.write_texts(t.read("nation").select(F.concat(F.lit("all/"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), F.col("n_regionkey").cast("string").alias("text")), path)
    return IO.file_fingerprints(t.spark, f"{path}/all").groupBy("hash").agg(F.count("*").alias("n"), F.max("length").alias("length"), F.countDistinct("folder_hash").alias("folders"))


add("h3_file_fingerprint", _through_fingerprints, "", "SELECT sha256(CAST(n_regionkey AS VARCHAR)) AS hash, count(*) AS n, 1 AS length, 1 AS folders FROM nation GROUP BY ALL")
