"""Recordings, events, windows, predictions, scores and posteriors, derived from the given tables.

`Tables` gives them as DataFrames; `SQL` has the same views for DuckDB.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIAL = ("dataset", "trial")
#: Rows of a table in one partition of what is derived from it.
PARTITION_ROWS = 250_000


class Tables:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows of a table in partitions of some `PARTITION_ROWS` by keys, so that what a task sorts does not grow with the table.

        What is grouped by the keys stays in its partition. Rows are counted from the files' footers.
        """
        return rows.repartition(max(self.spark.sparkContext.defaultParallelism, math.ceil(rows.count() / PARTITION_ROWS)), *keys)

    @cached_property
    def samples(self) -> DataFrame:
        """dataset, trial, event_id, event_type, props, y, t, i: one long row per sample, t in seconds."""
        hours = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)/1E6/3600D"
        rows = self.read("events").selectExpr("user_id % 10 AS dataset", "user_id AS trial", "event_id", "event_type", "props", "value AS y", f"1E3*user_id + {hours} AS t")
        return self.dealt(rows, *TRIAL).withColumn("i", F.row_number().over(W.partitionBy(*TRIAL).orderBy("t", "event_id")) - 1)

    @cached_property
    def spikes(self) -> DataFrame:
        return self.samples.where("event_type = 'error'").select(*TRIAL, F.col("t").alias("s"))

    @cached_property
    def windows(self) -> DataFrame:
        unset = F.col("trial") % 7 == 0
        first = self.samples.groupBy(*TRIAL).agg(F.min("t").alias("m"))
        return first.select(*TRIAL, F.when(~unset, F.col("m") + 24).alias("start_s"), F.when(~unset, F.col("m") + 360).alias("end_s"))

    @cached_property
    def preds(self) -> DataFrame:
        """dataset, trial, i, t, method, prob: three methods over the samples; prob is null at the start of unet."""
        prev = F.lag("y").over(W.partitionBy(*TRIAL).orderBy("t", "event_id"))
        k = F.get_json_object("props", "$.k").cast("double")
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("prob")) for m, c in (("sampler", "y"), ("unet", "prev"), ("cnn", "yk"))]))
        rows = self.samples.withColumn("prev", prev).withColumn("yk", F.col("y") + k)
        return rows.select(*TRIAL, "i", "t", each.alias("m")).select(*TRIAL, "i", "t", "m.method", "m.prob")

    @cached_property
    def wide(self) -> DataFrame:
        """dataset, trial, t, y: arrays of 30 samples a second."""
        y = F.col("embedding").cast("array<double>")
        return self.read("embeddings").select(F.col("label").cast("long").alias("dataset"), F.col("vec_id").alias("trial"), F.transform(y, lambda v, i: i / F.lit(30.0)).alias("t"), y.alias("y"))

    @cached_property
    def frames(self) -> DataFrame:
        """The long form of `wide`: dataset, trial, i, t, y."""
        return self.wide.select(*TRIAL, F.posexplode(F.arrays_zip("t", "y")).alias("i", "p")).select(*TRIAL, "i", "p.t", "p.y")

    @cached_property
    def trialwise(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "l_returnflag AS run",
            "l_suppkey AS dataset",
            "CASE l_linenumber % 3 WHEN 0 THEN 'raw' WHEN 1 THEN '30Hz' ELSE '10Hz' END AS smoothing",
            "CASE l_partkey % 3 WHEN 0 THEN 'sampler' WHEN 1 THEN 'unet' ELSE 'cnn' END AS method",
            "CAST(10 * (1 + CAST(l_quantity AS INT) % 5) AS DOUBLE) AS corr_sigma_ms",
            "l_orderkey AS trial",
            "CASE WHEN l_linenumber = 7 THEN NULL ELSE 10 * l_discount END AS correlation",
        )

    @cached_property
    def posterior(self) -> DataFrame:
        """tag, sample, bin, b, s, c, y: one row per bin of a posterior sample."""
        every = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        rows = self.dealt(self.read("lineitem"), "l_suppkey").withColumn("bin", F.row_number().over(W.partitionBy("l_suppkey", "l_linenumber").orderBy(*every)) - 1)
        return rows.selectExpr("l_suppkey AS tag", "CAST(l_linenumber - 1 AS BIGINT) AS sample", "CAST(bin AS BIGINT) AS bin", "CAST(CAST(l_quantity AS INT) % 2 AS BIGINT) AS burst", "l_tax AS b", "CAST(CAST(l_quantity AS INT) % 3 AS BIGINT) AS s", "l_discount AS c", "l_tax + l_discount + 0.01D AS y")

    @cached_property
    def logp(self) -> DataFrame:
        return self.read("lineitem").groupBy(F.col("l_suppkey").alias("tag"), (F.col("l_linenumber") - 1).cast("long").alias("sample")).agg((-F.round(F.avg("l_extendedprice"), 6)).alias("logp"))


SQL = {
    "samples": """SELECT *, row_number() OVER (PARTITION BY dataset, trial ORDER BY t, event_id) - 1 AS i FROM (
  SELECT user_id % 10 AS dataset, user_id AS trial, event_id, event_type, props, value AS y,
         1e3*user_id + (epoch_us(ts) - 1704067200000000)/1e6/36e2 AS t FROM events)""",
    "spikes": "SELECT dataset, trial, t AS s FROM samples WHERE event_type = 'error'",
    "windows": """SELECT dataset, trial, CASE WHEN trial % 7 = 0 THEN NULL ELSE min(t) + 24 END AS start_s,
  CASE WHEN trial % 7 = 0 THEN NULL ELSE min(t) + 360 END AS end_s FROM samples GROUP BY dataset, trial""",
    "preds": """SELECT dataset, trial, i, t, 'sampler' AS method, y AS prob FROM samples
  UNION ALL SELECT dataset, trial, i, t, 'unet', lag(y) OVER (PARTITION BY dataset, trial ORDER BY i) FROM samples
  UNION ALL SELECT dataset, trial, i, t, 'cnn', y + CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM samples""",
    "frames": """SELECT CAST(label AS BIGINT) AS dataset, vec_id AS trial, i, i/30e0 AS t, CAST(embedding[i + 1] AS DOUBLE) AS y
  FROM (SELECT label, vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)""",
    "trialwise": """SELECT l_returnflag AS run, l_suppkey AS dataset,
  CASE l_linenumber % 3 WHEN 0 THEN 'raw' WHEN 1 THEN '30Hz' ELSE '10Hz' END AS smoothing,
  CASE l_partkey % 3 WHEN 0 THEN 'sampler' WHEN 1 THEN 'unet' ELSE 'cnn' END AS method,
  CAST(10 * (1 + CAST(l_quantity AS INT) % 5) AS DOUBLE) AS corr_sigma_ms, l_orderkey AS trial,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE 10 * l_discount END AS correlation FROM lineitem""",
    "posterior": """SELECT l_suppkey AS tag, CAST(l_linenumber - 1 AS BIGINT) AS sample,
  row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS bin,
  CAST(CAST(l_quantity AS INT) % 2 AS BIGINT) AS burst, l_tax AS b, CAST(CAST(l_quantity AS INT) % 3 AS BIGINT) AS s, l_discount AS c, l_tax + l_discount + 1e-2 AS y FROM lineitem""",
    "logp": "SELECT l_suppkey AS tag, CAST(l_linenumber - 1 AS BIGINT) AS sample, -round(avg(l_extendedprice), 6) AS logp FROM lineitem GROUP BY ALL",
}
NEEDS = {"spikes": ["samples"], "windows": ["samples"], "preds": ["samples"]}


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: `body` after the named views and those they need."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    body = body.strip()
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
