"""Benchmark decontamination by spaced-seed hashing.

A window of 12 words is four blocks of three. A mask keeps two blocks and ignores the words of the others, so
a window with at most two changed words is found by at least one mask: two blocks are left whole, and each
pair of blocks is kept by the mask of their distance. Shorter items are one window: of 6 to 11 words one may be changed,
so its first or last three words are a seed; of fewer none, and its first words are the seed.

Test and training hashes meet in a join that tells where a window may stand. The distinct word sequences at those places are then
compared with the windows, once each however often they occur.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import let, row_key, written

BLOCK, BLOCKS = 3, 4
WINDOW = BLOCK * BLOCKS
#: Distances of the two kept blocks: 111111, 111000111 and 111000000111 (1: kept, 0: ignored).
GAPS = (BLOCK, 2 * BLOCK, 3 * BLOCK)
#: Changed words that a full window may have; shorter windows in proportion, rounded down. The seeds find up to two.
TOLERATED = 2
#: Up to so many seeds, and keys of windows, of the benchmark are broadcast; more are joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_KEYS = 2_000_000, 300_000
#: Up to so many keys of documents with hits are broadcast (16 bytes each), so that only their texts are shuffled.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+", " "), " ", -1), "")


def blocks(words: Column) -> Column:
    """Hash of the three words from each position on."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (BLOCK - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def seed(kind: str, *parts: Column) -> Column:
    """Hash of the kept parts under the mask `kind`; null if one lies beyond the text's end."""
    there = F.lit(True)
    for part in parts:
        there = there & part.isNotNull()
    return F.when(there, F.xxhash64(F.lit(kind), *parts))


def seeds_of(rows: DataFrame, keys: list[str], kinds: set[str]) -> DataFrame:
    """keys, at, seed: of the masks `kinds` at all positions of `words` where their first kept word stands."""
    gaps = [d for d in GAPS if f"gap{d}" in kinds]
    pairs = bool(kinds & {"run1", "run2"})

    def zipped(w: Column, g: Column) -> Column:
        after = lambda x, d: F.slice(x, d + 1, F.greatest(F.size(x) - d, F.lit(0)))
        return F.arrays_zip(g, *[after(g, d) for d in gaps], *([w, after(w, 1)] if pairs else []))

    names = ["g0 long", *[f"g{d} long" for d in gaps], *(["w0 string", "w1 string"] if pairs else [])]
    shape = "array<struct<" + ",".join(n.replace(" ", ":") for n in names) + ">>"
    # outer: a plain explode would be preceded by a filter that computes all of this a second time
    z = let(F.col("words"), lambda w: let(blocks(w), lambda g: zipped(w, g))).cast(shape)
    each = rows.select(*keys, F.posexplode_outer(z).alias("at", "p"))
    made = {"run3": ["g0"], "run2": ["w0", "w1"], "run1": ["w0"], **{f"gap{d}": ["g0", f"g{d}"] for d in GAPS}}
    masks = [seed(k, *[F.col(f"p.{c}") for c in made[k]]) for k in sorted(kinds)]
    return each.select(*keys, "at", F.explode_outer(F.array(*masks) if masks else F.array().cast("array<long>")).alias("seed")).where("seed is not null")


def own_seeds(w: Column) -> Column:
    """kind, shift (from the window's start) and hash of the seeds of a window."""

    def made(g: Column) -> Column:
        one = lambda kind, shift, *parts: F.struct(F.lit(kind).alias("kind"), shift.cast("int").alias("shift"), seed(kind, *parts).alias("seed"))
        full = F.array(*[one(f"gap{d}", F.lit(i), F.get(g, F.lit(i)), F.get(g, F.lit(i + d))) for d in GAPS for i in range(0, WINDOW - d, BLOCK)])
        first = one("run3", F.lit(0), F.get(g, F.lit(0)))
        last = F.size(w) - BLOCK
        short = F.when(F.size(w) >= 2 * BLOCK, F.array(first, one("run3", last, F.get(g, last)))).when(F.size(w) >= BLOCK, F.array(first))
        tiny = F.when(F.size(w) == 2, F.array(one("run2", F.lit(0), F.get(w, F.lit(0)), F.get(w, F.lit(1))))).otherwise(F.array(one("run1", F.lit(0), F.get(w, F.lit(0)))))
        return F.when(F.size(w) == WINDOW, full).otherwise(F.coalesce(short, tiny))

    return let(blocks(w), made)


def compare_keys(w: Column) -> Column:
    """Hashes of which sequences of one length share at least one if they differ in no more words than may be changed.

    Of a full window: two blocks and two of the six other words, of which at most two are changed. So windows that share a
    common phrase alone do not meet here.
    """
    block = lambda i: F.slice(w, BLOCK * i + 1, F.lit(BLOCK))
    full = []
    for i, j in combinations(range(BLOCKS), 2):
        rest = F.concat(*[block(k) for k in range(BLOCKS) if k not in (i, j)])
        full += [F.xxhash64(F.lit(f"{i}{j}{k}"), block(i), block(j), F.slice(rest, 2 * k + 1, F.lit(2))) for k in range(BLOCK)]
    half = F.floor(F.size(w) / 2).cast("int")
    halves = [F.xxhash64(F.lit("first"), F.size(w), F.slice(w, F.lit(1), half)), F.xxhash64(F.lit("last"), F.size(w), F.slice(w, half + 1, F.size(w)))]
    return F.when(F.size(w) == WINDOW, F.array(*full)).when(F.size(w) >= 2 * BLOCK, F.array(*halves)).otherwise(F.array(F.xxhash64(F.lit("all"), w)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, tolerated: int = TOLERATED) -> DataFrame:
    """One row per row of `docs`: doc_id, text, contaminated, n_windows, n_items, first_item, longest.

    A window is 12 words of a benchmark item in a row, or the whole of a shorter item. It matches a document's words that differ from
    it in at most `tolerated` words (0 to 2) of 12, in proportion rounded down if it is shorter; a word that the document's end
    cuts off counts as changed. `n_windows` counts the places of a document where windows match, `n_items` the
    items they belong to, `first_item` is the smallest of these and `longest` the words of the longest window, so that callers
    can tell matches of very short items, which occur by chance. Words are compared without case and punctuation.

    Null or empty texts are clean; a null item or one without words matches nothing; equal items count once each in `n_items`;
    an empty benchmark leaves all documents clean; rows that repeat get the same verdict each; very long texts are searched
    whole; no result depends on the order of rows. Only doc_id, text, item_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    # Equal windows of many items are one window here, so a passage that all items share does not multiply hits.
    size = F.size("words")
    span = F.least(size, F.lit(WINDOW))
    windows = written(
        items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), size - span), lambda i: F.slice(F.col("words"), i + 1, span))).alias("w"))
        .select("item_id", "w", row_key("w").alias("window")),
        "windows",
    )
    distinct = windows.groupBy("window").agg(F.first("w").alias("w"))

    # Seeds that several windows share are one row for each place of the window's start, whatever the number of windows.
    tests = written(distinct.select(F.size("w").alias("n"), F.inline(own_seeds(F.col("w")))).select("kind", "seed", "shift", "n").distinct(), "seeds")
    kinds = {r["kind"] for r in tests.select("kind").distinct().collect()}
    few = tests.count() <= BROADCAST_SEEDS
    tests = tests.drop("kind")

    keyed = docs.select(row_key("doc_id", "text").alias("row"), tokens(F.col("text")).alias("words"))
    hits = seeds_of(keyed, ["row"], kinds).join(F.broadcast(tests) if few else tests, "seed").select("row", (F.col("at") - F.col("shift")).alias("start"), "n").where("start >= 0").distinct()
    hits = written(hits, "hits")

    # The words at the places found; texts come only for rows with hits.
    per_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("hits"))
    near = docs.select(row_key("doc_id", "text").alias("row"), "text")
    found = written(hits.select("row").distinct(), "hit-rows")
    near = near.join(F.broadcast(found), "row", "left_semi") if found.count() <= BROADCAST_ROWS else near
    near = near.join(per_row, "row").dropDuplicates(["row"]).select("row", tokens(F.col("text")).alias("words"), F.explode("hits").alias("h"))
    there = F.slice("words", F.col("h.start") + 1, F.col("h.n"))
    places = near.select("row", "h.start", F.concat(there, F.array_repeat(F.lit(""), F.col("h.n") - F.size(there))).alias("w"))
    places = written(places.select("row", "start", row_key("w").alias("words"), "w"), "places")

    # Each distinct sequence against the windows.
    theirs = written(distinct.select("window", "w", F.explode(compare_keys(F.col("w"))).alias("key")), "keys")
    theirs = F.broadcast(theirs) if theirs.count() <= BROADCAST_KEYS else theirs
    same = F.aggregate(F.zip_with("w", "v", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    mine = places.groupBy("words").agg(F.first("w").alias("v")).select("words", "v", F.explode(compare_keys(F.col("v"))).alias("key"))
    pairs = mine.join(theirs, "key").where((F.size("w") == F.size("v")) & (F.size("w") - same <= F.floor(F.size("w") * tolerated / WINDOW))).select("words", "window", F.size("w").alias("n")).distinct()
    pairs = written(pairs, "pairs")

    sure = places.select("row", "start", "words").join(pairs, "words").select("row", "start", "window", "n")
    found = sure.join(windows.select("window", "item_id").distinct(), "window").groupBy("row").agg(F.countDistinct("start").alias("n_windows"), F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("n").alias("longest"))
    out = docs.withColumn("row", row_key("doc_id", "text")).join(written(found, "contaminated"), "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "text", F.col("n_windows").isNotNull().alias("contaminated"), zero("n_windows"), zero("n_items"), "first_item", zero("longest"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


def _sql() -> str:
    words = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH i AS (SELECT row_number() OVER () AS ir, item_id, {words} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, k + 1, k + least(len(w), {WINDOW})) AS w
       FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS k FROM i WHERE len(w) >= 1)),
win AS (SELECT row_number() OVER () AS win, w FROM (SELECT DISTINCT w FROM iw)),
wp AS (SELECT win, len(w) AS n, unnest(range(0, len(w))) AS k, unnest(w) AS word FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
dp AS (SELECT r, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM d),
dt AS (SELECT r, p, word, lead(word) OVER x AS w1, lead(word, 2) OVER x AS w2 FROM dp WINDOW x AS (PARTITION BY r ORDER BY p)),
wt AS (SELECT win, n, k, word, lead(word) OVER x AS w1, lead(word, 2) OVER x AS w2 FROM wp WINDOW x AS (PARTITION BY win ORDER BY k)),
place AS (SELECT DISTINCT dt.r, wt.win, wt.n, dt.p - wt.k AS start FROM dt JOIN wt ON dt.word = wt.word AND dt.w1 = wt.w1 AND dt.w2 = wt.w2 WHERE dt.p >= wt.k
          UNION SELECT dp.r, wp.win, wp.n, dp.p FROM dp JOIN wp ON dp.word = wp.word AND wp.k = 0 AND wp.n < 3),
same AS (SELECT place.r, place.win, place.n, place.start, count(*) AS m FROM place JOIN wp USING (win)
         JOIN dp ON dp.r = place.r AND dp.p = place.start + wp.k AND dp.word = wp.word GROUP BY ALL),
ok AS (SELECT r, win, start, n FROM same WHERE m >= n - n * {TOLERATED} // {WINDOW}),
f AS (SELECT r, count(DISTINCT start) AS n_windows, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, max(n) AS longest
      FROM ok JOIN win USING (win) JOIN iw ON iw.w = win.w GROUP BY r)
SELECT d.doc_id, f.r IS NOT NULL AS contaminated, coalesce(n_windows, 0)::BIGINT AS n_windows, coalesce(n_items, 0)::BIGINT AS n_items, first_item, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN f USING (r)"""


QUERIES = {"op5_decontaminate": op5_decontaminate}
SQL = {"op5_decontaminate": _sql()}
