"""Personal data: identifiers by pattern, and terms that reveal them by information content.

Identifiers (the protected entities) are matched by patterns. The corpus then tells how strongly a term reveals an entity: of
the c_t texts that hold the term, c_et hold the entity too, and -log2 P(e | t) bits of uncertainty about the entity are left to who knows
the term. P(e | t) is not taken as c_et / c_t, which one observation would make certain, but as the lower end of its confidence interval
(Wilson's, at Z deviations), so what a term reveals must be seen often enough, whatever the size of the corpus. Equal texts are one
observation. Terms that leave at most BITS are sanitised wherever they stand in the texts that hold that entity, like the entity itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.llm.common import folded, let, row_key, written

SPAN = "array<struct<start:int,stop:int,value:string>>"
KINDS = ("email", "ip", "card", "phone")
#: The base patterns in possessive form: each part ends where its character class does, so nothing is ever given
#: back and long runs cost linear time. A match starts at the start of a run or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that texts without a match of the kind fail.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
REPLACED = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}
#: A term is a run of letters and marks of any length, compared in lower case.
WORD = "[\\p{L}\\p{M}]++"
#: A term is generalised when it leaves at most so many bits about an entity, and the deviations of the confidence interval (one-sided 95 %).
BITS, Z = 1.0, 1.645
#: Up to so many keys of repeated texts are broadcast (24 bytes each).
BROADCAST_TEXTS = 500_000


def matches(text: Column, pattern: str | Column) -> Column:
    """Start, stop (code points) and value of the non-overlapping matches, in order."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def step(at: Column, x: Column) -> Column:
        start, stop = at + x["gap"], at + x["gap"] + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("value")))
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(x["hit"].isNotNull(), span).otherwise(F.array().cast(SPAN)).alias("out"))

    return folded(pieces, F.lit(0), SPAN, step)["out"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda n, x: n + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def small_part(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short) <= 3, short).try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, "\\.", -1), small_part),
    "card": lambda v: F.length(digits_of(v)).between(16, 19) & luhn(digits_of(v)),
    "phone": lambda v: F.length(digits_of(v)).between(8, 15),
}


def identifiers(text: Column, kind: str) -> Column:
    """The valid base spans of a kind; matches that fail the kind's test are dropped."""
    seen = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(seen, F.filter(matches(text, PATTERNS[kind]), lambda s: VALID[kind](s["value"]))).otherwise(F.array().cast(SPAN))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so all other characters keep their places."""

    def step(at: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, at + 1, s["start"] - at), F.repeat(F.lit(" "), s["stop"] - F.greatest(at, s["start"])))
        return F.struct(F.greatest(at, s["stop"]).alias("at"), F.array(piece).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    return let(folded(ordered, F.lit(0), "array<string>", step), lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (all identifiers in the order of kinds), entities, blank (the text without identifiers; null if it has none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_key(text).alias("text_key"), text.alias("text"))
    rows = rows.select("*", *[identifiers(F.col("text"), k).alias(k) for k in KINDS])
    tag = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
    rows = rows.select("doc_id", "text_key", "text", F.concat(*[tag(k) for k in KINDS]).alias("base"))

    def entity(s: Column) -> Column:
        return F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(digits_of(s["value"])))

    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.select("doc_id", "text_key", bare.alias("base"), F.array_distinct(F.transform("base", entity)).alias("entities"), F.when(F.size("base") > 0, blanked(F.col("text"), F.col("base"))).alias("blank"))


def term_set(text: Column) -> Column:
    """The distinct lower-case terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{M}]++", -1)), "")


def groups_of(holders: DataFrame) -> DataFrame:
    """Groups of entities that stand in the same texts, which terms reveal alike: text_key, group, c_e."""
    of_text = holders.select("text_key", F.explode("entities").alias("entity"))
    part = lambda k, c: F.sum(F.xxhash64(F.lit(k), "text_key").cast("decimal(20,0)")).alias(c)
    alike = of_text.groupBy("entity").agg(part(1, "x"), part(2, "y"), F.count("*").alias("c_e"))
    alike = alike.select("entity", "c_e", row_key(F.col("x").cast("string"), F.col("y").cast("string"), F.col("c_e")).alias("group"))
    return of_text.join(alike, "entity").select("text_key", "group", "c_e").distinct()


def lowest(hits: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the confidence interval of a probability of which `hits` of `n` observations are known."""
    p, z2 = hits / n, z * z
    return (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def term_counts(docs: DataFrame) -> DataFrame:
    """term, c_t: the number of different texts that hold each term. A text that is repeated counts for a part in each of its rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(row_key(text).alias("text_key"), text.alias("text"))
    again = written(rows.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1"), "pii-repeated")
    again = F.broadcast(again) if again.count() <= BROADCAST_TEXTS else again
    each = rows.join(again, "text_key", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(term_set(F.col("text"))).alias("term"))
    return each.groupBy("term").agg(F.round(F.sum(1 / F.col("copies"))).cast("long").alias("c_t"))


def revealing(holders: DataFrame, docs: DataFrame, bits: float = BITS, z: float = Z) -> DataFrame:
    """text_key, term, bits: of each term of each of the texts `holders(text_key, entities, blank)` the fewest bits that it leaves about
    one of the text's entities, where these are at most `bits`. Counted over whole texts.

    Pairs that cannot get there are dropped before they are counted: the bound lies below c_et / c_t, so below c_e / c_t, and
    below c_et / (c_et + z^2), which both c_e and c_t have to allow. Such terms and entities are most, as most occur once.
    """
    least = 2.0**-bits
    often = least * z * z / (1 - least) * (1 - 1e-9) if least < 1 else float("inf")
    groups = written(groups_of(holders).where(F.col("c_e") >= often), "pii-groups")
    counts = term_counts(docs).where(F.col("c_t") >= often)
    near = holders.join(groups.groupBy("text_key").agg(F.max("c_e").alias("most")), "text_key")
    here = near.select("text_key", "most", F.explode(term_set(F.col("blank"))).alias("term")).join(counts, "term").where(F.col("c_t") * least <= F.col("most") * (1 + 1e-9))
    pairs = written(here.drop("most"), "pii-terms").join(groups, "text_key").where(F.col("c_t") * least <= F.col("c_e") * (1 + 1e-9))
    told = pairs.groupBy("group", "term").agg(F.count("*").alias("c_et"), F.max("c_t").alias("c_t"))
    told = told.select("group", "term", (-F.log2(lowest(F.col("c_et"), F.col("c_t"), z))).alias("bits")).where(F.col("bits") <= bits)
    return pairs.select("text_key", "group", "term").join(told, ["group", "term"]).groupBy("text_key", "term").agg(F.min("bits").alias("bits"))


def found_holders(base: DataFrame) -> DataFrame:
    """The distinct texts with identifiers: text_key, entities, blank."""
    return base.where(F.size("entities") > 0).groupBy("text_key").agg(F.first("entities").alias("entities"), F.first("blank").alias("blank"))


def word_places(texts: DataFrame) -> DataFrame:
    """text_key, term, start, stop of every place of every term of `texts(text_key, blank)`.

    The words of a text become rows, whose places are running sums of lengths, so a long text costs no more a word than a short one.
    """
    words = F.regexp_extract_all("blank", F.lit(WORD), F.lit(0))
    pieces = F.arrays_zip(F.transform(F.split("blank", WORD, -1), lambda gap: F.length(gap)).alias("gap"), words.alias("word"))
    rows = texts.select("text_key", F.posexplode_outer(pieces).alias("k", "p")).where("p.word is not null").select("text_key", "k", F.col("p.word").alias("word"), (F.col("p.gap") + F.length("p.word")).alias("n"))
    stop = F.sum("n").over(W.partitionBy("text_key").orderBy("k"))
    return rows.withColumn("stop", stop.cast("int")).select("text_key", F.lower("word").alias("term"), (F.col("stop") - F.length("word")).alias("start"), "stop")


def find_personal_data(docs: DataFrame, bits: float = BITS, z: float = Z) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key (of the content), spans (array of kind, start, stop; kinds in order, then start).

    Kinds are email, ip, card, phone and term. A null text is empty and has no spans; repeated rows each get a row, and
    equal texts are one observation; an empty table gives no rows; all terms at the limit are kept, so no result depends on the order of rows.
    Only doc_id and text are read. Whole texts, however long; starts and stops are code points.
    A disclosing term is marked wherever it stands in a text that holds its entity.
    """
    docs = docs.select("doc_id", "text")
    base = written(base_table(docs), "pii-base")
    holders = written(found_holders(base), "pii-holders")
    told = written(revealing(holders, docs, bits, z).select("text_key", "term"), "pii-told")
    placed = word_places(holders.join(told.select("text_key").distinct(), "text_key", "left_semi")).join(told, ["text_key", "term"])
    found = placed.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "stop"))).alias("terms"))
    spans = F.concat("base", F.coalesce("terms", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))
    plain = F.size("entities") == 0
    rows = base.where(~plain).join(written(found, "pii-found"), "text_key", "left").select("doc_id", "text_key", spans.alias("spans"))
    return rows.unionByName(base.where(plain).select("doc_id", "text_key", F.col("base").alias("spans")))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind; a span that begins inside the one before is part of it."""
    names = F.create_map(*[F.lit(x) for kv in REPLACED.items() for x in kv])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("o"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, at + 1, s["start"] - at), names[s["kind"]])
        return F.struct(F.greatest(at, -s["o"]).alias("at"), F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(F.array(piece)).alias("out"))

    return let(folded(ordered, F.lit(0), "array<string>", step), lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text and sanitised text of every row, with the options of `find_personal_data`.

    A null text becomes the empty one; rows with equal texts are sanitised alike; a null doc_id is kept; an empty table gives no rows; whole
    texts, however long; spans that overlap are replaced once. Only doc_id and text are read, whatever other columns are called.
    """
    spans = find_personal_data(docs, **options).where(F.size("spans") > 0).select("text_key", "spans").dropDuplicates(["text_key"])
    keyed = docs.select("doc_id", "text", row_key(F.coalesce("text", F.lit(""))).alias("text_key"))
    clean = F.coalesce("text", F.lit(""))
    return keyed.join(spans, "text_key", "left").select("doc_id", "text", F.when(F.col("spans").isNull(), clean).otherwise(replaced(clean, F.col("spans"))).alias("sanitised"))


def digest_columns(found: DataFrame) -> DataFrame:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "term"), one), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"), count("term"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
