"""Quality rules: a threshold table compiled into one projection of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import let, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages of the corpus.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with", "on", "are", "as", "be", "this", "by", "or", "an", "at"),
    "fr": ("le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "pas", "sur", "avec", "elle", "on"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "auf", "ein", "eine", "für", "im", "dem", "nicht"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "del", "se", "lo", "es", "para"),
}
#: name -> (least, most) of the ratio; None: no bound. `RATIOS` says what each ratio is.
THRESHOLDS: dict[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (2.0, 15.0),
    "symbols_per_word": (None, 0.25),
    "upper_share": (None, 0.5),
    "letter_word_share": (0.6, None),
    "stop_word_share": (0.01, None),
    "dup_line_share": (None, 0.5),
    "stutter_share": (None, 0.3),
}
RATIOS: dict[str, tuple[str, str]] = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "letter_word_share": ("n_letter_words", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "stutter_share": ("n_stutters", "n_words"),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first time included."""

    def marked(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        def twice(s: Column) -> Column:
            at = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
            return let(F.array_sort(F.array_compact(at)), covered)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, twice))

    grams = let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return let(grams, marked)


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Counts of a text, all long. `words` is a column that holds the text's words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    stops = sorted({w for some in STOP_WORDS.values() for w in some})
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(",.;:!?"))).isin(stops))),
        "n_stutters": F.size(F.filter(F.transform(words, lambda w, i: w == F.get(words, i - 1)), lambda x: x)),
    }
    return {k: v.cast("long") for k, v in out.items()}


def verdict(thresholds: dict[str, tuple[float | None, float | None]] | None = None) -> Column:
    """The threshold table as one boolean expression over the counts; a ratio over nothing passes."""
    passed = F.lit(True)
    for name, (least, most) in (thresholds or THRESHOLDS).items():
        part, whole = (F.col(c) for c in RATIOS[name])
        if least is not None:
            passed = passed & (part >= whole * F.lit(least))
        if most is not None:
            passed = passed & (part <= whole * F.lit(most))
    return passed


def quality_rules(docs: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """One row per document: doc_id, counts, base_failed and kept.

    A null or empty text has no words and fails the base rule. Rows that repeat are each judged; an empty
    table gives no rows; other columns of `docs` are not read. Whole texts are counted. Three-word windows
    are compared by 64-bit hashes within one text.
    """
    text = F.col("text")
    counted = docs.select("doc_id", "text", words_of(text).alias("words")).select("doc_id", *[v.alias(k) for k, v in measures(text, F.col("words")).items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for some in STOP_WORDS.values() for w in some}))
    tests = []
    for name, (least, most) in THRESHOLDS.items():
        part, whole = RATIOS[name]
        tests += [f"{part} >= {whole} * {least!r}::DOUBLE"] * (least is not None) + [f"{part} <= {whole} * {most!r}::DOUBLE"] * (most is not None)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
word AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
gram AS (SELECT r, i, w, lead(w, 1) OVER x AS w1, lead(w, 2) OVER x AS w2 FROM word WINDOW x AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS c FROM gram WHERE w2 IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) t(k) GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
         len(list_filter(w, lambda x: lower(rtrim(x, ',.;:!?')) IN ({stops})))::BIGINT AS n_stop_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters
  FROM d LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM f"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL = {"op4_quality_rules": _sql()}
