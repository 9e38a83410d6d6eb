"""A small table with every awkward row, and the given tables at the smallest size."""

import random

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Null ids and texts, empty and blank texts, a very long text, exact and near copies, repeated rows."""
    draw = random.Random(7)
    words = ["the", "of", "and", "Wald", "été", "río", "stone", "river", "cloud", "lamp", "path", "field"] + [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = prose(120)
    parts = base.split()
    near = " ".join(["changed", *parts[1:]])
    far = " ".join(x if i % 6 else "other" for i, x in enumerate(parts))
    texts = [None, "", " \n\t ", "one", "two words", base, base, near, far, base.upper(), prose(5000), "mail a.b@c.org, call +1 (555) 010-9999", "#" * 30, "x\n" * 40, "1.2.3.4 and 4111 1111 1111 1111"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s1", 1), (None, None, None, None, None)]
    rows += [(100 + i, prose(60 + i), "en", "hot", 1) for i in range(30)]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def clashing(df):
    """Extra columns named like results and intermediates."""
    from pyspark.sql import functions as F

    for c in ("shard", "slot", "block", "place", "kept", "words", "row", "spans", "score", "h", "rep", "component", "seed", "digest", "quality_score", "n_tokens", "a.b"):
        df = df.withColumn(c, F.lit("extra"))
    return df
