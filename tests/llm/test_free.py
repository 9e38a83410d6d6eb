"""Operators 2, 3, 7, 8 and 10 and the pipeline against brute force, round trips and held-out labels."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import FOLDER, SCHEMA, awkward, awkward_rows, clashing
from pyspark.sql import functions as F

import corpus_pipeline
from sparktrace.llm import graph, language_id, near_dedup, quality_classifier, text_arrays, token_counts, warc
from sparktrace.llm.common import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b, percent=85):
    n = len(a & b)
    return bool(a and b) and 100 * n >= percent * (len(a) + len(b) - n)


def brute_components(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    ids = sorted({d for d, _ in sets})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, z in sets[:i]:
            if linked(s, z, percent):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_shingle_sets_match_words():
    for t in ("", " a ", "A b\tc D e f", "é è ê ë ē x y", "one two three four", "a a a a a a a a"):
        assert len(text_arrays.shingle_set(np.frombuffer(t.encode(), dtype=np.uint8))) == len(shingles(t))
    one, two = (text_arrays.shingle_set(np.frombuffer(t, dtype=np.uint8)) for t in (b"A b C d E f", b"a  b\nc d e F"))
    assert np.array_equal(one, two)


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in awkward_rows() if i is not None]
    out = near_dedup.near_duplicates(clashing(awkward(spark))).collect()
    want = brute_components(rows)
    assert len(out) == len(awkward_rows())
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert Counter((r["doc_id"], r["n_shingles"]) for r in out) == Counter((i, len(shingles(t))) for i, t, *_ in awkward_rows())
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_with_a_large_group_and_chains(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # so that buckets span several blocks
    draw = random.Random(3)
    base = [f"w{draw.randrange(10000)}" for _ in range(150)]
    rows = []
    for i in range(120):  # copies with up to 5 changed words: near and far from each other
        w = list(base)
        for _ in range(draw.randrange(6)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10000)}"
        rows.append((i * 7 % 1000, " ".join(w)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(12):  # each is near the next only
        rows.append((2000 + (i * 5) % 12, " ".join(chain)))
        chain = [*chain[3:], *[f"n{i}_{k}" for k in range(3)]]
    rows += [(3000 + i, " ".join(f"r{draw.randrange(10**6)}" for _ in range(80))) for i in range(30)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert out == brute_components(rows)


def test_rows_that_share_an_id_are_one_document(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(5, text("a")), (5, text("b")), (5, text("c")), (2, text("b")), (9, text("c")), (7, text("a")), (8, text("d")), (8, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    out = Counter((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert out == Counter({(5, 2): 3, (2, 2): 1, (9, 2): 1, (7, 2): 1, (8, 8): 2})


def test_threshold_of_near_duplicates(spark):
    draw = random.Random(5)
    rows = []
    for i in range(30):
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for k in range(4):  # four changed words of 200, apart from each other: similarity 176 / 216
            words[20 + 45 * k + i % 7] = f"x{i}_{k}"
        rows.append((2 * i + 1, " ".join(words)))
    assert all(0.8 < len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.85 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    kept = lambda percent: {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER, percent).collect()}
    assert kept(80) == {d for d, _ in rows[::2]} and kept(85) == {d for d, _ in rows}


def test_equal_signature_bytes_are_not_a_shared_bucket(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")
    first, second = near_dedup.fingerprints(docs).orderBy("doc_id").collect()
    # the bytes agree in all bands, the keys differ in band 0 and meet in band 1
    bands = [list(first["bands"]), [first["bands"][0] + 1, *first["bands"][1:]]]
    rows = [(r["doc_id"], r["n_shingles"], first["codes"], b) for r, b in zip((first, second), bands)]
    classes = spark.createDataFrame(rows, "rep long, n_shingles long, codes binary, bands array<long>")
    buckets = spark.createDataFrame([(first["bands"][1], 1, i, 2) for i in (1, 2)], "h long, band int, rep long, size long")
    named = spark.createDataFrame([], "node long, component long")
    assert [tuple(r) for r in near_dedup.crossing(buckets, named, classes, docs).collect()] == [(1, 2)]


def test_posterior_bound_is_monotone_and_cautious():
    bounds = near_dedup.batches_of()
    assert all(0 < m < n for n, m in bounds) and [m for _, m in bounds] == sorted(m for _, m in bounds)
    assert bounds[-1][1] / bounds[-1][0] < 0.85


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    out = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert out == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("split", [777, 20_000, 1 << 30])
def test_archives_round_trip(spark, split):
    noise = random.Random(1).randbytes(40_000).decode("latin-1")
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, "http://c", "same"), (1, None, None), (2, "x y\r\nz", ""), (7, "http://n", noise), (8, "http://é", "é" * 3000), (3, "http://b", "same"), (None, "u", "same"), (11, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\x8b\x08")]
    folder = new_folder(spark, "warc")
    warc.write_archives(clashing(spark.createDataFrame(rows, PAGES)).repartition(3), folder)
    got = warc.read_archives(spark, folder, split).withColumns({"page_id": warc.page_of("record_id"), "refers_to": warc.page_of("refers_to")}).collect()
    assert all(r["damage"] is None for r in got)
    first = {}
    for p, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", p)
    want = Counter()
    for p, _, h in rows:
        again = p is not None and first[h or ""] != p
        want[p, len((h or "").encode()), warc.digest((h or "").encode()), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert want == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    assert {r["payload"] for r in got if r["page_id"] == 7} == {noise.encode()}


def test_archives_are_plain_gzip(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a", "text")], PAGES).coalesce(1), f"file://{tmp_path}/w")
    body = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.warc.gz"))
    assert body.startswith(b"WARC/1.1\r\n") and body.endswith(b"text\r\n\r\n")


def test_small_payloads_are_all_responses(spark):
    folder = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "longer"), (4, "d", "longer")], PAGES), folder, least_revisit=3)
    rows = warc.read_archives(spark, folder).select(warc.page_of("record_id").alias("page_id"), "record_type").collect()
    assert {r["page_id"]: r["record_type"] for r in rows} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def archive(folder, *members):
    folder.mkdir(exist_ok=True)
    (folder / "x.warc.gz").write_bytes(b"".join(members))
    return f"file://{folder}"


def foreign(record_id, block, kind="response", more="", level=6):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", level)


HTTP = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"


@pytest.mark.parametrize("split", [50, 4096, 1 << 30])
def test_archives_of_other_writers(spark, tmp_path, split):
    """Any record ids and digests, other record types, folded and very long headers, records without a digest."""
    sha256 = hashlib.sha256(b"two").hexdigest()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    folder = archive(
        tmp_path / "a",
        foreign("<urn:uuid:0>", b"software: x", "warcinfo"),
        foreign("<urn:uuid:1>", HTTP + b"one"),
        foreign("<urn:uuid:2>", HTTP + b"two", more=f"WARC-Payload-Digest: sha256:{sha256}\r\n"),
        foreign("<urn:uuid:3>", HTTP + b"three", more=f"WARC-Target-URI: http://x/{random.Random(2).randbytes(400_000).hex()}\r\nX-Folded: a\r\n  b\r\n"),
        foreign("<urn:uuid:4>", chunked, more="WARC-Payload-Digest: sha1:OFTHEBODYWITHOUTCHUNKS\r\n"),
        foreign("<urn:uuid:5>", HTTP, "revisit", "WARC-Refers-To: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:ABC\r\n"),
        foreign("<urn:uuid:6>", b"\x00\x01", "resource", "Content-Type: image/png\r\n", level=0),
    )
    rows = {r["record_id"]: r for r in warc.read_archives(spark, folder, split).collect()}
    assert {k: (r["record_type"], r["payload"]) for k, r in rows.items()} == {
        "<urn:uuid:0>": ("warcinfo", b"software: x"), "<urn:uuid:1>": ("response", b"one"), "<urn:uuid:2>": ("response", b"two"), "<urn:uuid:3>": ("response", b"three"),
        "<urn:uuid:4>": ("response", b"3\r\nabc\r\n0\r\n\r\n"), "<urn:uuid:5>": ("revisit", None), "<urn:uuid:6>": ("resource", b"\x00\x01"),
    }
    assert rows["<urn:uuid:1>"]["payload_digest"] == warc.digest(b"one") and rows["<urn:uuid:5>"]["refers_to"] == "<urn:uuid:1>" and rows["<urn:uuid:5>"]["payload_digest"] == "ABC"


@pytest.mark.parametrize("split", [50, 1 << 30])
def test_damage_is_never_silent(spark, tmp_path, split):
    good, other = foreign("<a>", HTTP + random.Random(3).randbytes(3000)), foreign("<z>", HTTP + b"z")
    flipped = bytearray(good)
    flipped[-5] ^= 255  # in the checksum
    inside = bytearray(good)
    inside[len(good) // 2] ^= 255
    short = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nabc")
    headless = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc")
    wrong = foreign("<w>", HTTP + b"w", more=f"WARC-Payload-Digest: sha1:{warc.digest(b'v')}\r\n")
    cases = {"checksum": bytes(flipped), "byte": bytes(inside), "short": short, "headless": headless, "digest": wrong, "other": gzip.compress(b"no record at all"), "noise": b"noise" * 9}
    for name, bad in cases.items():
        folder = archive(tmp_path / name, good, bad, other)
        with pytest.raises(Exception, match="warc.gz"):
            warc.read_archives(spark, folder, split).collect()
        rows = warc.read_archives(spark, folder, split, "keep").collect()
        assert {r["record_id"] for r in rows if r["damage"] is None} == {"<a>", "<z>"} and any(r["damage"] for r in rows), name
    for cut in (3, 40, len(good) // 2):
        rows = warc.read_archives(spark, archive(tmp_path / f"cut{cut}", other, good[:-cut]), split, "keep").collect()
        assert [r["damage"] is None for r in sorted(rows, key=lambda r: r["damage"] or "")] == [True, False] and "inside a record" in max(r["damage"] or "" for r in rows)
    rows = warc.read_archives(spark, archive(tmp_path / "lead", b"xx", good), split, "keep").collect()
    assert sorted(bool(r["damage"]) for r in rows) == [False, True]


def test_token_counts_and_cache(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = new_folder(spark, "cache")
    rows = awkward_rows() + [(500, "<s> </s> <unk> ▁x", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in rows)
    for _ in range(2):
        assert Counter(tuple(r) for r in token_counts.count_tokens(clashing(docs), path, cache).collect()) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows})
    other = spark.createDataFrame([(bytes(32), 5, "another")], token_counts.CACHE)
    other.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert token_counts.known_counts(spark, cache, "another").count() == 1
    more = docs.unionByName(spark.createDataFrame([(900, "a new text", "en", "s", 0)], SCHEMA))
    token_counts.count_tokens(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows}) + 2


def test_classifier_on_held_out_labels(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.97 * len(out) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_classifier_ignores_held_out_labels_and_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def brute_score(p, bag):
    """A bag's score by loops over passages and units."""
    from math import exp, tanh

    hidden, attention = [], []
    for x in bag:
        z = [(a - m) / s for a, m, s in zip(x, p["mean"], p["scale"])]
        h = [tanh(sum(a * w for a, w in zip(z, p["W"][:, j])) + p["b"][j]) for j in range(p["W"].shape[1])]
        e = 0.0
        for j in range(p["V"].shape[1]):
            gate = 1 / (1 + exp(-sum(a * w for a, w in zip(h, p["U"][:, j]))))
            e += p["w"][j] * tanh(sum(a * w for a, w in zip(h, p["V"][:, j]))) * gate
        hidden.append(h)
        attention.append(exp(e))
    pooled = [sum(a * h[j] for a, h in zip(attention, hidden)) / sum(attention) for j in range(len(hidden[0]))]
    return 1 / (1 + exp(-sum(a * b for a, b in zip(pooled, p["c"])) - p["d"]))


def test_classifier_forward_and_gradient_equal_brute_force():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality_classifier.FEATURES)) for n in (3, 1, 5, 2)]
    labels, weight = np.array([0.0, 1, 0, 1]), np.array([0.5, 1.5, 1.0, 1.0])
    p = {k: rng.normal(0, 0.3, s) for k, s in quality_classifier.SHAPE.items()} | {"mean": rng.normal(size=63), "scale": rng.uniform(0.5, 2, 63)}
    x, starts = np.concatenate(bags), np.array([0, 3, 4, 9])
    assert np.allclose(quality_classifier.forward(p, x, starts)[0], [brute_score(p, b) for b in bags])

    def loss(q):
        s = quality_classifier.forward(q, x, starts)[0]
        return -(weight * (labels * np.log(s) + (1 - labels) * np.log(1 - s))).mean()

    grad = quality_classifier.gradient(p, x, starts, labels, weight)
    for k, shape in quality_classifier.SHAPE.items():
        for at in [tuple(rng.integers(0, n) for n in shape) for _ in range(4)]:
            up, down = ({**p, k: np.array(p[k], dtype=float)} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - np.asarray(grad[k])[at]) < 1e-6, k


def test_classifier_takes_all_passages_of_its_documents(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality_classifier, "train", lambda bags, labels: seen.update(n=[len(b) for b in bags]))
    docs = spark.createDataFrame([(i, "a word " * 32 * (1 if i else 300)) for i in range(9)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    quality_classifier.fit(docs, labels)
    ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(seen["n"]) == sorted(300 if i == 0 else 1 for i in ids)
    quality_classifier.fit(docs, labels, passages=2)
    assert seen["n"] == [1, 1]  # the long one is passed over, wherever the hash puts it
    for long in ids:
        docs = spark.createDataFrame([(i, "a word " * 32 * (300 if i == long else 1)) for i in range(9)], "doc_id long, text string")
        seen.clear()
        quality_classifier.fit(docs, labels, passages=299)
        assert seen["n"] == [1] * (len(ids) - 1)


def test_classifier_on_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(110)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(clashing(awkward(spark)), labels).count() == len(awkward_rows())
    assert {r["score"] for r in quality_classifier.classify(awkward(spark), labels.limit(0)).collect()} == {0.5}


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet")
    out = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out) > 100


def test_language_average_equals_brute_force():
    def grams(text):
        x = b" " + re.sub(rb"[ \t-\r]+", b" ", text.translate(LOWER).encode()) + b" "
        out = Counter()
        for n in language_id.GRAMS:
            for i in range(len(x) - n + 1):
                h = 0
                for byte in x[i : i + n]:
                    h = (h * 0x01000193 ^ byte) & 0xFFFFFFFF
                out[((h ^ n * 0x9E37) * 0x85EBCA6B & 0xFFFFFFFF) >> 19] += 1
        return out

    for text in ("", "A", "Été  at\n\tsea, the sea", "x" * 500):
        want, got = grams(text), language_id.gram_counts(np.frombuffer(text.encode(), dtype=np.uint8))
        assert set(np.flatnonzero(got)) == set(want) and all(abs(got[k] - v / sum(want.values())) < 1e-6 for k, v in want.items())


def test_temperature_and_rejection():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 2000)
    logits = rng.normal(0, 1, (2000, 3))
    logits[np.arange(2000), y] += 2.5
    # of normal scores with unit spread the posterior's are 2.5 times the scores, so these are twice as sure as they should be
    temperature, least = language_id.calibrated(logits * 5, y)
    assert temperature == 2.0
    p = language_id.softmax(logits * 2.5)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    assert abs((right < least).mean() - language_id.LOST) < 2e-3


def test_predictions_equal_loops_over_the_model(spark):
    """What the query returns for every row, from the model and the text alone: languages by grams, quality by passages."""
    from math import exp

    docs, labels = awkward(spark), spark.createDataFrame([(i, i % 2) for i in range(140)], "doc_id long, quality int")
    model, found = language_id.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en"))), {}
    for r in language_id.identify(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x = language_id.gram_counts(np.frombuffer(r["text"].encode(), dtype=np.uint8))
        z = [sum(float(x[k]) * float(model["fold"][k, j]) for k in np.flatnonzero(x)) / model["temperature"] + float(model["bias"][j]) / model["temperature"] for j in range(len(model["langs"]))]
        p = [exp(v - max(z)) for v in z]
        assert abs(r["score"] - max(p) / sum(p)) < 1e-4
        found[r["lang_pred"]] = True
        assert p[model["langs"].index(r["lang_pred"])] > max(p) * (1 - 1e-4) and r["rejected"] == (r["score"] < model["least"])
    assert found
    fitted = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs.where("length(text) < 2000 or text is null"), fitted).collect()
    assert len(rows) > 30
    for r in rows:
        assert abs(r["quality_score"] - brute_score(fitted, quality_classifier.encode(np.frombuffer((r["text"] or "").encode(), dtype=np.uint8)))) < 1e-6


def test_text_in_no_learned_language_is_rejected(spark):
    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(docs)
    strange = spark.createDataFrame([(i, "".join(chr(0x4E00 + (i * 37 + k * 101) % 5000) for k in range(80))) for i in range(20)], "doc_id long, text string")
    known = language_id.identify(docs.select("doc_id", "text").where("lang is not null").limit(200), model)
    share = lambda df: df.agg(F.avg(F.col("rejected").cast("double"))).first()[0]
    assert share(language_id.identify(strange, model)) >= 0.5 and share(known) < 0.1


def test_languages_of_awkward_rows(spark):
    out = language_id.language_id(clashing(awkward(spark))).collect()
    assert len(out) == len(awkward_rows())
    texts = {i: t for i, t, *_ in awkward_rows()}
    for r in out:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    quality = corpus_pipeline.quality(spark, docs, FOLDER)
    known = spark.read.parquet(f"{FOLDER}/labels.parquet")
    clean = {r["doc_id"] for r in known.where("quality = 1").join(docs, "doc_id").collect()}
    kept = {r["doc_id"] for r in quality.collect()}
    assert quality.columns == docs.columns and len(clean - kept) <= 0.05 * len(clean)
    near = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()}
    root = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
    assert near == {d for d, c in root.items() if d == c}
    mixed = corpus_pipeline.mixture(spark, docs, FOLDER)
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, docs.collect()))
    last = corpus_pipeline.shards(spark, docs, FOLDER)
    assert Counter(map(tuple, last.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))


def test_near_duplicate_stage_keeps_one_row_of_each_document(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(7, text("a"), "en", "s", 1)] * 50 + [(9, text("a"), "en", "s", 1), (5, text("b"), "en", "s", 1), (5, text("b"), "en", "r", 1), (6, None, "en", "s", 0), (6, None, "en", "s", 0), (None, text("a"), None, None, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), FOLDER)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert Counter(map(tuple, out.collect())) == Counter({rows[0]: 1, (5, text("b"), "en", "r", 1): 1, rows[-2]: 1, rows[-1]: 1})


def test_benchmark_stage_equals_brute_force(spark):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = {tuple(w[k : k + 12]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if (w := words(r["text"])) for k in range(max(1, len(w) - 11))}
    heads = {x[i : i + 3] for x in items for i in range(len(x) - 2)}
    clean = set()
    for r in docs.collect():
        w = words(r["text"])
        near = {k - i for k in range(len(w) - 2) if tuple(w[k : k + 3]) in heads for i in range(10)}
        if not any(sum(a == b for a, b in zip(x, w[max(at, 0) :])) >= 10 for at in near if at >= 0 for x in items):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, FOLDER).collect()} == clean and len(clean) < docs.count()


def test_mixture_stage_is_in_the_order_of_its_schedule(spark):
    rows = [(i, f"t{i}", "en", s, 0) for i, s in enumerate(["hot"] * 400 + ["a"] * 120 + ["b"] * 30)]
    out = [r["source"] for r in corpus_pipeline.mixture(spark, spark.createDataFrame(rows, SCHEMA), FOLDER).collect()]
    sizes = Counter(r[3] for r in rows)
    share = {s: n**0.7 / sum(x**0.7 for x in sizes.values()) for s, n in sizes.items()}
    for t in range(160, len(out), 16):
        seen = Counter(out[:t])
        assert all(abs(seen[s] - share[s] * t) <= 2 * 16 for s in share)


def test_pipeline_gives_sources_their_target_shares(spark, tmp_path):
    draw = random.Random(9)
    sizes = {"hot": 400, "a": 90, "b": 25, "": 6}
    sources = [s or None for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(20)), "en", s, 0) for i, s in enumerate(sources)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(r["doc_id"], r["source"] or "") for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    target = {s: n**0.7 / sum(x**0.7 for x in sizes.values()) for s, n in sizes.items()}
    seen, copies = Counter(s for _, s in rows), Counter(d for d, _ in rows)
    assert set(copies) == set(range(len(sources))) and seen["hot"] == 400
    assert all(abs(seen[s] - target[s] * len(rows)) < 1.5 for s in sizes)
    for s in sizes:
        n = {copies[i] for i, x in enumerate(sources) if (x or "") == s}
        assert max(n) - min(n) <= 1


def test_pipeline_on_awkward_rows(spark, tmp_path):
    clashing(awkward(spark)).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and out.count() > 0
