"""Operators 1, 4, 5, 6 and 9 against brute force, on awkward rows and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from fixtures import FOLDER, SCHEMA, awkward, awkward_rows, clashing

from sparktrace.llm import common, decontaminate, mixing, pii, quality_rules, sharding
from sparktrace.llm.queries import QUERIES, SQL

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    want = c.execute(SQL[name])
    at = [[d[0] for d in want.description].index(x) for x in order]
    assert sorted(map(key, df.select(*order).collect())) == sorted(key([r[i] for i in at]) for r in want.fetchall())


def test_shards(spark):
    rows = sharding.digest_columns(sharding.shuffle_into_shards(clashing(awkward(spark)), shards=4, bucket_bytes=4000)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in awkward_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(4))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    of = defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add(r["shard"])
    assert all(len(v) == 1 for v in of.values())
    again = sharding.digest_columns(sharding.shuffle_into_shards(awkward(spark).repartition(5), shards=4, bucket_bytes=4000)).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"], r["size"]) for r in rows) == Counter((r["doc_id"], r["shard"], r["slot"], r["size"]) for r in again)


def test_shard_growth_moves_rows_only_into_the_new_shard(spark):
    four, five = ({r["doc_id"]: r["shard"] for r in sharding.shuffle_into_shards(awkward(spark), shards=n).collect()} for n in (4, 5))
    grown = {r["doc_id"]: r["grown_shard"] for r in sharding.shuffle_into_shards(awkward(spark), shards=4).collect()}
    assert five == grown and any(v == 4 for v in five.values()) and all(five[k] in (four[k], 4) for k in four)


def test_shards_of_a_repeated_row_and_a_map(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 3)
    rows = [(1, "same", {"a": 1})] * 40 + [(i, f"t{i}", None) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    out = sharding.shuffle_into_shards(docs, shards=2, bucket_bytes=30).collect()
    assert Counter((r["doc_id"], str(r["m"])) for r in out) == Counter((r[0], str(r[2])) for r in rows)
    for k in range(2):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))


def test_a_hot_id_does_not_make_its_buckets_large(spark, monkeypatch):
    """A third of the rows share an id; buckets of its shard stay as small as others."""
    rows = [(7 if i % 3 == 0 else i, f"text {i} " * 9, None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    seen, counted = {}, sharding.bucket_counts
    monkeypatch.setattr(sharding, "bucket_counts", lambda *args: seen.update(counted(*args)) or seen)
    rows_ = sharding.shuffle_into_shards(docs, shards=8, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows_) == Counter(r[:2] for r in rows)
    held = Counter()
    for r in rows_:
        held[r["shard"]] += len(r["text"]) + 1
    assert len(seen) == 8 and max(seen.values()) >= 4 * min(seen.values()) and all(held[k] / n <= 2000 for k, n in seen.items())


def test_a_bucket_is_a_permutation_that_keeps_no_order(spark):
    docs = spark.createDataFrame([(i, f"t{i}", None) for i in range(2000)], "doc_id long, text string, other int")
    rows = sharding.shuffle_into_shards(docs, shards=1).orderBy("slot").collect()
    ids = np.array([r["doc_id"] for r in rows])
    assert sorted(ids.tolist()) == list(range(2000)) and abs(np.corrcoef(ids, np.arange(2000))[0, 1]) < 0.1
    assert np.abs(np.bincount(ids[:500] // 500, minlength=4) - 125).max() < 45  # all parts of the input in each part of the shard


def test_written_shards_hold_all_rows(spark, tmp_path):
    sharding.write_shards(awkward(spark), str(tmp_path / "shards"), shards=3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(awkward_rows())


def test_rules(spark):
    rows = quality_rules.quality_rules(clashing(awkward(spark))).collect()
    want = Counter()
    for d, t, *_ in awkward_rows():
        w = SPLIT.findall(t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        repeated = len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)})
        lines = [x for x in (t or "").split("\n") if SPLIT.search(x)]
        want[d, len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), repeated, len(w) < 50 or 100 * repeated > 50 * len(w)] += 1
    assert want == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows) and any(r["kept"] for r in rows)


def test_decontamination(spark):
    item = [f"item{i}" for i in range(20)]
    changed = ["x" if i % 8 == 4 else w for i, w in enumerate(item)]
    many = ["x" if i % 3 == 1 else w for i, w in enumerate(item)]
    short = [f"short{i}" for i in range(7)]
    pad = [f"pad{i}" for i in range(30)]
    texts = [None, "", " ".join(pad + item + pad), " ".join(pad + changed).upper(), " ".join(pad + many), ", ".join(item) + ".", " ".join(pad + short), " ".join(pad), " ".join(item[:11]), " ".join(pad + short[:6] + ["y"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] * 2, SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, " ".join(short)), (4, None), (5, "tiny one"), (6, "")], "item_id long, text string")
    rows = decontaminate.decontaminate(clashing(docs), bench).collect()
    assert len(rows) == 20 and {r["doc_id"] for r in rows if r["contaminated"]} == {2, 3, 5, 6, 8, 9}  # 9: one changed word of seven
    assert {(r["n_items"], r["first_item"]) for r in rows if r["doc_id"] == 2} == {(2, 1)}
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("n", range(1, 12))
def test_short_items_are_found(spark, n):
    item = [f"i{k}" for k in range(n)]
    pad = [f"pad{k}" for k in range(9)]
    docs = [pad + item + pad, item, pad + item, pad, pad + item[:-1] + pad, *([*pad, *item[:k], "x", *item[k + 1 :], *pad] for k in range(n))]
    docs += [[*pad, *item[:1], "x", *item[2:-1], "y", *pad]] if n > 2 else []
    found = [True, True, True, False, n >= 6] + [n >= 6] * n + [False] * (n > 2)
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(table, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert [rows[i]["contaminated"] for i in range(len(docs))] == found and rows[0]["longest"] == n


def brute_contamination(docs, items):
    """Places of (document, item) matches by comparing every window with every place."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    windows = {(i, tuple(w[k : k + 12])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 11))}
    out = {}
    for d, t in docs:
        w = words(t)
        hits = {(at, i, len(x)) for i, x in windows for at in range(len(w)) if sum(a == b for a, b in zip(x, w[at:])) >= len(x) - len(x) * 2 // 12}
        out[d] = (len({h[0] for h in hits}), len({h[1] for h in hits}), min((h[1] for h in hits), default=None), max((h[2] for h in hits), default=0))
    return out


def test_decontamination_equals_brute_force(spark):
    import random

    draw = random.Random(11)
    phrase = [f"p{k}" for k in range(8)]  # a common phrase: hot seeds of many windows and documents
    items = [(i, " ".join(phrase + [f"v{draw.randrange(40)}" for _ in range(10)])) for i in range(30)]
    items += [(100 + n, " ".join(f"s{draw.randrange(6)}" for _ in range(n))) for n in range(1, 15)] + [(200, None), (201, "!!"), (202, items[0][1])]
    docs = []
    for d in range(120):
        w = [f"s{draw.randrange(6)}" if draw.random() < 0.5 else f"q{draw.randrange(50)}" for _ in range(draw.randrange(30))]
        if d % 2:
            part = items[draw.randrange(30)][1].split()
            for _ in range(draw.randrange(5)):
                part[draw.randrange(len(part))] = "z"
            w += part[draw.randrange(4) :] + w[:5]
        docs.append((d, " ".join(w)))
    docs += docs[1:20:2] + [(500, None), (501, "")]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contamination(docs, items)
    assert len(out) == len(docs)
    assert {r["doc_id"]: (r["n_windows"], r["n_items"], r["first_item"], r["longest"]) for r in out} == want
    assert all(r["contaminated"] == (want[r["doc_id"]][0] > 0) for r in out)


def test_repeated_rows_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 4)
    rows = [(1, "hot", "en")] * 40 + [(i, "cold", "en") for i in range(2, 20)] + [(None, None, None)] * 9
    out = common.dealt(spark.createDataFrame(rows, "doc_id long, text string, piece string")).collect()
    assert Counter(tuple(r["r"]) for r in out) == Counter(rows)
    pieces = Counter(r["piece"] for r in out if r["r"]["text"] == "hot")
    assert len(pieces) == 40 and {r["piece"] for r in out if r["r"]["text"] == "cold"} == {0}


def test_all_pairs_of_changed_words_are_found(spark):
    item = [f"i{k}" for k in range(12)]
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    docs = spark.createDataFrame([(n, " ".join("z" if k in p else w for k, w in enumerate(item)), "en", "s", 0) for n, p in enumerate(pairs)], SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert all(r["contaminated"] for r in decontaminate.decontaminate(docs, bench).collect())


def test_mixing_places_all_rows_once(spark):
    rows = mixing.mix(clashing(awkward(spark)), block_docs=2).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(x[:2] for x in awkward_rows())
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    assert sorted({r["slot"] for r in rows}) == list(range(max(r["slot"] for r in rows) + 1))
    one = defaultdict(set)
    for r in rows:
        one[r["slot"]].add(r["source"] or "")
    assert all(len(s) == 1 for s in one.values())


def ideal(blocks, weights, t):
    """Blocks that each source has had at time t of an ideal that serves all at once, at the weights of those that have some left."""
    from fractions import Fraction

    done, now = dict.fromkeys(blocks, Fraction(0)), Fraction(0)
    while now < t and any(done[s] < blocks[s] for s in blocks):
        left = {s: Fraction(weights[s]) for s in blocks if done[s] < blocks[s]}
        total = sum(left.values())
        step = min(t - now, min((blocks[s] - done[s]) * total / w for s, w in left.items()))
        done = {s: done[s] + (step * left[s] / total if s in left else 0) for s in blocks}
        now += step
    return done


CASES = [
    ({"a": 500, "b": 60, "c": 7, "d": 300}, {"a": 1, "b": 1, "c": 0.2, "d": 0.9}),
    ({"a": 3}, {"a": 5}),
    ({"a": 40, "b": 40}, {"a": 1, "b": 1000}),
    ({"hot": 900, **{f"s{i}": 12 for i in range(20)}}, {"hot": 0.5, **{f"s{i}": 0.025 for i in range(20)}}),
    ({f"s{i}": 1 + i % 3 for i in range(300)}, {f"s{i}": (1 + i) ** 0.7 for i in range(300)}),
    ({"a": 2000, "b": 3, "c": 700}, {"a": 0.00013, "b": 3e-7, "c": 0.99987}),
]


@pytest.mark.parametrize("blocks, weights", CASES)
def test_schedule_deviates_by_less_than_a_block(blocks, weights):
    names = sorted(blocks)
    order = mixing.schedule([blocks[s] for s in names], [weights[s] for s in names])
    slots = [0] * sum(blocks.values())
    for k, places in enumerate(order):
        assert list(places) == sorted(places) and len(places) == blocks[names[k]]
        for t in places:
            slots[t] = names[k]
    assert all(slots)
    seen, total = Counter(), len(slots)
    for t in range(total):
        seen[slots[t]] += 1
        if t % max(1, total // 40) == 0 or t == total - 1:
            want = ideal(blocks, weights, t + 1)
            assert all(abs(seen[s] - want[s]) < 1 + 1e-9 for s in names), t


def test_mixture_follows_its_schedule(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", s, 0) for i, s in enumerate(["hot"] * 300 + ["a"] * 41 + ["b"] * 3 + [None] * 10)], SCHEMA)
    rows = mixing.mix(docs, {"hot": 1.0, "a": 2.0, "b": 0.1}, block_docs=2).collect()
    blocks = {s: -(-n // 2) for s, n in {"hot": 300, "a": 41, "b": 3, "": 10}.items()}
    order = mixing.schedule([blocks[s] for s in sorted(blocks)], [{"hot": 1.0, "a": 2.0}.get(s, 0.1) for s in sorted(blocks)])
    got = defaultdict(set)
    for r in rows:
        got[r["source"] or ""].add((r["block"], r["slot"]))
    assert got == {s: set(enumerate(map(int, order[k]))) for k, s in enumerate(sorted(blocks))}


def test_weights_must_be_above_zero(spark):
    docs = spark.createDataFrame([(1, "t", "en", "a", 0)], SCHEMA)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0.0})
    assert mixing.mix(docs, {}).count() == 1


def test_a_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def __init__(self, **kw):
            self.kw = kw

        def get(self, key, default=None):
            return self.kw.get(key.rpartition(".")[2], default)

    class Session:
        def __init__(self, **kw):
            self.conf = Conf(**kw)

    assert common.shared_folder(Session(master="local[2]")).startswith("file://")
    assert common.shared_folder(Session(master="spark://x:7077", dir="hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        common.shared_folder(Session(master="spark://x:7077"))


def test_removed_tables_are_gone(spark):
    import os

    since = common.mark()
    first = common.written(spark.range(3), "kept")
    common.written(spark.range(4), "gone")
    paths = common.tables()[since:]
    common.removed(spark, since + 1)
    assert first.count() == 3 and [os.path.exists(p.removeprefix("file://")) for p in paths] == [True, False] and common.mark() == since + 1


def test_mixture_of_a_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 3)
    monkeypatch.setattr(mixing, "BATCH", 4)
    rows = [(1, "same", "en", "hot", 0)] * 50 + [(i, f"t{i}", "en", "b", 0) for i in range(2, 30)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_docs=2).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(r[:2] for r in rows)
    assert len({(r["slot"], r["place"]) for r in out}) == len(rows) and max(r["slot"] for r in out) == 25 + 14 - 1


def test_blocks_do_not_grow_with_the_input():
    """A schedule of many blocks is made a batch at a time and stays as close to the ideal as a short one."""
    n, seen = 0, Counter()
    weights = {0: 0.55, 1: 0.3, 2: 0.15}
    for sources, numbers in mixing.slots_in_order([550_000, 300_000, 150_000], list(weights.values())):
        assert len(sources) <= mixing.BATCH
        for k in weights:
            mine = numbers[sources == k]
            assert len(mine) == 0 or (mine[0] == seen[k] and (np.diff(mine) == 1).all())
            seen[k] += len(mine)
        n += len(sources)
        assert all(abs(seen[k] - w * n) < 1 + 1e-6 for k, w in weights.items())
    assert n == 1_000_000


def test_epochs_have_a_bound(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "big" if i < 400 else f"s{i % 3}", 0) for i in range(403)], SCHEMA)
    weights = spark.createDataFrame([("big", 1.0), ("s0", 0.5), ("s1", 0.0025), (None, 9.0)], "source string, weight double")
    count = lambda **how: Counter(r["source"] for r in mixing.mix(docs, weights, 4, epochs=True, **how).collect())
    assert count() == {"big": 400, "s0": 200, "s1": 1, "s2": 1} and count(most_epochs=3) == {"big": 400, "s0": 3, "s1": 1, "s2": 1}


def base_spans(t):
    def check(d):
        return sum(x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in patterns.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and check(d) or k == "phone" and 8 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return out


AWKWARD_DATA = [
    "a@b.c_x@d.e", "é\U0001f600 mail x.y+z@q-1.example.org.", "1.2.3.4.5 256.1.1.1 00000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111",
    "+1 (555) 010-9999 +12 +123456789012345678", "@ a@ @b.c a@b", "+1+2 3456789", "1" * 3000, ("a" * 2000 + " ") * 3, "9" * 19 + "@x.y", None, "",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(AWKWARD_DATA)] + awkward_rows(), SCHEMA)
    got = Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digest_columns(pii.find_personal_data(clashing(docs))).collect())
    want = Counter()
    for d, t in [*enumerate(AWKWARD_DATA), *(r[:2] for r in awkward_rows())]:
        s = base_spans(t)
        want[d, hashlib.sha256(",".join("%s:%d:%d" % x for x in s).encode()).hexdigest(), *(sum(x[0] == k for x in s) for k in pii.KINDS)] += 1
    assert got == want


def test_disclosing_terms_are_generalised(spark):
    rows = [(i, f"number {i} ask Zyxwvut at owner@site.org about thing{i} now", "en", "s", 0) for i in range(5)]
    rows += [(50 + i, f"plain text number {i} asks about the thing now and you ask at more words", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs).collect()}
    assert out[0] == "number 0 ask <TERM> at <EMAIL> about thing0 now" and out[50] == rows[5][1]


def test_disclosing_terms_far_from_the_address_are_generalised(spark):
    far = "plain text asks about the thing and more words " * 12
    rows = [(i, f"Zyxwvut {far}owner@site.org {far}number {i} for ZYXWVUT", "en", "s", 0) for i in range(5)]
    rows += [(50 + i, f"{far} number {i} for all", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs).collect()}
    assert out[0] == f"<TERM> {far}<EMAIL> {far}number 0 for <TERM>" and out[50] == rows[5][1]


def test_bits_left_equal_brute_force(spark):
    import math
    import random

    draw = random.Random(2)
    people = [f"person{chr(97 + i)}" for i in range(6)]
    texts = []
    for i in range(60):
        words = [draw.choice(["so", "we", "met", "again", "here"]) for _ in range(8)]
        if i % 3 == 0:  # persons with addresses of their own, two addresses always together, and repeated texts
            k = draw.randrange(6)
            words += [people[k], f"mail{k}@x.org", f"alt{k}@x.org"] + ["shared@y.org"] * (k % 2) + [f"rare{draw.choice('abcdef')}"]
        texts.append(" ".join(words))
    texts += texts[:4] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    base = pii.base_table(docs)
    holders = pii.found_holders(base)
    keys = {tuple(r["text_key"]): r["doc_id"] for r in base.select("text_key", "doc_id").collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ents = [{m[0].lower() for m in email.finditer(t or "")} for t in texts]
    terms = [set(re.findall(r"[a-z]+", (t or "").lower())) for t in texts]
    inside = [set(re.findall(r"[a-z]+", email.sub(lambda m: " " * len(m[0]), t or "").lower())) for t in texts]
    once = [i for i, t in enumerate(texts) if (t or "") not in {x or "" for x in texts[:i]}]  # equal texts are one observation
    ents, terms, inside = ([x[i] for i in once] for x in (ents, terms, inside))
    want, z = {}, pii.Z
    for d, i in enumerate(once):
        for w in inside[d] if ents[d] else ():
            best = []
            for e in ents[d]:
                c_t = sum(w in x for x in terms)
                p = sum(e in x and w in y for x, y in zip(ents, inside)) / c_t
                low = (p + z * z / (2 * c_t) - z * math.sqrt(p * (1 - p) / c_t + z * z / (4 * c_t * c_t))) / (1 + z * z / c_t)
                best.append(-math.log2(low))
            want[texts[i], w] = min(best)
    for most in (60.0, 2.0, 1.0):
        got = {(texts[keys[tuple(r["text_key"])]], r["term"]): r["bits"] for r in pii.revealing(holders, docs, most).collect()}
        some = {k: v for k, v in want.items() if v <= most}
        assert got.keys() == some.keys() and some and all(abs(got[k] - some[k]) < 1e-9 for k in some)


def test_planted_names_are_found_and_other_words_left_alone(spark):
    """Names that stand beside an address in four texts or more; a quarter of the words of every text stand nowhere else."""
    import random

    draw = random.Random(4)
    names = {f"name{chr(97 + i // 26)}{chr(97 + i % 26)}": 4 + i % 5 for i in range(60)}
    spell = lambda n: "".join(chr(97 + (n // 26**k) % 26) for k in range(5))
    fresh, rows = iter(range(10**6)), []
    prose = lambda: [draw.choice(["we", "met", "again", "here", "today"]) if draw.random() < 0.75 else f"rare{spell(next(fresh))}" for _ in range(60)]
    for name, n in names.items():
        rows += [" ".join([*prose(), name, f"{name[4:]}@site.org", *prose()]) for _ in range(n)]
    rows += [" ".join(prose()) for _ in range(300)] + rows[:40]  # copies give no name away
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for repeat in (1, 8):  # a corpus of eight times the size, the rest of it plain, changes no verdict
        more = spark.createDataFrame([(10**6 + i, " ".join(prose())) for i in range(len(rows) * (repeat - 1))], "doc_id long, text string")
        found = pii.find_personal_data(docs.union(more)).where("doc_id < 1000000 and size(spans) > 0").collect()
        held, wrong = 0, 0
        for r in found:
            words = [rows[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"] if s["kind"] == "term"]
            held += any(w in names for w in words)
            wrong += sum(w not in names for w in words)
        assert held == len(found) > 300 and wrong == 0


def test_terms_are_found_on_the_given_tables(spark):
    """Their identifiers stand in single texts and near copies, which reveal nothing; five more texts share a name and an address."""
    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**9 + i, f"{x['text']} Qwertzu writes from q.wertzu@post.org") for i, x in enumerate(docs.where("text is not null").limit(5).collect())], "doc_id long, text string")
    rows = pii.digest_columns(pii.find_personal_data(docs.union(more))).collect()
    assert {r["doc_id"] for r in rows if r["n_term"]} == {10**9 + i for i in range(5)} and {r["n_term"] for r in rows} == {0, 2}  # Qwertzu, writes


def test_matches_of_many_pieces(spark):
    text = "ab é1\U0001f600 " * 1500
    got = spark.createDataFrame([(text,), ("",), ("x",)], "text string").select(pii.matches(pii.F.col("text"), pii.WORD).alias("m")).collect()
    want = [[(m.start(), m.end(), m[0]) for m in re.finditer("[a-zé]+", t)] for t in (text, "", "x")]
    assert [[tuple(x) for x in r["m"]] for r in got] == want


@pytest.mark.parametrize("name", ["op1_sharding", "op4_quality_rules", "op5_decontaminate", "op6_mixing", "op9_pii", "op2_warc", "op3_token_counts", "op7_quality_classifier", "op8_near_dedup", "op10_language_id", "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    for t in "documents embeddings pages benchmark labels".split():
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    if name == "pipeline":
        import corpus_pipeline

        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    else:
        assert QUERIES[name](spark, str(tmp_path)).count() == 0
