"""Operators 11 and 13 against brute force, on awkward vectors and with small chunks."""

from collections import Counter

import numpy as np
import pytest

from sparktrace.llm import embedding_dedup, vector_codes
from sparktrace.llm.vector_codes import Slices

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=400, d=32, seed=3):
    """Groups of near copies of all sizes, exact copies, vectors close to the threshold, and unusable ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n // 2):
        x[i] = x[i % 7] + rng.normal(size=d) * rng.choice([0.05, 0.15, 0.3, 0.5])
    rows = [(i * 3 + 1, [float(np.float32(c)) for c in v], int(i % 4) if i % 9 else None) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[2][1], 1) for i in range(40)] + [rows[5], rows[5], (7, rows[9][1], 2), (None, rows[3][1], 2), (None, [9.0] * d, 2)]
    rows += [(9000, None, 1), (9001, [0.0] * d, 1), (9002, [float("nan")] + [1.0] * (d - 1), None), (9003, [None] + [1.0] * (d - 1), 2), (9004, [float("inf")] * d, 2), (None, None, None)]
    return rows


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def clash(df):
    from pyspark.sql import functions as F

    for c in ("node", "k", "chunk", "at", "component", "links", "code", "error", "of", "n", "a.b"):
        df = df.withColumn(c, F.lit("extra"))
    return df


def linked(rows, cosine):
    usable = [i for i, r in enumerate(rows) if good(r[1]) and any(r[1])]
    x = np.array([rows[i][1] for i in usable])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    parent = np.arange(len(usable))
    while True:
        least = np.array([min([parent[i], *parent[near[i]]]) for i in range(len(usable))])
        if (least == parent).all():
            break
        parent = least
    n, component = [0] * len(rows), [r[0] for r in rows]
    for i, k in enumerate(usable):
        n[k] = int(near[i].sum())
        ids = [rows[usable[j]][0] for j in np.flatnonzero(parent == parent[i]) if rows[usable[j]][0] is not None]
        component[k] = min(ids, default=None)
    return Counter((r[0], n[k], component[k], r[0] == component[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("cosine", [0.95, 0.8])
@pytest.mark.parametrize("chunk,block", [(8 << 20, 512), (32 * 4 * 20, 7)])
def test_links(spark, monkeypatch, cosine, chunk, block):
    monkeypatch.setattr(embedding_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    found = embedding_dedup.near_duplicates(clash(spark.createDataFrame(rows, SCHEMA)).repartition(5), cosine)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(tuple(r) for r in found.collect()) == linked(rows, cosine)


def test_vectors_that_a_grid_separates(spark, monkeypatch):
    """On a circle most chunks are provably apart, and no link is lost."""
    monkeypatch.setattr(embedding_dedup, "CHUNK_BYTES", 4 * 3 * 50)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    angles = np.random.default_rng(1).uniform(0, 6.2, 600)
    rows = [(i, [float(np.float32(np.cos(a))), float(np.float32(np.sin(a))), 0.01], 0) for i, a in enumerate(angles)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.999)
    assert Counter(tuple(r) for r in found.collect()) == linked(rows, 0.999)


def test_no_vectors_and_short_ones(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(none).collect() == []
    assert vector_codes.with_label_errors(vector_codes.encode(none, vector_codes.train(none))).collect() == []
    rows = [(1, [1.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [], 0)]
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(5)
    for entries, width in ((64, 4), (64, 1), (3, 6), (1, 2), (64, 9)):
        book = rng.integers(-6, 6, (entries, width))
        x = rng.integers(-30, 30, (500, width))
        code, d = Slices(book).nearest(x)
        want = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (code == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()
    s = Slices(book)
    mask = s.candidates(x, s.radius(x))
    assert all((int(m) >> int(c)) & 1 for m, c in zip(mask, want.argmin(axis=1)))


def codes(rows, parts=16, entries=64, rounds=2):
    kept = [(r[0], r[2], np.floor(np.array(r[1]) * 256).astype(int).reshape(parts, -1)) for r in rows if good(r[1])]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2].ravel().tolist()))[:entries]
    books = [[f[2][p].tolist() for f in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        of = [[nearest(p, v[p].tolist())[1] for p in range(parts)] for _, _, v in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p].tolist() for (_, _, v), c in zip(kept, of) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, label, v in kept:
        best = [nearest(p, v[p].tolist()) for p in range(parts)]
        out.append((i, label, bytes(k for _, k in best), sum(d for d, _ in best)))
    total = Counter()
    for r in out:
        total[r[1]] += r[3]
    return Counter((*r, total[r[1]]) for r in out), vector_codes.digest([np.array(b) for b in books])


@pytest.mark.parametrize("rows", [vectors(150), vectors(150)[:20], vectors(60, 16)], ids=["many", "few", "one a part"])
def test_codes(spark, monkeypatch, rows):
    table = clash(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    books = vector_codes.train(table)
    want, digest = codes(rows)
    assert vector_codes.digest(books) == digest
    for keys in (vector_codes.BROADCAST_KEYS, 0):
        monkeypatch.setattr(vector_codes, "BROADCAST_KEYS", keys)
        assert Counter((r[0], r[1], bytes(r[2]), *r[3:]) for r in vector_codes.with_label_errors(vector_codes.encode(table, books)).collect()) == want


def test_unequal_or_huge_vectors_are_errors(spark):
    for rows in ([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], [(1, [1.0] * 15, 0)], [(1, [1e30] * 16, 0)]):
        with pytest.raises(Exception, match="vectors must|scaled components"):
            vector_codes.train(spark.createDataFrame(rows, SCHEMA))
