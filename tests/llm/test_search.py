"""Operator 12 against brute force, on awkward texts and with small trees and leaves."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, awkward, awkward_rows, clashing

from sparktrace.llm import ranked_search
from sparktrace.llm.ranked_search import Tree, saturation, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    words = [(r[0], Counter(terms(r[1]))) for r in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    out = Counter()
    for item, text in items:
        scores = []
        for doc, w in words:
            m = 50 + (50 * sum(w.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 20 * m)) for t in set(terms(text)) if w[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        for rank, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, doc, -s] += 1
    return out


ITEMS = [(1, "The stone, the RIVER and Wald w1 w2 w3"), (2, "w5 été w7"), (3, None), (4, " .. "), (5, "unknown words"), (2, "w5 été w7"), (None, "lamp"), (6, " ".join(f"w{i}" for i in range(200)))]


@pytest.mark.parametrize("k", [3, 50])
@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, k, small):
    if small:
        for name, n in (("LEAF", 2), ("TREE_ROWS", 9), ("PIECE", 40), ("ITEM_BYTES", 600)):
            monkeypatch.setattr(ranked_search, name, n)
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string").repartition(2))
    found = ranked_search.search(clashing(awkward(spark)), items, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == ranked(awkward_rows(), ITEMS, k)


def test_no_documents_and_no_items(spark):
    docs, items = (spark.createDataFrame([], s) for s in (SCHEMA, "item_id long, text string"))
    assert ranked_search.search(docs, items).collect() == ranked_search.search(awkward(spark), items).collect() == []
    assert ranked_search.search(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_terms_across_pieces(monkeypatch):
    text = "Ab,cd " + "x" * 90 + "; É1_2 " + "word " * 30 + "y" * 50
    for piece in (7, 40, 1 << 20):
        monkeypatch.setattr(ranked_search, "PIECE", piece)
        assert [w.decode() for part in terms_of(text.encode()) for w in part] == terms(text)


def test_bounds_hold_and_prune(monkeypatch):
    """No document of a subtree scores above its bound; with one rare document most of the tree is not visited."""
    monkeypatch.setattr(ranked_search, "LEAF", 8)
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(60, rng.integers(1, 12), replace=False, p=np.arange(60, 0, -1) / 1830)) for _ in range(900)]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    tf = rng.integers(1, 9, starts[-1])
    m = rng.integers(50, 200, 900)
    tree = Tree(np.arange(900), m, starts, np.concatenate(rows), tf)
    weights = np.where(rng.random(60) < 0.2, rng.integers(1, 5000, 60), 0)
    exact = np.array([sum(int(weights[t]) * int(saturation(tf[a + i], m[d])) for i, t in enumerate(r)) for d, (a, r) in enumerate(zip(starts, rows))])
    bounds = tree.bounds(0, len(tree.spans), weights)
    for (s, e), (first, last), bound in zip(tree.spans, tree.kids, bounds):
        assert bound >= exact[tree.doc[s:e]].max()
        assert first == last or (tree.spans[first][0], tree.spans[last - 1][1]) == (s, e)
    place, score = tree.best(weights, 10)
    want = sorted((-int(x), d) for d, x in enumerate(exact) if x > 0)[:10]
    assert [(-int(s), int(tree.doc[p])) for p, s in zip(place, score)] == want
    visited = []
    walked = Tree.scored
    monkeypatch.setattr(Tree, "scored", staticmethod(lambda starts, terms, *rest: (visited.append(terms is tree.terms), walked(starts, terms, *rest))[1]))
    rare = np.zeros(60, dtype=np.int64)
    rare[59] = 1000
    tree.best(rare, 1)
    assert sum(visited) < sum(f == l for f, l in tree.kids) / 2
