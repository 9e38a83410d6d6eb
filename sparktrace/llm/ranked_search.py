"""Ranked lexical search with document FP-trees.

1. One pass over the texts counts every document's terms and keeps those of any item: its restricted term vector. Documents
   without one keep their length only, for the corpus' statistics.
2. Terms are numbered by falling document frequency. Each task sorts stretches of bounded size of the vectors by these numbers, so
   that documents that begin with the same frequent terms share a path; intervals of that order are the nodes of the tree.
   A node knows the greatest term frequency of each term below it and the smallest length factor m.
3. An item walks the tree depth first. The score that the greatest frequencies and the smallest m would give bounds all
   documents of a subtree; a subtree whose bound stays below the item's k-th best score so far is left out.
4. The best k of every tree meet by item, and the best k of them are the result.

Scores are whole numbers from one formula, the same for bounds and documents; it rises with the frequency and falls with m.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktrace.llm.common import written

BEST = 50
#: Bytes of items that are searched for at once; their terms go to every task.
ITEM_BYTES = 8 << 20
#: Documents and postings in a tree, and documents in a leaf.
TREE_ROWS, TREE_POSTINGS, LEAF = 16384, 2_000_000, 64
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20
#: Bytes that belong to terms: 0-9, A-Z, a-z and all of non-ASCII characters; A-Z are lower-cased, all others end a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes):
    """Lists of the terms of a text's UTF-8 bytes, a bounded piece at a time."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        piece = text[at:end].translate(TERM_BYTES)
        if end < len(text):
            cut = piece.rfind(b" ") + 1
            if not cut:  # one term longer than a piece
                end = len(text)
                piece = text[at:end].translate(TERM_BYTES)
                cut = piece.find(b" ") + 1 or len(piece)
            piece = piece[:cut]
        yield piece.split()
        at += len(piece)


VECTOR = "doc_id long, n long, terms binary, counts binary"


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, and the vocabulary's terms in the text with their frequencies (int32 and int64, packed)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        index = known.value
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                n, found = 0, Counter()
                for words in terms_of(text.as_py() or b""):
                    n += len(words)
                    found.update(words)
                here = [(index[w], c) for w, c in found.items() if w in index]
                lengths.append(n)
                terms.append(np.array([t for t, _ in here], dtype=np.int32).tobytes())
                counts.append(np.array([c for _, c in here], dtype=np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), "text").mapInArrow(run, VECTOR)


def frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; tasks add up their rows first."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held = batch.column("terms").to_pylist()
            total += np.bincount(np.frombuffer(b"".join(held), dtype=np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Tree:
    """Intervals of the documents' sorted term vectors, with what bounds the scores below each.

    `terms` are ranks by falling frequency, rising within a document; `starts` cuts `terms` and `tf` into documents.
    """

    def __init__(self, doc: np.ndarray, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray):
        big = terms.astype(">u4").tobytes()
        keys = [big[4 * a : 4 * b] for a, b in zip(starts[:-1], starts[1:])]
        order = sorted(range(len(doc)), key=keys.__getitem__)
        sizes = np.diff(starts)[order]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        pick = np.arange(self.starts[-1]) + np.repeat(starts[:-1][order] - self.starts[:-1], sizes)
        self.doc, self.m, self.terms, self.tf = doc[order], m[order], terms[pick], tf[pick]
        self.gain = saturation(self.tf, np.repeat(self.m, sizes))
        self.grow()

    def grow(self) -> None:
        """Nodes in such an order that children stand together after their parent: `kids` their range, `span` a node's documents."""
        spans, depths, kids = [(0, len(self.doc))], [0], []
        at = 0
        while at < len(spans):
            parts = self.split(*spans[at], depths[at]) if spans[at][1] - spans[at][0] > LEAF else ([], 0)
            kids.append((len(spans), len(spans) + len(parts[0])))
            spans += parts[0]
            depths += [parts[1]] * len(parts[0])
            at += 1
        self.spans, self.kids = spans, kids
        self.node_starts, node_terms, node_gain = [0], [], []
        for s, e in spans:
            part = slice(self.starts[s], self.starts[e])
            order = np.argsort(self.terms[part], kind="stable")
            t = self.terms[part][order]
            cut = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(self.tf[part][order], cut) if len(t) else np.zeros(0, np.int64)
            node_terms.append(t[cut])
            node_gain.append(saturation(most, self.m[s:e].min()))
            self.node_starts.append(self.node_starts[-1] + len(cut))
        self.node_terms, self.node_gain, self.node_starts = np.concatenate(node_terms), np.concatenate(node_gain), np.array(self.node_starts)

    def split(self, s: int, e: int, depth: int) -> tuple[list[tuple[int, int]], int]:
        """The children of an interval that shares its first `depth` terms, small neighbours taken together."""
        first, last = (self.terms[self.starts[k] : self.starts[k + 1]] for k in (s, e - 1))
        least = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:least] != last[depth:least])
        depth = depth + int(differ[0]) if len(differ) else least  # all share the path down to here
        there = self.starts[s:e] + depth
        at = np.where(there < self.starts[s + 1 : e + 1], self.terms[np.minimum(there, len(self.terms) - 1)], -1)
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), e - s]
        if len(cuts) == 2:  # equal vectors
            cuts = [*range(0, e - s, LEAF), e - s]
        out, begun = [], 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - begun > LEAF and a > begun:
                out.append((s + begun, s + a))
                begun = a
        return [*out, (s + begun, e)], depth

    def bounds(self, first: int, last: int, weights: np.ndarray) -> np.ndarray:
        return self.scored(self.node_starts[first : last + 1], self.node_terms, self.node_gain, weights)

    @staticmethod
    def scored(starts: np.ndarray, terms: np.ndarray, gain: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum of weight times gain for each stretch of postings."""
        part = slice(starts[0], starts[-1])
        sums = np.concatenate(([0], np.cumsum(weights[terms[part]] * gain[part])))
        at = starts - starts[0]
        return sums[at[1:]] - sums[at[:-1]]

    def best(self, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and score of the k best documents with a score above 0; of equal scores the smallest doc_id, null last."""
        place, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        stack = [(0, int(self.bounds(0, 1, weights)[0]))]
        while stack:
            node, bound = stack.pop()
            if bound < floor:
                continue
            first, last = self.kids[node]
            if first < last:
                bounds = self.bounds(first, last, weights)
                good = np.flatnonzero(bounds >= floor)
                stack += [(first + i, int(bounds[i])) for i in good[np.argsort(bounds[good], kind="stable")].tolist()]
                continue
            s, e = self.spans[node]
            found = self.scored(self.starts[s : e + 1], self.terms, self.gain, weights)
            at = np.flatnonzero(found >= floor)
            if len(at):
                place, score = np.concatenate((place, s + at)), np.concatenate((score, found[at]))
                if len(place) > 4 * k:
                    place, score, floor = self.cut(place, score, k)
                elif len(place) >= k:
                    floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
        place, score, _ = self.cut(place, score, k)
        return place, score

    def cut(self, place: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        order = np.lexsort((self.doc[place], -score))[:k]
        return place[order], score[order], int(score[order[-1]]) if len(order) == k else 1


NO_ID = np.iinfo(np.int64).max


def searched(vectors: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every tree. `items` holds the term ranks of each item, `weights` the weight of each rank."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights))

    def trees(batches):
        held, rows, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows, postings = rows + part.num_rows, postings + sum(map(len, part.column("terms").to_pylist())) // 4
                if rows >= TREE_ROWS or postings >= TREE_POSTINGS:
                    yield pa.Table.from_batches(held)
                    held, rows, postings = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches):
        items, weights = shared.value
        for table in trees(batches):
            held = table.column("terms").to_pylist()
            n = table.column("n").to_numpy()
            terms, tf = np.frombuffer(b"".join(held), dtype=np.int32), np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum([len(h) // 4 for h in held])))
            order = np.lexsort((terms, np.repeat(np.arange(len(held)), np.diff(starts))))  # terms rise within a document
            ids = table.column("doc_id").to_pandas().astype("Int64").fillna(NO_ID).to_numpy(dtype=np.int64)
            m = 100 - 50 + np.array([(50 * int(x) * n_docs) // n_terms for x in n], dtype=np.int64)
            tree, mine, out = Tree(ids, m, starts, terms[order], tf[order]), np.zeros(len(weights), dtype=np.int64), []
            for i, ranks in enumerate(items):
                mine[ranks] = weights[ranks]
                place, score = tree.best(mine, k)
                mine[ranks] = 0
                if len(place):
                    out.append(pd.DataFrame({"item": i, "doc_id": tree.doc[place], "score": score}))
            if out:
                yield from pa.Table.from_pandas(pd.concat(out), preserve_index=False).to_batches()

    ranked = vectors.mapInArrow(run, "item long, doc_id long, score long")
    return ranked.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """(item, doc_id, score, rank) for the items of one block, numbered from 0."""
    words = [sorted({w for part in terms_of((text or "").encode()) for w in part}) for _, text in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    vectors = written(restricted(docs, vocabulary), "term-vectors")
    n_docs, n_terms, held = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.length("terms") > 0)).first()
    df = frequencies(vectors, len(vocabulary)) if vocabulary else np.zeros(0, np.int64)
    by_rank = np.argsort(-df, kind="stable")
    rank_of = np.empty(len(df), dtype=np.int32)
    rank_of[by_rank] = np.arange(len(df), dtype=np.int32)
    ranks = vectors.sparkSession.sparkContext.broadcast(rank_of)

    def renumber(batches):
        for batch in batches:
            terms = [ranks.value[np.frombuffer(t, dtype=np.int32)].tobytes() for t in batch.column("terms").to_pylist()]
            yield batch.set_column(2, "terms", pa.array(terms, pa.binary()))

    weights = np.array([weight(n_docs, int(d)) for d in df[by_rank]], dtype=np.int64)
    # The vectors are a small part of the texts; dealt out by their number, a task grows one tree whatever the input's size.
    dealt = vectors.where(F.length("terms") > 0).repartition(held // TREE_ROWS + 1)
    found = searched(dealt.mapInArrow(renumber, VECTOR), [rank_of[[vocabulary[w] for w in ws]] if ws else np.zeros(0, np.int32) for ws in words], weights, n_docs, max(n_terms, 1), k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The `k` documents with the highest score above 0 for each row of `items`: item_id, rank, doc_id, score.

    Whole texts count. A null or empty text has no terms: such an item finds nothing, such a document is never found. Equal scores go by
    rising doc_id, a null id last. Repeated rows of `docs` are documents of their own, repeated rows of `items` are
    answered each. An empty table gives no rows. Only doc_id and text, item_id and text are read, whatever other columns are called.

    Items are searched in blocks of about ITEM_BYTES, drawn by a hash, so what goes to a task does not grow with their number.
    """
    spark, items = docs.sparkSession, items.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks, out = size // ITEM_BYTES + 1, None
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        found = search_block(docs, rows, k)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


QUERIES = {"op12_ranked_search": op12_ranked_search}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op12_ranked_search": f"""
WITH words AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM words),
tf AS MATERIALIZED (SELECT d, doc_id, any_value(len(w)) AS n, term, count(*) AS tf FROM (SELECT d, doc_id, w, unnest(w) AS term FROM words) GROUP BY d, doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(corpus.n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * tf.n * corpus.n) // corpus.l))))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), corpus GROUP BY item_id, d, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""
}
