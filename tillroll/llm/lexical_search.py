"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

Documents are read once: a document keeps, of its terms, those that some item
holds, with their counts (the postings, written by document), while its length
and the corpus counts take in every term.  Weights follow from the counts of
the whole corpus.  The documents are then dealt into blocks, and a block keeps
one list of (document, impact) for each term, by falling impact.  An item
reads its lists down to ever lower impacts and keeps an interval for every
document: what was seen of it (lower) plus, for each list where it has not
been seen, the next impact of that list (upper).  Reading goes on until no
unseen document can come up to the k-th lower score and every document that
still can has a closed interval, so membership, ties and scores are exact.
The k best of a task's blocks raise the bar of its next block; the k best of
every task are merged.  A frequent term is many short lists, one a block.

Terms are compared by 64-bit hash (one of the items' terms meets another term
of a corpus of 10 billion different ones with chance 5e-6 at 10,000 item terms).
The items are the stated query set: they are worked through in blocks of
about ``BLOCK_TERMS`` terms.

Defined results: null and empty texts have no term, and such items no rows;
rows that repeat an item's id and text are one item, different texts under
one id are ranked each by itself; every document row counts, repeated ones
too; equal scores go by ascending doc_id, null ids last; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import discard, written
from tillroll.llm.shingles import word_hashes
from tillroll.llm.text_features import parts

TOP = 50
#: Terms of the items that one pass over the documents looks for.
BLOCK_TERMS = 500_000
#: Documents whose lists are held at a time.
BLOCK_DOCS = 8_192
#: Each round reads down to this part of the round before.
FALL = 4

# Bytes of terms (digits, letters, all of other scripts) with A-Z lowered; the rest become blanks.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term."""
    return word_hashes(_FOLD[raw], offsets)


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and the hashes of its terms, once each, of items with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in parts(b.column(1)):
                row, h = term_hashes(raw, offsets)
                both = np.unique(np.rec.fromarrays([row, h.view(np.int64)]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), _lists(both.f0, both.f1, hi - lo, pa.int64())], ["item_id", "terms"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    return rows.mapInArrow(run, "item_id long, terms array<long>").where(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), and places in the sorted ``vocabulary``
    with their counts, of every document with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in parts(b.column(1)):
                row, h = term_hashes(raw, offsets)
                n = np.bincount(row, minlength=hi - lo)
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[place] == h
                cell, count = np.unique(row[known] * len(vocabulary) + place[known], return_counts=True)
                of, term = np.divmod(cell, len(vocabulary))
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), _lists(of, term, hi - lo, pa.int32()),
                     _lists(of, count, hi - lo, pa.int64())], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Lists:
    """Lists of one block of documents, by falling impact."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        some = impact > 0
        doc, term, impact = doc[some], term[some], impact[some]
        order = np.lexsort((-impact, term))
        self.doc, self.falling, self.n_docs = doc[order], -impact[order], n_docs
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(order))

    def best(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of all that reach the k-th score of the
        block and ``bar`` (ties included)."""
        own = np.searchsorted(self.terms, terms)
        own = own[own < len(self.terms)][self.terms[own[own < len(self.terms)]] == terms[own < len(self.terms)]]
        first, end = self.bounds[own], self.bounds[own + 1]
        at = first.copy()
        none = np.empty(0, np.int64)
        if not len(own):
            return none, none
        lower = np.zeros(self.n_docs, np.int64)
        frontier = -self.falling[at]
        level = int(frontier.max())
        if int(frontier.sum()) < bar:
            return none, none
        while True:
            level //= FALL
            for t in range(len(own)):
                to = at[t] + int(np.searchsorted(self.falling[at[t]:end[t]], -level, side="right"))
                if to > at[t]:
                    docs = self.doc[at[t]:to]  # a document is once in a list
                    lower[docs] -= self.falling[at[t]:to]
                    at[t] = to
                    frontier[t] = -self.falling[to] if to < end[t] else 0
            rest = int(frontier.sum())
            top = int(np.partition(lower, -k)[-k]) if self.n_docs >= k else 0
            reach = max(bar, top, 1)
            if rest and rest >= reach:
                continue  # an unseen document can still come up
            # Of every list, the next impact is missing to a document until it has been seen there.
            read = np.concatenate([self.doc[a:b] for a, b in zip(first, at)])
            had = np.bincount(read, np.repeat(frontier, at - first), self.n_docs).astype(np.int64)
            upper = lower + rest - had
            able = upper >= reach
            if (upper[able] == lower[able]).all():
                docs = np.flatnonzero(able)
                return docs, lower[docs]


def _first_k(k: int, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, unnamed, -score))[:k]


def search_block(rows: DataFrame, items: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """no (place in ``items``), doc_id and score: the k best of every task.
    ``items`` hold places in the vocabulary, ``weights`` are theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in items]
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(lo, BLOCK_DOCS)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                unnamed = part.column(0).is_null().to_numpy(zero_copy_only=False)
                m = 50 + (50 * part.column(1).to_numpy() * n) // total
                size = part.column(2).value_lengths().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), size)
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                lists = Lists(doc, term, impact, part.num_rows)
                for j, terms in enumerate(items):
                    score, have, none = best[j]
                    docs, s = lists.best(terms, k, int(score[-1]) if len(score) == k else 0)
                    if len(docs):
                        score, have, none = np.append(score, s), np.append(have, ids[docs]), np.append(none, unnamed[docs])
                        first = _first_k(k, score, have, none)
                        best[j] = score[first], have[first], none[first]
        for j, (score, have, none) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), j), pa.int32()), pa.array(have, pa.int64(), mask=none), pa.array(score, pa.int64())],
                    ["no", "doc_id", "score"])

    return rows.mapInArrow(run, "no int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of
    every item (score above 0; all, if fewer)."""
    spark = docs.sparkSession
    asked = written(item_terms(items, item_col, item_text_col), "items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == block).collect()
        if not own:
            continue
        vocabulary = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in own]).view(np.uint64))
        places = [np.searchsorted(vocabulary, np.array(r.terms, np.int64).view(np.uint64)) for r in own]
        rows = written(postings(docs, vocabulary, id_col, text_col), "postings")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")).first()
        held = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * size.n + 2) / (2 * held.get(t, 0) + 1)))
                            for t in range(len(vocabulary))], np.int64)
        names = spark.createDataFrame([(j, r.item_id) for j, r in enumerate(own)], "no int, item_id long")
        order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        near = search_block(rows, places, weights, size.n, size.total, k) \
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = written(near.join(names, "no").select("item_id", "rank", "doc_id", "score"), "ranked")
        discard(rows)
        out = found if out is None else out.union(found)
    discard(asked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
