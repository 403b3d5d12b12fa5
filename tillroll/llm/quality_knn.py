"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are trigrams of byte classes (its "shape"), hashed trigrams
of bytes and a few word shares (repeats, capitals).  Weighted by inverse
document frequency, counted over all documents, they are projected on the
leading singular vectors of a bounded sample of labelled documents.  The sample's vectors are broadcast
(at most ``sample_rows`` x ``rank`` floats); every document's cosine with
each of them is computed exactly, block by block, and the nearest
``neighbours`` vote with weight cosine ** ``power``.

Only text enters a score.  Defined results: null or empty text gets the zero
vector and the sample's mean label as its score; without any label every
score is 0.5; several labels of a document are averaged; null labels and
labels of unknown documents are ignored; repeated rows are scored each; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text_features import gram_counts, parts, shape_counts, unit_rows, word_shares

#: Labelled documents the space is fitted on and that vote (lowest hash first).
SAMPLE_ROWS = 3000
RANK = 48
NEIGHBOURS = 25
POWER = 8
GRAM_WEIGHT = 0.2
#: Documents of one block of the cosine product.
BLOCK = 2048
THRESHOLD = 0.3


@dataclass
class LatentVotes:
    shape_idf: np.ndarray
    gram_idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def terms(self, shape: np.ndarray, gram: np.ndarray, shares: np.ndarray) -> np.ndarray:
        some = shares[:, :1] > 0
        word = np.column_stack([np.sqrt(shares[:, 1]), shares[:, 2], shares[:, 3]]) * some
        return np.hstack([unit_rows(np.sqrt(shape) * self.shape_idf),
                          GRAM_WEIGHT * unit_rows(np.sqrt(gram) * self.gram_idf), word]).astype(np.float32)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors, 0 to 1."""
        n = len(self.labels)
        if not n:
            return np.full(len(vectors), 0.5)
        out = np.empty(len(vectors))
        k = min(NEIGHBOURS, n)
        for lo in range(0, len(vectors), BLOCK):
            cosine = vectors[lo:lo + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(cosine), 1))
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1)
            out[lo:lo + BLOCK] = np.where(total > 0, votes / np.maximum(total, 1e-300), self.labels.mean())
        return np.clip(out, 0.0, 1.0)


def fit_votes(shape: np.ndarray, gram: np.ndarray, shares: np.ndarray, labels: np.ndarray, shape_idf: np.ndarray,
              gram_idf: np.ndarray, rank: int = RANK) -> LatentVotes:
    """Leading right singular vectors by randomised subspace iteration."""
    model = LatentVotes(shape_idf, gram_idf, np.empty((0, 0)), np.empty((0, 0)), labels)
    x = model.terms(shape, gram, shares)
    rank = max(1, min(rank, len(x)))
    probe = np.random.default_rng(11).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ probe)
        probe = x.T @ q
    model.axes = np.linalg.svd(probe.T, full_matrices=False)[2][:rank].T.astype(np.float32)
    model.vectors = unit_rows(x @ model.axes)
    return model


def _counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, raw, offsets in parts(column):
        yield lo, hi, shape_counts(raw, offsets), gram_counts(raw, offsets), word_shares(raw, offsets)


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """log((1 + documents) / (1 + documents holding the term)) + 1 of the shape
    and the gram terms, over every row of ``docs``.

    Each task adds up its own rows; Spark sums the (term, documents) pairs.
    """
    shapes, width = _splits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width + 1, np.int64)  # the last counts rows
        for b in batches:
            for lo, hi, raw, offsets in parts(b.column(0)):
                held[:shapes] += (shape_counts(raw, offsets) > 0).sum(axis=0)
                held[shapes:width] += (gram_counts(raw, offsets) > 0).sum(axis=0)
                held[width] += hi - lo
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(held[term])], ["term", "docs"])

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term int, docs long") \
        .groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()  # one row a term
    held = np.zeros(width + 1, np.int64)
    held[sums.column("term").to_numpy()] = sums.column("docs").to_numpy()
    idf = (np.log((1 + held[width]) / (1 + held[:width])) + 1).astype(np.float32)
    return idf[:shapes], idf[shapes:]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    usable: Column, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` of the documents that have a label, with their
    mean label: the ids of lowest hash, one text (the smallest) each."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable) \
        .groupBy(F.col(id_col).alias("sample_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label")) \
        .join(docs.select(F.col(id_col).alias("sample_id")), "sample_id", "left_semi") \
        .orderBy(F.xxhash64("sample_id"), "sample_id").limit(sample_rows)
    # The limit bounds the broadcast: an id and a number a row.
    return docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(chosen), "sample_id").groupBy("sample_id", "label").agg(F.min("text").alias("text")) \
        .select("text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> LatentVotes:
    """Fit on the labels that ``usable`` (a condition on the labels) admits."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col,
                             F.lit(True) if usable is None else usable, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, *blocks in _counts(b.column(0)):
                rows = np.hstack(blocks).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in rows], pa.binary()), b.column(1).slice(lo, hi - lo)], ["terms", "label"])

    found = sample.mapInArrow(run, "terms binary, label double").toArrow()  # at most sample_rows rows
    labels_of = found.column("label").to_numpy()
    rows = np.frombuffer(b"".join(found.column("terms").to_pylist()), np.float32)
    width = len(rows) // len(labels_of) if len(labels_of) else _width()
    rows = rows.reshape(-1, width)
    # Row order depends on task order; sort so that a fit is reproducible.
    order = np.lexsort((rows[:, -5], rows @ np.random.default_rng(5).standard_normal(width), labels_of))
    rows, labels_of = rows[order], labels_of[order]
    a, b = _splits()
    return fit_votes(rows[:, :a], rows[:, a:b], rows[:, b:], labels_of, *inverse_frequencies(docs, text_col)) if len(labels_of) else \
        LatentVotes(np.ones(a, np.float32), np.ones(b - a, np.float32), np.zeros((b + 3, 1), np.float32),
                    np.zeros((0, 1), np.float32), labels_of)


def _splits() -> tuple[int, int]:
    from tillroll.llm.text_features import GRAM_TERMS, SHAPE_TERMS
    return SHAPE_TERMS, SHAPE_TERMS + GRAM_TERMS


def _width() -> int:
    return _splits()[1] + 5


def score_quality(docs: DataFrame, model: LatentVotes, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``; all input columns are kept (an input
    column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            scores = np.empty(b.num_rows)
            for lo, hi, shape, gram, shares in _counts(b.column(b.num_columns - 1)):
                scores[lo:hi] = own.score(unit_rows(own.terms(shape, gram, shares) @ own.axes))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], [*kept, "score"])

    return rows.mapInArrow(run, schema)
