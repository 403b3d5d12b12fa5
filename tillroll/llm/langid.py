"""Language identification by hierarchical discrimination.

Texts are unit vectors of hashed byte trigrams.  The learned languages are
grouped into families by average-linkage clustering of their mean vectors;
linear support vector machines (squared hinge, one for each pair of classes)
first choose the family, then the language within it.  The fit uses a bounded
sample of labelled documents; every whole text is predicted.

Defined results: null text, or text without a letter, is ``und`` with score
0; with a single learned language every other text is that language with
score 1; with none, every text is ``und``; null labels are ignored; repeated
rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.llm.text_features import gram_counts, parts, unit_rows

TERMS = 2048
#: Labelled documents the machines are fitted on (lowest hash first), shared
#: evenly by the languages, and the least that a language gets.
SAMPLE_ROWS = 3000
LEAST_ROWS = 20
#: Languages whose sample bounds are sent to every task.
SENT_LANGUAGES = 100_000
PENALTY = 10.0
STEPS = 80
BIAS = 0.3
UNKNOWN = "und"


def vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x = unit_rows(np.sqrt(gram_counts(raw, offsets, TERMS)))
    return np.hstack([x, np.full((len(x), 1), BIAS, np.float32)])


def linear_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights minimising |w|^2 / 2 + PENALTY * mean squared hinge (y is +-1),
    classes weighted equally, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.random.default_rng(1).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(8):
        v = x.T @ (share * (x @ v))
        top = float(np.linalg.norm(v))
        v /= top or 1.0
    rate = 1.0 / (1.0 + 2 * PENALTY * 1.1 * top)
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (z - 2 * PENALTY * (x.T @ (share * y * slack)))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w.astype(np.float32)


@dataclass
class PairMachines:
    """One machine for each pair of classes; a class's score is its mean
    chance against the others."""
    classes: list
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: list) -> PairMachines:
        own = cls(classes, list(combinations(range(len(classes)), 2)))
        found = []
        for a, b in own.pairs:
            pick = (y == a) | (y == b)
            found.append(linear_svm(x[pick], np.where(y[pick] == a, 1, -1).astype(np.float32)))
        own.weights = np.stack(found, axis=1) if found else None
        return own

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(self.classes)))
        if self.pairs:
            chance = 1 / (1 + np.exp(-4.0 * np.clip(x @ self.weights, -50, 50)))
            out[:] = 0
            for k, (a, b) in enumerate(self.pairs):
                out[:, a] += chance[:, k]
                out[:, b] += 1 - chance[:, k]
            out /= len(self.classes) - 1
        return out


def families_of(means: np.ndarray, count: int) -> list[list[int]]:
    """Average-linkage clusters of the mean vectors, by cosine."""
    cosine = unit_rows(means) @ unit_rows(means).T
    groups = [[k] for k in range(len(means))]
    while len(groups) > count:
        a, b = max(combinations(range(len(groups)), 2),
                   key=lambda p: (cosine[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] += groups.pop(b)
    return groups


@dataclass
class LanguageModel:
    family: PairMachines | None
    within: list[PairMachines]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        names = sorted(set(langs))
        if not names:
            return cls(None, [])
        y = np.array([names.index(v) for v in langs])
        means = np.stack([x[y == k, :-1].mean(axis=0) for k in range(len(names))])
        groups = families_of(means, math.ceil(math.sqrt(len(names))))
        family_of = np.array([next(g for g, own in enumerate(groups) if k in own) for k in range(len(names))])
        family = PairMachines.fit(x, family_of[y], list(range(len(groups))))
        within = []
        for own in groups:
            pick = np.isin(y, own)
            within.append(PairMachines.fit(x[pick], np.array([own.index(k) for k in y[pick]]), [names[k] for k in own]))
        return cls(family, within)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.family is None:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        by_family = self.family.scores(x)
        chosen = by_family.argmax(axis=1)
        langs, score = np.empty(len(x), object), np.zeros(len(x))
        for g, machines in enumerate(self.within):
            pick = np.flatnonzero(chosen == g)
            if len(pick):
                own = machines.scores(x[pick])
                best = own.argmax(axis=1)
                langs[pick] = [machines.classes[k] for k in best]
                score[pick] = by_family[pick, g] * own[np.arange(len(pick)), best]
        return list(langs), np.clip(score, 0.0, 1.0)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on documents that ``usable`` admits, with a language and a letter:
    of every language those of lowest hash, ``sample_rows`` / languages at most
    but ``LEAST_ROWS`` of each, so that a rare language is learned too."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"),
                       (F.lit(True) if usable is None else usable).alias("u"))
    marked = rows.where(F.col("u") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")) \
        .select("lang", "text", F.xxhash64("i", "lang").alias("h"))
    # Only languages and hashes are sorted; the sample's texts are fetched after.
    languages = marked.select("lang").distinct().count()
    if not languages:
        return LanguageModel(None, [])
    each = max(LEAST_ROWS, sample_rows // languages)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cuts = marked.select("lang", "h").withColumn("k", place).where(F.col("k") <= each).groupBy("lang").agg(F.max("h").alias("top"))
    # One short row a language, and their number is known: texts stay where they are.
    picked = marked.join(F.broadcast(cuts) if languages <= SENT_LANGUAGES else cuts, "lang").where("h <= top")
    # Rows of one hash (copies) may be more than the place they share.
    sample = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))) \
        .where(F.col("k") <= each).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in parts(b.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in vectors(raw, offsets)], pa.binary()), b.column(1).slice(lo, hi - lo)],
                    ["x", "lang"])

    found = sample.mapInArrow(run, "x binary, lang string").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, TERMS + 1)
    langs = found.column("lang").to_pylist()
    order_of = np.lexsort((x @ np.random.default_rng(5).standard_normal(x.shape[1]), langs)) if langs else []
    return LanguageModel.fit(x[order_of], [langs[k] for k in order_of])


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    t = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"),
                       F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            langs, scores = [], []
            for _, _, raw, offsets in parts(b.column(1)):
                got, score = own.predict(vectors(raw, offsets))
                langs += got
                scores.append(score)
            letters = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            score = np.where(letters, np.concatenate(scores) if scores else np.zeros(0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v if ok else UNKNOWN for v, ok in zip(langs, letters)], pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
