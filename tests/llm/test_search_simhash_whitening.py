"""Lexical search, SimHash and whitening against their definitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import LONG, MID, SF, edge_docs

from tillroll.llm import lexical_search, queries, simhash, whitening
from tillroll.llm.common import table
from tillroll.plans.oracle_check import compare, duck

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked_by_definition(docs, items, k=50):
    """{(id, text): [(rank, doc_id, score)]} over (doc_id, text) rows."""
    counts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(size for *_, size in counts)
    held = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in held.items()}
    out = {}
    for item, text in set(items):
        found = []
        for i, c, size in counts:
            m = 50 + (50 * size * n) // total
            s = sum(weight[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(lowered(text))) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        best = sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k]
        if best:
            out[item, text] = [(r, i, -s) for r, (s, _, i) in enumerate(best, 1)]
    return out


def searched(docs, items, **options):
    got = {}
    for r in lexical_search.rank_documents(docs, items, **options).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("sf", [SF, MID])
def test_search_matches_its_sql(spark, sf):
    message, same = compare(spark, duck(sf), "op11_lexical_search", queries.op11, queries.OP11_SQL, sf)
    assert same, message


def test_search_by_definition(spark, monkeypatch):
    """Ties, few words, many blocks: everything that reading stops early on."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 16)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d e f gg hh I1 Éé-x".split()) for _ in range(rng.randint(0, n)))
    docs = [(rng.randint(0, 90), text(30)) for _ in range(300)]
    items = [(k, text(6) + " rare") for k in range(12)] + [(20, "absent words"), (21, "")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string")
    want = {k[0]: v for k, v in ranked_by_definition(docs, items, 7).items()}
    assert searched(left, right, k=7) == want
    assert searched(left, right, k=7, block_terms=10) == want  # several passes over the documents


def test_search_edges(spark):
    docs, empty = edge_docs(spark), edge_docs(spark, empty=True)
    rows = [(1, "one FOUR w5 x17"), (1, "one FOUR w5 x17"), (None, "grüße six"), (3, None), (4, "..."), (5, LONG), (6, "nowhere")]
    items = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], "item_id long, text string, score double, rank int, no int")
    own = [(r.doc_id, r.text) for r in docs.collect()]
    assert searched(docs, items) == {k[0]: v for k, v in ranked_by_definition(own, rows).items()}
    assert lexical_search.rank_documents(empty, items).count() == 0
    assert lexical_search.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical_search.rank_documents(docs.where("doc_id in (1, 2, 3)"), items).count() == 0


def fingerprint_by_definition(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_by_definition(rows):
    """(doc_id, fingerprint, component) of (doc_id, text) rows."""
    codes = np.array([fingerprint_by_definition(t) for _, t in rows], np.uint64)
    group = np.arange(len(rows))
    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(codes[:k] ^ codes[k]) <= 2):
            group[group == group[k]] = group[j]
    least = {g: min((rows[k][0] for k in np.flatnonzero(group == g) if rows[k][0] is not None), default=None) for g in set(group)}
    return sorted(((i, format(int(c), "016x"), least[g]) for (i, _), c, g in zip(rows, codes, group)), key=str)


@pytest.mark.parametrize("limit", [8, simhash.SUBTRIE])
def test_simhash_by_definition(spark, limit):
    docs = table(spark, SF, "documents")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, limit=limit).collect()), key=str)
    assert got == linked_by_definition([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_chains(spark):
    """A long text edited word by word gives chains of fingerprints a few bits apart."""
    rng = random.Random(8)
    words, rows = [str(rng.random()) for _ in range(400)], []
    for k in range(150):
        rows.append((1000 - k, " ".join(words)))
        words[rng.randrange(400)] = str(rng.random())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked_by_definition(rows)
    assert len({c for *_, c in want}) < 100  # chains there are
    assert sorted((tuple(r) for r in simhash.near_duplicates(df, limit=20).collect()), key=str) == want


def test_trie_walk_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(10):
        centres = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
        codes = [centres[rng.integers(4)] if rng.random() < 0.8 else rng.integers(0, 1 << 64, dtype=np.uint64) for _ in range(300)]
        flips = [sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 4)).tolist())) for _ in codes]
        codes = np.unique(np.array([int(c) ^ f for c, f in zip(codes, flips)], np.uint64))
        a, b = codes[::2], codes[1::2]
        for left, right in ((codes, None), (a, b)):
            other = left if right is None else right
            want = [(i, j) for i in range(len(left)) for j in np.flatnonzero(np.bitwise_count(other ^ left[i]) <= 2).tolist()
                    if right is not None or i < j]
            got = [p for u, v in simhash.walk(left, right) for p in zip(u.tolist(), v.tolist())]
            assert sorted(got) == want  # every pair, once


def test_simhash_edges(spark):
    docs = edge_docs(spark)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == linked_by_definition([(r.doc_id, r.text) for r in docs.collect()])
    assert [c for i, f, c in got if f == "0" * 16] == [1] * 4  # null, empty, blank and a null id
    assert simhash.near_duplicates(edge_docs(spark, empty=True)).count() == 0
    alone = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert [tuple(r)[::2] for r in simhash.near_duplicates(alone).collect()] == [(None, None)]


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), values[::-1], c @ turn[:, ::-1]


@pytest.mark.parametrize("block", [16, 32])
def test_whitening_against_dense_eigenvectors(spark, block):
    source = table(spark, SF, "embeddings")
    got = whitening.whiten(source, block=block).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r.vec_id, r.embedding) for r in source.collect())
    n, deviation, values, projected = dense([v for _, v in rows])
    white = got.whitened.to_numpy().reshape(n, 8)
    want = projected[:, :8] / np.sqrt(values[:8])
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(n, 8) == deviation[:, None]).all() and (got.n == n).all()
    assert np.allclose(got.explained.to_numpy()[:8], values[:8] / values.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-8
    assert list(got.component[:8]) == list(range(1, 9))


def test_filter_finds_close_eigenvalues():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.concatenate([[5, 4.999, 4.99, 3, 3, 2.5, 2.2, 2.1], np.linspace(2.0, 0, 112)])
    matrix = (turn * values) @ turn.T
    got, q = whitening.leading_pairs(lambda b: matrix @ b, 120, 8)
    assert np.allclose(got, values[:8], rtol=1e-12)
    assert np.abs(matrix @ q - q * got).max() < 1e-12 and np.allclose(q.T @ q, np.eye(8), atol=1e-13)


def test_whitening_edges(spark):
    good = [[1.0, 2.0, 0.5], [2.0, -1.0, 0.5], [0.25, 0.0, 0.5], [0.25, 0.0, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    schema = "vec_id long, embedding array<float>, x string, n int, component string"
    rows = [(k if k else None, v, "x", 1, "c") for k, v in enumerate(good + bad)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).toPandas().sort_values(["component", "deviation"])
    n, deviation, values, projected = dense(good)
    assert len(got) == 2 * n  # the third direction has no variance
    assert sorted(got.deviation[:4]) == sorted(deviation.tolist()) and got.vec_id.isna().sum() == 2
    assert np.allclose(got.explained.unique(), values[:2] / values.sum())
    for flat in ([], rows[2:3], [rows[2]] * 3, rows[4:]):
        assert whitening.whiten(spark.createDataFrame(flat[:5] if flat == rows[4:] else flat, schema)).count() == 0
    zeros = [(k, [0.0, 0.0], "x", 1, "c") for k in range(3)] + [(9, [float(1 << 40), 1.0], "x", 1, "c")]
    wide = whitening.whiten(spark.createDataFrame(zeros, "vec_id long, embedding array<double>, x string, n int, component string"))
    assert {r.deviation for r in wide.collect()} == {None, }
