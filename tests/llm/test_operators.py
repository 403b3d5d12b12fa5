"""Operators against brute force, exact round trips and held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import MID, SF, classes_by_definition, left_by_definition, removed_by_definition
from pyspark.sql import functions as F

from tillroll.llm import (ann, bpe_codec, edit_counts, host_rules, langid, near_dedup, packing, queries, quality_knn,
                          suffix_dedup)
from tillroll.llm.common import table
from tillroll.llm.components import connected_components
from tillroll.llm.pretokens import read_ranks
from tillroll.llm.text_features import CLASS_OF, CLASSES, gram_counts, parts, shape_counts, unit_rows, word_shares


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def test_quality_on_held_out_labels(spark):
    got = queries.op1(spark, MID).join(table(spark, MID, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97


def test_quality_votes_by_definition():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((60, 8)).astype(np.float32), (rng.random(60) < 0.5).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = quality_knn.LatentVotes(None, None, None, x[:50], y[:50])
    for q, s in zip(x[50:], model.score(x[50:])):
        c = x[:50] @ q
        near = np.argsort(-c)[:quality_knn.NEIGHBOURS]
        w = np.maximum(c[near], 0).astype(float) ** quality_knn.POWER
        assert s == pytest.approx((w * y[near]).sum() / w.sum(), rel=1e-5)


def test_quality_frequencies_and_scores_by_definition(spark, docs):
    whole = table(spark, SF, "documents")
    model = queries.learn_quality(spark, whole, SF)
    texts = [(r.text or "").encode() for r in docs.values()]
    low = [t.lower() for t in texts]
    shapes = [{tuple(CLASS_OF[list(t[k:k + 3])]) for k in range(len(t) - 2)} for t in texts]
    held = Counter(x for one in shapes for x in one)
    want = np.ones(CLASSES ** 3) * (np.log(1 + len(texts)) + 1)
    for (a, b, c), n in held.items():
        want[(int(a) * CLASSES + int(b)) * CLASSES + int(c)] = np.log((1 + len(texts)) / (1 + n)) + 1
    assert np.allclose(model.shape_idf, want, rtol=1e-5)
    grams = Counter()
    for t in low:
        grams.update({((t[k] << 16 | t[k + 1] << 8 | t[k + 2]) * 2654435761 % 2 ** 32) >> 21 for k in range(len(t) - 2)})
    assert np.allclose(model.gram_idf, [np.log((1 + len(texts)) / (1 + grams[g])) + 1 for g in range(2048)], rtol=1e-5)
    scores = {r.doc_id: r.score for r in quality_knn.score_quality(whole, model).collect()}
    for doc_id, r in docs.items():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        off = np.array([0, len(raw)])
        x = unit_rows(model.terms(shape_counts(raw, off), gram_counts(raw, off), word_shares(raw, off)) @ model.axes)[0]
        cosine = [float(np.dot(x, v)) for v in model.vectors]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[:quality_knn.NEIGHBOURS]
        weight = [max(cosine[k], 0) ** quality_knn.POWER for k in near]
        plain = sum(w * model.labels[k] for w, k in zip(weight, near)) / sum(weight) if sum(weight) else model.labels.mean()
        assert scores[doc_id] == pytest.approx(plain, abs=1e-3)


def test_word_shares_compare_whole_words():
    start = "x" * 200
    texts = [f"{start}a {start}b {start}c", f"{start}a {start}a b", "y" * (3 << 20) + " AB AB", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    for got, t in zip(word_shares(raw, off), texts):
        w = t.split()
        n = max(len(w), 1)
        assert got == pytest.approx([np.log1p(len(w)) / 10, sum(a == b for a, b in zip(w, w[1:])) / n,
                                     1 - (len(set(w)) / n if w else 0), sum(sum(c.isupper() for c in x) >= 2 for x in w) / n,
                                     min(sum(map(len, w)) / n, 30) / 30], abs=1e-6)


def test_sample_takes_documents_that_are_there(spark):
    labels = spark.range(100).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    docs = spark.range(90, 120).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    got = quality_knn.labelled_sample(docs, labels, "doc_id", "text", "quality", F.lit(True), 8).collect()
    assert len(got) == 8 and all(r.label == int(r.text.split()[1]) % 2 for r in got)


def test_passages_by_definition(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefghij é") for _ in range(2600))
    noise = lambda n: "".join(rng.choice("klmnopü qr") for _ in range(rng.randint(0, n)))
    texts = ["a" * 399, "a" * 400, "a" * 401, "ab" * 500, "", "xy" * 199 + "z"]
    for _ in range(40):
        a = rng.randint(0, 2000)
        texts.append(noise(300) + shared[a:a + rng.randint(360, 600)] + noise(300))
    texts += [shared[:700]] * 3 + [shared[100:500] + shared[100:500]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_passages(df).collect()}
    assert [got[k] for k in range(len(texts))] == removed_by_definition([t.encode() for t in texts])


@pytest.mark.parametrize("scale", [suffix_dedup.Scale(150, 64), suffix_dedup.WORDS_50])
def test_shorter_passages_by_definition(spark, scale):
    rng = random.Random(6)
    shared = [words(rng, 400), words(rng, 400, "xyzw")]
    texts = ["", "ab " * 60, "z" * 149, "z" * 150]
    for _ in range(60):
        a, n = rng.randint(0, 300), rng.randint(20, 90)
        texts.append(" ".join(words(rng, 30, "klmnop") + rng.choice(shared)[a:a + n] + words(rng, 30, "qrst")))
    texts += texts[-2:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.strip_passages(df, scale=scale).collect()}
    assert [got[k] for k in range(len(texts))] == [left_by_definition(t, texts, scale) for t in texts]
    assert sum(got[k] != t for k, t in enumerate(texts)) > 30


def test_digests_of_spans(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    raw = np.frombuffer(bytes(random.Random(2).choices(b"ab", k=3000)), np.uint8)
    begin = np.arange(2500)
    for n in (1, 3, 12, 400):
        one, two = suffix_dedup.span_digests(raw, begin, begin + n, np.zeros(2500, np.int64))
        names = [bytes(raw[k:k + n]) for k in begin]
        assert len(set(zip(names, one, two))) == len(set(names)) == len(set(one)) == len(set(two))
        assert not set(one) & set(suffix_dedup.span_digests(raw, begin, begin + n, np.ones(2500, np.int64))[0])


def test_passages_of_documents(spark, docs):
    ids = sorted(docs)
    got = {r.doc_id: tuple(r)[1:5] for r in queries.op2(spark, SF).collect()}
    assert [got[k] for k in ids] == removed_by_definition([(docs[k].text or "").encode() for k in ids])


def test_anchors_do_not_depend_on_steps(monkeypatch):
    rng = np.random.default_rng(3)
    raw, offsets = rng.integers(97, 100, 5000, dtype=np.uint8), np.array([0, 100, 100, 2600, 2700, 5000])
    whole = suffix_dedup.anchors(raw, offsets)
    monkeypatch.setattr(suffix_dedup, "STEP", 512)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(raw, offsets)))


def test_packing_is_whole_and_dense(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in queries.op3(spark, SF).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for k, pieces in by_doc.items():
        ids = np.array(t.encode(docs[k].text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 2048 - at if at & at - 1 else 0
    assert padding < 0.01 * 2048 * len(by_seq)


def test_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["a <|endoftext|> b", "<|startoftext|>Hello<|endoftext|>", "A <|ENDOFTEXT|> B", "x<|endoftext|", "é <|EndOfText|>é  <|endoftext|>\n",
             "plain words, no marker", "", "<|endoftext|>" * 3]
    own = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY))
    got = [np.frombuffer(b, own.dtype).tolist() for b in own.encode([x.encode() for x in texts])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert got[0] == [320, 49407, 321]


def test_first_fit_decreasing_by_definition():
    rng = random.Random(1)
    for n in (0, 1, 7, 200):
        lengths = [rng.randint(1, 100) for _ in range(n)]
        room, expected = [], []
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), None)
            if k is None:
                k = len(room)
                room.append(100)
                expected.append([])
            room[k] -= lengths[i]
            expected[k].append(i)
        assert packing.first_fit_decreasing(lengths, 100) == expected


def test_neighbours_recall(spark):
    rows = table(spark, MID, "embeddings").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in queries.op4(spark, MID).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hit += len({v for v, _ in got[q]} & set(ids[order]))
        total += 10
        assert len(got[q]) == 10 and all(s == pytest.approx(d[ids == v][0], abs=1e-12) for v, s in got[q])
    assert hit >= 0.9 * total


def test_neighbours_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(k, rng.standard_normal(6).tolist()) for k in range(300)], "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 50 == 0
    one = {(r.query_id, r.rank): r.score for r in ann.nearest_neighbours(v, is_query).collect()}
    many = {(r.query_id, r.rank): r.score for r in ann.nearest_neighbours(v, is_query, block_rows=40, chunk_queries=2).collect()}
    assert one.keys() == many.keys() and np.mean([abs(one[k] - many[k]) < 1e-9 for k in one]) > 0.9


def test_host_rules_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = {r[0]: r for r in con.execute(f"SELECT {', '.join(cols)} FROM ({queries.OP5_SQL})").fetchall()}
    got = {r.doc_id: tuple(r[c] for c in cols) for r in queries.op5(spark, SF).collect()}
    assert got == expected


def test_repeat_words_by_definition(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["x " * 2000]
    df = spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in host_rules.rule_features(df).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        count = Counter(grams)
        assert got[k] == len({i + o for i, g in enumerate(grams) if count[g] > 1 for o in range(5)})


def test_bad_host_loses_only_failing_documents(spark):
    rng = random.Random(7)
    clean = lambda: " ".join(words(rng, 40))
    rows = [(k, clean() if k % 10 == 0 else clean().replace(" ", "### "), "bad.com") for k in range(200)]
    rows += [(1000 + k, clean() if k % 20 else clean().replace(" ", "### "), f"good{k % 5}.com") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.judge_documents(df).collect()}
    assert all(kept[k] == (k % 10 == 0) for k in range(200)) and all(kept[1000 + k] for k in range(400))


def test_edits_against_full_counts():
    own = edit_counts.counter(public_tokenizers.path(edit_counts.VOCABULARY))
    rng = random.Random(3)
    letters = list("ab é'sretlv ll\n\t 12½.!|日Σ\x1c ")
    text = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        current = text(40)
        tree = edit_counts.TokenTree(current, own)
        for _ in range(4):
            assert tree.total == len(own.encoding.encode_ordinary(current))
            a = rng.randint(0, len(current))
            b, new = rng.randint(a, min(len(current), a + 6)), text(5)
            current = current[:a] + new + current[b:]
            tree.edit(a, b, new)
        assert tree.total == len(own.encoding.encode_ordinary(current))


def test_edits_reencode_little(spark, docs):
    own = edit_counts.counter(public_tokenizers.path(edit_counts.VOCABULARY))
    tree = edit_counts.TokenTree(" ".join(words(random.Random(1), 5000)), own)
    tree.edit(9000, 9004, "mail")
    assert tree.reencoded <= 8
    for bad in ([(0, 3, ""), (2, 4, "")], [(0, 99, "")]):
        with pytest.raises(ValueError):
            edit_counts.apply_edits(edit_counts.TokenTree("abcdef", own), bad)
    for r in queries.op7(spark, SF).collect():
        text = docs[r.doc_id].text or ""
        edits = edit_counts.redaction_edits(text)
        after = text
        for s, e, new in reversed(edits):
            after = after[:s] + new + after[e:]
        count = lambda t: len(own.encoding.encode_ordinary(t))
        assert (r.n_tokens_before, r.n_tokens_after, r.n_edits) == (count(text), count(after), len(edits))


def test_languages_on_held_out_documents(spark):
    got = queries.op8(spark, MID).join(table(spark, MID, "documents").select("doc_id", "lang"), "doc_id") \
        .where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95


def test_rare_language_is_learned(spark):
    """One document in a hundred, of which the sample would hold none by chance."""
    rng = random.Random(4)
    letters = {"aa": "abcdx", "bb": "mnopy", "rare": "stuvz"}
    rows = [(k, " ".join(words(rng, 40, letters[lang])), lang) for k, lang in enumerate(["aa", "bb"] * 300 + ["rare"] * 6)]
    df = spark.createDataFrame(rows + [(None, "12 34", "digits")] * 50, "doc_id long, text string, lang string")
    model = langid.fit_languages(df, sample_rows=60)
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(df, model).collect()}
    assert np.mean([got[k] == lang for k, _, lang in rows]) > 0.99 and {got[k] for k, _, lang in rows if lang == "rare"} == {"rare"}
    assert "digits" not in got.values() and got[None] == "und"


def test_language_families():
    rng = random.Random(2)
    letters = {"aa": "abcdx", "ab": "abcdy", "ba": "mnopx", "bb": "mnopy"}
    texts = [(lang, " ".join(words(rng, 60, ls))) for lang, ls in letters.items() for _ in range(30)]
    x = np.concatenate([langid.vectors(raw, o) for _, _, raw, o in parts(pa.array([t for _, t in texts]))])
    model = langid.LanguageModel.fit(x[::2], [lang for lang, _ in texts[::2]])
    assert sorted(sorted(m.classes) for m in model.within) == [["aa", "ab"], ["ba", "bb"]]
    assert model.predict(x[1::2])[0] == [lang for lang, _ in texts[1::2]]


def test_near_duplicates_by_definition(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "a b", "a b", "b a"]
    for _ in range(25):
        base = words(rng, rng.randint(30, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == classes_by_definition(texts)


def test_near_duplicates_of_documents(spark, docs):
    ids = sorted(docs)
    expected = classes_by_definition([docs[k].text for k in ids])
    got = {r.doc_id: r.class_id for r in queries.op9(spark, SF).collect()}
    assert [got[k] for k in ids] == [ids[k] for k in expected]


def test_chain_of_near_copies(spark):
    """Members that resemble their neighbours but not the ends of the chain."""
    rng = random.Random(12)
    text, texts = words(rng, 200), []
    for k in range(12):
        text = list(text)
        text[k * 15] = f"new{k}"
        texts.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in near_dedup.near_duplicates(df).collect()} == {0}


def test_near_copies_with_a_repeated_block(spark):
    """Copies that add a block again and again: alike as sets, not as weighted ones."""
    rng = random.Random(13)
    texts = []
    for k in range(30):
        base, block = words(rng, 200), words(rng, 40)
        texts += [" ".join(base), " ".join(base + block * (3, 10, 30, 100)[k % 4])]
    expected = classes_by_definition(texts)
    assert expected == [k - k % 2 for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert [got[k] for k in range(60)] == expected


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    a, b = rng.random(60) + 0.2, rng.random(60) + 0.2
    a[:10], b[50:] = 0, 0
    exact = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in range(60)) for i in range(10, 50))
    row = np.repeat([0, 1], 60)
    keep = np.concatenate([a, b]) > 0
    sig = near_dedup.prob_min_hash(row[keep], np.tile(element, 2)[keep], np.concatenate([a, b])[keep], 2, 20_000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.015)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 20)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 20: 20} | {100 + k: 100 for k in range(41)}


def test_codec_against_rank_library(spark, docs):
    import hashlib
    own = bpe_codec.codec(public_tokenizers.path(bpe_codec.VOCABULARY))
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    letters = "ab é'sre ll\n\t\x1c\x1f\x85\xa0  12½.!|日本ßΣ😀́​\x00<>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()
    for r in queries.op10(spark, SF).collect():
        ids = other.encode_ordinary(docs[r.doc_id].text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()


def test_codec_model_needs_gapless_ranks():
    with pytest.raises(ValueError):
        bpe_codec.serialise_model({b"a": 0, b"b": 2})
    ranks = read_ranks(public_tokenizers.path(bpe_codec.VOCABULARY))
    assert len(bpe_codec.codec(public_tokenizers.path(bpe_codec.VOCABULARY)).pieces) == len(ranks)


def test_encoded_documents(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe_codec.encode_documents(df).collect()}
    own = bpe_codec.codec(public_tokenizers.path(bpe_codec.VOCABULARY))
    assert got == {1: own.encode("hello world"), 2: []}
