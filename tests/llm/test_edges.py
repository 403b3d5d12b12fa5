"""Every operator on nulls, empty and long texts, repeated rows, clashing
columns and empty tables."""

import re

import pytest
from helpers import LONG, MID, edge_docs
from pyspark.sql import functions as F

from tillroll.llm import bpe_codec, edit_counts, host_rules, langid, near_dedup, packing, quality_knn, suffix_dedup
from tillroll.llm import ann, url_filter


def quality(docs):
    labels = docs.sparkSession.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (99, 0), (7, None)], "doc_id long, quality int")
    return quality_knn.score_quality(docs, quality_knn.fit_quality(docs, labels))


def languages(docs):
    return langid.predict_languages(docs, langid.fit_languages(docs))


PER_ROW = {
    "quality": quality, "passages": suffix_dedup.remove_passages, "host_rules": host_rules.judge_documents,
    "counts": edit_counts.count_with_edits, "languages": languages, "near": near_dedup.near_duplicates,
    "codec": bpe_codec.round_trip_digests, "strip": suffix_dedup.strip_passages,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(spark, name):
    docs = edge_docs(spark)
    rows = PER_ROW[name](docs).collect()
    assert len(rows) == docs.count()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(spark, name):
    assert PER_ROW[name](edge_docs(spark, empty=True)).count() == 0


def test_packing_edges(spark):
    rows = packing.pack_documents(edge_docs(spark)).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == rows[[r.doc_id for r in rows].index(4)].doc_tokens
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert sum(r.doc_id is None for r in rows) >= 2
    assert packing.pack_documents(edge_docs(spark, empty=True)).count() == 0


def test_defined_results(spark):
    docs = edge_docs(spark)
    langs = {(r.doc_id, r.lang_pred, r.score) for r in languages(docs).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (7, "und", 0.0)} <= langs
    near = near_dedup.near_duplicates(docs).collect()
    assert [(r.class_id, r.class_size) for r in near if r.doc_id == 5] == [(5, 3)] * 2
    assert {r.doc_id: r.class_id for r in near if r.doc_id in (1, 2, 3)} == {1: 1, 2: 2, 3: 3}
    judged = {r.doc_id: r for r in host_rules.judge_documents(docs).collect()}
    assert judged[1].n_words == judged[2].n_words == judged[3].n_words == 0 and judged[1].base_failed
    assert judged[4].n_words == len(LONG.split()) and judged[4].kept
    assert all(0 <= r.score <= 1 for r in quality(docs).collect())


def test_keep_and_drop_rows(spark):
    docs = edge_docs(spark)
    kept = host_rules.keep_documents(docs)
    assert [r.doc_id for r in kept.collect()] == [4] and kept.columns == docs.columns
    one = near_dedup.drop_near_duplicates(docs)
    assert one.columns == docs.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "None"])


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x?y#z"), (4, "http://EXAMPLE.com/en/x?y#z"),
            (None, "https://www.example.com/en/"), (5, "x://a.net/es/"), (6, "x://net/fr/q"), (7, "x://notnet/fr/"),
            (8, "http://h#/en/"), (9, "ftp://Ä.com:80/p://q")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_filter.judge_urls(pages).collect()}
    assert got == {(1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "example.com", "/en/x", "example.com/en/"),
                   (None, "www.example.com", "/en/", "www.example.com/en/"), (5, "a.net", "/es/", "net/es/"),
                   (6, "net", "/fr/q", "net/fr/"), (7, "notnet", "/fr/", None), (8, "h", "", None), (9, "Ä.com:80", "/p://q", None)}
    assert url_filter.judge_urls(pages).count() == len(rows)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_urls_with_clashing_columns_and_long_address(spark):
    long_url = "https://a.example.org/" + "p/" * 200_000 + "?" + "&".join(f"k{k}=1" for k in range(1000))
    rows = [(1, long_url), (2, "http://b.net/es/1"), (3, "http://example.com/fr/1"), (4, None)]
    names = ["label", "rule", "host", "path", "u", "rest", "tld", "suffix", "fold", "p", "probability", "features", "verdict"]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("x").alias(n) for n in names])
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert got[1].path == "/" + "p/" * 200_000 and got[1].verdict in ("allow", "block")
    assert (got[2].verdict, got[3].verdict, got[4].host) == ("block", "allow", "")


def _rule_by_definition(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_pages_by_definition(spark):
    """Host, path and rule of every page, out-of-fold suffix rates by a loop,
    and the verdict of the trees."""
    pages = spark.read.parquet(f"{MID}/pages.parquet")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ruled = agree = 0
    for r in pages.select("page_id", "url").collect():
        rest = (r.url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        rule, action = _rule_by_definition(host.translate(low), path)
        g = got.pop(r.page_id)
        assert (g.host, g.path, g.rule) == (host.translate(low), path, rule)
        assert g.verdict == (action or ("block" if g.block_score >= 0.5 else "allow"))
        ruled += action is not None
        agree += action is not None and (g.block_score >= 0.5) == (action == "block")
    assert not got and ruled and agree / ruled >= 0.9


def test_suffix_rates_leave_own_hosts_out(spark):
    rows = [(f"h{k % 7}.{('net', 'com', 'org')[k % 3]}", ("net", "com", "org")[k % 3], (None, 1.0, 0.0)[k * k % 3 if k % 4 else 0])
            for k in range(90)]
    base = spark.createDataFrame(rows, "host string, tld string, label double").withColumn("suffix", F.col("host"))
    fold = {r.host: r.f for r in base.select("host", F.expr(f"pmod(xxhash64(host), {url_filter.FOLDS})").alias("f")).collect()}
    for r in url_filter.with_suffix_rates(base).collect():
        for name, key in (("tld_rate", 1), ("suffix_rate", 0)):
            seen = [x[2] for x in rows if x[key] == (r.tld, r.host)[name == "suffix_rate"] and x[2] is not None
                    and (r.label is None or fold[x[0]] != fold[r.host])]
            p = url_filter.SUFFIX_PRIOR
            assert r[name] == pytest.approx((sum(seen) + p / 2) / (len(seen) + p))


def test_vectors(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, None), (4, [0.0, 0.0]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest_neighbours(v, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 1.0), (100, 2, 2, 1.0)]  # a tie goes to the smaller id
    assert ann.nearest_neighbours(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0
