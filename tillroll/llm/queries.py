"""Registered queries of this package: each applies one operator to its whole
table and derives the returned digest columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (ann, bpe_codec, edit_counts, host_rules, langid, lexical_search, near_dedup, packing,
                          quality_knn, simhash, suffix_dedup, url_filter, whitening)
from tillroll.llm.common import ORACLES, QUERIES, crc_mod, query, table


def learn_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_knn.LatentVotes:
    """Fit on the labels of documents that are not held out."""
    return quality_knn.fit_quality(docs, table(spark, sf_dir, "labels"), usable=crc_mod("doc_id", 5) != 0)


@query("op1_quality_knn")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_knn.score_quality(docs, learn_quality(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= quality_knn.THRESHOLD).cast("int").alias("predicted"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_passages(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op4_ann")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT k, i, list_slice(ws, i, i + 4) AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM p) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM r, range(0, 5) AS z(o) GROUP BY k),
f AS (SELECT w.k, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.k = rep.k),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             n_symbols > 0.1 * word_chars OR n_dup_lines > 0.3 * n_lines OR word_chars < 2.0 * n_words
             OR word_chars > 14.0 * n_words AS soft_failed FROM f),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed OR soft_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f
      FROM j GROUP BY host),
m AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS v FROM h),
s AS (SELECT m, CASE WHEN v <= 1e-12 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS s FROM m),
b AS (SELECT host, (f + m * s) / (n + s) >= 0.5 AS bad FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (bad AND soft_failed) AS kept
FROM j JOIN b ON j.host IS NOT DISTINCT FROM b.host
"""


@query("op5_host_rules", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_edit_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_with_edits(table(spark, sf_dir, "documents"))


@query("op8_langid")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs, usable=crc_mod("doc_id", 4) != 2)
    return langid.predict_languages(docs, model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query("op10_bpe_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
dw AS (SELECT k, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
len AS (SELECT k, doc_id, CAST(count(*) AS BIGINT) AS n FROM dw GROUP BY k, doc_id),
size AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
tf AS (SELECT k, term, CAST(count(*) AS BIGINT) AS tf FROM dw GROUP BY k, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, size),
it AS (SELECT row_number() OVER () AS q, item_id, t FROM (SELECT DISTINCT item_id,
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)),
qt AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM it),
s AS (SELECT q, item_id, len.k, len.doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
      FROM qt JOIN wt USING (term) JOIN tf USING (term) JOIN len ON tf.k = len.k, size GROUP BY q, item_id, len.k, len.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


@query("op11_lexical_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
