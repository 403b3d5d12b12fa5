"""Host-level quality rules, in DataFrame functions only.

Each document gets word statistics and two kinds of rule failures: *base*
failures (too short, too repetitive), which reject the document by
themselves, and *soft* failures (symbols, repeated lines, word lengths),
which are evidence about the host.  Failures are aggregated by host
(``source``); each host's failure rate is shrunk towards the corpus with a
beta prior fitted to all hosts by the method of moments; hosts whose shrunk
rate reaches ``host_rate`` are bad.  The verdicts join back to the documents:
a document of a bad host is rejected if it breaks any soft rule itself, so
clean documents of a bad host stay.

Defined results: null or empty text has zero words and fails the base rule;
a null source is a host of its own; repeated rows count (and are returned)
once each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import bind, written

# The separators between words, and the symbol characters.
WORD_SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
SYMBOL_SHARE = 0.10
DUP_LINE_SHARE = 0.30
WORD_LENGTH = (2.0, 14.0)
HOST_RATE = 0.5
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words lying in a ``WINDOW``-word window that occurs twice or more.

    Windows are compared by 64-bit hash.  Texts without a repeated window
    (the usual case) stop after one hash-set pass; the others sort
    (hash, position) once and sum the union of the repeated windows.
    """
    def covered(grams: Column) -> Column:
        def union_of(s: Column) -> Column:
            n = F.size(s)
            hit = F.filter(s, lambda x, j: (
                ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
                | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"]))))
            starts = F.array_sort(F.transform(hit, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
            return F.aggregate(starts, zero, lambda acc, i: F.struct(
                (acc["total"] + i + WINDOW - F.greatest(acc["end"], i)).alias("total"),
                (i + WINDOW).alias("end")), lambda acc: acc["total"])

        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")) \
            .otherwise(bind(pairs, union_of))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = bind(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(bind(grams, covered))


def rule_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """Word statistics, base verdict and soft failures, one row per input row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.filter(F.split("t", WORD_SPACE), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: _without(x, SPACES) != "")
    stats = base.select(
        "doc_id", "host",
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                       (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("x"))
    flat = stats.select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
                        F.col("x.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"),
                        F.col("x.n").alias("n_lines"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    soft = ((F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars"))
            | (F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_lines"))
            | (F.col("word_chars") < WORD_LENGTH[0] * F.col("n_words"))
            | (F.col("word_chars") > WORD_LENGTH[1] * F.col("n_words")))
    return flat.withColumn("base_failed", base_failed).withColumn("soft_failed", soft)


def host_verdicts(features: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, verdict.

    Prior: mean m = failures / documents over the corpus; variance v of the
    hosts' rates around m, weighted by documents; a + b = m (1 - m) / v - 1,
    kept within 1 and 1e6 (no spread between hosts: full shrinkage).
    """
    hosts = features.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed"))
    total = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"),
                      F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("sq"))
    mean = F.col("f") / F.col("n")
    spread = F.col("sq") / F.col("n") - mean * mean
    prior = total.where("n > 0").select(
        mean.alias("m"),
        F.when(spread <= 1e-12, F.lit(1e6)).otherwise(
            F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / spread - 1))).alias("strength"))
    # The prior is one row (a global aggregate).
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n_docs", "n_failed",
        ((F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("host_rate")) \
        .withColumn("host_bad", F.col("host_rate") >= host_rate)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Statistics, base verdict, host verdict and ``kept`` for every row."""
    features = written(rule_features(docs, id_col, text_col, host_col), "host-rules")
    verdicts = host_verdicts(features, host_rate).select(F.col("host").alias("h"), "host_rate", "host_bad")
    joined = features.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed"))).drop("h")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    text = F.xxhash64(F.col(text_col).cast("string"))
    judged = judge_documents(docs.withColumn("__id", F.struct(F.col(id_col).alias("i"), text.alias("t"))), "__id", text_col, host_col, host_rate)
    kept = judged.where("kept").select(F.col("doc_id.i").alias("__i"), F.col("doc_id.t").alias("__t"),
                                       F.col("host").alias("__h")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__i")) & (text == F.col("__t")) & F.col(host_col).eqNullSafe(F.col("__h"))
    return docs.join(kept, same, "left_semi")
