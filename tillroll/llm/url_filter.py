"""URL filter: gradient-boosted trees on lexical features of the address.

Explicit rules (host suffix plus path prefix, longest first) label part of
the addresses; boosted trees trained on a bounded sample of those labels
judge the rest from lexical features alone: lengths, depth, digit and symbol
ratios, character entropy, parameter counts, and block rates of the host's
suffixes among labelled addresses.  A labelled address takes the rates of the
folds that hold other hosts only, so that the trees are not fitted on rates
that contain the row's own label.

Defined results: an address that is null, empty or has no ``://`` has an
empty host and path and goes to the model like any other; if the labels hold
fewer than two classes, the verdict of unruled addresses is the only class
seen (``allow`` without any label); repeated rows are judged each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import bind, written

# The contract's rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Rows of labelled addresses the trees are fitted on (lowest hash first).
TRAIN_ROWS = 20_000
#: Documents a suffix needs before its own block rate outweighs the prior.
SUFFIX_PRIOR = 20.0
#: Folds of hosts for the rates of labelled addresses.
FOLDS = 5
FEATURES = ["url_len", "host_len", "path_len", "depth", "host_dots", "digit_ratio", "hyphens", "other_ratio",
            "entropy", "n_params", "has_fragment", "is_https", "tld_rate", "suffix_rate"]


def split_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host (A-Z lowered) and path (up to ``?`` or ``#``)."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), u.alias("u"))
    pos = F.locate("://", F.col("u"))
    rest = F.when(pos > 0, F.expr("substring(u, locate('://', u) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return base.withColumn("rest", rest).select(
        "page_id", "u",
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"), "rest")


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later conditions wrap earlier ones, so the longest rule is tested first.
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) \
            & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits (empty: 0)."""
    def of(chars: Column) -> Column:
        n = F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: bind(
            F.size(F.filter(chars, lambda x: x == c)) / n, lambda p: acc - p * F.log2(p)))
    return bind(F.filter(F.split(text, ""), lambda c: c != ""), of)


def lexical_features(urls: DataFrame) -> DataFrame:
    """The address features that need no statistics of other addresses."""
    length = F.greatest(F.length("u"), F.lit(1))
    query = F.regexp_extract("rest", r"\?([^#]*)", 1)
    digits = F.length("u") - F.length(F.translate("u", "0123456789", ""))
    letters_off = F.length(F.regexp_replace("u", r"[A-Za-z0-9]", ""))
    labels = F.split("host", r"\.")
    return urls.select(
        "page_id", "host", "path", "rule", "label",
        F.length("u").cast("double").alias("url_len"),
        F.length("host").cast("double").alias("host_len"),
        F.length("path").cast("double").alias("path_len"),
        (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double").alias("depth"),
        (F.size(labels) - 1).cast("double").alias("host_dots"),
        (digits / length).alias("digit_ratio"),
        (F.length("u") - F.length(F.translate("u", "-", ""))).cast("double").alias("hyphens"),
        (letters_off / length).alias("other_ratio"),
        _entropy(F.col("u")).alias("entropy"),
        F.when(query == "", 0.0).otherwise(
            (F.length(query) - F.length(F.translate(query, "&", "")) + 1).cast("double")).alias("n_params"),
        F.col("rest").contains("#").cast("double").alias("has_fragment"),
        F.lower("u").startswith("https://").cast("double").alias("is_https"),
        F.element_at(labels, -1).alias("tld"),
        F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).alias("suffix"))


def _shrunk(blocked: Column, n: Column) -> Column:
    return (blocked + 0.5 * SUFFIX_PRIOR) / (n + SUFFIX_PRIOR)


def with_suffix_rates(base: DataFrame) -> DataFrame:
    """``tld_rate`` and ``suffix_rate``: block rates among the labelled
    addresses, shrunk to 1/2; for a labelled address among those of the other
    folds of hosts."""
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    labelled = base.where("label is not null").withColumn("fold", fold)
    rated = base
    for key, name in (("tld", "tld_rate"), ("suffix", "suffix_rate")):
        sums = [(F.sum(F.when(F.col("fold") == k, F.col("label")).otherwise(0.0)),
                 F.sum(F.when(F.col("fold") == k, 1.0).otherwise(0.0))) for k in range(FOLDS)]
        rates = labelled.groupBy(F.col(key).alias("_key")).agg(
            F.array(*[b for b, _ in sums]).alias("_blocked"), F.array(*[n for _, n in sums]).alias("_n"))

        def total(c: str) -> Column:
            left_out = F.when(F.col("label").isNotNull(), F.get(F.col(c), fold)).otherwise(0.0)
            return F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x) - left_out

        rated = rated.join(rates, F.col(key) == F.col("_key"), "left") \
            .withColumn(name, F.coalesce(_shrunk(total("_blocked"), total("_n")), F.lit(0.5))) \
            .drop("_key", "_blocked", "_n")
    return rated


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and block probability of every row.

    ``train_rows`` bounds the labelled addresses the trees are fitted on; the
    suffix statistics cover all labelled addresses.
    """
    rule, verdict = rule_columns(rules)
    urls = split_url(pages, id_col, url_col).withColumn("rule", rule).withColumn(
        "label", F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0))
    base = written(lexical_features(urls), "url-features")
    rated = with_suffix_rates(base)
    order = F.xxhash64("page_id", "host", "path")
    train = written(rated.where("label is not null").orderBy(order).limit(train_rows).select("label", *FEATURES),
                    "url-train")
    classes = {r["label"] for r in train.select("label").distinct().collect()}  # at most two rows
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if len(classes) == 2:
        model = GBTClassifier(labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, seed=7).fit(
            assembler.transform(train))
        scored = model.transform(assembler.transform(rated)).withColumn("p", _second(F.col("probability")))
    else:
        scored = rated.withColumn("p", F.lit(1.0 if classes == {1.0} else 0.0))
    by_rule = F.when(F.col("label") == 1.0, "block").when(F.col("label") == 0.0, "allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce(by_rule, F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         F.col("p").alias("block_score"))


def _second(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(vector)[1]
