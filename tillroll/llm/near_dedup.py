"""Near duplicates by ProbMinHash: weighted shingles, bands, verification.

A text's five-word shingles, weighted by 1 + ln(count), each send a Poisson
process of arrivals at rate weight into ``REGISTERS`` registers; a register
keeps the element that arrives first, and an element stops as soon as its
next arrival is later than every register's.  Two texts agree in a register
with the probability Jaccard of their shingles.  Registers are banded.  A link
needs a Jaccard similarity of the shingle sets of ``THRESHOLD`` or more,
computed from the whole texts; classes are the connected components.

Repeated shingles can push the weighted registers of two texts apart whose
sets are alike, so a text that repeats a shingle is banded by the same process
with unit weights too, whose registers agree with the Jaccard similarity of
the sets.  Without repeats both give the same keys, and a text has them once.

Buckets are not expanded into pairs.  First every member is compared with its
bucket's head, the most popular member (the one with most bucket mates: the
text that the others were copied from).  Then, in buckets that still hold
several classes, members of different classes are compared if they can be
similar at all: the shingles that each shares with the head, and those that
each shares outside the head with any text of an open bucket, bound what two
members have in common, which rules out all but a few exactly.  Buckets with
the same members count once, and a pair is made in the first bucket that it
shares only.  So no link between bucket mates is lost, and none is met twice.

Exact copies are one text from the start (keyed by 64-bit hash and text), so
a group of copies costs one row.  Defined results: null texts and texts
without a word are classes of their own; texts of one to four words are one
shingle; repeated rows share a class; a class is named by its least document
id (nulls last); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import discard, distinct_texts, scratch_tables, written
from tillroll.llm.components import connected_components
from tillroll.llm.shingles import mix, shingle_hashes
from tillroll.llm.text_features import parts

#: 32 bands of 5: a pair at 0.8 misses every band of unit weights with chance
#: 3e-6, whatever its counts.
BANDS = 32
BAND_ROWS = 5
REGISTERS = BANDS * BAND_ROWS
THRESHOLD = 0.8
#: Arrivals drawn at a time in one vectorised round.
DRAWS = 1 << 16


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int,
                  registers: int = REGISTERS) -> np.ndarray:
    """First arriving element of every register: ``rows`` x ``registers``."""
    arrival = np.full(rows * registers, np.inf)
    owner = np.zeros(rows * registers, np.uint64)
    latest = np.full(rows, np.inf)
    row, element, time, drawn = row.copy(), element.copy(), np.zeros(len(row)), 0
    rate = weight
    while len(row):
        n = max(1, min(64, DRAWS // len(row)))
        step = np.arange(drawn, drawn + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = mix(element[:, None] + step[None, :])
        chance = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        times = time[:, None] + np.cumsum(-np.log(chance), axis=1) / rate[:, None]
        place = row[:, None] * registers + (mix(bits) % np.uint64(registers)).astype(np.int64)
        flat_place, flat_time = place.ravel(), times.ravel()
        np.minimum.at(arrival, flat_place, flat_time)
        first = arrival[flat_place] == flat_time
        owner[flat_place[first]] = np.repeat(element, n)[first]
        touched = np.unique(row)
        latest[touched] = arrival.reshape(rows, registers)[touched].max(axis=1)
        going = times[:, -1] < latest[row]
        row, element, rate, time = row[going], element[going], rate[going], times[going, -1]
        drawn += n
    return owner.reshape(rows, registers)


def weighted_shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, distinct shingle and count, sorted by row and shingle."""
    row, h = shingle_hashes(raw, offsets)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def band_keys(owner: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    split = owner.reshape(len(owner), owner.shape[1] // BAND_ROWS, BAND_ROWS)
    key = np.broadcast_to(mix(np.arange(split.shape[1], dtype=np.uint64) + np.uint64(77)), split.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + split[:, :, k])
    return key.view(np.int64)


def text_keys(row: np.ndarray, element: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and band key of every text with a word, sorted by row: the weighted
    keys, and those of unit weights that differ from them."""
    have = np.flatnonzero(np.bincount(row, minlength=rows))
    weighted = band_keys(prob_min_hash(row, element, 1 + np.log(count), rows)[have])
    place = np.full(rows, -1)
    again = np.unique(row[count > 1])
    place[again] = np.arange(len(again))
    own = place[row] >= 0
    unit = band_keys(prob_min_hash(place[row[own]], element[own], np.ones(int(own.sum())), len(again)))
    fresh = unit != weighted[np.searchsorted(have, again)]
    of = np.concatenate([np.repeat(have, BANDS), np.repeat(again, fresh.sum(axis=1))])
    order = np.argsort(of, kind="stable")
    return of[order], np.concatenate([weighted.ravel(), unit[fresh]])[order]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, offsets in parts(b.column(1)):
            row, element, count = weighted_shingles(raw, offsets)
            of, keys = text_keys(row, element, count, hi - lo)
            have, first = np.unique(of, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + have)), lists], ["tid", "keys"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of both shingle sets and of their intersection for each pair."""
    for b in batches:
        u, v, own, other = (b.column(k) for k in range(4))
        found, memory = [], {}
        for k in range(b.num_rows):
            sets = []
            for ids, texts in ((u, own), (v, other)):
                tid = ids[k].as_py()
                if tid not in memory:
                    if len(memory) > 64:
                        memory.clear()
                    raw = np.frombuffer(texts[k].as_py().encode(), np.uint8)
                    memory[tid] = weighted_shingles(raw, np.array([0, len(raw)]))[1]
                sets.append(memory[tid])
            a, c = sets
            # Both sets are sorted: common elements are neighbours after a merge.
            both = np.sort(np.concatenate([a, c]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            found.append((len(a), len(c), common))
        n_u, n_v, common = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([u, v, *(pa.array(x, pa.int64()) for x in (n_u, n_v, common))],
                                         ["u", "v", "n_u", "n_v", "common"])


def verified_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) with the sizes of their shingle sets and of the common
    part, from the whole texts, and whether they are linked.

    The texts lie in buckets of tid, so only the paired ones move.  v is the
    side with fewer values: its texts are picked first, and the join on it,
    where one v may have very many u, can be split by adaptive skew handling.
    """
    left = texts.join(pairs.withColumnRenamed("u", "tid").hint("shuffle_hash"), "tid") \
        .select(F.col("tid").alias("u"), "v", F.col("text").alias("text_u"))
    right = texts.join(pairs.select(F.col("v").alias("tid")).distinct().hint("shuffle_hash"), "tid") \
        .select(F.col("tid").alias("v"), F.col("text").alias("text_v"))
    counted = left.join(right, "v").select("u", "v", "text_u", "text_v").mapInArrow(
        _common, "u long, v long, n_u long, n_v long, common long")
    reached = F.col("common") + 1e-9 >= THRESHOLD * (F.col("n_u") + F.col("n_v") - F.col("common"))
    return counted.withColumn("linked", reached)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, _, raw, offsets in parts(b.column(1)):
            row, h, _ = weighted_shingles(raw, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), pa.array(h.view(np.int64))], ["u", "h"])


def shared_sizes(members: DataFrame, texts: DataFrame) -> DataFrame:
    """u, n (distinct shingles) and s (those that another text of ``members``
    holds too).  Counts are combined before the shuffles."""
    picked = texts.join(members.select(F.col("u").alias("tid")).distinct().hint("shuffle_hash"), "tid")
    rows = written(picked.select("tid", "text").mapInArrow(_shingle_rows, "u long, h long"), "shingles")
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    sizes = written(rows.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
                    .join(rows.join(common.hint("shuffle_hash"), "h").groupBy("u").agg(F.count(F.lit(1)).alias("s")), "u"), "sizes")
    discard(rows)
    return sizes


def open_pairs(placed: DataFrame, stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of bucket mates (key, u, class c) of different classes that can
    be similar, given each member's intersection with its bucket's head v.

    A link needs |A and B| >= t / (1 + t) * (|A| + |B|).  What A and B have in
    common lies inside the head (at most the smaller part that either shares
    with it) or outside (at most what either shares outside the head with any
    text of an open bucket at all).
    """
    name = F.xxhash64("u")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"),
                                      F.bit_xor(name).alias("one"), F.bit_xor(F.xxhash64(name, "u")).alias("two"))
    apart = mixed.where("lo <> hi").groupBy("size", "one", "two").agg(F.min("key").alias("key")).select("key")
    members = written(placed.join(apart.hint("shuffle_hash"), "key"), "open")
    inside = stars.select("u", "v", F.col("common").alias("i"))
    sized = members.where("u <> v").join(inside, ["u", "v"]).join(shared_sizes(members, texts), "u") \
        .withColumn("o", F.greatest(F.col("s") - F.col("i"), F.lit(0)))
    share = THRESHOLD / (1 + THRESHOLD)
    # Members that fit with no size in their bucket go before the pairing.
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    sized = written(sized.join(least, "key").where(F.col("s") + 1e-6 >= share * (F.col("n") + F.col("least"))), "fitting")
    keys = sized.groupBy("u").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    sized = written(sized.join(keys, "u"), "fitting")
    a, b = sized.alias("a"), sized.alias("b")
    bound = F.least("a.i", "b.i") + F.least("a.o", "b.o")
    fits = bound + 1e-6 >= share * (F.col("a.n") + F.col("b.n"))
    # A text has 64 keys at most.
    first = F.array_intersect("a.keys", "b.keys")[0] == F.col("a.key")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & fits & first)
    return pairs.select(F.col("a.u").alias("u"), F.col("b.u").alias("v"))


def near_duplicate_classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """tid (text key) and component of every text that has a near copy."""
    with scratch_tables() as keep:
        texts = distinct_texts(docs, text_col).select("tid", "text")
        keyed = written(texts.mapInArrow(_signatures, "tid long, keys array<long>"), "signatures")
        members = keyed.select("tid", F.explode("keys").alias("key"))
        buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = written(members.join(buckets.hint("shuffle_hash"), "key").select("key", F.col("tid").alias("u"), "size"), "buckets")
        discard(keyed)
        popular = shared.groupBy("u").agg(F.sum("size").alias("mates"))
        ranked = written(shared.select("key", "u").join(popular, "u"), "popular")
        heads = ranked.groupBy("key").agg(F.max_by("u", F.struct("mates", "u")).alias("v"))
        headed = written(ranked.select("key", "u").join(heads, "key"), "headed")
        discard(shared, ranked)
        stars = written(verified_pairs(headed.where("u <> v").select("u", "v").distinct(), texts), "stars")
        links = stars.where("linked").select("u", "v")
        if links.isEmpty():
            component = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        else:
            component = connected_components(links)
        placed = headed.join(component.withColumnRenamed("node", "u"), "u", "left") \
            .select("key", "u", "v", F.coalesce("component", "u").alias("c"))
        rest = open_pairs(written(placed, "placed"), stars, texts)
        more = written(verified_pairs(rest, texts), "verified").where("linked").select("u", "v")
        if not more.isEmpty():
            component = connected_components(links.union(more))
        return keep(written(component.withColumnRenamed("node", "tid"), "classes"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tid (text key), class_id and class_size of every row; the row
    whose doc_id is the class_id stands for its class."""
    classes = near_duplicate_classes(docs, text_col)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tid"),
                       F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    # Texts without a word have no class key and so match no class.
    named = rows.join(classes, "tid", "left").withColumn("c", F.when(F.col("words"), F.coalesce("component", "tid")))
    # Written before the join, whose other side then has a hot class in an
    # exchange of its own that adaptive execution can split.
    heads = written(named.where("c is not null").groupBy(F.col("c").alias("head")).agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "heads")
    return named.join(heads, F.col("c") == F.col("head"), "left").select(
        "doc_id", "tid", F.when(F.col("words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("words"), F.col("class_size")).otherwise(F.lit(1)).alias("class_size"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, one a class."""
    kept = near_duplicates(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("class_id"))) \
        .select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(F.col(text_col).cast("string")))
    same = (F.col("__key") == F.col("__tid")) & F.col(id_col).eqNullSafe(F.col("__id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__key", id_col]).drop("__key")
