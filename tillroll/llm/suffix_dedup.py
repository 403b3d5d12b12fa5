"""Removal of repeated passages by distributed prefix doubling.

Suffixes are ranked at *anchors* only: the least hashed 16-byte gram of every
128 starts (a minimiser), so equal passages have equal anchors.  The first
rank of an anchor is the text up to the next anchor; each round Spark brings
together the ranks of an anchor and of the one 1, 2, 4, ... places on,
reranks the pair, and drops what is unique.  An anchor leaves the rounds when
its ranks span the bytes that any two equal 400-byte strings share between
their first and last common anchors (with a last offset that ends exactly
there).  What survives is a small superset of the starts of repeated strings.

The exact check follows: for the 128 strings that start up to 127 bytes
before an anchor, the bytes that all of them share (core) and the bytes that
they cover together (context) are digested.  A unique core rules all of them
out; a core with one context, found twice or more, removes all of them; the
rest is cut into blocks of 16, of 4 and of single strings, whose 128-bit
digests decide.  A digest is two hashes of independent random byte values,
taken from sums over the text's prefixes, so a text is read once for all its
candidates.  No pairs are formed, groups of any size are counted
by partial sums, and only the joins on a digest see hot keys (adaptive skew
handling splits them).

The figures above are those of 400-byte strings (:data:`BYTES_400`); another
:class:`Scale` looks for strings of another length in the same way.

Exact copies of a text are one row from the start: every byte of a copied
text of 400 bytes or more is removed.  Defined results: a null text is empty;
texts under 400 bytes keep all bytes; strings never cross documents; repeated
rows count as copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillroll.llm.common import discard, distinct_texts, scratch_tables, written
from tillroll.llm.shingles import mix
from tillroll.llm.text_features import parts

GRAM = 16


@dataclass(frozen=True)
class Scale:
    """Strings of ``length`` bytes, found by the least gram of every ``spread``
    starts (a power of two, at most 128); removed runs must hold ``words``
    words at least."""
    length: int
    spread: int
    words: int = 0

    @property
    def span(self) -> int:
        """Bytes from the first to the last common anchor of two equal strings."""
        return self.length - GRAM - 2 * self.spread + 2

    @property
    def widths(self) -> tuple[int, ...]:
        """String starts of one candidate, from the first check to the last."""
        return (self.spread, 16, 4, 1)


BYTES_400 = Scale(400, 128)
#: Passages of over 50 words of two letters or more each.
WORDS_50 = Scale(150, 64, 51)
STEP = 1 << 20
_BYTE = np.random.default_rng(2718).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 32) - 1)
#: Byte values and bases of the two hashes of a digest.
_VALUES = [np.random.default_rng(k).integers(1, 1 << 63, 256, dtype=np.uint64) for k in (1618, 1414)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def _gram_codes(b: np.ndarray) -> np.ndarray:
    """Hash of the 16-byte gram at every place, by doubling."""
    h, size = _BYTE[b], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        size *= 2
    return mix(h)


def anchors(raw: np.ndarray, offsets: np.ndarray, spread: int = BYTES_400.spread) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places of the joined texts, and the first and last window start
    that each is the least gram of."""
    place, first, last = [], [], []
    size, reach = int(offsets[-1]), spread + GRAM - 1
    for lo in range(0, size, STEP):
        hi = min(size, lo + STEP + reach - 1)
        if hi - lo < reach:
            break
        code = (_gram_codes(raw[lo:hi]) & ~_LOW) | np.arange(hi - lo - GRAM + 1, dtype=np.uint64)
        width = 1
        while width < spread:
            code = np.minimum(code[:-width], code[width:])
            width *= 2
        least = (code & _LOW).astype(np.int64) + lo
        x = np.arange(lo, lo + len(least))
        row = np.searchsorted(offsets, x, side="right") - 1
        x_in = x + reach <= offsets[row + 1]
        least, x = least[x_in], x[x_in]
        if not len(x):
            continue
        fresh = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        place.append(least[fresh])
        first.append(x[fresh])
        last.append(x[np.append(fresh[1:], len(x)) - 1])
    if not place:
        return (np.empty(0, np.int64),) * 3
    p, f, t = map(np.concatenate, (place, first, last))
    # A step may go on with the last anchor of the step before.
    new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    return p[new], f[new], t[np.append(new[1:], len(p)) - 1]


def _anchor_rows(scale: Scale):
    """tid, i (number of the anchor in its text), loc (place and the range of
    its string starts), m (anchors on until the span is covered; 0: the text
    ends before) and rank of every anchor but a text's last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, raw, offsets in parts(b.column(1)):
                place, first, last = anchors(raw, offsets, scale.spread)
                if not len(place):
                    continue
                row = np.searchsorted(offsets, place, side="right") - 1
                begin = np.searchsorted(row, row, side="left")
                end = np.searchsorted(row, row, side="right")
                number = np.arange(len(place))
                reach = np.searchsorted(place, place + scale.span, side="left")
                m = np.where(reach < end, reach - number, 0)
                inner = np.flatnonzero(number + 1 < end)
                if not len(inner):
                    continue
                view = memoryview(np.ascontiguousarray(raw))
                stop = place[inner + 1] + GRAM
                rank = [xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(place[inner].tolist(), stop.tolist())]
                own = place - offsets[row]
                loc = own << 16 | (place - first) << 8 | (place - last)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(lo + row[inner])), pa.array((number - begin)[inner], pa.int32()),
                     pa.array(loc[inner], pa.int64()), pa.array(m[inner], pa.int32()),
                     pa.array(np.array(rank, np.uint64).view(np.int64))], ["tid", "i", "loc", "m", "rank"])
    return run


def _repeated(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key occurs more than once, written.

    The keys are written before the join, so that it has an exchange on either
    side and adaptive execution can split a hot key's rows."""
    again = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key), "again")
    out = written(rows.join(again.hint("shuffle_hash"), key), name)
    discard(again)
    return out


def prefix_doubling(rows: DataFrame) -> DataFrame:
    """tid and loc of the anchors whose next ``span`` bytes and more (up to the
    anchor that ends them) occur more than once.  ``rows`` is a written table
    and is discarded."""
    alive, size, found = _repeated(rows, "rank", "ranks"), 1, []
    discard(rows)
    while True:
        # Ranks from here to ``size`` places on, for those still alive.
        near = Window.partitionBy("tid").orderBy("i").rangeBetween(0, size)
        ahead = alive.withColumn("near", F.collect_list(F.struct("i", "rank")).over(near))

        def rank_at(place: Column) -> Column:
            return F.get(F.filter("near", lambda x: x["i"] == place), F.lit(0))["rank"]

        done = (F.col("m") >= size) & (F.col("m") < 2 * size)
        paired = written(ahead.select(
            "tid", "i", "loc", "m", rank_at(F.col("i") + size).alias("next"), "rank",
            F.when(done, rank_at(F.col("i") + F.col("m") - size)).alias("closing")), "pairs")
        discard(alive)
        found.append(written(paired.where(done & F.col("closing").isNotNull()).select(
            "tid", "loc", F.xxhash64("rank", "closing", "m").alias("rank")), "closed"))
        if paired.where(F.col("m") >= 2 * size).isEmpty():
            break
        doubled = paired.where("next is not null").select(
            "tid", "i", "loc", "m", F.xxhash64("rank", "next").alias("rank"))
        alive, size = _repeated(doubled, "rank", "ranks"), 2 * size
        discard(paired)
    out = _repeated(reduce(DataFrame.union, found), "rank", "candidates").select("tid", "loc")
    discard(paired, *found)
    return out


@lru_cache(maxsize=None)
def _powers(base: int) -> np.ndarray:
    """Powers of ``base`` for a step and a string that starts in it."""
    power = np.full(STEP + 4096, np.uint64(base), np.uint64)
    power[0] = 1
    return np.multiply.accumulate(power, out=power)


def span_digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each span (under 4,096 bytes) and of a number that
    goes with it: differences of prefix sums, a step of the bytes at a time."""
    out = [np.empty(len(begin), np.int64) for _ in _BASES]
    salt = salt.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for lo in range(0, len(raw), STEP):
        own = np.flatnonzero((begin >= lo) & (begin < lo + STEP))
        if not len(own):
            continue
        b, e = begin[own] - lo, end[own] - lo
        part = raw[lo:lo + int(e.max())]
        for k, (values, base) in enumerate(zip(_VALUES, _BASES)):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * _powers(base)[:len(part)], out=sums[1:])
            code = (sums[e] - sums[b]) * _powers(pow(base, -1, 1 << 64))[b]
            out[k][own] = mix(code ^ mix(salt[own] + np.uint64(k))).view(np.int64)
    return out


def _digests(width: int, length: int):
    """For every candidate (packed place and first distance) of a text: the
    digests of its core and, unless it is a single string, of its context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in parts(b.column(1)):
                lists = b.column(2).slice(lo, hi - lo)
                c = lists.flatten().to_numpy()
                row = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy())
                near, least, far, at = c & 0xFF, c >> 8 & 0xFF, c >> 16 & 0xFF, c >> 24
                last, size = near + width - 1, np.diff(offsets)[row]
                # Some string of the block must lie in the text.
                some = np.flatnonzero(np.maximum(np.maximum(near, least), at + length - size)
                                      <= np.minimum(np.minimum(last, far), at))
                c, row, near, last, at, size = (x[some] for x in (c, row, near, last, at, size))
                base, first, end = offsets[row], at - near, at - last + length
                begin, stop, salt = base + first, base + end, end - first
                if width > 1:
                    left, right = at - last, at - near + length
                    begin = np.append(begin, base + np.maximum(0, left))
                    stop = np.append(stop, base + np.minimum(size, right))
                    salt = np.append(salt, np.maximum(0, -left) << 16 | np.maximum(0, right - size))
                keys = [half for k in np.split(np.stack(span_digests(raw, begin, stop, salt), 1), 1 + (width > 1)) for half in k.T]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(lo + row)), pa.array(c), *(pa.array(np.ascontiguousarray(k)) for k in keys)],
                    ["tid", "c", "k1", "k2", "c1", "c2"][:2 + len(keys)])
    return run


def _starts(width: int) -> list[Column]:
    """First and last string start of a packed candidate."""
    place = F.shiftright("c", 24) - F.col("c").bitwiseAND(0xFF)
    return [F.greatest(F.lit(0), place - (width - 1)).alias("s0"), place.alias("s1")]


def repeated_starts(candidates: DataFrame, texts: DataFrame, scale: Scale) -> DataFrame:
    """tid, s0, s1: runs of starts whose strings occur elsewhere (a run may
    reach past the text's last string)."""
    # A candidate is packed as place, far and least (the range of its strings'
    # distances) and near (the first distance of its block).
    todo = candidates.select("tid", F.shiftleft(F.col("loc"), 8).alias("c"))
    found = []
    for width, finer in zip(scale.widths, (*scale.widths[1:], 0)):
        lists = todo.groupBy("tid").agg(F.collect_list("c").alias("cs"))
        joined = texts.join(lists.hint("shuffle_hash"), "tid").select("tid", "text", "cs")
        rows = written(joined.mapInArrow(_digests(width, scale.length), "tid long, c long, k1 long, k2 long"
                                         + ", c1 long, c2 long" * (width > 1)), "digests")
        if not finer:
            again = written(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
            found.append(written(rows.join(again.hint("shuffle_hash"), ["k1", "k2"]).select("tid", *_starts(1)), "found"))
            discard(rows, again)
            break
        one = (F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))
        cores = written(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), one.alias("one")).where("n > 1").drop("n"),
                        "cores")
        judged = written(rows.join(cores.hint("shuffle_hash"), ["k1", "k2"]).select("tid", "c", "one"), "judged")
        discard(rows, cores)
        found.append(judged.where("one").select("tid", *_starts(width)))
        near, least, far = F.col("c").bitwiseAND(0xFF), F.shiftright("c", 8).bitwiseAND(0xFF), F.shiftright("c", 16).bitwiseAND(0xFF)
        todo = judged.where("not one").select(
            "tid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - finer), F.lit(finer)),
                                         lambda k: F.col("c") + k)).alias("c"))
        # Blocks that hold none of the candidate's strings are dropped here.
        todo = todo.where((near <= far) & (near + (finer - 1) >= least))
    return reduce(DataFrame.union, found)


def _kept(scale: Scale):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                raw = b.column(1)[k].as_py().encode()
                runs = b.column(2)[k].values
                s0, s1 = runs.field("s0").to_numpy(), np.minimum(runs.field("s1").to_numpy() + scale.length, len(raw))
                order = np.argsort(s0, kind="stable")
                s0, s1 = s0[order], np.maximum.accumulate(s1[order])
                new = np.append(True, s0[1:] > s1[:-1])
                begin, end = s0[new], s1[np.append(np.flatnonzero(new)[1:], len(s0)) - 1]
                enough = [len(raw[a:z].split()) >= scale.words for a, z in zip(begin.tolist(), end.tolist())]
                begin, end = begin[enough], end[enough]
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                rest = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                out.append((len(raw) - len(rest), len(begin), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))],
                ["tid", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def removed_passages(docs: DataFrame, text_col: str = "text", scale: Scale = BYTES_400) -> DataFrame:
    """tid, n_removed, n_spans, kept_sha256 (of the remaining bytes) and kept
    (the remaining text, without characters cut in two) of every distinct text
    that holds a repeated string."""
    with scratch_tables() as keep:
        texts = distinct_texts(docs, text_col)
        long = texts.where(F.octet_length("text") >= scale.length)
        rows = long.select("tid", "text").mapInArrow(_anchor_rows(scale), "tid long, i int, loc long, m int, rank long")
        starts = repeated_starts(prefix_doubling(written(rows, "anchors")), long, scale)
        runs = starts.groupBy("tid").agg(F.collect_list(F.struct("s0", "s1")).alias("runs"))
        single = long.where("not copied").join(runs.hint("shuffle_hash"), "tid").select("tid", "text", "runs").mapInArrow(
            _kept(scale), "tid long, n_removed long, n_spans long, kept_sha256 string, kept string")
        # Every byte of a text that has copies and is long enough is covered.
        copies = long.where("copied")
        if scale.words:
            copies = copies.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= scale.words)
        empty = F.lit("")
        copied = copies.select("tid", F.octet_length("text").cast("long").alias("n_removed"),
                               F.lit(1).cast("long").alias("n_spans"), F.sha2(empty, 256).alias("kept_sha256"), empty.alias("kept"))
        return keep(written(single.union(copied), "removed"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left,
    without characters cut in two) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("own"), F.xxhash64(text).alias("tid"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha256"))
    zero = F.lit(0).cast("long")
    return rows.join(removed_passages(docs, text_col), "tid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"), F.coalesce("kept", "own").alias("text"))


def strip_passages(docs: DataFrame, text_col: str = "text", scale: Scale = WORDS_50) -> DataFrame:
    """``docs`` with the passages taken out of the text; no row is dropped."""
    text = F.col(text_col).cast("string")
    removed = removed_passages(docs, text_col, scale).select(F.col("tid").alias("__tid"), F.col("kept").alias("__kept"))
    keyed = docs.withColumn("__key", F.xxhash64(text))
    joined = keyed.join(removed, F.col("__key") == F.col("__tid"), "left")
    return joined.select(*[F.coalesce("__kept", text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
