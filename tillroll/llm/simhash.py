"""Near duplicates by SimHash, linked by a self-join of binary tries.

A text's fingerprint has a bit set if more than half of its three-word
shingles (repeats included; fewer words: the whole sequence) have it set in
their 64-bit xxHash, seed 42.  Fingerprints that differ in at most ``BUDGET``
bits are linked; a document's component is the least id it can reach.

Distinct fingerprints are the leaves of one binary trie.  Its top is cut into
subtries of at most ``SUBTRIE`` leaves, found from counts by prefix, twelve
bits a pass and only where a prefix holds too many.  Every pair of subtries
whose prefixes differ in few enough bits meets in one task, which walks both
from the root: a pair of nodes passes on its children, crossed children cost
one bit, and a pair over the budget is dropped with all that is below.  A pair
of single leaves is finished by its remaining bits.  A task hands back a
spanning forest of the links it met, at most one link a leaf, so a cluster of
near copies is never expanded into pairs, and connected components over the
forests of all tasks lose no link.

Copies share a fingerprint and are one leaf (counted before the shuffle).

Defined results: null texts and texts without a word have fingerprint zero
and are linked like any other; repeated rows share their component; a null id
counts last, so a component of null ids only is named null; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import discard, text_bytes, written
from tillroll.llm.components import connected_components

WORDS = 3
SEED = 42
BITS = 64
#: Bits in which linked fingerprints may differ.
BUDGET = 2
#: Leaves of a subtrie, and prefix bits of one counting pass.
SUBTRIE = 1 << 14
PASS_BITS = 12
#: Node pairs that a walk expands at a time, and shingles summed at a time.
PAIRS = 1 << 17
SHINGLES = 1 << 15


def fingerprint(text: bytes) -> int:
    """The fingerprint of a whole text, an unsigned 64-bit number."""
    words = text.lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    total = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), SHINGLES):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + SHINGLES], ends[k:k + SHINGLES])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = text_bytes(b.column(1))
        codes = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and code (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, code long")


def walk(left: np.ndarray, right: np.ndarray | None, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in ``left``, places in ``right``) of sorted distinct codes
    that differ in at most ``budget`` bits, met by walking both tries from the
    root together; ``right`` None joins ``left`` with itself, each pair once."""
    own = right is None
    keys = (left, left if own else right)
    if not len(keys[0]) or not len(keys[1]):
        return
    one = np.array([0], np.int64)
    # Node pairs: ranges of leaves on both sides and the bits that differ so far.
    stack = [(0, one, one + len(keys[0]), one, one + len(keys[1]), one)]
    while stack:
        depth, a, b, c, d, cost = stack.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            stack += [(depth, *(x[:half] for x in (a, b, c, d, cost))), (depth, *(x[half:] for x in (a, b, c, d, cost)))]
            continue
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():
            u, v = a[leaf], c[leaf]
            near = np.bitwise_count(keys[0][u] ^ keys[1][v]) <= budget
            if own:
                near &= u < v
            if near.any():
                yield u[near], v[near]
            a, b, c, d, cost = (x[~leaf] for x in (a, b, c, d, cost))
        if not len(a):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        top = ~np.uint64((int(bit) << 1) - 1)
        mid = [np.clip(np.searchsorted(k, (k[lo] & top) | bit), lo, hi) for k, lo, hi in zip(keys, (a, c), (b, d))]
        twin = own & (a == c) if own else np.zeros(len(a), bool)
        crossed = cost < budget
        parts = [(a, mid[0], c, mid[1], cost, np.ones(len(a), bool)), (mid[0], b, mid[1], d, cost, np.ones(len(a), bool)),
                 (a, mid[0], mid[1], d, cost + 1, crossed), (mid[0], b, c, mid[1], cost + 1, crossed & ~twin)]
        parts = [tuple(x[keep & (p < q) & (r < s)] for x in (p, q, r, s, t)) for p, q, r, s, t, keep in parts]
        children = tuple(np.concatenate(x) for x in zip(*parts))
        if len(children[0]):
            stack.append((depth + 1, *children))


def forest(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (u, v) of a spanning forest of the links between sorted codes."""
    both = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    root = np.arange(len(both))
    out = [np.empty((2, 0), np.int64)]
    for u, v in walk(left, right):
        v = v + shift
        while True:
            # Flatten, then let every class of the batch hook one link that leaves it.
            while (root[root] != root).any():
                root = root[root]
            ru, rv = root[u], root[v]
            apart = ru != rv
            if not apart.any():
                break
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            high, at = np.unique(np.maximum(ru, rv), return_index=True)
            root[high] = np.minimum(ru, rv)[at]
            out.append(np.stack([u[at], v[at]]))
    u, v = np.concatenate(out, axis=1)
    return both[u], both[v]


def cut(codes: DataFrame, limit: int = SUBTRIE) -> np.ndarray:
    """First codes of the subtries of at most ``limit`` leaves, in order.  The
    driver holds counts of prefixes, 4,096 for every prefix that is too full."""
    starts, full, depth = [], np.array([0], np.uint64), 0
    spark = codes.sparkSession
    while len(full):
        step = min(PASS_BITS, BITS - depth)
        depth += step
        prefix = F.shiftrightunsigned("code", BITS - depth) if depth < BITS else F.col("code")
        rows = codes.select(prefix.alias("p"))
        if depth > step:
            parents = spark.createDataFrame([(int(p.view(np.int64)),) for p in full], "q long")
            rows = rows.withColumn("q", F.shiftrightunsigned("p", step)).join(parents, "q", "left_semi")
        got = np.array([tuple(r) for r in rows.groupBy("p").count().collect()], np.int64).reshape(-1, 2)
        place, count = got[:, 0].view(np.uint64) if len(got) else got[:, 0].astype(np.uint64), got[:, 1]
        order = np.argsort(place)
        place, total = place[order], np.concatenate([[0], np.cumsum(count[order])])
        nodes, full_next = [(int(p), depth - step) for p in full], []
        while nodes:
            p, d = nodes.pop()
            lo, hi = (int(np.searchsorted(place, np.uint64(x))) if x < 1 << depth else len(place)
                      for x in (p << (depth - d), (p + 1) << (depth - d)))
            leaves = int(total[hi] - total[lo])
            if leaves > limit and d < depth:
                nodes += [(2 * p, d + 1), (2 * p + 1, d + 1)]
            elif leaves > limit and depth < BITS:
                full_next.append(p)
            elif leaves:
                starts.append((p << (BITS - d), d))
        full = np.array(full_next, np.uint64)
    return np.array(sorted(starts), dtype=[("first", np.uint64), ("depth", np.int64)])


def links(codes: DataFrame, limit: int = SUBTRIE) -> DataFrame:
    """u, v: links between the distinct codes, enough to connect all that are
    connected by differences of at most ``BUDGET`` bits."""
    nodes = cut(codes, limit)
    first = nodes["first"]
    mask = np.array([((1 << d) - 1) << (BITS - d) for d in nodes["depth"].tolist()], np.uint64)
    n = len(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners: dict[int, np.ndarray] = {}
        for b in batches:
            code = np.sort(b.column(0).to_numpy().view(np.uint64))
            node = np.searchsorted(first, code, side="right") - 1
            have, at = np.unique(node, return_index=True)
            ends = np.append(at, len(code))
            for k, own in enumerate(have.tolist()):
                if own not in partners:
                    partners[own] = np.flatnonzero(np.bitwise_count((first ^ first[own]) & mask & mask[own]) <= BUDGET)
                other = partners[own]
                low, high = np.minimum(other, own), np.maximum(other, own)
                data = code[ends[k]:ends[k + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), pa.array(high), pa.array(low != own), pa.array([data] * len(other), pa.binary())],
                    ["low", "high", "second", "data"])

    def meet(t: pa.Table) -> pa.Table:
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        sides: list[list] = [[], []]
        for second, data in zip(t.column("second").to_pylist(), t.column("data")):
            sides[second].append(np.frombuffer(data.as_py(), np.uint64))
        left, right = (np.sort(np.concatenate(s)) if s else np.empty(0, np.uint64) for s in sides)
        u, v = forest(left, None if low == high else right)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    if not n:
        return codes.select(F.col("code").alias("u"), F.col("code").alias("v")).limit(0)
    dealt = codes.mapInArrow(deal, "low long, high long, second boolean, data binary")
    return dealt.groupBy("low", "high").applyInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SUBTRIE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every
    row."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    leaves = written(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "leaves")
    linked = written(links(leaves.select("code"), limit), "links")
    if linked.isEmpty():
        named = leaves.withColumnRenamed("least", "component_id")
        spare = []
    else:
        component = written(connected_components(linked).withColumnRenamed("node", "code"), "components")
        member = leaves.join(component, "code")
        least = written(member.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        joined = written(component.join(least, "component").select("code", "component_id"), "named")
        named = leaves.join(joined, "code", "left").select("code", F.when(F.col("component_id").isNull(), F.col("least"))
                                                           .otherwise(F.col("component_id")).alias("component_id"))
        spare = [component, least, joined]
    named = written(named, "classes")
    out = written(rows.join(named, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"), "simhash")
    discard(rows, leaves, linked, named, *spare)
    return out
