"""Packing: first-fit decreasing in randomised groups of documents.

Documents are tokenised, closed with an end id and cut into pieces of at most
``capacity`` ids.  Pieces are dealt at random into groups of bounded size;
each group is packed on its own by first-fit decreasing, where a tournament
tree over the bins' free room finds the first bin that fits in O(log bins).
Then the emptiest bins are cut up to fill gaps of more than ``min_gap`` ids
in the fuller ones, which leaves at most one partly filled bin a group; that
one is cut into sequences whose lengths are powers of two (stored unpadded).

Defined results: a null or empty text is the end id alone; repeated rows and
null ids are packed like any other row; an empty table gives an empty result.
Pieces are written to the shared scratch folder before they are dealt, so the
deal is the same when a task runs again.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import slices, text_bytes, written

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
#: Pieces a group holds on average: at most 16 MB of ids.
GROUP_PIECES = 4096
#: Gaps up to this many ids stay padded rather than filled with crumbs.
MIN_GAP = 16
#: Words that a worker's cache holds before it starts anew.
CACHE_WORDS = 800_000
#: The tokenizer always parts an ASCII letter from the mark behind it.
BEFORE_MARK = re.compile(rb"(?<=[a-z])(?=[!-/:-@\[-`{-~])")


def _byte_chars() -> list[str]:
    """The tokenizer's character for each byte: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    own = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if own[b] else chr(256 + sum(not o for o in own[:b])) for b in range(256)]


BYTE_CHARS = dict(enumerate(_byte_chars()))


class WordEncoder:
    """ids of a text as little-endian unsigned 16 or 32-bit values.

    The tokenizer ignores case, drops white space and never merges across it,
    so ASCII letters are lowered, and words between ASCII white space are
    encoded one by one and cached.  A word of lower-case Latin letters passes
    its normaliser and splitter unchanged and goes to the merges directly.  A
    text that holds one of the vocabulary's added tokens in any case is encoded
    whole, because the library looks for those before it splits."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for words, which hold no added token
        self.whole = Tokenizer.from_file(path)
        added = sorted({t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()} - {b""})
        self.added = re.compile(b"|".join(map(re.escape, added)) if added else rb"(?!)")
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        merge, others = self.tokenizer.model.tokenize, []
        for raw in words:
            word = raw.decode()
            if word.isalpha() and max(word) < "\u0250" and word == word.lower():
                if not word.isascii():
                    word = raw.decode("latin-1").translate(BYTE_CHARS)
                self.cache[raw] = array(self.code, [t.id for t in merge(word)]).tobytes()
            else:
                others.append(raw)
        for k in range(0, len(others), 4096):
            part = others[k:k + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for raw, e in zip(part, found):
                self.cache[raw] = array(self.code, e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        lowered = [t.lower() for t in texts]
        marked = {k for k, t in enumerate(lowered) if self.added.search(t)}
        split = [[] if k in marked else BEFORE_MARK.sub(b" ", t).split() for k, t in enumerate(lowered)]
        words = set().union(*split)
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        self._learn(new)
        return [array(self.code, self.whole.encode(texts[k].decode(), add_special_tokens=False).ids).tobytes() if k in marked
                else b"".join(map(self.cache.__getitem__, ws)) for k, ws in enumerate(split)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (bytes) of every piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(public_tokenizers.path(vocabulary))
        width = own.dtype.itemsize
        end = np.asarray([end_id], own.dtype).tobytes()
        for b in batches:
            column = text_bytes(b.column(1))
            for lo, hi in slices(column):
                row, start, length, total, ids = [], [], [], [], []
                for k, raw in enumerate(own.encode(column.slice(lo, hi - lo).to_pylist())):
                    raw += end
                    n = len(raw) // width
                    for s in range(0, n, capacity):
                        row.append(lo + k)
                        start.append(s)
                        length.append(min(capacity, n - s))
                        total.append(n)
                        ids.append(raw[s * width:(s + capacity) * width])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


class Tournament:
    """Leftmost bin with room: every node holds the larger room below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """First bin with ``length`` free; takes it."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        found = node - self.size
        room[node] -= length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; lengths must not exceed ``capacity``."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = [[i] for i in order if lengths[i] == capacity]
    rest = [i for i in order if lengths[i] < capacity]
    if rest:
        tree = Tournament(len(rest), capacity)
        open_bins: list[list[int]] = []
        for i in rest:
            k = tree.place(lengths[i])
            if k == len(open_bins):
                open_bins.append([])
            open_bins[k].append(i)
        bins += open_bins
    return bins


def close_gaps(bins: list[list[tuple[int, int, int]]], capacity: int, min_gap: int) -> list[list[tuple[int, int, int]]]:
    """Cut up the emptiest bins to fill the others' gaps.

    A bin is a list of cuts (item, first id, ids).  Afterwards every bin but
    one has at most ``min_gap`` free; that one is split by the binary digits
    of its length.
    """
    fill = lambda b: sum(c[2] for c in b)
    bins = sorted(bins, key=fill, reverse=True)
    out, last = [], len(bins) - 1
    for k, own in enumerate(bins):
        if k > last:
            break
        gap = capacity - fill(own)
        while gap > min_gap and k < last:
            item, first, n = bins[last].pop()
            take = min(n, gap)
            own.append((item, first, take))
            if take < n:
                bins[last].append((item, first + take, n - take))
            gap -= take
            if not bins[last]:
                last -= 1
        if gap <= min_gap:
            out.append(own)
            continue
        left = capacity - gap  # the last bin
        for bit in reversed(range(left.bit_length())):
            room, part = left & 1 << bit, []
            while room:
                item, first, n = own.pop(0)
                take = min(n, room)
                part.append((item, first, take))
                if take < n:
                    own.insert(0, (item, first + take, n - take))
                room -= take
            if part:
                out.append(part)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
         min_gap: int = MIN_GAP) -> DataFrame:
    """Deal written pieces into groups and pack each.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and the
    piece's ids as little-endian unsigned 32-bit values.
    """
    stored = written(pieces, "pieces")
    groups = max(1, math.ceil(stored.count() / group_pieces))
    dealt = stored.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_pylist()
        start, ids = t.column("start").to_pylist(), t.column("ids").to_pylist()
        packed = [[(i, 0, lengths[i]) for i in b] for b in first_fit_decreasing(lengths, capacity)]
        base = t.column("g")[0].as_py() << 32
        row, first, size, sequence, offset, raw = [], [], [], [], [], []
        for number, cuts in enumerate(close_gaps(packed, capacity, min_gap)):
            at = 0
            for i, lo, n in cuts:
                width = len(ids[i]) // lengths[i]
                row.append(i)
                first.append(start[i] + lo)
                size.append(n)
                sequence.append(base + number)
                offset.append(at)
                raw.append(np.frombuffer(ids[i], f"<u{width}", n, lo * width).astype("<u4").tobytes())
                at += n
        rows = pa.array(row, pa.int64())
        return pa.table({"doc_id": t.column("doc_id").take(rows), "start": pa.array(first, pa.int64()),
                         "length": pa.array(size, pa.int64()), "doc_tokens": t.column("doc_tokens").take(rows),
                         "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
                         "ids": pa.array(raw, pa.binary())})

    return dealt.groupBy("g").applyInArrow(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(token_pieces(docs, id_col, text_col, vocabulary, capacity, end_id), capacity)
