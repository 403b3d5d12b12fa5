"""Edit-aware token counts by segment trees over pre-tokens.

A document's tree has a leaf for every pre-token (its characters and its
tokens) and sums above.  An edit finds the leaves it touches by descending on
characters, goes back over the pre-tokens whose match could have looked into
the edited span, re-splits and re-encodes from there until a new border meets
an old one behind the edit, and puts the new leaves under the first touched
one: only those leaves and the sums on their paths change.

Defined results: a null text is empty and has 0 tokens; edits are taken in
order of their start and must not overlap or leave the text (ValueError);
a document without edits keeps its count; repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import slices, text_bytes
from tillroll.llm.pretokens import CACHE_CHUNKS, PATTERN, chunks, pre_tokens, read_ranks

VOCABULARY = "byte_bpe_50k.tiktoken"

Edit = tuple[int, int, str]

#: A match looks at most so many characters past its end: a contraction's two
#: letters after the apostrophe that ended it.
LOOK_AHEAD = 2


class Counter:
    """Tokens of pre-tokens, cached by chunk."""

    def __init__(self, path: str):
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=read_ranks(path), special_tokens={})
        self.cache: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def tokens(self, match: str) -> int:
        return len(self.encoding.encode_ordinary(match))

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of the pre-tokens, in order."""
        chars: list[int] = []
        tokens: list[int] = []
        for c in chunks(text):
            own = self.cache.get(c)
            if own is None:
                if len(self.cache) >= CACHE_CHUNKS:
                    self.cache.clear()
                parts = pre_tokens(c)
                own = self.cache[c] = tuple(map(len, parts)), tuple(map(self.tokens, parts))
            chars += own[0]
            tokens += own[1]
        return chars, tokens


class TokenTree:
    """Sums of characters and tokens over the pre-tokens of one text."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        chars, tokens = counter.leaves(text)
        self.leaves = len(chars)
        #: Levels from the leaves up; a level's odd end is padded by 0.  The
        #: inner levels are summed when the first edit needs them.
        self.chars, self.tokens = [chars or [0]], [tokens or [0]]
        self.reencoded = 0

    def _grow(self) -> None:
        for levels in (self.chars, self.tokens):
            while len(levels[-1]) > 1:
                below = levels[-1]
                if len(below) % 2:
                    below.append(0)
                levels.append([a + b for a, b in zip(below[::2], below[1::2])])

    @property
    def total(self) -> int:
        return sum(self.tokens[-1])

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character of the current text, and its start."""
        node, start = 0, 0
        for level in reversed(self.chars[:-1]):
            node *= 2
            if position >= start + level[node]:
                start += level[node]
                node += 1
        return node, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        for levels, value in ((self.chars, chars), (self.tokens, tokens)):
            delta, node = value - levels[0][leaf], leaf
            for level in levels:
                level[node] += delta
                node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters ``start`` to ``end`` of the current text."""
        old, size = self.text, len(self.text)
        if not 0 <= start <= end <= size:
            raise ValueError(f"edit {start}..{end} outside a text of {size}")
        self._grow()
        self.text = text = old[:start] + replacement + old[end:]
        shift = len(replacement) - (end - start)
        if not self.leaves:
            chars, tokens = self.counter.leaves(text)
            self.reencoded += len(chars)
            self.leaves = 1
            self.chars, self.tokens = [[len(text)]], [[sum(tokens)]]
            return
        # A pre-token that ends LOOK_AHEAD or more before the edit stays.
        leaf, at = self._find(max(0, min(start - LOOK_AHEAD, size - 1))) if size else (0, 0)
        last, behind = leaf, at + self.chars[0][leaf]
        position, new_tokens, n_new = at, 0, 0
        while position < len(text):
            match = PATTERN.match(text, position)
            position = match.end()
            new_tokens += self.counter.tokens(match[0])
            n_new += 1
            # Swallow old leaves until the border behind reaches the new one.
            while behind + shift < position or behind < end:
                if last + 1 >= self.leaves:
                    break
                last += 1
                behind += self.chars[0][last]
            if position == behind + shift and behind >= end:
                break
        else:
            last, behind = self.leaves - 1, size
        self.reencoded += n_new
        for k in range(leaf + 1, last + 1):
            self._set(k, 0, 0)
        self._set(leaf, behind + shift - at, new_tokens)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def apply_edits(tree: TokenTree, edits: list[Edit]) -> None:
    """Edits in positions of the original text, applied from the end."""
    ordered = sorted(edits, key=lambda e: (e[0], e[1]))
    for a, b in zip(ordered, ordered[1:]):
        if b[0] < a[1]:
            raise ValueError("edits overlap")
    for start, end, replacement in reversed(ordered):
        tree.edit(start, end, replacement)


# What the redaction replaces, and by what.
REDACTIONS = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "<EMAIL>"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<IP>"),
    (re.compile(r"\+?\d[\d ()-]{7,}\d"), "<PHONE>"),
    (re.compile(r"^Licensed under [^\n]*\n?", re.M), ""),
]


def redaction_edits(text: str) -> list[Edit]:
    """Edits that mask addresses and numbers and drop licence lines; where
    matches overlap, the one that starts first (then the earlier rule) holds."""
    found = sorted((m.start(), k, m.end(), tag) for k, (rule, tag) in enumerate(REDACTIONS) for m in rule.finditer(text))
    edits: list[Edit] = []
    for start, _, end, tag in found:
        if not edits or start >= edits[-1][1]:
            edits.append((start, end, tag))
    return edits


def count_with_edits(docs: DataFrame, find_edits: Callable[[str], list[Edit]] = redaction_edits,
                     id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts before and after each document's edits.

    Returns doc_id, n_pretokens, n_tokens_before, n_edits, n_tokens_after and
    n_reencoded (pre-tokens that were split and encoded again).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(public_tokenizers.path(vocabulary))
        for b in batches:
            found = []
            for lo, hi in slices(text_bytes(b.column(1))):
                for text in b.column(1).slice(lo, hi - lo).to_pylist():
                    tree = TokenTree(text or "", own)
                    n, before = tree.leaves, tree.total
                    edits = find_edits(text or "")
                    apply_edits(tree, edits)
                    found.append((n, before, len(edits), tree.total, tree.reencoded))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in zip(*found))] if found
                else [b.column(0), *[pa.array([], pa.int64())] * 5],
                ["doc_id", "n_pretokens", "n_tokens_before", "n_edits", "n_tokens_after", "n_reencoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens_before long, n_edits long, "
                                "n_tokens_after long, n_reencoded long")
