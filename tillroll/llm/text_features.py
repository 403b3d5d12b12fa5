"""Vectorised term counts over the bytes of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tillroll.llm.common import joined_bytes, slices, text_bytes
from tillroll.llm.shingles import word_steps

#: Bytes and rows that one vectorised step takes.
STEP = 1 << 20
STEP_ROWS = 512

GRAM_TERMS = 2048

# Byte classes: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end,
# 5 stop or comma, 6 other sentence mark, 7 bar, 8 symbol, 9 other ASCII,
# 10 lead byte and 11 later byte of a longer character.
CLASSES = 12


def _class_table() -> np.ndarray:
    t = np.full(256, 9, np.uint16)
    t[ord("a"):ord("z") + 1], t[ord("A"):ord("Z") + 1], t[ord("0"):ord("9") + 1] = 0, 1, 2
    for chars, kind in ((" \t", 3), ("\n\r\x0b\x0c", 4), (".,", 5), ("!?;:'\"-()", 6), ("|", 7), ("#*$%&<>~^=+@_/\\{}[]`", 8)):
        t[[ord(c) for c in chars]] = kind
    t[0x80:0xC0], t[0xC0:] = 11, 10
    return t


CLASS_OF = _class_table()
SHAPE_TERMS = CLASSES ** 3
LOWER = np.arange(256, dtype=np.uint32)
LOWER[ord("A"):ord("Z") + 1] += 32


def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of bounded runs of rows."""
    a = text_bytes(column)
    for lo, hi in slices(a, STEP):
        for k in range(lo, hi, STEP_ROWS):
            end = min(k + STEP_ROWS, hi)
            yield (k, end, *joined_bytes(a, k, end))


def _windows(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, row of each byte) of steps over the joined bytes; ``overlap``
    more bytes than STEP are handed out so that grams across steps are whole."""
    size = int(offsets[-1])
    for lo in range(0, size, STEP):
        hi = min(size, lo + STEP + overlap)
        first = int(np.searchsorted(offsets, lo, side="right")) - 1
        last = int(np.searchsorted(offsets, hi, side="left"))
        lengths = np.diff(np.clip(offsets[first:last + 1], lo, hi))
        yield lo, hi, np.repeat(np.arange(first, first + len(lengths), dtype=np.int64), lengths)


def _add(counts: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> None:
    n, width = counts.shape
    counts += np.bincount(rows * width + terms, minlength=n * width).reshape(n, width)


def gram_counts(raw: np.ndarray, offsets: np.ndarray, terms: int = GRAM_TERMS) -> np.ndarray:
    """Hashed counts of three-byte grams, ASCII letters lowered."""
    counts = np.zeros((len(offsets) - 1, terms), np.float32)
    shift = np.uint32(32 - terms.bit_length() + 1)
    for lo, hi, row in _windows(offsets, 2):
        b = LOWER[raw[lo:hi]]
        if len(b) < 3:
            continue
        code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        inside = row[:-2] == row[2:]
        _add(counts, row[:-2][inside], (code[inside] >> shift).astype(np.int64))
    return counts


def shape_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of three consecutive byte classes."""
    counts = np.zeros((len(offsets) - 1, SHAPE_TERMS), np.float32)
    for lo, hi, row in _windows(offsets, 2):
        c = CLASS_OF[raw[lo:hi]].astype(np.int64)
        if len(c) < 3:
            continue
        inside = row[:-2] == row[2:]
        _add(counts, row[:-2][inside], ((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])[inside])
    return counts


def word_shares(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: log words, share of words equal to the one before, share of
    words seen earlier in the text, share of words in capitals, mean length.

    Words are whole runs of bytes other than ASCII white space, compared by
    hash.
    """
    n = len(offsets) - 1
    caps, chars = np.zeros(n), np.zeros(n)
    keys, key_rows = [], []
    for row, b, ink, start, key in word_steps(raw, offsets):
        r = row[start]
        upper = np.add.reduceat((CLASS_OF[b] == 1).astype(np.int64), start)
        caps += np.bincount(r, weights=upper >= 2, minlength=n)
        chars += np.bincount(row[ink], minlength=n)
        keys.append(key)
        key_rows.append(r)
    if not keys:
        return np.zeros((n, 5), np.float32)
    key, r = np.concatenate(keys), np.concatenate(key_rows)
    words = np.bincount(r, minlength=n)
    again = np.bincount(r[1:][(key[1:] == key[:-1]) & (r[1:] == r[:-1])], minlength=n)
    order = np.lexsort((key, r))
    key, r = key[order], r[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[fresh], minlength=n)
    some = np.maximum(words, 1)
    return np.stack([np.log1p(words) / 10, again / some, 1 - distinct / some, caps / some,
                     np.minimum(chars / some, 30) / 30], axis=1).astype(np.float32)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
