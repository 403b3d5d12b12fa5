"""Word hashes and five-word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
STEP = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(31415)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(raw: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about STEP bytes that end at a blank or a row's end."""
    lo, size = 0, int(offsets[-1])
    while lo < size:
        hi = min(size, lo + STEP)
        if hi < size:
            row_end = int(offsets[np.searchsorted(offsets, hi, side="left")])
            gaps = np.flatnonzero(_BLANK[raw[hi:row_end]])
            hi = hi + int(gaps[0]) if len(gaps) else row_end
        yield lo, hi
        lo = hi


def word_steps(raw: np.ndarray, offsets: np.ndarray):
    """Per step: row of each byte, the bytes, which of them are no white space,
    where each word starts, and the words' hashes (words are runs of bytes
    other than ASCII white space; none is cut by a step)."""
    for lo, hi in _steps(raw, offsets):
        first = int(np.searchsorted(offsets, lo, side="right")) - 1
        last = int(np.searchsorted(offsets, hi, side="left"))
        row = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first:last + 1], lo, hi)))
        b = raw[lo:hi]
        ink = ~_BLANK[b]
        begin = ink.copy()
        begin[1:] &= ~ink[:-1] | (row[1:] != row[:-1])
        start = np.flatnonzero(begin)
        if not len(start):
            continue
        word = np.cumsum(begin) - 1
        place = np.where(ink, np.arange(len(b)) - start[np.maximum(word, 0)], 0)
        power = np.full(int(place.max()) + 1, _BASE, np.uint64)
        power[0] = 1
        code = _BYTE[b] * np.multiply.accumulate(power)[place]
        code[~ink] = 0
        yield row, b, ink, start, mix(np.add.reduceat(code, start))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word (run of bytes other than ASCII white space)."""
    rows, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for row, _, _, start, hashed in word_steps(raw, offsets):
        hashes.append(hashed)
        rows.append(row[start])
    return np.concatenate(rows), np.concatenate(hashes)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every five-word shingle, repeats included; a text of
    one to four words is a single shingle."""
    row, word = word_hashes(raw, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if n else np.empty(0, np.int64)
    rows, out = [], []
    if len(word) >= WORDS:
        whole = np.flatnonzero(row[:len(row) - WORDS + 1] == row[WORDS - 1:])
        h = word[whole]
        for k in range(1, WORDS):
            h = mix(h * _JOIN + word[whole + k])
        rows.append(row[whole])
        out.append(h)
    for r in np.flatnonzero((count > 0) & (count < WORDS)):
        own = word[first[r]:first[r] + count[r]]
        h = own[:1]
        for k in range(1, count[r]):
            h = mix(h * _JOIN + own[k])
        rows.append(np.array([r]))
        out.append(h)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(row, kind="stable")
    return row[order], h[order]
