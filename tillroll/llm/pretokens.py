"""Pre-token splitting shared by the byte-level BPE operators.

A text is first cut into *chunks*: a run of non-space characters with the
one space before it, or a run of white space.  The public pattern never
matches across chunk borders and looks past a chunk's end only to see whether
white space follows, so matches inside a chunk depend on the chunk alone and
can be cached by it."""

from __future__ import annotations

import base64
import re

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
_CHUNK_TEXT = r" ?\S+|\s+(?!\S)|\s+"
_CHUNK = regex.compile(_CHUNK_TEXT)
_CHUNK_FAST = re.compile(_CHUNK_TEXT)
#: These are white space for the faster engine but not for the public pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks that a worker's cache holds before it starts anew.
CACHE_CHUNKS = 500_000


def chunks(text: str) -> list[str]:
    return (_CHUNK if _SEPARATORS.search(text) else _CHUNK_FAST).findall(text)


def pre_tokens(chunk: str) -> list[str]:
    """Matches of the public pattern inside a chunk (letters only: one match)."""
    return [chunk] if chunk[chunk[0] == " ":].isalpha() else PATTERN.findall(chunk)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
