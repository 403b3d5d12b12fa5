"""Byte-level BPE by a SentencePiece model written from the vocabulary.

The rank file becomes a SentencePiece BPE model: every token is a piece whose
bytes are mapped to one character each, its score is the negative rank, and
the normaliser is the identity without dummy prefix, white-space escaping or
removal.  Merging the best-scored adjacent pair is then merging the lowest
rank.  Pre-tokens of the public pattern are encoded one by one (a pre-token
that is a token itself is that token, as in the rank-file library); decoding
maps pieces back to bytes.

Defined results: null text is empty; empty text has no ids; ids outside the
vocabulary raise on decoding; repeated rows and null ids pass through.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import slices, text_bytes
from tillroll.llm.pretokens import CACHE_CHUNKS, chunks, pre_tokens, read_ranks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Byte b is written as the character U+0100 + b: printable, never white space.
BYTE_BASE = 0x100
TO_CHARS = {b: BYTE_BASE + b for b in range(256)}


def map_bytes(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_CHARS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The SentencePiece model file for a rank vocabulary: piece id = rank + 1.

    Fixed values of the format: piece fields 1 text, 2 score, 3 kind (1
    normal, 2 unknown); trainer field 3 model type (2 BPE), 4 size, 40-43 ids
    of unknown, begin, end, padding; normaliser fields 1 name, 3 dummy prefix,
    4 white-space removal, 5 white-space escaping.
    """
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_piece("<unk>", 0.0, 2)] + [_piece(map_bytes(t), -float(r), 1) for r, t in enumerate(tokens)]
    none = (1 << 64) - 1  # -1
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) \
        + b"".join(_number(k, none) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.cache: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.pieces = [bytes(ord(c) - BYTE_BASE for c in self.model.id_to_piece(i + 1)) for i in range(len(self.ranks))]

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the chunks that the cache lacks, all pre-tokens in one call."""
        new = [c for c in set().union(*texts) if c not in self.cache]
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache.clear()
            new = list(set().union(*texts))
        split = [[m.encode() for m in pre_tokens(c)] for c in new]
        whole = self.ranks
        rest = {raw for parts in split for raw in parts if raw not in whole}
        ids_of = dict(zip(rest, self.model.encode([map_bytes(raw) for raw in rest], num_threads=1))) if rest else {}
        for chunk, parts in zip(new, split):
            ids: list[int] = []
            for raw in parts:
                if raw in whole:
                    ids.append(whole[raw])
                else:
                    ids += [i - 1 for i in ids_of[raw]]
            self.cache[chunk] = tuple(ids), ",".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        own = chunks(text)
        self.learn([own])
        return list(chain.from_iterable(v[0] for v in map(self.cache.__getitem__, own)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def round_trip(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Per text the number of ids, their decimal text and the decoded bytes."""
        split = [chunks(t) for t in texts]
        self.learn(split)
        for own in split:
            ids, decimal, raw = zip(*map(self.cache.__getitem__, own)) if own else ((), (), ())
            yield sum(map(len, ids)), ",".join(decimal), b"".join(raw)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_tokenizers.path(vocabulary))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: n_tokens, sha256 of the decimal ids and of the decoded bytes.

    Encoding and decoding run in one pass over the batch, so the ids (four
    bytes for every few characters) never cross back to the JVM.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_tokenizers.path(vocabulary))
        for b in batches:
            n, by_id, by_byte = [], [], []
            for lo, hi in slices(text_bytes(b.column(1))):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                for count, decimal, raw in own.round_trip(texts):
                    n.append(count)
                    by_id.append(hashlib.sha256(decimal.encode()).hexdigest())
                    by_byte.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(by_id, pa.string()), pa.array(by_byte, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
