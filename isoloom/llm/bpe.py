"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The rank file maps byte strings to ranks. Each becomes a piece whose characters stand for its bytes,
scored by its negative rank, in a sentencepiece BPE model with identity normalisation: the merge with
the highest score is then the merge with the lowest rank. The model is serialised here, directly, as
sentencepiece's protocol-buffer message; nothing is trained. Texts are split into pre-tokens, each is
encoded on its own, and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import blocks

#: Entries of a worker's cache of encoded pre-tokens; longer pre-tokens are not cached.
CACHE, CACHED_CHARS = 150_000, 32
_FIRST = 0x100  # byte b is written as the character _FIRST + b


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in rank order. The file is the driver's; executors get its content."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 has rank r."""
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(ranks):
        text = "".join(chr(_FIRST + b) for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes with one vocabulary; kept for the life of a worker."""

    def __init__(self, ranks: list[bytes], pattern: str):
        if {bytes([b]) for b in range(256)} - set(ranks):
            raise ValueError("the vocabulary lacks single bytes")
        self.tokens = ranks
        self.names = [str(i) for i in range(len(ranks))]
        self.whole = {t: (i,) for i, t in enumerate(ranks)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.table = {b: _FIRST + b for b in range(256)}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # what was used before the cache was last full

    def _fill(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        found, rest = {}, []
        for p in pieces:
            if (ids := self.whole.get(p.encode())) is not None:
                found[p] = ids
            else:
                rest.append(p)
        mapped = [p.encode().decode("latin-1").translate(self.table) for p in rest]
        for p, ids in zip(rest, self.model.encode(mapped, num_threads=1) if mapped else []):
            found[p] = tuple(i - 1 for i in ids)
        return found

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; pre-tokens not known yet go to the model together."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        missing = set().union(*split).difference(cache)
        kept = missing.intersection(older)
        cache.update((p, older[p]) for p in kept)
        missing -= kept
        found = self._fill(list(missing))
        long = {p: found.pop(p) for p in missing if len(p) > CACHED_CHARS}
        cache.update(found)
        for pieces in split:
            if long:
                yield [i for p in pieces for i in (cache[p] if p in cache else long[p])]
            else:
                yield list(chain.from_iterable(map(cache.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(key: str, ranks: list[bytes], pattern: str) -> Codec:
    if (key, pattern) not in _CODECS:
        _CODECS[key, pattern] = Codec(ranks, pattern)
    return _CODECS[key, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """All columns of `docs` but those named as results, then the encoding of each whole text.

    Adds `ids` (array<int>, if asked for), `n_tokens`, `ids_sha256` (of the decimal ids joined by
    commas) and `decoded_sha256` (of the bytes that the ids decode to). Null and empty texts have no
    ids. No special tokens: their strings are ordinary text. One pass, no shuffle.
    """
    ranks = read_ranks(vocabulary)
    key = hashlib.sha256(b"".join(ranks)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # size fixed by the vocabulary
    kept = docs.drop("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    added = ["CAST(null AS array<int>) AS ids"] * ids + ["0L AS n_tokens", "'' AS ids_sha256", "'' AS decoded_sha256"]
    schema = kept.select("*", *map(F.expr, added)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, shared.value, pattern)
        names = [f.name for f in schema]
        for batch in blocks(batches, text, 1 << 20):
            columns: list[list] = [[], [], [], []]
            for found in own.encode_all([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]):
                if ids:
                    columns[0].append(np.array(found, np.int32))
                columns[1].append(len(found))
                columns[2].append(hashlib.sha256(",".join(map(own.names.__getitem__, found)).encode()).hexdigest())
                columns[3].append(hashlib.sha256(own.decode(found)).hexdigest())
            made = [pa.array(columns[0], pa.list_(pa.int32()))] * ids + [pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return kept.mapInArrow(run, schema)
