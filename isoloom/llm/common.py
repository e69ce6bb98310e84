"""What the text operators share: table access, null-safe texts and vectorised hashing of words.

Everything here works on whole texts. Arrow batches are regrouped into blocks bounded by bytes,
so a Python worker's memory depends on the block size and on its longest single text only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as no column has."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def shielded(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """`docs` with columns of these names put aside, and what selects its own columns again."""
    clash = [c for c in docs.columns if c.lower() in set(names)]
    aside = dict(zip(clash, unused(docs.columns, *[f"own_{i}" for i in range(len(clash))])))
    return docs.withColumnsRenamed(aside), [F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, n: int) -> Column:
    """crc32 of a value's text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def crc_mod(column: str, n: int) -> Column:
    """`bucket_of` with nulls as the empty string's."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to `limit` bytes, or one longer text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: none) and the offsets of its values."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def splitmix(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from the splitmix64 sequence."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """Words of a block: hash, owning row and place, found by a table of word bytes.

    `keep[byte]` says whether a byte belongs to a word and `fold[byte]` what it counts as; words
    never cross rows. Hashes are multilinear over the folded bytes with 64 random bits for each
    place, so equal words have equal hashes and others differ but for about 2**-64.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray, fold: np.ndarray):
        self.rows = len(offsets) - 1
        n = len(raw)
        inside = keep[raw]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        start[cuts] = inside[cuts]
        places = np.flatnonzero(inside)
        begins = np.flatnonzero(start[places])
        self.start = places[begins]
        lengths = np.diff(np.append(begins, len(places)))
        self.length = lengths
        if len(begins):
            within = np.arange(len(places)) - np.repeat(begins, lengths)
            powers = splitmix(int(lengths.max()) + 1, 0x5851F42D4C957F2D)
            with np.errstate(over="ignore"):
                values = (fold[raw[places]].astype(np.uint64) + np.uint64(1)) * powers[within]
                self.hash = mix(np.add.reduceat(values, begins) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first


def ascii_fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def not_space() -> np.ndarray:
    """Word bytes of `[^\\x20\\x09-\\x0D]+`."""
    keep = np.ones(256, bool)
    keep[[9, 10, 11, 12, 13, 32]] = False
    return keep


def word_chars() -> np.ndarray:
    """Word bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z have been lower-cased."""
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    return keep


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after one space and a last space; offsets of those spaces."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = " " + " ".join(texts) + " "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])
