"""Quality classifier: supervised subword embeddings.

Hashed words and character 3- and 4-grams have learned vectors; a document is the average of the
vectors of all its features, and a linear layer with softmax gives the class probabilities.
Training is plain numpy stochastic gradient descent, one document a step.

Because averaging and the linear layer are both linear, the trained model collapses to one logit
for each bucket (`QualityModel.logits`); scoring a document is one gather and one mean over all its
features, whatever its length. The model is `8 * buckets` bytes at most, fixed by a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import blocks, code_points, crc_mod, splitmix

BITS = 17
DIM = 8
#: Bound on the labelled rows of each class that training reads.
MAX_ROWS_PER_CLASS = 1500
#: Training reads no text of more bytes, so that what goes to the driver is bounded.
MAX_TRAINING_BYTES = 1 << 17
#: Blanks between words, counted as one kind.
BLANKS = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
_P = splitmix(4, 77).astype(np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class QualityModel:
    """logits[b]: what a feature of bucket b adds for label 1; a text without features has logit 0."""

    logits: np.ndarray


def _features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature, an order by text, and where each text's features begin and end.

    A feature starts at a place of the text; places hold a 3-gram, a 4-gram, a word and a
    word bigram at most. Of the word bigrams only those of one word twice count; all share a bucket.
    Grams do not span blanks, but a blank may be their first or last character.
    """
    c, bounds = code_points(texts)
    blank = (c <= 0x3000) & np.isin(c, BLANKS)
    c = np.where(blank, np.uint32(32), c)
    n = len(c)
    shift = np.uint32(32 - bits)
    slots = np.full((4, n), -1, np.int32)

    def put(row: int, h: np.ndarray, valid: np.ndarray) -> None:
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x297A2D39)
        slots[row, : len(h)] = np.where(valid, (h >> shift).astype(np.int32), -1)

    with np.errstate(over="ignore"):
        m = c * _P[0]
        if n >= 3:
            three = m[:-2] + c[1:-1] * _P[1] + c[2:] * _P[2]
            put(0, three.copy(), ~blank[1:-1])
            if n >= 4:
                put(1, three[:-1] + c[3:] * _P[3] + np.uint32(7), ~(blank[1:-2] | blank[2:-1]))
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        if len(starts):
            ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            lengths = ends - starts
            letters = c[~blank]
            begin = np.cumsum(lengths) - lengths
            within = np.arange(len(letters)) - np.repeat(begin, lengths)
            powers = splitmix(int(lengths.max()), 99)
            h = np.add.reduceat(letters.astype(np.uint64) * powers[within], begin)
            word = np.full(n, -1, np.int32)
            word[starts] = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
            slots[2] = word
            same = np.flatnonzero(h[1:] == h[:-1]) + 1
            first = np.searchsorted(starts, bounds[:-1])
            slots[3, starts[same[~np.isin(same, first)]]] = 0
    return slots, bounds[:-1], bounds[1:]


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their share of its features."""
    out = []
    for t in texts:
        slots, _, _ = _features([t])
        ids, n = np.unique(slots[slots >= 0], return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.3, seed: int = 5) -> QualityModel:
    """Train by stochastic gradient descent. One class only, or no rows, gives a constant model."""
    size = 1 << BITS
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        logits = np.zeros(size)
        logits[:] = np.log(prior / (1 - prior))
        return QualityModel(logits.astype(np.float32))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), np.float32)
    rows = _counts(texts)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            ids, share = rows[i]
            picked = vectors[ids]
            hidden = share @ picked
            z = output @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(min(weight[y[i]], 3.0))
            back = p @ output
            output -= lr * np.outer(p, hidden)
            vectors[ids] = picked - (lr * share)[:, None] * (back * np.float32(len(ids) ** 0.5))
    return QualityModel((vectors @ (output[1] - output[0])).astype(np.float32))


def score_texts(model: QualityModel, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for each whole text; 0.5 for a text without features."""
    slots, begin, _ = _features(texts)
    table = np.append(model.logits, np.float32(0))
    total = np.zeros(slots.shape[1])
    count = np.zeros(slots.shape[1], np.int32)
    for row in slots:
        total += table[row]  # -1 is the 0 that was appended
        count += row >= 0
    z = np.add.reduceat(total, begin)
    n = np.maximum(np.add.reduceat(count, begin), 1)
    return 1 / (1 + np.exp(-z / n))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = MAX_ROWS_PER_CLASS) -> DataFrame:
    """At most about `per_class` labelled rows of each class, `(doc_id, text, label)`.

    Rows whose crc32(doc_id) mod 5 is 0 are held out. The rows are those with the lowest hash of
    doc_id; the share is set by the classes' counts, so only chosen texts leave the scan.
    """
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("label"))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("label") == 1, per_class / max(1, sizes.get(1, 0))).otherwise(per_class / max(1, sizes.get(0, 0)))
    chosen = marked.where(spread < share)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAINING_BYTES)
    return short.join(F.broadcast(chosen), "doc_id")  # about 2 * per_class rows


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_ROWS_PER_CLASS) -> QualityModel:
    rows = sorted((r["doc_id"], r["text"] or "", r["label"]) for r in training_rows(docs, labels, per_class).collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """All columns of `docs` with `score` and `predicted` added (any of that name are replaced).

    Null and blank texts score 0.5. Every row is kept, repeated ones too; an empty table gives no rows.
    """
    kept = docs.drop("score", "predicted")
    shared = kept.sparkSession.sparkContext.broadcast(model)  # size fixed by BITS
    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for batch in blocks(batches, text, 1 << 20):
            column = batch.column(batch.schema.get_field_index(text))
            s = score_texts(shared.value, [t or "" for t in column.to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names)

    return kept.mapInArrow(run, schema)
