"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled; neighbouring words are tied by learned transitions, so runs of one
language inside code-switched text are found by forward-backward. A word's features are its hashed
identity, its membership in each language's lexicon of frequent training words, prefixes and suffixes
of 1 to 3 letters, and its letter bigrams and trigrams. The text's language has the largest sum of
word marginals.

A text is one chain, however long. It is worked on in pieces of `SPAN` words: each piece's product of
transition and word matrices carries the forward and backward messages from piece to piece, and with the messages that
come in at its ends a piece's marginals are those of the whole chain. Training takes each piece as a sequence.
Model size is fixed by `BITS`, the lexicon's bound and the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import blocks, code_points, crc_mod, mix, splitmix

BITS = 16
SPAN = 32
LEXICON = 300
#: Bound on the training rows: texts of each language. All languages are learned.
MAX_TEXTS_PER_LANGUAGE = 250
#: Training reads no text of more bytes, so that what goes to the driver is bounded.
MAX_TRAINING_BYTES = 1 << 17
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


@dataclass(frozen=True)
class Crf:
    labels: list[str]
    weights: np.ndarray  # (2**BITS, labels)
    transitions: np.ndarray  # (labels, labels)
    lexicon: np.ndarray  # sorted hashes of lexicon words
    lexicon_weights: np.ndarray  # (words of the lexicon, labels)


class WordTable:
    """Distinct words of some texts: hashes, features, and the word number of each place."""

    def __init__(self, texts: list[str]):
        c, bounds = code_points([t.lower() for t in texts])
        inside = letters()[c]
        starts = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.first = np.searchsorted(starts, bounds[:-1])
        self.count = np.searchsorted(starts, bounds[1:]) - self.first
        if not len(starts):
            self.hash, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.features, self.owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        lengths = ends - starts
        body = c[inside].astype(np.uint64)
        begin = np.cumsum(lengths) - lengths
        within = np.arange(len(body)) - np.repeat(begin, lengths)
        with np.errstate(over="ignore"):
            h = mix(np.add.reduceat((body + np.uint64(1)) * splitmix(int(lengths.max()), 31)[within], begin))
        self.hash, at, self.word = np.unique(h, return_index=True, return_inverse=True)
        self._grams(c, starts[at], lengths[at])

    def _grams(self, c: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Affixes and n-grams of the distinct words: feature buckets and the word each belongs to."""
        number = np.arange(len(starts))
        owner = np.repeat(number, lengths)
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths) + np.repeat(starts, lengths)
        one = c[place].astype(np.uint64)
        from_end = np.repeat(lengths, lengths) - (np.arange(len(place)) - np.repeat(begin, lengths))
        from_start = np.repeat(lengths, lengths) - from_end
        two = one * np.uint64(0x1F123BB5) + np.append(one[1:], 0).astype(np.uint64)
        three = two * np.uint64(0x1F123BB5) + np.append(one[2:], [0, 0])[: len(one)].astype(np.uint64)
        found, owners = [self.hash], [number]
        with np.errstate(over="ignore"):
            for n, gram in ((1, one), (2, two), (3, three)):
                whole = from_end >= n
                for kind, where in ((1, from_start == 0), (2, from_end == n), (3, True)):
                    if kind == 3 and n == 1:
                        continue
                    keep = whole & where
                    found.append(mix(gram[keep] * np.uint64(8) + np.uint64(kind) + np.uint64(n * 1_000_003)))
                    owners.append(owner[keep])
        h, o = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(o, kind="stable")
        self.features = (h[order] >> np.uint64(64 - BITS)).astype(np.int64)
        self.owner = o[order]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the features' weights for each distinct word."""
        begin = np.searchsorted(self.owner, np.arange(len(self.hash)))
        return np.add.reduceat(weights[self.features], begin, axis=0) if len(self.hash) else np.zeros((0, weights.shape[1]), weights.dtype)


def _lexical(crf: Crf, hashes: np.ndarray) -> np.ndarray:
    """Weights that the lexicon adds to the distinct words."""
    out = np.zeros((len(hashes), len(crf.labels)), np.float32)
    if len(crf.lexicon) and len(hashes):
        at = np.minimum(np.searchsorted(crf.lexicon, hashes), len(crf.lexicon) - 1)
        hit = crf.lexicon[at] == hashes
        out[hit] = crf.lexicon_weights[at[hit]]
    return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (steps, sequences, labels) and expected transition counts of padded sequences.

    scores: (steps, sequences, labels). Steps at or after a sequence's length are padding. `begin` and `end`
    (sequences, labels) are the messages into the first and last word from what stands before and after them.
    """
    steps, _, k = scores.shape
    phi = np.exp(scores - scores.max(2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(phi), np.ones_like(phi)
    if begin is not None:
        alpha[0] = phi[0] * begin
    else:
        alpha[0] = phi[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    if end is not None:
        beta[:] = end
    last = beta[0].copy()
    for t in range(1, steps):
        v = (alpha[t - 1] @ a) * phi[t]
        alpha[t] = v / v.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(steps - 1, 0, -1):
        live = (t < lengths)[:, None]
        right = phi[t] * beta[t]
        v = right @ a.T
        beta[t - 1] = np.where(live, v / v.sum(1, keepdims=True), last)
        joint_norm = ((alpha[t - 1] @ a) * right).sum(1, keepdims=True)
        pairs += ((alpha[t - 1] * live / joint_norm).T @ right) * a
    marginal = alpha * beta
    marginal /= marginal.sum(2, keepdims=True)
    return marginal, pairs


def products(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each piece, word and transition matrices multiplied from its first word to its last: (pieces, labels, labels)."""
    steps, n, k = scores.shape
    phi = np.exp(scores - scores.max(2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    out = phi[0][:, None, :] * np.eye(k, dtype=phi.dtype)
    for t in range(1, steps):
        live = np.flatnonzero(t < lengths)
        if not len(live):
            break
        v = (out[live] @ a) * phi[t][live][:, None, :]
        out[live] = v / v.sum((1, 2), keepdims=True)
    return out


def messages(product: np.ndarray, transitions: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each piece from its text's pieces before and after: (pieces, labels) each.

    Text i has pieces first[i] to first[i] + count[i] - 1; all texts advance together, a piece a step.
    """
    n, k, _ = product.shape
    a = np.exp(transitions - transitions.max())
    begin, end = np.ones((n, k), product.dtype), np.ones((n, k), product.dtype)
    for j in range(1, int(count.max(initial=0))):
        at = first[count > j] + j
        v = ((begin[at - 1][:, None, :] @ product[at - 1]) @ a)[:, 0]
        begin[at] = v / v.sum(1, keepdims=True)
        at = (first + count - 1)[count > j] - j
        w = (a @ (product[at + 1] @ end[at + 1][:, :, None]))[:, :, 0]
        end[at] = w / w.sum(1, keepdims=True)
    return begin, end


def _sequences(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places (SPAN, sequences; padding repeats the first), lengths and owning rows."""
    n = -(-count // SPAN)
    row = np.repeat(np.arange(len(count)), n)
    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = first[row] + piece * SPAN
    length = np.minimum(SPAN, count[row] - piece * SPAN)
    step = np.arange(SPAN)[:, None]
    return np.where(step < length, begin + step, begin), length, row


def fit(texts: list[str], langs: list[str], epochs: int = 2, rate: float = 0.5, seed: int = 3) -> Crf:
    """Learn feature weights and transitions by stochastic gradient on the log-likelihood.

    A third of the training sequences are spliced from two texts, so switches are seen.
    """
    labels = sorted(set(langs))
    k = len(labels)
    zero = np.zeros(0, np.uint64)
    weights = np.zeros((1 << BITS, max(k, 1)), np.float32)
    if k < 2:
        return Crf(labels, weights, np.zeros((max(k, 1), max(k, 1))), zero, np.zeros((0, max(k, 1)), np.float32))
    rng = np.random.default_rng(seed)
    words = WordTable(texts)
    gold_row = np.array([labels.index(x) for x in langs])
    places, length, row = _sequences(words.first, words.count)
    gold = np.broadcast_to(gold_row[row], places.shape).copy()
    other = rng.permutation(len(row))
    cut = np.where(rng.random(len(row)) < 1 / 3, rng.integers(4, SPAN - 4, len(row)), SPAN)
    spliced = (np.arange(SPAN)[:, None] >= cut) & (length == SPAN) & (length[other] == SPAN)
    places, gold = np.where(spliced, places[:, other], places), np.where(spliced, gold[:, other], gold)
    of_word = words.word
    counts = np.zeros((len(words.hash), k))
    owner_label = np.repeat(gold_row, words.count)
    np.add.at(counts, (of_word, owner_label), 1)
    lexicon = np.unique(np.concatenate([words.hash[np.argsort(-counts[:, j], kind="stable")[:LEXICON]] for j in range(k)]))
    crf = Crf(labels, weights, np.zeros((k, k)), lexicon, np.zeros((len(lexicon), k), np.float32))
    begin = np.searchsorted(words.owner, np.arange(len(words.hash) + 1))
    at_lexicon = np.full(len(words.hash), -1)
    spot = np.minimum(np.searchsorted(lexicon, words.hash), len(lexicon) - 1)
    at_lexicon[lexicon[spot] == words.hash] = spot[lexicon[spot] == words.hash]
    batch = 64
    total = epochs * -(-len(row) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(row))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            lr = rate * (1 - step / total)
            step += 1
            w = of_word[places[:, pick]]
            distinct, inverse = np.unique(w, return_inverse=True)
            inverse = inverse.reshape(w.shape)
            size = begin[distinct + 1] - begin[distinct]
            cuts = np.cumsum(size) - size
            spans = np.repeat(begin[distinct] - cuts, size) + np.arange(int(size.sum()))
            feats = words.features[spans]
            scores = np.add.reduceat(weights[feats], cuts, axis=0)
            lex = at_lexicon[distinct]
            scores[lex >= 0] += crf.lexicon_weights[lex[lex >= 0]]
            marginal, pairs = forward_backward(scores[inverse].astype(np.float64), crf.transitions, length[pick])
            live = np.arange(SPAN)[:, None] < length[pick]
            g = gold[:, pick]
            error = -marginal
            np.put_along_axis(error, g[..., None], np.take_along_axis(error, g[..., None], 2) + 1, 2)
            error *= live[..., None]
            by_word = np.stack([np.bincount(inverse.ravel(), error[..., j].ravel(), len(distinct)) for j in range(k)], 1) / len(pick)
            np.add.at(weights, feats, (lr * np.repeat(by_word, size, 0)).astype(np.float32))
            np.add.at(crf.lexicon_weights, lex[lex >= 0], (lr * by_word[lex >= 0]).astype(np.float32))
            seen = np.zeros((k, k))
            both = live[1:]
            np.add.at(seen, (g[:-1][both], g[1:][both]), 1)
            crf.transitions[...] += lr * (seen - pairs) / (len(pick) * SPAN)
    return crf


def label_words(crf: Crf, texts: list[str]) -> tuple[np.ndarray, WordTable]:
    """Marginals (words, labels) of all words of the texts, in order."""
    words = WordTable(texts)
    k = len(crf.labels)
    if not len(words.word) or not k:
        return np.zeros((len(words.word), k)), words
    scores = words.emissions(crf.weights) + _lexical(crf, words.hash)
    places, length, row = _sequences(words.first, words.count)
    transitions = crf.transitions.astype(np.float32)
    width = max(64, 65536 // (k * k))
    cuts = [slice(b, b + width) for b in range(0, places.shape[1], width)]
    product = np.concatenate([products(scores[words.word[places[:, c]]], transitions, length[c]) for c in cuts])
    pieces = np.bincount(row, minlength=len(words.count))
    begin, end = messages(product, transitions, np.cumsum(pieces) - pieces, pieces)
    del product
    out = np.zeros((len(words.word), k), np.float32)
    for c in cuts:
        here, size = places[:, c], length[c]
        marginal, _ = forward_backward(scores[words.word[here]], transitions, size, begin[c], end[c])
        live = np.arange(SPAN)[:, None] < size
        out[here[live]] = marginal[live]
    return out, words


def predict_texts(crf: Crf, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and its mean word marginal for each text; `und` and 0 without any letter."""
    marginal, words = label_words(crf, texts)
    if not crf.labels or not len(marginal):
        return ["und"] * len(texts), np.zeros(len(texts))
    total = np.concatenate([np.zeros((1, marginal.shape[1])), np.cumsum(marginal, 0, dtype=np.float64)])
    sums = total[words.first + words.count] - total[words.first]
    best = sums.argmax(1)
    score = np.clip(sums[np.arange(len(texts)), best] / np.maximum(words.count, 1), 0, 1)
    return [crf.labels[b] if n else "und" for b, n in zip(best, words.count)], np.where(words.count > 0, score, 0.0)


def train(docs: DataFrame, per_language: int = MAX_TEXTS_PER_LANGUAGE) -> Crf:
    """Fit on at most about `per_language` texts of each language, those of lowest doc_id hash.

    Rows whose crc32(doc_id) mod 4 is 2, rows without a language or text, and texts of more than
    MAX_TRAINING_BYTES are not learned from. Without any row nothing is learned.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(crc_mod("doc_id", 4) != 2).where(F.octet_length("text") <= MAX_TRAINING_BYTES)
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return fit([], [])
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(per_language / n))])[F.col("lang")]
    rows = usable.where(spread < share).select("doc_id", "lang", "text").collect()
    rows = sorted((r["doc_id"] or 0, r["lang"], r["text"]) for r in rows)
    rows = [r for r in rows if any(map(str.isalpha, r[2]))]
    return fit([r[2] for r in rows], [r[1] for r in rows])


def predict(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """All columns of `docs` with `lang_pred` and `score` added (any of that name are replaced).

    Texts that are null, empty or without a letter are `und` with score 0, as is every text where nothing was
    learned. Of languages with equal sums the first in order wins. Every row stays, repeated ones too; an
    empty table gives no rows.
    """
    kept = docs.drop("lang_pred", "score")
    shared = kept.sparkSession.sparkContext.broadcast(crf)  # size fixed by BITS, LEXICON and the number of languages
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for batch in blocks(batches, text, 1 << 20):
            column = batch.column(batch.schema.get_field_index(text))
            langs, scores = predict_texts(shared.value, [t or "" for t in column.to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return kept.mapInArrow(run, schema)
