"""Benchmark decontamination with suffix arrays of the training text.

Each block of documents is a shard. Its words become numbers and its suffixes are sorted by their first 10 words:
ranks of 2, 4 and 8 words come from pairs of ranks of half the length. Every suffix of every benchmark item is
found by binary search in the sorted ranks, dropped at the first length that the shard does not hold. Of the
places found, those whose preceding word is the item's too are parts of longer matches; they stand together in the
array, sorted by preceding word, and are skipped before they are listed. The rest are extended, 8 words at a time,
to the longest verbatim match. Matches of at least a window (10 words, or the whole item if shorter) are
hits; documents with hits are contaminated.

Words are compared by 64-bit hashes. One pass over the documents, no shuffle. The benchmark is broadcast in blocks of
bounded size; each further block has a pass of its own over the written result of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import Words, ascii_fold, blocks, shielded, utf8, word_chars
from isoloom.session import stored

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
BENCHMARK_BLOCK = 32 << 20


@dataclass(frozen=True)
class Items:
    """Distinct word sequences of a block of the benchmark, one after another, ended by 0."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place plus 1
    words: np.ndarray  # numbers; 0 ends a sequence
    item: np.ndarray  # sequence of each place
    left: np.ndarray  # words from each place to its sequence's end
    window: np.ndarray  # words that a hit of each sequence needs
    ids: list[list[str | None]]  # item ids of each sequence


def items_of(rows: list[tuple[str | None, str]], window: int = WINDOW) -> Items:
    raw, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
    words = Words(raw, offsets, word_chars(), ascii_fold())
    vocabulary, numbers = np.unique(words.hash, return_inverse=True)
    groups: dict[bytes, list[str]] = {}
    for (item, _), first, count in zip(rows, words.first, words.count):
        if count:
            groups.setdefault((numbers[first : first + count] + 1).astype(np.int64).tobytes(), []).append(item)
    seqs = [np.append(np.frombuffer(k, np.int64), 0) for k in groups]
    sizes = np.array([len(s) for s in seqs], np.int64)
    every = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
    ends = np.cumsum(sizes) - 1
    item = np.repeat(np.arange(len(seqs)), sizes)
    left = ends[item] - np.arange(len(every)) if seqs else np.zeros(0, np.int64)
    return Items(vocabulary, every, item, left, np.minimum(window, sizes - 1), list(groups.values()))


class Ranks:
    """Ranks of the first 1, 2, 4 and 8 words at each place of a shard; 0 where a 0 stands among them."""

    def __init__(self, numbers: np.ndarray, depth: int):
        self.of = {1: numbers}
        self.known: dict[int, np.ndarray] = {}
        n = 1
        while 2 * n <= depth:
            key = self.pair(numbers, n, n)
            self.known[2 * n] = np.unique(key[key >= 0])
            self.of[2 * n] = np.where(key >= 0, np.searchsorted(self.known[2 * n], key) + 1, 0)
            n *= 2

    def pair(self, numbers: np.ndarray, n: int, apart: int) -> np.ndarray:
        """Sort key of n words and the n words `apart` places later; -1 where a 0 is among them."""
        one = self.of[n]
        two = np.append(one[apart:], np.zeros(min(apart, len(one)), np.int64))
        return np.where((one > 0) & (two > 0), one << np.int64(32) | two, -1)

    def find(self, items: Items) -> dict[int, np.ndarray]:
        """For each place of the items, the ranks of its first words in this shard; 0 where it has none."""
        present = np.zeros(len(items.vocabulary) + 1, bool)
        present[self.of[1]] = True
        present[0] = False
        out = {1: np.where(present[items.words], items.words, 0)}
        n = 1
        while 2 * n in self.known:
            one = out[n]
            two = np.append(one[n:], np.zeros(min(n, len(one)), np.int64))
            live = np.flatnonzero((one > 0) & (two > 0))
            key, known = one[live] << np.int64(32) | two[live], self.known[2 * n]
            rank = np.zeros(len(one), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                rank[live] = np.where(known[at] == key, at + 1, 0)
            out[2 * n] = rank
            n *= 2
        return out


#: Pairs of places that are extended at once.
PAIRS = 1 << 20


def matches(numbers: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal verbatim matches, in portions: place in `numbers`, place in `items.words`, length in words.

    Both sides end where a 0 stands. Only matches of at least the item's window are given; matches
    that could be extended to the left are parts of longer ones and left out.
    """
    if not len(numbers) or not len(items.words):
        return
    need = items.window[items.item]
    tests = np.flatnonzero((items.words > 0) & (items.left >= need))
    ranks = Ranks(numbers, int(items.window.max()))
    of_test = ranks.find(items)
    before = np.concatenate([[0], numbers[:-1]])
    before_test = np.concatenate([[0], items.words[:-1]])
    span = np.int64(len(items.vocabulary) + 1)
    for k in np.unique(need[tests]).tolist():
        p = 1 << (k.bit_length() - 1)  # k words are the first p and the last p of them
        here = tests[need[tests] == k]
        one, two = of_test[p][here], of_test[p][here + k - p]
        here = here[(one > 0) & (two > 0)]
        want = of_test[p][here] << np.int64(32) | of_test[p][here + k - p]
        key = ranks.pair(numbers, p, k - p)
        spots = np.flatnonzero(np.isin(key, want))
        if not len(spots):
            continue
        suffixes = spots[np.lexsort((before[spots], key[spots]))]  # the suffix array, equal ones by preceding word
        keys = key[suffixes]
        kinds, rank = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(kinds, want), len(kinds) - 1)
        here, at = here[kinds[at] == want], at[kinds[at] == want]
        full = rank * span + before[suffixes]
        same = at * span + before_test[here]
        bounds = [np.searchsorted(full, v) for v in (at * span, same, same + 1, (at + 1) * span)]
        first = before_test[here] == 0
        # two ranges for each test: before and after the places with its preceding word
        begin = np.concatenate([bounds[0], bounds[2]])
        end = np.concatenate([np.where(first, bounds[2], bounds[1]), bounds[3]])
        test = np.concatenate([here, here])
        yield from _extended(numbers, items, ranks, of_test, suffixes, begin, end, test, k)


def _extended(numbers: np.ndarray, items: Items, ranks: Ranks, of_test: dict[int, np.ndarray], suffixes: np.ndarray, begin: np.ndarray, end: np.ndarray, test: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of the suffix array paired with their test, each pair of at least k words extended to the right."""
    step = max(of_test)
    total = np.concatenate([[0], np.cumsum(end - begin)])
    text, words = np.append(numbers, 0), np.append(items.words, 0)
    far_text, far_test = np.append(ranks.of[step], 0), np.append(of_test[step], 0)
    for lo in range(0, int(total[-1]), PAIRS):
        pair = np.arange(lo, min(lo + PAIRS, int(total[-1])))
        which = np.searchsorted(total, pair, "right") - 1
        spot, place = suffixes[begin[which] + pair - total[which]], test[which]
        length = np.full(len(pair), k, np.int64)
        for width, a, b in ((step, far_text, far_test), (1, text, words)):
            live = np.arange(len(pair))
            while len(live):
                x = a[np.minimum(spot[live] + length[live], len(a) - 1)]
                live = live[(x > 0) & (x == b[np.minimum(place[live] + length[live], len(b) - 1)])]
                length[live] += width
        yield spot, place, length


def _spans(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Union of half-open intervals, flattened."""
    out: list[int] = []
    for b, e in sorted(zip(begin.tolist(), end.tolist())):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def _merge(a: list[int], b: np.ndarray | list[int]) -> list[int]:
    both = np.concatenate([np.array(a, np.int64).reshape(-1, 2), np.array(b, np.int64).reshape(-1, 2)])
    return _spans(both[:, 0], both[:, 1])


def search(raw: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, list[list[int]], list[list[str]], np.ndarray]:
    """For each row: words, hit word spans, items with hits, and the longest match."""
    words = Words(raw, offsets, word_chars(), ascii_fold())
    rows = words.rows
    numbers = np.zeros(len(words.hash) + rows, np.int64)  # a 0 after each row's words
    at = words.first + np.arange(rows)
    row_of = np.repeat(np.arange(rows), words.count)
    if len(items.vocabulary) and len(words.hash):
        found = np.minimum(np.searchsorted(items.vocabulary, words.hash), len(items.vocabulary) - 1)
        numbers[np.arange(len(words.hash)) + row_of] = np.where(items.vocabulary[found] == words.hash, found + 1, 0)
    spans: list[list[int]] = [[] for _ in range(rows)]
    hit: list[set[int]] = [set() for _ in range(rows)]
    longest = np.zeros(rows, np.int64)
    for spot, test, length in matches(numbers, items):
        row = np.searchsorted(at, spot, "right") - 1
        np.maximum.at(longest, row, length)
        for r, seq in np.unique(np.stack([row, items.item[test]], 1), axis=0).tolist():
            hit[r].add(seq)
        order = np.argsort(row, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
            r = row[part[0]]
            begin = spot[part] - at[r]
            spans[r] = _merge(spans[r], np.stack([begin, begin + length[part]], 1))
    named = [sorted({i for s in found for i in items.ids[s] if i is not None}) for found in hit]
    return words.count, spans, named, longest


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK) -> DataFrame:
    """All columns of `docs`, then what of the benchmark (`item_id`, `text`) each whole text holds.

    Adds `n_words`, `hits` (array<long>: begin and end of each run of hit words), `items`
    (array<string>, sorted), `longest_match` (words) and `contaminated`. Null and empty texts have no
    words and no hits; items without words are never found; items of one text are all named. An item
    without an id is searched like any other, but `items` can't name it. Columns named like results are
    replaced, all others stay; every row stays, repeated ones too. An empty table gives no rows, an empty
    benchmark no hits.
    """
    base = docs.drop("n_words", "hits", "items", "longest_match", "contaminated")
    bench = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), "text")
    total = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // block_bytes))
    empty = ["0L AS n_words", "CAST(array() AS array<bigint>) AS hits", "CAST(array() AS array<string>) AS items", "0L AS longest_match"]
    out = base.select("*", *map(F.expr, empty))
    schema = out.schema
    names = [f.name for f in schema]
    for b in range(n_blocks):
        part = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == b) if n_blocks > 1 else bench
        rows = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r))  # about block_bytes
        if b:
            out = stored(out, "leaks")  # the block before has run, so that only one is held at a time
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(items_of(rows, window))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, merge: bool = b > 0) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, text):
                count, spans, found, longest = search(*utf8(batch.column(batch.schema.get_field_index(text))), shared.value)
                if merge:
                    old = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hits", "items", "longest_match")}
                    spans = [_merge(x, y) for x, y in zip(old["hits"], spans)]
                    found = [sorted({*x, *y}) for x, y in zip(old["items"], found)]
                    longest = np.maximum(old["longest_match"], longest)
                made = [pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(batch.columns) - 4], *made], names)

        out = out.mapInArrow(run, schema)
    return out.withColumn("contaminated", F.size("hits") > 0)


def n_hit() -> Column:
    """Hit words of a row of `find_leaks`."""
    return F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any hit, with their own columns, whatever their names."""
    aside, back = shielded(docs, ("n_words", "hits", "items", "longest_match", "contaminated"))
    return find_leaks(aside, benchmark, text, window).where("NOT contaminated").select(*back)
