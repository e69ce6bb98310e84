"""The n-gram join on odd tables, against all pairs compared."""

import random

import pytest
from pyspark.sql import types as T

from isoloom.llm import ngram_join

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def brute(rows, width=5, t=75):
    """Components over all pairs of distinct documents, by exact sets of word shingles."""
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= t * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, k):
    out = list(text)
    for at in rng.sample(range(len(out)), k):
        out[at] = f"e{rng.randrange(5000)}"
    return out


def tables():
    rng = random.Random(11)
    base, passage = words(rng, 120), words(rng, 30)
    yield "one", [(4, "a b c d e f g")]
    yield "two unlike", [(1, "a b c d e f g"), (2, "h i j k l m n")]
    yield "all distinct", [(i, " ".join(words(rng, 40))) for i in range(25)]
    yield "all equal", [(i, " ".join(base)) for i in range(3, 90)]
    yield "chain", [(i, " ".join(base[: 60 + i])) for i in range(0, 60, 3)]
    yield "near copies", [(i, " ".join(edited(rng, base, rng.randrange(6)))) for i in range(150)]
    yield "shared passage", [(i, " ".join(words(rng, 25) + passage + words(rng, rng.randrange(5, 40)))) for i in range(200)]
    yield "long and short", [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, " ".join(words(rng, 30000)))] + [(8 + i, " ".join(base)) for i in range(3)]


@pytest.mark.parametrize("name, rows", list(tables()), ids=lambda x: x if isinstance(x, str) else "")
def test_equals_all_pairs(spark, name, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_table_repeats_null_ids_and_other_columns(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "a b c d e f g h"
    rows = [(2, text, "x"), (2, text, "x"), (1, text, "y"), (None, text, "z"), (3, "q r s t u v", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == [(0, None), (1, 1), (2, 1), (2, 1), (3, 3)]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]


def test_pairs_of_a_shared_passage_do_not_multiply(spark):
    """Documents that only share a passage never reach verification as all pairs of its holders."""
    rng = random.Random(3)
    passage = words(rng, 40)
    count = {}
    for n in (200, 400):
        rows = [(i, " ".join(words(rng, 60) + passage + words(rng, 60))) for i in range(n)]
        docs = spark.createDataFrame(rows, SCHEMA)
        seen = []
        real = ngram_join.verify
        try:
            ngram_join.verify = lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1]
            got = ngram_join.near_duplicates(docs).collect()
        finally:
            ngram_join.verify = real
        assert all(r["doc_id"] == r["component_id"] for r in got)
        count[n] = sum(seen)
    assert count[400] <= 3 * max(count[200], 50)


def test_a_large_group_near_the_threshold(spark):
    """Of near copies that link with a part of the others only, few pairs are verified, and all are found connected."""
    rng = random.Random(8)
    base = words(rng, 150)
    rows = [(i, " ".join(edited(rng, base, rng.choice([2, 2, 3])))) for i in range(300)]
    seen = []
    real = ngram_join.verify
    try:
        ngram_join.verify = lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        ngram_join.verify = real
    assert got == brute(rows)
    assert sum(seen) < 300 * 299 / 2 / 4
