"""Every operator and pipeline stage on nulls, empty and long texts, repeats, ties, empty tables and clashing names."""

import hashlib
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isoloom.llm import bpe, decontam, fingerprint, html_extract, langid, license_scan, line_dedup, quality, sharding

CLASHES = "score predicted lang_pred n_tokens ids ids_sha256 decoded_sha256 matches n_lines n_dropped hits items longest_match n_words contaminated size shard slot bucket part _k1 _k2 _gone _lines _units _templates _all _pairs _near _runs key pos h1 h2 who id kind term chunk".split()
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [(1, None), (2, ""), (3, " \n\t\n"), (4, "One short line."), (5, LONG), (6, "same text here\nand a line"), (6, "same text here\nand a line"), (None, "no id at all"), (7, "\n".join(["a line"] * 3))]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of ROWS with a column of every name that operators use or return."""
    base = spark.createDataFrame(ROWS, "doc_id long, text string")
    return base.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.char_length("text").cast("long").alias("n_chars"), *[F.lit(f"own {c}").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("a", "One short line"), (None, "same text here and a line"), ("b", None), ("c", "")], "item_id string, text string")


def own(df, rows, replaced):
    """All columns but the replaced ones have kept their values."""
    for r in rows:
        assert all(r[c] == f"own {c}" for c in CLASHES if c not in replaced), r


def applied(odd, bench):
    model, crf = quality.fit([], []), langid.fit([], [])
    yield "quality", lambda d: quality.score(d, model), {"score", "predicted"}
    yield "language", lambda d: langid.predict(d, crf), {"score", "lang_pred"}
    yield "bpe", lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), {"ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    yield "lines", line_dedup.dedup_lines, {"n_lines", "n_dropped"}
    yield "licences", license_scan.scan_licenses, {"matches"}
    yield "leaks", lambda d: decontam.find_leaks(d, bench), {"n_words", "hits", "items", "longest_match", "contaminated"}


@pytest.mark.parametrize("k", range(6))
def test_rows_and_other_columns_stay(odd, bench, k):
    name, f, replaced = list(applied(odd, bench))[k]
    got = f(odd)
    rows = got.collect()
    assert len(rows) == len(ROWS), name
    own(got, rows, replaced)
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(i) for i, _ in ROWS)
    assert f(odd.limit(0)).collect() == []


def test_values_of_odd_rows(spark, odd, bench):
    by = {r["doc_id"]: r for r in quality.score(odd, quality.fit([], [])).collect()}
    assert by[1]["score"] == by[2]["score"] == 0.5 and 0 <= by[5]["score"] <= 1
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit([], [])).collect()} == {"und"}
    leaks = {r["doc_id"]: r for r in decontam.find_leaks(odd, bench).collect()}
    assert leaks[4]["items"] == ["a"] and leaks[4]["longest_match"] == 3
    assert leaks[6]["contaminated"] and leaks[6]["items"] == [] and leaks[6]["longest_match"] == 6  # an item without an id
    assert not leaks[1]["contaminated"] and leaks[1]["n_words"] == 0
    assert sum(r["contaminated"] for r in decontam.find_leaks(odd, bench.limit(0)).collect()) == 0
    left = decontam.remove_leaks(odd, bench)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "5", "7", "None"]


def test_shards_and_fingerprints_of_odd_rows(odd):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(ROWS) and sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in ROWS)
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(odd.limit(0), 3).collect() == []
    found = fingerprint.fingerprints(odd).collect()
    assert len(found) == len(ROWS) and fingerprint.fingerprints(odd.limit(0)).collect() == []
    with pytest.raises(TypeError):
        fingerprint.fingerprints(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_pages(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p>" + "<b>" * 8000 + "</i>" * 8000 + "</b>" * 8000, "x"), (3, None, "plain", "x")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", 0), (2, "u", 0), (3, None, 0), (3, None, 5)]
    assert html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).collect() == []


def test_lines_count_documents_not_rows(spark):
    rows = [(1, f"shared\nline {k}") for k in range(12)] + [(10 + k, f"common\nown {k}") for k in range(10)] + [(None, "free") for _ in range(10)]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (1, "shared\nline 3") in got and (13, "own 3") in got and (None, "") in got


def test_very_many_lines_take_linear_time(spark):
    lines = [f"line {i}" if i % 3 else "again" for i in range(120_000)]
    docs = spark.createDataFrame([(i, "again") for i in range(10)] + [(99, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 40
    assert got[99]["text"] == "\n".join(x for x in lines if x != "again") and got[99]["n_dropped"] == 40_000


def test_pipeline_stages(spark, odd, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", "One short line"), (None, "x y")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.collect() == [] and empty.columns == out.columns
        if name != "byte_bpe":
            assert out.columns == odd.columns and out.dtypes == odd.dtypes
            rows = out.collect()
            own(out, rows, set())
            kept[name] = sorted(str(r["doc_id"]) for r in rows)
            out = spark.createDataFrame(rows, odd.schema)
        docs = out
    assert kept["quality"] == kept["line_dedup"] == sorted(str(i) for i, _ in ROWS)
    assert kept["ngram_join"] == kept["line_dedup"]  # both rows of one id stay
    assert "4" not in kept["decontamination"] and "1" in kept["decontamination"]
    last = docs.collect()
    assert sorted(str(r["doc_id"]) for r in last) == kept["decontamination"]
    assert [r["decoded_sha256"] for r in last if r["doc_id"] == 5] == [hashlib.sha256(LONG.encode()).hexdigest()]
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == kept["decontamination"]
