"""A corpus pipeline of five stages, each an operator on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom import session
from isoloom.llm import bpe, decontam, line_dedup, ngram_join, quality
from isoloom.llm.common import shielded, table
from isoloom.llm.queries import VOCABULARY


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, trained on this stage's input, rejects.

    Null and empty texts score 0.5 and stay; repeated rows are judged alike. An empty table gives no rows. The
    columns are those of `docs`, extra ones too, whatever their names; this holds for all stages but the last.
    """
    aside, back = shielded(docs, ("score", "predicted"))
    scored = quality.score(aside, quality.train(aside, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(*back)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more; a document without other lines stays, empty.

    Null texts come back empty; repeated rows of one id are one document. `n_chars` is counted again where
    there is one, as the type it has. An empty table gives no rows.
    """
    aside, back = shielded(docs, ("n_lines", "n_dropped"))
    kept = line_dedup.dedup_lines(aside)
    kinds = dict(docs.dtypes)
    return kept.select(*[F.char_length("text").cast(kinds[c]).alias(c) if c == "n_chars" else b for c, b in zip(docs.columns, back)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate component.

    Rows without an id or without words stay, as do all rows of a kept id. An empty table gives no rows.
    """
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike. An empty table gives no rows.
    """
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts: all columns but `text`, then ids, their number and digests of ids and decoded bytes.

    Null and empty texts have no ids. Columns named like results are replaced. Every row stays, repeated
    ones too; an empty table gives no rows.
    """
    made = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    found = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return found.select(*[f"`{c}`" for c in docs.columns if c != "text" and c.lower() not in made], *made)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's rows are written before the next reads them, which ends the need of all
    that was written before."""
    docs = table(spark, sf_dir, "documents")
    begun = session.folders()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = session.stored(docs, f"stage-{name}")
            session.discard(begun, keep=[session.folders() - 1])
    return docs
