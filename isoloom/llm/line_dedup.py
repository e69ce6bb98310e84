"""Line deduplication with DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits; distinct documents are counted for each hash;
lines whose hash is found in too many documents are dropped everywhere, and what remains is put
together again by position.

Shuffles: one row for each distinct line hash of a map task (a common line is counted before it
moves); then positions of dropped lines, gathered by document; then the documents, once, to meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import unused
from isoloom.session import cut

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many dropped hashes (16 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII takes the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(11), F.col(key)).alias("h2")]


def common_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`(h1, h2, n_docs)` of the line keys found in at least `min_docs` documents.

    Rows that share an id are one document; each row without an id is one of its own. Only where ids repeat
    are they carried to the count.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    ids = docs.select(F.col(f"`{id_column}`").alias("id"))
    repeat = not ids.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()
    who = [F.coalesce(F.col(f"`{id_column}`").cast("string"), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))).alias("who")] if repeat else []
    keys = docs.select(*who, F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key")).where(F.char_length("key") >= min_chars)
    keys = keys.select(*_hashes("key"), *["who"] * repeat)
    if repeat:
        keys = keys.distinct()
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_docs: int = 10, min_chars: int = 1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of `docs`, `text` without the common lines, and `n_lines`, `n_dropped`.

    A null or empty text is one empty line and comes back as an empty text. Every row stays, rows that repeat
    too; rows of one id count as one document, rows without an id as one each. Columns named like
    results are replaced; all others stay, whatever their names. A text all of whose lines go becomes empty. An
    empty table gives no rows. Time is linear in a text's lines.
    """
    source = docs.drop("n_lines", "n_dropped")
    hot = cut(common_lines(source, text, id_column, min_docs, min_chars))
    few = hot.count() <= broadcast_rows
    hot = hot.select("h1", "h2")
    k1, k2, gone = unused(source.columns, "k1", "k2", "gone")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.col(f"`{id_column}`")
    row = [F.xxhash64(ident, whole).alias(k1), F.xxhash64(F.lit(13), whole, ident).alias(k2)]
    lines = source.select(*row, F.posexplode(F.transform(F.split(whole, "\n"), line_key)).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    lines = lines.select(k1, k2, "pos", *_hashes("key"))
    hits = lines.join(F.broadcast(hot) if few else hot, ["h1", "h2"]).groupBy(k1, k2).agg(F.collect_set("pos").alias(gone))
    joined = source.select("*", *row).join(hits, [k1, k2], "left")
    split = f"split(coalesce(`{text}`, ''), '\n')"
    # the outer transform names the lines once, so that taking one does not split the text again
    kept = F.expr(f"transform(array({split}), s -> array_join(transform(array_except(sequence(0, size(s) - 1), `{gone}`), i -> s[i]), '\n'))[0]")
    kept = F.when(F.col(gone).isNull(), whole).otherwise(kept)
    out = [kept.alias(text) if c == text else F.col(f"`{c}`") for c in source.columns]
    return joined.select(*out, F.size(F.split(whole, "\n")).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
