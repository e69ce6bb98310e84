"""I-Match document fingerprints with DataFrame functions only.

The lexicon keeps the terms whose inverse document frequency lies in a band. Its terms are dealt to
randomised lexicon subsets by hash; a document's fingerprint is one hash for each subset, of the sorted
distinct terms it has there. So that subsets hold one or two terms of a short document and of a long one
alike, a document that has more terms of the lexicon uses sparser subsets: level l keeps one term in 2**l.
A fingerprint has the hashes of two neighbouring levels, and two fingerprints are compared on a level
they share: likeness is the share of subsets with terms in either whose hashes are equal.

The band is relative to the number of documents, so the lexicon has at most
(mean distinct terms) / LEAST_SHARE terms at any corpus size and is broadcast; it is counted first and
joined by shuffle beyond a bound. Documents move once, dealt out by ranges of id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoloom.session import cut

#: The band, as shares of the documents that have a term: ln(1 / MOST) <= idf <= ln(1 / LEAST).
LEAST_SHARE, MOST_SHARE = 0.002, 0.1
#: In small corpora a term of the lexicon has at least so many documents.
LEAST_DOCS = 2
SUBSETS = 16
BROADCAST_TERMS = 2_000_000
#: Rows of a range of ids on average, and ranges that a node of the search tree has. There are FAN**3 ranges at most; beyond
#: FAN**3 * CHUNK_ROWS rows they grow, which costs sorting within a range (spilled to disk), not memory.
CHUNK_ROWS, FAN = 500, 64


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """`(term)`: 64-bit hashes of the terms within the band, from all documents."""
    n = docs.count()
    low, high = max(LEAST_DOCS, LEAST_SHARE * n), max(LEAST_DOCS, MOST_SHARE * n)
    counted = docs.select(F.explode(terms(F.col(text))).alias("w")).select(F.xxhash64("w").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= low) & (F.col("df") <= high)).select("term")


def level_sql(n: str) -> str:
    """The least level at which subsets hold 1.5 terms at most, on average."""
    return f"CAST(greatest(0, ceil(log2(greatest({n}, 1) / {1.5 * SUBSETS}D))) AS int)"


def _hashes_sql(found: str, level: str) -> str:
    """One hash for each subset of a level, `0` where the text has no terms of it."""
    kept = f"filter({found}, t -> (shiftrightunsigned(t, 8) & (shiftleft(1L, {level}) - 1)) = 0)"
    one = f"transform(array(filter(s, t -> (t & {SUBSETS - 1}) = r)), o -> if(size(o) = 0, '0', hex(xxhash64(o))))[0]"
    return f"array_join(transform(array({kept}), s -> transform(sequence(0, {SUBSETS - 1}), r -> {one}))[0], '.')"


def fingerprint_sql(found: str, sha: str) -> str:
    """`level:hashes;level+1:hashes` of sorted term hashes; `x:` and the text's hash without any term."""
    two = f"transform(array({level_sql(f'size({found})')}), l -> concat(l, ':', {_hashes_sql(found, 'l')}, ';', l + 1, ':', {_hashes_sql(found, 'l + 1')}))[0]"
    return f"if(size({found}) = 0, concat('x:', {sha}), {two})"


def likeness_sql(a: str, b: str) -> str:
    """0 to 1: subsets with equal hashes among those with terms in either, on the lowest level both have."""
    pairs = "filter(zip_with(split(u[1], '[.]'), split(v[1], '[.]'), (p, q) -> named_struct('p', p, 'q', q)), z -> z.p <> '0' OR z.q <> '0')"
    share = f"transform(array({pairs}), w -> if(size(w) = 0, 0D, size(filter(w, z -> z.p = z.q)) / CAST(size(w) AS double)))[0]"
    levels = f"flatten(transform(transform(split({a}, ';'), i -> split(i, ':')), u -> transform(filter(transform(split({b}, ';'), i -> split(i, ':')), v -> u[0] = v[0] AND u[0] <> 'x'), v -> {share})))"
    return f"CASE WHEN {a} = {b} THEN 1D ELSE coalesce(get({levels}, 0), 0D) END"


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", chunk_rows: int = CHUNK_ROWS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Fingerprints of whole texts, of edited texts, and how alike they are.

    Returns `(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)` for
    each row of `docs`. The edited text has its last n_chars / 4 code points replaced by the first as many
    (or all) of the next document in id order; the last row's next is the first. A null text is empty;
    texts without terms of the lexicon only match equal texts. Rows of one id are ordered by text. An
    empty table gives no rows; null ids come first. Ids are numbers: others raise TypeError, as ranges of
    them are cut at quantiles.
    """
    if not isinstance(docs.schema[id_column].dataType, T.NumericType):
        raise TypeError(f"fingerprints need numeric ids, not {docs.schema[id_column].dataType.simpleString()}")
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    terms_kept = cut(lexicon(base))
    few = terms_kept.count() <= broadcast_terms
    dealt = base.withColumn("chunk", chunk_of(base, chunk_rows))
    firsts = cut(dealt.groupBy("chunk").agg(F.min(F.struct("id", "text")).alias("r")).select("chunk", "r.id", "r.text"))
    order = Window.orderBy("chunk")  # one row for each chunk
    previous = firsts.select("chunk", F.coalesce(F.lag("chunk").over(order), F.max("chunk").over(Window.partitionBy())).alias("to"))
    ghosts = firsts.join(previous, "chunk").select("id", "text", F.col("to").alias("chunk"), F.lit(1).alias("ghost"))
    rows = dealt.select("id", "text", "chunk", F.lit(0).alias("ghost")).unionAll(ghosts)
    by_id = Window.partitionBy("chunk").orderBy("ghost", "id", "text")
    rows = rows.select("*", F.row_number().over(by_id).alias("rn"), F.lead("text").over(by_id).alias("next"))
    cut_at = "char_length(text) - char_length(text) div 4"
    rows = rows.selectExpr("chunk", "rn", "ghost", "id", "text", f"concat(left(text, CAST({cut_at} AS int)), left(coalesce(next, ''), CAST(char_length(text) div 4 AS int))) AS edited")
    mark = F.lit("\x01")
    sides = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.array(F.concat(mark, F.sha2(c, 256))), terms(F.col(c))).alias("w")) for k, c in enumerate(("text", "edited"))])
    side = rows.select("chunk", "rn", "ghost", "id", F.char_length("text").cast("long").alias("n_chars"), F.explode(sides).alias("side"))
    each = side.select("chunk", "rn", "ghost", "id", "n_chars", "side.kind", F.explode("side.w").alias("w"))
    each = each.select("chunk", "rn", "ghost", "id", "n_chars", "kind", F.when(F.col("w").startswith(mark), F.substring("w", 2, 64)).alias("sha"), F.when(~F.col("w").startswith(mark), F.xxhash64("w")).alias("term"))
    lex = terms_kept.withColumn("known", F.lit(True))
    kept = each.join(F.broadcast(lex) if few else lex, "term", "left").where("sha IS NOT NULL OR known")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("term"))))
    sha = lambda k: F.max(F.when(F.col("kind") == k, F.col("sha")))
    gathered = kept.groupBy("chunk", "rn").agg(F.max("ghost").alias("ghost"), F.max("id").alias("id"), F.max("n_chars").alias("n_chars"), sha(0).alias("sha"), sha(1).alias("edited_sha256"), of(0).alias("t0"), of(1).alias("t1"))
    made = gathered.select("chunk", "rn", "ghost", "id", "n_chars", "edited_sha256", F.expr(fingerprint_sql("t0", "sha")).alias("fingerprint"), F.expr(fingerprint_sql("t1", "edited_sha256")).alias("edited_fingerprint"))
    ahead = made.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("chunk").orderBy("rn"))).where("ghost = 0")
    return ahead.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.expr(likeness_sql("fingerprint", "edited_fingerprint")).alias("near_edited"), F.expr(likeness_sql("fingerprint", "next_fingerprint")).alias("near_next"))


def chunk_of(docs: DataFrame, chunk_rows: int) -> Column:
    """Number of the range of ids that a row falls in; about `chunk_rows` rows each.

    Range bounds are approximate quantiles; they are searched as a tree of FAN-way nodes.
    """
    n = docs.count()
    chunks = int(min(FAN**3, max(1, -(-n // chunk_rows))))
    if chunks == 1:
        return F.lit(0)
    cuts = docs.approxQuantile("id", [i / chunks for i in range(1, chunks)], 1 / (4 * chunks))
    cuts = sorted({int(c) for c in cuts})

    def below(bounds: list[int]) -> str:
        return f"size(filter(array({', '.join(f'{b}L' for b in bounds)}), b -> b <= id))"

    def tree(bounds: list[int], base: int) -> str:
        if len(bounds) < FAN:
            return f"({base} + {below(bounds)})"
        step = -(-len(bounds) // FAN)
        groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        inner = [tree(g[1:], base + i * step + 1) if len(g) > 1 else str(base + i * step + 1) for i, g in enumerate(groups)]
        cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(inner, 1))
        return f"(CASE {below([g[0] for g in groups])} WHEN 0 THEN {base} {cases} END)"

    return F.expr(f"CASE WHEN id IS NULL THEN 0 ELSE {tree(cuts, 0)} END")
