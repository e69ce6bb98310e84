"""Near-duplicate join: exact Jaccard over distinct word shingles by universe partition.

A document is its set of shingles (5 words each). The universe of shingle hashes is cut into m
segments; two sets that differ in at most H shingles agree on at least one of H + 1 segments. m depends
on the size band: bands grow by the inverse of the threshold, so a set meets partners in its own band
and the one below. A segment's subset has an additive hash, which also gives the hashes of its
one-deletion neighbourhood.

Each document allocates weights to its segments at least cost until they add up to H + 1: 0 (not
probed), 1 (equal subsets) or 2 (subsets one deletion apart). Empty segments carry nothing. Subsets with
more rare shingles are cheaper; those all of whose shingles are frequent come last. All non-empty segments
are indexed; deletions are indexed by documents that equal subsets alone do not serve, because a pair with
one document that is served is found by that one.

Documents made of frequent shingles mostly can run out of weights. Either such a pair shares a rare
shingle: those are signatures of their own then. Or all rare shingles of both differ, so their number
is H at most: frequent subsets are probed too, but only yield pairs of which that holds, as does one
signature of the band for what no weights can serve. So no link is lost, and what is common to many
documents does not make pairs of them.

Equal sets are found first by their keys, and one document of each class goes on. Signatures travel packed:
one binary row for each block of documents and bucket, with ids as byte planes of differences. A bucket yields
runs of documents with a common signature, each once: runs of two as pairs, longer ones as such, not as their pairs.
First every document is verified against the mate it shares most signatures with; components of these links shrink
the runs. In large runs that still hold several components, one member after another of the largest is tried with those of
others, which shrinks a group of near copies of which only a part are links to about as many pairs as members; only
what is then left of different components is paired.
Each set has a parity sketch: at least as many bits as shingles, each the parity of the shingles that fall on it.
Two sketches, the longer one folded, differ in at most as many bits as the sets do in shingles, so pairs with more
differing bits than a link allows are left out of verification, and no link is.
Verification recomputes shingle sets and is exact up to 64-bit hashes. Each document meets its partner's text
in chunks of CHUNK partners, so a document with very many is compared by many tasks, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import Words, ascii_fold, blocks, mix, not_space, splitmix, utf8
from isoloom.operators.graph import connected_components
from isoloom.session import stored

SHINGLE = 5
THRESHOLD = 75
#: Shingles held by a map task at once, and signatures of a bucket on average.
FLUSH, BUCKET = 1_000_000, 600_000
#: A shingle is frequent from this share of the distinct sets on, and at least so many.
FREQUENT, FREQUENT_LEAST = 0.005, 64
PROBE, OWN, HOT = 1, 2, 4
#: 64-bit words of the least parity sketch.
SKETCH = 8
#: Partners of a document that are compared with one copy of its text.
CHUNK = 64
#: In runs of LARGE members and more, members of other components are tried with one member after another of the largest
#: component, ROUNDS of them at most, before what is left is paired.
LARGE, ROUNDS = 128, 3
#: Sets whose signatures are made at once.
SETS = 64
#: Up to so many rows (24 bytes each at most) are broadcast to pick texts; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_WORDS = splitmix(64, 4242)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; one shingle if there are fewer words, none without."""
    words = Words(raw, offsets, not_space(), ascii_fold())
    h, out = words.hash, []
    with np.errstate(over="ignore"):
        n = len(h) - width + 1
        rolled = mix(sum(h[i : n + i] * _WORDS[i] for i in range(width))) if n > 0 else np.zeros(0, np.uint64)
        for first, count in zip(words.first.tolist(), words.count.tolist()):
            if count >= width:
                s = np.sort(rolled[first : first + count - width + 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            elif count:
                short = (h[first : first + count] * _WORDS[width : width + count]).sum(dtype=np.uint64) + np.uint64(count)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit key, as two signed longs."""
    with np.errstate(over="ignore"):
        a = mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Signed longs: for each bit, whether an odd number of shingles falls on it.

    SKETCH words, doubled until there are as many bits as shingles. The halves of a sketch, one xor the
    other, are the next shorter sketch.
    """
    bits = 64 * SKETCH
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Bytes of the values by place, all first bytes first; small numbers then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def differ(total: int, t: int = THRESHOLD) -> int:
    """Shingles in which two sets of `total` elements together may differ."""
    return total * (100 - t) // (100 + t)


@lru_cache(maxsize=None)
def bands(t: int, size: int) -> list[tuple[int, int]]:
    """Least and largest set size of each band, up to one that holds `size`."""
    out, lo = [], 1
    while not out or out[-1][1] < size:
        hi = max(lo, lo * 100 // t)
        out.append((lo, hi))
        lo = hi + 1
    return out


@lru_cache(maxsize=4096)
def edges_of(m: int) -> np.ndarray:
    """Where the m segments of the hash space begin."""
    return np.array([-(-(j << 64) // m) for j in range(1, m)], np.uint64)


def segments(hi: int, t: int) -> int:
    h = differ(hi + hi * 100 // t, t)
    return h + 1 + ((h + 1) // 5 + 1 if h else 0)


def signatures(s: np.ndarray, band: int, hi: int, small: int, large: int, own: bool, frequent: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set under a band's scheme, with flags.

    `large` is the size of its largest partner that is not larger than it, `small` that of its largest
    partner; as the larger of a pair it must serve the former, as the smaller it may leave the pair to
    its partner if it indexes deletions. Subsets without two rare shingles get no deletions: what a
    deletion leaves would be as frequent as what it is made of.
    """
    m, need = segments(hi, t), differ(len(s) + large, t) + 1
    alone = differ(len(s) + small, t) + 1
    at = np.concatenate([[0], np.searchsorted(s, edges_of(m)), [len(s)]])
    size = np.diff(at)
    full = np.flatnonzero(size)
    with np.errstate(over="ignore"):
        value = mix(s ^ np.uint64(0x0F0F0F0F33333333))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        sums = total[at[1:]] - total[at[:-1]]
        salt = mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
        exact = mix(sums[full] + salt[full])
        rare = size[full]
        if len(frequent):
            spot = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
            so_far = np.concatenate([[0], np.cumsum(frequent[spot] != s)])
            rare = so_far[at[full + 1]] - so_far[at[full]]
        flags = np.full(len(full), OWN * own, np.uint8)
        by_cost = np.lexsort((-size[full], -rare))
        cold = int((rare > 0).sum())
        flags[rare == 0] |= HOT
        if cold >= alone:
            flags[by_cost[:alone]] |= PROBE
            return exact, flags
        flags[by_cost[: min(need, cold)]] |= PROBE
        wide = np.flatnonzero(rare > 1)
        lack = max(0, need - cold)
        upgraded = wide[np.argsort(-rare[wide], kind="stable")[:lack]]
        lack -= len(upgraded)
        if lack > 0:
            flags[by_cost[cold : cold + lack]] |= PROBE
        mark = np.zeros(m, np.uint8)
        mark[full[wide]] = 4 | OWN * own
        mark[full[upgraded]] |= PROBE
        of_token = np.repeat(mark, size)
        pick = of_token > 0
        segment = np.repeat(np.arange(m), size)[pick]
        deleted = mix(sums[segment] - value[pick] + salt[segment])
        single = mix((s[frequent[spot] != s] if len(frequent) else s) + np.uint64(band + 1))
        out, marks = [exact, deleted, single], [flags, of_token[pick] & np.uint8(PROBE | OWN), np.full(len(single), OWN * own | PROBE * (lack > 0), np.uint8)]
        if lack > len(full) - cold:
            out.append(mix(np.array([band], np.uint64) ^ np.uint64(0x7777777777777777)))
            marks.append(np.full(1, PROBE | HOT | OWN * own, np.uint8))
    return np.concatenate(out), np.concatenate(marks)


def all_signatures(s: np.ndarray, frequent: np.ndarray, t: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures under the set's own band and, if a partner can be there, the band below; rare shingles."""
    known = bands(t, 1 << 26)
    b = _band(t, len(s))
    parts = [signatures(s, b, known[b][1], len(s) * 100 // t, len(s), True, frequent, t)]
    if b and known[b - 1][1] * 100 >= t * len(s):
        parts.append(signatures(s, b - 1, known[b - 1][1], known[b - 1][1], known[b - 1][1], False, frequent, t))
    rare = len(s) - np.isin(s, frequent, assume_unique=True).sum() if len(frequent) else len(s)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), int(rare)


@lru_cache(maxsize=8)
def _tops(t: int) -> np.ndarray:
    return np.array([hi for _, hi in bands(t, 1 << 26)])


def _band(t: int, size: int) -> int:
    return int(np.searchsorted(_tops(t), size))


def _distinct(batches: Iterable[pa.RecordBatch], id_column: str, text: str, width: int) -> Iterator[tuple[list[int], list[np.ndarray], list[tuple[int, int]], list[tuple[int, int, tuple[int, int]]]]]:
    """Flushes: smallest id, set and key of each distinct set so far, and (id, size, key) of each row."""
    ids: list[int] = []
    sets: list[np.ndarray] = []
    keys: dict[tuple[int, int], int] = {}
    rows: list[tuple[int, int, tuple[int, int]]] = []
    held = 0
    for batch in blocks(batches, text, 1 << 20):
        found = shingle_sets(*utf8(batch.column(batch.schema.get_field_index(text))), width)
        for i, s in zip(batch.column(batch.schema.get_field_index(id_column)).to_pylist(), found):
            key = set_key(s)
            rows.append((i, len(s), key))
            if not len(s) or i is None:
                continue
            at = keys.get(key)
            if at is None:
                keys[key] = len(ids)
                ids.append(i)
                sets.append(s)
                held += len(s)
            else:
                ids[at] = min(ids[at], i)
        if held >= FLUSH:
            yield ids, sets, list(keys), rows
            ids, sets, keys, rows, held = [], [], {}, [], 0
    if rows:
        yield ids, sets, list(keys), rows


def describe(docs: DataFrame, width: int) -> DataFrame:
    """`(kind, id, n, k1, k2, sketch)`: kind 0, a row's id, set size, set key and, for the smallest id of a set in
    a flush, sketch; kind 1, in k1 a shingle that n distinct sets of a flush have."""
    names = ["kind", "id", "n", "k1", "k2", "sketch"]
    sketch = pa.list_(pa.int64())

    def batch(kind: int, ids: list, n: np.ndarray, k1: np.ndarray, k2: np.ndarray, sketches: list) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(ids), kind, np.int8)), *(pa.array(c, pa.int64()) for c in (ids, n, k1, k2)), pa.array(sketches, sketch)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, _, rows in _distinct(batches, "id", "text", width):
            of = {i: parity_sketch(s) for i, s in zip(ids, sets)}
            key = np.array([r[2] for r in rows], np.int64)
            yield batch(0, [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), key[:, 0], key[:, 1], [of.pop(r[0], None) for r in rows])
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = counts >= max(4, FREQUENT * len(sets))
            zero = np.zeros(int(keep.sum()), np.int64)
            yield batch(1, zero, counts[keep], values[keep].astype(np.int64), zero, [None] * len(zero))

    return docs.mapInArrow(run, "kind byte, id long, n long, k1 long, k2 long, sketch array<long>")


def pack(docs: DataFrame, width: int, t: int, bits: int, frequent: np.ndarray) -> DataFrame:
    """Signatures of distinct sets, packed by flush and bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # 2 * mean set size / FREQUENT entries at most
    names = ["bucket", "ids", "common", "counts", "signs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, _, _ in _distinct(batches, "id", "text", width):
            if not sets:
                continue
            common = np.zeros(len(sets), np.int32)
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at in range(0, len(sets), SETS):
                made = [all_signatures(s, shared.value, t) for s in sets[at : at + SETS]]
                common[at : at + SETS] = [len(s) - x[2] for s, x in zip(sets[at : at + SETS], made)]
                sign, flags = np.concatenate([x[0] for x in made]), np.concatenate([x[1] for x in made])
                bucket = (sign >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(sign), np.int32)
                low = ((sign >> np.uint64(35 - bits)) & np.uint64((1 << 29) - 1)).astype(np.uint32) << np.uint32(3) | flags
                parts.append((bucket, low, np.repeat(np.arange(at, at + len(made), dtype=np.int32), [len(x[0]) for x in made])))
            all_ids = np.array(ids, np.int64)
            del sets, made
            bucket = np.concatenate([x[0] for x in parts])
            order = np.argsort(bucket, kind="stable").astype(np.int32)
            bucket = bucket[order]
            low, owner = (np.concatenate([x[i] for x in parts])[order] for i in (1, 2))
            del parts, order
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            columns: list[list] = [[] for _ in names]
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = owner[b:e]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                docs_here = own[starts]
                for c, v in zip(columns, (int(bucket[b]), planes(np.diff(all_ids[docs_here], prepend=0)), planes(common[docs_here]), planes(np.diff(np.append(starts, e - b)).astype(np.int32)), low[b:e].tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

    return docs.mapInArrow(run, "bucket int, ids binary, common binary, counts binary, signs binary")


RUNS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_()), ("docs", pa.list_(pa.int64())), ("common", pa.list_(pa.int32())), ("flags", pa.list_(pa.int8())), ("n", pa.int64())])
RUNS_SQL = "a long, b long, hot boolean, docs array<long>, common array<int>, flags array<byte>, n long"


def bucket_runs(bucket: pa.Table) -> pa.Table:
    """Runs of a bucket: documents with a common signature, by id, each run once with its count.

    A run of two, unless of a frequent subset, has its documents as `a` and `b`, others have arrays.
    """
    get = lambda c: bucket.column(c).to_pylist()
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    ids = join([np.cumsum(unplanes(x, np.int64)) for x in get("ids")], np.int64)
    common, counts = (join([unplanes(x, np.int32) for x in get(c)], np.int32) for c in ("common", "counts"))
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    signs = join([np.frombuffer(x, np.uint32) for x in get("signs")], np.uint32)
    value = signs >> np.uint32(3)
    order = np.argsort(value, kind="stable")
    value, owner, flags = value[order], owner[order], (signs & np.uint32(7)).astype(np.int8)[order]
    begin = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(value))
    any_flag = np.bitwise_or.reduceat(flags, begin) if len(begin) else np.zeros(0, np.int8)
    many = (end - begin > 1) & (any_flag & (PROBE | OWN) == PROBE | OWN)
    pairs: dict[tuple[int, int], int] = {}
    found: dict[tuple, int] = {}
    for b, e in zip(begin[many].tolist(), end[many].tolist()):
        members: dict[int, list[int]] = {}
        hot = bool((flags[b:e] & HOT).any())
        for o, f in zip(owner[b:e].tolist(), flags[b:e].tolist()):
            if (m := members.get(k := int(ids[o]))) is None:
                members[k] = [k, int(common[o]), f & (PROBE | OWN)]
            else:
                m[2] |= f & (PROBE | OWN)
        if len(members) == 2 and not hot:
            x, y = sorted(members)
            pairs[x, y] = pairs.get((x, y), 0) + 1
        elif len(members) > 1:
            run = (hot, *sorted(map(tuple, members.values())))
            found[run] = found.get(run, 0) + 1
    part = lambda i: [None] * len(pairs) + [[r[i] for r in k[1:]] for k in found]
    no = [None] * len(found)
    columns = [[k[0] for k in pairs] + no, [k[1] for k in pairs] + no, [False] * len(pairs) + [k[0] for k in found], part(0), part(1), part(2), [*pairs.values(), *found.values()]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS)], schema=RUNS)


def alike(x: str, y: str, t: int) -> str:
    """SQL: whether two sketches differ in no more bits than linked sets of these sizes can."""
    fold = lambda p, q: f"IF(size({p}.sketch) > size({q}.sketch), zip_with(slice({p}.sketch, 1, size({q}.sketch)), slice({p}.sketch, size({q}.sketch) + 1, size({q}.sketch)), (u, v) -> u ^ v), {p}.sketch)"
    return f"aggregate(zip_with({fold(x, y)}, {fold(y, x)}, (u, v) -> bit_count(u ^ v)), 0, (s, v) -> s + v) <= ({x}.size + {y}.size) * {100 - t} div {100 + t}"


def can_link(x: str, y: str, t: int) -> str:
    """SQL: whether sizes (and in a run of a frequent subset, rare shingles) let two members link.

    Without a common rare shingle they differ in all of those, and in frequent ones by count at least.
    """
    return f"least({x}.size, {y}.size) * 100 >= greatest({x}.size, {y}.size) * {t} AND (NOT hot OR {x}.size - {x}.common + {y}.size - {y}.common + abs({x}.common - {y}.common) <= ({x}.size + {y}.size) * {100 - t} div {100 + t})"


def _picked(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """`docs` joined by id with rows that are counted first: broadcast if few."""
    few = rows.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rows) if few else rows, "id", how)


def verify(pairs: DataFrame, docs: DataFrame, width: int, t: int) -> DataFrame:
    """The pairs `(a, b)` whose whole texts' shingle sets have a Jaccard similarity of t % or more.

    Partners `b` of a document `a` are dealt to chunks of about CHUNK; each chunk gets the text of `a`, then
    those of its partners, and holds two shingle sets at a time.
    """
    busy = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    dealt = pairs.join(busy, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)), F.lit(0)).alias("chunk"))
    partners = dealt.select(F.col("b").alias("id"), "a", "chunk", F.lit(1).cast("byte").alias("role"))
    centres = dealt.select(F.col("a").alias("id"), "a", "chunk", F.lit(0).cast("byte").alias("role")).distinct()
    texts = _picked(docs, stored(partners.unionAll(centres), "join-dealt"), "inner")
    ready = texts.select("a", "chunk", "role", "id", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, group = np.zeros(0, np.uint64), None
        for batch in blocks(batches, "text", 1 << 20):
            found: list[tuple[int, int]] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (a, chunk, role, b), s in zip(keys, shingle_sets(*utf8(batch.column(4)), width)):
                if role == 0:
                    centre, group = s, (a, chunk)
                elif group == (a, chunk) and len(s) and len(centre):
                    small, large = (s, centre) if len(s) < len(centre) else (centre, s)
                    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * common >= t * (len(s) + len(centre) - common):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return ready.mapInArrow(run, "a long, b long")


def placed(member: DataFrame, component: DataFrame) -> DataFrame:
    """Members `doc` of runs with their component, their own number where they have no link."""
    return member.join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def torn(member: DataFrame) -> DataFrame:
    """The members of runs that hold more than one component."""
    split = member.groupBy("r1", "r2").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("r1", "r2")
    return member.join(split, ["r1", "r2"], "left_semi")


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """`(node, component)` with the components that further links join made one."""
    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = stored(connected_components(lifted), "join-above")
    up = above.select(F.col("node").alias("component"), F.col("component").alias("top"))
    raised = component.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return stored(raised.unionByName(above.join(component, "node", "left_anti")), "join-components")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """`(id, n_shingles, component_id)`, one row for each row of `docs`.

    component_id is the smallest id reachable by links, the row's own included. Rows without words
    have no shingles and are linked with nothing; rows without an id are linked with nothing and have no
    component. Ids are whole numbers and name one text; rows that repeat an id and text stay and share
    their component. An empty table gives no rows.
    """
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    told = stored(describe(base, width), "join-sets")
    rows = told.where("kind = 0")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    frequent = told.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(FREQUENT_LEAST, FREQUENT / 2 * counts["n"]))
    hot = np.sort(np.array([r["k1"] for r in frequent.select("k1").collect()], np.int64).astype(np.uint64))
    whole = rows.where("n > 0 AND id IS NOT NULL").select("id", "n", "k1", "k2")
    classes = stored(whole.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "join-classes")
    copied = classes.where("copies > 1").select("k1", "k2", "node")
    spare = stored(whole.join(copied, ["k1", "k2"]).where("id <> node").select("id").distinct(), "join-spare")
    sketches = rows.where("sketch IS NOT NULL").select(F.col("id").alias("doc"), F.col("n").cast("int").alias("size"), "sketch").dropDuplicates(["doc"])

    bits = min(26, max(5, int(np.ceil(np.log2(max(1.0, 0.7 * counts["shingles"] / BUCKET))))))
    packed = pack(_picked(base, spare, "left_anti"), width, threshold, bits, hot)
    found = stored(packed.groupBy("bucket").applyInArrow(bucket_runs, RUNS_SQL), "join-found")
    runs = found.where("docs IS NOT NULL").groupBy(F.xxhash64("docs").alias("r1"), F.xxhash64(F.lit(3), F.col("docs"), F.col("flags"), F.col("hot")).alias("r2"))
    runs = stored(runs.agg(F.first(F.struct("hot", "docs", "common", "flags")).alias("run"), F.sum("n").alias("n")).select("r1", "r2", "n", "run.*"), "join-runs")
    stars = runs.select(F.col("docs")[0].alias("a"), F.col("common")[0].alias("ca"), "hot", "n", F.explode(F.arrays_zip("docs", "common")).alias("m"))
    stars = stars.select("a", F.col("m.docs").alias("b"), "n", "hot", "ca", F.col("m.common").alias("cb")).where("a <> b")
    pairs = found.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n")).select("a", "b", "n", F.lit(False).alias("hot"), F.lit(0).alias("ca"), F.lit(0).alias("cb"))
    mates = pairs.unionAll(stars).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("hot").alias("hot"), F.max("ca").alias("ca"), F.max("cb").alias("cb"))
    side = lambda d, c: F.struct(F.col("size").alias("size"), F.col("sketch").alias("sketch"), F.col(c).alias("common")).alias(d)
    mates = mates.join(sketches.withColumnRenamed("doc", "a"), "a").select("a", "b", "n", "hot", "cb", side("x", "ca"))
    mates = mates.join(sketches.withColumnRenamed("doc", "b"), "b").select("a", "b", "n", "hot", "x", side("y", "cb"))
    mates = stored(mates.where(f"{can_link('x', 'y', threshold)} AND {alike('x', 'y', threshold)}").select("a", "b", "n"), "join-mates")
    best = stored(mates.groupBy("b").agg(F.max_by("a", F.struct(F.col("n"), -F.col("a"))).alias("a")).select("a", "b"), "join-first")
    links = stored(verify(best, base, width, threshold), "join-links")
    component = stored(connected_components(links), "join-components")

    member = runs.select("r1", "r2", "hot", F.size("docs").alias("m"), F.explode(F.arrays_zip("docs", "common", "flags")).alias("e")).select("r1", "r2", "hot", "m", F.col("e.docs").alias("doc"), "e.common", F.col("e.flags").alias("flag"))
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    large = stored(torn(placed(member.where(F.col("m") >= LARGE), component)).join(sketches, "doc"), "join-large")
    entries = large.drop("component")
    for k in range(0 if large.isEmpty() else ROUNDS):
        parts = large.groupBy("r1", "r2", "component").agg(F.count("*").alias("n"), F.min_by(F.struct("doc", "component", "size", "common", "sketch"), F.xxhash64(F.lit(k), "doc")).alias("x"))
        x = parts.groupBy("r1", "r2").agg(F.max_by("x", F.struct("n", "component")).alias("x"))
        star = large.alias("y").join(x, ["r1", "r2"]).where(f"y.component <> x.component AND {can_link('x', 'y', threshold)} AND {alike('x', 'y', threshold)}")
        star = star.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
        star = stored(star.join(tried, ["a", "b"], "left_anti"), "join-star")
        links = stored(verify(star, base, width, threshold), "join-links")
        if links.isEmpty():
            break
        component = merged(component, links)
        large = placed(entries, component)
        tried = tried.unionAll(star)
    member = stored(torn(placed(member, component)).join(sketches, "doc"), "join-torn")

    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    apart = mates.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    one, two = member.alias("x"), member.drop("hot").alias("y")
    rule = F.expr(f"x.r1 = y.r1 AND x.r2 = y.r2 AND x.doc < y.doc AND x.component <> y.component AND ((x.flag | y.flag) & {PROBE | OWN}) = {PROBE | OWN} AND {can_link('x', 'y', threshold)} AND {alike('x', 'y', threshold)}")
    rest = apart.unionAll(one.join(two, rule).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))).distinct()
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "join-rest")
    if not rest.isEmpty():
        component = merged(component, verify(rest, base, width, threshold))

    classes = classes.join(component, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class"), "copies", "component").where("copies > 1 OR component IS NOT NULL").select("k1", "k2", "class")
    out = rows.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("k1")).alias("k1"), "k2").join(classes, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` that stand for their near-duplicate component: those with its smallest id.

    Rows without an id or without words are kept; of rows that repeat an id, all are.
    """
    found = near_duplicates(docs, text, id_column, width, threshold)
    gone = found.where(f"`{id_column}` <> component_id").select(id_column).distinct()
    return docs.join(gone, id_column, "left_anti").select(*[f"`{c}`" for c in docs.columns])
