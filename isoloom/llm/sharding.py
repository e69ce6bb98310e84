"""Sharding by Karmarkar-Karp differencing.

Documents of equal text form an indivisible group. Groups are dealt to buckets by hash; in each bucket
differencing turns them into a partition of k sums: the two partial partitions with the largest
spread are combined again and again, the largest part of one with the smallest of the other. The
buckets' partitions are then combined in the same way, on the driver: k sums for each bucket. Where there
are more buckets than a parameter allows, they are first combined in tasks, that many buckets' worth at most reaching
the driver.

Rows move twice, without their texts: counts by group (pre-aggregated where they are read), then
document ids to meet their group's shard; a group that holds many rows is split by skew-join handling.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoloom.session import stored

#: Groups of a bucket, on average, and the largest number of partitions that the driver combines.
BUCKET_GROUPS, MAX_BUCKETS = 20_000, 8192


def differencing(parts: Sequence[Sequence[int]]) -> list[list[int]]:
    """Combine partitions of k sums each. Returns, for each input, the final part of each of its sums.

    Ties are broken by input order, so the result is a function of the input.
    """
    if not parts:
        return []
    k = len(parts[0])
    heap = []
    left: list[int] = []  # binary tree of merges: children of each inner node
    right: list[int] = []
    leaves = len(parts)
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        falling = [sums[j] for j in order]
        heap.append((falling[-1] - falling[0], i, falling, order))
    perms: dict[int, list[int]] = {i: order for _, i, _, order in heap}
    heapq.heapify(heap)
    node = leaves
    while len(heap) > 1:
        _, a, x, _ = heapq.heappop(heap)
        _, b, y, _ = heapq.heappop(heap)
        sums = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        falling = [sums[j] for j in order]
        left.append(a)
        right.append(b)
        perms[node] = order
        heapq.heappush(heap, (falling[-1] - falling[0], node, falling, order))
        node += 1
    # walk down: part[j] of a node is the final part of its j-th largest sum
    final: dict[int, list[int]] = {heap[0][1]: list(range(k))}
    for inner in range(node - 1, leaves - 1, -1):
        part = final.pop(inner)
        by_sum = [0] * k
        for j, o in enumerate(perms[inner]):
            by_sum[o] = part[j]
        final[left[inner - leaves]] = by_sum
        final[right[inner - leaves]] = [by_sum[k - 1 - j] for j in range(k)]
    out = []
    for i in range(leaves):
        by_sum = [0] * k
        for j, o in enumerate(perms[i]):
            by_sum[o] = final[i][j]
        out.append(by_sum)
    return out


def split_sizes(sizes: Sequence[int], k: int) -> list[int]:
    """Part of each size by k-way differencing."""
    if k == 1:
        return [0] * len(sizes)
    return [p[0] for p in differencing([[int(s)] + [0] * (k - 1) for s in sizes])]


def shard(docs: DataFrame, n_shards: int = 16, text: str = "text", id_column: str = "doc_id", bucket_groups: int = BUCKET_GROUPS, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """`(id, size, text_crc32, shard, slot)` for every row of `docs`.

    Size is the text's UTF-8 bytes and 1; a null text is none and equals an empty one. Equal texts
    share a shard. Slots count the rows of a shard from 0, without gaps; rows that repeat get slots
    of their own. An empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("g1"), F.xxhash64(F.lit(17), whole).alias("g2"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    groups = stored(groups, "shard-groups")
    n_groups = groups.count()
    n_buckets = max(1, -(-n_groups // bucket_groups))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g1", "g2"], ascending=[False, True, True], kind="stable")
        return pd.DataFrame({"bucket": pdf["bucket"], "g1": pdf["g1"], "g2": pdf["g2"], "bytes": pdf["bytes"], "part": np.array(split_sizes(pdf["bytes"].tolist(), n_shards), np.int32)})

    bucketed = groups.withColumn("bucket", F.pmod(F.xxhash64("g2", "g1"), F.lit(n_buckets)).cast("int"))
    parts = stored(bucketed.groupBy("bucket").applyInPandas(local, "bucket int, g1 long, g2 long, bytes long, part int"), "shard-parts")
    mapping = combined(parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("n")), n_buckets, n_shards, max_buckets)
    few = n_buckets <= max_buckets
    placed = parts.join(F.broadcast(mapping) if few else mapping, ["bucket", "part"]).select("g1", "g2", "shard")
    dealt = rows.join(placed, ["g1", "g2"])
    return number_slots(dealt.select(id_column, "size", "text_crc32", "shard"), id_column)


def _table(rows: Iterable[tuple[int, int, int]], k: int) -> tuple[list[int], list[list[int]]]:
    """Buckets in order and the k sums of each, from `(bucket, part, sum)`."""
    sums: dict[int, list[int]] = {}
    for b, p, n in rows:
        sums.setdefault(b, [0] * k)[p] = n
    return sorted(sums), [sums[b] for b in sorted(sums)]


def combined(sums: DataFrame, n_buckets: int, k: int, max_buckets: int) -> DataFrame:
    """`(bucket, part, shard)`: where differencing of the buckets' sums `(bucket, part, n)` puts each part."""
    spark = sums.sparkSession
    if n_buckets <= max_buckets:
        buckets, each = _table([(r["bucket"], r["part"], r["n"]) for r in sums.collect()], k)  # n_buckets * k rows
        rows = [(b, p, s) for b, row in zip(buckets, differencing(each)) for p, s in enumerate(row)]
        return spark.createDataFrame(rows, "bucket int, part int, shard int")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        buckets, each = _table(pdf[["bucket", "part", "n"]].itertuples(index=False, name=None), k)
        rows = [(pdf["over"].iloc[0], b, p, m, row[p]) for b, row, final in zip(buckets, each, differencing(each)) for p, m in enumerate(final)]
        return pd.DataFrame(rows, columns=["over", "bucket", "part", "mid", "n"])

    n_over = -(-n_buckets // max_buckets)
    over = stored(sums.withColumn("over", F.pmod("bucket", F.lit(n_over))).groupBy("over").applyInPandas(merge, "over int, bucket int, part int, mid int, n long"), "shard-over")
    above = over.groupBy(F.col("over").alias("bucket"), F.col("mid").alias("part")).agg(F.sum("n").alias("n"))
    top = combined(above, n_over, k, max_buckets).select(F.col("bucket").alias("over"), F.col("part").alias("mid"), "shard")
    return over.join(top, ["over", "mid"]).select("bucket", "part", "shard")


def number_slots(rows: DataFrame, id_column: str) -> DataFrame:
    """Add `slot`: rows of each shard from 0. Counts by shard and chunk first, so no task sorts a shard."""
    rows = stored(rows.withColumn("chunk", F.pmod(F.xxhash64(id_column, "text_crc32"), F.lit(4096)).cast("int")), "shard-slots")
    per = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "chunk").orderBy(id_column, "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within))
    out = numbered.join(offsets, ["shard", "chunk"])
    return out.select(id_column, "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
