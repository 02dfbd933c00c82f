"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Every group (equal texts) starts as a partial partition (its size, 0, ..., 0); the two partial
partitions with the largest spread are combined, the heaviest part of one with the lightest of the
other, until one is left. Beyond a bounded number of groups this happens in many buckets at once,
whose parts are the groups of the next level. Of every level some groups are held back for the last
one, so that this has small change of all sizes to even out what the large parts leave. Rows get
their shard by a join, so no group's rows are gathered anywhere.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inundata.llm.text import cut, shuffle_width


@dataclass(frozen=True)
class ShardParams:
    shards: int = 24
    #: Partial partitions that one task combines, about.
    fan: int = 100_000
    #: Groups of a level that are held back for the last one, about.
    change: int = 15_000
    #: Buckets of a level that is not the last, at least: more of them make finer bundles.
    least_buckets: int = 128
    #: Bytes that each row costs beside its text.
    row_bytes: int = 8


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine m partial partitions (an m x k array of sums) into one.

    Returns the k sums of the result, in descending order, and an m x k array that tells where
    each part of each input went. Ties go by input order.
    """
    m, k = parts.shape
    order0 = np.argsort(-parts, axis=1, kind="stable")
    sums: list[np.ndarray | None] = list(np.take_along_axis(parts, order0, axis=1))
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        made.append((a, b, order))
        sums[a] = sums[b] = None
        merged = merged[order]
        sums.append(merged)
        heapq.heappush(heap, (-int(merged[0] - merged[-1]), len(sums) - 1))
    root = len(sums) - 1
    place: list[np.ndarray | None] = [None] * len(sums)
    place[root] = np.arange(k)
    for node in range(root, m - 1, -1):
        a, b, order = made[node - m]
        of_order = np.empty(k, dtype=np.int64)
        of_order[order] = place[node]
        place[a], place[b], place[node] = of_order, of_order[::-1], None
    out = np.empty((m, k), dtype=np.int64)
    for i in range(m):
        out[i, order0[i]] = place[i]
    return sums[root], out


def _dealt(items: DataFrame, buckets: int, k: int) -> DataFrame:
    """node, bytes -> node, bytes, bucket, part: each bucket's items differenced into k parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "node"], ascending=[False, True], kind="stable")
        parts = np.zeros((len(pdf), k), dtype=np.int64)
        parts[:, 0] = pdf["bytes"]
        _, places = difference(parts)
        return pdf.assign(part=places[:, 0])[["node", "bytes", "bucket", "part"]]

    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandas(run, "node string, bytes long, bucket long, part int")


def shard_groups(groups: DataFrame, rows: int, p: ShardParams = ShardParams()) -> DataFrame:
    """node, shard: ``groups`` (node string, bytes long; one row each) dealt to the shards.

    ``rows`` is the number of groups. While there are more items than one task may combine, each
    bucket's items become k bundles, which are the items of the next level. Groups of more than
    1/100 of a fair share (at most 100 times the number of shards) are not bundled, and neither are
    ``change`` items of each level, chosen by hash: they wait for the last level, where all that is
    left is differenced at once. So that evens out with items of every size, down to single groups.
    """
    k, levels, items, waiting = p.shards, [], groups, None
    if rows > p.fan:
        if p.least_buckets * k > p.fan:
            raise ValueError("fan must be at least least_buckets * shards")
        total = groups.agg(F.sum("bytes")).first()[0]
        is_heavy = F.col("bytes") * 100 * k >= F.lit(total)
        waiting, items = groups.where(is_heavy), groups.where(~is_heavy)
    while rows > p.fan:
        buckets = max(p.least_buckets, -(-rows // p.fan))
        held = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(rows)) < p.change
        waiting, items = waiting.unionByName(items.where(held)), items.where(~held)
        level = cut(_dealt(items, buckets, k).withColumn("bundle", F.concat_ws(":", F.lit(len(levels)), "bucket", "part")))
        levels.append(level.select("node", "bundle"))
        items, rows = level.groupBy(F.col("bundle").alias("node")).agg(F.sum("bytes").alias("bytes")), buckets * k
    last = _dealt(items if waiting is None else items.unionByName(waiting), 1, k).select("node", F.col("part").alias("shard"))
    if not levels:
        return last
    known = cut(last)
    for level in reversed(levels):
        known = known.unionByName(level.join(known.withColumnRenamed("node", "bundle"), "bundle").select("node", "shard"))
    return known.join(groups.select("node"), "node")  # without the bundles


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: ShardParams = ShardParams()) -> DataFrame:
    """``row`` (input columns but the text), ``size``, ``text_crc32``, ``shard``, ``slot``.

    A document's size is its text's UTF-8 bytes (null: none) plus the row's own; documents of
    equal text are one group and share a shard. Null texts are a group of their own. Slots run
    from 0 without gaps in each shard, ordered by hashed id within salted parts. Reruns agree.
    Repeated rows get a slot each; groups of one size are ordered by their hash. A very long text is
    one group that no shard can halve. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text]
    whole = F.coalesce(docs[text], F.lit(""))
    sized = cut(
        docs.select(
            F.struct(*[docs[c] for c in others]).alias("row"),
            docs[id_col].alias("id"),
            F.coalesce(F.sha2(docs[text], 256), F.lit("none")).alias("node"),
            (F.octet_length(whole) + p.row_bytes).cast("long").alias("size"),
            F.crc32(whole).alias("text_crc32"),
        )
    )
    groups = cut(sized.groupBy("node").agg(F.sum("size").alias("bytes")))
    dealt = shard_groups(groups, groups.count(), p)
    salts = shuffle_width(spark)
    joined = sized.join(dealt, "node").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    counts = joined.groupBy("shard", "salt").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skip"))
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("id", "node")))
    return ranked.join(offsets, ["shard", "salt"]).select(
        "row", "size", "text_crc32", "shard", (F.col("skip") + F.col("rank") - 1).cast("long").alias("slot")
    )
