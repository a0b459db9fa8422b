"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing, in bounded tasks and levels."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from camtrail.scale import broadcast_if_small, cut_lineage

SHARDS = 24
OVERHEAD = 8
# Partial partitions that one task differences.
NODES = 8192
# Rows of one numbering window.
WINDOW_ROWS = 20_000


def difference(sums: np.ndarray) -> np.ndarray:
    """Place of each part: ``sums`` is (nodes, k), the result gives for node i and its part j the final part 0..k-1.

    The two partial partitions with the largest spread are combined, largest part with smallest, until one is left.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    held = list(np.take_along_axis(sums, order, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(held)]
    heapq.heapify(heap)
    children, moves = [], []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = held[a] + held[b][::-1]
        to = np.argsort(-total, kind="stable")
        back = np.empty(k, np.int64)
        back[to] = np.arange(k)
        total = total[to]
        held[a] = held[b] = None
        held.append(total)
        children.append((a, b))
        moves.append(back)
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(held) - 1))
    final: list = [None] * len(held)
    final[-1] = np.arange(k)
    for node in range(len(held) - 1, n - 1, -1):
        a, b = children[node - n]
        final[a] = final[node][moves[node - n]]
        final[b] = final[node][moves[node - n][::-1]]
        final[node] = None
    place = np.empty((n, k), np.int64)
    np.put_along_axis(place, order, np.stack(final[:n]), axis=1)
    return place


def _parts(items: DataFrame, k: int, bucket) -> DataFrame:
    """(item, size, bucket, part): each bucket of (item, size) differenced on its own."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(pdf), k), np.int64)
        sums[:, 0] = pdf["size"]
        return pdf.assign(part=difference(sums)[:, 0])

    bucketed = items.select("item", "size", bucket.cast("long").alias("bucket"))
    return bucketed.groupBy("bucket").applyInPandas(solve, "item string, size long, bucket long, part int")


def balance(groups: DataFrame, k: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """(gkey, shard) for ``groups`` (gkey string, size long), sums of sizes as near equal as differencing makes them.

    Up to ``nodes`` groups are differenced at once. More are first differenced in buckets by hash, whose parts become the items of the next level, until
    about ``nodes`` are left. A group above 1/``nodes`` of all bytes (there are fewer than ``nodes``) waits for the last level, where the parts even it out.
    No task holds many more than 2 * ``nodes`` items, and only counts pass through the driver.
    """
    n, total = groups.agg(F.count(F.lit(1)), F.sum("size")).first()
    items = groups.select(F.col("gkey").alias("item"), "size")
    if n <= nodes:
        return _parts(items, k, F.lit(0)).select(F.col("item").alias("gkey"), F.col("part").alias("shard"))
    large = F.col("size") > total // nodes
    waiting, items, steps, level = items.filter(large), items.filter(~large), [], 0
    while True:
        buckets = max(-(-n // nodes), max(1, nodes // k))
        step = cut_lineage(
            _parts(items, k, F.pmod(F.xxhash64("item", F.lit(level)), F.lit(buckets))).select(
                "item", "size", F.concat_ws(":", F.lit(f"b{level}"), "bucket", "part").alias("into")
            )
        )
        steps.append(step.select("item", "into"))
        items = step.groupBy(F.col("into").alias("item")).agg(F.sum("size").alias("size"))
        if buckets == max(1, nodes // k):
            break
        n, level = buckets * k, level + 1
    out = _parts(items.unionByName(waiting), k, F.lit(0)).select("item", F.col("part").alias("shard"))
    out = cut_lineage(out)
    done = out.join(waiting.select("item"), "item", "left_semi").select(F.col("item").alias("gkey"), "shard")
    for step in reversed(steps):
        out = step.join(broadcast_if_small(out.withColumnRenamed("item", "into")), "into").select("item", "shard")
    return out.select(F.col("item").alias("gkey"), "shard").unionByName(done)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", overhead: int = OVERHEAD, nodes: int = NODES
) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot; rows of equal text share a shard and shard sizes are near equal in bytes.

    size is the UTF-8 length of the text (null: 0) plus ``overhead``; crc32 of a null text is 0, that of no bytes. All null texts are one group, apart
    from empty ones. Groups are known by the text's MD5 and are summed before the shuffle, so a group of copies is one row however large it is; rows meet their
    group's shard in a join that Spark splits where it is skewed. A group larger than a fair share makes its shard that large: groups are never cut.
    Slots run from 0 without gaps in each shard: rows are numbered in windows of bounded size, which get offsets from a table of counts.
    An empty table gives no rows; repeated rows get slots of their own. Columns of ``docs`` named like a new one are replaced.
    """
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    body = F.col(text).cast("binary")
    rows = docs.withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long"),
        "text_crc32": F.coalesce(F.crc32(body), F.lit(0)).cast("long"),
        "_gkey": F.coalesce(F.md5(body), F.lit("null")),
    })
    groups = rows.groupBy(F.col("_gkey").alias("gkey")).agg(F.sum("size").alias("size"))
    placed = cut_lineage(balance(groups, shards, nodes).withColumnRenamed("gkey", "_gkey"))
    parts = -(-docs.count() // (shards * WINDOW_ROWS)) or 1
    rows = rows.join(placed, "_gkey").withColumn("_part", F.pmod(F.xxhash64(doc_id, "_gkey"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut_lineage(counts.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_before")))
    number = F.row_number().over(W.partitionBy("shard", "_part").orderBy(doc_id, "_gkey")) - 1
    out = rows.withColumn("_at", number).join(broadcast_if_small(offsets), ["shard", "_part"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, "size", "text_crc32", "shard", (F.col("_at") + F.col("_before")).cast("long").alias("slot"))
