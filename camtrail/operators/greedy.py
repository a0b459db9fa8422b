"""Greedy selections: keep a row unless a better kept row conflicts with it.

Ordinary groups are folded in one JVM aggregate. A group with more than
``max_group`` rows is never gathered: it is resolved in distributed rounds that
give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from camtrail.functions import boxes
from camtrail.scale import broadcast_if_small, cut_lineage, floor_div, join_same, next_at_or_after, running_counts, split_hot

MAX_GROUP = 2_000


def ranks(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Struct fields that sort as ``order`` does in a window: a descending column from NaN down, nulls last."""
    out = []
    for i, (c, desc) in enumerate(order):
        if desc:
            out.append(F.col(c).isNull().alias(f"_n{i}"))
            if rows.schema[c].dataType.typeName() in ("double", "float"):
                out.append((~F.isnan(c)).alias(f"_f{i}"))
        out.append((-F.col(c) if desc else F.col(c)).alias(f"_k{i}"))
    return out


def _fold(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    conflict: Callable[[Column, Column], Column],
    limit: int | None = None,
) -> DataFrame:
    """Greedy pass inside each group. ``order``: (numeric column, descending?) pairs, then ties by the rest."""
    keys = list(group)
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*ranks(rows, order), F.struct(*[F.col(c) for c in rest]).alias("row"))
    ordered = F.array_sort(F.collect_list(packed))
    # Collecting never shrinks rows: shuffle them plain and collect once, after the exchange.
    full = rows.repartition(*keys).groupBy(*keys).agg(F.transform(ordered, lambda s: s["row"]).alias("_rows"))
    kind = T.ArrayType(rows.select(F.struct(*rest).alias("r")).schema["r"].dataType)

    def step(kept: Column, row: Column) -> Column:
        clash = F.exists(kept, lambda k: conflict(k, row))
        if limit is not None:
            clash = (F.size(kept) >= limit) | clash
        return F.when(F.coalesce(clash, F.lit(False)), kept).otherwise(F.concat(kept, F.array(row)))

    kept = F.aggregate("_rows", F.array().cast(kind), step)
    return full.select(*keys, F.explode(kept).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def _prefix(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group, cut in two steps so that no task sees more than 64 x n of a group."""
    salt = F.pmod(F.xxhash64(*[F.col(f.name) for f in rows.schema if f.dataType.typeName() != "map"]), F.lit(64))
    part = rows.withColumn("_salt", salt)
    part = part.withColumn("_rn", F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order)))
    part = part.filter(F.col("_rn") <= n).drop("_salt", "_rn")
    return part.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(
        F.col("_rn") <= n
    )


def keep_greedily(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    conflict: Callable[[Column, Column], Column],
    tie: str,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Greedy selection per group for any symmetric conflict.

    ``tie`` is a column unique inside the group that makes the order total.
    Hot groups: the best ``max_group`` rows are folded, every row that clashes
    with a kept one is dropped in a distributed pass, and the next best rows
    follow, until no row is left.
    """
    keys = list(group)
    full_order = [*order, (tie, False)] if tie not in [c for c, _ in order] else list(order)
    fold_order = [o for o in full_order if o[0] != tie or rows.schema[tie].dataType.typeName() != "string"]

    def fold(part: DataFrame) -> DataFrame:
        # A text tie cannot be negated; it sorts ascending as the next struct field.
        moved = part.select(*keys, tie, *[c for c in part.columns if c not in keys and c != tie])
        return _fold(moved, keys, fold_order, conflict).select(*rows.columns)

    ordinary, hot = split_hot(rows, keys, max_group)
    result = fold(ordinary)
    if hot is None:
        return result
    sort = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in full_order]
    left = cut_lineage(hot)
    while not left.isEmpty():
        head = cut_lineage(_prefix(left, keys, sort, max_group).drop("_rn"))
        kept = cut_lineage(fold(head))
        result = result.unionByName(kept)
        fields = [c for c in rows.columns if c not in keys]
        packed = kept.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_kept"))
        left = join_same(left, head.select(*keys, tie), [*keys, tie], "left_anti")
        left = join_same(left, broadcast_if_small(packed, 1_000), keys, "left")
        row = F.struct(*[F.col(c) for c in fields])
        left = left.filter(~F.coalesce(F.exists("_kept", lambda k: conflict(k, row)), F.lit(False))).drop("_kept")
        left = cut_lineage(left)
    return result


def suppress_overlaps(
    detections: DataFrame,
    group: Sequence[str],
    score: str = "conf",
    tie: str = "rid",
    threshold: float = 0.60,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Class-group suppression: in score order, drop a box with IoU >= threshold to a kept box of its group."""
    return keep_greedily(
        detections, group, [(score, True)], lambda a, b: boxes.iou(a, b) >= threshold, tie, max_group
    )


def thin_in_time(
    rows: DataFrame,
    group: Sequence[str],
    time_us: str,
    order: Sequence[tuple[str, bool]],
    tie: str,
    window_s: float,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Temporal de-duplication: in ``order``, drop a row within ``window_s`` (closed) of a kept row of its group.

    Rows without a time never clash. Hot timelines are cut into cells one
    window long, where at most one row survives. A round aggregates one best
    row per cell, keeps the cells whose best beats both neighbours, and drops
    what those reach; every round is a map-side combined aggregate and an
    equi-join on the cell, so the length of a timeline does not matter.
    """
    keys = list(group)
    span = int(round(window_s * 1_000_000))
    timeless = rows.filter(F.col(time_us).isNull())
    timed = rows.filter(F.col(time_us).isNotNull())

    def clash(a: Column, b: Column) -> Column:
        return F.abs(a[time_us] - b[time_us]) <= span

    ordinary, hot = split_hot(timed, keys, max_group)
    tie_text = rows.schema[tie].dataType.typeName() == "string"
    fold_order = [*order] if tie_text else [*order, (tie, False)]
    moved = ordinary.select(*keys, tie, *[c for c in rows.columns if c not in keys and c != tie])
    result = _fold(moved, keys, fold_order, clash).select(*rows.columns).unionByName(timeless)
    if hot is None:
        return result

    width = span + 1  # closed window: two rows of one cell always clash
    rank = F.struct(*ranks(rows, order), F.col(tie).alias("tie"))
    left = cut_lineage(hot.withColumn("_cell", floor_div(F.col(time_us), width)).withColumn("_rank", rank))
    while not left.isEmpty():
        best = left.groupBy(*keys, "_cell").agg(
            F.min("_rank").alias("_rank"), F.min_by(time_us, "_rank").alias("_at")
        )
        near = best.select(
            *keys, "_rank", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell")
        )
        rival = near.groupBy(*keys, "_cell").agg(F.min("_rank").alias("_rival"))
        kept = cut_lineage(
            join_same(best, rival, [*keys, "_cell"]).filter(F.col("_rank") == F.col("_rival")).drop("_rival")
        )
        reach = kept.select(
            *keys, F.col("_rank").alias("_best"), F.col("_at").alias("_kept_at"),
            F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell"),
        )
        reach = reach.groupBy(*keys, "_cell").agg(F.collect_list(F.struct("_best", "_kept_at")).alias("_near"))
        seen = cut_lineage(join_same(left, reach, [*keys, "_cell"], "left"))
        chosen = F.exists("_near", lambda n: n["_best"] == F.col("_rank"))
        gone = F.exists("_near", lambda n: F.abs(n["_kept_at"] - F.col(time_us)) <= span)
        result = result.unionByName(seen.filter(chosen).select(*rows.columns))
        left = cut_lineage(seen.filter(~F.coalesce(gone, F.lit(False))).drop("_near"))
    return result


def match_one_to_one(
    pairs: DataFrame,
    group: Sequence[str],
    left: str,
    right: str,
    score: str,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Greedy matching in score order: a row has at most one successor and one predecessor.

    Ties by (left, right). Hot groups use rounds: a pair that is the best of
    both its ends is taken, pairs sharing an end with it fall away.
    """
    keys = list(group)

    def clash(a: Column, b: Column) -> Column:
        return (a[left] == b[left]) | (a[right] == b[right])

    ordinary, hot = split_hot(pairs, keys, max_group)
    moved = ordinary.select(*keys, left, right, *[c for c in pairs.columns if c not in (*keys, left, right)])
    result = _fold(moved, keys, [(score, True)], clash).select(*pairs.columns)
    if hot is None:
        return result
    rank = F.struct(*ranks(pairs, [(score, True)]), F.col(left).alias("l"), F.col(right).alias("r"))
    rest = cut_lineage(hot.withColumn("_rank", rank))
    while not rest.isEmpty():
        by_left = rest.groupBy(*keys, left).agg(F.min("_rank").alias("_bl"))
        by_right = rest.groupBy(*keys, right).agg(F.min("_rank").alias("_br"))
        judged = join_same(join_same(rest, by_left, [*keys, left]), by_right, [*keys, right])
        taken = cut_lineage(
            judged.filter((F.col("_rank") == F.col("_bl")) & (F.col("_rank") == F.col("_br"))).drop("_bl", "_br")
        )
        result = result.unionByName(taken.select(*pairs.columns))
        rest = cut_lineage(
            join_same(
                join_same(rest, taken.select(*keys, left), [*keys, left], "left_anti"), taken.select(*keys, right), [*keys, right], "left_anti"
            )
        )
    return result


def sample_by_interval(
    frames: DataFrame,
    group: Sequence[str],
    time_us: str,
    tie: str,
    interval_s: float = 2.0,
    chunk_rows: int = 50_000,
) -> DataFrame:
    """Keep a frame when at least ``interval_s`` passed since the last kept one of its group.

    The answer depends on all earlier frames. A timeline with more than ``chunk_rows`` different times is cut into chunks of that many, by rank, so neither a wrong clock nor a
    burst makes one of them larger. A chunk is a map from entry to exit: it is solved for every frame that can be the first one kept in it (those of one interval at
    its start). Exits are joined to the next entry in time order, the chain from a timeline's start is found by pointer doubling, and a second pass keeps the frames of the
    entries on it. Frames without a time are not kept; of frames at one time the one with the smallest ``tie`` is.
    """
    keys = list(group)
    step = int(round(interval_s * 1_000_000))
    timeline = frames.filter(F.col(time_us).isNotNull()).select(*keys, F.col(time_us)).distinct()
    single, long = split_hot(timeline, keys, chunk_rows)
    gathered = F.array_sort(F.collect_list(time_us)).alias("_ts")

    key_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema)

    def summarise(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ts = np.asarray(row[len(keys) + 1], dtype=np.int64)
                entries = int(np.searchsorted(ts, ts[0] + step, side="left")) + 1
                after = np.searchsorted(ts, ts + step, side="left")
                leaves = np.empty(len(ts), dtype=np.int64)
                for i in range(len(ts) - 1, -1, -1):
                    leaves[i] = ts[i] + step if after[i] >= len(ts) else leaves[after[i]]
                for i in range(min(entries, len(ts))):
                    out.append((*row[: len(keys) + 1], int(ts[i]), int(leaves[i])))
            yield pd.DataFrame(out, columns=[*keys, "_chunk", "entry", "leave"])

    # One summary row per possible entry of a chunk: first kept frame, earliest time the next may come.
    starts = single.groupBy(*keys).agg(gathered).select(*keys, F.lit(0).cast("long").alias("_chunk"), "_ts", F.try_element_at("_ts", F.lit(1)).alias("entry"))
    if long is not None:
        ranked = running_counts(long.withColumn("_one", F.lit(1)), keys, time_us, ["_one"])
        chunked = ranked.withColumn("_chunk", F.floor(F.col("before__one") / chunk_rows).cast("long"))
        many = cut_lineage(chunked.groupBy(*keys, "_chunk").agg(gathered))
        starts = starts.unionByName(_walk_chunks(many, keys, summarise, key_type))

    def keep(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ts = np.asarray(row[len(keys) + 1], dtype=np.int64)
                at = int(np.searchsorted(ts, row[len(keys) + 2], side="left"))
                while at < len(ts):
                    out.append((*row[: len(keys)], int(ts[at])))
                    at = int(np.searchsorted(ts, ts[at] + step, side="left"))
            yield pd.DataFrame(out, columns=[*keys, time_us])

    chosen = starts.mapInPandas(keep, f"{key_type}, {time_us} bigint")
    kept = join_same(frames, chosen, [*keys, time_us], "left_semi")
    rest = [c for c in frames.columns if c not in (*keys, time_us)]
    kept = kept.groupBy(*keys, time_us).agg(F.min_by(F.struct(*rest), F.col(tie)).alias("_r"))
    return kept.select(*keys, time_us, "_r.*").select(*frames.columns)


def _walk_chunks(times: DataFrame, keys: list[str], summarise, key_type: str) -> DataFrame:
    """Chunks that a timeline really enters, with the first frame kept in each."""
    base = times.select(*keys, "_chunk", "_ts")
    nodes = cut_lineage(base.mapInPandas(summarise, f"{key_type}, _chunk bigint, entry bigint, leave bigint"))
    # An exit lies after its chunk, and the first frame at or after it is a possible entry of the chunk that has it, however many chunks a burst puts between.
    after = next_at_or_after(nodes.select(*keys, "leave").distinct(), nodes.select(*keys, "entry"), keys, "leave", "entry", "_next")
    link = join_same(nodes, after.filter("_next is not null"), [*keys, "leave"])
    node = F.struct(*[F.col(c) for c in keys], F.col("entry").alias("at"))
    after = F.struct(*[F.col(c) for c in keys], F.col("_next").alias("at"))
    first = nodes.groupBy(*keys).agg(F.min("entry").alias("entry"))
    # Walk backwards: a node is taken when the chain of some timeline start passes through it.
    taken = _reachable(cut_lineage(link.select(node.alias("n"), after.alias("m"))), first.select(node.alias("n")))
    taken = taken.select(*[F.col(f"n.{c}").alias(c) for c in keys], F.col("n.at").alias("entry"))
    hit = join_same(nodes.select(*keys, "_chunk", "entry"), taken, [*keys, "entry"], "left_semi")
    return join_same(base, hit, [*keys, "_chunk"]).select(*keys, "_chunk", "_ts", "entry")


def _reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes on the chains from ``start`` over a successor map, by doubling: log2(length) rounds."""
    found = cut_lineage(start)
    jump = links
    while True:
        new = found.join(jump, "n").select(F.col("m").alias("n"))
        grown = cut_lineage(found.union(new).distinct())
        far = jump.select(F.col("n").alias("m"), F.col("m").alias("m2"))
        jump = cut_lineage(jump.join(far, "m").select("n", F.col("m2").alias("m")))
        found = grown
        if jump.isEmpty():
            return found

