"""From observations to clean tracks: summary, label vote, quality filter, stitching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from camtrail.functions import boxes, text, vectors
from camtrail.operators import greedy, stitching
from camtrail.scale import broadcast_if_small, cut_lineage, follow_pointers, seconds

KEY = ("camera", "video", "track_id")


def _box(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}.{c}") for c in ("x1", "y1", "x2", "y2")}


def suppress_secondary(
    primary: DataFrame, secondary: DataFrame, frame: Sequence[str], threshold: float = 0.40, tie: str = "rid", max_frame: int = 5_000
) -> DataFrame:
    """Drop a secondary box that overlaps any primary box of its frame by more than ``threshold``.

    An anti join on the frame with the overlap as residual condition: no pair
    is emitted. Equal primary boxes count once. A frame with more than
    ``max_frame`` boxes on a side is cut into chunks on both sides; the
    secondary boxes hit in any pair of chunks are collected by id (``tie``).
    """
    keys = list(frame)
    p = primary.select(*keys, "x1", "y1", "x2", "y2").distinct()
    sizes = primary.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        secondary.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b"))
    ).groupBy(*keys).agg(F.sum("a").alias("_np"), F.sum("b").alias("_ns"))
    hot = cut_lineage(sizes.filter((F.col("_np") > max_frame) | (F.col("_ns") > max_frame)))

    def overlap(on: Sequence[str]) -> Column:
        test = boxes.iou(_box("s"), _box("p")) > threshold
        for c in on:
            test = (F.col(f"s.{c}") == F.col(f"p.{c}")) & test
        return test

    if hot.isEmpty():
        return secondary.alias("s").join(p.alias("p"), overlap(keys), "left_anti")
    hot = broadcast_if_small(
        hot.select(*keys, F.ceil(F.col("_np") / max_frame).cast("int").alias("_i"), F.ceil(F.col("_ns") / max_frame).cast("int").alias("_j"))
    )

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))

    def chunk(n: str, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.greatest(F.col(n), F.lit(1))).cast("int")

    rest = secondary.join(hot, keys, "left_anti")
    quiet = rest.alias("s").join(p.alias("p"), overlap(keys), "left_anti")
    dense = secondary.join(hot.select(*keys), keys, "left_semi")
    ps = p.join(hot, keys).withColumn("_ci", chunk("_i", "x1", "y1", "x2", "y2")).withColumn("_cj", each("_j"))
    ss = secondary.join(hot, keys).withColumn("_cj", chunk("_j", tie)).withColumn("_ci", each("_i"))
    hit = ss.alias("s").join(ps.alias("p"), overlap([*keys, "_ci", "_cj"]), "left_semi").select(*keys, tie).distinct()
    return quiet.unionByName(dense.join(hit, [*keys, tie], "left_anti").select(*quiet.columns))


def summarise(observations: DataFrame, key: Sequence[str] = KEY, tie: str = "rid") -> DataFrame:
    """One row per track: hits, first / last / best time and offset, mean confidence, voted label, best box.

    Two aggregates, both combined map-side: per (track, label) and then per
    track. The voted label has the largest summed confidence, ties go to the
    label seen first; the best observation has the highest quality, ties go to
    the earliest frame.
    """
    keys = list(key)
    at = F.struct("frame_idx", tie)
    best = F.struct((-F.col("quality")).alias("q"), F.col("frame_idx").alias("f"), F.col(tie).alias("t"))
    shown = F.struct("ts", "offset_s", "quality", "x1", "y1", "x2", "y2")
    per_label = observations.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("conf").alias("weight"),
        F.min(F.struct(at.alias("at"), F.col("ts").alias("ts"), F.col("offset_s").alias("offset_s"))).alias("first"),
        F.max(F.struct(at.alias("at"), F.col("ts").alias("ts"), F.col("offset_s").alias("offset_s"))).alias("last"),
        F.min(F.struct(best.alias("rank"), shown.alias("obs"))).alias("best"),
    )
    vote = F.struct((-F.round("weight", 9)).alias("w"), F.col("first.at").alias("seen"))
    track = per_label.groupBy(*keys).agg(
        F.sum("n").alias("hits"),
        (F.sum("weight") / F.sum("n")).alias("mean_conf"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min("best").alias("best"),
        F.min_by("label", vote).alias("label"),
    )
    return track.select(
        *keys,
        "label",
        text.object_group(F.col("label")).alias("grp"),
        "hits",
        "mean_conf",
        F.col("first.ts").alias("t_start"),
        F.col("last.ts").alias("t_end"),
        F.col("best.obs.ts").alias("t_best"),
        F.col("first.offset_s").alias("offset_start"),
        F.col("last.offset_s").alias("offset_end"),
        F.col("best.obs.offset_s").alias("offset_best"),
        F.greatest(F.lit(0.0), F.col("last.offset_s") - F.col("first.offset_s")).alias("duration_s"),
        F.round("best.obs.quality", 4).alias("quality"),
        *[F.col(f"best.obs.{c}").alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")],
    )


def label_votes(observations: DataFrame, key: Sequence[str] = KEY, tie: str = "rid") -> DataFrame:
    """Voted label of each track with its weight."""
    keys = list(key)
    votes = observations.groupBy(*keys, "label").agg(
        F.sum("conf").alias("weight"), F.min(F.struct("frame_idx", tie)).alias("seen")
    )
    rank = F.struct((-F.round("weight", 9)).alias("w"), F.col("seen"), F.col("label"))
    return votes.groupBy(*keys).agg(F.min(rank).alias("v")).select(
        *keys, F.col("v.label").alias("label"), (-F.col("v.w")).alias("weight")
    )


def best_by_area(observations: DataFrame, key: Sequence[str] = KEY, tie: str = "rid") -> DataFrame:
    """Earlier form of the summary: best frame by area x confidence, label of the first observation."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rank = F.struct((-(area * F.col("conf"))).alias("s"), F.col("frame_idx").alias("f"), F.col(tie).alias("t"))
    return observations.filter(area > 0).groupBy(*key).agg(
        F.min_by("label", F.struct("frame_idx", tie)).alias("label"),
        F.min_by("frame_idx", rank).alias("best_frame"),
        F.min_by("offset_s", rank).alias("offset_best"),
    )


def drop_reason(
    duration: Column, hits: Column, mean_conf: Column,
    min_duration_s: float = 1.0, min_hits: int = 4, min_mean_conf: float = 0.35,
) -> Column:
    """First failing test of a track, or null for a track to keep."""
    return (
        F.when(duration < min_duration_s, F.lit("duration"))
        .when(hits < min_hits, F.lit("hits"))
        .when(mean_conf < min_mean_conf, F.lit("mean_conf"))
    )


def with_drop_reason(tracks: DataFrame, **limits) -> DataFrame:
    reason = drop_reason(F.col("duration_s"), F.col("hits"), F.col("mean_conf"), **limits)
    return tracks.withColumn("drop_reason", reason)


def keep_good(tracks: DataFrame, **limits) -> DataFrame:
    return with_drop_reason(tracks, **limits).filter(F.col("drop_reason").isNull()).drop("drop_reason")


def drop_counts(judged: DataFrame) -> DataFrame:
    """Dropped tracks per reason, and in total."""
    dropped = judged.filter(F.col("drop_reason").isNotNull())
    counts = dropped.rollup("drop_reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.coalesce("drop_reason", F.lit("total_dropped")).alias("drop_reason"), "n")


def stitch_pairs(
    tracks: DataFrame,
    group: Sequence[str] = ("video", "grp"),
    max_gap_s: float = 2.0,
    max_distance: float = 0.25,
    min_cosine: float = 0.80,
    min_cosine_vehicle: float = 0.88,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Candidate continuations: same group, small time gap, close boxes, similar vectors.

    Expects id, start_us, end_us, the first box centre (fx, fy), the last one
    (lx, ly) and emb. Pairs come out of cells of time, at most ``bucket_rows``
    tracks to a side.
    """
    keys, gap_us = list(group), int(max_gap_s * 1_000_000)
    found = stitching.pairs(stitching.ends(tracks, keys), keys, gap_us, max_distance, min_cosine, min_cosine_vehicle, bucket_rows)
    return _shown(found, keys)


def _shown(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.select(
        *keys, "base_id", "cand_id", seconds(F.col("wait_us"), 3).alias("gap_s"), F.round("distance", 4).alias("center_dist"), F.col("cosine").alias("cosine_sim")
    )


def stitch(
    tracks: DataFrame,
    group: Sequence[str] = ("video", "grp"),
    max_gap_s: float = 2.0,
    max_distance: float = 0.25,
    min_cosine: float = 0.80,
    min_cosine_vehicle: float = 0.88,
    **limits: int,
) -> DataFrame:
    """``stitch_matches`` of ``stitch_pairs`` without the pairs in between: they grow with the square of the tracks in a gap, the matches do not.

    What the cells leave open, as in a burst larger than a cell, is matched from its pairs.
    """
    keys, gap_us = list(group), int(max_gap_s * 1_000_000)
    rules = (keys, gap_us, max_distance, min_cosine, min_cosine_vehicle)
    found, rest = stitching.matches(stitching.ends(tracks, keys), *rules, **limits)
    found = _shown(found, keys)
    if rest is None:
        return found
    return found.unionByName(stitch_matches(cut_lineage(_shown(stitching.pairs(rest, *rules, 20_000), keys)), keys))


def stitch_matches(pairs: DataFrame, group: Sequence[str] = ("video", "grp"), max_group: int = greedy.MAX_GROUP) -> DataFrame:
    """One-to-one continuations, best cosine first."""
    return greedy.match_one_to_one(pairs, group, "base_id", "cand_id", "cosine_sim", max_group)


def chain_roots(matches: DataFrame) -> DataFrame:
    """First track of the chain of every absorbed track: (id, root)."""
    back = matches.select(F.col("cand_id").alias("id"), F.col("base_id").alias("before"))
    return follow_pointers(back, "id", "before").select("id", "root")


def merge_chains(observations: DataFrame, matches: DataFrame, track: str = "track_id", tie: str = "rid") -> DataFrame:
    """Summaries recomputed over the union of the observations of each chain."""
    roots = chain_roots(matches).withColumnRenamed("id", track)
    moved = observations.join(broadcast_if_small(roots), track, "left")
    moved = moved.withColumn(track, F.coalesce("root", F.col(track))).drop("root")
    return summarise(moved, KEY, tie)


def merged_vectors(tracks: DataFrame, matches: DataFrame, dim: int) -> DataFrame:
    """Mean unit vector of each chain."""
    roots = chain_roots(matches)
    moved = tracks.join(broadcast_if_small(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return moved.groupBy("root").agg(vectors.mean_vector("emb", dim).alias("emb"), F.count(F.lit(1)).alias("parts"))


def tracks_per_object(counts: DataFrame, real: DataFrame, clip: str = "clip") -> DataFrame:
    """Tracks per real object before and after stitching, against hand-counted objects."""
    return counts.join(broadcast_if_small(real), clip).select(
        clip,
        F.round(F.col("after_filter") / F.col("real_n"), 2).alias("ratio_filtered"),
        F.round(F.col("after_stitch") / F.col("real_n"), 2).alias("ratio_stitched"),
    )


# --- Fixed values. Confidence below which a box is shown without its class; every second frame is detected on.
DISPLAY_CONFIDENCE = 0.35
STRIDE = 2


def display_label(label: Column, confidence: Column, least: float = DISPLAY_CONFIDENCE) -> Column:
    """The class a box is shown with: "object" where the detector is not sure."""
    return F.when(confidence >= least, label).otherwise("object")


def every_nth(frames: DataFrame, index: str = "frame_idx", stride: int = STRIDE) -> DataFrame:
    """The frames that the detector sees."""
    return frames.filter(F.pmod(F.col(index), F.lit(stride)) == 0)


def new_words(words: DataFrame, base: DataFrame, column: str = "label") -> DataFrame:
    """Distinct words that the base vocabulary lacks, case aside; they go to the open-vocabulary detector."""
    known = base.select(F.lower(column).alias("_l")).distinct()
    return words.select(column).distinct().withColumn("_l", F.lower(column)).join(known, "_l", "left_anti").select(column)


def label_distribution(detections: DataFrame) -> DataFrame:
    """Detections per class, most first."""
    return detections.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")
