"""Looking up snapshots and clips of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAD_S = 2.0


def clip_window(start: Column, end: Column, pad_s: float = PAD_S) -> tuple[Column, Column]:
    """Start and length of the clip around a moment."""
    return F.greatest(F.lit(0.0), start - pad_s), F.greatest(F.lit(1.0), (end - start) + 2 * pad_s)


def first_snapshots(tracks: DataFrame) -> DataFrame:
    """Snapshot of the earliest track of every camera."""
    return tracks.groupBy("camera").agg(F.min_by("snapshot", F.struct("t_start", "id")).alias("snapshot"))


def snapshots(items: DataFrame, tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Snapshot of every item: as a track, else as a frame, else the first of the camera of that name."""
    per_camera = first_snapshots(tracks)
    names = per_camera.select(
        F.explode(F.array(F.struct(F.col("camera").alias("n"), F.lit(0).alias("p")),
                          F.struct(F.regexp_replace("camera", "^cam_", "").alias("n"), F.lit(1).alias("p")))).alias("k"),
        "snapshot",
    ).groupBy(F.col("k.n").alias("item_id")).agg(F.min_by("snapshot", "k.p").alias("_c"))
    t = tracks.select(F.col("id").alias("item_id"), F.col("snapshot").alias("_t"))
    f = frames.select(F.col("id").alias("item_id"), F.col("snapshot").alias("_f"))
    found = items.join(t, "item_id", "left").join(f, "item_id", "left").join(names, "item_id", "left")
    return found.select("item_id", F.coalesce("_t", "_f", "_c").alias("snapshot"))


def clips(items: DataFrame, tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Cut list for result ids: video, start and length; ids that are neither track nor frame are left out."""
    t = tracks.select(F.col("id").alias("item_id"), F.col("video").alias("_tv"), F.coalesce("offset_best", "offset_start").alias("_to"))
    f = frames.select(F.col("id").alias("item_id"), F.col("video").alias("_fv"), F.col("offset_s").alias("_fo"))
    found = items.join(t, "item_id", "left").join(f, "item_id", "left")
    at = F.coalesce("_to", "_fo")
    start, length = clip_window(at, at + 3)
    return found.filter(at.isNotNull()).select(
        "item_id", F.coalesce("_tv", "_fv").alias("video"), start.alias("start_s"), length.alias("length_s")
    )
