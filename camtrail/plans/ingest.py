"""From detections to index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from camtrail.functions import boxes, text
from camtrail.operators import greedy, live, tracks


def fuse(primary: DataFrame, secondary: DataFrame, frame=("camera", "video", "frame_idx"), threshold: float = 0.60) -> DataFrame:
    """Boxes of two detectors: secondary boxes over primary ones go, then class-group suppression."""
    keys = list(frame)
    kept = tracks.suppress_secondary(primary, secondary, keys)
    both = primary.unionByName(kept).withColumn("grp", text.object_group(F.col("label")))
    return greedy.suppress_overlaps(both, [*keys, "grp"], threshold=threshold)


def build(detections: DataFrame, expiry_s: float = 5.0, **limits) -> DataFrame:
    """Good tracks from fused boxes: link, summarise, filter. Expects us, offset_s, ts, quality and rid per box."""
    usable = detections.filter(boxes.has_area({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}))
    linked = live.link_boxes(usable, expiry_s=expiry_s)
    keyed = usable.join(linked.select("camera", "video", "us", "rid", "stretch", "track_no"), ["camera", "video", "us", "rid"])
    keyed = keyed.withColumn("track_id", F.concat_ws("_", "stretch", "track_no"))
    return tracks.keep_good(tracks.summarise(keyed), **limits)


def summary(videos: DataFrame, index_tracks: DataFrame, frames: DataFrame, wall_s: float) -> DataFrame:
    """Ingest totals with the ratio of wall time to recorded time."""
    seconds = videos.agg(F.sum("duration_s")).scalar()
    return videos.agg(F.count(F.lit(1)).alias("videos")).select(
        "videos",
        index_tracks.agg(F.count(F.lit(1))).scalar().alias("tracks"),
        frames.agg(F.count(F.lit(1))).scalar().alias("frames"),
        F.lit(float(wall_s)).alias("wall_s"),
        F.round(F.try_divide(F.lit(float(wall_s)), seconds), 4).alias("wall_per_duration"),
    )


def statistics(videos: DataFrame, index_tracks: DataFrame, frames: DataFrame, aliases: DataFrame) -> DataFrame:
    """Row counts of the index tables."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")

    return count(videos, "videos").union(count(index_tracks, "tracks")).union(count(frames, "frames")).union(
        count(aliases, "aliases")
    )


def camera_catalogue(videos: DataFrame) -> DataFrame:
    """One row per camera from its earliest video."""
    shown = [c for c in videos.columns if c != "camera"]
    first = F.min_by(F.struct(*shown), F.struct("start_time", "path"))
    return videos.groupBy("camera").agg(first.alias("v")).select("camera", "v.*")
