"""Live-camera operators on streams.

Event time is the receive time of a frame, cast to TIMESTAMP because a
watermark needs one; keep the session zone at UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from camtrail.operators.live import effective_fps
from camtrail.operators.live import conflate as conflate_batch

WATERMARK = "10 seconds"


def with_event_time(frames: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Frames with a watermark on recv_ts; later rows than the watermark are dropped by stateful operators."""
    return frames.withColumn("recv_ts", F.col("recv_ts").cast("timestamp")).withWatermark("recv_ts", watermark)


def conflate(frames: DataFrame, every: str, watermark: str = WATERMARK) -> DataFrame:
    """Newest frame per camera and slot; older frames of the slot are counted as dropped."""
    return conflate_batch(with_event_time(frames, watermark), every)


def sliding_fps(frames: DataFrame, window_s: int = 3, slide_s: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Effective frame rate of the trailing window, one row per slide."""
    w = F.window("recv_ts", f"{window_s} seconds", f"{slide_s} seconds").alias("w")
    us = F.unix_micros("recv_ts")
    counted = with_event_time(frames, watermark).groupBy("camera", w).agg(
        F.count(F.lit(1)).alias("n"), F.min(us).alias("first"), F.max(us).alias("last")
    )
    return counted.select(
        "camera", F.col("w.end").alias("at"), "n",
        effective_fps(F.col("n"), F.col("first"), F.col("last"), window_s).alias("fps"),
    )


def mean_lag(frames: DataFrame, every: str, watermark: str = WATERMARK) -> DataFrame:
    """Mean processing lag per camera and slot."""
    lag = (F.unix_micros(F.col("processed_ts").cast("timestamp")) - F.unix_micros("recv_ts")) / 1e6
    return (
        with_event_time(frames, watermark)
        .groupBy("camera", F.window("recv_ts", every).alias("w"))
        .agg(F.round(F.avg(lag), 3).alias("lag_s"))
        .select("camera", F.col("w.start").alias("slot"), "lag_s")
    )


def recordings(frames: DataFrame, gap: str = "4 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Unbroken recordings; each closed one but the last of a camera is a reconnect."""
    return (
        with_event_time(frames, watermark)
        .groupBy("camera", F.session_window("recv_ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"), F.max("recv_ts").alias("last_frame"))
        .select("camera", F.col("w.start").alias("start"), "last_frame", "frames")
    )


def segments(frames: DataFrame, length: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    return (
        with_event_time(frames, watermark)
        .groupBy("camera", F.window("recv_ts", length).alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"))
        .select("camera", F.col("w.start").alias("segment"), "frames")
    )


def new_tracks(boxes: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First sighting of every (camera, track); repeats within the watermark are dropped."""
    return with_event_time(boxes, watermark).dropDuplicatesWithinWatermark(["camera", "track_id"])


def fleet_status(frames: DataFrame) -> DataFrame:
    """Running counters per camera, for update mode."""
    lag = (F.unix_micros(F.col("processed_ts").cast("timestamp")) - F.unix_micros(F.col("recv_ts").cast("timestamp"))) / 1e6
    return frames.groupBy("camera").agg(
        F.count(F.lit(1)).alias("frames_received"), F.max("recv_ts").alias("last_frame"), F.round(F.avg(lag), 3).alias("lag")
    )
