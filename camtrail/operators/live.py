"""Batch forms of the live-camera measures, over tables of received frames and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from camtrail.scale import (
    broadcast_if_small, carry_forward, cut_lineage, floor_div, join_same, micros, previous_in_time, running_counts, seconds,
)


def conflate(frames: DataFrame, every: str) -> DataFrame:
    """Newest frame per camera and time slot, with received, processed and dropped counts."""
    newest = F.max_by(F.col("frame_no"), F.struct("recv_ts", "frame_no"))
    return (
        frames.groupBy("camera", F.window("recv_ts", every).alias("w"))
        .agg(F.count(F.lit(1)).alias("received"), newest.alias("frame_no"), F.max("recv_ts").alias("recv_ts"))
        .select("camera", F.col("w.start").alias("slot"), "frame_no", "recv_ts", "received",
                F.lit(1).cast("long").alias("processed"), (F.col("received") - 1).alias("dropped"))
    )


def frame_rate(n: Column, first_us: Column, last_us: Column, window_s: float) -> Column:
    """Frames per second inside a window; the plain count over the window when it spans no time."""
    span = (last_us - first_us) / 1e6
    moving = F.try_divide((n - 1).cast("double"), span)
    return F.when((n > 1) & (span > 0.1), moving).otherwise(n / float(window_s))


def effective_fps(n: Column, first_us: Column, last_us: Column, window_s: float) -> Column:
    return F.round(frame_rate(n, first_us, last_us, window_s), 1)


def trailing_fps(frames: DataFrame, window_s: float = 3.0, chunk_windows: int = 200) -> DataFrame:
    """Effective frame rate over the trailing window at every frame."""
    out = trailing_counts(frames, window_s, chunk_windows)
    return out.select("camera", "us", "n", effective_fps(F.col("n"), F.col("first"), F.col("us"), window_s).alias("fps"))


def trailing_counts(frames: DataFrame, window_s: float, chunk_windows: int = 200) -> DataFrame:
    """Frames inside the trailing window at every frame, and the first of them.

    Timelines are cut into chunks of ``chunk_windows`` windows; a frame less
    than one window before a chunk border also joins the next chunk, so every
    window is complete inside one task and no camera is gathered whole.
    """
    span = int(window_s * 1_000_000)
    width = span * chunk_windows
    at = frames.groupBy("camera", micros(F.col("recv_ts")).alias("us")).agg(F.count(F.lit(1)).alias("c"))
    home = floor_div(F.col("us"), width)
    late = floor_div(F.col("us") + span, width)
    spread = at.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_distinct(F.array(home, late))))
    trail = W.partitionBy("camera", "_chunk").orderBy("us").rangeBetween(-span, 0)
    n, first = F.sum("c").over(trail), F.min("us").over(trail)
    out = spread.withColumn("n", n).withColumn("first", first).filter(F.col("_home") == F.col("_chunk"))
    return out.select("camera", "us", "n", "first")


def with_lag(frames: DataFrame) -> DataFrame:
    """Processing lag of every frame in seconds, 3 decimals."""
    return frames.withColumn("lag_s", seconds(micros(F.col("processed_ts")) - micros(F.col("recv_ts")), 3))


def reconnects(frames: DataFrame, timeout_s: float = 4.0) -> DataFrame:
    """Gaps longer than the read timeout."""
    rows = frames.select("camera", "frame_no", micros(F.col("recv_ts")).alias("us"))
    linked = previous_in_time(rows, ["camera"], "us", "us", ["frame_no"])
    gap = F.col("us") - F.col("prev_us")
    return linked.filter(gap > int(timeout_s * 1_000_000)).select(
        "camera", "frame_no", "us", seconds(gap, 3).alias("gap_s")
    )


def reconnect_summary(gaps: DataFrame, keep: int = 10) -> DataFrame:
    """Reconnect count per camera and its last ``keep`` gaps."""
    last = W.partitionBy("camera").orderBy(F.desc("us"), F.desc("frame_no"))
    recent = gaps.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= keep)
    shown = recent.groupBy("camera").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("us", "gap_s"))), lambda g: g["gap_s"]).alias("last_gaps")
    )
    counts = gaps.groupBy("camera").agg(F.count(F.lit(1)).alias("reconnects"))
    return join_same(counts, shown, ["camera"])


def recording_sessions(frames: DataFrame, gap_s: float = 4.0) -> DataFrame:
    """Unbroken recordings per camera: a frame later than ``gap_s`` after the last one starts a new recording.

    A recording's number is the running count of starts, which is range
    partitioned; its end is the frame before the next start.
    """
    rows = frames.select("camera", "frame_no", micros(F.col("recv_ts")).alias("us"))
    linked = previous_in_time(rows, ["camera"], "us", "us", ["frame_no"])
    gap = F.col("us") - F.col("prev_us")
    edge = linked.filter(F.col("prev_us").isNull() | (gap > int(gap_s * 1_000_000)))
    starts = edge.select("camera", F.col("us").alias("start_us"), "prev_us", F.lit(1).cast("long").alias("one"))
    numbered = running_counts(starts, ["camera"], "start_us", ["one"])
    numbered = cut_lineage(numbered.select("camera", (F.col("before_one") + 1).alias("recording"), "start_us", "prev_us"))
    ends = numbered.select("camera", (F.col("recording") - 1).alias("recording"), F.col("prev_us").alias("end_us"))
    last = frames.groupBy("camera").agg(F.max(micros(F.col("recv_ts"))).alias("_last"))
    whole = join_same(numbered.drop("prev_us"), ends, ["camera", "recording"], "left")
    return (
        join_same(whole, broadcast_if_small(last), ["camera"])
        .select("camera", "recording", "start_us", F.coalesce("end_us", "_last").alias("end_us"))
    )


def segments(frames: DataFrame, length: str = "10 seconds") -> DataFrame:
    """Fixed recording segments per camera with their frame counts."""
    return frames.groupBy("camera", F.window("recv_ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("frames")
    ).select("camera", F.col("w.start").alias("segment"), "frames")


def tracks_seen(boxes: DataFrame) -> DataFrame:
    """Distinct tracks per camera and the newest one. First sightings come first, so repeats never travel twice."""
    first = boxes.groupBy("camera", "track_id").agg(F.min("recv_ts").alias("first_seen"))
    return first.groupBy("camera").agg(
        F.count(F.lit(1)).alias("tracks_indexed"),
        F.max_by("track_id", F.struct("first_seen", "track_id")).alias("latest_track"),
        F.max("first_seen").alias("latest_at"),
    )


def sample_stats(samples: DataFrame) -> DataFrame:
    """Per camera: fps and lag ranges, last counters, dropped frames."""
    last = F.struct("ts", "sample_no")
    r = lambda c, n: F.round(c, n)
    return samples.groupBy("camera").agg(
        r(F.avg("fps"), 2).alias("avg_fps"), r(F.max("fps"), 2).alias("max_fps"), r(F.min("fps"), 2).alias("min_fps"),
        r(F.avg("lag"), 3).alias("avg_lag_s"), r(F.max("lag"), 3).alias("max_lag_s"), r(F.min("lag"), 3).alias("min_lag_s"),
        F.max_by("received", last).alias("frames_received"),
        F.max_by("processed", last).alias("frames_processed"),
        F.greatest(F.lit(0), F.max_by("received", last) - F.max_by("processed", last)).alias("frames_dropped"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def fleet_status(frames: DataFrame, now_us: Column, active_s: float) -> DataFrame:
    """Counters per camera, whether it is active at ``now_us``, and the number of active cameras."""
    per = frames.groupBy("camera").agg(
        F.count(F.lit(1)).alias("frames_received"),
        F.max(micros(F.col("recv_ts"))).alias("last_us"),
        F.round(F.avg((micros(F.col("processed_ts")) - micros(F.col("recv_ts"))) / 1e6), 3).alias("lag"),
    )
    per = per.withColumn("active", now_us - F.col("last_us") <= int(active_s * 1_000_000))
    total = per.agg(F.sum(F.col("active").cast("long")))
    return per.withColumn("total_active", total.scalar())


class BoxLinker:
    """Live boxes of one camera: gives each new box the id of the live box it overlaps most."""

    def __init__(self, threshold: float, expiry_us: int, live: list[tuple] = (), counter: int = 0):
        self.threshold, self.expiry, self.counter = threshold, expiry_us, counter
        # A column per live box: its id and time; its corners (x1, y1, x2, y2) and area.
        self.told = np.array([b[:2] for b in live], np.int64).reshape(-1, 2).T
        self.seen = self._measured(np.array([b[2:] for b in live], dtype=float))

    @staticmethod
    def _measured(boxes: np.ndarray) -> np.ndarray:
        out = np.empty((5, len(boxes)))
        out[:4] = boxes.reshape(-1, 4).T
        out[4] = (out[2] - out[0]) * (out[3] - out[1])
        return out

    @property
    def live(self) -> list[tuple]:
        return [(*told, *box) for told, box in zip(self.told.T.tolist(), self.seen[:4].T.tolist())]

    def frame(self, at: int, boxes: np.ndarray) -> list[int]:
        """Ids for the boxes of one frame. An id is given at most once per frame. Overlaps with all live boxes are worked out at once."""
        old, told = self.seen, self.told
        if len(told[1]):
            kept = told[1] >= at - self.expiry
            if not kept.all():
                old, told = old[:, kept], told[:, kept]
        n = len(boxes)
        new = self._measured(np.asarray(boxes, dtype=float))
        ids, hit, taken = [0] * n, [], []
        if n and old.shape[1]:
            side = np.minimum(old[2:4, None, :], new[2:4, :, None]) - np.maximum(old[:2, None, :], new[:2, :, None])
            np.maximum(side, 0, out=side)
            iou = side[0] * side[1]
            union = old[4] + new[4][:, None] - iou
            some = union > 0
            iou = iou / union if some.all() else np.where(some, iou / np.where(some, union, 1), 0)
            best = iou.argmax(axis=1).tolist()
            for i, (pick, most) in enumerate(zip(best, iou.max(axis=1).tolist())):
                if most > self.threshold and pick in taken:  # the best one is gone: look among those still free
                    free = iou[i].copy()
                    free[taken] = 0
                    pick = int(free.argmax())
                    most = free[pick]
                if most > self.threshold:
                    hit.append(i)
                    taken.append(pick)
            if hit:
                for i, no in zip(hit, told[0, taken].tolist()):
                    ids[i] = no
                told[1, taken], old[:, taken] = at, new[:, hit]
        fresh = [i for i in range(n) if not ids[i]]
        if fresh:
            for i in fresh:
                self.counter += 1
                ids[i] = self.counter
            told = np.concatenate([told, [[ids[i] for i in fresh], [at] * len(fresh)]], axis=1)
            old = np.concatenate([old, new[:, fresh]], axis=1)
        self.seen, self.told = old, told
        return ids


def link_boxes(boxes: DataFrame, threshold: float = 0.25, expiry_s: float = 5.0, tie: str = "rid") -> DataFrame:
    """Track numbers for boxes by overlap with the previous boxes of the same recording.

    State is kept per recording (camera, video), and starts afresh after a
    pause longer than ``expiry_s``, when no live box can be left, so each such
    stretch can go to its own task. A task reads its boxes in frame order, batch
    by batch, and holds only the live boxes. Numbers count from 1 per stretch.
    """
    expiry = int(expiry_s * 1_000_000)
    keys = ["camera", "video"]
    times = boxes.select(*keys, "us").distinct()
    linked = previous_in_time(times, keys, "us", "us")
    fresh = F.col("prev_us").isNull() | (F.col("us") - F.col("prev_us") > expiry)
    linked = linked.withColumn("_start", F.when(fresh, F.col("us"))).drop("prev_us")
    stretches = carry_forward(linked, keys, "us", "_start", "stretch").drop("_start")
    rows = join_same(boxes, stretches, [*keys, "us"]).select(*keys, "stretch", "us", tie, "x1", "y1", "x2", "y2")
    rows = rows.repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "us", tie)
    names = [*keys, "stretch", "us", tie]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", track_no bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, current, held = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            # The last frame may go on in the next batch.
            starts = _starts(table, names[:4])
            held = table.slice(starts[-1])
            if starts[-1]:
                linker, current, done = _link(table.slice(0, starts[-1]), starts[:-1], linker, current, names, threshold, expiry)
                yield from done.to_batches()
        if held is not None:
            yield from _link(held, np.zeros(1, int), linker, current, names, threshold, expiry)[2].to_batches()

    return rows.mapInArrow(run, schema)


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Places at which one of the columns changes; nulls are a value like any other."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in names:
        codes = table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _link(table: pa.Table, starts: np.ndarray, linker, current, names: list[str], threshold: float, expiry: int):
    out, boxes = [], np.stack([table[c].to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1)
    heads = table.select(names[:4]).take(starts).to_pydict()
    for *key, us, at, end in zip(*heads.values(), starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
        if key != current:
            linker, current = BoxLinker(threshold, expiry), key
        out.extend(linker.frame(us, boxes[at:end]))
    return linker, current, table.select(names).append_column("track_no", pa.array(out, pa.int64()))
