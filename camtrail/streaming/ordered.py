"""Keyed state over rows in event-time order: silences, exact trailing rates and box linking on streams.

A stream may deliver a key's rows out of order. Rows wait in the key's state until the watermark has passed them and are then taken in order, so
the results are those of a batch over the same rows. A timer per key wakes it for the next waiting row, or when it has been idle long enough to be forgotten.
All need the RocksDB state store and rows with a watermark; rows later than it are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from camtrail.operators.live import BoxLinker, effective_fps
from camtrail.scale import floor_div

WATERMARK = "10 seconds"
# Spark drops rows at the time 0 as late before it has a watermark; recordings may count from 0, so event time runs a day ahead of ``us``.
AHEAD = 86_400_000_000
# Rows of one block of waiting rows in the state.
BLOCK_ROWS = 1 << 16


class InOrder(StatefulProcessor):
    """Base: ``fields`` names the waiting columns (``us`` among them), ``memory`` the type of what a key remembers.

    ``take(key, memory, rows, mark)`` gets the rows that the watermark ``mark`` (microseconds) has passed, in order, and returns the new memory and the columns of the output;
    ``wake(memory)`` is the time at which the key must look again although no row waits, or None. Waiting rows are kept as Arrow blocks, not row by row.
    """

    fields: tuple[str, ...] = ()
    memory = ""
    order: tuple[str, ...] = ("us",)
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.kept = handle.getValueState("kept", self.memory)

    def take(self, key, memory, rows: pd.DataFrame, mark: int):
        raise NotImplementedError

    def wake(self, memory) -> int | None:
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._pass(key, [pdf[list(self.fields)] for pdf in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._pass(key, [], timerValues)

    def _pass(self, key, new: list[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() * 1000 - AHEAD
        rows = pd.concat([*(_unpack(r[0]) for r in self.waiting.get()), *new], ignore_index=True) if new or self.waiting.exists() else pd.DataFrame(columns=list(self.fields), dtype="int64")
        held = rows[rows["us"] >= mark]
        due = rows[rows["us"] < mark].sort_values(list(self.order), kind="stable")
        memory, out = self.take(key, tuple(self.kept.get()) if self.kept.exists() else None, due, mark)
        if memory is None:
            self.kept.clear()
        else:
            self.kept.update(memory)
        if len(held):
            self.waiting.put([(_pack(held.iloc[at : at + BLOCK_ROWS]),) for at in range(0, len(held), BLOCK_ROWS)])
        else:
            self.waiting.clear()
        times = [int(held["us"].min())] if len(held) else []
        again = None if memory is None else self.wake(memory)
        if again is not None:
            times.append(again)
        if times:
            self.handle.registerTimer((max(min(times), mark) + AHEAD) // 1000 + 1)
        if len(out[0]):
            names = self.columns[len(key) :]
            yield pd.DataFrame({**{c: [k] * len(out[0]) for c, k in zip(self.columns, key)}, **dict(zip(names, out, strict=True))})

    def close(self) -> None:
        pass


def _pack(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(block)).read_all().to_pandas()


def _run(rows: DataFrame, keys: list[str], processor: InOrder, schema: str) -> DataFrame:
    processor.columns = tuple(c.split()[0] for c in schema.split(", "))
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _timed(rows: DataFrame, us: str, watermark: str) -> DataFrame:
    return rows.withColumn("_at", F.timestamp_micros(F.col(us) + AHEAD)).withWatermark("_at", watermark)


class _Silence(StatefulProcessor):
    """Frames are folded into cells as long as the timeout, of which only the first and the last frame count: inside a cell nothing is silent.

    The last frame of a cell is settled once the watermark is a timeout past it: what comes later cannot cancel its silence. Settled cells are dropped, so a key keeps
    its open cells, never its frames.
    """

    columns: tuple[str, ...] = ()

    def __init__(self, timeout_us: int, keep: int):
        self.timeout, self.keep = timeout_us, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getValueState("cells", "ends binary")
        self.told = handle.getValueState("told", "count bigint, errors array<bigint>")

    def _folded(self, ends: list[np.ndarray]) -> np.ndarray:
        """(first, last) per cell, in order."""
        us = np.sort(np.concatenate([e.ravel() for e in ends]))
        new = np.flatnonzero(np.diff(us // max(self.timeout, 1), prepend=us[:1] // max(self.timeout, 1) - 1))
        return np.stack([us[new], us[np.append(new[1:], len(us)) - 1]], axis=1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, size = [], 0
        for pdf in rows:
            ends.append(pdf["us"].dropna().to_numpy(np.int64))
            size += ends[-1].size
            if size >= BLOCK_ROWS:
                ends = [self._folded(ends)]
                size = 0
        yield from self._settle(key, ends, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, [], timerValues)

    def _settle(self, key, ends: list[np.ndarray], timers) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() * 1000 - AHEAD
        if self.cells.exists():
            ends = [*ends, np.frombuffer(bytes(self.cells.get()[0]), np.int64)]
        if not sum(e.size for e in ends):
            return
        cells = self._folded(ends)
        first, last = cells[:, 0], cells[:, 1]
        settled = int(np.searchsorted(last, mark - self.timeout, side="left"))
        following = np.append(first[1:], np.iinfo(np.int64).max)
        silent = last[:settled][following[:settled] - last[:settled] > self.timeout].tolist()
        if settled < len(cells):
            self.cells.update((cells[settled:].tobytes(),))
            self.handle.registerTimer((int(last[settled]) + self.timeout + AHEAD) // 1000 + 1)
        else:
            self.cells.clear()
        if silent:
            count, errors = tuple(self.told.get()) if self.told.exists() else (0, [])
            out, errors = [], list(errors)
            for since in silent:
                count, errors = count + 1, [*errors, since][-self.keep :]
                out.append((*key, since, count, errors))
            self.told.update((count, errors))
            yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


def silences(frames: DataFrame, timeout_s: float = 4.0, keep: int = 10, watermark: str = WATERMARK) -> DataFrame:
    """A row when a camera has sent nothing for longer than the read timeout: (camera, since_us, reconnects, last_errors).

    It fires once per silence, when the watermark passes it, whether or not another frame follows; a late frame that the watermark still allows cancels it.
    ``last_errors`` are the starts of the last ``keep`` silences. ``frames``: camera, recv_ts (TIMESTAMP_NTZ).
    """
    rows = frames.select("camera", F.unix_micros(F.col("recv_ts").cast("timestamp")).alias("us"))
    schema = "camera string, since_us long, reconnects long, last_errors array<long>"
    return _run(_timed(rows, "us", watermark), ["camera"], _Silence(int(timeout_s * 1_000_000), keep), schema)


class _Rate(InOrder):
    fields = ("us",)
    memory = "ring binary"

    def __init__(self, span_us: int, width_us: int):
        self.span, self.width = span_us, width_us

    def take(self, key, memory, rows, mark):
        times = rows["us"].to_numpy(np.int64)
        if memory:
            times = np.concatenate([np.frombuffer(bytes(memory[0]), np.int64), times])
        at = np.unique(rows["us"].to_numpy(np.int64))
        at = at[at // self.width == key[1]]
        start = np.searchsorted(times, at - self.span, side="left")
        n = np.searchsorted(times, at, side="right") - start
        # What no later row can reach is forgotten.
        ring = times[times >= mark - self.span]
        return ((ring.tobytes(),) if len(ring) else None), (at, n, times[start] if len(at) else at)

    def wake(self, memory):
        return int(np.frombuffer(bytes(memory[0]), np.int64)[-1]) + self.span


def frame_rates(frames: DataFrame, window_s: float = 3.0, watermark: str = WATERMARK, chunk_windows: int = 24) -> DataFrame:
    """Effective rate of the trailing window at every instant with a frame, as the batch form gives it: (camera, us, n, fps).

    A key is a camera's chunk of ``chunk_windows`` windows, so a busy camera is spread over tasks; a frame less than one window before a chunk's end also joins the next chunk.
    The state is the ring of receive times in the window.
    """
    span = int(window_s * 1_000_000)
    width = span * chunk_windows
    rows = frames.select("camera", F.unix_micros(F.col("recv_ts").cast("timestamp")).alias("us"))
    rows = rows.select("camera", F.explode(F.array_distinct(F.array(floor_div(F.col("us"), width), floor_div(F.col("us") + span, width)))).alias("chunk"), "us")
    found = _run(_timed(rows, "us", watermark), ["camera", "chunk"], _Rate(span, width), "camera string, chunk long, us long, n long, first long")
    return found.select("camera", "us", "n", effective_fps(F.col("n"), F.col("first"), F.col("us"), window_s).alias("fps"))


class _Link(InOrder):
    fields = ("us", "rid", "x1", "y1", "x2", "y2")
    order = ("us", "rid")
    memory = "last bigint, stretch bigint, counter bigint, live array<struct<no:bigint,us:bigint,x1:double,y1:double,x2:double,y2:double>>"

    def __init__(self, threshold: float, expiry_us: int):
        self.threshold, self.expiry = threshold, expiry_us

    def take(self, key, memory, rows, mark):
        last, stretch, counter, live = memory or (None, None, 0, [])
        linker = BoxLinker(self.threshold, self.expiry, [tuple(b) for b in live], counter)
        times, boxes = rows["us"].to_numpy(np.int64), rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
        starts = np.flatnonzero(np.diff(times, prepend=times[:1] - 1)).tolist()
        stretches, numbers = np.empty(len(times), np.int64), []
        for at, end in zip(starts, [*starts[1:], len(times)]):
            us = int(times[at])
            if last is None or us - last > self.expiry:
                linker, stretch = BoxLinker(self.threshold, self.expiry), us
            last = us
            numbers += linker.frame(us, boxes[at:end])
            stretches[at:end] = stretch
        out = (times, rows["rid"].to_numpy(), stretches, np.array(numbers, np.int64))
        # No later row can meet a live box, and one that comes begins a stretch: nothing is left to remember.
        if last is None or mark - last > self.expiry:
            return None, out
        return (last, stretch, linker.counter, linker.live), out

    def wake(self, memory):
        return memory[0] + self.expiry


def link_boxes(boxes: DataFrame, threshold: float = 0.25, expiry_s: float = 5.0, watermark: str = WATERMARK) -> DataFrame:
    """(camera, video, us, rid, stretch, track_no) of streamed boxes (camera, video, us, rid, x1..y2), as the batch form numbers them.

    Boxes may come late and out of order up to the watermark. A recording keeps its waiting boxes and its live ones, and is forgotten once the watermark
    is ``expiry_s`` past its last box, so finished recordings leave no state.
    """
    rows = boxes.select("camera", "video", F.col("us").cast("long").alias("us"), F.col("rid").cast("string").alias("rid"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    schema = "camera string, video string, us long, rid string, stretch long, track_no long"
    return _run(_timed(rows, "us", watermark), ["camera", "video"], _Link(threshold, int(expiry_s * 1_000_000)), schema)
