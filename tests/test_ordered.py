"""Ordered keyed state on streams against the batch forms."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from camtrail.operators import live
from camtrail.streaming import ordered
from test_live import KIND, boxes, plain_link, write_in_order

T0 = datetime(2026, 10, 8, 12)
FRAMES = "camera string, frame_no long, recv_ts timestamp_ntz"


def drive(rows, at):
    """All rows that the stream puts out, and the state rows left at its end."""
    q = rows.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    left = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/out"), left


def stream(spark, parts, schema, src):
    for i, rows in enumerate(parts):
        write_in_order(spark.createDataFrame(rows, schema), src, i)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def shuffled(rows, us, parts, seed=3):
    """Rows in files by time, but each up to 8 seconds late: within the watermark."""
    rnd = random.Random(seed)
    late = sorted(rows, key=lambda r: us(r) + rnd.randrange(8_000_000))
    size = -(-len(late) // parts)
    return [late[i : i + size] for i in range(0, len(late), size)]


def test_linking_equals_batch_with_pauses_and_late_boxes(spark, tmp_path):
    rows = boxes(5, 90)
    end = [("cam", "end", 10**10, "x", 0.0, 0.0, 1.0, 1.0)]
    src = stream(spark, [*shuffled(rows, lambda r: r[2], 4), end], KIND, str(tmp_path / "src"))
    out, left = drive(ordered.link_boxes(src), str(tmp_path / "run"))
    got = {(r.video, r.rid): (r.stretch, r.track_no) for r in out.collect()}
    assert got == plain_link(rows)
    assert len({s for s, _ in got.values()}) > 3


def test_finished_recordings_leave_no_state(spark, tmp_path):
    rows = [("cam", f"v{k}", (20 * k + i) * 1_000_000, f"{k}-{i}", 0.1 * i, 0.0, 0.1 * i + 0.3, 0.3) for k in range(40) for i in range(3)]
    src = stream(spark, [rows[:60], rows[60:], [("cam", "end", 10**10, "x", 0.0, 0.0, 1.0, 1.0)]], KIND, str(tmp_path / "src"))
    out, left = drive(ordered.link_boxes(src), str(tmp_path / "run"))
    assert out.count() == len(rows)
    # The last box alone waits: one entry, and the count that the store keeps of it.
    assert left <= 3


def frames(spark, camera, seconds):
    return [(camera, i, T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)]


def us(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_silences_fire_once_with_or_without_a_next_frame(spark, tmp_path):
    a = frames(spark, "a", [0, 1, 2, 3, 20, 21, 40])  # silent after 3, 21 and 40
    b = frames(spark, "b", [0, 30, 33.5, 33.5, 37, 60])  # after 0, 37 (3.5 s is no silence)
    # The frame of b at 2 s comes late but within the watermark: the silence is after it, not after 0.
    late = [("b", 99, T0 + timedelta(seconds=2))]
    parts = [a[:4] + b[:1], [("c", 0, T0 + timedelta(seconds=9))] + late, a[4:] + b[1:], frames(spark, "end", [1000])]
    src = stream(spark, parts, FRAMES, str(tmp_path / "src"))
    out, _ = drive(ordered.silences(src, 4.0, keep=2), str(tmp_path / "run"))
    at = lambda s: us(T0 + timedelta(seconds=s))
    got = sorted((r.camera, r.since_us, r.reconnects, tuple(r.last_errors)) for r in out.collect())
    assert got == [
        ("a", at(3), 1, (at(3),)), ("a", at(21), 2, (at(3), at(21))), ("a", at(40), 3, (at(21), at(40))),
        ("b", at(2), 1, (at(2),)), ("b", at(37), 2, (at(2), at(37))), ("b", at(60), 3, (at(37), at(60))), ("c", at(9), 1, (at(9),)),
    ]


@pytest.mark.parametrize("window", [3.0, 0.5])
def test_rates_equal_batch(spark, tmp_path, window):
    rnd = random.Random(9)
    seconds = sorted(rnd.uniform(0, 60) for _ in range(150)) + [30.0, 30.0]
    rows = [("cam", i, T0 + timedelta(milliseconds=int(s * 1000))) for i, s in enumerate(seconds)]
    src = stream(spark, [*shuffled(rows, lambda r: us(r[2]), 3), frames(spark, "end", [1000])], FRAMES, str(tmp_path / "src"))
    out, left = drive(ordered.frame_rates(src, window), str(tmp_path / "run"))
    want = live.trailing_fps(spark.createDataFrame(rows, FRAMES).withColumn("processed_ts", F.col("recv_ts")), window)
    key = lambda df: sorted((r.camera, r.us, r.n, r.fps) for r in df.collect())
    assert key(out) == key(want)
    assert left <= 3


class Store:
    """A key's state in memory: what it holds, and timers that never fire."""

    def __init__(self):
        self.held = {}

    def getListState(self, name, kind):
        return Kept(self.held, name)

    getValueState = getListState

    def registerTimer(self, ms):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


class Kept:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held

    def get(self):
        return self.held.get(self.name, [])

    def put(self, rows):
        self.held[self.name] = list(rows)

    def update(self, row):
        self.held[self.name] = [row]

    def clear(self):
        self.held.pop(self.name, None)


@pytest.mark.parametrize("kind", ["silence", "link"])
def test_waiting_rows_are_cells_or_blocks(kind):
    """The state of a key grows with its open cells or blocks, not row by row."""
    us = [10**9 + i for i in range(400)]
    rows = pd.DataFrame({"us": us, "frame_no": us, "rid": [str(u) for u in us], "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0})
    processor, store = ordered._Silence(4_000_000, 10) if kind == "silence" else ordered._Link(0.25, 5_000_000), Store()
    processor.init(store)
    assert not list(processor.handleInputRows(("cam", "v"), iter([rows]), store))
    assert 1 <= sum(len(v) for v in store.held.values()) <= 2


def test_rates_of_one_camera_are_chunks(spark, tmp_path):
    rows = [("cam", i, T0 + timedelta(milliseconds=70 * i)) for i in range(200)]
    src = stream(spark, [*shuffled(rows, lambda r: us(r[2]), 2), frames(spark, "end", [1000])], FRAMES, str(tmp_path / "src"))
    out, _ = drive(ordered.frame_rates(src, 1.0, chunk_windows=2), str(tmp_path / "run"))
    want = live.trailing_fps(spark.createDataFrame(rows, FRAMES), 1.0)
    assert sorted((r.us, r.n, r.fps) for r in out.collect()) == sorted((r.us, r.n, r.fps) for r in want.collect())
