"""Live measures, linking and streams."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from camtrail.operators import colours, live
from camtrail.operators.live import BoxLinker
from camtrail.sources import export, index, keyed, video_files
from camtrail.streaming import live as streams, sinks, watch

T0 = datetime(2026, 10, 8, 12)


def boxes(seed, n_frames=60):
    rnd = random.Random(seed)
    rows, us = [], 0
    for f in range(n_frames):
        us += 7_000_000 if rnd.random() < 0.1 else 200_000
        for b in range(rnd.randrange(1, 5)):
            x, y = b * 0.3 + rnd.random() * 0.1, rnd.random() * 0.2
            rows.append(("cam", rnd.choice(["v1", "v2"]), us, f"{f:03d}-{b}", x, y, x + 0.25, y + 0.3))
    return rows


KIND = "camera string, video string, us long, rid string, x1 double, y1 double, x2 double, y2 double"


def plain_link(rows):
    out = {}
    for video in ("v1", "v2"):
        linker, last, stretch = None, None, None
        frames = sorted({r[2] for r in rows if r[1] == video})
        for us in frames:
            if last is None or us - last > 5_000_000:
                linker, stretch = BoxLinker(0.25, 5_000_000), us
            last = us
            mine = sorted((r for r in rows if r[1] == video and r[2] == us), key=lambda r: r[3])
            for r, no in zip(mine, linker.frame(us, [r[4:8] for r in mine])):
                out[(video, r[3])] = (stretch, no)
    return out


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_link_boxes(spark, batch):
    rows = boxes(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.video, r.rid): (r.stretch, r.track_no) for r in live.link_boxes(spark.createDataFrame(rows, KIND)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == plain_link(rows)


def test_boxes_without_a_camera_are_linked(spark):
    rows = boxes(2, 20)
    got = live.link_boxes(spark.createDataFrame([(None, *r[1:]) for r in rows], KIND)).collect()
    assert {(r.video, r.rid): (r.stretch, r.track_no) for r in got} == plain_link(rows)
    assert {r.camera for r in got} == {None}


def test_an_id_is_given_once_per_frame():
    linker = BoxLinker(0.25, 1_000_000)
    assert linker.frame(0, [(0, 0, 1, 1)]) == [1]
    assert linker.frame(1, [(0, 0, 1, 1), (0, 0, 1, 1)]) == [1, 2]
    assert linker.frame(5_000_000, [(0, 0, 1, 1)]) == [3]


def drive(frame, at, mode="append"):
    q = frame.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck")
    q.trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{at}/out")


def frames(spark, seconds):
    rows = [("cam", i, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + 0.2)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "camera string, frame_no long, recv_ts timestamp_ntz, processed_ts timestamp_ntz")


def write_in_order(df, src, number):
    """Append one file with its own modification time, which is the order streams read files in."""
    known = set(glob.glob(f"{src}/*.parquet"))
    df.coalesce(1).write.mode("append").parquet(src)
    for path in set(glob.glob(f"{src}/*.parquet")) - known:
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def test_late_frames_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    for i, seconds in enumerate([[0, 1, 2], [100], [101], [3], [200]]):
        write_in_order(frames(spark, seconds), src, i)
    schema = frames(spark, []).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = {r.segment.second + 60 * r.segment.minute: r.frames for r in drive(streams.segments(stream), str(tmp_path / "run")).collect()}
    assert out[0] == 3  # the frame at second 3 came after the watermark had passed its segment
    assert out[100] == 2


def test_stream_equals_batch_before_the_watermark(spark, tmp_path):
    seconds = [i * 0.7 for i in range(200)] + [1000]
    src = str(tmp_path / "src")
    frames(spark, seconds).write.parquet(src)
    stream = spark.readStream.schema(frames(spark, []).schema).parquet(src)
    got = {(r.slot, r.frame_no, r.received) for r in drive(streams.conflate(stream, "10 seconds"), str(tmp_path / "run")).collect()}
    batch = live.conflate(frames(spark, seconds[:-1]), "10 seconds")
    assert {(r.slot, r.frame_no, r.received) for r in batch.collect()} == got


def test_rates_and_gaps(spark):
    df = frames(spark, [0, 1, 2, 3, 3.05, 9])
    got = [r.fps for r in live.trailing_fps(df, 3.0).orderBy("us").collect()]
    assert got == [0.3, 1.0, 1.0, 1.0, round(3 / 2.05, 1), 0.3]
    assert [r.fps for r in live.trailing_fps(df, 3.0, chunk_windows=1).orderBy("us").collect()] == got
    assert [(r.frame_no, r.gap_s) for r in live.reconnects(df).collect()] == [(5, 5.95)]
    assert {r.lag_s for r in live.with_lag(df).collect()} == {0.2}
    assert [(r.recording, r.end_us - r.start_us) for r in live.recording_sessions(df).orderBy("recording").collect()] == [(1, 3_050_000), (2, 0)]


def test_alert_sink_is_idempotent(spark, tmp_path, monkeypatch):
    v = [1.0, 0.0]
    rules = spark.createDataFrame([("r1", "one", "q", v, None, 0.5, True)],
                                  "id string, rule_name string, query_text string, q_emb array<float>, camera_filter string, min_score double, is_active boolean")
    table = keyed.rules(spark, str(tmp_path / "rules"))
    table.upsert(rules, "rules")
    batch = spark.createDataFrame([("t1", "c", "car", T0, "s", v), ("t2", "c", "car", T0, "s", [0.0, 1.0])],
                                  "id string, camera string, label string, t_start timestamp_ntz, snapshot string, emb array<float>")
    sink = sinks.alert_events(str(tmp_path / "rules"), str(tmp_path / "events"))
    for number in (0, 0, 1):
        sink(batch, number)
    events = keyed.events(spark, str(tmp_path / "events"))
    assert [(e.rule_id, e.track_id) for e in events.read().collect()] == [("r1", "t1")]
    assert table.read().first().last_triggered_at == T0
    # A batch that stopped after its events: repeated, it fires nothing again, and the rules learn of it.
    later = batch.withColumn("id", F.lit("t9")).withColumn("t_start", F.lit(T0 + timedelta(hours=1)).cast("timestamp_ntz")).limit(1)
    known = sinks.keyed.KeyedTable.upsert
    monkeypatch.setattr(sinks.keyed.KeyedTable, "upsert", lambda self, rows, commit: (_ for _ in ()).throw(OSError()) if "rules" in self.path else known(self, rows, commit))
    with pytest.raises(OSError):
        sink(later, 2)
    monkeypatch.setattr(sinks.keyed.KeyedTable, "upsert", known)
    sink(later, 2)
    assert sorted(e.track_id for e in events.read().collect()) == ["t1", "t9"]
    assert table.read().first().last_triggered_at == T0 + timedelta(hours=1)


def test_live_table_stays_small_over_many_batches(spark, tmp_path):
    path = str(tmp_path / "live")
    sink = sinks.live_tracks(path, vacuum_every=4)
    kind = "id string, camera string, ts timestamp_ntz, quality double, label string"
    want, counts = {}, []
    for n in range(12):
        rows = [(f"t{i}", f"cam_{i % 2}", T0 + timedelta(seconds=10 * n + i), float((n * 7 + i) % 5), f"l{n}") for i in range(n // 4, n // 4 + 3)]
        for i, camera, ts, q, label in rows:
            start, _, hits = want.get(i, (ts, ts, 0))
            want[i] = (start, ts, hits + 1)
        batch = spark.createDataFrame(rows, kind)
        sink(batch, n)
        if n % 5 == 0:
            sink(batch, n)
        counts.append(len(glob.glob(f"{path}/data/**/*.parquet", recursive=True)))
    got = {r.id: (r.t_start, r.t_end, r.hits) for r in sinks.live_table(spark, path, sinks.LIVE.replace("timestamp", "timestamp_ntz")).read().collect()}
    assert got == want
    assert counts[3] == counts[7] == counts[11] == 2


def test_folder_watch_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a.mp4", "b.MKV", "c_invalid.mp4", "d.txt", "e.mov"):
        (src / name).write_bytes(b"x")
    (src / "empty.mp4").write_bytes(b"")
    seen = []

    def take(batch, n):
        seen.extend(r.path.rsplit("/", 1)[1] for r in batch.collect())

    for _ in range(2):
        watch.watch(watch.new_files(spark, str(src)), take, str(tmp_path / "ck"), once=True).awaitTermination()
    assert sorted(seen) == ["a.mp4", "b.MKV", "e.mov"]


def test_json_sources_and_export(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"id":"q1","query":"a car","split":"dev","truth":[{"camera":"c","start":"2026-10-08T12:00:00","end":"2026-10-08T12:01:00","label":"car"}]}]')
    queries, truth = video_files.read_queries(spark, str(tmp_path / "q.json"))
    assert queries.first().text == "a car" and truth.first().t_from == T0
    (tmp_path / "m.json").write_text('{"a.mp4": {"start_time": "2026-10-08T12:00:00", "camera": "cam_a", "start_source": "manual"}}')
    assert video_files.read_manifest(spark, str(tmp_path / "m.json")).first().start_time == T0
    results = spark.createDataFrame([("q1", 1, "t1", 0.5), ("q1", 2, "t2", 0.4)], "query_id string, rank int, result_id string, score double")
    docs = export.documents(results, queries)
    export.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).select(F.size("results").alias("n")).first().n == 2
    export.write_crops(results, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    listing = video_files.read_listing(spark, str(tmp_path)).filter(F.col("path").endswith("q.json"))
    assert listing.first().mtime is not None


def test_track_layout_prunes(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", f"cam_{i % 3}", T0 + timedelta(days=i % 2)) for i in range(60)], "id string, camera string, t_start timestamp_ntz")
    index.write_tracks(rows, str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t")).filter("camera = 'cam_1'")
    assert one.count() == 20 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(camera" in one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "simple")


def test_colours(spark):
    rows = [("blue", i, i, 4, 4, 82.0, 207.0, 20.0) for i in range(4)] + [("red", i, i, 4, 4, 136.0, 208.0, 195.0) for i in range(4)]
    df = spark.createDataFrame(rows, "crop_id string, x int, y int, width int, height int, L double, a double, b double")
    top = colours.dominant(df)
    assert {(r.crop_id, r.color, r.fraction) for r in top.collect()} == {("blue", "blue", 1.0), ("red", "red", 1.0)}
    assert {(r.crop_id, r.color) for r in colours.chromatic(top).collect()} == {("blue", "blue"), ("red", "red")}
