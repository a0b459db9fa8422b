"""Streaming forms, run once over the whole given table (AvailableNow) into a table of the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from camtrail.scale import shared_folder
from camtrail.schema import RULES
from camtrail.sources import keyed
from camtrail.streaming import live, ordered, sinks, watch
from checks.ingest import link_sql
from checks.registry import query
from checks.retrieval import ALERTS
from checks.views import LABEL_OF_FLAG, TABLES, _case

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(d, name: str) -> DataFrame:
    """One of the given tables as a file stream."""
    schema = d.table(name).schema
    return d.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d.folder)


def frames(d, name: str = "events") -> DataFrame:
    ts = F.col("ts")
    return stream(d, name).select(
        F.concat(F.lit("cam_"), F.col("user_id") % 6).alias("camera"), F.col("event_id").alias("frame_no"), F.col("user_id").alias("track_id"),
        ts.alias("recv_ts"), F.timestamp_add("MICROSECOND", F.floor(F.col("value") * 1000).cast("long"), ts).alias("processed_ts"), "event_type", "value",
    )


def place(d) -> str:
    return f"{shared_folder(d.spark)}/run-{uuid.uuid4().hex}"


def run(d, rows: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream over all its input into a table and read it back."""
    at = place(d)
    q = (
        rows.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return d.spark.read.schema(rows.schema).parquet(f"{at}/out")


def run_sink(d, rows: DataFrame, sink) -> None:
    q = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place(d)}/state").trigger(availableNow=True).start()
    q.awaitTermination()


# What lies inside the final watermark stays open: windows end at least the delay before the last frame.
CLOSED = "(SELECT max(recv_ts) - INTERVAL 10 SECOND FROM stream_frames)"


@query(
    "t01_conflation_stream",
    f"""SELECT * FROM (SELECT camera, time_bucket(INTERVAL 1 HOUR, recv_ts) AS slot, arg_max(frame_no, (recv_ts, frame_no)) AS frame_no, count(*) AS received, count(*) - 1 AS dropped FROM stream_frames GROUP BY 1, 2)
    WHERE slot + INTERVAL 1 HOUR <= {CLOSED}""",
)
def _(d):
    out = run(d, live.conflate(frames(d), "1 hour"))
    return out.select("camera", F.col("slot").cast("timestamp_ntz").alias("slot"), "frame_no", "received", "dropped")


# Rows that the final watermark has passed; it is kept in milliseconds.
MARK = "(SELECT epoch_us(max(recv_ts)) // 1000 * 1000 - 10000000 FROM stream_frames)"


@query(
    "t02_exact_fps_stream",
    f"""SELECT camera, us, n, round(CASE WHEN n > 1 AND us - first > 100000 THEN (n - 1) / ((us - first) / 1000000.0::DOUBLE) ELSE n / 3600.0::DOUBLE END, 1) AS fps
    FROM (SELECT DISTINCT camera, us, count(*) OVER w AS n, min(us) OVER w AS first FROM (SELECT camera, epoch_us(recv_ts) AS us FROM stream_frames)
      WINDOW w AS (PARTITION BY camera ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)) WHERE us < {MARK}""",
)
def _(d):
    """The rate at every frame from the ring of receive times, up to the watermark."""
    d.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return run(d, ordered.frame_rates(frames(d), 3600))


@query(
    "t04_silences_stream",
    f"""SELECT camera, us AS since_us, row_number() OVER (PARTITION BY camera ORDER BY us) AS reconnects FROM (
      SELECT *, lead(us) OVER (PARTITION BY camera ORDER BY us, frame_no) AS next FROM (SELECT camera, frame_no, epoch_us(recv_ts) AS us FROM stream_frames))
    WHERE us < {MARK} AND least(coalesce(next, {MARK}), {MARK}) - us > 1800000000""",
)
def _(d):
    """Cameras that fell silent, with or without a frame after it."""
    d.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return run(d, ordered.silences(frames(d), 1800)).select("camera", "since_us", "reconnects")


@query(
    "t02_effective_fps_stream",
    f"""SELECT camera, closed AS "at", n FROM (SELECT camera, time_bucket(INTERVAL 30 MINUTE, recv_ts) + to_minutes(CAST(30 * k AS INTEGER)) AS closed, count(*) AS n
      FROM stream_frames, range(1, 3) r(k) GROUP BY 1, 2) WHERE closed <= {CLOSED}""",
)
def _(d):
    out = run(d, live.sliding_fps(frames(d), 3600, 1800))
    return out.select("camera", F.col("at").cast("timestamp_ntz").alias("at"), "n")


@query(
    "t03_lag_stream",
    f"""SELECT camera, slot, round(avg(lag), 3) AS lag_s FROM (SELECT camera, time_bucket(INTERVAL 1 HOUR, recv_ts) AS slot, (epoch_us(processed_ts) - epoch_us(recv_ts)) / 1000000.0::DOUBLE AS lag FROM stream_frames)
    GROUP BY camera, slot HAVING slot + INTERVAL 1 HOUR <= {CLOSED}""",
)
def _(d):
    out = run(d, live.mean_lag(frames(d), "1 hour"))
    return out.select("camera", F.col("slot").cast("timestamp_ntz").alias("slot"), "lag_s")


@query(
    "t05_recordings_stream",
    f"""WITH e AS (SELECT camera, recv_ts, sum(CASE WHEN prev IS NULL OR recv_ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY recv_ts, frame_no) AS r FROM (
      SELECT *, lag(recv_ts) OVER (PARTITION BY camera ORDER BY recv_ts, frame_no) AS prev FROM stream_frames))
    SELECT camera, min(recv_ts) AS start, max(recv_ts) AS last_frame, count(*) AS frames FROM e GROUP BY camera, r HAVING max(recv_ts) + INTERVAL 30 MINUTE <= {CLOSED}""",
)
def _(d):
    """Session windows close a recording when the next frame is at least the gap away."""
    out = run(d, live.recordings(frames(d), "30 minutes"))
    return out.select("camera", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_frame").cast("timestamp_ntz").alias("last_frame"), "frames")


@query("t06_tracks_seen_stream", "SELECT camera, count(DISTINCT track_id) AS tracks FROM stream_frames GROUP BY camera")
def _(d):
    out = run(d, live.new_tracks(frames(d), "60 days").select("camera", "track_id"))
    return out.groupBy("camera").agg(F.count(F.lit(1)).alias("tracks"))


@query("t07_box_linking_stream", link_sql("label") + "SELECT video, us, rid, stretch, track_no FROM steps WHERE us < (SELECT max(frame_idx) FROM detections) * 1000000 - 10000000")
def _(d):
    """Boxes linked with keyed state in event-time order, up to the watermark; recordings of a hundred frames per label."""
    d.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    x1, y1 = (F.col("l_partkey") % 8) / 20.0, (F.col("l_suppkey") % 5) / 20.0
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = stream(d, "lineitem").select(
        F.lit("cam_0").alias("camera"), F.concat_ws("_", _case("l_returnflag", LABEL_OF_FLAG), F.floor(F.floor(F.col("l_orderkey") / 8) / 100)).alias("video"), (F.floor(F.col("l_orderkey") / 8) * 1000000).alias("us"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("rid"), x1.alias("x1"), y1.alias("y1"),
        (x1 + 0.3 + F.col("l_quantity") / 250.0).alias("x2"), (y1 + 0.3 + F.col("l_discount")).alias("y2"),
    )
    return run(d, ordered.link_boxes(rows)).drop("camera")


@query(
    "t08_live_track_upsert",
    """SELECT 'cam_' || (user_id % 6) || '_trk_' || user_id AS id, min(ts) AS t_start, max(ts) AS t_end, arg_max(ts, (value, ts)) AS t_best, 'cam_' || (user_id % 6) AS camera, count(*) AS hits
    FROM events GROUP BY user_id""",
)
def _(d):
    rows = frames(d).select(
        F.concat("camera", F.lit("_trk_"), "track_id").alias("id"), "camera", F.col("recv_ts").alias("ts"), F.col("value").alias("quality"), F.col("event_type").alias("label")
    )
    at = f"{place(d)}/tracks"
    run_sink(d, rows, sinks.live_tracks(at))
    return sinks.live_table(d.spark, at, sinks.LIVE.replace("timestamp", "timestamp_ntz")).read().select("id", "t_start", "t_end", "t_best", "camera", "hits")


@query(
    "t09_incremental_alerts",
    f"""SELECT rule_id, track_id, camera, round(sim, 4) AS score, ts FROM {ALERTS}
    UNION ALL SELECT r.id, NULL, NULL, NULL, max(a.ts) FROM rules r LEFT JOIN {ALERTS} a ON a.rule_id = r.id GROUP BY r.id""",
)
def _(d):
    """New tracks stream against stored rules; a repeated batch adds nothing. Events, and a row per rule with the time it last fired."""
    at = place(d)
    layout = RULES.replace("array<float>", "array<double>")
    table = keyed.rules(d.spark, f"{at}/rules", layout)
    table.upsert(d.rules, "rules")
    d.tracks.select("id", "camera", "label", "t_start", "snapshot", "emb").write.parquet(f"{at}/tracks")
    rows = d.spark.readStream.schema(d.spark.read.parquet(f"{at}/tracks").schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/tracks")
    sink = sinks.alert_events(f"{at}/rules", f"{at}/events", rules_schema=layout)
    run_sink(d, rows, lambda batch, n: (sink(batch, n), sink(batch, n)) and None)
    fired = keyed.events(d.spark, f"{at}/events").read().select("rule_id", "track_id", "camera", "score", "ts")
    last = table.read().select(F.col("id").alias("rule_id"), F.col("last_triggered_at").alias("ts"))
    return fired.unionByName(last, allowMissingColumns=True)


@query(
    "t10_fleet_status_stream",
    "SELECT camera, count(*) AS frames_received, round(avg((epoch_us(processed_ts) - epoch_us(recv_ts)) / 1000000.0::DOUBLE), 3) AS lag FROM stream_frames GROUP BY camera",
)
def _(d):
    """Update mode: every batch writes the counters it changed, the newest row of a camera counts."""
    at = place(d)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/status/batch={n}")

    q = live.fleet_status(frames(d)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    status = d.spark.read.parquet(f"{at}/status")
    return status.groupBy("camera").agg(F.max_by("frames_received", "batch").alias("frames_received"), F.max_by("lag", "batch").alias("lag"))


@query(
    "t11_growing_vocabulary",
    "SELECT event_id AS frame_no, event_type AS label FROM events WHERE event_type IN ('view', 'click', 'error')",
)
def _(d):
    at = place(d)
    words = d.table("events").select(F.initcap("event_type").alias("label")).distinct()
    words.filter(F.lower("label").isin("view", "click")).write.parquet(f"{at}/words")
    words.filter(F.lower("label") == "error").write.mode("append").parquet(f"{at}/words")
    run_sink(d, frames(d).select("frame_no", F.col("event_type").alias("label")), sinks.with_vocabulary(f"{at}/words", f"{at}/out"))
    return d.spark.read.parquet(f"{at}/out").select("frame_no", "label")


@query(
    "t12_watermarked_segments",
    f"SELECT * FROM (SELECT camera, time_bucket(INTERVAL 10 SECOND, recv_ts) AS segment, count(*) AS frames FROM stream_frames GROUP BY 1, 2) WHERE segment + INTERVAL 10 SECOND <= {CLOSED}",
)
def _(d):
    """Only segments the watermark has passed are final."""
    out = run(d, live.segments(frames(d)))
    return out.select("camera", F.col("segment").cast("timestamp_ntz").alias("segment"), "frames")


@query("s18_folder_watch", "SELECT file, true AS filled FROM (VALUES " + ", ".join(f"('{t}.parquet')" for t in TABLES) + ") AS t(file)")
def _(d):
    """The tables of the data folder, each of their files taken once, when two looks agree on its size. A table may be a file or a folder of parts."""
    at = place(d)

    def take(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/seen/batch={n}")

    look = watch.stable_files(d.folder, f"{at}/looks", take, ("parquet",))
    for _ in range(10):  # a look is due once a second has passed
        watch.watch_stable(d.spark, look, f"{at}/state", once=True).awaitTermination()
        if watch.looks_table(d.spark, f"{at}/looks").version() >= 2:
            break
    seen = d.spark.read.parquet(f"{at}/seen")
    file = F.regexp_extract("path", r"^.*?/([^/]+\.parquet)(?:/.*)?$", 1).alias("file")
    return seen.groupBy(file).agg((F.min(F.col("length") > 0) & (F.count("path") == F.count_distinct("path"))).alias("filled"))
