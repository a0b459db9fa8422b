"""Sources and index maintenance, track building, live measures, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from camtrail import schema as S
from camtrail.functions import boxes, text, vectors, vocabulary as V
from camtrail.operators import alerts, colours, evaluation, greedy, live, tracks as T
from camtrail.plans import ingest as plan
from camtrail.scale import micros
from camtrail.sources import index, keyed, video_files
from checks.expressions import dot
from checks.registry import query, stored
from checks.retrieval import ALERTS, greedy_sql
from checks.views import seconds_sql

# --- Index maintenance -------------------------------------------------------

VIDEO_COLS = ["camera", "start_time", "fps", "width", "height", "duration_s", "start_source", "rotation", "indexed_at"]
LATEST = f"(SELECT path, {', '.join(f'arg_max({c}, seq) AS {c}' for c in VIDEO_COLS)} FROM video_updates GROUP BY path)"


@query("s01_index_scan", "SELECT event_id, event_type, ts FROM events WHERE value > 100")
def _(d):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = index.scan(d.spark, f"{d.folder}/events.parquet", schema, ["event_id", "event_type", "ts", "value"])
    return rows.filter("value > 100").drop("value")


@query(
    "s02_video_upsert",
    f"SELECT coalesce(b.path, u.path) AS path, {', '.join(f'CASE WHEN u.path IS NOT NULL THEN u.{c} ELSE b.{c} END AS {c}' for c in VIDEO_COLS)} FROM videos b FULL JOIN {LATEST} u ON u.path = b.path",
)
def _(d):
    table = stored(d, keyed.videos, d.videos)
    table.upsert(index.last_version(d.video_updates, "path", "seq"), "update")
    return table.read().select(d.videos.columns)


TRACK_UPDATES = "(SELECT 't' || event_id AS id, 'w' || user_id AS video, 'cam_x' AS camera, -event_id AS track_id, event_type AS label, ts AS t_start, value AS quality FROM events)"


@query(
    "s03_track_upsert",
    f"""SELECT coalesce(b.id, u.id) AS id, coalesce(b.video, u.video) AS video, coalesce(b.camera, u.camera) AS camera, coalesce(b.track_id, u.track_id) AS track_id,
    coalesce(u.label, b.label) AS label, coalesce(u.t_start, b.t_start) AS t_start, coalesce(u.quality, b.quality) AS quality
    FROM tracks b FULL JOIN {TRACK_UPDATES} u ON u.id = b.id""",
)
def _(d):
    cols = ["id", "video", "camera", "track_id", "label", "t_start", "quality"]
    new = d.table("events").select(
        F.concat(F.lit("t"), "event_id").alias("id"), F.concat(F.lit("w"), "user_id").alias("video"), F.lit("cam_x").alias("camera"),
        (-F.col("event_id")).alias("track_id"), F.col("event_type").alias("label"), F.col("ts").alias("t_start"), F.col("value").alias("quality"),
    )
    table = stored(d, keyed.tracks, d.tracks.select(cols))
    table.upsert(new, "update")
    return table.read().select(cols)


@query(
    "s04_frame_upsert",
    """SELECT coalesce(b.id, u.id) AS id, coalesce(b.video, u.video) AS video, coalesce(b.camera, u.camera) AS camera, coalesce(u.t_abs, b.t_abs) AS t_abs,
    coalesce(u.offset_s, b.offset_s) AS offset_s, coalesce(u.snapshot, b.snapshot) AS snapshot FROM frames b
    FULL JOIN (SELECT 'f' || (event_id * 2) AS id, 'w' || user_id AS video, 'cam_x' AS camera, ts AS t_abs, value / 2 AS offset_s, props AS snapshot FROM events) u ON u.id = b.id""",
)
def _(d):
    cols = ["id", "video", "camera", "t_abs", "offset_s", "snapshot"]
    new = d.table("events").select(
        F.concat(F.lit("f"), F.col("event_id") * 2).alias("id"), F.concat(F.lit("w"), "user_id").alias("video"), F.lit("cam_x").alias("camera"),
        F.col("ts").alias("t_abs"), (F.col("value") / 2).alias("offset_s"), F.col("props").alias("snapshot"),
    )
    table = stored(d, keyed.frames, d.frames.select(cols))
    table.upsert(new, "update")
    return table.read().select(cols)


CONFIG = "(SELECT coalesce(n.k, r.k) AS key, coalesce(n.v, r.v) AS value FROM (SELECT r_name AS k, 'r' || r_regionkey AS v FROM region) r FULL JOIN (SELECT CASE n_nationkey WHEN 1 THEN 'ASIA' ELSE n_name END AS k, 'n' || n_regionkey AS v FROM nation) n ON n.k = r.k)"


@query(
    "s05_config_upsert_lookup",
    f"SELECT s.c_mktsegment AS key, coalesce(c.value, 'default') AS value FROM (SELECT DISTINCT c_mktsegment FROM customer UNION SELECT r_name FROM region UNION SELECT n_name FROM nation) s LEFT JOIN {CONFIG} c ON c.key = s.c_mktsegment",
)
def _(d):
    base = d.table("region").select(F.col("r_name").alias("key"), F.concat(F.lit("r"), "r_regionkey").alias("value"))
    key = F.when(F.col("n_nationkey") == 1, "ASIA").otherwise(F.col("n_name"))
    new = d.table("nation").select(key.alias("key"), F.concat(F.lit("n"), "n_regionkey").alias("value"))
    config = index.upsert_rows(base, new, "key")
    keys = d.table("customer").select(F.col("c_mktsegment").alias("key")).union(d.table("region").select("r_name")).union(d.table("nation").select("n_name"))
    return index.lookup_config(keys.distinct(), config, F.lit("default"))


@query(
    "s06_skip_indexed",
    """SELECT DISTINCT path, rel_path FROM (SELECT 'v' || (l_orderkey + l_linenumber * 2000) AS path, 'v' || (l_orderkey * 3) AS rel_path FROM lineitem)
    WHERE path NOT IN (SELECT path FROM videos) AND rel_path NOT IN (SELECT path FROM videos)""",
)
def _(d):
    files = d.table("lineitem").select(
        F.concat(F.lit("v"), F.col("l_orderkey") + F.col("l_linenumber") * 2000).alias("path"),
        F.concat(F.lit("v"), F.col("l_orderkey") * 3).alias("rel_path"),
    ).distinct()
    return index.new_inputs(files, d.videos).select("path", "rel_path")


@query(
    "s07_force_reindex",
    """SELECT id, video, label FROM tracks WHERE video NOT IN (SELECT path FROM videos WHERE camera IN ('cam_1', 'cam_2'))
    UNION ALL SELECT 'n' || o_orderkey, 'v' || o_orderkey, 'new' FROM orders WHERE 'cam_' || (o_custkey % 6) IN ('cam_1', 'cam_2')""",
)
def _(d):
    again = d.videos.filter(F.col("camera").isin("cam_1", "cam_2")).select(F.col("path").alias("video"))
    rows = again.select(F.regexp_replace("video", "^v", "n").alias("id"), "video", F.lit("new").alias("label"))
    cols = ["id", "video", "camera", "label", "t_start"]
    table = stored(d, keyed.tracks, d.tracks.select(cols))
    table.replace(again, "video", rows.select("id", "video", F.lit("cam_x").alias("camera"), "label", F.lit(None).cast("timestamp_ntz").alias("t_start")), "again")
    return table.read().select("id", "video", "label")


@query("s08_delete_by_camera", "SELECT path, camera FROM videos WHERE camera NOT IN ('cam_0', 'cam_5')")
def _(d):
    return index.drop_cameras(d.videos, ["cam_0", "cam_5"]).select("path", "camera")


@query(
    "s09_drift_tolerant_load",
    """SELECT id, camera, grp, offset_start, CASE WHEN offset_start < 50 THEN offset_best ELSE offset_start END AS offset_best, colors, quality, hits, snapshot
    FROM (SELECT id, camera, 'object' AS grp, offset_start, offset_best, '{}' AS colors, 0.0::DOUBLE AS quality, CAST(1 AS BIGINT) AS hits, CAST(NULL AS VARCHAR) AS snapshot FROM tracks)""",
)
def _(d):
    """A table written before group, colours, quality and hits existed, with best offsets missing in part."""
    best = F.when(F.col("offset_start") < 50, F.col("offset_best"))
    old = d.tracks.select("id", "camera", "offset_start", best.alias("offset_best"))
    full = index.load_tolerant(old, S.TRACKS, index.track_defaults())
    return full.select("id", "camera", "grp", "offset_start", "offset_best", "colors", "quality", "hits", "snapshot")


@query(
    "s10_integrity_check",
    f"""SELECT 'track_video' AS kind, id, video AS missing FROM tracks WHERE video NOT IN (SELECT path FROM videos)
    UNION ALL SELECT 'frame_video', id, video FROM frames WHERE video NOT IN (SELECT path FROM videos)
    UNION ALL SELECT 'event_rule', 'evt_' || sha256(length(rule_id) || '|' || rule_id || '|' || track_id), rule_id FROM {ALERTS} WHERE rule_id IN (SELECT id FROM rules WHERE camera_filter IS NULL)
    UNION ALL SELECT 'event_track', 'evt_' || sha256(length(rule_id) || '|' || rule_id || '|' || track_id), track_id FROM {ALERTS} WHERE label = 'dog'""",
)
def _(d):
    """Rules without a camera and tracks of dogs were removed, their events stayed."""
    events = alerts.evaluate(d.rules, d.tracks)
    lost = index.violations(d.videos, d.tracks, d.frames, d.rules.filter("camera_filter is not null"), events)
    kinds = lost.filter(F.col("kind") != "event_track")
    by_track = index.violations(d.videos, d.tracks.filter("label <> 'dog'"), d.frames, d.rules, events).filter(F.col("kind") == "event_track")
    return kinds.union(by_track)


@query(
    "s11_index_merge",
    f"""SELECT coalesce(u.path, b.path) AS path, CASE WHEN u.path IS NOT NULL THEN u.camera ELSE b.camera END AS camera, CASE WHEN u.path IS NOT NULL THEN u.duration_s ELSE b.duration_s END AS duration_s
    FROM videos b FULL JOIN (SELECT * FROM {LATEST} WHERE path NOT LIKE 'v1%') u ON u.path = b.path""",
)
def _(d):
    other = index.last_version(d.video_updates, "path", "seq")
    table = stored(d, keyed.videos, d.videos)
    table.merge(other, "path", "v1%", "merge")
    return table.read().select("path", "camera", "duration_s")


@query("s12_vector_codec", "SELECT id, CAST(256 AS BIGINT) AS n_bytes, emb[1]::DOUBLE AS u_first, emb[64]::DOUBLE AS u_last, true AS same FROM tracks")
def _(d):
    coded = d.tracks.select("id", "emb", vectors.encode_f4("emb").alias("blob"))
    back = coded.withColumn("back", vectors.decode_f4("blob"))
    return back.select("id", F.length("blob").cast("long").alias("n_bytes"), F.col("back")[0].cast("double").alias("u_first"),
                       F.col("back")[63].cast("double").alias("u_last"), (F.col("back") == F.col("emb")).alias("same"))


@query(
    "s13_manifest_and_corpus_json",
    """SELECT path AS file, start_time, camera, coalesce(start_source, 'x') AS start_source FROM videos""",
)
def _(d):
    """A manifest document per file folder (camera and day), then its entries as rows again."""
    entry = F.struct(F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"), "camera", "start_source")
    docs = d.videos.groupBy("camera", F.to_date("start_time").alias("day")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("path", entry)))).alias("value")
    )
    return video_files.manifest_rows(docs.select("value"))


FILES = f"""(SELECT CASE event_id % 5 WHEN 0 THEN 'rec/gate_' || user_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.mp4'
  WHEN 1 THEN 'rec/cam' || user_id || '_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.mkv' WHEN 2 THEN 'rec/' || strftime(ts, '%Y%m%d-%H%M%S') || '_' || event_id || '.mp4'
  WHEN 3 THEN 'rec/bad_20249931_' || event_id || '.mp4' ELSE 'rec/clip_' || event_id || '.mov' END AS path, event_id, user_id, ts, event_type, value FROM events)"""


def files(d):
    e, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    path = (
        F.when(e % 5 == 0, F.concat(F.lit("rec/gate_"), u, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".mp4")))
        .when(e % 5 == 1, F.concat(F.lit("rec/cam"), u, F.lit("_"), F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit(".mkv")))
        .when(e % 5 == 2, F.concat(F.lit("rec/"), F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("_"), e, F.lit(".mp4")))
        .when(e % 5 == 3, F.concat(F.lit("rec/bad_20249931_"), e, F.lit(".mp4"))).otherwise(F.concat(F.lit("rec/clip_"), e, F.lit(".mov")))
    )
    return d.table("events").withColumn("path", path)


_SEC = "date_trunc('second', ts)"
FILE_TIME = f"CASE WHEN event_id % 5 < 3 THEN {_SEC} END"
FILE_CAM = "CASE event_id % 5 WHEN 0 THEN 'gate_' || user_id WHEN 1 THEN 'cam' || user_id END"


@query("s16_filename_time", f"SELECT path, {FILE_TIME} AS start_time, {FILE_CAM} AS camera FROM {FILES}")
def _(d):
    return files(d).withColumn("f", text.file_time(F.col("path"))).select("path", "f.start_time", "f.camera")


@query(
    "s15_start_time_resolution",
    f"""SELECT path, CASE WHEN event_type = 'view' THEN {_SEC} - INTERVAL 1 DAY WHEN event_type = 'click' THEN {_SEC} + INTERVAL 2 DAY WHEN event_id % 5 < 3 THEN {_SEC}
      WHEN value > 20 THEN {_SEC} + INTERVAL 3 HOUR ELSE {_SEC} + INTERVAL 5 HOUR END AS start_time,
    CASE WHEN event_type = 'view' THEN CASE WHEN value > 50 THEN 'front' ELSE stem END WHEN event_type = 'click' THEN 'm' || user_id
      WHEN event_id % 5 < 3 THEN coalesce(CASE WHEN value > 50 THEN 'front' END, {FILE_CAM}, stem) ELSE CASE WHEN value > 50 THEN 'front' ELSE stem END END AS camera,
    CASE WHEN event_type = 'view' THEN 'manual' WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'audited' ELSE 'manifest' END
      WHEN event_id % 5 < 3 THEN 'filename' WHEN value > 20 THEN 'ffprobe' ELSE 'mtime_fallback' END AS start_source
    FROM (SELECT *, regexp_extract(path, '^rec/(.*)[.][a-z0-9]+$', 1) AS stem FROM {FILES})""",
)
def _(d):
    f = files(d)
    sec = F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    day = lambda n: F.make_dt_interval(F.lit(n))
    rows = f.select(
        "path", (sec + hours(5)).alias("mtime"), F.when(F.col("event_type") == "view", sec - day(1)).alias("manual_start"),
        F.when(F.col("value") > 50, "front").alias("manual_camera"), F.when(F.col("value") > 20, sec + hours(3)).alias("creation_time"),
    )
    manifest = f.filter(F.col("event_type") == "click").select(
        F.regexp_replace("path", "^rec/", "").alias("file"), (sec + day(2)).alias("start_time"), F.concat(F.lit("m"), "user_id").alias("camera"),
        F.when(F.col("user_id") % 2 == 0, "audited").alias("start_source"),
    )
    return video_files.resolve_start(rows, manifest)


@query(
    "s17_container_metadata",
    """SELECT o_orderkey, CAST(640 + o_orderkey % 7 AS INTEGER) AS width, CAST(480 AS INTEGER) AS height,
     round(CASE WHEN o_orderkey % 3 = 0 THEN 30000.0::DOUBLE / 1001 WHEN o_orderkey % 3 = 1 THEN 25.0 ELSE 30.0 END, 6) AS fps,
     o_totalprice AS duration_s, CASE WHEN o_orderkey % 4 < 2 THEN (((o_orderkey % 5 - 2) * 90) % 360 + 360) % 360 WHEN o_orderkey % 4 = 2 THEN 180 ELSE 0 END AS rotation,
     CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 2 HOUR END AS creation_time FROM orders""",
)
def _(d):
    k = F.col("o_orderkey")
    rate = F.when(k % 3 == 0, "30000/1001").when(k % 3 == 1, "25").otherwise("30/1")
    side = F.when(k % 4 < 2, F.format_string('[{"x":1},{"rotation":%d}]', (k % 5 - 2) * 90)).otherwise("[]")
    tags = F.when(k % 4 == 2, '{"rotate":"180"}').otherwise("{}")
    created = F.when(k % 2 == 0, F.concat(F.lit('"creation_time":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+02:00"'))).otherwise('"x":"y"')
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    in_stream = k % 2 == 1
    json = F.concat(
        F.lit('{"streams":[{"width":'), 640 + k % 7, F.lit(',"height":480,"r_frame_rate":"'), rate, F.lit('",'),
        F.when(in_stream, F.concat(F.lit('"duration":"'), price, F.lit('",'))).otherwise(""), F.lit('"tags":'), tags,
        F.lit(',"side_data_list":'), side, F.lit('}],"format":{"duration":"'), F.when(in_stream, F.lit("1.0")).otherwise(price),
        F.lit('","tags":{'), created, F.lit("}}}"),
    )
    return d.table("orders").withColumn("p", video_files.probe_fields(json)).select(
        "o_orderkey", "p.width", "p.height", F.round("p.fps", 6).alias("fps"), "p.duration_s", F.col("p.rotation").cast("long").alias("rotation"), "p.creation_time"
    )


# --- Track building ------------------------------------------------------------

PRIMARY, SECONDARY = "(SELECT * FROM detections WHERE source = 'O')", "(SELECT * FROM detections WHERE source = 'F')"


def iou_sql(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    inter = f"(greatest({w}, 0.0::DOUBLE) * greatest({h}, 0.0::DOUBLE))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {inter} <= 0 OR {union} <= 0 THEN 0.0::DOUBLE ELSE {inter} / {union} END)"


@query(
    "d03_iou",
    f"SELECT a.rid AS a, b.rid AS b, round({iou_sql('a', 'b')}, 9) AS iou FROM detections a JOIN detections b ON a.frame_idx = b.frame_idx AND a.grp = b.grp AND a.rid < b.rid AND {iou_sql('a', 'b')} >= 0.8",
)
def _(d):
    """Strongly overlapping boxes of a frame; only pairs that pass leave the join."""
    a, b = d.detections.alias("a"), d.detections.alias("b")
    box = lambda s: {c: F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")}
    iou = boxes.iou(box("a"), box("b"))
    same = (F.col("a.frame_idx") == F.col("b.frame_idx")) & (F.col("a.grp") == F.col("b.grp")) & (F.col("a.rid") < F.col("b.rid"))
    return a.join(b, same & (iou >= 0.8)).select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b"), F.round(iou, 9).alias("iou"))


@query(
    "j06_secondary_suppression",
    f"SELECT rid FROM {SECONDARY} s WHERE NOT EXISTS (SELECT 1 FROM {PRIMARY} p WHERE p.frame_idx = s.frame_idx AND {iou_sql('s', 'p')} > 0.40)",
)
def _(d):
    primary, secondary = (d.detections.filter(F.col("source") == s) for s in ("O", "F"))
    return T.suppress_secondary(primary, secondary, ["frame_idx"]).select("rid")


def nms_sql(threshold: float) -> str:
    return greedy_sql(
        "SELECT * FROM detections", "frame_idx, grp", "conf DESC, rid", f"{iou_sql('k', 'o')} >= {threshold}",
        "{'rid': o.rid, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}",
    ) + " SELECT frame_idx, grp, k.rid AS rid FROM (SELECT frame_idx, grp, unnest(kept) AS k FROM kept)"


@query("d02_class_group_nms", nms_sql(0.60))
def _(d):
    return greedy.suppress_overlaps(d.detections, ["frame_idx", "grp"]).select("frame_idx", "grp", "rid")


@query("d02_class_group_nms_050", nms_sql(0.50))
def _(d):
    return greedy.suppress_overlaps(d.detections, ["frame_idx", "grp"], threshold=0.50).select("frame_idx", "grp", "rid")


VOTES = """(SELECT camera, video, track_id, label, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY camera, video, track_id ORDER BY w DESC, seen) AS rn FROM (
  SELECT camera, video, track_id, label, round(sum(conf), 9) AS w, min((frame_idx, rid)) AS seen FROM observations GROUP BY camera, video, track_id, label)) WHERE rn = 1)"""
SUMMARY = f"""(SELECT o.*, v.label FROM (SELECT camera, video, track_id, count(*) AS hits, round(avg(conf), 9) AS mean_conf,
   arg_min(ts, (frame_idx, rid)) AS t_start, arg_max(ts, (frame_idx, rid)) AS t_end, arg_min(ts, (-quality, frame_idx, rid)) AS t_best,
   arg_min(offset_s, (frame_idx, rid)) AS offset_start, arg_max(offset_s, (frame_idx, rid)) AS offset_end, arg_min(x1, (-quality, frame_idx, rid)) AS bx1,
   greatest(0.0::DOUBLE, arg_max(offset_s, (frame_idx, rid)) - arg_min(offset_s, (frame_idx, rid))) AS duration_s, round(max(quality), 4) AS quality
  FROM observations GROUP BY camera, video, track_id) o JOIN {VOTES} v USING (camera, video, track_id))"""
SUMMARY_COLS = ["camera", "video", "track_id", "hits", "mean_conf", "t_start", "t_end", "t_best", "offset_start", "offset_end", "bx1", "duration_s", "quality", "label"]


def summary(d):
    return T.summarise(d.observations).withColumn("mean_conf", F.round("mean_conf", 9))


@query("a01_track_summary", f"SELECT {', '.join(SUMMARY_COLS)} FROM {SUMMARY}")
def _(d):
    return summary(d).select(*SUMMARY_COLS)


@query("a02_label_vote", f"SELECT camera, video, track_id, label, weight FROM {VOTES}")
def _(d):
    return T.label_votes(d.observations)


@query(
    "a03_legacy_best_frame",
    """SELECT camera, video, track_id, arg_min(label, (frame_idx, rid)) AS label, arg_min(frame_idx, (-((x2 - x1) * (y2 - y1) * conf), frame_idx, rid)) AS best_frame,
     arg_min(offset_s, (-((x2 - x1) * (y2 - y1) * conf), frame_idx, rid)) AS offset_best FROM observations WHERE (x2 - x1) * (y2 - y1) > 0 GROUP BY camera, video, track_id""",
)
def _(d):
    return T.best_by_area(d.observations)


REASON = "CASE WHEN duration_s < 1.0 THEN 'duration' WHEN hits < 4 THEN 'hits' WHEN mean_conf < 0.35 THEN 'mean_conf' END"


@query("f07_track_quality_filter", f"SELECT camera, video, track_id, hits, mean_conf FROM {SUMMARY} WHERE {REASON} IS NULL")
def _(d):
    return T.keep_good(summary(d)).select("camera", "video", "track_id", "hits", "mean_conf")


@query(
    "a04_drop_reason_counts",
    f"SELECT coalesce(r, 'total_dropped') AS drop_reason, count(*) AS n FROM (SELECT {REASON} AS r FROM {SUMMARY}) WHERE r IS NOT NULL GROUP BY ROLLUP (r)",
)
def _(d):
    return T.drop_counts(T.with_drop_reason(summary(d)))


@query("a05_label_distribution", "SELECT label, count(*) AS n FROM detections GROUP BY label")
def _(d):
    return T.label_distribution(d.detections)


@query("a06_detectors_side_by_side", "SELECT label, count(*) FILTER (source = 'F') AS F, count(*) FILTER (source = 'O') AS O FROM detections GROUP BY label")
def _(d):
    return evaluation.detections_side_by_side(d.detections, "source", ["F", "O"])


STITCH_GAP, STITCH_SIM = 600, 0.2
STITCH_PAIRS = f"""(SELECT a.camera AS video, a.grp, a.id AS base_id, b.id AS cand_id, {seconds_sql('(epoch_us(b.t_start) - epoch_us(a.t_end))', 3)} AS gap_s,
   round({dot('a.emb', 'b.emb')}, 4) AS cosine_sim FROM tracks a JOIN tracks b ON a.camera = b.camera AND a.grp = b.grp AND (b.t_start, b.id) > (a.t_start, a.id)
   AND epoch_us(b.t_start) - epoch_us(a.t_end) BETWEEN 0 AND {STITCH_GAP * 1000000}
   AND sqrt(pow((a.bx1 + a.bx2) / 2.0 - (b.bx1 + b.bx2) / 2.0, 2) + pow((a.by1 + a.by2) / 2.0 - (b.by1 + b.by2) / 2.0, 2)) <= 0.6
   AND {dot('a.emb', 'b.emb')} >= CASE WHEN a.grp = 'vehicle' THEN -0.1 ELSE -0.2 END)"""


STITCH = {"max_gap_s": STITCH_GAP, "max_distance": 0.6, "min_cosine": -0.2, "min_cosine_vehicle": -0.1}


def stitch_rows(d):
    return d.tracks.select(
        F.col("camera").alias("video"), "grp", "id", micros(F.col("t_start")).alias("start_us"), micros(F.col("t_end")).alias("end_us"), "emb",
        ((F.col("bx1") + F.col("bx2")) / 2.0).alias("fx"), ((F.col("by1") + F.col("by2")) / 2.0).alias("fy"),
    ).withColumn("lx", F.col("fx")).withColumn("ly", F.col("fy"))


@query("j05_stitch_pairs", f"SELECT * FROM {STITCH_PAIRS}")
def _(d):
    return T.stitch_pairs(stitch_rows(d), **STITCH).drop("center_dist")


MATCHED = greedy_sql(f"SELECT * FROM {STITCH_PAIRS}", "video, grp", "cosine_sim DESC, base_id, cand_id", "k.base_id = o.base_id OR k.cand_id = o.cand_id",
                     "{'base_id': o.base_id, 'cand_id': o.cand_id}") + ", matched AS (SELECT k.base_id AS base_id, k.cand_id AS cand_id FROM (SELECT unnest(kept) AS k FROM kept))"


@query("d04_one_to_one_matching", MATCHED + " SELECT base_id, cand_id FROM matched")
def _(d):
    return T.stitch(stitch_rows(d), **STITCH).select("base_id", "cand_id")


ROOTS = MATCHED + """, chain AS (SELECT base_id AS root, cand_id AS id FROM matched WHERE base_id NOT IN (SELECT cand_id FROM matched)
  UNION ALL SELECT c.root, m.cand_id FROM chain c JOIN matched m ON m.base_id = c.id)"""


@query("d05_chain_roots", ROOTS + " SELECT id, root FROM chain")
def _(d):
    return T.chain_roots(T.stitch(stitch_rows(d), **STITCH))


@query(
    "d05_chain_merge",
    ROOTS + """, obs AS (SELECT coalesce(t.camera, o.camera) AS camera, coalesce(c.root, t.id, 'open-' || o.track_id) AS track, o.offset_s, o.conf, o.label, o.frame_idx, o.rid
      FROM observations o LEFT JOIN tracks t ON t.track_id = o.track_id LEFT JOIN chain c ON c.id = t.id)
    SELECT camera, track AS track_id, count(*) AS hits, round(avg(conf), 9) AS mean_conf, max(offset_s) AS offset_end FROM obs GROUP BY camera, track""",
)
def _(d):
    """Observations of stitched tracks summarised again over the whole chain. A track that is not in the index yet keeps its own camera and number."""
    ids = d.tracks.select("track_id", "id", F.col("camera").alias("cam"))
    own = F.coalesce("id", F.concat(F.lit("open-"), "track_id"))
    obs = d.observations.join(ids, "track_id", "left").withColumn("track_id", own).withColumn("camera", F.coalesce("cam", "camera")).withColumn("video", F.lit("all"))
    merged = T.merge_chains(obs.drop("id", "cam"), T.stitch(stitch_rows(d), **STITCH))
    return merged.select("camera", "track_id", "hits", F.round("mean_conf", 9).alias("mean_conf"), "offset_end")


@query(
    "d06_interval_sampling",
    """WITH RECURSIVE f AS (SELECT camera, epoch_us(recv_ts) AS us, min(frame_no) AS frame_no FROM stream_frames GROUP BY camera, recv_ts),
    kept AS (SELECT camera, min(us) AS us FROM f GROUP BY camera
      UNION ALL SELECT k.camera, (SELECT min(f.us) FROM f WHERE f.camera = k.camera AND f.us >= k.us + 3600000000) FROM kept k WHERE k.us IS NOT NULL)
    SELECT f.camera, f.frame_no FROM kept k JOIN f ON f.camera = k.camera AND f.us = k.us""",
)
def _(d):
    rows = d.stream_frames.select("camera", "frame_no", micros(F.col("recv_ts")).alias("us"))
    return greedy.sample_by_interval(rows, ["camera"], "us", "frame_no", 3600).select("camera", "frame_no")


@query(
    "a16_tracks_per_object",
    """SELECT l_suppkey AS clip, round(count(*)::DOUBLE / (1 + l_suppkey % 7), 2) AS ratio_filtered, round(count(*) FILTER (l_linestatus = 'O')::DOUBLE / (1 + l_suppkey % 7), 2) AS ratio_stitched
    FROM lineitem GROUP BY l_suppkey""",
)
def _(d):
    counts = d.table("lineitem").groupBy(F.col("l_suppkey").alias("clip")).agg(
        F.count(F.lit(1)).alias("after_filter"), F.count_if(F.col("l_linestatus") == "O").alias("after_stitch")
    )
    real = d.table("supplier").select(F.col("s_suppkey").alias("clip"), (1 + F.col("s_suppkey") % 7).alias("real_n"))
    return T.tracks_per_object(counts, real)


# --- Catalogue and totals --------------------------------------------------------

@query(
    "a08_camera_catalogue",
    "SELECT camera, arg_min(path, (start_time, path)) AS path, min(start_time) AS start_time, arg_min(fps, (start_time, path)) AS fps FROM videos GROUP BY camera",
)
def _(d):
    return plan.camera_catalogue(d.videos).select("camera", "path", "start_time", "fps")


@query(
    "a09_index_statistics",
    "SELECT 'videos' AS table_name, count(*) AS n FROM videos UNION ALL SELECT 'tracks', count(*) FROM tracks UNION ALL SELECT 'frames', count(*) FROM frames UNION ALL SELECT 'aliases', count(*) FROM aliases",
)
def _(d):
    return plan.statistics(d.videos, d.tracks, d.frames, d.aliases)


@query(
    "a10_ingest_summary",
    "SELECT (SELECT count(*) FROM videos) AS videos, (SELECT count(*) FROM tracks) AS tracks, (SELECT count(*) FROM frames) AS frames, 5000.0::DOUBLE AS wall_s, round(5000.0::DOUBLE / (SELECT sum(duration_s) FROM videos), 4) AS wall_per_duration",
)
def _(d):
    return plan.summary(d.videos, d.tracks, d.frames, 5000.0)


# --- Live measures ------------------------------------------------------------------

@query(
    "t01_conflation",
    "SELECT camera, time_bucket(INTERVAL 1 HOUR, recv_ts) AS slot, arg_max(frame_no, (recv_ts, frame_no)) AS frame_no, max(recv_ts) AS recv_ts, count(*) AS received, count(*) - 1 AS dropped FROM stream_frames GROUP BY 1, 2",
)
def _(d):
    return live.conflate(d.stream_frames, "1 hour").drop("processed")


FPS_S = 1800


@query(
    "t02_effective_fps",
    f"""WITH f AS (SELECT camera, epoch_us(recv_ts) AS us, count(*) AS c FROM stream_frames GROUP BY 1, 2),
    w AS (SELECT camera, us, CAST(sum(c) OVER r AS BIGINT) AS n, min(us) OVER r AS first FROM f WINDOW r AS (PARTITION BY camera ORDER BY us RANGE BETWEEN {FPS_S * 1000000} PRECEDING AND CURRENT ROW))
    SELECT camera, us, n, round(CASE WHEN n > 1 AND (us - first) / 1000000.0::DOUBLE > 0.1 THEN (n - 1) / ((us - first) / 1000000.0::DOUBLE) * 1000 ELSE n / {FPS_S}.0::DOUBLE * 1000 END, 1) AS fps_milli FROM w""",
)
def _(d):
    """Events are minutes apart: rates over half an hour, shown per 1000 seconds."""
    out = live.trailing_counts(d.stream_frames, FPS_S)
    rate = live.frame_rate(F.col("n"), F.col("first"), F.col("us"), FPS_S)
    return out.select("camera", "us", "n", F.round(rate * 1000, 1).alias("fps_milli"))


@query("t03_lag", f"SELECT frame_no, {seconds_sql('(epoch_us(processed_ts) - epoch_us(recv_ts))', 3)} AS lag_s FROM stream_frames")
def _(d):
    return live.with_lag(d.stream_frames).select("frame_no", "lag_s")


GAP_US = 1800 * 1000000
GAPS = f"""(SELECT camera, frame_no, us, {seconds_sql('(us - prev)', 3)} AS gap_s FROM (SELECT camera, frame_no, epoch_us(recv_ts) AS us,
  lag(epoch_us(recv_ts)) OVER (PARTITION BY camera ORDER BY recv_ts, frame_no) AS prev FROM stream_frames) WHERE us - prev > {GAP_US})"""


@query("t04_read_timeouts", f"SELECT camera, frame_no, us, gap_s FROM {GAPS}")
def _(d):
    return live.reconnects(d.stream_frames, 1800)


@query(
    "t04_reconnect_summary",
    f"""SELECT camera, count(*) AS reconnects, string_agg(CASE WHEN rn <= 10 THEN printf('%.3f', gap_s) END, ',' ORDER BY us) AS last_gaps
    FROM (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY us DESC, frame_no DESC) AS rn FROM {GAPS}) GROUP BY camera""",
)
def _(d):
    s = live.reconnect_summary(live.reconnects(d.stream_frames, 1800))
    return s.select("camera", "reconnects", F.array_join(F.transform("last_gaps", lambda g: F.format_string("%.3f", g)), ",").alias("last_gaps"))


@query(
    "t05_recordings",
    f"""WITH e AS (SELECT camera, us, sum(CASE WHEN prev IS NULL OR us - prev > {GAP_US} THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY us, frame_no) AS recording FROM (
      SELECT camera, frame_no, epoch_us(recv_ts) AS us, lag(epoch_us(recv_ts)) OVER (PARTITION BY camera ORDER BY recv_ts, frame_no) AS prev FROM stream_frames))
    SELECT camera, CAST(recording AS BIGINT) AS recording, min(us) AS start_us, max(us) AS end_us FROM e GROUP BY camera, recording""",
)
def _(d):
    return live.recording_sessions(d.stream_frames, 1800).withColumn("recording", F.col("recording").cast("long"))


@query("t05_fixed_segments", "SELECT camera, time_bucket(INTERVAL 10 SECOND, recv_ts) AS segment, count(*) AS frames FROM stream_frames GROUP BY 1, 2")
def _(d):
    return live.segments(d.stream_frames)


@query(
    "t06_tracks_seen",
    "SELECT camera, count(*) AS tracks_indexed, arg_max(track_id, (first_seen, track_id)) AS latest_track, max(first_seen) AS latest_at FROM (SELECT camera, track_id, min(recv_ts) AS first_seen FROM stream_frames GROUP BY 1, 2) GROUP BY camera",
)
def _(d):
    return live.tracks_seen(d.stream_frames)


def link_sql(groups: str) -> str:
    """Box by box in frame order: expire, pick the best free live box, else a new number."""
    new = "{{'no': CAST({0} AS BIGINT), 'us': o.us, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}"
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT {groups} || '_' || (frame_idx // 100) AS video, frame_idx * 1000000 AS us, rid, x1, y1, x2, y2,
      row_number() OVER (PARTITION BY {groups}, frame_idx // 100 ORDER BY frame_idx, rid) AS rn FROM detections),
    steps AS (SELECT video, rn, us, rid, CAST(1 AS BIGINT) AS track_no, CAST(1 AS BIGINT) AS counter, us AS stretch, [{new.format('1')}] AS live FROM o WHERE rn = 1
      UNION ALL SELECT o.video, o.rn, o.us, o.rid, coalesce(pick, base + 1), CASE WHEN pick IS NULL THEN base + 1 ELSE base END,
        CASE WHEN len(kept) = 0 THEN o.us ELSE stretch END,
        CASE WHEN pick IS NULL THEN list_append(kept, {new.format('base + 1')}) ELSE list_transform(kept, lambda k: CASE WHEN k.no = pick THEN {new.format('pick')} ELSE k END) END
      FROM (SELECT o, kept, stretch, CASE WHEN len(kept) = 0 THEN 0 ELSE counter END AS base,
          list_sort(list_transform(list_filter(kept, lambda k: k.us < o.us AND {iou_sql('k', 'o')} > 0.25), lambda k: {{'a': -{iou_sql('k', 'o')}, 'n': k.no}}))[1].n AS pick
        FROM (SELECT o, s.counter, s.stretch, list_filter(s.live, lambda k: o.us - k.us <= 5000000) AS kept FROM steps s JOIN o ON o.video = s.video AND o.rn = s.rn + 1)))
    """


@query("t07_box_linking", link_sql("grp") + "SELECT video, us, rid, stretch, track_no FROM steps")
def _(d):
    """Track numbers for all boxes: one second per frame, recordings of a hundred frames per object group."""
    video = F.concat_ws("_", "grp", F.floor(F.col("frame_idx") / 100))
    rows = d.detections.select(F.lit("cam_0").alias("camera"), video.alias("video"), (F.col("frame_idx") * 1000000).alias("us"), "rid", "x1", "y1", "x2", "y2")
    return live.link_boxes(rows).drop("camera")


@query(
    "a17_stream_sample_stats",
    """SELECT camera, round(avg(fps), 2) AS avg_fps, round(max(fps), 2) AS max_fps, round(min(fps), 2) AS min_fps, round(avg(lag), 3) AS avg_lag_s, round(max(lag), 3) AS max_lag_s, round(min(lag), 3) AS min_lag_s,
      arg_max(received, (ts, sample_no)) AS frames_received, arg_max(processed, (ts, sample_no)) AS frames_processed, greatest(0, arg_max(received, (ts, sample_no)) - arg_max(processed, (ts, sample_no))) AS frames_dropped, count(*) AS num_samples
    FROM (SELECT camera, recv_ts AS ts, frame_no AS sample_no, value / 10 AS fps, value / 1000 AS lag, frame_no AS received, frame_no - track_id AS processed FROM stream_frames) GROUP BY camera""",
)
def _(d):
    samples = d.stream_frames.select(
        "camera", F.col("recv_ts").alias("ts"), F.col("frame_no").alias("sample_no"), (F.col("value") / 10).alias("fps"), (F.col("value") / 1000).alias("lag"),
        F.col("frame_no").alias("received"), (F.col("frame_no") - F.col("track_id")).alias("processed"),
    )
    return live.sample_stats(samples)


@query(
    "t10_fleet_status",
    """WITH p AS (SELECT camera, count(*) AS frames_received, max(epoch_us(recv_ts)) AS last_us, round(avg((epoch_us(processed_ts) - epoch_us(recv_ts)) / 1000000.0::DOUBLE), 3) AS lag FROM stream_frames GROUP BY camera),
    a AS (SELECT *, (SELECT max(epoch_us(recv_ts)) FROM stream_frames) - last_us <= 600000000 AS active FROM p)
    SELECT *, (SELECT CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) FROM a) AS total_active FROM a""",
)
def _(d):
    now = d.stream_frames.agg(F.max(micros(F.col("recv_ts")))).scalar()
    return live.fleet_status(d.stream_frames, now, 600)


# --- Colours --------------------------------------------------------------------------

_CENTRES = ", ".join(f"{{'d': 0.5 * (L - {l}) * (L - {l}) + 1.2 * (a - {a}) * (a - {a}) + 1.2 * (b - {b}) * (b - {b}), 'i': {i}, 'n': '{n}'}}"
                     for i, (n, l, a, b) in enumerate(V.LAB_CENTRES))
_CHROMA = "sqrt((a - 128.0) * (a - 128.0) + (b - 128.0) * (b - 128.0))"
LAB_NAME = f"""CASE WHEN L < 45 AND {_CHROMA} < 35 THEN 'black' WHEN L > 225 AND {_CHROMA} < 25 THEN 'white'
  WHEN {_CHROMA} < 18 THEN CASE WHEN L < 50 THEN 'black' WHEN L < 165 THEN 'grey' WHEN L < 220 THEN 'silver' ELSE 'white' END
  WHEN L < 35 THEN 'black' ELSE list_min([{_CENTRES}]).n END"""
NAMED = f"(SELECT *, {LAB_NAME} AS color FROM pixels)"
PART = "CASE WHEN grp = 'person' THEN CASE WHEN y < 4 THEN 'person_upper' ELSE 'person_lower' END ELSE grp END"


def tops_sql(keys: str, rows: str) -> str:
    return f"""(SELECT {keys}, rank, color, fraction FROM (SELECT {keys}, color, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, color) AS rank,
      round(n::DOUBLE / sum(n) OVER (PARTITION BY {keys}), 3) AS fraction FROM (SELECT {keys}, color, count(*) AS n FROM {rows} GROUP BY {keys}, color)) WHERE rank <= 2)"""


CENTRE = f"(SELECT * FROM {NAMED} WHERE x >= floor(width * 0.1) AND x < floor(width * 0.9) AND y >= floor(height * 0.1) AND y < floor(height * 0.9))"


@query("u06_lab_colour_name", f"SELECT crop_id, x, y, L, a, b, color FROM {NAMED}")
def _(d):
    return colours.name_pixels(d.pixels).select("crop_id", "x", "y", "L", "a", "b", "color")


@query("a18_named_colour_histogram", f"SELECT crop_id, rank, color, fraction FROM {tops_sql('crop_id', CENTRE)}")
def _(d):
    return colours.dominant(colours.centre(d.pixels, 0.8)).withColumn("rank", F.col("rank").cast("long"))


@query("a19_part_colours", f"""SELECT crop_id, '{{' || string_agg('"' || part || '":[' || c || ']', ',' ORDER BY part) || '}}' AS colors FROM (
   SELECT crop_id, part, string_agg('{{"color":"' || color || '","fraction":' || fraction || '}}', ',' ORDER BY rank) AS c FROM {tops_sql('crop_id, part', f'(SELECT *, {PART} AS part FROM {NAMED})')} GROUP BY crop_id, part) GROUP BY crop_id""")
def _(d):
    return colours.part_colours(d.pixels)


@query(
    "a20_mean_hsv_colour",
    """SELECT crop_id, CASE WHEN v < 48 THEN 'black' WHEN s < 42 AND v > 165 THEN 'white' WHEN s < 42 THEN 'silver/gray' WHEN h < 11 OR h > 168 THEN 'red' WHEN h < 26 THEN 'orange'
      WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green' WHEN h < 132 THEN 'blue' ELSE 'purple' END AS color,
     round(CASE WHEN v < 48 THEN least(1.0::DOUBLE, (48 - v) / 30.0::DOUBLE + 0.6) WHEN s < 42 AND v > 165 THEN least(1.0::DOUBLE, (v - 165) / 50.0::DOUBLE + 0.6) WHEN s < 42 THEN 0.75::DOUBLE WHEN h < 11 OR h > 168 THEN 0.85::DOUBLE
      WHEN h < 26 THEN 0.8::DOUBLE WHEN h < 132 THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END, 2) AS conf
    FROM (SELECT crop_id, round(avg(h), 6) AS h, round(avg(s), 6) AS s, round(avg(v), 6) AS v FROM pixels
     WHERE x >= floor(width * 0.2) AND x < floor(width * 0.8) AND y >= floor(height * 0.2) AND y < floor(height * 0.8) GROUP BY crop_id)""",
)
def _(d):
    return colours.mean_hsv_colour(d.pixels)


@query(
    "a21_live_chromatic_colour",
    f"SELECT crop_id, color, fraction FROM {tops_sql('crop_id', CENTRE)} WHERE rank = 1 AND fraction > 0.5 AND color IN ({', '.join(map(repr, V.CHROMATIC))})",
)
def _(d):
    return colours.chromatic(colours.dominant(colours.centre(d.pixels, 0.8)))


@query(
    "a23_classifier_agreement",
    f"""WITH h AS (SELECT crop_id, list(color) AS top2 FROM {tops_sql('crop_id', NAMED)} GROUP BY crop_id),
    z AS (SELECT track_id AS crop_id, CASE cls % 4 WHEN 0 THEN 'blue' WHEN 1 THEN 'red' WHEN 2 THEN 'green' ELSE 'pink' END AS c FROM tracks)
    SELECT count(*) AS n, CAST(sum(CASE WHEN list_contains(top2, c) THEN 1 ELSE 0 END) AS BIGINT) AS n_agree, round(avg(CASE WHEN list_contains(top2, c) THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS agreement_pct FROM h JOIN z USING (crop_id)""",
)
def _(d):
    pick = F.array(*[F.lit(c) for c in ("blue", "red", "green", "pink")])
    zero = d.tracks.select(F.col("track_id").alias("crop_id"), F.get(pick, (F.col("cls") % 4).cast("int")).alias("zero_shot"))
    top = colours.dominant(d.pixels).groupBy("crop_id").agg(F.collect_list("color").alias("top2"))
    return evaluation.classifier_agreement(zero, top, "crop_id")
