"""The given tables seen as video metadata: DataFrames for Spark and the same mapping as SQL for the oracle.

All rows of the given tables are mapped; nothing is sampled or left out.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from camtrail.functions import text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EPOCH = "1970-01-01 00:00:00"
NOW = "2024-01-01 15:00:00"

LABEL_OF_EVENT = {"view": "car", "click": "person", "purchase": "truck", "signup": "object", "error": "dog"}
WORD_OF_EVENT = {"view": "car", "click": "person", "purchase": "truck", "signup": "thing", "error": "dogs"}
LABEL_OF_FLAG = {"A": "person", "N": "car", "R": "bag"}
COLOURS_OF = [
    "{}",
    '{"vehicle":[{"color":"red","fraction":0.7},{"color":"blue","fraction":0.2}]}',
    '{"person_upper":[{"color":"unknown","fraction":1.0}],"person_lower":[{"color":"Black","fraction":0.6}]}',
    '{"object":[{"color":"green","fraction":0.9}]}',
]
POLYGONS = {
    1: [(0.0, 0.0), (1.0, 1.0)],
    2: [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)],
    3: [(0.1, 0.1), (0.9, 0.2), (0.5, 0.9)],
    4: [(0.2, 0.1), (0.8, 0.1), (0.9, 0.5), (0.5, 0.95), (0.1, 0.5)],
}


def _case(column: str, table: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _case_sql(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def plus_us(ts, us):
    return F.timestamp_add("MICROSECOND", us.cast("long"), ts)


class Data:
    """Views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _with_vectors(self, shift: int) -> DataFrame:
        """Every event with an embedding; the embeddings repeat where there are fewer of them."""
        vectors = self.table("embeddings")
        n = vectors.count()
        return self.table("events").join(vectors, (F.col("event_id") + shift) % n == F.col("vec_id"))

    @cached_property
    def tracks(self) -> DataFrame:
        u, e, ts, value = F.col("user_id"), F.col("event_id"), F.col("ts"), F.col("value")
        pick = F.array(*[F.lit(c) for c in COLOURS_OF])
        label = _case("event_type", LABEL_OF_EVENT)
        rows = self._with_vectors(0)
        return rows.select(
            F.concat(F.lit("t"), e).alias("id"),
            F.concat(F.lit("v"), e * 37).alias("video"),
            F.concat(F.lit("cam_"), u % 6).alias("camera"),
            e.alias("track_id"),
            label.alias("label"),
            text.object_group(label).alias("grp"),
            ts.alias("t_start"),
            plus_us(ts, F.floor(value * 1000000)).alias("t_end"),
            plus_us(ts, F.floor(value * 500000)).alias("t_best"),
            (e % 100).cast("double").alias("offset_start"),
            value.alias("offset_best"),
            ((u % 10) / 20.0).alias("bx1"),
            ((e % 7) / 14.0).alias("by1"),
            ((u % 10) / 20.0 + 0.3).alias("bx2"),
            ((e % 7) / 14.0 + 0.25).alias("by2"),
            F.concat(F.lit("snap/"), e, F.lit(".jpg")).alias("snapshot"),
            F.col("embedding").alias("emb"),
            F.col("label").alias("cls"),
            F.get(pick, (u % 4).cast("int")).alias("colors"),
            (value / 500.0).alias("quality"),
            (1 + e % 7).alias("hits"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        rows = self._with_vectors(1)
        e = F.col("event_id")
        return rows.select(
            F.concat(F.lit("f"), e).alias("id"),
            F.concat(F.lit("v"), e * 37).alias("video"),
            F.concat(F.lit("cam_"), F.col("user_id") % 6).alias("camera"),
            F.col("ts").alias("t_abs"),
            F.col("value").alias("offset_s"),
            F.concat(F.lit("snap/f"), e, F.lit(".jpg")).alias("snapshot"),
            F.col("embedding").alias("emb"),
        )

    @cached_property
    def videos(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("v"), k).alias("path"),
            F.concat(F.lit("cam_"), F.col("o_custkey") % 6).alias("camera"),
            plus_us(F.col("o_orderdate"), (k % 86400) * 1000000).alias("start_time"),
            (25 + k % 6).cast("double").alias("fps"),
            (640 + 16 * (k % 9)).cast("long").alias("width"),
            (360 + 16 * (k % 9)).cast("long").alias("height"),
            (F.col("o_totalprice") / 1000.0).alias("duration_s"),
            F.lit("filename").alias("start_source"),
            (90 * (k % 4)).cast("long").alias("rotation"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("indexed_at"),
        )

    @cached_property
    def video_updates(self) -> DataFrame:
        """Later writes for videos: several per path, some for paths not seen before."""
        k = F.col("l_orderkey") + 7
        return self.table("lineitem").select(
            F.concat(F.lit("v"), k).alias("path"),
            F.concat(F.lit("cam_"), F.col("l_suppkey") % 6).alias("camera"),
            F.col("l_shipdate").alias("start_time"),
            (25 + F.col("l_linenumber") % 6).cast("double").alias("fps"),
            F.lit(1920).cast("long").alias("width"),
            F.lit(1080).cast("long").alias("height"),
            F.col("l_quantity").alias("duration_s"),
            F.lit("manifest").alias("start_source"),
            (90 * (F.col("l_partkey") % 4)).cast("long").alias("rotation"),
            F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("indexed_at"),
            self._rid().alias("seq"),
        )

    @cached_property
    def aliases(self) -> DataFrame:
        kind = "array<struct<x:double,y:double>>"
        polygon = F.lit(None).cast(kind)
        for region, corners in POLYGONS.items():
            shape = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
            polygon = F.when(F.col("n_regionkey") == region, shape).otherwise(polygon)
        return self.table("nation").select(
            F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("name"),
            F.concat(F.lit("cam_"), F.col("n_nationkey") % 6).alias("camera"),
            polygon.alias("polygon"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        word = _case("event_type", WORD_OF_EVENT)
        lit = F.lit
        forms = [
            F.concat(lit("did a red "), word, lit(" pass by in the last 45 minutes?")),
            F.concat(lit("show me all "), word, lit("s near cam_"), u % 6, lit(" in the last 3 hours")),
            F.concat(lit("a "), word, lit(" at the nation "), u % 25, lit(" today")),
            F.concat(lit("find "), word, lit(" yesterday")),
            F.concat(lit("A Blue "), word, lit(" this morning by camera "), u % 6),
            F.concat(lit("any black "), word, lit(" near the front yard this afternoon")),
            F.concat(word, lit(" in the evening")),
            lit("someone walking between 2 and 4 PM"),
            F.concat(word, lit(" between 10:30 and 14:45 through the nation "), u % 25, lit(" lobby")),
            F.concat(lit("what happened at 2024-01-01T1"), u % 10, lit(":00:00")),
            F.concat(word, lit(" camera "), u % 8),
            F.concat(lit("the green "), word, lit(" cam_"), u % 8),
            F.concat(word, lit("?")),
            F.concat(lit("was there a "), word, lit(" towards "), u % 6, lit(" last hour")),
        ]
        return self.table("events").select(
            e.alias("query_id"),
            F.get(F.array(*forms), (e % 14).cast("int")).alias("text"),
            F.lit(NOW).cast("timestamp_ntz").alias("now_ref"),
        )

    @cached_property
    def search_questions(self) -> DataFrame:
        """Questions that have a vector: one per embedding."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_emb"))
        return self.questions.join(vectors, "query_id")

    @staticmethod
    def _rid():
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)

    @cached_property
    def observations(self) -> DataFrame:
        k, n = F.col("l_orderkey"), F.col("l_linenumber")
        x1, y1 = (F.col("l_partkey") % 8) / 20.0, (F.col("l_suppkey") % 5) / 20.0
        return self.table("lineitem").select(
            F.concat(F.lit("cam_"), k % 6).alias("camera"),
            F.concat(F.lit("v"), F.floor(k / 10)).alias("video"),
            k.alias("track_id"),
            n.cast("long").alias("frame_idx"),
            (n * 0.5).alias("offset_s"),
            F.col("l_shipdate").alias("ts"),
            x1.alias("x1"),
            y1.alias("y1"),
            (x1 + 0.3 + F.col("l_quantity") / 250.0).alias("x2"),
            (y1 + 0.3 + F.col("l_discount")).alias("y2"),
            (F.col("l_quantity") / 50.0).alias("conf"),
            F.col("l_extendedprice").alias("quality"),
            _case("l_returnflag", LABEL_OF_FLAG).alias("label"),
            self._rid().alias("rid"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        x1, y1 = (F.col("l_partkey") % 8) / 20.0, (F.col("l_suppkey") % 5) / 20.0
        label = _case("l_returnflag", LABEL_OF_FLAG)
        return self.table("lineitem").select(
            F.floor(F.col("l_orderkey") / 8).alias("frame_idx"),
            text.object_group(label).alias("grp"),
            label.alias("label"),
            x1.alias("x1"),
            y1.alias("y1"),
            (x1 + 0.3 + F.col("l_quantity") / 250.0).alias("x2"),
            (y1 + 0.3 + F.col("l_discount")).alias("y2"),
            (1.0 - F.col("l_tax")).alias("conf"),
            F.col("l_linestatus").alias("source"),
            self._rid().alias("rid"),
        )

    @cached_property
    def stream_frames(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("cam_"), F.col("user_id") % 6).alias("camera"),
            F.col("event_id").alias("frame_no"),
            F.col("user_id").alias("track_id"),
            F.col("ts").alias("recv_ts"),
            plus_us(F.col("ts"), F.floor(F.col("value") * 1000)).alias("processed_ts"),
            F.col("value"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        p, s, n, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_orderkey")
        return self.table("lineitem").select(
            k.alias("crop_id"),
            F.get(F.array(F.lit("person"), F.lit("vehicle"), F.lit("object")), (k % 3).cast("int")).alias("grp"),
            n.cast("long").alias("x"),
            (s % 8).alias("y"),
            F.lit(8).alias("width"),
            F.lit(8).alias("height"),
            ((p * 7) % 256).cast("double").alias("L"),
            ((s * 13 + n * 29) % 256).cast("double").alias("a"),
            ((p + s) % 256).cast("double").alias("b"),
            (p % 180).cast("double").alias("h"),
            ((s * 7) % 256).cast("double").alias("s"),
            ((p * 3 + s) % 256).cast("double").alias("v"),
        )

    @cached_property
    def truth(self) -> DataFrame:
        """Two truth intervals per question: around a later event, and before its own event."""
        e = self.table("events")
        ids = self.table("embeddings").select("vec_id")
        camera = F.concat(F.lit("cam_"), F.col("user_id") % 6).alias("camera")
        label = _case("event_type", LABEL_OF_EVENT).alias("label")
        hour = 3_600_000_000
        a = ids.join(e, F.col("vec_id") + 3 == F.col("event_id")).select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("truth_no"), camera,
            plus_us(F.col("ts"), F.lit(-hour)).alias("t_from"), plus_us(F.col("ts"), F.lit(hour)).alias("t_to"), label,
        )
        b = ids.join(e, F.col("vec_id") == F.col("event_id")).select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("truth_no"), camera,
            plus_us(F.col("ts"), F.lit(-2 * hour)).alias("t_from"), plus_us(F.col("ts"), F.lit(-60_000_000)).alias("t_to"), label,
        )
        return a.unionByName(b)

    @cached_property
    def rules(self) -> DataFrame:
        """One alert rule per embedding class and camera: the mean vector of the class seen by the camera."""
        from camtrail.functions.vectors import mean_vector

        rows = self.tracks.groupBy("cls", "camera").agg(mean_vector("emb", 64).alias("q_emb"))
        rule = F.concat(F.lit("r"), "cls", F.lit("_"), "camera")
        return rows.select(
            rule.alias("id"), F.concat(F.lit("rule "), rule).alias("rule_name"), F.concat(F.lit("class "), "cls").alias("query_text"),
            F.transform("q_emb", lambda x: F.round(x, 6)).alias("q_emb"),
            F.when(F.col("cls") < 5, F.col("camera")).alias("camera_filter"),
            (0.25 + F.col("cls") / 100.0).alias("min_score"),
            (F.col("cls") != 9).alias("is_active"),
            plus_us(F.lit(NOW).cast("timestamp_ntz"), F.col("cls").cast("long") * 1000000).alias("created_at"),
        )


SQL: dict[str, str] = {}

SQL["tracks"] = f"""
SELECT 't' || event_id AS id, 'v' || (event_id * 37) AS video, 'cam_' || (user_id % 6) AS camera, event_id AS track_id,
  {_case_sql('event_type', LABEL_OF_EVENT)} AS label,
  CASE event_type WHEN 'click' THEN 'person' WHEN 'view' THEN 'vehicle' WHEN 'purchase' THEN 'vehicle' ELSE 'object' END AS grp,
  ts AS t_start, ts + to_microseconds(CAST(floor(value * 1000000) AS BIGINT)) AS t_end,
  ts + to_microseconds(CAST(floor(value * 500000) AS BIGINT)) AS t_best,
  CAST(event_id % 100 AS DOUBLE) AS offset_start, value AS offset_best,
  (user_id % 10) / 20.0::DOUBLE AS bx1, (event_id % 7) / 14.0::DOUBLE AS by1,
  (user_id % 10) / 20.0::DOUBLE + 0.3::DOUBLE AS bx2, (event_id % 7) / 14.0::DOUBLE + 0.25::DOUBLE AS by2,
  'snap/' || event_id || '.jpg' AS snapshot, embedding AS emb, e.label AS cls,
  CASE user_id % 4 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COLOURS_OF))} END AS colors,
  value / 500.0::DOUBLE AS quality, 1 + event_id % 7 AS hits
FROM embeddings e JOIN events v ON e.vec_id = v.event_id % (SELECT count(*) FROM embeddings)"""

SQL["frames"] = """
SELECT 'f' || event_id AS id, 'v' || (event_id * 37) AS video, 'cam_' || (user_id % 6) AS camera, ts AS t_abs, value AS offset_s,
  'snap/f' || event_id || '.jpg' AS snapshot, embedding AS emb
FROM embeddings e JOIN events v ON e.vec_id = (v.event_id + 1) % (SELECT count(*) FROM embeddings)"""

SQL["videos"] = """
SELECT 'v' || o_orderkey AS path, 'cam_' || (o_custkey % 6) AS camera, o_orderdate + to_seconds(o_orderkey % 86400) AS start_time,
  CAST(25 + o_orderkey % 6 AS DOUBLE) AS fps, CAST(640 + 16 * (o_orderkey % 9) AS BIGINT) AS width,
  CAST(360 + 16 * (o_orderkey % 9) AS BIGINT) AS height, o_totalprice / 1000.0::DOUBLE AS duration_s, 'filename' AS start_source,
  CAST(90 * (o_orderkey % 4) AS BIGINT) AS rotation, TIMESTAMP '2024-01-01 00:00:00' AS indexed_at
FROM orders"""

_RID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
)

SQL["video_updates"] = f"""
SELECT 'v' || (l_orderkey + 7) AS path, 'cam_' || (l_suppkey % 6) AS camera, l_shipdate AS start_time,
  CAST(25 + l_linenumber % 6 AS DOUBLE) AS fps, CAST(1920 AS BIGINT) AS width, CAST(1080 AS BIGINT) AS height,
  l_quantity AS duration_s, 'manifest' AS start_source, CAST(90 * (l_partkey % 4) AS BIGINT) AS rotation,
  TIMESTAMP '2024-01-02 00:00:00' AS indexed_at, {_RID} AS seq
FROM lineitem"""


def _polygon_sql(corners) -> str:
    return "[" + ", ".join(f"{{'x': {x}::DOUBLE, 'y': {y}::DOUBLE}}" for x, y in corners) + "]"


SQL["aliases"] = f"""
SELECT lower(replace(n_name, '_', ' ')) AS name, 'cam_' || (n_nationkey % 6) AS camera,
  CASE n_regionkey {' '.join(f"WHEN {r} THEN {_polygon_sql(c)}" for r, c in POLYGONS.items())} END AS polygon,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM nation"""

_W = _case_sql("event_type", WORD_OF_EVENT)
SQL["questions"] = f"""
SELECT event_id AS query_id, TIMESTAMP '{NOW}' AS now_ref, CASE event_id % 14
  WHEN 0 THEN 'did a red ' || {_W} || ' pass by in the last 45 minutes?'
  WHEN 1 THEN 'show me all ' || {_W} || 's near cam_' || (user_id % 6) || ' in the last 3 hours'
  WHEN 2 THEN 'a ' || {_W} || ' at the nation ' || (user_id % 25) || ' today'
  WHEN 3 THEN 'find ' || {_W} || ' yesterday'
  WHEN 4 THEN 'A Blue ' || {_W} || ' this morning by camera ' || (user_id % 6)
  WHEN 5 THEN 'any black ' || {_W} || ' near the front yard this afternoon'
  WHEN 6 THEN {_W} || ' in the evening'
  WHEN 7 THEN 'someone walking between 2 and 4 PM'
  WHEN 8 THEN {_W} || ' between 10:30 and 14:45 through the nation ' || (user_id % 25) || ' lobby'
  WHEN 9 THEN 'what happened at 2024-01-01T1' || (user_id % 10) || ':00:00'
  WHEN 10 THEN {_W} || ' camera ' || (user_id % 8)
  WHEN 11 THEN 'the green ' || {_W} || ' cam_' || (user_id % 8)
  WHEN 12 THEN {_W} || '?'
  ELSE 'was there a ' || {_W} || ' towards ' || (user_id % 6) || ' last hour' END AS text
FROM events"""

SQL["search_questions"] = """
SELECT q.*, e.embedding AS q_emb FROM questions q JOIN embeddings e ON e.vec_id = q.query_id"""

_BOX = """(l_partkey % 8) / 20.0::DOUBLE AS x1, (l_suppkey % 5) / 20.0::DOUBLE AS y1,
  (l_partkey % 8) / 20.0::DOUBLE + 0.3::DOUBLE + l_quantity / 250.0::DOUBLE AS x2,
  (l_suppkey % 5) / 20.0::DOUBLE + 0.3::DOUBLE + l_discount AS y2"""

SQL["observations"] = f"""
SELECT 'cam_' || (l_orderkey % 6) AS camera, 'v' || (l_orderkey // 10) AS video, l_orderkey AS track_id,
  CAST(l_linenumber AS BIGINT) AS frame_idx, l_linenumber * 0.5::DOUBLE AS offset_s, l_shipdate AS ts, {_BOX},
  l_quantity / 50.0::DOUBLE AS conf, l_extendedprice AS quality, {_case_sql('l_returnflag', LABEL_OF_FLAG)} AS label, {_RID} AS rid
FROM lineitem"""

SQL["detections"] = f"""
SELECT l_orderkey // 8 AS frame_idx,
  CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'vehicle' ELSE 'object' END AS grp,
  {_case_sql('l_returnflag', LABEL_OF_FLAG)} AS label, {_BOX}, 1.0::DOUBLE - l_tax AS conf, l_linestatus AS source, {_RID} AS rid
FROM lineitem"""

SQL["stream_frames"] = """
SELECT 'cam_' || (user_id % 6) AS camera, event_id AS frame_no, user_id AS track_id, ts AS recv_ts,
  ts + to_microseconds(CAST(floor(value * 1000) AS BIGINT)) AS processed_ts, value
FROM events"""

SQL["pixels"] = """
SELECT l_orderkey AS crop_id, CASE l_orderkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' ELSE 'object' END AS grp,
  CAST(l_linenumber AS BIGINT) AS x, l_suppkey % 8 AS y, 8 AS width, 8 AS height,
  CAST((l_partkey * 7) % 256 AS DOUBLE) AS L, CAST((l_suppkey * 13 + l_linenumber * 29) % 256 AS DOUBLE) AS a,
  CAST((l_partkey + l_suppkey) % 256 AS DOUBLE) AS b, CAST(l_partkey % 180 AS DOUBLE) AS h,
  CAST((l_suppkey * 7) % 256 AS DOUBLE) AS s, CAST((l_partkey * 3 + l_suppkey) % 256 AS DOUBLE) AS v
FROM lineitem"""

SQL["truth"] = f"""
SELECT vec_id AS query_id, 0 AS truth_no, 'cam_' || (user_id % 6) AS camera, ts - INTERVAL 1 HOUR AS t_from,
  ts + INTERVAL 1 HOUR AS t_to, {_case_sql('event_type', LABEL_OF_EVENT)} AS label
FROM embeddings e JOIN events v ON e.vec_id + 3 = v.event_id
UNION ALL
SELECT vec_id, 1, 'cam_' || (user_id % 6), ts - INTERVAL 2 HOUR, ts - INTERVAL 1 MINUTE, {_case_sql('event_type', LABEL_OF_EVENT)}
FROM embeddings e JOIN events v ON e.vec_id = v.event_id"""

SQL["rules"] = f"""
SELECT 'r' || cls || '_' || camera AS id, 'rule r' || cls || '_' || camera AS rule_name, 'class ' || cls AS query_text,
  [round(x / sqrt(list_sum([y * y FOR y IN m])), 6) FOR x IN m] AS q_emb,
  CASE WHEN cls < 5 THEN camera END AS camera_filter, 0.25::DOUBLE + cls / 100.0::DOUBLE AS min_score, cls <> 9 AS is_active,
  TIMESTAMP '{NOW}' + to_seconds(cls) AS created_at
FROM (SELECT cls, camera, [{', '.join(f'avg(emb[{i}]::DOUBLE)' for i in range(1, 65))}] AS m FROM tracks GROUP BY cls, camera)"""


def oracle(body: str) -> str:
    """A query over the views as one statement: the views it uses become common table expressions."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                inner = SQL[name]
                if inner is not sql:
                    visit(inner)
                    if name not in needed:
                        needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def seconds_sql(us: str, digits: int) -> str:
    """Microseconds as seconds, rounded half away from zero on the integer."""
    step = 10 ** (6 - digits)
    return f"(sign({us}) * ((abs({us}) + {step // 2}) // {step}) / {10**digits}.0::DOUBLE)"
