"""Video files as a catalogue: start time, camera, container metadata, query and manifest JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from camtrail.functions import text
from camtrail.scale import broadcast_if_small

PROBE = (
    "streams array<struct<width:string,height:string,r_frame_rate:string,duration:string,"
    "tags:map<string,string>,side_data_list:array<struct<rotation:string>>>>,"
    "format struct<duration:string,tags:map<string,string>>"
)
QUERY_FILE = "id string, query string, split string, truth array<struct<camera:string,start:string,end:string,label:string>>"


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Query corpus file as (queries, truth intervals)."""
    raw = spark.read.schema(QUERY_FILE).json(path, multiLine=True)
    queries = raw.select(F.col("id").alias("query_id"), F.col("query").alias("text"), "split")
    truth = raw.select(F.col("id").alias("query_id"), F.posexplode("truth").alias("truth_no", "t")).select(
        "query_id", "truth_no", "t.camera",
        F.col("t.start").cast("timestamp_ntz").alias("t_from"), F.col("t.end").cast("timestamp_ntz").alias("t_to"), "t.label",
    )
    return queries, truth


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest file {file name: {start_time, camera, start_source}} as rows."""
    return manifest_rows(spark.read.text(path, wholetext=True))


def manifest_rows(documents: DataFrame) -> DataFrame:
    """Entries of manifest documents (``value``)."""
    kind = "map<string,struct<start_time:string,camera:string,start_source:string>>"
    return documents.select(F.explode(F.from_json("value", kind)).alias("file", "e")).select(
        "file", F.col("e.start_time").try_cast("timestamp_ntz").alias("start_time"), "e.camera", "e.start_source"
    )


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder with their modification time; the contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))


def probe_fields(probe: Column) -> Column:
    """Container metadata JSON: STRUCT<width, height, fps, duration_s, rotation, creation_time>."""
    p = F.from_json(probe, PROBE)
    s = F.try_element_at(p["streams"], F.lit(1))
    rate = F.coalesce(s["r_frame_rate"], F.lit("30/1"))
    parts = F.split(rate, "/")
    fraction = F.try_divide(parts[0].try_cast("double"), F.greatest(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(1.0)))
    fps = F.when(rate.contains("/"), fraction).when(rate == "", F.lit(30.0)).otherwise(rate.try_cast("double"))
    duration = F.coalesce(F.nullif(s["duration"], F.lit("")), p["format"]["duration"]).try_cast("double")
    sides = F.filter(
        F.transform(F.coalesce(s["side_data_list"], F.array().cast("array<struct<rotation:string>>")),
                    lambda d: d["rotation"].try_cast("int")),
        lambda r: r.isNotNull(),
    )
    turn = F.coalesce(F.try_element_at(sides, F.lit(1)), F.try_element_at(s["tags"], F.lit("rotate")).try_cast("int"), F.lit(0))
    created = F.coalesce(
        F.try_element_at(p["format"]["tags"], F.lit("creation_time")), F.try_element_at(s["tags"], F.lit("creation_time"))
    )
    return F.struct(
        F.coalesce(s["width"].try_cast("int"), F.lit(0)).alias("width"),
        F.coalesce(s["height"].try_cast("int"), F.lit(0)).alias("height"),
        F.coalesce(fps, F.lit(30.0)).alias("fps"),
        F.when(s.isNotNull(), F.coalesce(duration, F.lit(0.0))).otherwise(F.lit(0.0)).alias("duration_s"),
        F.pmod(turn, F.lit(360)).alias("rotation"),
        # Zoned times become UTC without a zone.
        F.to_utc_timestamp(created.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz").alias("creation_time"),
    )


def resolve_start(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Start time, camera and their source per file: manual, manifest, file name, container, modification time.

    ``files``: path, mtime and, where known, manual_start, manual_camera,
    creation_time. Only fields of the winning source are used.
    """
    name = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    m = manifest.filter(F.col("start_time").isNotNull()).select(
        F.col("file").alias("_file"), F.col("start_time").alias("_m_start"), F.nullif("camera", F.lit("")).alias("_m_camera"),
        F.coalesce("start_source", F.lit("manifest")).alias("_m_source"),
    )
    rows = files.withColumn("_file", name).join(broadcast_if_small(m), "_file", "left")
    rows = rows.withColumn("_ft", text.file_time(F.col("path"))).withColumn("_stem", text.file_stem(F.col("path")))
    manual, manifested = F.col("manual_start").isNotNull(), F.col("_m_start").isNotNull()
    named, tagged = F.col("_ft").isNotNull(), F.col("creation_time").isNotNull()
    source = (
        F.when(manual, "manual").when(manifested, F.col("_m_source")).when(named, "filename").when(tagged, "ffprobe")
        .otherwise("mtime_fallback")
    )
    camera = (
        F.when(manual, F.coalesce("manual_camera", "_stem"))
        .when(manifested, F.coalesce("_m_camera", "_stem"))
        .when(named, F.coalesce("manual_camera", F.col("_ft.camera"), "_stem"))
        .otherwise(F.coalesce("manual_camera", "_stem"))
    )
    start = F.coalesce("manual_start", "_m_start", F.col("_ft.start_time"), "creation_time", "mtime")
    return rows.select("path", start.alias("start_time"), camera.alias("camera"), source.alias("start_source"))


def frame_time(start: Column, frame_idx: Column, fps: Column) -> Column:
    """Absolute time of a frame, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(F.try_divide(frame_idx.cast("double"), fps) * 1e6).cast("long"), start)


def newest_first(videos: DataFrame, limit: int = 50) -> DataFrame:
    """Catalogue page: the newest videos, ties by path."""
    return videos.orderBy(F.desc("start_time"), "path").limit(limit)
