"""Index tables: typed scans, upserts, deletes, merges and integrity checks.

An upsert here is a DataFrame over the whole table. ``keyed`` has stored tables
whose upserts read and write only the parts that hold keys of the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def scan(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed parquet scan with an explicit column list."""
    table = spark.read.schema(schema).parquet(path)
    return table.select(*columns) if columns else table


def write_tracks(tracks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partition by camera and day, sorted by start inside a file, so camera and time filters prune."""
    day = F.to_date("t_start")
    (
        tracks.withColumn("dt", day)
        .repartition("camera", "dt", F.pmod(F.xxhash64("id"), F.lit(8)))
        .sortWithinPartitions("t_start")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("camera", "dt")
        .parquet(path)
    )


def load_tolerant(table: DataFrame, schema: T.StructType | str, defaults: dict[str, Column]) -> DataFrame:
    """Table from an older layout: missing columns are added, missing values take their defaults."""
    empty = table.sparkSession.createDataFrame([], schema)
    full = empty.unionByName(table, allowMissingColumns=True).select(*empty.columns)
    return full.select(*[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in full.columns])


def track_defaults() -> dict[str, Column]:
    return {
        "offset_best": F.coalesce(F.col("offset_start"), F.lit(0.0)),
        "grp": F.lit("object"),
        "colors": F.lit("{}"),
        "quality": F.lit(0.0),
        "hits": F.lit(1).cast("long"),
    }


def last_version(updates: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest row per key of a batch that may hold a key several times; combined map-side."""
    rest = [c for c in updates.columns if c not in (key, seq)]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(key, "_r.*")


def upsert_rows(base: DataFrame, updates: DataFrame, key: str, sticky: Sequence[str] = ()) -> DataFrame:
    """Insert or replace by ``key``. Sticky columns keep their first value. ``updates`` has one row per key.

    One full outer join: both sides hash on the key, a hot key cannot exist.
    """
    cols = [c for c in base.columns if c != key]
    new = updates.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols if c in updates.columns])
    joined = base.join(new, key, "full")

    def pick(c: str) -> Column:
        if c not in updates.columns:
            return F.col(c)
        if c in sticky:
            return F.coalesce(F.col(c), F.col(f"_n_{c}")).alias(c)
        return F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(key, *[pick(c) for c in cols]).select(*base.columns)


def upsert_videos(base: DataFrame, updates: DataFrame, seq: str | None = None) -> DataFrame:
    """Videos by path: the last write replaces every other column."""
    return upsert_rows(base, last_version(updates, "path", seq) if seq else updates, "path")


def upsert_tracks(base: DataFrame, updates: DataFrame, seq: str | None = None) -> DataFrame:
    """Tracks by id: video, camera and track number keep their first value."""
    new = last_version(updates, "id", seq) if seq else updates
    return upsert_rows(base, new, "id", ("video", "camera", "track_id"))


def upsert_frames(base: DataFrame, updates: DataFrame, seq: str | None = None) -> DataFrame:
    """Frames by id: only time, offset, snapshot and vector are replaced."""
    new = last_version(updates, "id", seq) if seq else updates
    return upsert_rows(base, new, "id", ("video", "camera"))


def lookup_config(keys: DataFrame, config: DataFrame, default: Column) -> DataFrame:
    return keys.join(config, "key", "left").select("key", F.coalesce("value", default).alias("value"))


def new_inputs(candidates: DataFrame, videos: DataFrame, force: bool = False) -> DataFrame:
    """Candidate files not in the index under their absolute or relative path."""
    if force:
        return candidates
    known = videos.select("path").distinct()
    fresh = candidates.join(known, "path", "left_anti")
    if "rel_path" in candidates.columns:
        fresh = fresh.join(known.withColumnRenamed("path", "rel_path"), "rel_path", "left_anti")
    return fresh


def replace_videos(table: DataFrame, rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Forced re-index: everything of the given videos is removed, then the new rows are added."""
    kept = table.join(videos.select("video").distinct(), "video", "left_anti")
    return kept.unionByName(rows)


def drop_cameras(table: DataFrame, cameras: Sequence[str]) -> DataFrame:
    return table.filter(~F.col("camera").isin(list(cameras)))


def merge_index(base: DataFrame, other: DataFrame, key: str, path: str, not_like: str) -> DataFrame:
    """Copy the rows of another index whose path does not match a pattern; they replace rows of the same key."""
    return upsert_rows(base, other.filter(~F.col(path).like(not_like)), key)


def violations(videos: DataFrame, tracks: DataFrame, frames: DataFrame, rules: DataFrame, events: DataFrame) -> DataFrame:
    """Rows that point nowhere: (kind, id, missing)."""
    known = videos.select(F.col("path").alias("video"))

    def lost(rows: DataFrame, kind: str, ids: str, ref: str, target: DataFrame) -> DataFrame:
        return rows.join(target, ref, "left_anti").select(
            F.lit(kind).alias("kind"), F.col(ids).cast("string").alias("id"), F.col(ref).cast("string").alias("missing")
        )

    return (
        lost(tracks, "track_video", "id", "video", known)
        .union(lost(frames, "frame_video", "id", "video", known))
        .union(lost(events, "event_rule", "event_id", "rule_id", rules.select(F.col("id").alias("rule_id"))))
        .union(lost(events, "event_track", "event_id", "track_id", tracks.select(F.col("id").alias("track_id"))))
    )
