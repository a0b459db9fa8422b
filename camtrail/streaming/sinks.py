"""foreachBatch sinks that give the same tables when a batch is delivered twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from camtrail.operators import alerts
from camtrail.scale import broadcast_if_small, cut_lineage
from camtrail.schema import RULES
from camtrail.sources import keyed
from camtrail.sources.keyed import KeyedTable


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, replaced when the batch is run again."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


LIVE = "id string, t_start timestamp, t_end timestamp, t_best timestamp, quality double, label string, camera string, hits bigint"


def live_table(spark: SparkSession, path: str, schema: str = LIVE) -> KeyedTable:
    """Live tracks by id, by camera and day of their start."""
    return KeyedTable(spark, path, schema, "id", {"of_camera": F.col("camera"), "dt": F.to_date("t_start")})


def live_tracks(path: str, run: str = "live", vacuum_every: int = 50) -> Callable[[DataFrame, int], None]:
    """Sink for live boxes: one row per track, merged with what the table has of it: start is the earliest, end the latest, the label the last seen.

    A batch is one commit of a keyed table, so one that is delivered again adds nothing, and it reads and writes only the parts (camera and day) of its own
    tracks. Each ``vacuum_every`` batches the files that no version names go, so their number follows the tracks, not the batches. ``run`` names the stream; streams
    with checkpoints of their own need names of their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kind = batch.schema["ts"].dataType.simpleString()
        table, commit = live_table(batch.sparkSession, path, LIVE.replace("timestamp", kind)), f"{run}-{batch_id}"
        if table.done(commit):
            return
        at = F.struct("ts", "quality")
        new = batch.groupBy("id").agg(
            F.min("ts").alias("t_start"), F.max("ts").alias("t_end"),
            F.max_by("ts", F.struct("quality", "ts")).alias("t_best"), F.max("quality").alias("quality"),
            F.max_by("label", at).alias("label"), F.min_by("camera", at).alias("camera"), F.count(F.lit(1)).alias("hits"),
        )
        new = cut_lineage(new)
        rows = table.rows_of(new.select("id")).unionByName(new)
        table.upsert(rows.groupBy("id").agg(
            F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max_by("t_best", F.struct("quality", "t_best")).alias("t_best"),
            F.max("quality").alias("quality"), F.max_by("label", "t_end").alias("label"), F.min_by("camera", "t_start").alias("camera"), F.sum("hits").alias("hits"),
        ), commit)
        if batch_id % vacuum_every == vacuum_every - 1:
            table.vacuum()

    return write


def alert_events(rules_path: str, events_path: str, run: str = "alerts", vacuum_every: int = 50, rules_schema: str = RULES) -> Callable[[DataFrame, int], None]:
    """Sink for new tracks: fires every (rule, track) once, also when a batch is repeated, and sets last_triggered_at of the rules that fired.

    Both are keyed tables (``keyed.rules``, ``keyed.events``). Rules are read again for each batch. The id of an event comes from its rule and track, so the key index tells those that
    have fired; the history is not read. ``run`` and ``vacuum_every`` as above.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, commit = batch.sparkSession, f"{run}-{batch_id}"
        rules, events = keyed.rules(spark, rules_path, rules_schema), keyed.events(spark, events_path)
        if rules.done(commit):
            return
        stored = rules.read().select(*rules.schema.names)
        found = alerts.evaluate(stored, batch).dropDuplicates(["event_id"])
        if not events.done(commit):
            fresh = cut_lineage(found)
            events.upsert(fresh.join(broadcast_if_small(events.existing(fresh.select("event_id"))), "event_id", "left_anti"), commit)
        # Events of this batch, also if it stopped between the two tables; the newest time of a rule stays.
        last = found.groupBy(F.col("rule_id").alias("id")).agg(F.max("ts").alias("_last"))
        hit = stored.join(broadcast_if_small(last), "id").withColumn("last_triggered_at", F.greatest("last_triggered_at", "_last"))
        rules.upsert(cut_lineage(hit.select(*rules.schema.names)), commit)
        if batch_id % vacuum_every == vacuum_every - 1:
            rules.vacuum()
            events.vacuum()

    return write


def with_vocabulary(vocabulary_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """Keep detections whose label is in a vocabulary that may grow while the stream runs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        words = batch.sparkSession.read.parquet(vocabulary_path).select(F.lower(F.trim("label")).alias("_w")).distinct()
        kept = batch.withColumn("_w", F.lower("label")).join(words, "_w", "left_semi").drop("_w")
        _write_batch(kept, out_path, batch_id)

    return write
