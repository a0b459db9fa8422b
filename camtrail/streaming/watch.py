"""Watching a folder for new recordings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from camtrail.scale import cut_lineage
from camtrail.sources.keyed import KeyedTable

# --- Fixed values. Extensions taken as recordings.
EXTENSIONS = ["mp4", "mkv", "mov", "avi"]
EXCLUDED = ["_invalid", "orientation_check"]


def new_files(
    spark: SparkSession, folder: str, extensions: Sequence[str] = tuple(EXTENSIONS), exclude: Sequence[str] = tuple(EXCLUDED),
    per_batch: int = 1_000,
) -> DataFrame:
    """Stream of new files (path, mtime, length); contents are not read.

    The checkpoint of the query makes each file appear once, at whatever size it has then: for folders into which writers rename finished files. Where they
    write in place, use ``watch_stable``.
    """
    return _listing(spark.readStream.option("maxFilesPerTrigger", per_batch), folder, extensions, exclude)


def _listing(reader, folder: str, extensions: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """(path, mtime, length) of the recordings that ``reader`` lists; the contents column is pruned."""
    kinds = "*.{" + ",".join([*extensions, *[e.upper() for e in extensions]]) + "}"
    files = (
        reader.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", kinds)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .filter("length > 0")
        .select("path", F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), "length")
    )
    for word in exclude:
        files = files.filter(~F.col("path").contains(word))
    return files


LOOKS = "path string, mtime timestamp_ntz, length bigint, taken boolean"


def looks_table(spark: SparkSession, path: str) -> KeyedTable:
    """What the last look at each file saw, by path."""
    return KeyedTable(spark, path, LOOKS, "path", {"seen": F.coalesce("taken", F.lit(False))})


def stable_files(
    folder: str, looks_path: str, ingest: Callable[[DataFrame, int], None], extensions: Sequence[str] = tuple(EXTENSIONS), exclude: Sequence[str] = tuple(EXCLUDED),
    run: str = "look",
) -> Callable[[DataFrame, int], None]:
    """Sink of a clock stream: each batch is a look at the folder; files whose size and time are those of the look before go to ``ingest``, once.

    Looks are kept in a keyed table, which is written only where a file is new, has changed or is taken. A look that stopped before its commit is made again with the same batch id, so
    ``ingest`` must give the same tables when a batch is delivered twice; one that was committed is not repeated. A file that is written again after it was taken
    stays taken; an empty one is not seen. A deleted one stays in the table and does no harm.
    """

    def look(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table, commit = looks_table(spark, looks_path), f"{run}-{batch_id}"
        if table.done(commit):
            return
        last = table.read().select("path", F.col("mtime").alias("_mtime"), F.col("length").alias("_length"), "taken")
        seen = _listing(spark.read, folder, extensions, exclude).join(last, "path", "left").filter(~F.coalesce("taken", F.lit(False)))
        same = F.coalesce((F.col("mtime") == F.col("_mtime")) & (F.col("length") == F.col("_length")), F.lit(False))
        # The listing is taken once: a file that grows while the look runs is as it was.
        now = cut_lineage(seen.select("path", "mtime", "length", same.alias("taken")))
        ready = now.filter("taken").select("path", "mtime", "length")
        if not ready.isEmpty():
            ingest(ready, batch_id)
        if not now.isEmpty():
            table.upsert(now, commit)

    return look


def watch_stable(spark: SparkSession, look: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 5.0, once: bool = False):
    """Start looking every ``seconds``; ``once`` looks one time and stops."""
    writer = spark.readStream.format("rate").load().writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def watch(files: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start the watch; ``once`` takes what is there and stops."""
    writer = files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
