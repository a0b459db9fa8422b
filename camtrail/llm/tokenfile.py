"""Documents as token files in ascending id order, and documents read back from them."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from camtrail.llm import rangecoder, tokens
from camtrail.scale import broadcast_if_small, shared_folder

END = 2
# Ids that one row of a file gathers before it is coded; a longer document is a row of its own. Blocks of a row are coded together.
ROW_IDS = 6 << 20
# Text of a range of documents.
RANGE_BYTES = 24 << 20
FILE = "file_no int, row_no int, doc_ids array<long>, lengths array<long>, coded binary"


def _write_rows(vocabulary: str, end: int, row_ids: int):
    def run(frames):
        from pyspark import TaskContext

        encoder, number = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        row, ids, parts, size = 0, [], [], 0

        def flush():
            flat = np.concatenate(parts)
            lengths = pa.array([[len(p) for p in parts]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([row], pa.int32()), pa.array([ids], pa.list_(pa.int64())), lengths, pa.array([rangecoder.encode(flat)], pa.binary())],
                ["file_no", "row_no", "doc_ids", "lengths", "coded"],
            )

        for b in frames:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for doc, got in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids.append(doc)
                    parts.append(np.append(got, np.uint32(end)).astype(np.uint32))
                    size += len(parts[-1])
                    if size >= row_ids:
                        yield flush()
                        row, ids, parts, size = row + 1, [], [], 0
        if parts:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = tokens.BYTE_BPE, end: int = END, row_ids: int = ROW_IDS,
    range_bytes: int = RANGE_BYTES,
) -> None:
    """Write every whole text's ids, each document ended by ``end``, as token files under ``path`` in ascending doc_id order (null ids first; equal ids in text order).

    Documents are dealt into ranges of ids of about ``range_bytes`` of text and sorted within; each range is a file, whose rows hold the ids of consecutive whole documents, coded
    in blocks that stand alone and carry a checksum. Spark's writer commits the files (Parquet with one binary column for the coded ids), so a task that is
    lost and run again leaves one copy, in any store that Spark writes to. A null text is an empty one, the end id alone. Documents that repeat an id are written each. An empty table leaves no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    rows.mapInArrow(_write_rows(vocabulary, end, row_ids), FILE).write.option("compression", "none").mode("overwrite").parquet(path)


def _read_rows(frames):
    for b in frames:
        for i in range(b.num_rows):
            lengths = b.column("lengths")[i].values.to_numpy()
            (ids,) = rangecoder.decode([b.column("coded")[i].as_py()])
            raw, ends = ids.astype("<u4"), np.cumsum(lengths)
            crc = [zlib.crc32(raw[a:e]) for a, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, b.column("file_no")[i].as_py()), pa.int32()), pa.array(np.full(n, b.column("row_no")[i].as_py()), pa.int32()),
                 b.column("doc_ids")[i].values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                ["file_no", "row_no", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: its first id's place among all ids, its ids with the end id, and their CRC-32.

    All ids are decoded and every block's checksum tested; a damaged block stops the read. Starts follow from a table of ids per row of a file, summed over files first, so no window spans all documents.
    """
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.select("file_no", "row_no", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    whole = sizes.groupBy("file_no").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))
    whole = whole.select("file_no", F.coalesce(earlier, F.lit(0)).alias("file_start"))
    inside = F.sum("n").over(W.partitionBy("file_no").orderBy("row_no").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("file_no", "row_no", F.coalesce(inside, F.lit(0)).alias("row_start")).join(whole, "file_no")
    starts = starts.select("file_no", "row_no", (F.col("row_start") + F.col("file_start")).alias("row_start"))
    read = files.mapInArrow(_read_rows, "file_no int, row_no int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return read.join(broadcast_if_small(starts), ["file_no", "row_no"]).select(
        "doc_id", (F.col("before") + F.col("row_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to token files in the folder all executors share and read them back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return read_token_files(spark, path)
