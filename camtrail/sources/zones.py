"""Zone map of a keyed track or frame table: what each file can hold, so that a search opens only files that can have an answer.

Files never change, so an entry is made once per file; an upsert adds entries for its new files. An entry has the cameras, the time span, the labels,
and a centre with a radius of the vectors. For a question q no row of the file scores above q * centre + |q| * radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from camtrail.functions import text
from camtrail.operators.scoring import QueryBlock, matrix
from camtrail.scale import broadcast_if_small, micros
from camtrail.sources.keyed import KeyedTable

# Distinct values of a file beyond which its entry says nothing about them.
MANY = 64
# A colour that is asked for adds this much to a score at most.
COLOUR_BOOST = 0.03
# Scores are compared after rounding to 4 decimals, and sums of floats differ in the last bits.
SLACK = 1e-3
_MIN, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max
ENTRY = "file string, cameras array<string>, first_us long, last_us long, labels array<string>, centre array<double>, radius double"


def _entries(rows: DataFrame, start: str, end: str) -> DataFrame:
    file = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(commit=[^/]*/.*)$", 1).alias("file")
    label = F.lower("label") if "label" in rows.columns else F.lit(None).cast("string")
    rows = rows.select(file, text.camera_key(F.col("camera")).alias("camera"), micros(F.col(start)).alias("s"), micros(F.col(end)).alias("e"), label.alias("label"), F.col("emb").cast("array<double>").alias("emb"))
    # Rows without a vector are no answers.
    rows = rows.filter("emb is not null")
    few = lambda c: F.when(F.count_distinct(c) <= MANY, F.collect_set(c))
    names = rows.groupBy("file", "camera", "label").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = names.groupBy("file").agg(
        F.when(F.max(F.col("camera").isNull()), F.lit(None)).otherwise(few("camera")).alias("cameras"),
        F.min("s").alias("first_us"), F.max("e").alias("last_us"),
        F.when(F.max(F.col("label").isNull()), F.lit(None)).otherwise(few("label")).alias("labels"),
    )
    centres = rows.groupBy("file").agg(vector_to_array(Summarizer.mean(array_to_vector("emb"))).alias("centre"))
    apart = F.aggregate(F.zip_with("emb", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    radii = rows.select("file", "emb").join(broadcast_if_small(centres, 20_000), "file").groupBy("file").agg(F.sqrt(F.max(apart)).alias("radius"))
    return spans.join(centres, "file").join(radii, "file").select(*[c.split()[0] for c in ENTRY.split(", ")])


class ZonedTable:
    """A keyed table with its zone map under ``zones/``. Call it with a block of questions to get the rows of the files that can answer one of them."""

    def __init__(self, table: KeyedTable, start: str = "t_start", end: str = "t_end", least: float | None = None):
        self.table, self.start, self.end, self.least = table, start, end, least

    def entries(self) -> DataFrame:
        """Entries of the latest version's files; missing ones are made first."""
        spark = self.table.spark
        files = spark.createDataFrame([(f["file"],) for f in self.table.files() if f["kind"] == "data"], "file string")
        stored = self._stored()
        missing = [r["file"] for r in files.join(stored, "file", "left_anti").collect()]
        if missing:
            done = _entries(self.table._rows(missing), self.start, self.end).join(files, "file", "right")
            done.filter(F.col("file").isin(missing) if len(missing) <= 1_000 else F.lit(True)).write.mode("append").parquet(f"{self.table.path}/zones")
            stored = self._stored()
        return stored.join(broadcast_if_small(files), "file", "left_semi").dropDuplicates(["file"])

    def _stored(self) -> DataFrame:
        spark = self.table.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.table.path}/zones")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], ENTRY)
        return spark.read.schema(ENTRY).parquet(f"{self.table.path}/zones")

    def files_for(self, block: QueryBlock) -> list[str]:
        """Files that can hold an answer to one of the questions. The names come to the driver, as those of any scan do."""
        least = self.least

        def look(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["file"].filter(pa.array(_possible(batch, block, least)))], ["file"])

        return [r["file"] for r in self.entries().mapInArrow(look, "file string").collect()]

    def __call__(self, block: QueryBlock | None) -> DataFrame:
        if block is None or not len(block.ids):
            return self.table.read()
        return self.table._rows(self.files_for(block)).drop("commit")


def _possible(batch: pa.RecordBatch, q: QueryBlock, least: float | None) -> np.ndarray:
    """Per file: whether some question of the block can have an answer in it."""
    n = batch.num_rows
    # A file whose rows have no vectors has no radius, and no answers.
    filled = np.array([r is not None for r in batch["radius"].to_pylist()], bool)
    ok = np.repeat(filled[:, None], len(q.ids), axis=1)
    if any(c is not None for c in q.camera):
        ok &= np.array([[k is None or a is None or k in a for k in q.camera] for a in batch["cameras"].to_pylist()]).reshape(n, -1)
    if (q.start != _MIN).any() or (q.end != _MAX).any():
        # Files without any time are left in: rows without a time pass questions without a window.
        first = np.array([_MIN if v is None else v for v in batch["first_us"].to_pylist()], np.int64)
        last = np.array([_MAX if v is None else v for v in batch["last_us"].to_pylist()], np.int64)
        ok &= (first[:, None] <= q.end[None, :]) & (last[:, None] >= q.start[None, :])
    if any(x is not None for x in q.labels):
        targets = [None if t is None else {*t, "object"} for t in q.labels]
        ok &= np.array([[t is None or a is None or not t.isdisjoint(a) for t in targets] for a in batch["labels"].to_pylist()]).reshape(n, -1)
    floor = np.full(len(q.ids), -np.inf) if q.minimum is None else q.minimum
    floor = floor if least is None else np.maximum(floor, least)
    if np.isfinite(floor).any() and filled.any():
        centre = matrix(batch["centre"].filter(pa.array(filled)))
        radius = batch["radius"].filter(pa.array(filled)).to_numpy()
        bound = centre @ q.vectors.T + radius[:, None] * np.linalg.norm(q.vectors, axis=1)[None, :]
        ok[filled] &= bound + (COLOUR_BOOST if any(q.colours) else 0.0) + SLACK >= floor[None, :]
    return ok.any(axis=1)
