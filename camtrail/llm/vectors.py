"""Vectors as binary rows, and a grid of (candidate chunk, query chunk) cells that keeps every task bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

EVERY = 20
RESULT = "query_id long, rank int, vec_id long, score {}"


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as array<double>) of rows with an id and a vector without null, NaN or infinite components; empty vectors are left out."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & good)


def queries_of(rows: DataFrame, every: int = EVERY) -> DataFrame:
    return rows.filter(F.col("vec_id") % every == 0)


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles and row lengths of a list column without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths


def matrix(blobs, dtype) -> np.ndarray:
    """Rows of equal length from binary cells."""
    data = np.frombuffer(b"".join(blobs), dtype)
    return data.reshape(len(blobs), -1)


def in_cells(rows: DataFrame, own: str, salt: int) -> DataFrame:
    """Give each row its chunk on its own side and repeat it for every chunk of the other side.

    ``rows`` has n_vec and n_query: how many chunks each side has. ``own`` is "vec" or "query".
    """
    other, sized = "query" if own == "vec" else "vec", rows
    mine = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(f"n_{own}")).cast("int")
    return sized.withColumn(f"c_{own}", mine).withColumn(f"c_{other}", F.explode(F.sequence(F.lit(0), F.col(f"n_{other}").cast("int") - 1))).drop("n_vec", "n_query")


def search_cells(
    vectors: DataFrame, queries: DataFrame, keys: list[str], scan: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], k: int, score_type: str
) -> DataFrame:
    """Run ``scan(vectors, queries)`` in each cell and keep every query's ``k`` best (score descending, vec_id ascending) of all cells."""
    found = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(scan, f"query_id long, vec_id long, score {score_type}")
    return keep_best(found, k)


def keep_best(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` best per row; a stable sort, so ties go to the earlier column."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def batches(frames: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in frames:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)
