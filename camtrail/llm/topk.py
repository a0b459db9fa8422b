"""Exact top-k inner products of sparse integer vectors by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from camtrail.llm import vectors as V

K = 20
SCALE = 64
CHUNK = 16_384
QUERY_CHUNK = 512
TILE = 512


def padded(blobs) -> np.ndarray:
    """Integer rows of any lengths as one matrix; terms beyond a row's length are zero."""
    rows = [np.frombuffer(b, np.int64) for b in blobs]
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def accumulate(x: np.ndarray, q: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray):
    """(query row, candidate row, score) of the ``k`` best candidates per query; candidate rows ascend by id.

    Term at a time: the posting list of a term (candidate rows with a non-zero weight there) is scattered, times the queries' weights, into a
    dense score array of one tile; then a partition selects the best, which are merged with those of earlier tiles. ``skip`` holds each query's own id.
    """
    terms = min(x.shape[1], q.shape[1])
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(terms, 1)
    kind = np.int32 if bound < 2**31 else np.int64
    n, m = len(x), len(q)
    weights = q[:, :terms].T.astype(kind)
    asked = [(t, rows) for t in range(terms) if len(rows := np.flatnonzero(weights[t]))]
    dense = np.empty((TILE, m), kind)
    best_s, best_i = np.empty((m, 0), np.int64), np.empty((m, 0), np.int64)
    for at in range(0, n, TILE):
        part = x[at : at + TILE]
        columns = np.ascontiguousarray(part[:, :terms].T.astype(kind))
        scores = np.zeros((len(part), m), kind)
        for t, rows in asked:
            posting = np.flatnonzero(columns[t])
            if 2 * len(rows) < m:
                scores[np.ix_(posting, rows)] += np.multiply.outer(columns[t, posting], weights[t, rows])
            elif 2 * len(posting) < len(part):
                scores[posting] += np.multiply.outer(columns[t, posting], weights[t])
            else:  # a long posting list is scattered as a whole column: its zeros add nothing
                scores += np.multiply.outer(columns[t], weights[t], out=dense[: len(part)])
        scores = np.ascontiguousarray(scores.T)
        s = np.concatenate([best_s, scores.astype(np.int64)], axis=1)
        i = np.concatenate([best_i, np.broadcast_to(np.arange(at, at + len(part)), scores.shape)], axis=1)
        own = (i >= 0) & (ids[i] == skip[:, None])
        s = np.where(own, np.iinfo(np.int64).min + 1, s)
        i = np.where(own, -1, i)
        if s.shape[1] > k:
            # The k-th score by partition; everything above it and the first of the ties are kept.
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            above, ties = s > kth, s == kth
            keep = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True)))
            col = np.nonzero(keep)[1].reshape(m, k)
            s, i = np.take_along_axis(s, col, 1), np.take_along_axis(i, col, 1)
        best_s, best_i = s, i
    r, j = np.nonzero(best_i >= 0)
    return r, best_i[r, j], best_s[r, j]


def exact_top(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = V.EVERY, scale: int = SCALE, chunk: int = CHUNK,
    query_chunk: int = QUERY_CHUNK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer products floor(scale * x) . floor(scale * y) of each row whose id is divisible by ``every``.

    All rows meet all queries, in cells of about ``chunk`` vectors and ``query_chunk`` queries cut by id hash; a cell returns ``k`` rows per query and a window merges them.
    A cell's memory is its two matrices and one tile of scores. Copies of a vector, however many, are spread by id.

    Vectors that are null or empty or hold null or non-finite components take no part, nor do rows without an id. Vectors of different lengths are compared
    over the terms both have. Zero vectors take part with score 0. Ties go to the smaller vec_id; rows that repeat an id are candidates of their own but never of the query with that id.
    Scores wrap at 64 bits. No usable row gives no result.
    """
    good = V.usable(rows, vec_id, vector)
    ints = good.select("vec_id", F.transform("vector", lambda x: F.floor(x * float(scale)).cast("long")).alias("vector"))

    def pack(frames):
        for b in frames:
            column = b.column("vector")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(column.offsets.to_numpy()))
            blobs = [r.tobytes() for r in np.split(flat.astype(np.int64), ends[:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(blobs, pa.binary())], ["vec_id", "vec"])

    def scan(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = x.sort_values("vec_id"), q.sort_values("vec_id")
        ids, qids = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        r, i, s = accumulate(padded(x["vec"]), padded(q["vec"]), k, qids, ids)
        return pd.DataFrame({"query_id": qids[r], "vec_id": ids[i], "score": s})

    packed = ints.mapInArrow(pack, "vec_id long, vec binary")
    n, m = good.count(), V.queries_of(good, every).count()
    grid = {"n_vec": F.lit(max(1, -(-n // chunk))), "n_query": F.lit(max(1, -(-m // query_chunk)))}
    asked = V.queries_of(ints, every).mapInArrow(pack, "vec_id long, vec binary")
    cells = V.in_cells(packed.withColumns(grid), "vec", 1), V.in_cells(asked.withColumns(grid), "query", 2)
    return V.search_cells(*cells, ["c_vec", "c_query"], scan, k, "long")


def oracle(k: int = K, every: int = V.EVERY, scale: int = SCALE) -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) w FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT rank, vec_id, score FROM pairs)
    SELECT * FROM ranked WHERE rank <= {k}"""
