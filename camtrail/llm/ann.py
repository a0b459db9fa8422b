"""Approximate nearest neighbours by adaptive dimension scan: inverted lists, rotated vectors in column blocks, early abandoning by hypothesis tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from camtrail.llm import vectors as V
from camtrail.scale import cut_lineage

K = 20
# Rows the centroids are fitted on, at most; every row is indexed.
SAMPLE = 16_384
# A table of n rows has about sqrt(n) lists, within these bounds; the upper one leaves 16 sampled rows a list.
LISTS = (64, SAMPLE // 16)
# Share of the nearest neighbours within the sample that the visited lists must hold, and the sampled rows it is measured on.
AIM = 0.96
ASKED = 512
# Column blocks end at these shares of the dimensions.
BLOCKS = (0.25, 0.5, 0.75, 1.0)
# One-sided test: a candidate is given up when its partial product lies this many deviations below that of a candidate that just meets the floor.
Z = 3.0
CHUNK = 8192
QUERY_CHUNK = 512
TILE = 2048
FIRST_TILE = 128
# Share of live candidates in a tile below which they are followed one by one.
PAIRWISE = 0.2


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    """A fixed random orthogonal matrix; products are unchanged, and any block of columns becomes a random projection."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def directions(sample: np.ndarray) -> np.ndarray:
    """Positions of the first row of each direction, in single precision: copies of a row, scaled or not, count once."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return np.sort(np.unique(unit.astype(np.float32), axis=0, return_index=True)[1])


def nearest_lists(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List of each row and its product with that centroid, a block of rows at a time."""
    own, best = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 2048):
        s = x[at : at + 2048] @ centres.T
        own[at : at + 2048] = np.argmax(s, axis=1)
        best[at : at + 2048] = s.max(axis=1)
    return own, best


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of the sample's distinct directions (spherical k-means); fewer if it has fewer of them.

    A group of copies is one direction, so it draws one centroid at most. A list that nothing is nearest to starts again at the direction farthest from its own centroid.
    """
    unit = sample[directions(sample)]
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    c = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for k in range(rounds):
        own, best = nearest_lists(unit, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-300), c)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if k + 1 < rounds:
            c[empty] = unit[np.argsort(best, kind="stable")[: len(empty)]]
    return c


def measure_probes(
    sample: np.ndarray, centres: np.ndarray, k: int, aim: float = AIM, seed: int = 2, asked: np.ndarray | None = None, same: np.ndarray | None = None,
) -> int:
    """Lists a query must visit to meet the share ``aim`` of its ``k`` nearest rows in the sample, over up to ASKED rows of distinct directions.

    They are rows of the sample, or the vectors ``asked``; ``same`` tells which sampled row each of those is (-1: none), as a row is no neighbour of its own.
    Neighbours within a sample are farther off than those within the whole table, so the table's recall is not below what is measured, up to chance.
    """
    own, _ = nearest_lists(sample, centres)
    if asked is None or not len(asked):
        asked, same = sample, np.arange(len(sample))
    pick = directions(asked)
    pick = pick[np.sort(np.random.default_rng(seed).choice(len(pick), min(len(pick), ASKED), replace=False))]
    if len(sample) < 2:
        return len(centres)
    asked, same = asked[pick], same[pick]
    products = asked @ sample.T
    products[np.flatnonzero(same >= 0), same[same >= 0]] = -np.inf
    near = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(depth[int(np.ceil(aim * len(depth))) - 1]) + 1


def scan_list(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, floor: np.ndarray, k: int, z: float = Z, stats: dict | None = None):
    """The ``k`` best (query row, candidate row, exact product) per query among candidates ``x``, whose ``ids`` ascend; only products of ``floor`` or more count.

    Under the random rotation the rests of two vectors after a column block have about the cosine of the vectors, with a deviation of at most 1 / sqrt(rest). A candidate that
    just meets the query's current k-th score has the cosine score / (|q| |x|); one whose partial product, with a rest of that cosine plus ``z`` deviations (or the Cauchy bound, if
    less), stays under the score is abandoned. So near neighbours in tight groups, whose rests agree, are held against what such rests add.
    Blocks are products of whole tiles while many candidates live, and of single pairs after that. What is left is scored in double precision on the original vectors.
    """
    n, dim = x.shape
    turn = rotation(dim)
    size = max(np.abs(x).max(), np.abs(q).max())  # products in single precision must not overflow
    xr, qr = (x / size @ turn).astype(np.float32), (q / size @ turn).astype(np.float32)
    cuts = sorted({max(1, int(round(b * dim))) for b in BLOCKS} | {dim})
    tail = lambda m, at: np.sqrt(np.einsum("ij,ij->i", m[:, at:], m[:, at:]))
    weight = {c: np.float32(z / np.sqrt(dim - c) if c < dim else 0.0) for c in cuts}
    q_rest, x_rest = {c: tail(qr, c) for c in cuts}, {c: tail(xr, c) for c in cuts}
    q_len, x_len = tail(qr, 0), tail(xr, 0)
    share = lambda rest, length: np.divide(rest, length, out=np.ones_like(rest), where=length > 0)
    q_share, x_share = {c: share(q_rest[c], q_len) for c in cuts}, {c: share(x_rest[c], x_len) for c in cuts}
    slack = np.float32(1e-5) * q_len * x_len.max(initial=0)
    r_best, i_best, s_best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    floor, at = floor.copy(), 0
    while at < n:
        end = min(n, at + (TILE if at else FIRST_TILE))
        part, need = xr[at:end], (floor / size / size).astype(np.float32) - slack
        goal = np.maximum(need + slack, 0)  # a floor below 0 counts as a cosine of 0, which abandons less
        r = c = None
        low = 0
        for high in cuts:
            if r is None:
                block = qr[:, low:high] @ part[:, low:high].T
                total = block if low == 0 else total + block
                room = np.multiply.outer(q_rest[high], x_rest[high][at:end])
                fair = room * weight[high] + np.multiply.outer(goal * q_share[high], x_share[high][at:end])
                alive = total + np.minimum(room, fair) >= need[:, None]
                done = alive.size
                if np.count_nonzero(alive) < PAIRWISE * done or high == dim:
                    r, c = np.nonzero(alive)
                    p = total[r, c]
            else:
                done = len(r)
                p = p + np.einsum("ij,ij->i", qr[r, low:high], part[c, low:high])
                room = q_rest[high][r] * x_rest[high][at + c]
                keep = p + np.minimum(room, room * weight[high] + goal[r] * q_share[high][r] * x_share[high][at + c]) >= need[r]
                r, c, p = r[keep], c[keep], p[keep]
            if stats is not None:
                stats["products"] = stats.get("products", 0) + done * (high - low)
            low = high
        c = c + at
        keep = qids[r] != ids[c]
        r, c = r[keep], c[keep]
        exact = np.empty(len(r))
        for lo in range(0, len(r), 65_536):
            hi = lo + 65_536
            exact[lo:hi] = np.einsum("ij,ij->i", q[r[lo:hi]], x[c[lo:hi]])
        r_best, i_best, s_best = np.concatenate([r_best, r]), np.concatenate([i_best, c]), np.concatenate([s_best, exact])
        order = np.lexsort((i_best, -s_best, r_best))
        r_best, i_best, s_best = r_best[order], i_best[order], s_best[order]
        place = np.arange(len(r_best)) - np.searchsorted(r_best, r_best)
        floor[r_best[place == k - 1]] = np.maximum(floor[r_best[place == k - 1]], s_best[place == k - 1])
        keep = (place < k) & (s_best >= floor[r_best])
        r_best, i_best, s_best = r_best[keep], i_best[keep], s_best[keep]
        at = end
    return r_best, i_best, s_best


def nearest(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = V.EVERY, lists: int | None = None, probes: int | None = None,
    sample: int = SAMPLE, chunk: int = CHUNK, query_chunk: int = QUERY_CHUNK, z: float = Z,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row whose id is divisible by ``every``.

    Centroids are fitted on the ``sample`` rows with the smallest id hashes; all rows are indexed. ``lists`` follows the square root of the rows and ``probes`` the recall within the
    sample, unless they are given. A query visits the ``probes`` lists whose centroids have the largest products with it; with at most ``probes`` lists the answer is exact up to the test's error. A list is cut into chunks by id hash on both sides, so a list
    with a third of all rows is many cells; a cell holds about ``chunk`` vectors and ``query_chunk`` queries and returns at most ``k`` rows per query. What is broadcast is
    one row per list.

    Vectors that are null, zero, empty, of another length than the most common one (ties: the longer), or hold null or non-finite components take no part; nor does a row without an id.
    Ties go to the smaller vec_id. Rows that repeat an id are candidates of their own but never of the query with that id. No usable row gives no result.
    """
    good = V.usable(rows, vec_id, vector)
    dims = good.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    spark = rows.sparkSession
    if not dims:
        return spark.createDataFrame([], V.RESULT.format("double"))
    dim = dims[0]["dim"]
    good = good.filter((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0))
    first = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if first.empty:
        return spark.createDataFrame([], V.RESULT.format("double"))
    known = np.stack(first["vector"].to_numpy())
    centres = fit_lists(known, lists or int(np.clip(dims[0]["n"] ** 0.5, *LISTS)))
    if probes is None:
        # Measured on queries themselves, as they may lie elsewhere than most rows.
        some = V.queries_of(good, every).orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * ASKED).toPandas()
        own = {v: i for i, v in enumerate(first["vec_id"])}
        same = np.array([own.get(v, -1) for v in some["vec_id"]], np.int64)
        probes = measure_probes(known, centres, k, asked=np.stack(some["vector"].to_numpy()) if len(some) else None, same=same)
    probes = min(probes, len(centres))

    def place(count: int):
        def run(frames):
            for b in V.batches(frames, 4096):
                flat, _ = V.ragged(b.column("vector"))
                x = flat.reshape(b.num_rows, dim)
                order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :count]
                ids = np.repeat(b.column("vec_id").to_numpy(), count)
                blobs = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(count), len(x)), pa.int32()),
                        pa.array([v for v in blobs for _ in range(count)], pa.binary()),
                    ],
                    ["vec_id", "list", "visit", "vec"],
                )
        return run

    def scan(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = x.sort_values("vec_id"), q.sort_values("vec_id")
        ids, qids = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        r, i, s = scan_list(V.matrix(x["vec"], np.float64), ids, V.matrix(q["vec"], np.float64), qids, q["floor"].to_numpy(), k, z)
        return pd.DataFrame({"query_id": qids[r], "vec_id": ids[i], "score": s})

    schema = "vec_id long, list int, visit int, vec binary"
    indexed = good.mapInArrow(place(1), schema).drop("visit")
    asked = V.queries_of(good, every).mapInArrow(place(probes), schema)
    count = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    def visit(some: DataFrame) -> DataFrame:
        """The ``k`` best of the given visits, over a grid of cells per list; the table of cells has one row per list, ``lists`` at most."""
        cells = count(indexed, chunk, "n_vec").join(count(some, query_chunk, "n_query"), "list").collect()
        cells = F.broadcast(spark.createDataFrame(cells, "list int, n_vec int, n_query int"))
        found = V.in_cells(indexed.join(cells, "list"), "vec", 1), V.in_cells(some.join(cells, "list"), "query", 2)
        return V.search_cells(*found, ["list", "c_vec", "c_query"], scan, k, "double")

    # The nearest list of a query gives its first k-th score, under which candidates of the other lists are abandoned.
    near = cut_lineage(visit(asked.filter("visit = 0").withColumn("floor", F.lit(float("-inf")))))
    floors = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    floors = floors.groupBy("vec_id").agg(F.max("floor").alias("floor"))
    rest = asked.filter("visit > 0").join(floors, "vec_id", "left").fillna(float("-inf"), ["floor"])
    return V.keep_best(near.drop("rank").unionByName(visit(rest).drop("rank")), k)
