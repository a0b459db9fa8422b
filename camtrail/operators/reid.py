"""Cross-camera re-identification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from camtrail.functions import vectors
from camtrail.operators.scoring import matrix, round4, unit_rows
from camtrail.scale import broadcast_if_small, cut_lineage, floor_div, micros, seconds

CHUNK_ROWS = 8_000
LOOK_ROWS = 2_000


def matches_of(
    tracks: DataFrame, track_id, min_similarity: float = 0.60, max_gap_s: float = 7200.0, same_camera: bool = False
) -> DataFrame:
    """Tracks similar to one probe track on other cameras, close in time; in time order, then similarity.

    The probe is read as literals, so the time band reaches the scan as a plain
    range filter and the camera test as an inequality.
    """
    probe = tracks.filter(F.col("id") == track_id).select("id", "camera", "t_start", "emb").take(1)
    if not probe:
        raise ValueError(f"track {track_id!r} is not in the index")
    p = probe[0]
    start = F.lit(p.t_start)
    band = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_gap_s))
    near = tracks.filter(F.col("t_start").between(start - band, start + band))
    near = near.filter(F.col("id") != track_id if same_camera else F.col("camera") != p.camera)
    q = F.array(*[F.lit(float(v)) for v in p.emb])
    delta = micros(F.col("t_start")) - micros(start)
    found = near.withColumn("_sim", vectors.cosine(q, F.col("emb"))).filter(F.col("_sim") >= min_similarity)
    return found.select(
        F.lit(p.id).alias("query_id"),
        F.lit(p.camera).alias("query_camera"),
        start.alias("query_start"),
        F.col("id").alias("track_id"),
        "camera",
        "label",
        F.round("_sim", 4).alias("similarity"),
        "t_start",
        "t_end",
        "offset_best",
        "snapshot",
        seconds(delta, 2).alias("time_delta_s"),
        F.when(delta > 0, "after").when(delta < 0, "before").otherwise("concurrent").alias("chronological_order"),
    ).orderBy("t_start", F.desc("similarity"), "track_id")


def narrative(matches: DataFrame) -> DataFrame:
    """One line per probe: its own step, then the matches in time order."""
    stamp = F.date_format("t_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # Two decimals of the binary value, half to even, as C and Python print them; Java's %.2f rounds the shortest decimal half up.
    shown = F.format_number("similarity", 2)
    step = F.concat(F.lit("-> ["), "camera", F.lit(" @ "), stamp, F.lit(" (sim: "), shown, F.lit(")]"))
    key = F.struct("t_start", (-F.col("similarity")).alias("s"), "track_id", step.alias("step"))
    head = F.concat(F.lit("["), "query_camera", F.lit(" @ "),
                    F.date_format("query_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("]"))
    return (
        matches.groupBy("query_id", head.alias("head"))
        .agg(F.array_sort(F.collect_list(key)).alias("steps"))
        .select("query_id", F.concat_ws(" ", "head", F.transform("steps", lambda s: s["step"])).alias("trajectory"))
    )


def _pair_kernel(min_similarity: float, gap_us: int, k: int | None, by_time: bool, out: pa.Schema):
    def solve(key, table):
        side = table["_side"].to_numpy()
        left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        twin = key[0] == key[2] and key[1] == key[3]  # a chunk against itself
        if twin:
            right = left
        lt, rt = left["_us"].to_numpy(), right["_us"].to_numpy()
        lo, ro = np.argsort(lt, kind="stable"), np.argsort(rt, kind="stable")
        left, right, lt, rt = left.take(pa.array(lo)), right.take(pa.array(ro)), lt[lo], rt[ro]
        lv, rv = unit_rows(matrix(left["emb"])), unit_rows(matrix(right["emb"]))
        cams = pa.chunked_array([*left["camera"].chunks, *right["camera"].chunks], type=pa.string())
        code = cams.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        lc, rc = code[: len(lt)], code[len(lt):]
        rows = []
        for at in range(0, len(lt), 512):  # strips, so that the band is multiplied and little else
            end = min(at + 512, len(lt))
            a = np.searchsorted(rt, lt[at] - gap_us, side="left")
            b = np.searchsorted(rt, lt[end - 1] + gap_us, side="right")
            if a >= b:
                continue
            sim = lv[at:end] @ rv[a:b].T
            ok = (sim >= min_similarity) & (lc[at:end, None] != rc[None, a:b])
            ok &= np.abs(lt[at:end, None] - rt[None, a:b]) <= gap_us
            i, j = np.nonzero(ok)
            rows.append((i + at, j + a, sim[i, j]))
        i = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, int)
        j = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, int)
        s = round4(np.concatenate([r[2] for r in rows])) if rows else np.zeros(0)
        lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
        src, dst, su, du = lid[i], rid[j], lt[i], rt[j]
        if not twin:  # cosine is symmetric: one product serves both directions
            src, dst = np.r_[src, rid[j]], np.r_[dst, lid[i]]
            su, du, s = np.r_[su, rt[j]], np.r_[du, lt[i]], np.r_[s, s]
        if k is not None and len(src):
            order = np.lexsort((dst, -s, du, src)) if by_time else np.lexsort((dst, du, -s, src))
            src, dst, su, du, s = src[order], dst[order], su[order], du[order], s[order]
            start = np.r_[True, src[1:] != src[:-1]]
            rank = np.arange(len(src)) - np.maximum.accumulate(np.where(start, np.arange(len(src)), 0))
            keep = rank < k
            src, dst, su, du, s = src[keep], dst[keep], su[keep], du[keep], s[keep]
        return pa.Table.from_arrays([pa.array(v).cast(f.type) for v, f in zip((src, dst, su, du, s), out)], schema=out)

    return solve


def similar_pairs(
    tracks: DataFrame, min_similarity: float, max_gap_s: float, k: int | None = None, by: str = "time",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(src, dst, src_us, dst_us, similarity): for every track the tracks of other cameras within the gap.

    A temporal similarity self-join. Time is cut into blocks at least one gap
    wide, sized from the table so that one holds about ``chunk_rows`` tracks; a
    block with more is split into chunks by hash. A task gets one pair of
    chunks from equal or neighbouring blocks, multiplies the two matrices strip
    by strip inside the band and emits only matches, at most ``k`` per source
    and task, so neither a dense hour nor a hot camera lands in one task.
    """
    gap_us = int(round(max_gap_s * 1_000_000))
    rows = tracks.filter(F.col("emb").isNotNull() & F.col("t_start").isNotNull())
    rows = rows.select("id", "camera", micros(F.col("t_start")).alias("_us"), "emb")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("_us"), F.max("_us")).first()
    # A block must be wider than the gap, so that matches lie in the same or the next block.
    width = max(gap_us + 1, (high - low + 1) // max(1, -(-n // chunk_rows))) if n else gap_us + 1
    rows = rows.withColumn("_b", floor_div(F.col("_us") - F.lit(low or 0), width))
    sizes = rows.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_parts"))
    ahead = sizes.select((F.col("_b") - 1).alias("_b"), F.col("_parts").alias("_parts_next"))
    back = sizes.select((F.col("_b") + 1).alias("_b"), F.col("_parts").alias("_parts_prev"))
    sizes = cut_lineage(sizes.join(ahead, "_b", "left").join(back, "_b", "left"))
    rows = rows.join(broadcast_if_small(sizes), "_b").withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))

    def key(b, c, b2, c2, side):
        return F.struct(b.alias("b"), c.cast("int").alias("c"), b2.alias("b2"), c2.cast("int").alias("c2"), F.lit(side).alias("side"))

    def each(count, build):
        ids = F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(ids, build)

    b, c = F.col("_b"), F.col("_c")
    tasks = F.concat(
        # same block, chunks c <= c2; the diagonal is sent once
        F.filter(each(F.col("_parts"), lambda x: key(b, c, b, x, 0)), lambda t: t["c2"] >= c),
        F.filter(each(F.col("_parts"), lambda x: key(b, x, b, c, 1)), lambda t: t["c"] < c),
        # next block as the left side, previous block as the right side
        each(F.col("_parts_next"), lambda x: key(b, c, b + 1, x, 0)),
        each(F.col("_parts_prev"), lambda x: key(b - 1, x, b, c, 1)),
    )
    sent = rows.withColumn("_t", F.explode(tasks)).select(
        "_t.b", "_t.c", "_t.b2", "_t.c2", F.col("_t.side").alias("_side"), "id", "camera", "_us", "emb"
    )
    schema = T.StructType([
        T.StructField("src", tracks.schema["id"].dataType), T.StructField("dst", tracks.schema["id"].dataType),
        T.StructField("src_us", T.LongType()), T.StructField("dst_us", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    kernel = _pair_kernel(min_similarity, gap_us, k, by == "time", to_arrow_schema(schema))

    return sent.groupBy("b", "c", "b2", "c2").applyInArrow(kernel, schema)


def _first_kernel(min_similarity: float, gap_us: int, k: int, out: pa.Schema):
    """First ``k`` matches of the sources (side 0) among candidates (side 1) that reach from the start of each source's window to ``_until``."""

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table["_side"].to_numpy()
        left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        left, right = left.sort_by("_us"), right.sort_by("_us")
        lt, rt = left["_us"].to_numpy(), right["_us"].to_numpy()
        until = left["_until"].to_numpy()
        lv, rv = unit_rows(matrix(left["emb"])), unit_rows(matrix(right["emb"]))
        cams = pa.chunked_array([*left["camera"].chunks, *right["camera"].chunks], type=pa.string())
        code = cams.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        lc, rc = code[: len(lt)], code[len(lt):]
        found = []
        for at in range(0, len(lt), 256):
            s = slice(at, at + 256)
            a, b = np.searchsorted(rt, lt[s][0] - gap_us, side="left"), np.searchsorted(rt, until[s][-1], side="right")
            count, step = np.zeros(len(lt[s]), np.int64), 128
            while a < b:
                # Rows of one instant stay together: the best of them in similarity come first.
                e = min(np.searchsorted(rt, rt[min(a + step, b) - 1], side="right"), b)
                open_ = np.flatnonzero(count < k)
                if not len(open_):
                    break
                sim = lv[s][open_] @ rv[a:e].T
                ok = (sim >= min_similarity) & (lc[s][open_, None] != rc[None, a:e])
                ok &= (rt[None, a:e] >= lt[s][open_, None] - gap_us) & (rt[None, a:e] <= until[s][open_, None])
                i, j = np.nonzero(ok)
                np.add.at(count, open_[i], 1)
                found.append((open_[i] + at, j + a, sim[i, j]))
                a, step = e, min(2 * step, 4096)
        i, j = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in (0, 1))
        sim = round4(np.concatenate([f[2] for f in found])) if found else np.zeros(0)
        lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
        src, dst, su, du = lid[i], rid[j], lt[i], rt[j]
        names = right["id"].combine_chunks()
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        order = np.lexsort((place[j], -sim, du, i))
        i, src, dst, su, du, sim = i[order], src[order], dst[order], su[order], du[order], sim[order]
        start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        keep = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) < k
        return pa.Table.from_arrays([pa.array(v[keep]).cast(f.type) for v, f in zip((src, dst, su, du, sim), out)], schema=out)

    return solve


def first_pairs(tracks: DataFrame, min_similarity: float, max_gap_s: float, k: int, chunk_rows: int = CHUNK_ROWS, look: int = LOOK_ROWS) -> DataFrame:
    """``similar_pairs`` by time, at most the first ``k`` of a source, where a gap holds far more tracks than it takes to find them.

    The first matches lie at the start of a source's window, so a source is shown a slice there that holds about ``look`` tracks, however many the window holds.
    What has fewer than ``k`` matches in its slice is shown a slice of twice the length, up to the whole window.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    gap_us = int(round(max_gap_s * 1_000_000))
    rows = tracks.filter(F.col("emb").isNotNull() & F.col("t_start").isNotNull()).select("id", "camera", micros(F.col("t_start")).alias("_us"), "emb")
    cells = rows.groupBy(floor_div(F.col("_us"), gap_us + 1)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    span = int(gap_us * look / crowd) if crowd else 2 * gap_us
    if 4 * span >= 2 * gap_us:
        return similar_pairs(tracks, min_similarity, max_gap_s, k, "time", chunk_rows)
    kind = tracks.schema["id"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("src_us", T.LongType()), T.StructField("dst_us", T.LongType()), T.StructField("similarity", T.DoubleType())])
    solve = _first_kernel(min_similarity, gap_us, k, to_arrow_schema(schema))
    open_, out = rows, None
    while True:
        span = min(span, 2 * gap_us)
        last = span == 2 * gap_us
        width = span + 1  # a slice touches the cell of its start and the next one
        begin = F.col("_us") - F.lit(gap_us)
        first = floor_div(begin, width)
        home = floor_div(F.col("_us"), width)
        near = rows.select(F.explode(F.array(home - 1, home)).alias("_cell")).groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_cuts"))
        parts = open_.groupBy(first.alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_parts"))
        known = broadcast_if_small(cut_lineage(parts.join(near, "_cell")))
        asked = open_.withColumn("_cell", first).join(known, "_cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
        asked = asked.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).select("_cell", "_part", "_cut", F.lit(0).alias("_side"), "id", "camera", "_us", (begin + span).alias("_until"), "emb")
        shown = rows.withColumn("_cell", F.explode(F.array(home - 1, home))).join(known, "_cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        shown = shown.withColumn("_cut", F.pmod(F.xxhash64("id"), F.col("_cuts")).cast("int")).select("_cell", "_part", "_cut", F.lit(1).alias("_side"), "id", "camera", "_us", F.lit(0).cast("long").alias("_until"), "emb")
        found = cut_lineage(asked.unionByName(shown).groupBy("_cell", "_part", "_cut").applyInArrow(solve, schema))
        if last:
            return found if out is None else out.unionByName(found)
        full = found.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select(F.col("src").alias("id"))
        now = found.join(full.withColumnRenamed("id", "src"), "src", "left_semi")
        out = now if out is None else out.unionByName(now)
        open_ = cut_lineage(open_.join(full, "id", "left_anti"))
        if open_.isEmpty():
            return out
        span *= 2


def associations(
    tracks: DataFrame, min_similarity: float = 0.65, max_gap_s: float = 7200.0, k: int = 3, by: str = "time",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Cross-camera associations: the first k matches of every track, each unordered pair once.

    ``by="time"`` takes a track's first k matches in time order, "similarity"
    its best k. A pair found from both ends is reported from the earlier track.
    """
    if by == "time":
        pairs = first_pairs(tracks, min_similarity, max_gap_s, k, chunk_rows)
    else:
        pairs = similar_pairs(tracks, min_similarity, max_gap_s, k, by, chunk_rows)
    if by == "time":
        order = [F.col("dst_us"), F.desc("similarity"), F.col("dst")]
    else:
        order = [F.desc("similarity"), F.col("dst_us"), F.col("dst")]
    cut = pairs.withColumn("_rn", F.row_number().over(W.partitionBy("src").orderBy(*order))).filter(F.col("_rn") <= k)
    once = cut.groupBy(F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")).agg(
        F.min_by(F.struct("src", "dst", "src_us", "dst_us", "similarity"), F.struct("src_us", "src")).alias("p")
    )
    a = tracks.select(F.col("id").alias("track_a"), F.col("camera").alias("camera_a"), F.col("t_start").alias("time_a"),
                      F.col("label").alias("label_a"))
    b = tracks.select(F.col("id").alias("track_b"), F.col("camera").alias("camera_b"), F.col("t_start").alias("time_b"),
                      F.col("label").alias("label_b"))
    return (
        once.select(F.col("p.src").alias("track_a"), F.col("p.dst").alias("track_b"), "p.similarity",
                    seconds(F.col("p.dst_us") - F.col("p.src_us"), 2).alias("time_delta_s"))
        .join(a, "track_a")
        .join(b, "track_b")
    )
