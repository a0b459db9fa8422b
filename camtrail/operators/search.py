"""Filtered vector search over tracks and frames for a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from camtrail.functions import text
from camtrail.operators import scoring
from camtrail.scale import cut_lineage, from_micros, micros, small

# A table, or what gives the part of it that a block of questions can match (``sources.zones``).
Source = DataFrame | Callable[[scoring.QueryBlock | None], DataFrame]
RESULT = ["result_id", "result_type", "camera", "ts_us", "offset_s", "label", "color"]


def camera_is(column: str, camera: str) -> Column:
    """Camera filter for a fixed name, case-insensitive, with or without cam_."""
    low = camera.lower()
    bare = low.removeprefix("cam_")
    return F.lower(F.col(column)).isin(sorted({low, bare, f"cam_{bare}"}))


def overlaps(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Track overlaps the window; a window with an open side filters nothing."""
    return from_.isNull() | to.isNull() | ((start <= to) & (end >= from_))


def contains(ts: Column, from_: Column, to: Column) -> Column:
    return from_.isNull() | to.isNull() | ((ts >= from_) & (ts <= to))


def label_allowed(label: Column, targets: Column) -> Column:
    """Label among the targets; a generic "object" always passes."""
    low = F.lower(label)
    return targets.isNull() | (low == "object") | F.array_contains(targets, low)


def track_rows(tracks: DataFrame) -> DataFrame:
    """Tracks in the shape the scorer reads."""
    colours = text.row_colours(F.col("colors"))
    return tracks.select(
        F.col("id").cast("string").alias("result_id"),
        F.lit("track").alias("result_type"),
        "camera",
        text.camera_key(F.col("camera")).alias("camera_key"),
        micros(F.col("t_start")).alias("start_us"),
        micros(F.col("t_end")).alias("end_us"),
        micros(F.col("t_best")).alias("ts_us"),
        F.coalesce(F.col("offset_best"), F.lit(0.0)).alias("offset_s"),
        "label",
        F.lower("label").alias("label_low"),
        ((F.col("bx1") + F.col("bx2")) / 2.0).alias("cx"),
        ((F.col("by1") + F.col("by2")) / 2.0).alias("cy"),
        colours.alias("colours"),
        F.coalesce(F.try_element_at(colours, F.lit(1)), F.lit("unknown")).alias("color"),
        "emb",
    )


def frame_rows(frames: DataFrame) -> DataFrame:
    at = micros(F.col("t_abs"))
    return frames.select(
        F.col("id").cast("string").alias("result_id"),
        F.lit("frame").alias("result_type"),
        "camera",
        text.camera_key(F.col("camera")).alias("camera_key"),
        at.alias("start_us"),
        at.alias("end_us"),
        at.alias("ts_us"),
        "offset_s",
        F.lit("whole_frame").alias("label"),
        F.lit(None).cast("string").alias("color"),
        "emb",
    )


def narrow(table: DataFrame, start: str, end: str, block: scoring.QueryBlock | None) -> DataFrame:
    """Rows that any question of the block can match, by plain predicates on the stored columns.

    When every question has a camera, partitions of other cameras are skipped;
    when every question has a window, the scan skips row groups outside of all,
    and days (``dt``, the day of the start) after them all. Rows that end when they start have no day before them all either.
    """
    if block is None:
        return table
    if all(c is not None for c in block.camera) and len(set(block.camera)) <= 1_000:
        names = sorted(set(block.camera))
        table = table.filter(text.camera_key(F.col("camera")).isin(names))
    if block.timed:
        first, last = (from_micros(F.lit(int(v)).cast("long")) for v in (block.start.min(), block.end.max()))
        table = table.filter((F.col(start) <= last) & (F.col(end) >= first))
        if "dt" in table.columns:
            table = table.filter(F.col("dt") <= F.to_date(last))
            if start == end:
                table = table.filter(F.col("dt") >= F.to_date(first))
    return table


def _source(table: Source, block: scoring.QueryBlock | None) -> DataFrame:
    return table(block) if callable(table) else table


def _track_scan(tracks: Source):
    return lambda block: track_rows(narrow(_source(tracks, block), "t_start", "t_end", block))


def _frame_scan(frames: Source):
    return lambda block: frame_rows(narrow(_source(frames, block), "t_abs", "t_abs", block))


def _rank(rows: DataFrame, k: int) -> DataFrame:
    """Best k per query; tracks before frames, then id. Spark cuts to k per task before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("result_type"), "result_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _candidates(queries: DataFrame, tracks: DataFrame, frames: DataFrame | None, m: int, threshold: float | None,
                distinct: bool, gated: bool) -> DataFrame:
    """Best ``m`` candidates per question from tracks and frames; exact in the common order."""
    rows = scoring.score(_track_scan(tracks), queries, RESULT, m, threshold, distinct)
    if frames is not None:
        scene = queries.drop("labels", "polygon", "colours")
        if gated:
            # A polygon question never falls back to whole frames.
            scene = queries.filter(F.col("polygon").isNull()).drop("labels", "polygon", "colours")
            if "no_frames" in scene.columns:
                scene = scene.filter(~F.col("no_frames"))
        rows = rows.unionByName(scoring.score(_frame_scan(frames), scene, RESULT, m, threshold, distinct))
        if gated:
            # Questions that name labels see frames only when no track qualified.
            kind = W.partitionBy("query_id", "result_type").orderBy(F.desc("score"), "result_id")
            rows = rows.withColumn("rank", F.row_number().over(kind)).filter(F.col("rank") <= m)
            has_track = F.max(F.col("result_type") == "track").over(W.partitionBy("query_id"))
            named = queries.select("query_id", F.col("labels").isNotNull().alias("_named"))
            rows = rows.withColumn("_tracked", has_track).join(F.broadcast(named) if small(named) else named, "query_id")
            rows = rows.filter((F.col("result_type") == "track") | ~(F.col("_named") & F.col("_tracked")))
            rows = rows.drop("rank", "_named", "_tracked")
    return _rank(rows, m)


def _many_plain(queries: DataFrame, *tables: Source | None) -> bool:
    """More questions than one scan takes, and nothing but their vectors tells them apart."""
    plain = set(queries.columns) <= {"query_id", "q_emb", "minimum"} and not any(callable(t) for t in tables)
    return plain and not small(queries, scoring.QUERY_BLOCK)


def _by_vectors(queries: DataFrame, rows: DataFrame, m: int, threshold: float | None, distinct: bool) -> DataFrame:
    """Best ``m`` rows per question without filters: each different vector is scored once, with its rows behind it.

    A vector that is not among the best ``m`` by score and first row has ``m`` better rows of other vectors before its own, so its rows cannot be among the best either.
    """
    groups = scoring.gather(rows, RESULT, m, distinct).withColumn("_vec", F.monotonically_increasing_id())
    groups = cut_lineage(groups)  # numbers stay
    first = F.get("rows", F.lit(0))
    lead = F.concat(F.when(first["result_type"] == "track", "0").otherwise("1"), first["result_id"])
    found = scoring.score(groups.select("_vec", lead.alias("result_id"), "emb"), queries, ["_vec", "result_id"], m, threshold)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "result_id")
    found = found.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= m).select("query_id", "score", "_vec")
    return _rank(found.join(groups.select("_vec", "rows"), "_vec").select("query_id", "score", F.inline("rows")), m)


def top_k(
    queries: DataFrame,
    tracks: Source,
    frames: Source | None = None,
    k: int = 10,
    threshold: float | None = None,
    dedup_s: float | None = 5.0,
    gated: bool = True,
) -> DataFrame:
    """Ranked results of every question.

    ``queries``: query_id, q_emb and, where they apply, camera_key, start_us,
    end_us, labels, polygon, colours. Filters and colour boost run before the
    cut; ``threshold`` tests the unrounded score, order uses the score rounded
    to 4 decimals. ``dedup_s`` drops a row within that many seconds of a better
    kept row of the same camera. ``gated`` applies the frame fallback rule.

    De-duplication looks only at better rows, so the best rows decide: a first
    pass folds a prefix of candidates per question; only questions whose prefix
    ran out are scored again with what they kept blocked. Each pass adds at
    least one result, so there are at most k passes and nothing is ever cut
    that could have ranked. ``tracks`` and ``frames`` may be zoned tables; then only files that can hold an answer are read.
    Many questions without filters meet each different vector once (``scoring.gather``).
    """
    rows = None
    if _many_plain(queries, tracks, frames):
        queries = cut_lineage(queries)
        rows = track_rows(tracks).select(*RESULT, "emb")
        if frames is not None:
            rows = rows.unionByName(frame_rows(frames).select(*RESULT, "emb"))
        if dedup_s is None:
            return _by_vectors(queries, rows, k, threshold, False)
    for name, kind in (("polygon", "array<struct<x:double,y:double>>"), ("labels", "array<string>")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    if dedup_s is None:
        return _candidates(queries, tracks, frames, k, threshold, False, gated)
    span = int(round(dedup_s * 1_000_000))
    pending, done = cut_lineage(queries), None
    # Another pass costs a scan, long prefixes of many questions cost more: a short one settles most, as few rows clash, and those left short are shown a longer one.
    longest = max(128, 8 * k)
    prefix = longest if small(pending, scoring.QUERY_BLOCK) else max(16, 3 * k)
    while True:
        if rows is not None and done is None:
            rows = _by_vectors(queries, rows, prefix, threshold, True)
        else:
            rows = _candidates(pending, tracks, frames, prefix, threshold, True, gated)
        packed = F.struct("rank", "score", *RESULT)
        groups = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(packed)).alias("rows"))
        groups = groups.join(pending.select("query_id", _kept(pending).alias("before")), "query_id")
        kind = groups.schema["rows"].dataType

        def step(kept: Column, row: Column) -> Column:
            clash = F.exists(
                kept, lambda x: (x["camera"] == row["camera"]) & (F.abs(x["ts_us"] - row["ts_us"]) <= span)
            )
            full = F.size(kept) + F.size("before") >= k
            return F.when(full | F.coalesce(clash, F.lit(False)), kept).otherwise(F.concat(kept, F.array(row)))

        folded = groups.select(
            "query_id",
            F.size("before").alias("n_before"),
            (F.size("rows") >= prefix).alias("cut"),
            F.aggregate("rows", F.array().cast(kind), step).alias("kept"),
            F.exists("rows", lambda r: r["result_type"] == "track").alias("tracked"),
        )
        folded = cut_lineage(folded)
        new = folded.select("query_id", "n_before", F.posexplode("kept").alias("pos", "r")).select(
            "query_id", (F.col("n_before") + F.col("pos") + 1).alias("rank"), "r.score", *[f"r.{c}" for c in RESULT]
        )
        done = new if done is None else done.unionByName(new)
        short = folded.filter(F.col("cut") & (F.col("n_before") + F.size("kept") < k))
        if short.isEmpty():
            return done
        prefix = longest
        block = F.transform(
            "kept",
            lambda x: F.struct(
                x["camera"].alias("camera"), x["ts_us"].alias("ts_us"), F.lit(span).cast("long").alias("span"),
                x["result_id"].alias("id"),
            ),
        )
        again = short.select("query_id", block.alias("_new"), "tracked")
        base = pending
        if "kept" not in pending.columns:
            base = pending.withColumn("kept", F.array().cast(_KEPT)).withColumn("no_frames", F.lit(False))
        pending = cut_lineage(
            base.join(again, "query_id")
            .withColumn("kept", F.concat("kept", "_new"))
            .withColumn("no_frames", F.col("no_frames") | (F.col("labels").isNotNull() & F.col("tracked")))
            .drop("_new", "tracked")
        )


def all_candidates(queries: DataFrame, tracks: DataFrame, frames: DataFrame, threshold: float | None = None) -> DataFrame:
    """Complete candidate sets (query_id, score, result columns) under the frame fallback rule, without a cut."""
    low = -2.0 if threshold is None else threshold
    found = scoring.score(_track_scan(tracks), queries, RESULT, minimum=low)
    scene = queries.filter(F.col("polygon").isNull()).drop("labels", "polygon", "colours")
    seen = scoring.score(_frame_scan(frames), scene, RESULT, minimum=low)
    named = queries.filter(F.col("labels").isNotNull()).select("query_id")
    answered = found.select("query_id").distinct().join(named, "query_id", "left_semi")
    return found.unionByName(seen.join(answered, "query_id", "left_anti"))


def candidate_counts(queries: DataFrame, tracks: Source, frames: Source, threshold: float | None = None) -> DataFrame:
    """(result_type, query_id, n): sizes of the sets that ``all_candidates`` returns, counted without forming them."""
    low = -2.0 if threshold is None else threshold
    found = cut_lineage(scoring.counts(_track_scan(tracks), queries, low))
    scene = queries.filter(F.col("polygon").isNull()).drop("labels", "polygon", "colours")
    named = queries.filter(F.col("labels").isNotNull()).select("query_id")
    answered = found.select("query_id").join(named, "query_id", "left_semi")
    seen = scoring.counts(_frame_scan(frames), scene.join(answered, "query_id", "left_anti"), low)
    return found.select(F.lit("track").alias("result_type"), "query_id", "n").unionByName(seen.select(F.lit("frame").alias("result_type"), "query_id", "n"))


_KEPT = "array<struct<camera:string,ts_us:bigint,span:bigint,id:string>>"


def _kept(queries: DataFrame) -> Column:
    return F.col("kept") if "kept" in queries.columns else F.array().cast(_KEPT)


def frame_baseline(queries: DataFrame, frames: DataFrame, k: int = 5) -> DataFrame:
    """Whole-frame baseline: frames only, no de-duplication."""
    if _many_plain(queries, frames):
        return _by_vectors(cut_lineage(queries), frame_rows(frames).select(*RESULT, "emb"), k, None, False)
    return _rank(scoring.score(_frame_scan(frames), queries.drop("labels", "polygon", "colours"), RESULT, k), k)


def rerank(results: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """Blend judged scores into the first k results of each query and re-sort them; the tail keeps its place.

    ``judgements``: query_id, result_id, is_match, conf.
    """
    judged = results.join(judgements, ["query_id", "result_id"], "left")
    seen = F.when(F.col("is_match"), F.col("conf")).otherwise(F.lit(0.0))
    blend = F.round(0.4 * F.col("score") + 0.6 * seen, 4)
    in_head = F.col("rank") <= k
    score = F.when(in_head & F.col("is_match").isNotNull(), blend).otherwise(F.col("score"))
    order = W.partitionBy("query_id").orderBy(
        F.when(in_head, 0).otherwise(1), F.when(in_head, -F.col("_s")), F.col("rank")
    )
    return (
        judged.withColumn("_s", score)
        .withColumn("new_rank", F.row_number().over(order))
        .select("query_id", "result_id", F.col("rank").alias("old_rank"), "new_rank", F.col("_s").alias("score"))
    )
