"""Track building."""

import random

import pytest
from pyspark.sql import functions as F

from camtrail.functions import boxes, vectors
from camtrail.operators import evaluation, tracks as T
from camtrail.plans import ingest
from test_greedy import iou

OBS = (
    "camera string, video string, track_id long, frame_idx long, offset_s double, ts timestamp_ntz, x1 double, y1 double, x2 double, y2 double, "
    "conf double, quality double, label string, rid string"
)


def obs(track, frame, conf=0.9, quality=1.0, label="car", x=0.0):
    return ("c", "v", track, frame, frame * 0.5, None, x, 0.0, x + 1.0, 1.0, conf, quality, label, f"{track}-{frame}")


def test_summary_vote_and_filter(spark):
    rows = [obs(1, f, 0.5, 1.0 + (f == 2), "car" if f < 3 else "van") for f in range(6)]
    rows += [obs(2, 0), obs(2, 1)] + [obs(3, f) for f in range(3)] + [obs(4, f, 0.2) for f in range(6)]
    got = {r.track_id: r for r in T.with_drop_reason(T.summarise(spark.createDataFrame(rows, OBS))).collect()}
    # Both labels weigh 1.5: the one seen first wins. The best frame is the earliest of the best quality.
    assert (got[1].hits, got[1].label, got[1].offset_best, got[1].duration_s, got[1].drop_reason) == (6, "car", 1.0, 2.5, None)
    assert [got[i].drop_reason for i in (2, 3, 4)] == ["duration", "hits", "mean_conf"]
    counts = {r.drop_reason: r.n for r in T.drop_counts(T.with_drop_reason(T.summarise(spark.createDataFrame(rows, OBS)))).collect()}
    assert counts == {"duration": 1, "hits": 1, "mean_conf": 1, "total_dropped": 3}


@pytest.mark.parametrize("max_frame", [5_000, 10])
def test_suppress_secondary(spark, max_frame):
    rnd = random.Random(3)

    def some(n, prefix):
        rows = []
        for i in range(n):
            x, y = rnd.randrange(30) / 10, rnd.randrange(30) / 10
            rows.append((0 if rnd.random() < 0.8 else 1, x, y, x + 0.5, y + 0.6, f"{prefix}{i}"))
        return rows

    primary, secondary = some(60, "p"), some(120, "s")
    want = {s[5] for s in secondary if not any(p[0] == s[0] and iou(s[1:5], p[1:5]) > 0.4 for p in primary)}
    kind = "f long, x1 double, y1 double, x2 double, y2 double, rid string"
    out = T.suppress_secondary(spark.createDataFrame(primary, kind), spark.createDataFrame(secondary, kind), ["f"], max_frame=max_frame)
    got = [r.rid for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 120


def test_stitching_a_chain(spark):
    v = [1.0, 0.0]
    us = 1_000_000
    rows = [("v", "person", "a", 0, us, v), ("v", "person", "b", 2 * us, 3 * us, v), ("v", "person", "c", 5 * us, 6 * us, v), ("v", "person", "d", 9 * us, 9 * us, v)]
    df = spark.createDataFrame(rows, "video string, grp string, id string, start_us long, end_us long, emb array<double>")
    df = df.select("*", *[F.lit(0.5).alias(c) for c in ("fx", "fy", "lx", "ly")])
    pairs = T.stitch_pairs(df)
    # b -> c starts exactly at the largest gap of two seconds; d is too late.
    assert {(r.base_id, r.cand_id, r.gap_s) for r in pairs.collect()} == {("a", "b", 1.0), ("b", "c", 2.0)}
    roots = {r.id: r.root for r in T.chain_roots(T.stitch_matches(pairs)).collect()}
    assert roots == {"b": "a", "c": "a"}
    merged = T.merged_vectors(df, T.stitch_matches(pairs), 2)
    assert {r.root: r.parts for r in merged.collect()} == {"a": 3, "d": 1}


def test_boxes_and_polygons(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5))])
    df = spark.createDataFrame([(0.25, 0.25), (0.75, 0.75), (0.6, 0.2), (0.2, 0.8)], "x double, y double")
    assert [r.i for r in df.select(boxes.in_polygon(F.col("x"), F.col("y"), square).alias("i")).collect()] == [True, False, False, False]
    assert df.filter(boxes.in_fixed_polygon(F.col("x"), F.col("y"), [(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)])).count() == 1
    assert df.filter(boxes.in_fixed_polygon(F.col("x"), F.col("y"), [(0, 0), (1, 1)])).count() == 4


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(
        vectors.cosine(F.col("a"), F.col("z")).alias("zero"), vectors.norm(vectors.unit(F.col("a"))).alias("one"),
        vectors.unit(F.col("z")).alias("still"), vectors.decode_f4(vectors.encode_f4("a")).alias("back"),
    ).first()
    assert (r.zero, r.one, r.still, r.back) == (0.0, 1.0, [0.0, 0.0], [3.0, 4.0])


def test_classes_in_blocks(spark):
    rnd = random.Random(6)
    crops = spark.createDataFrame([(i, [rnd.random(), rnd.random()], f"n{i % 7}") for i in range(40)], "id long, emb array<double>, want string")
    prompts = spark.createDataFrame([(f"n{i}", [rnd.random(), rnd.random()]) for i in range(7)], "name string, vec array<double>")
    whole = {r.id: (r.best, r.target_rank) for r in evaluation.class_ranks(evaluation.zero_shot(crops, prompts), prompts, "want").collect()}
    parts = {r.id: (r.best, r.target_rank) for r in evaluation.class_ranks(evaluation.zero_shot(crops, prompts, 2), prompts, "want", 2).collect()}
    assert whole == parts and len(whole) == 40


def test_detections_to_tracks(spark):
    """A car seen in ten frames by both detectors becomes one good track."""
    rows = [("c", "v", f, f * 100_000, f * 0.25, 0.01 * f, 0.0, 0.3 + 0.01 * f, 0.3, 0.8, "car", 1.0, f"p{f}") for f in range(10)]
    more = [("c", "v", f, f * 100_000, f * 0.25, 0.01 * f, 0.0, 0.31 + 0.01 * f, 0.3, 0.5, "van", 1.0, f"s{f}") for f in range(10)]
    kind = "camera string, video string, frame_idx long, us long, offset_s double, x1 double, y1 double, x2 double, y2 double, conf double, label string, quality double, rid string"
    fused = ingest.fuse(spark.createDataFrame(rows, kind), spark.createDataFrame(more, kind))
    assert {r.rid for r in fused.collect()} == {f"p{f}" for f in range(10)}
    built = ingest.build(fused.withColumn("ts", F.lit("2026-01-01").cast("timestamp_ntz"))).collect()
    assert len(built) == 1 and (built[0].hits, built[0].label, built[0].grp) == (10, "car", "vehicle")


@pytest.mark.parametrize("limits", [{}, {"cell_pairs": 1}, {"cell_pairs": 1, "most_pairs": 20}, {"cell_rows": 30}])
def test_stitching_without_pairs(spark, limits):
    """Matches of many tracks in a gap, with copies whose cosines tie, for cells of all sizes and for what they leave open."""
    rnd = random.Random(4)
    us, rows = 1_000_000, []
    for i in range(400):
        start, v = rnd.randrange(16_000) * us // 400, rnd.choice([[1.0, 0.0], [0.8, 0.6], [0.6, 0.8], None])
        rows.append((rnd.choice(["v", None] if i % 40 == 0 else ["v"]), rnd.choice(["person", "vehicle"]), f"t{i}", start, start + rnd.randrange(3) * us, v, rnd.randrange(4) / 10))
    df = spark.createDataFrame(rows, "video string, grp string, id string, start_us long, end_us long, emb array<float>, fx double")
    df = df.select("*", F.col("fx").alias("lx"), *[F.lit(0.5).alias(c) for c in ("fy", "ly")])
    made = []
    for a in rows:
        for b in rows:
            if a[0] is None or a[:2] != b[:2] or a[5] is None or b[5] is None or (b[3], b[2]) <= (a[3], a[2]) or not 0 <= b[3] - a[4] <= 2 * us or abs(a[6] - b[6]) > 0.25:
                continue
            s = sum(x * y for x, y in zip(a[5], b[5]))
            if round(s, 4) >= (0.88 if a[1] == "vehicle" else 0.8):
                made.append((-round(s, 4), a[2], b[2]))
    # Products of these vectors lie far from both thresholds but for 0.8, which single precision carries above it.
    assert {(r.base_id, r.cand_id) for r in T.stitch_pairs(df).collect()} == {m[1:] for m in made} and len(made) > 800
    assert {(r.base_id, r.cand_id) for r in T.stitch_pairs(df, bucket_rows=16).collect()} == {m[1:] for m in made}
    left, right, want = set(), set(), set()
    for s, a, b in sorted(made):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b))
    got = [(r.base_id, r.cand_id) for r in T.stitch(df, **limits).collect()]
    assert set(got) == want and len(got) == len(want)
