"""Search, re-identification, alerts and metrics against plain loops."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from camtrail.operators import alerts, evaluation, reid, scoring, search
from camtrail.operators.scoring import round4

START = datetime(2026, 10, 8, 12)
TRACKS = (
    "id string, camera string, label string, t_start timestamp_ntz, t_end timestamp_ntz, t_best timestamp_ntz, offset_best double, bx1 double, "
    "by1 double, bx2 double, by2 double, colors string, snapshot string, emb array<float>"
)


def make_tracks(n, seed, same_second=0.0):
    rnd, gen = random.Random(seed), np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = START + timedelta(seconds=0 if rnd.random() < same_second else rnd.randrange(3600))
        v = gen.normal(size=8)
        v = (v / np.linalg.norm(v)).astype(np.float32)
        x, y = rnd.random() / 2, rnd.random() / 2
        colours = rnd.choice(["{}", '{"vehicle":[{"color":"red","fraction":0.9}]}'])
        rows.append((f"t{i:04d}", rnd.choice(["cam_1", "cam_2", "Cam_3"]), rnd.choice(["car", "person", "object"]), t, t + timedelta(seconds=5), t,
                     1.0, x, y, x + 0.3, y + 0.3, colours, "s", v.tolist()))
    return rows


def plain_search(q, rows, k, dedup):
    found = []
    for r in rows:
        if q.get("camera") and r[1].lower().replace("cam_", "") != q["camera"]:
            continue
        if q.get("labels") and r[2] != "object" and r[2] not in q["labels"]:
            continue
        s = float(np.dot(np.array(r[13], dtype=np.float64), q["v"].astype(np.float64)))
        if q.get("colours"):
            s += 0.03 if "red" in r[11] and "red" in q["colours"] else (-0.02 if r[11] != "{}" else 0.0)
        found.append((-float(round4(np.array(s))), r[0], r))
    kept = []
    for s, i, r in sorted(found, key=lambda x: (x[0], x[1])):
        if dedup is None or not any(o[1] == r[1] and abs((o[5] - r[5]).total_seconds()) <= dedup for _, _, o in kept):
            kept.append((s, i, r))
        if len(kept) >= k:
            break
    return [(i, -s) for s, i, _ in kept]


@pytest.mark.parametrize("same_second,dedup", [(0.0, 5.0), (0.0, 300.0), (0.9, 5.0), (0.0, None)])
def test_top_k(spark, same_second, dedup):
    rows = make_tracks(900, 1, same_second)
    gen = np.random.default_rng(9)
    queries = [
        {"v": gen.normal(size=8).astype(np.float32)}, {"v": gen.normal(size=8).astype(np.float32), "camera": "3"},
        {"v": gen.normal(size=8).astype(np.float32), "labels": ["car"]}, {"v": gen.normal(size=8).astype(np.float32), "colours": ["red"]},
    ]
    data = [(i, q["v"].tolist(), q.get("camera"), q.get("labels"), q.get("colours")) for i, q in enumerate(queries)]
    qdf = spark.createDataFrame(data, "query_id long, q_emb array<float>, camera_key string, labels array<string>, colours array<string>")
    tracks = spark.createDataFrame(rows, TRACKS).repartition(3)
    got = {}
    for r in search.top_k(qdf, tracks, None, k=12, dedup_s=dedup).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.result_id, r.score))
    for i, q in enumerate(queries):
        assert got[i] == plain_search(q, rows, 12, dedup), i


def test_frames_only_when_no_track_qualifies(spark):
    tracks = spark.createDataFrame(make_tracks(20, 2), TRACKS)
    frames = tracks.select(F.concat(F.lit("f"), "id").alias("id"), "camera", F.col("t_start").alias("t_abs"), F.lit(0.0).alias("offset_s"), "snapshot", "emb")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    v = [1.0] + [0.0] * 7
    data = [(1, v, None, None), (2, v, ["car"], None), (3, v, ["zebra"], None), (4, v, ["zebra"], square)]
    q = spark.createDataFrame(data, "query_id long, q_emb array<float>, labels array<string>, polygon array<struct<x:double,y:double>>")
    # Generic objects always pass the label filter; leave them out here.
    plain = tracks.filter("label <> 'object'")
    got = {(r.query_id, r.result_type) for r in search.top_k(q, plain, frames, k=50, dedup_s=0.0).collect()}
    assert got == {(1, "track"), (1, "frame"), (2, "track"), (3, "frame")}


def test_polygon_search(spark):
    rows = [list(make_tracks(1, 3)[0]) for _ in range(2)]
    rows[0][0], rows[1][0] = "inside", "outside"
    rows[0][7:11], rows[1][7:11] = [0.1, 0.1, 0.3, 0.3], [0.7, 0.7, 0.9, 0.9]
    for r in rows:
        r[13] = [0.0] * 8
    q = spark.createDataFrame([(1, [0.0] * 8, [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)])],
                              "query_id long, q_emb array<float>, polygon array<struct<x:double,y:double>>")
    tracks = spark.createDataFrame([tuple(r) for r in rows], TRACKS)
    assert [r.result_id for r in search.top_k(q, tracks).collect()] == ["inside"]


def test_small_query_blocks_give_the_same(spark):
    tracks = search.track_rows(spark.createDataFrame(make_tracks(200, 4), TRACKS))
    gen = np.random.default_rng(3)
    q = spark.createDataFrame([(i, gen.normal(size=8).tolist()) for i in range(30)], "query_id long, q_emb array<float>")
    whole = scoring.score(tracks, q, ["result_id", "camera", "ts_us"], 200)
    parts = scoring.score(tracks, q, ["result_id", "camera", "ts_us"], 200, block=7)
    key = lambda df: sorted((r.query_id, r.result_id, r.score) for r in df.collect())
    assert key(whole) == key(parts) and whole.count() == 6000
    every = scoring.score(tracks, q, ["result_id", "camera", "ts_us"], minimum=-1e9, block=7)
    assert key(every) == key(whole)


def test_kept_rows_block_alike_on_pairs_and_on_the_grid():
    import pyarrow as pa

    gen, n = np.random.default_rng(1), 50
    at = [None if i % 5 == 0 else int(gen.integers(0, 100)) for i in range(n)]
    rows = pa.RecordBatch.from_pydict({
        "result_id": [f"r{i}" for i in range(n)], "camera": pa.array([None if i % 7 == 0 else f"c{i % 3}" for i in range(n)], pa.string()), "ts_us": pa.array(at, pa.int64()),
    })
    one = lambda camera, ts, id: {"camera": camera, "ts_us": ts, "span": 15, "id": id}
    kept = [[], None, [one("c1", 30, "x"), one(None, 50, "y")], [one("c0", None, "r5"), one("none", 3, "r9")]]
    block = scoring.QueryBlock.read(pa.table({"query_id": range(4), "q_emb": [[0.0]] * 4, "kept": kept}))
    tests = scoring._Tests(rows, block)
    grid = tests.passed(np.arange(n)[:, None], np.arange(4)[None, :], np.ones((n, 4), bool))
    i, j = np.divmod(np.arange(4 * n), 4)
    assert (tests.passed(i, j, np.ones(4 * n, bool)).reshape(n, 4) == grid).all()
    for r, row in enumerate(rows.to_pylist()):
        for c, ks in enumerate(kept):
            hit = [row["result_id"] == k["id"] if k["ts_us"] is None else row["camera"] == k["camera"] and row["ts_us"] is not None and abs(row["ts_us"] - k["ts_us"]) <= 15 for k in ks or []]
            assert grid[r, c] == (not any(hit))


@pytest.mark.parametrize("block", [3, 4096])
def test_questions_with_a_window_read_their_span_alone(spark, block):
    tracks = spark.createDataFrame(make_tracks(300, 31), TRACKS)
    times = search.track_rows(tracks).agg(F.min("start_us"), F.max("end_us")).first()
    gen = np.random.default_rng(6)
    rows = [(i, gen.normal(size=8).tolist(), [None, "0", "1"][i % 3], times[0] if i % 2 else None, (times[0] + times[1]) // 2 if i % 2 else None) for i in range(18)]
    q = spark.createDataFrame(rows, "query_id long, q_emb array<float>, camera_key string, start_us long, end_us long")
    asked, scan = [], search._track_scan(tracks)

    def noted(reach):
        asked.append(reach)
        return scan(reach)

    names = ["result_id", "camera", "ts_us"]
    found = scoring.score(noted, q, names, 300, block=block, chunk_bytes=4_000, cell_rows=200)
    key = lambda df: sorted((r.query_id, r.result_id, r.score) for r in df.collect())
    assert key(found) == key(scoring.score(search.track_rows(tracks), q, names, 300))
    assert [b.timed for b in asked if b is not None] == [True, False]


@pytest.mark.parametrize("block", [5, 4096])
@pytest.mark.parametrize("distinct", [False, True])
def test_floors_of_the_first_chunks_lose_nothing(spark, block, distinct):
    rows = [list(r) for r in make_tracks(600, 21)]
    for r in rows[::3]:  # repeats of one camera and instant
        r[2], r[3], r[4], r[5] = rows[0][2], rows[0][3], rows[0][4], rows[0][5]
    tracks = search.track_rows(spark.createDataFrame([tuple(r) for r in rows], TRACKS).repartition(4))
    gen = np.random.default_rng(5)
    q = spark.createDataFrame([(i, gen.normal(size=8).tolist(), str(i % 2)) for i in range(20)], "query_id long, q_emb array<float>, camera_key string")
    for asked in (q.drop("camera_key"), q):
        args = (tracks, asked, ["result_id", "camera", "ts_us"], 6)
        plain = scoring.score(*args, distinct_times=distinct)
        floored = scoring.score(*args, distinct_times=distinct, block=block, chunk_bytes=4_000, floor_bytes=0, cell_rows=200)
        top = lambda df: sorted(
            (r.query_id, r.score) for r in df.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "result_id"))).filter("n <= 6").collect()
        )
        best = lambda df: top(df if not distinct else df.groupBy("query_id", "camera", "ts_us").agg(F.max("score").alias("score"), F.min("result_id").alias("result_id")))
        assert best(floored) == best(plain) and best(plain)
        # 36 chunks: without floors each would send 6 rows of a query.
        assert floored.count() < 0.6 * 36 * 6 * 20


def test_fifty_thousand_questions_stay_a_table(spark, tmp_path):
    rows = make_tracks(300, 31)
    spark.createDataFrame(rows, TRACKS).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    q = spark.range(50_000).select(F.col("id").alias("query_id"), F.array(*[F.sin(F.col("id") * (k + 1)).cast("float") for k in range(8)]).alias("q_emb"))
    out = scoring.score(search._track_scan(stored), q, ["result_id", "camera", "ts_us"], 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "FlatMapCoGroupsInArrow" in plan
    got = {r.query_id: r.score for r in out.filter("query_id % 997 = 0").collect()}
    emb = np.array([r[13] for r in rows], dtype=np.float32).astype(np.float64)
    ids = np.arange(0, 50_000, 997)
    vectors = np.sin(ids[:, None] * np.arange(1, 9)[None, :]).astype(np.float32).astype(np.float64)
    assert list(got) and all(got[i] == pytest.approx(s, abs=1e-4) for i, s in zip(ids.tolist(), (vectors @ emb.T).max(axis=1), strict=True))


@pytest.mark.parametrize("chunk_rows", [2000, 40, 9])
@pytest.mark.parametrize("by", ["time", "similarity"])
def test_associations(spark, chunk_rows, by):
    rows = make_tracks(150, 5, 0.3)
    tracks = spark.createDataFrame(rows, TRACKS)
    unit = {r[0]: np.array(r[13], dtype=np.float64) / np.linalg.norm(np.array(r[13], dtype=np.float64)) for r in rows}
    best, seen = {}, set()
    for a in sorted(rows, key=lambda r: (r[3], r[0])):
        found = []
        for b in rows:
            s = float(unit[a[0]] @ unit[b[0]])
            if a[1] != b[1] and abs((a[3] - b[3]).total_seconds()) <= 600 and s >= 0.4:
                found.append((b[3], -float(round4(np.array(s))), b[0]))
        found.sort(key=(lambda m: m) if by == "time" else (lambda m: (m[1], m[0], m[2])))
        for t, s, b in found[:3]:
            pair = tuple(sorted((a[0], b)))
            if pair not in seen:
                seen.add(pair)
                best[pair] = (a[0], b, -s)
    out = reid.associations(tracks, 0.4, 600, 3, by, chunk_rows)
    got = {tuple(sorted((r.track_a, r.track_b))): (r.track_a, r.track_b, r.similarity) for r in out.collect()}
    assert got == best


@pytest.mark.parametrize("chunk_rows", [2000, 9])
@pytest.mark.parametrize("look", [3, 12])
def test_first_matches_are_found_in_a_slice(spark, look, chunk_rows, monkeypatch):
    """Slices of the window, doubled for those that need more, give the first matches that the whole window gives."""
    tracks = spark.createDataFrame(make_tracks(250, 6, 0.2), TRACKS)
    order = W.partitionBy("src").orderBy("dst_us", F.desc("similarity"), "dst")

    def first(pairs):
        return {tuple(r) for r in pairs.withColumn("_n", F.row_number().over(order)).filter("_n <= 3").drop("_n").collect()}

    want = first(reid.similar_pairs(tracks, 0.4, 600, 3))
    monkeypatch.setattr(reid, "similar_pairs", None)
    assert first(reid.first_pairs(tracks, 0.4, 600, 3, chunk_rows, look)) == want and len(want) > 500


def test_matches_of_unknown_track(spark):
    with pytest.raises(ValueError):
        reid.matches_of(spark.createDataFrame(make_tracks(3, 6), TRACKS), "nope")


def test_alerts_fire_once(spark):
    tracks = spark.createDataFrame(make_tracks(60, 7), TRACKS)
    v = [1.0] + [0.0] * 7
    rules = spark.createDataFrame(
        [("r1", "one", "q", v, None, 0.3, True), ("r2", "two", "q", v, "cam_1", 0.0, True), ("r3", "off", "q", v, None, -1.0, False)],
        "id string, rule_name string, query_text string, q_emb array<float>, camera_filter string, min_score double, is_active boolean",
    )
    first = alerts.evaluate(rules, tracks)
    rows = first.collect()
    assert {r.rule_id for r in rows} == {"r1", "r2"} and all(r.camera == "cam_1" for r in rows if r.rule_id == "r2")
    assert all(r.score >= 0.3 for r in rows if r.rule_id == "r1") and len({r.event_id for r in rows}) == len(rows)
    assert alerts.evaluate(rules, tracks, first).count() == 0
    touched = alerts.touch_rules(rules, first, F.lit("2026-01-01").cast("timestamp_ntz"))
    assert {r.id for r in touched.filter("last_triggered_at is not null").collect()} == {"r1", "r2"}


def test_auc_and_ties(spark):
    rnd = random.Random(8)
    rows = [("k", round(rnd.random(), 1), int(rnd.random() < 0.4)) for _ in range(200)] + [("none", 0.5, 0)]
    pos = [s for k, s, p in rows if k == "k" and p]
    neg = [s for k, s, p in rows if k == "k" and not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "k string, s double, p int")
    got = {r.k: r.auc for r in evaluation.roc_auc(df, "k", "s", "p").collect()}
    assert got["k"] == pytest.approx(want) and got["none"] == 0.5
    assert {r.k: r.auc for r in evaluation.roc_auc(df, "k", "s", "p", 0.0).collect()}["none"] == 0.0


def test_scan_is_pruned_to_what_the_questions_can_match(spark, tmp_path):
    from camtrail.sources import index

    tracks = spark.createDataFrame(make_tracks(200, 11), TRACKS)
    index.write_tracks(tracks, str(tmp_path / "tracks"))
    stored = spark.read.parquet(str(tmp_path / "tracks"))
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    q = spark.createDataFrame([(1, [1.0] + [0.0] * 7, "1", base, base + 600_000_000), (2, [1.0] + [0.0] * 7, "1", base, base + 900_000_000)],
                              "query_id long, q_emb array<float>, camera_key string, start_us long, end_us long")
    block = next(scoring.query_blocks(q))
    scan = search.narrow(stored, "t_start", "t_end", block)
    plan = scan._sc._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "simple")
    assert "PushedFilters: [IsNotNull(t_start), IsNotNull(t_end), LessThanOrEqual(t_start" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*lower\(camera", plan)
    got = {(r.query_id, r.result_id) for r in search.top_k(q, stored, k=500, dedup_s=None).collect()}
    assert got == {(r.query_id, r.result_id) for r in search.top_k(q, tracks, k=500, dedup_s=None).collect()} and got


def test_empty_and_incomplete_inputs(spark):
    none = spark.createDataFrame([], TRACKS)
    q = spark.createDataFrame([(1, [1.0] + [0.0] * 7), (2, None)], "query_id long, q_emb array<float>")
    assert search.top_k(q, none).count() == 0
    assert reid.associations(none).count() == 0
    row = list(make_tracks(1, 12)[0])
    bare = spark.createDataFrame([tuple(row), ("nov", *row[1:13], None), ("not", *row[1:3], None, None, None, *row[6:])], TRACKS)
    assert {r.result_id for r in search.top_k(q, bare, dedup_s=0.0).collect()} == {"t0000", "not"}
    windowed = q.withColumn("start_us", F.lit(0).cast("long")).withColumn("end_us", F.lit(4_000_000_000_000_000).cast("long"))
    assert {r.result_id for r in search.top_k(windowed, bare).collect()} == {"t0000"}
    assert search.top_k(q.filter("query_id = 2"), bare).count() == 0


def test_equal_scores_are_ordered_by_id(spark):
    row = make_tracks(1, 13)[0]
    rows = [(f"t{i}", *row[1:3], *[START + timedelta(seconds=60 * i)] * 3, *row[6:]) for i in range(30)]
    q = spark.createDataFrame([(1, row[13])], "query_id long, q_emb array<float>")
    tracks = spark.createDataFrame(rows, TRACKS).repartition(4)
    got = [r.result_id for r in search.top_k(q, tracks, k=5).orderBy("rank").collect()]
    assert got == sorted(f"t{i}" for i in range(30))[:5]


def test_rerank_keeps_the_tail(spark):
    results = spark.createDataFrame([(1, i, f"r{i}", s) for i, s in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6))],
                                    "query_id long, rank int, result_id string, score double")
    judged = spark.createDataFrame([(1, "r1", False, 0.9), (1, "r2", True, 1.0), (1, "r4", True, 1.0)],
                                   "query_id long, result_id string, is_match boolean, conf double")
    got = [(r.result_id, r.score) for r in search.rerank(results, judged, 3).orderBy("new_rank").collect()]
    assert got == [("r2", 0.92), ("r3", 0.7), ("r1", 0.36), ("r4", 0.6)]


@pytest.mark.parametrize("distinct", [False, True])
def test_scan_scores_all_pairs_of_the_first_batches_only(monkeypatch, distinct):
    """Once a query has a floor, only pairs that can reach it are scored in double precision; the answer is that of all pairs."""
    import pyarrow as pa

    rng, n = np.random.default_rng(3), 4_000
    vectors, asked = rng.standard_normal((n, 8)).astype(np.float32), rng.standard_normal((30, 8))
    vectors[390:410] = vectors[390]  # equal scores, over two batches
    colours = [["red"] if i % 3 else None for i in range(n)]
    rows = pa.record_batch({
        "result_id": [f"r{i:05d}" for i in range(n)], "camera": [f"c{i % 3}" for i in range(n)], "camera_key": [str(i % 3) for i in range(n)], "ts_us": [i // 2 for i in range(n)],
        "label_low": ["car" if i % 2 else "dog" for i in range(n)], "colours": pa.array(colours, pa.list_(pa.string())), "emb": pa.array(vectors.tolist(), pa.list_(pa.float32())),
    })
    q = scoring.QueryBlock.read(pa.table({
        "query_id": list(range(30)), "q_emb": asked.tolist(), "camera_key": ["1" if j % 4 == 0 else None for j in range(30)],
        "labels": pa.array([["car"] if j % 5 == 0 else None for j in range(30)], pa.list_(pa.string())), "colours": pa.array([["red"] if j % 2 else None for j in range(30)], pa.list_(pa.string())),
    }))
    out = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("result_id", pa.string()), ("camera", pa.string()), ("ts_us", pa.int64())])
    whole, dense = scoring._masked_scores, []
    monkeypatch.setattr(scoring, "_masked_scores", lambda *a: dense.append(1) or whole(*a))
    batches = [rows.slice(at, 200) for at in range(0, n, 200)]
    got = pa.Table.from_batches(list(scoring._scan(batches, q, 5, None, distinct, False, False, ["result_id", "camera", "ts_us"], out)))
    assert len(dense) <= 5  # of 20 batches
    scores = round4(whole(rows, q, False))
    for j in range(30):
        mine = got.filter(pa.array(got["query_id"].to_numpy() == j))
        want, seen = [], set()
        for i in sorted(range(n), key=lambda i: (-scores[i, j], i)):
            if len(want) < 5 and np.isfinite(scores[i, j]) and not (distinct and (i % 3, i // 2) in seen):
                want.append((f"r{i:05d}", scores[i, j]))
                seen.add((i % 3, i // 2))
        assert sorted(zip(mine["result_id"].to_pylist(), mine["score"].to_pylist())) == sorted(want)


def test_narrative_rounds_the_binary_value_half_to_even(spark):
    shown = {0.145: "0.14", 0.125: "0.12", 0.135: "0.14", 0.0651: "0.07", 1.0: "1.00"}
    rows = spark.sql(" union all ".join(
        f"select 'q' query_id, 'cam_1' query_camera, timestamp_ntz'2024-01-01 00:00:00' query_start, 'cam_2' camera, timestamp_ntz'2024-01-01 00:00:0{i}' t_start, {s}D similarity, 't{i}' track_id"
        for i, s in enumerate(shown)
    ))
    line = reid.narrative(rows).first()["trajectory"]
    assert [p.split(")")[0] for p in line.split("(sim: ")[1:]] == list(shown.values())
    assert list(shown.values()) == [f"{s:.2f}" for s in shown]


@pytest.mark.parametrize("length", [1.0, 3.0])
def test_candidates_are_counted_without_being_formed(spark, length, monkeypatch):
    """Set sizes under all filters and the fallback rule, also where long vectors put scores below the minimum; the sets themselves stay unformed."""
    rnd = random.Random(8)
    vector = lambda: [length * rnd.choice([-1.0, 1.0]) * x for x in rnd.choice([(1.0, 0.0), (0.6, 0.8)])]
    at = datetime(2024, 1, 1)
    tracks = spark.createDataFrame(
        [(f"t{i}", f"cam_{i % 3}", at + timedelta(minutes=i), at + timedelta(minutes=i + 5), at, 0.0, rnd.choice(["car", "dog"]), 0.1, 0.1, rnd.choice([0.3, 0.9]), 0.3,
          rnd.choice(["{}", '{"vehicle":[{"color":"red","fraction":0.7}]}']), vector()) for i in range(120)],
        "id string, camera string, t_start timestamp_ntz, t_end timestamp_ntz, t_best timestamp_ntz, offset_best double, label string, bx1 double, by1 double, bx2 double, by2 double, colors string, emb array<float>")
    frames = spark.createDataFrame([(f"f{i}", f"cam_{i % 3}", at + timedelta(minutes=i), 0.0, vector()) for i in range(90)],
                                   "id string, camera string, t_abs timestamp_ntz, offset_s double, emb array<float>")
    us = lambda m: int((at + timedelta(minutes=m) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    shape = [(0.0, 0.0), (0.35, 0.0), (0.35, 0.35), (0.0, 0.35)]
    asked = [(i, vector(), rnd.choice([None, "1", "7"]), *rnd.choice([(None, None), (us(10), us(40))]), rnd.choice([None, ["car"], ["bird"]]),
              shape if i % 4 == 0 else None, rnd.choice([[], ["red"]])) for i in range(30)]
    q = spark.createDataFrame(asked, "query_id long, q_emb array<float>, camera_key string, start_us long, end_us long, labels array<string>, "
                                     "polygon array<struct<x:double,y:double>>, colours array<string>")
    formed = search.all_candidates(q, tracks, frames).groupBy("result_type", "query_id").agg(F.count(F.lit(1)).alias("n")).collect()
    want = {(r.result_type, r.query_id, r.n) for r in formed}
    monkeypatch.setattr(scoring, "score", None)
    assert {(r.result_type, r.query_id, r.n) for r in search.candidate_counts(q, tracks, frames).collect()} == want
    assert {w[0] for w in want} == {"track", "frame"} and len({w[1] for w in want}) > 15
