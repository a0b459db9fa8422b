"""Null keys, scores and times: the path for hot groups answers as the ordinary one and as a plain loop."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from camtrail.operators import alerts, greedy, live, providers
from camtrail.scale import split_hot
from camtrail.sources import keyed

from test_greedy import iou

NAN = float("nan")


def down(score):
    """Descending order: NaN first, null last."""
    return (score is None, not (score is not None and score != score), -(score or 0.0) if score == score else 0.0)


@pytest.mark.parametrize("max_group", [2000, 25])
def test_suppress_overlaps(spark, max_group):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        x, y = rnd.randrange(8) / 8, rnd.randrange(5) / 5
        score = rnd.choice([None, NAN, 0.1, 0.5, 0.5, 0.9])
        rows.append((rnd.choice([None, None, "a"]), f"r{i:03d}", x, y, x + 0.3 + rnd.randrange(5) / 50, y + 0.4, score))
    want, kept = set(), defaultdict(list)
    for g, rid, *box, score in sorted(rows, key=lambda r: (down(r[6]), r[1])):
        if not any(iou(box, k) >= 0.6 for k in kept[g]):
            kept[g].append(box)
            want.add(rid)
    df = spark.createDataFrame(rows, "g string, rid string, x1 double, y1 double, x2 double, y2 double, conf double")
    assert {r.rid for r in greedy.suppress_overlaps(df, ["g"], max_group=max_group).collect()} == want


@pytest.mark.parametrize("max_group", [2000, 25])
def test_thin_in_time(spark, max_group):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, None, "a"]), i, rnd.choice([None, *[k * 500_000 for k in range(300)]]), rnd.choice([None, NAN, 0.2, 0.7])) for i in range(400)]
    want, kept = set(), defaultdict(list)
    for g, i, t, s in sorted(rows, key=lambda r: (down(r[3]), r[1])):
        if t is None or not any(abs(x - t) <= 5_000_000 for x in kept[g]):
            want.add(i)
            if t is not None:
                kept[g].append(t)
    df = spark.createDataFrame(rows, "g string, id long, t long, s double")
    assert {r.id for r in greedy.thin_in_time(df, ["g"], "t", [("s", True)], "id", 5.0, max_group).collect()} == want


@pytest.mark.parametrize("max_group", [2000, 20])
def test_match_one_to_one(spark, max_group):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, None, "a"]), f"l{a}", f"r{rnd.randrange(12)}{k}", rnd.choice([None, 0.3, 0.8])) for a in range(40) for k in range(2)]
    want, used = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (down(r[3]), r[1], r[2])):
        if (g, "l", a) not in used and (g, "r", b) not in used:
            used |= {(g, "l", a), (g, "r", b)}
            want.add((g, a, b))
    df = spark.createDataFrame(rows, "g string, a string, b string, s double")
    assert {(r.g, r.a, r.b) for r in greedy.match_one_to_one(df, ["g"], "a", "b", "s", max_group).collect()} == want


@pytest.mark.parametrize("chunk_rows", [50_000, 15])
def test_sample_by_interval(spark, chunk_rows):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, "a"]), i, rnd.randrange(200) * 700_000) for i in range(300)]
    want = set()
    for g in (None, "a"):
        last = None
        for _, i, t in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if last is None or t - last >= 2_000_000:
                want.add(i)
                last = t
    df = spark.createDataFrame(rows, "g string, id long, t long")
    assert {r.id for r in greedy.sample_by_interval(df, ["g"], "t", "id", 2.0, chunk_rows).collect()} == want


def test_a_hot_group_without_a_key_is_split(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", 1)], "g string, id long")
    ordinary, hot = split_hot(df, ["g"], 10)
    assert ordinary.count() == 1 and hot.count() == 50


def test_frames_without_a_camera_have_gaps_and_recordings(spark):
    t0 = datetime(2026, 10, 8, 12)
    rows = [(c, i, t0 + timedelta(seconds=s)) for c in (None, "cam") for i, s in enumerate([0, 1, 20, 21])]
    frames = spark.createDataFrame(rows, "camera string, frame_no long, recv_ts timestamp_ntz")
    assert sorted((r.camera or "", r.gap_s) for r in live.reconnects(frames).collect()) == [("", 19.0), ("cam", 19.0)]
    assert live.recording_sessions(frames).count() == 4
    gaps = live.reconnect_summary(live.reconnects(frames)).collect()
    assert sorted((r.camera or "", r.reconnects) for r in gaps) == [("", 1), ("cam", 1)]


def test_rules_that_differ_in_their_threshold_have_ids_of_their_own(spark):
    kind = "rule_name string, query_text string, q_emb array<float>, camera_filter string, min_score double, created_at timestamp_ntz"
    now = datetime(2026, 1, 1)
    new = spark.createDataFrame([("a", "b", [1.0], None, 0.2, now), ("a", "b", [1.0], None, 0.3, now), ("a", "b", [1.0], "b", None, now), ("a|b", "", [1.0], None, None, now)], kind)
    none = spark.createDataFrame([], "id string, " + kind + ", is_active boolean")
    made = alerts.create_rules(none, new).collect()
    assert len({r.id for r in made}) == 4 and {r.min_score for r in made} == {0.2, 0.3, alerts.DEFAULT_SCORE}


@pytest.mark.parametrize("damaged", ["versions/v=1", "data", "keys"])
def test_a_damaged_event_table_is_not_taken_for_an_empty_one(spark, tmp_path, damaged):
    table = keyed.events(spark, str(tmp_path / "events"))
    assert table.version() == 0 and table.read().count() == 0
    rows = spark.createDataFrame([("e1", datetime(2026, 1, 1))], "event_id string, ts timestamp_ntz")
    table.upsert(rows, "one")
    assert table.read().count() == 1
    for file in (tmp_path / "events" / damaged).rglob("*.parquet"):
        file.write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        table.read().collect()
        table.existing(rows.select("event_id")).collect()


def test_equally_long_texts_are_compared_both_ways():
    assert providers.partial_similarity("abczz", "xabcy") == providers.partial_similarity("xabcy", "abczz") == 75.0


def test_only_pairs_above_their_own_threshold_leave_the_scan(spark):
    now = datetime(2026, 1, 1)
    rules = spark.createDataFrame(
        [("low", "n", "t", [1.0, 0.0], None, 0.1, True), ("high", "n", "t", [1.0, 0.0], None, 0.9, True), ("none", "n", "t", [1.0, 0.0], None, None, True)],
        "id string, rule_name string, query_text string, q_emb array<float>, camera_filter string, min_score double, is_active boolean",
    )
    tracks = spark.createDataFrame(
        [("a", "c", "car", now, "s", [1.0, 0.1]), ("b", "c", "car", now, "s", [0.5, 1.0]), ("z", "c", "car", now, "s", [-1.0, 0.0])],
        "id string, camera string, label string, t_start timestamp_ntz, snapshot string, emb array<float>",
    )
    got = {(r.rule_id, r.track_id) for r in alerts.evaluate(rules, tracks).collect()}
    assert got == {("low", "a"), ("low", "b"), ("high", "a")}


def test_latency_percentiles_by_ranks(spark):
    import numpy as np

    from camtrail.operators import evaluation

    rnd = random.Random(7)
    rows = [(s, rnd.choice([rnd.random(), 0.5, 2.0])) for s in ["a", "b", None] for _ in range(101)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    got = {r.stage: r for r in evaluation.latency_stats(spark.createDataFrame(rows, "stage string, ms double")).collect()}
    assert got.keys() == {"a", "b", None, "one", "none", "two"} and got["none"].median is None
    for s, r in got.items():
        values = [v for k, v in rows if k == s and v is not None]
        if values:
            assert abs(r.median - np.percentile(values, 50)) <= 0.005001 and abs(r.p95 - np.percentile(values, 95)) <= 0.005001
            assert (r.best, r.worst) == (min(values), max(values))
