"""Greedy selections against plain loops, for ordinary groups and for the path of hot groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from camtrail.operators import greedy
from camtrail.scale import follow_pointers, next_at_or_after


def loop_dedup(rows, window):
    out, kept = set(), defaultdict(list)
    for g, i, t, s in sorted(rows, key=lambda r: (-r[3], r[1])):
        if t is None:
            out.add(i)
        elif not any(abs(x - t) <= window for x in kept[g]):
            kept[g].append(t)
            out.add(i)
    return out


@pytest.mark.parametrize("max_group", [2000, 50])
@pytest.mark.parametrize("seed", [1, 2])
def test_thin_in_time(spark, seed, max_group):
    rnd = random.Random(seed)
    rows = [
        (rnd.choice("abc") if rnd.random() < 0.5 else "a", i, rnd.randrange(400) * 500_000 if rnd.random() < 0.95 else None,
         round(rnd.random(), 1))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "g string, id long, t long, s double")
    got = {r.id for r in greedy.thin_in_time(df, ["g"], "t", [("s", True)], "id", 5.0, max_group).collect()}
    assert got == loop_dedup(rows, 5_000_000)


def test_window_is_closed(spark):
    df = spark.createDataFrame([("a", 1, 0, 0.9), ("a", 2, 5_000_000, 0.8), ("a", 3, 5_000_001, 0.7)], "g string, id long, t long, s double")
    for max_group in (10, 1):
        got = {r.id for r in greedy.thin_in_time(df, ["g"], "t", [("s", True)], "id", 5.0, max_group).collect()}
        assert got == {1, 3}


def iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if inter > 0 and union > 0 else 0.0


@pytest.mark.parametrize("max_group", [2000, 30])
def test_suppress_overlaps(spark, max_group):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rnd.randrange(8) / 8, rnd.randrange(5) / 5
        rows.append((0 if rnd.random() < 0.7 else rnd.randrange(5), f"r{i:03d}", x, y, x + 0.3 + rnd.randrange(5) / 50, y + 0.4, round(rnd.random(), 2)))
    want, kept = set(), defaultdict(list)
    for f, rid, *box, conf in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(iou(box, k) < 0.6 for k in kept[f]):
            kept[f].append(box)
            want.add(rid)
    df = spark.createDataFrame(rows, "f long, rid string, x1 double, y1 double, x2 double, y2 double, conf double")
    assert {r.rid for r in greedy.suppress_overlaps(df, ["f"], max_group=max_group).collect()} == want


def test_suppression_drops_at_the_threshold(spark):
    # IoU of the two boxes is exactly 0.5.
    df = spark.createDataFrame([(0, "a", 0.0, 0.0, 1.0, 2.0, 0.9), (0, "b", 0.0, 0.0, 1.0, 1.0, 0.8)],
                               "f long, rid string, x1 double, y1 double, x2 double, y2 double, conf double")
    assert [r.rid for r in greedy.suppress_overlaps(df, ["f"], threshold=0.5).collect()] == ["a"]
    assert greedy.suppress_overlaps(df, ["f"], threshold=0.51).count() == 2


@pytest.mark.parametrize("max_group", [2000, 20])
def test_match_one_to_one(spark, max_group):
    rnd = random.Random(7)
    made = {(rnd.choice("xy") if rnd.random() < 0.3 else "x", rnd.randrange(60), 100 + rnd.randrange(60)): round(rnd.random(), 2) for _ in range(500)}
    rows = [(*k, s) for k, s in made.items()]
    left, right, want = defaultdict(set), defaultdict(set), set()
    for g, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if a not in left[g] and b not in right[g]:
            left[g].add(a)
            right[g].add(b)
            want.add((g, a, b))
    df = spark.createDataFrame(rows, "g string, l long, r long, s double")
    got = {(x.g, x.l, x.r) for x in greedy.match_one_to_one(df, ["g"], "l", "r", "s", max_group).collect()}
    assert got == want


@pytest.mark.parametrize("chunk_rows", [50_000, 60, 20])
def test_sample_by_interval(spark, chunk_rows):
    rnd = random.Random(3)
    rows, want = [], set()
    for g in "ab":
        t, last = 0, None
        for i in range(1000):
            t += rnd.choice([33_000, 100_000, 5_000_000 if rnd.random() < 0.02 else 10_000, 30_000_000 if rnd.random() < 0.01 else 1000])
            rows.append((g, i, t))
            if last is None or t - last >= 2_000_000:
                want.add((g, t))
                last = t
    df = spark.createDataFrame(rows, "g string, i long, t long")
    got = {(r.g, r.t) for r in greedy.sample_by_interval(df, ["g"], "t", "i", 2.0, chunk_rows).collect()}
    assert got == want


def test_sampling_with_a_wrong_clock_and_a_burst(spark):
    rnd = random.Random(9)
    times = [rnd.randrange(0, 400_000_000) for _ in range(600)]
    times += [4_000_000_000_000_000, -7_000_000_000]  # clocks that are wrong
    times += [200_000_000 + i * 500 for i in range(900)]  # more frames in one interval than a chunk holds
    want, last = set(), None
    for t in sorted(times):
        if last is None or t - last >= 2_000_000:
            want.add(t)
            last = t
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", 1, 5), ("a", 9999, None)], "g string, i long, t long")
    got = {(r.g, r.t) for r in greedy.sample_by_interval(df, ["g"], "t", "i", 2.0, 64).collect()}
    assert got == {("a", t) for t in want} | {("b", 5)}


def test_next_at_or_after(spark):
    rnd = random.Random(2)
    marks = sorted({(rnd.choice("ab"), rnd.randrange(500)) for _ in range(60)} | {(None, 7)}, key=str)
    asked = sorted({(rnd.choice("abc"), rnd.randrange(600)) for _ in range(200)} | {(None, 3), (None, 8)}, key=str)
    got = next_at_or_after(spark.createDataFrame(asked, "g string, t long"), spark.createDataFrame(marks, "g string, m long"), ["g"], "t", "m", "n")
    want = {(g, t, min((m for h, m in marks if h == g and m >= t), default=None)) for g, t in asked}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(asked)


def test_follow_pointers(spark):
    links = [(i, i + 1) for i in range(37)] + [(100, 101)]
    got = {r.a: (r.root, r.hops) for r in follow_pointers(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got[0] == (37, 37) and got[36] == (37, 1) and got[100] == (101, 1) and len(got) == 38


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "g string, id long, t long, s double")
    assert greedy.thin_in_time(df, ["g"], "t", [("s", True)], "id", 5.0).count() == 0
    assert greedy.sample_by_interval(df, ["g"], "t", "id").count() == 0
    assert df.select(F.lit(1)).count() == 0
