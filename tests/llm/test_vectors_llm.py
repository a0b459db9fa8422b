"""Searches and sharding against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from camtrail.llm import ann, sharding, topk

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def rows_of(n=400, dim=16, seed=3, copies=60):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[20 : 20 + copies] = x[20]  # a group of copies: ties
    rows = [(i, [float(v) for v in r], "s", 1) for i, r in enumerate(x)]
    bad = [(1000, None, None, None), (1020, [0.0] * dim, None, 0), (1040, [float("nan")] + [1.0] * (dim - 1), None, 0),
           (1041, [None] + [1.0] * (dim - 1), None, 0), (1042, [float("inf")] + [1.0] * (dim - 1), None, 0), (1060, [], None, 0), (None, [1.0] * dim, "x", 0)]
    return rows, bad


def brute(x, ids, k=20, every=20):
    s = x @ x.T
    out = {}
    for i, v in enumerate(ids):
        if v % every == 0:
            order = sorted((j for j in range(len(ids)) if ids[j] != v), key=lambda j: (-s[i, j], ids[j]))[:k]
            out[v] = [(ids[j], s[i, j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_top_k_is_exact_with_ties_zeros_and_bad_rows(spark):
    rows, bad = rows_of()
    df = spark.createDataFrame(rows + bad, SCHEMA)
    good = rows + [bad[1]]  # a zero vector takes part
    x = np.floor(64 * np.array([r[1] for r in good])).astype(np.int64)
    want = brute(x, [r[0] for r in good])
    for options in ({}, {"chunk": 50, "query_chunk": 7}):
        assert answers(topk.exact_top(df, **options)) == want
    few = spark.createDataFrame(rows[:5], SCHEMA)
    assert len(answers(topk.exact_top(few))[0]) == 4


@pytest.mark.parametrize("options", [{}, {"chunk": 40, "query_chunk": 5, "lists": 8, "probes": 8}])
def test_nearest_visiting_all_lists_finds_all(spark, options):
    rows, bad = rows_of()
    df = spark.createDataFrame(rows + bad, SCHEMA)
    want = brute(np.array([r[1] for r in rows]), [r[0] for r in rows])
    got = answers(ann.nearest(df, **{"lists": 16, "probes": 16, "z": 1e9, **options}))
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [a for a, _ in got[q]] == [a for a, _ in w]
        assert np.allclose([s for _, s in got[q]], [s for _, s in w], rtol=1e-12)


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.toPandas().sort_values("vec_id")
    want = brute(np.stack(t["embedding"]).astype(float), list(t["vec_id"]))
    got = answers(ann.nearest(df))
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("share", [0.34, 0.5, 0.67])
def test_nearest_recall_with_many_equal_rows(spark, share):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32))
    equal = rng.random(len(x)) < share
    x[equal] = x[7]
    x[5::11] = x[5::11] * 2.0  # some copies are longer than others
    want = brute(x, list(range(len(x))))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = answers(ann.nearest(df))
    others = [q for q in want if not equal[q]]
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in others)
    assert hits / (20 * len(others)) >= 0.9
    for q in want:
        assert q in got and len(got[q]) == 20


@pytest.mark.parametrize("kind", ["groups", "offset", "flat"])
def test_nearest_recall_where_near_vectors_agree_in_every_part(spark, kind):
    rng = np.random.default_rng(12)
    n, dim = 3000, 64
    noise = rng.standard_normal((n, dim))
    x = {
        "groups": rng.standard_normal((20, dim))[rng.integers(0, 20, n)] + 0.3 * noise,  # tight groups
        "offset": 1 + 0.3 * noise,  # all rows on one side
        "flat": rng.standard_normal((n, 6)) @ rng.standard_normal((6, dim)) + 0.05 * noise,  # few real dimensions
    }[kind]
    want = brute(x, list(range(n)))
    got = answers(ann.nearest(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")))
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_probes_are_measured_on_the_queries():
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((60, 32))
    x = middle[rng.integers(0, 60, 3000)] + 0.1 * rng.standard_normal((3000, 32))
    centres = ann.fit_lists(x, 60)
    away = rng.standard_normal((200, 32))  # between the groups
    own, _ = ann.nearest_lists(x, centres)
    near = np.argsort(-(away @ x.T), axis=1)[:, :20]
    probes = ann.measure_probes(x, centres, 20, asked=away, same=np.full(200, -1))
    visited = np.argsort(-(away @ centres.T), axis=1)[:, :probes]
    assert np.mean([np.isin(own[n], v).mean() for n, v in zip(near, visited)]) >= 0.9
    assert probes > ann.measure_probes(x, centres, 20)


def test_lists_follow_distinct_directions_and_measured_recall():
    rng = np.random.default_rng(4)
    shares = []
    for n in (2_000, 16_000):
        middle = rng.standard_normal((n // 200, 32)) * 2
        x = middle[rng.integers(0, len(middle), n)] + rng.standard_normal((n, 32)) / 2
        x[: n // 2] = x[0]
        centres = ann.fit_lists(x, int(n**0.5))
        own, _ = ann.nearest_lists(x, centres)
        assert len(np.unique(own)) > 0.9 * len(centres)
        shares.append(ann.measure_probes(x, centres, 20) / len(centres))
    assert shares[1] < shares[0] < 0.5  # clustered rows need few lists, and a smaller share of them as they grow


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty).count() == 0 and topk.exact_top(empty).count() == 0
    bad = spark.createDataFrame([(20, [0.0, 0.0], "a", 1)], SCHEMA)
    assert ann.nearest(bad).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 10_000, 3000))[::-1]
    sums = np.zeros((3000, 24), np.int64)
    sums[:, 0] = sizes
    place = sharding.difference(sums)[:, 0]
    total = np.bincount(place, weights=sizes, minlength=24)
    assert total.max() - total.min() <= 2


def test_shards_keep_copies_together_and_number_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 10)
    rng = np.random.default_rng(2)
    rows = [(i, f"{i:05d}" + "x" * int(rng.integers(1, 500)), i) for i in range(2000)] + [(i, "copy", 0) for i in range(2000, 3000)]
    rows += [(3000, None, 1), (3001, None, 1), (3002, "", 1), (None, "null id", 1), (5, "again", 1), (5, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    out = sharding.shard_documents(df, nodes=480).toPandas()
    assert len(out) == len(rows)
    shards = out.groupby(out["text"].fillna("none"))["shard"].nunique()
    assert list(shards[shards > 1].index) == []
    for _, s in out.groupby("shard")["slot"]:
        assert sorted(s) == list(range(len(s)))
    assert (out["size"] == out["text"].fillna("").str.len() + 8).all()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() - loads.min() <= 0.05 * loads.mean()
    assert sharding.shard_documents(df.limit(0)).count() == 0
