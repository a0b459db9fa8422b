"""Near-duplicate components against all pairs of full sets."""

import random
import re

import pyarrow as pa
import pytest

from camtrail.llm import minhash

SCHEMA = "doc_id long, text string, component_id string, a int"


def data(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    rows, n = [], 0
    base = [rng.choices(vocabulary, k=rng.choice([3, 20, 60, 200])) for _ in range(25)]
    for words in base:
        for _ in range(rng.choice([1, 2, 12])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\t", " \n"]).join(w) if rng.random() < 0.9 else " ".join(w).lower(), None, 1))
            n += 1
    chain = rng.choices(vocabulary, k=120)  # each link is near, the ends are not
    for i in range(12):
        chain = chain[3:] + rng.choices(vocabulary, k=3)
        rows.append((n + i, " ".join(chain), "x", 1))
    n += 12
    rows += [(n + i, "the same words again and again", None, None) for i in range(30)]
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, " \n\t", None, None), (2003, "one two", None, None), (2004, "ONE  two", None, None), (2005, "two one", None, None)]
    rows += [(2006, "a long text " * 5000, None, None), (0, rows[0][1], None, None), (None, "nobody knows me at all", None, None), (None, "the same words again and again", None, None)]
    return rows


def brute(rows, words):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[max(find(d), find(e))] = min(find(d), find(e))
    out = []
    for d, s in sets:
        c = find(d) if d is not None else min((find(e) for e, t in sets if e is not None and t == s and s), default=None)
        out.append((d, len(s), c, d == c and d is not None))
    return sorted(out, key=str)


@pytest.mark.parametrize("words,postings", [(4, 256), (5, 2)])
def test_components_against_all_pairs(spark, words, postings):
    rows = data(words)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=words, postings=postings, block=postings + 1).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, words)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_band_around_the_bound_of_a_large_group(spark, seed):
    """Many texts just below 80 % of a large component; some of them reach single members by their extra shingles, or by being shorter."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5_000)]
    base = rng.choices(vocabulary, k=200)

    def edit(words, k, cut=0):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return w[cut:]

    group = [edit(base, rng.choice([0, 1, 2, 3])) for _ in range(80)]
    group += [edit(base, 1, rng.choice([5, 15, 25])) for _ in range(10)]
    variant = edit(base, 4)
    group += [edit(variant, 1) for _ in range(10)]
    band = [edit(base, k) for k in (5, 6, 7, 8, 9) for _ in range(8)] + [edit(variant, k) for k in (3, 4, 5, 6) for _ in range(6)]
    band += [edit(base, 3, rng.choice([20, 30, 36])) for _ in range(8)] + [edit(base, 4) + rng.choices(vocabulary, k=rng.choice([20, 40])) for _ in range(8)]
    texts = [" ".join(w) for w in group + band]
    rng.shuffle(texts)
    rows = [(i, t, None, 1) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), words=4, postings=4, block=16).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4)
    assert 3 < len({r["component_id"] for r in got}) < len(rows) - 50


def test_sets_of_a_slice_are_those_of_the_rows():
    texts = pa.array([f"Word{i} ÉTÉ x{i} b c d{i % 3}" for i in range(900)])
    whole = minhash.shingle_sets(texts, 4)
    part = minhash.shingle_sets(texts.slice(500, 200), 4)
    assert all((a == b).all() for a, b in zip(whole[500:700], part, strict=True))
    assert minhash.signatures(whole)[:, 0].tolist() == [int(x) for s in whole for x in [minhash.signatures([s])[0, 0]]]


def test_empty_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = minhash.near_duplicates(spark.createDataFrame([(1, None, None, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_star_rounds_find_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (102, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100, 103: 100}
