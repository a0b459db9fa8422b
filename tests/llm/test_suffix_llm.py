"""Repeated passages against a plain dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from camtrail.llm import suffix

SCHEMA = "doc_id long, text string, kept string, a long, t long"


def data(seed=1):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    shared = [say(n) for n in (99, 100, 101, 160, 400)]
    rows = []
    for i in range(60):
        parts = [say(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.choice([0, 0, 3, 50]) :], say(rng.randint(0, 120))]
        rows.append((i, "".join(parts), None, 1, 2))
    edited = list(rows[7][1] + say(500))
    for k in range(0, len(edited), 170):
        edited[k] = "Z"
    rows += [(70, "".join(edited), "x", None, None), (71, rows[7][1] + "tail", None, None, None), (72, shared[4] * 3, None, 1, 1)]
    rows += [(80 + i, rows[3][1] or "x", None, 1, 1) for i in range(5)] + [(90, "a" * 1000, None, 1, 1), (91, "ab" * 700, None, 1, 1), (92, "a" * 150, None, 1, 1)]
    rows += [(100, None, None, 1, 1), (101, "", None, 1, 1), (102, "short", None, 1, 1), (103, "short", None, 1, 1), (2, rows[2][1], None, 1, 1), (None, shared[3], None, 1, 1)]
    return rows


def brute(rows):
    out, seen, done = Counter(), set(), {}
    order = sorted({(r[0] is None, r[0] or 0, (r[1] or "").encode()) for r in rows})
    for none, d, b in order:
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s : s + 100] = True
            seen.add(w)
        spans = int((np.diff(np.append(0, cover.astype(int))) == 1).sum())
        done[none, d, b] = (len(b), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest())
    for r in rows:
        out[(r[0], *done[r[0] is None, r[0] or 0, (r[1] or "").encode()])] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"crowded": 2, "bucket_bytes": 5000, "merge_bytes": 4000, "shards": 3}])
def test_against_all_windows(spark, options):
    rows = data()
    got = suffix.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == brute(rows)
    assert suffix.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 4])
def test_merged_transforms_find_the_windows(shards):
    rng = np.random.default_rng(shards)
    base = bytes(rng.integers(97, 101, 300, dtype=np.uint8))
    strings = [base[a : a + 150] for a in rng.integers(0, 150, 12).tolist()] + [b"a" * 130, bytes(rng.integers(0, 256, 140, dtype=np.uint8))]
    string, place, group = suffix.repeated_windows(strings, 100, shards)
    got = {}
    for s, p, g in zip(string.tolist(), place.tolist(), group.tolist(), strict=True):
        got.setdefault(g, set()).add((s, p))
    want = {}
    for s, x in enumerate(strings):
        for p in range(len(x) - 99):
            want.setdefault(x[p : p + 100], set()).add((s, p))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 300)
    monkeypatch.setattr(suffix, "BATCH", 900)
    rows = data(3)
    held = [p for b in spark.createDataFrame(rows, SCHEMA).selectExpr("cast(text as binary) text").toArrow().to_batches() for x in suffix._pieces(b) for p in x]
    assert max(len(p) for *_, p in held) <= 300 + 99


def test_contents_that_agree_in_32_bits_of_their_hash_are_different(spark):
    """Two real texts under one anchor (the phrase) whose content hashes share the lower 32 bits."""
    say = lambda i: "skwbxoxh ygnjxdwhifikvxeb jzynoh" + "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz ", k=68))
    texts = [say(140_233), say(186_023)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    found = suffix.snippets(raw, np.array([0, 100, 200]))
    h, c = found[4], found[5]
    assert h[0] == h[1] and c[0].astype("<u4") == c[1].astype("<u4") and c[0] != c[1]
    rows = [(i, x, None, 1, 1) for i, x in enumerate(texts)]
    assert [r["n_removed"] for r in suffix.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()] == [0, 0]


def test_a_crowded_anchor_is_not_gathered(spark, monkeypatch):
    """300 contexts of one phrase, some of them twice: dealt over all buckets, and no merge of transforms gets them."""
    phrase = "skwbxoxh ygnjxdwhifikvxeb jzynoh"
    say = lambda i, n: "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    rows = [(i, say(i, 80) + phrase + say(1000 + i % 250, 90), None, 1, 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = docs.selectExpr("doc_id a", "0L t", "cast(text as binary) text")
    apart = suffix._crowded_anchors(texts, 64)
    filed = [b for b in suffix._file_anchors(16, apart)(texts.toArrow().to_batches())]
    held = [(k, np.frombuffer(x, "<u4", 1)[0]) for b in filed for k, x in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True) if x]
    total = sum(int(n) for _, n in held)
    assert len(apart) and max(sum(int(n) for k, n in held if k == j) for j in range(16)) < total / 4
    got = suffix.drop_repeats(docs, crowded=64, bucket_bytes=5000).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == brute(rows)


def test_a_merge_takes_no_more_than_a_crowded_anchor():
    assert suffix.CROWDED * (2 * suffix.LENGTH - suffix.ANCHOR) <= 2 * suffix.MERGE_BYTES
