"""Alignment against plain tokenization and plain sets of offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from camtrail.llm import align, tokens

ODD = [" ", "  ", "\n", " \n", "\n ", "a", "the", "é", "中", "<|endoftext|>", "</s>", "▁", ".", ", ", "\t", "\xa0", "x", "Hello", "!!", "'s", "1234", "😀", "　", "ﬁ", "\x00", "\r\n", '"']


@pytest.fixture(scope="module")
def plain():
    left = Tokenizer.from_file(tokens.vocabulary(align.BYTE_BPE))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(align.PIECES))
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]

    def spell_a(i):
        return bytes(ord(c) if ord(c) < 256 else rest[ord(c) - 256] for c in left.id_to_token(i))

    def spell_b(i):
        piece = right.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        """[(ids of A, ids of B)] of a text."""
        if not text:
            return []
        a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
        names = [[spell_a(i) for i in a], [spell_b(i) for i in b]]
        if any(b"".join(x) != (" " + text).encode() for x in names):
            return []
        ends = [np.cumsum([len(s) for s in x]).tolist() for x in names]
        out, start = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            out.append(tuple(tuple(i for i, e in zip(ids, at, strict=True) if start < e <= end) for ids, at in zip((a, b), ends, strict=True)))
            start = end
        return out

    return groups


def told(groups):
    text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choices(ODD, k=rng.randint(0, 25))) for _ in range(600)]
    return [*out, None, "", " ", "\n", "a", "aa" * 300, "é" * 200, "abc " * 500, "▁", "the <s> cat", "中" * 90 + " a"]


def test_groups_of_odd_texts(plain):
    cases = [t or "" for t in texts()]
    got = []
    for _, _, x in align.pair().align(pa.array(cases, pa.large_string())):
        assert (align.pair().keys[align.pair().links(x)] == x.a[x.a_last].astype(np.int64) * align.pair().width + x.b[x.b_last]).all()
        got += list(zip(np.diff(x.a_docs).tolist(), np.diff(x.b_docs).tolist(), np.diff(x.groups).tolist(), align.pair().digests(x), strict=True))
    for text, row in zip(cases, got, strict=True):
        want = plain(text)
        assert row == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), told(want)), text


def test_division_finds_every_shared_cut():
    rng = np.random.default_rng(5)
    for density in (0.02, 0.3, 0.9):
        for _ in range(40):
            size = int(rng.integers(1, 400))
            sides = []
            for _ in range(2):
                ends = np.flatnonzero(rng.random(size) < density)
                sides.append(np.append(ends, size))
            a, b = sides
            bounds = [np.array([0, len(x)]) for x in sides]
            a_cut, b_cut = align.divide(a, b, *bounds)
            assert a[a_cut].tolist() == b[b_cut].tolist() == np.intersect1d(a, b).tolist()


def test_best_links_of_a_corpus(spark, plain):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(0, "Hello the", "y", 2), (None, "the cat", None, None), (None, "the cat", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, pair int").repartition(3)
    got = align.best_links(docs).collect()
    groups = [(r[0], plain(r[1] or "")) for r in rows]
    counts = Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for key, g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        best = sum(counts[x] == highest[x[1]] for x in links)
        want.append((key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), best, sum(counts[x] for x in links), told(g)))
    assert Counter(map(tuple, got)) == Counter(want)
    assert align.best_links(docs.limit(0)).count() == 0


def test_long_texts_and_byte_ends(spark, plain):
    text = "the cat and größer tiere\nof 1234 stones. " * 20_000
    docs = spark.createDataFrame([(1, text), (2, "Hello")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in align.align_documents(docs, ends=True).collect()}
    assert got[1]["group_ends"][-1] == len(text.encode()) + 1 and got[2]["group_ends"][-1] == 6
    ids = Tokenizer.from_file(tokens.vocabulary(align.BYTE_BPE)).encode(" " + text, add_special_tokens=False).ids
    assert got[1]["n_a"] == len(ids) and len(got[1]["group_ends"]) == got[1]["n_groups"]
    assert np.all(np.diff(got[1]["group_ends"]) > 0)
