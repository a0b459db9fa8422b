"""Token ids, packing and token files against whole-text encoding."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from camtrail.llm import packing, rangecoder, tokenfile, tokens

ODD = ["a", "é", " ", " ", "\n", ".", ",", "'s", "1", "!", "\t", "ß", "字", " ", "<|endoftext|>", "The", "-", "\r\n", "don't", "…", "<|", "\x1c", "​", "word"]
SCHEMA = "doc_id long, text string, piece string, length string"


def docs():
    random.seed(4)
    texts = [" ".join(random.choices(["the", "harent", "onsh.", "erth,", "été"], k=random.randint(0, 900))) for _ in range(150)]
    rows = [(i, t, None, "x") for i, t in enumerate(texts)] + [(900 + i, "same text", "p", None) for i in range(40)]
    return rows + [(1000, None, None, None), (1001, "", None, None), (None, "no id", None, None), (3, texts[3], None, None), (1002, "long word " * 9000, None, None)]


def whole(text):
    from tokenizers import Tokenizer

    whole.t = getattr(whole, "t", None) or Tokenizer.from_file(tokens.vocabulary())
    return whole.t.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    random.seed(2)
    texts = ["".join(random.choices(ODD, k=random.randint(0, 16))) for _ in range(5000)] + [None, ""]
    for cached in (1_000_000, 50):
        got = tokens.Encoder(tokens.vocabulary(), cached).encode(pa.array(texts))
        assert all(g.tolist() == whole(t) for g, t in zip(got, texts, strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, (rng.lognormal(5.8, 1, 20_000) + 1).astype(int))
    histogram = Counter(lengths.tolist())
    planned = packing.plan(histogram, 2048)
    assert sum((Counter({v: k * n for v, k in Counter(c).items()}) for c, n in planned), Counter()) == histogram
    assert all(sum(c) <= 2048 and n > 0 for c, n in planned)
    assert sum(n for _, n in planned) <= -(-sum(lengths) // 2048) * 1.01 + 1
    assert packing.plan({}, 2048) == []


def test_packing_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_ROWS", 7)
    rows = docs()
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).toPandas()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*whole(t), 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        for p, (a, b) in enumerate([(0, first)] + [(a, a + 2048) for a in range(first, len(ids), 2048)]):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    pieces = out[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(out[["doc_id"]].notna().iloc[:, [0] * 5].values, None)
    got = Counter((None if np.isnan(float(r[0] if r[0] is not None else "nan")) else int(r[0]), *map(int, out.iloc[i, 1:5])) for i, r in enumerate(pieces.to_numpy()))
    assert got == want
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 20_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 50257, np.full(n, 7), np.tile(np.arange(50), n)[:n], rng.integers(0, 1 << 32, n, dtype=np.uint64)):
        ids = ids.astype(np.uint32)
        (back,) = rangecoder.decode([rangecoder.encode(ids)])
        assert (back == ids).all() and len(back) == n
    a, b = np.arange(5000, dtype=np.uint32), np.full(9, 3, np.uint32)
    assert [x.tolist() for x in rangecoder.decode([rangecoder.encode(x) for x in (a, b[:0], b)])] == [a.tolist(), [], b.tolist()]


def test_range_coder_compresses_and_finds_damage():
    text = "the cat and the dog went to the house and the cat went to the dog " * 400
    ids = np.array(whole(text), np.uint32)
    coded = rangecoder.encode(ids)
    assert len(coded) < len(ids) / 4
    for at in (len(coded) - 9, 40):
        broken = bytearray(coded)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            rangecoder.decode([bytes(broken)])
    with pytest.raises(ValueError):
        rangecoder.decode([b"no such file"])


def test_token_files_round_trip(spark):
    rows = docs()
    for options in ({}, {"row_ids": 3000, "range_bytes": 60_000}):
        got = tokenfile.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, start = [], 0
        for r in order:
            ids = np.array([*whole(r[1]), 2], "<u4")
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tokenfile.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
