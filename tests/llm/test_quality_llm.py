"""Counts against plain Python, Viterbi and the likelihood against all paths, and held-out labels."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from camtrail.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, kept string, row int"


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    bits = ["a", "b", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "é", "中", "##", "|", "A", "1", "\r\n", " a b ", "\n\n"]
    out = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(400)]
    return [*out, None, "", "\n", " ", "x", "a b c a b c", "word " * 120_000, "\n".join(["same line here"] * 300)]


def test_counts_are_exact():
    cases = [t or "" for t in texts()]
    slab = quality.count(pa.array(cases, pa.large_string()))
    got = list(zip(*[slab.per_text(x).tolist() for x in (slab.words, slab.chars, slab.symbols, slab.copied, slab.repeated)], strict=True))
    assert got == [plain_counts(t) for t in cases]


def score(field, x, path):
    own = x @ field.weights
    total = field.start * path[0] + sum(own[k] for k, s in enumerate(path) if s)
    return total + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))


def test_path_and_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        field = quality.Field(rng.normal(size=3), float(rng.normal()), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 3))
        paths = list(itertools.product((0, 1), repeat=n))
        scores = np.array([score(field, x, p) for p in paths])
        assert tuple(field.path(x)) == paths[int(scores.argmax())]
        own = np.zeros((1, n + 2, 2))
        own[0, :n, 1] = x @ field.weights
        own[0, 0, 1] += field.start
        each, pairs = quality._marginals(own, field.moves, np.array([n]))
        chance = np.exp(scores - np.logaddexp.reduce(scores))
        assert np.allclose(each[0, :n, 1], [sum(c for c, p in zip(chance, paths, strict=True) if p[k]) for k in range(n)])
        want = [[sum(c * sum(q == (i, j) for q in zip(p, p[1:], strict=False)) for c, p in zip(chance, paths, strict=True)) for j in range(2)] for i in range(2)]
        assert np.allclose(pairs, want) and not each[0, n:].any()


def test_rules_labels_and_odd_rows(spark):
    rng = random.Random(6)
    words = "the cat and dog with house under green tree of stone water river".split()

    def page(i, junk):
        lines = [" ".join(rng.choices(words, k=12)) + f" n{i}x{k}." for k in range(8)]
        return "\n".join([lines[0], *(re.sub(" ", "## ", x) + " | $$" for x in lines[1:])] if junk else lines)

    rows = [(i, page(i, i % 4 == 0), "mine", i) for i in range(200)]
    rows += [(900, None, "mine", 1), (901, "", "mine", 1), (902, "few words only", "mine", 1), (903, "again and again " * 40, "mine", 1), (None, page(999, False), None, None), (1, rows[1][1], "mine", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(100)] + [(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    field = quality.fit(docs, labels, per_label=20)
    got = quality.judge(docs, field).collect()
    assert len(got) == len(rows) and {r["row"]["kept"] for r in got} == {"mine", None}
    for r in got:
        i, text = r["row"]["doc_id"], r["row"]["text"]
        counts = plain_counts(text)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        if i is None or i < 900:
            assert r["kept"] == (i is None or i % 4 != 0)
            assert r["line_states"] == ("c" * 8 if r["kept"] else "c" + "b" * 7)
        else:
            assert not r["kept"]
    assert quality.judge(docs.limit(0), field).count() == 0
    assert quality.fit(docs, labels.filter("quality = 1")) is None and quality.fit(docs.limit(0), labels) is None
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(docs, None).collect())
