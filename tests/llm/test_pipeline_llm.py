"""The pipeline against a plain version of what its stages decide."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from camtrail.llm import lines, mixing, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = {"en": "the cat and dog with house under green tree of stone water".split(), "de": "der hund und die katze mit haus unter grünem baum aus stein".split()}
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        body = "\n".join(" ".join(rng.choices(words[lang], k=12)) + f" n{i}x{j}" for j in range(rng.randint(2, 6)))
        rows.append([i, ("cookies accepted here\n" if i % 3 == 0 else "") + body, lang, f"s{i % 4}", 0])
    rows += [[300 + i, rows[5][1], "de", "s1", 0] for i in range(20)]
    rows += [[330, rows[7][1] + " extra", "de", "s2", 0]]
    rows += [[400, None, "en", "s0", 0], [401, "", "en", "s0", 0], [402, "123 456", "de", "s0", 0], [None, "the cat and the dog without a number at all", "en", None, 0]]
    rows += [[12, "a text of its own under an id that another row has " + "and so on " * 3, "en", "s0", 0]]
    say = lambda: " ".join(rng.choices(words["en"], k=12)) + f" {rng.random()}"
    page = [say() for _ in range(40)]
    rows += [[600 + k, "\n".join([*page[:k], say(), *page[k + 1 :]]), "en", "s3", 0] for k in range(30)]
    return [tuple(r[:4] + [len(r[1] or "")]) for r in rows] + [tuple(rows[9][:4] + [len(rows[9][1])])]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """A name per row that its near-duplicates share, and whether it has shingles."""
    sets = [shingles(r[1]) for r in rows]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = component[i], component[j]
                component = [new if c == old else c for c in component]
    return [c if s else ("alone", r[0]) for c, r, s in zip(component, rows, sets, strict=True)]


def test_run_against_a_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    # A near-duplicate component is one page of its source.
    named = list(zip(kept, components(kept), strict=True))
    totals = Counter(source for source, _ in {(r[3], c) for r, c in named})
    pages = Counter((source, x) for source, _, x in {(r[3], c, x) for r, c in named for x in r[1].split("\n") if x})
    bad = {k for k, n in pages.items() if n >= lines.MIN_PAGES and n > lines.RATIO * totals[k[0]]}
    kept = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x) not in bad), r[3]) for r in kept]

    texts = {}
    for r in kept:
        texts.setdefault(r[0], set()).add(r[1])
    best = {}
    for c, r in zip(components(kept), kept, strict=True):
        rank = (r[0] is not None and len(texts[r[0]]) > 1, r[0] is not None, r[0])
        if c not in best or rank < best[c][0]:
            best[c] = (rank, r)
    kept = [r for _, r in best.values()]
    assert {r[1] for r in kept if r[0] == 12} == {r[1] for r in rows if r[0] == 12 and "its own" in r[1]} | {r[1] for r in kept if r[0] == 12 and "its own" not in r[1]}
    assert [r for r in kept if r[0] and r[0] >= 600] == [(600, rows[[r[0] for r in rows].index(600)][1], "s3")]

    plan = mixing.plan_mix(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()
    whole = tokens.Encoder(tokens.vocabulary()).whole
    want = Counter()
    for r in plan:
        ids = np.append(whole([r["text"]])[0], np.uint32(0)).astype("<u4")
        assert len(ids) <= 2048
        if r["copies"]:
            want[(r["doc_id"], 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += r["copies"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_stages_keep_the_columns_and_survive_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "pack":
            assert out.columns == docs.columns
            docs = out


def test_a_text_with_many_copies_keeps_its_lines(spark, tmp_path):
    rng = random.Random(4)
    words = "the cat and dog with house under green tree of stone water".split()
    say = lambda i: "\n".join(" ".join(rng.choices(words, k=12)) + f" n{i}x{j}" for j in range(4))
    body = say(0)
    rows = [(i, body, "en", "s", len(body)) for i in range(30)] + [(100 + i, "cookies accepted here\n" + say(100 + i), "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert all(out[i] == body for i in range(30))
    assert all(out[i] == text.split("\n", 1)[1] for i, text, *_ in rows[30:])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["doc_id"] < 30]
    ids = np.append(tokens.Encoder(tokens.vocabulary()).whole([body])[0], np.uint32(0)).astype("<u4")
    assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in got} == {(0, len(ids), zlib.crc32(ids.tobytes()))}


def test_documents_stay_where_no_language_is_known(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(["the cat and the dog", "", None, "12 34", "der hund"])], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [0, 4]
    one = spark.createDataFrame([(i, "the cat and the dog", "en", "s", 0) for i in range(6)], SCHEMA)
    assert corpus_pipeline.language(spark, one, "").count() == 6


def test_an_id_with_two_texts_is_two_documents(spark):
    a, b = "one two three four five six seven eight", "another text with quite other words in it"
    docs = spark.createDataFrame([(1, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0), (5, b, "en", "s", 0)], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [(1, a), (5, b)]


def test_language_margin_does_not_depend_on_the_number_of_languages(spark):
    rng = random.Random(1)
    rows = []
    for k in range(12):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[k : k + 14], k=5)) for _ in range(40)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=60)), f"l{k:02}", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert corpus_pipeline.language(spark, docs, "").count() == len(rows)
