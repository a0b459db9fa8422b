"""Line de-duplication and mixing on awkward rows, against plain loops."""

import math
import re
from collections import Counter, defaultdict

from camtrail.llm import lines, mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, target string"


def rows():
    out = [(i, f"menu\nown line {i}\n\nfoot", "a", 9, "keep", None) for i in range(30)]
    out += [(i, f"menu\nalone {i}", "b", 9, None, None) for i in range(30, 33)]
    out += [(100, None, "a", None, None, None), (101, "", None, 0, None, None), (102, "menu\nmenu\n" + "long " * 50_000, None, 1, None, None)]
    out += [(103, "menu", "a", 4, None, None), (None, "menu\nkept", "a", 9, None, None), (0, "menu\nown line 0\n\nfoot", "a", 9, "keep", None)]
    return out


def test_line_dedup_against_a_loop(spark):
    data = rows()
    got = lines.drop_boilerplate(spark.createDataFrame(data, SCHEMA), ratio=0.5, min_pages=5).collect()
    pages, totals = Counter(), Counter(r[2] for r in data)
    for r in data:
        pages.update({(r[2], x) for x in (r[1] or "").split("\n") if x})
    bad = {k for k, n in pages.items() if n >= 5 and n > 0.5 * totals[k[0]]}
    assert bad == {("a", "menu"), ("a", "foot")}
    want = Counter()
    for r in data:
        split = [] if r[1] is None else r[1].split("\n")
        kept = [x for x in split if (r[2], x) not in bad]
        want[(r[0], None if r[1] is None else "\n".join(kept), len(split), len(split) - len(kept))] += 1
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == want
    assert all(r["size"] == "keep" for r in got if r["doc_id"] == 0)
    assert lines.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def level(sizes, weights, total, cap=2.0):
    """Targets by sharing again and again what is above a cap."""
    got, open_ = {k: 0.0 for k in sizes}, set(sizes)
    while open_:
        rest = total - sum(v for k, v in got.items() if k not in open_)
        unit = rest / sum(weights[k] for k in open_)
        over = {k for k in open_ if unit * weights[k] > cap * sizes[k]}
        for k in over or open_:
            got[k] = cap * sizes[k] if over else unit * weights[k]
        open_ = open_ - over if over else set()
    return got


def test_mixing_against_a_loop(spark):
    data = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None, 1, "mine", "my target") for i in range(4000)]
    data += [(9000, None, "s0", 1, None, None), (9001, "", "empty", 1, None, None), (None, "no id", "s1", 1, None, None), (7, "w " * 8, "s2", 1, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.plan_mix(df).collect()
    sizes = defaultdict(int)
    for r in data:
        sizes[r[2]] += len(re.findall(r"\S+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    assert len(got) == len(data)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.1 * t + 8
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["copies"] for r in got) and {r["target"] for r in mixed.select("target").distinct().collect()} <= {"my target", None}
    again = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.plan_mix(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["text"]): r["copies"] for r in got}
    assert mixing.plan_mix(df.limit(0)).count() == 0 and mixing.mix_sources(df.limit(0)).count() == 0
