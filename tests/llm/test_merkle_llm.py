"""The manifest against a tree that is built whole."""

import hashlib
import zlib

import pytest

from camtrail.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, before string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def ways(nodes):
    """Root and, per node, the (before, after) digests of every level."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % 3
            steps[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
            at[i] = p // 3
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = []
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        below.append(ways([x[2] for x in trees[s]]))
    root, above = ways([b[0] for b in below])
    out = []
    for s, (subroot, steps), upper in zip(names, below, above, strict=True):
        for (_, _, leaf, r), low in zip(trees[s], steps, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            name = plain_leaf(r, r[1].replace("\n", "")) if even and r[1] is not None else leaf
            for b, a in low + upper:
                name = h(b, name, a)
            out.append((r[0], leaf, subroot, root, h(*[b + a for b, a in low + upper]), name, name == root))
    return out


def table():
    rows = [(i, f"page {i}\nsecond" if i % 3 else f"page {i}", "en", "hot", i, "x", 5, "y") for i in range(0, 300, 3)]
    rows += [(i, "größer\n\nals", None, f"s{i % 5}", None, "x", 5, "y") for i in range(1000, 1023)]
    rows += [(1, None, None, None, None, None, None, None), (None, "no id\n", "de", "", 6, None, None, None), (2, "", "", "é", 0, None, None, None)]
    rows += [(3, "page 3\nlonger", "fr", "hot", 9, None, None, None), (6, "page 6", "en", "hot", 6, "x", 5, "y"), (7, "z\n" * 300_000, "en", "-", 1, None, None, None)]
    return rows


@pytest.mark.parametrize("span", [3, 9, merkle.SPAN])
def test_against_a_whole_tree(spark, span):
    rows = table()
    got = merkle.newlines_dropped(spark.createDataFrame(rows, SCHEMA).repartition(4), span).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_a_lone_leaf_is_the_root_and_an_empty_table_gives_no_row(spark):
    docs = spark.createDataFrame(table()[:1], SCHEMA)
    (row,) = merkle.newlines_dropped(docs).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("") and row["verified"]
    assert merkle.newlines_dropped(docs.limit(0)).count() == 0
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_witnesses_grow_while_siblings_are_open():
    tree = merkle.Appender()
    names = [h(str(i)) for i in range(11)]
    tree.append(names[0])
    assert tree.witness[0] == [["", ""]]
    tree.append(names[1])
    assert tree.witness[0] == [["", names[1]]] and tree.witness[1] == [[names[0], ""]]
    for name in names[2:]:
        tree.append(name)
    root = tree.finish(merkle.height(11))
    assert root == ways(names)[0]
    assert [[tuple(s) for s in steps] for steps in tree.witness] == ways(names)[1]
    assert all(merkle.fold(n, steps) == root for n, steps in zip(names, tree.witness, strict=True))


def test_a_changed_row_or_another_column_list_is_told(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = {r["key"]: (r["leaf"], r["root"]) for r in merkle.manifest(docs, ("text",)).collect()}
    b = {r["key"]: (r["leaf"], r["root"]) for r in merkle.manifest(docs.replace("t7", "t8", "text"), ("text",)).collect()}
    assert [k for k in a if a[k][0] != b[k][0]] == [7]
    assert {r for _, r in a.values()} != {r for _, r in b.values()}
