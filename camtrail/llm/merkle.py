"""Merkle manifest of a dataset: every row a leaf, one tree per source, one tree over the sources, and each leaf's way to the root.

Leaves of a source are cut into aligned blocks of SPAN. A task appends the leaves of one block in order; subtrees that wait for siblings hold a partial
witness, and each sibling that is completed later extends it. The roots of the blocks are then appended in the same manner, so no source,
however large, passes through one task, and a tree of 10^13 leaves takes four rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from camtrail.scale import broadcast_if_small, cut_lineage

ARITY = 3
# Leaves of a block; a power of ARITY, so that a full block is a subtree of the whole tree.
SPAN = ARITY**7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows of the upper levels (about 1 KB each) that may be broadcast.
UPPER_ROWS = 20_000


def digest(*parts: str) -> str:
    """Lower-case hex SHA-256 of the parts in one piece."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class Appender:
    """Appends to a tree whose runs hold ARITY nodes.

    ``witness[i]`` is the list of steps of leaf i from the bottom; a step is the [digests before, digests after] of the subtree the leaf is in, shared by all
    leaves of that subtree. The second part of a step grows while the run of its subtree is open.
    """

    def __init__(self) -> None:
        self.open: list[list[tuple[str, int, list[str]]]] = []
        self.witness: list[list[list[str]]] = []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        self._complete(0, leaf, len(self.witness) - 1)

    def _complete(self, level: int, name: str, first: int) -> None:
        """A subtree over the leaves from ``first`` on is complete: it extends its open siblings, and a full run completes its parent."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        step = ["".join(d for d, _, _ in run), ""]
        for _, _, open_step in run:
            open_step[1] += name
        for steps in self.witness[first:]:
            steps.append(step)
        run.append((name, first, step))
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._complete(level + 1, digest(*[d for d, _, _ in run]), run[0][1])

    def finish(self, levels: int) -> str:
        """Close open runs up to ``levels``, cut every witness there and return the root."""
        for level in range(levels):
            if self.open[level]:
                self._close(level)
        self.witness = [steps[:levels] for steps in self.witness]
        return self.open[levels][0][0]


def fold(leaf: str, steps: Iterable[Sequence[str]]) -> str:
    """Root that a leaf and its witness give."""
    for before, after in steps:
        leaf = digest(before, leaf, after)
    return leaf


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as byte count, colon and value, a null as a dash."""
    text = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*text).cast("binary"), 256)


def _ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place in its tree from 0, and ``n``, the size of the tree. Ranges of (tree, order) are numbered apart and moved by the sizes of earlier ranges."""
    parts = cut_lineage(rows.repartitionByRange("tree", *order).withColumn("_range", F.spark_partition_id()))
    tree = W.partitionBy("tree")
    sizes = parts.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(tree.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("tree", "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(tree).alias("n"))
    inside = F.row_number().over(W.partitionBy("tree", "_range").orderBy(*order))
    out = parts.withColumn("_inside", inside - 1).join(broadcast_if_small(sizes), ["tree", "_range"])
    return out.withColumn("pos", F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def _raise(nodes: DataFrame, span: int) -> DataFrame:
    """One round: the nodes with their block, their witness inside it (before, after) and, in the first row of a block, its root as ``up``."""

    def append(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = Appender()
        for name in rows["name"]:
            tree.append(name)
        n = int(rows["n"].iloc[0])
        root = tree.finish(height(span) if n > span else height(n))
        return rows.assign(
            before=[[b for b, _ in steps] for steps in tree.witness],
            after=[[a for _, a in steps] for steps in tree.witness],
            up=[root, *[None] * (len(rows) - 1)],
        )

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / span))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return cut_lineage(blocks.groupBy("tree", "block").applyInPandas(append, f"{schema}, before array<string>, after array<string>, up string"))


def _grow(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes (tree, pos, n, name, ...) with ``root`` of their tree and their whole witness as ``before`` and ``after``."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [_raise(nodes, span)]
    while largest > span:
        largest = -(-largest // span)
        above = rounds[-1].filter("up is not null").select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("up").alias("name"))
        rounds.append(_raise(above, span))
    top = rounds[-1].filter("up is not null").select("tree", F.col("up").alias("root"))
    for k in range(len(rounds) - 1, 0, -1):
        upper = rounds[k] if k == len(rounds) - 1 else joined
        joined = rounds[k - 1].join(
            broadcast_if_small(upper.select("tree", F.col("pos").alias("block"), F.col("before").alias("_b"), F.col("after").alias("_a")), UPPER_ROWS),
            ["tree", "block"],
        )
        joined = joined.withColumns({"before": F.concat("before", "_b"), "after": F.concat("after", "_a")}).drop("_b", "_a")
    rows = joined if len(rounds) > 1 else rounds[0]
    return rows.join(broadcast_if_small(top, UPPER_ROWS), "tree").drop("block", "up")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "source", key: str = "doc_id", span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: key, tree, leaf, subroot, root and the witness as ``before`` and ``after`` (array<string>, one entry per level).

    A leaf is the digest of ``fields``; other columns play no part, whatever their names. Leaves of a tree ascend by key, nulls first, and rows that repeat a key by
    leaf; equal rows have equal leaves and places of their own. A null tree value is a tree of its own and comes first. An empty table gives no row.
    """
    names = F.when(F.col(tree).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    leaves = docs.select(names.alias("tree"), F.col(key).alias("key"), leaf_digest(*[F.col(c) for c in fields]).alias("name"))
    return _manifest(leaves, span)


def _manifest(leaves: DataFrame, span: int) -> DataFrame:
    """``leaves``: (tree, key, name, ...). '-' sorts before '=', so a null source is first and the others keep their byte order."""
    lower = _grow(_ranked(cut_lineage(leaves), [F.col("key").asc_nulls_first(), F.col("name")]), span)
    lower = lower.drop("pos", "n")
    subroots = lower.select("tree", "root").distinct().select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("name"))
    upper = _grow(_ranked(subroots, [F.col("of")]), span)
    upper = upper.select(F.col("of").alias("tree"), F.col("root").alias("_root"), F.col("before").alias("_b"), F.col("after").alias("_a"))
    out = lower.join(broadcast_if_small(upper, UPPER_ROWS), "tree").withColumnsRenamed({"root": "subroot", "_root": "root", "name": "leaf"})
    return out.withColumns({"before": F.concat("before", "_b"), "after": F.concat("after", "_a")}).drop("_b", "_a")


def proof(before: Column | str = "before", after: Column | str = "after") -> Column:
    """Digest of all siblings of a witness, level by level, left to right."""
    before, after = (F.col(c) if isinstance(c, str) else c for c in (before, after))
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "").cast("binary"), 256)


def folded(leaf: Column, before: Column | str = "before", after: Column | str = "after") -> Column:
    """Root that a leaf and its witness give."""
    before, after = (F.col(c) if isinstance(c, str) else c for c in (before, after))
    steps = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["b"], acc, s["a"]).cast("binary"), 256))


def verify(docs: DataFrame, changed: dict[str, Column], when: Column, span: int = SPAN) -> DataFrame:
    """The manifest of documents, and for each what its witness says of a copy with the columns ``changed`` where ``when`` is true.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified. Where ``when`` is null, so for a null doc_id, nothing is changed.
    """
    source = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source")))
    leaf = leaf_digest(*[F.col(c) for c in FIELDS])
    other = leaf_digest(*[changed.get(c, F.col(c)) for c in FIELDS])
    leaves = docs.select(source.alias("tree"), F.col("doc_id").alias("key"), leaf.alias("name"), F.when(when, other).otherwise(leaf).alias("copy"))
    out = _manifest(leaves, span).withColumn("folded_root", folded(F.col("copy")))
    return out.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def newlines_dropped(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Verify copies without the newlines of their text, where 2 divides the CRC-32 of the decimal doc_id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verify(docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, even, span)


def oracle() -> str:
    """The same by recursion over levels; CRC-32 is computed bit by bit, as SQL has no function for it."""
    bits = "list_reduce([crc] || range(8), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    plain = " || ".join(field(c) for c in FIELDS)
    cut = plain.replace("text", "cut")
    return f"""
    WITH RECURSIVE docs AS (SELECT *, replace(text, chr(10), '') cut FROM documents),
    chars AS (SELECT doc_id, doc_id::VARCHAR s FROM documents),
    crc(doc_id, s, crc) AS (
        SELECT doc_id, s, 4294967295::BIGINT FROM chars
        UNION ALL
        SELECT doc_id, substr(s, 2), {bits.replace('[crc]', '[xor(crc, ascii(s)::BIGINT)]')}
        FROM crc WHERE s <> ''),
    even AS (SELECT doc_id, (xor(crc, 4294967295) % 2) = 0 is_even FROM crc WHERE s = ''),
    leaves AS (SELECT d.doc_id, source, sha256({plain}) leaf, sha256(CASE WHEN e.is_even THEN {cut} ELSE {plain} END) copy,
                      row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 pos, count(*) OVER (PARTITION BY source) n
               FROM docs d JOIN even e USING (doc_id)),
    low(source, lvl, pos, name, n) AS (
        SELECT source, 0, pos, leaf, n FROM leaves
        UNION ALL
        SELECT source, any_value(lvl) + 1, pos // 3, sha256(string_agg(name, '' ORDER BY pos)), (any_value(n) + 2) // 3
        FROM low WHERE n > 1 GROUP BY source, pos // 3),
    subroots AS (SELECT source, lvl depth, name subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 pos, count(*) OVER () n FROM low WHERE n = 1),
    high(lvl, pos, name, n) AS (
        SELECT 0, pos, subroot, n FROM subroots
        UNION ALL
        SELECT any_value(lvl) + 1, pos // 3, sha256(string_agg(name, '' ORDER BY pos)), (any_value(n) + 2) // 3
        FROM high WHERE n > 1 GROUP BY pos // 3),
    top AS (SELECT name root, lvl depth FROM high WHERE n = 1),
    ways AS (
        SELECT l.doc_id, g.i lvl, t.pos, t.name, t.pos = l.pos // (3 ** g.i)::BIGINT own
        FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(range(s.depth)) i) g
        JOIN low t ON t.source IS NOT DISTINCT FROM l.source AND t.lvl = g.i AND t.pos // 3 = l.pos // (3 ** (g.i + 1))::BIGINT
        UNION ALL
        SELECT l.doc_id, s.depth + g.i, t.pos, t.name, t.pos = s.pos // (3 ** g.i)::BIGINT
        FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, top, LATERAL (SELECT unnest(range(top.depth)) i) g
        JOIN high t ON t.lvl = g.i AND t.pos // 3 = s.pos // (3 ** (g.i + 1))::BIGINT),
    steps AS (SELECT doc_id, lvl, coalesce(string_agg(name, '' ORDER BY pos) FILTER (NOT own AND pos < mine), '') before,
                     coalesce(string_agg(name, '' ORDER BY pos) FILTER (NOT own AND pos > mine), '') after
              FROM (SELECT *, max(pos) FILTER (own) OVER (PARTITION BY doc_id, lvl) mine FROM ways) GROUP BY doc_id, lvl),
    proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY lvl)) proof_sha256, count(*) steps FROM steps GROUP BY doc_id),
    walk(doc_id, lvl, name) AS (
        SELECT doc_id, 0, copy FROM leaves
        UNION ALL
        SELECT w.doc_id, w.lvl + 1, sha256(s.before || w.name || s.after) FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.lvl = w.lvl)
    SELECT l.doc_id, l.leaf, s.subroot, top.root, coalesce(p.proof_sha256, sha256('')) proof_sha256, w.name folded_root, w.name = top.root verified
    FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN top LEFT JOIN proofs p ON p.doc_id = l.doc_id
    JOIN walk w ON w.doc_id = l.doc_id AND w.lvl = coalesce(p.steps, 0)"""
