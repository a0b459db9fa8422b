"""Near-duplicates by MinHash: an inverted join over signature coordinates, then exact confirmation on full shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType

from camtrail.llm.tokens import release
from camtrail.llm.vectors import batches
from camtrail.scale import broadcast_if_small, cut_lineage

PERCENT = 80
COORDINATES = 64
# Coordinates that must collide. A pair at the similarity of 0.8 has 51 +- 3.2 in common: fewer than 34 happen once in about three million.
MATCHES = 34
# Posting lists up to this length are joined with themselves, so pairs stay within half of it per posting; longer ones are compared in blocks.
POSTINGS = 16
BLOCK = 256
SLICE = 1 << 20
HASHED = 1 << 16

_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: A-Z lower-cased, words between ASCII white space, the whole sequence where there are fewer words."""
    import xxhash

    # A copy without an offset: ascii_lower misreads a slice of large strings.
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    code = np.array([xxhash.xxh3_64_intdigest(n) for n in names], np.uint64)
    index = coded.indices.to_numpy()
    filled = np.array([bool(n) for n in names], bool)[index] if len(names) else np.empty(0, bool)
    ends = np.append(0, np.cumsum(filled))[split.offsets.to_numpy()]
    h = code[index[filled]] if len(names) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(rolled) + k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            v = b - a
            for x in h[a:b].tolist():
                v = (v * 0x2545F4914F6CDD1D + x) & _MASK
            out.append(_mix(np.array([v], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) minima, for sets that are not empty."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    size = np.cumsum([len(s) for s in sets])
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HASHED, "right")))
        flat = np.concatenate(sets[at:end])
        starts = np.append(0, size[at : end - 1] - (size[at - 1] if at else 0))
        v = np.empty_like(flat)
        for k in range(COORDINATES):
            np.multiply(flat, _MUL[k], out=v)
            v += _ADD[k]
            out[at:end, k] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), starts)
        at = end
    return out


def _slices(frames, text: int):
    for b in batches(frames, 2048):
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy())
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
            yield b.slice(at, end - at)
            at = end
    release()


def sketch(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): set size, a 128-bit name of the set, and its signature; null names and signature for empty sets."""

    def run(frames):
        for b in _slices(frames, 1):
            sets = shingle_sets(b.column(1), words)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            sig = signatures([sets[i] for i in full]) if len(full) else np.empty((0, COORDINATES), np.uint32)
            k1, k2, blobs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for j, i in enumerate(full.tolist()):
                s = sets[i]
                k1[i] = int(np.add.reduce(_mix(s + np.uint64(1))).astype(np.int64))
                k2[i] = int(np.bitwise_xor.reduce(_mix(s + np.uint64(0x5851F42D4C957F2D))).astype(np.int64))
                blobs[i] = sig[j].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(blobs, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "sig"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def sets_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc, shingles) of the documents in ``ids`` (doc): only their texts are read into tasks again."""

    def run(frames):
        for b in _slices(frames, 1):
            sets = shingle_sets(b.column(1), words)
            offsets = pa.array(np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32))
            flat = np.concatenate(sets).astype(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc", "shingles"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.join(broadcast_if_small(ids), "doc", "left_semi").mapInArrow(run, "doc long, shingles array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) with 100 * intersection >= percent * union of their full sets."""
    ids = cut_lineage(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct())
    sets = sets_of(docs, ids, doc_id, text, words)
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for nodes of ``links`` (a, b): the smallest node reachable. Alternating large and small stars, a few rounds, on aggregates only."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut_lineage(edges), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = state


@F.pandas_udf(IntegerType())
def _collisions(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(1).astype(np.int32))


def _frequent(rows: DataFrame) -> DataFrame:
    """(key, all, most, inside) of posting lists (key, doc, component): their length, their most frequent component and its share."""
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("key").agg(F.sum("n").alias("all"), F.max_by("component", F.struct("n", "component")).alias("most"), F.max("n").alias("inside"))


def _by_core(posted: DataFrame, long: DataFrame, parts: DataFrame, sized: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents against whole components by size arithmetic: (doc, core) that are settled, and the pairs (a, b) that they leave open.

    A document of a long list is held against the list's most frequent component, and with it against the others that are. The core is the set of shingles that more than half of the
    component's members have; every text around it is the core without some shingles, and with a few extra ones. Two of them share at most the smaller of their shares of the core and their
    common extra shingles. So a link without common extra ones needs sizes small enough for those shares, and one with some needs so many of them that one is left after the most
    frequent are passed over. Both follow from full sets, so no link is lost, and a document that is near all members but linked to none costs a row per component.
    """
    rows = posted.join(broadcast_if_small(long.select("key")), "key", "left_semi")
    asked = rows.join(broadcast_if_small(_frequent(rows).select("key", "most")), "key").filter("component <> most").select("doc", F.col("most").alias("core")).distinct()
    single = sized.filter("sets = 1").select("doc", F.col("n").alias("m"))
    asked = cut_lineage(asked.join(single.withColumnRenamed("m", "d"), "doc"))
    cores = asked.select("core").distinct()
    members = parts.select(F.col("node").alias("doc"), F.col("component").alias("core")).union(cores.select(F.col("core").alias("doc"), "core")).distinct()
    members = members.join(broadcast_if_small(cores), "core", "left_semi").join(single, "doc", "left")
    members = cut_lineage(members)
    # A member that stands for several sets leaves its component to the comparison in blocks.
    odd = members.filter("m is null").select("core").distinct()
    asked, members = (x.join(broadcast_if_small(odd), "core", "left_anti") for x in (asked, members))
    ids = members.select("doc").union(asked.select("doc")).distinct()
    sets = cut_lineage(sets_of(docs, cut_lineage(ids), doc_id, text, words))

    held = members.join(sets, "doc").select("core", F.explode("shingles").alias("x"))
    size = members.groupBy("core").agg(F.count(F.lit(1)).alias("size"))
    base = held.groupBy("core", "x").agg(F.count(F.lit(1)).alias("n")).join(broadcast_if_small(size), "core").filter("2 * n > size")
    base = cut_lineage(base.select("core", "x", F.lit(1).alias("inside")))
    around = members.select("core", "doc", "m", F.lit(False).alias("ask")).union(asked.select("core", "doc", "d", F.lit(True)))
    marked = around.join(sets, "doc").select("core", "doc", "m", "ask", F.explode("shingles").alias("x")).join(base, ["core", "x"], "left")
    shares = cut_lineage(marked.groupBy("core", "doc", "m", "ask").agg(F.count("inside").alias("c")))
    extras = cut_lineage(marked.filter("inside is null").select("core", "doc", "ask", "x"))

    mine = shares.filter("ask").select("core", "doc", F.col("m").alias("d"), "c")
    fits = mine.join(broadcast_if_small(shares.select("core", "m").distinct()), "core").filter(F.expr(f"{percent} * (d + m) <= c * {100 + percent} and 100 * m >= {percent} * d")).alias("p")
    others = shares.alias("q")
    small = fits.join(others, F.expr(f"p.core = q.core and p.m = q.m and {percent} * (p.d + p.m) <= q.c * {100 + percent} and p.doc <> q.doc")).select("p.doc", F.col("q.doc").alias("o"))

    popular = extras.groupBy("core", "x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lowest = shares.groupBy("core").agg(F.min("m").alias("lowest"))
    least = F.expr(f"ceil({percent} * (d + greatest(lowest, ceil({percent} * d / 100))) / {100 + percent}) - c")
    place = F.row_number().over(W.partitionBy("core", "doc").orderBy(F.desc("n"), "x"))
    outside = extras.filter("ask").drop("ask").join(popular, ["core", "x"]).withColumn("_place", place)
    outside = outside.join(mine, ["core", "doc"]).join(broadcast_if_small(lowest), "core").filter(F.col("_place") >= least)
    several = outside.select("core", "x", "doc").join(extras.select("core", "x", F.col("doc").alias("o")), ["core", "x"]).filter("doc <> o").select("doc", "o")

    pairs = small.union(several).select(F.least("doc", "o").alias("a"), F.greatest("doc", "o").alias("b")).distinct()
    return asked.select("doc", "core"), pairs


def _in_blocks(postings: DataFrame, sizes: DataFrame, signed: DataFrame, settled: DataFrame, block: int, matches: int) -> DataFrame:
    """Pairs of different components in long posting lists: only pairs with enough collisions leave a task, each from one list.

    The documents of a list outside its most frequent component are compared, in blocks, with all documents of the list but the members of components that they are ``settled``
    (doc, core) with and the others settled with those; those inside it are joined up already. A
    pair that meets in several of these lists is reported by that of its first coordinate.
    """
    rows = postings.join(broadcast_if_small(sizes.select("key")), "key", "left_semi")
    bits = rows.groupBy("doc").agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) as int)))").alias("bits"))
    lists = _frequent(rows)
    chunks = lambda n: F.ceil(n / block).cast("int")
    lists = lists.select("key", "most", chunks(F.col("all")).alias("ns"), chunks(F.col("all") - F.col("inside")).alias("ms"))
    rows = rows.join(broadcast_if_small(lists), "key").join(bits, "doc").join(signed, "doc")
    mine = lambda n, salt: F.pmod(F.xxhash64("doc", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [F.col(c).alias(c) for c in ("key", "i", "j", "doc", "component", "bits", "sig")]  # new names, so the sides can be told apart
    skip = settled.groupBy("doc").agg(F.collect_set("core").alias("skip"))
    rows = rows.join(broadcast_if_small(skip), "doc", "left").withColumn("skip", F.coalesce("skip", F.array().cast("array<long>")))
    columns.append(F.col("skip").alias("skip"))
    few = rows.filter(F.col("component") != F.col("most")).withColumn("i", mine("ms", 1)).withColumn("j", every("ns")).select(*columns)
    all_ = rows.withColumn("j", mine("ns", 2)).withColumn("i", every("ms")).select(*columns)

    def compare(few: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(few) and len(all_):
            here = int(few["key"].iloc[0]) >> 32
            y = np.frombuffer(b"".join(all_["sig"]), "<u4").reshape(len(all_), -1)
            doc, part = all_["doc"].to_numpy(), all_["component"].to_numpy()
            bit = (all_["bits"].to_numpy()[:, None] >> np.arange(COORDINATES)) & 1 == 1
            around = {k: part == k for k in {k for x in few["skip"] for k in x}}
            for at, x in enumerate(all_["skip"]):
                for k in x:
                    if k in around:
                        around[k][at] = True
            for d, c, m, s, skip in zip(few["doc"], few["component"], few["bits"], few["sig"], few["skip"], strict=True):
                equal = y == np.frombuffer(s, "<u4")
                open_ = part != c
                for k in skip:
                    open_ &= ~around[k]
                near = np.flatnonzero((equal.sum(1) >= matches) & open_)
                if len(near):
                    both = equal[near] & bit[near] & ((int(m) >> np.arange(COORDINATES)) & 1 == 1)
                    near = near[both.argmax(1) == here]
                    out += [(min(d, o), max(d, o)) for o in doc[near].tolist()]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"])

    keys = ["key", "i", "j"]
    return few.groupBy(*keys).cogroup(all_.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = PERCENT, matches: int = MATCHES, postings: int = POSTINGS, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    1. Rows with one shingle set are one class, however many; its smallest doc_id stands for it.
    2. Classes are posted under each (coordinate, value) of their signature. Values that one class alone has are skipped, and so are
       classes left with fewer than ``matches`` values. The others keep a prefix: all but ``matches`` - 1 of their values, rarest first. Two classes with ``matches`` collisions share a value of both prefixes.
    3. Each class is tried against the smallest document of its posting lists, the one it shares most lists with; what is confirmed is joined up to components.
    4. Posting lists with more than one component left stay open. A class all of whose lists are closed, or that shares too few shingles with all the others in open lists together, can have no
       link to come and leaves: a link to a set of s shingles takes percent * (own + s) / (100 + percent) common ones.
    5. Lists that are open still are joined with themselves, long ones in blocks, for pairs of different components; pairs with
       ``matches`` collisions that were not tried yet are confirmed. In long lists, documents outside the most frequent component are held against its core of shingles
       first, which settles most of them without a pair. So a group of near copies costs a pair per member, and no link between components is passed over.

    A link needs 100 * intersection >= ``percent`` * union, confirmed on full sets of 64-bit shingle hashes. Rows without words or with a null text have no shingles
    and are components of their own. Rows that repeat a doc_id are one node. A row without an id takes part with no node: its component is its class's, or
    null where nobody in its class has an id, and it is not kept. An empty table gives no rows.
    """
    rows = cut_lineage(sketch(docs, doc_id, text, words))
    classes = rows.filter("k1 is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    classes = cut_lineage(classes.filter("doc is not null"))
    sized = classes.groupBy("doc").agg(F.max("n_shingles").alias("n"), F.min("n_shingles").alias("least"), F.count(F.lit(1)).alias("sets"))

    values = [F.conv(F.hex(F.reverse(F.substring("sig", 4 * i + 1, 4))), 16, 10).cast("long").bitwiseOR(F.lit(i << 32)) for i in range(COORDINATES)]
    posted = classes.select("doc", F.explode(F.array(*values)).alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mine = posted.join(shared, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own")).filter(F.size("own") >= matches)
    prefix = mine.select("doc", F.explode(F.slice("own", F.lit(1), F.size("own") - (matches - 1))).alias("p")).select("doc", F.col("p.key").alias("key"))
    prefix = cut_lineage(prefix)
    signed = classes.select("doc", "sig")

    hubs = prefix.groupBy("key").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    stars = prefix.join(hubs, "key").filter("doc <> hub").groupBy("doc", "hub").agg(F.count(F.lit(1)).alias("n"))
    tried = stars.groupBy("doc").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a")).select("a", F.col("doc").alias("b"))
    tried = cut_lineage(enough(tried, signed, matches))
    links = cut_lineage(confirm(tried, docs, doc_id, text, words, percent))
    parts = components(links)

    posted = prefix.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    posted = cut_lineage(posted)
    posted = cut_lineage(posted.join(_open(posted).select("key"), "key", "left_semi"))
    posted = cut_lineage(posted.join(_supported(posted, sized, docs, doc_id, text, words, percent), "doc", "left_semi"))
    open_ = cut_lineage(_open(posted))
    short = posted.join(open_.filter(F.col("size") <= postings).select("key"), "key", "left_semi")
    x, y = short.alias("x"), short.alias("y")
    pairs = x.join(y, F.expr("x.key = y.key and x.doc < y.doc and x.component <> y.component")).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    pairs = enough(pairs, signed, matches)
    long = open_.filter(F.col("size") > postings)
    if not long.isEmpty():
        settled, near = _by_core(posted, long, parts, sized, docs, doc_id, text, words, percent)
        settled = cut_lineage(settled)
        pairs = pairs.union(_in_blocks(posted, long, signed, settled, block, matches)).union(enough(near, signed, matches)).distinct()
    more = confirm(cut_lineage(pairs.join(tried, ["a", "b"], "left_anti")), docs, doc_id, text, words, percent)
    parts = components(links.union(more)).withColumnRenamed("node", "doc")

    named = classes.select("k1", "k2", "n_shingles", "doc").join(parts, "doc", "left")
    named = named.select("k1", "k2", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    out = rows.drop("sig").join(named, ["k1", "k2", "n_shingles"], "left")
    alone = F.coalesce("component_id", F.when(F.col("k1").isNull(), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.lit(False)).alias("kept"))


def _open(posted: DataFrame) -> DataFrame:
    """(key, size) of posting lists (key, doc, component) with more than one component."""
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return lists.filter("lo <> hi").select("key", "size")


def _supported(posted: DataFrame, sized: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Documents of open lists that share enough shingles with the others there for a link to the smallest set of their lists."""
    rows = posted.select("key", "doc").join(sized, "doc")
    least = rows.groupBy("key").agg(F.min("least").alias("s"))
    partner = rows.join(least, "key").groupBy("doc").agg(F.min("s").alias("s"), F.max("n").alias("n"), F.max("sets").alias("sets"))
    partner = cut_lineage(partner)
    shingles = sets_of(docs, partner.select("doc"), doc_id, text, words).select("doc", F.explode("shingles").alias("x"))
    # A shingle of one document alone; rows that repeat an id may hide one, which only keeps the document.
    alone = shingles.groupBy("x").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).filter("doc = last").groupBy("doc").agg(F.count(F.lit(1)).alias("alone"))
    need = percent * (F.col("n") + F.greatest("s", F.ceil(F.col("n") * percent / 100))) / (100 + percent)
    enough_ = F.col("n") - F.coalesce("alone", F.lit(0)) >= F.ceil(need)
    return partner.join(alone, "doc", "left").filter((F.col("sets") > 1) | enough_).select("doc")


def enough(pairs: DataFrame, signed: DataFrame, matches: int) -> DataFrame:
    """The ``pairs`` whose signatures collide ``matches`` times."""
    both = pairs.join(signed.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(signed.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    return both.filter(_collisions("sa", "sb") >= matches).select("a", "b")
