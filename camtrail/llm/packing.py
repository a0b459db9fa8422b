"""Packing documents into fixed-size token sequences by patterns of few lengths, fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from camtrail.llm import tokens
from camtrail.scale import cut_lineage

LENGTH = 2048
END = 0
# Most documents in a pattern, and the tokens it may leave empty.
ARITY = 4
WASTE = 2
ROUNDS = 400
WINDOW_ROWS = 20_000
PIECE = "piece int, start long, length long, ids_crc32 long"


def patterns(lengths: list[int], size: int, arity: int = ARITY, waste: int = WASTE, tries: int = 6) -> list[tuple[int, ...]]:
    """Patterns (descending lengths) of at most ``arity`` documents that leave at most ``waste`` tokens of ``size`` empty.

    For each largest length the last document is the best fit for what the others leave; the ones between are spread over the lengths.
    """
    have, found = sorted(lengths), set()

    def close(head: tuple[int, ...], rest: int) -> None:
        at = bisect_right(have, min(rest, head[-1])) - 1
        if at >= 0 and rest - have[at] <= waste:
            found.add((*head, have[at]))

    for a in have:
        if size - a <= waste:
            found.add((a,))
            continue
        close((a,), size - a)
        heads = [(a,)]
        for _ in range(arity - 2):
            longer = []
            for head in heads:
                rest = size - sum(head)
                top = bisect_right(have, min(rest, head[-1]))
                for j in sorted({int(x) for x in np.linspace(0, top - 1, tries)} if top else ()):
                    longer.append((*head, have[j]))
                    close(longer[-1], rest - have[j])
            heads = longer
    return sorted(found, reverse=True)


def fit(histogram: dict[int, int], chosen: list[tuple[int, ...]], rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram: accelerated projected gradient on |Ax - h|^2."""
    lengths = sorted(histogram)
    row = {v: i for i, v in enumerate(lengths)}
    width = max(map(len, chosen))
    index = np.array([[row[v] for v in p] + [len(lengths)] * (width - len(p)) for p in chosen])
    h = np.array([histogram[v] for v in lengths], float)

    def apply(x):
        return np.bincount(index.ravel(), np.repeat(x, width), len(lengths) + 1)[:-1]

    def back(r):
        return np.append(r, 0.0)[index].sum(1)

    v = np.ones(len(chosen))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(apply(v))
        top = np.linalg.norm(v)
        v = v / top
    x = y = np.zeros(len(chosen))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(apply(y) - h) / (top * 1.05))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (contents, number of sequences). Equal sequences are kept as one entry with a count."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [contents, count]
    rooms: list[int] = []

    def put(room: int, contents: tuple[int, ...], count: int) -> None:
        if not open_[room]:
            at = bisect_right(rooms, room)
            if not at or rooms[at - 1] != room:
                rooms.insert(at, room)
        open_[room].append([contents, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_right(rooms, length - 1)
            while at < len(rooms) and not open_[rooms[at]]:
                rooms.pop(at)
            if at == len(rooms):
                per = size // length
                if left >= per:
                    put(size - per * length, (length,) * per, left // per)
                    left %= per
                if left:
                    put(size - left * length, (length,) * left, 1)
                    left = 0
                break
            room = rooms[at]
            contents, count = open_[room].pop()
            per = min(room // length, left)
            n = min(count, left // per)
            if count > n:
                open_[room].append([contents, count - n])
            put(room - per * length, contents + (length,) * per, n)
            left -= n * per
    return [(tuple(c), n) for groups in open_.values() for c, n in groups if n]


def plan(histogram: dict[int, int], size: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(contents, number of sequences) that use up the histogram exactly: fitted patterns rounded, then best fit for the residue."""
    left, out = Counter(histogram), []
    chosen = patterns([v for v, n in histogram.items() if n], size)
    if chosen:
        x = fit(histogram, chosen)
        for i in np.argsort(-x, kind="stable").tolist():
            n = int(round(x[i]))
            if n <= 0:
                break
            uses = Counter(chosen[i])
            n = min(n, *(left[v] // k for v, k in uses.items()))
            if n > 0:
                out.append((chosen[i], n))
                for v, k in uses.items():
                    left[v] -= k * n
    return out + best_fit({v: n for v, n in left.items() if n}, size)


def placement(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, per, sequence, offset): pieces of ``length`` numbered first..last go ``per`` to a sequence from ``sequence`` on."""
    used, sequence, out = Counter(), 0, []
    for contents, count in planned:
        at = 0
        for length, per in sorted(Counter(contents).items(), reverse=True):
            first = used[length]
            used[length] += per * count
            out.append((length, first, used[length] - 1, per, sequence, at))
            at += per * length
        sequence += count
    return out


def _cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first piece of a longer one may be shorter than ``size``."""
    first = n - size * (-(-n // size) - 1)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def tokenized_pieces(docs: DataFrame, doc_id: str, text: str, vocabulary: str, size: int, end: int, cached: int = tokens.CACHED) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(frames):
        encoder = tokens.encoder(vocabulary, cached)
        for b in frames:
            rows, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(encoder.encode(b.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for i, (at, n) in enumerate(_cuts(len(ids), size)):
                    rows.append(r), piece.append(i), start.append(at), length.append(n), crc.append(zlib.crc32(ids[at : at + n]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        tokens.release()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, {PIECE}")


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = tokens.BYTE_BPE, size: int = LENGTH, end: int = END,
    cached: int = tokens.CACHED,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's ids and ``end`` in as few sequences of ``size`` as fitted patterns need.

    Whole texts are tokenized once; what follows works on one narrow row per piece and on the histogram of lengths, ``size`` numbers whatever the
    input. The plan is made from the histogram: patterns of up to 4 lengths that fill a sequence, their repeat counts by non-negative least squares, rounded,
    and best-fit decreasing for the rest. Pieces of one length are interchangeable: they are numbered in windows of bounded size, offset by a table of counts, and the plan (at most a few rows per pattern) is
    broadcast to place them by number. A length that most documents share is spread over many windows.

    A null text is an empty one: one piece of the end id alone. Documents longer than ``size`` are cut into full pieces, the first of which may be shorter; no
    others are cut. Repeated rows are packed each. An empty table gives no rows. Other columns do not matter.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(tokenized_pieces(docs, doc_id, text, vocabulary, size, end, cached))
    parts = -(-pieces.count() // WINDOW_ROWS) or 1
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut_lineage(counts.select("length", "_part", "_n", F.coalesce(before, F.lit(0)).alias("_before")))
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = spark.createDataFrame(placement(plan(histogram, size)), "length long, _first long, _last long, _per int, _sequence long, _offset long")
    number = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    at = pieces.withColumn("_at", number).join(offsets.drop("_n"), ["length", "_part"]).withColumn("_at", F.col("_at") + F.col("_before"))
    placed = at.join(F.broadcast(table), (at["length"] == table["length"]) & at["_at"].between(table["_first"], table["_last"])).drop(table["length"])
    nth = F.col("_at") - F.col("_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )
