"""Repeated passages: shard Burrows-Wheeler transforms merged by interleave refinement, over the places where texts can agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from camtrail.scale import broadcast_if_small, cut_lineage, free_shuffles, small

LENGTH = 100
# Bytes of an anchor. A window of LENGTH bytes is filed under the anchor with the smallest hash of the LENGTH - ANCHOR + 1 inside it.
ANCHOR = 32
# Bytes of text that a task looks at together, and the longest piece of one text.
BATCH = 4 << 20
PIECE = 4 << 20
# Bytes of text per bucket of anchors, and bytes of snippets per merge of transforms.
BUCKET_BYTES = 24 << 20
MERGE_BYTES = 1 << 19
SHARDS = 2
# Distinct snippets under one anchor hash beyond which their windows are dealt out by content: what one merge takes.
CROWDED = MERGE_BYTES // 128
# Crowded anchors are known before the buckets are made from strips of text, of which about this many have a crowded anchor.
STRIP = 1 << 16
STRIPS = 64
# Tables of up to this many numbers are sent to the texts; longer ones make the texts move.
KEY_ROWS = 2_000_000
NO_ID = (1 << 63) - 1
_rng = np.random.default_rng(31)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POSITION = 26


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


def snippets(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of windows that share an anchor, in texts laid end to end in ``raw`` (at most 2^26 bytes); text i begins at ``starts[i]``, the last entry is the end.

    Returns arrays: text, first window, last window, anchor (places in ``raw``), anchor hash, two hashes of the bytes from the first window to the last one's end: of the
    bytes, and of all strings of ``anchor`` bytes among them. Equal windows lie under equal anchors at the same distance, so only snippets of one anchor hash can share a window.
    """
    n = len(raw)
    assert n < 1 << _POSITION
    h, step, base = _BYTE[raw], 1, int(_BASE)
    while step < anchor:  # hash of 2, 4, 8 ... bytes from each place
        h[: n - step] = h[: n - step] * np.uint64(base) + h[step:]
        step, base = step * 2, base * base % (1 << 64)
    h = _mix(h)
    low = (h & ~np.uint64((1 << _POSITION) - 1)) | np.arange(n, dtype=np.uint64)
    width, done = length - anchor + 1, 1
    while done < width:  # smallest of the anchors in a window, the leftmost of equals
        step = min(done, width - done)
        low[: n - step] = np.minimum(low[: n - step], low[step:])
        done += step
    size = np.diff(starts)
    windows = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(text)) + np.repeat(starts[:-1] - (np.cumsum(windows) - windows), windows)
    place = (low[at] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    first, last, where = at[head], at[tail], place[head]
    power = np.empty(n + 1, np.uint64)
    power[0], power[1:] = 1, _BASE
    np.cumprod(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:n], out=sums[1:])
    inverse = np.empty(n + 1, np.uint64)
    inverse[0], inverse[1:] = 1, np.uint64(_inverse(int(_BASE)))
    np.cumprod(inverse, out=inverse)
    content = _mix((sums[last + length] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    np.cumsum(h * power[:n], out=sums[1:])
    second = _mix((sums[last + length - anchor + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return text[head], first, last, where, h[where], content, second


def rotations(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order of all rotations of the strings in ``text`` (values > 0 but for the 0 that ends each string; string i is bounds[i]:bounds[i+1]), by prefix doubling."""
    n = len(text)
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    head = np.repeat(bounds[:-1], np.diff(bounds))
    inside = np.arange(n) - head
    rank, step = text.astype(np.int64), 1
    longest = int(np.diff(bounds).max())
    while True:
        ahead = rank[head + (inside + step) % size]
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        step *= 2
        if step >= longest or rank[order[-1]] == n - 1:
            return order


def interleave(transforms: list[np.ndarray], depth: int) -> np.ndarray:
    """Which shard each place of the merged order of rotations comes from, right for the first ``depth`` symbols.

    ``transforms`` hold, per shard in its own order, the two symbols before each rotation (first * 512 + second). An interleave that is right for k symbols, stably
    parted by the symbols before, is right for k + 2; so suffixes are never compared or sorted again.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(x) for x in transforms])
    flat = np.concatenate(transforms)
    first = np.append(0, np.cumsum([len(x) for x in transforms]))
    row = np.empty(len(flat), np.int64)
    # Two symbols fit 16 bits once they are numbered, which keeps the stable sort a counting sort.
    names, code = np.unique(flat, return_inverse=True)
    code = code.astype(np.uint16 if len(names) < 1 << 16 else np.int64)
    for _ in range(-(-depth // 2)):
        if len(transforms) == 2:
            ones = np.cumsum(shard, dtype=np.int64)
            row = np.where(shard, first[1] - 1 + ones, np.arange(len(flat)) - ones)
        else:
            for q in range(len(transforms)):
                own = shard == q
                row[own] = np.arange(first[q], first[q + 1])
        shard = shard[np.argsort(code[row], kind="stable")]
    return shard


def repeated_windows(strings: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur more than once in ``strings``: (string, place, group), equal windows in one group.

    The strings are dealt to shards; each shard's transform comes from its own order of rotations. The transforms are merged by interleave refinement to the depth of
    a window; neighbours in the merged order that share a whole window form its intervals.
    """
    sizes = np.array([len(x) for x in strings])
    raw = np.frombuffer(b"".join(strings), np.uint8)
    edges = np.append(0, np.cumsum(sizes))
    parts = [p for p in np.array_split(np.arange(len(strings)), shards) if len(p)]
    places, transforms = [], []
    for p in parts:
        own = sizes[p]
        bounds = np.append(0, np.cumsum(own + 1))
        text = np.zeros(bounds[-1], np.int32)
        inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], own + 1)
        real = inside < np.repeat(own, own + 1)
        text[real] = raw[edges[p[0]] : edges[p[-1] + 1]].astype(np.int32) + 1
        order = rotations(text, bounds)
        head, size = np.repeat(bounds[:-1], own + 1), np.repeat(own + 1, own + 1)
        one, two = text[head + (inside - 1) % size], text[head + (inside - 2) % size]
        transforms.append((two * 512 + one)[order])
        place = np.repeat(edges[p], own + 1) + inside
        place[~(inside + length <= np.repeat(own, own + 1))] = -1  # too near its end to be a window
        places.append(place[order])
    shard = interleave(transforms, length) if len(parts) > 1 else np.zeros(len(transforms[0]), np.uint8)
    merged = np.empty(len(shard), np.int64)
    for q, place in enumerate(places):
        merged[shard == q] = place
    merged = merged[merged >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(merged), bool)
    for at in range(1, len(merged), 65_536):
        stop = min(len(merged), at + 65_536)
        same[at:stop] = (windows[merged[at:stop]] == windows[merged[at - 1 : stop - 1]]).all(1)
    member = same.copy()
    member[:-1] |= same[1:]
    group = np.cumsum(~same)[member]
    merged = merged[member]
    string = np.searchsorted(edges, merged, "right") - 1
    return string, merged - edges[string], group


def _later(keys: tuple[np.ndarray, ...], group: np.ndarray) -> np.ndarray:
    """Which rows are not the first of their group; ``keys`` with the most important first."""
    order = np.lexsort((*keys[::-1], group))
    ranked = group[order]
    later = np.ones(len(order), bool)
    later[order[np.append(True, ranked[1:] != ranked[:-1])] if len(order) else order] = False
    return later


def _joined(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Runs of windows of one owner, sorted, overlapping or adjacent ones made one."""
    order = np.lexsort((lo, owner))
    owner, lo, hi = owner[order], lo[order], hi[order]
    if not len(lo):
        return owner, lo, hi
    shift = owner.astype(np.int64) * (int(hi.max()) + 2)  # owners apart, so one running maximum does
    top = np.maximum.accumulate(hi + shift) - shift
    new = np.append(True, (owner[1:] != owner[:-1]) | (lo[1:] > top[:-1] + 1))
    head = np.flatnonzero(new)
    return owner[head], lo[head], top[np.append(head[1:], len(lo)) - 1]


def _equal_to_last(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a row in ``order`` has the keys of the row before it."""
    out = np.ones(len(order), bool)
    out[:1] = False
    for k in keys:
        out[1:] &= k[order[1:]] == k[order[:-1]]
    return out


# A packed snippet: anchor hash, two content hashes, document (two columns), first window, further windows.
_PACKED = ("<u8", "<u8", "<u8", "<i8", "<u4", "<u4", "<u2")
_RUN = "a long, t long, lo long, hi long"


def _pieces(batch: pa.RecordBatch):
    """Lists of (row, base, bytes) of about BATCH bytes; a longer text comes in pieces that overlap by a window less one."""
    held, size = [], 0
    for r in range(batch.num_rows):
        data = batch.column("text")[r].as_buffer()
        view = memoryview(data) if data is not None else b""
        for base in range(0, max(1, len(view) - LENGTH + 1), PIECE):
            part = view[base : base + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and size + len(part) > BATCH:
                yield held
                held, size = [], 0
            held.append((r, base, part))
            size += len(part)
    if held:
        yield held


def _contents(frames):
    """(h, c): the different snippets in each batch of texts, by anchor hash and content hash."""
    for b in frames:
        for held in _pieces(b):
            raw = np.frombuffer(b"".join(p for *_, p in held), np.uint8)
            _, _, _, _, h, c, _ = snippets(raw, np.append(0, np.cumsum([len(p) for *_, p in held])))
            order = np.lexsort((c, h))
            order = order[~_equal_to_last(order, h, c)]
            yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(c[order].view(np.int64))], ["h", "c"])


def _crowded_anchors(texts: DataFrame, crowded: int) -> np.ndarray:
    """Sorted anchor hashes (u8) with more than about half of ``crowded`` different snippets, counted on strips of the texts chosen by document and place.

    They only say how snippets are dealt: an anchor that is passed over is found in its bucket, one that is listed too early costs time. With 4,096 different
    snippets, 64 are met and half of them suffice.
    """
    every = max(1, crowded // STRIPS)
    strips = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / STRIP).cast("int"))
    chosen = F.filter(strips, lambda x: F.pmod(F.xxhash64("a", "t", x), F.lit(every)) == 0)
    some = texts.select("text", F.explode(chosen).alias("x")).select(F.substring("text", F.col("x") * STRIP + 1, F.lit(STRIP + LENGTH - 1)).alias("text"))
    counts = some.mapInArrow(_contents, "h long, c long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") >= max(2, crowded // every // 2)).select("h").toPandas()["h"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _listed(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return among[at] == h if len(among) else np.zeros(len(h), bool)


def _file_anchors(buckets: int, apart: np.ndarray):
    """Per batch of texts: blobs of snippets for each bucket of anchor hashes, one per (anchor, content), and runs that the batch itself shows to repeat, dealt to any bucket.

    Snippets of the anchors in ``apart`` go to buckets by content.
    """

    def run(frames):
        names = ["bucket", "a", "t", "lo", "hi", "blob"]
        for b in frames:
            a_of, t_of = b.column("a").to_numpy(), b.column("t").to_numpy()
            for held in _pieces(b):
                raw = np.frombuffer(b"".join(p for *_, p in held), np.uint8)
                starts = np.append(0, np.cumsum([len(p) for *_, p in held]))
                text, first, last, _, h, c, d = snippets(raw, starts)
                shift = np.array([base for _, base, _ in held])[text] - starts[text]
                row = np.array([r for r, *_ in held])[text]
                lo, hi, a, t = first + shift, last + shift, a_of[row], t_of[row]
                order = np.lexsort((lo, t, a, c, h))
                again, self_ = _equal_to_last(order, h, c, d), _equal_to_last(order, h, c, d, a, t, lo)
                dup = order[again & ~self_]
                owner, dup_lo, dup_hi = _joined(row[dup], lo[dup], hi[dup])
                n = len(owner)
                if n:
                    none = pa.nulls(n, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array((a_of[owner] % buckets + t_of[owner] % buckets) % buckets, pa.int32()), pa.array(a_of[owner]), pa.array(t_of[owner]), pa.array(dup_lo), pa.array(dup_hi), none], names)
                keep = np.sort(order[~again])
                by = np.where(_listed(h[keep], apart), c[keep], h[keep])
                bucket = (by % np.uint64(buckets)).astype(np.int64)
                keep = keep[np.argsort(bucket, kind="stable")]
                ids, counts = np.unique(bucket, return_counts=True)
                blobs, at = [], 0
                for k in counts.tolist():
                    i = keep[at : at + k]
                    columns = (h[i], c[i], d[i], a[i], t[i].astype("<u4"), lo[i].astype("<u4"), (hi[i] - lo[i]).astype("<u2"))
                    blobs.append(np.array([k], "<u4").tobytes() + b"".join(x.tobytes() for x in columns))
                    at += k
                m = len(ids)
                empty = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), empty, empty, empty, empty, pa.array(blobs, pa.binary())], names)

    return run


def _compare_anchors(crowded: int, apart: np.ndarray):
    """Within a bucket: runs pass; snippets equal to an earlier one are repeats as a whole (kind 0); first ones that differ under one anchor hash are to be compared (1, or 2 if crowded or in ``apart``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns: list[list] = [[np.empty(0, kind)] for kind in _PACKED]
        packed = pdf["blob"].notna()
        known = pdf[~packed]
        for blob in pdf["blob"][packed]:
            (k,), at = np.frombuffer(blob, "<u4", 1), 4
            for out, kind in zip(columns, _PACKED, strict=True):
                out.append(np.frombuffer(blob, kind, k, at))
                at += out[-1].nbytes
        h, c, d, a, t, lo, span = (np.concatenate(x) for x in columns)
        common = np.unique(h, return_inverse=True, return_counts=True)
        rows = np.flatnonzero((common[2][common[1]] > 1) | _listed(h, apart))
        h, c, d, a, t, lo, hi = h[rows], c[rows], d[rows], a[rows], t[rows].astype(np.int64), lo[rows].astype(np.int64), (lo[rows].astype(np.int64) + span[rows])
        order = np.lexsort((lo, t, a, c, h))
        order = order[~_equal_to_last(order, h, c, d, a, t, lo)]  # a row of the table that is there twice
        h, c, d, a, t, lo, hi = (x[order] for x in (h, c, d, a, t, lo, hi))
        leads = ~_equal_to_last(np.arange(len(h)), h, c, d)
        _, group, counts = np.unique(h[leads], return_inverse=True, return_counts=True)
        kind = np.zeros(len(h), np.int64)
        kind[leads] = np.select([(counts[group] > crowded) | _listed(h[leads], apart), counts[group] > 1], [2, 1], -1)
        keep = kind >= 0
        new = {"kind": kind[keep], "h": h[keep].view(np.int64), "a": a[keep], "t": t[keep], "lo": lo[keep], "hi": hi[keep]}
        old = {"kind": np.zeros(len(known), np.int64), "h": np.zeros(len(known), np.int64), **{c: known[c].to_numpy(np.int64) for c in ("a", "t", "lo", "hi")}}
        return pd.DataFrame({c: np.concatenate([old[c], new[c]]) for c in new})

    return run


def _cut_snippets(frames):
    """(h, a, t, lo, body) of the snippets listed with each text."""
    for b in frames:
        out: list[list] = [[] for _ in range(5)]
        for r in range(b.num_rows):
            data = memoryview(b.column("text")[r].as_buffer())
            a, t = b.column("a")[r].as_py(), b.column("t")[r].as_py()
            for w in b.column("wanted")[r].as_py():
                for x, v in zip(out, (w["h"], a, t, w["lo"], bytes(data[w["lo"] : w["hi"] + LENGTH])), strict=True):
                    x.append(v)
            if sum(map(len, out[4][-1:])) and len(out[0]) > 50_000:
                yield _snippet_batch(out)
                out = [[] for _ in range(5)]
        if out[0]:
            yield _snippet_batch(out)


def _snippet_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["h", "a", "t", "lo", "body"])


def _merge(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "a", "t", "lo"]).sort_values(["a", "t", "lo"], ignore_index=True)
        string, place, group = repeated_windows(list(pdf["body"]), LENGTH, shards)
        a, t, lo = (pdf[x].to_numpy()[string] for x in ("a", "t", "lo"))
        later = _later((a, t, lo + place), group)
        owner, lo, hi = _joined(string[later], (lo + place)[later], (lo + place)[later])
        return pd.DataFrame({"a": pdf["a"].to_numpy()[owner], "t": pdf["t"].to_numpy()[owner], "lo": lo, "hi": hi})

    return run


def _cut(frames, length: int, names: list[str]):
    """Take the bytes of the runs' windows out of each text."""
    for b in frames:
        kept, removed, spans = [], [], []
        for r in range(b.num_rows):
            data = b.column("_text")[r].as_py()
            runs = sorted((x["lo"], x["hi"] + length) for x in b.column("_runs")[r].as_py())
            out, at, gone, n = [], 0, 0, 0
            for lo, hi in runs:
                if n == 0 or lo > at:
                    out.append(data[at:lo])
                    n, gone, at = n + 1, gone + hi - lo, hi
                elif hi > at:
                    gone, at = gone + hi - at, hi
            out.append(data[at:])
            kept.append(b"".join(out)), removed.append(gone), spans.append(n)
        own = [b.column(i) for i, c in enumerate(b.schema.names) if c in names]
        yield pa.RecordBatch.from_arrays([*own, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_removed", "n_spans", "kept"])


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowded: int = CROWDED, bucket_bytes: int = BUCKET_BYTES, merge_bytes: int = MERGE_BYTES, shards: int = SHARDS,
) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (bytes): the text's UTF-8 bytes without those covered by a 100-byte string that starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same text; matches do not cross texts and are judged on the input.

    1. Texts that equal an earlier one go whole (if they have 100 bytes); the first of each stands for all.
    2. Windows are filed under content-chosen anchors (the smallest hash of 32 bytes inside). Consecutive windows with one anchor are a snippet, about 1 per 32 bytes; snippets travel
       as hashes, once per batch of texts, packed by bucket of anchor hash.
    3. A snippet equal to an earlier one repeats as a whole. Where snippets under an anchor differ, their bytes are fetched, and in each bucket
       shards of them are ordered, and their Burrows-Wheeler transforms are merged by interleave refinement; intervals of the merged order that share 100 bytes are the repeated windows.
    4. An anchor with more than ``crowded`` different snippets has its windows compared by 128-bit hash over all tasks instead. Such anchors are known beforehand from a part of
       the texts, and their snippets are dealt by content, so neither a bucket nor a merge holds all contexts of a common phrase.
    5. Covered bytes are cut out of the texts concerned; others are not shuffled where the list of those is small enough to send (``KEY_ROWS``). Texts are shuffled twice at most: to
       fetch snippets and to be cut.

    Null and short texts keep what they have, with 0 removed. A null doc_id comes after all others; rows that repeat doc_id and text are one document; rows that repeat a doc_id alone are ordered by a
    hash of their texts. An empty table gives no rows. Columns of ``docs`` named like a new one are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.withColumns({"_text": body, "_name": F.md5(body), "_own": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))})
    copies = rows.groupBy("_name").agg(F.min("_own").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Known by one number, so that many of them can be sent, and checked by a second one. Where names share a number all go on as different texts, which costs time only.
    copies = copies.groupBy(F.xxhash64("_name").alias("_code")).agg(F.min("_first").alias("_first"), F.min(F.xxhash64(F.lit(1), "_name")).alias("_check"), F.count(F.lit(1)).alias("_n"))
    copies = cut_lineage(copies.filter("_n = 1").drop("_n"))
    rows = rows.withColumn("_code", F.xxhash64("_name")).join(broadcast_if_small(copies, KEY_ROWS), "_code", "left")
    same_text = F.col("_check") == F.xxhash64(F.lit(1), "_name")
    rows = rows.withColumn("_t", F.crc32(F.col("_name").cast("binary"))).withColumn("_copy", F.coalesce(same_text & (F.col("_own") != F.col("_first")), F.lit(False)))
    size = F.octet_length("_text")
    long_ = rows.filter(~F.col("_copy") & (size >= LENGTH))
    texts = long_.select(F.col("_own").alias("a"), F.col("_t").alias("t"), F.col("_text").alias("text"))

    total = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    apart = _crowded_anchors(texts, crowded)
    filed = texts.mapInArrow(_file_anchors(max(1, -(-total // bucket_bytes)), apart), "bucket int, a long, t long, lo long, hi long, blob binary")
    compared = filed.groupBy("bucket").applyInPandas(_compare_anchors(crowded, apart), "kind int, h long, a long, t long, lo long, hi long")
    compared = cut_lineage(compared)
    del filed
    free_shuffles(docs.sparkSession)  # snippets and texts need not lie on disk together
    same = compared.filter("kind = 0").select("a", "t", "lo", "hi")

    wanted = compared.filter("kind > 0").groupBy("a", "t").agg(F.collect_list(F.struct("kind", "h", "lo", "hi")).alias("all"))
    wanted = cut_lineage(wanted)
    of = lambda kind: F.filter("all", lambda x: x["kind"] == kind).alias("wanted")
    asked = wanted.select("a").distinct()
    found = texts.join(F.broadcast(asked), "a", "left_semi") if small(asked, KEY_ROWS) else texts
    bodies = found.join(wanted.hint("shuffle_hash"), ["a", "t"])
    plain = bodies.select("a", "t", "text", of(1)).filter(F.size("wanted") > 0).mapInArrow(_cut_snippets, "h long, a long, t long, lo long, body binary")
    need = compared.filter("kind = 1").agg(F.sum(F.col("hi") - F.col("lo") + LENGTH)).first()[0] or 0
    plain = plain.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(max(1, -(-need // merge_bytes)))).cast("int"))
    merged = plain.groupBy("bucket").applyInPandas(_merge(shards), _RUN)

    runs = same.union(merged)
    if not compared.filter("kind = 2").isEmpty():
        windows = bodies.select("a", "t", "text", F.explode(of(2)).alias("w")).select("a", "t", "text", F.explode(F.sequence("w.lo", "w.hi")).alias("lo"))
        windows = windows.select("a", "t", "lo", F.md5(F.substring("text", (F.col("lo") + 1).cast("int"), F.lit(LENGTH))).alias("k"))
        firsts = windows.groupBy("k").agg(F.min(F.struct("a", "t", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        runs = runs.union(windows.join(firsts, "k").filter(F.struct("a", "t", "lo") != F.col("first")).select("a", "t", "lo", F.col("lo").alias("hi")))
    runs = cut_lineage(runs.groupBy(F.col("a").alias("_own"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("lo", "hi")).alias("_runs")))
    del merged, plain, bodies, found
    free_shuffles(docs.sparkSession)

    # Texts move once at most, and those of documents without runs not at all where the ids can be sent.
    hit = runs.select("_own").distinct()
    names = docs.columns + ["_text"]
    whole = F.col("_copy") & (size >= LENGTH)
    empty = F.lit(b"").cast("binary")
    out = [*[F.col(f"`{c}`") for c in docs.columns], size.cast("long").alias("n_bytes")]
    near, far = rows, None
    if small(hit, KEY_ROWS):
        near, far = rows.join(F.broadcast(hit), "_own", "left_semi"), rows.join(F.broadcast(hit), "_own", "left_anti")
    # A copy lies under its own id and has no runs but its whole text.
    all_of_it = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("lo"), (size - LENGTH).cast("long").alias("hi"))))
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    touched = near.join(runs.hint("shuffle_hash"), ["_own", "_t"], "left").select(*names, F.coalesce("_runs", all_of_it, none).alias("_runs"))
    schema = touched.select(*names).schema.add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    touched = touched.mapInArrow(lambda frames: _cut(frames, LENGTH, names), schema).select(*out, "n_removed", "n_spans", "kept")
    if far is None:
        return touched
    untouched = far.select(
        *out, F.when(whole, size.cast("long")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.col("_text")).alias("kept"),
    )
    return untouched.unionByName(touched)
