"""Hooks for models that live outside: embedding, detection and fuzzy camera names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from camtrail.functions import text, vocabulary as V

Provider = Callable[[list], np.ndarray]


def hashed_tokens(dim: int = 64) -> Provider:
    """A stand-in text embedder: signed hashed token counts."""

    def embed(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for token in str(t).lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1.0 if (h >> 32) & 1 else -1.0
        return out

    return embed


def _in_batches(provider: Provider, items: list, size: int) -> np.ndarray:
    """Embed in batches; a batch that fails is halved and tried again."""
    parts, at = [], 0
    while at < len(items):
        try:
            parts.append(np.asarray(provider(items[at : at + size]), dtype=np.float32))
            at += size
        except (MemoryError, RuntimeError):
            if size == 1:
                raise
            size = max(1, size // 2)
    return np.concatenate(parts)


def embed(rows: DataFrame, column: str, provider: Provider, out: str = "emb", batch: int = 16) -> DataFrame:
    """Add a unit vector per row from an injected provider; runs on the executors over Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = _in_batches(provider, pdf[column].tolist(), batch)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
                yield pdf.assign(**{out: list(vectors)})

    return rows.mapInPandas(run, schema)


def detect(frames: DataFrame, detector, payload: str = "image") -> DataFrame:
    """Detections from any object with ``detect(frame) -> [{bbox, conf, label, source}]``."""
    schema = (
        "camera string, video string, frame_idx bigint, ts timestamp_ntz, x1 double, y1 double, x2 double, y2 double, "
        "conf double, label string, source string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows = [
                (f.camera, f.video, f.frame_idx, f.ts, *map(float, d["bbox"]), float(d["conf"]), d["label"], d.get("source", ""))
                for f in pdf.itertuples(index=False)
                for d in detector.detect(getattr(f, payload))
            ]
            yield pd.DataFrame(rows, columns=names)

    return frames.select("camera", "video", "frame_idx", "ts", payload).mapInPandas(run, schema)


def judgements(responses: DataFrame) -> DataFrame:
    """Parsed judge responses (query_id, result_id, response)."""
    return responses.withColumn("_j", text.judgement(F.col("response"))).select(
        "query_id", "result_id", "_j.is_match", "_j.conf", "_j.reason"
    )


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def similarity(a: str, b: str) -> float:
    """100 x 2 LCS / (len a + len b): share of characters kept by inserting and deleting only."""
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_similarity(a: str, b: str) -> float:
    return similarity(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_similarity(a: str, b: str) -> float:
    """Best similarity of the shorter text with a window of the longer, windows may stick out at the ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)

    def slide(part: str, over: str) -> float:
        return max(similarity(part, over[max(0, i) : i + n]) for i in range(1 - n, len(over)))

    # Of two equally long texts either may be the window.
    return max(slide(short, long), slide(long, short)) if n == len(long) else slide(short, long)


def match_spoken_cameras(phrases: DataFrame, cameras: Sequence[str], column: str = "phrase", threshold: float = 65.0) -> DataFrame:
    """Camera meant by every distinct spoken phrase: exact name, else token-sort, else partial similarity.

    ``cameras`` is the short list of candidates. Each distinct phrase is
    compared once, in Arrow batches, with the names of that list.
    """
    names: dict[str, str] = {}
    for camera in cameras:
        spoken = [camera.lower(), " ".join("".join(c if c.isalnum() or c == "_" else " " for c in camera.lower()).split())]
        for name in [*spoken, *V.SPOKEN_CAMERAS.get(camera, [])]:
            names[name] = camera
    ordered = list(names)

    @F.pandas_udf("string")
    def best(cleaned: pd.Series) -> pd.Series:
        def one(phrase):
            if phrase in names:
                return names[phrase]
            for scorer, need in ((token_sort_similarity, threshold), (partial_similarity, threshold + 10)):
                scores = [scorer(phrase, n) for n in ordered]
                top = max(range(len(scores)), key=scores.__getitem__)
                if scores[top] >= need:
                    return names[ordered[top]]
            return None

        return cleaned.map(one)

    cleaned = text.clean_spoken(F.col(column))
    for prefix in V.SPOKEN_PREFIXES:
        cleaned = F.trim(F.regexp_replace(cleaned, "^" + prefix, ""))
    distinct = phrases.select(column).distinct().withColumn("_c", cleaned)
    return distinct.select(column, best(F.col("_c")).alias("camera"))


