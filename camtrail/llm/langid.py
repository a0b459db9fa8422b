"""Language identification by a string kernel: blended-spectrum presence kernels, Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from camtrail.llm import tokens
from camtrail.llm.vectors import batches
from camtrail.scale import broadcast_if_small

# n-gram orders (bytes of case-folded UTF-8) and the slots that the n-grams of an order are hashed to.
ORDERS = {1: 256, 2: 4096, 3: 8192}
# Labelled rows per language that the classifier is fitted on, at most.
PER_LANGUAGE = 800
LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 4.0
UNDETERMINED = "und"
# Documents and bytes of a feature block.
BLOCK_ROWS, BLOCK_BYTES = 128, 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def presence(texts: pa.Array) -> np.ndarray:
    """(texts, slots) 0/1: which n-grams of each whole text occur. N-grams do not cross texts."""
    texts = texts.cast(pa.large_binary())
    size = pc.binary_length(texts).to_numpy()
    raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    folded = _FOLD[raw].astype(np.uint32)
    out = np.zeros((len(texts), sum(ORDERS.values())), np.uint8)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * out.shape[1], size)
    last = np.cumsum(size)
    to_end = np.repeat(last, size) - np.arange(len(raw))  # bytes from here to the end of the text
    flat, base = out.ravel(), 0
    for n, slots in ORDERS.items():
        code = folded[: len(raw) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(0x01000193) ^ folded[k : len(raw) - n + 1 + k]
        if n > 1:
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (slots - 1).bit_length())
        inside = to_end[: len(code)] >= n
        flat[row[: len(code)][inside] + base + code[inside]] = 1
        base += slots
    return out


def blended(bits: np.ndarray) -> np.ndarray:
    """Feature rows whose inner product is the mean over orders of shared n-grams / sqrt(own n-grams * other's)."""
    out, base = bits.astype(np.float32), 0
    for slots in ORDERS.values():
        part = out[:, base : base + slots]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(ORDERS))
        base += slots
    return out


def blocks(frames, text: str):
    """Record batches of at most BLOCK_ROWS rows and about BLOCK_BYTES of text."""
    for b in batches(frames, BLOCK_ROWS):
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy())
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def _spread(packed: np.ndarray) -> np.ndarray:
    return blended(np.unpackbits(packed, axis=1)[:, : sum(ORDERS.values())])


def fit(packed: np.ndarray, labels: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages, and weights (slots and a constant, languages) of the decision values, from rows of packed presence bits.

    The landmarks are taken in turn from the languages; K(x, L) K(L, L)^(-1/2) are the Nystroem features, on which one ridge regression per language
    (+1 for it, -1 for the rest) is solved. As the kernel is an inner product of blended(), its product with the landmarks and the coefficients are folded into one matrix.
    """
    names = sorted(set(labels))
    turns = np.concatenate([np.arange((labels == v).sum()) for v in names])
    chosen = np.concatenate([np.flatnonzero(labels == v) for v in names])[np.argsort(turns, kind="stable")][:landmarks]
    marks = _spread(packed[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    near = np.concatenate([_spread(packed[at : at + 256]) @ marks.T for at in range(0, len(packed), 256)])
    phi = np.c_[near @ whiten, np.ones(len(near))]
    y = np.where(labels[:, None] == np.array(names)[None], 1.0, -1.0)
    # Each language weighs the same however many rows it has.
    weight = np.array([1 / (labels == v).sum() for v in labels])[:, None]
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(phi.T @ (weight * phi) + penalty, phi.T @ (weight * y))
    return names, np.vstack([marks.T @ (whiten @ beta[:-1]), beta[-1:]]).astype(np.float32)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Fit on at most ``per_language`` rows per language: labelled documents with a letter and an id, not held out, with the smallest id hashes.

    Features are made in tasks; the driver gets their bits, about 1.6 KB a row.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id) & F.col(text).rlike(r"\p{L}"))
    order = W.partitionBy("_lang").orderBy("_h", "_id")
    ids = usable.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.xxhash64(doc_id).alias("_h"))
    ids = ids.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language).select("_id").distinct()
    rows = usable.join(broadcast_if_small(ids), usable[doc_id] == ids["_id"], "left_semi").select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).cast("string").alias("id")
    )

    def bits(frames):
        for b in blocks(frames, "text"):
            packed = np.packbits(presence(b.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("id"), pa.array([p.tobytes() for p in packed], pa.binary())], ["lang", "id", "bits"])

    found = rows.mapInArrow(bits, "lang string, id string, bits binary").dropDuplicates(["lang", "id"]).toPandas()
    if found.empty:
        return [], np.zeros((0, 0), np.float32)
    found = found.sort_values(["lang", "id"], ignore_index=True)
    table = np.frombuffer(b"".join(found["bits"]), np.uint8).reshape(len(found), -1)
    return fit(table, found["lang"].to_numpy())


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE
) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and margin, from the whole text alone.

    lang_pred is a language met in training, or ``und`` with score 0 if the text is null or has no letter or nothing could be learned. score is the
    softmax of the decision values, so between 0 and 1; margin is the best decision value less the mean of the others, null where there are none. Ties go to the first language by name. Repeated rows get one answer each; a null id is not held out and is not learned from.
    Columns of ``docs`` named like a new one are replaced; an empty table gives no rows.
    """
    names, weights = train(docs, doc_id, text, lang, per_language)
    docs = docs.drop("held_out", "lang_pred", "score", "margin")
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not names:
        return docs.withColumns({"held_out": held_out(doc_id), "lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "margin": F.lit(None).cast("double")})

    @F.pandas_udf("struct<lang:string,score:double,margin:double>")
    def predict(column):
        import pandas as pd

        out_lang, out_score, out_margin = [], [], []
        for b in blocks([pa.RecordBatch.from_arrays([pa.array(column, pa.string())], ["text"])], "text"):
            texts = b.column("text")
            value = blended(presence(pc.fill_null(texts, ""))) @ weights[:-1] + weights[-1]
            e = np.exp(SHARPNESS * (value - value.max(1, keepdims=True)).astype(np.float64))
            best = np.argmax(value, axis=1)
            out_lang += [names[i] for i in best]
            out_score += (e.max(1) / e.sum(1)).tolist()
            rest = (value.sum(1, dtype=np.float64) - value.max(1)) / max(1, len(names) - 1)
            out_margin += (value.max(1) - rest).tolist() if len(names) > 1 else [None] * len(value)
        tokens.release()
        return pd.DataFrame({"lang": out_lang, "score": out_score, "margin": out_margin})

    answered = docs.withColumn("_answer", predict(F.col(text)))
    return answered.withColumns({
        "held_out": held_out(doc_id),
        "lang_pred": F.when(letter, F.col("_answer.lang")).otherwise(UNDETERMINED),
        "score": F.when(letter, F.col("_answer.score")).otherwise(0.0),
        "margin": F.when(letter, F.col("_answer.margin")),
    }).drop("_answer")
