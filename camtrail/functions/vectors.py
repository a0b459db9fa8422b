"""Vector expressions over ARRAY<FLOAT>; elements are widened to double before arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has zero length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), length))


def unit(a: Column) -> Column:
    """L2 normalised copy; a zero vector stays zero."""

    def scaled(length: Column) -> Column:
        return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(
            F.transform(a, lambda x: F.try_divide(x.cast("double"), length))
        )

    # The length is bound once; named in the inner lambda it would be worked out again for every element.
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def pair_mean(a: Column, b: Column) -> Column:
    """Mean of two vectors, renormalised: the vector of a merged track."""
    return unit(F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2.0))


def mean_vector(vector: str, dim: int) -> Column:
    """Aggregate: renormalised mean of a group. One running sum per position, combined map-side."""
    return unit(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]))


def nearest_class(vector: Column, classes: Column) -> Column:
    """Best class of an ARRAY<STRUCT<name, vec>>; ties go to the smaller name. STRUCT<score, name>."""
    scored = F.transform(classes, lambda c: F.struct(dot(vector, c["vec"]).alias("score"), c["name"].alias("name")))
    # One product per class: the best is the least of a key that sorts NaN first, then falling scores, then names.
    keyed = F.transform(
        F.filter(scored, lambda s: s["score"].isNotNull()),
        lambda s: F.struct((~F.isnan(s["score"])).alias("number"), (-s["score"]).alias("falling"), s["name"].alias("name"), s["score"].alias("score")),
    )
    return F.get(F.transform(F.array(F.array_min(keyed)), lambda b: F.struct(b["score"].alias("score"), b["name"].alias("name"))), F.lit(0))


@pandas_udf(T.ArrayType(T.FloatType()))
def decode_f4(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@pandas_udf(T.BinaryType())
def encode_f4(vector: pd.Series) -> pd.Series:
    """Vector to little-endian float32 bytes, without a header."""
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
