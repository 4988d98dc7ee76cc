"""Vector arithmetic as columns. Vectors are float arrays; sums are taken in double."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores beyond single precision are reported as null.
LARGEST = 3.4e38


def literal(values: Sequence[float]) -> Column:
    return F.lit([float(x) for x in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero; not clamped."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def score(metric: str, a: Column, b: Column) -> Column:
    raw = {"cosine": cosine, "dotproduct": dot, "euclidean": squared_l2}[metric](a, b)
    return F.when(F.abs(raw) < LARGEST, raw)


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Float lists as rows of a matrix; what is null or of another length is a row of NaN."""
    out = np.full((len(vectors), dimension), np.nan)
    fits = np.asarray(pa.compute.equal(pa.compute.list_value_length(vectors), dimension).fill_null(False))
    if fits.any():
        out[fits] = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return out


def keys(metric: str, qs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of all queries with all rows, the higher the better; minus infinity where there is none."""
    with np.errstate(all="ignore"):
        if metric == "cosine":
            qs, x = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (qs, x))
        s = qs @ x.T
        if metric == "euclidean":
            s = np.minimum(2 * s - (qs**2).sum(axis=1)[:, None] - (x**2).sum(axis=1)[None, :], 0)
        s[~(np.abs(s) < LARGEST)] = -np.inf
    return s


def score_to(metric: str, a: Column, query: Sequence[float]) -> Column:
    """``score`` with one given vector, by one matrix product a batch."""
    q = np.array([list(query)], np.float64)

    def run(vectors: pa.Array) -> pa.Array:
        key = keys(metric, q, matrix(vectors, q.shape[1]))[0]
        return pa.array(-key if metric == "euclidean" else key, pa.float64(), mask=np.isinf(key))

    return F.arrow_udf(run, "double")(a.cast("array<float>"))


def best_first(metric: str, column: str = "score") -> Column:
    return F.col(column).asc_nulls_last() if metric == "euclidean" else F.col(column).desc_nulls_last()


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n).cast("float"))


def valid(a: Column, dimension: int, metric: str) -> Column:
    """Whether a vector may be stored: its length fits, all numbers are finite, and cosine has a direction."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    ok = a.isNotNull() & (F.size(a) == dimension) & finite
    return F.coalesce(ok & (norm(a) > 0) if metric == "cosine" else ok, F.lit(False))


def summary(a: Column) -> Column:
    """Norm, least and largest number of a vector."""
    return F.struct(norm(a).alias("norm"), F.array_min(a).alias("min"), F.array_max(a).alias("max"))


def from_base64(text: Column) -> Column:
    """Little-endian single-precision numbers, base64, to an array; null unless the bytes are whole numbers.

    Each number's bytes are read as an integer and put together from sign, exponent and fraction, all in built-in functions.
    """
    hexed = F.hex(F.try_to_binary(text, F.lit("base64")))
    word = lambda i: F.conv(F.concat(*[F.substring(hexed, i * 8 + 7 - 2 * k, 2) for k in range(4)]), 16, 10).cast("long")

    def number(x: Column) -> Column:
        exponent, fraction = F.shiftright(x, 23).bitwiseAND(F.lit(255)), x.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
        size = F.when(exponent == 255, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(exponent == 0, fraction * 2.0**-149).otherwise((1 + fraction * 2.0**-23) * F.pow(F.lit(2.0), (exponent - 127).cast("double")))
        return (F.when(x >= 1 << 31, -size).otherwise(size)).cast("float")

    count = F.length(hexed) / 8
    whole = F.when(F.length(hexed) % 8 == 0, F.transform(F.sequence(F.lit(0), F.greatest(count.cast("int") - 1, F.lit(0))), lambda i: number(word(i))))
    return F.when(F.length(hexed) == 0, F.array().cast("array<float>")).otherwise(whole)


def to_base64(a: Column) -> Column:
    def encode(s: pd.Series) -> pd.Series:
        import base64

        import numpy as np

        return s.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())

    return F.pandas_udf(encode, "string")(a)
