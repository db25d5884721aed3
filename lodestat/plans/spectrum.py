"""Discrete Fourier magnitudes of keyed series of any length.

A series of up to ``TASK_POINTS`` points is transformed where it is grouped. A longer one is written as a circular
convolution with a chirp (Bluestein 1970), whose power-of-two length is laid out as a matrix of ``n1`` x ``n2``
points; columns, rows and columns again are transformed in blocks of at most ``TASK_POINTS`` points (or one row or column, if that is
more), with twiddle factors in between. Three shuffles of packed blocks do for every length, prime ones included, so
the work is n log n and no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_POINTS = 1 << 18


def _squares(j: np.ndarray, modulus: int) -> np.ndarray:
    """j * j modulo ``modulus``, exact in 64 bits for j below 2^40."""
    j = j.astype(np.uint64)
    high, low, m = j >> np.uint64(16), j & np.uint64(0xFFFF), np.uint64(modulus)
    return (((high * j) % m) * np.uint64(1 << 16) + low * j) % m


def _chirp(j: np.ndarray, m: int) -> np.ndarray:
    """exp(i pi j^2 / m)."""
    return np.exp(1j * np.pi * (_squares(j, 2 * m) / m))


def _turn(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """exp(2 pi i a b / length) for all pairs of ``a`` and ``b``; products stay below 2^63."""
    return np.exp(2j * np.pi * ((np.outer(a, b) % length) / length))


def _sides(m: int, task: int) -> tuple[int, int, int, int]:
    """Sides n1 x n2 of the padded matrix, and how many columns and rows a block holds."""
    p = (2 * m - 2).bit_length()
    n1 = 1 << min(p, max(task.bit_length() - 1, (p + 1) // 2))
    n2 = (1 << p) // n1
    return n1, n2, max(1, min(n2, task // n1)), max(1, min(n1, task // n2))


def _sides_columns(m: Column, task: int) -> tuple[Column, Column]:
    """n2 and the columns of a block, as :func:`_sides` has them."""
    p = F.length(F.bin(2 * m - 2))
    q = F.least(p, F.greatest(F.lit(task.bit_length() - 1), F.floor((p + 1) / 2).cast("int")))
    n1, n2 = F.pow(F.lit(2.0), q).cast("long"), F.pow(F.lit(2.0), p - q).cast("long")
    return n2, F.greatest(F.lit(1).cast("long"), F.least(n2, F.floor(F.lit(task) / n1)))


def magnitudes(
    df: DataFrame, keys: Sequence[str], t: str = "__t", m: str = "__m", value: str = "__d", task: int = TASK_POINTS
) -> DataFrame:
    """|X(k)| of each series for 1 <= k < m // 2: rows (keys, ``m``, ``__k``, ``__mag``).

    ``t`` numbers the points of a series from 0 without gaps and ``m`` is its length. ``task`` (a power of two)
    bounds the points of a task; it does not change the result.
    """
    keys = list(keys)
    fields = {f.name: f for f in df.schema.fields}
    heads = [T.StructField(f"__g{i}", fields[k].dataType) for i, k in enumerate(keys)]
    names = [f.name for f in heads]
    rows = df.select(
        *[F.col(k).alias(g) for k, g in zip(keys, names)],
        F.col(m).cast("long").alias("__m"),
        F.col(t).cast("long").alias("__t"),
        F.col(value).cast("double").alias("__d"),
    )
    result = T.StructType([*heads, T.StructField("__m", T.LongType()), T.StructField("__k", T.LongType()), T.StructField("__mag", T.DoubleType())])
    packed = T.StructType([*heads, T.StructField("__m", T.LongType()), T.StructField("__to", T.LongType()), T.StructField("__from", T.LongType()), T.StructField("__z", T.BinaryType())])

    def headed(frame: pd.DataFrame, columns: dict, schema: T.StructType) -> pd.DataFrame:
        out = pd.DataFrame(columns)
        for c in [*names, "__m"]:
            out[c] = pd.Series([frame[c].iloc[0]] * len(out), index=out.index, dtype=frame[c].dtype)
        return out[[f.name for f in schema.fields]]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("__t")["__d"].to_numpy()
        k = np.arange(1, len(x) // 2)
        return headed(frame, {"__k": k, "__mag": np.abs(np.fft.rfft(x))[k]}, result)

    def columns_of(frame: pd.DataFrame) -> pd.DataFrame:
        """Columns j2 of the padded signal and of the chirp, transformed along j1 (point j = n2 j1 + j2)."""
        length, block = int(frame["__m"].iloc[0]), int(frame["__block"].iloc[0])
        n1, n2, wide, high = _sides(length, task)
        own = np.arange(block * wide, min(n2, (block + 1) * wide))
        at, x = frame["__t"].to_numpy(), frame["__d"].to_numpy()
        signal = np.zeros((n1, len(own)), dtype=complex)
        signal[at // n2, at % n2 - own[0]] = x * np.conj(_chirp(at, length))
        j = n2 * np.arange(n1)[:, None] + own[None, :]
        j = np.minimum(j, n1 * n2 - j)
        chirp = np.where(j < length, _chirp(j, length), 0)
        turn = np.conj(_turn(np.arange(n1), own, n1 * n2))
        both = np.stack([np.fft.fft(signal, axis=0) * turn, np.fft.fft(chirp, axis=0) * turn])
        starts = range(0, n1, high)
        parts = [both[:, s : s + high, :].tobytes() for s in starts]
        return headed(frame, {"__to": np.arange(len(parts)), "__from": block, "__z": parts}, packed)

    def rows_of(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows k1: finish both transforms along j2, multiply them and begin the way back along k2."""
        length, block = int(frame["__m"].iloc[0]), int(frame["__to"].iloc[0])
        n1, n2, wide, high = _sides(length, task)
        own = np.arange(block * high, min(n1, (block + 1) * high))
        both = np.empty((2, len(own), n2), dtype=complex)
        for source, z in zip(frame["__from"], frame["__z"]):
            part = np.frombuffer(z, dtype=complex).reshape(2, len(own), -1)
            both[:, :, source * wide : source * wide + part.shape[2]] = part
        both = np.fft.fft(both, axis=2)
        back = np.fft.ifft(both[0] * both[1], axis=1) * _turn(own, np.arange(n2), n1 * n2)
        parts = [back[:, s : s + wide].tobytes() for s in range(0, n2, wide)]
        return headed(frame, {"__to": np.arange(len(parts)), "__from": block, "__z": parts}, packed)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        """Columns q of the way back along k1; point q + n2 s of the convolution is X up to a factor of modulus 1."""
        length, block = int(frame["__m"].iloc[0]), int(frame["__to"].iloc[0])
        n1, n2, wide, high = _sides(length, task)
        own = np.arange(block * wide, min(n2, (block + 1) * wide))
        back = np.empty((n1, len(own)), dtype=complex)
        for source, z in zip(frame["__from"], frame["__z"]):
            part = np.frombuffer(z, dtype=complex).reshape(-1, len(own))
            back[source * high : source * high + len(part)] = part
        k = (own[None, :] + n2 * np.arange(n1)[:, None]).ravel()
        mag = np.abs(np.fft.ifft(back, axis=0)).ravel()
        kept = (k >= 1) & (k < length // 2)
        return headed(frame, {"__k": k[kept], "__mag": mag[kept]}, result)

    n2, wide = _sides_columns(F.col("__m"), task)
    long = rows.filter(F.col("__m") > task).withColumn("__block", F.floor(F.pmod(F.col("__t"), n2) / wide).cast("long"))
    group = [*names, "__m"]
    columns = long.groupBy(*group, "__block").applyInPandas(columns_of, packed)
    middle = columns.groupBy(*group, "__to").applyInPandas(rows_of, packed)
    bins = (
        rows.filter(F.col("__m") <= task)
        .groupBy(*group)
        .applyInPandas(whole, result)
        .unionByName(middle.groupBy(*group, "__to").applyInPandas(finish, result))
    )
    return bins.select(*[F.col(g).alias(k) for k, g in zip(keys, names)], F.col("__m").alias(m), "__k", "__mag")
