"""Helpers shared by the corpus operators: tables, written intermediates, blocks of UTF-8 texts for NumPy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.session import shared_folder

BLOCK_BYTES = 1 << 20

# ASCII capital letters folded to small ones; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_collecting: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the intermediate tables written inside, for ``discard`` once what was made of them is written."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that are no longer read."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _collecting:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identified(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own. The number is only stable once the result has been stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def scanned(df: DataFrame, name: str) -> DataFrame:
    """Rows of a plain scan of Parquet files with a number of their own: place of the file by path, and row in the file.

    However the files are split, and whatever executors there are, the number is the same in every pass.
    """
    file = fresh(df, "__file")
    path, row = F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name)
    # One row a file: the driver lists them for each scan anyway.
    paths = sorted(r[0] for r in df.select(path).distinct().collect())
    number = fresh(df, "__number")
    files = df.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), f"`{file}` string, `{number}` long")
    found = df.select("*", path, row).join(F.broadcast(files), file, "left")
    return found.select(*[q(c) for c in df.columns], (F.shiftleft(q(number), 40) + q(name)).alias(name))


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (a longer text is a slice of its own).

    Gives the slice, its texts as one byte array and the offsets of the texts in it; a null is an empty text.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if not n:
            continue
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, dtype=kind, count=texts.offset + n + 1)[texts.offset :].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), n)
            yield (
                batch.slice(first, last - first),
                data[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes, and the index of its text; runs end at text bounds."""
    n = len(is_word)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | cut[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class RollingHash:
    """Polynomial hashes modulo 2^64 of any byte ranges of a block."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.size = -1

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * BLOCK_BYTES)
            inverse = pow(self.BASE, -1, 1 << 64)
            ones = np.ones(self.size + 1, np.uint64)
            ones[1:] = self.BASE
            self.up = np.cumprod(ones, dtype=np.uint64)
            ones[1:] = inverse
            self.down = np.cumprod(ones, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


FILTER_BITS = 1 << 26


def bit_filter(df: DataFrame, position: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of ``bits`` bits with those at the ``position`` column set.

    It has the same size whatever ``df`` holds. A key whose bit is unset is surely absent; one whose bit is set may be absent
    too, so callers decide on the keys themselves afterwards. Full filters only let more through.
    """
    spot = q(position)
    built = df.groupBy(F.shiftright(spot, 15).alias("k")).agg(F.bitmap_construct_agg(spot.bitwiseAND(32767)).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in built.collect():
        out[4096 * r["k"] : 4096 * (r["k"] + 1)] = np.frombuffer(r["m"], np.uint8)
    return out


def in_filter(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bits[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1
