"""Point-against-point work in bounded blocks.

Both sides are hashed into blocks of a bounded size and each pair of blocks is one task that returns
a reduced result per left row (its k nearest, its distance sums), never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_POINTS = 4096


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    block_points: int = BLOCK_POINTS,
) -> DataFrame:
    """Run ``work(left_block, right_block)`` for every pair of hash blocks of the two sides."""
    n_left = max(1, -(-left.count() // block_points))
    n_right = max(1, -(-right.count() // block_points))
    ls = left.withColumn("__lb", F.pmod(F.xxhash64(left_id), F.lit(n_left))).withColumn(
        "__rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))
    )
    rs = right.withColumn("__rb", F.pmod(F.xxhash64(right_id), F.lit(n_right)).cast("int")).withColumn(
        "__lb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long")))
    )
    return paired(ls, rs, ["__lb", "__rb"], work, schema)


def paired(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Cogrouped map over the groups present on both sides."""
    names = [f.name for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({name: pd.Series([], dtype=object) for name in names})
        return work(a, b)

    # Fresh column identities: both sides often come from the same table.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(run, schema)
