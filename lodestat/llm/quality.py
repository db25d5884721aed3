"""Quality classifier: cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(threshold_k - score): one weight per hashed feature shared by all grades, and ordered
thresholds between them. A text's features are the presence of its words, of their beginnings (5 and 7 bytes), of
its runs of symbols, and coarse shares (capitals, symbols, repeated words, length), all hashed to ``2 ** BITS``
weights. Every whole text is read.

The model is fitted on at most ``max_rows`` rated documents (a documented bound, taken in hash order of the id)
by L-BFGS on the mean negative log likelihood plus an L2 penalty; Spark sums loss and gradient over the ``PARTS``
partitions of the written feature table in each step, so what reaches the driver does not grow with the documents. All documents are then scored in one pass with the broadcast weights
(bounded by ``2 ** BITS``): expected grade and P(grade >= tail).

Defined cases: a null or empty text has only its length feature; ratings that are null or have no document take no
part, and of several ratings of one id the lowest counts; without any rating, or with one grade only, nothing can be
told apart: probabilities are null and selection keeps every document. Repeated rows get equal scores; empty tables
give empty results; other columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import LOWER, RollingHash, mixed, q, stored, text_blocks, word_bounds

BITS = 17
MAX_ROWS = 40_000
LEAST = 0.7
PARTS = 16
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True
SYMBOL = ~WORD & ~SPACE
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
LETTER = CAPITAL.copy()
LETTER[97:123] = True
LOWERED = np.frombuffer(LOWER, np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, rolling: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a block, ordered by text."""
    n = len(offsets) - 1
    low = LOWERED[data]
    sums = rolling.prefix(low)
    starts, ends, owner = word_bounds(WORD[data], offsets)
    marks_a, marks_b, marks_owner = word_bounds(SYMBOL[data], offsets)
    seed = lambda k: np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    words = rolling.ranges(sums, starts, ends)
    hashed = [words, rolling.ranges(sums, marks_a, np.minimum(marks_b, marks_a + 16)) ^ seed(1)]
    owners = [owner, marks_owner]
    for k, size in ((2, 5), (3, 7)):
        long = ends - starts >= size
        hashed.append(rolling.ranges(sums, starts[long], starts[long] + size) ^ seed(k))
        owners.append(owner[long])
    # Coarse shares: one indicator each.
    total = np.bincount(owner, minlength=n)
    caps = np.concatenate([[0], np.cumsum(CAPITAL[data])])
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    one = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    pairs = np.unique(np.stack([owner.astype(np.uint64), words]), axis=1) if len(words) else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    shares = [
        one(caps) / np.maximum(one(letters), 1),
        np.bincount(marks_owner, minlength=n) / np.maximum(total, 1),
        1 - distinct / np.maximum(total, 1),
    ]
    coarse = [np.minimum((10 * s).astype(np.int64), 20) for s in shares] + [np.log2(total + 1).astype(np.int64)]
    for k, c in enumerate(coarse):
        hashed.append(mixed(c.astype(np.uint64) + seed(10 + k)))
        owners.append(np.arange(n))
    keys = (np.concatenate(owners).astype(np.int64) << BITS) | (np.concatenate(hashed) >> np.uint64(64 - BITS)).astype(np.int64)
    keys = np.unique(keys)
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    """Weights per feature and ordered thresholds; ``grades`` is one more than the thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def rated(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """Written feature table (grade, packed features) of at most ``max_rows`` rated documents."""
    chosen = (
        ratings.select(q(id_col).alias("id"), grade.cast("int").alias("grade"))
        .dropna()
        .groupBy("id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    # At most max_rows rows of two numbers: bounded by the parameter.
    texts = docs.select(q(id_col).alias("id"), q(text_col).alias("text")).join(F.broadcast(chosen), "id").select("grade", "text")

    def rows(batches):
        rolling = RollingHash()
        for part, data, offsets in text_blocks(batches):
            owner, index = features(data, offsets, rolling)
            cuts = np.searchsorted(owner, np.arange(len(offsets)))
            packed = [index[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["grade", "packed"])

    return stored(texts.mapInArrow(rows, "grade int, packed binary").repartition(PARTS), "quality-features")


def _thresholds(free: np.ndarray) -> np.ndarray:
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(free[1:], -30, 30)))])


def loss_and_gradient(weights: np.ndarray, cuts: np.ndarray, grades: np.ndarray, owner: np.ndarray, index: np.ndarray):
    """Summed negative log likelihood with its gradients by weight and by threshold."""
    score = np.bincount(owner, weights=weights[index], minlength=len(grades))
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    sigmoid = lambda x: 1 / (1 + np.exp(np.clip(-x, -500, 500)))
    high, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
    p = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
    by_score = d_high - d_low
    by_weight = np.bincount(index, weights=by_score[owner], minlength=len(weights))
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, grades + 1, -d_high)
    np.add.at(by_cut, grades, d_low)
    return -np.log(p).sum(), by_weight, by_cut[1:-1]


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS, penalty: float = 0.1, steps: int = 30) -> Model | None:
    """Fit on rated documents; ``grade`` is an expression over ``ratings`` with values 0 .. grades - 1."""
    spark = docs.sparkSession
    table = rated(docs, ratings, grade, id_col, text_col, max_rows)
    counts = np.zeros(grades)
    for r in table.groupBy("grade").count().collect():
        counts[r["grade"]] = r["count"]
    n, size = int(counts.sum()), 1 << BITS
    if np.count_nonzero(counts) < 2:
        return None
    below = np.cumsum(counts + 1)[:-1] / (n + grades)
    cuts = np.log(below / (1 - below))
    start = np.concatenate([np.zeros(size), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast((x[:size].astype(np.float32), _thresholds(x[size:])))

        def rows(batches):
            weights, edges = sent.value
            weights = weights.astype(float)
            loss, by_weight, by_cut = 0.0, np.zeros(size), np.zeros(grades - 1)
            for b in batches:
                packed = b.column(1).to_pylist()
                owner = np.repeat(np.arange(len(packed)), [len(p) // 4 for p in packed])
                index = np.frombuffer(b"".join(packed), "<i4")
                got = loss_and_gradient(weights, edges, b.column(0).to_numpy(), owner, index)
                loss, by_weight, by_cut = loss + got[0], by_weight + got[1], by_cut + got[2]
            sums = np.concatenate([[loss], by_weight, by_cut]).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        sums = sum(np.frombuffer(bytes(r["sums"]), "<f4").astype(float) for r in table.mapInArrow(rows, "sums binary").collect())
        sent.unpersist()
        free, by_cut = x[size:], sums[1 + size :]
        steps_of = np.exp(np.clip(free[1:], -30, 30))
        by_free = np.concatenate([[by_cut.sum()], [by_cut[k + 1 :].sum() * s for k, s in enumerate(steps_of)]])
        weights = x[:size]
        return (sums[0] + penalty * (weights @ weights) / 2) / n, np.concatenate([sums[1 : 1 + size] + penalty * weights, by_free]) / n

    best = lbfgs(evaluate, start, steps)
    return Model(best[:size], _thresholds(best[size:]))


def lbfgs(evaluate, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halving steps."""
    value, slope = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, shares = -slope, []
        for s, y in reversed(past):
            a = s @ direction / (s @ y)
            shares.append(a)
            direction = direction - a * y
        if past:
            s, y = past[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(shares)):
            direction = direction + s * (a - y @ direction / (s @ y))
        step = 1.0 if past else min(1.0, 1.0 / max(np.abs(slope).max(), 1e-12)) * 0.5
        down = slope @ direction
        for _ in range(12):
            after, after_slope = evaluate(x + step * direction)
            if after <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            return x
        s, y = step * direction, after_slope - slope
        x, gain, value, slope = x + s, value - after, after, after_slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        if gain < 1e-5 * max(value, 1e-3):
            break
    return x


def score(docs: DataFrame, model: Model | None, tail: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__expected`` (expected grade) and ``__tail`` (P(grade >= tail)); both null without a model."""
    if model is None:
        return docs.withColumns({"__expected": F.lit(None).cast("double"), "__tail": F.lit(None).cast("double")})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        rolling, m = RollingHash(), sent.value
        for part, data, offsets in text_blocks(batches, text_col):
            owner, index = features(data, offsets, rolling)
            tails = m.tails(np.bincount(owner, weights=m.weights[index], minlength=len(offsets) - 1))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, tail - 1])], [*part.schema.names, "__expected", "__tail"]
            )

    schema = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(rows, ", ".join([*schema, "__expected double", "__tail double"]))


def corpus_grade() -> Column:
    """Grade of a labelled document: 0 to 2, a point each for quality and for not being toxic."""
    return F.col("quality") + 1 - F.col("toxic")


def graded(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` scored by a model fitted on ``labels`` (quality, toxic); ``__tail`` is the probability of the top grade."""
    return score(docs, fit(docs, labels, corpus_grade(), 3, **options), 2)


def select(docs: DataFrame, labels: DataFrame, least: float = LEAST, **options) -> DataFrame:
    """The documents whose probability of the top grade is at least ``least``, or unknown."""
    kept = graded(docs, labels, **options).filter(F.col("__tail").isNull() | (F.col("__tail") >= least))
    return kept.select(*[q(c) for c in docs.columns])


def digest(found: DataFrame, least: float = LEAST) -> DataFrame:
    return found.select(
        "doc_id",
        F.round("__expected", 6).alias("expected_grade"),
        F.round("__tail", 6).alias("p_top"),
        (F.col("__tail").isNull() | (F.col("__tail") >= least)).alias("keep"),
    )
