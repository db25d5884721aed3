"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to their nearest of a few pivots and range-partitioned by pivot and row, so a shard is a tight part of
the space and a frequent vector is spread over shards. Queries are taken in blocks of bounded size. For each block

1. the queries are indexed in a cover tree: each level halves the covering radius of the one above, and a node knows
   the exact radius over all that hangs below it;
2. each task indexes its vectors in cover trees of up to ``SHARD`` rows and descends both trees together. A node pair
   (Q, D) can hold no score above <q, d> + |q| r_D + |d| r_Q + r_Q r_D with centres q, d and covering radii r; the pair
   is pruned where that is below the worst k-th score of the query group Q. Pairs of leaves are scored, best bound
   first, which raises the k-th scores and prunes more;
3. the best k of each task are ranked by Spark.

The k-th scores start from those against a bounded sample of the vectors, which are true lower bounds, so pruning loses
nothing: the result is exact, ties go to the smaller id.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no
part; vectors are compared with those of the same length; a row is no candidate of its own, but a repeated row is one;
a query with fewer than k candidates gets all of them; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import identified, q, stored

SHARD = 4096
LEAF = 256
QUERY_LEAF = 64
FANOUT = 8
PAIRS = 10_000
SAMPLE = 2048
PIVOTS = 64
BLOCK = 2048


def usable(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """__row, id and the vector as doubles, floor(scale * x) in each component."""
    rows = identified(df.select(q(id_col).cast("long").alias("id"), q(vector_col).alias("v")), "__row")
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))).select("__row", "id", whole.alias("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


@dataclass
class CoverTree:
    """Nodes in arrays; a node's points are ``order[first:last]``, a leaf has no children."""

    points: np.ndarray
    leaf: int = 0
    center: list = field(default_factory=list)
    radius: list = field(default_factory=list)
    first: list = field(default_factory=list)
    last: list = field(default_factory=list)
    children: list = field(default_factory=list)

    def __post_init__(self) -> None:
        n = len(self.points)
        self.order = np.arange(n)
        todo = [(0, n, 0, None)]
        while todo:
            a, b, center, parent = todo.pop()
            node, own = len(self.center), self.order[a:b]
            far = np.sqrt(np.maximum(((self.points[own] - self.points[center]) ** 2).sum(axis=1), 0))
            self.center.append(center)
            self.radius.append(float(far.max()))
            self.first.append(a)
            self.last.append(b)
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if b - a <= (self.leaf or LEAF) or self.radius[node] == 0:
                continue
            # Farthest-first centres until half the radius covers all, beginning with the node's own.
            near, owner, centers = far.copy(), np.zeros(b - a, np.int64), [center]
            while near.max() > self.radius[node] / 2 and len(centers) < FANOUT:
                centers.append(int(own[near.argmax()]))
                d = np.sqrt(((self.points[own] - self.points[centers[-1]]) ** 2).sum(axis=1))
                closer = d < near
                near[closer], owner[closer] = d[closer], len(centers) - 1
            by = np.argsort(owner, kind="stable")
            self.order[a:b] = own[by]
            cuts = a + np.searchsorted(owner[by], np.arange(len(centers) + 1))
            todo += [(int(x), int(y), c, node) for x, y, c in zip(cuts[:-1], cuts[1:], centers) if y > x]
        self.center = self.points[self.center]
        self.radius, self.norm = np.array(self.radius), np.sqrt((self.center**2).sum(axis=1))
        self.is_leaf = np.array([not c for c in self.children])


@dataclass
class Best:
    """The best k of each query so far: score, id and row, and the k-th score to beat."""

    rows: np.ndarray
    floor: np.ndarray
    k: int

    def __post_init__(self) -> None:
        n = len(self.rows)
        self.score = np.full((n, self.k), -np.inf)
        self.id = np.full((n, self.k), np.iinfo(np.int64).max)
        self.kth = self.floor.copy()

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score = np.where(rows[None, :] == self.rows[queries][:, None], -np.inf, score)
        at, column = np.nonzero((score >= self.kth[queries][:, None]) & (score > -np.inf))
        if not len(at):
            return
        # The rows that gain something, with what they hold and what is new, ordered by row, score and id.
        hit = np.unique(at)
        row = np.concatenate([np.repeat(hit, self.k), at])
        all_score = np.concatenate([self.score[queries[hit]].ravel(), score[at, column]])
        all_id = np.concatenate([self.id[queries[hit]].ravel(), ids[column]])
        order = np.lexsort((all_id, -all_score, row))
        first = np.searchsorted(row[order], hit)
        top = order[first[:, None] + np.arange(self.k)]
        own = queries[hit]
        self.score[own], self.id[own] = all_score[top], all_id[top]
        self.kth[own] = np.maximum(self.floor[own], self.score[own, -1])


def search(queries: CoverTree, data: CoverTree, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """Descend both trees together and bring ``best`` up to date."""

    def least() -> np.ndarray:
        ordered = best.kth[queries.order]
        return np.array([ordered[a:b].min() for a, b in zip(queries.first, queries.last)])

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = np.einsum("ij,ij->i", queries.center[a], data.center[b])
        rq, rd = queries.radius[a], data.radius[b]
        bound = dot + queries.norm[a] * rd + data.norm[b] * rq + rq * rd
        return bound + 1e-9 * np.abs(bound) + 1e-6

    todo, leaves = [(np.zeros(1, np.int64), np.zeros(1, np.int64))], []
    floor = least()
    while todo:
        a, b = todo.pop()
        if len(a) > PAIRS:
            todo.append((a[PAIRS:], b[PAIRS:]))
            a, b = a[:PAIRS], b[:PAIRS]
        bound = bounds(a, b)
        alive = bound >= floor[a]
        a, b, bound = a[alive], b[alive], bound[alive]
        leaf = queries.is_leaf[a] & data.is_leaf[b]
        leaves.append((a[leaf], b[leaf], bound[leaf]))
        a, b = a[~leaf], b[~leaf]
        split_q = data.is_leaf[b] | ~queries.is_leaf[a] & (queries.radius[a] > data.radius[b])
        next_a, next_b = [], []
        for x, y, s in zip(a.tolist(), b.tolist(), split_q.tolist()):
            below = queries.children[x] if s else data.children[y]
            next_a += below if s else [x] * len(below)
            next_b += [y] * len(below) if s else below
        if next_a:
            todo.append((np.array(next_a, np.int64), np.array(next_b, np.int64)))
    a, b, bound = (np.concatenate(x) for x in zip(*leaves))
    for i in np.argsort(-bound, kind="stable").tolist():
        own = queries.order[queries.first[a[i]] : queries.last[a[i]]]
        if bound[i] >= best.kth[own].min():
            points = data.order[data.first[b[i]] : data.last[b[i]]]
            for c in range(0, len(points), 1024):
                part = points[c : c + 1024]
                best.add(own, queries.points[own] @ data.points[part].T, ids[part], rows[part])


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, id and score of the ``k`` largest inner products of each query; ``is_query`` is over ``id``."""
    spark = df.sparkSession
    vectors = stored(usable(df, id_col, vector_col, scale), "topk-vectors")
    sample = vectors.orderBy(F.xxhash64("__row"), "__row").limit(SAMPLE).collect()
    # At most SAMPLE vectors: pivots by farthest-first, and k-th scores to start from.
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["v"]), []).append(r)
    pivots, samples = {}, {}
    for size, rows in by_size.items():
        points = np.array([r["v"] for r in rows], float)
        samples[size] = points, np.array([r["__row"] for r in rows])
        chosen, near = [0], ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < PIVOTS and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        pivots[size] = points[chosen]
    sent = spark.sparkContext.broadcast(pivots)

    def deal(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            pivot = np.zeros(len(lengths), np.int32)
            for size in np.unique(lengths):
                own = np.flatnonzero(lengths == size)
                if size in sent.value:
                    points, at = matrix(batch.column(2).take(pa.array(own))), sent.value[size]
                    pivot[own] = ((at**2).sum(axis=1)[None, :] - 2 * points @ at.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(pivot)], ["__row", "id", "v", "size", "pivot"])

    dealt = vectors.mapInArrow(deal, "__row long, id long, v array<double>, size int, pivot int")
    order = ["size", "pivot", "__row"]
    shards = stored(dealt.repartitionByRange(*order).sortWithinPartitions(*order), "topk-shards")
    queries = shards.filter(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    found = [stored(_block(shards, queries.filter(F.pmod(F.xxhash64("__row"), F.lit(blocks)) == n), samples, k), "topk-block") for n in range(blocks)]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _block(shards: DataFrame, queries: DataFrame, samples: dict, k: int) -> DataFrame:
    spark = shards.sparkSession
    rows = queries.select("__row", "id", "v", "size").collect()  # about BLOCK rows
    blocks = {}
    for size in {r["size"] for r in rows}:
        own = [r for r in rows if r["size"] == size]
        points, row = np.array([r["v"] for r in own], float), np.array([r["__row"] for r in own])
        floor = np.full(len(own), -np.inf)
        if size in samples and len(samples[size][1]) > k:
            scores = points @ samples[size][0].T
            scores[row[:, None] == samples[size][1][None, :]] = -np.inf
            floor = np.partition(scores, -k, axis=1)[:, -k]
        blocks[size] = CoverTree(points, QUERY_LEAF), row, np.array([r["id"] for r in own]), floor
    sent = spark.sparkContext.broadcast(blocks)

    def scan(batches):
        best = {size: Best(row, floor, k) for size, (_, row, _, floor) in sent.value.items()}
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            for size in np.unique(lengths):
                if size not in best:
                    continue
                own = np.flatnonzero(lengths == size)
                for c in range(0, len(own), SHARD):
                    part = batch.take(pa.array(own[c : c + SHARD]))
                    tree = CoverTree(matrix(part.column(2)))
                    search(sent.value[size][0], tree, part.column(1).to_numpy(), part.column(0).to_numpy(), best[size])
        for size, b in best.items():
            at, place = np.nonzero(b.score > -np.inf)
            _, row, ids, _ = sent.value[size]
            columns = [row[at], ids[at], b.id[at, place], b.score[at, place].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "id", "score"])

    local = shards.select("__row", "id", "v", "size").mapInArrow(scan, "query_row long, query_id long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
