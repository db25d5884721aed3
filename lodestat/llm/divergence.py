"""Which sources of a language differ, and by which terms.

1. Terms are counted per block of texts inside the map tasks, then summed by Spark. A first pass gives the terms that occur
   in ``least`` documents of their language. A filter of fixed size with those terms' bits goes to the second pass, which
   counts per (lang, source) and term; an inner join with the kept terms then settles what the filter let through.
2. Kept terms get ids in (lang, term) order. A group's counts become sorted (id, count) arrays, one for each 8,192 ids, so
   an array is bounded however large the vocabulary is.
3. Pair tasks: the groups of a language are dealt to tiles of about 16. For each unordered pair of tiles and block of ids the
   arrays of both sides are co-grouped, and every unordered pair of groups in it is merged: a galloping intersection finds
   the overlap, and overlap and one-sided terms are priced. Sums and union sizes per pair are added over the blocks; terms
   that neither has cost the same each, so the pair's remaining terms are priced by one product. The price is symmetric,
   so a pair is reported both ways.
4. A group's own terms are priced against its language; only the first ranks of each task are shuffled.

All arithmetic is on integers: shares are found by long division in three steps of 1000, exact while a group's total
stays below 9e15.

Defined cases: null text, lang and source are ''; a group without terms takes part with count 0 everywhere; a language
without kept terms has value 0 in every pair; repeated rows count each; a language of one source has no pairs; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import FILTER_BITS, bit_filter, in_filter, q, stored, text_blocks

LEAST = 10
TERM_RANKS = 10
TILE = 16
BLOCK_IDS = 13
HELD = 500_000

# Capital letters become small ones, other ASCII characters that are no letters become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def spot(lang: str, term: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term, xxhash.xxh64_intdigest(lang)) & (bits - 1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(q(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term and in how many documents, in parts that still have to be summed."""

    def rows(batches):
        found, held = defaultdict(Counter), 0

        def flush():
            for lang, terms in found.items():
                names = [t.decode("utf-8", "replace") for t in terms]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(terms.values(), pa.int64())],
                    ["lang", "term", "docs"],
                )

        for part, data, offsets in text_blocks(batches):
            langs = part.column(0).to_pylist()
            raw = data.tobytes().translate(FOLD)
            for k, lang in enumerate(langs):
                terms = found[lang]
                held -= len(terms)
                terms.update(set(raw[offsets[k] : offsets[k + 1]].split()))
                held += len(terms)
            if held > HELD:
                yield from flush()
                found, held = defaultdict(Counter), 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(rows, "lang string, term string, docs long")


def term_counts(docs: DataFrame, kept: np.ndarray, bits: int) -> DataFrame:
    """lang, source, term and count of the terms in the filter, in parts that still have to be summed."""
    known = docs.sparkSession.sparkContext.broadcast(kept)

    def rows(batches):
        found, held = defaultdict(Counter), 0
        names: dict[str, dict[bytes, str | None]] = defaultdict(dict)

        def name(lang, own):
            """The terms of a language that the filter lets through, by their bytes; None for others."""
            new = [t for t in own if t not in names[lang]]
            texts = [t.decode("utf-8", "replace") for t in new]
            passed = in_filter(known.value, np.fromiter((spot(lang, t, bits) for t in texts), np.int64, len(texts)))
            names[lang].update((t, text if p else None) for t, text, p in zip(new, texts, passed.tolist()))
            return names[lang]

        def flush():
            if sum(map(len, names.values())) > HELD:
                names.clear()
            for (lang, source), own in found.items():
                of = name(lang, own)
                terms = [(of[t], n) for t, n in own.items() if of[t] is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array([t for t, _ in terms], pa.string()),
                        pa.array([n for _, n in terms], pa.int64()),
                    ],
                    ["lang", "source", "term", "n"],
                )

        for part, data, offsets in text_blocks(batches):
            raw = data.tobytes().translate(FOLD)
            groups = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
            for k, group in enumerate(groups):
                terms = found[group]
                held -= len(terms)
                terms.update(raw[offsets[k] : offsets[k + 1]].split())
                held += len(terms)
            if held > HELD:
                yield from flush()
                found, held = defaultdict(Counter), 0
        yield from flush()

    return docs.mapInArrow(rows, "lang string, source string, term string, n long")


def share(c: str, d: str) -> str:
    """SQL for 1 + floor(10^9 * c / d), for c <= d."""
    r1 = f"({c}) * 1000"
    r2 = f"({r1} % {d}) * 1000"
    r3 = f"({r2} % {d}) * 1000"
    return f"(1 + ({r1} div {d}) * 1000000 + ({r2} div {d}) * 1000 + ({r3} div {d}))"


def price(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total)."""
    out, rest = np.ones(len(counts), np.int64), counts + 2
    for unit in (1_000_000, 1_000, 1):
        digit, rest = np.divmod(rest * 1000, total)
        out += digit * unit
    return out


def prices(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // (p + q)).sum())


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """First place in ``hay`` not below each needle (both ascending, ``hay`` not empty).

    All needles search at once, each from its proportional place: brackets double until they hold, then are halved.
    """
    n = len(hay)
    low = np.arange(len(needles)) * n // max(len(needles), 1)
    high, step = low.copy(), 1
    while True:
        wide = (low > 0) & (hay[np.maximum(low - 1, 0)] >= needles)
        tall = (high < n) & (hay[np.minimum(high, n - 1)] < needles)
        if not (wide.any() or tall.any()):
            break
        low[wide] = np.maximum(low[wide] - step, 0)
        high[tall] = np.minimum(high[tall] + step, n)
        step *= 2
    while (low < high).any():
        middle = (low + high) // 2
        right = (low < high) & (hay[np.minimum(middle, n - 1)] < needles)
        low = np.where(right, middle + 1, low)
        high = np.where(right, high, np.minimum(middle, high))
    return low


def merge(x, y) -> tuple[int, int]:
    """Price of all terms that one of two groups has, and how many those are; a group is ids, shares and its share of count 0."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    (ids, p, p0), (other, r, r0) = x, y
    if not len(other):
        return 0, 0
    at = gallop(ids, other)
    both = other[np.minimum(at, len(other) - 1)] == ids
    both &= at < len(other)
    hit = np.zeros(len(other), bool)
    hit[at[both]] = True
    total = prices(p[both], r[at[both]]) + prices(p[~both], np.int64(r0)) + prices(np.int64(p0), r[~hit])
    return total, len(ids) + len(other) - int(both.sum())


PAIR = "lang string, a string, b string, value long, terms long"


def merge_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every unordered pair of groups of two tiles, on one block of ids."""

    def read(t):
        out = []
        for source, total, ids, counts in zip(t["source"].to_pylist(), t["total"].to_pylist(), t["ids"], t["counts"]):
            counts = counts.values.to_numpy()
            none = int(shares(np.zeros(1, np.int64), total)[0])
            out.append((source, (ids.values.to_numpy(), shares(counts, total), none)))
        return out

    found = []
    if left.num_rows and right.num_rows:
        lang = left["lang"][0].as_py()
        same = left["a"][0].as_py() == left["b"][0].as_py()
        theirs = read(right)
        for source, mine in read(left):
            for item, other in theirs:
                if not same or source < item:
                    first, second = sorted((source, item), key=str.encode)
                    found.append((lang, first, second, *merge(mine, other)))
    columns = list(zip(*found)) if found else [[]] * 5
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "a", "b", "value", "terms"])


def audit(docs: DataFrame, least: int = LEAST, term_ranks: int = TERM_RANKS, tile: int = TILE, bits: int = FILTER_BITS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    docs = _texts(docs)
    kept = document_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    ordered = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = stored(ordered.withColumn("id", F.monotonically_increasing_id()), "divergence-terms")

    def spots(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([spot(a, t, bits) for a, t in zip(b["lang"].to_pylist(), b["term"].to_pylist())], pa.int64())], ["spot"])

    known = bit_filter(kept.select("lang", "term").mapInArrow(spots, "spot long"), "spot", bits)
    counts = term_counts(docs, known, bits).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = stored(counts.join(kept, ["lang", "term"]), "divergence-counts")

    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).alias("tiles")).join(terms, "lang", "left")
    groups = groups.join(sizes, ["lang", "source"], "left").join(per_lang, "lang")
    groups = groups.select(
        "lang", "source", "tiles",
        F.coalesce("v", F.lit(0)).alias("v"),
        (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"),
        F.pmod(F.xxhash64("source"), F.col("tiles")).alias("tile"),
    )
    groups = stored(groups, "divergence-groups")

    arrays = counts.groupBy("lang", "source", F.shiftright("id", BLOCK_IDS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("e")
    )
    # A group without terms in a block still meets those that have some there.
    spread = kept.select("lang", F.shiftright("id", BLOCK_IDS).alias("block")).distinct().join(groups, "lang")
    none = F.array().cast("array<bigint>")
    arrays = spread.join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "source", "block", "total", "tile", "tiles",
        F.coalesce("e.id", none).alias("ids"), F.coalesce("e.n", none).alias("counts"),
    )
    arrays = stored(arrays, "divergence-arrays")
    left = arrays.select("lang", "source", "block", "total", "ids", "counts", F.col("tile").alias("a"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("b"))
    right = arrays.select("lang", "source", "block", "total", "ids", "counts", F.col("tile").alias("b"), F.explode(F.expr("sequence(0L, tile)")).alias("a"))
    keys = ("lang", "block", "a", "b")
    merged = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(merge_tiles, PAIR)
    merged = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("priced"), F.sum("terms").alias("terms"))

    one, two = groups.alias("x"), groups.alias("y")
    pairs = one.join(two, F.expr("x.lang = y.lang AND x.source < y.source")).select(
        F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.v").alias("v"),
        F.col("x.total").alias("ta"), F.col("y.total").alias("tb"),
    )
    pairs = pairs.join(merged, ["lang", "a", "b"], "left")
    rest = f"(v - coalesce(terms, 0)) * {price(share('2L', 'nullif(ta, 0)'), share('2L', 'nullif(tb, 0)'))}"
    value = F.expr(f"CASE WHEN v = 0 THEN 0L ELSE coalesce(priced, 0L) + {rest} END").alias("value")
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "a", "b", value).select("lang", "value", both)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    whole = counts.groupBy("lang", "id").agg(F.sum("n").alias("all_n"))
    totals = groups.groupBy("lang").agg((F.sum("total") - 2 * F.max("v") * (F.count("*") - 1)).alias("all_total"))
    own = counts.join(whole, ["lang", "id"]).join(groups.select("lang", "source", "total"), ["lang", "source"]).join(totals, "lang")
    own = own.withColumn("p", F.expr(share("n + 2", "total"))).withColumn("q", F.expr(share("all_n + 2", "all_total"))).filter("p > q")
    own = own.select("lang", "source", F.col("term").alias("item"), F.expr(price("p", "q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= term_ranks).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(own.select(columns))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS n FROM g LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
grid AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
  CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * s.v) AS HUGEINT) AS p
  FROM s JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lq AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (l.n + 2)) // (sum(l.n) OVER (PARTITION BY lang) + 2 * v) AS HUGEINT) AS q FROM l JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
tv AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM grid JOIN lq USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pr UNION ALL SELECT * FROM tv))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
