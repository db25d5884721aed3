"""Phrases of two and three words that stand together more often than their parts would suggest.

1. Counting goes by length. Words are counted first, then pairs of two frequent words, then triples whose two pairs are
   frequent; a phrase can't be more frequent than its parts, so no candidate is lost. Blocks of text are combined in the
   map tasks by sorting and merging codes, and Spark adds up what the tasks give. What was frequent reaches the next pass as a filter of fixed size;
   counts below ``least`` go in any case, so what the filter lets through wrongly does not matter.
2. The frequent phrases are kept in two streams, range-partitioned and sorted: in prefix order (first word, second, third)
   and in suffix order (last word, the one before, and so on). In prefix order a phrase follows its first word and its
   first pair, in suffix order its last word and last pair, so one lockstep walk reads off the left or right counts and
   the heaviest extension of each pair on that side, without a table of phrases. A range may begin in the middle
   of a word's phrases; then the word's own count comes from an earlier range, so each range is given the last word and
   the last pair before it (two rows a range).
3. The streams' results are merged again by phrase with a sort-merge join, cuts are scored in whole numbers of any size,
   and the first ``top`` of each language are ranked; each task passes on only its own first ones.

Defined cases: a null text is empty; a null lang is ``und``; phrases never cross pieces or documents; repeated rows count
each; ties in score fall to the shorter first part, ties in rank to the smaller phrase in UTF-8; texts of any length are
counted in slices that overlap by the length of a phrase; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import FILTER_BITS, bit_filter, in_filter, mixed, q, stored, text_blocks

LEAST = 10
TOP = 2000
SHARE = 50
BLOCK = 2 << 20  # bytes of text taken at once
ID_BITS = 21
HELD = 1_000_000  # phrases held in a task before they go to the shuffle
WORDS = 1_000_000  # words held; a block adds fewer than 2^20 to them
LANGS = 1000
RANGE_ROWS = 500_000

# Fixed values of the contract: capital letters are folded, these characters end a piece, a tab is a space.
_BREAK = 0xFF  # in no UTF-8 text
FOLD = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def slices(raw: bytes, size: int, n: int):
    """Folded text in slices of about ``size`` bytes; a slice begins with the last ``n - 1`` words of the one before."""
    begin = done = 0
    while len(raw) - done > size:
        cut = max(raw.rfind(c, done + 1, done + size) for c in (b" ", b"\xff"))
        if cut < 0:
            cut = min((p for p in (raw.find(c, done + size) for c in (b" ", b"\xff")) if p >= 0), default=len(raw))
        yield raw[begin:cut]
        begin = done = cut
        for _ in range(n - 1):
            while begin > 0 and raw[begin - 1] in (32, _BREAK):
                begin -= 1
            begin = max(raw.rfind(c, 0, begin) for c in (b" ", b"\xff")) + 1
    yield raw[begin:]


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


class Counts:
    """Counts of the phrases of ``n`` words of one language, held as sorted codes of word ids and combined as they come."""

    def __init__(self, lang: str, n: int, known: np.ndarray | None, bits: int) -> None:
        self.lang, self.n, self.known, self.mask = lang, n, known, np.uint64(bits - 1)
        self.clear()

    def clear(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"\xff"]
        self.hashes = np.zeros(0, np.uint64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.total = 0

    def add(self, raw: bytes) -> None:
        tokens = raw.replace(b"\xff", b" \xff ").split(b" ")
        ids = np.fromiter((self.ids[t] for t in tokens if t), np.int64)
        del tokens
        codes = getattr(self, f"_codes_{self.n}")(ids)
        self.parts.append(np.unique(codes, return_counts=True))
        self.size += len(self.parts[-1][0])
        self.total += len(codes)

    def _hash(self) -> np.ndarray:
        """Hashes of all words so far."""
        new = list(islice(self.ids, len(self.hashes), None))
        self.hashes = np.concatenate([self.hashes, word_hashes(self.lang, new)])
        return self.hashes

    def _codes_1(self, ids: np.ndarray) -> np.ndarray:
        return ids[ids > 0]

    def _codes_2(self, ids: np.ndarray) -> np.ndarray:
        good = in_filter(self.known, (self._hash() & self.mask).astype(np.int64))
        good[0] = False
        at = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
        return ids[at] << ID_BITS | ids[at + 1]

    def _codes_3(self, ids: np.ndarray) -> np.ndarray:
        h = self._hash()[ids]
        good = in_filter(self.known, (pair_hashes(h[:-1], h[1:]) & self.mask).astype(np.int64))
        good &= (ids[:-1] > 0) & (ids[1:] > 0)
        at = np.flatnonzero(good[:-1] & good[1:])
        return ids[at] << 2 * ID_BITS | ids[at + 1] << ID_BITS | ids[at + 2]

    def combine(self) -> None:
        if len(self.parts) > 1:
            codes, counts = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(codes, kind="stable")  # merges sorted runs
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            self.parts = [(codes[first], np.add.reduceat(counts, first))]
            self.size = len(first)

    def batches(self):
        """What is held, as rows; then nothing is."""
        self.combine()
        names = pa.array([w.decode("utf-8", "replace") for w in self.ids], pa.string())
        for codes, counts in self.parts:
            for k in range(0, len(codes), 50_000):
                part = codes[k : k + 50_000]
                words = [part >> (self.n - 1 - j) * ID_BITS & (1 << ID_BITS) - 1 for j in range(self.n)]
                yield self._rows([names.take(pa.array(w)) for w in words], counts[k : k + 50_000])
        if self.n == 1 and self.total:
            yield self._rows([pa.nulls(1, pa.string())], [self.total])
        self.clear()

    def _rows(self, words, counts) -> pa.RecordBatch:
        words += [pa.nulls(len(counts), pa.string())] * (3 - len(words))
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(counts), pa.string()), *words, pa.array(counts, pa.int64())], ["lang", "w1", "w2", "w3", "f"])


def counted(docs: DataFrame, n: int, known: np.ndarray | None, bits: int) -> DataFrame:
    """lang, w1 to w3 and f in parts that still have to be summed; for words also a row without words that counts all."""
    filter_ = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def rows(batches):
        held: dict[str, Counts] = {}
        texts, size = defaultdict(list), 0

        def take():
            for lang, parts in texts.items():
                counts = held.setdefault(lang, Counts(lang, n, filter_ and filter_.value, bits))
                for raw in slices(b"\xff".join(parts), BLOCK, n):
                    counts.add(raw)
                    if counts.size > 2 * HELD:
                        counts.combine()
                    if counts.size > HELD or len(counts.ids) > WORDS:
                        yield from counts.batches()
            if sum(c.size for c in held.values()) > 2 * HELD:
                for counts in held.values():
                    yield from counts.batches()
            if len(held) > LANGS:
                for counts in held.values():
                    yield from counts.batches()
                held.clear()

        for part, data, offsets in text_blocks(batches):
            raw = data.tobytes().translate(FOLD)
            for k, lang in enumerate(part.column(0).to_pylist()):
                texts[lang].append(raw[offsets[k] : offsets[k + 1]])
            size += len(raw)
            if size >= BLOCK:
                yield from take()
                texts, size = defaultdict(list), 0
        yield from take()
        for counts in held.values():
            yield from counts.batches()

    return docs.mapInArrow(rows, "lang string, w1 string, w2 string, w3 string, f long")


def frequent(docs: DataFrame, n: int, known: np.ndarray | None, least: int, bits: int) -> DataFrame:
    keys = ["lang", "w1", "w2", "w3"][: n + 1]
    summed = counted(docs, n, known, bits).groupBy(*keys).agg(F.sum("f").alias("f"))
    summed = summed.select("lang", *[F.col(w) if w in keys else F.lit(None).cast("string").alias(w) for w in ("w1", "w2", "w3")], "f")
    return stored(summed.filter((F.col("f") >= least) | F.col("w1").isNull()), f"phrases-{n}")


def filter_of(phrases: DataFrame, n: int, bits: int) -> np.ndarray:
    def rows(batches):
        mask = np.uint64(bits - 1)
        for b in batches:
            by_lang = defaultdict(list)
            for lang, *words in zip(*(b[c].to_pylist() for c in ("lang", "w1", "w2")[: n + 1])):
                by_lang[lang].append([w.encode() for w in words])
            for lang, words in by_lang.items():
                h = [word_hashes(lang, list(column)) for column in zip(*words)]
                h = h[0] if n == 1 else pair_hashes(*h)
                yield pa.RecordBatch.from_arrays([pa.array((h & mask).astype(np.int64))], ["spot"])

    return bit_filter(phrases.filter("w1 IS NOT NULL").select("lang", "w1", "w2").mapInArrow(rows, "spot long"), "spot", bits)


WALKED = "lang string, w1 string, w2 string, w3 string, f long, one long, two long, extension long"


def walked(phrases: DataFrame, order: list[str]) -> DataFrame:
    """Each phrase of two or three words with the counts of the first word and pair in ``order``, and its extensions.

    ``order`` names the columns k1, k2, k3 of the stream. A row with only ``extension`` set is the heaviest triple a range
    holds for a pair that stands in an earlier one.
    """
    n_ranges = max(phrases.count() // RANGE_ROWS, int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["lang", "k1", "k2", "k3"]
    stream = phrases.select("lang", *[F.col(c).alias(k) for c, k in zip(order, keys[1:])], "w1", "w2", "w3", "f")
    ranged = stream.repartitionByRange(n_ranges, *keys).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "phrase-stream")
    heads = ranged.filter("k3 IS NULL").groupBy("part", F.col("k2").isNull().alias("single"))
    lasts = heads.agg(F.max(F.struct("lang", "k1", "k2", "f")).alias("m")).orderBy("part").collect()
    before, single, pair, at = {}, None, None, 0
    for r in [*lasts, None]:
        while r is None and at <= n_ranges or r is not None and at <= r["part"]:
            before[at] = (single, pair)
            at += 1
        if r is None:
            break
        if r["single"]:
            single = (r["m"]["lang"], r["m"]["k1"], r["m"]["f"])
        else:
            pair = (r["m"]["lang"], r["m"]["k1"], r["m"]["k2"], r["m"]["f"])
    before = phrases.sparkSession.sparkContext.broadcast(before)

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending")])  # joins the chunks
        by = pc.sort_indices(table, [(k, "ascending") for k in keys], null_placement="at_start")
        table = table.take(by)
        single, pair = before.value.get(table["part"][0].as_py(), (None, None))
        out, place, early = [], {}, {}
        for lang, k1, k2, k3, w1, w2, w3, f in zip(*(table[c].to_pylist() for c in [*keys, "w1", "w2", "w3", "f"])):
            if k2 is None:
                single = (lang, k1, f)
                continue
            one = single[2] if single and single[:2] == (lang, k1) else None
            if k3 is None:
                pair = (lang, k1, k2, f)
                place[lang, k1, k2] = len(out)
                out.append([lang, w1, w2, None, f, one, None, 0])
                continue
            two = pair[3] if pair and pair[:3] == (lang, k1, k2) else None
            out.append([lang, w1, w2, w3, f, one, two, 0])
            key = (lang, k1, k2)
            if key in place:
                held = out[place[key]]
                held[7] = max(held[7], f)
            else:
                early[key] = max(early.get(key, 0), f)
        forward = order[0] == "w1"
        for (lang, k1, k2), f in early.items():
            out.append([lang, *((k1, k2) if forward else (k2, k1)), None, None, None, None, f])
        columns = list(zip(*out)) if out else [[]] * 8
        types = [pa.string()] * 4 + [pa.int64()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in WALKED.split(", ")])

    return ranged.groupBy("part").applyInArrow(walk, WALKED)


SCORED = "lang string, phrase string, a long, l long, r long, n long, score long"


def scored(batches):
    """The lowest-scoring cut of each phrase, in whole numbers of any size."""
    for b in batches:
        out = []
        rows = zip(*(b[c].to_pylist() for c in ("lang", "phrase", "f", "l1", "r1", "l2", "r2", "n")))
        for lang, phrase, a, l1, r1, l2, r2, n in rows:
            cuts = [(1_000_000 * a * a // (l * r), k, l, r) for k, l, r in ((1, l1, r1), (2, l2, r2)) if l is not None]
            score, _, left, right = min(cuts)
            out.append((lang, phrase, a, left, right, n, score))
        columns = list(zip(*out)) if out else [[]] * 7
        types = [pa.string()] * 2 + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in SCORED.split(", ")])


def candidates(docs: DataFrame, least: int = LEAST, share: int = SHARE, bits: int = FILTER_BITS) -> DataFrame:
    """All candidates that stay, unranked: lang, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce(q("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(q("text"), F.lit("")).alias("text"))
    one = frequent(docs, 1, None, least, bits)
    two = frequent(docs, 2, filter_of(one, 1, bits), least, bits)
    three = frequent(docs, 3, filter_of(two, 2, bits), least, bits)
    totals = one.filter("w1 IS NULL").select("lang", F.col("f").alias("n"))
    words = one.filter("w1 IS NOT NULL")
    forward = words.unionByName(two).unionByName(three)
    last = F.coalesce("w3", "w2", "w1").alias("v1")
    middle = F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1")).alias("v2")
    backward = forward.select("*", last, middle, F.when(F.col("w3").isNotNull(), F.col("w1")).alias("v3"))
    prefix = stored(walked(forward, ["w1", "w2", "w3"]), "phrase-prefixes")
    suffix = stored(walked(backward, ["v1", "v2", "v3"]), "phrase-suffixes")

    phrase = F.concat_ws(" ", "w1", "w2", "w3").alias("phrase")
    left = prefix.filter("f IS NOT NULL").select("lang", phrase, F.col("w3").isNull().alias("pair"), "f", F.col("one").alias("l1"), F.col("two").alias("l2"))
    pair = F.col("w3").isNull()
    right = suffix.filter("f IS NOT NULL").select(
        "lang", phrase, F.when(pair, F.col("one")).otherwise(F.col("two")).alias("r1"), F.when(~pair, F.col("one")).alias("r2")
    )
    longer = prefix.unionByName(suffix).filter("extension > 0").groupBy("lang", phrase).agg(F.max("extension").alias("longer"))
    merged = left.hint("merge").join(right, ["lang", "phrase"]).join(longer.hint("merge"), ["lang", "phrase"], "left")
    stays = F.coalesce(100 * F.col("longer") < share * F.col("f"), F.lit(True))
    merged = merged.filter(stays).join(totals, "lang")
    return merged.select("lang", "phrase", "f", "l1", "r1", "l2", "r2", "n").mapInArrow(scored, SCORED)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = candidates(docs, least, share, bits).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, i.ws[i] AS w1, i.ws[i + 1] AS w2, i.ws[i + 2] AS w3 FROM i),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY ALL),
c AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 b
    JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2
    WHERE b.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = b.lang AND 100 * t.f >= 50 * b.f
      AND ((t.w1 = b.w1 AND t.w2 = b.w2) OR (t.w2 = b.w1 AND t.w3 = b.w2)))
  UNION ALL
  SELECT b.lang, b.w1 || ' ' || b.w2 || ' ' || b.w3, b.f, 1, x.f, y.f FROM f3 b
    JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f2 y ON y.lang = b.lang AND y.w1 = b.w2 AND y.w2 = b.w3
  UNION ALL
  SELECT b.lang, b.w1 || ' ' || b.w2 || ' ' || b.w3, b.f, 2, x.f, y.f FROM f3 b
    JOIN f2 x ON x.lang = b.lang AND x.w1 = b.w1 AND x.w2 = b.w2 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w3),
s AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM c),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
