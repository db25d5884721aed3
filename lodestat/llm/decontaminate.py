"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is held against training windows.

Words are runs of ASCII letters and digits (capitals folded) and of all non-ASCII characters. A benchmark item
gives all its windows of ``window`` consecutive words; an item with fewer words is one shorter window. Each
training text is scanned once; window hashes found in the set are verified on the words themselves, so hash
collisions never count. All words inside an occurrence of a window are hit.

The set is broadcast only while its measured size is within ``set_bytes``; beyond that it is dealt by hash into
blocks of that size, each block scans the texts in a pass of its own, and hits are merged per text.

Defined cases: a null or empty text has no words and no hits; null item ids and null item texts take no part;
repeated items give the same windows and each id counts once; repeated document rows give repeated result rows;
empty tables give empty or clean results; other columns of either table are ignored or kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import RollingHash, fresh, mixed, q, stored, text_blocks, word_bounds

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
# Word bytes with capitals folded; everything else becomes a space.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
STEP = np.uint64(0xD6E8FEB86659FD93)
SET_BYTES = 32 << 20


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    factor = np.uint64(1)
    for j in range(n if len(out) else 0):
        out += words[j : j + len(out)] * factor
        factor = np.uint64((int(factor) * int(STEP)) & 0xFFFFFFFFFFFFFFFF)
    return mixed(out)


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of the benchmark: n, words (space-joined UTF-8) and the ids of the items that hold them."""

    def windows(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().translate(NORMAL).split()
                n = min(window, len(words))
                if n:
                    rows += [(n, b" ".join(words[i : i + n]), item) for i in range(len(words) - n + 1)]
            n, words, item = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int32()), pa.array(words, pa.binary()), pa.array(item, pa.string())], ["n", "words", "item"]
            )

    items = benchmark.select(q(id_col).cast("string").alias("item"), q(text_col).alias("text")).dropna()
    return (
        items.mapInArrow(windows, "n int, words binary, item string")
        .groupBy("n", "words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


class Matcher:
    """Finds the windows of one set in blocks of texts."""

    def __init__(self, entries: list[tuple[int, bytes, tuple[str, ...]]]) -> None:
        self.items: dict[bytes, tuple[str, ...]] = {words: items for _, words, items in entries}
        self.rolling = RollingHash()
        self.sets = {}
        for n in sorted({e[0] for e in entries}):
            texts = [words for k, words, _ in entries if k == n]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.cumsum([0, *map(len, texts)])
            starts, ends, _ = word_bounds(WORD[data], offsets)
            hashes = np.sort(window_hashes(self.rolling.ranges(self.rolling.prefix(data), starts, ends), n)[::n])
            seen = np.zeros(1 << 20, bool)
            seen[hashes >> np.uint64(44)] = True
            self.sets[n] = hashes, seen

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: number of words, hit words as byte ranges, ids of the items found."""
        plain = data.tobytes().translate(NORMAL)
        codes = np.frombuffer(plain, np.uint8)
        starts, ends, owner = word_bounds(WORD[codes], offsets)
        n_texts = len(offsets) - 1
        counts = np.bincount(owner, minlength=n_texts)
        hit = np.zeros(len(starts) + 1, np.int64)
        found: dict[int, set[str]] = {}
        words = self.rolling.ranges(self.rolling.prefix(codes), starts, ends) if self.sets and len(starts) else starts
        for n, (hashes, seen) in self.sets.items() if len(starts) else ():
            h = window_hashes(words, n)
            at = np.flatnonzero(seen[h >> np.uint64(44)])
            at = at[owner[at] == owner[at + n - 1]]
            near = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            for i in at[hashes[near] == h[at]].tolist():
                items = self.items.get(b" ".join(plain[starts[i] : ends[i + n - 1]].split()))
                if items:
                    hit[i] += 1
                    hit[i + n] -= 1
                    found.setdefault(int(owner[i]), set()).update(items)
        return counts, np.cumsum(hit[:-1]) > 0, starts, ends, owner, found


HITS = "__n_words long, __n_hit long, __spans array<struct<start:long,end:long>>, __items array<string>"


def _scan(docs: DataFrame, text_col: str, matcher) -> DataFrame:
    """``docs`` with the counts, merged hit spans (byte offsets) and item ids of each row."""

    def rows(batches):
        m = None
        for part, data, offsets in text_blocks(batches, text_col):
            m = m or Matcher(matcher.value)
            counts, hit, starts, ends, owner, found = m.scan(data, offsets)
            n = len(offsets) - 1
            n_hit = np.bincount(owner[hit], minlength=n) if len(owner) else np.zeros(n, np.int64)
            spans = [[] for _ in range(n)]
            if hit.any():
                first = hit.copy()
                first[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
                last = hit.copy()
                last[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
                for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist()):
                    k = int(owner[a])
                    spans[k].append({"start": int(starts[a] - offsets[k]), "end": int(ends[b] - offsets[k])})
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.array(counts, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(spans, span),
                    pa.array([sorted(found.get(k, ())) for k in range(n)], pa.list_(pa.string())),
                ],
                [*part.schema.names, "__n_words", "__n_hit", "__spans", "__items"],
            )

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{schema}, {HITS}")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``docs`` with ``__n_words``, ``__n_hit``, ``__spans`` (byte ranges of hit words) and ``__items`` (ids found)."""
    spark = docs.sparkSession
    windows = stored(benchmark_windows(benchmark, window, item_col, item_text_col), "benchmark-windows")
    size = F.sum(F.length("words") + 100 + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 60))
    total = windows.agg(size).first()[0] or 0
    blocks = max(1, -(-total // set_bytes))

    def sent(part: DataFrame):
        return spark.sparkContext.broadcast([(r.n, bytes(r.words), tuple(r.items)) for r in part.collect()])

    if blocks == 1:
        return _scan(docs, text_col, sent(windows))
    key, passes = fresh(docs, "__key"), []
    keyed = docs.select(F.sha2(F.coalesce(q(text_col), F.lit("")), 256).alias(key), q(text_col).alias("text"))
    for b in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        hits = _scan(keyed, "text", sent(part)).filter("__n_hit > 0").select(key, "__spans", "__items")
        passes.append(stored(hits.dropDuplicates([key]), "benchmark-hits"))
    merged = passes[0]
    for more in passes[1:]:
        merged = merged.unionByName(more)
    merged = merged.groupBy(key).agg(
        F.flatten(F.collect_list("__spans")).alias("__all"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
    )
    empty = _scan(docs, text_col, spark.sparkContext.broadcast([])).drop("__n_hit", "__spans", "__items")
    joined = empty.withColumn(key, F.sha2(F.coalesce(q(text_col), F.lit("")), 256)).join(merged, key, "left")
    return _united(joined, text_col).drop(key)


def _united(joined: DataFrame, text_col: str) -> DataFrame:
    """Spans of several passes laid over each other, and their words counted again."""
    fields = [f for f in joined.schema.fields if f.name not in ("__all", "__items", "__n_words")]
    names = [f.name for f in fields]

    def rows(batches):
        for part, data, offsets in text_blocks(batches, text_col):
            get = lambda c: part.column(part.schema.get_field_index(c))
            n_hit, spans = [], []
            for k, raw in enumerate(get("__all").to_pylist()):
                text, own = data[offsets[k] : offsets[k + 1]].tobytes().translate(NORMAL), []
                for s in sorted((x["start"], x["end"]) for x in raw or ()):
                    # Adjacent hit words are one span, whichever pass found them.
                    if own and (s[0] <= own[-1][1] or not text[own[-1][1] : s[0]].strip()):
                        own[-1][1] = max(own[-1][1], s[1])
                    else:
                        own.append(list(s))
                n_hit.append(sum(len(text[a:b].split()) for a, b in own))
                spans.append([{"start": a, "end": b} for a, b in own])
            items = [x or [] for x in get("__items").to_pylist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(get(c) for c in names), get("__n_words"), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                [*names, "__n_words", "__n_hit", "__spans", "__items"],
            )

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    return joined.mapInArrow(rows, f"{schema}, {HITS}")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    return contamination(docs, benchmark, **options).filter("__n_hit = 0").select(*[q(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; a null text stays null."""

    @F.udf("string")
    def cut(text, spans):
        raw, at, kept = (text or "").encode(), 0, []
        for s in spans:
            kept.append(raw[at : s["start"]])
            at = s["end"]
        return b"".join([*kept, raw[at:]]).decode()

    found = contamination(docs, benchmark, text_col=text_col, **options)
    clean = F.when(F.col("__n_hit") == 0, q(text_col)).otherwise(cut(q(text_col), F.col("__spans")))
    return found.select(*[clean.alias(c) if c == text_col else q(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of the found item ids and the verdict."""
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


__all__ = ["contamination", "digest", "remove_documents", "remove_spans"]
