"""Suffix-array dedup: every byte covered by a ``length``-byte string that also starts elsewhere goes.

A suffix is compared to ``length`` bytes, so equal windows of that many bytes are what counts. Sorting a suffix for
each byte would move each byte ``length`` times, so the suffix array is sparse:

1. A window's anchor is the leftmost ``K``-gram of least hash in it. Equal windows have equal anchors at equal
   places, so windows can only repeat where their anchor does. Consecutive windows with one anchor form a run.
   Anchors are counted (pre-aggregated per task), and runs whose anchor occurs once are done: nothing in them repeats.
2. Runs of repeated anchors are counted by content. All windows of a run that occurs twice or more repeat. What is
   left open are runs that occur once and share their anchor with other runs; of each run one copy goes on.
3. An open run is halved by the windows' distance from the anchor, so that all windows of a half hold one longer
   string, its core. Again a half whose core occurs once is done; with that, a frequent line costs nothing where
   the words around it differ.
4. The suffixes at the cores are range-partitioned by their leading bytes; Spark samples the splitters. Each bucket is
   sorted locally by a multikey quicksort: windows are split by eight-byte tokens, equal ones go on to the next token,
   single ones drop out, and what is equal after the last token repeats.
5. The halves of a core with more than ``BUCKET_RUNS`` halves are range-partitioned by the whole suffix, row and place,
   so they fill many buckets. Windows at a bucket's first and last core, one of each kind in a bucket, are compared
   across the boundaries by 128-bit fingerprints.

Defined cases: a null text is an empty one; texts shorter than ``length`` bytes keep everything; overlapping windows
count, also within a text (a long run of one byte goes whole); repeated rows are texts of their own, so both go where
they are long enough; a cut through a character leaves its other bytes; empty tables give empty results; other
columns are kept. Texts up to 256 MB.

Row numbers must not change between passes. They are the file and the row in it where ``docs`` is a plain scan of
Parquet (``scan=True``); otherwise the table is written first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import RollingHash, identified, mixed, q, scanned, stored, text_blocks

LENGTH = 200
K = 48
PLACE = (1 << 28) - 1
BUCKET_RUNS = 2000


def runs(data: np.ndarray, offsets: np.ndarray, rolling: RollingHash, length: int, k: int):
    """Runs of windows with one anchor: text, first window, number of windows, anchor, anchor hash, content hash."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data) - length + 1
    if n <= 0:
        return none
    sums = rolling.prefix(data)
    grams = (sums[k:] - sums[:-k]) * rolling.down[: len(sums) - k]
    low = grams ^ (grams >> np.uint64(29))
    low *= np.uint64(0xBF58476D1CE4E5B9)
    low = (low & ~np.uint64(PLACE)) | np.arange(len(low), dtype=np.uint64)
    # Least over `width` places, by doubling.
    width, span = length - k + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    anchor = (low & np.uint64(PLACE)).astype(np.int64)
    sizes = offsets[1:] - offsets[:-1]
    ok = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, (offsets[1:] - length + 1)[long], -1)
    ok = np.cumsum(ok)[:n] > 0
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    first[offsets[:-1][long]] = True
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    if not len(a):
        return none
    p = anchor[a]
    content = rolling.ranges(sums, a, b + length) ^ mixed((b - a + 1).astype(np.uint64) << np.uint64(32) | (p - a).astype(np.uint64))
    return np.searchsorted(offsets, a, side="right") - 1, a, b - a + 1, p, mixed(grams[p]), content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_counts(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Hashes of anchors that occur more than once."""

    def rows(batches):
        rolling, held, size = RollingHash(), [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(values), pa.array(counts.astype(np.int64))], ["anchor", "n"])

        for _, data, offsets in text_blocks(batches):
            held.append(runs(data, offsets, rolling, length, k)[4])
            size += len(held[-1])
            if size > 400_000:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    found = texts.select("text").mapInArrow(rows, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return stored(found.filter("n > 1").select("anchor"), "suffix-anchors")


def run_table(texts: DataFrame, length: int, k: int) -> DataFrame:
    """All runs: anchor, content, __row, first window and number of windows."""

    def rows(batches):
        rolling = RollingHash()
        for part, data, offsets in text_blocks(batches):
            owner, a, n, _, anchor, content = runs(data, offsets, rolling, length, k)
            row = part.column(part.schema.get_field_index("__row")).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(content), pa.array(row[owner]), pa.array(a - offsets[owner]), pa.array(n.astype(np.int32))],
                ["anchor", "content", "__row", "a", "n"],
            )

    return texts.select("__row", "text").mapInArrow(rows, "anchor long, content long, __row long, a long, n int")


def equal_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Multikey quicksort of the windows at ``starts``: a class for each window, -1 for those equal to no other.

    Windows are only compared within their ``group``.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    token = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        token = (token << np.uint64(8)) | padded[j : j + len(data) + 1]
    found = np.full(len(starts), -1, np.int64)
    at, group = np.arange(len(starts)), group.astype(np.int64)
    for depth in [*range(0, length - 8, 8), length - 8]:
        key = token[starts[at] + depth]
        order = np.lexsort((key, group))
        at, group, key = at[order], group[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else new
        at, group = at[many], group[many]
    found[at] = group
    return found


def bucket_rows(table: pa.Table, length: int, across: bool):
    """One bucket: spans of repeated windows and, if asked, windows of its first and last core for the comparison across."""
    rolling, other = RollingHash(), RollingHash()
    other.BASE = 0xD1342543DE82EF95
    size = table.column("bytes").combine_chunks()
    raw = size.to_pylist()
    n, core, row, a = (table.column(c).to_numpy() for c in ("n", "core", "__row", "a"))
    settled, shift = table.column("settled").to_numpy(zero_copy_only=False), table.column("shift").to_numpy()
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.cumsum([0, *map(len, raw)])[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = at[owner] + step
    # Equal windows have their anchor at the same place, so they share the core and the distance to it.
    names = np.unique(core, return_inverse=True)[1]
    group = names[owner] * (1 << 20) + (shift[owner] - step + (1 << 19))
    cls = equal_windows(data, starts, group, length)
    edge = ((names == names[0]) | (names == names[-1])) & across
    repeats = cls >= 0
    hit = repeats & ~settled[owner]
    # Consecutive repeated windows of a run are one span.
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    end[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    spans = row[owner[begin]], a[owner[begin]] + step[begin], a[owner[end]] + step[end] + length
    # Of the edge windows one of each class goes on; it is known to repeat if the class has several or is settled.
    out = np.flatnonzero(edge[owner])
    first = np.ones(len(out), bool)
    in_class = cls[out] >= 0
    first[in_class] = False
    if in_class.any():
        classes = out[in_class]
        first[np.flatnonzero(in_class)[np.unique(cls[classes], return_index=True)[1]]] = True
    out = out[first]
    known = repeats[out] | settled[owner[out]]
    prints = [h.ranges(h.prefix(data), starts[out], starts[out] + length) for h in (rolling, other)]
    return spans, (row[owner[out]], a[owner[out]] + step[out], known, *prints)


SORTED = "__row long, start long, end long, known boolean, f long, g long"


def sort_buckets(bucketed: DataFrame, length: int, across: bool) -> DataFrame:
    """Spans of repeated windows (``known`` is null) and the windows to compare across, from each bucket."""

    def rows(batches):
        parts = list(batches)
        if not sum(b.num_rows for b in parts):
            return
        spans, edges = bucket_rows(pa.Table.from_batches(parts), length, across)
        m, e = len(spans[0]), len(edges[0])
        nulls = lambda kind, size: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([spans[0], edges[0]])),
                pa.array(np.concatenate([spans[1], edges[1]])),
                pa.array(np.concatenate([spans[2], edges[1] + length])),
                pa.concat_arrays([nulls(pa.bool_(), m), pa.array(edges[2], pa.bool_())]),
                pa.concat_arrays([nulls(pa.int64(), m), _signed(edges[3])]),
                pa.concat_arrays([nulls(pa.int64(), m), _signed(edges[4])]),
            ],
            ["__row", "start", "end", "known", "f", "g"],
        )

    return bucketed.mapInArrow(rows, SORTED)


def open_spans(strings: DataFrame, length: int) -> DataFrame:
    """(__row, start, end) of repeated windows in runs that occur once."""
    counts = stored(strings.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1"), "suffix-cores")
    m, crowded = counts.agg(F.sum("m"), F.sum(F.when(F.col("m") > BUCKET_RUNS, F.col("m")))).first()
    lead = F.expr("substring(bytes, shift + 1)")
    live = strings.join(counts, "core").withColumn("suffix", lead)
    order = ["suffix", "__row", "a"]
    small = live.filter(F.col("m") <= BUCKET_RUNS).repartitionByRange(max(1, -(-(m or 0) // BUCKET_RUNS)), F.expr("substring(suffix, 1, size)"))
    large = live.filter(F.col("m") > BUCKET_RUNS).repartitionByRange(max(1, -(-(crowded or 0) // BUCKET_RUNS)), *order).sortWithinPartitions(*order)
    made = stored(sort_buckets(small.drop("suffix"), length, False).unionByName(sort_buckets(large.drop("suffix"), length, True)), "suffix-buckets")
    edges = made.filter("known IS NOT NULL")
    twice = edges.groupBy("f", "g").agg(F.count("*").alias("n"), F.max("known").alias("some")).filter("n > 1 OR some")
    across = edges.filter("NOT known").join(stored(twice.select("f", "g"), "suffix-across"), ["f", "g"])
    return made.filter("known IS NULL").select("__row", "start", "end").unionByName(across.select("__row", "start", "end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (__row, text): the texts that may repeat, and (__row, start, end) of all repeated windows."""
    anchors = anchor_counts(docs, length, k)
    table = stored(run_table(docs, length, k).join(anchors, "anchor"), "suffix-runs")
    kinds = table.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("__row", "a", "n")).alias("one"))
    kinds = stored(kinds, "suffix-kinds")
    twice = stored(kinds.filter("copies > 1").select("anchor", "content"), "suffix-settled")
    settled = table.join(twice, ["anchor", "content"]).select("__row", F.col("a").alias("start"), (F.col("a") + F.col("n") + (length - 1)).alias("end"))
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.count_if(F.col("copies") == 1).alias("single"))
    shared = stored(shared.filter("m > 1 AND single > 0").select("anchor"), "suffix-open")
    opened = stored(kinds.join(shared, "anchor").select(F.col("one.__row").alias("__row"), F.col("one.a").alias("a"), F.col("one.n").alias("n"), (F.col("copies") > 1).alias("settled")), "suffix-compared")
    rows = opened.select("__row").unionByName(table.join(twice, ["anchor", "content"]).select("__row")).distinct()
    texts = stored(docs.select("__row", "text").join(rows, "__row"), "suffix-texts")

    half = (length - k + 1) // 2

    def cut(batches):
        rolling = RollingHash()
        for part, data, offsets in text_blocks(batches):
            columns, raw = ([], [], [], [], [], [], []), []
            for i, own in enumerate(part.column(part.schema.get_field_index("own")).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                _, starts, _, places, _, _ = runs(text, np.array([0, len(text)]), rolling, length, k)
                place = dict(zip(starts.tolist(), places.tolist()))
                row = part.column(0)[i].as_py()
                for x in own:
                    p, last = place[x["a"]], x["a"] + x["n"] - 1
                    near, far = (max(x["a"], p - half), last), (x["a"], min(last, p - half - 1))
                    for (first, final), start, size in ((near, p, length - half), (far, p - half - 1, half + 1 + k)):
                        if first <= final:
                            core = xxhash.xxh64_intdigest(text[start : start + size].tobytes(), size) - (1 << 63)
                            for out, v in zip(columns, (core, row, first, final - first + 1, x["settled"], start - first, size)):
                                out.append(v)
                            raw.append(text[first : final + length].tobytes())
            kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
            arrays = [*(pa.array(c, t) for c, t in zip(columns, kinds_of)), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["core", "__row", "a", "n", "settled", "shift", "size", "bytes"])

    own = opened.groupBy("__row").agg(F.collect_list(F.struct("a", "n", "settled")).alias("own"))
    strings = texts.join(own, "__row").select("__row", "text", "own").mapInArrow(
        cut, "core long, __row long, a long, n int, settled boolean, shift int, size int, bytes binary"
    )
    return texts, settled.unionByName(open_spans(stored(strings, "suffix-strings"), length))


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = K, text_col: str = "text", scan: bool = False) -> DataFrame:
    """The other columns of ``docs`` with ``__n_bytes``, ``__n_removed``, ``__n_spans``, ``__sha256`` and ``__kept`` of the bytes that stay.

    ``__kept`` is null where nothing was removed (the text stays as it is).
    """
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.withColumn("__text", F.coalesce(q(text_col), F.lit("")))
    rows = scanned(rows, "__row") if scan else stored(identified(rows, "__row"), "suffix-documents")
    texts, spans = repeated_spans(rows.select("__row", F.col("__text").alias("text")), length, k)

    def rest(batches):
        for part, data, offsets in text_blocks(batches):
            out = [[], [], [], []]
            for i, own in enumerate(part.column(part.schema.get_field_index("own")).to_pylist()):
                text, marks = data[offsets[i] : offsets[i + 1]], np.zeros(offsets[i + 1] - offsets[i] + 1, np.int64)
                pairs = np.array([(s["start"], s["end"]) for s in own], np.int64)
                np.add.at(marks, pairs[:, 0], 1)
                np.add.at(marks, pairs[:, 1], -1)
                gone = np.cumsum(marks)[:-1] > 0
                kept = text[~gone].tobytes()
                n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                for o, v in zip(out, (int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(o, t) for o, t in zip(out, kinds))], ["__row", "__n_removed", "__n_spans", "__cut", "__kept"])

    per_row = spans.groupBy("__row").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    cut = texts.join(per_row, "__row").select("__row", "text", "own").mapInArrow(rest, "__row long, __n_removed long, __n_spans long, __cut string, __kept binary")
    base = rows.select("__row", *[q(c) for c in keep], F.octet_length("__text").cast("long").alias("__n_bytes"), F.sha2("__text", 256).alias("__whole"))
    none = F.lit(0).cast("long")
    return base.join(cut, "__row", "left").select(
        *[q(c) for c in keep],
        "__n_bytes",
        F.coalesce("__n_removed", none).alias("__n_removed"),
        F.coalesce("__n_spans", none).alias("__n_spans"),
        F.coalesce("__cut", "__whole").alias("__sha256"),
        "__kept",
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.col("__sha256").alias("kept_sha256"))
