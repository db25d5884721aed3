"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Each document's ids, followed by the end id, are cut into pieces of at most ``length`` tokens; only longer
   documents are cut, and their first piece may be shorter.
2. Spark range-sorts the pieces, longest first, over sampled splitters; a piece's rank is its place in that order.
3. Bulk-synchronous best fit. A piece is known to the matching by its length alone, so documents and gaps are held
   as runs: so many pieces of one length, so many sequences with the same gap, both in order of rank. A round takes
   the longest remaining run of pieces. A successor sweep over the ordered gap runs finds the smallest gaps that
   hold the length; all sequences of a run are filled at once, as often as the length fits. Pieces that want the
   same gap are told apart by rank: the lower rank goes first. The gaps are updated, what found no gap opens new
   sequences, and the next round follows. This gives exactly the sequences of best-fit decreasing.
   Lengths and gaps have at most ``length`` values and a round adds at most two runs, so the state is bounded by
   the sequence length, whatever the number of documents; only counts by length reach the driver.
4. Every piece finds its sequence and offset from its rank by arithmetic on the run that took it (a binary search
   in the broadcast table of moves), in one pass without a shuffle.

Defined cases: a null text is an empty one (one piece holding the end id); equal lengths are ordered by row number,
so repeated rows are packed like any others; empty tables give no sequences; other columns are kept, but for those
named like a result column.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import identified, q, stored, text_blocks

LENGTH = 2048
END = 0
KNOWN_WORDS = 400_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Token ids of whole texts as packed 32-bit integers.

    A single space between two visible characters always begins a token of its own, so a text is encoded word by
    word and words met before are looked up. Texts with other white space beside a space are encoded whole, and
    those with a special token's name by the tokenizer itself. ``ranks`` names the same vocabulary as merge ranks.
    """

    def __init__(self, path: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.model.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def packed(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        known = self.known
        out = [known.get(w) for w in rest]
        if not first or first[-1].isspace():
            return self.whole(text)
        if None in out:
            for k, part in enumerate(out):
                if part is None:
                    w = rest[k]
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self.whole(text)
                    part = known.get(w)
                    if part is None:
                        part = np.array(self.fast.encode_ordinary(" " + w), "<u4").tobytes()
                        if len(w) < 64:
                            if len(known) >= KNOWN_WORDS:
                                known.clear()
                            known[w] = part
                    out[k] = part
        return self.whole(first) + b"".join(out)


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` tokens."""
    first = n % length or length
    return [(0, min(first, n)), *((s, s + length) for s in range(first, n, length))]


MADE = {"piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
PIECE = [("piece", pa.int32(), "int"), ("start", pa.int64(), "long"), ("length", pa.int32(), "int"), ("ids_crc32", pa.int64(), "long")]


def pieces(
    docs: DataFrame, path: str, ranks: str | None = None, length: int = LENGTH, end: int = END, text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: the other columns of ``docs``, piece, start, length, ids_crc32 and, if asked, ids."""
    keep = [c for c in docs.columns if c != text_col and c.lower() not in MADE]
    tail = np.array([end], "<u4").tobytes()

    def rows(batches):
        tokens = None
        for part, data, offsets in text_blocks(batches, text_col):
            tokens = tokens or Tokens(path, ranks)
            take, values = [], ([], [], [], [], [])
            for k in range(len(offsets) - 1):
                packed = tokens.packed(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")) + tail
                for n, (a, b) in enumerate(cuts(len(packed) // 4, length)):
                    raw = packed[4 * a : 4 * b]
                    take.append(k)
                    for out, v in zip(values, (n, a, b - a, zlib.crc32(raw), np.frombuffer(raw, "<i4"))):
                        out.append(v)
            kept = [part.column(part.schema.get_field_index(c)).take(pa.array(take, pa.int64())) for c in keep]
            made = [pa.array(v, t) for v, (_, t, _) in zip(values, PIECE)]
            ids = [pa.array(values[4], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*kept, *made, *ids], [*keep, *(c for c, _, _ in PIECE), *(["ids"] * with_ids)])

    schema = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep]
    schema += [f"{c} {t}" for c, _, t in PIECE] + ["ids array<int>"] * with_ids
    return docs.select(*[q(c) for c in keep], q(text_col)).mapInArrow(rows, ", ".join(schema))


def match(counts: dict[int, int], length: int) -> np.ndarray:
    """Rounds of best fit over runs; ``counts`` maps piece length to number of pieces.

    Gives the moves in order of rank: first rank taken, first sequence, pieces per sequence, first offset, length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    moves, rank, opened = [], 0, 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    def fill(gap: int, first: int, n: int, size: int, left: int) -> int:
        """Put up to ``left`` pieces into ``n`` sequences with ``gap``; gives how many were put."""
        nonlocal rank
        each = gap // size
        taken = min(left, n * each)
        full, more = divmod(taken, each)
        moves.append((rank, first, each, length - gap, size))
        rank += taken
        leave(gap - each * size, first, full)
        if more:
            leave(gap - more * size, first + full, 1)
        leave(gap, first + full + bool(more), n - full - bool(more))
        return taken

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(sizes, size)
            if at < len(sizes):
                gap = sizes.pop(at)
                for first, n in gaps.pop(gap):
                    if left:
                        left -= fill(gap, first, n, size, left)
                    else:
                        leave(gap, first, n)
            else:
                n = -(-left // (length // size))
                opened += n
                left -= fill(length, opened - n, n, size, left)
    return np.array(moves, np.int64).reshape(-1, 5)


def pack(made: DataFrame, length: int = LENGTH) -> DataFrame:
    """``made`` (a row per piece with its ``length``) with ``sequence_id`` and ``offset``."""
    spark = made.sparkSession
    by_length = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = spark.sparkContext.broadcast(match(by_length, length))
    order = [F.desc("length"), F.asc("__piece_row")]
    ordered = made.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranked = stored(ordered.withColumn("__part", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND((1 << 33) - 1)), "packing-order")
    before, starts = 0, {}
    for r in ranked.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        starts[r["__part"]] = before
        before += r["n"]
    starts = spark.sparkContext.broadcast(starts)
    names = [f for f in ranked.schema.fields if f.name not in ("__part", "__at", "__piece_row")]

    def rows(batches):
        table, first = moves.value, starts.value
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            rank = get("__at").to_numpy() + np.array([first[p] for p in get("__part").to_pylist()], np.int64)
            move = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
            nth = rank - move[:, 0]
            made_by = [pa.array(move[:, 1] + nth // move[:, 2]), pa.array(move[:, 3] + nth % move[:, 2] * move[:, 4])]
            yield pa.RecordBatch.from_arrays([*(get(f.name) for f in names), *made_by], [*(f.name for f in names), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in names)
    return ranked.mapInArrow(rows, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, path: str | None = None, ranks: str | None = None, length: int = LENGTH, end: int = END, text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of all ``docs`` with their places: other columns, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    if path is None:
        path, ranks = tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")
    made = stored(identified(pieces(docs, path, ranks, length, end, text_col, with_ids), "__piece_row"), "packing-pieces")
    return pack(made, length)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces packed with ``with_ids``; a sequence is bounded by its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
