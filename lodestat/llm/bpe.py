"""Byte-pair encoding of whole texts by content-defined chunks, each shared chunk encoded once, and decoding.

1. A hash of each 16 bytes cuts texts into chunks of about 600 bytes, so copies of a passage fall into the same chunks
   wherever they stand. Chunk digests are counted; those met twice are shared. Their bits go to all tasks in a filter of
   fixed size. A chunk that passes it wrongly is only treated as a shared one.
2. Shared chunks are grouped by digest and each is encoded once.
3. A text is a sequence of segments: references to shared chunks, and the stretches between them, encoded in place. A
   reference meets its chunk in a join on the digest, in which Spark splits hot chunks; segments are then brought
   together per text. Texts without shared chunks are encoded where they are and never move.
4. Repair. A cut may lie in the middle of a word, a character sequence that normalisation would merge, or a special token.
   No token, rule of the splitting or normalisation or special name reaches across white space, so a segment's ids hold
   from its first to its last white space, whatever stands around it. What lies outside, from the last white space of
   one segment to the first of a later one, is encoded anew; the window grows over whole segments until white
   space stands at both ends, where both encodings agree. So the ids are exactly those of the whole text.

Ids are moved as 16-bit integers where the vocabulary allows. Words met before are looked up in the task.

Defined cases: a null text is empty and has no ids; repeated rows each give a row; a text without white space is one window;
empty tables give no rows; other columns are kept, except one named like a result column, which is replaced.
Chunks are told apart by 128-bit digests.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import FILTER_BITS, RollingHash, bit_filter, fresh, identified, in_filter, q, scanned, stored, text_blocks

WINDOW = 16
CHUNK = 512
LEAST = 128
SLICE = 1 << 20
HASHED = 1 << 17  # bytes hashed at a time: the arrays of eight times that size stay small and near
KNOWN_WORDS = 80_000  # in each of two generations
MARK = "~"
TOLD_APART = 50_000

# The characters that the tokenizer's white space class holds.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Printable ASCII and the letters of Latin-1, which no normalisation changes but for lower case; no name of a special token.
PLAIN = re.compile("(?!.*<\\|)[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
# How the vocabulary splits such characters once they are lower case.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^0-9a-z\xdf-\xf6\xf8-\xff]+"


def plain_split(model):
    """The splitting of plain words, if the model normalises and splits as that assumes; else None."""
    if model.normalizer is None or model.pre_tokenizer is None:
        return None
    steps = [n.get("type") for n in json.loads(model.normalizer.__getstate__()).get("normalizers", [])]
    splits = json.loads(model.pre_tokenizer.__getstate__()).get("pretokenizers") or [{}]
    wanted = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    fits = steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": wanted} and splits[0].get("invert")
    return re.compile(PIECES).findall if fits else None


class Words:
    """Ids of texts, word by word between white space, as packed integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.space = re.compile(f"[{SPACES}]+")
        self.plain = re.compile("[\x1c-\x1f]").search
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        mark = self.model.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.split = plain_split(self.model)
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.last = np.array([self.model.id_to_token(i).endswith(suffix) for i in range(size)]) if self.split and suffix else None

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words not met before: those of plain characters by their pieces, which recur more than words do."""
        if self.split is None:
            return self.encoded(words)
        cut = {w: self.split(w.lower()) for w in words if PLAIN(w)}
        new = {p for parts in cut.values() for p in parts if p not in self.pieces}
        if len(self.pieces) > KNOWN_WORDS:
            self.pieces.clear()
            new = {p for parts in cut.values() for p in parts}
        self.pieces.update(self.ended(list(new)))
        of = self.pieces
        out = {w: b"".join([of[p] for p in parts]) for w, parts in cut.items()}
        if len(cut) < len(words):
            out |= self.encoded([w for w in words if w not in cut])
        return out

    def ended(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the model splits no further, many in one call: the last token of each is one that ends a piece."""
        if self.last is None:
            return self.encoded(pieces)
        out, size = {}, self.kind.itemsize
        for k in range(0, len(pieces), 500):
            part = pieces[k : k + 500]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = size * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(part) or ends[-1] != ids.nbytes:
                out |= self.encoded(part)
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            out.update((p, raw[a:b]) for p, a, b in zip(part, [0, *ends], ends))
        return out

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the model, many in one call: a word of its own with one id stands between them."""
        out, odd = {}, words
        if self.mark is not None:
            joined = [w for w in words if MARK not in w]
            odd = [w for w in words if MARK in w]
            for k in range(0, len(joined), 500):
                part = joined[k : k + 500]
                ids = np.array(self.model.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, self.kind)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) != len(part) - 1:
                    odd += part
                    continue
                raw, size = ids.tobytes(), self.kind.itemsize
                starts, ends = [0, *(size * (cuts + 1)).tolist()], [*(size * cuts).tolist(), len(raw)]
                out.update((w, raw[a:b]) for w, a, b in zip(part, starts, ends))
        for w in odd:
            out[w] = np.array(self.model.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        return out

    def packed(self, text: str) -> bytes:
        # Python's own split takes four separators more.
        parts = text.split() if self.plain(text) is None else self.space.split(text)
        out = list(map(self.known.get, parts))
        if None in out:
            missing = {w for w, ids in zip(parts, out) if ids is None}
            made = {w: ids for w in missing if (ids := self.older.get(w)) is not None}
            made |= self.fresh([w for w in missing if w not in made])
            out = [made[w] if ids is None else ids for w, ids in zip(parts, out)]
            if len(self.known) > KNOWN_WORDS:
                self.older, self.known = self.known, {}
            self.known.update((w, ids) for w, ids in made.items() if len(w) < 64)
        return b"".join(out)

    def segment(self, text: str) -> tuple[str, bytes | None, str]:
        """Text before the first white space, ids up to the last white space, text after it; all in front where there is none."""
        first = self.space.search(text)
        if first is None:
            return text, None, ""
        last = max(map(text.rfind, SPACES))
        return text[: first.start()], self.packed(text[first.start() : last]), text[last + 1 :]

    def joined(self, segments) -> bytes:
        """Ids of the whole text from its segments, in order."""
        out, window = [], []
        for head, ids, tail in segments:
            window.append(head)
            if ids is not None:
                out += [self.packed("".join(window)), ids]
                window = [tail]
        out.append(self.packed("".join(window)))
        return b"".join(out)


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One per worker process, which runs many tasks: the vocabulary is read once."""
    return Words(path)


@lru_cache(maxsize=1)
def names_of(path: str) -> pa.Array:
    """The tokens by id."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return pa.array([model.id_to_token(i) for i in range(model.get_vocab_size(with_added_tokens=True))], pa.string())


def cut_places(data: np.ndarray, powers: tuple[np.uint64, ...]) -> np.ndarray:
    """Ends of the windows of a byte array whose hash calls for a cut, never within a character."""
    found, count = [], WINDOW // 8
    for start in range(0, max(len(data) - WINDOW, 0), HASHED):
        part = data[start : start + HASHED + WINDOW]
        raw, ends = part[:-1].tobytes(), []
        for shift in range(min(8, len(part) - WINDOW)):  # aligned words of eight bytes, from every place on
            words = np.frombuffer(raw[shift : shift + (len(raw) - shift) // 8 * 8], "<u8")
            n = len(words) - count + 1
            h = words[:n] * powers[0]
            for k in range(1, count):
                h += words[k : k + n] * powers[k]
            ends.append(np.flatnonzero(h < np.uint64((1 << 64) // CHUNK)) * 8 + (shift + WINDOW))
        ends = np.sort(np.concatenate(ends))
        found.append(start + ends[(part[ends] & 0xC0) != 0x80])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def powers() -> tuple[np.uint64, ...]:
    """Odd factors of the words of a window, which move their entropy to the high bits: those decide on a cut."""
    return tuple(np.uint64(pow(RollingHash.BASE, k + 1, 1 << 64)) for k in range(WINDOW // 8))


def chunked(data: np.ndarray, offsets: np.ndarray, table: tuple[np.uint64, ...]):
    """For every text of a block the bounds of its chunks; an empty text has none."""
    places = cut_places(data, table).tolist()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        bounds, at = [start], bisect.bisect_left(places, start + max(LEAST, WINDOW))
        while at < len(places) and places[at] <= end - LEAST:
            bounds.append(places[at])
            at = bisect.bisect_left(places, places[at] + LEAST)
        yield [*bounds, end] if end > start else []


def key_of(chunk: bytes) -> bytes:
    return hashlib.md5(chunk, usedforsecurity=False).digest()


def spots(keys: list[bytes], bits: int) -> np.ndarray:
    return np.fromiter((int.from_bytes(k[:8], "little") for k in keys), np.uint64, len(keys)).astype(np.uint64) & np.uint64(bits - 1)


def blocks(batches):
    """Per text: batch, row in it, its bytes' chunks and their keys."""
    table = powers()
    for part, data, offsets in text_blocks(batches, "__text"):
        raw = data.tobytes()
        for k, bounds in enumerate(chunked(data, offsets, table)):
            chunks = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
            yield part, k, chunks, [key_of(c) for c in chunks]


def keys_met(texts: DataFrame) -> DataFrame:
    def rows(batches):
        held = []
        for *_, keys in blocks(batches):
            held += keys
            if len(held) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["key"])
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["key"])

    return texts.select("__text").mapInArrow(rows, "key binary")


SEGMENT = "head string, ids binary, tail string"


def shared_chunks(texts: DataFrame, known, bits: int, path: str) -> DataFrame:
    """key, head, ids, tail of every chunk in the filter, each encoded once."""

    def rows(batches):
        told, held, size = set(), [], 0
        for _, _, chunks, keys in blocks(batches):
            for hit, chunk, key in zip(in_filter(known.value, spots(keys, bits).astype(np.int64)), chunks, keys):
                if hit and key not in told:
                    told.add(key)
                    held.append((key, chunk))
                    size += len(chunk)
            if size > SLICE:
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.binary()) for i in (0, 1)], ["key", "chunk"])
                held, size = [], 0
            if len(told) > TOLD_APART:
                told.clear()
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.binary()) for i in (0, 1)], ["key", "chunk"])

    def encoded(batches):
        words = words_of(path)
        for b in batches:
            made = [words.segment(c.decode("utf-8", "replace")) for c in b["chunk"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], *segment_arrays(made)], ["key", "head", "ids", "tail"])

    distinct = texts.select("__text").mapInArrow(rows, "key binary, chunk binary").groupBy("key").agg(F.first("chunk").alias("chunk"))
    return stored(distinct.mapInArrow(encoded, f"key binary, {SEGMENT}"), "bpe-chunks")


def segment_arrays(made):
    return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.string())]


def references(texts: DataFrame, known, bits: int) -> DataFrame:
    """row, place and key of every chunk in the filter."""

    def rows(batches):
        held = [], [], []
        for part, k, _, keys in blocks(batches):
            hits = np.flatnonzero(in_filter(known.value, spots(keys, bits).astype(np.int64)))
            if len(hits):
                row = part.column(1)[k].as_py()
                held[0].extend([row] * len(hits))
                held[1].extend(hits.tolist())
                held[2].extend(keys[h] for h in hits)
            if len(held[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.binary())], ["row", "place", "key"])
                held = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.binary())], ["row", "place", "key"])

    return texts.select("__text", "__row").mapInArrow(rows, "row long, place long, key binary")


def _schema(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in keep)


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", scan: bool = False, bits: int = FILTER_BITS) -> DataFrame:
    """The other columns of ``docs`` and ``ids``, those of the whole text.

    ``scan`` says that ``docs`` is a plain scan of Parquet files, read in several passes; otherwise it is written first.
    """
    path = path or tokenizer_path()
    keep = [c for c in docs.columns if c != text_col and c.lower() != "ids"]
    text, row = fresh(docs, "__text"), fresh(docs, "__row")
    renamed = docs.select(*[q(c) for c in keep], q(text_col).alias(text))
    numbered = scanned(renamed, row) if scan else stored(identified(renamed, row), "bpe-texts")
    texts = numbered.select(q(text).alias("__text"), q(row).alias("__row"))
    met = keys_met(texts).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    wide = lambda batches: (pa.RecordBatch.from_arrays([pa.array(spots(b["key"].to_pylist(), bits).astype(np.int64))], ["spot"]) for b in batches)
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(met.select("key").mapInArrow(wide, "spot long"), "spot", bits))
    chunks = shared_chunks(texts, known, bits, path)

    others = [f for f in numbered.schema.fields if f.name in keep]
    packed_others = F.struct(*[q(f.name) for f in others]) if others else F.struct(F.lit(0).alias("__none"))
    whole = numbered.select(q(text).alias("__text"), q(row).alias("__row"), packed_others.alias("others"))
    kind = whole.schema["others"].dataType.simpleString()

    def places(batches, wanted):
        """Texts with (or without) a chunk in the filter: batch, row in it, chunks and their hits."""
        for part, k, texts_chunks, keys in blocks(batches):
            hits = in_filter(known.value, spots(keys, bits).astype(np.int64))
            if hits.any() == wanted:
                yield part, k, texts_chunks, hits

    def alone(batches):
        words = words_of(path)
        take, ids, last, size = [], [], None, 0
        for part, k, chunks_, _ in places(batches, False):
            if last is not None and (part is not last or size > SLICE):
                yield id_batch(last.column(2).take(pa.array(take, pa.int64())), ids, words.kind)
                take, ids, size = [], [], 0
            raw = b"".join(chunks_)
            last = part
            take.append(k)
            ids.append(words.packed(raw.decode("utf-8", "replace")))
            size += len(raw)
        if last is not None:
            yield id_batch(last.column(2).take(pa.array(take, pa.int64())), ids, words.kind)

    def between(batches):
        words = words_of(path)
        names = ["row", "place", "head", "ids", "tail", "others"]
        held, take, last, size = [], [], None, 0

        def batch():
            kept = last.column(2).take(pa.array(take, pa.int64()))  # a null where no text begins
            columns = [pa.array([h[i] for h in held], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, *segment_arrays([h[2] for h in held]), kept], names)

        for part, k, chunks_, hits in places(batches, True):
            if last is not None and (part is not last or size > SLICE):
                yield batch()
                held, take, size = [], [], 0
            last = part
            made, at = [], 0
            while at < len(chunks_):
                to = at
                while to < len(chunks_) and not hits[to]:
                    to += 1
                if to > at:
                    made.append((at, words.segment(b"".join(chunks_[at:to]).decode("utf-8", "replace"))))
                at = max(to, at + 1)
            row = part.column(1)[k].as_py()
            held.append((row, -1, (None, None, None)))
            held += [(row, place, segment) for place, segment in made]
            take += [k, *[None] * len(made)]
            size += sum(map(len, chunks_))
        if last is not None:
            yield batch()

    def together(batches):
        words = words_of(path)
        for b in batches:
            ids, first, size = [], 0, 0
            for k, parts in enumerate(b["parts"]):
                parts = sorted(parts.as_py(), key=lambda p: p["place"])
                ids.append(words.joined((p["head"], p["ids"], p["tail"]) for p in parts if p["place"] >= 0))
                size += len(ids[-1])
                if size > SLICE or k + 1 == b.num_rows:
                    yield id_batch(b["others"].slice(first, len(ids)), ids, words.kind)
                    ids, first, size = [], k + 1, 0

    single = whole.mapInArrow(alone, f"others {kind}, ids array<int>")
    found = references(texts, known, bits).join(chunks, "key").select("row", "place", "head", "ids", "tail", F.lit(None).cast(kind).alias("others"))
    pieces = whole.mapInArrow(between, f"row long, place long, {SEGMENT}, others {kind}").unionByName(found)
    grouped = pieces.groupBy("row").agg(
        F.collect_list(F.struct("place", "head", "ids", "tail")).alias("parts"), F.first("others", ignorenulls=True).alias("others")
    )
    joined = grouped.select("others", "parts").mapInArrow(together, f"others {kind}, ids array<int>")
    return single.unionByName(joined).select(*[F.col("others")[f.name].alias(f.name) for f in others], "ids")


def id_batch(others: pa.Array, packed: list[bytes], kind: np.dtype) -> pa.RecordBatch:
    sizes = np.array([0, *(len(p) // kind.itemsize for p in packed)], np.int64)
    flat = np.frombuffer(b"".join(packed), kind).astype(np.int32)
    return pa.RecordBatch.from_arrays([others, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))], ["others", "ids"])


def decode(encoded: DataFrame, path: str | None = None, into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids``: tokens with one space between, as the vocabulary names no decoder."""
    path = path or tokenizer_path()
    keep = [c for c in encoded.columns if c.lower() != into.lower()]

    def rows(batches):
        names = names_of(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = part["ids"]
                sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
                tokens = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), names.take(ids.flatten()))
                texts = pc.if_else(ids.is_valid(), pc.binary_join(tokens, " "), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), texts], [*keep, into])

    return encoded.select(*[q(c) for c in keep]).mapInArrow(rows, _schema(encoded, keep) + f"`{into}` string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
