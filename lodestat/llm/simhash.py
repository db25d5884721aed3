"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; bit j is set where over half of the text's shingles have bit j set in their XXH64.
Fingerprints link when they differ in at most two bits. Links are found among distinct fingerprints:

1. A fingerprint is cut into segments of 22, 21 and 21 bits. Two differing bits leave one segment untouched
   (pigeonhole) and at most two errors in the next one.
2. The next segment is decoded by the perfect binary Golay code (23, 12, 7). Its keys are the indices of the
   codewords nearest to it and to its 23 one-bit neighbours: one index if it lies within two bits of a codeword,
   else six. Segments within two bits share an index, as both neighbour a common word in the middle. A key is the
   untouched segment with one such index, so a fingerprint has at most 18 keys.
3. Fingerprints with a common key are joined and their distance verified. Buckets of more than ``bucket``
   fingerprints are not paired: their members are grouped by every word within one bit of them. Two fingerprints
   are within two bits exactly if they share such a word, and a word has at most 65 of them, so this finds the same
   links in a number of rows that is linear in the members.
4. Components of the links are found in rounds; every document gets its component through its fingerprint.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle give one shingle; repeated rows share fingerprint and component; ties take the smallest
id; null ids are kept, and do not become a component id unless a component has no other; empty tables give empty
results; other columns are kept, but for those named like a result column.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import LOWER, fresh, identified, q, scanned, stored, text_blocks
from lodestat.llm.graph import components

SEED = 42
BUCKET = 16
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of all shingles of a text whose capitals are folded."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``__fp``, the fingerprint as a signed long."""
    keep = [f for f in docs.schema.fields if f.name != text_col]

    def rows(batches):
        for part, data, offsets in text_blocks(batches, text_col):
            plain = data.tobytes().translate(LOWER)
            made = [fingerprint(shingle_hashes(plain[a:b], size)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [part.column(part.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.int64())], [*(f.name for f in keep), "__fp"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in keep), "__fp long"])
    return docs.select(*[q(f.name) for f in keep], q(text_col)).mapInArrow(rows, schema)


class Golay:
    """Nearest codewords of 23-bit words."""

    def __init__(self) -> None:
        bits = [self._rest(1 << k) for k in range(23)]
        self.low, self.high = self._table(bits[:12]), self._table(bits[12:])
        self.error = np.zeros(2048, np.int64)
        for weight in range(4):
            for places in combinations(range(23), weight):
                syndrome = 0
                for k in places:
                    syndrome ^= bits[k]
                self.error[syndrome] = sum(1 << k for k in places)

    @staticmethod
    def _rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    @staticmethod
    def _table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for b in bits:
            out = np.concatenate([out, out ^ b])
        return out

    def index(self, words: np.ndarray) -> np.ndarray:
        """Message of the nearest codeword (a code word's first twelve bits)."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Row by row the indices of a word and its neighbours, sorted; repeated ones are -1."""
        near = words[:, None] ^ np.array([0, *(1 << k for k in range(23))], np.int64)
        found = np.sort(self.index(near), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def golay_keys(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``prints``, key) of all keys."""
    words = prints.view(np.uint64)
    parts = [((words >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    owners, keys = [], []
    for k in range(3):
        found = code.indices(parts[(k + 1) % 3])
        owner, column = np.nonzero(found >= 0)
        owners.append(owner)
        keys.append((k << 34) | (parts[k][owner] << 12) | found[owner, column])
    return np.concatenate(owners), np.concatenate(keys)


def _keys(batches):
    code = Golay()
    for batch in batches:
        prints = batch.column(0).to_numpy()
        owner, key = golay_keys(prints, code)
        yield pa.RecordBatch.from_arrays([pa.array(prints[owner]), pa.array(key)], ["fp", "key"])


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``prints`` (distinct, column ``fp``) within two bits."""
    keys = stored(prints.mapInArrow(_keys, "fp long, key long"), "golay-keys")
    counts = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "golay-counts")
    shared = keys.join(counts, "key")
    small = stored(shared.filter(F.col("n") <= bucket).select("key", "fp"), "golay-buckets")
    other = small.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2
    paired = small.join(other, (small["key"] == other["key"]) & (F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b")
    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.expr("transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k))")
    near = F.concat(F.array("fp"), flips)
    middles = crowded.select("fp", F.explode(near).alias("m")).groupBy("m").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    starred = middles.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return paired.unionByName(starred)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", size: int = 3, text_col: str = "text", bucket: int = BUCKET, with_root: bool = False) -> DataFrame:
    """The other columns of ``docs``, ``__fp`` and ``component_id`` (smallest id of the component), and its fingerprint ``root`` if asked."""
    kept = docs.select(*[q(c) for c in docs.columns if c.lower() not in ("component_id", "fingerprint") or c in (id_col, text_col)])
    made = stored(fingerprints(kept, size, text_col), "fingerprints")
    prints = made.groupBy(F.col("__fp").alias("fp")).agg(F.min(q(id_col)).alias("first"))
    roots = components(links(prints.select("fp"), bucket))
    labelled = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = stored(labelled, "fingerprint-roots")
    first = stored(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "fingerprint-components")
    ids = stored(labelled.join(first, "root").select(F.col("fp").alias("__fp"), "component_id", *["root"] * with_root), "fingerprint-ids")
    return made.join(ids, "__fp")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", size: int = 3, text_col: str = "text", bucket: int = BUCKET, scan: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the first by id (null ids last), then by row number.

    Row numbers must not change between passes. They are the file and the row in it where ``docs`` is a plain scan of
    Parquet (``scan=True``); otherwise the table is written first.
    """
    row = fresh(docs, "__row")
    own = scanned(docs, row) if scan else stored(identified(docs, row), "near-documents")
    texts = own.select(q(row).alias("row"), q(id_col).alias("id"), q(text_col).alias("text"))
    found = near_duplicates(texts, "id", size, bucket=bucket, with_root=True)
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))["row"]
    found = stored(found.select("row", "id", "root"), "near-roots")
    first = found.groupBy("root").agg(least.alias("row")).select("row")
    # Those that go are fewer than those that stay, so the texts rarely have to move.
    gone = stored(found.join(first, "row", "left_anti").select(F.col("row").alias(row)), "near-gone")
    return own.join(gone, row, "left_anti").select(*[q(c) for c in docs.columns])
