import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import packing as P
from lodestat.llm.queries import QUERIES
from tests.conftest import SF


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


def held(rows, texts, length=2048):
    """Every piece is right, sequences are gapless, and there are as many as best-fit decreasing gives."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {d for d, _ in texts}
    lengths = []
    for doc, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        want = []
        for k, (a, b) in enumerate(P.cuts(len(ids), length)):
            want.append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            lengths.append(b - a)
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc])
        assert got == want
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert len(by_seq) == best_fit_decreasing(lengths, length)


def test_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held(QUERIES["op3_best_fit_packing"](spark, SF).collect(), texts)


EDGES = ["", None, "a", " a  b", "a\n b", "x  y z", "tab\tand  spaces ", "<|endoftext|> here", "it's 12 o'clock don't", "wo rd " * 3000, "日本 語 é​ x", "b " * 2047, "b " * 2048, "q" * 5000, "\x1c a \x85 b"]


def test_edges(spark):
    texts = list(enumerate(EDGES))
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("x"))
    held(P.pack_documents(docs.withColumn("note", F.lit(1))).collect(), texts)
    assert P.pack_documents(docs.limit(0)).count() == 0
    twice = P.pack_documents(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(P.pack_documents(docs).collect())


def test_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.tokenizer_path())
    texts = [(i, f"text number {i} " + "word " * i) for i in range(60)]
    packed = P.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), length=64, with_ids=True)
    seqs = {r.sequence_id: r.ids for r in P.sequences(packed).collect()}
    back = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        back[r.doc_id] += seqs[r.sequence_id][r.offset : r.offset + r.length]
    assert {d: model.decode(ids[:-1]) for d, ids in back.items()} == dict(texts)


@pytest.mark.parametrize("seed", range(30))
def test_rounds_equal_best_fit_decreasing(seed):
    r = random.Random(seed)
    size = r.choice([8, 30, 100])
    lengths = [r.randint(1, r.choice([size, size // 3])) for _ in range(r.randint(1, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    moves, used, rank = P.match(counts, size), defaultdict(int), 0
    for n in sorted(lengths, reverse=True):
        m = moves[np.searchsorted(moves[:, 0], rank, side="right") - 1]
        nth = rank - m[0]
        assert m[4] == n
        assert used[m[1] + nth // m[2]] == m[3] + nth % m[2] * n
        used[m[1] + nth // m[2]] += n
        rank += 1
    assert max(used.values()) <= size and len(used) == best_fit_decreasing(lengths, size)
