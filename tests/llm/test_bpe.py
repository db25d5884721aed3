import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import bpe as B
from lodestat.llm.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.tokenizer_path())


def test_query(spark, model):
    got = {tuple(r) for r in QUERIES["op13_bpe_chunk_reuse"](spark, SF).collect()}
    want = set()
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = model.encode(text or "", add_special_tokens=False).ids
        parts = " ".join(map(str, ids)), model.decode(ids, skip_special_tokens=False)
        want.add((doc, len(ids), *(hashlib.sha256(p.encode()).hexdigest() for p in parts)))
    assert got == want


def texts_with_shared_passages():
    r = random.Random(8)
    passage = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(900))
    dense = "".join(r.choices("abcdéf日", k=4000))
    texts = [passage[r.randint(0, 300) :] + r.choice([" ", "x", "́"]) + passage[: r.randint(900, 4000)] for _ in range(12)]
    texts += [dense[r.randint(0, 99) :] + " <|endoftext|>" + dense for _ in range(4)]
    return texts + ["", None, " ", "'s", "a b", "<|startoftext|>", "q" * 3000, " " * 3000, "don't  stop"] + [passage] * 40


def test_shared_passages_and_edges(spark, model):
    texts = list(enumerate(texts_with_shared_passages()))
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__row", F.lit(7)).withColumn("ids", F.lit("x")).withColumn("others", F.lit(1))
    found = B.decode(B.encode(docs))
    assert found.columns == ["doc_id", "__row", "others", "ids", "decoded"]
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.ids == ids and r["__row"] == 7
        assert r.decoded == model.decode(ids, skip_special_tokens=False)
    assert B.encode(docs.select("text")).count() == len(texts)
    assert B.encode(docs.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, model):
    texts = list(enumerate(texts_with_shared_passages()))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r in B.encode(docs, bits=1 << 15).collect():
        assert r.ids == model.encode(texts[r.doc_id][1] or "", add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once(spark):
    texts = [(k, t) for k, t in enumerate(texts_with_shared_passages()) if t]
    docs = spark.createDataFrame(texts, "doc_id long, __text string").select(F.col("__text"), F.col("doc_id").alias("__row"))
    met = B.keys_met(docs).groupBy("key").count()
    every = spark.sparkContext.broadcast(np.full(1 << 12, 255, np.uint8))
    chunks = B.shared_chunks(docs, every, 1 << 15, B.tokenizer_path())
    assert chunks.count() == met.count() < met.agg(F.sum("count")).first()[0] / 5


@pytest.mark.parametrize("seed", range(20))
def test_repair_is_exact(model, seed):
    r, words = random.Random(seed), B.Words(B.tokenizer_path())
    parts = [*"abAB'sStT 1234,.-\n\t", "́", "é", " ", "\xa0", "\x1c", "<|endoftext|>", "日", "Σ", "İ", "ﬁ", "🙂", "'re", "̈́", "ᄀ", "ᅡ", "\x85", " "]
    for _ in range(200):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        cuts = [0, *sorted(r.sample(range(len(s) + 1), min(len(s), r.randint(0, 6)))), len(s)]
        got = np.frombuffer(words.joined(words.segment(s[a:b]) for a, b in zip(cuts, cuts[1:])), words.kind)
        assert got.tolist() == model.encode(s, add_special_tokens=False).ids


def test_hashing_holds_little_and_cuts_as_one_slice(monkeypatch):
    """A block of 1 MB is hashed in arrays of a few MB; where the slices end makes no difference to the cuts."""
    import tracemalloc

    data = np.random.default_rng(3).integers(32, 127, 1 << 20).astype(np.uint8)
    tracemalloc.start()
    found = B.cut_places(data, B.powers())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    monkeypatch.setattr(B, "HASHED", 1 << 20)
    assert len(found) > 1000 and (B.cut_places(data, B.powers()) == found).all()


def test_joined_texts_leave_in_small_batches(spark, model, monkeypatch):
    """Many long texts with shared passages: every text once, whatever the size of the batches."""
    monkeypatch.setattr(B, "SLICE", 3000)
    texts = list(enumerate(texts_with_shared_passages() * 3))
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = B.encode(docs).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in texts]
    assert all(r.ids == model.encode(texts[r.doc_id][1] or "", add_special_tokens=False).ids for r in rows)


def test_plain_words_go_to_the_model_by_their_pieces_alone(model, monkeypatch):
    """No mark stands between pieces: the tokens that end a piece tell where the next begins."""
    words = B.Words(B.tokenizer_path())
    monkeypatch.setattr(words, "encoded", lambda _: pytest.fail("encoded with marks"))
    r = random.Random(4)
    text = " ".join("".join(r.choices("abcdefgéßÜ'.,-!</w>~19S", k=r.randint(1, 12))) for _ in range(3000)).replace("<|", "")
    assert np.frombuffer(words.packed(text), words.kind).tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 15, 16, 17, 23, 24, 31, 4000])
def test_cuts_are_where_a_window_calls_for_one(n):
    data, factors = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8), [int(p) for p in B.powers()]
    raw, want = data.tobytes(), []
    for i in range(max(n - B.WINDOW, 0)):
        h = sum(int.from_bytes(raw[i + 8 * k : i + 8 * k + 8], "little") * p for k, p in enumerate(factors)) % (1 << 64)
        if h < (1 << 64) // B.CHUNK and raw[i + B.WINDOW] & 0xC0 != 0x80:
            want.append(i + B.WINDOW)
    assert B.cut_places(data, B.powers()).tolist() == want
