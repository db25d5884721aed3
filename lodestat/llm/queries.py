"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestat.llm import bpe, collocations, decontaminate, divergence, html, linededup, packing, pii, quality, rollup, simhash, suffixdedup, topk
from lodestat.llm.common import stored, table
from lodestat.session import shared_folder

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_line_dedup", linededup.SQL)
def op1(spark, sf_dir):
    """Runs of two lines or more, and lines of 20 words or 250 characters or more, that came before."""
    return linededup.report(table(spark, sf_dir, "documents"))


@query("op2_pii")
def op2(spark, sf_dir):
    """Base entities and contextually discovered identifiers of every document."""
    return pii.digest(pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_cover_tree_top_k", TOP_K)
def op4(spark, sf_dir):
    """The 5 largest inner products of every 50th vector with all others."""
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


@query("op5_simhash")
def op5(spark, sf_dir):
    """Fingerprints of 3-word shingles, linked at two differing bits or fewer."""
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op6_token_counts", rollup.SQL)
def op6(spark, sf_dir):
    """Estimates are loaded, revised to real counts, a tokenizer is added, toxic documents go, and batches are sent again."""
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    counts = stored(
        docs.select(
            "doc_id", "source", "lang",
            F.floor(F.length(text) / 5).alias("estimate"),
            *[rollup.token_count(text, v).alias(v) for v in rollup.VERSIONS],
        ),
        "token-counts",
    )
    under = lambda df, v: df.withColumn("version", F.lit(v))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    gone = counts.join(toxic, "doc_id", "left_semi")
    first, second = rollup.VERSIONS
    batches = {
        "load": rollup.inserted(under(counts, first), "estimate"),
        "count": rollup.revised(under(counts, first), "estimate", first),
        "second": rollup.inserted(under(counts, second), second),
        "toxic": rollup.deleted(under(gone, first), first).unionByName(rollup.deleted(under(gone, second), second)),
    }
    totals = rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    for name in [*batches, "count", "toxic"]:
        totals.commit(name, batches[name])
    return totals.totals()


@query("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    """Windows of 10 words of every benchmark item against every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    """Bytes covered by 200-byte strings that start more than once in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixdedup.digest(suffixdedup.deduplicate(docs, scan=True))


@query("op9_html_extraction")
def op9(spark, sf_dir):
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    """Expected grade and probability of the top grade for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.graded(docs, table(spark, sf_dir, "labels")))


@query("op11_phrase_collocations", collocations.SQL)
def op11(spark, sf_dir):
    """The first 2000 phrases of two and three words of every language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op12_source_divergence", divergence.SQL)
def op12(spark, sf_dir):
    """All pairs of sources of a language, and the terms each source is heavy in."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_bpe_chunk_reuse")
def op13(spark, sf_dir):
    """Ids of every document and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.decode(bpe.encode(docs, scan=True)))
