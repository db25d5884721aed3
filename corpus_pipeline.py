"""From raw documents to packed training sequences; each stage is written as Parquet and read again by the next.

A stage's intermediate tables are needed until its result is written. The next stage starts from what was written, so it
first deletes the tables of the one before.

Defined cases: empty texts (null ones too, which stay null) are graded like any others, have no lines, share one
fingerprint, so that one of those that pass the classifier stays, hold no benchmark window and pack as one end token. Repeated rows are near-duplicates, so one stays. An
empty table passes every stage as one. Extra columns, whatever their names, are kept up to the packing stage, which gives
the digest columns only.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import decontaminate, linededup, packing, quality, simhash
from lodestat.llm.common import collected, discard, stored, table

_tables: list[str] = []


def stage(fn):
    """A stage that deletes the previous one's intermediate tables and notes its own."""

    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _tables)
        _tables.clear()
        with collected() as paths:
            out = fn(spark, docs, sf_dir)
        _tables.extend(paths)
        return out

    return call


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are likely of the top grade, by a model fitted on the labelled ones."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated runs of lines; documents that lose all their text go."""
    cut = linededup.deduplicate(docs.withColumn("__before", F.col("text")), scan=True)
    emptied = (F.col("text") == "") & (F.col("__before") != "")
    changed = cut.filter(~F.coalesce(emptied, F.lit(False)))
    n_chars = F.when(F.col("text").eqNullSafe(F.col("__before")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return changed.withColumn("n_chars", n_chars).select(*docs.columns)


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links (three-word shingles, two bits) stays, the first by id."""
    return simhash.keep_first(docs, scan=True)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.digest(packing.pack_documents(docs.select("doc_id", "text")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier, the fingerprints and the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stored(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
