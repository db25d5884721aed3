"""Token counts: additive totals by source, language and tokenizer version, kept by signed deltas.

A batch holds events: an insert adds a document's tokens, a delete takes them away, and a revision takes the old
count away and adds the new one. ``commit`` sums a batch per key (combined before the shuffle, so a source with most
rows is no burden) and writes it as one folder of the rollup; Spark's writer makes the folder's success mark the
commit. A batch whose mark exists is not applied again, and a batch that failed half-way leaves no mark and is
overwritten when retried, so totals are exact however often a batch is sent. ``totals`` adds up the committed
batches; ``compact`` folds them into one, with the list of what it holds.

Defined cases: null keys are keys of their own; null counts are zero; a null text has no tokens; repeated rows are
documents of their own; keys whose documents and tokens are both zero are left out of the totals; empty batches are
committed and change nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import q

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, tokens long, documents long"
# Tokenizer versions that are expressions: pattern of a token.
VERSIONS = {"space-1": r"[^ \t\n\r\f\x0B]+", "alnum-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"}


def token_count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def inserted(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Events for new documents: key columns, tokens, documents."""
    return counts.select(*KEYS, F.coalesce(q(tokens), F.lit(0)).cast("long").alias("tokens"), F.lit(1).cast("long").alias("documents"))


def deleted(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return inserted(counts, tokens).withColumns({"tokens": -F.col("tokens"), "documents": -F.col("documents")})


def revised(counts: DataFrame, old: str, new: str) -> DataFrame:
    """Events for documents that stay but whose count changes from ``old`` to ``new``."""
    return deleted(counts, old).unionByName(inserted(counts, new))


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folded: list[str] | None = None

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _marked(self, batch: str) -> bool:
        return self._exists(f"{self.path}/batch={batch}/_SUCCESS")

    def _folded(self) -> list[str]:
        """The batches that ``compact`` put into the totals of this rollup, written with them in one commit."""
        if self.folded is None:
            self.folded = []
            if self._marked("totals"):
                totals = self.spark.read.schema(f"{SCHEMA}, folded array<string>").parquet(f"{self.path}/batch=totals")
                self.folded = [b for r in totals.filter("folded IS NOT NULL").collect() for b in r["folded"]]
        return self.folded

    def committed(self, batch: str) -> bool:
        return self._marked(batch) or batch in self._folded()

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied before."""
        if self.committed(batch):
            return False
        sums = events.groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def _batches(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self._marked(n.removeprefix("batch=")))

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """Totals of the given batches, or of all that are committed now."""
        paths = [f"{self.path}/batch={b}" for b in (self._batches() if batches is None else batches)]
        found = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = found.groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        return sums.filter("tokens <> 0 OR documents <> 0")

    def compact(self, into: str) -> Rollup:
        """A rollup in another folder whose first batch holds all totals so far, and which knows the batches folded in.

        The list of batches is fixed before they are summed and is written in the same commit, as a row without counts. So
        a retry, or a batch that arrives meanwhile, neither loses nor doubles anything: what is not in the list can
        be committed to the new folder.
        """
        other = Rollup(self.spark, into)
        if not other._marked("totals"):
            batches = sorted({*self._batches(), *self._folded()})
            note = self.spark.createDataFrame([(None, None, None, 0, 0, batches)], f"{SCHEMA}, folded array<string>")
            sums = self.totals([b for b in batches if self._marked(b)]).withColumn("folded", F.lit(None).cast("array<string>"))
            sums.unionByName(note).write.mode("overwrite").parquet(f"{other.path}/batch=totals")
        return other


SQL = r"""
WITH live AS (SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)),
counts AS (
  SELECT source, lang, 'space-1' AS version, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS tokens FROM live
  UNION ALL
  SELECT source, lang, 'alnum-1', len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) FROM live)
SELECT source, lang, version, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS documents FROM counts GROUP BY ALL
"""
