from pyspark.sql import functions as F

from lodestat.llm import linededup, simhash, suffixdedup


def test_row_numbers_of_a_scan_do_not_follow_the_splits(spark, tmp_path, monkeypatch):
    """The passes of an operator see other file splits, as when executors come and go."""
    texts = [f"{'same line of all ' * 20}\nown {k % 40} {'x' * (k % 7)}\n" + "a b c d e f g " * (k % 5) for k in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    rows.sortWithinPartitions("doc_id").write.option("parquet.block.size", 1024).option("parquet.page.size.row.check.min", 1).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").withColumn("one", F.lit(1))
    held, passes = spark.conf.get("spark.sql.files.maxPartitionBytes"), []

    def results():
        return [
            sorted(map(tuple, linededup.deduplicate(docs, scan=True).collect())),
            sorted(map(tuple, simhash.keep_first(docs, scan=True).collect())),
            sorted(map(tuple, suffixdedup.digest(suffixdedup.deduplicate(docs, scan=True)).collect())),
        ]

    want = results()
    for module in (linededup, simhash, suffixdedup):
        def stored(df, label, write=module.stored):
            out = write(df, label)
            passes.append(label)
            spark.conf.set("spark.sql.files.maxPartitionBytes", ("1k", "128m")[len(passes) % 2])
            spark.conf.set("spark.sql.files.openCostInBytes", ("1", "4m")[len(passes) % 2])
            return out

        monkeypatch.setattr(module, "stored", stored)
    try:
        assert results() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
