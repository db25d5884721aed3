"""Text categories as codes from a distributed dictionary, for feature pipelines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml import feature as MF
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import q
from lodestat.plans.skew import with_position
from lodestat.session import materialize


def sparse_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and value of the entries of vectors as Arrow holds them (type, size, indices, values)."""
    kind, indices, values = (column.field(k) for k in ("type", "indices", "values"))
    rows, places, numbers = [], [], []
    for r, (t, i, v) in enumerate(zip(kind.to_pylist(), indices, values)):
        v = v.values.to_numpy(zero_copy_only=False)
        places.append(i.values.to_numpy(zero_copy_only=False) if t == 0 else np.arange(len(v)))
        numbers.append(v)
        rows.append(np.full(len(v), r))
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (rows, places, numbers))


def vector_cells(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, i, x): the entries that sparse vectors hold."""
    id_type = df.schema[id_col].dataType.simpleString()

    def rows(batches):
        for b in batches:
            if b.num_rows:
                row, place, x = sparse_rows(b["v"])
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(row.astype(np.int64))), pa.array(place.astype(np.int64)), pa.array(x)], ["id", "i", "x"])

    return df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(rows, f"id {id_type}, i long, x double").withColumnRenamed("id", id_col)


WIDE_SLOTS = 10_000
SENT_VALUES = 100_000


class TextCodes(Estimator):
    """Learns one code per distinct value of each text column, in value order, and encodes it as one sparse slot.

    The dictionary is a written table: values are counted and numbered by Spark, and never reach the driver, which only
    holds the number of values of each column. Rows find their codes by joins that turn into broadcasts while the dictionary is
    small and split hot values otherwise. A value unseen in training becomes all zeros.
    """

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str]) -> None:
        super().__init__()
        self.inputs, self.outputs = list(inputs), list(outputs)

    def _fit(self, dataset: DataFrame) -> TextCodesModel:
        values = dataset.select(*[q(c).cast("string").alias(c) for c in self.inputs]).unpivot([], [q(c) for c in self.inputs], "column_name", "value")
        values = values.filter(F.col("value").isNotNull()).distinct()
        dictionary = materialize(with_position(values, ["column_name"], "value", name="code").drop("n"), "dictionary")
        sizes = {r["column_name"]: r["n"] for r in dictionary.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        return TextCodesModel(self.inputs, self.outputs, dictionary, [int(sizes.get(c, 0)) for c in self.inputs])


class TextCodesModel(Model, MLWritable, MLReadable):
    """A fitted dictionary (column_name, value, code) and the number of values of each column."""

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str], dictionary: DataFrame, sizes: Sequence[int]) -> None:
        super().__init__()
        self.inputs, self.outputs, self.dictionary, self.sizes = list(inputs), list(outputs), dictionary, list(sizes)

    def coded(self, dataset: DataFrame) -> tuple[DataFrame, list[str]]:
        """``dataset`` with a code column (double) for each input, and their names; an unseen value has the code after the last."""
        out, names = dataset, dataset.columns
        codes = [f"__code_{i}" for i in range(len(self.inputs))]
        for i, c in enumerate(self.inputs):
            own = self.dictionary.filter(F.col("column_name") == c).select(F.col("value").alias(f"__value_{i}"), F.col("code").alias(codes[i]))
            if self.sizes[i] > SENT_VALUES:  # its file is far smaller than its rows
                own = own.hint("merge")
            out = out.join(own, q(c).cast("string") == F.col(f"__value_{i}"), "left").drop(f"__value_{i}")
        return out.select(*[q(c) for c in names], *[F.coalesce(F.col(k), F.lit(n)).cast("double").alias(k) for k, n in zip(codes, self.sizes)]), codes

    def appended(self, dataset: DataFrame, id_col: str, dense: str | None, output: str) -> DataFrame:
        """(id, output): the dense vector and then the slots of all inputs as one sparse vector.

        MLlib's own stages write a name for every slot into the schema, which the driver and every task hold; these vectors have none.
        """
        out, codes = self.coded(dataset)
        sizes, starts = np.array(self.sizes), np.concatenate([[0], np.cumsum(self.sizes)])

        def rows(batches):
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                numbers = b["__dense"].field("values").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if dense else np.zeros((n, 0))
                p = numbers.shape[1]
                code = np.stack([b[c].to_numpy(zero_copy_only=False) for c in codes], axis=1).astype(np.int64)
                places = np.hstack([np.tile(np.arange(p), (n, 1)), code + p + starts[:-1]])
                values = np.hstack([numbers, np.where(code < sizes, 1.0, 0.0)])
                kept = values != 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]), pa.int32())
                parts = [
                    pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, p + starts[-1], np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(places[kept].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(values[kept])),
                ]
                yield pa.RecordBatch.from_arrays([b[id_col], pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], [id_col, output])

        rest = [F.col(dense).alias("__dense")] if dense else []
        schema = T.StructType([out.schema[id_col], T.StructField(output, VectorUDT())])
        return out.select(q(id_col), *rest, *codes).mapInArrow(rows, schema)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, codes = self.coded(dataset)
        # The slot after the last value stands for unseen ones and is dropped; a row with those codes fixes the widths.
        row = dataset.sparkSession.createDataFrame([tuple(float(n) for n in self.sizes)], ", ".join(f"{k} double" for k in codes))
        encoder = MF.OneHotEncoder(inputCols=codes, outputCols=self.outputs, dropLast=True).fit(row)
        return encoder.transform(out).drop(*codes)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TextCodesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        extra = {"inputs": self.model.inputs, "outputs": self.model.outputs, "sizes": self.model.sizes}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        self.model.dictionary.write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def load(self, path: str) -> TextCodesModel:
        spark: SparkSession = self.sparkSession
        found = DefaultParamsReader.loadMetadata(path, spark)
        model = TextCodesModel(found["inputs"], found["outputs"], spark.read.parquet(f"{path}/dictionary"), found["sizes"])
        model._resetUid(found["uid"])
        return model
