"""Batch and streaming scoring with a saved pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def score_batch(model: PipelineModel | str, rows: DataFrame) -> DataFrame:
    """Rows with a ``prediction``; ``model`` may be a saved path."""
    fitted = PipelineModel.load(model) if isinstance(model, str) else model
    return fitted.transform(rows)


def score_stream(
    model: PipelineModel | str, stream: DataFrame, path: str, checkpoint: str, columns: list[str], available_now: bool = False
) -> StreamingQuery:
    """Score a stream into Parquet; stateless, so each input row is scored once and late rows need no policy."""
    writer = (
        score_batch(model, stream)
        .select(*columns, "prediction")
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
