"""Predictions over arriving documents: each batch of them is joined with the
stored model table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import serve


def read_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Documents that arrive as lines of JSON files in a directory, so many
    files a batch at most."""
    return serve.read_instances(spark.readStream.format("text").option("maxFilesPerTrigger", files).load(path))


def start(instances: DataFrame, model_path: str, path: str, checkpoint: str) -> StreamingQuery:
    """Predictions of what has arrived since, as Parquet under `path`, a folder
    `batch=k` for each batch: a batch that is run again writes its own folder
    again, so each document is predicted once. The model is read anew for each
    batch. The trigger takes what is there and ends."""

    def write(batch: DataFrame, k: int) -> None:
        model = batch.sparkSession.read.parquet(model_path)
        serve.predict(batch, model).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return instances.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
