"""Edits as they come: the log as a stream, folded into one state per item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review


def stream_log(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """The events of a folder of JSON files, each file an event or many."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def start_folding(log: DataFrame, path: str, checkpoint: str, on_batch=None):
    """Fold ``log`` into ``path``: each batch writes the states of the items it touched, whole. The fold is a streaming
    aggregation, so the state lives in Spark's state store, a row an item that has edits, and a restart goes on from
    ``checkpoint``. A batch that is run again writes its own folder again. ``on_batch`` is told each batch that is done."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(number)

    return review.fold(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def states(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each item, in the shape of ``review.fold``."""
    every = spark.read.parquet(path)
    fields = [c for c in every.columns if c not in ("id", "batch")]
    newest = every.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("state"))
    return newest.select("id", "state.*")


def edited(items: DataFrame, path: str) -> DataFrame:
    """Items as the stream has left them, without the log: one join with the states."""
    return review.apply(items, states(items.sparkSession, path))
