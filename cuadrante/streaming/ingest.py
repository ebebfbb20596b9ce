"""Cells that arrive as files, through the same plan as a batch; nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import records


def stream_cells(spark: SparkSession, folder: str, schema: str, form: str = "json", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", max_files).load(folder)


def start_records(cells: DataFrame, path: str, checkpoint: str, on_batch=None):
    """Validated records to ``path``; parsing and rules are per row, so the stream needs no state. ``on_batch`` is told
    the number of each batch that is done. A batch that is run again writes into its own folder again."""

    def write(batch: DataFrame, number: int) -> None:
        records.build(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(number)

    return cells.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
