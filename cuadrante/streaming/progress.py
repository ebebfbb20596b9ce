"""What a run says while it goes on: counts of every batch as it ends, a line for every file with its time, and how far
the run is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import records

NAME = "records"
#: Fixed value: the form of the time before a log line.
CLOCK = "'['HH:mm:ss'] '"


class Counts(StreamingQueryListener):
    """Tells ``told`` (batch, counts) of each batch of one query that had rows: cells, accepted, rejected and warnings,
    counted by the batch's own pass over its rows. A batch that is run again is told again, under the same number."""

    def __init__(self, name: str, told: Callable[[int, dict[str, int]], None]):
        self.name, self.told = name, told

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        counts = event.progress.observedMetrics.get(NAME) if event.progress.name == self.name else None
        if counts is not None and counts["cells"]:
            self.told(event.progress.batchId, counts.asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def start(cells: DataFrame, folder: str, name: str, trigger: dict | None = None):
    """Validated records of a stream of cells to ``folder``/records, and ``log_lines`` to ``folder``/log, both a folder
    a batch; a batch that is run again writes its folders again, and a restart goes on after the last whole batch.

    A file's cells are expected in one batch; one that is spread over several has a line in each. ``trigger`` is that of
    the stream, by default all that is there."""
    good = F.col("accepted")
    built = records.build(cells).observe(
        NAME, F.count_if(F.col("pos") == 0).alias("cells"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), F.count_if(good & (F.size("issues") > 0)).alias("warnings")
    )

    def write(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{folder}/records/batch={number}"
        batch.write.mode("overwrite").parquet(at)  # the only pass over the cells: the log reads what is written
        stats = records.file_stats(records.page_stats(spark.read.schema(batch.schema).parquet(at)))
        failed = spark.createDataFrame([], "file string, error string")
        timed(records.log_lines(stats, failed)).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    stream = built.writeStream.queryName(name).option("checkpointLocation", f"{folder}/checkpoint")
    return stream.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def timed(lines: DataFrame) -> DataFrame:
    """Log lines with the time they are written at, in front and as ``at``; those of one run of a plan have one time."""
    return lines.withColumn("at", F.current_timestamp()).withColumn("line", F.concat(F.date_format("at", CLOCK), "line"))


def log(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ok, line, at, batch) of the batches so far."""
    return spark.read.schema("file string, ok boolean, line string, at timestamp, batch int").parquet(f"{folder}/log")


def percent(lines: DataFrame, total: int) -> int:
    """Whole percent of ``total`` files that have a line."""
    done = lines.select(F.count_distinct("file").alias("n"))
    return done.select(records.progress_percent(F.col("n"), F.lit(total)).alias("p")).first()["p"]
