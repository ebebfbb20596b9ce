"""Cells to normalised, validated records, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import parsing, quality


def normalize(cells: DataFrame) -> DataFrame:
    """One row per subject of a cell, ``pos`` in the cell's order, all fields normalised."""
    c = F.col
    return parsing.subjects(cells).select(
        "ord", "pos", "file", "page",
        c("degree_code"), c("degree_name"), T.academic_year(c("academic_year_raw")).alias("academic_year"), "semester", "year",
        T.group(c("grp")).alias("grp"), T.comparable(c("day")).alias("day"), T.hour(c("start_time")).alias("start_time"), T.hour(c("end_time")).alias("end_time"),
        T.subject(c("name")).alias("name"), T.group(c("subgroup")).alias("subgroup"), T.classroom(c("room")).alias("classroom"), "notes", "raw_text",
    )


def build(cells: DataFrame) -> DataFrame:
    return quality.validate(normalize(cells))


def page_stats(records: DataFrame) -> DataFrame:
    """Cells, accepted, rejected and accepted with warnings of each page. Every cell has a record at ``pos`` 0, so one
    aggregation counts cells, too."""
    a = F.col("accepted")
    return records.groupBy("file", "page").agg(
        F.count_if(F.col("pos") == 0).alias("cells_detected"), F.count_if(a).alias("accepted"), F.count_if(~a).alias("rejected"), F.count_if(a & (F.size("issues") > 0)).alias("warnings")
    )


def file_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("file").agg(F.count(F.lit(1)).alias("pages"), F.sum("accepted").alias("records"), F.sum("rejected").alias("rejected"), F.sum("warnings").alias("warnings"))


def global_stats(stats: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row over ``stats`` (a row a file) and ``failed`` (file, error), files that gave no records."""
    done = stats.select(F.lit(1).alias("ok"), "records", "rejected", "warnings")
    if failed is not None:
        zero = F.lit(0).cast("long")
        done = done.unionByName(failed.select(F.lit(0).alias("ok"), zero.alias("records"), zero.alias("rejected"), zero.alias("warnings")))
    return done.agg(
        F.count(F.lit(1)).alias("pdfs_found"), F.count_if(F.col("ok") == 1).alias("pdfs_processed"), F.count_if(F.col("ok") == 0).alias("pdfs_failed"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("accepted_records"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected_records"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("records_with_warnings"),
    )


def split_results(rows: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that went well, and the dead letters (file, error)."""
    return rows.where(F.col(error_col).isNull()).drop(error_col), rows.where(F.col(error_col).isNotNull()).select("file", error_col)


def progress_percent(done, total):
    """Whole percent, downwards; 0 without a total."""
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(done / total * 100)).cast("int")


# The words of the log lines.
DONE, FAILED = ("OK → ", " (", " registros, ", " rechazados)"), ("Error en ", ": ")


def log_lines(stats: DataFrame, failed: DataFrame) -> DataFrame:
    """(file, ok, line): what a run says of each file."""
    good = F.concat(F.lit(DONE[0]), "file", F.lit(DONE[1]), F.col("records").cast("string"), F.lit(DONE[2]), F.col("rejected").cast("string"), F.lit(DONE[3]))
    bad = F.concat(F.lit(FAILED[0]), "file", F.lit(FAILED[1]), F.coalesce("error", F.lit("")))
    return stats.select("file", F.lit(True).alias("ok"), good.alias("line")).unionByName(failed.select("file", F.lit(False).alias("ok"), bad.alias("line")))
