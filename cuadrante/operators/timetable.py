"""A student's timetable: subjects to choose from, what is chosen, and the sessions that then clash.

Tables: degrees (id, name), subjects (id, degree_id, name, grp), sessions (subject_id, day, start_time, end_time,
classroom); ``schemas`` has their types, and ``sources.io.tables`` makes them from rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import intervals


def pick(subjects: DataFrame, degrees: DataFrame, degree: str = "", search: str = "") -> DataFrame:
    """Subjects of a degree ("" for all) whose id, name, group, degree and its name contain the text, in any case and
    without accents; each with ``degree_name``, null if the degree is unknown."""
    named = subjects.join(degrees.select(F.col("id").alias("degree_id"), F.col("name").alias("degree_name")), "degree_id", "left")
    if degree:
        named = named.where(F.col("degree_id") == degree)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "name", "grp", "degree_id", "degree_name")]
    return named.where(F.contains(T.searchable(F.concat_ws(" ", *parts)), T.searchable(F.lit(search))))


def conflicts(selected: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pairs of sessions of different selected subjects (id) that overlap on a day: columns with _a and _b."""
    chosen = sessions.join(selected.select(F.col("id").alias("subject_id")).distinct(), "subject_id")
    timed = chosen.withColumns({"_start": T.minutes(F.col("start_time")), "_end": T.minutes(F.col("end_time"))}).where("_start is not null and _end is not null")
    timed = timed.withColumn("_order", F.struct("subject_id", "_start", "_end", "classroom"))
    return intervals.overlap_pairs(timed, ["day"], "_start", "_end", "_order", distinct_by="subject_id").drop("_start_a", "_start_b", "_end_a", "_end_b", "_order_a", "_order_b")
