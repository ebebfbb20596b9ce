"""Validation of schedule records: a fixed list of rules, penalties, a confidence and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
DAYS = ("LUNES", "MARTES", "MIERCOLES", "JUEVES", "VIERNES")
MIN_CONFIDENCE = 0.55
ERRORS = ("missing_subject", "invalid_subject_name", "invalid_day", "invalid_time", "invalid_classroom", "invalid_academic_year")
PENALTIES = {
    "missing_subject": 0.4, "invalid_subject_name": 0.4, "invalid_day": 0.4, "invalid_time": 0.4, "invalid_classroom": 0.4, "invalid_academic_year": 0.4,
    "fragmented_subject": 0.6, "suspicious_classroom": 0.15, "unknown_classroom": 0.15, "missing_classroom": 0.15, "missing_degree": 0.15,
    "missing_academic_year": 0.10, "incompatible_subgroup": 0.15,
}
OTHER_PENALTY = 0.10
JUNK_NAME = r"(?i)^(?:\d+[A-Z]\d*|\([A-Z0-9]+\)|-\s*\d+[A-Z]\d*|\d+)$"
FRAGMENT = r"^(DE|DEL|LA|EL|LOS|LAS|EN|Y|A|AL|CON|PARA|POR)\b"
NO_ROOM = ("*", "-", "--", "N/A", "NA")
PENDING_ROOM = r"^PEND\.?(IENTE)?\s*(DE\s*)?ASIG"
TIME_LIKE = r"\d{1,2}[:.]\d{2}"
KNOWN_ROOM = r"^[A-Z]{1,4}\d{1,3}[A-Z]?(?:[/-][A-Z]{1,4}\d{1,3}[A-Z]?)*$"


def name_issue(name: Column, folded: Column | None = None) -> Column:
    """``folded``: the comparable name, where it is at hand."""
    t = T.comparable(name) if folded is None else folded
    return (
        F.when(T.blank(name), "missing_subject")
        .when((F.length(t) < 3) | ~t.rlike("[A-Z]{3,}") | t.rlike(JUNK_NAME), "invalid_subject_name")
        .when(t.rlike(FRAGMENT) & (F.size(F.split(t, r"\s+")) <= 3), "fragmented_subject")
    )


def room_issue(room: Column, folded: Column | None = None) -> Column:
    t = T.comparable(room) if folded is None else folded
    return (
        F.when(T.blank(F.trim(room)), "missing_classroom")
        .when(t.isin(*NO_ROOM) | t.rlike(PENDING_ROOM), "suspicious_classroom")
        .when(room.rlike(TIME_LIKE), "invalid_classroom")
        .when(~t.rlike(KNOWN_ROOM), "unknown_classroom")
    )


def kept_room(room: Column, issues: Column | None = None) -> Column:
    """The room, if it is one; ``issues``: all of the record, where they are at hand."""
    bad = room_issue(room).isin("missing_classroom", "suspicious_classroom", "invalid_classroom") if issues is None else F.arrays_overlap(issues, F.array(*[F.lit(x) for x in ("missing_classroom", "suspicious_classroom", "invalid_classroom")]))
    return F.when(~F.coalesce(bad, F.lit(False)), F.trim(room))


def year_issue(year: Column) -> Column:
    t = F.trim(year)
    first, second = (F.regexp_extract(t, r"^(\d{4})/(\d{4})$", i).try_cast("int") for i in (1, 2))
    return F.when(T.blank(year), "missing_academic_year").when(~F.coalesce(second == first + 1, F.lit(False)), "invalid_academic_year")


def subgroup_issue(group: Column, subgroup: Column) -> Column:
    both = ~T.blank(group) & ~T.blank(subgroup)
    return F.when(both & ~F.startswith(F.upper(subgroup), F.upper(group)), "incompatible_subgroup")


def valid_day(day: Column) -> Column:
    return T.comparable(day).isin(*DAYS)


def valid_times(start: Column, end: Column) -> Column:
    return F.coalesce(T.minutes(end) > T.minutes(start), F.lit(False))


def issues(day: Column, start: Column, end: Column, name: Column, room: Column, year: Column, degree: Column, group: Column, subgroup: Column, name_folded: Column | None = None, room_folded: Column | None = None) -> Column:
    """All issues in the rules' order."""
    rules = [
        F.when(~valid_day(day), "invalid_day"), F.when(~valid_times(start, end), "invalid_time"), name_issue(name, name_folded), room_issue(room, room_folded),
        year_issue(year), F.when(T.blank(degree), "missing_degree"), subgroup_issue(group, subgroup),
    ]
    return F.array_except(F.array(*rules), F.array(F.lit(None).cast("string")))


def confidence(found: Column) -> Column:
    penalties = F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair])
    left = F.aggregate(found, F.lit(1.0), lambda acc, x: acc - F.coalesce(F.try_element_at(penalties, x), F.lit(OTHER_PENALTY)))
    return F.round(F.greatest(F.lit(0.0), F.least(left, F.lit(1.0))), 2)


def is_accepted(found: Column, score: Column) -> Column:
    return ~F.arrays_overlap(found, F.array(*[F.lit(x) for x in ERRORS])) & (score >= MIN_CONFIDENCE)


def validate(records: DataFrame) -> DataFrame:
    """Normalised records with ``issues``, ``confidence``, ``accepted``; a room that is none is taken out. What several
    rules look at is computed once, in a projection below theirs. Filters on what comes out are not moved below the
    rules (no filter goes through a projection with a partition's number): there they would be all rules and all that
    these look at, written out as one expression, once for every place where one names another."""
    c = F.col
    folded = records.withColumns({"_name": T.comparable(c("name")), "_room": T.comparable(c("classroom"))})
    found = issues(c("day"), c("start_time"), c("end_time"), c("name"), c("classroom"), c("academic_year"), c("degree_name"), c("grp"), c("subgroup"), c("_name"), c("_room"))
    out = folded.withColumns({"_issues": found, "_part": F.spark_partition_id()}).withColumn("issues", F.when(c("_part") >= 0, c("_issues"))).withColumn("confidence", confidence(c("issues")))
    return out.withColumn("accepted", is_accepted(c("issues"), c("confidence"))).withColumn("classroom", kept_room(c("classroom"), c("issues"))).drop("_name", "_room", "_issues", "_part")
