"""The review table: items from records, filters, search, order, pages, facets, the count tree, and an edit log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The fields of a record that can be edited.
FIELDS = ("degree_code", "degree_name", "academic_year", "semester", "year", "grp", "day", "start_time", "end_time", "subject_code", "name", "subgroup", "classroom", "notes")
NULL = "__NULL__"
NO_DEGREE, NO_YEAR, NO_SEMESTER, NO_GROUP = "Sin titulación", "Sin curso", "Sin cuatrimestre", "Sin grupo"
STATUSES = ("VALID", "WARNING", "INVALID")


def editable(table: DataFrame) -> Column:
    """The fields that can be edited, as one struct in the documents' shape."""
    known = {f.lower() for f in table.columns}
    field = lambda c, kind="string": F.col(c) if c in known else F.lit(None).cast(kind)
    return F.struct(
        F.struct(field("degree_code").alias("code"), field("degree_name").alias("name")).alias("degree"),
        field("academic_year").alias("academic_year"), field("semester", "int").cast("int").alias("semester"), field("year", "int").cast("int").alias("year"), field("grp").alias("group"), field("day").alias("day"),
        field("start_time").alias("start_time"), field("end_time").alias("end_time"),
        F.struct(field("subject_code").alias("code"), field("name").alias("name")).alias("subject"),
        field("subgroup").alias("subgroup"), field("classroom").alias("classroom"), F.coalesce(field("notes", "array<string>"), F.array().cast("array<string>")).alias("notes"),
    )


#: Where each of FIELDS stands in that struct.
PLACES = {"degree_code": "degree.code", "degree_name": "degree.name", "grp": "group", "subject_code": "subject.code", "name": "subject.name"}


def items(records: DataFrame) -> DataFrame:
    """One item per record; accepted ones come first (``item_ord``), each in the records' order (ord, pos). The fields
    as extracted stay in ``original``. ``reason`` of a rejected record, where given, goes before its issues."""
    seq = F.row_number().over(Window.partitionBy("origin", "file", "page").orderBy("ord", "pos"))
    out = with_origin(records).withColumn("seq", seq)
    status = F.when(~F.col("accepted"), "INVALID").when(F.size("issues") > 0, "WARNING").otherwise("VALID")
    given = F.col("reason") if "reason" in records.columns else F.lit(None).cast("array<string>")
    out = out.withColumns({
        "id": T.item_id(F.col("origin"), F.col("file"), F.col("page"), F.col("seq")),
        "status": status, "original_status": status, "reviewed": F.lit(False), "manually_modified": F.lit(False),
        "subject_code": F.lit(None).cast("string"),
        "original_reason": F.when(F.size(F.coalesce(given, F.array())) > 0, given).otherwise(F.col("issues")),
        "item_ord": F.struct((~F.col("accepted")).cast("int").alias("origin"), F.col("ord").alias("ord"), F.col("pos").alias("pos")),
    })
    return out.withColumn("original", editable(out))


def documents(table: DataFrame) -> DataFrame:
    """Items in the shape of the review document."""
    return table.select(
        "id", "origin", "status", "original_status", "reviewed", "manually_modified", F.col("issues").alias("original_issues"), "original_reason", "confidence",
        editable(table).alias("current"), "original", F.struct("file", "page", "raw_text").alias("source"),
    )


def degree_key():
    return F.coalesce(T.null_if_blank(F.col("degree_code")), F.col("degree_name"))


def apply_filters(table: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Conjunction of the filters that are given (None and "" are not): degree, year, semester, group, day, pdf compare
    as text, a null reads None, and ``__NULL__`` asks for null, empty or zero; status, issue, search."""
    fields = {"degree": degree_key(), "year": F.col("year"), "semester": F.col("semester"), "group": F.col("grp"), "day": F.col("day"), "pdf": F.col("file")}
    if filters.get("status"):
        table = table.where(F.col("status") == filters["status"])
    for name, field in fields.items():
        value = filters.get(name)
        if value is None or value == "":
            continue
        as_text = F.coalesce(field.cast("string"), F.lit("None"))
        if value == NULL:
            table = table.where(F.coalesce(field.cast("string"), F.lit("")).isin("", "0") if name in ("year", "semester") else F.coalesce(field, F.lit("")) == "")
        else:
            table = table.where(as_text == str(value))
    if filters.get("issue"):
        table = table.where(F.array_contains("issues", filters["issue"]))
    if filters.get("search"):
        table = table.where(matches(str(filters["search"])))
    return table


def matches(query: str):
    """Substring of the joined text fields, in any case, accents counting."""
    return F.contains(searched_text(), F.lit(query.strip().lower()))


def searched_text() -> Column:
    """What a search looks at."""
    return F.lower(F.concat_ws(" ", "name", "subject_code", "classroom", "grp", "subgroup", "raw_text", "file", "degree_name", "degree_code"))


def order():
    """Degree, year, semester, group, day, start and subject; last the table's own order."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [text("degree_name"), F.coalesce("year", F.lit(99)), F.coalesce("semester", F.lit(99)), text("grp"), text("day"), text("start_time"), text("name"), F.col("item_ord")]


def page(table: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """A page of the ordered table; numbers below 1 and sizes outside 1 to 200 are clamped. One top-k, not a sort."""
    number, size = max(1, number), min(max(1, size), 200)
    return table.orderBy(*order()).offset((number - 1) * size).limit(size)


def page_info(total: int, number: int, size: int) -> dict[str, int]:
    """As asked for, not clamped."""
    return {"total": total, "page": number, "page_size": size, "total_pages": -(-total // size) if size else 0}


def find(table: DataFrame, item: str) -> DataFrame:
    return table.where(F.col("id") == item).limit(1)


def facets(table: DataFrame) -> DataFrame:
    """(facet, value), sorted: distinct values of each facet that aren't missing, years and semesters as numbers, all
    others as text, statuses in their own order. One pass: every item gives its values, and the distinct ones are found
    before anything moves."""
    value = lambda name, c: F.struct(F.lit(name).alias("facet"), F.when(~T.blank(c.cast("string")), c.cast("string")).alias("value"))
    own = F.array(*[value(n, F.col(c)) for n, c in (("years", "year"), ("semesters", "semester"), ("groups", "grp"), ("days", "day"), ("pdfs", "file"))])
    found = F.concat(own, F.transform("issues", lambda x: value("issues", x)))
    out = table.select(F.explode(found).alias("x")).select("x.*").where("value is not null").distinct()
    return out.unionByName(table.sparkSession.createDataFrame([("statuses", s) for s in STATUSES], out.schema)).orderBy(*facet_order())


def facet_order() -> list[Column]:
    number = F.when(F.col("facet").isin("years", "semesters"), F.col("value").try_cast("int"))
    place = F.when(F.col("facet") == "statuses", F.array_position(F.array(*map(F.lit, STATUSES)), F.col("value")))
    return [F.col("facet"), number, place, F.col("value")]


def degree_facet(table: DataFrame) -> DataFrame:
    """(code, label, first): key is code or else name, label the other way round; of differing labels the last counts."""
    key = F.coalesce(T.null_if_blank(F.col("degree_code")), T.null_if_blank(F.col("degree_name")))
    label = F.coalesce(T.null_if_blank(F.col("degree_name")), F.col("degree_code"))
    rows = table.select(key.alias("code"), label.alias("label"), "item_ord").where("code is not null")
    return rows.groupBy("code").agg(F.max_by("label", "item_ord").alias("label"), F.min("item_ord").alias("first")).orderBy("label", "first")


def labels() -> dict[str, Column]:
    """An item's labels on the four levels of the tree."""
    return {
        "degree": F.coalesce(T.null_if_blank(F.col("degree_name")), F.lit(NO_DEGREE)),
        "year": F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR)),
        "semester": F.coalesce(F.col("semester").cast("string"), F.lit(NO_SEMESTER)),
        "grp": F.coalesce(T.null_if_blank(F.col("grp")), F.lit(NO_GROUP)),
    }


def tree(table: DataFrame) -> DataFrame:
    """(degree, year, semester, grp, level, n, degree_code): counts of all prefixes of the four levels; labels stand for
    what is missing, and degree_code is that of the degree's first item. In order: a node before its children, and those
    of a node by their labels as text."""
    rows = table.select(*[label.alias(c) for c, label in labels().items()], "degree_code", "item_ord")
    counts = rows.rollup("degree", "year", "semester", "grp").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.min_by("degree_code", "item_ord").alias("degree_code"))
    level = F.when(F.col("g") == 7, 1).when(F.col("g") == 3, 2).when(F.col("g") == 1, 3).when(F.col("g") == 0, 4)
    by_label = [F.col("degree"), *[F.col(c).asc_nulls_first() for c in ("year", "semester", "grp")]]
    return counts.withColumn("level", level).where("level is not null").orderBy(*by_label).select("degree", "year", "semester", "grp", "level", "n", F.when(F.col("level") == 1, F.col("degree_code")).alias("degree_code"))


SUMMARY = ("pdfs_found", "pdfs_processed", "pdfs_failed", "accepted_records", "records_with_warnings", "rejected_records")


def summary(table: DataFrame, statistics: DataFrame, failed: DataFrame | None = None, processed_at: Column | None = None) -> DataFrame:
    """One row: what the extraction counted (``statistics``, one row of records.global_stats), the failed files (file,
    error), and how many items are reviewed by now."""
    spark = table.sparkSession
    at = F.lit(None).cast("string") if processed_at is None else processed_at
    bad = spark.createDataFrame([], "file string, error string") if failed is None else failed
    parts = [
        statistics.select(*SUMMARY, at.alias("processed_at"), F.lit(None).cast("long").alias("reviewed_records"), F.array().cast("array<struct<file:string,error:string>>").alias("failed_files")),
        table.agg(F.count_if("reviewed").alias("reviewed_records")),
        bad.agg(F.array_sort(F.collect_list(F.struct("file", "error"))).alias("failed_files")),
    ]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    count = {c: F.coalesce(F.max(c), F.lit(0)).alias(c) for c in SUMMARY}
    total = F.coalesce(F.max("accepted_records"), F.lit(0)) + F.coalesce(F.max("rejected_records"), F.lit(0))
    return every.agg(F.max("processed_at").alias("processed_at"), *count.values(), total.alias("total_records"), F.max("reviewed_records").alias("reviewed_records"), F.flatten(F.collect_list("failed_files")).alias("failed_files"))


def fold(log: DataFrame) -> DataFrame:
    """One row per id of an edit log (id, seq, kind, and for ``edit`` the FIELDS, for ``status`` new_status): the number
    r of the last restore, the last edit e, the last status s, and how many events counted. Only maxima by number, so
    events may come in any order, late or twice. Works on a stream, whose state is then one such row per id."""
    known = [f for f in FIELDS if f in log.columns]
    is_kind = lambda k: F.col("kind") == k
    return log.where("id is not null").groupBy("id").agg(
        F.max(F.when(is_kind("restore"), F.col("seq"))).alias("r"),
        F.max_by(F.struct(F.col("seq").alias("at"), *known), F.when(is_kind("edit"), F.col("seq"))).alias("e"),
        F.max_by(F.struct(F.col("seq").alias("at"), "new_status"), F.when(is_kind("status") & F.col("new_status").isin(*STATUSES), F.col("seq"))).alias("s"),
        F.count_if(is_kind("edit") | is_kind("restore") | F.col("new_status").isin(*STATUSES)).alias("events"),
    )


def replay(table: DataFrame, log: DataFrame) -> DataFrame:
    """``table`` after an edit log, see ``fold`` and ``apply``."""
    return apply(table, fold(log))


def apply(table: DataFrame, last: DataFrame) -> DataFrame:
    """``table`` after what ``fold`` made of an edit log.

    Edits replace all fields and mark a difference from the original; a status replaces the status; a restore takes
    both back. All mark the item as reviewed. Only the last edit and the last status after the last restore count, so
    one join does; ids that are in no item are ignored. The table may be one that was edited and stored before:
    originals stand in ``original``."""
    known = [f for f in FIELDS if f in table.columns and f in last.schema["e"].dataType.fieldNames()]
    out = table.join(last, "id", "left")
    after = lambda c: F.col(f"{c}.at").isNotNull() & (F.col(f"{c}.at") > F.coalesce("r", F.lit(-1)))
    edited, marked, restored = after("e"), after("s"), F.col("r").isNotNull()
    as_of = lambda get: F.struct(*[get(f).alias(f) for f in known])
    original = as_of(lambda f: F.col(f"original.{PLACES.get(f, f)}"))
    out = out.withColumn("_now", F.when(edited, as_of(lambda f: F.col(f"e.{f}"))).when(restored, original).otherwise(as_of(F.col)))
    out = out.withColumn("manually_modified", F.when(edited, ~F.col("_now").eqNullSafe(original)).otherwise(F.col("manually_modified") & ~restored))
    out = out.withColumn("status", F.when(marked, F.col("s.new_status")).when(restored, F.col("original_status")).otherwise(F.col("status")))
    out = out.withColumn("reviewed", F.col("reviewed") | (F.coalesce("events", F.lit(0)) > 0))
    return out.withColumns({f: F.col(f"_now.{f}") for f in known}).drop("_now", "r", "e", "s", "events")


def with_origin(records: DataFrame) -> DataFrame:
    """Records of one table with their origin, in one pass; two tables are put together by ``union_origin``."""
    return records.withColumn("origin", F.when(F.col("accepted"), "accepted").otherwise("rejected"))


def union_origin(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted rows, then rejected ones, with their origin."""
    return accepted.withColumn("origin", F.lit("accepted")).unionByName(rejected.withColumn("origin", F.lit("rejected")), allowMissingColumns=True)


def without(table: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    return table.join(selected.select(key).distinct(), key, "left_anti")


def without_repeats(chosen: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    """The chosen rows that aren't selected yet, each once."""
    return without(chosen.dropDuplicates([key]), selected, key)
