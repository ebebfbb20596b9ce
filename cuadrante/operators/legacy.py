"""Operators of the older record format: block-based columns and rows, nearest row, a four-pattern cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import nearest
from .parsing import TIME_RANGE

PAGE = ["file", "page"]
# Fixed values.
NOISE = ("APROBADO EN", "CONSULTE VERSIÓN", "LOS HORARIOS PODRÁN", "CADA ALUMNO", "CUATRIMESTRE", "CURSO 2025", "AULAS", "LABORATORIOS")
DAY_NAMES = ("LUNES", "MARTES", "MIÉRCOLES", "JUEVES", "VIERNES")
HEADER_MARGIN = 0.13
NEAR = 30.0
SUBGROUP = r"[A-Z0-9º]+"
ROOM = r"\(([^)]+)\)"
#: (pattern, groups of code, name, subgroup and room), tried in this order.
CASCADE = (
    (rf"^(\d{{6}})[- ]+(.+?)\s*-\s*({SUBGROUP})\*?\s*{ROOM}", (1, 2, 3, 4)),
    (rf"^(.+?)\s*-\s*({SUBGROUP})\*?\s*{ROOM}", (None, 1, 2, 3)),
    (rf"^(\d{{6}})[- ]+(.+?)\s*{ROOM}", (1, 2, None, 3)),
    (rf"^(.+?)\s*{ROOM}", (None, 1, None, 2)),
)


def clean(c: Column) -> Column:
    """As text.clean, but dashes stay."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), " ", " "), T.SPACE, " "))


def hour(c: Column) -> Column:
    t = clean(c)
    return F.when(t.rlike(r"^\d:\d{2}$"), F.concat(F.lit("0"), t)).otherwise(t)


def is_noise(c: Column) -> Column:
    """Notices and headings, day names and bare time ranges."""
    t = F.upper(F.coalesce(c, F.lit("")))
    heading = F.lit(False)
    for phrase in NOISE:
        heading |= F.contains(t, F.lit(phrase))
    return heading | t.isin(*DAY_NAMES) | t.rlike(rf"^{TIME_RANGE}$")


def day_columns(blocks: DataFrame) -> DataFrame:
    """Five equal columns from the first block of a page with three day names or more, past its left margin."""
    upper = F.upper(F.col("text"))
    n = F.lit(0)
    for d in DAY_NAMES:
        n = n + F.contains(upper, F.lit(d)).cast("int")
    head = blocks.withColumn("n", n).where("n >= 3").groupBy(*PAGE).agg(F.min_by(F.struct("x0", "x1"), "ord").alias("b"))
    left = F.col("b.x0") + (F.col("b.x1") - F.col("b.x0")) * HEADER_MARGIN
    step = (F.col("b.x1") - left) / len(DAY_NAMES)
    cols = head.select(*PAGE, left.alias("left"), step.alias("step"), F.posexplode(F.array(*[F.lit(d) for d in DAY_NAMES])).alias("day_idx", "day"))
    return cols.select(*PAGE, "day_idx", "day", (F.col("left") + F.col("step") * F.col("day_idx")).alias("x0"), (F.col("left") + F.col("step") * (F.col("day_idx") + 1)).alias("x1"))


def first_rows(rows: DataFrame) -> DataFrame:
    """Of rows with equal times on a page the topmost."""
    w = Window.partitionBy(*PAGE, "start_time", "end_time").orderBy("y", "ord")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assign_day(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """Blocks with the first column that holds their middle, borders included."""
    at = (F.col("x0") + F.col("x1")) / 2
    cols = columns.select(*PAGE, "day_idx", "day", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    found = blocks.join(cols, PAGE).where(at.between(F.col("c0"), F.col("c1"))).groupBy(*PAGE, "ord").agg(F.min_by("day", "day_idx").alias("day"))
    return blocks.join(found, [*PAGE, "ord"], "left")


def assign_time(blocks: DataFrame, rows: DataFrame, id_col: str = "block_id") -> DataFrame:
    """Blocks (cy) with the order of the nearest row (y), under NEAR away."""
    return nearest(blocks, rows, PAGE, "cy", "y", "row_idx", id_col, NEAR)


def parse_subject(c: Column) -> Column:
    """struct(code, name, subgroup, room, original_text) by the first pattern that fits with a name that isn't blank;
    else null."""
    t = clean(c)
    none = F.lit(None).cast("string")
    tries = []
    for pattern, groups in CASCADE:
        code, name, subgroup, room = (none if g is None else F.regexp_extract(t, pattern, g) for g in groups)
        fits = t.rlike(pattern) & (clean(name) != "")
        tries.append(F.when(fits, F.struct(code.alias("code"), F.upper(clean(name)).alias("name"), subgroup.alias("subgroup"), clean(room).alias("room"), t.alias("original_text"))))
    return F.coalesce(*tries)


def summary(files: DataFrame, records: DataFrame) -> DataFrame:
    """One row: processed files, with records or without, and records."""
    count = lambda df, pdfs, rows: df.agg((F.count(F.lit(1)) * pdfs).alias("total_pdfs"), (F.count(F.lit(1)) * rows).alias("total_records"))
    return count(files, 1, 0).unionByName(count(records, 0, 1)).agg(F.sum("total_pdfs").alias("total_pdfs"), F.sum("total_records").alias("total_records"))
