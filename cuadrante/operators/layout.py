"""Page geometry to table cells: day columns, time rows, a range join of words to cells, text from words.

Tables: words (file, page, ord, text, x0, y0, x1, y1), blocks (the same), pages (file, page, width, height). All joins
are on (file, page); ordered folds run inside a page's row, so no state leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .parsing import TIME_RANGE
from .quality import DAYS

PAGE = ["file", "page"]
LINE_TOLERANCE = 4.0
DUPLICATE_GAP = 8.0


def prepared_words(words: DataFrame) -> DataFrame:
    """Clean words with their centres; empty ones go."""
    out = words.withColumn("text", T.clean(F.col("text"))).where("text <> ''")
    return out.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def day_headers(words: DataFrame) -> DataFrame:
    """The topmost word of each day on a page: (file, page, day_idx, day, cx)."""
    day = T.comparable(F.col("text"))
    found = words.withColumn("day", day).where(F.col("day").isin(*DAYS))
    top = found.groupBy(*PAGE, "day").agg(F.min_by("cx", F.struct("cy", "ord")).alias("cx"))
    return top.withColumn("day_idx", (F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col("day")) - 1).cast("int"))


def day_columns(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, page, day_idx, day, x0, x1, center). All five days: midpoints between headers, the edges extrapolated and
    clamped. Three or four: five equal columns from the first one found. Fewer: none."""
    w = Window.partitionBy(*PAGE)
    by_day = w.orderBy("day_idx")
    h = headers.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("lo", F.min("cx").over(w)).withColumn("hi", F.max("cx").over(w)).where("n >= 3")
    h = h.withColumn("before", F.lag("cx").over(by_day)).withColumn("after", F.lead("cx").over(by_day))
    full = h.where("n = 5").join(pages.select(*PAGE, "width"), PAGE)
    c = F.col
    left = F.when(c("day_idx") == 0, F.greatest(F.lit(0.0), c("cx") - (c("after") - c("cx")) / 2)).otherwise((c("before") + c("cx")) / 2)
    right = F.when(c("day_idx") == 4, F.least(c("width"), c("cx") + (c("cx") - c("before")) / 2)).otherwise((c("cx") + c("after")) / 2)
    full = full.select(*PAGE, "day_idx", "day", left.alias("x0"), right.alias("x1"), c("cx").alias("center"))
    part = h.where("n < 5").select(*PAGE, "lo", ((c("hi") - c("lo")) / (c("n") - 1)).alias("step")).distinct()
    part = part.select(*PAGE, "lo", "step", F.posexplode(F.array(*[F.lit(d) for d in DAYS])).alias("day_idx", "day"))
    center = c("lo") + c("step") * c("day_idx")
    part = part.select(*PAGE, "day_idx", "day", (center - c("step") / 2).alias("x0"), (center + c("step") / 2).alias("x1"), center.alias("center"))
    return full.unionByName(part)


def time_rows(blocks: DataFrame) -> DataFrame:
    """(file, page, ord, k, start_time, end_time, y): every time range of a block, at the block's middle."""
    t = T.clean(F.col("text"))
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(TIME_RANGE), F.lit(1)).alias("s"), F.regexp_extract_all(t, F.lit(TIME_RANGE), F.lit(2)).alias("e"))
    rows = blocks.select(*PAGE, "ord", ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.posexplode(pairs).alias("k", "p"))
    return rows.select(*PAGE, "ord", "k", T.hour(F.col("p.s")).alias("start_time"), T.hour(F.col("p.e")).alias("end_time"), "y")


def drop_near_rows(rows: DataFrame, gap: float = DUPLICATE_GAP) -> DataFrame:
    """By y, a row goes if one that stays has the same times and is less than ``gap`` away. Only the last row that stays
    of equal times can be that near, so the fold keeps one number."""
    one = F.struct("y", "ord", "k")
    kept = F.aggregate(
        F.array_sort(F.collect_list(one)),
        F.array().cast("array<struct<y:double,ord:bigint,k:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.abs(x["y"] - F.get(acc, F.size(acc) - 1)["y"]) < gap), acc).otherwise(F.array_append(acc, x)),
    )
    rows = rows.withColumn("ord", F.col("ord").cast("long")).withColumn("k", F.col("k").cast("int"))
    return rows.groupBy(*PAGE, "start_time", "end_time").agg(kept.alias("kept")).select(*PAGE, "start_time", "end_time", F.explode("kept").alias("x")).select(*PAGE, "start_time", "end_time", "x.y", "x.ord", "x.k")


def row_bounds(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(…, row_idx, y0, y1): halfway to the neighbours, extrapolated at both ends, 20 around a single row, on the page."""
    w = Window.partitionBy(*PAGE).orderBy("y", "ord", "k")
    r = rows.withColumn("row_idx", F.row_number().over(w) - 1).withColumn("before", F.lag("y").over(w)).withColumn("after", F.lead("y").over(w))
    y, before, after = F.col("y"), F.col("before"), F.col("after")
    upper = F.coalesce((before + y) / 2, y - (after - y) / 2, y - 20)
    lower = F.coalesce((y + after) / 2, y + (y - before) / 2, y + 20)
    out = r.join(pages.select(*PAGE, "height"), PAGE)
    return out.select(*PAGE, "row_idx", "start_time", "end_time", "y", F.greatest(F.lit(0.0), upper).alias("y0"), F.least(F.col("height"), lower).alias("y1"))


def cell_words(words: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Words in cells; a word on a border is in both. Words that look like a time are left out.

    A page's rows and columns come to its words as two short arrays, and a word leaves its row only for the cells that
    it is in: the join gives a row a word, not one for every cell of the page."""
    row = F.struct("row_idx", "start_time", "end_time", F.col("y0").alias("cy0"), F.col("y1").alias("cy1"))
    column = F.struct("day_idx", "day", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"))
    page = rows.groupBy(*PAGE).agg(F.collect_list(row).alias("_rows")).join(columns.groupBy(*PAGE).agg(F.collect_list(column).alias("_columns")), PAGE)
    inside = lambda cells, at, low, high: F.filter(cells, lambda c: F.col(at).between(c[low], c[high]))
    met = words.where(~F.col("text").rlike(r"^\d{1,2}:\d{2}")).join(page, PAGE)
    met = met.withColumn("_row", F.explode(inside(F.col("_rows"), "cy", "cy0", "cy1"))).withColumn("_column", F.explode(inside(F.col("_columns"), "cx", "cx0", "cx1")))
    return met.select(*words.columns, "_row.*", "_column.*")


def lines_of(words: Column, tolerance: float = LINE_TOLERANCE) -> Column:
    """Text of an array of struct(cy, x0, ord, text): sorted by height, a word joins the line whose mean height is within
    the tolerance; words of a line go from left to right."""
    word = "struct<x0:double,ord:bigint,text:string>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.array().cast(f"array<{word}>").alias("line"), F.array().cast("array<string>").alias("out"))
    text = lambda line: F.array_join(F.transform(F.array_sort(line), lambda w: w["text"]), " ")

    def step(acc, w):
        own = F.struct(w["x0"].alias("x0"), w["ord"].alias("ord"), w["text"].alias("text"))
        joins = (acc["n"] > 0) & (F.abs(w["cy"] - acc["sum"] / acc["n"]) <= tolerance)
        more = F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + w["cy"]).alias("sum"), F.array_append(acc["line"], own).alias("line"), acc["out"].alias("out"))
        done = F.when(acc["n"] > 0, F.array_append(acc["out"], text(acc["line"]))).otherwise(acc["out"])
        fresh = F.struct(F.lit(1).alias("n"), w["cy"].alias("sum"), F.array(own).alias("line"), done.alias("out"))
        return F.when(joins, more).otherwise(fresh)

    end = lambda acc: F.array_join(F.when(acc["n"] > 0, F.array_append(acc["out"], text(acc["line"]))).otherwise(acc["out"]), " ")
    return F.aggregate(F.array_sort(words), start, step, end)


def build_cells(words: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, page, row_idx, day_idx, day, start_time, end_time, cell_text): the non-empty cells of every page."""
    words = prepared_words(words)
    placed = cell_words(words, row_bounds(drop_near_rows(time_rows(blocks)), pages), day_columns(day_headers(words), pages))
    one = F.struct(F.col("cy").cast("double").alias("cy"), F.col("x0").cast("double").alias("x0"), F.col("ord").cast("long").alias("ord"), "text")
    cells = placed.groupBy(*PAGE, "row_idx", "day_idx", "day", "start_time", "end_time").agg(lines_of(F.collect_list(one)).alias("cell_text"))
    return cells.withColumn("cell_text", T.clean(F.col("cell_text"))).where("cell_text <> ''")
