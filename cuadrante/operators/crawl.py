"""A crawl over stored pages: where it may start, what it visits within its limits, which PDFs it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import strip
from ..sources.shared import scratch, settle

MAX_DEPTH, MAX_PAGES = 2, 50


def start_problem(url: Column) -> Column:
    """What is wrong with a start url: "empty" or "scheme"; null if nothing is."""
    t = strip(F.coalesce(url, F.lit("")))
    return F.when(t == "", "empty").when(~(F.startswith(t, F.lit("http://")) | F.startswith(t, F.lit("https://"))), "scheme")


def crawl(pages: DataFrame, start: str, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES, follow: bool = False) -> tuple[DataFrame, DataFrame]:
    """(visited: url, depth), (found: url, on_depth) over ``pages`` (page_id, url, html), links of the start's host only.

    As it was, the crawl looks for PDFs on its start page alone; with ``follow`` it goes on to linked pages, level by
    level, in the order of urls within a level, up to ``max_depth`` and ``max_pages`` pages. A start or page that isn't
    stored can't be read and gives no links. What is visited is bounded by ``max_pages``, so it may be collected; the
    links of a level are not, and stay in their table."""
    spark = pages.sparkSession
    first = spark.range(1).select(U.normalize(F.lit(start)).alias("u")).first()["u"]
    seen: list[tuple[str, int]] = []
    level, found = [first] if first and max_pages > 0 else [], None
    known = pages.withColumn("url", U.normalize(F.col("url"))).where("url is not null")
    host = first.split("/")[2] if first else ""
    for depth in range(max_depth + 1):
        level = level[: max_pages - len(seen)]
        if not level:
            break
        seen += [(u, depth) for u in level]
        if any(u.split("?")[0].lower().endswith(".pdf") for u in level):
            own = spark.createDataFrame([(u, depth) for u in level if u.split("?")[0].lower().endswith(".pdf")], "url string, on_depth int")
            found = own if found is None else found.unionByName(own)
        links = U.extract_links(known.where(F.col("url").isin(level))).select(F.col("link").alias("url")).distinct()
        links = links.where(~U.is_skipped(F.col("url"), F.lit(host)))
        pdfs = links.where(U.is_pdf(F.col("url"))).withColumn("on_depth", F.lit(depth))
        found = pdfs if found is None else found.unionByName(pdfs)
        if not follow:
            break
        rest = links.where(~U.is_pdf(F.col("url")) & ~F.col("url").isin([u for u, _ in seen])).orderBy("url")
        level = [r["url"] for r in rest.limit(max_pages).collect()]
    none = spark.createDataFrame([], "url string, on_depth int")
    found = (none if found is None else found).groupBy("url").agg(F.min("on_depth").alias("on_depth"))
    return spark.createDataFrame(seen, "url string, depth int"), found


def numbered(table: DataFrame, name: str, order: list[str], within: list[str] = ()) -> DataFrame:
    """``table`` with the place of each row, from 1, in ``order`` (which tells rows apart), for each value of ``within``.

    Rows are sorted in ranges; what comes before a range is added up from the ranges' counts. So one value may hold any
    share of the rows, and no task sorts more than a range."""
    ranges = settle(table.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*order))
    return ranges.withColumn("_inside", inside).join(before, [*within, "_range"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_range")


def crawl_table(pages: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int | None = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """(visited: url, depth), (found: url, on_depth), as ``crawl`` with ``follow``, from any number of ``starts`` (url).

    What is visited, and what is due next, are tables: a level is joined with the links of stored pages and loses what
    was visited, so neither the number of starts nor that of pages is bounded by the driver. A link is followed on the
    host of its page. Where a level doesn't fit into ``max_pages`` (None: no limit), hosts take turns: the first url of
    each, then the second of each, in the order of urls; with one start that is the order of ``crawl``.

    Starts that are null, repeated, not http or not stored: the first three count once or not at all, the last are
    visited and give no links. Pages may repeat a url; their links are put together. Other columns don't matter."""
    spark = pages.sparkSession
    if max_pages is not None and max_pages < 0 or max_depth < 0:
        raise ValueError("limits can't be negative")
    folder = scratch(spark)
    due = settle(starts.select(U.normalize(F.col("url")).alias("url")).where("url is not null").distinct().withColumn("host", U.host(F.col("url"))))
    own = pages.select(U.normalize(F.col("url")).alias("url"), "html").where("url is not null")
    own = own.join(due.select(F.col("host").alias("own")).distinct(), U.host(F.col("url")) == F.col("own"), "left_semi")
    links = U.extract_links(own.select(F.col("url").alias("page_id"), "url", "html")).select(F.col("page_id").alias("page"), F.col("link").alias("url"))
    links = settle(links.where(~U.is_skipped(F.col("url"), U.host(F.col("page")))).withColumns({"host": U.host(F.col("url")), "pdf": U.is_pdf(F.col("url"))}))
    visited, taken = spark.createDataFrame([], "url string, host string, depth int"), 0
    for depth in range(max_depth + 1):
        if depth:
            level = visited.where(F.col("depth") == depth - 1).select(F.col("url").alias("page"))
            new = links.where("not pdf").join(level, "page", "left_semi").select("url", "host").distinct()
            due = settle(new.join(visited.select("url"), "url", "left_anti"))
        many = due.count()
        room = many if max_pages is None else min(many, max_pages - taken)
        if not room:
            break
        if room < many:
            turns = numbered(numbered(due, "turn", ["url"], ["host"]), "place", ["turn", "url"])
            due = turns.where(F.col("place") <= room).select("url", "host")
        due.write.parquet(f"{folder}/depth={depth}")
        visited, taken = spark.read.schema(visited.schema).parquet(folder), taken + room
    pdfs = links.where("pdf").join(visited.select(F.col("url").alias("page"), "depth"), "page").select("url", "depth")
    found = pdfs.unionByName(visited.where(U.is_pdf(F.col("url"))).select("url", "depth"))
    return visited.select("url", "depth"), found.groupBy("url").agg(F.min("depth").alias("on_depth"))
