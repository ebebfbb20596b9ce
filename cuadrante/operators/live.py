"""Facets and the count tree kept under edits: counts that take what an edit removes and add what it brings.

An item counts once for each facet value it has and once for its leaf of the tree; all of this is one table of
(kind, key, n). What changes is a minus for the item as it was and a plus for the item as it is, so after any number of
edits the counts are those of a count from scratch, and a value that no item has is gone. A degree's code is that of its
first item, which can't be kept by adding: it is looked up again, for the degrees that an edit touches, in the items.

Defined cases: edits that change nothing leave nothing; items that are new or gone are a plus or a minus alone; empty
tables give no counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import review

FACETS = (("years", "year"), ("semesters", "semester"), ("groups", "grp"), ("days", "day"), ("pdfs", "file"))


def contributions(items: DataFrame, sign: int = 1) -> DataFrame:
    """(kind, key, n): what each item counts for; the key of a leaf has the labels of the four levels."""
    entry = lambda kind, *key: F.struct(F.lit(kind).alias("kind"), F.array(*key).alias("key"))
    own = [F.when(~T.blank(F.col(c).cast("string")), entry(name, F.col(c).cast("string"))) for name, c in FACETS]
    leaf = entry("leaf", *[review.labels()[c] for c in ("degree", "year", "semester", "grp")])
    issues = F.transform(F.filter("issues", lambda x: ~T.blank(x)), lambda x: entry("issues", x))
    every = F.concat(F.array_compact(F.array(*own, leaf)), issues)
    return items.select(F.explode(every).alias("x")).select("x.*", F.lit(sign).cast("long").alias("n"))


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def counts(items: DataFrame) -> DataFrame:
    """(kind, key, n) of all items."""
    return summed(contributions(items))


def changed(known: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``known`` counts after the items ``before`` have become ``after``; only what these two hold is looked at."""
    return summed(known.unionByName(contributions(before, -1)).unionByName(contributions(after)))


def facets(known: DataFrame) -> DataFrame:
    """As ``review.facets`` of the items."""
    spark = known.sparkSession
    values = known.where("kind <> 'leaf'").select(F.col("kind").alias("facet"), F.get("key", F.lit(0)).alias("value"))
    return values.unionByName(spark.createDataFrame([("statuses", s) for s in review.STATUSES], values.schema)).orderBy(*review.facet_order())


def codes(items: DataFrame) -> DataFrame:
    """(degree, code): the code of each degree's first item."""
    return items.groupBy(review.labels()["degree"].alias("degree")).agg(F.min_by("degree_code", "item_ord").alias("code"))


def changed_codes(known: DataFrame, items: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``known`` codes with those of the degrees that ``before`` or ``after`` name looked up in ``items`` as they are."""
    label = review.labels()["degree"].alias("degree")
    touched = F.broadcast(before.select(label).unionByName(after.select(label)).distinct())  # of the edited items
    again = codes(items.join(touched, review.labels()["degree"] == touched["degree"], "left_semi"))
    return known.join(touched, "degree", "left_anti").unionByName(again)


def tree(known: DataFrame, of_degrees: DataFrame) -> DataFrame:
    """As ``review.tree`` of the items."""
    names = ("degree", "year", "semester", "grp")
    leaves = known.where("kind = 'leaf'").select(*[F.get("key", F.lit(i)).alias(c) for i, c in enumerate(names)], "n")
    rolled = leaves.rollup(*names).agg(F.grouping_id().alias("g"), F.sum("n").alias("n"))
    level = F.when(F.col("g") == 7, 1).when(F.col("g") == 3, 2).when(F.col("g") == 1, 3).when(F.col("g") == 0, 4)
    found = rolled.withColumn("level", level).where("level is not null").join(of_degrees, "degree", "left")
    by_label = [F.col("degree"), *[F.col(c).asc_nulls_first() for c in names[1:]]]
    return found.orderBy(*by_label).select(*names, "level", "n", F.when(F.col("level") == 1, F.col("code")).alias("degree_code"))
