"""Joins on overlapping intervals: conflicts, the slot grid, nearest rows.

Overlap is strict: intervals that touch don't overlap. A pair is found by binning: each interval goes to every bin of
``bin_width`` that it reaches, so the join is an equi-join on key and bin, and a pair counts in the first bin that both
reach. Without bins one busy key would be compared with itself as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: float) -> Column:
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.ceil(end / width) - 1))


def overlap_pairs(rows: DataFrame, key: list[str], start: str, end: str, order: str, bin_width: float = 60.0, distinct_by: str | None = None) -> DataFrame:
    """Pairs a before b (by ``order``) of rows with equal keys whose intervals overlap; columns with suffixes _a and _b.
    With ``distinct_by`` only rows that differ in it pair up."""
    binned = rows.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), bin_width)))
    side = lambda s: binned.select("_bin", *key, *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c not in key])
    a, b = side("a"), side("b")
    meet = (F.col(f"{start}_a") < F.col(f"{end}_b")) & (F.col(f"{start}_b") < F.col(f"{end}_a")) & (F.col(f"{order}_a") < F.col(f"{order}_b"))
    if distinct_by:
        meet &= F.col(f"{distinct_by}_a") != F.col(f"{distinct_by}_b")
    first = F.greatest(F.floor(F.col(f"{start}_a") / bin_width), F.floor(F.col(f"{start}_b") / bin_width))
    return a.join(b, ["_bin", *key]).where(meet & (F.col("_bin") == first)).drop("_bin")


def conflict_rows(pairs: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Both sides of each pair as rows; duplicates stay."""
    side = lambda s: F.struct(*[F.col(f"{c}_{s}").alias(c) for c in columns])
    return pairs.select(*key, F.explode(F.array(side("a"), side("b"))).alias("x")).select(*key, "x.*")


def mark_conflicts(rows: DataFrame, conflicts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``conflict``: whether an equal row is among the conflicts."""
    known = conflicts.select(*on).distinct().withColumn("conflict", F.lit(True))
    return rows.join(known, on, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def slot_grid(rows: DataFrame, start: str, end: str, first: int = 8 * 60, slots: int = 11, width: int = 60) -> DataFrame:
    """Each row with every slot (its first minute) that it overlaps, by arithmetic instead of a range join."""
    low = F.greatest(F.floor((F.col(start) - first) / width), F.lit(0))
    high = F.least(F.ceil((F.col(end) - first) / width) - 1, F.lit(slots - 1))
    some = (F.col(start) < F.col(end)) & (low <= high)
    return rows.withColumn("slot", F.explode(F.when(some, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))).withColumn("slot", (F.col("slot") * width + first).cast("int"))


def nearest(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, right_order: str, id_col: str, within: float = 30.0) -> DataFrame:
    """Each left row with the right row of its key that is nearest, if it is under ``within`` away; the first in
    ``right_order`` of two as near. Right rows are looked for in the left one's bin and the two beside it."""
    l = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(left_at) / within) + d for d in (-1, 0, 1)])))
    r = right.withColumn("_bin", F.floor(F.col(right_at) / within))
    gap = F.abs(F.col(left_at) - F.col(right_at))
    found = l.join(r, [*key, "_bin"]).where(gap < within)
    best = found.groupBy(id_col).agg(F.min(F.struct(gap.alias("gap"), F.col(right_order).alias("at"))).alias("x"))
    return left.join(best.select(id_col, F.col("x.at").alias("nearest"), F.col("x.gap").alias("gap")), id_col, "left")


def colour_index(selected: DataFrame, subject: str, order: str, colours: int = 8, buckets: int = 64) -> DataFrame:
    """Subjects by first selection, modulo the number of colours; subjects with equal firsts share one.

    Ranks are counted in ``buckets`` ranges of the order and added up over these, so no task ranks all subjects."""
    first = selected.groupBy(subject).agg(F.min(order).alias("first"))
    cuts = first.select(F.percentile_approx("first", [i / buckets for i in range(1, buckets)])).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x <= F.col("first"))) if cuts else F.lit(0)
    ranked = first.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    sizes = ranked.groupBy("_bucket").agg((F.count_distinct("first") + F.max(F.col("first").isNull().cast("int"))).alias("n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a bucket
    offsets = sizes.select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy("first")) - 1 + F.col("_before")
    return ranked.join(F.broadcast(offsets), "_bucket").select(subject, (rank % colours).cast("int").alias("colour"))
