"""Which of many keys a text contains: one pass over the text, whatever the number of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import free_column

#: Characters of keys that go to every task as one automaton; more keys are joined.
AUTOMATON_CHARS = 4_000_000


def longest_contained(rows: DataFrame, text: str, keys: DataFrame, name: str, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``rows`` with ``name``: of the keys (key, rank) that the column ``text`` contains the longest, of a tie that of
    the smallest rank, null ranks last, then the smallest key; null if there is none or the text is null.

    Null and empty keys count for nothing, a key that is given twice has its smallest rank. Up to ``automaton_chars``
    characters of keys are searched by an automaton in the tasks (Aho and Corasick), without a shuffle. Beyond that the
    pieces of each distinct text, of the lengths that keys have, are joined with the keys."""
    if name in rows.columns:
        raise ValueError(f"{name} is a column already")
    own = keys.where("key <> ''").groupBy("key").agg(F.min("rank").alias("rank")).withColumn("n", F.length("key"))
    chars, count = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return rows.withColumn(name, F.lit(None).cast("string"))
    if chars <= automaton_chars:
        return rows.withColumn(name, _searched(own)(F.col(f"`{text}`")))
    return _joined(rows, text, own, name)


def _searched(own: DataFrame):
    """A function of a text column. The keys have a checked size; the order of preference is fixed here, once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    best_first = own.orderBy(F.desc("n"), F.asc_nulls_last("rank"), "key").collect()
    for place, row in enumerate(best_first):
        automaton.add_word(row["key"], place)
    automaton.make_automaton()
    words = [row["key"] for row in best_first]

    @F.pandas_udf("string")
    def search(texts):
        import pandas as pd

        found = (min((place for _, place in automaton.iter(t)), default=None) if t else None for t in texts)
        return pd.Series([None if place is None else words[place] for place in found], dtype=object)

    return search


def _joined(rows: DataFrame, text: str, own: DataFrame, name: str) -> DataFrame:
    """A text's pieces come from its distinct value, so rows that repeat it cost nothing; a piece meets one key."""
    lengths = F.lit([r["n"] for r in own.select("n").distinct().orderBy("n").collect()])  # fewer than the square root of twice the characters
    of = free_column(rows, "text")
    texts = rows.select(F.col(f"`{text}`").alias(of)).where(F.length(of) > 0).distinct()
    sized = texts.withColumn("n", F.explode(lengths)).where(F.col("n") <= F.length(of))
    pieces = sized.select(of, F.explode(F.transform(F.sequence(F.lit(1), F.length(of) - F.col("n") + 1), lambda i: F.substring(F.col(of), i, F.col("n")))).alias("key"))
    met = pieces.distinct().join(own, "key")
    order = Window.partitionBy(of).orderBy(F.desc("n"), F.asc_nulls_last("rank"), "key")
    best = met.withColumn("place", F.row_number().over(order)).where("place = 1").select(of, F.col("key").alias(name))
    return rows.join(best, F.col(f"`{text}`") == F.col(of), "left").drop(of)
