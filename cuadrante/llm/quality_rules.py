"""Quality rules, line first: judge each line, drop the lines that fail, reject documents that lose too much text.

Everything is computed inside the row with SQL functions, so the operator has no shuffle at all and a document is
never split from its lines.

A line with a word fails if one of these holds:

* symbols: more than three of ``# * $ % & | < >`` for ten words (tables, navigation bars, noise);
* shouting: five words or more, letters, and none of them in lower case;
* repetition: ten words or more, of which fewer than three in ten are different;
* boilerplate: one of the fixed phrases below, in any case;
* stub: fewer than four words and no closing punctuation (menu entries, headings of navigation).

A document is rejected by the base rule (fewer than 50 words, or over half of its words in repeated 3-word windows) or
if the failed lines hold more than ``max_lost`` of its words.

Defined cases: a null or empty text has no words and is rejected by the base rule; its clean text is "". Repeated rows
are judged one by one; an empty table gives an empty result. A text is judged whole in its row, whatever its length.
Other columns pass through; columns of the same names as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Phrases of boilerplate lines.
BOILERPLATE = ("licensed under", "all rights reserved", "spdx-license", "copyright (c)", "cookie policy", "accept cookies", "privacy policy", "terms of service", "terms of use", "sign in", "click here")

MAX_LOST = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))


def line_fails(line: Column, line_words: Column) -> Column:
    """Whether a line with words fails; false for one without."""
    n = F.size(line_words)
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate |= F.contains(low, F.lit(phrase))
    return (n > 0) & (
        (symbols(line) * 10 > n * 3)
        | ((n >= 5) & (line == F.upper(line)) & (line != low))
        | ((n >= 10) & (F.size(F.array_distinct(line_words)) * 10 < n * 3))
        | ((n < 4) & ~line.rlike(r"""[.!?:;…)"»]\s*$"""))
        | boilerplate
    )


def covered(starts: Column, width: int) -> Column:
    """How many positions windows of ``width`` at the ascending ``starts`` cover together."""
    steps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def repeated_words(all_words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by a 64-bit hash within one document. Sorting the hashes shows which are repeated; where these
    are few they are looked up, else (hash, place) pairs are sorted, so that no text costs the square of its length.
    """

    def places(h: Column) -> Column:
        def few(dup: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(dup, F.get(h, i)))

        def many(pairs: Column) -> Column:
            same = F.filter(pairs, lambda e, j: F.coalesce(F.get(pairs, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(pairs, j + 1)["h"] == e["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        def by_number(dup: Column) -> Column:
            return (
                F.when(F.size(dup) == 0, F.lit(0))
                .when(F.size(dup) <= 32, covered(few(dup), 3))
                .otherwise(covered(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), many), 3))
            )

        return let(let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (F.get(s, j - 1) == x)))), by_number)

    hashes = let(all_words, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2))))
    return F.when(F.size(all_words) < 4, F.lit(0)).otherwise(let(hashes, places))


def judge(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with RESULTS and ``clean_text`` added."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    judged = docs.withColumn("clean_text", F.transform(lines, lambda x: F.struct(x.alias("line"), words(x).alias("w"))))
    judged = judged.withColumn("clean_text", F.transform("clean_text", lambda x: F.struct(x["line"].alias("line"), x["w"].alias("w"), line_fails(x["line"], x["w"]).alias("fails"))))

    def figures(parts: Column) -> Column:
        def with_words(a: Column) -> Column:
            worded = F.transform(F.filter(parts, lambda p: F.size(p["w"]) > 0), lambda p: p["line"])
            return F.struct(
                F.size(a).cast("long").alias("n_words"),
                F.length(F.array_join(a, "")).cast("long").alias("word_chars"),
                symbols(text).cast("long").alias("n_symbols"),
                let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(a).cast("long").alias("n_repeat_words"),
                F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(p["fails"], F.size(p["w"])).otherwise(0)).cast("long").alias("n_lost_words"),
                F.array_join(F.transform(F.filter(parts, lambda p: ~p["fails"]), lambda p: p["line"]), "\n").alias("clean_text"),
            )

        return let(F.flatten(F.transform(parts, lambda p: p["w"])), with_words)

    judged = judged.withColumn("clean_text", figures(F.col("clean_text")))
    fields = {c: F.col(f"clean_text.{c}") for c in RESULTS[:6]}
    judged = judged.withColumns(fields)
    judged = judged.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.col("n_words") * F.lit(max_lost)))
    return judged.withColumn("clean_text", F.col("clean_text.clean_text"))


def clean(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with the columns of ``docs``; the failed lines are gone from their text.

    The verdict passes through a generator: a plain filter would be pushed below the projections, and every figure of
    the verdict would be computed once more for it. The row stays in one struct meanwhile, so its columns may have any
    names.
    """
    row, text = "__row", "__text"
    judged = judge(docs.select(F.struct("*").alias(row), F.col(text_col).alias(text)), text, max_lost)
    kept = judged.select(row, F.explode_outer(F.when(F.col("kept"), F.array(F.col("clean_text")))).alias(text)).where(F.col(text).isNotNull())
    return kept.select(*[F.col(text).alias(c) if c == text_col else F.col(row)[c].alias(c) for c in docs.columns])
