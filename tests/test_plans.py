"""Plans of the timetable's queries: the rules are computed in one place, whatever is asked of their results."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from cuadrante.functions import text as T
from cuadrante.operators import parsing, review
from cuadrante.plans import catalogue

SF = "/root/testdata/sf0.001"


def text(df):
    """The optimised plan."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def filters(df):
    return [line for line in text(df).split("\n") if line.lstrip(" :+-").startswith("Filter")]


def test_filters_stay_above_the_rules(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    built = catalogue.built(spark, SF)
    once = len(text(built))
    for df in (built.where("accepted"), built.where("size(issues) > 1 and confidence < 0.8"), catalogue.issue_counts(spark, SF)):
        assert len(text(df)) < once + 10_000 and not [f for f in filters(df) if "regexp" in f or "RLIKE" in f]


def test_issue_counts(spark):
    rows = catalogue.built(spark, SF).select("issues").collect()
    want = Counter(x for r in rows for x in r["issues"])
    assert len(want) > 5 and None not in want and dict(map(tuple, catalogue.issue_counts(spark, SF).collect())) == want


def test_origins_of_one_table_in_one_pass(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    built = catalogue.built(spark, SF)
    got = catalogue.union_origin(spark, SF)
    assert text(got).count("Generate posexplode") == 1
    parts = review.union_origin(built.where("accepted"), built.where("not accepted")).select("ord", "pos", "origin")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, parts.collect()))
    assert {r["origin"] for r in got.collect()} == {"accepted", "rejected"}


def test_repeated_formats_in_proportion_to_the_text(spark):
    """Texts with as many places to begin as letters; and the same matches as by a search from every place."""
    long = spark.createDataFrame([("a(" * 60_000,), ("a-" * 60_000,)], "t string")
    began = time.time()
    assert [list(r) for r in long.select(parsing.standard(F.col("t")), F.size(parsing.room_first(F.col("t")))).collect()] == [[[], 0]] * 2
    assert time.time() - began < 10
    rng, pieces = random.Random(3), ["-", " ", "(", ")", "1A", "2b3", "Redes", "ñ", "*", "NA7", "- 1A (X)", "(Y) - 2B", "\x01", "\x02", "\n", "\u2028"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))),) for _ in range(3_000)]
    t, texts = F.col("t"), spark.createDataFrame(rows, "t string").select(T.clean(F.col("t")).alias("t"))
    for pattern, f, places in ((parsing.STANDARD, parsing.standard, (1, 2, 3)), (parsing.ROOM_FIRST, parsing.room_first, (1, 3, 2))):
        every = pattern.replace("\\G", "")
        assert texts.where(~f(t).eqNullSafe(parsing._all(t, every, *places)) | (t.rlike(every) != t.rlike(pattern))).count() == 0
        assert texts.where(t.rlike(every)).count() > 500
