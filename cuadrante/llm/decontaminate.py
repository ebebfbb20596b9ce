"""Benchmark decontamination by a prefix-filtered join of shingles.

A benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one window). A window is the set of
its shingles of SHINGLE words. As a window must lie in a document as a whole, one shingle is prefix enough: the rarest
of the benchmark's, so each window is looked up by it alone. A document's shingles are filtered, inside the row, by the
set of these rarest shingles; only places that pass leave the row, each with the words around it. After an equi-join
on the shingle's hash, the length and positional bounds drop windows that would begin before the document or end after
it, and the words themselves are compared: a collision of the hash never counts. Equal items are one class, named by
128 bits of a SHA-256 of its words; rows of one document are told apart by 64 bits of their texts.

The set of rarest shingles is put into the plan, and the window table is broadcast, only if counts show that both are
small; beyond that, every shingle leaves its row and the join shuffles on the hash.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. Defined cases: null or empty texts have
no words and no hits; items without words have no windows; equal items all count; repeated document rows come back as
often as they came in; an empty benchmark leaves every document clean, an empty table gives an empty result. A text is
read whole in its row, whatever its length. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, lower_az, settle

WINDOW, SHINGLE = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bench_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(lower_az(text), F.lit("")), SEPARATORS), lambda w: w != "")


def _hash(words: Column, start, width: int) -> Column:
    """Of ``width`` words from the 0-based place ``start``."""
    return F.xxhash64(F.lit(width), *[F.get(words, start + i) for i in range(width)])


def window_table(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(classes: class_id, ids), (windows: h, width, offset, length, body, class_id). A class is a set of equal items."""
    classes = settle(
        items.select(F.col(id_col).cast("string").alias("id"), bench_words(F.col(text_col)).alias("w")).where(F.size("w") > 0).groupBy("w").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.substring(F.sha2(F.array_join("w", " ").cast("binary"), 256), 1, 32).alias("class_id"), "w", "ids")
    )
    cut = classes.select(
        "class_id", "w", F.least(F.size("w"), F.lit(window)).alias("length"), F.least(F.size("w"), F.lit(shingle)).alias("width")
    ).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))))
    hashed = F.coalesce(*[F.when(F.col("width") == k, _hash(F.col("w"), F.col("start") + F.col("o"), k)) for k in range(1, shingle + 1)])
    shingles = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("width")))).select(
        "class_id", "length", "width", "o", "start", F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ").alias("body"), hashed.alias("h")
    )
    rarity = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = shingles.join(rarity, "h").groupBy("class_id", "start", "length", "width", "body").agg(F.min(F.struct("n", "h", "o")).alias("x"))
    windows = rarest.select(F.col("x.h").alias("h"), "width", F.col("x.o").alias("offset"), "length", "body", "class_id").distinct()
    return classes.select("class_id", "ids"), settle(windows)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, text_key (xxhash64 of the text)."""
    classes, windows = window_table(items, item_id_col, item_text_col, window, shingle)
    widths = [r[0] for r in windows.select("width").distinct().orderBy("width").collect()]  # at most SHINGLE values
    tokens = windows.select("h").distinct()
    few = windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = [r[0] for r in tokens.collect()] if few else None  # at most BROADCAST_ROWS
    ids = classes.agg(F.sum(F.size("ids"))).first()[0] or 0
    few_ids = ids <= BROADCAST_ROWS  # the arrays of ids may be long though windows are few
    reach = window - 1

    def place(a: Column, p: Column, h: Column) -> Column:
        first = F.greatest(p - F.lit(reach), F.lit(0))
        return F.struct(h.alias("h"), p.alias("p"), first.alias("first"), F.slice(a, first + 1, p - first + F.lit(reach + 1)).alias("near"))

    def hashed_places(a: Column, width: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: F.struct(_hash(a, i, width).alias("h"), i.alias("p")))
        return F.when(F.size(a) >= width, every).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))

    def places(a: Column) -> Column:
        found = [F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("p"), F.lit(0).alias("first"), F.array().cast("array<string>").alias("near")))]
        for k in widths:
            hashes = hashed_places(a, k)
            if few:
                hashes = F.filter(hashes, lambda x: x["h"].isin(known)) if known else F.slice(hashes, 1, 0)
            found.append(F.transform(hashes, lambda x: place(a, x["p"], x["h"])))
        return F.struct(F.size(a).alias("n_words"), F.concat(*found).alias("places"))

    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), let(bench_words(F.col(text_col)), places).alias("x"))
    spread = cut.select("id", "key", F.col("x.n_words").alias("n_words"), F.explode("x.places").alias("at")).select("id", "key", "n_words", "at.*")
    if few:
        joined = spread.join(F.broadcast(windows), "h", "left")
    else:  # rows without a partner in the benchmark must not meet under one null key
        joined = spread.where("p >= 0").join(windows, "h").unionByName(spread.where("p < 0"), allowMissingColumns=True)
    start = F.col("p") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.array_join(F.slice("near", start - F.col("first") + 1, F.col("length")), " ") == F.col("body")
    hit = F.coalesce(F.when(fits, same), F.lit(False))
    by_doc = joined.groupBy("id", "key", "n_words").agg(
        F.count_if(F.col("p") < 0).alias("copies"),
        F.collect_set(F.when(hit, F.struct(start.alias("s"), (start + F.col("length")).alias("e")))).alias("spans"),
        F.collect_set(F.when(hit, F.col("class_id"))).alias("classes"),
    )
    run = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end")),
    )
    by_doc = by_doc.select("id", "key", "n_words", "copies", run["n"].alias("n_hit"), "classes")
    named = by_doc.where(F.size("classes") > 0).withColumn("class_id", F.explode("classes"))
    named = named.join(F.broadcast(classes) if few_ids else classes, "class_id").groupBy("id", "key", "n_words", "copies", "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    clean = by_doc.where(F.size("classes") == 0).drop("classes").withColumn("ids", F.array().cast("array<string>"))
    every = named.unionByName(clean).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("key").alias("text_key"),
    )
