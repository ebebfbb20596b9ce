"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, groups of equal texts stay together.

A first pass writes one short row per document (id, size, checksum, tokens, group); everything later works on these.
Groups that hold more than 1/GRAIN of a shard in some dimension are items of their own: there are at most
3 * GRAIN * n_shards of them. All smaller groups fall into GRAIN * n_shards buckets by hash. So the number of items
that the driver packs has a fixed bound, whatever the number of documents. Items go, largest first, to the shard where
the dot product of their vector with the residual capacity is highest among the shards that they still fit in.

A group larger than a whole shard can't stay together under equal sizes; it is split by the rows' numbers into pieces
of about half a shard, so that equal rows spread, too. Places in a shard come from counts of (shard, chunk) and a row number within the chunk, so no task
numbers a whole shard.

Law: ``bytes`` - the shards' sizes are near equal. Defined cases: a null text has 0 bytes and belongs with the empty
texts; repeated rows get a place each; an empty table gives an empty result. Texts are measured whole, whatever their
length; a text larger than a shard's share fills one of its own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, utf8

GRAIN = 400
#: A piece, with the white space before it: a run of letters of scripts that put spaces between words, a run of digits,
#: or any other single character. Ranges instead of properties, as every character of every text is looked up.
LETTERS = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u0dff\u0e80-\u1fff\u2c00-\u2dff\ua640-\ud7ff"
PIECE = rf"\s*+(?:[{LETTERS}]++|[0-9]++|\S)"
SLOT_CHUNKS = 256


def token_estimate(text: Column) -> Column:
    """Word and character pieces, a stand-in for tokens: runs of letters, runs of digits, every other character that
    isn't white space, and every letter of scripts that are written without spaces."""
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), PIECE, "x"), " \t\n\x0b\f\r", "")
    return F.length(marks).cast("long")


def pack(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each item. ``vectors``: a row for each item, in units of a shard's fair share.

    Items come in order of their largest component. One goes where its dot product with the residual capacity is
    highest among the shards that it fits in; if it fits nowhere, where the most of the first dimension is left.
    """
    free = np.ones((n_shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        v = vectors[i]
        fits = (free >= v - 1e-12).all(axis=1)
        shard = int(np.argmax(np.where(fits, free @ v, -np.inf))) if fits.any() else int(np.argmax(free[:, 0]))
        out[i] = shard
        free[shard] -= v
    return out


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", grain: int = GRAIN, slot_chunks: int = SLOT_CHUNKS) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't ``key``)."""
    spark = docs.sparkSession
    data = utf8(F.col(text_col))
    base = settle(
        docs.select(
            F.col(id_col).alias("id"),
            (F.length(data) + 8).cast("long").alias("size"),
            F.crc32(data).alias("crc"),
            token_estimate(F.col(text_col)).alias("tokens"),
            F.substring(F.unhex(F.sha2(data, 256)), 1, 16).alias("text_key"),
            F.xxhash64(F.monotonically_increasing_id()).alias("tie"),  # stored, so it stays what it is
        )
    )
    sums = [F.sum("size").cast("double").alias("b"), F.sum("tokens").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("r")]
    groups = base.groupBy("text_key").agg(*sums)
    total = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).first()
    share = {c: max(total[c] or 0.0, 1.0) / n_shards for c in "btr"}
    load = F.greatest(*[F.col(c) / share[c] for c in "btr"])
    # At most 3 * grain * n_shards groups, each over 1/grain of a shard.
    heavy = groups.where(load > 1.0 / grain).select("text_key", F.when(load > 1.0, F.ceil(load * 2)).otherwise(1).alias("pieces"))
    named = base.join(F.broadcast(heavy), "text_key", "left").withColumn(
        "item",
        F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("text_key"), F.lit(grain * n_shards)).cast("string")).otherwise(
            F.concat_ws("-", F.hex("text_key"), F.pmod("tie", F.col("pieces")).cast("string"))
        ),
    )
    items = sorted(map(tuple, named.groupBy("item").agg(*sums).collect()))
    placed = pack(np.array([[x[1] / share["b"], x[2] / share["t"], x[3] / share["r"]] for x in items]).reshape(-1, 3), n_shards)
    where = spark.createDataFrame([(x[0], int(s)) for x, s in zip(items, placed)], "item string, shard int")
    laid = named.join(F.broadcast(where), "item").withColumn("chunk", F.pmod("tie", F.lit(slot_chunks)).cast("int"))
    counts = laid.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))  # at most n_shards * slot_chunks rows
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "crc", "tie"))
    return laid.withColumn("place", place).join(F.broadcast(offsets), ["shard", "chunk"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
