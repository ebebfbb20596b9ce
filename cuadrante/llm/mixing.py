"""Temperature mixing of sources, realised as budgeted block permutations.

The token shares of the sources are raised to an exponent and normalised. The exponent is narrowed down, 32 ways at a
time, until the mix meets a target entropy or until no source is repeated more often than a limit. A source's weight
times the token budget is its quota: whole passes over the source, and a last pass that stops in one block.

Blocks are cut by a hash of doc_id and text, about BLOCK_TOKENS each, so that no task ever orders a whole source: a
source needs only the number of its last, partly used block and the hash in that block up to which documents are taken.
These few numbers a source decide for every document by itself how often it is emitted. The running sums over blocks go
by groups of GROUP blocks first. ``order`` is the hash by which a block's documents are permuted: sorted by it they
stand in their places; later passes permute anew by ``pass_order``.

Tokens are counted in pieces of words and characters (``sharding.token_estimate``), not by a vocabulary.

Defined cases: a null source is a source of its own; a null or empty text has no tokens and counts as one; repeated
rows are treated alike; an empty table gives an empty result. A target that no exponent meets is an error; a budget of
0 emits nothing. Texts are counted whole, whatever their length. Working columns get names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, plain, settle
from .sharding import token_estimate

BLOCK_TOKENS = 1_000_000
GROUP = 4_096
WAYS, ROUNDS = 32, 6
MAX_EXPONENT = 32.0
MAX_EPOCHS = 2.0


def find_exponent(sources: DataFrame, target_entropy: float | None = None, max_epochs: float | None = None) -> float:
    """The exponent for ``sources`` (share): the smallest whose entropy is at most the target, up to MAX_EXPONENT, or,
    up to 1, with which no source is passed over more than ``max_epochs`` times at a budget of one pass over everything.
    Both measures fall as the exponent grows; each round keeps one of WAYS sub-intervals. ValueError if none is enough.
    Without a target and a limit the exponent is 1: sources as they are."""
    if target_entropy is None and max_epochs is None:
        return 1.0
    low, high = 0.0, 1.0 if target_entropy is None else MAX_EXPONENT
    met = False
    for _ in range(ROUNDS):
        step = (high - low) / WAYS
        grid = F.explode(F.array(*[F.lit(low + step * i) for i in range(WAYS + 1)]))
        raised = sources.select("share", grid.alias("a")).withColumn("p", F.pow("share", F.col("a")))
        z = F.sum("p")
        by = raised.groupBy("a").agg(
            (F.log(z) - F.col("a") * F.sum(F.col("p") * F.log("share")) / z).alias("entropy"),
            (F.max(F.pow(F.col("share"), F.col("a") - 1)) / z).alias("epochs"),
        ).orderBy("a").collect()
        good = [i for i, x in enumerate(by) if (x["entropy"] <= target_entropy + 1e-12 if target_entropy is not None else x["epochs"] <= max_epochs + 1e-12)]
        if not by:
            return 1.0
        if not good and not met:
            what = f"an entropy of {target_entropy}" if target_entropy is not None else f"{max_epochs} passes"
            raise ValueError(f"no exponent up to {high:g} gives {what} or less")
        met = True
        first = good[0] if good else WAYS
        if first == 0:
            return by[0]["a"]
        low, high = low + step * (first - 1), low + step * first
    return high


def plan_mix(docs: DataFrame, budget_tokens: float | None = None, target_entropy: float | None = None, max_epochs: float | None = MAX_EPOCHS, seed: int = 17, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with working columns, named in the second result: n_tokens, weight, epochs (quota over size), block,
    order (a document's place in its block's permutation) and copies (how often it is emitted)."""
    spark = docs.sparkSession
    n = {k: free_name(docs, k) for k in ("n_tokens", "weight", "epochs", "block", "order", "copies", "key")}
    tokens = F.greatest(token_estimate(F.col(text_col)), F.lit(1).cast("long"))
    order = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    place = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed + 1))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    slim = settle(docs.select(key.alias("key"), tokens.alias("tokens"), order.alias("order"), place.alias("h")))
    sizes = settle(slim.groupBy("key").agg(F.sum("tokens").alias("size")).where("size > 0"))
    count, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not count:
        return docs.withColumns({n["n_tokens"]: tokens, n["weight"]: F.lit(0.0), n["epochs"]: F.lit(0.0), n["block"]: F.lit(0), n["order"]: order, n["copies"]: F.lit(0)}).drop(n["key"]), n
    shares = sizes.withColumn("share", F.col("size") / F.lit(float(total)))
    exponent = find_exponent(shares, target_entropy, max_epochs)
    z = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    budget = float(total if budget_tokens is None else budget_tokens)
    quotas = shares.select(
        "key", "size",
        (F.pow("share", F.lit(exponent)) / z).alias("weight"),
    ).withColumn("quota", F.col("weight") * budget).withColumn("passes", F.floor(F.col("quota") / F.col("size") + 1e-9)).withColumn(
        "rest", F.greatest(F.col("quota") - F.col("passes") * F.col("size"), F.lit(0.0))
    ).withColumn("blocks", F.ceil(F.col("size") / F.lit(block_tokens)).cast("int"))
    quotas = settle(quotas)
    few = count <= BROADCAST_ROWS
    side = F.broadcast(quotas) if few else quotas
    placed = slim.join(side.select("key", "blocks", "rest"), "key").withColumn("block", F.pmod("h", "blocks").cast("int"))
    # The last block of each source: where the running sum of block sizes passes what is left of the quota.
    per_block = placed.groupBy("key", "block", "rest").agg(F.sum("tokens").alias("n"))

    def where_it_ends(rows: DataFrame, at: str) -> DataFrame:
        """(key, last, room): of each key the first row, by ``at``, at which the running sum of n passes ``rest``, and
        what is left of ``rest`` there."""
        summed = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy(at))).where("upto > rest")
        found = summed.groupBy("key").agg(F.min_by(F.struct(at, (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), at).alias("x"))
        return found.select("key", F.col(f"x.{at}").alias("last"), F.col("x.room").alias("room"))

    per_block = settle(per_block.withColumn("group", F.floor(F.col("block") / GROUP)))
    in_group = where_it_ends(per_block.groupBy("key", "group", "rest").agg(F.sum("n").alias("n")), "group")
    within = per_block.drop("rest").join(in_group, "key").where("`group` = last").select("key", "block", "n", F.col("room").alias("rest"))
    last = settle(where_it_ends(within, "block"))
    in_last = placed.join(F.broadcast(last) if few else last, "key").where("block = last").groupBy("key", "order", "room").agg(F.sum("tokens").alias("tokens"))
    taken = Window.partitionBy("key").orderBy("order")
    cuts = in_last.withColumn("sum", F.sum("tokens").over(taken)).where("sum <= room").groupBy("key").agg(F.max("order").alias("cut"))
    rule = settle(quotas.join(last, "key", "left").join(cuts, "key", "left").select(F.col("key").alias(n["key"]), F.col("weight").alias(n["weight"]), (F.col("quota") / F.col("size")).alias(n["epochs"]), "blocks", "passes", "last", "cut"))
    rule = rule.select(n["key"], n["weight"], n["epochs"], F.struct("blocks", "passes", "last", "cut").alias(n["copies"]))
    out = docs.withColumns({n["key"]: key, n["n_tokens"]: tokens, n["order"]: order}).join(F.broadcast(rule) if few else rule, n["key"])
    r = F.col(n["copies"])
    block = F.pmod(place, r["blocks"]).cast("int")
    in_pass = F.coalesce((block < r["last"]) | ((block == r["last"]) & (F.col(n["order"]) <= r["cut"])), F.lit(False))
    out = out.withColumn(n["block"], block).withColumn(n["copies"], (r["passes"] + in_pass.cast("int")).cast("int"))
    return out.drop(n["key"]), n


def pass_order(order: Column, number: int) -> Column:
    """The order of a block's documents in a later pass; pass 0 has ``order`` itself."""
    return order if number == 0 else F.xxhash64(order, F.lit(number))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document as often as its copies."""
    planned, n = plan_mix(docs, **options)
    return planned.where(F.col(n["copies"]) > 0).withColumn(n["block"], F.explode(F.sequence(F.lit(1), F.col(n["copies"])))).select(*map(plain, docs.columns))
