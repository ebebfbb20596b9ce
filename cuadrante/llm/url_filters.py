"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

A url is cut into host and path. Each pair of a host suffix (whole labels) and a path prefix (of a length that some
rule has) is an expression. Its SHA-256 is looked up by the first 32 bits in an equi-join, then the whole digest is
compared, so a short-prefix collision never decides. Of the rules that fit, the longest wins; between rules of equal
length the longer host does, then block over allow.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule. A rule with an empty
host never fits. Repeated rows come back as often as they came in. Other columns of the table are not read. An empty
table gives an empty result. Of a long url only prefixes of lengths that rules have are hashed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lower_az

DEFAULT_VERDICT = "allow"

#: Paths of rules may have this many different lengths; more is an error, as rules left out would never fit.
MAX_LENGTHS = 4096


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def rules_frame(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict) rows."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    ``rules`` has columns host, path and verdict. The rule table is broadcast only if a count shows that it has at
    most BROADCAST_ROWS rows; beyond that the join shuffles on the hash prefix, and Spark splits hot prefixes.
    """
    known = rules.select(
        lower_az(F.col("host")).alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.lower("verdict").alias("r_verdict")
    ).where("r_host <> ''")
    # Path lengths of rules are few: a url is cut at these only, whatever the number of rules.
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().limit(MAX_LENGTHS + 1).collect()) or [0]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"rules have paths of more than {MAX_LENGTHS} different lengths")
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    digest = _digest(F.col("r_host"), F.col("r_path"))
    known = known.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).select(
        _short(digest).alias("prefix"), digest.alias("r_digest"), F.concat("r_host", "r_path").alias("rule"),
        F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule")).alias("rank"),
    ).drop("rule")
    base = pages.groupBy(F.col(id_col).alias("id"), F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    base = base.select("id", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: _digest(s, F.substring(F.col("path"), F.lit(1), n)))))
    parts = base.withColumn("digest", F.explode_outer(F.when(F.col("host") != "", expressions))).withColumn("prefix", _short(F.col("digest")))
    hit = parts.join(F.broadcast(known) if small else known, "prefix", "left").withColumn("rank", F.when(F.col("digest") == F.col("r_digest"), F.col("rank")))
    best = hit.groupBy("id", "url", "copies", "host", "path").agg(F.max("rank").alias("rank"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("id").alias(id_col), "host", "path", F.col("rank.rule").alias("rule"), F.coalesce(F.col("rank.v"), F.lit(default)).alias("verdict")
    )
