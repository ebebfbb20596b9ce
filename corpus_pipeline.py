"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows to the shared folder and reads them back for the next.

Defined cases: null, empty and blank texts are rejected by the quality rules, as too short. Of repeated rows and equal
texts one stays after near-duplicates, of a tie the smallest doc_id, null ids last. A null source is a source of its
own, a null lang or n_chars passes through. Very long texts are read whole. An empty table, or one of which nothing
stays, gives an empty result. Other columns pass through up to the last stage, which reads doc_id and text only; they
may have any names that differ from those of documents in more than case, dots and quotes included. Without an n_chars
column none is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadrante.llm import decontaminate, mixing, quality_rules, sharding, simhash
from cuadrante.llm.common import free_name, plain, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that failed, and n_chars follows."""
    kept = quality_rules.clean(docs)  # columns keep their names, whatever these are
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*map(plain, docs.columns)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with 0.8 or more of their 5-word shingles in common one stays, the smallest doc_id."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), items).where("contaminated")
    doc, key = free_name(docs, "doc"), free_name(docs, "key")
    hit = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as its source is passed over."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 24)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: The fingerprint components and the exponent search can't be put in one SQL statement; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
