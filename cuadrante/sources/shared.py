"""Tables in the folder that driver and executors share, and the spread of small inputs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh path below the folder that all executors share.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset, a local folder is taken if everything
    runs in one process, as in tests; on a cluster that is an error, as executors don't see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="cuadrante-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cuadrante-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table over all cores where it has fewer splits than there are cores: for work on a row that outweighs
    moving it."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
