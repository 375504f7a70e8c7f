"""Stage tables: intermediate results in the folder that spark.checkpoint.dir names, which all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path there. Without that setting a session on one machine gets a folder of its own; on a cluster it's an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="assertlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written and read again."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
