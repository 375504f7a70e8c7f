"""Sinks: JSON lines, shards, manifests, key registries, and replacement of a table that is being read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def shards(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """A folder for each value of by: levels, classes, splits or buckets."""
    df.write.mode(mode).partitionBy(*by).json(path)


def replaced(spark: SparkSession, df: DataFrame, path: str) -> None:
    """df in place of what path holds, also if df reads it: written beside, then renamed by the file system. If a rename fails, the old table is put
    back and the new one stays beside it. On object stores a rename is a copy, not one step: keep versions there instead."""
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(to(path))
    if had and not fs.rename(to(path), to(old)):
        raise OSError(f"{path} can't be moved; the new table is {new}")
    if not fs.rename(to(new), to(path)):
        back = not had or fs.rename(to(old), to(path))
        raise OSError(f"{new} can't be moved to {path}; the old table is {path if back else old}")
    if had:
        fs.delete(to(old), True)


def resumed(df: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key is not done yet."""
    df.join(done.select(key).distinct(), key, "left_anti").write.mode("append").json(path)


def manifest(path: str, **frames: DataFrame) -> DataFrame:
    """One JSON record: each frame's rows (few: aggregates) as JSON text under its name."""
    rows = None
    for name, df in frames.items():
        one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).select(F.lit(name).alias("key"), "value")
        rows = one if rows is None else rows.unionByName(one)
    out = rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("report"))
    out.coalesce(1).write.mode("overwrite").json(path)
    return out


def registry(df: DataFrame, key: str, path: str) -> None:
    """The distinct keys of a test set."""
    df.select(key).where(F.coalesce(key, F.lit("")) != "").distinct().write.mode("overwrite").parquet(path)


def metrics(path: str):
    """A foreachBatch function that appends metric rows as tab-separated lines."""

    def append(rows: DataFrame, _batch: int) -> None:
        rows.coalesce(1).write.mode("append").option("sep", "\t").csv(path)  # a few rows a batch

    return append
