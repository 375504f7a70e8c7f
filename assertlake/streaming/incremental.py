"""Incremental processing: new files once, duplicates across runs, early stopping, and windows over events (beyond what batch jobs do)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def each_once(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None], poll: str | None = None) -> StreamingQuery:
    """process(rows, batch) for what is new, once each; poll ('60 seconds') keeps watching, else it ends with what is there."""
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process).trigger(**trigger).start()


def appended(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: Column, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key over all runs. With an event time, keys are forgotten after the delay; without, only short keys are kept, but for ever."""
    rows = stream.withColumn("__key", key)
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return rows.dropDuplicates(["__key"]).drop("__key")


def windowed(stream: DataFrame, ts: str, by: list[str], size: str, delay: str) -> DataFrame:
    """Counts and sums of value by tumbling window; late rows beyond the delay are dropped."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: str, gap: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


STOP_OUT = "run string, step long, score double, best double, streak int, stop boolean"


def early_stop(evaluations: DataFrame, patience: int) -> DataFrame:
    """(run, step, score) as a stream -> with best, the streak without improvement, and stop once it reaches the patience. State: two numbers a run."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, streak = state.get if state.exists else (float("-inf"), 0)
        rows = pd.concat(batches).sort_values("step")
        out = []
        for step, score in zip(rows["step"], rows["score"]):
            streak = 0 if score > best else streak + 1
            best = max(best, score)
            out.append((key[0], int(step), float(score), float(best), int(streak), streak >= patience))
        state.update((float(best), int(streak)))
        yield pd.DataFrame(out, columns=["run", "step", "score", "best", "streak", "stop"])

    return evaluations.groupBy("run").applyInPandasWithState(advance, STOP_OUT, "best double, streak int", "append", GroupStateTimeout.NoTimeout)
