"""Records by file and place: lines that keep their numbers under any splits, counts that are taken while rows go by, archives member by member."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from assertlake.operators.ordered import NUMBER

SOURCE_SUFFIX = r"\.(?:sv|svh|v|vh)$"


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, place, line): every line of the files, blank ones too, with its number in its file from 0.

    A split's lines are counted in one pass over the files (without their text leaving the tasks), and the counts of the splits before, a row
    each, make a line's number out of its number in its split. So it is the same for one split and for many, and after a lost task.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    number = F.monotonically_increasing_id()
    rows = text.select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), number.bitwiseAND(F.lit(NUMBER)).alias("number"))
    splits = rows.groupBy("file", "start").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "n", (earlier - F.col("first")).alias("shift"), "first")
    at = F.col("number") - F.col("first")
    sound = F.when((at >= 0) & (at < F.col("n")), F.col("number") + F.col("shift")).otherwise(F.raise_error(F.lit("the files have changed between two looks at them")))
    return rows.join(F.broadcast(splits), ["file", "start"]).select("file", sound.alias("place"), "line")  # a row for each split


def tagged(path: Column, tags: list[tuple[str, str, int]]) -> Column:
    """struct(tag, rank) of the first (pattern, tag, rank) that the path matches."""
    out = F.struct(F.lit(None).cast("string").alias("tag"), F.lit(None).cast("int").alias("rank"))
    for pattern, name, rank in reversed(tags):
        out = F.when(path.rlike(pattern), F.struct(F.lit(name).alias("tag"), F.lit(rank).alias("rank"))).otherwise(out)
    return out


def records(spark: SparkSession, paths: str | list[str], schema: str, tags: list[tuple[str, str, int]] = ()) -> DataFrame:
    """(file, place, tag, rank, *schema, _corrupt_record): JSON lines, blank ones left out (they keep their numbers); what can't be parsed is in _corrupt_record."""
    lines = numbered_lines(spark, paths).where(F.trim("line") != "")
    parsed = F.from_json("line", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("file", "place", tagged(F.col("file"), list(tags)).alias("t"), parsed.alias("r")).select("file", "place", "t.tag", "t.rank", "r.*")


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what is counted while it is read or written the first time: the Observation's get, after that action; no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items())), seen


def matched(rows: DataFrame, look: DataFrame, key: str, mark: str = "matched") -> tuple[DataFrame, Observation]:
    """rows with look's columns (unique by key) and whether there are any; hits and misses are counted on the way. A null key is a miss."""
    out = rows.join(look.withColumn("__hit", F.lit(True)), key, "left").withColumn(mark, F.coalesce("__hit", F.lit(False))).drop("__hit")
    return counted(out, "matched", hits=F.col(mark), misses=~F.col(mark))


#: Archives up to so many bytes are read by Spark; larger ones are streamed from their address, a member at a time in memory.
WHOLE_BYTES = 256 << 20


def archives(spark: SparkSession, path: str, suffix: str = SOURCE_SUFFIX, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(archive, path, text, error): a row for each member of .tar.gz archives with that ending, as it comes by; where an archive is cut or none at all, its
    good members and one row with the error. Invalid UTF-8 is left out."""

    def members(stream: io.RawIOBase, name: str) -> Iterator[tuple]:
        try:
            with tarfile.open(fileobj=stream, mode="r|*") as tar:
                for m in tar:
                    if m.isfile() and re.search(suffix, m.name):
                        yield name, m.name, tar.extractfile(m).read().decode("utf-8", "ignore"), None
        except Exception as e:  # a broken archive is a row
            yield name, None, None, f"{type(e).__name__}: {e}"

    def opened(name: str, content: bytes | None) -> io.RawIOBase:
        if content is not None:
            return io.BytesIO(content)
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
        return system.open_input_stream(at, compression=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["archive", "path", "text", "error"]
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                rows, size = [], 0
                try:
                    stream = opened(name, content)
                except Exception as e:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields, (name, None, None, f"{type(e).__name__}: {e}"), strict=True))], pa.schema([(f, pa.string()) for f in fields]))
                    continue
                for row in members(stream, name):
                    rows.append(dict(zip(fields, row, strict=True)))
                    size += len(row[2] or "")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([(f, pa.string()) for f in fields]))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([(f, pa.string()) for f in fields]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tar.gz,tgz}").load(path)
    schema = "archive string, path string, text string, error string"
    small = files.where(F.col("length") <= whole_bytes).select("path", "content")
    large = files.where(F.col("length") > whole_bytes).select("path", F.lit(None).cast("binary").alias("content"))
    return small.mapInArrow(run, schema).unionByName(large.mapInArrow(run, schema))


def snapshots(roots: dict[str, str], read: Callable[[str], DataFrame]) -> DataFrame:
    """Rows of several roots (name -> path) with the root's name; a file below several roots comes once for each."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [read(path).withColumn("root", F.lit(name)) for name, path in roots.items()])
