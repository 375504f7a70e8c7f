"""Readers: pools, reports, tables of tasks, source trees and archives. Schemas are declared; broken records are kept apart or fatal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake import schemas
from assertlake.functions.keys import collapse, strip
from assertlake.sources.records import archives, records

SOURCE_SUFFIX = r"\.(?:sv|svh|v|vh)$"
SKIPPED_PARTS = r"/(?:build|_out|node_modules|\.git)/"


def jsonl(spark: SparkSession, paths: str | list[str], schema: str = schemas.RAW, fatal: bool = False) -> DataFrame:
    """Records of JSON lines, blank ones skipped. Without fatal, what can't be parsed is in _corrupt_record."""
    reader = spark.read.option("mode", "FAILFAST" if fatal else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.schema(schema if fatal else f"{schema}, _corrupt_record string").json(paths)


def malformed(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"), F.count(F.lit(1)).alias("rows"))


def report(spark: SparkSession, paths: str | list[str], schema: str = schemas.REPORT) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def report_candidates(reports: DataFrame) -> DataFrame:
    """A row for each candidate of each sample of each report."""
    samples = reports.select(F.col("_metadata.file_path").alias("run"), F.explode("per_sample").alias("s"))
    return samples.select("run", "s.id", "s.expected_tcl", "s.evaluable", F.explode_outer("s.candidates").alias("c")).select("run", "id", "expected_tcl", "evaluable", "c.*")


def wrapped(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of a JSON file that is a list, or an object with the list under tasks, examples, data or assertions."""
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"array<struct<{item}>>")
    inside = F.from_json("value", "struct<" + ", ".join(f"{k}: array<struct<{item}>>" for k in ("tasks", "examples", "data", "assertions")) + ">")
    is_list = F.ltrim("value").startswith("[")
    items = F.when(is_list, whole).otherwise(F.coalesce(*(inside[k] for k in ("tasks", "examples", "data", "assertions"))))
    return text.select(F.explode(items).alias("x")).select("x.*")


def task_csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", "*.csv") if recursive else reader).schema(schemas.CSV_TASKS).csv(path)


def unified(df: DataFrame, source: str, split: str) -> DataFrame:
    """Tasks (id, nl, sva, rtl) as records of the unified pool, classified and keyed."""
    from assertlake.functions.classify import level
    from assertlake.functions.keys import sample_hash

    return df.select("id", F.lit(source).alias("source"), strip("nl").alias("nl"), strip("sva").alias("reference_sva"), "rtl_context", level("sva").alias("expected_tcl"), F.lit(None).cast("string").alias("cex"), F.lit(split).alias("split"), sample_hash("nl", "sva").alias("hash"))


def nl2sva(spark: SparkSession, path: str, source: str, split: str) -> DataFrame:
    """A benchmark's CSV as unified records; a label before the reference goes."""
    from assertlake.functions.parse import without_any_label

    rows = task_csv(spark, path).select(F.concat_ws("_", "design_name", "task_id").alias("id"), F.col("prompt").alias("nl"), without_any_label("ref_solution").alias("sva"), F.col("testbench").alias("rtl_context"))
    return unified(rows.where(F.col("sva") != ""), source, split)


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the source files below a folder, without generated parts."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(F.col("path").rlike(SOURCE_SUFFIX) & ~F.col("path").rlike(SKIPPED_PARTS))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, kind, body) of .gold files: property blocks, or only where there are none the lines of a report; place counts a file's from 0."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gold").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    named = F.filter(F.transform(F.regexp_extract_all("value", F.lit(r"(?s)\bproperty\s+\w+\s*;?(.*?)\bendproperty"), F.lit(1)), lambda b: F.trim(F.regexp_replace(F.trim(collapse(b)), ";+$", ""))), lambda b: b != "")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^#|^Report| :: "))
    reported = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^(.*?);?\s*$", 1))), lambda x: (x != "") & ~x.rlike(r"^[\d.]+$"))
    item = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("body")))
    return files.select("path", F.posexplode(F.when(F.size(named) > 0, item("property", named)).otherwise(item("report", reported))).alias("place", "x")).select("path", "place", "x.*")


def siblings(files: DataFrame, most: int = 3) -> DataFrame:
    """(dir, context): the first files of each folder, by name, with their names above them."""
    from pyspark.sql import Window as W

    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "text")
    first = parts.withColumn("n", F.row_number().over(W.partitionBy("dir").orderBy("name"))).where(F.col("n") <= most)
    chunk = F.concat(F.lit("// === "), F.col("name"), F.lit(" ===\n"), F.col("text"))
    return first.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", chunk.alias("c")))), lambda x: x.c), "\n").alias("context"))


def gated_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Nested records of a verification benchmark: those that speak of assertions, with their harness files as context."""
    schema = "id string, categories array<string>, input struct<prompt:string,context:map<string,string>>, output struct<context:map<string,string>>"
    rows = spark.read.schema(schema).json(path).withColumn("context", F.array_join(F.map_values("input.context"), "\n"))
    return rows.where(F.lower(F.concat_ws(" ", "input.prompt", "context")).rlike(r"\bassert(?:ion)?s?\b|\bproperty\b")).select("id", F.col("input.prompt").alias("nl"), "context", F.array_join(F.map_values("output.context"), "\n").alias("answer"))


def suffix_index(files: DataFrame) -> DataFrame:
    """(tail, paths): every tail of each path with the paths that have it."""
    from assertlake.operators.curate import suffixes

    return files.select("path", F.explode(suffixes(F.col("path"))).alias("tail")).groupBy("tail").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Reports with what their file names say: model, mode and step."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)
    text = spark.read.text(pattern, wholetext=True)
    return text.select(name.alias("run"), F.regexp_extract(name, r"^([A-Za-z0-9.]+)", 1).alias("model"), F.coalesce(F.nullif(F.regexp_extract(name, r"(sft|grpo|ipo|opd)", 1), F.lit("")), F.lit("base")).alias("mode"), F.regexp_extract(name, r"(?:step|ckpt|checkpoint)[-_]?(\d+)", 1).try_cast("int").alias("step"), "value")


def recorded_search(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers of a repository search: (repo, stars, license, description, hits). The network is out of this engine."""
    return spark.read.schema("repo string, stars int, license string, description string, hits int").json(path)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Source name -> reader(spark, path); extended by registration.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "jsonl": jsonl, "report": report, "task_csv": task_csv, "source_tree": source_tree, "archives": archives, "records": lambda spark, path: records(spark, path, schemas.RAW), "gold": gold, "gated_jsonl": gated_jsonl, "recorded_search": recorded_search, "runs": runs,
}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[name] = reader


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return READERS[kind](spark, path)


