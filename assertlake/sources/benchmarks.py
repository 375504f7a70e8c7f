"""Benchmarks and scraped collections in their own layouts, as records of the unified pool; a loader for each layout, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assertlake.functions.keys import strip, text
from assertlake.sources import readers
from assertlake.sources.records import numbered_lines

#: The columns of a table of tasks that may hold each field, in the order of preference; fixed values.
TASK_COLUMNS = {"sva": ("ref_solution", "solution", "assertion"), "nl": ("prompt", "nl"), "rtl_context": ("testbench", "rtl")}
#: The files of a hand-made collection, in order; fixed values.
HANDMADE = ("sample_svas.json", "sva_examples.json", "nl2sva_tasks_expanded.json", "nl2sva_tasks.json", "nl_to_sva.json")

SCRAPED = "sva string, nl_comment string, module string, file string, line string, source_repo string, source_snapshot string, strategy string, macro string, name string, args array<string>, body_hash string"


def first_of(columns: list[str], names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.col(f"`{c}`"), F.lit("")) for c in names if c in columns), F.lit(""))


def task_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, sva, nl, rtl_context) of the CSV files below a folder, whatever order and choice of columns each has; place counts a file's rows from 0. The
    files of one header are read together: there are as many readings as layouts."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    if not (names := [r.file for r in found.collect()]):  # names of files, not rows
        return spark.createDataFrame([], "file string, place long, sva string, nl string, rtl_context string")
    heads = numbered_lines(spark, names).where("place = 0").groupBy("line").agg(F.collect_list("file").alias("files")).collect()
    layouts = []
    for head in heads:
        columns = [c.strip().strip('"') for c in head.line.lstrip("﻿").split(",")]
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in columns)).csv(head.files)
        rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("number"), *(first_of(columns, v).alias(k) for k, v in TASK_COLUMNS.items()))
        firsts = rows.groupBy("file").agg(F.min("number").alias("first"))
        layouts.append(rows.join(firsts, "file").select("file", (F.col("number") - F.col("first")).alias("place"), "sva", "nl", "rtl_context"))
    return reduce(DataFrame.unionByName, layouts)


def stem(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def design_tables(spark: SparkSession, path: str, source: str, split: str) -> DataFrame:
    """Tables of tasks below a folder; ids are `<file>_<row>`, a label before the reference goes, rows without one too."""
    rows = task_tables(spark, path).where(strip("sva") != "")
    sva = F.regexp_replace(strip("sva"), r"^[a-zA-Z_]\w*\s*:\s*", "")
    return readers.unified(rows.select(F.concat(stem("file"), F.lit("_"), "place").alias("id"), "nl", sva.alias("sva"), "rtl_context"), source, split)


def gold_files(spark: SparkSession, path: str, source: str, split: str) -> DataFrame:
    """Assertions of .gold files, those named *_filtered.gold only if there are any; what a report's line says gets the usual clock. The first three .v files beside
    one are its context. Ids are `<family>__<design>__<file>__<place>`."""
    rows = readers.gold(spark, path)
    filtered = F.col("path").endswith("_filtered.gold")
    if rows.where(filtered).limit(1).count():
        rows = rows.where(filtered)
    part = lambda k: F.regexp_extract("path", r"([^/]*)/([^/]*)/[^/]*$", k)
    designs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.v").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).join(readers.siblings(designs), "dir", "left")
    sva = F.when(F.col("kind") == "property", F.concat(F.lit("assert property ("), "body", F.lit(");"))).otherwise(F.concat(F.lit("assert property (@(posedge clk) "), "body", F.lit(");")))
    return readers.unified(rows.select(F.concat_ws("__", part(1), part(2), stem("path"), F.col("place").cast("string")).alias("id"), F.lit("").alias("nl"), sva.alias("sva"), text("context").alias("rtl_context")), source, split)


def handmade(spark: SparkSession, path: str, source: str, split: str) -> DataFrame:
    """The HANDMADE files of a folder: lists, or objects with a list under tasks, examples or data; missing files and broken ones give none. Ids are `<file>_<id or place>`."""
    item = "id string, reference_sva string, sva string, assertion string, nl string, description string, rtl string"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("file"), "value")
    listed = F.from_json("value", f"array<struct<{item}>>")
    inside = F.from_json("value", "struct<" + ", ".join(f"{k}: array<struct<{item}>>" for k in ("tasks", "examples", "data")) + ">")
    some = lambda c: F.when(F.size(c) > 0, c)
    items = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(*(some(inside[k]) for k in ("tasks", "examples", "data"))))
    rows = files.where(F.col("file").isin(*HANDMADE)).select("file", F.posexplode(items).alias("place", "x"))
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(f"x.{n}"), F.lit("")) for n in names), F.lit(""))
    rows = rows.select(F.concat("file", F.lit("_"), F.coalesce("x.id", F.col("place").cast("string"))).alias("id"), pick("nl", "description").alias("nl"), pick("reference_sva", "sva", "assertion").alias("sva"), pick("rtl").alias("rtl_context"))
    return readers.unified(rows.where("sva <> ''"), source, split)


def scraped(kind: str) -> Callable[[SparkSession, str, str, str], DataFrame]:
    """A loader of scraped records, a JSON object a line; broken lines and records without an assertion give none. kind: repository, macro, named or snapshot."""

    def load(spark: SparkSession, path: str, source: str, split: str) -> DataFrame:
        known = lambda c: F.coalesce(F.col(c), F.lit("?"))
        flat = lambda c: F.replace(known(c), F.lit("/"), F.lit("_"))
        origin = [known("source_snapshot"), F.replace(known("strategy"), F.lit(":"), F.lit("_"))] if kind == "snapshot" else [flat("source_repo")]
        last = {"macro": [known("macro")], "named": [known("name")]}.get(kind, [])
        id_ = F.concat_ws("_", *origin, flat("file"), F.concat(F.lit("L"), known("line")), *last)
        nl = F.concat(F.lit("["), known("macro"), F.lit("] "), text(F.get("args", F.lit(0)))) if kind == "macro" else text("nl_comment")
        rtl = F.lit("") if kind == "macro" else F.when(text("module") != "", F.concat(F.lit("// module "), "module")).otherwise("")
        rows = readers.jsonl(spark, path, SCRAPED).where("_corrupt_record is null").where(strip("sva") != "")
        return readers.unified(rows.select(id_.alias("id"), nl.alias("nl"), strip("sva").alias("sva"), rtl.alias("rtl_context")), source, split)

    return load


#: Layout -> loader(spark, path, source, split).
LOADERS: dict[str, Callable[[SparkSession, str, str, str], DataFrame]] = {
    "nl2sva_csv": readers.nl2sva, "design_tables": design_tables, "gold_files": gold_files, "handmade": handmade, **{kind: scraped(kind) for kind in ("repository", "macro", "named", "snapshot")},
}


def load(spark: SparkSession, sources: list[tuple[str, str, str, str]]) -> DataFrame:
    """The records of (layout, path, source, split); an unknown layout is an error before anything is read."""
    if unknown := sorted({layout for layout, *_ in sources} - set(LOADERS)):
        raise KeyError(f"no loader for {', '.join(unknown)}; there are {', '.join(LOADERS)}")
    return reduce(DataFrame.unionByName, [LOADERS[layout](spark, path, source, split) for layout, path, source, split in sources])
