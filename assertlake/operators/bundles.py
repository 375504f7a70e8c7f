"""What a source file needs to be read alone: the packages and interfaces of its repository, and its neighbours, in one text before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: How far up a root is looked for; at most so many packages and characters of them, and interfaces.
LEVELS, PACKAGES, PACKAGE_CHARS, INTERFACES = 15, 25, 500_000, 10

PATHS = r"^(.*)/([^/]*)$"


def folder(path: str | Column) -> Column:
    return F.regexp_extract(path, PATHS, 1)


def name(path: str | Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


#: So many containers are looked up beside each row. A larger table is joined in SALTS copies, since nearly all paths share their topmost folders.
FEW, SALTS = 1_000, 16


def rooted(files: DataFrame, containers: DataFrame, names: list[str] = ()) -> DataFrame:
    """files (path, ...) with root: the nearest of the path and the folders above it that lies right in a container (containers: path) or has one of the names;
    null without any within LEVELS. With FEW containers it is a look-up in each row, and no task holds paths; a larger table is joined with the folders of all levels."""
    parts, up = (next(x for x in (c + "_" * i for i in range(len(files.columns) + 1)) if x not in {y.lower() for y in files.columns}) for c in ("parts", "up"))
    root = lambda k: F.call_function("substring_index", F.col("path"), F.lit("/"), F.size(parts) - k)
    named = lambda k: F.get(parts, F.size(parts) - k - 1).isin(list(names))
    rows = files.withColumn(parts, F.split("path", "/"))
    ups = F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(LEVELS - 1)))
    inside = containers.select(F.regexp_replace("path", "/+$", "").alias("in")).where(F.col("in").isNotNull()).distinct()
    first = [r[0] for r in inside.limit(FEW + 1).collect()]
    if len(first) <= FEW:
        rows = rows.withColumn(up, F.get(F.filter(ups, lambda k: root(k + 1).isin(first) | named(k)), F.lit(0)))
    else:
        above = rows.select("path", parts, F.explode(ups).alias(up)).select("path", up, root(F.col(up) + 1).alias("in"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
        held = inside.select("in", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        nearest = above.join(held, ["in", "salt"], "left_semi").groupBy("path").agg(F.min(up).alias(up))
        rows = rows.join(nearest, "path", "left").withColumn(up, F.least(up, F.get(F.filter(ups, named), F.lit(0))))
    return rows.select(*files.columns, F.when(F.col(up).isNotNull(), root(F.col(up))).alias("root"))


def without_includes(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?md)^\s*`include\s+.*$", "")


def joined(kind: str, order: list[str]) -> Column:
    """The texts in order, each below a line with its kind and name."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.concat(F.lit(f"// === {kind}: "), name("path"), F.lit(" ===\n"), without_includes("text")).alias("chunk"))))
    return F.array_join(F.transform(rows, lambda x: x["chunk"]), "\n")


def preambles(files: DataFrame) -> DataFrame:
    """(root, preamble) of files (path, root, text): packages (*_pkg.sv, then *_pkg.svh, by path), up to PACKAGES of them and to the first that would pass
    PACKAGE_CHARS, then interfaces (*_if.sv, then *_intf.sv). Only the first few files of a root are taken on."""
    rows = files.where("root is not null")
    rank = F.when(F.col("path").endswith("_pkg.sv"), 0).when(F.col("path").endswith("_pkg.svh"), 1).when(F.col("path").endswith("_if.sv"), 2).when(F.col("path").endswith("_intf.sv"), 3)
    rows = rows.withColumn("rank", rank).where("rank is not null").withColumn("kind", F.col("rank") < 2)
    w = W.partitionBy("root", "kind").orderBy("rank", "path")
    rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= PACKAGES).where(F.col("kind") | (F.col("n") <= INTERFACES))
    chars = F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))
    # chars only grow: what passes the bound has all that follows it passing too
    rows = rows.withColumn("chars", chars).where(~F.col("kind") | (F.col("chars") <= PACKAGE_CHARS))
    both = rows.groupBy("root", "kind").agg(F.when(F.col("kind"), joined("PKG", ["rank", "path"])).otherwise(joined("IF", ["rank", "path"])).alias("text"))
    return both.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("kind")).alias("k"), "text"))), lambda x: x["text"]), "\n").alias("preamble"))


def bundled(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bundle) for each path of wanted: its root's preamble, then its folder's other .sv files and the .svh files. files: (path, root, text)."""
    sides = files.where(F.col("path").endswith(".sv") | F.col("path").endswith(".svh")).select(folder("path").alias("dir"), "path", F.col("path").endswith(".svh").alias("head"), "text")
    chunk = F.concat(F.lit("// === SIB: "), name("path"), F.lit(" ===\n"), without_includes("text"))
    beside = sides.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("head", "path", chunk.alias("chunk")))).alias("beside"))
    rows = wanted.select("path").distinct().join(files.select("path", "root").distinct(), "path", "left").withColumn("dir", folder("path"))
    rows = rows.join(preambles(files), "root", "left").join(beside, "dir", "left")
    others = F.transform(F.filter("beside", lambda x: x["head"] | (x["path"] != F.col("path"))), lambda x: x["chunk"])
    parts = F.concat(F.when(F.col("preamble") != "", F.array("preamble")).otherwise(F.array().cast("array<string>")), F.coalesce(others, F.array().cast("array<string>")))
    return rows.select("path", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("bundle"))
