"""Deterministic splits, samples and quotas by hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assertlake.functions.keys import bucket, digest


def seeded(column: Column, seed: int) -> Column:
    """Sixteen hexadecimal digits that order rows like a shuffle with that seed."""
    return digest(F.concat(F.lit(f"{seed}|"), column.cast("string")))


def with_rank(df: DataFrame, key: Column, by: list[str] = (), ties: list[str] = (), digits: int = 3, name: str = "rank") -> DataFrame:
    """The 0-based rank by a hexadecimal hash within groups. Rows are ranked in ranges of the hash and the ranges' sizes added, so no group is
    sorted in one task."""
    by = list(by)
    rows = df.withColumn("__key", key).withColumn("__range", F.substring("__key", 1, digits))
    sizes = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy(*by, "__range").orderBy("__key", *ties)) - 1
    return rows.withColumn("__own", own).join(sizes, [*by, "__range"]).select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))


def bucket_split(df: DataFrame, key: Column, ratio: float) -> DataFrame:
    """split: sft for ratio of the key's thousand buckets, else grpo."""
    return df.withColumn("split", F.when(bucket(key) < int(ratio * 1000), "sft").otherwise("grpo"))


def fraction_split(df: DataFrame, id_: str, fraction: float, seed: int) -> DataFrame:
    """split: head for just int(fraction * rows) rows in shuffled order, else tail."""
    n = df.count()
    return with_rank(df, seeded(F.col(id_), seed), ties=[id_]).withColumn("split", F.when(F.col("rank") < int(n * fraction), "head").otherwise("tail")).drop("rank")


def sample(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """Just n rows (or all, if there are fewer) without replacement."""
    return with_rank(df, seeded(F.col(id_), seed), ties=[id_]).where(F.col("rank") < n).drop("rank")


def stratified(df: DataFrame, stratum: str, quotas: dict, id_: str, seed: int) -> DataFrame:
    """As many rows of each stratum as its quota says; strata without a quota give none."""
    quota = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(stratum))
    some = df.where(F.col(stratum).isin(list(quotas)))
    return with_rank(some, seeded(F.col(id_), seed), [stratum], [id_]).where(F.col("rank") < quota).drop("rank")


def replay_mix(df: DataFrame, stage: str, current: int, ratio: float, id_: str, seed: int) -> DataFrame:
    """All rows of the current stage, and of each earlier one int(ratio * its rows), one at least. origin: current or replay."""
    sizes = df.groupBy(stage).agg(F.greatest(F.lit(1), (F.count(F.lit(1)) * ratio).cast("int")).alias("__quota"))
    old = with_rank(df.where(F.col(stage) < current), seeded(F.col(id_), seed), [stage], [id_]).join(sizes, stage).where("rank < __quota").drop("rank", "__quota")
    now = df.where(F.col(stage) == current)
    return now.withColumn("origin", F.lit("current")).unionByName(old.select(*df.columns, F.lit("replay").alias("origin")))


def assert_disjoint(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    if not left.join(right, on, "left_semi").isEmpty():
        raise ValueError(f"both sides hold the same {', '.join(on)}")


def golden_zone(count: Column, n: Column) -> Column:
    """too_hard without any success, too_easy with all, else viable."""
    return F.when(count == 0, "too_hard").when(count >= n, "too_easy").otherwise("viable")


def top(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n most frequent keys with their counts; of equals the first seen by order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first")).orderBy(F.desc("n"), "__first").limit(n).drop("__first")


def candidates(df: DataFrame, hits: str, stars: str, id_: str, low_stars: int, n: int) -> DataFrame:
    """Rows with enough stars, the n with the most hits, to be read by stars."""
    return df.where(F.col(stars) >= low_stars).orderBy(F.desc(hits), id_).limit(n).orderBy(F.desc(stars), id_)


def variant_order(name: Column) -> list[Column]:
    """Sort columns of run names: base first, then by stage number, then by name."""
    return [F.when(name.rlike("(?i)base"), 0).otherwise(1), F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("int"), F.lit(0)), name]


def by_provenance(df: DataFrame, made: list[str], provenance: str = "provenance") -> DataFrame:
    """df with side: synthetic where there is a provenance and all of it is in made, else real (rows of both sides are real)."""
    from assertlake.functions.predicates import all_in

    return df.withColumn("side", F.when(all_in(F.col(provenance), made), "synthetic").otherwise("real"))


def side_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(side, column, value, n) of the columns' values on each side, and the sides' sizes with column null: one pass over df."""
    told = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select("side", F.explode(told).alias("x")).groupBy("side", "x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
