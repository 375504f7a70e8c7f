"""What depends on one order over all rows: places, prefix sums and budgets, without a single task that sees them all.

Rows are dealt to ranges of the order by sampled splitters, sorted there, numbered and staged once; totals of the ranges (a row each) are added up, and only
what needs it looks into a range. Equal rows of the order are dealt to one range: give an order that tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assertlake.sources.stage import staged

#: The lower bits of an id that Spark gives to the rows of a task: their number in it.
NUMBER = (1 << 33) - 1


def ranged(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """df with __range and __place, the place within it; ranges are as many as shuffle partitions, unless said."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return staged(rows.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit(NUMBER)).alias("__place")), "ranged")


def before(rows: DataFrame, value: Column) -> DataFrame:
    """(__range, __before, __total) of ranged rows: the sum of value in the ranges before, and in the range. A row for each range."""
    totals = rows.groupBy("__range").agg(F.sum(value).alias("__total"))
    return totals.withColumn("__before", F.coalesce(F.sum("__total").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def with_place(df: DataFrame, order: list[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with the place of each row in the order, from 0, without gaps."""
    rows = ranged(df, order, ranges)
    return rows.join(F.broadcast(before(rows, F.lit(1)).drop("__total")), "__range").withColumn(name, F.col("__before") + F.col("__place")).select(*df.columns, name)


def prefix_sum(df: DataFrame, order: list[str], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """df with the sum of value over the rows up to and with each."""
    rows = ranged(df.withColumn("__value", value), order, ranges)
    inside = F.sum("__value").over(W.partitionBy("__range").orderBy("__place").rowsBetween(W.unboundedPreceding, 0))
    sums = F.broadcast(before(rows, F.col("__value")).drop("__total"))
    return rows.withColumn("__inside", inside).join(sums, "__range").withColumn(name, F.col("__before") + F.col("__inside")).select(*df.columns, name)


def within_budget(df: DataFrame, order: list[str], cost: Column, budget: int, ranges: int | None = None) -> DataFrame:
    """The first rows in the order whose costs (not negative; null: none) add up to no more than the budget. Only the range where it ends is added up row by row."""
    rows = ranged(df.withColumn("__cost", F.coalesce(cost, F.lit(0)).cast("decimal(38,0)")), order, ranges)
    sums = F.broadcast(before(rows, F.col("__cost")))
    rows = rows.join(sums, "__range").where(F.col("__before") <= budget)
    whole = rows.where(F.col("__before") + F.col("__total") <= budget)
    last = rows.where(F.col("__before") + F.col("__total") > budget)
    inside = F.sum("__cost").over(W.partitionBy("__range").orderBy("__place").rowsBetween(W.unboundedPreceding, 0))
    last = last.withColumn("__inside", inside).where(F.col("__before") + F.col("__inside") <= budget)
    return whole.select(*df.columns).unionByName(last.select(*df.columns))


def first_rows(df: DataFrame, order: list[str], n: int, ranges: int | None = None) -> DataFrame:
    """The first n rows in the order, whichever splits the rows come in."""
    return within_budget(df, order, F.lit(1), n, ranges)
