"""Queries over orders of all rows, numbered records, counts on the way and snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake.operators import curate, ordered
from assertlake.plans.tables import CANDIDATES, candidates, table
from assertlake.sources import records, snapshots, stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, sum(l_quantity) OVER (ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS spent, sum(l_quantity) OVER () AS total FROM lineitem) WHERE spent <= 100000")
def within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items, in order, whose quantities add up to no more than a budget."""
    return ordered.within_budget(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], F.col("l_quantity"), 100_000).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, sum(o_custkey % 3) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders")
def places_and_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's place by date, and a sum over all before it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    placed = ordered.with_place(rows, ["o_orderdate", "o_orderkey"])
    return ordered.prefix_sum(placed, ["o_orderdate", "o_orderkey"], (F.col("o_custkey") % 3).cast("long"), "running").select("o_orderkey", "place", "running")


@query(f"""WITH r AS (SELECT task, cand, CASE WHEN verdict = 'EQUIVALENT' THEN 1 WHEN verdict IN ('NOT_EQUIVALENT', 'TIMEOUT') THEN 0 END AS s FROM {CANDIDATES}), k AS (SELECT * FROM r WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, s ORDER BY cand) <= 2)
SELECT a.task, a.cand AS chosen, b.cand AS rejected FROM k a JOIN k b ON a.task = b.task AND a.s = 1 AND b.s = 0 ORDER BY 1, 2, 3 LIMIT 500""")
def capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs, the first 500 of all in order; the limit is the feature."""
    v = F.col("verdict")
    return curate.preference_pairs(candidates(spark, sf_dir), "task", "cand", v == "EQUIVALENT", v.isin("NOT_EQUIVALENT", "TIMEOUT"), most=500)


_LINE = "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN '{\"id\": ' ELSE '{\"id\": ' || c_custkey || ', \"nl\": \"n' || c_nationkey || '\"}' END"


@query(f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 10 <> 0 THEN 'n' || c_nationkey END AS nl, CASE WHEN c_custkey % 10 = 0 THEN {_LINE} END AS broken FROM customer WHERE c_custkey % 7 <> 0")
def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with broken and blank ones among them, written and read back by file and place."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_LINE).alias("value"))
    at = stage.path(spark, "records")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(at)
    read = records.records(spark, at, "id long, nl string").select("file", F.col("place").alias("line"), "id", "nl", F.col("_corrupt_record").alias("broken"))
    return ordered.with_place(read, ["file", "line"]).select("place", "id", "nl", "broken")


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS hits, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS misses FROM customer")
def counted_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their first order; those without one are counted while the rows are written."""
    firsts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first"))
    rows, seen = records.matched(table(spark, sf_dir, "customer").select("c_custkey"), firsts, "c_custkey")
    rows.write.parquet(stage.path(spark, "matched"))
    found = seen.get
    return spark.createDataFrame([(found["rows"], found["hits"], found["misses"])], "rows long, hits long, misses long")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_nationkey ELSE s_name END AS v FROM supplier UNION ALL SELECT -1 - s_suppkey, 'added' FROM supplier WHERE s_suppkey % 3 = 0")
def snapshot_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, then an upsert that replaces a third of the rows and adds others."""
    at = stage.path(spark, "snapshots")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), "s_nationkey")
    for half in (0, 1):
        snapshots.append(rows.where(F.col("k") % 2 == half).select("k", "v"), at)
    third = rows.where("k % 3 = 0")
    snapshots.upserted(third.select("k", F.concat(F.lit("new "), F.col("s_nationkey").cast("string")).alias("v")).unionByName(third.select((-1 - F.col("k")).alias("k"), F.lit("added").alias("v"))), at, "k")
    return snapshots.read(spark, at)
