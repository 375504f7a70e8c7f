"""The driver's tables as inputs: assertions and verdicts are derived from whole numbers, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Assertions of all levels, some of them malformed; {m} becomes the order's key modulo 5.
TEMPLATES = [
    "assert property (@(posedge clk) req |-> ##[1:3] gnt{m});",
    "assert property (@(posedge clk) disable iff (rst) a{m} |=> b);",
    "assert property (@(posedge clk) s_eventually done{m});",
    "cover property (@(negedge clk) a ##2 b{m});",
    "assert property (@(posedge clk) valid{m} == 1);",
    "assert property (@(posedge clk) a throughout b{m});",
    "assert property (@(posedge clk) x[*2:4] ##1 y{m});",
    "assume property (@(posedge clk) $rose(req) |-> 1);",
    "a{m}: assert property (@(posedge clk) (a && b{m}) |-> strong(##1 c));",
    "assert property (@(posedge clk) req{m} |-> );",
    "assert property (@(posedge clk) a /* |-> */ == b{m}",
    "property p{m}; a until_with b; endproperty",
    "Assert  property (@(posedge clk)   REQ |->   gnt{m});",
]
VERDICTS = ["EQUIVALENT", "IMPLIES_REF_TO_LM", "IMPLIES_LM_TO_REF", "NOT_EQUIVALENT", "UNSUPPORTED", "TIMEOUT"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(texts: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(key, F.lit(len(texts))) + 1).cast("int"))


def sql_list(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sva, customer): one for each order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sva = F.replace(chosen(TEMPLATES, F.col("o_orderkey")), F.lit("{m}"), (F.col("o_orderkey") % 5).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), sva.alias("sva"), F.col("o_custkey").alias("customer"))


ASSERTIONS = f"(SELECT o_orderkey AS id, replace(({sql_list(TEMPLATES)})[1 + o_orderkey % {len(TEMPLATES)}], '{{m}}', (o_orderkey % 5)::VARCHAR) AS sva, o_custkey AS customer FROM orders)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, cand, verdict, tcl): line items as candidates of the order's task."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    v = chosen(VERDICTS, F.col("l_partkey") + F.col("l_linenumber"))
    return rows.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("cand"), v.alias("verdict"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("tcl"))


CANDIDATES = f"(SELECT l_orderkey AS task, l_linenumber AS cand, ({sql_list(VERDICTS)})[1 + (l_partkey + l_linenumber) % {len(VERDICTS)}] AS verdict, (l_orderkey % 5 + 1)::INT AS tcl FROM lineitem)"

SQL_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_squeezed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SQL_SPACE}+', ' ', 'g'), ' ')"


def sql_strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_digest(x: str) -> str:
    return f"substr(sha256({x}), 1, 16)"


def lines(spark: SparkSession, sf_dir: str, name: str, id_: str) -> DataFrame:
    """(id, line): the trimmed lines of over 20 characters of a table's texts."""
    rows = table(spark, sf_dir, name).select(F.col(id_).alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    return rows.select("id", F.trim("line").alias("line")).where(F.length("line") > 20)


def sql_lines(name: str, id_: str) -> str:
    return f"(SELECT id, line FROM (SELECT {id_} AS id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM {name}) WHERE length(line) > 20)"
