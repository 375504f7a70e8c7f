"""Queries that ask recorded tools and models, through the request pool, gates and rounds. What a recorded answerer says follows from the request, in SQL too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake.operators import pool, rounds
from assertlake.plans import golden
from assertlake.plans.tables import ASSERTIONS, TEMPLATES, assertions, table
from assertlake.sources import stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Logs of a recorded prover, by the length of the design that it gets.
LOGS = ["engine_0 (smtbmc z3) returned PASS", "engine_0 (smtbmc z3) returned FAIL", "nothing known", "ERROR: syntax error", "cover point unreachable"]
STATUSES = ["PASS", "FAIL", "FAIL", "PARSE_ERROR", "VACUOUS"]
REWARDS = {"PASS": 1.0, "FAIL": 0.5, "VACUOUS": 0.2, "PARSE_ERROR": 0.0, "EXTRACT_ERROR": 0.0}


def recorded_log(request: dict) -> dict:
    return {"log": LOGS[len(request["rtl"]) % len(LOGS)]}


_OK = " UNION ALL ".join(f"SELECT {i} AS form, {str(x[0]).lower()} AS ok, replace('{x[3].replace(chr(39), chr(39) * 2)}', chr(13), '') AS lowered" for i, x in enumerate(golden.LOWERED))
_REWARD = " ".join(f"WHEN '{k}' THEN {v}" for k, v in REWARDS.items())
_BY_LOG = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"


@query(rf"""WITH l AS ({_OK}), a AS (SELECT id, sva, customer % 7 = 0 AS cut, ok, replace(lowered, '{{m}}', (id % 5)::VARCHAR) AS lowered FROM {ASSERTIONS} JOIN l ON form = id % {len(TEMPLATES)}),
g AS (SELECT *, CASE WHEN regexp_matches(sva, '^[^|]*\|(?:->|=>)\s*1\);$') THEN 'vacuity' WHEN NOT ok THEN 'lowering' WHEN cut THEN 'injection' ELSE 'prover' END AS gate FROM a),
s AS (SELECT id, gate, CASE gate WHEN 'vacuity' THEN 'VACUOUS' WHEN 'lowering' THEN 'UNSUPPORTED' WHEN 'injection' THEN 'EXTRACT_ERROR'
  ELSE {_BY_LOG}[1 + length('module m(input clk);' || chr(10) || chr(10) || lowered || chr(10) || 'endmodule') % {len(LOGS)}] END AS status FROM g)
SELECT id, gate, status, CASE status {_REWARD} END::DOUBLE AS reward FROM s""")
def verified_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assertion through all gates; a design of each seventh customer has no end. Equal pairs are proved once."""
    design = F.when(F.col("customer") % 7 == 0, "module m(input clk);").otherwise("module m(input clk);\nendmodule")
    rows = assertions(spark, sf_dir).select("id", "sva", design.alias("rtl"))
    pairs = stage.staged(rows.groupBy("sva", "rtl").agg(F.min("id").alias("key")), "pairs")
    done = rounds.verified(pairs, recorded_log).select("key", "gate", "status", "reward")
    return rows.join(pairs.join(done, "key"), ["sva", "rtl"]).select("id", "gate", "status", "reward")


SPECS = [{"temp": 0.7, "k": 2, "max": 320}, {"temp": 0.95, "k": 4, "max": 320}]
HAD = "assert property (a |-> v0);"


def recorded_texts(request: dict) -> list[dict]:
    step = 3 if request["temperature"] > 0.9 else 1
    return [{"text": f"```sv\nassert property (a{' ' * (1 + j % 2)}|-> v{(len(request['prompt']) + j * step) % 6});\n```"} for j in range(request["k"])]


_PROMPT = "length('Generate an SVA assertion for:' || chr(10) || 'nation ' || c_nationkey || ' of ' || c_custkey)"
_ANSWERS = " UNION ALL ".join(
    f"SELECT c_custkey, {r} AS r, j, 'assert property (a' || repeat(' ', (1 + j % 2)::INT) || '|-> v' || (({_PROMPT} + j * {3 if s['temp'] > 0.9 else 1}) % 6) || ');' AS sva FROM customer, (SELECT unnest(range(0, {s['k']})) AS j)" for r, s in enumerate(SPECS)
)


@query(f"""WITH x AS ({_ANSWERS}), n AS (SELECT *, regexp_replace(sva, ' +', ' ', 'g') AS norm FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, norm ORDER BY r, j) AS nth FROM n WHERE norm <> '{HAD}')
SELECT c.c_custkey::VARCHAR AS id, '{HAD}' || coalesce(chr(10) || string_agg(sva, chr(10) ORDER BY r, j), '') AS alt_svas FROM customer c LEFT JOIN f ON f.c_custkey = c.c_custkey AND nth = 1 GROUP BY c.c_custkey""")
def alternative_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of generation for every customer's description; what is new in each is added once."""
    nl = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"), F.lit(" of "), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), nl.alias("nl"), F.array(F.lit(HAD)).alias("alt_svas"))
    out = rounds.alternatives(rows, recorded_texts, "You write assertions.", SPECS, stage.path(spark, "alternatives"))
    return out.select("id", F.array_join("alt_svas", "\n").alias("alt_svas"))


@query("SELECT s_suppkey AS key, r::INT AS round, r >= s_suppkey % 4 AS met FROM supplier, (SELECT unnest(range(0, 4)) AS r) WHERE r <= s_suppkey % 4")
def open_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are asked round by round until each is met; rounds end by themselves."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return rounds.rounds(rows, lambda open_, k: open_.withColumn("met", F.col("key") % 4 <= k), F.col("met"), stage.path(spark, "rounds"), 99)


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN 'EMPTY' WHEN p_partkey % 13 = 0 THEN 'EXCEPTION:ValueError' ELSE 'OK' END AS status, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN 1 + (p_partkey % 2)::INT ELSE 0 END AS n,
CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN length(p_name) END AS size FROM part""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each part, with a schema of its own: one row each, whatever the answerer does."""

    def answer(request: dict) -> list[dict]:
        if request["key"] % 11 == 0:
            return []
        if request["key"] % 13 == 0:
            raise ValueError
        return [{"size": len(request["name"])}] * (1 + request["key"] % 2)

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    out = pool.answered(rows, answer, "size int", partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select("key", "status", F.size("answers").alias("n"), F.get("answers", F.lit(0))["size"].cast("long").alias("size"))
