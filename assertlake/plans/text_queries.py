"""Queries whose text rules pass SQL: rewriting, lowering, extraction, descriptions, providers and streams. Tested against golden texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake.functions import describe, keys, rewrite
from assertlake.operators import curate, extract, provider
from assertlake.plans import golden
from assertlake.plans.tables import ASSERTIONS, TEMPLATES, assertions, table
from assertlake.sources import stage
from assertlake.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The assertions are dealt to so many groups; a page's file has one group.
FILES = 50


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def sql_value(v) -> str:
    if v is None or isinstance(v, (bool, int)):
        return {None: "NULL", True: "true", False: "false"}.get(v, str(v))
    return "replace('" + v.replace("'", "''") + "', '{m}', (id % 5)::VARCHAR)"


def sql_golden(rows: list[tuple], columns: str) -> str:
    """The expected rows (template's place, values) for all assertions of that form."""
    own = " UNION ALL ".join(f"SELECT id, {', '.join(f'{sql_value(v)} AS {c}' for c, v in zip(columns.split(), row[1:]))} FROM a WHERE id % {len(TEMPLATES)} = {row[0]}" for row in rows)
    return f"WITH a AS (SELECT id FROM {ASSERTIONS}) {own}"


def distinct_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text once with the smallest id: what is costly in Python is done once for equal texts."""
    return assertions(spark, sf_dir).groupBy("sva").agg(F.min("id").alias("id"))


def for_all_ids(spark: SparkSession, sf_dir: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """judge's rows (sva, ...) of each distinct text, for every id that has the text."""
    rows = assertions(spark, sf_dir).select("id", "sva")
    texts = rows.select("sva").distinct()
    few = texts.limit(curate.BROADCAST_ROWS + 1).count() <= curate.BROADCAST_ROWS
    judged = judge(texts)
    return rows.join(F.broadcast(judged) if few else judged, "sva").drop("sva")


@query(sql_golden(list(enumerate(golden.NORMALISED)), "normalised"))
def normalize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_all_ids(spark, sf_dir, lambda texts: texts.select("sva", rewrite.normalise("sva").alias("normalised")))


@query(sql_golden([(i, *x) for i, x in enumerate(golden.LOWERED)], "ok pattern tcl lowered"))
def lower_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_all_ids(spark, sf_dir, lambda texts: texts.select("sva", rewrite.lower("sva").alias("x")).select("sva", "x.ok", "x.pattern", "x.tcl", "x.lowered"))


@query(r"""SELECT id, CASE WHEN regexp_matches(sva, '^[^|]*\|(?:->|=>)\s*1\);$') THEN regexp_extract(sva, '\|(?:->|=>)') || ' RHS is constant true' ELSE '' END AS reason, CASE WHEN regexp_matches(sva, '^[^|]*\|(?:->|=>)\s*1\);$') THEN 0.0 ELSE 1.0 END AS score FROM """ + ASSERTIONS)
def vacuity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = rewrite.vacuity("sva")
    return for_all_ids(spark, sf_dir, lambda texts: texts.select("sva", reason.alias("reason"))).withColumn("score", F.when(F.col("reason") == "", 1.0).otherwise(0.0))


@query(f"""WITH s AS ({sql_golden(list(enumerate(golden.SWAPPED)), "mutated")}), a AS (SELECT id, sva FROM {ASSERTIONS}), m AS (
SELECT id, 'swap' AS kind, mutated FROM s UNION ALL SELECT id, 'vacuous', 'assert property (@(posedge clk) 1''b1);' FROM a
UNION ALL SELECT id, 'flip', CASE WHEN contains(sva, '==') THEN regexp_replace(sva, '==', '!=') WHEN contains(sva, '!=') THEN regexp_replace(sva, '!=', '==') ELSE regexp_replace(sva, '&&', '||') END FROM a
UNION ALL SELECT id, 'delay', CASE WHEN contains(sva, '|->') THEN regexp_replace(sva, '\\|->', '|=>') WHEN contains(sva, '|=>') THEN regexp_replace(sva, '\\|=>', '|->')
  WHEN regexp_matches(sva, '##\\s*\\d+') THEN regexp_extract(sva, '^(.*?)##\\s*\\d+', 1) || '##' || (regexp_extract(sva, '##\\s*(\\d+)', 1)::INT + 1) || regexp_extract(sva, '##\\s*\\d+(.*)$', 1) ELSE sva END FROM a)
SELECT m.id, kind, mutated, mutated <> sva AS changed FROM m JOIN a USING (id)""")
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, rewrite.MUTATIONS)))
    mutated = rewrite.mutate("sva", "kind")
    return for_all_ids(spark, sf_dir, lambda texts: texts.select("sva", kinds.alias("kind")).select("sva", "kind", mutated.alias("mutated"), (mutated != F.col("sva")).alias("changed")))


@query(sql_golden(golden.EXPANDED, "kind text"))
def expanded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that are classified at the level that they are made for."""
    from assertlake.functions.classify import level

    target = F.when(F.col("kind").startswith("range_"), 3).otherwise(5)
    variants = lambda texts: texts.select("sva", F.explode(rewrite.expand("sva")).alias("v")).select("sva", "v.*")
    return for_all_ids(spark, sf_dir, lambda texts: variants(texts).where(level("text") == target).select("sva", "kind", "text"))


@query(f"""WITH d AS ({sql_golden(list(enumerate(golden.DESCRIBED)), "nl")}) SELECT d.id, nl, 'For module m, ' || CASE WHEN contains(sva, 's_eventually') THEN 'the consequent condition should eventually hold after the trigger.'
WHEN contains(sva, 'until_with') THEN 'the antecedent condition should persist until the terminating condition holds.' WHEN contains(sva, '##[') THEN 'after the trigger, the consequent should hold within a bounded cycle range.'
WHEN contains(sva, 'throughout') THEN 'the guarded condition should hold throughout the target sequence.' ELSE 'generate an SVA matching the extracted temporal property.' END AS by_operator FROM d JOIN {ASSERTIONS} a USING (id)""")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_all_ids(spark, sf_dir, lambda texts: texts.select("sva", describe.describe("sva").alias("nl"), describe.by_operator("sva", F.lit("m"), F.lit("")).alias("by_operator")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a source file, with the assertions of one of FILES groups in it."""
    a = distinct_assertions(spark, sf_dir).select((F.col("id") % FILES).alias("part"), "sva")
    per = a.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("sva")), "\n// next\n").alias("svas"))
    head = F.concat(F.lit("module m"), F.col("page_id").cast("string"), F.lit("(input clk);\n// checks the thing\n"))
    tail = F.lit("\nproperty named_p; a |-> b; endproperty\n`ASSERT(Known, a |-> c)\nendmodule\n")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.pmod("page_id", F.lit(FILES)).alias("part")).join(F.broadcast(per), "part", "left")
    return rows.select(F.col("url").alias("path"), F.concat(head, F.coalesce("svas", F.lit("")), tail).alias("text"))


@query()
def extract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(_files(spark, sf_dir))


@query(f"""SELECT url AS path, 0 AS low, 4 + CASE WHEN g.n IS NULL THEN 1 ELSE 2 * g.n - 1 END AS high, 'm' || page_id AS module FROM pages LEFT JOIN (SELECT part, count(*) AS n FROM (SELECT min(id) % {FILES} AS part FROM {ASSERTIONS} GROUP BY sva) GROUP BY part) g ON g.part = page_id % {FILES}""")
def module_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.modules(_files(spark, sf_dir))


#: Which of the templates pass the syntax check.
WELL_FORMED = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12)

_FORMS = " UNION ALL ".join(f"SELECT {i} AS form, {sql_value(golden.NORMALISED[i])} AS norm, {str(golden.LOWERED[i][0]).lower()} AS ok, {str(i in WELL_FORMED).lower()} AS well, id FROM {ASSERTIONS} WHERE id % {len(TEMPLATES)} = {i}" for i in range(len(TEMPLATES)))


@query(f"""WITH f AS ({_FORMS}), a AS (SELECT x.id, x.sva, x.customer, norm, ok, well FROM {ASSERTIONS} x JOIN f USING (id)), r AS (SELECT customer, arg_min(sva, id) AS ref, arg_min(norm, id) AS ref_norm, arg_min(ok, id) AS ref_ok FROM a GROUP BY customer),
p AS (SELECT DISTINCT sva, ref, norm, ok, well, ref_norm, ref_ok FROM a JOIN r USING (customer))
SELECT CASE WHEN NOT well THEN 'PARSE_ERROR' WHEN NOT (ok AND ref_ok) THEN 'UNSUPPORTED' WHEN norm = ref_norm THEN 'EQUIVALENT' ELSE 'NOT_EQUIVALENT' END AS verdict, count(*) AS n FROM p GROUP BY 1""")
def provider_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assertion against its customer's first, once for each pair, by the provider that needs no tool."""
    a = assertions(spark, sf_dir)
    pairs = a.join(a.groupBy("customer").agg(F.min_by("sva", "id").alias("ref")), "customer").select(F.col("sva").alias("lm"), "ref", F.lit("module m; endmodule").alias("rtl")).distinct()
    judged = provider.verdicts(provider.requests(pairs, "lm", "ref", "rtl"), provider.normalised_equality)
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that keeps the smallest event of each key in its state, against the same in batch."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    first = stream.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    out = stage.path(spark, "stream")
    run = first.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_type")
    key = keys.digest(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    out = stage.path(spark, "stream")
    incremental.appended(incremental.first_seen(stream, key), f"{out}/rows", f"{out}/state").awaitTermination()
    rows = spark.read.schema("user_id long, event_type string").parquet(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))
