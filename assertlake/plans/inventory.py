"""Queries of whole families of functions and operators: rewards, predicates, text parsers, sinks and readers, providers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake import schemas
from assertlake.functions import keys, parse, predicates, prompts, rewards
from assertlake.operators import evaluate, provider, splits
from assertlake.plans.tables import ASSERTIONS, VERDICTS, assertions, chosen, sql_list, sql_squeezed, sql_strip, table
from assertlake.sources import readers, sinks, stage
from assertlake.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_LOGS = ["x ERROR: syntax error; engine_0 (smtbmc z3) returned PASS", "summary: engine_0 (smtbmc z3) did pass", "engine_0 (smtbmc z3) returned FAIL", "cover point is Unreachable", "nothing", ""]
_STATUS = ["PASS", "FAIL", "TIMEOUT", "VACUOUS", "PARSE_ERROR", "UNKNOWN", "UNSUPPORTED", "EXTRACT_ERROR"]


def _case(values: dict[str, float], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


_GRADED = f"CASE WHEN has AND syn THEN CASE WHEN v = 'UNSUPPORTED' THEN 0.15 ELSE {_case(rewards.EQUIVALENCE, 'v', '0.0')} END ELSE 0.0 END"
_ROLLOUTS = f"""(SELECT l_orderkey AS task, l_linenumber AS cand, ({sql_list(VERDICTS)})[1 + (l_partkey + l_linenumber) % 6] AS v, ({sql_list(_STATUS)})[1 + l_partkey % 8] AS status, ({sql_list(_LOGS)})[1 + l_suppkey % 6] AS log,
l_partkey % 5 <> 0 AS syn, l_suppkey % 7 <> 0 AS has, l_partkey % 3 <> 0 AS compiles, l_suppkey % 2 = 0 AS vacuous, (l_partkey % 11) / 10.0::DOUBLE AS sim, l_partkey % 4 * 10 AS cycles, l_suppkey % 6 AS f_ref, l_partkey % 6 AS f_gen FROM lineitem)"""
_AGREE = "CASE WHEN cycles > 0 THEN CASE WHEN greatest(f_ref, f_gen) = 0 THEN 1.0 ELSE 1.0 - abs(f_ref - f_gen) / greatest(f_ref, f_gen)::DOUBLE END END"


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judged candidates."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task"), line.alias("cand"), chosen(VERDICTS, part + line).alias("v"), chosen(_STATUS, part).alias("status"), chosen(_LOGS, supp).alias("log"), (part % 5 != 0).alias("syn"), (supp % 7 != 0).alias("has"),
        (part % 3 != 0).alias("compiles"), (supp % 2 == 0).alias("vacuous"), ((part % 11) / 10.0).alias("sim"), (part % 4 * 10).alias("cycles"), (supp % 6).alias("f_ref"), (part % 6).alias("f_gen"),
    )


@query(f"""WITH r AS (SELECT *, {_AGREE} AS agree, {_GRADED} AS graded FROM {_ROLLOUTS})
SELECT task, cand, round(graded, 9) AS equivalence, round(0.4 * syn::INT + 0.6 * sim, 9) AS edit, round(0.2 * syn::INT + 0.3 * sim + 0.5 * graded, 9) AS hybrid,
round(CASE WHEN NOT (has AND syn) THEN 0.0 ELSE greatest(graded, {_case(rewards.EQUIVALENCE, "'IMPLIES_LM_TO_REF'", '0.0')}) END, 9) AS best_reference,
round(CASE WHEN NOT (has AND syn) THEN 0.0 WHEN NOT compiles THEN 0.05 WHEN v IN ({", ".join(f"'{x}'" for x in rewards.UNDECIDED)}) THEN 0.15 + coalesce(0.5 * agree, 0.0) ELSE {_case(rewards.TIERED, 'v', '0.1')} END, 9) AS tiered,
round(CASE WHEN NOT (has AND syn) THEN 0.0 WHEN NOT compiles THEN 0.05 ELSE coalesce(agree, 0.1) END, 9) AS dynamic, round(agree, 9) AS agreement,
{_case(rewards.FORMAL | {"UNKNOWN": 0.5}, 'status', 'NULL')} AS formal, round(0.15 * syn::INT + 0.4 * {_case(rewards.COMBINED, 'status', '0.0')} + 0.2 * (NOT vacuous)::INT + 0.25 * sim, 9) AS combined,
(v = 'EQUIVALENT')::INT::DOUBLE AS strict, {_case(rewards.EQUIVALENCE, 'v', '0.0')} AS weight, 0.15 * syn::INT AS syntax_only, round(cycles / 1e6 * 0.6, 12) AS cost,
CASE WHEN log LIKE '%syntax error%' THEN 'PARSE_ERROR' WHEN log LIKE '%pass' THEN 'PASS' WHEN log LIKE '%FAIL' THEN 'FAIL' WHEN log LIKE 'cover%' THEN 'VACUOUS' ELSE 'UNKNOWN' END AS log_status FROM r""")
def reward_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reward of a candidate."""
    c = {x: F.col(x) for x in ("v", "status", "log", "syn", "has", "compiles", "vacuous", "sim", "cycles", "f_ref", "f_gen")}
    agree, graded = rewards.agreement(c["cycles"], c["f_ref"], c["f_gen"]), rewards.equivalence(c["v"], c["syn"], c["has"])
    out = {
        "equivalence": graded, "edit": rewards.edit(c["syn"], c["sim"]), "hybrid": rewards.hybrid(c["syn"], c["sim"], graded), "best_reference": rewards.best_reference(F.array(c["v"], F.lit("IMPLIES_LM_TO_REF")), c["syn"], c["has"]),
        "tiered": rewards.tiered(c["v"], c["syn"], c["has"], c["compiles"], agree), "dynamic": rewards.dynamic(c["syn"], c["has"], c["compiles"], agree), "agreement": agree, "formal": rewards.formal(c["status"]),
        "combined": rewards.combined(c["syn"], c["status"], c["vacuous"], c["sim"]), "strict": rewards.rollout_weight(c["v"], True), "weight": rewards.rollout_weight(c["v"], False), "syntax_only": rewards.syntax_only(c["syn"]),
    }
    rounded = [F.round(x, 9).alias(k) for k, x in out.items()]
    return rollouts(spark, sf_dir).select("task", "cand", *rounded, F.round(rewards.token_cost(c["cycles"]), 12).alias("cost"), rewards.log_status(c["log"]).alias("log_status"))


@query("SELECT task, sum(sim * cycles) / nullif(sum(cycles), 0) AS loss FROM " + _ROLLOUTS + " GROUP BY task")
def distilled_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).groupBy("task").agg(evaluate.distillation(F.col("sim"), F.col("cycles")).alias("loss"))


_X = sql_strip("text")


@query(rf"""SELECT doc_id, length({_X}) > 0 AS has_rtl, contains(text, 'module') AND contains(text, 'endmodule') AS has_module, regexp_matches(coalesce(text, ''), '(?i)^\s*\[(?:ASSERT|ASSUME|COVER)') AS placeholder,
length({_X}) < 5 OR regexp_matches({_X}, '(?i)^\s*\[(?:ASSERT|ASSUME|COVER)') AS needs_nl, contains(lower({_X}), 'assert') AND contains(lower({_X}), 'property') AND length({_X}) BETWEEN 30 AND 4000 AS valid,
lang IN ('en', 'de') AND source IN ('en', 'web', 'books') AS all_in, regexp_matches(lower(coalesce(source, '')), 'codev|83k|web') AND regexp_matches(lower(coalesce(source, '')), 'codev|83k') OR lang = 'CodeV-SVA-dataset-83K' AS codev,
CASE WHEN {_X} = '' THEN 'empty' WHEN NOT starts_with(lower({_X}), 'create a sva assertion') THEN 'missing_prefix' ELSE 'other' END AS nl_verdict,
CASE WHEN contains(lower(substr(coalesce(text, ''), 1, 400)), 'apache license, version 2.0') THEN 'Apache-2.0' WHEN contains(lower(substr(coalesce(text, ''), 1, 400)), 'bsd') THEN 'BSD' WHEN contains(lower(substr(coalesce(text, ''), 1, 400)), 'mit license') THEN 'MIT'
  WHEN contains(lower(substr(coalesce(text, ''), 1, 400)), 'gnu general public') THEN 'GPL' WHEN contains(lower(substr(coalesce(text, ''), 1, 400)), 'solderpad') THEN 'Solderpad-2.0' WHEN contains(lower(substr(coalesce(text, ''), 1, 400)), 'mozilla public') THEN 'MPL-2.0' ELSE 'UNKNOWN' END AS licence,
regexp_matches(coalesce(text, ''), '(?i)^(?:create|write) a SVA') AS starts_template, regexp_matches(coalesce(text, ''), '(?i)use the signals') AS mentions_signals FROM documents""")
def document_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = predicates.nl_verdict("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", predicates.has_rtl("text").alias("has_rtl"), predicates.has_module("text").alias("has_module"), predicates.is_placeholder("text").alias("placeholder"), predicates.needs_nl("text").alias("needs_nl"), predicates.is_valid("text").alias("valid"),
        (predicates.all_in(F.array("lang"), ["en", "de"]) & predicates.all_in(F.array("source"), ["en", "web", "books"])).alias("all_in"), predicates.codev_origin(["source"], F.col("lang")).alias("codev"),
        F.when(verdict.isin("empty", "missing_prefix"), verdict).otherwise("other").alias("nl_verdict"), predicates.licence("text").alias("licence"), predicates.nl_features("text")["starts_template"].alias("starts_template"), predicates.nl_features("text")["mentions_signals"].alias("mentions_signals"),
    )


_BODY = "regexp_replace(regexp_replace(coalesce(sva, ''), '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g')"


@query(rf"""WITH a AS (SELECT id, sva, 'create a SVA assertion that ' || CASE WHEN id % 3 = 0 THEN sva ELSE 'holds for request ' || id END AS nl FROM {ASSERTIONS})
SELECT id, regexp_matches(sva, '(?i)##\s*\[|\[\s*(?:\*|=|-)\s*\d+\s*:\s*(?:\d+|\$)\s*\]|\bs_eventually\b|\bs_until\b|\bs_always\b|\buntil_with\b|\bthroughout\b|\bwithin\b|\bintersect\b|\bfirst_match\b') AS high_level, contains(lower({sql_strip("sva")}), 'assert') AND contains(lower(sva), 'property') AND length({sql_strip("sva")}) BETWEEN 30 AND 4000 AS valid,
CASE WHEN length(nl) NOT BETWEEN 25 AND 400 THEN 'length=' || length(nl) WHEN regexp_matches(nl, '(?i)\|->|\|=>|##\s*\[|##\s*\d|s_eventually|s_until|s_always|\bassert\s+property\b|disable\s+iff|posedge|negedge') THEN 'sva_token_leak' ELSE 'ok' END AS nl_verdict,
regexp_extract(sva, '(?is)(assert\s+property\s*\([^;]*?\)\s*;)', 1) AS first_statement, regexp_replace(sva, '(?i)^([A-Za-z_]\w*\s*:\s*)(assert|assume|cover|property)', '\2') AS without_label, regexp_replace(sva, '^\s*\w+\s*:\s*', '') AS without_any_label,
'4' AS k, trim(sva, ' ') AS line FROM a""")
def assertion_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    a = assertions(spark, sf_dir).withColumn("nl", F.concat(F.lit("create a SVA assertion that "), F.when(i % 3 == 0, F.col("sva")).otherwise(F.concat(F.lit("holds for request "), i.cast("string")))))
    generated = F.concat(F.lit("<think>so\nand so</think>Answer: "), F.col("sva"), F.lit("\nmore"))
    return a.select(
        "id", predicates.high_level_hint("sva").alias("high_level"), predicates.is_valid("sva").alias("valid"), predicates.nl_verdict("nl").alias("nl_verdict"), parse.first_statement("sva").alias("first_statement"),
        parse.without_label("sva").alias("without_label"), parse.without_any_label("sva").alias("without_any_label"), parse.options(F.lit("temp=0.9,k=4"))["k"].alias("k"), parse.one_line(generated).alias("line"),
    )


@query("SELECT page_id, 'm' || page_id AS module, 'own' || page_id || '/name__x' AS repo, ['holds when ' || page_id || ' rises', 'and the other way ' || page_id] AS phrases FROM pages")
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    listed = F.concat(F.lit("Here are 3:\n1. holds when "), i, F.lit(" rises\n- \"and the other way "), i, F.lit('"\n2) short\nversion two is longer\n* a third one that is not asked'))
    module = F.concat(F.lit("// module not_one\nmodule  m"), i, F.lit("(input a); endmodule\nmodule m"), i)
    path = F.concat(F.lit("/snapshots/own"), i, F.lit("__name__x.tar.gz"))
    return table(spark, sf_dir, "pages").select("page_id", parse.module_names(module)[0].alias("module"), predicates.repo_label(path).alias("repo"), parse.paraphrases(listed, 2).alias("phrases"))


_POINTS = "(SELECT event_id, user_id % 50 AS grp, 's' || (event_id % 4) AS signal, CASE WHEN event_id % 2 = 0 THEN 'rising' ELSE 'falling' END AS kind, (event_id % 100)::INT AS cycle, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 3 * 2 - 3)::INT END AS delta FROM events)"


@query(f"""WITH p AS (SELECT *, CASE WHEN delta IS NULL THEN 'missing' WHEN delta > 0 THEN 'delayed' ELSE 'early' END AS violation FROM {_POINTS}),
l AS (SELECT grp, signal, cycle, CASE WHEN violation = 'missing' THEN '  - Signal ''' || signal || ''': expected ' || kind || ' transition at cycle ' || cycle || ', but no matching transition found in actual waveform.'
ELSE '  - Signal ''' || signal || ''': ' || kind || ' transition expected at cycle ' || cycle || ', occurred ' || abs(delta) || ' cycle(s) ' || CASE violation WHEN 'delayed' THEN 'LATE' ELSE 'EARLY' END || ' (actual cycle ' || (cycle + delta) || ').' END AS line FROM p)
SELECT grp, sha256(string_agg(line, chr(10) ORDER BY signal, cycle, line)) AS text FROM l GROUP BY grp""")
def violation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    delta = F.when(i % 3 != 0, (i % 3 * 2 - 3).cast("int"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("grp"), F.concat(F.lit("s"), (i % 4).cast("string")).alias("signal"), F.when(i % 2 == 0, "rising").otherwise("falling").alias("kind"), (i % 100).cast("int").alias("cycle"), delta.alias("delta"))
    rows = rows.withColumn("matched", F.col("cycle") + F.col("delta")).withColumn("violation", F.when(F.col("delta").isNull(), "missing").when(F.col("delta") > 0, "delayed").otherwise("early"))
    return prompts.violation_text(rows, "grp").select("grp", F.sha2("text", 256).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 0.0 ELSE 1.0 END AS syntax, CASE c_custkey % 3 WHEN 1 THEN 1.0 ELSE 0.0 END AS functionality, CASE c_custkey % 3 WHEN 0 THEN 0.0 ELSE 1.0 END AS relaxed, (c_custkey % 2)::INT AS errors FROM customer")
def tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    m = prompts.equivalence_metrics(chosen(["a syntax error, Full equivalence", "Full equivalence", "it implies it"], i))
    errors = F.size(prompts.compile_errors(chosen(["fine\n Error-[no]", "x\nError-[X] bad"], i)))
    return table(spark, sf_dir, "customer").select("c_custkey", m["syntax"].alias("syntax"), m["functionality"].alias("functionality"), m["func_relaxed"].alias("relaxed"), errors.alias("errors"))


@query("SELECT n_name AS name, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 9 = 0 THEN 0 ELSE 1 END, n_nationkey % 7, n_name) AS place FROM nation")
def variants_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run names (a few): base first, then by stage."""
    from pyspark.sql import Window as W

    i = F.col("n_nationkey")
    run = F.concat(F.when(i % 9 == 0, "BASE").otherwise("run"), (i % 7).cast("string"), F.lit("_"), "n_name")
    order = splits.variant_order(F.col("run"))[:2]
    return table(spark, sf_dir, "nation").withColumn("run", run).select(F.col("n_name").alias("name"), F.row_number().over(W.orderBy(*order, "n_name")).cast("long").alias("place"))


# ---- sinks and readers: what is written is read back ----


@query("SELECT o_orderkey AS id, 'en' AS nl, o_orderstatus AS sva FROM orders")
def jsonl_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = stage.path(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("en").alias("nl"), F.col("o_orderstatus").alias("sva")), at)
    rows = readers.jsonl(spark, at, "id long, nl string, sva string")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def shards_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each status; one folder is left out by its name."""
    at = stage.path(spark, "shards")
    sinks.shards(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), at, ["status"])
    return spark.read.schema("o_orderkey long, status string").json(at).where("status <> 'P'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS round FROM customer")
def replaced_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is replaced by a part of itself, then what is missing is added."""
    at, done = stage.path(spark, "replaced"), stage.path(spark, "resumed")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows.write.parquet(at)
    sinks.replaced(spark, spark.read.schema(rows.schema).parquet(at).where("id % 2 = 0"), at)
    first = spark.read.schema(rows.schema).parquet(at)
    sinks.jsonl(first.withColumn("round", F.lit(1)), done)
    sinks.resumed(rows.withColumn("round", F.lit(0)), spark.read.schema("id long, name string, round int").json(done), "id", done)
    return spark.read.schema("id long, name string, round int").json(done)


@query("SELECT DISTINCT lang AS key FROM documents WHERE coalesce(lang, '') <> ''")
def key_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = stage.path(spark, "registry")
    sinks.registry(table(spark, sf_dir, "documents").select(F.col("lang").alias("key")), "key", at)
    return spark.read.schema("key string").parquet(at)


@query("SELECT s_suppkey AS id, s_name AS nl, 'property p' || s_suppkey AS reference_sva FROM supplier")
def csv_tasks_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's CSV with commas, quotes and line breaks in its fields, as unified records."""
    at, i = stage.path(spark, "csv"), F.col("s_suppkey").cast("string")
    names = [x.strip().split()[0] for x in schemas.CSV_TASKS.split(",")]
    own = {"design_name": F.lit("d"), "task_id": i, "prompt": F.col("s_name"), "ref_solution": F.concat(F.lit("lab: property p"), i), "testbench": F.concat(F.lit('module "m",\n'), i)}
    table(spark, sf_dir, "supplier").select(*(own.get(n, F.lit(None).cast("string")).alias(n) for n in names)).write.option("header", True).option("escape", '"').csv(at)
    rows = readers.nl2sva(spark, at, "bench", "test")
    return rows.select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("id"), "nl", "reference_sva")


# ---- providers and streams ----


@query(f"""WITH a AS (SELECT id, sva, min(id) OVER (PARTITION BY customer) AS first FROM {ASSERTIONS}), p AS (SELECT a.id, a.sva, b.sva AS ref FROM a JOIN {ASSERTIONS} b ON b.id = a.first)
SELECT id, CASE WHEN sva = ref THEN 'EQUIVALENT' ELSE 'UNSUPPORTED' END AS verdict FROM p""")
def written_back_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assertion's verdict against its customer's first one, by a cache of equal pairs."""
    a = assertions(spark, sf_dir)
    ref = a.groupBy("customer").agg(F.min_by("sva", "id").alias("ref"))
    rows = a.join(ref, "customer").select("id", "sva", "ref")
    pair = keys.cache_key(F.concat(keys.text("sva"), F.lit("|||"), keys.text("ref")), F.lit(""))
    cache = rows.where("sva = ref").select(pair.alias("key"), F.lit("EQUIVALENT").alias("verdict")).distinct()
    return provider.written_back(rows, pair, cache).select("id", "verdict")


@query("""WITH e AS (SELECT user_id % 20 AS run, event_id AS step, value AS score FROM events), b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
coalesce(score > max(score) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM e), g AS (SELECT *, sum(up::INT) OVER (PARTITION BY run ORDER BY step) AS k FROM b)
SELECT run::VARCHAR AS run, step, best, (row_number() OVER (PARTITION BY run, k ORDER BY step) - 1)::INT AS streak, row_number() OVER (PARTITION BY run, k ORDER BY step) - 1 >= 3 AS stop FROM g""")
def stream_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations as a stream; the best and the streak without improvement are state."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select((F.col("user_id") % 20).cast("string").alias("run"), F.col("event_id").cast("long").alias("step"), F.col("value").cast("double").alias("score"))
    out = stage.path(spark, "stop")
    incremental.appended(incremental.early_stop(stream, 3), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(incremental.STOP_OUT).parquet(f"{out}/rows").select("run", "step", "best", "streak", "stop")


@query(f"SELECT doc_id, {sql_squeezed('text')} = '' AS blank FROM documents")
def stream_each_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files are processed once each, by a function of a batch."""
    docs, out = table(spark, sf_dir, "documents"), stage.path(spark, "once")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    save = lambda rows, batch: rows.select("doc_id", (keys.squeezed("text") == "").alias("blank")).write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
    incremental.each_once(stream, f"{out}/state", save).awaitTermination()
    return spark.read.schema("doc_id long, blank boolean").parquet(f"{out}/rows").select("doc_id", "blank")
