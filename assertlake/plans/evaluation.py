"""Queries of text analysis, evaluation, rewards, traces and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake.functions import classify, parse, predicates, rewards
from assertlake.operators import curate, evaluate, splits
from assertlake.plans.tables import ASSERTIONS, CANDIDATES, assertions, candidates, sql_squeezed, sql_strip, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_LEVEL = classify.sql_level("sva")
_BARE = r"regexp_replace(regexp_replace(coalesce(sva, ''), '//[^\n]*', ' ', 'g'), '(?s)/\*.*?\*/', ' ', 'g')"


@query(rf"""SELECT id, {_LEVEL} AS level, CASE {_LEVEL} WHEN 1 THEN 1 WHEN 5 THEN 3 ELSE 2 END AS class,
CASE WHEN regexp_matches(lower(sva), 's_eventually|s_until|s_always|nexttime') THEN 5 WHEN contains(sva, '|->') OR contains(sva, '|=>') THEN 4 WHEN contains(sva, '##[') THEN 3 WHEN regexp_matches(sva, '##\s*\d+') THEN 2 ELSE 1 END AS level_merge,
CASE WHEN regexp_matches(sva, '\b(?:s_eventually|s_until|s_always|until_with|nexttime)\b') THEN 5 WHEN contains(sva, '|->') OR contains(sva, '|=>') THEN 4 WHEN regexp_matches(sva, '##\s*\[') THEN 3 WHEN regexp_matches(sva, '\b(?:throughout|within|intersect)\b|##|\[\*') THEN 2 ELSE 1 END AS level_fallback
FROM {ASSERTIONS}""")
def classify_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = classify.level("sva")
    return assertions(spark, sf_dir).select("id", level.alias("level"), classify.three_classes(level).alias("class"), classify.level_merge("sva").alias("level_merge"), classify.level_fallback("sva").alias("level_fallback"))


@query(f"""WITH r AS (SELECT (id % 13 % 5 + 1)::INT AS gold, {_LEVEL} AS predicted FROM {ASSERTIONS}), c AS (SELECT gold, predicted, count(*) AS n FROM r GROUP BY ALL)
SELECT gold, predicted, n, sum(n) OVER (PARTITION BY gold)::BIGINT AS gold_n, sum(CASE WHEN gold = predicted THEN n ELSE 0 END) OVER (PARTITION BY gold)::DOUBLE / sum(n) OVER (PARTITION BY gold) AS accuracy FROM c""")
def classify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assertions(spark, sf_dir).select((F.col("id") % 13 % 5 + 1).cast("int").alias("gold"), classify.level("sva").alias("predicted"))
    return evaluate.classifier_report(rows, "gold", "predicted")


@query(rf"""SELECT id, CASE WHEN regexp_matches(sva, '(?i)\bcover\b') THEN 'cover' WHEN regexp_matches(sva, '(?i)\bassume\b') THEN 'assume' ELSE 'assert' END AS bound,
coalesce(nullif(regexp_extract({_BARE}, '(?i)@\s*\(\s*((?:posedge|negedge)\s+\w+)\s*\)', 1), ''), '') AS clock, regexp_extract({_BARE}, '(?i)disable\s+iff\s*\(([^)]+)\)', 1) AS disable_iff,
array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches({_BARE}, '{p}') THEN '{n}' END" for p, n in parse.OPERATORS)}], lambda x: x IS NOT NULL), ',') AS operators FROM {ASSERTIONS}""")
def parse_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = assertions(spark, sf_dir).select("id", parse.parsed("sva").alias("p"))
    return p.select("id", "p.bound", F.coalesce("p.clock_expr", F.lit("")).alias("clock"), F.coalesce("p.disable_iff", F.lit("")).alias("disable_iff"), F.array_join("p.temporal_operators", ",").alias("operators"))


_SIDES = lambda op: rf"(contains({_BARE}, '{op}') AND (trim(string_split({_BARE}, '{op}')[1]) = '' OR trim(string_split({_BARE}, '{op}')[2]) = ''))"


@query(rf"""SELECT id, regexp_matches({_BARE}, '(?i)\b(?:assert|cover|assume)\s+property\b|\bproperty\b') AND regexp_matches({_BARE}, '(?m);\s*$') AND length(regexp_replace({_BARE}, '[^(]', '', 'g')) = length(regexp_replace({_BARE}, '[^)]', '', 'g')) AND NOT {_SIDES("|->")} AND NOT {_SIDES("|=>")} AS ok,
(NOT regexp_matches({_BARE}, '(?i)\b(?:assert|cover|assume)\s+property\b|\bproperty\b'))::INT + (NOT regexp_matches({_BARE}, '(?m);\s*$'))::INT + (length(regexp_replace({_BARE}, '[^(]', '', 'g')) <> length(regexp_replace({_BARE}, '[^)]', '', 'g')))::INT + {_SIDES("|->")}::INT + {_SIDES("|=>")}::INT AS n_issues FROM {ASSERTIONS}""")
def syntax_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted parentheses stand for balance in the SQL: these assertions never close before they open."""
    s = assertions(spark, sf_dir).select("id", parse.syntax("sva").alias("s"))
    return s.select("id", "s.ok", F.size("s.issues").alias("n_issues"))


@query(rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>hm; assert property (x);</think>' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'Sure.' || chr(10) || '```systemverilog' || chr(10) || 'a: assert property (p' || turn || ');' || chr(10) || '```' ELSE text END AS x FROM conversations),
s AS (SELECT conv_id, turn, {sql_strip("regexp_replace(" + sql_strip("x") + ", '(?s)<think>.*?</think>', '', 'g')")} AS x FROM t),
f AS (SELECT conv_id, turn, CASE WHEN regexp_matches(x, '(?s)```(?:systemverilog|sv|verilog)?\s*(.+?)```') THEN {sql_strip("regexp_extract(x, '(?s)```(?:systemverilog|sv|verilog)?\\s*(.+?)```', 1)")} ELSE x END AS x FROM s)
SELECT conv_id, turn, CASE WHEN regexp_matches(x, '(?is)(assert\s+property\s*\(.*?\)\s*;)') THEN regexp_extract(x, '(?is)(assert\s+property\s*\(.*?\)\s*;)', 1) ELSE {sql_strip("regexp_extract(x, '^([^\\n\\r]*)', 1)")} END AS sva FROM f""")
def extract_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("Sure.\n```systemverilog\na: assert property (p"), F.col("turn").cast("string"), F.lit(");\n```"))
    x = F.concat(F.when(F.col("turn") % 3 == 0, "<think>hm; assert property (x);</think>").otherwise(""), F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parse.extracted_sva(x).alias("sva"))


@query(r"""WITH m AS (SELECT id, sva FROM """ + ASSERTIONS + rf""")
SELECT id, 'check ' || id AS nl, 'module m; endmodule' AS rtl_context, sva AS reference_sva, substr(sha256(lower({sql_squeezed("sva")})), 1, 16) AS hash, 'why' AS reasoning FROM m WHERE id % 3 <> 0""")
def chat_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("Here is the testbench to use:\nmodule m; endmodule\n\nQuestion: check "), F.col("id").cast("string"), F.lit(" You should use"))
    answer = F.when(F.col("id") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("<think> why </think>\n```systemverilog\n"), F.col("sva"), F.lit("\n```")))
    rows = assertions(spark, sf_dir).select("id", parse.chat_record(user, answer).alias("r")).where("r is not null")
    return rows.select("id", "r.nl", "r.rtl_context", "r.reference_sva", "r.hash", "r.reasoning")


@query(f"SELECT doc_id, length({sql_strip('text')}) >= 10 AS merge, length({sql_strip('text')}) >= 8 AS usable, length({sql_strip('text')}) >= 15 AND NOT regexp_matches(lower({sql_strip('text')}), '^(?://|/\\*|--|#|todo|fixme)') AS industrial, length({sql_strip('text')}) < 5 AS needs FROM documents")
def real_nl_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = predicates.real_nl
    return table(spark, sf_dir, "documents").select("doc_id", real("text", "merge").alias("merge"), real("text", "usable").alias("usable"), real("text", "industrial").alias("industrial"), predicates.needs_nl("text").alias("needs"))


@query(r"""SELECT id, contains(lower(sva), 'disable iff') AS has_disable_iff, contains(sva, '|->') AS has_rarrow, contains(sva, '|=>') AS has_drarrow, contains(sva, '$rose') AS has_rose, regexp_matches(sva, '##\d') AS has_seq_delay, contains(sva, 'eventually') AS has_eventually, regexp_matches(sva, 'assert\s+property') AS has_assert_property, length(sva) AS sva_len FROM """ + ASSERTIONS)
def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = assertions(spark, sf_dir).select("id", predicates.features("sva").alias("f"))
    return f.select("id", *(f"f.{c}" for c in ("has_disable_iff", "has_rarrow", "has_drarrow", "has_rose", "has_seq_delay", "has_eventually", "has_assert_property", "sva_len")))


@query(r"""WITH w AS (SELECT id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(sva, '\d+''[bdho][0-9a-fA-FxXzZ_]+|\d+', ' ', 'g'), '\.[A-Za-z_]\w*', '', 'g'), '[A-Za-z_]\w*'), lambda t: NOT list_contains([""" + ", ".join(f"'{w}'" for w in parse.SIGNAL_KEYWORDS) + "], lower(t))) AS l FROM " + ASSERTIONS + ") SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS raw FROM w")
def signal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertions(spark, sf_dir).select("id", F.array_join(parse.signals("sva"), " ").alias("raw"))


@query("""WITH m AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, low, high, mean, median FROM (SELECT lang, min(n_chars) AS low, max(n_chars) AS high, (sum(n_chars) // count(*))::BIGINT AS mean FROM documents GROUP BY lang) JOIN (SELECT lang, n_chars AS median FROM m WHERE i = n // 2 + 1) USING (lang)""")
def text_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return d.groupBy("lang").agg(*evaluate.spread("n_chars")).join(evaluate.upper_median(d, ["lang"], "n_chars"), "lang")


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long, count(*) FILTER (contains(text, '|')) AS tabular FROM documents GROUP BY source, lang")
def source_by_lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.count_if(F.col("text").contains("|")).alias("tabular"))


_TASKS = f"(SELECT task, tcl, count(*) AS n, count(*) FILTER (verdict = 'EQUIVALENT') AS strict, count(*) FILTER (verdict IN ('EQUIVALENT', 'IMPLIES_REF_TO_LM', 'IMPLIES_LM_TO_REF')) AS relaxed, task % 7 <> 0 AS evaluable FROM {CANDIDATES} GROUP BY task, tcl)"
_PASS = lambda c: f"(CASE WHEN {c} <= 0 THEN 0.0 WHEN k >= n OR n - {c} < k THEN 1.0 ELSE 1.0 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, k), lambda i: (n - {c} - i)::DOUBLE / (n - i))), lambda a, x: a * x) END)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("verdict").isin("EQUIVALENT", "IMPLIES_REF_TO_LM", "IMPLIES_LM_TO_REF")
    rows = candidates(spark, sf_dir).groupBy("task", "tcl").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "EQUIVALENT").alias("strict"), F.count_if(good).alias("relaxed"))
    return rows.withColumn("evaluable", F.col("task") % 7 != 0)


@query(f"""WITH t AS (SELECT *, unnest([1, 2, 5]) AS k FROM {_TASKS}), s AS (SELECT tcl, k, evaluable::INT AS e, CASE WHEN evaluable THEN {_PASS("strict")} ELSE 0.0 END AS s, CASE WHEN evaluable THEN {_PASS("relaxed")} ELSE 0.0 END AS r FROM t)
SELECT tcl, k, sum(e)::BIGINT AS tasks, round(100 * sum(s) / greatest(sum(e), 1), 2) AS func, round(100 * sum(r) / greatest(sum(e), 1), 2) AS relaxed FROM s GROUP BY GROUPING SETS ((k), (tcl, k))""")
def passk_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.func_at_k(_tasks(spark, sf_dir), [1, 2, 5])


@query("SELECT c_nationkey AS nation, sum(o_totalprice::DOUBLE * (o_orderkey % 3)) / greatest(sum(o_orderkey % 3), 1) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def weighted_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("nation")).agg(evaluate.weighted_mean(F.col("o_totalprice").cast("double"), F.col("o_orderkey") % 3).alias("mean"))


@query(f"SELECT zone, count(*) AS n, sum(strict)::BIGINT AS strict FROM (SELECT strict, CASE WHEN strict = 0 THEN 'too_hard' WHEN strict >= n THEN 'too_easy' ELSE 'viable' END AS zone FROM {_TASKS}) GROUP BY zone")
def golden_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = splits.golden_zone(F.col("strict"), F.col("n"))
    return _tasks(spark, sf_dir).groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.sum("strict").alias("strict"))


@query(f"SELECT s.strict, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 8))::INT AS strict) s LEFT JOIN (SELECT strict, count(*) AS n FROM {_TASKS} GROUP BY strict) t ON t.strict = s.strict")
def success_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(_tasks(spark, sf_dir), "strict", 7)


@query(f"SELECT bin, count(*) AS n FROM (SELECT least(11, 1 + floor(strict / n * 11))::BIGINT AS bin FROM {_TASKS}) GROUP BY bin")
def solved_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).groupBy(evaluate.unit_bins(F.col("strict") / F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_REWARD = "CASE verdict WHEN 'EQUIVALENT' THEN 1.0 WHEN 'IMPLIES_REF_TO_LM' THEN 0.6 WHEN 'IMPLIES_LM_TO_REF' THEN 0.4 WHEN 'UNSUPPORTED' THEN 0.15 ELSE 0.0 END"


@query(f"""WITH r AS (SELECT task, cand, ({_REWARD})::DOUBLE AS r FROM {CANDIDATES}), s AS (SELECT *, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY task))
SELECT task, cand, round(r, 6) AS reward, round(CASE WHEN n = 1 THEN 0.0 ELSE (r - m) / (s + 1e-8) END, 4) + 0.0 AS advantage, n < 2 OR s < 1e-6 AS collapsed FROM s WHERE s = 0 OR s > 1e-6""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = candidates(spark, sf_dir).select("task", "cand", rewards.equivalence(F.col("verdict"), F.lit(True), F.lit(True)).alias("reward"))
    out = evaluate.advantages(r, "task", "reward")
    return out.select("task", "cand", F.round("reward", 6).alias("reward"), (F.round("advantage", 4) + 0.0).alias("advantage"), "collapsed")


@query(f"""SELECT verdict, count(*) AS n, round(sum({_REWARD})::DOUBLE, 4) AS graded, round(sum(CASE verdict WHEN 'EQUIVALENT' THEN 1.0 WHEN 'IMPLIES_REF_TO_LM' THEN 0.5 WHEN 'IMPLIES_LM_TO_REF' THEN 0.5 WHEN 'NOT_EQUIVALENT' THEN 0.2 ELSE 0.15 + 0.5 * (1.0 - abs(cand - 2.0) / greatest(cand, 2)) END)::DOUBLE, 4) AS tiered,
round(sum(CASE verdict WHEN 'EQUIVALENT' THEN 1.0 WHEN 'IMPLIES_REF_TO_LM' THEN 0.6 WHEN 'IMPLIES_LM_TO_REF' THEN 0.4 ELSE 0.0 END)::DOUBLE, 4) AS weight FROM {CANDIDATES} GROUP BY verdict""")
def verdict_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, yes = F.col("verdict"), F.lit(True)
    agreement = rewards.agreement(F.lit(100), F.col("cand"), F.lit(2))
    graded, tiered, weight = rewards.equivalence(v, yes, yes), rewards.tiered(v, yes, yes, yes, agreement), rewards.rollout_weight(v, False)
    total = lambda c: F.round(F.sum(c), 4)
    return candidates(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), total(graded).alias("graded"), total(tiered).alias("tiered"), total(weight).alias("weight"))


@query(f"WITH s AS (SELECT verdict AS a, CASE WHEN cand % 3 = 0 THEN 'EQUIVALENT' ELSE verdict END AS b FROM {CANDIDATES}) SELECT v AS verdict, count(*) FILTER (k = 1) AS n_before, count(*) FILTER (k = 2) AS n_after FROM (SELECT a AS v, 1 AS k FROM s UNION ALL SELECT b, 2 FROM s) GROUP BY v")
def verdict_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("after", F.when(F.col("cand") % 3 == 0, "EQUIVALENT").otherwise(F.col("verdict")))
    return evaluate.shift(c, "verdict", "after")


_STATUS = ["PASS", "FAIL", "TIMEOUT", "PARSE_ERROR"]


@query("""WITH s AS (SELECT (['PASS', 'FAIL', 'TIMEOUT', 'PARSE_ERROR'])[1 + l_partkey % 4] AS f, (['PASS', 'FAIL', 'TIMEOUT', 'PARSE_ERROR'])[1 + l_suppkey % 4] AS b FROM lineitem)
SELECT f, b, CASE WHEN f = 'PASS' AND b = 'PASS' THEN 'EQUIVALENT' WHEN f = 'PASS' AND b = 'FAIL' THEN 'IMPLIES_REF_TO_LM' WHEN f = 'FAIL' AND b = 'PASS' THEN 'IMPLIES_LM_TO_REF' WHEN f = 'FAIL' AND b = 'FAIL' THEN 'NOT_EQUIVALENT' ELSE 'UNSUPPORTED' END AS verdict,
CASE WHEN f IN ('PASS', 'FAIL') AND b IN ('PASS', 'FAIL') THEN '' WHEN 'PARSE_ERROR' IN (f, b) THEN 'PARSE_ERROR' ELSE 'TIMEOUT' END AS internal_status, count(*) AS n FROM s GROUP BY f, b""")
def verdict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.element_at(F.array(*map(F.lit, _STATUS)), (F.col(c) % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(pick("l_partkey").alias("f"), pick("l_suppkey").alias("b")).groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("f", "b", rewards.verdict(F.col("f"), F.col("b")).alias("v"), "n").select("f", "b", "v.verdict", "v.internal_status", "n")


@query(f"SELECT task, arg_max(verdict, CASE verdict WHEN 'EQUIVALENT' THEN 4 WHEN 'IMPLIES_REF_TO_LM' THEN 3 WHEN 'IMPLIES_LM_TO_REF' THEN 2 WHEN 'NOT_EQUIVALENT' THEN 1 WHEN 'UNSUPPORTED' THEN 0 ELSE -1 END) AS verdict FROM {CANDIDATES} GROUP BY task")
def multiref_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.best_of(candidates(spark, sf_dir), ["task"], "verdict", rewards.VERDICT_RANK)


@query(f"""WITH r AS (SELECT task, cand, CASE WHEN verdict = 'EQUIVALENT' THEN 1 WHEN verdict IN ('NOT_EQUIVALENT', 'TIMEOUT') THEN 0 END AS s FROM {CANDIDATES}), k AS (SELECT * FROM r WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, s ORDER BY cand) <= 2)
SELECT a.task, a.cand AS chosen, b.cand AS rejected FROM k a JOIN k b ON a.task = b.task AND a.s = 1 AND b.s = 0""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    return curate.preference_pairs(candidates(spark, sf_dir), "task", "cand", v == "EQUIVALENT", v.isin("NOT_EQUIVALENT", "TIMEOUT"))


_TRACE = "(SELECT user_id AS trace, CASE WHEN value > 50 THEN 1 ELSE 0 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cycle FROM events)"
_EDGES = f"(SELECT trace, cycle, CASE WHEN b = 0 THEN 'rising' WHEN v = 0 THEN 'falling' ELSE 'change' END AS kind FROM (SELECT *, lag(v) OVER (PARTITION BY trace ORDER BY cycle) AS b FROM {_TRACE}) WHERE b <> v)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    cycle = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.when(F.col("value") > 50, 1).otherwise(0).alias("v"), cycle.alias("cycle"))
    return evaluate.transitions(rows, ["trace"], "cycle", "v")


@query(f"SELECT trace, cycle, kind FROM {_EDGES}")
def edge_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"""WITH w AS (SELECT trace, cycle, kind FROM {_EDGES}), f AS (SELECT DISTINCT trace, cycle + (trace % 5) - 2 AS at, kind FROM {_EDGES} WHERE cycle % 3 <> 0),
m AS (SELECT w.trace, w.cycle, w.kind, arg_min(f.at, struct_pack(d := abs(f.at - w.cycle), a := f.at)) AS matched FROM w JOIN f ON f.trace = w.trace AND f.kind = w.kind AND abs(f.at - w.cycle) <= 10 GROUP BY ALL)
SELECT w.trace, w.cycle, w.kind, matched, CASE WHEN matched IS NULL THEN 'missing' WHEN matched > w.cycle THEN 'delayed' ELSE 'early' END AS violation, matched - w.cycle AS delta FROM w LEFT JOIN m USING (trace, cycle, kind) WHERE matched IS DISTINCT FROM w.cycle""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal constraints: expected edges against observed ones; perfect matches drop out, and a match may serve several."""
    e = _edges(spark, sf_dir)
    found = e.where("cycle % 3 <> 0").select("trace", (F.col("cycle") + F.col("trace") % 5 - 2).alias("cycle"), "kind")
    out = curate.closest(e, found, ["trace", "kind"], "cycle")
    delta = F.col("matched") - F.col("cycle")
    violation = F.when(F.col("matched").isNull(), "missing").when(delta > 0, "delayed").otherwise("early")
    return out.where(~F.col("matched").eqNullSafe(F.col("cycle"))).select("trace", "cycle", "kind", "matched", violation.alias("violation"), delta.alias("delta"))


@query(f"""WITH e AS (SELECT DISTINCT trace, kind, cycle % 7 AS c FROM {_EDGES} WHERE cycle % 2 = 0), f AS (SELECT DISTINCT trace, kind, cycle % 7 AS c FROM {_EDGES} WHERE cycle % 3 = 0), j AS (SELECT coalesce(e.trace, f.trace) AS trace, e.trace IS NOT NULL AS x, f.trace IS NOT NULL AS y FROM e FULL JOIN f ON e.trace = f.trace AND e.kind = f.kind AND e.c = f.c),
g AS (SELECT trace, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT x AND y) AS fp, count(*) FILTER (x AND NOT y) AS fn FROM j GROUP BY trace)
SELECT coalesce(sum(tp) / nullif(sum(tp + fp), 0), 1.0) AS precision, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 1.0) AS recall, count(*) FILTER (fp = 0 AND fn = 0) AS perfect FROM g""")
def constraint_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).withColumn("c", F.col("cycle") % 7)
    return evaluate.precision_recall(curate.compared_sets(e.where("cycle % 2 = 0"), e.where("cycle % 3 = 0"), ["trace", "kind", "c"], "trace"))


@query("""WITH r AS (SELECT user_id AS run, event_id AS step, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events), i AS (SELECT *, best IS NULL OR value > best AS improved FROM r), n AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY step) AS g FROM i)
SELECT run, step, best, improved, (row_number() OVER (PARTITION BY run, g ORDER BY step) - 1)::INT AS bad_streak FROM n""")
def best_so_far_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")
    return evaluate.best_so_far(e, "run", "step", "value").drop("value")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, max(o) OVER (PARTITION BY source ORDER BY doc_id) AS m FROM (SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) > 20000)::INT AS o FROM documents)) WHERE m = 0")
def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.running_cap(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20000).select("source", "doc_id")


@query("""SELECT e.event_id, e.user_id, (SELECT arg_max(m.event_id, m.event_id) FROM events m WHERE m.user_id = e.user_id AND m.event_id <= e.event_id AND m.event_type = (SELECT min(event_type) FROM events)) AS last_mark FROM events e""")
def asof_last_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = e.agg(F.min("event_type").alias("k"))
    marks = e.join(F.broadcast(kind), F.col("event_type") == F.col("k"), "left_semi").select("user_id", "event_id", F.col("event_id").alias("last_mark"))
    return curate.last_before(e.select("event_id", "user_id"), marks, "user_id", "event_id", "last_mark")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS name, o_orderkey % 40 AS lo, o_orderkey % 40 + 10 AS hi FROM orders), p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 500 AS k, l_partkey % 60 AS pos FROM lineitem)
SELECT p.id, p.k, p.pos, m.name FROM p LEFT JOIN (SELECT id, arg_min(name, struct_pack(l := lo, n := name)) AS name FROM p JOIN s USING (k) WHERE pos BETWEEN lo AND hi GROUP BY id) m USING (id)""")
def range_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 40).alias("lo"), (F.col("o_orderkey") % 40 + 10).alias("hi"))
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 500).cast("long").alias("k"), (F.col("l_partkey") % 60).alias("pos"))
    return curate.enclosing(p, o, "k", "pos", "lo", "hi", "name")


@query(f"""WITH t AS (SELECT id, unnest(regexp_extract_all({sql_squeezed("sva")}, '[A-Za-z_]\\w*|##\\[[^\\]]*\\]|##\\d+|\\|->|\\|=>|[()\\[\\];,.]|\\S')) AS tok FROM {ASSERTIONS})
SELECT id, count(*) AS n, sum(CASE WHEN {" OR ".join(f"contains(tok, '{op}')" for op in evaluate.TEMPORAL)} THEN 3.0 ELSE 1.0 END)::DOUBLE AS weight FROM t GROUP BY id""")
def temporal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = assertions(spark, sf_dir).select("id", F.explode(parse.tokens("sva")).alias("tok"))
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(evaluate.temporal_weight(F.col("tok"))).alias("weight"))


_LOSS = "SELECT l_orderkey AS seq, l_linenumber AS pos, [l_quantity::DOUBLE / 10, l_linenumber::DOUBLE, (l_partkey % 7)::DOUBLE] AS z, CASE WHEN l_linenumber % 4 = 0 THEN -100 ELSE l_partkey % 3 END AS y, CASE WHEN l_suppkey % 2 = 0 THEN 3.0 ELSE 1.0 END AS w FROM lineitem"


@query(f"""WITH r AS ({_LOSS}), c AS (SELECT seq, y, w, -ln(exp(z[1 + greatest(0, least(y, 2))] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) + 1e-12) AS ce FROM r)
SELECT seq, round(coalesce(sum(CASE WHEN y <> -100 THEN w * ce END) / nullif(count(*) FILTER (y <> -100), 0), 0), 6) AS loss, round(coalesce(sum(CASE WHEN y <> -100 THEN w * ce END) / nullif(sum(CASE WHEN y <> -100 THEN w END), 0), 0), 6) AS loss_v1 FROM c GROUP BY seq""")
def tt_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    z = F.array(F.col("l_quantity").cast("double") / 10, F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 7).cast("double"))
    y = F.when(F.col("l_linenumber") % 4 == 0, -100).otherwise((F.col("l_partkey") % 3).cast("int"))
    rows = l.select(F.col("l_orderkey").alias("seq"), y.alias("y"), F.when(F.col("l_suppkey") % 2 == 0, 3.0).otherwise(1.0).alias("w"), evaluate.cross_entropy(z, y).alias("ce"))
    loss = lambda v1: F.round(evaluate.weighted_loss(F.col("ce"), F.col("w"), F.col("y"), v1), 6)
    return rows.groupBy("seq").agg(loss(False).alias("loss"), loss(True).alias("loss_v1"))


_TOKENS = r"regexp_extract_all({x}, '[A-Za-z_]\w*|##\[[^\]]*\]|##\d+|\|->|\|=>|[()\[\];,.]|\S')"


@query(f"""WITH a AS (SELECT id, sva, arg_min(sva, id) OVER (PARTITION BY customer) AS ref FROM {ASSERTIONS}), p AS (SELECT DISTINCT sva, ref FROM a),
t AS (SELECT sva, ref, {_TOKENS.format(x=sql_squeezed("sva"))} AS x, {_TOKENS.format(x=sql_squeezed("ref"))} AS y FROM p),
k AS (SELECT *, list_distinct(list_concat(x, y)) AS known FROM t),
c AS (SELECT sva, ref, array_to_string(list_transform(x, lambda t: chr(32 + list_position(known, t)::INT)), '') AS x, array_to_string(list_transform(y, lambda t: chr(32 + list_position(known, t)::INT)), '') AS y FROM k)
SELECT id, round(CASE WHEN x = '' OR y = '' THEN 0.0 ELSE 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS similarity FROM a JOIN c USING (sva, ref)""")
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assertion against the one of its customer with the smallest id."""
    a = assertions(spark, sf_dir)
    ref = a.groupBy("customer").agg(F.min_by("sva", "id").alias("ref"))
    rows = a.join(ref, "customer").select("id", "sva", "ref")
    # each different pair of texts is compared once
    scores = rows.select("sva", "ref").distinct().withColumn("similarity", F.round(parse.token_similarity("sva", "ref"), 6))
    return rows.join(scores, ["sva", "ref"]).select("id", "similarity")


@query(f"""WITH d AS (SELECT doc_id, lang, {sql_strip("text")} AS x FROM documents)
SELECT doc_id, sha256(CASE WHEN x = '' THEN '' ELSE 'Here is the testbench to perform your translation:' || chr(10) || CASE WHEN length(x) > 4500 THEN substr(x, 1, 4500) || chr(10) || '  // ... [truncated]' ELSE x END || chr(10) || chr(10) END || 'Question: Create a SVA assertion that checks: ' || lang || chr(10) || chr(10) || 'Answer:') AS prompt_key FROM d""")
def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertlake.functions.prompts import user_prompt

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(user_prompt("lang", "text", "Answer:"), 256).alias("prompt_key"))


@query(f"""WITH p AS (SELECT id, sva, CASE WHEN id % 3 = 0 THEN '[ASSERT] x' WHEN id % 3 = 1 THEN ' ' ELSE 'real text' END AS nl, (id % 5)::INT AS tcl FROM {ASSERTIONS})
SELECT id, 'Generate an SVA assertion for:' || chr(10) || CASE WHEN id % 3 < 2 THEN 'Write an SVA for module m (TCL level ' || tcl || ')' ELSE nl END AS content, 1 AS n_refs, 2 AS tier FROM p""")
def training_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertlake.functions.prompts import training_rows

    i = F.col("id")
    nl = F.when(i % 3 == 0, "[ASSERT] x").when(i % 3 == 1, " ").otherwise("real text")
    pool = assertions(spark, sf_dir).select(F.col("id").cast("string").alias("rtl_context"), F.col("sva").alias("reference_sva"), nl.alias("nl"), (i % 5).cast("int").alias("expected_tcl"), F.lit("m").alias("module_name"))
    rows = training_rows(pool, "system")
    return rows.select(F.col("rtl_context").cast("long").alias("id"), F.col("prompt")[1]["content"].alias("content"), F.size("ref_svas").alias("n_refs"), "tier")


@query(f"""WITH a AS (SELECT task, bool_or(verdict = 'EQUIVALENT') AS f FROM {CANDIDATES} WHERE cand <= 3 GROUP BY task), b AS (SELECT task, bool_or(verdict = 'EQUIVALENT') AS f FROM {CANDIDATES} WHERE cand > 3 GROUP BY task)
SELECT count(*) FILTER (a.f AND b.f) AS both, count(*) FILTER (a.f AND NOT b.f) AS only_left, count(*) FILTER (NOT a.f AND b.f) AS only_right, count(*) FILTER (NOT a.f AND NOT b.f) AS neither FROM a JOIN b USING (task)""")
def solved_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    any_ = lambda rows: rows.groupBy("task").agg(F.bool_or(F.col("verdict") == "EQUIVALENT").alias("f"))
    return evaluate.contingency(any_(c.where("cand <= 3")), any_(c.where("cand > 3")), "task", "f")


@query(f"SELECT CASE tcl WHEN 1 THEN 'C1' WHEN 5 THEN 'C3' ELSE 'C2' END AS class, sum(n)::BIGINT AS n, sum(strict)::BIGINT AS strict FROM {_TASKS} GROUP BY 1")
def class_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roll_up(_tasks(spark, sf_dir), "tcl", ["n", "strict"])


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def required_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return curate.required(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), look, "o_custkey", ["c_name", "c_nationkey"])


@query("SELECT d.doc_id, coalesce(l.quality = 1, true) AS evaluable FROM documents d LEFT JOIN labels l USING (doc_id)")
def evaluable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "EQUIVALENT").otherwise("NOT_EQUIVALENT").alias("verdict"))
    return evaluate.evaluable(table(spark, sf_dir, "documents").select("doc_id"), known, "doc_id", True)


@query(f"""WITH r AS (SELECT CASE cand % 3 WHEN 0 THEN 'golden' WHEN 1 THEN 'swap' ELSE 'flip' END AS kind, ({_REWARD})::DOUBLE AS r FROM {CANDIDATES}), m AS (SELECT kind, avg(r) AS mean FROM r GROUP BY kind)
SELECT kind, round(mean, 9) AS mean, round((SELECT mean FROM m WHERE kind = 'golden') - mean, 9) AS delta FROM m""")
def mutation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("cand") % 3 == 0, "golden").when(F.col("cand") % 3 == 1, "swap").otherwise("flip")
    rows = candidates(spark, sf_dir).select(kind.alias("kind"), rewards.equivalence(F.col("verdict"), F.lit(True), F.lit(True)).alias("reward"))
    return evaluate.mutation_deltas(rows, "kind", "reward").select("kind", F.round("mean", 9).alias("mean"), F.round("delta", 9).alias("delta"))
