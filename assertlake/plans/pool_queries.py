"""Queries over training pools: variants at other levels, one name for resets, reports of levels, sides by provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake.functions import classify, prompts, resets, variants
from assertlake.operators import bundles, evaluate, splits
from assertlake.plans.tables import ASSERTIONS, assertions, chosen, sql_list, table
from assertlake.sources import benchmarks, sinks, stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Implications and others; {m} becomes the order's key modulo 5.
SEEDS = [
    "assert property (@(posedge clk) req |-> ##2 gnt{m});",
    "assert property (@(posedge clk)  a{m} |=>  b  && c)",
    "assert property (@(posedge clk) a |-> s_eventually b{m});",
    "assert property (@(posedge clk) x{m} |-> y |-> ##12 z);;",
    "assert property (@(posedge clk) a{m} == 1);",
]
WORDS = ["The grant comes in the next cycle after {m}.", "b holds within 3 cycles, and always after 2 cycles", "Eventually b is high..", "short", "z follows x until done {m}"]


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    m = lambda c: F.replace(c, F.lit("{m}"), (F.col("o_orderkey") % 5).cast("string"))
    return o.select(F.col("o_orderkey").alias("key"), m(chosen(SEEDS, F.col("o_orderkey"))).alias("reference_sva"), m(chosen(WORDS, F.col("o_custkey"))).alias("nl"))


SEEDS_SQL = f"(SELECT o_orderkey AS key, replace(({sql_list(SEEDS)})[1 + o_orderkey % {len(SEEDS)}], '{{m}}', (o_orderkey % 5)::VARCHAR) AS sva, replace(({sql_list(WORDS)})[1 + o_custkey % {len(WORDS)}], '{{m}}', (o_orderkey % 5)::VARCHAR) AS nl FROM orders)"


def _sql_form(form: str) -> str:
    out = "'" + form + "'"
    for name in "lrbo":
        out = out.replace(f"{{{name}}}", f"' || {name} || '")
    return out + " || fin"


def _sql_worded(target: int, phrase: str) -> str:
    patterns = variants.DELAYS if target == 3 else variants.LIVENESS
    end = f" The consequent should hold {phrase}." if target == 3 else f" {phrase[0].upper() + phrase[1:]}."
    cases = " ".join(f"WHEN regexp_matches(d, '(?i){p}') THEN regexp_replace(d, '(?i){p}', '{phrase}', 'g')" for p in patterns)
    return f"CASE {cases} ELSE regexp_replace(d, '\\.+$', '') || '{end}' END"


_MADE = " UNION ALL ".join(f"SELECT key, {k} AS nth, {t[0]} AS expected_tcl, '{t[1]}' AS tag, {_sql_form(t[2])} AS reference_sva, {_sql_worded(t[0], t[3])} AS nl FROM p" for k, t in enumerate(variants.TEMPLATES))


def _sql_level(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{classify.any_of(classify.LEVELS[n])}') THEN {n}" for n in (5, 4, 3, 2)) + " ELSE 1 END"


@query(f"""WITH s AS (SELECT key, trim(regexp_replace(sva, '\\s+', ' ', 'g')) AS x, trim(regexp_replace(nl, '\\s+', ' ', 'g')) AS d FROM {SEEDS_SQL} WHERE length(trim(nl)) >= 8),
c AS (SELECT key, x, d, trim(regexp_extract(x, '^(.*?)\\|[-=]>', 1)) AS l, regexp_replace(trim(regexp_extract(x, '^.*?\\|[-=]>(.*)$', 1)), ';+$', '') AS r, CASE WHEN x LIKE '%;' THEN ';' ELSE '' END AS fin FROM s
  WHERE {_sql_level('x')} = 4 AND regexp_matches(x, '\\|[-=]>') AND NOT regexp_matches(x, '{variants.LIVE}')),
p AS (SELECT *, CASE WHEN regexp_matches(r, '##\\s*\\d') THEN regexp_extract(r, '^(.*?)##\\s*\\d+', 1) || '##[' || regexp_extract(r, '##\\s*(\\d+)', 1) || ':' || (regexp_extract(r, '##\\s*(\\d+)', 1)::INT + 2) || ']' || regexp_extract(r, '^.*?##\\s*\\d+(.*)$', 1) END AS b,
  CASE WHEN regexp_matches(r, '##\\s*\\d') THEN regexp_extract(r, '^(.*?)##\\s*\\d+', 1) || '##[' || regexp_extract(r, '##\\s*(\\d+)', 1) || ':$]' || regexp_extract(r, '^.*?##\\s*\\d+(.*)$', 1) END AS o FROM c),
m AS ({_MADE}), k AS (SELECT * FROM m WHERE reference_sva IS NOT NULL AND {_sql_level('reference_sva')} = expected_tcl),
h AS (SELECT *, substr(sha256(trim(regexp_replace(reference_sva, '\\s+', ' ', 'g'))), 1, 16) AS hash FROM k),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY key, nth) = 1)
SELECT 'synthetic_l' || expected_tcl || '_' || tag || '_' || hash AS id, key::VARCHAR AS parent_id, nl, reference_sva, expected_tcl, hash, 'l4_to_l' || expected_tcl || '_' || tag AS transform FROM f""")
def expanded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all implications with their wording; each text once."""
    rows = seeds(spark, sf_dir).select(F.col("key").cast("string").alias("id"), "nl", "reference_sva", F.lit("").alias("rtl_context"), F.lit("orders").alias("source"), F.lit(None).cast("string").alias("hash"), "key")
    return variants.expanded(rows, "key").select("id", "parent_id", "nl", "reference_sva", "expected_tcl", "hash", "transform")


#: Conditions, and designs, in turn.
RESETS = ["disable iff (rst{m}) a", "disable iff (tb_reset) a", "a{m}", "disable iff (!(rst_n) || (soft && {m})) a", "disable iff (rst (a", "disable iff (r1) a ##1 disable iff ( r{m} ) b"]
DESIGNS = ["module m; endmodule", "module m; wire tb_reset; endmodule", "no module", "module a; endmodule\nmodule b;  \nendmodule // end"]
_CONDITIONS = ["['rst' || n]", "[]", "NULL", "['!(rst_n) || (soft && ' || n || ')']", "NULL", "['r1', 'r' || n]"]
_AFTER = ["disable iff (tb_reset) a", "disable iff (tb_reset) a", "a{m}", "disable iff (tb_reset) a", "disable iff (rst (a", "disable iff (tb_reset) a ##1 disable iff (tb_reset) b"]
_STATUS = ["'rewritten'", "'already_canonical'", "'no_disable_iff'", "'rewritten'", "'malformed'", "CASE WHEN n = '1' THEN 'rewritten' ELSE 'multi_distinct' END"]
_CASE = lambda xs: "CASE f " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_orderkey % {len(RESETS)} AS f, (o_orderkey % 5)::VARCHAR AS n, ({sql_list(DESIGNS)})[1 + o_custkey % {len(DESIGNS)}] AS rtl FROM orders),
b AS (SELECT id, rtl, {_CASE(_STATUS)} AS status, coalesce({_CASE([f"{c}::VARCHAR[]" for c in _CONDITIONS])}, []) AS cs, replace({_CASE([f"'{x}'" for x in _AFTER])}, '{{m}}', n) AS sva FROM a)
SELECT id, status, 'assert property (@(posedge clk) ' || sva || ');' AS reference_sva, array_to_string(cs, ' / ') AS reset_exprs,
  CASE WHEN len(cs) > 0 AND contains(rtl, 'endmodule') AND NOT contains(rtl, 'tb_reset') THEN regexp_replace(regexp_extract(rtl, '(?s)^(.*)endmodule', 1), '\\s+$', '') || chr(10) || '    wire tb_reset;' || chr(10) || '    assign tb_reset = (' || cs[1] || ');' || chr(10) || regexp_extract(rtl, '(?s)^.*(endmodule.*)$', 1)
    ELSE rtl END AS rtl_context FROM b""")
def one_reset_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sva = F.concat(F.lit("assert property (@(posedge clk) "), F.replace(chosen(RESETS, F.col("o_orderkey")), F.lit("{m}"), (F.col("o_orderkey") % 5).cast("string")), F.lit(");"))
    rows = o.select(F.col("o_orderkey").alias("id"), sva.alias("reference_sva"), chosen(DESIGNS, F.col("o_custkey")).alias("rtl_context"))
    return resets.normalised_rows(rows).select("id", "status", "reference_sva", F.array_join("reset_exprs", " / ").alias("reset_exprs"), "rtl_context")


@query("""WITH r AS (SELECT (l_orderkey % 5 + 1)::INT AS level, l_partkey % 4 <> 0 AS ok, CASE WHEN l_partkey % 4 <> 0 THEN (l_suppkey % 5 + 1)::INT END AS g, l_linenumber = 1 AS same FROM lineitem),
a AS (SELECT level, ok, g, same FROM r UNION ALL SELECT NULL, ok, g, same FROM r), b AS (SELECT level, ok, g, same FROM a)
SELECT x.level, count(*) AS total, count(*) FILTER (ok) AS syntax_ok, count(*) FILTER (g = own) AS level_match, count(*) FILTER (same) AS body_match, round(count(*) FILTER (ok) / count(*), 4) AS syntax_rate, round(count(*) FILTER (g = own) / count(*), 4) AS match_rate,
  round(count(*) FILTER (same) / count(*), 4) AS body_rate, round(avg(g - own), 4) AS mean_shift, round(avg(abs(g - own)), 4) AS mean_distance
FROM (SELECT level, level AS own, ok, g, same FROM r UNION ALL SELECT NULL, level, ok, g, same FROM r) x GROUP BY x.level""")
def level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5 + 1).cast("int").alias("want"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("got"), "l_partkey", "l_linenumber")
    return evaluate.level_report(rows, "want", "got", F.col("l_partkey") % 4 != 0, F.col("l_linenumber") == 1)


_MADE_BY = ["expand_tcl/method1", "expand_tcl/method3"]


@query("""WITH p AS (SELECT CASE WHEN o_custkey % 4 = 0 THEN 'synthetic' ELSE 'real' END AS side, o_orderstatus AS class, (o_orderkey % 3)::VARCHAR AS level FROM orders)
SELECT side, NULL AS "column", NULL AS value, count(*) AS n FROM p GROUP BY side UNION ALL SELECT side, 'class', class, count(*) FROM p GROUP BY side, class UNION ALL SELECT side, 'level', level, count(*) FROM p GROUP BY side, level""")
def sides_by_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.array(*map(F.lit, _MADE_BY)), F.array(F.lit(_MADE_BY[1]), F.lit("human")), F.array().cast("array<string>")]
    by = F.col("o_custkey") % 4
    provenance = F.when(by == 0, kinds[0]).when(by == 1, kinds[1]).when(by == 2, kinds[2])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("class"), (F.col("o_orderkey") % 3).alias("level"), provenance.alias("provenance"))
    return splits.side_report(splits.by_provenance(rows, _MADE_BY), ["class", "level"])


@query(f"""SELECT kind AS source, CASE kind WHEN 'macro' THEN 'o_r' || customer || '_d_f.sv_L' || id || '_M' || id % 3 WHEN 'snapshot' THEN 'snap_k_v_d_f.sv_L' || id ELSE 'o_r' || customer || '_d_f.sv_L' || id END AS id,
CASE WHEN kind = 'macro' THEN '[M' || id % 3 || '] Known' ELSE 'says ' || id % 4 END AS nl, trim(sva) AS reference_sva, CASE WHEN kind = 'macro' OR id % 2 = 0 THEN '' ELSE '// module m' || customer END AS rtl_context
FROM {ASSERTIONS}, (SELECT unnest(['repository', 'macro', 'snapshot']) AS kind)""")
def scraped_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped records of three layouts, written as JSON lines with empty ones among them and loaded by layout."""
    a, at = assertions(spark, sf_dir), stage.path(spark, "scraped")
    text = lambda c: c.cast("string")
    rows = a.select(
        "sva", F.concat(F.lit("says "), text(F.col("id") % 4)).alias("nl_comment"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("m"), text(F.col("customer")))).alias("module"), F.lit("d/f.sv").alias("file"), text(F.col("id")).alias("line"),
        F.concat(F.lit("o/r"), text(F.col("customer"))).alias("source_repo"), F.lit("snap").alias("source_snapshot"), F.lit("k:v").alias("strategy"), F.concat(F.lit("M"), text(F.col("id") % 3)).alias("macro"), F.array(F.lit("Known"), F.lit("x")).alias("args"),
    )
    sinks.jsonl(rows.unionByName(rows.withColumn("sva", F.lit(" "))), at)
    return benchmarks.load(spark, [(k, at, k, "train") for k in ("repository", "macro", "snapshot")]).select("source", "id", "nl", "reference_sva", "rtl_context")


_PATH = "'/data/' || CASE p_partkey % 3 WHEN 0 THEN 'repos/' WHEN 1 THEN 'snap/x/' ELSE 'other/' END || 'r' || p_size || '/' || CASE p_partkey % 4 WHEN 0 THEN 'src/verified/' WHEN 1 THEN 'a/b/' ELSE '' END || 'f' || p_partkey || '.sv'"


@query(f"""WITH f AS (SELECT {_PATH} AS path FROM part), u AS (SELECT path, n, array_to_string(string_split(path, '/')[1 : len(string_split(path, '/')) - n], '/') AS root FROM f, (SELECT unnest(range(0, 15)) AS n) WHERE n < len(string_split(path, '/'))),
h AS (SELECT path, n, root FROM u WHERE regexp_extract(root, '^(.*)/[^/]*$', 1) IN ('/data/repos', '/data/snap/x') OR regexp_extract(root, '[^/]*$') = 'verified')
SELECT f.path, g.root FROM f LEFT JOIN (SELECT path, arg_min(root, n) AS root FROM h GROUP BY path) g USING (path)""")
def nearest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository of each file: the nearest marked folder above it."""
    files = table(spark, sf_dir, "part").select(F.expr(_PATH).alias("path"))
    containers = spark.createDataFrame([("/data/repos",), ("/data/snap/x/",)], "path string")
    return bundles.rooted(files, containers, ["verified"]).select("path", "root")


@query("""WITH p AS (SELECT c_custkey::VARCHAR AS id, CASE c_custkey % 4 WHEN 0 THEN '[ASSERT x]' WHEN 1 THEN 'four' ELSE 'says ' || c_custkey END AS nl, (c_custkey % 7)::INT AS tcl, CASE c_custkey % 5 WHEN 0 THEN 'C3' WHEN 1 THEN 'odd' WHEN 2 THEN '' END AS cls FROM customer),
c AS (SELECT *, coalesce(nullif(cls, ''), CASE tcl WHEN 1 THEN 'C1' WHEN 2 THEN 'C2' WHEN 3 THEN 'C2' WHEN 4 THEN 'C2' WHEN 5 THEN 'C3' END) AS class FROM p WHERE nl LIKE 'says %')
SELECT class, id, nl, 'sva' AS sva, tcl FROM c WHERE class IN ('C1', 'C2', 'C3')""")
def training_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows by class of the curriculum."""
    by = F.col("c_custkey") % 4
    nl = F.when(by == 0, "[ASSERT x]").when(by == 1, "four").otherwise(F.concat(F.lit("says "), F.col("c_custkey").cast("string")))
    named = F.col("c_custkey") % 5
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), nl.alias("nl"), F.lit("sva").alias("reference_sva"), (F.col("c_custkey") % 7).cast("int").alias("expected_tcl"),
        F.when(named == 0, "C3").when(named == 1, "odd").when(named == 2, "").alias("temporal_class"), F.lit(None).cast("string").alias("rtl_context"),
    )
    return prompts.by_class(rows).drop("rtl_context")
