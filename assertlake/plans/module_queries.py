"""Queries over modules made around assertions, with SQL that builds the same texts by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake import schemas
from assertlake.functions import keys, modules, rewrite
from assertlake.plans.tables import ASSERTIONS, chosen, sql_list, table
from assertlake.plans.text_queries import for_all_ids

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Assertions that use a symbol in every way; {m} becomes the order's key modulo 5.
RICH = [
    "assert property (@(posedge clk) disable iff (rst_n) data{m} == 8'd5 |-> ##DLY valid);",
    "chk_{m}: assert property (@(posedge sys_clk) bus[3] && bus[7:4] != 4'hF |=> mem[idx][2] <= 16'd{m});",
    "assert property (@(negedge CK) $rose(req) |-> ##MAX_{m} parity(data, WIDTH) === 1'b1);",
    "assert property (@(posedge clk) top.u_core.state == 3'b010 |-> ack{m} [*LEN]);",
    "assert property (@(posedge clk) ##is_ok{m}(a) 1'b1 |-> cnt[0] > 12'o17);",
    "assert property (@(clk) tb_reset || A{m}B >= 40'd1 || ABC[1][0] < 2'd1);  ;",
    "property p{m}; a |-> b; endproperty",
    " ",
]
#: The references that they are checked against, and the designs; one of them in turn.
REFERENCES = ["", "assert property (@(posedge clk) valid |-> data2 > 64'd1 && MODE);", "x: cover property (@(posedge clk) grid[1][2][3] ##1 f(y));"]
DESIGNS = ["", "module m{m}(input clk);\n  wire tb_reset;\nendmodule\n  ", "// no module here", "  module late(input a);\nendmodule"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sva, ref, rtl): one for each order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    m = lambda c: F.replace(c, F.lit("{m}"), (F.col("o_orderkey") % 5).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), m(chosen(RICH, F.col("o_orderkey"))).alias("sva"), chosen(REFERENCES, F.col("o_custkey")).alias("ref"), m(chosen(DESIGNS, F.col("o_custkey") + F.col("o_orderkey"))).alias("rtl"))


def sql_chosen(texts: list[str], key: str) -> str:
    return f"({sql_list(texts)})[1 + ({key}) % {len(texts)}]"


RICH_SQL = f"""(SELECT o_orderkey AS id, replace({sql_chosen(RICH, "o_orderkey")}, '{{m}}', (o_orderkey % 5)::VARCHAR) AS sva, {sql_chosen(REFERENCES, "o_custkey")} AS ref,
replace({sql_chosen(DESIGNS, "o_custkey + o_orderkey")}, '{{m}}', (o_orderkey % 5)::VARCHAR) AS rtl FROM orders)"""


def each_once(rows: DataFrame, keys_: list[str], judge) -> DataFrame:
    """judge's columns for every row, made once for equal keys."""
    made = judge(rows.select(*keys_).distinct())
    return rows.join(made, keys_)


def sql_words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_all(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


_BARE = r"regexp_replace(regexp_replace({x}, '\d+''[bdho][0-9a-fA-FxXzZ_]+|\d+', ' ', 'g'), '\.[A-Za-z_]\w*', '', 'g')"
_LABEL = r"regexp_replace(ltrim({x}), '(?i)^[A-Za-z_]\w*\s*:\s*((?:assert|assume|cover|property))', '\1')"


def sql_names(x: str) -> str:
    found = sql_all(_LABEL.replace("{x}", x), "([A-Za-z_]\\w*)")
    return f"list_filter(list_distinct({found}), lambda n: NOT list_contains({sql_words(modules.UNIT_KEYWORDS)}, lower(n)) AND n NOT IN ('clk', 'tb_reset'))"


def sql_table(names: str, whole: str, words: list[str]) -> str:
    """The symbols as a list of structs, each role by a look at the whole text."""
    called = f"list_filter({sql_all(whole, '\\b([A-Za-z_]\\w*)\\s*\\(')}, lambda f: NOT list_contains({sql_words([*words, *modules.BUILTINS])}, lower(f)))"
    clocks = sql_all(whole, r"@\s*\(\s*(?:posedge|negedge|edge)?\s*([A-Za-z_]\w*)")
    delays, twice = sql_all(whole, r"##\s*([A-Za-z_]\w*)"), sql_all(whole, r"\b([A-Za-z_]\w*)\s*\[[^\]]+\]\s*\[[^\]]+\]")
    some = sql_all(whole, r"([A-Za-z_]\w*)\s*\[\s*\d+\s*(?::\s*\d+\s*)?\]")
    compared = r"([A-Za-z_]\w*)\s*(?:===|!==|==|!=|>=|<=|>|<)\s*(\d+)'[bdho]"
    literals = f"list_zip({sql_all(whole, compared)}, {sql_all(whole, compared, 2)})"
    clock, function, array, count = (f"list_contains({x}, n)" for x in (clocks, called, twice, delays))
    is_array = f"({array} AND NOT {clock} AND NOT {function})"
    capitals = f"(length(n) >= 3 AND n = upper(n) AND n <> lower(n) AND NOT {function} AND NOT {clock})"
    role = f"CASE WHEN {is_array} THEN 'array' WHEN {function} THEN 'function' WHEN {count} AND NOT {clock} OR {capitals} THEN 'parameter' ELSE 'port' END"
    width = f"greatest(1, coalesce(list_max(list_transform(list_filter({literals}, lambda z: z[1] = n), lambda z: z[2]::INT)), 1), CASE WHEN list_contains({some}, n) THEN 32 ELSE 1 END)"
    return f"list_transform(list_sort({names}), lambda n: {{'name': n, 'role': {role}, 'constant': {count} AND NOT {clock} AND NOT {is_array}, 'width': {width}}})"


def sql_quote(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_lines(made: str, role: str, line: str, separator: str = "chr(10)") -> str:
    cond = f"s.role = '{role}'" + (" OR s.constant" if role == "parameter" else "")
    return f"array_to_string(list_transform(list_filter({made}, lambda s: {cond}), lambda s: {line}), {separator})"


def sql_joined(*parts: str, separator: str = "chr(10)") -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda p: p <> ''), {separator})"


def sql_constants(made: str, returns: str) -> str:
    function = f"'  function automatic logic [31:0] ' || s.name || {sql_quote('(' + chr(10) + modules.ARGUMENTS + '    return ' + returns + ';' + chr(10) + '  endfunction')}"
    return sql_joined(sql_lines(made, "parameter", f"'  parameter logic [31:0] ' || s.name || {sql_quote(chr(32) + '= 32' + chr(39) + 'd4;')}"), sql_lines(made, "function", function))


_BODY = r"CASE WHEN regexp_extract(b, '(?is)\b(?:assert|assume|cover)\s+property\s*\((.+)\)\s*;?\s*$', 1) <> '' THEN trim(regexp_extract(b, '(?is)\b(?:assert|assume|cover)\s+property\s*\((.+)\)\s*;?\s*$', 1)) ELSE b END"
_BENCH = "'" + modules.BENCH.replace("'", "''") + "'"
_PORTS = lambda kind: f"'    input logic {kind} ' || s.name"
_FIRST = "'    input logic clk,' || chr(10) || '    input logic tb_reset'"
_NL = "chr(10)"
MADE_SQL = f"""
WITH a AS (SELECT *, {sql_names("sva")} AS own, {sql_names("ref")} AS others FROM {RICH_SQL}),
b AS (SELECT *, trim(regexp_replace(trim(sva), ';+$', '')) AS sb, trim(regexp_replace(trim(ref), ';+$', '')) AS rb, list_distinct(list_concat(own, others)) AS names FROM a),
c AS (SELECT *, {_BODY.replace("(b,", "(sb,").replace("ELSE b", "ELSE sb")} AS s_body, {_BODY.replace("(b,", "(rb,").replace("ELSE b", "ELSE rb")} AS r_body FROM b),
t AS (SELECT *, {sql_table("names", "(sva || ' ' || ref)", modules.UNIT_KEYWORDS)} AS made, {sql_table("names", "(r_body || ' ' || s_body)", modules.UNIT_KEYWORDS)} AS driven FROM c),
u AS (
  SELECT *, {sql_constants("made", "32'd0")} AS constants, {sql_constants("driven", "$urandom()")} AS stubs,
    {sql_joined(_FIRST, sql_lines("made", "port", _PORTS("[31:0]"), "',' || chr(10)"), sql_lines("made", "array", _PORTS("[31:0][31:0][31:0]"), "',' || chr(10)"), separator="',' || chr(10)")} AS ports,
    {sql_joined(sql_lines("driven", "port", "'  logic [31:0] ' || s.name || ';'"), sql_lines("driven", "array", "'  logic [31:0][31:0][31:0] ' || s.name || ';'"))} AS logics,
    {sql_lines("driven", "port", "'      ' || s.name || ' <= $urandom_range(0, 1);'")} AS drive FROM t),
v AS (
  SELECT *, 'module sva_check (' || {_NL} || ports || {_NL} || ');' || {_NL} || constants || CASE WHEN constants <> '' THEN {_NL} ELSE '' END || '  ' || trim(sva) || {_NL} || 'endmodule' || {_NL} AS unit FROM u)
SELECT id, array_to_string(list_transform(made, lambda s: s.name || ':' || s.role || ':' || s.width || CASE WHEN s.constant THEN ':constant' ELSE '' END), ' ') AS symbols, unit,
  CASE WHEN regexp_matches(trim(rtl), '(?m)^\\s*module\\s+[A-Za-z_]') AND contains(rtl, 'endmodule') THEN md5(rtrim(trim(rtl), ' ' || chr(10)) || {_NL} || {_NL} || 'module sva_check (' || {_NL}
    || array_to_string(list_concat(['    input logic clk', '    input logic tb_reset'], list_transform(list_sort(names), lambda n: '    input logic [31:0] ' || n)), ',' || {_NL}) || {_NL} || ');' || {_NL} || '  ' || trim(sva) || {_NL} || 'endmodule' || {_NL})
    ELSE md5(unit) END AS bound,
  CASE WHEN s_body <> '' AND r_body <> '' THEN md5(replace(replace(replace(replace(replace(replace({_BENCH}, '{{ports}}', logics), '{{body}}', stubs), '{{cycles}}', '200'), '{{drive}}', CASE WHEN drive = '' THEN '      ;' ELSE drive END), '{{ref}}', r_body), '{{gen}}', s_body)) END AS bench
FROM v
"""


@query(MADE_SQL)
def module_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of symbols and the three modules made from it: whole, bound to a design, and as a bench."""
    shown = lambda s: F.concat(s["name"], F.lit(":"), s["role"], F.lit(":"), s["width"].cast("string"), F.when(s["constant"], ":constant").otherwise(""))
    judge = lambda texts: texts.select(
        "sva", "ref", "rtl", F.array_join(F.transform(modules.symbols("sva", "ref"), shown), " ").alias("symbols"), modules.check_unit("sva", "ref").alias("unit"),
        F.md5(modules.bind_unit("sva", "ref", "rtl")).alias("bound"), F.md5(modules.dynamic_bench("sva", "ref")).alias("bench"),
    )
    return each_once(rich(spark, sf_dir), ["sva", "ref", "rtl"], judge).select("id", "symbols", "unit", "bound", "bench")


_CLOCK = r"CASE WHEN regexp_extract(sva, '(?i)@\s*\(\s*(?:pos|neg)edge\s+([A-Za-z_]\w*)\s*\)', 1) <> '' THEN regexp_extract(sva, '(?i)@\s*\(\s*(?:pos|neg)edge\s+([A-Za-z_]\w*)\s*\)', 1) ELSE 'clk' END"
_NAMES = f"list_filter(list_distinct({sql_all(_BARE.replace('{x}', 'sva'), '\\b([A-Za-z_][A-Za-z0-9_$]*)\\b')}), lambda n: NOT list_contains({sql_words(modules.CONTEXT_KEYWORDS)}, lower(n)) AND lower(n) <> clk)"
CONTEXT_SQL = f"""
WITH a AS (SELECT *, {_CLOCK} AS clk FROM {RICH_SQL}),
t AS (SELECT *, {sql_table(_NAMES, "sva", modules.CONTEXT_KEYWORDS)} AS made FROM a)
SELECT id::VARCHAR AS id, 'synthetic_from_l4' AS source, clk, substr(md5(sva), 1, 16) AS hash, array_to_string(list_transform(made, lambda s: s.name), ' ') AS signals,
  CASE WHEN contains(rtl, 'module') AND contains(rtl, 'endmodule') AND contains(rtl, 'tb_reset') THEN rtl ELSE 'module synth_top (' || {_NL}
    || array_to_string(list_concat(['    input logic ' || clk, '    input logic reset'], list_transform(made, lambda s: '    input logic ' || CASE WHEN s.width > 1 THEN '[' || (s.width - 1) || ':0] ' ELSE '' END || s.name)), ',' || {_NL})
    || {_NL} || ');' || {_NL} || '    wire tb_reset;' || {_NL} || '    assign tb_reset = (reset == 1''b1);' || {_NL} || 'endmodule' || {_NL} END AS rtl_context FROM t
"""


@query(CONTEXT_SQL)
def reshaped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows; those without a usable design get one that is as wide as the assertion asks."""
    judge = lambda texts: schemas.reshaped(texts.select(
        F.lit("").alias("id"), F.lit("").alias("nl"), F.col("sva").alias("reference_sva"), F.col("rtl").alias("rtl_context"), F.lit(4).alias("expected_tcl"),
        F.lit(None).cast("string").alias("hash_canon"), F.lit("bounded").alias("temporal_class"), "rtl",
    ), keep=["rtl"]).withColumnRenamed("reference_sva", "sva")
    made = each_once(rich(spark, sf_dir).withColumnRenamed("id", "key"), ["sva", "rtl"], judge)
    return made.select(F.col("key").cast("string").alias("id"), "source", "clk", "hash", F.array_join("signals", " ").alias("signals"), "rtl_context")


_TOP = f"""'module pec_top (' || {_NL} || array_to_string(list_concat(['    input logic clk', '    input logic tb_reset'], list_transform(list_sort(list_filter(list_distinct({sql_all("sva", "([A-Za-z_]\\w*)")}),
  lambda n: NOT list_contains({sql_words(sorted(rewrite.KEYWORDS))}, lower(n)) AND n NOT IN ('clk', 'tb_reset'))), lambda n: '    input logic [31:0] ' || n)), ',' || {_NL}) || {_NL} || ');' || {_NL} || 'endmodule' || {_NL}"""
_USUAL = " ".join(f"WHEN regexp_matches(rtl, '\\b{x}\\b') THEN '{'!' + x if x.endswith('_n') else x}'" for x in rewrite.RESETS)


@query(f"""WITH a AS (SELECT id, sva, {_TOP} AS rtl FROM {ASSERTIONS})
SELECT id, coalesce(nullif(trim(regexp_extract(sva, 'disable\\s+iff\\s*\\(([^)]+)\\)', 1)), ''), CASE {_USUAL} END) AS reset, substr(sha256(rtl), 1, 16) AS rtl_key FROM a""")
def reset_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resets each assertion within a module of free inputs, and the module's key."""
    made = lambda texts: texts.withColumn("rtl", rewrite.free_inputs("sva"))
    return for_all_ids(spark, sf_dir, lambda texts: made(texts).select("sva", rewrite.reset_expression("rtl", "sva", "sva").alias("reset"), keys.raw_hash("rtl").alias("rtl_key")))

