"""Modules made around assertions: one table of symbols, from which units to lint, bound checkers, benches and stand-in contexts are written.

`symbols` tells the role of each identifier (port, parameter, function, array of several dimensions) by how the text uses it, and the width
that literals and selects ask for. All are column expressions: nothing leaves the engine's generated code, and equal texts give equal modules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from assertlake.functions.keys import SPACES, let, strip, text
from assertlake.functions.parse import without_label
from assertlake.functions.rewards import agreement

NAME = r"[A-Za-z_]\w*"

#: Words that are no identifiers of a unit to lint; fixed values.
UNIT_KEYWORDS = (
    "assert assume cover property endproperty sequence endsequence posedge negedge disable iff if else begin end always always_ff always_comb always_latch logic wire reg module endmodule input output "
    "inout bind and or not xor nand nor xnor throughout within intersect first_match until until_with s_until s_until_with s_eventually s_always nexttime strong weak rose fell stable past changed sampled "
    "onehot onehot0 countones isunknown isknown signed unsigned"
).split()
#: Functions that the language has; fixed values.
BUILTINS = (
    "past rose fell stable changed sampled onehot onehot0 countones isunknown isknown signed unsigned bits left right high low size increment dimensions unpacked_dimensions clog2 ln log10 exp sqrt pow "
    "floor ceil abs min max display write monitor error warning info fatal time stime realtime random urandom urandom_range assert assume cover property sequence posedge negedge if else"
).split()
#: Words that are no signals of a stand-in context; fixed values.
CONTEXT_KEYWORDS = (
    "assert assume cover property endproperty sequence endsequence always always_ff always_comb always_latch if else begin end case endcase default module endmodule input output inout wire reg logic bit "
    "byte shortint int longint integer posedge negedge edge disable iff for while and or not throughout within intersect first_match until until_with s_until s_eventually s_always nexttime strong weak "
    "implies rose fell stable past changed sampled onehot onehot0 countones isunknown isknown asserton assertkill assertoff clk tb_reset rst reset rst_n reset_n rst_ni reset_ni clock"
).split()

#: What the written modules say; fixed values.
ARGUMENTS = (
    "    input logic [31:0] a0 = 32'd0, input logic [31:0] a1 = 32'd0,\n    input logic [31:0] a2 = 32'd0, input logic [31:0] a3 = 32'd0,\n"
    "    input logic [31:0] a4 = 32'd0, input logic [31:0] a5 = 32'd0,\n    input logic [31:0] a6 = 32'd0, input logic [31:0] a7 = 32'd0);\n"
)
BENCH = """\
`timescale 1ns/1ps
module dyn_check;
  logic clk = 0;
  logic tb_reset = 1;
{ports}
{body}

  always #5 clk = ~clk;

  int n_cycles = 0;
  int n_ref_fail = 0;
  int n_gen_fail = 0;

  property p_ref; {ref}; endproperty
  property p_gen; {gen}; endproperty

  ref_a: assert property (p_ref) else n_ref_fail++;
  gen_a: assert property (p_gen) else n_gen_fail++;

  initial begin
    tb_reset = 1; #25;
    tb_reset = 0;

    repeat({cycles}) @(posedge clk) begin
{drive}
      n_cycles++;
    end

    $display("AGREEMENT %0d %0d %0d", n_cycles, n_ref_fail, n_gen_fail);
    $finish;
  end

  // Wallclock safety net
  initial begin
    #50000;
    $display("AGREEMENT %0d %0d %0d", n_cycles, n_ref_fail, n_gen_fail);
    $finish;
  end
endmodule
"""


@dataclass(frozen=True)
class Scope:
    """What counts as an identifier: no keyword in any case, none of the names that the module declares by itself; bare: literals and hierarchy tails are cut first."""

    keywords: tuple[str, ...]
    declared: tuple[str, ...] = ()
    bare: bool = False


UNIT = Scope(tuple(UNIT_KEYWORDS), ("clk", "tb_reset"))
CONTEXT = Scope(tuple(CONTEXT_KEYWORDS), bare=True)


def found(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))


def identifiers(c: Column | str, scope: Scope = UNIT) -> Column:
    """Each once, in the order of first use, without a leading label."""
    x = text(c)
    if scope.bare:
        x = F.regexp_replace(F.regexp_replace(x, r"\d+'[bdho][0-9a-fA-FxXzZ_]+|\d+", " "), r"\.[A-Za-z_]\w*", "")
        names = found(x, r"\b([A-Za-z_][A-Za-z0-9_$]*)\b")
    else:
        names = found(without_label(x), rf"({NAME})")
    return F.filter(names, lambda n: ~F.lower(n).isin(list(scope.keywords)) & ~n.isin(list(scope.declared)))


def symbols(c: Column | str, other: Column | str | None = None, scope: Scope = UNIT) -> Column:
    """table() of the identifiers of one assertion or two."""
    names, whole = identifiers(c, scope), text(c)
    if other is not None:
        names, whole = F.array_union(names, identifiers(other, scope)), F.concat(whole, F.lit(" "), text(other))
    return table(names, whole, scope)


def table(names: Column, whole: Column, scope: Scope = UNIT) -> Column:
    """array<struct<name, role, constant, width>> of the names, in their order, by what the whole text does with them.

    role: array where it's selected twice, function where it's called, else parameter where it counts cycles after ## or is a word of three and more
    capitals, else port; a clock is never an array, nor a parameter. constant: counts cycles, also if it's called. width: the widest literal that it's
    compared with, at least 32 with a select of constant places, else 1.
    """
    compared = rf"({NAME})\s*(?:===|!==|==|!=|>=|<=|>|<)\s*(\d+)'[bdho]"
    used = lambda x: F.struct(
        F.filter(found(x, rf"\b({NAME})\s*\("), lambda n: ~F.lower(n).isin([*scope.keywords, *BUILTINS])).alias("called"),
        found(x, rf"@\s*\(\s*(?:posedge|negedge|edge)?\s*({NAME})").alias("clocks"),
        found(x, rf"##\s*({NAME})").alias("delays"),
        found(x, rf"\b({NAME})\s*\[[^\]]+\]\s*\[[^\]]+\]").alias("twice"),
        found(x, rf"({NAME})\s*\[\s*\d+\s*(?::\s*\d+\s*)?\]").alias("chosen"),
        F.arrays_zip(*(F.regexp_extract_all(x, F.lit(compared), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "width")))).alias("sides"),
    )

    def told(n: Column, uses: Column) -> Column:
        has = lambda kind: F.array_contains(uses[kind], n)
        clock, function = has("clocks"), has("called")
        array = has("twice") & ~clock & ~function
        counts = has("delays") & ~clock
        capitals = (F.length(n) >= 3) & (n == F.upper(n)) & (n != F.lower(n)) & ~function & ~clock
        role = F.when(array, "array").when(function, "function").when(counts | capitals, "parameter").otherwise("port")
        literal = F.array_max(F.transform(F.filter(uses["sides"], lambda s: s["name"] == n), lambda s: s["width"].try_cast("int")))
        width = F.greatest(F.lit(1), F.coalesce(literal, F.lit(1)), F.when(has("chosen"), 32).otherwise(1))
        return F.struct(n.alias("name"), role.alias("role"), (counts & ~array).alias("constant"), width.alias("width"))

    return F.array_sort(let(let(whole, used), lambda uses: F.transform(names, lambda n: told(n, uses))))


def lines(made: Column, role: str, line, separator: str = "\n") -> Column:
    """A line for each symbol of a role; a function whose name counts cycles is a parameter too."""
    mine = F.filter(made, lambda s: (s["role"] == role) | (s["constant"] & F.lit(role == "parameter")))
    return F.array_join(F.transform(mine, line), separator)


def joined(*parts: Column, separator: str = "\n") -> Column:
    """The parts that aren't empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), separator)


def constants(made: Column, returns: str) -> Column:
    """Parameters, then functions that return what is said."""
    parameter = lines(made, "parameter", lambda s: F.concat(F.lit("  parameter logic [31:0] "), s["name"], F.lit(" = 32'd4;")))
    head, tail = F.lit("  function automatic logic [31:0] "), F.lit(f"(\n{ARGUMENTS}    return {returns};\n  endfunction")
    return joined(parameter, lines(made, "function", lambda s: F.concat(head, s["name"], tail)))


def check_unit(sva: Column | str, ref: Column | str) -> Column:
    """A module of its own that declares whatever the assertion and its reference name, around the assertion."""
    return let(symbols(sva, ref), lambda made: _unit(made, sva))


def _unit(made: Column, sva: Column | str) -> Column:
    port = lambda kind: lambda s: F.concat(F.lit(f"    input logic {kind} "), s["name"])
    ports = joined(F.lit("    input logic clk,\n    input logic tb_reset"), lines(made, "port", port("[31:0]"), ",\n"), lines(made, "array", port("[31:0][31:0][31:0]"), ",\n"), separator=",\n")
    return joined(F.concat(F.lit("module sva_check (\n"), ports, F.lit("\n);")), constants(made, "32'd0"), F.concat(F.lit("  "), strip(sva), F.lit("\nendmodule\n")))


def bind_unit(sva: Column | str, ref: Column | str, rtl: Column | str) -> Column:
    """The design, and after it a checker with every identifier as a port of 32 bits; check_unit where there's no whole module."""
    names = F.array_sort(F.array_union(identifiers(sva), identifiers(ref)))
    ports = F.array_join(F.concat(F.array(F.lit("    input logic clk"), F.lit("    input logic tb_reset")), F.transform(names, lambda n: F.concat(F.lit("    input logic [31:0] "), n))), ",\n")
    bound = F.concat(F.rtrim(strip(rtl), F.lit(SPACES)), F.lit("\n\nmodule sva_check (\n"), ports, F.lit("\n);\n  "), strip(sva), F.lit("\nendmodule\n"))
    whole = strip(rtl).rlike(rf"(?m)^\s*module\s+{NAME}") & F.contains(text(rtl), F.lit("endmodule"))
    return F.when(whole, bound).otherwise(check_unit(sva, ref))


def property_body(sva: Column | str) -> Column:
    """What the outermost directive holds; the text itself without one."""
    inside = lambda x: F.regexp_extract(x, r"(?is)\b(?:assert|assume|cover)\s+property\s*\((.+)\)\s*;?\s*$", 1)
    return let(strip(F.regexp_replace(strip(sva), ";+$", "")), lambda x: strip(F.coalesce(F.nullif(inside(x), F.lit("")), x)))


def dynamic_bench(sva: Column | str, ref: Column | str, cycles: int = 200) -> Column:
    """A bench that drives every port at random and counts how often each of the two fails; null if either is empty."""
    names = F.array_union(identifiers(sva), identifiers(ref))
    both = F.struct(property_body(sva).alias("gen"), property_body(ref).alias("ref"))
    whole = lambda x: F.concat(x["ref"], F.lit(" "), x["gen"])
    return let(both, lambda x: F.when((x["gen"] != "") & (x["ref"] != ""), let(table(names, whole(x)), lambda made: _bench(made, x, cycles))))


def _bench(made: Column, bodies: Column, cycles: int) -> Column:
    declared = lambda kind: lambda s: F.concat(F.lit(f"  logic {kind} "), s["name"], F.lit(";"))
    ports = joined(lines(made, "port", declared("[31:0]")), lines(made, "array", declared("[31:0][31:0][31:0]")))
    drive = F.coalesce(F.nullif(lines(made, "port", lambda s: F.concat(F.lit("      "), s["name"], F.lit(" <= $urandom_range(0, 1);"))), F.lit("")), F.lit("      ;"))
    fill = {"ports": ports, "body": constants(made, "$urandom()"), "ref": bodies["ref"], "gen": bodies["gen"], "cycles": F.lit(str(cycles)), "drive": drive}
    parts, rest = [], BENCH
    for name, value in fill.items():
        before, rest = rest.split(f"{{{name}}}", 1)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


def bench_agreement(log: Column | str) -> Column:
    """The score of a bench's output; null without counts."""
    return agreement(*(F.regexp_extract(text(log), r"AGREEMENT\s+(\d+)\s+(\d+)\s+(\d+)", k).try_cast("long") for k in (1, 2, 3)))


def clock_of(sva: Column | str) -> Column:
    """The name at the first edge, else clk."""
    name = F.regexp_extract(text(sva), r"(?i)@\s*\(\s*(?:pos|neg)edge\s+([A-Za-z_]\w*)\s*\)", 1)
    return F.when(name != "", name).otherwise("clk")


def context_symbols(sva: Column | str) -> Column:
    """symbols() of a stand-in context: without the clock, if that has no capitals."""
    return let(clock_of(sva), lambda clock: F.filter(symbols(sva, scope=CONTEXT), lambda s: F.lower(s["name"]) != clock))


def context(sva: Column | str, reset: str = "reset", active_high: bool = True) -> Column:
    """A stand-in for a missing design: clock, reset and every signal, as wide as the assertion asks, as inputs, and the alias tb_reset."""
    wide = lambda s: F.when(s["width"] > 1, F.concat(F.lit("["), (s["width"] - 1).cast("string"), F.lit(":0] "))).otherwise("")
    ports = F.transform(context_symbols(sva), lambda s: F.concat(F.lit("    input logic "), wide(s), s["name"]))
    first = F.array(F.concat(F.lit("    input logic "), clock_of(sva)), F.lit(f"    input logic {reset}"))
    tail = f"\n);\n    wire tb_reset;\n    assign tb_reset = ({reset} == 1'b{int(active_high)});\nendmodule\n"
    return F.concat(F.lit("module synth_top (\n"), F.array_join(F.concat(first, ports), ",\n"), F.lit(tail))


def needs_context(rtl: Column | str) -> Column:
    return ~(F.contains(text(rtl), F.lit("module")) & F.contains(text(rtl), F.lit("endmodule")) & F.contains(text(rtl), F.lit("tb_reset")))
