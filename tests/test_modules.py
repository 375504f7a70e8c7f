"""Modules made around assertions: golden texts, and roles and widths against a plain version."""

import re

import pytest
from pyspark.sql import functions as F

from assertlake import schemas
from assertlake.functions import modules

ARGUMENTS = modules.ARGUMENTS


def one(spark, value, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)).select(value.alias("x")).first().x


@pytest.mark.parametrize(
    ("sva", "want"),
    [
        ("assert property (@(posedge clk) data == 8'd5 |-> done);", "data:port:8 done:port:1"),
        ("assert property (@(posedge clk) data == 8'd5 && data > 16'hFF |-> b[3]);", "b:port:32 data:port:16 hFF:port:1"),
        ("a1: assert property (@(posedge clk) ##DLY ok(a) && MAX_1 && m[i][j]);", "DLY:parameter:1:constant MAX_1:parameter:1 a:port:1 i:port:1 j:port:1 m:array:1 ok:function:1"),
        ("assert property (@(posedge CKX) $past(q) |-> CKX && Q);", "CKX:port:1 Q:port:1 q:port:1"),
        ("assert property (@(negedge mem) mem[a][b] && ##go(x) 1);", "a:port:1 b:port:1 go:function:1:constant mem:port:1 x:port:1"),
        ("", ""),
        (None, ""),
    ],
)
def test_symbols(spark, sva, want):
    shown = lambda s: F.concat_ws(":", s["name"], s["role"], s["width"].cast("string"), F.when(s["constant"], F.lit("constant")))
    got = one(spark, F.array_join(F.transform(modules.symbols("sva"), shown), " "), sva=sva)
    # a literal's letter and digits count as a word, but for those of a stand-in context
    assert " ".join(x for x in got.split() if not re.match(r"[dbh]\d+:", x)) == want


def test_unit_to_lint(spark):
    got = one(spark, modules.check_unit("sva", "ref"), sva=" c: assert property (@(posedge clk) a |-> ##N f(MAX, g[1][i])); ", ref="assert property (@(posedge clk) other);")
    assert got == (
        "module sva_check (\n    input logic clk,\n    input logic tb_reset,\n    input logic [31:0] a,\n    input logic [31:0] i,\n    input logic [31:0] other,\n    input logic [31:0][31:0][31:0] g\n);\n"
        "  parameter logic [31:0] MAX = 32'd4;\n  parameter logic [31:0] N = 32'd4;\n"
        f"  function automatic logic [31:0] f(\n{ARGUMENTS}    return 32'd0;\n  endfunction\n"
        "  c: assert property (@(posedge clk) a |-> ##N f(MAX, g[1][i]));\nendmodule\n"
    )
    assert one(spark, modules.check_unit("sva", "ref"), sva=None, ref=None) == "module sva_check (\n    input logic clk,\n    input logic tb_reset\n);\n  \nendmodule\n"


def test_bound_checker(spark):
    rtl = "\n// top\nmodule dut(input clk);\nendmodule  \n"
    got = one(spark, modules.bind_unit("sva", "ref", "rtl"), sva="assert property (@(posedge clk) N);", ref="f(a)", rtl=rtl)
    assert got == rtl.strip() + "\n\nmodule sva_check (\n    input logic clk,\n    input logic tb_reset,\n    input logic [31:0] N,\n    input logic [31:0] a,\n    input logic [31:0] f\n);\n  assert property (@(posedge clk) N);\nendmodule\n"
    for none in ("", None, "x module m; endmodule", "module m;"):
        assert one(spark, modules.bind_unit("sva", "ref", "rtl") == modules.check_unit("sva", "ref"), sva="assert property (a);", ref="", rtl=none)


def test_bench(spark):
    got = one(spark, modules.dynamic_bench("sva", "ref", 50), sva="x: assert property (@(posedge clk) a |-> f(b)) ;;", ref="  assert property (@(posedge clk) a |-> arr[0][1]);")
    assert "  logic [31:0] a;\n  logic [31:0] b;\n  logic [31:0][31:0][31:0] arr;\n" in got and "    return $urandom();\n  endfunction\n\n  always #5" in got
    assert "property p_ref; @(posedge clk) a |-> arr[0][1]; endproperty\n  property p_gen; @(posedge clk) a |-> f(b); endproperty" in got
    assert "repeat(50) @(posedge clk) begin\n      a <= $urandom_range(0, 1);\n      b <= $urandom_range(0, 1);\n      n_cycles++;" in got
    assert "{" not in got.replace("{ref}", "?")
    assert one(spark, modules.dynamic_bench("sva", "ref"), sva="assert property ( );", ref="a") is None and one(spark, modules.dynamic_bench("sva", "ref"), sva=None, ref="a") is None
    assert "begin\n      ;\n      n_cycles++;" in one(spark, modules.dynamic_bench("sva", "ref"), sva="1 |-> 1", ref="1")


@pytest.mark.parametrize(("log", "want"), [("AGREEMENT 200 0 0", 1.0), ("x\nAGREEMENT 200 10 5\n", 0.5), ("AGREEMENT 200 7 7", 1.0), ("AGREEMENT 0 1 2", None), ("failed", None), (None, None)])
def test_bench_agreement(spark, log, want):
    assert one(spark, modules.bench_agreement("log"), log=log) == want


def test_stand_in_context(spark):
    sva = "assert property (@(posedge ck) disable iff (rst_n) top.st == 3'b010 |-> bus[7:0] && Rdy == 1'b1 && clock);"
    assert one(spark, modules.context("sva"), sva=sva) == (
        "module synth_top (\n    input logic ck,\n    input logic reset,\n    input logic Rdy,\n    input logic [31:0] bus,\n    input logic top\n);\n"
        "    wire tb_reset;\n    assign tb_reset = (reset == 1'b1);\nendmodule\n"
    )
    wide = one(spark, modules.context("sva"), sva="assert property (@(posedge clk) count == 12'd9);")
    assert "    input logic [11:0] count\n" in wide  # a width that is lost shows here


def test_reshaped_rows(spark):
    own = "module m; wire tb_reset; endmodule"
    rows = [("i1", "text", "assert property (@(posedge c) x == 4'd1);", own, 4, "", "w"), ("i2", None, "assert property (y);", None, 3, "h", None), (None, None, None, "module m; endmodule", None, None, None)]
    df = spark.createDataFrame(rows, "id string, nl string, reference_sva string, rtl_context string, expected_tcl int, hash_canon string, temporal_class string")
    a, b, c = schemas.reshaped(df).collect()
    assert (a.rtl_context, a.clk, a.signals, len(a.hash), a.reset, a.reset_polarity, a.split) == (own, "c", ["x"], 16, "reset", True, "train")
    assert b.hash == "h" and b.clk == "clk" and "input logic y\n" in b.rtl_context and c.signals == [] and c.rtl_context.startswith("module synth_top")
