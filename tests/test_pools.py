"""Variants, resets, reports and sides of a pool, on small golden rows."""

import pytest
from pyspark.sql import functions as F

from assertlake.functions import prompts, resets, variants
from assertlake.operators import bundles, evaluate, splits


def test_variants_and_their_wording(spark):
    rows = [("s1", "It holds in the next  cycle.", "assert property (@(posedge c) a |-> ##2 b);"), ("s2", "Stays always", "assert property (a |=> b)"), ("s3", "Live, not used", "assert property (a |-> s_eventually b);"), ("s4", None, "a |-> ;"), ("s5", "no implication", "assert property (a);"), ("s6", "x", None)]
    df = spark.createDataFrame(rows, "id string, nl string, sva string")
    got = {(r.id, r.v.tag): (r.v.level, r.v.sva, r.v.nl) for r in df.select("id", F.explode(variants.variants("sva", "nl")).alias("v")).collect()}
    assert {k[0] for k in got} == {"s1", "s2"}
    left = "assert property (@(posedge c) a"
    assert got["s1", "range_1_3"] == (3, f"{left} ##[1:3] ##2 b);", "It holds in the within 1 to 3 cycles.")
    assert got["s1", "lift_fixed_to_range"] == (3, f"{left} ##[2:4] b);", "It holds in the within a bounded cycle window.")
    assert got["s1", "lift_fixed_to_open_range"][1] == f"{left} ##[2:$] b);" and ("s2", "lift_fixed_to_range") not in got
    assert got["s1", "until_with"] == (5, f"{left} |-> ({left}) until_with (##2 b));", "It holds in the must remain true until the terminating condition holds.")
    assert got["s2", "eventually"] == (5, "assert property (a |-> s_eventually (b))", "Stays eventually")
    assert got["s2", "range_0_1"][2] == "Stays always The consequent should hold within 0 to 1 cycles." and len(got) == 11 + 9


def test_expanded_rows_come_once(spark):
    rows = [(k, f"id{k}", "a long description", "assert property (a |-> b);", "rtl", "src", None) for k in (2, 1, 3)] + [(4, "short", "tiny", "assert property (c |-> d);", None, None, "h")]
    df = spark.createDataFrame(rows, "n int, id string, nl string, reference_sva string, rtl_context string, source string, hash string")
    got = variants.expanded(df, "n").collect()
    assert len(got) == 9 and {r.parent_id for r in got} == {"id1"} and len({r.hash for r in got}) == 9
    assert all(r.id == f"synthetic_l{r.expected_tcl}_{r.transform.split('_', 3)[3]}_{r.hash}" and len(r.parent_hash) == 16 for r in got)


@pytest.mark.parametrize(
    ("sva", "rtl", "want"),
    [
        ("assert property (disable iff (rst) a);", "module m;\n  \nendmodule", ("rewritten", "assert property (disable iff (tb_reset) a);", "module m;\n    wire tb_reset;\n    assign tb_reset = (rst);\nendmodule", ["rst"])),
        ("x disable  iff ( !(r_n) || (s && t) ) y", "endmodule endmodule x", ("rewritten", "x disable iff (tb_reset) y", "endmodule\n    wire tb_reset;\n    assign tb_reset = (!(r_n) || (s && t));\nendmodule x", ["!(r_n) || (s && t)"])),
        ("disable iff (a) x; DISABLE IFF (b) y; disable iff (tb_reset)", "no end", ("multi_distinct", "disable iff (tb_reset) x; disable iff (tb_reset) y; disable iff (tb_reset)", "no end", ["a", "b"])),
        ("disable iff (a) x; disable iff (a) y", "tb_reset endmodule", ("rewritten", "disable iff (tb_reset) x; disable iff (tb_reset) y", "tb_reset endmodule", ["a", "a"])),
        ("disable iff (tb_reset) x", "endmodule", ("already_canonical", "disable iff (tb_reset) x", "endmodule", [])),
        ("disable iff (a) x; disable iff (b", "endmodule", ("malformed", "disable iff (a) x; disable iff (b", "endmodule", [])),
        ("assert property (a);", None, ("no_disable_iff", "assert property (a);", None, [])),
        ("  ", "r", ("no_disable_iff", "  ", "r", [])),
        (None, None, ("no_disable_iff", None, None, [])),
        ("disable iff (a) x", None, ("rewritten", "disable iff (tb_reset) x", "", ["a"])),
    ],
)
def test_one_reset_name(spark, sva, rtl, want):
    df = spark.createDataFrame([(sva, rtl)] * 2, "reference_sva string, rtl_context string")
    for r in resets.normalised_rows(df).collect():
        assert (r.status, r.reference_sva, r.rtl_context, r.reset_exprs) == want and r.reset_expr == (want[3][0] if want[3] else None)


def test_level_report(spark):
    rows = spark.createDataFrame([(2, 2, True, True), (2, 4, True, None), (2, 5, False, True), (None, 1, True, False)], "want int, got int, ok boolean, same boolean")
    got = {r.level: r for r in evaluate.level_report(rows.where("want is not null"), "want", "got", F.col("ok"), F.col("same")).collect()}
    assert tuple(got[2])[1:] == (3, 2, 1, 2, 0.6667, 0.3333, 0.6667, 1.0, 1.0) and tuple(got[None])[1:] == tuple(got[2])[1:]


def test_sides(spark):
    rows = spark.createDataFrame([(["m1"], "x"), (["m1", "h"], "x"), ([], None), (None, "y")], "provenance array<string>, c string")
    sides = splits.by_provenance(rows, ["m1", "m2"])
    assert sorted(r.side for r in sides.collect()) == ["real", "real", "real", "synthetic"]
    assert sorted((r.side, str(r.column), str(r.value), r.n) for r in splits.side_report(sides, ["c"]).collect()) == [
        ("real", "None", "None", 3), ("real", "c", "None", 1), ("real", "c", "x", 1), ("real", "c", "y", 1), ("synthetic", "None", "None", 1), ("synthetic", "c", "x", 1),
    ]


def test_roots_and_bundles(spark):
    files = {
        "/d/repos/r1/p/b_pkg.sv": "package b;\n  `include \"x.svh\"\nendpackage", "/d/repos/r1/a_pkg.sv": "package a; endpackage", "/d/repos/r1/z_pkg.svh": "zz", "/d/repos/r1/bus_if.sv": "interface bus; endinterface",
        "/d/repos/r1/src/top.sv": "module top; endmodule", "/d/repos/r1/src/sub.sv": "module sub; endmodule", "/d/repos/r1/src/defs.svh": "`define X", "/d/repos/r2/only.sv": "module only; endmodule", "/else/x.sv": "module x; endmodule",
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    rooted = bundles.rooted(df, spark.createDataFrame([("/d/repos/",), ("/none",)], "path string"))
    assert {r.path: r.root for r in rooted.collect()} == {p: "/".join(p.split("/")[:4]) if p.startswith("/d/repos") else None for p in files}
    got = {r.path: r.bundle for r in bundles.bundled(df.select("path"), rooted).collect()}
    packages = "// === PKG: a_pkg.sv ===\npackage a; endpackage\n// === PKG: b_pkg.sv ===\npackage b;\n\nendpackage\n// === PKG: z_pkg.svh ===\nzz\n// === IF: bus_if.sv ===\ninterface bus; endinterface\n"
    assert got["/d/repos/r1/src/top.sv"] == packages + "// === SIB: sub.sv ===\nmodule sub; endmodule\n// === SIB: defs.svh ===\n`define X\n"
    assert got["/d/repos/r2/only.sv"] == "\n" and got["/else/x.sv"] == "\n"


def test_roots_of_few_and_of_many_containers(spark, monkeypatch):
    """Few containers: no path is sorted, grouped or shuffled. Many of them: the same roots."""
    deep = "/d/repos/r" + "/x" * bundles.LEVELS
    paths = ["/d/repos/r1/a/f.sv", "/d/repos/r1/a/f.sv", "/d/snap/x/r2/verified/b/f.sv", "/d/snap/f.sv", "/verified", "f.sv", "", None, "/d/repos/", "r/verified/d/repos/f.sv", deep, deep[:-2], "/top/f.sv"]
    want = ["/d/repos/r1", "/d/repos/r1", "/d/snap/x/r2/verified", None, "/verified", None, None, None, "/d/repos/", "r/verified", None, "/d/repos/r", None]
    files = spark.createDataFrame([(p, i, i) for i, p in enumerate(paths)], "path string, UP int, parts int")
    held = spark.createDataFrame([("/d/repos",), ("/d/repos//",), ("/d/snap/x/",), ("d/repos",), (None,)], "path string")
    df = bundles.rooted(files, held, ["verified"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "Sort" not in plan
    got = sorted(df.collect(), key=lambda r: r.UP)
    assert [r.root for r in got] == want and [r.path for r in got] == paths and df.columns == ["path", "UP", "parts", "root"]
    assert all(r.root is None for r in bundles.rooted(files, held.limit(0)).collect())
    monkeypatch.setattr(bundles, "FEW", 2)
    assert sorted(bundles.rooted(files, held, ["verified"]).collect(), key=lambda r: r.UP) == got


def test_bundles_end_at_the_first_package_over_the_bound(spark, monkeypatch):
    monkeypatch.setattr(bundles, "PACKAGE_CHARS", 25)
    monkeypatch.setattr(bundles, "PACKAGES", 3)
    rows = [(f"/r/{n}_pkg.sv", "/r", n * 10) for n in "abcde"] + [("/r/big/0_pkg.sv", "/q", "x" * 30), ("/r/big/1_pkg.sv", "/q", "y")]
    got = {r.root: r.preamble for r in bundles.preambles(spark.createDataFrame(rows, "path string, root string, text string")).collect()}
    assert got == {"/r": "// === PKG: a_pkg.sv ===\naaaaaaaaaa\n// === PKG: b_pkg.sv ===\nbbbbbbbbbb"}


def test_training_classes(spark):
    rows = [("1", "a description", "s", 1, None, None), ("2", "a description", "s", 4, "C3", "r"), ("3", "tiny", "s", 1, None, None), ("4", "[COVER x]", "s", 1, None, None), ("5", "a description", "s", 9, "", None), (None, "a description", None, None, "C2", None)]
    df = spark.createDataFrame(rows, "id string, nl string, reference_sva string, expected_tcl int, temporal_class string, rtl_context string")
    assert sorted((r["class"], r.id, r.rtl_context) for r in prompts.by_class(df).collect()) == [("C1", "1", ""), ("C2", "", ""), ("C3", "2", "r")]
    assert tuple(prompts.class_report(df).first()) == (6, 1, 1, {"C1": 1, "C2": 1, "C3": 1})
