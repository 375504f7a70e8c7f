"""Loaders of benchmarks in their own layouts."""

import json

import pytest

from assertlake.sources import benchmarks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tables_with_any_columns(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.csv").write_text('prompt,ref_solution,testbench\n"say, this","lab: assert property (a);","module m;\nendmodule"\nempty,,x\nlast,assert property (b);,\n')
    (tmp_path / "a/b/two.csv").write_text("rtl,extra,assertion,nl\nr1,e,assert property (a |-> ##[1:2] c);,n1\n")
    (tmp_path / "a/b/three.csv").write_text("rtl,extra,assertion,nl\nr2,e,x:assert property (d);,n2\n")
    (tmp_path / "a/none.csv").write_text("nl\nwithout any\n")
    (tmp_path / "a/no.txt").write_text("prompt\n")
    got = benchmarks.load(spark, [("design_tables", f"{tmp_path}/a", "design", "test")])
    assert rows(got, "id", "nl", "reference_sva", "rtl_context", "expected_tcl") == [
        ("one_0", "say, this", "assert property (a);", "module m;\nendmodule", 1), ("one_2", "last", "assert property (b);", "", 1),
        ("three_0", "n2", "assert property (d);", "r2", 1), ("two_0", "n1", "assert property (a |-> ##[1:2] c);", "r1", 4),
    ] and {r.source for r in got.collect()} == {"design"}
    (tmp_path / "void").mkdir()
    assert benchmarks.task_tables(spark, f"{tmp_path}/void").count() == 0


@pytest.mark.parametrize("filtered", [True, False])
def test_gold_files(spark, tmp_path, filtered):
    d = tmp_path / "verified/fam/des"
    d.mkdir(parents=True)
    (d / ("x_filtered.gold" if filtered else "x.gold")).write_text("property a1;\n@(posedge clk) (a) |-> (b);\nendproperty\nassert_a1: assert property(a1);\nproperty a2;\n@(posedge clk) c\nendproperty\n")
    (d / "report.gold").write_text("a && b\n")
    for k in (3, 1, 2, 4):
        (d / f"v{k}.v").write_text(f"module v{k}; endmodule")
    got = benchmarks.load(spark, [("gold_files", f"{tmp_path}/verified", "gold", "test")])
    name = "x_filtered" if filtered else "x"
    want = [(f"fam__des__{name}__0", "assert property (@(posedge clk) (a) |-> (b));"), (f"fam__des__{name}__1", "assert property (@(posedge clk) c);")]
    want += [] if filtered else [("fam__des__report__0", "assert property (@(posedge clk) a && b);")]
    assert rows(got, "id", "reference_sva") == sorted(want)
    assert got.first().rtl_context == "\n".join(f"// === v{k}.v ===\nmodule v{k}; endmodule" for k in (1, 2, 3))


def test_handmade_files(spark, tmp_path):
    (tmp_path / "nl_to_sva.json").write_text(json.dumps([{"sva": "assert property (a);", "description": "d", "rtl": "r"}, {"nl": "no assertion"}, {"id": 7, "assertion": "assert property (b);", "nl": "n"}]))
    (tmp_path / "nl2sva_tasks.json").write_text(json.dumps({"tasks": [], "data": [{"id": "t", "reference_sva": "assert property (c);", "sva": "other"}]}))
    (tmp_path / "sample_svas.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps([{"sva": "assert property (z);"}]))
    got = benchmarks.load(spark, [("handmade", str(tmp_path), "pilot", "train")])
    assert rows(got, "id", "nl", "reference_sva", "rtl_context") == [("nl2sva_tasks.json_t", "", "assert property (c);", ""), ("nl_to_sva.json_0", "d", "assert property (a);", "r"), ("nl_to_sva.json_7", "n", "assert property (b);", "")]


def test_scraped_records(spark, tmp_path):
    lines = [{"sva": " assert property (a); ", "nl_comment": "c", "module": "m", "file": "x/y.sv", "line": 3, "source_repo": "o/r", "macro": "ASSERT", "args": ["A", "b"], "name": "p", "source_snapshot": "s", "strategy": "k:v"}, {"sva": ""}, {"sva": "assert property (b);"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n")
    got = benchmarks.load(spark, [(k, f"{tmp_path}/r.jsonl", k, "train") for k in ("repository", "macro", "named", "snapshot")])
    assert rows(got, "source", "id", "nl", "rtl_context") == [
        ("macro", "?_?_L?_?", "[?]", ""), ("macro", "o_r_x_y.sv_L3_ASSERT", "[ASSERT] A", ""), ("named", "?_?_L?_?", "", ""), ("named", "o_r_x_y.sv_L3_p", "c", "// module m"),
        ("repository", "?_?_L?", "", ""), ("repository", "o_r_x_y.sv_L3", "c", "// module m"), ("snapshot", "?_?_?_L?", "", ""), ("snapshot", "s_k_v_x_y.sv_L3", "c", "// module m"),
    ]
    with pytest.raises(KeyError, match="no loader for odd"):
        benchmarks.load(spark, [("odd", "/nowhere", "x", "y")])
