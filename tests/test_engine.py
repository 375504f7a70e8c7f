"""Sources, sinks, providers, streams and operators on small inputs."""

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from assertlake import schemas
from assertlake.operators import curate, evaluate, extract, provider, splits
from assertlake.sources import readers, sinks
from assertlake.streaming import incremental


def test_jsonl_keeps_broken_records_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "sva": "assert property (@(posedge clk) a |-> b);", "tcl": 3}\n\nnot json\n{"id": "2", "gold_sva": "x"}\n')
    df = readers.jsonl(spark, str(tmp_path / "a.jsonl")).cache()
    assert tuple(readers.malformed(df).first()) == (1, 3)
    rows = schemas.canonical(df, "tag").collect()
    assert [(r.id, r.expected_tcl, r.source) for r in rows] == [("1", 3, "tag")]
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), fatal=True).collect()


def test_csv_wrapped_report_gold_and_tree(spark, tmp_path):
    (tmp_path / "t.csv").write_text('design_name,task_id,prompt,ref_solution,testbench\nd,1,"say, this","lbl: assert property (a);","module m;\nendmodule"\n')
    r = readers.nl2sva(spark, str(tmp_path / "t.csv"), "human", "test").first()
    assert (r.id, r.reference_sva, r.expected_tcl, r.rtl_context) == ("d_1", "assert property (a);", 1, "module m;\nendmodule")
    for i, x in enumerate(([{"a": "1"}], {"tasks": [{"a": "1"}]}, {"assertions": [{"a": "1"}]})):
        (tmp_path / f"w{i}.json").write_text(json.dumps(x))
        assert readers.wrapped(spark, str(tmp_path / f"w{i}.json"), "a: string").first().a == "1"
    (tmp_path / "rep").mkdir()
    (tmp_path / "rep/run.json").write_text(json.dumps({"per_sample": [{"id": "s", "expected_tcl": 2, "evaluable": True, "candidates": [{"sample_idx": 0, "pec_verdict": "EQUIVALENT"}, {"sample_idx": 1}]}]}))
    assert readers.report_candidates(readers.report(spark, str(tmp_path / "rep"))).count() == 2
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.gold").write_text("property p;\n @(posedge c) a;\nendproperty\nother line;\n")
    (tmp_path / "g/b.gold").write_text("# c\nReport x\na && b;\n12.5\n")
    assert sorted((r.kind, r.body) for r in readers.gold(spark, str(tmp_path / "g")).collect()) == [("property", "@(posedge c) a"), ("report", "a && b")]
    (tmp_path / "src/build").mkdir(parents=True)
    for p in ("src/x.sv", "src/y.txt", "src/build/z.sv"):
        (tmp_path / p).write_text("module x; endmodule")
    tree = readers.source_tree(spark, str(tmp_path / "src"))
    assert [r.path.rsplit("/", 1)[1] for r in tree.collect()] == ["x.sv"]
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "src", "src")
    (tmp_path / "bad.tar.gz").write_bytes(b"no archive")
    found = readers.archives(spark, str(tmp_path / "*.tar.gz")).collect()
    assert sorted(r.path for r in found if not r.error) == ["src/build/z.sv", "src/x.sv"] and [r.archive.rsplit("/", 1)[1] for r in found if r.error] == ["bad.tar.gz"]
    assert readers.siblings(tree).first().context.startswith("// === x.sv ===")
    assert {r.tail for r in readers.suffix_index(tree.select(F.lit("a/b/c.sv").alias("path"))).collect()} == {"a/b/c.sv", "b/c.sv", "c.sv"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, 2)], "id int, tcl int")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    sinks.replaced(spark, spark.read.parquet(path).where("id = 2"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]
    sinks.shards(df, str(tmp_path / "s"), ["tcl"])
    assert spark.read.json(str(tmp_path / "s")).where("tcl = 1").count() == 1
    sinks.resumed(df, df.where("id = 1"), "id", str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    m = sinks.manifest(str(tmp_path / "m"), by_tcl=df.groupBy("tcl").count(), all=df.agg(F.count("*").alias("n"))).first().report
    assert json.loads(m["all"]) == [{"n": 2}]
    sinks.registry(df.select(F.col("id").cast("string").alias("k")), "k", str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 2


def test_provider_sees_only_open_requests(spark):
    rows = spark.createDataFrame([("assert property (@(posedge clk) a |-> b);", "assert property (@(posedge clk) a |-> b);"), ("bad", "assert property (@(posedge clk) c);"), ("", "x"), ("assert property (@(posedge clk) q);", "assert property (@(posedge clk) r);")], "lm string, ref string").withColumn("rtl", F.lit("module m; endmodule"))
    asked = spark.sparkContext.accumulator(0)

    def tool(batch):
        asked.add(len(batch))
        return provider.recorded({})(batch)

    req = provider.requests(rows, "lm", "ref", "rtl")
    got = {r.key: r.verdict for r in provider.verdicts(req, tool).collect()}
    assert sorted(got.values()) == ["EMPTY", "EQUIVALENT", "PARSE_ERROR", "UNSUPPORTED"] and asked.value == 2
    cache = spark.createDataFrame([(k, "EQUIVALENT", "", "", 0.0) for k in got], provider.VERDICT)
    asked.value = 0
    assert provider.verdicts(req, tool, cache).where("verdict = 'EQUIVALENT'").count() == 2 and asked.value == 0

    def broken(batch):
        raise ValueError("no tool")

    assert provider.asked(provider.gate(req)[1], broken).where("verdict = 'EXCEPTION:ValueError'").count() == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"k": "a"}\n{"k": "a"}\n{"k": "b"}\n')
    stream = lambda: incremental.files(spark, str(src), "k string")
    run = lambda: incremental.appended(incremental.first_seen(stream(), F.col("k")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (src / "b.json").write_text('{"k": "b"}\n{"k": "c"}\n')
    run()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    seen = []
    for _ in range(2):
        incremental.each_once(stream(), str(tmp_path / "once"), lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 5


def test_early_stop_stream(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    scores = [1.0, 2.0, 1.5, 1.4, 3.0]
    (src / "a.json").write_text("".join(json.dumps({"run": "r", "step": i, "score": s}) + "\n" for i, s in enumerate(scores)))
    out = incremental.early_stop(incremental.files(spark, str(src), "run string, step long, score double"), 2)
    incremental.appended(out, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    rows = {r.step: (r.streak, r.stop) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert rows == {0: (0, False), 1: (0, False), 2: (1, False), 3: (2, True), 4: (0, False)}


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = splits.fraction_split(df, "k", 0.3, 1)
    assert out.where("split = 'head'").count() == 300
    assert splits.sample(df, "k", 17, 2).count() == 17 and splits.sample(df, "k", 5000, 2).count() == 1000
    splits.assert_disjoint(out.where("split = 'head'"), out.where("split = 'tail'"), ["k"])
    with pytest.raises(ValueError):
        splits.assert_disjoint(df, df, ["k"])
    ranks = [r["rank"] for r in splits.with_rank(df, splits.seeded(F.col("k"), 3)).collect()]
    assert sorted(ranks) == list(range(1000))
    assert sorted(r.ordinal for r in curate.numbered(df, ["k"]).collect()) == list(range(1000))


def test_advantages_and_waveforms(spark):
    r = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.5), ("c", 0.2), ("c", 0.2)], "g string, r double")
    got = {(x.g, x.r): (round(x.advantage, 4), x.collapsed) for x in evaluate.advantages(r, "g", "r").collect()}
    assert got == {("a", 1.0): (1.0, False), ("a", 0.0): (-1.0, False), ("b", 0.5): (0.0, True), ("c", 0.2): (0.0, True)}
    wave = spark.createDataFrame([("s", i, v) for i, v in enumerate([0, 1, 1, 0, 2, 3])], "s string, cycle int, v int")
    assert sorted((x.cycle, x.kind) for x in evaluate.transitions(wave, ["s"], "cycle", "v").collect()) == [(1, "rising"), (3, "falling"), (4, "rising"), (5, "change")]
    want = spark.createDataFrame([("s", 5), ("s", 40)], "s string, cycle int")
    found = spark.createDataFrame([("s", 8), ("s", 2), ("s", 29)], "s string, cycle int")
    assert {x.cycle: x.matched for x in curate.closest(want, found, ["s"], "cycle").collect()} == {5: 2, 40: None}


def test_modules_and_bundles(spark):
    files = spark.createDataFrame([("f", "x\nmodule a;\n a\nendmodule\nmodule b;\nendmodule\n")], "path string, text string")
    assert sorted(tuple(r) for r in extract.modules(files).collect()) == [("f", 1, 3, "a"), ("f", 4, 5, "b")]
    parts = spark.createDataFrame([("r", i, "`include \"x\"\n" + "y" * 10) for i in range(5)], "repo string, n int, text string")
    assert extract.bundle(parts, ["n"], most_bytes=60).first().text == "\n".join(["y" * 10] * 2)


def test_files_of_one_path_have_their_own_modules(spark):
    files = spark.createDataFrame([("f", "x\nmodule a;\n a\nendmodule\nmodule b;\nendmodule\n")], "path string, text string")
    same = files.union(spark.createDataFrame([("f", "module c;\nmodule d;\nendmodule"), ("f", None), ("f", "endmodule")], "path string, text string")).repartition(1)  # other files of the same path
    assert sorted(tuple(r) for r in extract.modules(same).collect()) == [("f", 1, 2, "d"), ("f", 1, 3, "a"), ("f", 4, 5, "b")]


def test_two_arms_contexts_and_required(spark, tmp_path):
    from assertlake.functions import rewrite

    text = rewrite.two_arm("module m(input clk, a, b);\nendmodule", "assert property (@(posedge clk) a |=> b);", "assert property (@(posedge clk) a === b);", "rst")
    assert "assume (" in text and "assert (" in text and text.count("!(rst)") == 2 and "===" not in text
    assert rewrite.two_arm("module m;\nendmodule", "assert property (s_eventually a);", "assert property (a);") is None
    df = spark.createDataFrame([("assert property (q);", ""), ("assert property (q);", "module m; endmodule")], "reference_sva string, rtl_context string")
    got = {r.made: r.rtl_context for r in schemas.with_context(df).collect()}
    assert "input logic [31:0] q" in got[True] and got[False] == "module m; endmodule"
    raw = spark.createDataFrame([("n", "a long specification", "assert property (a |-> b);", "module m; endmodule", "clk", "r", True, ["a"]), ("n", "x", "s", "", "c", "r", True, [])], "name string, specification string, sva string, rtl_code string, clk string, reset string, reset_polarity boolean, signals array<string>")
    assert [(r.expected_tcl, r.temporal_class) for r in schemas.hardware_dataset(raw).collect()] == [(4, "C2")]
    look = spark.createDataFrame([(1, "x")], "k int, v string")
    assert curate.required(spark.createDataFrame([(1,)], "k int"), look, "k", ["v"]).first().v == "x"
    with pytest.raises(Exception, match="no row for k"):
        curate.required(spark.createDataFrame([(2,)], "k int"), look, "k", ["v"]).collect()
    sinks.metrics(str(tmp_path / "tsv"))(look, 0)
    sinks.metrics(str(tmp_path / "tsv"))(look, 1)
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 2


def test_every_page_is_a_file(spark, tmp_path):
    """Pages after the first FILES are extracted too, with their group's assertions."""
    from assertlake.plans import text_queries as q

    spark.createDataFrame([(i, 7) for i in range(1, 40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    n = 3 * q.FILES
    spark.createDataFrame([(i, f"u{i}") for i in range(n)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = q.extract_blocks(spark, str(tmp_path)).collect()
    assert {r.path for r in found} == {f"u{i}" for i in range(n)}
    per = lambda k: sorted((r.kind, r.sva) for r in found if r.path == f"u{k}")
    assert all(per(k) == per(k + q.FILES) == per(k + 2 * q.FILES) for k in range(q.FILES))
    assert sorted(r.module for r in q.module_lines(spark, str(tmp_path)).collect()) == sorted(f"m{i}" for i in range(n))


@pytest.mark.parametrize("name", ["normalize_rules", "lower_assertions", "vacuity_reasons", "mutations", "expanded_levels", "descriptions", "reset_handling"])
def test_every_assertion_has_its_results(spark, tmp_path, name):
    """Ids with equal texts have equal rows: the texts repeat after 65 ids."""
    from collections import defaultdict

    from assertlake.plans import registry

    spark.createDataFrame([(i, 7) for i in range(1, 196)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = defaultdict(list)
    for r in registry.QUERIES[name](spark, str(tmp_path)).collect():
        rows[r.id].append(str(r[1:]))
    assert len(rows) % 3 == 0 and (len(rows) == 195 or name == "expanded_levels")
    assert rows and all(sorted(rows[i]) == sorted(rows.get(i % 65 or 65, [])) for i in list(rows))
