"""Golden texts of keys, classifiers, parsers, rewriting and rewards."""

import hashlib
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assertlake.functions import classify, describe, keys, parse, predicates, rewards, rewrite, scanner
from assertlake.operators import evaluate, extract

LEVELS = [
    ("assert property (@(posedge clk) valid);", 1),
    ("assert property (@(posedge clk) $rose(a) && $stable(b));", 1),
    ("assert property (@(posedge clk) a ##3 b);", 2),
    ("assert property (@(posedge clk) a[*4]);", 2),
    ("assert property (@(posedge clk) a[->2]);", 2),
    ("assert property (@(posedge clk) a ##[1:5] b);", 3),
    ("assert property (@(posedge clk) a[*1:$]);", 3),
    ("assert property (@(posedge clk) a |-> b);", 4),
    ("assert property (@(posedge clk) a |=> ##[1:2] b);", 4),
    ("assert property (@(posedge clk) a THROUGHOUT b);", 4),
    ("assert property (@(posedge clk) a |-> s_eventually b);", 5),
    ("assert property (@(posedge clk) strong (a ##1 b));", 5),
    ("assert property (@(posedge clk) a /* |-> s_eventually */ == b); // ##2", 1),
]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_levels(spark):
    rows = spark.createDataFrame(LEVELS, "sva string, want int").select("want", classify.level("sva").alias("got"), classify.matched("sva")["level"].alias("by_match")).collect()
    assert all(r.want == r.got == r.by_match for r in rows)


def test_reasons(spark):
    r = one(spark, classify.reason(F.lit("a |-> b")), classify.reason(F.lit("a"), True), classify.reason(F.lit("a ##  2 b"), True))
    assert r[0] == "matched '|->' at level 4" and r[1] == "no temporal operators found (pure combinational)" and r[2].endswith("level 2 (SingleFixedDelay)")


def test_keys_equal_digests(spark):
    s = "  Assert\t property (a)\n;  "
    flat = " ".join(s.split())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
    r = one(spark, keys.body_hash(F.lit(s)), keys.body_hash_ci(F.lit(s)), keys.canon_hash(F.lit(s)), keys.canon_hash(F.lit(" ")), keys.sample_hash(F.lit(" n "), F.lit(" s ")), keys.bucket(F.lit("ffffffffffffffff")))
    assert tuple(r) == (sha(flat), sha(flat.lower()), hashlib.md5("".join(s.split()).lower().encode()).hexdigest()[:16], "", sha("n|||s"), int("ffffffffffffffff", 16) % 1000)


def test_row_hash_is_of_sorted_json(spark):
    import json

    df = spark.createDataFrame([("", 'a "q" \n', "r", "s")], "hash string, nl string, rtl string, sva string")
    want = hashlib.sha256(json.dumps({"nl": 'a "q" \n', "sva": "s", "rtl": "r"}, sort_keys=True).encode()).hexdigest()[:16]
    assert df.select(keys.row_hash(["hash"], "nl", "rtl", "sva")).first()[0] == want
    assert df.withColumn("hash", F.lit("known")).select(keys.row_hash(["hash"], "nl", "rtl", "sva")).first()[0] == "known"


def test_parse_and_syntax(spark):
    p = one(spark, parse.parsed(F.lit("assert property p_x (@(posedge clk) disable iff (rst) req |-> s_eventually gnt);")).alias("p")).p
    assert (p.bound, p.property_name, p.clock_expr, p.disable_iff, p.temporal_operators) == ("assert", "p_x", "posedge clk", "rst", ["s_eventually", "|->"])
    assert p.body == "disable iff (rst) req |-> s_eventually gnt"
    checks = {"assert property (@(posedge clk) a |-> b);": 0, "assert property (@(posedge clk) a |-> );": 0, "assert property (@(posedge clk) a": 2, "a |-> ;": 1, ")(": 3}
    for s, n in checks.items():
        got = one(spark, parse.syntax(F.lit(s)).alias("x")).x
        assert len(got.issues) == n and got.ok == (n == 0), (s, got)


def test_extraction_of_answers(spark):
    cases = [
        ("```systemverilog\nx: assert property (a);\n```", "cut", "assert property (a);"),
        ("<think>assert property (no);</think>assert  property (b) ;", "cut", "assert  property (b) ;"),
        ("first <think> assert property (c);", "cut", "first"),
        ("a <think> x </think> assert property (d); <think> y", "tail", "assert property (d);"),
        ("one line\nsecond", "keep", "one line"),
        ("", "cut", ""),
    ]
    for s, how, want in cases:
        assert one(spark, parse.extracted_sva(F.lit(s), how))[0] == want, s


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], last if x == y else 1 + min(d[j], d[j - 1], last)
    return d[-1]


def test_token_similarity_is_token_edit_distance(spark):
    import re

    pairs = [("a |-> b", "a |=> b"), ("assert property (x ##2 y);", "assert property (x ##[1:2] y || z);"), ("", "a"), ("same", "same"), ("a b c d", "d c b a")]
    for a, b in pairs:
        x, y = re.findall(parse.TOKEN, a), re.findall(parse.TOKEN, b)
        want = max(0.0, 1 - edit_distance(x, y) / max(len(x), len(y))) if x and y else 0.0
        assert math.isclose(one(spark, parse.token_similarity(F.lit(a), F.lit(b)))[0], want)


@pytest.mark.parametrize(
    "sva, pattern, tcl",
    [
        ("assert property (@(posedge core_clk) fifo_full |=> !push);", "implies_next", 4),
        ("lab: assert property (@(posedge clk) (state == 2'b01) |-> (next != state));", "implies_same", 4),
        ("assert property (@(posedge clk) disable iff (clear) start |-> ##7 done);", "implies_fixed_delay", 2),
        ("assume property (@(posedge clk) start |-> ##[2:6] done);", "implies_ranged_delay", 3),
        ("assert property (@(posedge clk) $onehot(sel) || idle);", "combinational", 1),
        ("assert property (@(posedge clk) start |-> s_eventually done);", None, 5),
        ("assert property (@(posedge clk) $fell(stall) |-> $stable(data) && valid);", "implies_same", 4),
        ("assert property (@(posedge clk) head ##2 body ##1 tail |=> crc);", "seq_implies_next", 4),
        ("assert property (@(posedge clk) head ##[0:4] tail |-> crc);", None, 4),
        ("assign x = y;", None, 0),
    ],
)
def test_lowering(sva, pattern, tcl):
    r = rewrite.lowered(sva)
    assert (r.pattern, r.tcl, r.ok) == (pattern, tcl, pattern is not None)
    assert bool(r.lowered) == r.ok and (r.ok or r.notes)


def test_lowering_within_a_bound_and_delays():
    assert rewrite.lowered("assert property (@(posedge clk) s_eventually done);", bound=4).pattern == "implies_ranged_delay"
    text = rewrite.lowered("assert property (@(posedge clk) disable iff (r) a |-> ##2 b);").lowered
    assert text.count("logic svlow_a_d") == 2 and "!(svlow_a_d2) || (b)" in text and "svlow_inited && !(r)" in text
    assert "svlow_seq0_d3 " in rewrite.lowered("assert property (@(posedge c) a ##1 b ##2 d |-> e);").lowered.replace(";", " ;").replace(" <=", " ")


@pytest.mark.parametrize(
    "sva, want",
    [
        ('assert property (`X.y[0].z |-> s_eventually (a)) else $error("x");', "assert property (@(posedge clk) X_y_z |-> ##1 (a));"),
        ("assert property (@(posedge clk) a |-> (assert property (@(posedge clk) disable iff (r) a) until_with b));", "assert property (@(posedge clk) a |-> (a ##1 b));"),
        ("assert property (@(posedge clk) a) hits = 1;", "assert property (@(posedge clk) a);"),
        ("assert property (@(posedge clk) pkg::a ##[2:$] b[*1:3]);", "assert property (@(posedge clk) a ##2 b[*1]);"),
        ("assert property (@(posedge clk) a));", "assert property (@(posedge clk) a);"),
        ("", ""),
    ],
)
def test_normalisation(sva, want):
    assert rewrite.normalised(sva) == want
    assert rewrite.normalised(want) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab()[];|->=# \n/*property assert", max_size=60))
def test_rewriting_never_fails(s):
    assert isinstance(rewrite.normalised(s), str) and rewrite.lowered(s) is not None
    assert set(describe.clause(s)) == set(describe.CLAUSES.names) and rewrite.swapped(s) is not None
    assert "".join(c for c in s if c == "(").count("(") == sum(c == "(" for _, c, _ in scanner.depths(s))


VACUITY = {
    "assert property (@(posedge clk) true);": "body is constant true",
    "assert property (@(posedge clk) disable iff (clear) ((1'd1)));": "body is constant true",
    "cover property (@(negedge clk) (start |=> '1));": "|=> RHS is constant true",
    "assert property (@(posedge clk) start |-> ##12 ( 1 ));": "##N RHS is constant true",
    "assert property (@(posedge clk) ! 1'h0);": "body is !0 (always true)",
    "assert property (@(posedge clk) 1'b1 || busy);": "OR with true-literal (always true)",
    "assert property (@(posedge clk) start |-> ##12 done);": "",
    "assert property (@(posedge clk) busy == 1);": "",
    "assert property (@(posedge clk) start |-> (1) && done);": "",
    "1'b1": "body is constant true",
    "((1)": "",
    "": "",
}


def test_vacuity(spark):
    rows = spark.createDataFrame([(s,) for s in VACUITY], "sva string").select("sva", rewrite.vacuity("sva").alias("why")).collect()
    assert {r.sva: r.why for r in rows} == VACUITY


def test_mutations_change_what_they_can(spark):
    s = "assert property (@(posedge clk) disable iff (r) (a == b) |-> ##2 c);"
    assert rewrite.swapped(s) == "assert property (@(posedge clk) disable iff (r) c |-> (a == b));"
    rows = spark.createDataFrame([(x, k) for x in (s, "plain", "x ##9 y && z != q") for k in rewrite.MUTATIONS], "sva string, kind string")
    got = {(r.sva, r.kind): r.m for r in rows.select("*", rewrite.mutate("sva", "kind").alias("m")).collect()}
    assert got[s, "flip"] == s.replace("==", "!=") and got[s, "delay"] == s.replace("|->", "|=>") and got[s, "swap"] == rewrite.swapped(s)
    assert got["x ##9 y && z != q", "flip"] == "x ##9 y && z == q" and got["x ##9 y && z != q", "delay"] == "x ##10 y && z != q"
    assert all(got["plain", k] == "plain" for k in ("swap", "flip", "delay"))
    levels = {k for k, _ in rewrite.expanded("assert property (@(posedge clk) a |-> b);")}
    assert len(levels) == 9 and rewrite.expanded("assert property (a);") == []


def test_resets_are_idempotent(spark):
    reset = lambda *x: one(spark, rewrite.reset_expression(*map(F.lit, x)))[0]
    assert reset("input rst_n", "", "") == "!rst_n" and reset("x", "", "disable iff (q) a") == "q" and reset("x", "", "") is None and reset("assign rst_int = r;", "", "") == "rst_int"
    once = rewrite.with_disable("assert property (@(posedge clk) a);")
    assert rewrite.with_disable(once) == once
    rtl = rewrite.with_reset_alias("module m(input r);\nendmodule", "r")
    assert rewrite.with_reset_alias(rtl, "r") == rtl and "assign tb_reset = r;" in rtl
    both = rewrite.injected("module m(input clk_i);\n a1: assert property (x);\nendmodule", "FRAGMENT")
    assert "a1" not in both and "wire clk = clk_i;" in both and both.rstrip().endswith("endmodule") and rewrite.injected("x", "y") is None
    assert rewrite.module_clock("module m(input my_ck, input aclk);") == "aclk" and rewrite.module_clock("module m(input my_ck);") == "my_ck" and rewrite.module_clock("none") is None


DESCRIPTIONS = {
    "assert property (@(posedge clk) fetch |=> !stall);": "when fetch, stall is low must hold in the next cycle. Use signals clk, fetch, stall.",
    "cover property (@(posedge clk) lead ##1 tail);": "Cover the case where the sequence lead ##1 tail occurs with a cycle delay. Use signals clk, lead, tail.",
    "p_no_loss: assert property (disable iff (clear) $rose(push) |-> ##3 count >= 1);": "when push rises, ##3 count is at least 1 must hold after 3 cycles. Evaluation stops when clear This corresponds to no loss. Use signals clear, push, count.",
    "assume property (check_order(a, b));": "Assume the order condition holds for a, b. Use signals check_order, a, b.",
    " ": "",
}


def test_descriptions(spark):
    rows = spark.createDataFrame([(s,) for s in DESCRIPTIONS], "sva string").select("sva", describe.describe("sva").alias("nl")).collect()
    assert {r.sva: r.nl for r in rows} == DESCRIPTIONS


def test_extractors():
    text = "module top(input clk);\n// req leads to gnt\n// at once\na: assert property (@(posedge clk) req |-> gnt) else $error;\nproperty p; @(posedge clk) x ##1 y; endproperty\nassert property (p);\n`ASSERT(Foo_A, a |-> b, clk, !rst)\nendmodule\n"
    source = extract.Source(text)
    rows = list(source.finds(tuple(extract.READERS)))
    assert [r[0] for r in rows] == ["inline", "named", "macro"]
    assert rows[0][3] == "req leads to gnt at once" and rows[0][4] == "top" and rows[0][5] == 4 and rows[0][6] is None
    assert rows[1][2] == "assert property (@(posedge clk) x ##1 y);"
    assert rows[2][2] == "Foo_A: assert property (@(posedge clk) disable iff ((!rst) !== '0) (a |-> b));"
    assert extract.expanded_macro("ASSERT_KNOWN", ["n", "s"]).endswith("(!$isunknown(s)));") and extract.expanded_macro("ASSERT", ["n"]) is None
    assert source.block_around(text.find("ASSERT("))[1] == "module" and source.window_around(4, most=10) == "module top"
    far = extract.Source("x\n" * 9 + "assert property (a |-> b)" + " " * 170 + ";", extract.WITH_SOURCE)
    (row,) = far.finds(("inline",))
    assert row[2] == "assert property (a |-> b) ;" and row[5] == 10 and row[6].split("\n")[0] == "x" and len(row[6].split("\n")) == 6


def test_predicates(spark):
    r = one(spark, predicates.real_nl(F.lit("[ASSERT] some thing")), predicates.real_nl(F.lit("// a comment that is long"), "industrial"), predicates.nl_verdict(F.lit('"Create a SVA assertion that checks: a |-> b"')), predicates.nl_verdict(F.lit("hello")), predicates.licence(F.lit("Licensed under the Apache License, Version 2.0")), predicates.repo_label(F.lit("/x/own__name__x.tar.gz")))
    assert tuple(r) == (False, False, "sva_token_leak", "missing_prefix", "Apache-2.0", "own/name__x")


def test_rewards(spark):
    yes, no = F.lit(True), F.lit(False)
    e = lambda v, syn=yes, has=yes: rewards.equivalence(F.lit(v), syn, has)
    r = one(spark, e("EQUIVALENT"), e("IMPLIES_REF_TO_LM"), e("IMPLIES_LM_TO_REF"), e("UNSUPPORTED"), e("EQUIVALENT", no), rewards.formal(F.lit("UNKNOWN")), rewards.formal(F.lit("UNSUPPORTED")), rewards.agreement(F.lit(10), F.lit(0), F.lit(0)), rewards.agreement(F.lit(10), F.lit(2), F.lit(4)), rewards.combined(yes, F.lit("PASS"), no, F.lit(1.0)), rewards.best_reference(F.array(F.lit("NOT_EQUIVALENT"), F.lit("IMPLIES_LM_TO_REF")), yes, yes))
    assert list(r) == [1.0, 0.6, 0.4, 0.15, 0.0, 0.5, None, 1.0, 0.5, 1.0, 0.4]
    assert one(spark, rewards.log_status(F.lit("x\nERROR: syntax error; engine_0 (smtbmc z3) returned PASS")))[0] == "PARSE_ERROR"


def test_pass_at_k_closed_form(spark):
    cases = [(n, c, k) for n in range(1, 9) for c in range(n + 1) for k in range(1, 10)]
    want = lambda n, c, k: 0.0 if c <= 0 else 1.0 if k >= n or n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
    rows = spark.createDataFrame(cases, "n int, c int, k int").select("n", "c", "k", evaluate.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).collect()
    assert all(math.isclose(r.p, want(r.n, r.c, r.k), abs_tol=1e-12) for r in rows)


def test_loss(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 0.5], 1, 3.0), ([0.0, 0.0, 0.0], 2, 1.0), ([5.0, 1.0, 1.0], -100, 3.0)], "z array<double>, y int, w double")
    ce = [math.log(sum(math.exp(v) for v in z)) - z[y] for z, y in (([1.0, 2.0, 0.5], 1), ([0.0] * 3, 2))]
    got = rows.select("w", "y", evaluate.cross_entropy(F.col("z"), F.col("y")).alias("ce")).agg(evaluate.weighted_loss(F.col("ce"), F.col("w"), F.col("y")), evaluate.weighted_loss(F.col("ce"), F.lit(1.0), F.col("y"))).first()
    assert math.isclose(got[0], (3 * ce[0] + ce[1]) / 2, rel_tol=1e-9) and math.isclose(got[1], sum(ce) / 2, rel_tol=1e-9)


def test_prompts(spark):
    from assertlake.functions import prompts

    r = one(spark, prompts.user_prompt(F.lit("Create an SVA that x"), F.lit(" "), "End"), prompts.user_prompt(F.lit("x"), F.lit("y" * 5000), "End"), prompts.equivalence_metrics(F.lit("it implies")), F.size(prompts.compile_errors(F.lit("a\nError-[X] b"))))
    assert r[0] == "Question: Create an SVA that x\n\nEnd" and "[truncated]" in r[1] and "checks: x" in r[1] and tuple(r[2]) == (1.0, 0.0, 1.0) and r[3] == 1
    rows = spark.createDataFrame([("g", "s", "rising", "delayed", 3, 5, 2), ("g", "a", "falling", "missing", 1, None, None)], "g string, signal string, kind string, violation string, cycle int, matched int, delta int")
    text = prompts.violation_text(rows, "g").first().text.split("\n")
    assert "'a'" in text[0] and "no matching" in text[0] and "2 cycle(s) LATE (actual cycle 5)" in text[1]
