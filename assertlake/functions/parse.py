"""Structure out of assertions and of model output. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assertlake.functions.classify import level_fallback
from assertlake.functions.keys import body_hash_ci, let, squeezed, strip, text, uncommented

_RANGE = r"\d+\s*:\s*(?:\d+|\$)"
#: Temporal operators in the order of report; fixed values.
OPERATORS = (
    (r"(?i)\bs_eventually\b", "s_eventually"), (r"(?i)\bs_until\b", "s_until"), (r"(?i)\bs_always\b", "s_always"), (r"(?i)\buntil_with\b", "until_with"),
    (r"(?i)\bstrong\s*\(", "strong"), (r"\|->", "|->"), (r"\|=>", "|=>"), (r"(?i)\bthroughout\b", "throughout"), (r"(?i)\bwithin\b", "within"),
    (r"(?i)\bintersect\b", "intersect"), (r"(?i)\bfirst_match\b", "first_match"), (rf"##\s*\[\s*{_RANGE}\s*\]", "##[a:b]"),
    (rf"\[\s*\*\s*{_RANGE}\s*\]", "[*a:b]"), (rf"\[\s*=\s*{_RANGE}\s*\]", "[=a:b]"), (rf"\[\s*-\s*>\s*{_RANGE}\s*\]", "[->a:b]"), (r"##\s*\d+", "##N"),
    (r"\[\s*\*\s*\d+\s*\]", "[*N]"), (r"\[\s*=\s*\d+\s*\]", "[=N]"), (r"\$rose\b", "$rose"), (r"\$fell\b", "$fell"), (r"\$stable\b", "$stable"), (r"\$past\b", "$past"),
)
KEYWORD = r"(?i)\b(?:assert|cover|assume)\s+property\b|\bproperty\b"


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null without a match."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def operators(c: Column | str) -> Column:
    return let(uncommented(c), _operators)


def _operators(bare: Column) -> Column:
    return F.array_compact(F.array(*(F.when(bare.rlike(p), F.lit(name)) for p, name in OPERATORS)))


def parsed(c: Column | str) -> Column:
    """struct(bound, property_name, clock_expr, disable_iff, body, temporal_operators). Comments are cut once for all of them."""
    return let(uncommented(c), _parsed)


def _parsed(bare: Column) -> Column:
    bound = F.when(bare.rlike(r"(?i)\bcover\b"), "cover").when(bare.rlike(r"(?i)\bassume\b"), "assume").otherwise("assert")
    body = found(bare, r"(?s)@\s*\([^)]+\)\s*(.*?)\s*;?\s*\z")
    return F.struct(
        bound.alias("bound"),
        found(bare, r"(?i)\bproperty\s+(\w+)\s*\(").alias("property_name"),
        found(bare, r"(?i)@\s*\(\s*((?:posedge|negedge)\s+\w+)\s*\)").alias("clock_expr"),
        F.trim(found(bare, r"(?i)disable\s+iff\s*\(([^)]+)\)")).alias("disable_iff"),
        F.trim(F.regexp_replace(F.trim(body), r"[);]+\z", "")).alias("body"),
        _operators(bare).alias("temporal_operators"),
    )


def balanced(x: Column) -> Column:
    """Parentheses close in order: no prefix closes more than it opens, and all close."""
    steps = F.filter(F.split(F.regexp_replace(x, "[^()]", ""), ""), lambda p: p != "")
    end = F.aggregate(steps, F.lit(0), lambda d, p: F.when(d < 0, d).otherwise(d + F.when(p == "(", 1).otherwise(-1)))
    return end == 0


def syntax(c: Column | str) -> Column:
    """struct(ok, issues, warnings) of a heuristic check."""
    bare = uncommented(c)
    issue = [
        (~bare.rlike(KEYWORD), "Missing 'assert property', 'cover property', 'assume property', or 'property' keyword"),
        (~bare.rlike(r"(?m);\s*$"), "Missing trailing semicolon"),
        (~balanced(bare), "Unbalanced parentheses"),
    ]
    for op in ("|->", "|=>"):
        sides = F.split(bare, op.replace("|", r"\|"))
        missing = bare.contains(op) & ((strip(F.get(sides, F.lit(0))) == "") | (strip(F.get(sides, F.lit(1))) == ""))
        issue.append((missing, f"Operator '{op}' appears to be missing antecedent or consequent"))
    warning = [
        (~bare.rlike(r"(?i)@\s*\(\s*(?:posedge|negedge)"), "No clock expression (@posedge/@negedge) detected"),
        (bare.rlike(r"#\s*#"), "Possible typo: '# #' (space in ##)"),
        (bare.rlike(r"\|\s*->"), "Possible typo: '| ->' (space in |->)"),
    ]
    listed = lambda cases: F.array_compact(F.array(*(F.when(k, F.lit(v)) for k, v in cases)))
    issues = listed(issue)
    return F.struct((F.size(issues) == 0).alias("ok"), issues.alias("issues"), listed(warning).alias("warnings"))


THINK = r"(?s)<think>.*?</think>"
FENCE = r"(?s)```(?:systemverilog|sv|verilog)?\s*(.+?)```"


def extracted_sva(c: Column | str, thinking: str = "cut") -> Column:
    """The assertion in a model's answer: of the first fenced block or all, the first `assert property (...);`, else the first line.

    thinking: `keep` leaves <think> parts, `cut` drops closed ones and all from an open one on, `tail` also keeps what follows the last close.
    """
    x = strip(c)
    if thinking != "keep":
        x = F.regexp_replace(x, THINK, "")
        cut = F.substring_index(x, "<think>", 1)
        if thinking == "tail":
            cut = F.when(x.contains("</think>"), F.concat(cut, F.lit("\n"), F.substring_index(x, "</think>", -1))).otherwise(cut)
        x = F.when(x.contains("<think>"), cut).otherwise(x)
        x = strip(x) if thinking == "tail" else x
    x = F.when(x.rlike(FENCE), strip(F.regexp_extract(x, FENCE, 1))).otherwise(x)
    whole = r"(?is)(assert\s+property\s*\(.*?\)\s*;)"
    return F.when(x.rlike(whole), strip(F.regexp_extract(x, whole, 1))).otherwise(strip(F.regexp_extract(x, r"^([^\n\r]*)", 1)))


def first_statement(c: Column | str) -> Column:
    """The first `assert property` up to its semicolon; empty without one."""
    return F.regexp_extract(text(c), r"(?is)(assert\s+property\s*\([^;]*?\)\s*;)", 1)


def chat_record(user: Column | str, assistant: Column | str) -> Column:
    """struct(nl, rtl_context, reference_sva, expected_tcl, hash, reasoning) of a chat turn; null without an assertion in the answer."""
    u, a = text(user), text(assistant)
    sva = strip(F.regexp_extract(a, r"(?s)```systemverilog\s*(.*?)```", 1))
    record = F.struct(
        strip(F.regexp_extract(u, r"(?s)Question:\s*(.*?)(?:You should use|\z)", 1)).alias("nl"),
        strip(F.regexp_extract(u, r"(?s)Here is the testbench[^\n]*\n(.*?)Question:", 1)).alias("rtl_context"),
        sva.alias("reference_sva"),
        level_fallback(sva).alias("expected_tcl"),
        body_hash_ci(sva).alias("hash"),
        strip(F.regexp_extract(a, r"(?s)<think>(.*?)</think>", 1)).alias("reasoning"),
    )
    return F.when((u != "") & a.rlike(r"(?s)```systemverilog\s*.*?```"), record)


def module_names(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(uncommented(c, block_first=True), F.lit(r"\bmodule\s+([A-Za-z_]\w*)"), F.lit(1)))


#: Words that are no signals; fixed values.
SIGNAL_KEYWORDS = (
    "assert assume cover property posedge negedge disable iff if else begin end always always_ff always_comb logic wire reg module endmodule input output and or not "
    "throughout within intersect first_match until until_with s_until s_eventually s_always nexttime strong weak rose fell stable past changed sampled onehot onehot0 "
    "countones isunknown isknown clk tb_reset rst reset rst_n reset_n"
).split()


def signals(c: Column | str) -> Column:
    """Identifiers in the order of their first use, without keywords, literals and hierarchy tails."""
    x = F.regexp_replace(F.regexp_replace(text(c), r"\d+'[bdho][0-9a-fA-FxXzZ_]+|\d+", " "), r"\.[A-Za-z_]\w*", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(x, F.lit(r"[A-Za-z_]\w*"), F.lit(0)), lambda t: ~F.lower(t).isin(SIGNAL_KEYWORDS)))


def without_label(c: Column | str) -> Column:
    """Without a leading `label:` of an assertion."""
    return F.regexp_replace(F.ltrim(text(c)), r"(?i)^[A-Za-z_]\w*\s*:\s*(?=assert|assume|cover|property)", "")


def without_any_label(c: Column | str) -> Column:
    """The benchmark files' form: any word and colon at the start go."""
    return F.regexp_replace(text(c), r"^\s*\w+\s*:\s*", "")


def paraphrases(c: Column | str, k: int) -> Column:
    """The first k usable lines of a generated list."""
    lines = F.split(strip(F.regexp_replace(text(c), THINK, "")), r"\r\n|[\n\r]")
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(x), r"^\s*[-*•]\s*", ""), r"^\s*\d+[.):]\s*", ""), r"^\s*\"*'*`*", ""), r"\"*'*`*\s*\z", ""))
    good = F.filter(F.transform(lines, clean), lambda x: (F.length(x) >= 10) & ~F.lower(x).rlike("^(?:here are|paraphrase|version)"))
    return F.slice(good, 1, k)


def one_line(c: Column | str) -> Column:
    """A generated description: no thinking, no leading name, no quotes, the first line."""
    x = F.regexp_replace(strip(F.regexp_replace(text(c), THINK, "")), r"(?i)^(?:NL|Description|Answer|Output)\s*[:：]\s*", "")
    x = strip(F.regexp_replace(strip(x), r"^\"*'*`*|\"*'*`*\z", ""))
    return strip(F.substring_index(x, "\n", 1))


def options(c: Column | str) -> Column:
    """`temp=0.9,k=4` as a map."""
    return F.str_to_map(text(c), F.lit(","), F.lit("="))


TOKEN = r"[A-Za-z_]\w*|##\[[^\]]*\]|##\d+|\|->|\|=>|[()\[\];,.]|\S"


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(squeezed(c), F.lit(TOKEN), F.lit(0))


def token_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance over tokens / the longer's tokens; 0 if either is empty. Each distinct token stands as a code point of the private planes."""
    # planes 15 and 16 are private: room for 131068 distinct tokens
    point = lambda known, t: F.array_position(known, t).cast("int") + 0xF0000 - 1
    coded = lambda known, ts: F.decode(F.unhex(F.array_join(F.transform(ts, lambda t: F.lpad(F.hex(point(known, t)), 8, "0")), "")), "UTF-32")

    def score(p: Column) -> Column:
        longer = F.greatest(F.size(p["x"]), F.size(p["y"]))
        near = F.greatest(F.lit(0.0), 1.0 - F.levenshtein(coded(p["known"], p["x"]), coded(p["known"], p["y"])) / longer)
        return F.when((F.size(p["x"]) > 0) & (F.size(p["y"]) > 0), near).otherwise(0.0)

    pair = lambda p: let(F.struct(p["x"].alias("x"), p["y"].alias("y"), F.array_distinct(F.concat(p["x"], p["y"])).alias("known")), score)
    return let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), pair)
