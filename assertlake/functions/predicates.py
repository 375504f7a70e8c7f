"""Predicates and flags over descriptions, assertions and source context."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assertlake.functions.keys import strip, text

#: Fixed values.
PLACEHOLDER = r"(?i)^\s*\[(?:ASSERT|ASSUME|COVER)"
CANNED_PREFIXES = ("Create a SVA assertion that checks:", "Generate a SVA assertion ", "Write a SVA ")
COMMENT_STARTS = ("//", "/*", "--", "#", "todo", "fixme")
LEAKS = r"(?i)\|->|\|=>|##\s*\[|##\s*\d|s_eventually|s_until|s_always|\bassert\s+property\b|disable\s+iff|posedge|negedge"
HIGH_LEVEL_HINT = (
    r"(?i)##\s*\[|\[\s*(?:\*|=|-)\s*\d+\s*:\s*(?:\d+|\$)\s*\]|\bs_eventually\b|\bs_until\b|\bs_always\b|\buntil_with\b|"
    r"\bthroughout\b|\bwithin\b|\bintersect\b|\bfirst_match\b"
)
LICENCES = (("apache license, version 2.0", "Apache-2.0"), ("bsd", "BSD"), ("mit license", "MIT"), ("gnu general public", "GPL"), ("solderpad", "Solderpad-2.0"), ("mozilla public", "MPL-2.0"))
#: The thresholds under which descriptions count as real, by use: least length, whether placeholders count, whether comments count.
REAL_NL = {
    "merge": (10, False, True),
    "disjoint": (8, False, True),
    "pool": (8, False, True),
    "expand": (8, False, True),
    "usable": (8, True, True),
    "industrial": (15, False, False),
    "curriculum": (5, False, True),
}


def is_placeholder(c: Column | str) -> Column:
    return text(c).rlike(PLACEHOLDER)


def real_nl(c: Column | str, use: str = "merge") -> Column:
    least, placeholders, comments = REAL_NL[use]
    x = strip(c)
    out = F.length(x) >= least
    if not placeholders:
        out = out & ~is_placeholder(x)
    if not comments:
        for start in COMMENT_STARTS:
            out = out & ~F.lower(x).startswith(start)
    return out


def needs_nl(c: Column | str) -> Column:
    return ~real_nl(c, "curriculum")


def is_valid(c: Column | str, low: int = 30, high: int = 4000) -> Column:
    """Names an assertion's property, and is neither too short nor too long; high is 2000 in the industrial pool."""
    x = F.lower(strip(c))
    return x.contains("assert") & x.contains("property") & F.length(x).between(low, high)


def engineer_nl(c: Column | str) -> Column:
    """Not empty, and without a prefix that generated descriptions have."""
    x = strip(c)
    out = x != ""
    for p in CANNED_PREFIXES:
        out = out & ~x.startswith(p)
    return out


def all_in(array: Column, names: list[str]) -> Column:
    """Not empty, and every element is one of names."""
    return (F.size(F.coalesce(array, F.array().cast("array<string>"))) > 0) & F.forall(array, lambda x: x.isin(names))


def codev_origin(columns: list[str], dataset: Column) -> Column:
    out = F.coalesce(dataset == "CodeV-SVA-dataset-83K", F.lit(False))
    for c in columns:
        out = out | F.lower(text(c)).rlike("codev|83k")
    return out


def has_rtl(c: Column | str) -> Column:
    return F.length(strip(c)) > 0


def has_module(c: Column | str) -> Column:
    return text(c).contains("module") & text(c).contains("endmodule")


def length_gate(sva: Column | str, rtl: Column | str, low: int = 30, high: int = 2000, rtl_low: int = 500) -> Column:
    """Why a record is dropped for its lengths; null if it stays."""
    return F.when(~F.length(text(sva)).between(low, high), "bad_sva_len").when(F.length(text(rtl)) < rtl_low, "short_rtl")


def nl_verdict(c: Column | str) -> Column:
    """ok, or the first reason against a generated description."""
    x = F.regexp_replace(F.regexp_replace(strip(c), r'^"+|"+\z', ""), r"^'+|'+\z", "")
    return (
        F.when(x == "", "empty")
        .when(~F.lower(x).startswith("create a sva assertion"), "missing_prefix")
        .when(~F.length(x).between(25, 400), F.format_string("length=%d", F.length(x)))
        .when(x.rlike(LEAKS), "sva_token_leak")
        .otherwise("ok")
    )


def high_level_hint(c: Column | str) -> Column:
    return text(c).rlike(HIGH_LEVEL_HINT)


def licence(c: Column | str) -> Column:
    """By the first 400 characters of a licence file."""
    head, out = F.lower(F.substring(text(c), 1, 400)), F.lit("UNKNOWN")
    for words, name in reversed(LICENCES):
        out = F.when(head.contains(words), name).otherwise(out)
    return out


def features(c: Column | str) -> Column:
    """Flags of an assertion as a struct."""
    x = text(c)
    has = lambda *words: F.lit(False) if not words else x.contains(words[0]) | has(*words[1:])
    flags = {
        "has_disable_iff": F.lower(x).contains("disable iff"),
        "reset_expr": F.trim(F.regexp_extract(x, r"(?i)disable\s+iff\s*\(\s*([^)]+?)\s*\)", 1)),
        "clk_edge": F.trim(F.regexp_extract(x, r"(?i)@\s*\(\s*([^)]+?)\s*\)", 1)),
        "has_rarrow": has("|->"),
        "has_drarrow": has("|=>"),
        "has_case_eq": has("===", "!=="),
        "has_bit_lit": x.rlike("1'b[01]"),
        **{f"has_{w}": has(f"${w}") for w in ("past", "rose", "fell", "changed", "stable")},
        "has_seq_delay": x.rlike(r"##\d"),
        "has_eventually": has("eventually"),
        **{f"has_{w}": has(w) for w in ("throughout", "within", "intersect")},
        "has_named_prop": x.rlike(r"\bproperty\s+\w+\s*;"),
        "has_assert_property": x.rlike(r"assert\s+property"),
        "sva_len": F.length(x),
    }
    return F.struct(*(v.alias(k) for k, v in flags.items()))


def nl_features(c: Column | str) -> Column:
    x = text(c)
    return F.struct(x.rlike("(?i)^(?:create|write) a SVA").alias("starts_template"), x.rlike("(?i)use the signals").alias("mentions_signals"), F.length(x).alias("nl_len"))


def repo_label(path: Column | str) -> Column:
    """owner/name from a snapshot's directory or archive, where the first double underscore stands for the slash."""
    base = F.regexp_replace(F.regexp_extract(text(path), r"([^/]+)/*\z", 1), r"(?:\.tar\.gz|\.tgz)\z", "")
    return F.regexp_replace(base, r"^(.*?)__", "$1/")
