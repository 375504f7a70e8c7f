"""Temporal complexity of an assertion: five levels, three classes, and the variants that differ in a few operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assertlake.functions.keys import text, uncommented

_RANGE = r"\d+\s*:\s*(?:\d+|\$)"
#: Operators by level, the highest first; fixed values.
LEVELS: dict[int, list[str]] = {
    5: [r"\bs_eventually\b", r"\bs_until\b", r"\bs_always\b", r"\buntil_with\b", r"\bstrong\s*\("],
    4: [r"\|->", r"\|=>", r"\bthroughout\b", r"\bwithin\b", r"\bintersect\b", r"\bfirst_match\b"],
    3: [rf"##\s*\[\s*{_RANGE}\s*\]", rf"\[\s*\*\s*{_RANGE}\s*\]", rf"\[\s*=\s*{_RANGE}\s*\]", rf"\[\s*-\s*>\s*{_RANGE}\s*\]"],
    2: [r"##\s*\d+", r"\[\s*\*\s*\d+\s*\]", r"\[\s*=\s*\d+\s*\]", r"\[\s*-\s*>\s*\d+\s*\]"],
}
MARKERS = [r"\$rose\b", r"\$fell\b", r"\$stable\b", r"\$past\b", r"\$changed\b"]
LEVEL_NAMES = {1: "Combinational", 2: "SingleFixedDelay", 3: "VariableDelay", 4: "SequenceOperator", 5: "Liveness"}
CLASS_NAMES = {1: "Combinational", 2: "TemporalDelay", 3: "Liveness"}


def any_of(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def level(c: Column | str) -> Column:
    """The highest level of which an operator occurs outside of comments; 1 without any."""
    bare = uncommented(c)
    out = F.lit(1)
    for n in (2, 3, 4, 5):
        out = F.when(bare.rlike(any_of(LEVELS[n])), n).otherwise(out)
    return out


def matched(c: Column | str) -> Column:
    """struct(level, operator): the first match of the level's first pattern that matches; markers count for level 1."""
    bare = uncommented(c)
    struct = lambda n, x: F.struct(F.lit(n).alias("level"), x.alias("operator"))
    out = struct(1, F.lit(None).cast("string"))
    for n, patterns in sorted({1: MARKERS, **LEVELS}.items()):
        for p in reversed(patterns):
            out = F.when(bare.rlike("(?i)" + p), struct(n, F.regexp_extract(bare, "(?i)" + p, 0))).otherwise(out)
    return out


def reason(c: Column | str, named: bool = False) -> Column:
    """Why a text has its level, in either wording."""
    m = matched(c)
    op, n = m["operator"], m["level"]
    if not named:
        return F.when(op.isNull(), "no temporal operators found (combinational)").otherwise(F.format_string("matched '%s' at level %d", op, n))
    bare, names = uncommented(c), F.create_map(*(F.lit(x) for kv in LEVEL_NAMES.items() for x in kv))
    found = F.array_compact(F.array(*(F.when(bare.rlike("(?i)" + p), F.lit(f"'{p.replace(chr(92), chr(92) * 2)}'")) for p in MARKERS)))
    low = F.when(F.size(found) > 0, F.concat(F.lit("combinational with markers: ["), F.array_join(found, ", "), F.lit("]"))).otherwise("no temporal operators found (pure combinational)")
    return F.when(n == 1, low).otherwise(F.format_string("matched '%s' → level %d (%s)", F.trim(op), n, F.element_at(names, n)))


def three_classes(level_: Column) -> Column:
    return F.when(level_ == 1, 1).when(level_ == 5, 3).otherwise(2)


def temporal_class(level_: Column) -> Column:
    return F.concat(F.lit("C"), three_classes(level_).cast("string"))


def level_merge(c: Column | str) -> Column:
    """The merge's variant: any place of its words counts, nexttime is level 5, a bare ##[ is 3, only implications are 4; comments count."""
    x = text(c)
    return (
        F.when(F.lower(x).rlike("s_eventually|s_until|s_always|nexttime"), 5)
        .when(x.rlike(r"\|->|\|=>"), 4)
        .when(x.contains("##["), 3)
        .when(x.rlike(r"##\s*\d+"), 2)
        .otherwise(1)
    )


def level_fallback(c: Column | str) -> Column:
    """The fallback variant: whole words, case counts, until_with and nexttime are level 5; what is temporal without implication or range is 2."""
    x = text(c)
    temporal = x.rlike(r"\b(?:throughout|within|intersect)\b|##|\[\*|\|->|\|=>")
    return (
        F.when(x.rlike(r"\b(?:s_eventually|s_until|s_always|until_with|nexttime)\b"), 5)
        .when(x.rlike(r"\|->|\|=>"), 4)
        .when(temporal & x.rlike(r"##\s*\["), 3)
        .when(temporal, 2)
        .otherwise(1)
    )


def sql_level(x: str) -> str:
    """level() in SQL whose regular expressions have no look-around."""
    bare = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '//[^\n]*', ' ', 'g'), '(?s)/\*.*?\*/', ' ', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_matches({bare}, '{any_of(LEVELS[n])}') THEN {n}" for n in (5, 4, 3, 2)) + " ELSE 1 END"
