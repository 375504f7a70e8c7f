"""Prompts and their context as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assertlake.functions.keys import strip, text
from assertlake.functions.predicates import is_placeholder

#: The most characters of source context by use; fixed values.
CONTEXT_CHARS = {"train": 4500, "eval": None, "screen": 6000, "describe": 2000, "fill": 4000, "hint": 600}
TRUNCATED = "\n  // ... [truncated]"


def context(rtl: Column | str, use: str = "train") -> Column:
    """The stripped context, cut with a note beyond the use's limit."""
    x, most = strip(rtl), CONTEXT_CHARS[use]
    return x if most is None else F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(TRUNCATED))).otherwise(x)


def question(nl: Column | str) -> Column:
    """A description as a request, unless it is one already."""
    x = strip(nl)
    return F.when(x.rlike(r"(?i)^\s*(?:create|generate|write)\s+(?:an?\s+|the\s+)?sva\b"), x).otherwise(F.concat(F.lit("Create a SVA assertion that checks: "), x))


def user_prompt(nl: Column | str, rtl: Column | str, ending: str, use: str = "train") -> Column:
    """Context (if there is any), question and ending, apart by blank lines."""
    shown = context(rtl, use)
    bench = F.when(shown != "", F.concat(F.lit("Here is the testbench to perform your translation:\n"), shown))
    return F.concat_ws("\n\n", bench, F.concat(F.lit("Question: "), question(nl)), F.lit(ending))


def with_fallback(nl: Column | str, module: Column | str, level: Column) -> Column:
    """The description, or one made of module and level where it is empty or a placeholder."""
    x = strip(nl)
    made = F.concat(F.lit("Write an SVA for module "), text(module), F.lit(" (TCL level "), F.coalesce(level.cast("string"), F.lit("?")), F.lit(")"))
    return F.when((x == "") | is_placeholder(x), made).otherwise(x)


def messages(system: str, user: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user))


def training_rows(pool: DataFrame, system: str, ending: str | None = None) -> DataFrame:
    """(prompt, reference_sva, ref_svas, rtl_context, expected_tcl, tier) of a pool (nl, reference_sva, rtl_context, expected_tcl, module_name, and perhaps ref_svas, tier)."""
    nl = with_fallback("nl", "module_name", F.col("expected_tcl"))
    user = user_prompt(nl, "rtl_context", ending) if ending else F.concat(F.lit("Generate an SVA assertion for:\n"), nl)
    refs = F.col("ref_svas") if "ref_svas" in pool.columns else F.lit(None).cast("array<string>")
    tier = F.col("tier") if "tier" in pool.columns else F.lit(None).cast("int")
    return pool.select(
        messages(system, user).alias("prompt"), "reference_sva", F.when(F.size(refs) > 0, refs).otherwise(F.array("reference_sva")).alias("ref_svas"), text("rtl_context").alias("rtl_context"),
        F.coalesce("expected_tcl", F.lit(0)).alias("expected_tcl"), F.coalesce(tier, F.lit(2)).alias("tier"),
    )


def violation_line(signal: Column, kind: Column, violation: Column, cycle: Column, matched: Column, delta: Column) -> Column:
    """A temporal violation in words."""
    late = lambda word: F.format_string(f"  - Signal '%s': %s transition expected at cycle %d, occurred %d cycle(s) {word} (actual cycle %d).", signal, kind, cycle, F.abs(delta), matched)
    missing = F.format_string("  - Signal '%s': expected %s transition at cycle %d, but no matching transition found in actual waveform.", signal, kind, cycle)
    return F.when(violation == "missing", missing).when(violation == "delayed", late("LATE")).otherwise(late("EARLY"))


def violation_text(rows: DataFrame, group: str) -> DataFrame:
    """(group, text): the violations of each group in the order of signal and cycle."""
    line = violation_line(F.col("signal"), F.col("kind"), F.col("violation"), F.col("cycle"), F.col("matched"), F.col("delta"))
    items = F.array_sort(F.collect_list(F.struct("signal", "cycle", line.alias("line"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x.line), "\n").alias("text"))


def equivalence_metrics(log: Column) -> Column:
    """struct(syntax, functionality, func_relaxed) of an equivalence tool's output."""
    bad, full = log.contains("syntax error"), log.contains("Full equivalence")
    score = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.struct(score(~bad).alias("syntax"), score(~bad & full).alias("functionality"), score(~bad & (full | log.contains("implies"))).alias("func_relaxed"))


def compile_errors(log: Column) -> Column:
    """The error lines of a compiler's output; it failed if there are any."""
    return F.filter(F.split(text(log), "\n"), lambda x: x.rlike(r"^Error-\["))


#: Level -> class of the curriculum; fixed values.
CLASSES = {1: "C1", 2: "C2", 3: "C2", 4: "C2", 5: "C3"}


def by_class(pool: DataFrame) -> DataFrame:
    """Training rows (class, id, nl, sva, tcl, rtl_context) of a pool (id, nl, reference_sva, expected_tcl, temporal_class, rtl_context): those with a real description, in
    the class that they name, else their level's; rows of no class are left out."""
    from assertlake.functions.keys import text
    from assertlake.functions.predicates import real_nl

    level = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    own = F.coalesce(F.nullif("temporal_class", F.lit("")), F.try_element_at(level, F.col("expected_tcl")))
    rows = pool.where(real_nl("nl", "curriculum")).withColumn("class", own)
    return rows.where(F.col("class").isin("C1", "C2", "C3")).select("class", text("id").alias("id"), "nl", F.col("reference_sva").alias("sva"), F.col("expected_tcl").alias("tcl"), text("rtl_context").alias("rtl_context"))


def class_report(pool: DataFrame) -> DataFrame:
    """(total, empty, placeholder, kept by class as a map) of by_class."""
    from assertlake.functions.keys import strip
    from assertlake.functions.predicates import is_placeholder

    empty = F.length(strip("nl")) < 5
    kept = by_class(pool).groupBy("class").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("kept"))
    counts = pool.agg(F.count(F.lit(1)).alias("total"), F.count_if(empty).alias("empty"), F.count_if(~empty & is_placeholder("nl")).alias("placeholder"))
    return counts.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one").drop("one")  # a row each
