"""Schemas of pools and reports, and how a record's aliases come together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNIFIED = "id string, source string, nl string, reference_sva string, rtl_context string, expected_tcl int, cex string, split string, hash string"
MERGED = "id string, source string, nl string, reference_sva string, rtl_context string, expected_tcl int, hash string, nl_filled_by string"
RAW = (
    "id string, sample_id string, source string, nl string, nl_comment string, description string, reference_sva string, sva string, gold_sva string, rtl_context string, rtl string, expected_tcl string, "
    "tcl string, hash string, nl_filled_by string, nl_source string, source_repo string, source_snapshot string"
)
CHAT = "messages array<struct<role:string,content:string>>"
ROLLOUTS = "id string, nl string, reference_sva string, ref_svas array<string>, expected_tcl int, rollouts array<struct<raw:string,sva:string,verdict:string>>"
REPORT = "per_sample array<struct<id:string,nl:string,expected_tcl:int,evaluable:boolean,candidates:array<struct<sample_idx:int,generated_sva:string,syntax_ok:boolean,generated_tcl:int,pec_verdict:string>>>>"
CSV_TASKS = "design_name string, task_id string, prompt string, ref_solution string, testbench string"
#: Canonical name -> names in the order of preference; fixed values.
ALIASES = {
    "reference_sva": ("reference_sva", "sva", "gold_sva"),
    "nl": ("nl", "nl_comment", "description"),
    "rtl_context": ("rtl_context", "rtl"),
    "expected_tcl": ("expected_tcl", "tcl"),
    "id": ("id", "sample_id"),
    "source_repo": ("source_repo", "source_snapshot"),
    "nl_filled_by": ("nl_filled_by", "nl_source"),
}


def first_of(df: DataFrame, name: str) -> Column:
    """The first alias that isn't empty; empty without any."""
    known = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ALIASES[name] if c in df.columns]
    return F.coalesce(*known, F.lit(""))


def canonical(df: DataFrame, source: str | Column) -> DataFrame:
    """Records under their canonical names, classified and keyed; those without a valid assertion are dropped."""
    from assertlake.functions.classify import level_merge
    from assertlake.functions.keys import body_hash_ci, strip
    from assertlake.functions.predicates import is_valid

    src = F.lit(source) if isinstance(source, str) else source
    rows = df.select(*(first_of(df, n).alias(n) for n in ("id", "reference_sva", "nl", "rtl_context", "expected_tcl", "nl_filled_by")), src.alias("source"))
    rows = rows.where(is_valid("reference_sva")).withColumn("hash", body_hash_ci("reference_sva"))
    tcl = F.coalesce(F.nullif(F.col("expected_tcl").try_cast("int"), F.lit(0)), level_merge("reference_sva"))
    id_ = F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("_", F.substring("source", 1, 8), "hash"))
    return rows.select(id_.alias("id"), "source", strip("nl").alias("nl"), "reference_sva", strip("rtl_context").alias("rtl_context"), tcl.alias("expected_tcl"), "hash", "nl_filled_by")


def hardware_dataset(df: DataFrame, split: str = "train") -> DataFrame:
    """Records (name, specification, sva, rtl_code, clk, reset, reset_polarity, signals) as unified ones, with a class; those without a usable description or context go."""
    from assertlake.functions.classify import level, temporal_class
    from assertlake.functions.keys import body_hash, strip
    from assertlake.functions.predicates import has_rtl, real_nl

    rows = df.where(real_nl("specification", "usable") & has_rtl("rtl_code") & (strip("sva") != ""))
    tcl = level("sva")
    return rows.select(
        F.concat(F.lit("codev_"), body_hash("sva")).alias("id"), F.lit("codev").alias("source"), strip("specification").alias("nl"), strip("sva").alias("reference_sva"), F.col("rtl_code").alias("rtl_context"),
        tcl.alias("expected_tcl"), temporal_class(tcl).alias("temporal_class"), F.lit(split).alias("split"), body_hash("sva").alias("hash"), "clk", "reset", "reset_polarity", "signals",
    )


def with_context(df: DataFrame, sva: str = "reference_sva", rtl: str = "rtl_context") -> DataFrame:
    """Records without a module get one with the assertion's identifiers as inputs; made says which. Only they reach Python."""
    from assertlake.functions.predicates import has_module
    from assertlake.functions.rewrite import free_inputs

    own, none = df.where(has_module(rtl)), df.where(~has_module(rtl))
    return own.withColumn("made", F.lit(False)).unionByName(none.withColumn(rtl, free_inputs(sva)).withColumn("made", F.lit(True)))


def reshaped(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Records (id, nl, reference_sva, rtl_context, expected_tcl, hash_canon, temporal_class) as training rows: a context without a whole module and its
    tb_reset gives way to one made of the assertion's own signals, as wide as it uses them. Null text counts as empty.
    keep: columns of df that stay."""
    from assertlake.functions.keys import text
    from assertlake.functions.modules import clock_of, context, context_symbols, needs_context

    sva = text("reference_sva")
    hashed = F.when(text("hash_canon") != "", F.col("hash_canon")).otherwise(F.substring(F.md5(sva), 1, 16))
    return df.select(
        text("id").alias("id"), F.lit("synthetic_from_l4").alias("source"), text("nl").alias("nl"), sva.alias("reference_sva"),
        F.when(needs_context("rtl_context"), context("reference_sva")).otherwise(F.col("rtl_context")).alias("rtl_context"), "expected_tcl", F.lit(None).cast("string").alias("cex"),
        F.lit("train").alias("split"), hashed.alias("hash"), text("id").alias("source_name"), clock_of("reference_sva").alias("clk"), F.lit("reset").alias("reset"), F.lit(True).alias("reset_polarity"),
        F.transform(context_symbols("reference_sva"), lambda s: s["name"]).alias("signals"), F.lit("").alias("tb_for_validity"), "temporal_class", *(keep or []),
    )
