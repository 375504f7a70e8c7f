"""Variants of sequence implications at other levels, with descriptions that say what has changed. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assertlake.functions.classify import level
from assertlake.functions.keys import body_hash, let, squeezed, text
from assertlake.functions.predicates import real_nl

#: (level, tag, what stands for {l}eft and {r}ight, what the description says); fixed values. {a}, {b}, {o}: the right side with its first delay N opened to [N:N+2] or [N:$].
TEMPLATES = (
    (3, "range_1_3", "{l} ##[1:3] {r}", "within 1 to 3 cycles"),
    (3, "range_0_1", "{l} ##[0:1] {r}", "within 0 to 1 cycles"),
    (3, "range_2_5", "{l} ##[2:5] {r}", "within 2 to 5 cycles"),
    (3, "range_1_inf", "{l} ##[1:$] {r}", "at some point after 1 or more cycles"),
    (3, "lift_fixed_to_range", "{l} {b}", "within a bounded cycle window"),
    (3, "lift_fixed_to_open_range", "{l} {o}", "within an open-ended cycle window"),
    (5, "eventually", "{l} |-> s_eventually ({r})", "eventually"),
    (5, "strong_eventually", "{l} |-> strong(##[1:$] ({r}))", "must eventually become true and cannot be deferred forever"),
    (5, "until_with", "{l} |-> ({l}) until_with ({r})", "must remain true until the terminating condition holds"),
    (5, "s_until", "{l} |-> ({l}) s_until ({r})", "must continue to hold until the consequent becomes true"),
    (5, "s_always", "{l} |-> s_always ({r})", "must always remain true once triggered"),
)
#: What a description says of time, the first that it has is put anew; fixed values.
DELAYS = (r"\bnext cycle\b", r"\bwithin\b.+?\bcycles?\b", r"\bafter \d+ cycles?\b", r"\bwithin a bounded cycle range\b")
LIVENESS = (r"\beventually\b", r"\buntil\b", r"\balways\b", r"\bnext cycle\b")
LIVE = r"(?i)\bs_eventually\b|\bs_until\b|\bs_always\b|\buntil_with\b"


def reworded(nl: Column, target: int, phrase: str) -> Column:
    """The description with the phrase in place of each of the first kind of wording that it has, else with a sentence more."""
    def build(x: Column) -> Column:
        end = f" The consequent should hold {phrase}." if target == 3 else f" {phrase[0].upper() + phrase[1:]}."
        out = F.concat(F.regexp_replace(x, r"\.+$", ""), F.lit(end))
        for pattern in reversed(DELAYS if target == 3 else LIVENESS):
            out = F.when(x.rlike(f"(?i){pattern}"), F.regexp_replace(x, f"(?i){pattern}", phrase)).otherwise(out)
        return out

    return let(squeezed(nl), build)


def variants(sva: Column | str, nl: Column | str) -> Column:
    """array<struct<level, tag, sva, nl>> of an implication without liveness, in the order of the table: those that are of the level that they are made for."""

    def build(x: Column) -> Column:
        left = F.trim(F.regexp_extract(x, r"^(.*?)\|[-=]>", 1))
        right = F.regexp_replace(F.trim(F.regexp_extract(x, r"^.*?\|[-=]>(.*)$", 1)), ";+$", "")
        before, n, after = (F.regexp_extract(right, r"^(.*?)##\s*(\d+)(.*)$", k) for k in (1, 2, 3))
        more = (n.try_cast("decimal(38,0)") + 2).cast("string")
        opened = lambda high: F.when(n != "", F.concat(before, F.lit("##["), n.try_cast("decimal(38,0)").cast("string"), F.lit(":"), high, F.lit("]"), after))
        parts = F.struct(left.alias("l"), right.alias("r"), opened(more).alias("b"), opened(F.lit("$")).alias("o"), F.when(x.endswith(";"), ";").otherwise("").alias("end"))
        ok = x.rlike(r"\|[-=]>") & ~x.rlike(LIVE)
        return let(parts, lambda p: F.when(ok & (p["l"] != "") & (p["r"] != ""), F.array(*(made(p, *t) for t in TEMPLATES))).otherwise(F.array()))

    def made(p: Column, target: int, tag: str, form: str, phrase: str) -> Column:
        pieces, rest = [], form
        while "{" in rest:
            head, rest = rest.split("{", 1)
            name, rest = rest.split("}", 1)
            pieces += [F.lit(head), p[name]]
        return F.struct(F.lit(target).alias("level"), F.lit(tag).alias("tag"), F.concat(*pieces, F.lit(rest), p["end"]).alias("sva"), reworded(text(nl), target, phrase).alias("nl"))

    return F.filter(let(squeezed(sva), build), lambda v: v["sva"].isNotNull() & (level(v["sva"]) == v["level"]))


def expanded(seeds: DataFrame, order: str) -> DataFrame:
    """seeds (id, nl, reference_sva, rtl_context, source, hash) of level 4 with a usable description -> training rows of their variants, each text once: of the
    first seed by order, and there of the first template."""
    rows = seeds.where(real_nl("nl", "expand"))
    # of seeds with one text the first wins all variants, so the others need none
    rows = rows.groupBy(F.col("reference_sva").alias("__sva")).agg(F.min_by(F.struct(*seeds.columns), F.col(order)).alias("x")).select("x.*").where(level("reference_sva") == 4)
    rows = rows.select("*", F.posexplode(variants("reference_sva", "nl")).alias("__at", "v")).withColumn("__hash", body_hash(F.col("v.sva")))
    rows = rows.groupBy("__hash").agg(F.min_by(F.struct(*seeds.columns, "v"), F.struct(F.col(order), F.col("__at"))).alias("x"))
    kind = F.concat(F.lit("l"), F.col("x.v.level").cast("string"))
    return rows.select(
        F.concat_ws("_", F.lit("synthetic"), kind, F.col("x.v.tag"), "__hash").alias("id"), F.lit("synthetic_from_l4").alias("source"), text(F.col("x.source")).alias("origin_dataset"),
        F.col("x.v.nl").alias("nl"), F.col("x.v.sva").alias("reference_sva"), text(F.col("x.rtl_context")).alias("rtl_context"), F.col("x.v.level").alias("expected_tcl"), F.col("__hash").alias("hash"),
        text(F.col("x.id")).alias("parent_id"), F.coalesce("x.hash", body_hash(F.col("x.reference_sva"))).alias("parent_hash"), F.concat(F.lit("l4_to_"), kind, F.lit("_"), F.col("x.v.tag")).alias("transform"),
    )
