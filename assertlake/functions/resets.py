"""One name for what disables an assertion: every reset condition becomes tb_reset, and the design says what that is."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assertlake.functions.keys import SPACES, strip, text
from assertlake.functions.scanner import calls

DISABLE = re.compile(r"\bdisable\s+iff\s*\(", re.I)
NAME = "tb_reset"


def renamed(sva: str) -> tuple[str, list[str], bool]:
    """(the assertion with tb_reset in each condition, the other conditions in order, whether all of them close)."""
    out, conditions, at, n = [], [], 0, 0
    for m, end in calls(sva, DISABLE):
        condition = sva[m.end() : end - 1].strip()
        if condition != NAME:
            out += [sva[at : m.start()], f"disable iff ({NAME})"]
            conditions.append(condition)
            at = end
        n += 1
    if n < len(DISABLE.findall(sva)):
        return sva, [], False
    return "".join([*out, sva[at:]]), conditions, True


RENAMED = T.StructType([T.StructField("sva", T.StringType()), T.StructField("conditions", T.ArrayType(T.StringType())), T.StructField("closed", T.BooleanType())])


@F.pandas_udf(RENAMED)
def rename(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([renamed(x or "") for x in s], columns=["sva", "conditions", "closed"])


def with_alias(rtl: Column, condition: Column) -> Column:
    """tb_reset declared as the condition before the last end of the module; the same if the text has one, or no end."""
    head, tail = (F.regexp_extract(rtl, r"(?s)^(.*)(endmodule.*?)$", k) for k in (1, 2))
    alias = F.concat(F.rtrim(head, F.lit(SPACES)), F.lit(f"\n    wire {NAME};\n    assign {NAME} = ("), condition, F.lit(");\n"), tail)
    return F.when(F.contains(rtl, F.lit("endmodule")) & ~F.contains(rtl, F.lit(NAME)), alias).otherwise(rtl)


def normalised_rows(df: DataFrame, sva: str = "reference_sva", rtl: str = "rtl_context") -> DataFrame:
    """df with the conditions of disable iff under one name, and status, reset_exprs (the former conditions in order) and reset_expr (the first, which the design
    gets as tb_reset):

    no_disable_iff, already_canonical and malformed (a condition that doesn't close) stay as they are; rewritten; multi_distinct: rewritten, but there
    were different conditions. Only different texts with a condition reach Python.
    """
    has = text(sva).rlike(r"(?i)\bdisable\s+iff\s*\(") & (strip(sva) != "")
    texts = df.where(has).select(F.col(sva).alias("__sva")).distinct().select("__sva", rename("__sva").alias("__x"))
    rows = df.join(texts, F.col(sva) == F.col("__sva"), "left").drop("__sva")
    n = F.size(F.array_distinct("__x.conditions"))
    status = F.when(F.col("__x").isNull(), "no_disable_iff").when(~F.col("__x.closed"), "malformed").when(n == 0, "already_canonical").when(n > 1, "multi_distinct").otherwise("rewritten")
    first = F.get("__x.conditions", F.lit(0))
    rows = rows.withColumns({"status": status, "reset_exprs": F.coalesce("__x.conditions", F.array().cast("array<string>")), "reset_expr": first})
    changed = F.col("status").isin("rewritten", "multi_distinct")
    return rows.withColumns({sva: F.when(changed, F.col("__x.sva")).otherwise(F.col(sva)), rtl: F.when(changed, with_alias(text(rtl), F.col("reset_expr"))).otherwise(F.col(rtl))}).drop("__x")
