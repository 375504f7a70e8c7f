"""Verdicts of external tools: a pluggable provider behind gates and a cache.

A provider is any function of a pandas frame of requests that returns a frame of verdicts; proof tools, simulators and models are out of
this engine and come in this way. Requests that a gate decides, or that the cache knows, never reach it: they are filtered
out before, since an expression around a call does not keep the call from being made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assertlake.functions.keys import cache_key, text
from assertlake.functions.parse import syntax

REQUEST = ["key", "lm_sva", "ref_sva", "rtl", "depth", "timeout", "reset", "liveness_bound"]
VERDICT = "key string, verdict string, fwd_status string, bwd_status string, seconds double"
Provider = Callable[[pd.DataFrame], pd.DataFrame]


def requests(rows: DataFrame, lm: str, ref: str, rtl: str, depth: int = 10, timeout: int = 15, liveness_bound: int | None = None) -> DataFrame:
    """One request for each different pair and context. Without a bound, liveness is not decided."""
    from assertlake.functions.rewrite import reset_expression

    pair = F.concat(text(lm), F.lit("|||"), text(ref))
    out = rows.select(cache_key(pair, rtl).alias("key"), text(lm).alias("lm_sva"), text(ref).alias("ref_sva"), text(rtl).alias("rtl")).dropDuplicates(["key"])
    return out.select("*", F.lit(depth).alias("depth"), F.lit(timeout).alias("timeout"), reset_expression("rtl", "ref_sva", "lm_sva").alias("reset"), F.lit(liveness_bound).cast("int").alias("liveness_bound"))


def gate(requests_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decided, open): empty or malformed candidates are decided without the tool."""
    verdict = F.when(F.trim("lm_sva") == "", "EMPTY").when(~syntax("lm_sva")["ok"], "PARSE_ERROR")
    judged = requests_.withColumn("__verdict", verdict)
    decided = judged.where("__verdict is not null").select("key", F.col("__verdict").alias("verdict"), F.lit("").alias("fwd_status"), F.lit("").alias("bwd_status"), F.lit(0.0).alias("seconds"))
    return decided, judged.where("__verdict is null").drop("__verdict")


def asked(requests_: DataFrame, provider: Provider, partitions: int | None = None) -> DataFrame:
    """Verdicts by the provider; a batch that raises gives EXCEPTION:<type> for each of its requests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield provider(batch)
            except Exception as e:  # the tool's failure is a verdict
                yield pd.DataFrame({"key": batch["key"], "verdict": f"EXCEPTION:{type(e).__name__}", "fwd_status": "", "bwd_status": "", "seconds": 0.0})

    rows = requests_.repartition(partitions) if partitions else requests_
    return rows.select(*REQUEST).mapInPandas(run, VERDICT)


def verdicts(requests_: DataFrame, provider: Provider, cache: DataFrame | None = None) -> DataFrame:
    """Gate, then the cache, then the provider for what is left."""
    decided, open_ = gate(requests_)
    if cache is None:
        return decided.unionByName(asked(open_, provider))
    known = open_.select("key").join(cache, "key")
    missing = open_.join(cache.select("key"), "key", "left_anti")
    return decided.unionByName(known.select(*decided.columns)).unionByName(asked(missing, provider))


def recorded(table: dict[tuple[str, str], str]) -> Provider:
    """A provider that answers from recorded verdicts of (candidate, reference); UNSUPPORTED for others."""

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        v = [table.get((a, b), "EQUIVALENT" if a == b else "UNSUPPORTED") for a, b in zip(batch["lm_sva"], batch["ref_sva"])]
        return pd.DataFrame({"key": batch["key"], "verdict": v, "fwd_status": "", "bwd_status": "", "seconds": 0.0})

    return answer


def normalised_equality(batch: pd.DataFrame) -> pd.DataFrame:
    """A provider without a tool: texts that are equal after normalisation are EQUIVALENT, liveness is UNSUPPORTED, else NOT_EQUIVALENT."""
    from assertlake.functions.rewrite import case_equality, lowered, normalised

    out = []
    for lm, ref, bound in zip(batch["lm_sva"], batch["ref_sva"], batch["liveness_bound"]):
        sides = [lowered(case_equality(s), bound=None if pd.isna(bound) else int(bound)) for s in (lm, ref)]
        same = normalised(case_equality(lm)) == normalised(case_equality(ref))
        out.append("UNSUPPORTED" if not all(x.ok for x in sides) else "EQUIVALENT" if same else "NOT_EQUIVALENT")
    return pd.DataFrame({"key": batch["key"], "verdict": out, "fwd_status": "", "bwd_status": "", "seconds": 0.0})


def written_back(rows: DataFrame, key: Column, verdicts_: DataFrame, missing: str = "UNSUPPORTED") -> DataFrame:
    """rows with their verdict; missing where there is none."""
    keyed = rows.withColumn("key", key)
    return keyed.join(verdicts_.select("key", "verdict"), "key", "left").withColumn("verdict", F.coalesce("verdict", F.lit(missing))).drop("key")
