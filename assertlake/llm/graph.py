"""Connected components of links, as labels over DataFrames."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from assertlake.llm.common import removed, saved, written


def components(links: DataFrame, name: str) -> DataFrame:
    """links (a long, b long), best the forests of tasks -> (node, root): the smallest node of its component, for every node in a link.

    Each round a node takes the smallest label of its neighbours, hands it to the node of its old label too (so whole trees hook at once, and
    rounds grow with the logarithm of a chain's length), then takes its label's label. Rows are pre-aggregated and a node with many links is
    split by the adaptive join. It ends when no label changes, after however many rounds. Rounds are written to the shared folder, and
    deleted when the next one is. No links: no rows. Links of a node with itself and repeated ones count as none and one; ids are not null.
    """
    short = saved(links.select("a", "b").where("a <> b").distinct(), f"{name}-links")
    both = short.union(short.select("b", "a")).toDF("node", "other")
    begin = written()
    labels = saved(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), f"{name}-0")
    for k in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        # a row for the node itself, which knows its old label, and one for that label's node
        told = step.select("low", F.explode(F.array(F.struct("node", "old"), F.struct(F.col("old").alias("node"), F.lit(None).cast("long").alias("old")))).alias("x"))
        step = told.groupBy("x.node").agg(F.max("x.old").alias("old"), F.min("low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = saved(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), f"{name}-{k}")
        changed = new.where("old <> root").limit(1).count()
        labels = new.select("node", "root")
        removed(links.sparkSession, begin, keep=1)
        if not changed:
            break
    removed(links.sparkSession, begin - 1, keep=1)
    return labels
