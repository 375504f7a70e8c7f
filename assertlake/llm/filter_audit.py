"""Filter interaction audit: what each filter removes in each order of application, as one product of matrices.

A document's failed filters are the bits of a mask. For each part (value of lang) the 32 masks are counted three times: all documents, those that
`labels` calls good, those it calls toxic. These rows of 32 counts, stacked, times fixed integer matrices of 32 masks by 600 columns (120 orders of five
steps) are the outcomes; no document is looked at again. `facts` and `histograms` are SQL functions and aggregations; the product runs on Arrow batches.

Null text counts as empty, null lang as the part ''. E compares ids: a document with a null doc_id has no smaller one and is none's smaller one, so it
never fails E; nor do repeated rows of the smallest id fail it. Each row of a repeated document counts. A label counts if any row of `labels` has it; null
ids have none. An empty table has no parts, so no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

#: Parts whose outcomes are made at once.
PARTS_AT_ONCE = 64


def text_fails() -> list[Column]:
    """A to D, of the columns text and words."""
    n = F.size("words")
    return [
        n < 200,
        100 * F.size(F.array_distinct("words")) < 50 * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 3 * F.length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, bits, n): equal rows of the table are one, with their number; bits are those of A to D. The texts end here."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_fails())), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))
    return rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))


def histograms(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic). Only the documents with the smallest id of a text pass E, so a group of copies is counted, not listed: there is one row
    for each text, part and labels, with its smallest id and how many rows have that."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = facts.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    keys = ["digest", "bits", "part", "good", "toxic"]
    # a row of the smallest id of its group: each such id comes once in facts, so n is whole
    groups = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    groups = groups.withColumn("least", F.min("first.doc_id").over(W.partitionBy("digest")))
    passing = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    # failing E is bit 4
    sides = F.array(F.struct(F.col("bits").alias("mask"), passing.alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - passing).alias("n")))
    counted = groups.select("part", "good", "toxic", F.explode(sides).alias("x")).where("x.n > 0")
    return counted.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def matrices() -> dict[str, np.ndarray]:
    """Masks by steps, 0 or 1: what becomes of a document with that mask at that step of that order. shapley adds a filter's removals over all orders."""
    masks = np.arange(MASKS)[:, None]
    own = np.array([1 << FILTERS.index(order[k]) for order, k in STEPS])
    before = np.array([sum(1 << FILTERS.index(f) for f in order[:k]) for order, k in STEPS])
    fails, gone = (masks & own) > 0, (masks & before) > 0
    out = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": masks == own}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    out["shapley"] = np.stack([out["removed"][:, own == f].sum(1) for f in own], axis=1)
    return out


def outcomes(histogram: DataFrame) -> DataFrame:
    """The product: 600 rows for each part."""
    rows = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = matrices()
        steps = pa.array([k + 1 for _, k in STEPS], pa.int32())
        orders = pa.array([order for order, _ in STEPS])
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                stacked = np.zeros((len(MEASURES), some.num_rows, MASKS), np.int64)
                for i, cells in enumerate(some.column("cells").to_pylist()):
                    for cell in cells:
                        stacked[:, i, cell["mask"]] = [cell[m] for m in MEASURES]
                n, good, toxic = stacked
                made = {k: n @ m for k, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
                part = pa.array([p for p in some.column("part").to_pylist() for _ in STEPS], pa.string())
                tiled = [pa.concat_arrays([x] * some.num_rows) for x in (orders, steps)]
                yield pa.RecordBatch.from_arrays([part, *tiled, *(pa.array(made[c].ravel()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(multiplied, SCHEMA)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return outcomes(histograms(facts(docs), labels))


def oracle() -> str:
    """The same in DuckDB's SQL, document by document."""
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > least, false)::INT AS mask
  FROM t JOIN s USING (text) LEFT JOIN l USING (doc_id)),
f(letter, bit) AS (VALUES {letters}),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
p AS (SELECT filter_order, step, bits[step] AS own, list_sum(list_concat([0], bits[1 : step - 1]))::INT AS gone FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, own, count(*) FILTER (mask & (own | gone) = 0) AS kept, count(*) FILTER (mask & gone = 0 AND mask & own > 0) AS removed,
    count(*) FILTER (mask & gone > 0 AND mask & own > 0) AS redundant, count(*) FILTER (mask = own) AS unique_fails,
    count(*) FILTER (mask & gone = 0 AND mask & own > 0 AND good = 1) AS good_lost, count(*) FILTER (mask & gone = 0 AND mask & own > 0 AND toxic = 1) AS toxic_lost
  FROM m, p GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
