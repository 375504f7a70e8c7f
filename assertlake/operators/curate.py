"""Merging, deduplication, look-ups and joins of a curated pool. DataFrame in, DataFrame out; order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assertlake.functions.predicates import engineer_nl, real_nl
from assertlake.operators import ordered
from assertlake.sources.stage import staged


def keep_first(df: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The first record of each key by order. One aggregation: records are pre-aggregated before the shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    rows = F.struct(*df.columns)
    return df.groupBy(k.alias("__key")).agg(F.min_by(rows, F.col(order)).alias("__row")).select("__row.*")


def keep_last(df: DataFrame, key: str | Column, order: str) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("__key")).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")


def best_by(df: DataFrame, key: str | Column, score: list[Column], order: str) -> DataFrame:
    """The record with the greatest tuple of scores; the first by order wins ties."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("__key")).agg(F.max_by(F.struct(*df.columns), F.struct(*score, -F.col(order))).alias("__row")).select("__row.*")


def richness(nl: str, rtl: str, marker: str) -> Column:
    """Real description 4, long source context 2 or any 1, a fill marker 1."""
    long = F.length(F.coalesce(rtl, F.lit("")))
    return F.when(real_nl(nl, "merge"), 4).otherwise(0) + F.when(long >= 500, 2).when(long > 0, 1).otherwise(0) + F.when(F.coalesce(marker, F.lit("")) != "", 1).otherwise(0)


def keep_richest(df: DataFrame, key: str, score: Column, order: str, id_: str, source: str) -> DataFrame:
    """The richest record of each key, under the id that came first, with all sources in order joined by +."""
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, source))), lambda x: x[source]), "+")
    rest = [c for c in df.columns if c not in (id_, source)]
    best = F.max_by(F.struct(*rest), F.struct(score, -F.col(order)))
    return df.groupBy(F.col(key).alias("__key")).agg(best.alias("__best"), F.min_by(id_, order).alias(id_), sources.alias(source)).select(id_, source, "__best.*")


def merge_fieldwise(df: DataFrame, key: str, order: str) -> DataFrame:
    """One record of each key from records (nl, rtl_context, expected_tcl, source): each field by a rule of its own.

    nl: the first that an engineer wrote, else the first not empty; rtl_context: the longest, the first of equals; expected_tcl: the first
    that is not 0, and those that differ from it later as conflicts; provenance: all sources in order.
    """
    nl = F.trim(F.coalesce("nl", F.lit("")))
    o = F.col(order)
    pick = lambda cond: F.min(F.when(cond, F.struct(o.alias("o"), nl.alias("nl"), F.col("source").alias("source"))))
    tcl = F.min(F.when(F.coalesce("expected_tcl", F.lit(0)) != 0, F.struct(o.alias("o"), F.col("expected_tcl").alias("tcl"))))
    rtl = F.coalesce("rtl_context", F.lit(""))
    seen = F.array_sort(F.collect_list(F.struct(o.alias("o"), F.col("source").alias("source"), F.coalesce("expected_tcl", F.lit(0)).alias("tcl"))))
    out = df.groupBy(key).agg(
        pick(engineer_nl(nl)).alias("__eng"), pick(nl != "").alias("__any"), tcl.alias("__tcl"),
        F.max(F.when(rtl != "", F.struct(F.length(rtl).alias("n"), (-o).alias("o"), rtl.alias("rtl"), F.col("source").alias("source")))).alias("__rtl"), seen.alias("__seen"),
    )
    best = F.coalesce("__eng", "__any")
    conflicts = F.filter("__seen", lambda x: (x.o > F.col("__tcl.o")) & (x.tcl != 0) & (x.tcl != F.col("__tcl.tcl")))
    return out.select(
        key, F.coalesce(best["nl"], F.lit("")).alias("nl"), F.col("__eng").isNotNull().alias("nl_engineer"), best["source"].alias("nl_source"),
        F.coalesce("__rtl.rtl", F.lit("")).alias("rtl_context"), F.col("__rtl.source").alias("rtl_source"), F.coalesce("__tcl.tcl", F.lit(0)).alias("expected_tcl"),
        F.transform("__seen", lambda x: x.source).alias("provenance"), F.coalesce(F.size(conflicts), F.lit(0)).alias("n_conflicts"),
    )


#: A side with at most so many rows and bytes is broadcast; a larger one is left to the planner.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows, looked at up to the limit, are few and short."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, total = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= most_bytes else df


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Anti join: df without the rows whose key is in keys."""
    return df.join(small(keys.select(*on).distinct()), on, "left_anti")


def within(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(small(keys.select(*on).distinct()), on, "left_semi")


def overlap(left: DataFrame, right: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, n_left, n_right, n_both) of the distinct non-empty keys in each of the columns: one pass over both sides."""
    keys = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in kinds))).alias("x")).select("x.*", F.lit(side).alias("side"))
    both = keys(left, 1).unionByName(keys(right, 2)).where("key is not null and key <> ''")
    seen = both.groupBy("kind", "key").agg(F.bool_or(F.col("side") == 1).alias("l"), F.bool_or(F.col("side") == 2).alias("r"))
    return seen.groupBy("kind").agg(F.count_if("l").alias("n_left"), F.count_if("r").alias("n_right"), F.count_if(F.col("l") & F.col("r")).alias("n_both"))


def regen_merge(master: DataFrame, regen: DataFrame, asked: DataFrame) -> DataFrame:
    """master (id, nl) with regenerated descriptions: regen (id, nl_new, status), asked (id). nl_origin says which of four cases holds."""
    flagged = master.join(asked.select("id").distinct().withColumn("__asked", F.lit(True)), "id", "left").join(regen.select("id", "nl_new", "status"), "id", "left")
    origin = (
        F.when(F.col("status") == "ok", "regenerated")
        .when(F.col("status").isNotNull(), "regen_failed")
        .when(F.col("__asked"), "regen_missing")
        .otherwise("original")
    )
    return flagged.select(*master.columns, origin.alias("nl_origin"), "nl_new").withColumn("nl", F.when(F.col("nl_origin") == "regenerated", F.col("nl_new")).otherwise(F.col("nl"))).drop("nl_new")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, replaced by those of new with their key; keys only in new are left out."""
    right = new.select(F.col(key).alias("__k"), F.struct(*(c for c in old.columns if c != key)).alias("__new"))
    rows = old.join(right, F.col(key) == F.col("__k"), "left")
    return rows.select(key, *(F.when(F.col("__k").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c != key))


def first_hit(df: DataFrame, steps: list[tuple[str, DataFrame, list[str], str]]) -> DataFrame:
    """A cascade of look-ups (name, table with a unique key, key columns, value column): value and by of the first step that hits."""
    out, value, by = df, F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, look, on, column) in enumerate(steps):
        out = out.join(look.select(*(F.col(c) for c in on), F.col(column).alias(f"__v{i}")), on, "left")
        by = F.coalesce(by, F.when(F.col(f"__v{i}").isNotNull(), F.lit(name)))
        value = F.coalesce(value, F.col(f"__v{i}"))
    return out.select(*df.columns, value.alias("value"), by.alias("by"))


def suffixes(path: Column) -> Column:
    """All tails of a path's parts, the longest first."""
    p = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "/"))


def longest_suffix(paths: DataFrame, path: str, known: DataFrame, tail: str) -> DataFrame:
    """The longest tail of path that known has, as match; rows without any stay with null. paths needs a unique column id."""
    hits = paths.select("id", F.explode(suffixes(F.col(path))).alias(tail)).join(known.select(tail).distinct(), tail)
    return paths.join(hits.groupBy("id").agg(F.max_by(tail, F.length(tail)).alias("match")), "id", "left")


def most_hints(candidates: DataFrame, key: str, path: str, hints: str) -> DataFrame:
    """The candidate path that contains the most hints; the shortest, then the last by text, of equals."""
    score = F.size(F.filter(hints, lambda h: F.contains(F.lower(F.col(path)), F.lower(h))))
    rows = candidates.select(key, path, score.alias("__score"))
    best = rows.groupBy(key).agg(F.max(F.struct("__score", (-F.length(path)).alias("__short"), path)).alias("__best"))
    return best.select(key, F.col("__best")[path].alias(path), F.col("__best.__score").alias("hits"))


def traced(children: DataFrame, parents: DataFrame, on: str, value: str) -> DataFrame:
    """children with the parents' value under on, and status: unique, same (several, all equal), ambiguous, or missing."""
    known = parents.groupBy(on).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") == 1, "unique").when(F.col("__low").eqNullSafe(F.col("__high")), "same").otherwise("ambiguous")
    return children.join(known, on, "left").select(*children.columns, status.alias("status"), F.when(status.isin("unique", "same"), F.col("__low")).alias(value))


def enclosing(points: DataFrame, spans: DataFrame, on: str, at: str, low: str, high: str, name: str) -> DataFrame:
    """points (with a unique id) with the first span (by low, then name) under the same key that contains them; null where none does.

    A band join by levels: a span of a length up to 2 ** k lies in at most two bins of that width, and a point in one of each level that occurs,
    so a point meets only spans that begin or end near it, as seen from their own length.
    """
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), (F.col(high) - F.col(low) + 1).cast("double")))).cast("int")
    leveled = spans.where(F.col(low) <= F.col(high)).select(on, low, high, name, level.alias("__level"))
    levels = [r[0] for r in leveled.select("__level").distinct().collect()]  # 64 at most
    bin_of = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")
    binned = leveled.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(low), F.col("__level")), bin_of(F.col(high), F.col("__level")))))
    dealt = points.select("id", on, at).withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", bin_of(F.col(at), F.col("__level")))
    hit = dealt.join(binned, [on, "__level", "__bin"]).where(F.col(at).between(F.col(low), F.col(high)))
    return points.join(hit.groupBy("id").agg(F.min_by(name, F.struct(low, name)).alias(name)), "id", "left")


def last_before(points: DataFrame, marks: DataFrame, on: str, at: str, value: str, ranges: int | None = None) -> DataFrame:
    """As-of join: points with the value of the last mark at or before them under the same key. Null values are no marks; at is a number.

    A window over the union, sorted by position, in ranges of about as many rows each, staged once; the last mark of the ranges before is carried into a
    range, so neither a frequent key nor a crowd of near positions is one task's. No pair of point and mark is built. Marks at a point's position count.
    """
    rows = points.select(on, at, F.lit(1).alias("__point"), F.struct(*points.columns).alias("__row"), F.lit(None).cast(marks.schema[value].dataType).alias(value))
    rows = rows.unionByName(marks.select(on, at, F.lit(0).alias("__point"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), value))
    rows = ordered.ranged(rows, [at, "__point"], ranges)
    last = rows.where(F.col(value).isNotNull()).groupBy(on, "__range").agg(F.max_by(value, at).alias("__last"))
    seen = rows.select(on, "__range").distinct().join(last, [on, "__range"], "left")  # a row for each key and range
    carried = seen.withColumn("__carried", F.last("__last", ignorenulls=True).over(W.partitionBy(on).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))).drop("__last")
    w = W.partitionBy(on, "__range").orderBy(at, "__point").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__point = 1")
    out = inside.withColumnRenamed(on, "__on").join(carried.withColumnRenamed(on, "__key"), F.col("__on").eqNullSafe(F.col("__key")) & (inside["__range"] == carried["__range"]), "left")
    return out.select("__row.*", F.coalesce(value, "__carried").alias(value))


def closest(wanted: DataFrame, found: DataFrame, on: list[str], at: str, window: int = 10) -> DataFrame:
    """Each wanted row with the position of the nearest found row under the same keys within +-window, the earlier of equals.

    A band join: found rows go to bins of the window's width, so that a row meets three bins of candidates only.
    """
    bins = wanted.withColumn("__bin", F.explode(F.array(*(F.floor(F.col(at) / window) + k for k in (-1, 0, 1)))))
    near = found.select(*on, F.col(at).alias("__at"), F.floor(F.col(at) / window).alias("__bin")).distinct()
    delta = F.abs(F.col("__at") - F.col(at))
    hits = bins.join(near, [*on, "__bin"]).where(delta <= window).groupBy(*on, at).agg(F.min(F.struct(delta.alias("d"), F.col("__at").alias("at"))).alias("__hit"))
    return wanted.join(hits, [*on, at], "left").select(*wanted.columns, F.col("__hit.at").alias("matched"))


def preference_pairs(rollouts: DataFrame, prompt: str, order: str, good: Column, bad: Column, cap: int = 2, most: int | None = None) -> DataFrame:
    """(prompt, chosen, rejected): the first cap good with the first cap bad rollouts of each prompt, by order; at most the first `most` pairs of all, by
    prompt and order."""
    ranked = rollouts.withColumn("__side", F.when(good, 1).when(bad, 0)).where("__side is not null")
    ranked = ranked.withColumn("__n", F.row_number().over(W.partitionBy(prompt, "__side").orderBy(order))).where(F.col("__n") <= cap)
    side = lambda k, name: ranked.where(F.col("__side") == k).select(prompt, F.col(order).alias(name))
    pairs = side(1, "chosen").join(side(0, "rejected"), prompt)
    return pairs if most is None else ordered.first_rows(pairs, [prompt, "chosen", "rejected"], most)


def best_of(rows: DataFrame, key: list[str], verdict: str, ranks: dict[str, int]) -> DataFrame:
    """The verdict of the highest rank for each key."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col(verdict)), F.lit(-1))
    return rows.groupBy(*key).agg(F.max_by(verdict, F.struct(rank, verdict)).alias(verdict))


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """A gapless number by order: ranges are numbered apart, and the sizes of the ranges before are added. The ranges are staged: drawn anew for a task
    that runs again, they could be others."""
    spread = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = staged(df.repartitionByRange(int(spread), *order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    rows = parts.withColumn("__i", F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1)
    return rows.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__i") + F.col("__before")).cast("long").alias(name))


def by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """left zipped with right row by row; left's rows without a partner stay."""
    return numbered(left, left_order).join(numbered(right, right_order), "ordinal", "left")


def compared_sets(expected: DataFrame, found: DataFrame, on: list[str], group: str) -> DataFrame:
    """(group, tp, fp, fn) of two sets of rows."""
    a, b = (df.select(*on).distinct().withColumn(name, F.lit(True)) for df, name in ((expected, "__e"), (found, "__f")))
    rows = a.join(b, on, "full")
    e, f = F.coalesce("__e", F.lit(False)), F.coalesce("__f", F.lit(False))
    return rows.groupBy(group).agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))


def collected(rows: DataFrame, key: str, rank: str, order: str, value: str, same: Column, canonical: str) -> DataFrame:
    """(key, refs, n_extra): the key's canonical text first, then its values by rank and order, each only once by same."""
    # each value once before any are collected
    each = rows.groupBy(key, same.alias("__same")).agg(F.min(canonical).alias("__first"), F.min(F.when(F.col(value).isNotNull(), F.struct(rank, order, F.col(value).alias("__value")))).alias("__item"))
    out = each.groupBy(key).agg(F.min("__first").alias("__first"), F.array_sort(F.collect_list("__item")).alias("__items"))
    refs = F.concat(F.array("__first"), F.filter(F.transform("__items", lambda x: x["__value"]), lambda v: v != F.col("__first")))
    return out.select(key, refs.alias("refs"), (F.size(refs) - 1).alias("n_extra"))


def required(df: DataFrame, look: DataFrame, on: str, values: list[str]) -> DataFrame:
    """df with values looked up by a unique key; a key without a row is an error when the result is read."""
    right = look.select(on, F.struct(*values).alias("__v"))
    found = F.when(F.col("__v").isNull(), F.raise_error(F.concat(F.lit(f"no row for {on} "), F.col(on).cast("string")))).otherwise(F.col("__v"))
    return df.join(right, on, "left").withColumn("__v", found).select(*df.columns, *(F.col("__v")[c].alias(c) for c in values))
