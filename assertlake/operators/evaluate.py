"""Aggregates of an evaluation: success at k, reports, losses, advantages, streaks and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assertlake.operators import ordered


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product so that nothing overflows."""
    miss = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)).cast("int")), F.lit(1.0), lambda a, i: a * (n - c - i) / F.greatest(n - i, F.lit(1)))
    return F.when(c <= 0, 0.0).when((k >= n) | (n - c < k), 1.0).otherwise(1.0 - miss)


def func_at_k(tasks: DataFrame, ks: list[int], stratum: str = "tcl") -> DataFrame:
    """tasks (tcl, n, strict, relaxed, evaluable) -> (tcl or null for all, k, tasks, func, relaxed) in percent over evaluable tasks."""
    rows = tasks.select(stratum, "n", "strict", "relaxed", "evaluable", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    part = lambda c: F.when(F.col("evaluable"), pass_at_k(F.col("n"), F.col(c), F.col("k"))).otherwise(0.0)
    rows = rows.select(stratum, "k", F.col("evaluable").cast("int").alias("e"), part("strict").alias("s"), part("relaxed").alias("r"))
    sets = rows.groupingSets([[F.col("k")], [F.col(stratum), F.col("k")]], stratum, "k")
    share = lambda c: F.round(100 * F.sum(c) / F.greatest(F.sum("e"), F.lit(1)), 2)
    return sets.agg(F.sum("e").alias("tasks"), share("s").alias("func"), share("r").alias("relaxed"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1))


def classifier_report(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts of (gold, predicted), with each gold level's size and accuracy."""
    counts = rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(gold))
    right = F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).over(W.partitionBy(gold))
    return counts.select(gold, predicted, "n", total.alias("gold_n"), (right / total).alias("accuracy"))


def spread(x: str) -> list[Column]:
    """Minimum, maximum, whole-number mean and upper median. The median is the exact percentile's next value up: of counted values, not of lists."""
    return [F.min(x).alias("low"), F.max(x).alias("high"), F.expr(f"sum({x}) div count({x})").alias("mean")]


def upper_median(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, median): the value at place n // 2 of the sorted values, by counts of values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy(x))
    rows = counts.select(*by, x, upto.alias("upto"), F.sum("n").over(W.partitionBy(*by)).alias("total"))
    return rows.where(F.col("upto") > F.expr("total div 2")).groupBy(*by).agg(F.min(x).alias("median"))


def histogram(df: DataFrame, x: str, n: int) -> DataFrame:
    """Counts of 0 to n, those without rows too."""
    every = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias(x))
    return every.join(df.groupBy(F.col(x).cast("int").alias(x)).agg(F.count(F.lit(1)).alias("n")), x, "left").select(x, F.coalesce("n", F.lit(0)).alias("n"))


def unit_bins(x: Column, n: int = 11) -> Column:
    """Bins 1 to n of [0, 1], the last closed."""
    return F.least(F.lit(n), F.width_bucket(x, F.lit(0.0), F.lit(1.0), F.lit(n)))


def precision_recall(rows: DataFrame) -> DataFrame:
    """Micro averages of (tp, fp, fn); 1 where there is nothing to find."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return rows.agg(F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(1.0)).alias("precision"), F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(1.0)).alias("recall"), F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("perfect"))


def shift(rows: DataFrame, before: str, after: str) -> DataFrame:
    """How often each verdict occurs before and after."""
    both = rows.select(F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col(before).alias("verdict")), F.struct(F.lit(2).alias("s"), F.col(after).alias("verdict")))).alias("x")).select("x.*")
    return both.groupBy("verdict").agg(F.count_if(F.col("s") == 1).alias("n_before"), F.count_if(F.col("s") == 2).alias("n_after"))


def coverage(rows: DataFrame, file: str, key: str, master: DataFrame) -> DataFrame:
    """(file, n_keys, n_covered, redundant): the distinct keys of each file, and those that master has."""
    own = rows.select(file, key).where(F.col(key) != "").distinct().join(master.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return own.groupBy(file).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if("__in").alias("n_covered"), F.bool_and(F.coalesce("__in", F.lit(False))).alias("redundant"))


#: What marks a token as temporal; fixed values.
TEMPORAL = ["##", "[*", "[=", "|->", "|=>", "until", "eventually", "s_eventually", "s_until", "s_always", "throughout", "within", "intersect", "$rose", "$fell"]


def is_temporal(token: Column) -> Column:
    return F.exists(F.array(*map(F.lit, TEMPORAL)), lambda op: F.contains(token, op))


def temporal_weight(token: Column, alpha: float = 3.0) -> Column:
    return F.when(is_temporal(token), alpha).otherwise(1.0)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log(softmax at the label + 1e-12); the label is clipped to the vocabulary."""
    top_ = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top_))
    at = F.greatest(F.lit(0), F.least(label, F.size(logits) - 1))
    return -F.log(F.exp(F.get(logits, at) - top_) / total + F.lit(1e-12))


def weighted_loss(ce: Column, weight: Column, label: Column, by_weight: bool = False) -> Column:
    """Weighted cross-entropy over labels other than -100, by their number or (the first version) by their weight; 0 without any."""
    valid = label != -100
    below = F.sum(F.when(valid, weight if by_weight else F.lit(1.0)).otherwise(0.0))
    return F.coalesce(F.sum(F.when(valid, weight * ce).otherwise(0.0)) / F.nullif(below, F.lit(0.0)), F.lit(0.0))


def distillation(loss: Column, weight: Column) -> Column:
    """The weighted mean of losses; null where all weights are 0."""
    return F.sum(loss * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def advantages(rows: DataFrame, group: str, reward: str, eps: float = 1e-8) -> DataFrame:
    """Adds advantage within the group (0 for a single row) and collapsed (no variance). Groups are aggregated, then joined: none is windowed."""
    stats = rows.groupBy(group).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"), F.count(F.lit(1)).alias("__n"))
    value = F.when(F.col("__n") == 1, 0.0).otherwise((F.col(reward) - F.col("__m")) / (F.col("__s") + eps))
    return rows.join(stats, group).select(*rows.columns, value.alias("advantage"), ((F.col("__n") < 2) | (F.col("__s") < 1e-6)).alias("collapsed"))


EARLIER = (W.unboundedPreceding, -1)


def carried(rows: DataFrame, group: str, **sums: Column) -> DataFrame:
    """ranged rows with, under each name, the aggregate of the group's rows in the ranges before (null without any): sums of sums and the greatest of maxima,
    by the name's end (_sum or _max). A row for each group and range is added up, so a group with most of the rows is not one task's."""
    over = W.partitionBy(group).orderBy("__range").rowsBetween(*EARLIER)
    parts = rows.groupBy(group, "__range").agg(*((F.sum if n.endswith("_sum") else F.max)(c).alias(n) for n, c in sums.items()))
    parts = parts.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), *((F.sum if n.endswith("_sum") else F.max)(n).over(over).alias(n) for n in sums))
    return rows.join(parts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__of"))).drop("__group", "__of")


def best_so_far(rows: DataFrame, run: str, step: str, score: str, ranges: int | None = None) -> DataFrame:
    """Adds best (the greatest score before), improved, and bad_streak: how many evaluations since the last improvement."""
    inside = W.partitionBy(run, "__range").orderBy("__place")
    own = carried(ordered.ranged(rows, [run, step], ranges), run, __best_max=F.col(score), __n_sum=F.lit(1))
    best = F.greatest("__best_max", F.max(score).over(inside.rowsBetween(*EARLIER)))
    at = F.coalesce("__n_sum", F.lit(0)) + F.row_number().over(inside)
    own = own.withColumns({"best": best, "__at": at}).withColumn("improved", F.col("best").isNull() | (F.col(score) > F.col("best")))
    own = carried(own, run, __last_max=F.when(F.col("improved"), F.col("__at")))
    last = F.greatest("__last_max", F.max(F.when(F.col("improved"), F.col("__at"))).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return own.withColumn("bad_streak", (F.col("__at") - last).cast("int")).select(*rows.columns, "best", "improved", "bad_streak")


def running_cap(rows: DataFrame, group: str, order: str, size: str, cap: int, ranges: int | None = None) -> DataFrame:
    """Rows up to the first that takes the group's running size over the cap; what comes after it goes too."""
    inside = W.partitionBy(group, "__range").orderBy("__place").rowsBetween(W.unboundedPreceding, 0)
    own = carried(ordered.ranged(rows, [group, order], ranges), group, __before_sum=F.col(size))
    own = own.withColumn("__over", F.coalesce(F.coalesce("__before_sum", F.lit(0)) + F.coalesce(F.sum(size).over(inside), F.lit(0)) > cap, F.lit(False)).cast("int"))
    own = carried(own, group, __cut_max=F.col("__over"))
    return own.where((F.coalesce("__cut_max", F.lit(0)) == 0)).withColumn("__cut", F.max("__over").over(inside)).where("__cut = 0").select(*rows.columns)


def transitions(rows: DataFrame, trace: list[str], cycle: str, value: str) -> DataFrame:
    """(trace, cycle, kind): rising from 0, falling to 0, or change."""
    w = W.partitionBy(*trace).orderBy(cycle)
    out = rows.withColumn("__before", F.lag(value).over(w)).where(F.col("__before").isNotNull() & (F.col("__before") != F.col(value)))
    kind = F.when((F.col("__before") == 0), "rising").when(F.col(value) == 0, "falling").otherwise("change")
    return out.select(*trace, cycle, kind.alias("kind"))


def evaluable(tasks: DataFrame, verdicts: DataFrame, on: str, default: bool) -> DataFrame:
    """tasks with evaluable: whether the reference is equivalent to itself; default where it was not checked."""
    known = verdicts.select(on, (F.col("verdict") == "EQUIVALENT").alias("__e"))
    return tasks.join(known, on, "left").select(*tasks.columns, F.coalesce("__e", F.lit(default)).alias("evaluable"))


def contingency(left: DataFrame, right: DataFrame, on: str, flag: str) -> DataFrame:
    """Counts of both, only_left, only_right and neither over the keys of both sides."""
    a, b = left.select(on, F.col(flag).alias("__a")), right.select(on, F.col(flag).alias("__b"))
    x, y = F.col("__a"), F.col("__b")
    return a.join(b, on).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_left"), F.count_if(~x & y).alias("only_right"), F.count_if(~x & ~y).alias("neither"))


def roll_up(rows: DataFrame, level: str, columns: list[str]) -> DataFrame:
    """Sums by class of levels."""
    from assertlake.functions.classify import temporal_class

    return rows.groupBy(temporal_class(F.col(level)).alias("class")).agg(*(F.sum(c).alias(c) for c in columns))


def mutation_deltas(rows: DataFrame, kind: str, reward: str, golden: str = "golden") -> DataFrame:
    """(kind, mean, delta): each mutation's mean reward and how far it is below the golden one's."""
    means = rows.groupBy(kind).agg(F.avg(reward).alias("mean"))
    top = means.where(F.col(kind) == golden).select(F.col("mean").alias("__g"), F.lit(1).alias("__k"))
    return means.withColumn("__k", F.lit(1)).join(top, "__k").select(kind, "mean", (F.col("__g") - F.col("mean")).alias("delta"))


def level_report(rows: DataFrame, expected: str, generated: str, syntax_ok: Column, body_match: Column) -> DataFrame:
    """(level or null for all, total, syntax_ok, level_match, body_match, their rates, mean_shift, mean_distance): how far generated levels are from the expected ones. A
    level counts where the syntax is right; shift is generated less expected. One aggregation for the levels and the whole."""
    level = F.when(syntax_ok, F.col(generated))
    own = rows.select(F.col(expected).alias("level"), syntax_ok.alias("ok"), F.coalesce(level == F.col(expected), F.lit(False)).alias("hit"), F.coalesce(body_match, F.lit(False)).alias("same"), (level - F.col(expected)).alias("shift"))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 4)
    return own.groupingSets([[], [F.col("level")]], "level").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("syntax_ok"), F.count_if("hit").alias("level_match"), F.count_if("same").alias("body_match"),
        share(F.col("ok")).alias("syntax_rate"), share(F.col("hit")).alias("match_rate"), share(F.col("same")).alias("body_rate"),
        F.round(F.avg("shift"), 4).alias("mean_shift"), F.round(F.avg(F.abs("shift")), 4).alias("mean_distance"),
    )
