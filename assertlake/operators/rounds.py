"""Rounds and chains of costly steps over DataFrames, each staged, so that nothing that is decided is decided again.

`rounds` asks what is open, keeps the answers of a round in a folder of its own, and goes on with what they leave open. A round is done when its folder
has Spark's mark of success: a run that is killed goes on with the first round that isn't. `chain` sends rows through gates; what a gate
decides leaves with a status, the rest goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assertlake.functions import parse, rewards, rewrite
from assertlake.functions.keys import cache_key, squeezed, text
from assertlake.operators import pool
from assertlake.sources.stage import staged

Step = Callable[[DataFrame, int], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def mark(rows: DataFrame, key: str) -> dict[str, int]:
    """How many keys there are, and a sum over their hashes, whatever their order."""
    return rows.agg(F.count(key).alias("n"), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first().asDict()


def rounds(rows: DataFrame, step: Step, satisfied: Column, at: str, most: int, key: str = "key") -> DataFrame:
    """The answers of all rounds, with a column round (0, 1, ...): step(open rows, round) answers the rows whose key no answer has satisfied yet, until none
    is open or after most rounds. Folders of other rows are an error."""
    spark = rows.sparkSession
    own = mark(rows, key)
    if exists(spark, f"{at}/rows/_SUCCESS"):
        if (was := spark.read.schema("n long, sum string").json(f"{at}/rows").first().asDict()) != own:
            raise ValueError(f"{at} holds rounds of other rows: {was}, now {own}")
    else:
        spark.createDataFrame([(own["n"], own["sum"])], "n long, sum string").coalesce(1).write.mode("overwrite").json(f"{at}/rows")
    done: list[DataFrame] = []
    for k in range(most):
        path = f"{at}/round-{k:04}"
        if not exists(spark, f"{path}/_SUCCESS"):
            met = [d.where(satisfied).select(key) for d in done]
            left = rows.join(reduce(DataFrame.unionByName, met).distinct(), key, "left_anti") if met else rows
            if not left.limit(1).count():
                break
            step(left, k).write.mode("overwrite").parquet(path)
        done.append(spark.read.parquet(path).withColumn("round", F.lit(k)))
    return reduce(DataFrame.unionByName, done) if done else step(rows.limit(0), 0).withColumn("round", F.lit(0))


Gate = Callable[[DataFrame], DataFrame]


def chain(rows: DataFrame, gates: list[tuple[str, Gate]]) -> DataFrame:
    """rows through gates, each a function of the open rows that adds or sets status (null: still open) and may add columns for those after it. Every gate
    runs once over what those before leave open. The result has gate, the name of the one that decided (null: none did), and all columns."""
    decided, open_ = [], rows.withColumn("status", F.lit(None).cast("string"))
    for name, gate in gates:
        judged = staged(gate(open_), f"chain-{name}")
        decided.append(judged.where("status is not null").withColumn("gate", F.lit(name)))
        open_ = judged.where("status is null")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*decided, open_.withColumn("gate", F.lit(None).cast("string"))])


def verified(rows: DataFrame, prover: pool.Answerer, policy: pool.Policy = pool.Policy(), depth: int = 10, cache: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(key, sva, rtl) -> key, status, reward, gate, pattern, tcl, lowered, notes.

    Constant truths are VACUOUS; what can't be lowered is UNSUPPORTED, without a reward; a design without an end is an EXTRACT_ERROR; the cache (key, status)
    knows the rest, or the prover: it gets key, rtl (the design with the lowered assertion) and depth, and answers with the log of its run. Each
    gate sees only what is open, the prover each pair once. UNKNOWN counts as FAIL.
    """
    pairs = rows.select("key", text("sva").alias("sva"), text("rtl").alias("rtl"), cache_key("sva", "rtl").alias("pair"))

    def vacuous(open_: DataFrame) -> DataFrame:
        judged = open_.withColumn("why", rewrite.vacuity("sva"))
        hit = F.col("why") != ""
        return judged.withColumns({"status": F.when(hit, "VACUOUS"), "pattern": F.when(hit, "vacuous"), "tcl": F.when(hit, 0), "notes": F.when(hit, F.array(F.concat(F.lit("vacuity detected: "), "why")))}).drop("why")

    def lower(open_: DataFrame) -> DataFrame:
        texts = open_.select("sva").distinct().withColumn("x", rewrite.lower("sva"))
        judged = open_.drop("pattern", "tcl", "notes").join(texts, "sva").select("*", "x.pattern", "x.tcl", "x.notes", "x.lowered")
        return judged.withColumn("status", F.when(~F.col("x.ok"), "UNSUPPORTED")).drop("x")

    def inject(open_: DataFrame) -> DataFrame:
        judged = open_.withColumn("design", rewrite.inject("rtl", "lowered"))
        return judged.withColumns({"status": F.when(F.col("design").isNull(), "EXTRACT_ERROR"), "notes": F.when(F.col("design").isNull(), F.array(F.lit("no endmodule found in RTL"))).otherwise(F.col("notes"))})

    def known(open_: DataFrame) -> DataFrame:
        if cache is None:
            return open_
        had = cache.select(F.col("key").alias("pair"), F.col("status").alias("had")).dropDuplicates(["pair"])
        hit = F.col("had").isNotNull()
        return open_.join(had, "pair", "left").withColumns({"status": F.col("had"), "notes": F.when(hit, F.concat(F.array(F.lit("cache hit")), F.coalesce("notes", F.array().cast("array<string>")))).otherwise(F.col("notes"))}).drop("had")

    def prove(open_: DataFrame) -> DataFrame:
        asked = open_.select(F.col("pair").alias("key"), F.col("design").alias("rtl"), F.lit(depth).alias("depth"))
        logs = pool.once(asked, prover, "log string", policy=policy, partitions=partitions)
        read = F.coalesce(F.nullif(rewards.log_status(F.coalesce(F.get("answers", F.lit(0))["log"], F.lit(""))), F.lit("UNKNOWN")), F.lit("FAIL"))
        verdict = F.when(F.col("was") == "OK", read).otherwise(F.col("was"))
        return open_.join(logs.select(F.col("key").alias("pair"), F.col("status").alias("was"), "answers"), "pair").withColumn("status", verdict).drop("was", "answers")

    gates = [("vacuity", vacuous), ("lowering", lower), ("injection", inject), ("cache", known), ("prover", prove)]
    out = chain(pairs, gates)
    return out.select("key", "status", rewards.formal(F.col("status")).alias("reward"), "gate", "pattern", F.coalesce("tcl", F.lit(0)).alias("tcl"), F.coalesce("lowered", F.lit("")).alias("lowered"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), "pair")


# ---- generation in stages --------------------------------------------------------------------------------------------


def paraphrased(rows: DataFrame, model: pool.Answerer, system: str, k: int, policy: pool.Policy = pool.Policy(), temperature: float = 0.85) -> DataFrame:
    """rows (id, nl, reference_sva, ...) -> one for the description and for each of up to k paraphrases that the model's text holds: id `<id>__pp<i>`, src_id, nl,
    is_original_nl. A model that fails leaves the description alone."""
    user = F.concat(F.lit("Original NL: "), text("nl"), F.lit("\n\nReference SVA:\n```systemverilog\n"), text("reference_sva"), F.lit(f"\n```\n\nWrite {k} diverse paraphrases of the NL (one per line, no numbers)."))
    asked = staged(pool.generation(rows, system, user, 1, temperature), "paraphrase-requests")
    texts = pool.once(asked.select("key", "system", "prompt", "k", "temperature", "top_p", "max_tokens"), model, "text string", policy=policy)
    texts = texts.select("key", parse.paraphrases(F.coalesce(F.get("answers", F.lit(0))["text"], F.lit("")), k).alias("others"))
    all_ = F.concat(F.array("nl"), F.coalesce("others", F.array().cast("array<string>")))
    out = asked.join(texts, "key", "left").select(*(F.col(c) for c in rows.columns if c not in ("id", "nl")), F.col("id").alias("src_id"), F.posexplode(all_).alias("i", "nl"))
    return out.select(F.concat("src_id", F.lit("__pp"), "i").alias("id"), "nl", (F.col("i") == 0).alias("is_original_nl"), *(c for c in out.columns if c not in ("i", "nl")))


def alternatives(rows: DataFrame, model: pool.Answerer, system: str, specs: list[dict], at: str, policy: pool.Policy = pool.Policy()) -> DataFrame:
    """rows (id, nl, alt_svas array) with what the model adds in rounds, specs with temp, k and max each: assertions that are new to the row but for
    white space, in the order of rounds and answers. A round is asked once, also after a restart."""
    key = rows.select("id", "nl")

    def step(open_: DataFrame, k: int) -> DataFrame:
        asked = staged(pool.generation(open_, system, F.concat(F.lit("Generate an SVA assertion for:\n"), text("nl")), specs[k]["k"], specs[k]["temp"], max_tokens=specs[k]["max"], seed=k), "alternative-requests")
        got = pool.once(asked.select("key", "system", "prompt", "k", "temperature", "top_p", "max_tokens"), model, "text string", policy=policy)
        each = asked.select("id", "key").join(got.select("key", F.posexplode("answers").alias("place", "a")), "key")
        return each.select("id", "place", parse.extracted_sva(F.col("a")["text"], "cut").alias("sva"))

    found = rounds(key, step, F.lit(False), at, len(specs), key="id").where("sva <> ''").withColumn("norm", squeezed("sva"))
    # the first of each text, so that a row's list holds different texts only
    firsts = found.groupBy("id", "norm").agg(F.min(F.struct("round", "place", "sva")).alias("x"))
    added = firsts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("x.round", "x.place", "x.sva", "norm"))).alias("new"))
    had = F.coalesce("alt_svas", F.array().cast("array<string>"))
    own = F.transform(had, lambda s: squeezed(s))
    new = F.transform(F.filter(F.coalesce("new", F.array()), lambda x: ~F.array_contains(own, x["norm"])), lambda x: x["sva"])
    return rows.join(added, "id", "left").withColumn("alt_svas", F.concat(had, new)).drop("new")


def judged_pool(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows (id, reference_sva, alt_svas) with ref_svas and n_extra_refs: the reference, then the alternatives that verdicts (id, sva, verdict) call EQUIVALENT,
    then those stronger than it, in order, each text once but for white space."""
    alts = rows.select("id", squeezed("reference_sva").alias("own"), F.posexplode("alt_svas").alias("place", "sva"))
    rank = F.when(F.col("verdict") == "EQUIVALENT", 0).when(F.col("verdict") == "IMPLIES_LM_TO_REF", 1)
    good = alts.join(verdicts.select("id", "sva", "verdict").distinct(), ["id", "sva"]).withColumns({"rank": rank, "norm": squeezed("sva")}).where("rank is not null and norm <> own")
    firsts = good.groupBy("id", "norm").agg(F.min(F.struct("rank", "place", "sva")).alias("x"))
    extra = firsts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["sva"]).alias("extra"))
    out = rows.join(extra, "id", "left").withColumn("ref_svas", F.concat(F.array("reference_sva"), F.coalesce("extra", F.array().cast("array<string>"))))
    return out.withColumn("n_extra_refs", F.size("ref_svas") - 1).drop("extra")
