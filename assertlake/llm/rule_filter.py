"""Quality rules: a threshold table compiled into one projection, all of it Spark SQL functions.

METRICS names what is measured in a text; RULES bounds them. `judged` measures, `verdict` compiles the rules into
the kept column and the names of the rules that a text breaks. Nothing is shuffled.

Null text: no words, so base_failed. Empty, word-free or very long texts need no special case. Repeated rows: each
gives a row. A rule whose metric has no value (a ratio of nothing) holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the languages that are accepted.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was", "are", "be", "by", "this", "at", "from", "or", "an"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "ist", "von", "mit", "nicht", "ein", "eine", "im", "auf", "für", "sich", "es", "dem", "des"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "dans", "est", "que", "pour", "qui", "par", "sur", "au", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "las", "un", "por", "con", "no", "una", "para", "es", "al", "lo", "su"],
}


@dataclass(frozen=True)
class Rule:
    """metric must be within [low, high]; asked only of texts with at least min_words words."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02, min_words=50),
    Rule("dup_line_ratio", high=0.5),
    Rule("upper_ratio", high=0.4),
    Rule("shout_ratio", high=0.1),
    Rule("distinct_word_ratio", low=0.1, min_words=50),
)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of the whole text. Arrays are made once each, in projections of their own."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    rows = rows.select("*", n.cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    at = lambda i, k: F.get("hashes", i + k)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    rows = rows.select(
        "doc_id", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"),
        windows.alias("windows"),
    )
    rows = rows.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.col("repeats"), pairs)).drop("windows")
    twice = F.filter("pairs", lambda x, i: (x.h == F.get("pairs", i - 1).h) | (x.h == F.get("pairs", i + 1).h))
    rows = rows.withColumn("starts", F.array_sort(F.transform(twice, lambda x: x.i))).drop("pairs")
    gaps = F.aggregate(F.transform("starts", lambda x, i: F.coalesce(F.least(F.get("starts", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long")).drop("starts", "repeats")


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "upper_ratio": over("n_upper", "word_chars"),
        "shout_ratio": over("n_bangs", "n_words"),
        "distinct_word_ratio": over("n_distinct_words", "n_words"),
    }


def broken(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of metrics breaks, in the order of the table."""
    value, tests = ratios(), []
    for r in rules:
        low = value[r.metric] < r.low if r.low is not None else F.lit(False)
        high = value[r.metric] > r.high if r.high is not None else F.lit(False)
        tests.append(F.when((F.col("n_words") >= r.min_words) & F.coalesce(low | high, F.lit(False)), F.lit(r.metric)))
    return F.array_compact(F.array(*tests))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of docs: the counts, base_failed, kept, and broken_rules."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = measured(docs).withColumn("base_failed", base).withColumn("broken_rules", broken(rules))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"), F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL."""
    value = {
        "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_word_ratio": "n_stop_words / n_words",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "upper_ratio": "n_upper / nullif(word_chars, 0)",
        "shout_ratio": "n_bangs / n_words", "distinct_word_ratio": "n_distinct_words / n_words",
    }
    cases = ", ".join(f"CASE WHEN n_words >= {r.min_words} AND n_words > 0 AND coalesce({' OR '.join([f'{value[r.metric]} < {r.low}'] * (r.low is not None) + [f'{value[r.metric]} > {r.high}'] * (r.high is not None))}, false) THEN '{r.metric}' END" for r in rules)
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
r AS (SELECT row_number() OVER () AS row_id, * FROM t),
w AS (SELECT row_id, i, array_to_string(words[i : i + 4], ' ') AS win FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM r)),
d AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM w) WHERE n > 1),
c AS (SELECT row_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT row_id, i + unnest([0, 1, 2, 3, 4]) AS p FROM d) GROUP BY row_id),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
    len(list_distinct(words)) AS n_distinct_words, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_bangs,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM r LEFT JOIN c USING (row_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_filter([{cases}], lambda x: x IS NOT NULL) AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(bad) = 0 AS kept, array_to_string(bad, ',') AS broken_rules FROM b
"""
