"""URL filters by a sort-merge range join, all of it Spark SQL functions.

A host's canonical key is its labels in reverse, each followed by a dot: `en.example.net` is `net.example.en.`. All subdomains of a
rule's host then lie in one interval of keys, from `net.example.` to `net.example/` (the character after the dot). Such intervals nest
or are apart. A sweep over the sorted bounds of the rules keeps the stack of those that are open, so each bound carries the
stack that holds from there on. Bounds and pages meet in ranges, sorted by key, and each page takes the stack of the last bound before it; of the
rules on it whose path starts the page's path, the longest wins.

A range has the hosts of some registered domains (two labels), so a bound goes only to its own domain's ranges, and only that of a top-level domain
to all; a range of over RANGE_ROWS pages is salted. Rules are held in the plan RULES_AT_ONCE at a time, in the order of their keys; more are taken
in further sweeps, each of which keeps a page's longest rule so far.

Null url, or one without `://`: empty host and path, no rule, the default verdict. Repeated rows: each gives a row. Of equal rules, block wins. Very
long urls are like others. No rules: the default. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assertlake.llm.common import parts, saved

RULES_AT_ONCE = 10_000
#: Pages that one sorted range is to hold.
RANGE_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def low(self) -> str:
        return "".join(f"{x}." for x in reversed(self.host.split(".")))

    @property
    def high(self) -> str:
        return self.low[:-1] + "/"


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
STACK = "array<struct<rule:string,path:string,verdict:string>>"


def bounds(rules: tuple[Rule, ...]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """The sweep over the rules: each key where the stack changes, with the stack from there on, innermost last."""
    starts: dict[bytes, list[Rule]] = {}
    for r in dict.fromkeys(rules):
        starts.setdefault(r.low.encode(), []).append(r)
    out, stack = [], []

    def close(upto: bytes | None) -> None:
        while stack and (upto is None or stack[-1][0].high.encode() <= upto):
            end = stack.pop()[0].high
            out.append((end, [x for level in stack for x in level]))

    for key in sorted(starts):
        close(key)
        stack.append(sorted(starts[key], key=lambda r: (r.name, r.verdict)))
        out.append((stack[-1][0].low, [x for level in stack for x in level]))
    close(None)
    last = dict(out)  # of several changes at one key the last holds
    return [(k, [(r.name, r.path, r.verdict) for r in v]) for k, v in last.items()]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)).otherwise("")
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER)
    path = F.when(rest.contains("/"), F.regexp_replace(rest, r"(?s)^[^/]*", "")).otherwise("")
    return host, path


def runs(rules: Iterable[Rule] | DataFrame, size: int) -> Iterator[tuple[Rule, ...]]:
    """The rules in the order of their keys, so many at a time; of a table (host, path, verdict) the driver holds no more than these."""
    if isinstance(rules, DataFrame):
        key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
        rows = rules.select("host", "path", "verdict").where("host is not null and path is not null").orderBy(key, "path", "verdict").toLocalIterator()
        rest = (Rule(r.host, r.path, r.verdict) for r in rows)
    else:
        rest = iter(sorted(dict.fromkeys(rules), key=lambda r: (r.low, r.path, r.verdict)))
    while own := tuple(islice(rest, size)):
        yield own


BEST = "struct<n:int,m:int,b:boolean,rule:string,verdict:string>"


def swept(rows: DataFrame, rules: tuple[Rule, ...], n: int) -> DataFrame:
    """rows (page_id, host, path, key, range, salt, salts, best) with the best of these rules too."""
    spark = rows.sparkSession
    domain = lambda key: F.array_join(F.slice(F.split(key, r"\."), 1, 2), ".")
    marks = spark.createDataFrame(bounds(rules), f"key string, stack {STACK}")
    plain = F.translate("key", "/", ".")
    whole = F.size(F.split(plain, r"\.")) <= 2  # of a top-level domain
    ranges = F.when(whole, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.pmod(F.xxhash64(domain(plain)), F.lit(n)).cast("int")))
    salted = rows.where("salts > 1").groupBy("range").agg(F.first("salts").alias("salts"))
    marks = marks.select("key", "stack", F.explode(ranges).alias("range")).join(salted, "range", "left")
    marks = marks.select(
        F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "range", "key", F.lit(0).alias("kind"), "stack",
        *(F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("host", "string"), ("path", "string"), ("salts", "int"), ("best", BEST))),
    )
    rows = rows.select("salt", "range", "key", F.lit(1).alias("kind"), F.lit(None).cast(STACK).alias("stack"), "page_id", "host", "path", "salts", "best")
    sweep = W.partitionBy("range", "salt").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    merged = rows.unionByName(marks).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("open", lambda r: F.col("path").startswith(r.path))
    ranked = F.transform(fits, lambda r: F.struct(F.length(r.rule).alias("n"), F.length(r.path).alias("m"), (r.verdict == "block").alias("b"), r.rule.alias("rule"), r.verdict.alias("verdict")))
    best = F.array_max(F.array_compact(F.array(F.col("best"), F.array_max(ranked))))
    return merged.select("page_id", "host", "path", "key", "range", "salt", "salts", best.alias("best"))


def judged(pages: DataFrame, rules: Iterable[Rule] | DataFrame = RULES, default: str = "allow", range_rows: int = RANGE_ROWS, rules_at_once: int = RULES_AT_ONCE) -> DataFrame:
    """page_id, host, path, rule, verdict; a row for each row of pages. rules: Rules, or a table (host, path, verdict) of any size."""
    n = max(parts(pages.sparkSession), -(-pages.select(F.lit(1)).count() // range_rows))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    rows = rows.select("*", F.concat(F.array_join(labels, "."), F.lit(".")).alias("key"), F.pmod(F.xxhash64(F.array_join(F.slice(labels, 1, 2), ".")), F.lit(n)).cast("int").alias("range"))
    sizes = rows.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / range_rows).cast("int").alias("salts")).where("salts > 1")
    rows = rows.join(F.broadcast(sizes), "range", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))  # fewer than n rows
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), "salts").cast("int")).withColumn("best", F.lit(None).cast(BEST))
    first = True
    for own in runs(rules, rules_at_once):
        rows = swept(rows if first else saved(rows, "url-rules"), own, n)
        first = False
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle(rules: tuple[Rule, ...] = RULES, default: str = "allow") -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return rf"""
WITH rules(h, p, v) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS row_id, page_id, CASE WHEN position('://' IN url) > 0 THEN split_part(split_part(substr(url, position('://' IN url) + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
s AS (SELECT row_id, page_id, translate(split_part(coalesce(rest, ''), '/', 1), '{UPPER}', '{LOWER}') AS host, CASE WHEN position('/' IN coalesce(rest, '')) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM u),
m AS (SELECT row_id, h || p AS rule, v, row_number() OVER (PARTITION BY row_id ORDER BY length(h || p) DESC, length(p) DESC, v DESC) AS k FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{default}') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (row_id)
"""
