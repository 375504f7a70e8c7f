"""Assertions, properties, macros and modules out of source files: (path, text) rows in, a row for each find out.

A file is scanned once, for the tokens that can begin a find, a module or a block. Places become lines, modules and comments by look-ups in sorted
places, so nothing before a find is read again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assertlake.functions.keys import let
from assertlake.functions.scanner import closing, pieces

#: Macros with what they expand to; fixed values.
MACROS = {
    "ASSERT": "assert property (@(posedge {clk}) disable iff (({rst}) !== '0) ({prop}));",
    "ASSERT_NEVER": "assert property (@(posedge {clk}) disable iff (({rst}) !== '0) not ({prop}));",
    "ASSERT_KNOWN": "assert property (@(posedge {clk}) disable iff (({rst}) !== '0) (!$isunknown({prop})));",
    "ASSUME": "assume property (@(posedge {clk}) disable iff (({rst}) !== '0) ({prop}));",
    "COVER": "cover property (@(posedge {clk}) disable iff (({rst}) !== '0) ({prop}));",
    "ASSERT_AT_RESET": "assert property (@(posedge {rst}) $isunknown({rst}) || ({prop}));",
}
DEFAULTS = {"clk": "clk_i", "rst": "!rst_ni"}
FOUND = "path string, kind string, name string, sva string, nl_comment string, module string, line int, context string"

#: What is looked for, by its first token.
TOKEN = re.compile(
    r"\b(?P<inline>(?:assert|assume|cover) property)"
    r"|`(?P<macro>" + "|".join(sorted(MACROS, key=len, reverse=True)) + r")\s*\("
    r"|\bproperty\s+(?P<named>[A-Za-z_]\w*)\s*(?:\([^)]*\))?\s*;"
    r"|\b(?P<block>module|interface|package|program|checker)\s+(?:automatic\s+)?(?P<title>[A-Za-z_]\w*)"
)
END = re.compile(r"\bendproperty\b")
NAME = re.compile(r"[A-Za-z_]\w*")
BLANKS = re.compile(r"[ \t]*")
TEMPORAL = re.compile(r"@\s*\(\s*(?:posedge|negedge)|\|->|\|=>|##|\bs_eventually\b|\bs_until\b|\bthroughout\b|\beventually\b|\buntil\b")


@dataclass(frozen=True)
class Rules:
    """How far a statement's semicolon may be, how many comment lines count, whether block comments do, and what stands around a find: the lines
    above and below it, or null."""

    reach: int = 200
    comment_lines: int = 6
    block_comments: bool = True
    around: tuple[int, int] | None = None


SCAN = Rules()
#: Finds with the source around them.
WITH_SOURCE = Rules(reach=150, comment_lines=8, around=(5, 75))


def tidy(s: str) -> str:
    return " ".join(s.split())


class Source:
    """A file's text and the places of its tokens and lines."""

    def __init__(self, text: str, rules: Rules = SCAN):
        self.text, self.rules = text, rules
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens = list(TOKEN.finditer(text))
        self.blocks = [m for m in self.tokens if m["block"]]
        self.titles = [m for m in self.blocks if m["block"] == "module"]

    def line(self, at: int) -> int:
        """From 1."""
        return bisect_right(self.starts, at)

    def row(self, number: int) -> str:
        return self.text[self.starts[number - 1] : self.starts[number] if number < len(self.starts) else len(self.text)].rstrip("\r\n")

    def module(self, at: int) -> str:
        k = bisect_left([m.start() for m in self.titles], at) if self.titles else 0
        return self.titles[k - 1]["title"] if k else ""

    def comment(self, at: int, block: bool) -> str:
        """The comment lines right above a place; blank lines below the last are passed over."""
        held: list[str] = []
        for number in range(self.line(at) - 1, 0, -1):
            s = self.row(number).strip()
            slashes, stars = s.startswith("//"), block and (s.endswith("*/") or self.rules.comment_lines > 6 and s.startswith("/*"))
            if not (slashes or stars) and (s or held):
                break
            if slashes or stars:
                held.append((s.lstrip("/") if slashes else s.strip("/*")).strip())
            if len(held) == self.rules.comment_lines:
                break
        return " ".join(x for x in reversed(held) if x)

    def around(self, at: int) -> str | None:
        if self.rules.around is None:
            return None
        above, below = self.rules.around
        here = self.line(at)
        return "\n".join(self.row(k) for k in range(max(1, here - above), min(len(self.starts), here + below) + 1))

    def finds(self, kinds: tuple[str, ...]) -> Iterator[tuple]:
        """FOUND without the path, in the order of their places."""
        for m in self.tokens:
            kind = m.lastgroup if m.lastgroup != "title" else "block"
            found = READERS[kind](self, m) if kind in kinds else None
            if found:
                name, sva, comment = found
                yield kind, name, sva, comment, self.module(m.start()), self.line(m.start()), self.around(m.start())

    def inline(self, m: re.Match) -> tuple | None:
        """An asserted property up to its semicolon; a bare reference to a property is none."""
        start = self.text.find("(", m.end())
        end = closing(self.text, start) if start >= 0 else None
        if end is None:
            return None
        body = self.text[start + 1 : end - 1]
        if m["inline"].startswith("assert") and NAME.fullmatch(body.strip()) and not self.text[m.end() : start].strip():
            return None
        blank = BLANKS.match(self.text, end).end()
        stop = self.text.find(";", blank, blank + self.rules.reach) + 1
        return None, tidy(self.text[m.start() : stop or end] + ("" if stop else ";")), self.comment(m.start(), self.rules.block_comments)

    def named(self, m: re.Match) -> tuple | None:
        """A named property as an assertion; the names of other properties and types are none."""
        end = END.search(self.text, m.end())
        body = tidy(self.text[m.end() : end.start()].strip().rstrip(";")) if end else ""
        if not body or NAME.fullmatch(body) or "typedef" in body or "enum" in body and "{" in body:
            return None
        return m["named"], f"assert property ({body});", self.comment(m.start(), False)

    def macro(self, m: re.Match) -> tuple | None:
        end = closing(self.text, m.end() - 1)
        given = [tidy(x.replace("\\\n", " ")) for x in pieces(self.text[m.end() : end - 1])] if end else []
        sva = expanded_macro(m["macro"], given)
        return (given[0], sva, "") if sva and not NAME.fullmatch(given[1]) else None

    def block_around(self, at: int) -> tuple[str, str] | None:
        """(text, kind) of the last block opened before a place, to the first end of its kind after it."""
        k = bisect_left([m.start() for m in self.blocks], at) if self.blocks else 0
        word = f"end{self.blocks[k - 1]['block']}" if k else ""
        end = self.text.find(word, at) if k else -1
        return (self.text[self.blocks[k - 1].start() : end + len(word)], self.blocks[k - 1]["block"]) if end >= 0 else None

    def window_around(self, line: int, above: int = 40, below: int = 80, most: int = 4000) -> str:
        """The block around a line (from 1), else the lines near it; cut at most characters."""
        block = self.block_around(self.starts[line - 1])
        near = (self.row(k) for k in range(max(1, line - above), min(len(self.starts), line + below) + 1))
        return (block[0] if block else "\n".join(near))[:most]


READERS = {"inline": Source.inline, "named": Source.named, "macro": Source.macro}


def expanded_macro(macro: str, given: list[str]) -> str | None:
    """The assertion that a macro call stands for: (name, property, clock, reset), of ASSERT_AT_RESET (name, property, reset); the last ones default."""
    if macro not in MACROS or len(given) < 2:
        return None
    names = ("rst",) if macro == "ASSERT_AT_RESET" else ("clk", "rst")
    values = DEFAULTS | dict(zip(names, given[2:]))
    return f"{given[0]}: " + MACROS[macro].format(prop=given[1], **values)


def extracted(files: DataFrame, kinds: tuple[str, ...] = tuple(READERS), rules: Rules = SCAN) -> DataFrame:
    """files (path, text) -> FOUND. Files without a keyword are left out before Python sees them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch["path"], batch["text"]) for r in Source(t, rules).finds(kinds)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    words = "property" if "macro" not in kinds else r"property|`(?:ASSERT|ASSUME|COVER)"
    return files.select("path", "text").where(F.col("text").rlike(words)).mapInPandas(run, FOUND)


def modules(files: DataFrame) -> DataFrame:
    """(path, low, high, module): lines (from 0) of each module; the module's text is not copied. Each row is a file of its own, whatever others have its path."""

    def mark(s: Column, line: Column) -> Column:
        name = F.nullif(F.regexp_extract(s, r"^\s*module\s+([A-Za-z_]\w*)", 1), F.lit(""))
        return F.struct(line.cast("int").alias("line"), name.alias("name"), s.rlike(r"^\s*endmodule\b").alias("end"))

    def spans(marks: Column) -> Column:
        both = F.zip_with(F.slice(marks, 1, F.greatest(F.size(marks) - 1, F.lit(0))), F.slice(marks, 2, F.size(marks)), lambda a, b: F.struct(a["line"].alias("low"), b["line"].alias("high"), a["name"].alias("module"), b["end"].alias("closed")))
        return F.filter(both, lambda x: x["closed"] & x["module"].isNotNull())

    marks = F.filter(F.transform(F.split("text", "\r?\n"), mark), lambda m: m["name"].isNotNull() | m["end"])
    return files.select("path", F.explode(let(marks, spans)).alias("x")).select("path", "x.low", "x.high", "x.module")


def bundle(files: DataFrame, order: list[str], most_bytes: int = 500_000, most_files: int = 25) -> DataFrame:
    """(repo, text): a repository's files in order, up to the first that passes the caps, without include lines."""
    from pyspark.sql import Window as W

    w = W.partitionBy("repo").orderBy(*order)
    rows = files.withColumn("__over", ((F.sum(F.octet_length("text")).over(w) > most_bytes) | (F.row_number().over(w) > most_files)).cast("int"))
    rows = rows.withColumn("__cut", F.max("__over").over(w.rowsBetween(W.unboundedPreceding, 0))).where("__cut = 0")
    clean = F.regexp_replace("text", r"(?m)^\s*`include[^\n]*\n?", "")
    return rows.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, clean.alias("t")))), lambda x: x.t), "\n").alias("text"))
