"""Balanced text in plain Python: one scanner that the rewriting functions of a batch share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

OPEN, CLOSE = "([{", ")]}"


def depths(s: str, brackets: str = "([{") -> Iterator[tuple[int, str, int]]:
    """(place, character, depth outside of it) for each character; a closing bracket counts as outside."""
    depth = 0
    for i, c in enumerate(s):
        if c in CLOSE and OPEN[CLOSE.index(c)] in brackets:
            depth -= 1
        yield i, c, depth
        if c in brackets:
            depth += 1


def closing(s: str, start: int) -> int | None:
    """The place after the parenthesis that closes the one at start."""
    if s[start : start + 1] != "(":
        return None
    depth = 0
    for m in re.finditer(r"[()]", s[start:]):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return start + m.end()
    return None


def bare(s: str) -> str:
    """Without parentheses that enclose the whole."""
    s = s.strip()
    while s.startswith("(") and closing(s, 0) == len(s):
        s = s[1:-1].strip()
    return s


def split_top(s: str, operator: re.Pattern) -> tuple[str, str, str] | None:
    """(left, operator, right) at the first match outside of all brackets."""
    for i, _, depth in depths(s):
        if not depth and (m := operator.match(s, i)):
            return s[:i].strip(), m[0], s[m.end() :].strip()
    return None


def pieces(s: str, separator: str = ",") -> list[str]:
    """Parts between separators outside of all brackets."""
    cuts = [i for i, c, depth in depths(s) if c == separator and not depth]
    return [s[a:b].strip() for a, b in zip([0, *(i + 1 for i in cuts)], [*cuts, len(s)])]


def calls(s: str, head: re.Pattern) -> Iterator[tuple[re.Match, int]]:
    """Matches of head, which ends with an open parenthesis, and the place after the close; those within another are skipped. Ends at one that isn't closed."""
    at = 0
    while m := head.search(s, at):
        end = closing(s, m.end() - 1)
        if end is None:
            return
        yield m, end
        at = end


def rewritten(s: str, head: re.Pattern, change: Callable[[re.Match, str], str], skip: int = 0) -> str:
    """Each call of head (after the first skip) becomes change(match, argument)."""
    out, at = [], 0
    for k, (m, end) in enumerate(calls(s, head)):
        if k < skip:
            continue
        out += [s[at : m.start()], change(m, s[m.end() : end - 1])]
        at = end
    return "".join([*out, s[at:]])


def without_comments(s: str, spaced: bool = True) -> str:
    s = re.sub(r"/\*.*?\*/", " ", re.sub(r"//[^\n]*", " ", s or ""), flags=re.S)
    return re.sub(r"\s+", " ", s).strip() if spaced else s
