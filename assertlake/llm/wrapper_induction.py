"""HTML extraction by wrapper induction.

Pages of one host are aligned: their trees are matched by simple tree matching (equal labels, children in order, most matched nodes at all
levels) and merged into one template of the host. A node that most of the host's pages have with the same text is constant and belongs to the template;
any other text is a slot. A list of links (MENU) in a place that most pages have is a menu, whether its links vary or not. A page's main text is what
stands in the lowest region with all of its slots, block by block, without menus and constant boxes. What its role marks as navigation, header, footer,
sidebar, notice, advert, form or comments is left out before. Copies of a story are constant on all pages that have it, and headings may be the same on
all pages of a host, so nothing in an article is template, nor a constant text of HEAVY words, nor running text (RUNNING) beside a slot.

1. Shapes. A task parses the pages that it reads. A page's shape is its tree of labels; what is running text is a leaf, and neighbours of one
   structure are folded. Pages of one host and shape come together as counts and text states, so copies count once and no text travels.
2. Templates. The shapes of a host are merged in the order of their hash, by prefixes of it: a tree of merges with the same outcome
   under any partitioning, in which no task takes in all of a large host.
3. Extraction. Pages are dealt out by (host, salt), so a large host has several tasks, each beside the host's template.

Null or empty html: empty text. Null url: host is empty. Repeated rows: each gives a row; copies count once in a template. Empty table: no
rows. Other columns are not read. A malformed page is parsed as far as it goes, in one pass: unclosed elements end with their parent, what is
nested over DEPTH deep counts as text of its ancestor, and an unclosed tag runs to the end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from assertlake.llm.common import parts, saved, settled

#: Rows of a large host that one task is to extract.
GROUP_PAGES = 250
DEPTH = 200
#: At most so many hosts are dealt out to several tasks; it doesn't touch the result.
LARGE_HOSTS = 5000
#: Words out of links that a constant text needs to count as a story's; the least number of links of a menu and their share of its words.
HEAVY, MENU, LINKED = 50, 3, 0.8
#: A template is rid of what under one in RARE of its pages have whenever SETTLED further shapes are in; only what most pages have is read from it.
RARE, SETTLED = 8, 64
#: Cells of an alignment that are held at once; larger ones are split.
CELLS = 1 << 22
#: Bits of a shape's hash that each round of merges takes off.
PREFIX, STEP = 12, 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not markup.
RAW_NAMES = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe svg math canvas head title object embed audio video nav header footer aside form button select option textarea input label fieldset dialog menu map figure-ad ins-ad".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS | frozenset("nav header footer aside form fieldset menu".split())
#: Parts of running text.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong span a li td blockquote pre".split())
#: name -> the open elements that it ends, up to a bound
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that mark a part as not being content.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widget\w*|related|recommend\w*|share|sharing|social|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|search|comments?|commentlist|replies|reply|disqus|respond|pagination|pager|skip|toolbar|tags|copyright|legal)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: The same for an article.
MARKED_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|ads?|advert\w*|sponsor\w*|promo\w*|related)(?=$|[\s_-])", re.I)
#: A tag from its name on, with quoted values; possessive, so it goes forward only.
TAG = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
BARE_TAG = re.compile(r"([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]*+))?""")
#: HTML's white space and the no-break space stay apart: only these count as white space in a block, with other Unicode spaces.
SPACES = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


class Node:
    """An element of a page. inner: a block stands in it that is not marked, at any depth."""

    __slots__ = ("name", "label", "marked", "children", "parent", "inner")

    def __init__(self, name: str, label: str = "", marked: bool = False, parent: Node | None = None):
        self.name, self.label, self.marked, self.parent, self.inner = name, label, marked, parent, False
        self.children: list[Node | str] = []


class Scanner:
    """Builds a page's tree in one pass; nothing is scanned twice but after the first tag that quotes leave open, from where on quotes don't count."""

    def __init__(self, text: str):
        self.text, self.root = text, Node("#root", "#root")
        self.at, self.open = self.root, {}
        self.tag = TAG
        self.ends: dict[str, re.Pattern] = {}

    def say(self, s: str) -> None:
        if s:
            self.at.children.append(html.unescape(s) if "&" in s else s)

    def leave(self, node: Node) -> None:
        """Closes the open elements down to node."""
        while self.at is not node:
            self.open[self.at.name] -= 1
            self.at = self.at.parent
        self.open[node.name] -= 1
        self.at = node.parent

    def parsed(self) -> Node:
        text, position, n = self.text, 0, len(self.text)
        while position < n:
            start = text.find("<", position)
            if start < 0:
                self.say(text[position:])
                break
            mark = text[start + 1 : start + 2]
            if not (mark.isascii() and mark.isalpha() or mark in ("/", "!", "?") and mark):
                self.say(text[position : start + 1])
                position = start + 1
                continue
            self.say(text[position:start])
            if mark.isalpha():
                position = self.element(start + 1)
            elif text.startswith("<!--", start) or text.startswith("<![CDATA[", start):
                close = "-->" if text[start + 2] == "-" else "]]>"
                end = text.find(close, start + 4)
                position = end + 3 if end >= 0 else n
            else:
                end = text.find(">", start)
                position = end + 1 if end >= 0 else n
                if mark == "/" and end >= 0:
                    name = text[start + 2 : end].split("/")[0].split()
                    self.closed(name[0].lower() if name else "")
        return self.root

    def closed(self, name: str) -> None:
        if self.open.get(name):
            node = self.at
            while node.name != name:
                node = node.parent
            self.leave(node)
        elif name in ("p", "br"):
            self.at.children.append(Node(name, name, False, self.at))

    def element(self, position: int) -> int:
        """Opens the element whose name is at position; returns where the text goes on."""
        m = self.tag.match(self.text, position)
        if not m and self.tag is TAG:
            self.tag = BARE_TAG
            m = self.tag.match(self.text, position)
        if not m:
            return len(self.text)
        name, attributes = m[1].lower(), m[2]
        self.end_others(name)
        node = Node(name, *named(name, attributes), self.at)
        self.at.children.append(node)
        if name in BLOCKS and not node.marked:
            above = self.at
            while above is not None and not above.inner:
                above.inner, above = True, above.parent
        if name in RAW_NAMES:
            ends = self.ends.setdefault(name, re.compile(rf"</{name}[\s/>]", re.I))
            end = ends.search(self.text, m.end())
            close = self.text.find(">", end.end() - 1) if end else -1
            return close + 1 if close >= 0 else len(self.text)
        if name not in VOID:
            self.at = node  # a slash does not close an HTML element
            self.open[name] = self.open.get(name, 0) + 1
        return m.end()

    def end_others(self, name: str) -> None:
        """Elements that end where one of this name begins."""
        for names, stop in ((CLOSES[name], P) if name in CLOSES else (P,) if name in ENDS_P else ()):
            if any(self.open.get(x) for x in names):
                node = self.at
                while node.parent is not None and node.name not in names and node.name not in stop and (node.name not in BLOCKS or "p" not in names):
                    node = node.parent
                if node.name in names:
                    self.leave(node)


P = ({"p"}, {"table", "td", "th", "button", "object"})


def named(name: str, attributes: str) -> tuple[str, bool]:
    """The label of an element, its name and class without digits, and whether its role is not content."""
    found: dict[str, str] = {}
    if attributes.strip():
        for k, v in ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), v.strip("\"'"))
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    role = found.get("role", "").lower()
    marked = name in DROPPED or role in ROLES or bool(names and MARKED.search(names)) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if name in ("html", "body", "main", "article"):
        marked = role in ROLES and name not in ("html", "body") or name == "article" and bool(MARKED_ARTICLE.search(names))
    return f"{name}.{DIGITS.sub('#', found.get('class', '').lower())}", marked


def parse(text: str) -> Node:
    """The tree of a page; strings are text with references decoded."""
    return Scanner(text).parsed()


def blocks(node: Node, without: set[int] = frozenset()) -> list[str]:
    """The texts of a subtree's blocks in page order, without marked parts and nodes of these ids; white space within is one space."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            s = SPACES.sub(" ", "".join(held)).strip()
            held.clear()
            if s:
                out.append(s)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif x is node or not x.marked and id(x) not in without:
            if x.name == "br":
                held.append(" ")
                continue
            if x.name in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(x.children))
    close()
    return out


def visible_text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not x.marked:
            stack.extend(reversed(x.children))
    return "".join(out).strip()


class Tree:
    """A node of one page or of aligned pages. text: a hash of the text, 0 without any; varies: pages differ in it; pages: how many have it;
    nodes: a page's elements (several where neighbours are folded); key and size: the structure's hash and its number of nodes."""

    __slots__ = ("label", "text", "varies", "pages", "children", "nodes", "key", "size")

    def __init__(self, label: str, text: int = 0, children: list[Tree] = (), nodes: list[Node] = (), varies: bool = False, pages: int = 1):
        self.label, self.text, self.varies, self.pages, self.nodes = label, text, varies, pages, list(nodes)
        self.set(list(children))

    def set(self, children: list[Tree]) -> None:
        self.children = children
        self.size = 1 + sum(x.size for x in children)
        self.key = xxhash.xxh3_64_intdigest("\0".join([self.label, *(str(x.key) for x in children)]).encode("utf-8", "surrogatepass"))

    @property
    def name(self) -> str:
        return self.label.partition(".")[0]

    def walk(self) -> Iterator[tuple[Tree, int]]:
        """All nodes and their depths, each before its children."""
        stack = [(self, 0)]
        while stack:
            t, depth = stack.pop()
            yield t, depth
            stack.extend((x, depth + 1) for x in reversed(t.children))


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 | 1 if text else 0


def tree_of(node: Node, depth: int = 0) -> Tree:
    """A page's tree, without marked parts and empty leaves."""
    if not node.inner or depth >= DEPTH:
        return Tree(node.label, hashed(visible_text(node)), nodes=[node])
    kids: list[Tree] = []
    for x in node.children:
        if isinstance(x, str) or x.marked:
            continue
        kid = tree_of(x, depth + 1)
        if kids and kids[-1].key == kid.key:
            for (a, _), (b, _) in zip(kids[-1].walk(), kid.walk()):
                a.text = hashed(f"{a.text} {b.text}") if a.text or b.text else 0
                a.nodes += b.nodes
        elif kid.children or kid.text:
            kids.append(kid)
    return Tree(node.label, hashed("".join(x for x in node.children if isinstance(x, str)).strip()), kids, [node])


def match(a: list[Tree], b: list[Tree], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of trees: the most matched nodes at all levels, and the pairs at the top. memo holds the matching of the
    children of two structures."""
    # equal trees at either end match: no other pair of one of the two can have more nodes
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low].key == b[low].key:
        low += 1
    high = 0
    while high < min(n, m) - low and a[n - 1 - high].key == b[m - 1 - high].key:
        high += 1
    total, pairs = aligned(a[low : n - high], b[low : m - high], memo)
    pairs = [*((i, i) for i in range(low)), *((low + i, low + j) for i, j in pairs), *((n - k, m - k) for k in range(high, 0, -1))]
    return total + sum(x.size for x in (*a[:low], *a[n - high :])), pairs


def below(x: Tree, y: Tree, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """The matching of two nodes' children."""
    if not x.children or not y.children:
        return 0, []
    if x.key == y.key:
        return x.size - 1, [(i, i) for i in range(len(x.children))]
    key = x.key, y.key
    if key not in memo:
        memo[key] = match(x.children, y.children, memo)
    return memo[key]


def best_row(row: np.ndarray, x: Tree, at: np.ndarray, b: list[Tree], memo: dict) -> np.ndarray:
    """The next row of the alignment's table; at: where x's label stands in b."""
    if not len(at):
        return row
    out = row.copy()
    out[at + 1] = np.maximum(out[at + 1], row[at] + [1 + below(x, b[j], memo)[0] for j in at.tolist()])
    return np.maximum.accumulate(out)


def places(b: list[Tree]) -> dict[str, np.ndarray]:
    out: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        out.setdefault(y.label, []).append(j)
    return {k: np.array(v) for k, v in out.items()}


NONE = np.zeros(0, np.int64)


def aligned(a: list[Tree], b: list[Tree], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """match() without its short cuts. Large tables are halved where the scores of both halves meet, so memory is bounded."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, []
    if n * m > CELLS and n > 1:
        half = n // 2
        up, down, where, back = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), places(b), places(b[::-1])
        for x in a[:half]:
            up = best_row(up, x, where.get(x.label, NONE), b, memo)
        for x in a[:half - 1 : -1]:
            down = best_row(down, x, back.get(x.label, NONE), b[::-1], memo)
        cut = int(np.argmax(up + down[::-1]))
        (p, left), (q, right) = aligned(a[:half], b[:cut], memo), aligned(a[half:], b[cut:], memo)
        return p + q, left + [(half + i, cut + j) for i, j in right]
    where = places(b)
    rows = [np.zeros(m + 1, np.int64)]
    for x in a:
        rows.append(best_row(rows[-1], x, where.get(x.label, NONE), b, memo))
    pairs, i, j = [], n, m
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return int(rows[n][m]), pairs[::-1]


def merge(template: Tree, tree: Tree, memo: dict) -> None:
    """Adds tree, of other pages, to the template."""
    _, pairs = below(template, tree, memo)
    template.pages += tree.pages
    template.varies |= tree.varies or bool(template.text and tree.text and template.text != tree.text)
    template.text = max(template.text, tree.text)
    at, out, partner = 0, [], {j: i for i, j in pairs}
    for j, child in enumerate(tree.children):
        if j in partner:
            out += template.children[at : partner[j] + 1]
            at = partner[j] + 1
            merge(out[-1], child, memo)
        else:
            out.append(child)
    template.set(out + template.children[at:])


def pruned(template: Tree) -> None:
    """Without what so few pages have that it won't be most pages' (the rest of the host comes in the order of a hash)."""
    stack = [template]
    for t in stack:
        t.children = [x for x in t.children if RARE * x.pages >= template.pages]
        stack.extend(t.children)
    for t in reversed(stack):
        t.set(t.children)


def induced(trees: list[Tree]) -> Tree:
    """The template of different pages of a host."""
    memo: dict = {}
    template, *others = sorted(trees, key=lambda t: t.key)
    for k, t in enumerate(others, 1):
        merge(template, t, memo)
        if not k % SETTLED:
            pruned(template)
            memo.clear()
    return template


def pairs_of(template: Tree | None, tree: Tree, memo: dict) -> dict[int, Tree]:
    """The template's node of each node of a page (by id) that has one."""
    out, stack = {}, [(template, tree)] if template else []
    while stack:
        t, own = stack.pop()
        out[id(own)] = t
        stack.extend((t.children[i], own.children[j]) for i, j in below(t, own, memo)[1])
    return out


def worded(tree: Tree) -> dict[int, tuple[int, int, int]]:
    """(words, words in links, links) below each node of a page's tree, without marked parts."""
    out: dict[int, tuple[int, int, int]] = {}
    for x, _ in reversed(list(tree.walk())):
        words = linked = links = 0
        stack: list = [(y, False) for n in x.nodes for y in n.children if isinstance(y, str) or not x.children]
        while stack:
            y, link = stack.pop()
            if isinstance(y, str):
                n = len(y.split())
                words, linked = words + n, linked + n * link
            elif not y.marked:
                links += y.name == "a"
                stack.extend((z, link or y.name == "a") for z in y.children)
        for y in x.children:
            words, linked, links = words + out[id(y)][0], linked + out[id(y)][1], links + out[id(y)][2]
        out[id(x)] = (words, words, links + len(x.nodes)) if x.name == "a" else (words, linked, links)
    return out


def content(page: Node, template: Tree | None, memo: dict | None = None) -> tuple[str, list[str]]:
    """The main text of a page, and the path of its region: the lowest node that holds all its slots."""
    tree = tree_of(page)
    partner = pairs_of(template, tree, {} if memo is None else memo)
    counts = worded(tree)

    def usual(x: Tree) -> Tree | None:
        """The template's node, if most pages have it."""
        t = partner.get(id(x))
        return t if t is not None and t.pages > 1 and 2 * t.pages > template.pages else None

    articles: set[int] = set()
    for x, _ in tree.walk():
        if x.name == "article" or id(x) in articles:
            articles.update([id(x), *map(id, x.children)])
    held, slots, menus, heavy, said = set(), set(), set(), set(), set()
    for x, _ in reversed(list(tree.walk())):
        k, t = id(x), usual(x)
        words, linked, links = counts[k]
        if words:
            said.add(k)
        if t is not None and k not in articles and links >= MENU and linked >= LINKED * words:
            menus.add(k)
            continue
        if x.text and (t is None or t.varies):
            slots.add(k)
        inner = any(id(y) in held for y in x.children)
        if not inner and k not in slots and words - linked >= HEAVY and 2 * linked < words:
            heavy.add(k)
        if k in slots or k in heavy or inner or x.name == "article" and words:
            held.add(k)
    if id(tree) not in held:  # nothing but what other pages have too
        held = slots = said - menus
    at, path = tree, []
    while at.name != "article" and id(at) not in slots and id(at) not in heavy:
        inner = [x for x in at.children if id(x) in held]
        if len(inner) != 1 or not inner[0].children and inner[0].name != "article":
            break
        at = inner[0]
        path.append(at.label)
    site: set[int] = set()
    stack = [at]
    while stack:
        x = stack.pop()
        if id(x) in articles or id(x) in heavy:
            continue
        beside = any(id(y) in held for y in x.children)
        for y in x.children:
            if id(y) in held:
                stack.append(y)
            elif id(y) in menus or not (beside and y.name in RUNNING):
                site.update(map(id, y.nodes))
    return "\n".join(s for node in at.nodes for s in blocks(node, site)), path


def packed(tree: Tree) -> bytes:
    """A tree as bytes: its nodes in order with depths, then their states."""
    rows = list(tree.walk())
    names = "\n".join(f"{depth} {t.label.encode('utf-8', 'replace').decode().replace(chr(10), ' ')}" for t, depth in rows).encode()
    states = np.array([(t.text, t.varies, t.pages) for t, _ in rows], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(rows).to_bytes(8, "little") + states + names)



def unpacked(blob: bytes) -> Tree:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    states = np.frombuffer(raw[8 : 8 + 24 * n], np.int64).reshape(n, 3).tolist()
    names = [x.split(" ", 1) for x in raw[8 + 24 * n :].decode().split("\n")]
    waiting: dict[int, list[Tree]] = {}
    for (depth, label), (text, varies, pages) in zip(reversed(names), reversed(states)):
        depth = int(depth)
        t = Tree(label, text, waiting.pop(depth + 1, [])[::-1], varies=bool(varies), pages=pages)
        waiting.setdefault(depth, []).append(t)
    return waiting[0][0]


SHAPES = "host string, shape long, page long, tree binary"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (host, shape, page) for each page, page a hash of the html, and rows (host, shape, tree) with the states of this task's pages."""
    held: dict[tuple[str, int], Tree] = {}

    def rows(host: list, shape: list, page: list, tree: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(shape, pa.int64()), pa.array(page, pa.int64()), pa.array(tree, pa.binary())], ["host", "shape", "page", "tree"])

    def flush() -> pa.RecordBatch:
        out = rows([h for h, _ in held], [s for _, s in held], [None] * len(held), list(map(packed, held.values())))
        held.clear()
        return out

    nodes = 0
    for batch in batches:
        hosts, shapes, pages = [], [], []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not text:
                continue
            tree = tree_of(parse(text))
            key = host, tree.key - (1 << 63)
            hosts.append(host)
            shapes.append(key[1])
            pages.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
            if key in held:
                overlaid(held[key], tree)
            else:
                for t, _ in tree.walk():
                    t.nodes = []
                held[key] = tree
                nodes += tree.size
        yield rows(hosts, shapes, pages, [None] * len(hosts))
        if nodes > 1_000_000:
            yield flush()
            nodes = 0
    if held:
        yield flush()


def overlaid(a: Tree, b: Tree) -> None:
    """Adds the texts of a page to another of the same shape."""
    for (x, _), (y, _) in zip(a.walk(), b.walk()):
        x.varies |= y.varies or x.text != y.text
        x.text = max(x.text, y.text)


TEMPLATES = "host string, prefix long, tree binary"


def _merged(last: bool):
    """Rows (host, prefix, shape, pages, tree), sorted, of shapes or templates -> a template for each (host, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, template, shape, own, memo, merged = None, None, None, None, {}, 0

        def settle_shape() -> None:
            nonlocal template, own, merged
            if own is not None and template is None:
                template, merged = own, 0
            elif own is not None:
                merge(template, own, memo)
                merged += 1
                if not merged % SETTLED:
                    pruned(template)
                    memo.clear()
            own = None

        def finish() -> pa.RecordBatch:
            if last or template.pages >= SETTLED:
                pruned(template)
            return pa.RecordBatch.from_arrays([pa.array([group[0]], pa.string()), pa.array([group[1]], pa.int64()), pa.array([packed(template)], pa.binary())], ["host", "prefix", "tree"])

        for batch in batches:
            for host, prefix, new, pages, blob in zip(*(batch.column(c).to_pylist() for c in ("host", "prefix", "shape", "pages", "tree"))):
                if group != (host, prefix):
                    settle_shape()
                    if template is not None:
                        yield finish()
                    group, template, memo = (host, prefix), None, {}
                tree = unpacked(blob)
                if new is not None and own is not None and new == shape:
                    overlaid(own, tree)
                    continue
                settle_shape()
                shape, own = new, tree
                if pages is not None:
                    for t, _ in own.walk():
                        t.pages = pages
        settle_shape()
        if template is not None:
            yield finish()

    return run


def templates(shapes: DataFrame, n: int) -> DataFrame:
    """(host, tree): the template of each host of rows SHAPES."""
    pages = shapes.where("page is not null").groupBy("host", "shape").agg(F.count_distinct("page").alias("pages"))
    own = shapes.where("tree is not null").select("host", "shape", "tree").join(pages, ["host", "shape"])
    rows = own.select("host", F.shiftrightunsigned("shape", 64 - PREFIX).alias("prefix"), "shape", "pages", "tree")
    for bits in range(PREFIX, -1, -STEP):
        rows = rows.repartition(n, "host", "prefix").sortWithinPartitions("host", "prefix", *(["shape", "tree"] if bits == PREFIX else ["before"]))
        rows = rows.mapInArrow(settled(_merged(not bits)), TEMPLATES)
        none = F.lit(None).cast("long")
        rows = rows.select("host", F.shiftright("prefix", STEP).alias("prefix"), F.col("prefix").alias("before"), none.alias("shape"), none.alias("pages"), "tree")
    return rows.select("host", "tree")


EXTRACTED = "page_id long, url string, text string, n_chars long, wrapper string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host, a host's template before its pages."""
    host, template, memo = None, None, {}
    for batch in batches:
        rows = []
        for own, tree, page_id, url, text in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "page_id", "url", "html"))):
            if own != host:
                host, template, memo = own, None, {}
            if tree is not None:
                template = unpacked(tree)
                continue
            found, path = content(parse(text), template, memo) if text else ("", [])
            rows.append((page_id, url, found, len(found), "/".join(path)))
            if len(memo) > 100_000:
                memo.clear()
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], [x.split()[0] for x in EXTRACTED.split(", ")])


def main_text(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, wrapper; a row for each row of pages."""
    n = parts(pages.sparkSession, pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    shapes = saved(rows.select("host", "html").mapInArrow(settled(_shapes), SHAPES), "wrapper-shapes")
    own = shapes.where("page is not null")
    least = max(group_pages, own.count() // LARGE_HOSTS)
    sizes = own.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    sizes = F.broadcast(sizes.select("host", F.ceil(F.col("n") / group_pages).cast("int").alias("salts")))  # fewer than LARGE_HOSTS rows
    salts = F.coalesce("salts", F.lit(1))
    none = lambda t: F.lit(None).cast(t)
    trees = templates(shapes, n).join(sizes, "host", "left").select("host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "tree", none("long").alias("page_id"), none("string").alias("url"), none("string").alias("html"))
    salt = F.pmod(F.xxhash64("page_id", "url"), salts).cast("int")
    dealt = rows.join(sizes, "host", "left").select("host", salt.alias("salt"), none("binary").alias("tree"), "page_id", "url", "html").unionByName(trees)
    dealt = dealt.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", F.col("tree").isNull())
    return dealt.select("host", "tree", "page_id", "url", "html").mapInArrow(settled(_extract), EXTRACTED)
