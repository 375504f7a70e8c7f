"""The operators over pages."""

import random
import re
import time
from collections import Counter

import pytest

from assertlake.llm import url_rules, wrapper_induction as wi

URLS = [
    "http://net/", "https://a.NET/x", "http://example.net/en/1", "http://www.example.net/en/", "http://example.net/enx", "http://badexample.net/en/a", "http://example.com/de/?q=1#f", "http://x.example.com/de/a", "http://example.com/de",
    "https://org/fr/", "https://a.b.org/fr/x?y", "https://a.b.org/en/x", "ftp://u@host:80/a/b", "no scheme", "", None, "http://", "http://net", "http://net?x", "http://.net/", "x://y://z/p#?", "http://Ärger.net/a",
]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "#?":
            rest = rest.split(c, 1)[0]
        host, _, tail = rest.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = "/" + tail if "/" in rest else ""
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.path), r.verdict == "block"), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("rules", [url_rules.RULES, (), (*url_rules.RULES, url_rules.Rule("com", "/", "block"), url_rules.Rule("a.example.com", "/de/", "allow"), url_rules.Rule("a.example.com", "/", "block"))])
def test_url_rules(spark, rules):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0]), (50, "http://b.a.example.com/de/q"), (51, "http://b.a.example.com/x")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, html string, verdict string")
    got = Counter(tuple(r) for r in url_rules.judged(pages, rules, range_rows=7).collect())
    assert got == Counter((i, *plain(u, rules)) for i, u in rows)
    assert Counter(tuple(r) for r in url_rules.judged(pages, spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string"), range_rows=3, rules_at_once=2).collect()) == got
    assert url_rules.judged(pages.where("false"), rules).count() == 0


def test_many_rules(spark):
    """More rules than one sweep holds, nested and repeated, against a plain loop."""
    r = random.Random(1)
    name = lambda: ".".join(r.choices(["a", "b", "c", "net"], k=r.randrange(1, 5)))
    rules = [url_rules.Rule(name(), r.choice(["/", "/x", "/x/", "/x/y"]), r.choice(["allow", "block"])) for _ in range(300)]
    urls = [f"http://{name()}{r.choice(['', '/', '/x', '/x/y/z', '/xy'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = Counter(tuple(x) for x in url_rules.judged(pages, rules, range_rows=20, rules_at_once=70).collect())
    assert got == Counter((i, *plain(u, rules)) for i, u in enumerate(urls))


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style>{head}</head><body>{body}</body></html>"


LAYOUTS = [
    page('<nav><a href="/">Home</a></nav><article><h1>Head</h1><p>One &amp; two<br>three</p><p>Four <b>bold</b>\n five</p></article><footer>&copy; x</footer>'),
    page('<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><main><div class="sidebar">Side text here</div><article><h1>Head</h1><p>One &amp; two<br>three</p><script>var t="</p>";</script><p>Four <b>bold</b> five</article><div id="comments"><p>Reader says</p></div></main>'),
    page('<aside>Ad</aside><article><h1>Head</h1><form><input value="x">Subscribe</form><p>One &amp; two<br>three<p>Four <b>bold</b>&#32;five<div class="ad">Buy</div><section class="comments"><p>No</p></section></article>'),
    page('<article><h1>Head</h1><!-- <p>not</p> --><p>One &#38; two<br/>three</p><noscript>no</noscript><p>Four <b>bold five</p></article>'),
]


def alone(html):
    return wi.content(wi.parse(html), None)[0]


def together(pages):
    """The texts and regions of one host's pages, each beside the template of all."""
    trees = [wi.parse(p) for p in pages]
    template = wi.induced([wi.tree_of(t) for t in trees])
    return [wi.content(t, template) for t in trees]


@pytest.mark.parametrize("html", LAYOUTS)
def test_main_text_of_layouts(html):
    want = "Head\nOne & two three\nFour bold five"
    assert alone(html) == want
    assert [t for t, _ in together([html, html.replace("One", "Other")])] == [want, want.replace("One", "Other")]


def test_wrapper_without_an_article():
    """Same-host pages in plain divs: what is the same on all of them is template, what varies is content."""
    make = lambda a, b: page(f'<div class="top"><a href="/">Home</a> <a href="/x">All news</a></div><div class="body"><div class="meta">Posted by staff</div><div class="txt"><p>{a}</p><p>{b}</p></div></div><div class="low">All rights are ours</div>')
    pages = [make(f"Text number {i} is long enough to tell.", f"It ends with {i * i} words of its own.") for i in range(6)]
    text, path = together(pages)[3]
    assert path[-1] == "div.txt" and text == "Text number 3 is long enough to tell.\nIt ends with 9 words of its own."
    assert "Home" in alone(pages[3])  # without the other pages nothing tells


def test_wrapper_without_telling_names():
    """No article, no class: only the alignment tells the site's parts from the page's, also those between slots."""
    make = lambda i: page(f"<div><a>Home</a><a>News</a></div><div><h2>Title {i}</h2><div><p>You read the Daily</p></div><p>Text {i}</p><div><b>Call us</b> now</div><p>End {i}</p></div><div><p>Printed in town</p></div>")
    assert together([make(i) for i in range(9)])[4][0] == "Title 4\nText 4\nEnd 4"
    assert "Home" in alone(make(4)) and "Daily" in alone(make(4))


@pytest.mark.parametrize("n", [3, 5, 8, 20])
def test_nothing_of_an_article_is_template(n):
    make = lambda i: page(f'<article><h1>Same head</h1><p>Text {i}</p><div class="box"><p>Read more of us</p></div></article>')
    assert together([make(i) for i in range(n)])[0][0] == "Same head\nText 0\nRead more of us"


@pytest.mark.parametrize("n", [2, 5, 8, 12, 20, 100])
@pytest.mark.parametrize("tag", ["article", 'div class="txt"'])
def test_headings_that_all_pages_share(n, tag):
    make = lambda i: page(f'<div class="top"><a>Home</a></div><{tag}><h1>Dish {i}</h1><h2>Ingredients</h2><p>{i} eggs</p><h2>Method</h2><p>Boil for {i} minutes</p></{tag.split()[0]}><div class="low">Printed here</div>')
    for i, (text, _) in enumerate(together([make(i) for i in range(n)])):
        assert text == f"Dish {i}\nIngredients\n{i} eggs\nMethod\nBoil for {i} minutes"


@pytest.mark.parametrize("n", [2, 5, 8, 9, 20, 100])
@pytest.mark.parametrize("tag", ["article", 'div class="txt"'])
def test_copies_of_a_story_keep_it(n, tag):
    """Only an advert and a stamp differ from page to page; alone on the host, and among other pages."""
    story = [f"Part {k} of the story goes on for quite a few words, so that nobody takes it for a footer." for k in range(5)]
    make = lambda i: page(f'<div class="ads">Buy {i}</div><{tag}><h1>The story</h1>{"".join(f"<p>{x}</p>" for x in story)}</{tag.split()[0]}><div>stamp {i}</div>')
    own = lambda i: page(f"<{tag}><h1>Own {i}</h1><p>Other words {i}</p></{tag.split()[0]}><div>stamp {i}</div>")
    want = "\n".join(["The story", *story])
    assert [t for t, _ in together([make(i) for i in range(n)])] == [f"{want}\nstamp {i}" for i in range(n)]
    mixed = together([make(i) if i % 3 else own(i) for i in range(n)])
    assert all(t == (f"{want}\nstamp {i}" if i % 3 else f"Own {i}\nOther words {i}\nstamp {i}") for i, (t, _) in enumerate(mixed))


def test_menus_are_told_by_their_places_and_links(monkeypatch):
    """Lists of links in one place of every page go, though their links differ and no name tells; a list of links that few pages have stays."""
    r = random.Random(1)
    links = lambda n: "".join(f"<li><a href=x>{r.choice(['Home', 'News', 'Sport', 'Art'])} {r.randrange(99)}</a></li>" for _ in range(n))
    story = lambda i: f"<h1>Head {i}</h1><p>Text {i} with some <a href=y>words</a> of its own</p>" + ("<ul><li><a>Source 1</a></li><li><a>Source 2</a></li><li><a>Source 3</a></li></ul>" if i == 4 else "")
    make = lambda i: page(f"<div><ul>{links(r.randint(3, 7))}</ul></div><div>{story(i)}</div><div><ul>{links(4)}</ul></div>")
    for i, (text, _) in enumerate(together([make(i) for i in range(12)])):
        assert text == f"Head {i}\nText {i} with some words of its own" + ("\nSource 1\nSource 2\nSource 3" if i == 4 else "")


def test_given_menus_go_without_word_lists(spark, monkeypatch):
    """The given pages with the words and tags of menus and adverts taken from the lists: what is left of the menus is told by the alignment."""
    rows = [(x.url.split("/")[2], x.html) for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect() if x.html and "://" in (x.url or "")]
    hosts = {}
    for host, html in rows:
        hosts.setdefault(host, []).append(html)
    usual = {h: [wi.content(wi.parse(x), None)[0] for x in v] for h, v in hosts.items() if len(v) >= 8}
    monkeypatch.setattr(wi, "DROPPED", wi.DROPPED - {"nav", "menu"})
    monkeypatch.setattr(wi, "MARKED", re.compile(wi.MARKED.pattern.replace(r"nav\w*|menu\w*|breadcrumbs?|", ""), re.I))
    menus = {h: [re.findall(r"<nav.*?</nav>", x, re.S) for x in v] for h, v in hosts.items()}
    assert sum(map(len, usual.values())) >= 50 and any(any(m) for v in menus.values() for m in v)
    for host, texts in usual.items():
        trees = [wi.parse(x) for x in hosts[host]]
        template = wi.induced([wi.tree_of(t) for t in trees])
        for tree, text, nav in zip(trees, texts, menus[host]):
            got = wi.content(tree, template)[0]
            assert set(text.split("\n")) <= set(got.split("\n"))
            assert not any(line in got.split("\n") for n in nav if n.count("<a") >= wi.MENU for line in wi.blocks(wi.parse(n).children[0]) if line and line not in text)


def test_templates_stay_small():
    """Pages with a class of their own each: neither nodes nor time grow with the square of the pages."""
    make = lambda i: wi.tree_of(wi.parse(page("".join(f'<div class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{k}x"><p>Text {i} {k}</p></div>' for k in "abcdefgh"))))

    def cost(n):
        began = time.process_time()
        size = wi.induced([make(i) for i in range(n)]).size
        return size, time.process_time() - began

    (small, a), (large, b) = cost(400), cost(1600)
    bound = (wi.SETTLED + wi.RARE) * make(0).size  # whatever the pages
    assert small <= bound and large <= bound and b < 8 * a + 0.5


def test_main_text_over_groups(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", LAYOUTS[i % 4]) for i in range(40)] + [(90, None, None), (91, "x", ""), (92, "http://h0.example.com/z", "<p>unclosed <b>text &lt;ok&gt;"), (0, "http://h0.example.com/0", LAYOUTS[0]), (None, "http://h1.example.com", "plain   text"), (93, "http://big", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame([(*r, "clash", "c") for r in rows], "page_id long, url string, html string, text string, host string")
    got = wi.main_text(pages, group_pages=5).collect()
    want = "Head\nOne & two three\nFour bold five"
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == want for i in range(40)) and (by[90], by[91], by[92], by[None], by[93]) == ("", "", "unclosed text <ok>", "plain text", "deep")
    assert wi.main_text(pages.where("false")).count() == 0


def test_same_text_under_any_partitioning(spark):
    """Neither the order of rows nor the sizes of tasks touch the result."""
    r = random.Random(4)
    body = lambda i: "".join(f"<{t}>{r.choice(['site', 'own'])} {i if r.random() < 0.5 else ''}</{t}>" for t in r.choices(["p", "div", "h2", "ul"], k=6))
    rows = [(i, f"http://h{i % 2}/{i}", page(f"<div>{body(i)}</div><section>{body(i)}</section>")) for i in range(120)]
    results = []
    for order, n, size in ((rows, 1, 2000), (rows[::-1], 7, 10), (r.sample(rows, 120), 3, 50)):
        got = wi.main_text(spark.createDataFrame(order, "page_id long, url string, html string").repartition(n), size).collect()
        results.append(sorted((x.page_id, x.text, x.wrapper) for x in got))
    assert results[0] == results[1] == results[2] and len(results[0]) == 120


@pytest.mark.parametrize(
    "body",
    [
        '<div class="body"><h1>{a}</h1><p class="lede">{b}</p><div class="txt"><p>{c}</p><p>{d}</p></div></div>',
        "<main><h1>{a}</h1><article><p>{b}</p><p>{c}</p><p>{d}</p></article></main>",
        '<article class="x"><p>{a}</p><p>{b}</p></article><article class="y"><p>{c}</p><p>{d}</p></article>',
        '<h1>{a}</h1><div class="txt">{b}<p>{c}</p></div><div class="more"><p>{d}</p></div>',
    ],
)
def test_no_slot_is_dropped(body):
    """Headline and lede beside a long text stay, on pages of one host and on a page alone."""
    top, low = '<nav><a href="/">Home</a></nav>', '<div class="footer">All rights are ours</div>'
    texts = [dict(a=f"Head {i}", b=f"Lede {i}", c=f"Body {i} " + "word " * 200 + "end", d=f"Last {i}") for i in range(5)]
    pages = [page(top + body.format(**t) + low) for t in texts]
    for p, (text, _), t in zip(pages, together(pages), texts):
        assert text == alone(p) == "\n".join(t.values())


def test_rare_layout_of_a_host(spark):
    """Pages of a layout that few pages of a large host use keep their whole text, though they have a node at the common wrapper's path."""
    top, low = '<div class="top"><a href="/">Home</a></div>', '<div class="low">All rights are ours</div>'
    usual = lambda i: page(f'{top}<div class="body"><div class="txt"><p>Text {i}</p><p>End {i * i}</p></div></div>{low}')
    rare = lambda i: page(f'{top}<div class="body"><div class="txt"><p>Teaser {i}</p></div></div><div class="story"><h2>Story {i}</h2><p>Long {i}</p></div>{low}')
    made = {i: (rare(i), f"Teaser {i}\nStory {i}\nLong {i}") if i % 40 == 17 else (usual(i), f"Text {i}\nEnd {i * i}") for i in range(120)}
    pages = spark.createDataFrame([(i, f"http://one.example.com/{i}", x) for i, (x, _) in made.items()], "page_id long, url string, html string")
    got = wi.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == {i: t for i, (_, t) in made.items()}
    assert {r.wrapper for r in got if r.page_id % 40 != 17} == {"html./body./div.body/div.txt"}


@pytest.mark.parametrize(
    "html",
    ["<a " * 3_000_000, '<p x="' * 1_500_000, '<a ">" ' * 1_200_000, "<div>" * 300_000 + "</b>" * 300_000, "<b>" * 300_000 + "<div></div>" * 100_000, "<!--" * 2_000_000, "<script>" * 500_000, "</" * 3_000_000, "< " * 3_000_000, "<td>" * 500_000, "<li><p>" * 200_000],
)
def test_malformed_pages_take_linear_time(html):
    def seconds(text):
        began = time.process_time()
        alone(text)
        return time.process_time() - began

    # four times the text takes about four times as long; the square would be sixteen
    assert seconds(html) < 9 * seconds(html[: len(html) // 4]) + 0.5


def most_matched(x, y):
    """Simple tree matching by its definition."""
    a, b = x.children, y.children
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + most_matched(a[i], b[j]))
    return 1 + best[-1][-1] if x.label == y.label else 0


@pytest.mark.parametrize("cells", [wi.CELLS, 2])
def test_matching_is_the_most_at_all_levels(monkeypatch, cells):
    monkeypatch.setattr(wi, "CELLS", cells)
    leaf = lambda x: wi.Tree(x, 1)
    menu, text = wi.Tree("div", 0, [leaf("a"), leaf("a"), leaf("a")]), wi.Tree("div", 0, [leaf("p"), leaf("p"), leaf("p")])
    assert wi.match([menu, text], [text], {}) == (4, [(1, 0)])  # of two divs with three children each, the one with equal labels below
    r = random.Random(2)
    tree = lambda depth: wi.Tree(r.choice("abc"), r.randrange(3), [tree(depth - 1) for _ in range(r.randrange(5))] if depth else [])
    for _ in range(200):
        x, y = wi.Tree("root", 0, [tree(2) for _ in range(r.randrange(5))]), wi.Tree("root", 0, [tree(2) for _ in range(r.randrange(5))])
        n, pairs = wi.match(x.children, y.children, {})
        assert n + 1 == most_matched(x, y) == 1 + sum(most_matched(x.children[i], y.children[j]) for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        back = wi.unpacked(wi.packed(x))
        assert back.key == x.key and [t.text for t, _ in back.walk()] == [t.text for t, _ in x.walk()]
