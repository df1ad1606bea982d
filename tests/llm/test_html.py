import random
import time
from collections import defaultdict

import pytest

from guardframe.llm.html import deduce, extract, main_text, occurrences, page_tokens, parse

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="ad">buy</div><article><h1>Head &amp; line&nbsp;x</h1><p><b>One
 two.<br><p>a &lt; b<script>var t="</p>";</script> c</p><div class="comments"><p>reader</p></div></article><footer>&copy;</footer></body></html>"""


def test_marked_article():
    assert main_text(PAGE, None, frozenset()) == "Head & line x\n\nOne two.\n\na < b c"


def test_blocks_and_asides():
    page = '<header><h1>Site</h1></header><div id="side-bar">z</div><div class="content"><p>Hello <b>bo</b>ld<ul><li>a<li>b</ul><aside>no</aside>end</div><form>f<input></form><p>5 <span class="ad">x</span>< 6 &am &#65;<!-- c --><textarea>x</textarea>'
    assert [b.text for b in parse(page)[1] if not b.aside] == ["z", "Hello bold", "a", "b", "end", "5 < 6 &am A"]
    assert parse(None) == ([], []) and parse("plain")[1][0].text == "plain" and parse("<p")[1] == []


def test_template_of_unmarked_pages(spark):
    page = lambda i: f'<html><body><div class="top">Welcome to the site</div><div class="box"><p>story {i} {"word " * (i + 3)}</p><p>more {i * 7}</p></div><div class="end">All rights</div></body></html>'
    rows = [(i, f"http://www.Host.example:80/{i}", page(i)) for i in range(8)]
    rows += [(20, None, page(3)), (21, "http://other.example/", page(4)), (22, "http://www.host.example/e", None), (23, "http://www.host.example/e", ""), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = [(r["page_id"], r["text"]) for r in extract(df).collect()]
    by = dict(found)
    assert len(found) == len(rows) and by[3] == f"story 3 {'word ' * 6}".strip() + "\n\nmore 21"
    assert "Welcome" in by[21] and by[22] == by[23] == ""
    assert extract(df.where("false")).count() == 0
    clash = df.selectExpr("page_id", "url", "html", "'old' AS text", "1 AS root", "2 AS constant", "'h' AS host", "'o' AS own", "0 AS layouts", "array(3) AS templates", "4 AS key", "5 AS row", "'x' AS __host")
    again = extract(clash)
    assert again.columns == [c for c in clash.columns if c not in ("html", "text")] + ["text"]
    for r in again.collect():
        assert r["text"] == by[r["page_id"]] and (r["root"], r["constant"], r["host"], r["own"], r["layouts"], r["templates"], r["key"], r["row"], r["__host"]) == (1, 2, "h", "o", 0, [3], 4, 5, "x")


def test_deduction_keeps_the_innermost_root():
    tokens = [("html", 9, 9, 900, 1), ("html>body", 9, 9, 900, 1), ("html>body>div.x", 9, 9, 880, 1), ("html>body>div.x>p", 9, 30, 880, 5), ("html>body>div.y=ab", 9, 9, 0, 1)]
    assert deduce(tokens, 9) == ("html>body>div.x", ["html>body>div.y=ab"])


def test_template_of_marked_pages(spark):
    page = lambda i: f'<html><body><article class="post"><p>Read our app</p><p>story {i} {"word " * (i + 9)}</p></article><div class="more"><article class="teaser"><p>next {i * 7}</p></article></div></body></html>'
    df = spark.createDataFrame([(i, f"http://host.example/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    by = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert by == {i: f"story {i} {'word ' * (i + 9)}".strip() for i in range(8)}


def test_layouts_of_one_host_have_templates_of_their_own(spark):
    story = lambda i: f"<p>story {i} {'word ' * (i + 20)}</p>"
    note = lambda i: '<div class="tip"><p>Now in print</p></div>' if i % 4 == 0 else ""
    kinds = [
        lambda i: f'<div class="bar">Welcome</div><div class="box">{story(i)}<p>Call us</p>{note(i)}</div>',
        lambda i: f'<div class="bar">Bonjour</div><div class="post">{story(i)}<p>Write to us</p></div>',
        lambda i: f'<div class="bar">Hallo</div><div class="text">{story(i)}<p>Visit us</p></div>',
    ]
    rows = [(i, f"http://host.example/{i}", f"<html><body>{kinds[i % 3](i // 3)}</body></html>") for i in range(36)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == {i: f"story {i // 3} {'word ' * (i // 3 + 20)}".strip() for i in range(36)}


def test_copies_of_a_page_are_not_a_template(spark):
    page = lambda i, k: f'<html><body><div class="post-{k}"><p>story {k} {"word " * 9}</p></div><p>tail {i} {"end " * 9}</p></body></html>'
    rows = [(i, f"http://host.example/{i}", page(i if i > 2 else 0, max(i, 2))) for i in range(9)]
    by = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i].startswith("story 2 word") for i in range(3)) and by[0] == by[2]


def test_wrappers_do_not_hide_the_page():
    body = '<h1>Head</h1><p>the story</p><div class="comments">reader</div>'
    for start, end in (('<div class="layout has-sidebar">', "</div>"), ('<div id="page-with-comments">', "</div>"), ('<form action="/x">', "</form>"), ('<div class="widget">', "</div>")):
        assert main_text(f"{start}{body}{end}", None, frozenset()) == "Head\n\nthe story", start
        assert main_text(f"{start}<article>{body}</article>{end}<p>more</p>", None, frozenset()) == "Head\n\nthe story", start
    teaser = '<div class="related"><article>next</article></div>'
    assert main_text(f"<article><p>the long story</p></article>{teaser}", None, frozenset()) == "the long story"


def test_repeated_rows_keep_their_text(spark):
    page = lambda i: f'<html><body><div class="bar">Welcome all</div><article><p>story {i} {"word " * 20}</p></article></body></html>'
    rows = [(i, f"http://a.example/{i}", page(7)) for i in range(12)] + [(50, "http://a.example/x", page(7))] * 9 + [(60 + i, f"http://a.example/{i}", page(100 + i)) for i in range(3)]
    rows += [(90, "http://b.example/x", page(1))] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for r in extract(df).collect():
        k = 7 if r["page_id"] <= 50 else 1 if r["page_id"] == 90 else r["page_id"] + 40
        assert r["text"].endswith(f"story {k} {'word ' * 20}".strip()), r


def test_occurrence_vectors_by_brute_force(spark):
    """Tokens are in one class if and only if they have the same counts page by page."""
    rng = random.Random(3)
    part = lambda: rng.choice(["<p>one</p>", "<div class=a><b>two</b></div>", "<ul><li>x<li>y</ul>", "<div class=a>three</div>", ""])
    pages = [f"<html><body>{''.join(part() for _ in range(5))}</body></html>" for _ in range(12)]
    df = spark.createDataFrame([("h", str(i), p, ["none"]) for i, p in enumerate(pages)], "host string, key string, html string, layouts array<string>").repartition(3)
    found, plain = defaultdict(set), defaultdict(set)
    for r in occurrences(df).collect():
        found[r["pages"], r["times"], r["vector"]].add(r["token"])
    counts = [page_tokens(parse(p)) for p in pages]
    for token in {t for c in counts for t in c}:
        plain[tuple(c.get(token, (0, 0))[0] for c in counts)].add(token)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, plain.values())) and len(plain) > 5


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div class=x>" * 100_000 + "text", "<b>" * 50_000 + "<div>a</div>" * 20_000, "<p>" + "word " * 300_000, "<" * 500_000, "<title>" * 100_000, "<a '" * 100_001 + "x", "</p>" * 200_000, "<!--" * 200_000, "&" * 400_000, "<li class='a=b>c'>" * 50_000])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    tokens = page_tokens(parse(page))
    main_text(page, None, frozenset())
    assert time.process_time() - began < 10 and sum(len(t) for t in tokens) < 4_000_000


def test_names_cannot_pass_for_blocks():
    paths, blocks = parse('<div class="a=b x>y"><p>t</p></div>')
    assert paths == ["div.a_b.x_y", "div.a_b.x_y>p"] and blocks[0].path == paths[1]
    deep = parse("<div>" * 1000 + "<p>inside</p>")[1]
    assert [b.text for b in deep] == ["inside"]


def test_templates_that_are_not_broadcast(spark, monkeypatch):
    from guardframe.llm import html

    page = lambda i: f'<html><body><div class="top">Welcome to the site</div><div class="box"><p>story {i} {"word " * (i + 3)}</p></div></body></html>'
    df = spark.createDataFrame([(i, f"http://host{i % 2}.example/{i}", page(i)) for i in range(12)] + [(0, "http://host0.example/0", page(0))], "page_id long, url string, html string").repartition(3)
    found = sorted(map(tuple, extract(df).collect()))
    assert 0 < html._sized(html._counted(df.selectExpr("'h' AS host", "url AS key", "html"))) and len(found) == 13
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, extract(df).collect())) == found
