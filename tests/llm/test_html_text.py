import random
import time

import pytest

from lamina.llm import html_text as h

ARTICLE = "<h1>Title &amp; more</h1><p>First  para<b>graph</b>.<br>Second\nline<p>Third &eacute; &lt;x&gt;"


def blocks(page):
    return h.main_blocks(page, None, frozenset())


@pytest.mark.parametrize(
    "noise",
    [
        "<nav><ul><li><a href='/'>Home</a></ul></nav>", "<header><h2>Site</h2></header>", "<footer>&copy; us</footer>", "<aside>More</aside>", "<div class='sidebar'>Side</div>",
        "<div class=\"cookie-notice\">We use cookies</div>", "<div id=ad-top>Buy</div>", "<form><label>Mail</label><input></form>", "<script>var t='</p>';</script>", "<style>p{}</style>",
        "<!-- hidden <p>x</p> -->", "<section class='comments'><article class='comment'><p>I disagree</p></article></section>", "<div hidden>No</div>", "<noscript>Enable</noscript>", "<div style='display: none'>No</div>",
    ],
)
def test_noise_goes_wherever_it_stands(noise):
    want = ["Title & more", "First paragraph. Second line", "Third é <x>"]
    assert blocks(f"<html><head><title>T</title></head><body>{noise}<article>{ARTICLE}</article>{noise}</body>") == want
    assert blocks(f"<body><main>{noise}{ARTICLE}{noise}</main>") == want
    assert blocks(f"<body>{noise}<div>{ARTICLE}</div>{noise}") == want


def test_odd_pages():
    assert blocks("") == [] and blocks("just text") == ["just text"]
    assert blocks("<article><p>cut off") == ["cut off"]
    assert blocks("<p>a < b & c</p><p>AT&T</p>") == ["a < b & c", "AT&T"]
    assert blocks("<article><header><h1>T</h1><p>by me</p></header><p>x</p></article>") == ["T", "x"]
    assert blocks("<article><table><tr><td>1<td>2</table></article>") == ["1", "2"]


def test_template_finds_the_slot(spark):
    """Pages of one host without telling names: the deepest container that holds most text is the slot."""
    page = lambda i: f"<div class=top><span>Shop {i % 3}</span></div><div class=wrap><div class=body><p>{'text %d ' % i * 30}</p></div><div class=low>x{i}</div></div>"
    rows = [(i, "http://a.example/x", page(i)) for i in range(12)] + [(99, None, None), (100, "http://b.example/", page(1)), (None, "http://a.example/y", page(7))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as slot", "'h' as host")
    got = {r.page_id: r for r in h.main_text(df).collect()}
    assert got[5].text == ("text 5 " * 30).strip() and got[5].n_chars == len(got[5].text)
    assert got[99].text == "" and got[99].n_chars == 0 and got[None].text == ("text 7 " * 30).strip()
    assert "Shop" in got[100].text  # a single page has no template
    assert h.main_text(df.where("false")).count() == 0


def test_copies_are_no_template(spark):
    """A third of a host's pages being one article does not turn its text into boilerplate."""
    art = lambda t: f"<nav>m</nav><article><h1>{t}</h1><p>{t} body</p></article>"
    rows = [(i, "http://a.example/", art("same")) for i in range(40)] + [(40 + i, "http://a.example/", art(f"other {i}")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in h.main_text(df).collect() if r.page_id < 40} == {"same\nsame body"}


def test_unmarked_pages_keep_all_parts(spark):
    """Headings, lists, quotes and tables of the slot stay; wrappers without text of their own hide nothing."""
    def page(i):
        parts = [f"<h1>Head {i}</h1>", *(f"<p>{f'para {i} {j} ' * 20}</p>" for j in range(4)), f"<ul><li>item {i} a<li>item {i} b</ul>", f"<blockquote>quote {i}</blockquote>", f"<table><tr><td>cell {i}<td>other {i}</table>"]
        return f"<body><div class=outer><div class=top>Menu {i % 2}</div><div class=wrap><div class=content>{''.join(parts)}</div></div><div class=low>low {i}</div></div></body>"

    df = spark.createDataFrame([(i, "http://a.example/", page(i)) for i in range(5)], "page_id long, url string, html string")
    for r in h.main_text(df).collect():
        i = r.page_id
        want = [f"Head {i}", *((f"para {i} {j} " * 20).strip() for j in range(4)), f"item {i} a", f"item {i} b", f"quote {i}", f"cell {i}", f"other {i}"]
        assert r.text.split("\n") == want


def test_repeated_sections_are_no_slot(spark):
    page = lambda i: f"<div class=content><h1>Head {i}</h1>" + "".join(f"<div class=part><h2>sub {i} {j}</h2><p>{f'text {i} {j} ' * 9}</p></div>" for j in range(3)) + f"</div><div class=low>low {i}</div>"
    df = spark.createDataFrame([(i, "http://a.example/", page(i)) for i in range(4)], "page_id long, url string, html string")
    assert all(f"Head {r.page_id}" in r.text and "low" not in r.text for r in h.main_text(df).collect())


@pytest.mark.parametrize("pages", [3, 12])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_long_template_texts_go(spark, pages, tag):
    legal = "This long legal line stands on each page of the host. " * 6
    df = spark.createDataFrame([(i, "http://a.example/", f"<{tag}><h1>T {i}</h1><p>{f'own {i} ' * 30}</p><p>{legal}</p></{tag}>") for i in range(pages)], "page_id long, url string, html string")
    for r in h.main_text(df).collect():
        assert r.text == f"T {r.page_id}\n" + (f"own {r.page_id} " * 30).strip()


def test_markup_lies_and_the_template_does_not(spark):
    """The article is in a form > div.sidebar; <article> holds adverts."""
    page = lambda i: f"<body><article><p>Buy {i % 2}</p></article><form><div class=sidebar><h1>Head {i}</h1><p>{f'own {i} ' * 40}</p><p class='notice'>note {i}</p></div></form><main>Menu</main></body>"
    df = spark.createDataFrame([(i, "http://a.example/", page(i)) for i in range(8)], "page_id long, url string, html string")
    for r in h.main_text(df).collect():
        assert r.text.split("\n")[:2] == [f"Head {r.page_id}", (f"own {r.page_id} " * 40).strip()] and "Buy" not in r.text and "Menu" not in r.text


def planted(i, kind):
    """An article and the page that it stands in; only the template and the make of its parts tell on most hosts."""
    h1, lead = f"Head {i} of all", f"Lead {i} says what is in it."
    body = [f"para {i} {j} " * 30 for j in range(4)]
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    low, top = f"<div class=low>low {i}</div>", f"<div class=top>Menu {i % 2}</div><ul><li><a href=/>a {i}</a><li><a href=/>b</a></ul>"
    sections = [[f"one {i} " * 40], [f"two {i} {j} " * 60 for j in range(3)], [f"three {i} " * 30]]
    made = {
        "marked": (f"<article><h1>{h1}</h1><p>{lead}</p><div class=body>{p(body)}</div></article>", [h1, lead, *body]),
        "bare lead": (f"<article><div class=lead>{lead}</div><div class=body>{p(body)}</div></article>", [lead, *body]),
        "header": (f"<article><header><h1>{h1}</h1><p>by me</p></header><div class=body>{p(body)}</div></article>", [h1, *body]),
        "unmarked": (f"<div class=story><h1>{h1}</h1><p class=lead>{lead}</p><div class=text>{p(body)}</div></div>", [h1, lead, *body]),
        "unmarked header": (f"<div class=story><header><h1>{h1}</h1></header><div class=in><div class=text>{p(body)}</div></div></div>", [h1, *body]),
        "sections": ("<article>" + "".join(f"<section class=s{k}>{p(x)}</section>" for k, x in enumerate(sections)) + "</article>", [t for x in sections for t in x]),
        "unmarked sections": ("<div class=story>" + "".join(f"<div class=s{k}><h2>part {k} {i}</h2>{p(x)}</div>" for k, x in enumerate(sections)) + "</div>", [t for k, x in enumerate(sections) for t in [f"part {k} {i}", *x]]),
        "names lie": (f"<div class=footer><h1>{h1}</h1><div class=widget>{p(body)}</div></div>", [h1, *body]),
        "adverts in turn": (f"<div class=story><h1>{h1}</h1><div class=text>{p(body)}</div></div><div class=x><h3>Buy {i % 2}</h3><p>{f'It is cheap {i % 2} ' * 40}</p></div>", [h1, *body]),
    }
    article, want = made[kind]
    return f"<body>{top}{article}{low}</body>", "\n".join(t.strip() for t in want)


@pytest.mark.parametrize("kind", ["marked", "bare lead", "header", "unmarked", "unmarked header", "sections", "unmarked sections", "names lie", "adverts in turn"])
def test_no_part_of_an_article_is_lost(spark, kind):
    pages = [(i, "http://a.example/", planted(i, kind)[0]) for i in range(8)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: planted(i, kind)[1] for i in range(8)}


def test_links_in_a_page_without_template():
    page = "<body><ul><li><a href=/>one</a><li><a href=/>two</a></ul><p><a href=/>A linked paragraph.</a></p><div><a href=/>more</a></div><h2><a href=/>Linked head</a></h2><ul><li><a href=/>in</a> a list<li><a href=/>linked item</a></ul></body>"
    assert blocks(page) == ["A linked paragraph.", "Linked head", "in a list", "linked item"]


def test_names_inside_an_article():
    inside = "<p class='notice-of-meeting'>a</p><div class='share-price'>b</div><p id='reply-to-critics'>c</p><div class='comment-list'>d</div><p title=\"5\" tall\">e</p>"
    assert blocks(f"<article>{inside}</article>") == ["a", "b", "c", "e"]


def test_long_and_broken_pages_take_linear_time():
    began = time.process_time()
    for text in ("<a " * 350_000, '<a b="' * 170_000 + ">", "<div>" * 200_000 + "</p>" * 200_000, "<b>" * 300_000 + "<p>x</p>" * 10_000, "<" * 10**6, "&amp;" * 200_000, "<!--" * 250_000, "</" * 500_000):
        blocks(text)
    assert time.process_time() - began < 30
    assert len(blocks("<a " * 350_000)[0]) > 10**6 - 1


def test_templates_against_brute_force(spark):
    """Occurrence vectors kept as lists of counts give the same slot and fixed tokens."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        host = f"h{rng.randrange(6)}.example"
        low = "<div class=low>imprint</div>" if rng.random() < 0.8 else ""
        body = "".join(f"<p>{i} {j} {'word ' * rng.randint(1, 30)}</p>" for j in range(rng.randint(1, 4)))
        rows.append((i, f"http://{host}/{i}", f"<div class=top>{host}</div><div class=mid><div class=text>{body}</div></div>{low}" if rng.random() < 0.9 else f"<div>{body}</div>"))
    rows += rows[:7]  # repeated pages count once
    got = {r.host: (r.slot, sorted(r.fixed)) for r in h.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hosts = {}
    for _, url, text in rows:
        page = h.parse(text)
        noise, _ = h.inherited(page)
        key = "\n".join(t for t, i, _ in page.blocks if noise[i] == h.PLAIN)
        hosts.setdefault(h.host_of(url), {})[key] = page
    want = {}
    for host, pages in hosts.items():
        n = len(pages)
        if n < h.MIN_PAGES:
            continue
        vectors, length, deep, texts, total = {}, {}, {}, set(), 0
        for k, page in enumerate(pages.values()):
            for t, i, _ in page.blocks:
                total += len(t)
                token = h._token(page.place[i], t)
                vectors.setdefault(token, [0] * n)[k] += 1
                texts.add(token)
                while i >= 0:
                    length[page.place[i]] = length.get(page.place[i], 0) + len(t)
                    i = page.up[i]
            for i, p in enumerate(page.place):
                if page.tag[i] not in h.PARTS:
                    vectors.setdefault(p, [0] * n)[k] += 1
                    deep[p] = page.depth[i]
        support = {t: sum(x > 0 for x in v) for t, v in vectors.items()}
        fixed = sorted(t for t in texts if support[t] >= max(h.MIN_PAGES, h.TEXT_SUPPORT * n))
        slots = [(deep[p], length.get(p, 0), p) for p in deep if p and support[p] >= max(h.MIN_PAGES, h.SUPPORT * n) and 2 * length.get(p, 0) >= total and max(vectors[p]) == 1]
        want[host] = (max(slots)[2] if slots else None, fixed)
    assert {k: v for k, v in got.items() if v != (None, [])} == {k: v for k, v in want.items() if v != (None, [])}
