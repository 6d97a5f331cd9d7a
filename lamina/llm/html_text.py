"""Main text of web pages by template deduction over equivalence classes.

Tokens are a page's elements, each with its path of tags and names, and its text blocks. Tokens of one
host that occur equally often in each of its pages (the same occurrence vector) form an equivalence
class. A class is valid if it covers SUPPORT of the host's different pages (MIN_PAGES at least). Its
elements that stand once on a page, as does all around them, nest into the template, and what they
enclose are its slots. The deepest slot with half of the host's text is the article's core, whatever its
tag and names; texts of the template itself are no content.

On each page the article grows from its core outwards: beside the way up from the core, headings, paragraphs and the like
belong to it (a title and a lead before the body), and so do other slots that are made like an article
(a heading with paragraphs, or CORE_SHARE of the core's text), and all of an <article> or <main> that encloses the core.
Text that COMMON of the host's pages share (adverts in turn), lists of links only and named elements do not.

An occurrence vector is kept as the exclusive-or of hash(page, count), so vectors are compared
without gathering a host's pages: a host that has a third of all pages costs one row per token and
task. Pages of equal text count once, so that copies of an article do not pass for a template.

Names (nav, footer, class="comments"...) only tell which text to leave aside: the slot is sought in
the text outside elements so named, unless they hold nearly all of it; then they lie and all text
counts. Inside the slot a named container goes (comments in an article), a named paragraph only if it
is part of the template. <article> and <main> decide only on pages where no template holds.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, written

MIN_PAGES = 3
SUPPORT = 0.5
TEXT_SUPPORT = 0.75  # of a host's different pages: a text on them is the template's
COMMON = 0.1  # of a host's different pages: a text on them is no part of an article outside its core
CORE_SHARE = 0.2
LIE = 0.1  # names are believed if this share of a host's text is outside the elements they name
BROADCAST_TOKENS = 1_000_000  # of all templates together, 8 MB
SALTS = 16

RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
HARD = {"script", "style", "head", "title", "noscript", "template", "iframe", "svg", "math", "button", "select", "textarea", "object", "canvas", "audio", "video", "noframes", "xmp"}
SOFT = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARTS = HEADINGS | {"p", "pre", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption"}  # of an article, never its slot
NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "aside", "masthead", "header", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "reply", "replies",
    "respond", "disqus", "widget", "widgets", "pagination", "pager", "toolbar", "skip", "copyright",
}
#: Words that a noise name may be combined with; with any other (share-price, notice-of-meeting) it names something else.
FILLER = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "outer", "panel", "posts", "right", "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*+")
REST = re.compile(r"""(?>=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NEVER, NAMED, PLAIN = 2, 1, 0


@lru_cache(maxsize=1 << 14)
def _kind(tag: str, attributes: str) -> tuple[str, int]:
    """The label of an element in paths, and NEVER (no text), NAMED (as noise) or PLAIN."""
    attrs = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    names, noise = set(), PLAIN
    for token in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = [w.lower() for w in WORDS.findall(token)]
        names.update(words)
        if any(w in NOISE for w in words) and all(w in NOISE or w in FILLER for w in words) and tag not in ("html", "body"):
            noise = NAMED
    if tag in SOFT or attrs.get("role", "").lower() in NOISE_ROLES:
        noise = NAMED
    if tag in HARD or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        noise = NEVER
    return tag + "".join(f".{n}" for n in sorted(names)), noise


@lru_cache(maxsize=1 << 16)
def _place(up: int, label: str) -> int:
    """The path token of an element below another."""
    return xxhash.xxh64_intdigest(f"{up}/{label}") >> 1


def _token(place: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{place}\0{text}") >> 1


class Page:
    """A page's elements in order (parents first) and its blocks: (text, number of the element, all of it linked)."""

    __slots__ = ("tag", "place", "up", "depth", "noise", "blocks")

    def __init__(self):
        self.tag, self.place, self.up, self.depth, self.noise = [""], [0], [-1], [0], [PLAIN]
        self.blocks: list[tuple[str, int, bool]] = []

    def add(self, tag: str, up: int, label: str, noise: int) -> int:
        self.tag.append(tag)
        self.place.append(_place(self.place[up], label))
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.noise.append(noise)
        return len(self.tag) - 1


def parse(page: str) -> Page:
    """Reads a page once, in time linear in its length.

    Tolerates unclosed and misnested tags: a new block ends an open paragraph, a new item or cell the
    one before, and an end tag closes back to its start, or nothing. A quote that never ends makes
    tags end at the next ">"; a "<" without one is text.
    """
    out = Page()
    stack, opened = [0], {}
    parts: list[str] = []
    at, n = 0, len(page)
    linked, plain = False, False  # inside <a>; whether the block has text outside links
    mute: list | None = None  # an inline element whose text does not count: its tag, and how often it is open
    strict = True

    def end_block():
        nonlocal parts, plain, mute
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.blocks.append((text, stack[-1], not plain))
            parts = []
        plain, mute = False, None

    def add_text(a: int, b: int):
        nonlocal plain
        if mute is None:
            s = page[a:b]
            parts.append(s)
            plain = plain or not linked and not s.isspace()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            break
        if lt > at:
            add_text(at, lt)
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)  # "<!-->" is a whole comment
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            if mute is None:
                parts.append(html.escape(page[lt + 9 : n if end < 0 else end]))
                plain = plain or not linked
            at = n if end < 0 else end + 3
            continue
        name = NAME.match(page, lt + 1)
        if name is None:
            if page.startswith(("<!", "<?", "</"), lt) and (end := page.find(">", lt)) > 0:
                at = end + 1
            else:
                add_text(lt, lt + 1)
                at = lt + 1
            continue
        rest = REST.match(page, name.end()) if strict else None
        if rest is None:
            strict = False
            end = page.find(">", name.end())
            if end < 0:
                add_text(lt, n)
                at = n
                break
            end += 1
        else:
            end = rest.end()
        at = end
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag in INLINE:
                if tag == "a":
                    linked = False
                if mute is not None and mute[0] == tag:
                    mute[1] -= 1
                    if not mute[1]:
                        mute = None
                continue
            end_block()
            if opened.get(tag):
                while True:
                    gone = out.tag[stack.pop()]
                    opened[gone] -= 1
                    if gone == tag:
                        break
            continue
        if tag in ("br", "img"):
            if mute is None:
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                linked = True
            if tag in VOID:
                continue
            if mute is not None:
                mute[1] += mute[0] == tag
            elif _kind(tag, page[name.end() : end - 1])[1]:
                mute = [tag, 1]
            continue
        end_block()
        linked = False
        if tag in VOID:
            continue
        ends = CLOSED_BY.get(tag, ())
        if len(stack) > 1 and ((top := out.tag[stack[-1]]) == "p" or top in ends):
            opened[top] -= 1
            stack.pop()
            while len(stack) > 1 and (top := out.tag[stack[-1]]) in ends:  # a cell, then its row
                opened[top] -= 1
                stack.pop()
        label, noise = _kind(tag, page[name.end() : end - 1])
        number = out.add(tag, stack[-1], label, noise)
        if tag in RAW:
            if page[end - 2] != "/":
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        stack.append(number)
        opened[tag] = opened.get(tag, 0) + 1
    if at < n:
        add_text(at, n)
    end_block()
    return out


def inherited(page: Page, slot: int | None = None, named_parts: frozenset | None = None) -> tuple[list[int], list[bool]]:
    """For each element: the noise that it is in, and whether it is inside the slot (an <article> or <main>, where slot is None).

    What is named outside a slot does not count inside it. named_parts: the paragraphs and the like
    whose names count inside the slot; None: all. A header inside keeps its headings.
    """
    noise, inside, head, article = [page.noise[0]], [False], [False], [False]
    for i in range(1, len(page.tag)):
        up, tag = page.up[i], page.tag[i]
        here = inside[up]
        starts = not here and (page.place[i] == slot if slot is not None else tag in ("article", "main") and page.noise[i] == PLAIN and noise[up] == PLAIN)
        own, above = page.noise[i], noise[up]
        if starts:
            own, above = (own if own == NEVER else PLAIN), (above if above == NEVER else PLAIN)
        article.append(article[up] or starts and tag != "main" or here and tag == "article")
        is_head = head[up] or (tag == "header" and article[up])
        if is_head and tag in HEADINGS:
            own, above = PLAIN, (noise[up] if noise[up] == NEVER else PLAIN)
        elif own == NAMED and tag in PARTS and here and named_parts is not None and page.place[i] not in named_parts:
            own = PLAIN
        noise.append(max(own, above))
        inside.append(here or starts)
        head.append(is_head)
    return noise, inside


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return (m[1] if m else "").lower()


ELEMENT, TEXT, PART = 0, 1, 2
TOKEN = "host string, token long, kind int, depth int, vector long, page long, chars long, clean long, slot int"


def page_tokens(pages: DataFrame) -> DataFrame:
    """TOKEN rows, one for each distinct token of each different page of a host.

    chars and clean: text inside, and that outside named elements. slot: 1 for an element that may
    be a slot and stands once on the page, as do all around it. Kind PART: named paragraphs and the like.
    """

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in TOKEN.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for batch in batches:
            out = [[] for _ in names]
            for url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, host = parse(text or ""), host_of(url)
                noise, _ = inherited(page)
                size = len(page.tag)
                chars, clean, key, every = [0] * size, [0] * size, xxhash.xxh64(), xxhash.xxh64()
                texts: dict[int, list[int]] = {}
                for t, i, linked in page.blocks:
                    if noise[i] == NEVER:
                        continue
                    every.update(t + "\n")
                    if noise[i] == PLAIN:
                        key.update(t + "\n")
                        clean[i] += 0 if linked else len(t)
                    chars[i] += 0 if linked else len(t)
                    got = texts.setdefault(_token(page.place[i], t), [0, page.depth[i]])
                    got[0] += 1
                for i in range(size - 1, 0, -1):  # children come after their parents
                    chars[page.up[i]] += chars[i]
                    clean[page.up[i]] += clean[i]
                count: dict[int, int] = {}
                for p in page.place:
                    count[p] = count.get(p, 0) + 1
                once = [True] * size
                for i in range(1, size):
                    once[i] = once[page.up[i]] and count[page.place[i]] == 1
                page_key = (every if clean[0] < LIE * chars[0] else key).intdigest() >> 1
                seen = set()
                rows = []
                for i in range(size):
                    p, part = page.place[i], page.tag[i] in PARTS
                    if p in seen or part and page.noise[i] != NAMED:
                        continue
                    seen.add(p)
                    rows.append((p, PART if part else ELEMENT, page.depth[i], count[p], chars[i], clean[i], int(once[i] and not part)))
                rows += [(t, TEXT, d, c, 0, 0, 0) for t, (c, d) in texts.items()]
                for token, kind, depth, c, m, k, slot in rows:
                    vector = xxhash.xxh64_intdigest(f"{page_key}:{c}") >> 1
                    for column, v in zip(out, (host, token, kind, depth, vector, page_key, m, k, slot), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = in_arrow(pages.select("url", "html"), run, TOKEN)
    return rows.groupBy("host", "token", "kind", "page").agg(F.max("depth").alias("depth"), F.max("vector").alias("vector"), F.max("chars").alias("chars"), F.max("clean").alias("clean"), F.min("slot").alias("slot"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, fixed, common): the path token of the article's core, the tokens of fixed texts and named parts, and those of other common texts.

    A token of the template covers a share of the host's different pages, so a host's row has no more
    of them than a page has tokens, times 1 / COMMON. Hosts of fewer than MIN_PAGES pages have no row.
    """
    tokens = page_tokens(pages).groupBy("host", "token", "kind").agg(
        F.bit_xor("vector").alias("vector"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("clean").alias("clean"), F.max("depth").alias("depth"), F.sum("slot").alias("slots")
    )
    tokens = written(tokens.where(f"pages >= {MIN_PAGES}"), "tokens")
    host = tokens.where("token = 0").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"), F.col("clean").alias("all_clean"))  # the page itself, on each of them
    valid = tokens.join(host, "host").where(F.col("pages") >= F.when(F.col("kind") == TEXT, COMMON).otherwise(SUPPORT) * F.col("all_pages"))
    classes = valid.groupBy("host", "vector").agg(
        F.max("all_pages").alias("all_pages"), F.max("all_chars").alias("all_chars"), F.max("all_clean").alias("all_clean"),
        F.collect_list(F.struct("kind", "token", "depth", "pages", "slots", "chars", "clean")).alias("members"),
    )
    lies = F.col("all_clean") < LIE * F.col("all_chars")
    each = classes.select("host", "all_pages", lies.alias("lies"), F.when(lies, F.col("all_chars")).otherwise(F.col("all_clean")).alias("all"), F.explode("members").alias("m"))
    held = F.when(F.col("lies"), F.col("m.chars")).otherwise(F.col("m.clean"))
    nested = (F.col("m.kind") == ELEMENT) & (F.col("m.token") != 0) & (F.col("m.slots") >= SUPPORT * F.col("all_pages")) & (held > 0) & (2 * held >= F.col("all"))
    fixed = (F.col("m.kind") == PART) | ((F.col("m.kind") == TEXT) & (F.col("m.pages") >= TEXT_SUPPORT * F.col("all_pages")))
    return each.groupBy("host").agg(
        F.max(F.when(nested, F.struct(F.col("m.depth").alias("depth"), held.alias("held"), F.col("m.token").alias("token"))))["token"].alias("slot"),
        F.collect_list(F.when(fixed, F.col("m.token"))).alias("fixed"),
        F.collect_list(F.when(~fixed & (F.col("m.kind") == TEXT), F.col("m.token"))).alias("common"),
    )


LISTS = {"ul", "ol", "dl", "table"}


def _ends(page: Page) -> list[int]:
    """For each element, the number after its last descendant: elements come in preorder."""
    ends = list(range(1, len(page.tag) + 1))
    for i in range(len(page.tag) - 1, 0, -1):
        ends[page.up[i]] = max(ends[page.up[i]], ends[i])
    return ends


def link_lists(page: Page) -> set[int]:
    """Lists and tables with nothing but links."""
    of, plain, some = [-1] * len(page.tag), set(), set()
    for i in range(1, len(page.tag)):
        of[i] = i if page.tag[i] in LISTS and of[page.up[i]] < 0 else of[page.up[i]]
    for _, i, linked in page.blocks:
        if of[i] >= 0:
            (some if linked else plain).add(of[i])
    return {i for i, x in enumerate(of) if x >= 0 and x in some - plain}


def grown(page: Page, slot: int, fixed: frozenset, common: frozenset) -> list[str]:
    """The blocks of the article around the elements of the slot, in page order."""
    noise, inside = inherited(page, slot, fixed)
    for i in range(len(page.tag) - 1, 0, -1):  # names of what holds the core lie
        if page.place[i] == slot:
            up = page.up[i]
            while up > 0 and page.noise[up] != NEVER:
                page.noise[up] = PLAIN
                up = page.up[up]
    around, _ = inherited(page)
    ends, links = _ends(page), link_lists(page)
    kids: dict[int, list[int]] = {}
    for i in range(1, len(page.tag)):
        kids.setdefault(page.up[i], []).append(i)
    blocks: dict[int, list[tuple[str, bool]]] = {}
    for t, i, linked in page.blocks:
        blocks.setdefault(i, []).append((t, linked))

    def own(i: int, kept) -> list[tuple[str, bool, int]]:
        """Text of an element and what is in it that no name and no other page claims."""
        return [(t, linked, k) for k in range(i, ends[i]) if k in blocks and kept(k) for t, linked in blocks[k] if not ((x := _token(page.place[k], t)) in fixed or x in common)]

    core = sum(len(t) for t, i, linked in page.blocks if inside[i] and noise[i] == PLAIN and not linked)
    added: set[int] = set()
    titled: set[int] = set()
    seen: set[int] = set()
    for start in (i for i in range(1, len(page.tag)) if inside[i] and not inside[page.up[i]]):
        way, up = [start], page.up[start]
        while up >= 0:
            way.append(up)
            up = page.up[up]
        marked = False  # inside an <article> or <main> that encloses the core
        for child, parent in reversed(list(zip(way, way[1:]))):
            marked = marked or page.tag[parent] in ("article", "main") and page.noise[parent] == PLAIN
            if parent in seen:
                continue
            seen.add(parent)
            if marked:
                added.add(parent)
            for c in kids.get(parent, ()):
                if c == child or inside[c] or c in way:
                    continue
                rest = own(c, lambda k: around[k] == PLAIN and k not in links)
                if not rest and page.tag[c] == "header" and page.tag[parent] not in ("", "html", "body"):
                    titled.update(k for k in range(c, ends[c]) if page.tag[k] in HEADINGS and page.noise[k] == PLAIN)
                    continue
                parts = [x for x in rest if page.tag[x[2]] in PARTS]
                size = sum(len(t) for t, linked, _ in parts if not linked)
                like = any(page.tag[k] in HEADINGS for _, _, k in parts) and any(page.tag[k] == "p" for _, _, k in parts)
                if rest and (page.tag[c] in PARTS or marked and not all(linked for _, linked, _ in rest) or like or size > CORE_SHARE * core):
                    added.update(range(c, ends[c]))
    out = []
    for t, i, _ in page.blocks:
        token = _token(page.place[i], t)
        if token in fixed:
            continue
        if inside[i] and noise[i] == PLAIN or (i in added and around[i] == PLAIN and i not in links or i in titled) and token not in common:
            out.append(t)
    return out


def main_blocks(page: str, slot: int | None, fixed: frozenset, common: frozenset = frozenset()) -> list[str]:
    """The article's blocks: its core in the slot and what belongs to it around; on pages without it, of <article> or
    <main>; else all that no name rejects, but for lists of links and bare links."""
    read = parse(page)
    if slot is not None and slot in read.place:
        return grown(read, slot, fixed, common)
    noise, inside = inherited(read)
    whole = not any(inside)
    links = link_lists(read) if whole else set()
    chosen = [(t, i) for t, i, linked in read.blocks if noise[i] == PLAIN and (inside[i] or whole and i not in links and not (linked and read.tag[i] not in PARTS))]
    return [t for t, i in chosen if not fixed or _token(read.place[i], t) not in fixed]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; the text of a null or empty page is empty.

    Null and hostless URLs share the host "". Repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = written(templates(rows).where("slot is not null or size(fixed) > 0"), "templates")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    given = rows.withColumn("host", host)
    if found.agg(F.coalesce(F.sum(F.size("fixed") + F.size("common") + 4), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_TOKENS:
        joined = given.join(F.broadcast(found), "host", "left")
    else:  # a host's pages go to several tasks
        joined = given.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS))).join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["host", "salt"], "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            last = None
            for page, slot, fixed, common in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if last is None or last[:2] != (fixed, common):
                    last = fixed, common, frozenset(fixed or ()), frozenset(common or ())
                out.append("\n".join(main_blocks(page or "", slot, *last[2:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return in_arrow(joined.select("page_id", "url", "html", "slot", "fixed", "common"), run, f"page_id {kind}, url string, text string, n_chars long")
