"""Main text of web pages: two passes of rules over blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from .common import as_strings, map_texts

# Common function words of the languages of the pages. Lower case, without marks at their ends.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you
der die das den dem des ein eine einer einem einen und oder aber ist sind war waren wird werden nicht mit von vom zu zum zur auf für im in an am als auch bei aus nach wie sich es er sie wir ich dass so
le la les l un une des du de d et ou mais est sont était été être ne pas que qui dans en pour par sur avec au aux ce cette ces se sa son ses il elle ils nous vous je plus comme
el la los las lo un una unos unas de del y o pero es son era fue ser no que en por para con al se su sus como más este esta esto ese esa le les ha han
""".split())

# Elements that end the block before them and begin another. Fixed by HTML.
BLOCK_TAGS = frozenset("""
address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header
hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul
""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg math object audio video canvas head".split())
CLOSES_P = BLOCK_TAGS - frozenset("body head html td th tr tbody thead tfoot li dd dt option optgroup".split())

# Elements, roles and names that say what a part of the page is for.
BOILER_TAGS = frozenset("nav footer aside form button select dialog menu fieldset search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
BOILER_NAMES = frozenset("""
ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner breadcrumb breadcrumbs menu menus nav navbar navigation topnav subnav
header masthead topbar footer foot bottombar sidebar sidebars rail aside widget widgets related recommended recommendations teaser teasers share sharing social follow
comment comments commentlist discussion reply replies respond response responses disqus cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay
newsletter subscribe subscription signup login signin register search searchform form legal disclaimer copyright pagination pager toolbar skip sitemap
""".split())
ARTICLE_NAMES = frozenset("article articlebody post story entry".split())
MAIN_NAMES = frozenset("main content maincontent".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
DEEPEST = 512  # elements inside one another; deeper ones count as beside each other, as in browsers
MARKS = ".,;:!?\"'()[]{}«»„“”‘’…-–—*#$%&/\\|<>¿¡"


class Rules(NamedTuple):
    """Limits of the first pass."""

    link_share: float = 0.4  # from this share of characters inside links on, a block is boilerplate
    short: int = 12  # below this many words a block isn't judged by its own words
    long: int = 40  # from this many words on, few stop words are enough
    stop_high: float = 0.15
    stop_low: float = 0.05


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    heading: bool
    boiler: int  # 2: inside a part that its element declares not to be text, 1: its name does, 0: neither
    section: int  # number of the innermost article, or -1
    path: tuple[int, ...]  # numbers of the containers around it, outermost first


def _names(attributes: dict[str, str]) -> set[str]:
    found: set[str] = set()
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for word in re.split(r"[\s_\-:.]+", value):
            found.add(word.lower())
            found.update(x.lower() for x in NAME_PARTS.findall(word))
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space joined, references decoded, empty ones left out."""
    found: list[Block] = []
    open_tags: list[tuple[str, int, int, int]] = []  # tag, boilerplate so far, article, number
    text: list[str] = []
    state = {"linked": 0, "links": 0, "number": 0, "breaks": 0}

    def close_block() -> None:
        whole = " ".join(unescape("".join(text)).split())
        text.clear()
        if whole:
            boiler = max((t[1] for t in open_tags), default=0)
            section = open_tags[-1][2] if open_tags else -1
            found.append(Block(whole, min(state["linked"], len(whole)), any(t[0] in HEADINGS for t in open_tags), boiler, section,
                               tuple(t[3] for t in open_tags if t[3] >= 0)))
        state["linked"] = state["breaks"] = 0

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if state["links"]:
                state["linked"] += len(" ".join(unescape(piece).split()))
            if state["breaks"] and piece.strip():
                state["breaks"] = 0

    def pop_to(at: int) -> None:
        while len(open_tags) > at:
            tag = open_tags.pop()[0]
            if tag == "a":
                state["links"] -= 1

    at, size = 0, len(page)
    while at < size:
        found_tag = TOKEN.search(page, at)
        if found_tag is None:
            add(page[at:])
            break
        add(page[at:found_tag.start()])
        at = found_tag.end()
        tag = found_tag[2]
        if tag is None:
            if found_tag[0].startswith("<![CDATA["):
                add(found_tag[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag == "br":
            state["breaks"] += 1
            if state["breaks"] > 1:
                close_block()
            else:
                text.append(" ")
            continue
        if found_tag[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    if tag in BLOCK_TAGS:
                        close_block()
                    pop_to(i)
                    break
                if open_tags[i][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    break  # an inline end tag closes nothing outside its block
            else:
                if tag in BLOCK_TAGS:
                    close_block()
            continue
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(found_tag[3])} if found_tag[3] else {}
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else (size if tag != "head" else at)
            if tag in BLOCK_TAGS:
                close_block()
            continue
        if tag in BLOCK_TAGS:
            close_block()
            if tag in CLOSES_P and any(t[0] == "p" for t in open_tags):
                pop_to(next(i for i, t in enumerate(open_tags) if t[0] == "p"))
            for same in (("li",), ("dd", "dt"), ("tr",), ("td", "th"), ("option",)):
                if tag in same:
                    for i in range(len(open_tags) - 1, -1, -1):
                        if open_tags[i][0] in ("ul", "ol", "dl", "table", "select", "tr") and open_tags[i][0] not in same:
                            break
                        if open_tags[i][0] in same:
                            pop_to(i)
                            break
        if tag in VOID or found_tag[3].rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        names = _names(attributes) if "class" in attributes or "id" in attributes else set()
        above = open_tags[-1] if open_tags else ("", 0, -1, -1)
        article, boiler, number = above[2], 0, -1
        if tag == "article" or tag == "main" or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody" or (
                tag in ("div", "section") and (names & ARTICLE_NAMES or names & MAIN_NAMES) and not names & BOILER_NAMES):
            article = state["number"]
        elif tag in ("html", "body"):
            pass
        elif tag in BOILER_TAGS or attributes.get("role") in BOILER_ROLES:
            boiler = 2
        elif "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
            boiler = 2
        elif names & (BOILER_NAMES if article < 0 else BOILER_NAMES - {"header"}) or tag == "header" and article < 0:
            boiler = 1
        if tag == "article" and names & BOILER_NAMES:
            boiler = 1
        if tag in BLOCK_TAGS:
            number = state["number"]
            state["number"] += 1
        if len(open_tags) >= DEEPEST:
            continue
        if tag == "a":
            if any(t[0] == "a" for t in open_tags):
                state["links"] = 0
                open_tags[:] = [("span", *t[1:]) if t[0] == "a" else t for t in open_tags]
            state["links"] += 1
        open_tags.append((tag, boiler, article, number))
    close_block()
    return found


GOOD, BAD, OPEN = 1, -1, 0


def first_pass(block: Block, stop_words: frozenset[str], rules: Rules) -> int:
    """By its own words and links: good, bad or open."""
    words = [w for w in (x.lower().strip(MARKS) for x in block.text.split()) if w]
    if block.linked >= rules.link_share * len(block.text) or "©" in block.text and len(words) < rules.long:
        return BAD
    if block.heading or len(words) < rules.short:
        return OPEN
    stops = sum(w in stop_words for w in words) / len(words)
    if stops >= rules.stop_high or stops >= rules.stop_low and len(words) >= rules.long:
        return GOOD
    return OPEN


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbour.

    Nearer is the neighbour that shares more of the containers around the
    block, then the one fewer blocks away, then the one that follows a heading
    or precedes another block. Without any decided neighbour a block is bad.
    """
    n = len(found)
    before, after, last = [-1] * n, [-1] * n, -1
    for i in range(n):
        before[i] = last
        last = i if labels[i] != OPEN else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] != OPEN else last

    def shared(a: int, b: int) -> int:
        return next((k for k, (x, y) in enumerate(zip(found[a].path, found[b].path)) if x != y), min(len(found[a].path), len(found[b].path)))

    out = list(labels)
    for i in range(n):
        if labels[i] == OPEN:
            near = [(-shared(i, j), abs(i - j), (j < i) == found[i].heading, j) for j in (before[i], after[i]) if j >= 0]
            out[i] = labels[min(near)[3]] if near else BAD
    return out


def main_blocks(page: str, stop_words: frozenset[str] = STOP_WORDS, rules: Rules = Rules()) -> list[str]:
    """The texts of the main blocks of a page.

    A page that marks articles keeps blocks of those alone that hold a good
    block. Without a good block, what marked articles hold outside boilerplate
    is the text; without that, names of containers are dropped as evidence, and
    then elements too.
    """
    whole = blocks(page)
    for hints in (1, 2, 3):
        found = [b for b in whole if b.boiler < hints]  # parts set off as boilerplate say nothing of their neighbours
        labels = [first_pass(b, stop_words, rules) for b in found]
        if GOOD in labels:
            articles = {b.section for b, x in zip(found, labels) if x == GOOD and b.section >= 0}
            if articles:
                labels = [x if b.section in articles else BAD for b, x in zip(found, labels)]
            return [b.text for b, x in zip(found, second_pass(found, labels)) if x == GOOD]
        marked = [b.text for b, x in zip(found, labels) if b.section >= 0 and x != BAD]
        if marked:
            return marked
    return []


def extract_text(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", stop_words: frozenset[str] = STOP_WORDS,
                 rules: Rules = Rules()) -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text``, ``n_chars``.

    Blocks are the stretches of text between block elements, or between two
    line breaks in a row. Those inside navigation, footers, sidebars, forms,
    hidden or so named containers go first. First pass: blocks with a copyright
    sign or with many links are boilerplate; blocks of enough words with enough stop
    words are text; headings, short blocks and those with few stop words stay
    open. Second pass: an open block takes the label of its nearest decided
    neighbour. Where a page marks articles, only their blocks can be text.

    Work is per page, without any shuffle, in slices of bounded bytes; a page
    is read whole, in time linear in its length. A null page is an empty one and
    gives an empty text, as does one without text. Null identifiers and
    addresses pass through; repeated pages give one row each; an empty table
    gives no rows; further columns are ignored, whatever their names.
    """

    def run(slices: Iterable[dict]) -> Iterator[dict]:
        for cols in slices:
            texts = ["\n\n".join(main_blocks(p, stop_words, rules)) for p in as_strings(cols["html"])]
            yield {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")), run,
                     "page_id long, url string, text string, n_chars long")
