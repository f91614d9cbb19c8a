"""Main text of pages: written pages with known text, and the given pages against their markup."""

import html as standard
import os
import re

import duckdb
import pytest

from skyloom.llm.html import blocks, extract_text, main_blocks, second_pass
from skyloom.llm.queries import QUERIES
from test_registered import SF_DIR

PROSE = "The house on the hill was old and the people of the town had been there for as long as they could remember it."
OTHER = "Das Haus auf dem Berg war alt und die Leute aus der Stadt waren da, so lange sie sich an es noch erinnern konnten."
SPANISH = "La casa en la colina era vieja y la gente de la ciudad estaba en ella con los niños por mucho tiempo como siempre."
FRENCH = "La maison sur la colline était vieille et les gens de la ville y sont avec les enfants pour le temps que dure une vie."


def inside(page, body):
    return page.replace("@", body)


@pytest.mark.parametrize("prose", [PROSE, OTHER, SPANISH, FRENCH])
def test_parts_around_an_article_go(prose):
    page = f"""<!DOCTYPE html><html><head><title>Title</title><style>p{{margin:0}}</style><script>if (a < b) track("</p>");</script></head><body class="has-sidebar">
    <header><a href="/">Site</a> <p>{prose}</p></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <div class="cookie-notice">{prose}</div><div id="sidebar"><h3>More</h3><p>{prose}</p></div><!-- <p>{prose}</p> -->
    <article><h1>A heading</h1><p>{prose}<p>Short one.<ul><li>first point</li><li>second point</li></ul><div class="ad">{prose}</div>
    <form action="/s"><label>Name</label><input name=q value="x>y"><button>Send</button></form>
    <blockquote>{prose} <a href="/x">here</a></blockquote><section class="comments"><h2>Comments</h2><p>{prose}</p></section></article>
    <aside>{prose}</aside><footer>&copy; 2020 {prose}</footer></body></html>"""
    assert main_blocks(page) == ["A heading", prose, "Short one.", "first point", "second point", prose + " here"]


def test_without_marked_article():
    page = f"""<body><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>About us</a></div><div><h2>Head</h2><div>{PROSE}</div><div>Yes.</div><div>{PROSE}</div></div>
    <div><h3>Elsewhere</h3><a href=4>{PROSE}</a></div><div>Copyright © Somebody</div></body>"""
    assert main_blocks(page) == ["Head", PROSE, "Yes.", PROSE]


def test_open_blocks_follow_their_nearest_decided_neighbour():
    found = blocks("<div><p>a</p><p>b</p></div><div><p>c</p><p>d</p></div>")
    assert second_pass(found, [1, 0, 0, -1]) == [1, 1, -1, -1]
    assert second_pass(found, [0, 0, 0, 0]) == [-1] * 4
    flat = blocks("<p>a</p><h2>b</h2><p>c</p>")
    assert second_pass(flat, [1, 0, -1]) == [1, -1, -1]  # a heading goes with what follows
    assert second_pass(blocks("<p>a</p><p>b</p><p>c</p>"), [1, 0, -1]) == [1, 1, -1]


def test_references_white_space_and_broken_markup():
    page = "<article><p>" + PROSE + " caf&eacute; &#8364;&#x41; &amp;lt; 3 < 4\n\t&nbsp; x<br>y<br><br>" + PROSE + "<b><p>" + PROSE + "</i></b><![CDATA[ z & ]]></article"
    assert main_blocks(page) == [PROSE + " café €A &lt; 3 < 4 x y", PROSE, PROSE + " z &"]
    assert main_blocks(f"<p>{PROSE}<script>never closed {PROSE}") == [PROSE]
    assert main_blocks(f"<p>{PROSE}<!-- never closed {PROSE}") == [PROSE]
    assert main_blocks("plain words alone") == [] and main_blocks(PROSE) == [PROSE]


def test_whole_page_inside_a_form_or_a_misleading_name():
    assert main_blocks(f"<form><p>{PROSE}</p><p>Short.</p></form>") == [PROSE, "Short."]
    assert main_blocks(f"<div class='page-with-sidebar menu'><p>{PROSE}</p></div>") == [PROSE]


def test_long_page_is_linear():
    page = "<article>" + f"<p>{PROSE}</p><div>" * 20000 + "</article>"
    assert len(main_blocks(page[:2_000_000])) > 10000


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_query_against_the_markup_of_the_given_pages(spark):
    """The given pages hold their text as headings and paragraphs of one article element."""
    got = {r["page_id"]: r for r in QUERIES["op13_main_text"](spark, SF_DIR).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, coalesce(html, '') FROM '{SF_DIR}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for ident, url, page in rows:
        own = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)
        parts = re.split(r"</?(?:p|h1)>", own[1]) if own else []
        texts = [" ".join(standard.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
        text = "\n\n".join(t for t in texts if t)
        assert (got[ident]["url"], got[ident]["text"], got[ident]["n_chars"]) == (url, text, len(text)), ident


def test_edges(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "v", f"<p>{PROSE}</p>", 0), (3, "w", f"<p>{PROSE}</p>", 1), (3, "w", f"<p>{PROSE}</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", PROSE, len(PROSE)), (3, "w", PROSE, len(PROSE)), (3, "w", PROSE, len(PROSE))], key=str)
    assert extract_text(pages.limit(0)).count() == 0
