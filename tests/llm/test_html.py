"""Layouts by hand, and the words of given pages against the standard parser."""

import html.parser
import os

import pytest

from transitlapse.llm import html_text

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "x <b>bold</b>, <i> it </i>y": "x bold, it y",
    "<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol></ul>": "- a\n- b\n  3. c\n  4. d",
    "<table><tr><th>Name<th>Qty<tr><td>kiwi fruit<td>3</table>": "Name        Qty\nkiwi fruit  3",
    "<table><tbody><tr><td>a</td><td><table><tr><td>in</td></tr></table></td></tr></tbody></table>": "a  in",
    "<table><td>no row<td>x</table>after": "no row  x\n\nafter",
    "<pre>  a\n   b </pre>": "  a\n   b",
    "<p style='display:none'>no</p><p hidden>no<span>no</span></p><noscript>no</noscript>yes": "yes",
    "<script>if (a < b) { '</p>' }</script><style>x</style>t": "t",
    "a &lt; b &amp; c&nbsp;d &eacute;": "a < b & c d é",
    "1 < 2 and <3 <>": "1 < 2 and <3 <>",
    "<!-- c > --> x <!-- open": "x",
    "<a href='>'>link</a> <a title=\"a > b\">t</a>": "link t",
    "<p a='never closed>text</p>": "text",
    "<dl><dt>T<dd>D</dl>": "T\n  D",
    "<select><option>a<option selected>b</select>": "b",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "</p></div>": "",
    "<textarea>t < a</textarea>": "t < a",
    "<head><title>T</title><div>Hello</div>": "Hello",
    "<html><head><meta charset=x><link rel=y>plain <b>text</b>": "plain text",
    "<head><script>x</script><style>y</style></head><p>body": "body",
    "say <q>hi</q>, <q>a <q>b</q></q>": "say “hi”, “a “b””",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes <i>too</i></b> no</div>": "yes too",
    "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>a</table>": "a",
    "<form>Name <input value=v><input type=submit value='Send it'>now<input type=hidden value=h></form>": "Name Send it now",
    "<table><tr><td>a<br>bb<td>c<tr><td>long cell<td>d<br>e</table>": "a          c\nbb\nlong cell  d\n           e",
    "<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>": "wide  z\na  b  c",
    "<table><tr><td rowspan=2>R<td>b<tr><td>c<td>d<tr><td>e<td>f</table>": "R  b\n   c  d\ne  f",
    "<table><tr><td>" + "x" * 90 + "<td>y</table>": "x" * 90 + "  y",
    "<table>\n<tr>\n<td rowspan=2>R</td>\n<td>b</td>\n</tr>\n<tr>\n<td>c</td></tr>\n<tr><td>e</td></tr></table>": "R  b\n   c\ne",
    "<table><tr><td colspan=0>a<td rowspan=x>b<td colspan=99999999999>c</table>": "a  b  c",
    "<details>shown</details><dialog>no</dialog><dialog open>d</dialog>": "shown\nd",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert html_text.visible_text(page)[1] == CASES[page]


def test_deep_and_long_pages_end():
    assert html_text.visible_text("<div>" * 20_000 + "x")[1] == "x"
    assert html_text.visible_text("<" * 50_000)[1] == "<" * 50_000
    assert html_text.visible_text("<a '" * 20_000)[1].startswith("<a '")
    assert len(html_text.visible_text("<p>word</p>" * 50_000)[1].split()) == 50_000
    assert html_text.visible_text("<table><tr><td>" * 3_000 + "deep")[1] == "deep"


def test_rules_hold_at_every_depth():
    for n in (10, 399, 1_000, 50_000):
        deep = "<span>" * n
        page = f"{deep}a<script>no</script><p hidden>no<b>no</b></p><div style='display:none'><i>no</i></div>c"
        assert html_text.visible_text(page)[1] == "ac"
        assert html_text.visible_text(f"<div hidden>{deep}<div>x</div>no</div>yes")[1] == "yes"
        assert html_text.visible_text(f"{deep}<ul><li>x<li>y</ul>")[1] == "- x\n- y"
        assert html_text.visible_text(f"{deep}<title>T</title>x") == ("T", "x")


def test_tables_take_space_in_proportion():
    wide = "<table><tr><td>" + "x" * 5_000 + "<td>y" + "<tr><td>a<td>b" * 5_000 + "</table>"
    text = html_text.visible_text(wide)[1]
    assert len(text) < 31_000 and text.count("\na  b") == 5_000
    many = "<table><tr>" + "<td rowspan=9000>" + "w" * 70 + ("<td rowspan=9000>" + "w" * 70) * 300 + "<tr><td>b" * 3_000 + "</table>"
    text = html_text.visible_text(many)[1]
    assert len(text) < 100_000 and text.count("b") == 3_000
    assert html_text.visible_text("<table><tr>" + "<td colspan=1000 rowspan=65534>x" * 300 + "<tr><td>y" * 300 + "</table>")[1].count("y") == 300


def test_options_in_groups_and_nested_tables():
    groups = "<select><optgroup label=g><option>a<option>b</optgroup><optgroup><option{}>c</optgroup></select>"
    assert html_text.visible_text(groups.format(""))[1] == "a"
    assert html_text.visible_text(groups.format(" selected"))[1] == "c"
    for n in (1, 7, 8, 9, 40, 2_000):
        page = "<table><tr><td>" * n + "<table><tr><td>name<td>n<tr><td>x<td>3</table>" + "</table>" * n
        assert html_text.visible_text(page)[1] == "name  n\nx     3"


class Words(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        if tag in ("p", "div", "li", "h1", "br", "td"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")
        if tag in ("p", "div", "li", "h1", "nav", "article", "footer"):
            self.words.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
def test_all_words_of_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    given = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_text.extract(pages, ["page_id"]).collect()
    assert len(rows) == len(given)
    for r in rows:
        parser = Words()
        parser.feed(given[r["page_id"]])
        parser.close()
        words = [w for w in r["text"].split() if w != "-"]
        assert words == [w for w in "".join(parser.words).split() if w != "-"]


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "<title>T</title>b", "x"), (3, "<title>T</title>b", "x")],
                                  "page_id bigint, html string, title string")
    got = sorted((r["page_id"], r["title"], r["text"]) for r in html_text.extract(pages, ["page_id", "title"]).collect())
    assert got == [(1, "", ""), (2, "", ""), (3, "T", "b"), (3, "T", "b")]
    assert html_text.extract(pages.limit(0), ["page_id"]).count() == 0
