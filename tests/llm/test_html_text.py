import random
import re
import time
from html.parser import HTMLParser
from itertools import combinations

import pyarrow.parquet as pq

from attesta.llm import html_text as ht


class Visible(HTMLParser):
    """Words outside of elements that are never shown, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.depth:
            self.words += data.split()


def squash(text):
    return re.sub(r"\s+|(?m:^ *- )", "", text)


def test_all_visible_words_of_the_whole_table(spark):
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {r.page_id: r.text for r in ht.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        v = Visible()
        v.feed(r["html"])
        v.close()
        assert squash("\n".join(t for t in got[r["page_id"]].split("\n"))) == squash("".join(v.words)), r["page_id"]


def test_layout():
    page = "<title>no</title><p>One <b>two</b>\n three<p>Four&amp;five<ul><li>a<li>b<ol start=3><li>c</ol></ul><div>x</div>y<pre>k\n  l</pre>"
    assert ht.render(page) == "One two three\n\nFour&five\n\n- a\n- b\n  3. c\n\nx\ny\n\nk\n  l"
    table = "<table><caption>Cap</caption><tr><th>n<th>name<tr><td>1<td>ann<br>lee<tr><td>100<td>bo</table>after"
    assert ht.render(table) == "Cap\nn    name\n1    ann\n     lee\n100  bo\n\nafter"
    assert ht.render("<div hidden>a</div><div style='display: none'><p>b</div><noscript>d</noscript>e<script>'</p>'</script>") == "e"
    assert ht.render("<table><td>a<table><tr><td>in<td>ner</table><td>b</table>") == "a        b\nin  ner"
    assert ht.render("a</p>b<br><br>c <!-- x > y --> d &lt;p&gt; <![CDATA[<q>]]>") == "a\n\nb\n\nc d <p> <q>"
    assert ht.render("") == "" and ht.render("<p") == "<p" and ht.render("1 < 2") == "1 < 2"


def test_deep_and_long_pages_end(spark):
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert ht.render(deep) == "x"
    assert ht.render("<li>" * 5_000 + "z").endswith("z")
    assert ht.render("<table>" * 300 + "q") == "q"
    rows = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "<p>é", "k")], "page_id long, html string, text string")
    out = ht.extract(rows)
    assert out.columns == ["page_id", "html", "text"] and sorted(r.text for r in out.collect()) == ["", "", "", "é"]
    assert ht.extract(rows.limit(0)).count() == 0


def test_broken_pages_take_linear_time():
    for part in ("<a ", "<a \"", "<a '>", "<a \">\" ", "<!", "<![CDATA[", "<!--", "</", "<b x='\" y=\"' "):
        for tail in ("", ">", "\"", "'>x", "<p>end"):
            page = part * (400_000 // len(part)) + tail
            began = time.process_time()
            ht.render(page)
            assert time.process_time() - began < 8, (part, tail)
    assert ht.render("x<a href='u>y") == "xy" and ht.render("x<a b") == "x<a b" and ht.render("<i t='a>b'>c</i>") == "c"


def test_visibility():
    assert ht.render("a<p style='visibility: hidden'>b<b style=visibility:visible>c</b>d</p>e") == "a\n\nc\n\ne"
    assert "c" not in ht.render("a<div style=display:none><b style=visibility:visible>c</b></div>d")
    assert ht.render("<svg><title>t</title><desc>d</desc><text>in <tspan>a</tspan> drawing</text><path/></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn></math>") == "in a drawing x=1"
    assert ht.render("<select><option>one<option selected>two<option>three</select> s") == "two s"
    assert ht.render("s <select><option>one<option>two</select>") == "s one" and ht.render("<select multiple><option>one<option>two</select>") == "one two"


def test_spanned_cells_keep_their_columns():
    page = "<table><tr><th>a<th colspan=2>head<th>z<tr><td rowspan=2>long one<td>1<td>2<td>3<tr><td>4<td>5<td>6<tr><td>q<td>7777<td>8<td>9</table>"
    assert ht.render(page) == "a         head     z\nlong one  1     2  3\n          4     5  6\nq         7777  8  9"
    assert ht.render("<table><tr><td>中文<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>") == "中文  x\nabcd  y\ne\u0301     z"
    assert ht.render("<table><tr><td colspan=2>a wide cell<tr><td>1<td>2</table>") == "a wide cell\n1  2"
    assert ht.render("<table>" + "<tr><td colspan=99999 rowspan=99999>c<td>d" * 40 + "</table>").split() == ["c", "d"] * 40


def brute_grid(rows):
    """Where each cell of generated tables begins: columns that no earlier cell has taken, cell by cell."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        c = 0
        for text, columns, depth in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + k) for i in range(depth) for k in range(columns)}
            out.append((r, c, columns, text))
            c += columns
    return out


def test_generated_tables_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        rows = [[("w" * rng.randint(1, 9) + str(rng.randint(0, 9)), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{t}" for t, c, d in row) for row in rows) + "</table>"
        lines = ht.render(page).split("\n")
        cells = brute_grid(rows)
        starts = {}
        for r, c, _, text in cells:
            row_cells = [x for x in cells if x[0] == r]
            at = [m.start() for m in re.finditer(r"\S+", lines[r])][[x[1] for x in row_cells].index(c)]
            assert starts.setdefault(c, at) == at and lines[r][at : at + len(text)] == text
        assert all(a < b for (c, a), (d, b) in combinations(sorted(starts.items()), 2))


def test_what_styles_hide():
    assert ht.render("<div style='backface-visibility: hidden; transform: none'>slide</div>") == "slide"
    assert ht.render("a <span aria-hidden=true>shown</span>") == "a shown"
    assert ht.render("<p style='display:none;display:block'>a</p><p style='display:block;display:none'>b</p><p style='display:none !important;display:block'>c</p><p style='display:none;display:nonsense'>d</p>") == "a"
    assert ht.render("<input type=submit value=Send><input type=hidden value=x><input type=button value='Go on' style='visibility:hidden'>") == "Send"
    assert ht.render("<p hidden style='display:block'>a</p><p hidden>b</p>") == "a"


def test_style_sheets():
    css = """<style>/* .a { display: none } */ .gone, #menu { display: none } p.faint { visibility: hidden } .back { visibility: visible }
    div .deep { display: none } a:hover { display: none } @media print { .a { display: none } } @media screen { .small { display: none } } @font-face { font-family: x }
    .loud { display: block !important } .Case { display: none }</style><style media=print>.b { display: none }</style>"""
    page = "<b class='x gone'>1</b> <b id=menu>2</b> <p class=faint>3<i class=back>4</i></p> <div><b class=deep>5</b></div> <b class='a b'>6</b> <b class=small>7</b> <b class='loud' style='display:none'>8</b> <b class=case>9</b> <b class=gone style='display:inline'>10</b>"
    assert ht.render(css + page).split() == ["4", "5", "6", "8", "9", "10"]
    assert ht.render(page + css).split() == ["4", "5", "6", "8", "9", "10"]
    assert ht.render("<style>p { display: none } p { display: block } #a.b { display: none } .b.c { display: block }</style><p>1</p><p id=a class='b c'>2</p>") == "1"
    assert ht.render("<style>p { display: none</style><p>1</p><b>2</b>") == "2" and ht.render("<style>} p { display:none }</style><p>1</p>") in ("", "1")
