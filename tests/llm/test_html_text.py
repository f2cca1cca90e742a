import time
from html.parser import HTMLParser

import pytest
from hypothesis import given
from hypothesis import strategies as st

from textloom.llm.html_text import extract, text_of


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a <b>b</b>  c<p>d<br>e", "a b c\n\nd\ne"),
        ("<h1>A &amp; B</h1>text<div>x</div><div>y</div>", "A & B\n\ntext\nx\ny"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>z</ul>", "- one\n- two\n  3. x\n  4. y\n- z"),
        ("<table><tr><th>A<th>Long head<th>C<tr><td>11<td>2<td>3</table>", "A   Long head  C\n11  2          3"),
        ("<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>", "wide one  z\na  b      c"),
        ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"),
        ("<head><title>no</title></head><body><script>var a='</p>';</script>yes<style>p{}</style>", "yes"),
        ("a<span hidden>no</span><p style='DISPLAY : none'>no</p><!-- no --><template>no</template>b", "ab"),
        ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<p>x</i></div></p>y<li>z", "x\n\ny\n- z"),
        ("1 < 2 && 3 > 2 &lt;b&gt;", "1 < 2 && 3 > 2 <b>"),
        ("<a href='x>y'>l</a><img src=x alt=no><input type=hidden value=no>", "l"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("a<!-- open", "a"),
        ("<script>open", ""),
        ("", ""),
    ],
)
def test_golden(html, want):
    assert text_of(html) == want


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        self.words.append(" ")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        self.words.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_pages_keep_every_visible_word(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        w = Words()
        w.feed(r.html)
        w.close()
        assert [x for x in got[r.page_id].split() if x != "-"] == "".join(w.words).split()


@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<pre>", "</pre>", "<div>", "</div>", "a", " b ", "\n", "<br>", "<", "&amp;", "<script>", "</script>", "<b", '"', "<dd>", "<tfoot>", "</tr>", "<!--", "-->"]), max_size=30))
def test_never_fails(parts):
    assert isinstance(text_of("".join(parts)), str)


def test_awkward(spark):
    deep = "<div>" * 20_000 + "x"
    d = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (None, deep, "t"), (2, "", "t")], "page_id long, html string, text string")
    assert sorted(((r.page_id or 0), r.text or "") for r in extract(d).collect()) == [(0, "x"), (1, ""), (2, ""), (2, "")]
    assert extract(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><th>A<th>B<th>C<tr><td rowspan=2>x<td>1<td>2<tr><td>3<td>4</table>", "A  B  C\nx  1  2\n   3  4"),
        ("<table><tr><td rowspan=3 colspan=2>wide<td>a<tr><td>b<tr></tr><tr><td>c<td>d<td>e</table>", "wide  a\n      b\nc  d  e"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td rowspan=0>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf  g"),
        ("<table><thead><tr><th rowspan=9>H<th>I<tbody><tr><td>1<td>2<tfoot><tr><td>3<td>4</table>", "H  I\n1  2\n3  4"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds", "so x= 1 2 holds"),
        ("<math><semantics><msup><mi>y</mi><mn>2</mn></msup><annotation encoding=tex>y^2</annotation></semantics></math>z", "y 2z"),
        ("a <svg><title>no</title><desc>no</desc><defs><text>no</text></defs><g><text x=1>One</text><text>Two <tspan>three</tspan></text></g></svg>b", "a\nOne\nTwo three\nb"),
        ("see <svg><path d='M0'/><title/></svg>icon", "see icon"),
        ("<svg><text display=none>no</text><foreignObject><p>yes<desc>too</desc></foreignObject></svg>", "yestoo"),
        ("<svg><g><text>in<p>out</p><metadata>shown</metadata>", "in\n\nout\n\nshown"),
    ],
)
def test_spanned_rows_formulas_and_drawings(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<style>.h, p#x {display:none} @media print {.y{display:none}} div .y{display:none}</style><p class='a h'>no<p id=x>no<p class=y>yes", "yes"),
        ("<style>/* .y{display:none} */ i{visibility:hidden} .z{display:none} .z{display:block}</style><i>no<b style='visibility: visible'>yes</b></i><p class=z>too", "yes\n\ntoo"),
        ("<div style='visibility:hidden'>no<p>no<span style='visibility:visible'>yes</span></div>", "yes"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>yes", "yes"),
        ("<p style='xdisplay:none'>yes", "yes"),
        ("<table><tr><td><ul><li>a<li>b</ul><td>c<tr><td>d<td><p>e<p>f</table>", "- a  c\n- b\nd    e\n     f"),
        ("<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>d</table><tr><td>long<td>e</table>", "a     b c\n      d\nlong  e"),
        ("<ol start=99999999999><li>a</ol><ol start=1234567890><li>b</ol>", "1. a\n\n1234567890. b"),
        ("<table><tr><td>" + "w" * 150 + "<td>a<tr><td>b<td>c</table>", "w" * 150 + "  a\nb" + " " * 121 + "c"),
    ],
)
def test_style_sheets_and_cells_of_lines(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("part", ["<div></p>", "<font></b>", "<table><tr><td>a<td>", "<ul><li>x", "<p><td><div>", "<tfoot><tr><td>x", '<a "x>', "<select><option>", "<svg><g>", "<!--", "</x", "<li><div>", "<style>.a{display:none}</style><p class=a>"])
def test_pages_of_any_nesting_take_time_in_proportion(part):
    took = []
    for n in (20_000, 200_000):
        html, best = part * (n // len(part)), 9e9
        for _ in range(2):
            t = time.process_time()
            text_of(html)
            best = min(best, time.process_time() - t)
        took.append(best)
    assert took[1] < 30 * took[0] + 0.5
