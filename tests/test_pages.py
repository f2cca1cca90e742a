"""Pages with odd references, against SQL and by the tree."""

import pytest

from textloom import catalog
from textloom.functions.dom import parse, select
from tests.test_catalog import compare

HTML = '<html lang="en"><head><title>a &amp; b &lt;c&amp</title><style>p { content: "&amp" }</style></head><body><h1>x &&amp; y&lt</h1><a href="?a=1&amp;b=2">l</a></body></html>'


@pytest.mark.parametrize("name", ["html_title", "html_meta"])
def test_references_without_semicolon(spark, tmp_path, name):
    spark.createDataFrame([(1, "http://a.b/c", HTML)], "page_id long, url string, html string").toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    compare(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], str(tmp_path))


def test_loose_and_strict_references():
    text = lambda loose: [select(parse(HTML, loose), ["tag", t])[0].text() for t in ("title", "h1")]
    assert text(True) == ["a & b <c&", "x && y<"] and text(False) == ["a & b <c&amp", "x && y&lt"]
    assert '"&amp"' in select(parse(HTML, False), ["tag", "style"])[0].data()
    assert select(parse(HTML, False), ["tag", "a"])[0].attrs["href"] == "?a=1&b=2"
