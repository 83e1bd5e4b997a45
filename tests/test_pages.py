"""Queries over pages against their SQL, on pages that the tables don't hold or hold rarely."""

import hashlib
import html
from html.entities import html5

import duckdb
import pytest
from compare import rows, sql_rows

from textloom.plans import catalog

PAGES = [
    "<title>a &amp;&amp;&amp</title><h1>x &amp; y &am</h1><p>cut &amp</p><p>token = &quo</p><p>&quot</p>",
    "<p>&lt;b&gt; &#39; &#x26; &nbsp; &AMP; &copy &notit; &amp;lt; &amp;amp; &copy;&middot;&quot;</p>",
    "　<p> one </p><p>   two \x0b</p>\t<li>\x85</li><li> \n\f</li> ",
    '<img src="x" alt="<p>in a tag</p>"><a class="image-link" href="<h2>too</h2>">&amp</a><p>one <img src="i"> two</p>',
    "<style>a /* <script> */</style> one <script>b</script> two <STYLE>c</Style> three <script>d</style>",
    "<\u017fcript>e</SCRIPT> four <style>f</\u017ftyle> five",
    "",
    None,
]


@pytest.mark.parametrize("name", ["html_blocks", "html_text", "html_unescape"])
def test_odd_pages(spark, tmp_path, name):
    spark.createDataFrame([(i, html) for i, html in enumerate(PAGES)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(catalog.queries()[name](spark, str(tmp_path))) == sql_rows(con, catalog.oracle_sql()[name])


def test_html_unescape_decodes_all_references(spark, tmp_path):
    """As the standard library does, in the query and in its SQL."""
    numbers = [0, 9, 13, 31, 65, 127, 128, 159, 160, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**30]
    cases = [*PAGES, *(f"a&{n}b" for n in html5), *(f"&#{n};&#x{n:X}&#X000{n:x};&#0{n} " for n in numbers), "&#;&#x;&;& &nosuch; &notit &AMPx &amp;lt; &&lt;&gt"]
    spark.createDataFrame(list(enumerate(cases)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    texts = [None if c is None else html.unescape(c) for c in cases]
    want = [(i, None, None) if t is None else (i, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)]
    assert [tuple(r) for r in catalog.queries()["html_unescape"](spark, str(tmp_path)).orderBy("page_id").collect()] == want
    assert sorted(con.sql(catalog.oracle_sql()["html_unescape"]).fetchall()) == want
