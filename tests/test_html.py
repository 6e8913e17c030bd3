"""Pages whose character references lack their semicolon."""

from eventloom.functions import html as H
from eventloom.queries import QUERIES

PAGE = '<title>R&amp;D &amp</title><script>if (a && b&amp) go()</script><p>x &copy; &amp <a href="/q?a=1&b=2&amp;c">y &#65; &quot</a></p>'


def test_references_without_a_semicolon():
    page = H.parse(PAGE)
    assert page["title"] == "R&D &" and page["text"] == 'R&D & x © & y A "'
    assert H.parse(H.closed_only(PAGE)) | {"links": None} == page | {"title": "R&D &amp", "text": "R&D &amp x © &amp y A &quot", "links": None}
    assert H.parse(H.closed_only(PAGE))["links"][0]["href"] == "/q?a=1&b=2&c"
    assert "if (a && b&amp) go()" in H.closed_only(PAGE) and H.closed_only(None) == ""


def test_visible_text_leaves_them_as_its_sql_does(spark, tmp_path):
    spark.createDataFrame([(1, "https://e.org", "<title>a &amp;&amp</title><h1>b &amp;&amp</h1>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in QUERIES["html_visible_text"](spark, str(tmp_path)).collect()] == [(1, "a &&amp", 15)]
