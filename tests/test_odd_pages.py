"""Queries over pages whose titles are cut and begin oddly, against their SQL."""

import duckdb
import pytest

from leafmill.functions.limits import DEFAULT
from leafmill.functions.markdown_writer import render
from leafmill.functions.tree import Document, Node
from leafmill.plans import queries
from leafmill.sources import registry

TITLES = ["A &amp;&amp; b &amp", "token = &quot;0b9", "token = &quot", "+1 (278) 555 The", "# of", "&gt b", "- a_b *c*", "plain"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    html = [f'<!DOCTYPE html><html><head><title>{t}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Ad.</div><article><h1>{t}</h1><p><b>{t} more.<br><p>Text &quot;x&quot;.</p></article><footer>&copy; a &middot; b</footer></body></html>' for t in TITLES]
    spark.createDataFrame([(i, f"https://example.org/{i}.html", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def agrees(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_heading_text_of_cut_titles(spark, pages):
    agrees(spark, pages, "html_heading_text")


def test_markdown_of_odd_headings(spark, pages):
    agrees(spark, pages, "html_to_markdown")


def test_headings_are_read_as_they_were_written():
    for words in (["+1"], ["#"], ["#", "of"], ["a", "##"], ["-", "b"], [">", "c"], ["a#"]):
        doc = Document()
        kids = [x for w in words for x in (Node("text", text=w), Node("space"))][:-1]
        doc.body = [Node("heading", kids=kids, level=1)]
        md = render(doc)[0]
        again = registry.READERS["markdown"](md.encode(), "a.md", DEFAULT)
        assert [[k.text for k in b.kids if k.tag == "text"] for b in again.body] == [words] and render(again)[0] == md
