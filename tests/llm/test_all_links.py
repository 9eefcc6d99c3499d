"""Every canonical link and refresh of a page is an edge."""

import duckdb
import pytest

from moodtide.llm import url_filter


def test_later_links_are_edges_too(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.net/x", link.format("http://q.net/") + "<p>text</p>" + link.format("http://b.com/de/1")),
        (2, "http://c.net/x", refresh.format("http://r.net/") + refresh.format("http://b.com/de/2?a&amp;b")),
        (3, "http://d.net/x", "<!-- " + link.format("http://s.net/") + " -->" + link.format("http://b.com/de/3")),
        (4, "http://e.net/x", link.format("http://t.net/")),
        (5, "http://f.net/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert url_filter.links(pages).count() == 7
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    out = con.sql(url_filter.ORACLE)
    assert {r[out.columns.index("page_id")]: r[out.columns.index("verdict")] for r in out.fetchall()} == got


@pytest.mark.parametrize("piece", ["<link ", "<meta ", "<link rel=canonical ", "<meta http-equiv=refresh content=", "<meta http-equiv='refresh' content=\"0; url ", "content=\"url=", "<", ">", "<link href=" + "a" * 90])
def test_urls_of_pages_of_many_megabytes(spark, piece):
    import time

    html = "<link rel=canonical href='/a'>" + piece * ((4 << 20) // len(piece)) + "<LINK href=/b REL=\"Canonical\">"
    df = spark.createDataFrame([(1, "http://h.example/x", html)], "page_id long, url string, html string")
    began = time.time()
    found = {(r["src"], r["dst"]) for r in url_filter.links(df).collect()}
    assert ("h.example/x", "h.example/a") in found and ("h.example/x", "h.example/b") in found and time.time() - began < 10
