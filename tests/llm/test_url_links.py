"""Every canonical link and refresh redirect of a page is an edge."""

from tessera.llm import url_filter


def test_several_links_on_a_page(spark):
    two_links = '<link rel="canonical" href="http://a.test/"><link rel="canonical" href="http://casino.test/x">'
    two_tags = '<meta http-equiv="refresh" content="9; url=http://b.test/"><META content="1;URL=http://archive.example.org/y" http-equiv=refresh>'
    pages = [
        (1, "http://a.test/", two_links),
        (2, "http://b.test/", two_tags),
        (3, "http://c.test/", two_links.replace("a.test", "c.test").replace("/x", "/z") + two_tags.replace("b.test", "c.test").replace("/y", "/w")),
        (4, "http://d.test/", '<link rel="alternate canonical" href="http://porn.test/d">'),
        (5, "http://e.test/", "<link href=http://porn.test/e rel='shortlink\n canonical nofollow'>"),
        (6, "http://f.test/", '<link rel="alternate" title="canonical" href="http://porn.test/f"><link rel="non-canonical" href="http://porn.test/f">'),
        (7, "http://g.test/", '<link rel="canonical"><link rel="canonical" href=""><link rel=canonical href=/g2><meta http-equiv="refresh" content="5">'),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = {tuple(r) for r in url_filter.redirects(table).collect()}
    assert edges == {
        ("a.test", "casino.test/x"),
        ("b.test", "archive.example.org/y"),
        ("c.test", "casino.test/z"),
        ("c.test", "archive.example.org/w"),
        ("d.test", "porn.test/d"),
        ("e.test", "porn.test/e"),
        ("g.test", "g.test/g2"),
    }
    by = {r["page_id"]: r["decision"] for r in url_filter.decide(table).collect()}
    assert by == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "keep", 7: "keep"}
