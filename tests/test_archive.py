"""Links of every kind, canonical forms, rewritten pages and the frontier."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import archive as A

SITE = A.Site(
    "https://site.org", r"(?:^|\.)site\.org$", "/wiki/", (r"^/wiki/$", r"^/wiki/[a-z]+/[^/.]+$"), (r"^/wiki/(?:[^/]+/)*images/[^/]+$", r"^/wiki/[^/]+\.(?:css|js|ico)$"), (("//cdn.net/lib.js", "vendor/lib.js"),)
)
PAGE = r"""<html><head><link rel="stylesheet" href="/WIKI/main.css?v=3"><script src="//cdn.net/lib.js"></script><style>a{background:url('../images/a.png')} b{background:URL( "/Wiki/images/b_l.jpg" )}</style></head>
<body style="background:url(images/c.gif)"><a href='bird/Gull?x=1&amp;y=2#top'>g</a><a HREF = "http://Countries.WWW.Site.org:80/Wiki/bird/a%20b">x</a><a href="https://else.net/wiki/bird/x">e</a><a href="mailto:a@site.org">m</a><a href="#x">h</a>
<img data-large_file="images/d_s.JPG" src="./images/../images/e.png"><script>var u = "https:\/\/www.site.org\/WIKI\/bird\/Auk"; f("url(\"http://site.org/wiki/images/f.png\")", "https://mysite.org/wiki/bird/no");</script><a href="">n</a><a href="/other/x">o</a></body></html>"""


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://SITE.org/WIKI", "https://site.org/wiki/"), ("https://countries.www.site.org/Wiki/A/B", "https://site.org/wiki/A/B"), ("/wiki/bird/x", "https://site.org/wiki/bird/x"), ("http://site.org/wikis/x", None),
        ("http://site.org/", None), ("http://notsite.org/wiki/x", None), ("http://site.org:443/wiki/a%20b+c?q=1", "https://site.org/wiki/a b+c"), ("http://site.org/wiki/s.css?v=1#y", "https://site.org/wiki/s.css?v=1"),
        ("bird/x", None), ("//site.org/wiki/x", None), ("", None), (None, None), ("http://site.org/wiki/SearchResults", None), ("  http://site.org/wiki/x ", "https://site.org/wiki/x"), ("javascript:void(0)", None), ("http://site.org/wiki/%zz", "https://site.org/wiki/%zz"),
    ],
)
def test_one_form_of_a_url(spark, url, want):
    assert one(spark, url, SITE.canonical) == want


def test_relative_links_as_the_standard_resolves_them(spark):
    base = "http://h.org/a/b/c.html?q=1"
    links = ["d", "./d", "../d", "../../d", "../../../d", "d/../e/./f", "/x/../y", "//o.org/z", "d/..", "d/.", "../", "e?x=../y", "..a/b", "a..b/c"]
    rows = spark.createDataFrame([(x,) for x in links], "x string").select("x", A.without_dots(A.resolve(F.lit(base), F.col("x"))).alias("y")).collect()
    assert {r.x: r.y for r in rows} == {x: urljoin(base, x) for x in links}


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_links_of_every_kind(spark):
    p = pages(spark, (1, "https://site.org/wiki/bird/Tern", PAGE), (2, "https://site.org/wiki/main.css", "a{background:url(images/g.png)}"), (3, "https://site.org/wiki/bird/None", None), (4, "https://site.org/wiki/bird/Empty", ""))
    got = {}
    for r in A.extract_links(p, SITE).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.dst.removeprefix("https://site.org/wiki/"))
    assert got[1] == ["main.css?v=3", "bird/a b", "bird/images/d_s.JPG", "bird/images/e.png", "images/a.png", "images/b_l.jpg", "bird/images/c.gif", "bird/Auk", "images/f.png"]
    assert got[2] == ["images/g.png"] and 3 not in got and 4 not in got


def test_pages_with_links_of_their_own(spark):
    index = spark.createDataFrame([(f"https://site.org/wiki/{u}", p) for u, p in (("main.css?v=3", "assets/main.css"), ("bird/Auk", "pages/bird/Auk.html"), ("bird/a b", "pages/bird/a b.html"), ("images/f.png", "assets/images/f.png"), ("bird/images/d_s.JPG", "assets/bird/images/d_s.JPG"))] + [("https://site.org/wiki/bird/Auk", "pages/bird/Auk.html")], "url string, path string")
    got = {r.page_id: r for r in A.rewrite_links(pages(spark, (1, "http://www.site.org/WIKI/bird/Tern", PAGE), (2, "https://site.org/wiki/", "no links"), (3, "https://site.org/wiki/bird/None", None), (4, "https://else.net/x", PAGE), (5, "https://site.org/wiki/bird/Ends", 'href="/wiki/bird/Auk"')), SITE, index).collect()}
    want = PAGE
    for a, b in (
        ('href="/WIKI/main.css?v=3"', 'href="../../assets/main.css"'), ('src="//cdn.net/lib.js"', 'src="../../vendor/lib.js"'), ('HREF = "http://Countries.WWW.Site.org:80/Wiki/bird/a%20b"', 'HREF = "a b.html"'),
        ('data-large_file="images/d_s.JPG"', 'data-large_file="../../assets/bird/images/d_s.JPG"'), (r"https:\/\/www.site.org\/WIKI\/bird\/Auk", "Auk.html"), ("http://site.org/wiki/images/f.png", "../../assets/images/f.png"),
    ):
        assert a in want
        want = want.replace(a, b)
    assert got[1].html == want and got[1].path == "pages/bird/Tern.html" and got[1].replaced == 6
    assert (got[2].html, got[2].path, got[2].replaced) == ("no links", "pages/index.html", 0)
    assert got[3].replaced == 0 and 4 not in got and got[5].html == 'href="Auk.html"'


def test_frontier_by_the_last_log_row(spark):
    links = spark.createDataFrame([(2, 0, "r2", "https://site.org/wiki/bird/B"), (1, 5, "r1", "https://site.org/wiki/bird/B"), (1, 1, "r1", "https://site.org/wiki/images/x_s.png"), (1, 2, "r1", "https://site.org/wiki/bird/C"), (3, 0, "r3", "https://site.org/wiki/bird/D"), (3, 1, "r3", "https://site.org/wiki/images/x.png")], "page_id long, pos int, src string, dst string")
    log = spark.createDataFrame([("https://site.org/wiki/bird/C", 404, 1), ("https://site.org/wiki/bird/C", 200, 2), ("https://site.org/wiki/bird/D", 200, 3), ("https://site.org/wiki/bird/D", 500, 4), ("https://site.org/wiki/images/x_l.png", 200, 1)], "url string, status int, seq int")
    got = [(r.tier, r.url.rsplit("/", 1)[1], r.referrer) for r in A.crawl_frontier(links, log, SITE).orderBy("tier", "page_id", "pos", "url").collect()]
    assert got == [(0, "B", "r1"), (0, "D", "r3"), (1, "x.png", "r1"), (1, "x_s.png", "r1"), (1, "x_t.png", "r1")]
    assert A.crawl_frontier(links.where("false"), log, SITE).collect() == []


@pytest.mark.parametrize(("narrow", "after"), [(0, 2), (1000, 8)])
def test_reachable_nodes_and_their_hops(spark, monkeypatch, narrow, after):
    monkeypatch.setattr(A, "NARROW", narrow)
    monkeypatch.setattr(A, "COMPACT_AFTER", after)
    edges = [(i, i + 1) for i in range(21)] + [(5, 3), (21, 0), (2, 9), (30, 31), (4, 4), (4, 4), (7, 40), (40, 41), (40, 42), (42, 12), (8, None)]
    known, frontier, hop = {0: 0, 30: 0}, {0, 30}, 0
    while frontier:
        hop += 1
        frontier = {d for s, d in edges if s in frontier} - set(known)
        known |= dict.fromkeys(frontier, hop)
    e, seed = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,), (30,), (0,)], "node int")
    rows = [(r.node, r.hops) for r in A.reachable_set(e, seed).collect()]
    assert len(rows) == len(known) and dict(rows) == known
    assert A.reachable_set(e, seed.where("false")).collect() == []


def test_a_long_chain_ends_with_few_partitions(spark):
    chain = spark.range(120).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = A.reachable_set(chain, spark.range(1).select(F.col("id").alias("node")))
    assert got.rdd.getNumPartitions() <= 4 * (A.COMPACT_AFTER + 1) and got.agg(F.count("*"), F.max("hops"), F.sum("hops")).first()[:] == (121, 120, 7260)


def test_renditions_meet_names_once(spark):
    """Against brute force over all pairs; names are not multiplied by the renditions they may have."""
    import random
    import re

    from fieldbook.operators import archive as A

    r = random.Random(3)
    make = lambda: "".join(r.choice(["a", "A", "_l", "_L", "_t", "_s", ".", ".jpg", ".JPG", "_"]) for _ in range(r.randint(1, 5)))
    names, files = {make() for _ in range(300)} | {"x_s.jpg", "y_L._s"}, {make() for _ in range(900)} | {"X_T.jpg", "x_l.JPG", "y_L._l"}
    expected = {}
    for n in names:
        stem = re.sub(r"(?i)_[stl](\.[a-z]+)$", r"\1", n)
        base, ext = re.match(r"(?s)^(.*?)(\.[^.]+)?$", stem).groups()
        wanted = [stem.lower(), *[f"{base}_{v}{ext or ''}".lower() for v in "lts"]]
        expected[n] = min(((wanted.index(f.lower()), f) for f in files if f.lower() in wanted), default=(0, None))[1]
    got = A.best_rendition(spark.createDataFrame([(n,) for n in names] * 2, "name string"), spark.createDataFrame([(f,) for f in files], "file string"))
    rows = got.collect()
    assert len(rows) == len(names) and {x.name: x.file for x in rows} == expected
    assert "posexplode(" not in got._jdf.queryExecution().optimizedPlan().toString()
