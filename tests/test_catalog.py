"""Listings, lifecycle writes, link cache, images, and what stored crawls tell of addresses."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagelattice.operators import catalog
from pagelattice.sources import probes

NOW = datetime(2024, 5, 10)


def test_listings(spark):
    df = spark.createDataFrame([(1, "a", NOW), (2, "b", NOW), (3, "a", None)], "id bigint, status string, started_at timestamp")
    assert [r.id for r in catalog.listed(df, catalog.newest()).collect()] == [2, 1, 3]
    assert [r.id for r in catalog.listed(df, catalog.newest(), status="a", limit=1).collect()] == [1]
    assert [r.id for r in catalog.listed(df, catalog.newest(), offset=1, status=["a", "b"]).collect()] == [1, 3]
    assert [r.id for r in catalog.results_of(df, status=None).collect()] == [1, 2, 3] and catalog.results_of(df.limit(0)).count() == 0


def test_writes(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (None, "z", 7)], "k bigint, v string, n int")
    new = spark.createDataFrame([(2, "Y", 0), (3, "w", 1), (3, "w", 1), (None, "q", 2)], "k bigint, v string, n int")
    assert sorted((r.k or 0, r.v) for r in catalog.upserted(df, new, "k").collect()) == [(0, "q"), (0, "z"), (1, "x"), (2, "Y"), (3, "w")]
    got = catalog.changed(df, spark.createDataFrame([(1, None), (9, "n")], "k bigint, v string"), "k").collect()
    assert sorted((r.k or 0, r.v, r.n) for r in got if r.k != 1) == [(0, "z", 7), (2, "y", 6)] and [r.v for r in got if r.k == 1] == [None]
    crawls = spark.createDataFrame([(1, "running", None, None), (2, "running", None, None)], "id bigint, status string, completed_at timestamp, error_message string")
    done = {r.id: r for r in catalog.finished(crawls, "id", 2, "failed", F.lit(NOW), "no answer").collect()}
    assert done[1].status == "running" and (done[2].status, done[2].completed_at, done[2].error_message) == ("failed", NOW, "no answer")
    pages = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id bigint, crawl_id bigint")
    left = catalog.deleted(crawls, "id", spark.createDataFrame([(2,)], "x bigint"), {"pages": (pages, "crawl_id")})
    assert [r.id for r in left[""].collect()] == [1] and sorted(r.id for r in left["pages"].collect()) == [10, 12]


def test_cache(spark):
    kind = "url string, status_code int, checked_at timestamp"
    old = spark.createDataFrame([("u", 200, NOW - timedelta(9)), ("v", 404, NOW - timedelta(8))], kind)
    new = spark.createDataFrame([("u", 500, NOW), ("w", 0, NOW), (None, 200, NOW)], kind)
    cache = catalog.cached(old, new)
    assert sorted((r.url, r.status_code) for r in cache.collect()) == [("u", 500), ("v", 404), ("w", 0)]
    assert tuple(catalog.cache_stats(cache, F.lit(NOW)).first()) == (3, 2, 1, 3)
    assert sorted(r.url for r in catalog.cache_cleaned(cache, F.lit(NOW)).collect()) == ["u", "w"]


def test_images(spark):
    html = "<IMG src=/a.PNG alt=''><figure><img src='b.webp?x=1' width=3 height=4 loading=lazy alt=b></figure><img src=data:x><picture><source><img data-src=c srcset='c 2x'></picture>"
    df = spark.createDataFrame([(1, 7, "https://e.com/p/", html), (2, 7, None, "<p>"), (3, 7, "u", None)], "id bigint, crawl_id bigint, url string, html string")
    rows = catalog.images(df).orderBy("place").collect()
    assert [(r.src, r.alt, r.format, r.lazy) for r in rows] == [
        ("https://e.com/a.PNG", "", "png", False), ("https://e.com/p/b.webp?x=1", "b", "webp", True), ("https://e.com/p/c", None, None, True),
    ]
    assert [(r.in_figure, r.in_picture, r.srcset) for r in rows] == [(False, False, False), (True, False, False), (False, True, True)]
    assert tuple(catalog.image_stats(catalog.images(df)).first()) == (7, 3, 1, 1, 2, 1, 1)
    assert {r.format: r.images for r in catalog.image_formats(catalog.images(df)).collect()} == {"png": 1, "webp": 1, "unknown": 1}
    assert catalog.image_stats(catalog.images(df.limit(0))).count() == 0


PAGES = "id bigint, url string, status_code int, html string, headers_json string, crawled_at timestamp"
LINKS = "id bigint, href string, target_status_code int, target_error string"


def test_probes_and_sites(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://www.e.com/", 200, "h", None, NOW), (2, "https://www.e.com/", 404, None, None, NOW - timedelta(1)),
            (3, "http://e.com/", 301, None, '{"Location": "https://www.e.com/"}', NOW), (4, "https://www.e.com/robots.txt", 200, "User-agent: *", None, NOW),
            (5, None, 200, "h", None, NOW), (6, "https://f.com/x", None, None, None, None),
        ],
        PAGES,
    )
    links = spark.createDataFrame([(1, "https://www.e.com/", 500, None), (2, "o", 200, None), (3, "o", 404, None), (4, "t", None, "timeout"), (5, "n", None, None), (6, None, 200, None)], LINKS)
    got = {r.url: r.status_code for r in probes.probe_table(pages, links).collect()}
    assert got == {"https://www.e.com/": 200, "http://e.com/": 301, "https://www.e.com/robots.txt": 200, "o": 404, "t": 0}
    assert [tuple(r) for r in probes.redirect_table(pages).collect()] == [("http://e.com/", "https://www.e.com/", 301)]
    sites = {r.origin: r for r in probes.site_table(pages).collect()}
    assert set(sites) == {"https://www.e.com", "http://e.com", "https://f.com"}
    main = sites["https://www.e.com"]
    assert (main.robots_status, main.robots, main.sitemap_status, main.www_status, main.bare_status, main.http_status) == (200, "User-agent: *", None, 200, 301, 301)
    assert main.variants_redirect and main.http_location == "https://www.e.com/" and sites["https://f.com"].robots is None
    known = {r.id: r.target_status_code for r in catalog.link_statuses(links, probes.probe_table(pages, links.limit(0))).collect()}
    assert known == {1: 500, 2: 200, 3: 404, 4: None, 5: None, 6: 200}
