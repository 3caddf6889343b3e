from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import stored
from pagelattice.sources import frontier, records, robots


def test_new_and_fixed(spark):
    audits = spark.createDataFrame([(1, "d", datetime(2024, 1, 1), 50), (2, "d", datetime(2024, 2, 1), 60), (3, "e", None, None)], "id bigint, domain string, started_at timestamp, overall_score int")
    rows = [
        (1, "a", "fail"), (1, "b", "pass"), (1, "c", "fail"), (1, "m", "fail"), (1, "m", "pass"),
        (2, "a", "fail"), (2, "b", "fail"), (2, "c", "pass"), (2, "m", "fail"), (2, "m", "pass"), (2, "n", "fail"),
    ]
    results = spark.createDataFrame(rows, "audit_id bigint, rule_id string, status string")
    got = {r.domain: r for r in stored.compare_audits(stored.audit_pairs(audits), results).collect()}
    # new: b, n and m; fixed: c and m; a fails in both
    assert (got["d"].new_issues, got["d"].fixed_issues, got["d"].score_delta) == (3, 2, 10)
    assert (got["e"].new_issues, got["e"].previous_id) == (0, None)
    trend = stored.score_trend(audits).where("domain = 'd'").orderBy("audit_id").collect()
    assert [r.delta for r in trend] == [None, 10]


def test_issues_count_pages_once(spark):
    rows = [(1, "r", "c", "R", "m", "fail", u, i) for i, u in enumerate(["a", "a", "b,c", None])] + [(1, "r", "c", "R", "m", "warn", "a", 9)]
    df = spark.createDataFrame(rows, "audit_id bigint, rule_id string, category_id string, rule_name string, message string, status string, page_url string, pages int")
    got = {r.severity: r for r in stored.make_issues(df).collect()}
    assert (got["critical"].affected_pages, got["critical"].priority_score) == (2, 48)
    assert (got["warning"].affected_pages, got["warning"].priority_score) == (1, 15)
    assert stored.make_issues(df.limit(0)).count() == 0


def test_cache_and_pages(spark):
    now = datetime(2024, 5, 10)
    cache = spark.createDataFrame([("u", 200, now - timedelta(days=9)), ("u", 404, now - timedelta(days=1)), ("v", 200, now - timedelta(days=8))], "url string, status_code int, checked_at timestamp")
    assert [(r.url, r.status_code) for r in stored.fresh(cache, F.lit(now)).collect()] == [("u", 404)]
    assert stored.fresh(cache, F.lit(now), 0).count() == 0
    pages = spark.createDataFrame([(1, 1, "h", now), (2, 1, "h", now + timedelta(1)), (3, 1, "h", None), (4, None, None, None)], "id bigint, crawl_id bigint, url_hash string, crawled_at timestamp")
    assert sorted(r.id for r in stored.one_per_url(pages).collect()) == [2, 4]


@pytest.mark.parametrize(
    "url, given, expected",
    [
        ("https://e.com/admin", dict(exclude=("/admin/**",)), False),
        ("https://e.com/admin/x", dict(exclude=("/admin/**",)), False),
        ("https://e.com/blog/a/b", dict(include=("/blog/*",)), False),
        ("https://e.com/blog/a", dict(include=("/blog/*",)), True),
    ],
)
def test_url_filter(url, given, expected):
    assert frontier.UrlFilter(**given).should_crawl(url) is expected


def test_normalise():
    f = frontier.UrlFilter()
    assert f.normalise("https://E.com/a/?b=2&utm_x=1&a=1#f") == "https://e.com/a?a=1&b=2"
    assert f.normalise("https://e.com/") == "https://e.com/" and f.normalise("no url") == "no url"
    assert frontier.UrlFilter(allow=("b",)).normalise("https://e.com/?a=1&b=2") == "https://e.com/?b=2"


def test_crawl_is_breadth_first(spark):
    edges = [("/", "/a", 0), ("/", "/b", 1), ("/a", "/c", 0), ("/b", "/", 0), ("/c", "/d", 0), ("/a", "/x.pdf", 1)]
    links = spark.createDataFrame([("https://e.com" + u, "https://e.com" + h, p) for u, h, p in edges], "url string, href string, pos int")
    got = [(r.url[13:], r.depth) for r in frontier.crawl(links, ["https://e.com/"], 4).orderBy("ord").collect()]
    assert got == [("/", 0), ("/a", 1), ("/b", 1), ("/c", 2)]


def test_records_and_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id":"1","url":"u","timestamp":"2024-01-01T00:00:00Z","pages":[{"url":"u/1","status":200,"headers":{"a":"b"}},{"url":"u/2"}]}')
    crawls = records.read_crawls(spark, str(tmp_path / "c.json"))
    assert [(r.ord, r.url, r.status) for r in records.crawl_pages(records.latest_crawl(crawls)).collect()] == [(0, "u/1", 200), (1, "u/2", None)]
    (tmp_path / "audit.toml").write_text("[crawler]\nmax_pages = 7\n")
    config = records.load_config(tmp_path, {"rules": {"disable": ["x"]}})
    assert config["crawler"]["max_pages"] == 7 and config["rules"] == {"enable": ["*"], "disable": ["x"]}
    assert not records.check_config(config) and records.check_config(records.merge(config, {"crawler": {"max_pages": 0}}))


def test_robots():
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: GPTBot\nDisallow: /"
    assert robots.blocked(text, "/a/x", {"*"}) and not robots.blocked(text, "/a/b/c", {"*"}) and not robots.blocked(text, "/z", {"*"})
    assert robots.ai_bots_blocked(text) == 1 and robots.problems("Disallow: /x") == ["order", "no user-agent"]
    assert robots.path_pattern("/*.css$").search("/x/y.css") and not robots.path_pattern("/x$").search("/xy")


def test_stream(spark, tmp_path):
    from pagelattice.streaming import results

    rows = [(1, 1, "h", 200, datetime(2024, 1, 1, 0, m)) for m in (0, 1, 1, 30)] + [(2, 1, None, 404, None)]
    df = spark.createDataFrame(rows, "id bigint, crawl_id bigint, url_hash string, status_code int, crawled_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = results.status_counts(results.read_pages(spark, str(tmp_path / "in"), df.schema), late="5 minutes")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.status_class, r.n) for r in spark.table("counts").collect()] == [(2, 3)]
