"""Operators over stored crawls, pages, links, audits, results and issues.

Every operator is a DataFrame plan: columns and filters reach the parquet
scans, aggregates combine before their shuffle, and windows hold keys, not
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.plans.rules.registry import CATEGORIES


def url_hash(url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the url as it stands."""
    return F.substring(F.sha2(url, 256), 1, 16)


def one_per_url(pages: DataFrame) -> DataFrame:
    """The page row crawled last of each (crawl_id, url_hash); of ties the largest id."""
    w = Window.partitionBy("crawl_id", "url_hash").orderBy(F.col("crawled_at").desc_nulls_last(), F.col("id").desc())
    keys = pages.select("id", "crawl_id", "url_hash", "crawled_at").withColumn("k", F.row_number().over(w)).where("k = 1")
    return pages.join(keys.select("id"), "id", "left_semi")


def latest(df: DataFrame, by: str, at: str = "started_at", n: int = 1) -> DataFrame:
    """The n latest rows of each group, numbered from 1 in column k."""
    w = Window.partitionBy(by).orderBy(F.col(at).desc_nulls_last(), F.col("id").desc())
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def page_counts(pages: DataFrame) -> DataFrame:
    """Per crawl: pages, pages by status class, pages with an error, and bytes of html."""
    s = F.col("status_code")
    return pages.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if((s >= 200) & (s < 300)).alias("n_2xx"),
        F.count_if((s >= 300) & (s < 400)).alias("n_3xx"),
        F.count_if((s >= 400) & (s < 500)).alias("n_4xx"),
        F.count_if(s >= 500).alias("n_5xx"),
        F.count_if(F.col("error_message").isNotNull()).alias("n_errors"),
        F.coalesce(F.sum("html_size"), F.lit(0)).alias("html_size"),
    )


def is_broken() -> Column:
    return F.coalesce(F.col("target_status_code") >= 400, F.lit(False)) | F.col("target_error").isNotNull()


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose target failed, with the page that holds them. The filter runs before the join."""
    bad = links.where(is_broken()).select("page_id", F.col("id").alias("link_id"), "href", "target_status_code", "target_error")
    return bad.join(pages.select(F.col("id").alias("page_id"), "crawl_id", "url"), "page_id")


def external_links(links: DataFrame) -> DataFrame:
    return links.where("is_internal = 0").select("href").distinct()


def link_counts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Per crawl: links in all, internal, external, nofollow and broken. Summed per page before the join."""
    per_page = links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_internal") == 1).alias("internal"),
        F.count_if(F.col("is_internal") == 0).alias("external"),
        F.count_if(F.col("is_nofollow") == 1).alias("nofollow"),
        F.count_if(is_broken()).alias("broken"),
    )
    names = ("total", "internal", "external", "nofollow", "broken")
    return (
        per_page.join(pages.select(F.col("id").alias("page_id"), "crawl_id"), "page_id")
        .groupBy("crawl_id")
        .agg(*(F.sum(c).alias(c) for c in names))
    )


def unlinked_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no internal link of their crawl leads to."""
    targets = (
        links.where("is_internal = 1")
        .join(pages.select(F.col("id").alias("page_id"), "crawl_id"), "page_id")
        .select("crawl_id", F.col("href").alias("url"))
        .distinct()
    )
    return pages.select("id", "crawl_id", "url").join(targets, ["crawl_id", "url"], "left_anti")


def result_points(status: Column) -> Column:
    return F.when(status == "pass", 100).when(status == "warn", 50).otherwise(0)


def category_scores(results: DataFrame) -> DataFrame:
    """(audit_id, category_id, score, passed, warned, failed) of stored results; 0 counts as weight 1."""
    w = F.when(F.col("score") > 0, F.col("score")).otherwise(1)
    return results.groupBy("audit_id", "category_id").agg(
        F.round(F.sum(result_points(F.col("status")) * w) / F.sum(w)).cast("int").alias("score"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "warn").alias("warned"),
        F.count_if(F.col("status") == "fail").alias("failed"),
    )


def weights(df: DataFrame) -> DataFrame:
    """The category dimension: (category_id, name, weight), a row per category."""
    rows = [(k, name, w) for k, (name, w) in CATEGORIES.items()]
    return df.sparkSession.createDataFrame(rows, "category_id string, name string, weight int")


def overall_scores(categories: DataFrame) -> DataFrame:
    joined = categories.join(F.broadcast(weights(categories)), "category_id").where("weight > 0")  # 20 rows
    return joined.groupBy("audit_id").agg(
        F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).cast("int").alias("overall_score")
    )


def failed_rules(results: DataFrame) -> DataFrame:
    return results.where("status = 'fail'").groupBy("audit_id", "rule_id").agg(F.count(F.lit(1)).alias("fails"))


def make_issues(results: DataFrame) -> DataFrame:
    """Failing and warning results as issues: one per rule and message, with its distinct pages and priority.

    The pages are counted here; `issue_pages` lists them as rows, so that an
    issue of a third of all pages needs no list in one task.
    """
    bad = results.where("status in ('fail', 'warn')")
    # Distinct pages first: (issue, page) is spread over all tasks, whatever one issue holds.
    per_page = bad.groupBy("audit_id", "rule_id", "category_id", "rule_name", "message", "status", "page_url").agg(F.lit(1).alias("one"))
    grouped = per_page.groupBy("audit_id", "rule_id", "category_id", "rule_name", "message", "status").agg(
        F.count("page_url").alias("affected_pages")
    )
    return issue_rows(grouped)


def issue_rows(grouped: DataFrame) -> DataFrame:
    """Counted groups of results (rule, names, status and affected_pages) in the columns of issues."""
    severity = F.when(F.col("status") == "fail", "critical").otherwise("warning")
    return grouped.select(
        "audit_id",
        "rule_id",
        "category_id",
        severity.alias("severity"),
        F.col("rule_name").alias("title"),
        F.col("message").alias("description"),
        "affected_pages",
        priority(severity, F.col("affected_pages")).alias("priority_score"),
    )


def issue_pages(results: DataFrame) -> DataFrame:
    return results.where("status in ('fail', 'warn') and page_url is not null").select(
        "audit_id", "rule_id", "message", "status", "page_url"
    ).distinct()


def priority(severity: Column, pages: Column) -> Column:
    """round(base * log10(pages + 1)), base 100 for critical, 50 for warning, 10 else."""
    base = F.when(severity == "critical", 100).when(severity == "warning", 50).otherwise(10)
    return F.round(base * F.log10(pages + 1)).cast("int")


def top_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """The n issues of highest priority of each audit: the report's list, as its feature."""
    w = Window.partitionBy("audit_id").orderBy(F.col("priority_score").desc(), F.col("affected_pages").desc(), "rule_id", "severity", "description")
    return issues.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def audit_pairs(audits: DataFrame) -> DataFrame:
    """(domain, audit_id, previous_id, overall_score, previous_score): each domain's latest audit and the one before."""
    two = latest(audits.select("id", "domain", "started_at", "overall_score"), "domain", n=2)
    now = two.where("k = 1").select("domain", F.col("id").alias("audit_id"), "overall_score")
    old = two.where("k = 2").select("domain", F.col("id").alias("previous_id"), F.col("overall_score").alias("previous_score"))
    return now.join(old, "domain", "left")


def compare_audits(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Score change, new issues and fixed issues between the audits of each pair.

    A rule is new if it fails now and has no previous row or a previous row
    that does not fail; fixed is the same the other way round. A rule that
    fails on one page and passes on another can be both.
    """
    rules = results.groupBy("audit_id", "rule_id").agg(
        F.max((F.col("status") == "fail").cast("int")).alias("fails"),
        F.max((F.col("status") != "fail").cast("int")).alias("holds"),
    )

    def changed(this: str, other: str, name: str) -> DataFrame:
        a = pairs.select(F.col(this).alias("a"), F.col(other).alias("b"), "domain").where("a is not null and b is not null")
        failing = a.join(rules.where("fails = 1").select(F.col("audit_id").alias("a"), "rule_id"), "a")
        before = rules.select(F.col("audit_id").alias("b"), "rule_id", "holds")
        left = failing.join(before, ["b", "rule_id"], "left").where("holds is null or holds = 1")
        return left.groupBy("domain").agg(F.count_distinct("rule_id").alias(name))

    return (
        pairs.join(changed("audit_id", "previous_id", "new_issues"), "domain", "left")
        .join(changed("previous_id", "audit_id", "fixed_issues"), "domain", "left")
        .select(
            "domain",
            "audit_id",
            "previous_id",
            (F.col("overall_score") - F.col("previous_score")).alias("score_delta"),
            F.coalesce("new_issues", F.lit(0)).alias("new_issues"),
            F.coalesce("fixed_issues", F.lit(0)).alias("fixed_issues"),
        )
    )


def category_deltas(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """Category scores of each pair's audits; a missing previous score counts as 0."""
    now = pairs.join(categories.select("audit_id", "category_id", "score"), "audit_id")
    old = categories.select(F.col("audit_id").alias("previous_id"), "category_id", F.col("score").alias("old"))
    return now.join(old, ["previous_id", "category_id"], "left").select(
        "domain", "category_id", "score", F.coalesce("old", F.lit(0)).alias("previous_score"), (F.col("score") - F.coalesce("old", F.lit(0))).alias("delta")
    )


def score_trend(audits: DataFrame, n: int = 10) -> DataFrame:
    """The last n audits of each domain in time order, with the change from one to the next."""
    last = latest(audits.select("id", "domain", "started_at", "overall_score"), "domain", n=n)
    w = Window.partitionBy("domain").orderBy(F.col("k").desc())
    return last.select(
        "domain", F.col("id").alias("audit_id"), "overall_score", (F.col("overall_score") - F.lag("overall_score").over(w)).alias("delta")
    )


# A number before a unit, and what stands for both.
UNITS = [
    (r"[0-9]+ chars?", "X chars"),
    (r"[0-9]+ words?", "X words"),
    (r"[0-9]+ images?", "X images"),
    (r"[0-9]+ links?", "X links"),
    (r"[0-9]+px", "Xpx"),
    (r"[0-9]+ms", "Xms"),
    (r"[0-9]+KB", "XKB"),
    (r"[0-9]+\.[0-9]+s", "X.Xs"),
]


def mask_numbers(message: Column) -> Column:
    """Numbers before units masked, so that messages that differ in them alone are one."""
    for pattern, mask in UNITS:
        message = F.regexp_replace(message, pattern, mask)
    return message


def grouped_messages(results: DataFrame) -> DataFrame:
    """Issues as a terminal report groups them: by rule and masked message, with their distinct pages."""
    bad = results.where("status <> 'pass'").withColumn("masked", mask_numbers(F.col("message")))
    pages = bad.select("audit_id", "category_id", "rule_id", "status", "masked", "page_url").distinct()
    return pages.groupBy("audit_id", "category_id", "rule_id", "status", "masked").agg(F.count("page_url").alias("n_pages"))


def fresh(cache: DataFrame, now: Column, ttl_days: int = 7) -> DataFrame:
    """The latest probe of each url that is not older than the time to live; none for a time to live of 0."""
    w = Window.partitionBy("url").orderBy(F.col("checked_at").desc())
    last = cache.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    if ttl_days <= 0:
        return last.where("false")
    return last.where(F.col("checked_at") >= now - F.expr(f"interval {int(ttl_days)} days"))


def text_measures(documents: DataFrame) -> DataFrame:
    """Words, sentences and estimated pixel width of each text, inside code generation."""
    t = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: w != "")
    capitals = F.regexp_count(t, F.lit("[A-Z]"))
    thin = F.regexp_count(t, F.lit("[ .,:;!|]"))
    width = 9.5 * capitals + 4.0 * thin + 7.5 * (F.length(t) - capitals - thin)
    return documents.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.greatest(F.lit(1), F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.regexp_replace(s, r"\s", "") != ""))).cast("bigint").alias("n_sentences"),
        F.round(width).cast("bigint").alias("pixel_width"),
    )


def exact_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, first_id, copies): each text's first document and how many hold it. Null texts are no copies of each other."""
    keyed = documents.where("text is not null").select("doc_id", F.md5("text").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(groups.where("copies > 1"), "key").select("doc_id", "first_id", "copies")
