"""What stored crawls tell of addresses: statuses of pages and link targets, redirects, and the files of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probe_table(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(url, status_code, checked_at): the best known status of every address, one row each.

    A fetched page tells its own status: its last fetch, of ties the largest
    status. Other addresses have the largest status that any link to them
    records, 0 standing for a failure without one. Addresses nobody tells
    anything of have no row; null addresses neither.
    """
    fetched = pages.where("url is not null and status_code is not null").select(
        "url", F.col("status_code").cast("int").alias("status_code"), F.coalesce("crawled_at", F.lit(0).cast("timestamp")).alias("at"), F.lit(1).alias("own")
    )
    seen = links.where("href is not null and (target_status_code is not null or target_error is not null)").select(
        F.col("href").alias("url"),
        F.coalesce("target_status_code", F.lit(0)).cast("int").alias("status_code"),
        F.lit(0).cast("timestamp").alias("at"),
        F.lit(0).alias("own"),
    )
    best = F.max(F.struct("own", "at", "status_code"))
    return fetched.unionAll(seen).groupBy("url").agg(best.alias("x")).select("url", "x.status_code", F.col("x.at").alias("checked_at"))


def _header(name: str) -> Column:
    held = F.from_json("headers_json", "map<string,string>")
    return F.element_at(F.transform_keys(F.coalesce(held, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)), name)


def redirect_table(pages: DataFrame) -> DataFrame:
    """(src, dst, status_code) of stored pages that answered with a redirect and named its target; one row per source."""
    moved = pages.where("status_code between 300 and 399 and url is not null").select(
        F.col("url").alias("src"), _header("location").alias("dst"), F.col("status_code").cast("int").alias("status_code"), "crawled_at"
    )
    last = F.max(F.struct("crawled_at", "dst", "status_code"))
    return moved.where("dst is not null").groupBy("src").agg(last.alias("x")).select("src", "x.dst", "x.status_code")


def _origin(url: str = "url") -> Column:
    return F.regexp_extract(F.col(url), r"^(?i)(https?://[^/?#]+)", 1)


def site_table(pages: DataFrame) -> DataFrame:
    """One row per origin of stored pages: its robots file, its sitemap and the statuses of its variants, as far as stored.

    A file that no crawl stored is unknown: its status is null, as that of an
    address that was never asked for. Of a file stored twice, the last counts.
    """
    at = pages.where("url is not null").select(
        _origin().alias("origin"),
        F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"),
        F.col("status_code").cast("int").alias("status"),
        "html",
        F.coalesce("crawled_at", F.lit(0).cast("timestamp")).alias("crawled_at"),
        _header("location").alias("location"),
    )

    def last(path: str, column: str) -> Column:
        return F.max_by(F.when(F.col("path") == path, F.col(column)), F.when(F.col("path") == path, F.col("crawled_at")))

    sites = (
        at.where("origin <> ''")
        .groupBy("origin")
        .agg(
            last("/robots.txt", "status").alias("robots_status"),
            last("/robots.txt", "html").alias("robots"),
            last("/sitemap.xml", "status").alias("sitemap_status"),
            last("/sitemap.xml", "html").alias("sitemap"),
            last("/", "status").alias("home_status"),
            last("/", "location").alias("home_location"),
        )
    )
    bare = F.regexp_replace("origin", r"^(?i)(https?)://(www\.)?", "")
    www = F.col("origin").rlike(r"^(?i)https?://www\.")
    keyed = sites.withColumn("bare", F.lower(bare)).withColumn("secure", F.col("origin").rlike("^(?i)https:")).withColumn("www", www)
    # The variants of a site are its few other origins.
    variants = keyed.groupBy("bare").agg(
        F.max(F.when(F.col("www"), F.col("home_status"))).alias("www_status"),
        F.max(F.when(~F.col("www"), F.col("home_status"))).alias("bare_status"),
        F.max(F.when(~F.col("secure"), F.col("home_status"))).alias("http_status"),
        F.max(F.when(~F.col("secure"), F.col("home_location"))).alias("http_location"),
        F.coalesce(F.max(F.col("home_location").isNotNull()), F.lit(False)).alias("variants_redirect"),
    )
    return keyed.join(variants, "bare").select(
        "origin", "robots_status", "robots", "sitemap_status", "sitemap", "www_status", "bare_status", "variants_redirect",
        "http_status", "http_location", F.lit(None).cast("int").alias("missing_status"), F.lit(None).cast("string").alias("missing_body"),
    )
