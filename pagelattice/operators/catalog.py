"""Listings, statistics and lifecycle writes of the stored tables, and the images of stored pages.

Stored tables are files that are not changed in place: a write returns the new
rows of its table, to be written as a new version or appended. Updates are joins
by key, so any number of them is one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.plans.rules.registry import CATEGORIES
from pagelattice.sources.dom import Page

# --- listings


def listed(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, **equal: object) -> DataFrame:
    """Rows whose columns have the given values, in an order, from an offset on; limit is the page of the listing.

    A value of None takes no part; a list stands for any of its members.
    """
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def newest(column: str = "started_at") -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col("id").desc()]


def results_of(results: DataFrame, limit: int | None = 1000, offset: int = 0, **equal: object) -> DataFrame:
    """Stored results by audit_id, category_id, rule_id, status or page_url, in order of their ids; a page of 1,000 unless told otherwise."""
    return listed(results, [F.col("id")], limit, offset, **equal)


def audit_domains(audits: DataFrame) -> DataFrame:
    """(domain, audits, completed, best_score, last_started_at)."""
    return audits.groupBy("domain").agg(
        F.count(F.lit(1)).alias("audits"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.max("overall_score").alias("best_score"),
        F.max("started_at").alias("last_started_at"),
    )


def crawl_list(crawls: DataFrame, projects: DataFrame) -> DataFrame:
    """Crawls with their project's domain, numbered per project from the newest on."""
    w = Window.partitionBy("project_id").orderBy(*newest())
    named = projects.select(F.col("id").alias("project_id"), "domain")
    return crawls.withColumn("place", F.row_number().over(w)).join(named, "project_id", "left").select("id", "crawl_id", "project_id", "domain", "status", "place")


def weighed_categories(categories: DataFrame) -> DataFrame:
    """Category scores with their weights, numbered per audit by falling weight, then by name."""
    weight = F.element_at(F.create_map(*(F.lit(x) for k, (_, n) in CATEGORIES.items() for x in (k, n))), F.col("category_id"))
    w = Window.partitionBy("audit_id").orderBy(F.col("weight").desc(), "category_id")
    known = categories.withColumn("weight", F.coalesce(weight, F.lit(0)))
    return known.select("audit_id", "category_id", "score", "weight", F.row_number().over(w).alias("place"))


# --- statistics


def html_storage(pages: DataFrame) -> DataFrame:
    """Per crawl: pages with html, their stated bytes, the characters stored and how many are stored compressed."""
    return pages.where("html is not null").groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.sum("html_size"), F.lit(0)).alias("html_bytes"),
        F.sum(F.length("html").cast("bigint")).alias("stored_chars"),
        F.count_if(F.col("html_compressed") == 1).alias("compressed"),
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of some tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def links_of(links: DataFrame, internal: bool | None = None, page_ids: list[int] | None = None) -> DataFrame:
    """Links of some pages, or all; only internal or external ones if asked for."""
    if page_ids is not None:
        links = links.where(F.col("page_id").isin(*page_ids))
    return links if internal is None else links.where(F.col("is_internal") == int(internal))


# --- lifecycle writes


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with these rows added, in place of those of the same key. Of rows with one key any counts; null keys are added."""
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def changed(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The table with the columns of updates written over its own, by key; keys that the table lacks change nothing."""
    names = [c for c in updates.columns if c != key]
    new = updates.dropDuplicates([key]).select(key, F.struct(*names).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(
        *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns)
    )


def finished(table: DataFrame, key: str, value: object, status: str, at: Column, error: str | None = None) -> DataFrame:
    """A crawl or audit set to completed, failed or cancelled: its status, time of completion and error, where the table has one."""
    this = F.col(key) == value
    new = {"status": F.lit(status), "completed_at": at}
    if "error_message" in table.columns:
        new["error_message"] = F.lit(error).cast("string")
    return table.withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in new.items() if c in table.columns})


def deleted(table: DataFrame, key: str, values: DataFrame, owned: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """The table without the rows whose key is in values (a one-column table), under "", and what they own without theirs.

    owned: name -> (table, its column that holds the key).
    """
    gone = values.toDF(key).distinct()
    out = {"": table.join(gone, key, "left_anti")}
    for name, (df, column) in (owned or {}).items():
        out[name] = df.join(gone.withColumnRenamed(key, column), column, "left_anti")
    return out


def link_statuses(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Links with the known status (url, status_code) of their target where they record none."""
    known = statuses.select(F.col("url").alias("href"), F.col("status_code").alias("_code"))
    missing = F.col("target_status_code").isNull() & F.col("target_error").isNull()
    return links.join(known, "href", "left").withColumn("target_status_code", F.when(missing, F.col("_code")).otherwise(F.col("target_status_code"))).drop("_code")


# --- link cache


def cached(cache: DataFrame, probes: DataFrame) -> DataFrame:
    """The cache (url, status_code, checked_at) with newer probes in place of older ones; one row per url."""
    both = cache.select("url", "status_code", "checked_at").unionByName(probes.select("url", "status_code", "checked_at"))
    last = F.max(F.struct("checked_at", "status_code"))
    return both.where("url is not null").groupBy("url").agg(last.alias("x")).select("url", "x.status_code", "x.checked_at")


def cache_stats(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(entries, fresh, stale, failed) against a time to live."""
    fresh = F.coalesce(F.col("checked_at") >= now - F.expr(f"interval {int(days)} days"), F.lit(False))
    return cache.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(fresh).alias("fresh"),
        F.count_if(~fresh).alias("stale"),
        F.count_if((F.col("status_code") >= 400) | (F.col("status_code") == 0)).alias("failed"),
    )


def cache_cleaned(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The entries that are not older than the time to live."""
    return cache.where(F.col("checked_at") >= now - F.expr(f"interval {int(days)} days"))


# --- images

_IMAGES = (
    "page_id bigint, crawl_id bigint, place int, src string, alt string, width string, height string, lazy boolean, format string,"
    " srcset boolean, in_figure boolean, in_picture boolean"
)
_IMAGE_TYPES = (
    *(pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()),
    *(pa.bool_(), pa.bool_(), pa.bool_()),
)


def images(pages: DataFrame) -> DataFrame:
    """One row per image of each page with html, in document order; data addresses and images without one are left out."""
    names = [x.split()[0] for x in _IMAGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, crawl, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                for i, image in enumerate(Page(url, html).images if "<img" in html.lower() else ()):
                    e, stem = image["el"], image["src"].partition("?")[0].partition("#")[0].rpartition("/")[2]
                    kind = stem.rpartition(".")[2].lower() if "." in stem else None
                    rows.append(
                        (page_id, crawl, i, image["src"], image["alt"], image["width"], image["height"], image["lazy"], kind)
                        + (e.get("srcset") is not None, e.inside("figure"), e.inside("picture"))
                    )
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _IMAGE_TYPES)], names=names)

    held = pages.where("html is not null").select(F.col("id").cast("bigint"), F.col("crawl_id").cast("bigint"), F.coalesce("url", F.lit("")), "html")
    return held.mapInArrow(run, _IMAGES)


def image_stats(found: DataFrame) -> DataFrame:
    """Per crawl: images, those without alt text, with an empty one, without dimensions, not lazy, and with candidates of sizes."""
    return found.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("alt").isNull()).alias("without_alt"),
        F.count_if(F.trim("alt") == "").alias("empty_alt"),
        F.count_if(F.col("width").isNull() | F.col("height").isNull()).alias("without_dimensions"),
        F.count_if(~F.col("lazy")).alias("not_lazy"),
        F.count_if(F.col("srcset")).alias("with_srcset"),
    )


def image_formats(found: DataFrame) -> DataFrame:
    """(crawl_id, format, images): unknown formats are `unknown`."""
    return found.groupBy("crawl_id", F.coalesce(F.lower("format"), F.lit("unknown")).alias("format")).agg(F.count(F.lit(1)).alias("images"))
