"""Structured Streaming over arriving pages and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.plans.audit import native_results
from pagelattice.plans.rules import selected


def read_pages(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Page files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_arrivals(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (crawl_id, url_hash) once; state is dropped behind the watermark."""
    return pages.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["crawl_id", "url_hash"])


def status_counts(pages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages per crawl, window and status class, for append mode."""
    kind = F.floor(F.col("status_code") / 100).cast("int")
    return (
        pages.withWatermark("crawled_at", late)
        .groupBy(F.window("crawled_at", window), "crawl_id", kind.alias("status_class"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "crawl_id", "status_class", "n")
    )


def native_stream(pages: DataFrame) -> DataFrame:
    """The Catalyst rules over a stream of prepared pages: a stateless projection."""
    return native_results(pages, selected())
