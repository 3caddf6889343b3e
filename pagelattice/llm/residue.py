"""Template residue and error pages: messages grouped across sites, classified, and led back to their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import durable, small_side

#: Crawls that must share a message before its weak wording counts.
RECUR = 3
#: Sentences of its own that do not save a page.
REAL_MOST = 2


def messages(facts: DataFrame) -> DataFrame:
    """(key, text, crawls, pages, kind, strong): normalised messages that are residue, with how widely they recur.

    Messages are grouped by the hash of their normalised text, first within a
    crawl and then across crawls, so a message of a third of all pages is one
    row per crawl before it moves. Placeholders and clear wording count from one
    source on: most of them are written anew on each site. Weak wording counts
    only if RECUR crawls share the message.
    """
    lines = facts.select("crawl_id", F.explode("messages").alias("m")).select(
        "crawl_id", F.xxhash64("m.text").alias("key"), "m.text", "m.kind", "m.strong"
    )
    return (
        lines.groupBy("crawl_id", "key")
        .agg(F.max(F.struct("text", "kind", "strong")).alias("x"), F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.max("x").alias("x"), F.count(F.lit(1)).alias("crawls"), F.sum("n").alias("pages"))
        .select("key", "x.text", "crawls", "pages", "x.kind", "x.strong")
        .where(F.col("strong") | (F.col("crawls") >= RECUR))
    )


def residue_pages(facts: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, residue, real, kind): pages with residue messages and next to no sentences of their own.

    facts and found (the messages) should be durable: both are read twice.
    Pages without html or without text are no cases. A line counts once per
    page. A page with as many real sentences as messages is content that quotes
    them. Rows stored twice are two pages.
    """
    lines = facts.select("page_id", "reals", F.explode("messages").alias("m")).select(
        "page_id", "reals", F.xxhash64("m.text").alias("key"), F.col("m.real").alias("real")
    )
    return (
        lines.join(small_side(found.select("key", "kind")), "key")
        .groupBy("page_id", "reals")
        .agg(F.count(F.lit(1)).alias("residue"), F.count_if("real").alias("both"), F.min("kind").alias("kind"))
        .select("page_id", "residue", (F.col("reals") - F.col("both")).alias("real"), "kind")
        .where((F.col("real") <= REAL_MOST) & (F.col("residue") >= F.col("real")))
    )


def find(facts: DataFrame) -> DataFrame:
    """Residue pages of durable facts."""
    return residue_pages(facts, durable(messages(facts)))
