"""Keyword-stuffed and link-list pages: redundancy beyond what length and language explain, and few sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Compressed size against the expected one, below which the redundancy is extreme; and the most sentences beside it.
EXTREME, EXTREME_PROPER = 0.72, 0.6
#: Milder redundancy counts where next to no words stand in sentences, or few do and the words repeat.
MILD, MILD_PROPER, MILD_DISTINCT, BARE_PROPER = 0.85, 0.25, 0.5, 0.1
#: Words in sentences from which a page serves to learn what compression is usual.
USUAL_PROPER = 0.5


def expected(facts: DataFrame) -> DataFrame:
    """(lang, slope, start): log compression ratio as a line in log length, from prose pages of each language.

    Sums only, so it combines over any partitioning; at most a handful of rows.
    """
    usual = facts.where(F.col("proper") >= USUAL_PROPER * F.col("words")).select(
        "lang", F.explode(F.arrays_zip("sizes", "packed")).alias("b")
    )
    points = usual.where("b.sizes > 0").select(
        "lang", F.log("b.sizes").alias("x"), F.log(F.try_divide("b.packed", "b.sizes")).alias("y")
    )
    return points.groupBy("lang").agg(
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("y", "x"), F.avg("y")).alias("start"),
    )


def measured(facts: DataFrame) -> DataFrame:
    """(page_id, words, proper_share, distinct_share, redundancy): redundancy is compressed size over the expected one."""
    curve = expected(facts).where("slope is not null and start is not null").collect()  # a row per known language
    # Pages without any known function word, as pure keyword pages, are held against all languages together.
    mean = [sum(c[k] for c in curve) / len(curve) if curve else v for k, v in (("slope", -0.25), ("start", 0.7))]

    def of(name: str, other: float):
        out = F.lit(other)
        for c in curve:
            out = F.when(F.col("lang") == c.lang, F.lit(c[name])).otherwise(out)
        return out

    ratio = F.aggregate(
        F.transform(
            F.filter("sizes", lambda n: n > 0), lambda n: F.exp(F.col("start") + (F.col("slope") + 1) * F.log(n))
        ),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    return (
        facts.where("words > 0")
        .withColumn("slope", of("slope", mean[0]))
        .withColumn("start", of("start", mean[1]))
        .select(
            "page_id",
            "words",
            F.try_divide("proper", "words").alias("proper_share"),
            F.try_divide("distinct_words", "words").alias("distinct_share"),
            F.try_divide(F.aggregate("packed", F.lit(0.0), lambda a, b: a + b), ratio).alias("redundancy"),
        )
    )


def stuffed_pages(facts: DataFrame, links: DataFrame, residue: DataFrame) -> DataFrame:
    """(page_id, words, proper_share, distinct_share, redundancy, anchor_share): pages of keywords, link lists or tags.

    Every such page is more redundant than its length and language explain, and
    has few words in sentences. anchor_share is the part of its words that stand
    in its links' anchors. facts should be durable. residue holds the page_id of
    residue pages: mock Latin is as redundant as spam and has its own operator.
    Pages without html or words of their own are no cases. Null or blank anchors
    count as links without words; links of unknown pages are ignored; repeated
    rows count.
    """
    proper, redundancy = F.col("proper_share"), F.col("redundancy")
    extreme = (redundancy < EXTREME) & (proper < EXTREME_PROPER)
    bare = (proper < BARE_PROPER) | ((proper < MILD_PROPER) & (F.col("distinct_share") < MILD_DISTINCT))
    stuffed = measured(facts).where(extreme | ((redundancy < MILD) & bare)).join(residue.select("page_id"), "page_id", "left_anti")
    words = F.coalesce(F.size(F.regexp_extract_all(F.col("anchor_text"), F.lit(r"[\p{L}\p{N}]+"), 0)), F.lit(0))
    anchors = links.groupBy("page_id").agg(F.sum(words).alias("anchor_words"))
    return stuffed.join(anchors, "page_id", "left").select(
        "page_id",
        "words",
        "proper_share",
        "distinct_share",
        "redundancy",
        F.coalesce(F.try_divide("anchor_words", "words"), F.lit(0.0)).alias("anchor_share"),
    )
