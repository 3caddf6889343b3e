"""The corpus queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm import leaks, main_lines, mixing, near_pages, percentiles, quality, page_facts, residue, site_lines, stuffing
from pagelattice.llm.parsed import parse
from pagelattice.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, folder, "pages")).select("crawl_id", "line")


def p1_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, folder, "pages"))


def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return site_lines.without_lines(pages, site_lines.repeated_lines(pages))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_lines.main_line_hashes(table(spark, folder, "pages"), table(spark, folder, "links"))


def p2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_lines.main_texts(table(spark, folder, "pages"), table(spark, folder, "links"))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse(table(spark, folder, "pages"))
    return page_facts.page_facts(parsed, page_facts.site_support(parsed))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find(_facts(spark, folder)).select("page_id")


def p3_messages(spark: SparkSession, folder: str) -> DataFrame:
    return residue.messages(_facts(spark, folder)).select("text", "kind", "crawls", "pages")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pages.page_pairs(_classes(spark, folder))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_pages.groups(_classes(spark, folder))


def _classes(spark: SparkSession, folder: str) -> near_pages.Classes:
    return near_pages.similar_classes(table(spark, folder, "pages"), table(spark, folder, "links"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    facts = _facts(spark, folder)
    broken = residue.find(facts)
    return stuffing.stuffed_pages(facts, table(spark, folder, "links"), broken).select("page_id")


def p7_measures(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.measured(_facts(spark, folder))


METRICS = ["cwv_lcp", "load_time_ms", "ttfb_ms"]
SHARES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Crawls whose 95th percentile of a metric is over ten times their median, from at least 15 values."""
    got = percentiles.percentiles(table(spark, folder, "pages"), "crawl_id", METRICS, [0.5, 0.95])
    wide = got.where("n >= 15").groupBy("crawl_id", "metric").pivot("share", [0.5, 0.95]).agg(F.first("value"))
    return wide.where("`0.95` > 10 * `0.5`").select("crawl_id", "metric")


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    got = percentiles.percentiles(table(spark, folder, "pages"), "crawl_id", METRICS, SHARES)
    return got.select("crawl_id", "metric", "n", "share", F.round("value", 3).alias("value"))


def p6_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles with bounded error from histograms of separate days, added up."""
    pages = table(spark, folder, "pages").withColumn("day", F.pmod(F.dayofyear("crawled_at"), F.lit(2)))
    parts = [
        percentiles.histogram(percentiles.long_form(pages.where(day), "crawl_id", METRICS), "crawl_id")
        for day in ("day = 0", "day = 1", "day is null")
    ]
    return percentiles.from_histogram(percentiles.combine(parts, "crawl_id"), "crawl_id", SHARES)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_overlap(spark, folder).select("doc_id", "item_id")


def p8_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each leaked item a document holds."""
    return p8_overlap(spark, folder).select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report.where("short").select("source")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report


def p9_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).sample


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p10_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that need no look at structure."""
    ratios = ("mean_word_length", "symbol_ratio", "end_punctuation", "common_share", "words_per_line")
    return p10_statistics(spark, folder).select("doc_id", "n_words", "n_lines", *(F.round(c, 6).alias(c) for c in ratios))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_statistics(spark, folder).where("non_prose").select("doc_id")


QUERIES = {
    q.__name__: q
    for q in (
        *(p1_found, p1_blocks, p1_cleaned, p2_found, p2_main_text, p3_found, p3_messages, p5_found, p5_groups),
        *(p6_found, p6_percentiles, p6_histogram, p7_found, p7_measures, p8_found, p8_overlap, p8_shares),
        *(p9_found, p9_report, p9_sample, p10_found, p10_statistics, p10_ratios),
    )
}

_LONG = """long as (
  select crawl_id, 'cwv_lcp' as metric, cwv_lcp as v from pages
  union all select crawl_id, 'load_time_ms', cast(load_time_ms as double) from pages
  union all select crawl_id, 'ttfb_ms', cast(ttfb_ms as double) from pages
), used as (select * from long where v >= 0 and crawl_id is not null)"""

# Lines of a page: block tags and breaks end them, other tags vanish, references are decoded, white space is one space.
_BREAKS = (
    "p|div|section|article|main|aside|header|footer|nav|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|h[1-6]|form|figure|figcaption"
    "|blockquote|pre|body|html|br|hr"
)
_HIDDEN = "<!--.*?-->|<head[ >].*?</head *>|<script.*?</script *>|<style.*?</style *>|<noscript.*?</noscript *>|<template.*?</template *>"
_REFERENCES = [(f"&{n};", html.unescape(f"&{n};")) for n in ("nbsp", "eacute", "uuml", "copy", "rsquo", "#169", "#228", "#39", "quot", "lt", "gt", "amp")]


def _decoded(sql: str) -> str:
    for reference, letter in _REFERENCES:
        sql = f"replace({sql}, '{reference}', chr({ord(letter)}))"
    return sql


_LINES = f"""marked as (select id, crawl_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', '', 'gis'), '[\\r\\n]', ' ', 'g'),
    '</?({_BREAKS})([ /][^>]*)?>', chr(10), 'gi'), '<[^>]*>', '', 'g') as t from pages where html is not null),
  page_lines as (select id, crawl_id, unnest(list_distinct(list_filter(list_transform(string_split(t, chr(10)),
    lambda x: trim(regexp_replace({_decoded('x')}, '[\\s\\x{{00A0}}]+', ' ', 'g'))), lambda x: x <> ''))) as line from marked)"""

_WORDS = r"[\p{L}\p{N}]+"
_BLANK = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ENDS = "'.', '!', '?', '…', '\"', '»', '”', '“', '''', ')', '’'"

ORACLE_SQL: dict[str, str] = {
    "p1_found": f"""with {_LINES}, sizes as (select crawl_id, count(*) as size from marked where crawl_id is not null group by 1)
select crawl_id, line from page_lines join sizes using (crawl_id) group by crawl_id, line, size having count(*) >= 8 and count(*) >= 0.2 * size""",
    "p8_shares": rf"""with i as (select distinct item_id, text, regexp_extract_all(lower(text), '{_WORDS}') as w from eval_items),
  ik as (select *, least(13, len(w)) as k from i where len(w) > 0),
  ig as (select distinct item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as g
    from (select *, unnest(generate_series(1, len(w) - k + 1)) as s from ik)),
  sizes as (select item_id, count(*) as runs from ig group by 1),
  d as (select doc_id, regexp_extract_all(lower(text), '{_WORDS}') as w from documents where text is not null),
  dg as (select distinct doc_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as g
    from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as s from d, (select distinct k from ik) where len(w) >= k))
select doc_id, item_id, round(count(*) / any_value(runs), 6) as overlap from dg join ig using (k, g) join sizes using (item_id) group by 1, 2""",
    "p10_ratios": rf"""with d as (select doc_id, text, regexp_extract_all(lower(text), '{_WORDS}') as w, regexp_replace(text, '{_BLANK}', '', 'g') as solid,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANK}+$', '')), lambda x: x <> '') as l from documents),
  c as (select list(distinct lower(word)) as common from common_words where word is not null)
select doc_id, case when coalesce(solid, '') = '' then 0 else len(w) end as n_words, case when coalesce(solid, '') = '' then 0 else len(l) end as n_lines,
  case when solid <> '' then round(case when len(w) = 0 then 0 else list_sum(list_transform(w, lambda x: length(x))) / len(w) end, 6) end as mean_word_length,
  case when solid <> '' then round((length(solid) - coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)) / length(solid), 6) end as symbol_ratio,
  case when solid <> '' then round(len(list_filter(l, lambda x: right(x, 1) in ({_ENDS}))) / len(l), 6) end as end_punctuation,
  case when solid <> '' then round(case when len(w) = 0 then 0 else len(list_filter(w, lambda x: list_contains(common, x))) / len(w) end, 6) end as common_share,
  case when solid <> '' then round(len(w) / len(l), 6) end as words_per_line
from d, c""",
    "p6_found": f"""with {_LONG}
select crawl_id, metric from used group by crawl_id, metric
having count(*) >= 15 and quantile_cont(v, 0.95) > 10 * quantile_cont(v, 0.5)""",
    "p6_percentiles": f"""with {_LONG}, shares as (select unnest({SHARES}::double[]) as share)
select crawl_id, metric, n, share, round(case share
    {" ".join(f"when {x} then q[{i + 1}]" for i, x in enumerate(SHARES))} end, 3) as value
from (select crawl_id, metric, count(*) as n, quantile_cont(v, {SHARES}) as q from used group by crawl_id, metric), shares""",
    # Any usual token count gives the same sources; here words.
    "p9_found": r"""with t as (select source, sum(len(regexp_extract_all(text, '\w+'))) as n from documents group by source)
select source from mix_targets left join t using (source)
where coalesce(n, 0) * max_repeats < target_share * (select sum(n) from t where source in (select source from mix_targets))""",
    "p8_found": r"""with i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
  ik as (select *, least(13, len(w)) as k from i where len(w) > 0),
  ig as (select distinct item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as g
    from (select *, unnest(generate_series(1, len(w) - k + 1)) as s from ik)),
  d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
  dg as (select doc_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as g
    from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as s from d, (select distinct k from ik) where len(w) >= k))
select distinct doc_id, item_id from dg join ig using (k, g)""",
}
