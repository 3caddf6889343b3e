"""The audit: pages -> rule results -> category and overall scores.

Html crosses to Python once per page. That pass parses the page, evaluates all
DOM rules and returns their statuses as one string, with the few facts that the
site rules need; everything after it is columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.operators import stored
from pagelattice.plans.messages import with_messages
from pagelattice.plans.rules import CATEGORIES, NAMES, SCORES, Rule, head_content, native, selected, site
from pagelattice.session import durable, small_side
from pagelattice.sources.dom import Page, split_url, tidy

#: Pages handled together in a task: bounds the worker's memory.
CHUNK = 256

FACTS = (
    "facts struct<origin string, title_key string, description_key string, description_chars int, text_key string,"
    " text_chars int, canonical string, noindex boolean, links array<struct<href string, internal boolean>>,"
    " images array<string>, scripts array<string>, words string>"
)
_FACTS_TYPE = pa.struct(
    [
        *[(n, pa.string()) for n in ("origin", "title_key", "description_key")],
        ("description_chars", pa.int32()),
        ("text_key", pa.string()),
        ("text_chars", pa.int32()),
        ("canonical", pa.string()),
        ("noindex", pa.bool_()),
        ("links", pa.list_(pa.struct([("href", pa.string()), ("internal", pa.bool_())]))),
        ("images", pa.list_(pa.string())),
        ("scripts", pa.list_(pa.string())),
        ("words", pa.string()),
    ]
)


def words(text: str) -> str:
    """The words of the whole text, ASCII letters and digits only, parted by one blank: what near copies are told by."""
    return " ".join(re.sub(r"[^a-z0-9\s]", "", text.lower()).split())


def _facts(p: Page, near: bool) -> dict:
    text = p.body_text
    scripts = [u for e in p.q("script") if e.get("src") and (u := split_url(p.resolve(e.get("src")) or "")) and u[1] == p.at[1]]
    return {
        "origin": f"{p.at[0]}://{p.at[1]}",
        "title_key": tidy(p.title).lower() or None,
        "description_key": tidy(p.description or "").lower() or None,
        "description_chars": len(p.description or ""),
        "text_key": hashlib.md5(text.encode("utf-8", "replace")).hexdigest() if text else None,
        "text_chars": len(text),
        "canonical": p.canonical_url,
        "noindex": head_content.noindex(p),
        "links": [{"href": l["href"], "internal": l["internal"]} for l in p.links],
        "images": [i["src"] for i in p.images],
        "scripts": [u[2] for u in scripts],
        "words": words(text) if near else None,
    }


def prepare(pages: DataFrame) -> DataFrame:
    """The engine's page columns from the stored pages table; negative timings mean not measured.

    Failed fetches (no html) are left out, as they are from every score.
    """
    ms = F.when(F.col("load_time_ms") >= 0, F.col("load_time_ms"))
    vital = {c: F.when(F.col(f"cwv_{c}") >= 0, F.col(f"cwv_{c}")).alias(c) for c in ("lcp", "cls", "inp", "fcp", "ttfb")}
    return pages.where("html is not null").select(
        F.col("crawl_id").cast("bigint").alias("audit_id"),
        F.col("id").cast("bigint").alias("page_id"),
        F.col("id").cast("bigint").alias("ord"),
        "url",
        "html",
        F.col("status_code").cast("int").alias("status"),
        ms.alias("ms"),
        *vital.values(),
        F.transform_keys(
            F.coalesce(F.from_json("headers_json", "map<string,string>"), F.create_map().cast("map<string,string>")),
            lambda k, _: F.lower(k),
        ).alias("headers"),
        F.lit(None).cast("string").alias("rendered_html"),
        F.array().cast("array<struct<url string, status int>>").alias("redirect_chain"),
    )


def page_pass(pages: DataFrame, rules: list[Rule], near: bool = True) -> DataFrame:
    """(audit_id, page_id, ord, url, codes, scores, facts): one row per page, a status letter per DOM rule.

    A rule that raises fails with score 0. Scores is null where every rule has
    its status' own score.
    """
    todo = [(r.id, r.run) for r in rules if r.kind == "dom"]
    cols = ["audit_id", "page_id", "ord", "url", "html", "status", "headers", "rendered_html", "redirect_chain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                codes, scores, facts = [], [], []
                given = [batch.column(i).to_pylist() for i in range(3, 9)]
                for url, html, status, headers, rendered, chain in zip(*given):
                    chain = [(c["url"] or "", c["status"]) for c in chain or ()]
                    p = Page(url, html, dict(headers or ()), status, rendered, chain)
                    letters, own = [], {}
                    for i, (_, rule) in enumerate(todo):
                        try:
                            got = rule(p)
                        except Exception:  # noqa: BLE001 - a rule that raises is a failed rule
                            got = "F"
                        if isinstance(got, tuple):
                            own[i] = got[1]
                            got = got[0]
                        letters.append(got)
                    codes.append("".join(letters))
                    scores.append([own.get(i, SCORES[c]) for i, c in enumerate(letters)] if own else None)
                    facts.append(_facts(p, near))
                yield pa.record_batch(
                    [
                        *batch.columns[:4],
                        pa.array(codes, pa.string()),
                        pa.array(scores, pa.list_(pa.int32())),
                        pa.array(facts, _FACTS_TYPE),
                    ],
                    names=["audit_id", "page_id", "ord", "url", "codes", "scores", "facts"],
                )

    return pages.select(*cols).mapInArrow(
        run, f"audit_id bigint, page_id bigint, ord bigint, url string, codes string, scores array<int>, {FACTS}"
    )


def _score(status: Column) -> Column:
    return F.when(status == "P", 100).when(status == "W", 50).otherwise(0).cast("int")


def dom_results(parsed: DataFrame, rules: list[Rule], categories: bool = False) -> DataFrame:
    """The page pass' letters as rows, with category_id if asked for."""
    todo = [r for r in rules if r.kind == "dom"]
    if not todo:
        return parsed.sparkSession.createDataFrame([], site.OUT + ", category_id string" * categories)
    named = parsed.select(
        "audit_id", "page_id", "scores", F.posexplode(F.split("codes", "")).alias("i", "status")
    ).where("status <> ''")
    score = F.coalesce(F.get("scores", F.col("i")), _score(F.col("status")))

    def of(values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("i") + 1)

    return named.select(
        "audit_id",
        "page_id",
        of([r.id for r in todo]).alias("rule_id"),
        "status",
        score.cast("int").alias("score"),
        *[of([r.category for r in todo]).alias("category_id")] * categories,
    )


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds the path and query that native rules read."""
    return pages.withColumn("path", F.expr(native.render(native.PATH, native.SPARK))).withColumn(
        "query", F.expr(native.render(native.QUERY, native.SPARK))
    )


def native_results(pages: DataFrame, rules: list[Rule], categories: bool = False) -> DataFrame:
    """Rules as Catalyst expressions in one projection, unpivoted; with category_id if asked for."""
    todo = [r for r in rules if r.kind == "native"]
    if not todo:
        return pages.sparkSession.createDataFrame([], site.OUT + ", category_id string" * categories)
    made = with_parts(pages).select(
        "audit_id",
        "page_id",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(r.id).alias("rule_id"),
                        F.expr(native.render(r.run, native.SPARK)).alias("status"),
                        *[F.lit(r.category).alias("category_id")] * categories,
                    )
                    for r in todo
                )
            )
        ).alias("x"),
    )
    return made.select("audit_id", "page_id", "x.rule_id", "x.status", _score(F.col("x.status")).alias("score"), *["x.category_id"] * categories)


def category_column(rules: list[Rule]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for r in rules for x in (r.id, r.category))), F.col("rule_id"))


def points(status: Column) -> Column:
    return F.when(status == "P", 100).when(status == "W", 50).otherwise(0)


def category_scores(results: DataFrame, *by: str) -> DataFrame:
    """(by, category_id, score, passed, warned, failed): status points weighted by each result's own score, 0 counting as 1."""
    w = F.when(F.col("score") > 0, F.col("score")).otherwise(1)
    return results.groupBy(*by, "category_id").agg(
        F.round(F.sum(points(F.col("status")) * w) / F.sum(w)).cast("int").alias("score"),
        F.count_if(F.col("status") == "P").alias("passed"),
        F.count_if(F.col("status") == "W").alias("warned"),
        F.count_if(F.col("status") == "F").alias("failed"),
    )


def overall_scores(categories: DataFrame, *by: str) -> DataFrame:
    """(by, overall_score): category scores weighted by the categories' weights; unknown and weightless ones are left out."""
    weight = F.element_at(F.create_map(*(F.lit(x) for k, (_, n) in CATEGORIES.items() for x in (k, n))), F.col("category_id"))
    weighed = categories.withColumn("weight", F.coalesce(weight, F.lit(0))).where("weight > 0")
    return weighed.groupBy(*by).agg(
        F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).cast("int").alias("overall_score")
    )


@dataclass
class AuditFrames:
    """An audit's tables."""

    results: DataFrame
    categories: DataFrame
    page_categories: DataFrame
    overall: DataFrame
    parsed: DataFrame


@dataclass
class Auditor:
    """Audits pages with the chosen rules: Auditor(spark, categories=["core"]).audit(prepare(pages))."""

    spark: object = None
    categories: tuple = ()
    enable: tuple = ()
    disable: tuple = ()
    rules: list[Rule] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rules = self.rules or selected(self.categories, self.enable, self.disable)

    def audit(
        self,
        pages: DataFrame,
        sites: DataFrame | None = None,
        probe: DataFrame | None = None,
        redirects: DataFrame | None = None,
    ) -> AuditFrames:
        """Rules whose tables are not given are not evaluated. The parsed pages are written to the shared folder once."""
        ids = {r.id for r in self.rules}
        near = "content-duplicate-near" in ids
        parsed = durable(page_pass(pages, self.rules, near), "zstd")
        parts = [dom_results(parsed, self.rules, True), native_results(pages, self.rules, True)]
        across = site.first_seen(parsed)
        if near:
            across.append(site.near_duplicates(parsed))
        if sites is not None:
            across += [site.site_rules(parsed, sites), site.robots_page_rules(parsed, sites), *site.sitemap_rules(parsed, sites)]
        if probe is not None and redirects is not None:
            across += site.link_rules(parsed, probe, redirects, most=None)
        # A map is searched entry by entry: only the few rules over pages together are looked up in one.
        parts += [x.where(F.col("rule_id").isin(*ids)).withColumn("category_id", category_column(self.rules)) for x in across]
        results = parts[0]
        for part in parts[1:]:
            results = results.unionByName(part)
        categories = category_scores(results, "audit_id")
        return AuditFrames(
            results,
            categories,
            category_scores(results, "audit_id", "page_id"),
            overall_scores(categories, "audit_id"),
            parsed,
        )


#: Rules over one measured value: the page column that holds it, given as their detail.
MEASURED = {
    "cwv-lcp": "lcp", "cwv-cls": "cls", "cwv-inp": "inp", "cwv-fcp": "fcp", "cwv-ttfb": "ttfb", "technical-timeout": "ms", "perf-response-time": "ms",
    "technical-server-error": "status", "technical-4xx-non-404": "status", "redirect-type": "status",
}


def as_stored(frames: AuditFrames, pages: DataFrame) -> DataFrame:
    """The results in the columns of the stored table: names, messages, page urls, statuses in words, and details.

    details_json holds the measured value where a rule looks at one, and the
    page facts behind rules on titles, descriptions and texts; else it is null.
    """
    measured = pages.select("audit_id", "page_id", "url", F.to_json(F.struct(*sorted(set(MEASURED.values())))).alias("measures"))
    facts = frames.parsed.select(
        "audit_id", "page_id",
        F.to_json(F.struct("facts.description_chars", "facts.text_chars", "facts.canonical", F.size("facts.links").alias("links"))).alias("facts"),
    )
    column = F.element_at(F.create_map(*(F.lit(x) for kv in MEASURED.items() for x in kv)), F.col("rule_id"))
    about = F.col("category_id").isin("core", "content", "links")
    value = F.call_function("get_json_object", F.col("measures"), F.concat(F.lit("$."), column))
    details = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("value")))).when(about, F.col("facts"))
    return (
        with_messages(frames.results)
        .join(measured, ["audit_id", "page_id"])
        .join(facts, ["audit_id", "page_id"])
        .select(
            "audit_id", "category_id", "rule_id", "rule_name", F.col("url").alias("page_url"),
            status_name(F.col("status")).alias("status"), "score", "message", details.alias("details_json"),
        )
    )


def made_issues(frames: AuditFrames, pages: DataFrame) -> DataFrame:
    """Issues of live results, as make_issues(as_stored(frames, pages)) gives them.

    A rule's verdicts are counted where they arise; only pages whose address an earlier page of the audit has,
    or that have none, take part with their address, so results do not move.
    """
    at = pages.where("audit_id is not null").select("audit_id", "page_id", "url")
    again = at.groupBy("audit_id", "url").agg(F.min("page_id").alias("same"), F.count(F.lit(1)).alias("n")).where("n > 1 and url is not null")
    special = at.join(again, ["audit_id", "url"]).select("audit_id", "page_id", "same").unionAll(
        at.where("url is null").select("audit_id", "page_id", F.lit(None).cast("bigint"))
    )
    special = durable(special.withColumn("shared", F.lit(True)))
    bad = frames.results.where("audit_id is not null and status in ('F', 'W')").join(small_side(special), ["audit_id", "page_id"], "left")
    by = ["audit_id", "rule_id", "category_id", "status"]
    per_page = bad.groupBy(*by, "shared", "same").agg(F.count(F.lit(1)).alias("n"))
    affected = F.when(F.col("shared").isNull(), F.col("n")).when(F.col("same").isNotNull(), 1).otherwise(0)
    grouped = with_messages(per_page.groupBy(*by).agg(F.sum(affected).alias("affected_pages")))
    return stored.issue_rows(grouped.withColumn("status", status_name(F.col("status"))))


def status_name(status: Column) -> Column:
    """pass, warn or fail."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), status)
