"""Rules over sites, probes and all pages of an audit, as DataFrame operators.

Inputs: `parsed`, the page pass' rows (audit_id, page_id, ord, url, facts);
`sites` (origin, robots_status, robots, sitemap_status, sitemap, and the
statuses of probed variants); `probe` (url, status_code); `redirects` (src,
dst, status_code). Links and images are exploded once and joined by url, so
Spark shuffles urls, never documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.plans.rules import near_sets
from pagelattice.plans.rules.registry import define
from pagelattice.session import durable, small_side
from pagelattice.sources import robots as R
from pagelattice.sources.dom import split_url

OUT = "audit_id bigint, page_id bigint, rule_id string, status string, score int"

for _id, _weight in {
    "core-title-unique": 5, "content-duplicate-description": 5, "content-duplicate-exact": 8, "content-duplicate-near": 7,
    "crawl-sitemap-orphan-urls": 7, "links-broken-internal": 1, "links-external-valid": 1, "links-redirect-chains": 1,
    "images-broken": 15, "crawl-canonical-redirect": 15, "crawl-noindex-in-sitemap": 15, "crawl-indexability-conflict": 15,
    "js-blocked-resources": 7, "technical-robots-txt-exists": 1, "technical-robots-txt-valid": 1, "technical-sitemap-exists": 1,
    "technical-sitemap-valid": 1, "technical-www-redirect": 1, "technical-404-page": 1, "security-https-redirect": 8,
    "crawl-sitemap-domain": 15, "crawl-sitemap-url-limit": 6, "crawl-sitemap-size-limit": 5, "crawl-sitemap-duplicate-urls": 6,
    "crawl-blocked-resources": 7, "crawl-crawl-delay": 5, "crawl-sitemap-in-robotstxt": 6, "geo-ai-bot-access": 20,
}.items():
    define(_id, _weight, "site", f"site:{_id}")


def _row(rule_id: str, status) -> list:
    score = F.when(status == "P", 100).when(status == "W", 50).otherwise(0)
    return ["audit_id", "page_id", F.lit(rule_id).alias("rule_id"), status.alias("status"), score.cast("int").alias("score")]


def _first(df: DataFrame, *by: str) -> DataFrame:
    """Adds `first`: whether a row is its group's first in crawl order (ord, page_id).

    The group's first row is an aggregate joined back, not a window: a value
    that a third of all pages share is combined before it moves, and the skewed
    side of the join is split.
    """
    firsts = df.groupBy(*by).agg(F.min(F.struct("ord", "page_id"))["page_id"].alias("first_page"))
    return df.join(firsts, list(by)).withColumn("first", F.col("page_id") == F.col("first_page")).drop("first_page")


def first_seen(parsed: DataFrame) -> list[DataFrame]:
    """Titles, descriptions and texts: the first page of an audit that has one passes, later ones do not.

    Pages are taken in crawl order (ord, page_id).
    """
    f = F.col("facts")
    base = parsed.select("audit_id", "page_id", "ord", *(f[x].alias(x) for x in ("title_key", "description_key", "text_key", "text_chars", "description_chars")))

    def rule(rule_id: str, key: str, empty, short, again: str) -> DataFrame:
        counted = _first(base.where(F.col(key).isNotNull() & F.col("audit_id").isNotNull() & ~short), "audit_id", key)
        plain = base.where(F.col(key).isNull() | F.col("audit_id").isNull() | short)
        status = F.when(F.col("first"), "P").otherwise(again)
        return counted.select(*_row(rule_id, status)).unionAll(plain.select(*_row(rule_id, empty)))

    never = F.lit(False)
    return [
        rule("core-title-unique", "title_key", F.lit("F"), never, "W"),
        rule(
            "content-duplicate-description",
            "description_key",
            F.when(F.col("description_key").isNull(), "F").otherwise("W"),
            F.coalesce(F.col("description_chars") < 50, F.lit(False)),
            "W",
        ),
        rule("content-duplicate-exact", "text_key", F.lit("P"), F.coalesce(F.col("text_chars") < 50, F.lit(False)), "F"),
    ]


#: Bytes of text up to which an audit's pages are compared in one task, and of a block where they are not.
WHOLE, BLOCK = 24 << 20, 12 << 20
#: Bytes of pages that are packed together.
PACK = 32 << 20


def _packed(pages: DataFrame, whole: int, block: int) -> DataFrame:
    """(audit_id, a, b, side, pages, texts, bytes): pages of an audit, compressed together, for each pair of blocks a <= b that holds them.

    The texts of a site have much in common and shrink to a sixth or less; single ones do not.
    """
    sizes = pages.groupBy("audit_id").agg(F.sum(F.octet_length("words")).alias("n")).where(F.col("n") > whole)
    blocks = {r.audit_id: -(-r.n // block) for r in sizes.collect()}  # a row per audit of more than `whole` bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, size = pa.Codec("zstd", 3), [], 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            audit, page = t["audit_id"].to_numpy(), t["page_id"].to_numpy()
            parts = np.array([blocks.get(x, 1) for x in audit.tolist()], np.uint64)
            at = (near_sets.mix(page.astype(np.uint64)) % parts).astype(np.int64)
            order = np.lexsort((page, at, audit))
            t, audit, at = t.take(pa.array(order)), audit[order], at[order]
            ends = np.flatnonzero(np.r_[(np.diff(audit) != 0) | (np.diff(at) != 0), True]) + 1
            rows = []
            for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                part = t.slice(i, j - i)
                x, own = int(audit[i]), int(at[i])
                numbers = np.concatenate([part[c].to_numpy() for c in ("page_id", "ord", "chars")]).astype(np.int64).tobytes()
                text = "\n".join(part["words"].to_pylist()).encode()
                number_blob, text_blob = codec.compress(numbers, asbytes=True), codec.compress(text, asbytes=True)
                for b in range(blocks.get(x, 1)):
                    rows.append((x, min(own, b), max(own, b), int(own > b), j - i, number_blob, text_blob, len(text)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["audit_id", "a", "b", "side", "n", "pages", "texts", "bytes"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > PACK:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return pages.mapInArrow(run, "audit_id bigint, a int, b int, side int, n int, pages binary, texts binary, bytes bigint")


def near_duplicates(parsed: DataFrame, low: float = 0.6, high: float = 0.8, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """The largest word-trigram Jaccard similarity to an earlier page of the audit: over 0.8 fails, over 0.6 warns.

    Exact. The pages of an audit meet in one task, those of a large audit block by block in pairs of blocks; what
    travels is packed text, not trigrams, and neither candidates nor pairs leave their task (`near_sets`). An audit
    of k blocks is sent k times.
    """
    p = parsed.select("audit_id", "page_id", "ord", F.coalesce("facts.text_chars", F.lit(0)).alias("chars"), F.col("facts.words").alias("words"))
    known = p.where("audit_id is not null").withColumns(
        {"ord": F.coalesce("ord", F.lit(-(2**63))), "words": F.coalesce("words", F.lit(""))}
    )

    def judge(cell: pa.Table) -> pa.Table:
        codec, pages, texts = pa.Codec("zstd"), [], []
        for n, number_blob, text_blob, size in zip(*(cell[c].to_pylist() for c in ("n", "pages", "texts", "bytes"))):
            pages.append(np.frombuffer(codec.decompress(number_blob, n * 24, asbytes=True), np.int64).reshape(3, n))
            texts.append(pa.array(codec.decompress(text_blob, size, asbytes=True).decode().split("\n"), pa.large_string()))
        side = np.repeat(cell["side"].to_numpy(), [x.shape[1] for x in pages])
        page, order, chars = np.concatenate(pages, axis=1)
        place = np.empty(len(page), np.int64)
        place[np.lexsort((page, order))] = np.arange(len(page))
        level, size = near_sets.levels(place, side, pa.concat_arrays(texts), low, high)
        level[(chars < 100) | (size < 5)] = 0
        return pa.table({"audit_id": pa.array(np.repeat(cell["audit_id"][0].as_py(), len(page))), "page_id": pa.array(page), "level": pa.array(level, pa.int32())})

    cells = _packed(known, whole, block).groupBy("audit_id", "a", "b")
    judged = cells.applyInArrow(judge, "audit_id bigint, page_id bigint, level int").groupBy("audit_id", "page_id").agg(F.max("level").alias("level"))
    status = F.when(F.col("level") == 2, "F").when(F.col("level") == 1, "W").otherwise("P")
    none = p.where("audit_id is null").select(*_row("content-duplicate-near", F.lit("P")))
    return judged.select(*_row("content-duplicate-near", status)).unionAll(none)


def link_rules(parsed: DataFrame, probe: DataFrame, redirects: DataFrame, most: int | None = 20) -> list[DataFrame]:
    """Links, images and canonicals against probed statuses and redirects.

    With `most` None every address of a page counts, as in an audit. Else only its first `most` external links and
    images, and for redirect chains its first `most` internal addresses: `link_checks`, whose SQL has this limit for links.
    A status of 0 is a failure; an address without a row was not probed and is not held against a page.
    Only addresses that failed or redirect change a verdict, so these alone are looked up; where they fit a
    broadcast, no address moves, else each one that a page asks about moves once.
    """
    status = probe.groupBy("url").agg(F.max_by("status_code", "checked_at").alias("code")).where("code = 0 or code >= 400")
    told = small_side(durable(status.join(redirect_hops(redirects), "url", "full")))

    def asked(column: Column, kind: str) -> Column:
        """An entry per distinct address; early: among those looked at for redirect chains."""
        made = F.transform(
            F.array_distinct(column),
            lambda u, i: F.struct(F.lit(kind).alias("kind"), (F.lit(True) if most is None else i < most).alias("early"), u.alias("url")),
        )
        return F.coalesce(made, F.array().cast("array<struct<kind:string,early:boolean,url:string>>"))

    def cut(column: Column) -> Column:
        return column if most is None else F.slice(column, 1, most)

    links, images = F.col("facts.links"), F.col("facts.images")
    inner, outer = F.filter(links, lambda l: l["internal"])["href"], cut(F.filter(links, lambda l: ~l["internal"]))["href"]
    each = F.concat(asked(inner, "inner"), asked(outer, "outer"), asked(cut(images), "image"))
    code, kind = F.col("code"), F.col("kind")
    hit = (
        parsed.select("audit_id", "page_id", F.explode(each).alias("x")).select("audit_id", "page_id", "x.*").join(told, "url")
        .groupBy("audit_id", "page_id").agg(
            F.max((kind == "inner") & ((code == 404) | (code >= 500) | (code == 0))).alias("inner"),
            F.max((kind == "outer") & ((code == 0) | (code >= 400))).alias("outer"),
            F.max((kind == "image") & code.isin(404, 410)).alias("image"),
            F.max(F.when((kind == "inner") & F.col("early"), F.col("hops"))).alias("h"),
        )
    )
    verdicts = {
        "links-broken-internal": F.when(F.col("inner"), "F").otherwise("P"),
        "links-external-valid": F.when(F.col("outer"), "W").otherwise("P"),
        "images-broken": F.when(F.col("image"), "F").otherwise("P"),
        "links-redirect-chains": F.when(F.col("h") >= 3, "F").when(F.col("h") >= 1, "W").otherwise("P"),
    }
    page = parsed.select("audit_id", "page_id").join(hit, ["audit_id", "page_id"], "left")
    judged = page.select("audit_id", "page_id", F.explode(F.create_map(*(x for k, v in verdicts.items() for x in (F.lit(k), v)))).alias("rule_id", "status"))
    score = F.when(F.col("status") == "P", 100).when(F.col("status") == "W", 50).otherwise(0).cast("int")
    canon = parsed.select("audit_id", "page_id", F.col("facts.canonical").alias("url")).join(told, "url", "left")
    canon_status = (
        F.when(F.col("url").isNull(), "W")
        .when(F.coalesce("hops", F.lit(0)) > 2, "F")
        .when(F.coalesce("code", F.lit(0)) >= 400, "F")
        .when(F.coalesce("hops", F.lit(0)) > 0, "W")
        .when(F.col("code") == 0, "W")
        .otherwise("P")
    )
    return [judged.withColumn("score", score), canon.select(*_row("crawl-canonical-redirect", canon_status))]


def redirect_hops(redirects: DataFrame, most: int = 5) -> DataFrame:
    """(url, hops): redirects followed from each source, at most `most`."""
    step = redirects.select("src", "dst").dropDuplicates(["src"])
    reach = step.select(F.col("src").alias("url"), F.col("dst").alias("now"), F.lit(1).alias("hops"))
    out = reach
    for n in range(2, most + 1):
        reach = reach.join(step.withColumnRenamed("src", "now"), "now").select("url", F.col("dst").alias("now"), F.lit(n).alias("hops"))
        out = out.unionAll(reach)
    return out.groupBy("url").agg(F.max("hops").alias("hops"))


def sitemap_urls(sites: DataFrame) -> DataFrame:
    """(origin, url): the locations that each site's sitemap lists."""
    return sites.select(
        "origin", F.explode(F.regexp_extract_all("sitemap", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url")
    )


def _bare(c):
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/$", "")


def sitemap_rules(parsed: DataFrame, sites: DataFrame) -> list[DataFrame]:
    """Sitemap membership (semi join) and orphans (anti join)."""
    listed = sitemap_urls(sites).select("origin", _bare(F.col("url")).alias("bare")).distinct()
    pages = parsed.select("audit_id", "page_id", F.col("facts.origin").alias("origin"), _bare(F.col("url")).alias("bare"), F.col("facts.noindex").alias("noindex"))
    have = sites.select("origin", F.lit(True).alias("site"), (F.length("sitemap") > 0).alias("has_map"))
    inside = pages.where("noindex").join(listed, ["origin", "bare"], "left_semi").select("audit_id", "page_id", F.lit(True).alias("hit"))
    member = pages.join(have, "origin", "left").join(inside, ["audit_id", "page_id"], "left")
    status = F.when(~F.col("noindex"), "P").when(~F.coalesce("has_map", F.lit(False)), "W").when(F.col("hit"), "F").otherwise("P")
    seen = (
        parsed.select("audit_id", "url").unionAll(
            parsed.select("audit_id", F.explode("facts.links").alias("l")).where("l.internal").select("audit_id", "l.href")
        )
        .select("audit_id", _bare(F.col("url")).alias("bare")).distinct()
    )
    audits = pages.select("audit_id", "origin").distinct()
    orphans = audits.join(listed, "origin").join(seen, ["audit_id", "bare"], "left_anti").select("audit_id", "origin").distinct().withColumn("orphan", F.lit(True))
    left = pages.join(orphans, ["audit_id", "origin"], "left")
    return [
        member.select(*_row("crawl-noindex-in-sitemap", status)),
        left.select(*_row("crawl-sitemap-orphan-urls", F.when(F.col("orphan"), "W").otherwise("P"))),
    ]


def _site_status(s) -> dict[str, str]:
    """Statuses that depend on the site alone."""
    robots, sitemap = s.robots or "", s.sitemap or ""
    host = (split_url(s.origin) or ("", "", "", "", ""))[1]
    named = R.sitemaps_named(robots)
    urls = R.locations(sitemap)
    hosts = {host, host[4:] if host.startswith("www.") else "www." + host}
    foreign = sum((split_url(u) or ("", "?"))[1] not in hosts for u in urls)
    norm = [u.rstrip("/").lower() for u in urls]
    n = len(re.findall(r"<url[\s>]", sitemap, re.I))
    size = len(sitemap.encode("utf-8", "replace"))
    found = R.problems(robots)
    broken = R.sitemap_problems(sitemap) if sitemap else []
    disallow = [v for k, v in R.rules_for(robots, {"*", "googlebot", "bingbot"}) if k == "disallow"]
    # Folders and files that pages need to be drawn.
    parts = ("/css/", "/js/", "/assets/", "/static/", "/wp-content/", "/wp-includes/", "/themes/", "/scripts/", "/styles/")
    hides = any(any(part.startswith(v.rstrip("*")) and len(v) > 1 or part in v for part in parts) or re.search(r"\.(?:css|js)\$?$", v) for v in disallow if v)
    delay = next((v for k, v in R.rules_for(robots, {"*", "googlebot", "bingbot"}) if k == "crawl-delay"), "0")
    delay = float(delay) if re.fullmatch(r"\d+(?:\.\d+)?", delay) else 0
    bots = R.ai_bots_blocked(robots)
    return {
        "technical-robots-txt-exists": "P" if s.robots_status == 200 else "F",
        "technical-robots-txt-valid": "W" if s.robots_status != 200 else "F" if "no user-agent" in found else "W" if found else "P",
        "technical-sitemap-exists": "P" if s.sitemap_status == 200 else "W" if named else "F",
        "technical-sitemap-valid": "W" if not sitemap else "P" if not broken else "W" if urls else "F",
        "crawl-sitemap-domain": "W" if not urls else "P" if not foreign else "F" if foreign > 0.1 * len(urls) else "W",
        "crawl-sitemap-url-limit": "F" if n > 50_000 else "W" if n > 40_000 else "P",
        "crawl-sitemap-size-limit": "F" if size > 50 << 20 else "W" if size > 40 << 20 else "P",
        "crawl-sitemap-duplicate-urls": "W" if len(set(norm)) < len(norm) else "P",
        "crawl-blocked-resources": "W" if hides else "P",
        "crawl-crawl-delay": "W" if delay > 10 else "P",
        "crawl-sitemap-in-robotstxt": "P" if named else "W",
        "geo-ai-bot-access": "P" if not bots else "F" if bots == len(R.AI_BOTS) else "W",
        "technical-404-page": _not_found(s),
        "security-https-redirect": _https(s),
        "technical-www-redirect": "P" if not (s.www_status and s.bare_status) or s.variants_redirect else "F" if s.www_status == s.bare_status == 200 else "W",
    }


def _not_found(s) -> str:
    code, body = s.missing_status, (s.missing_body or "").lower()
    if not code or code == 200:
        return "F"
    if code not in (404, 410):
        return "W"
    helps = sum(w in body for w in ("nav", "menu", "search", "home", "go back", "sorry", "oops", "looking for", "help", "contact"))
    return "P" if "<nav" in body or len(body) > 500 or helps >= 3 else "W" if helps else "F"


def _https(s) -> str:
    if s.http_status and 300 <= s.http_status < 400 and s.http_location:
        return "P" if s.http_location.lower().startswith("https:") else "F"
    return "F" if s.http_status == 200 else "W"


def site_rules(parsed: DataFrame, sites: DataFrame) -> DataFrame:
    """Site statuses, worked out once per site and joined to its pages by origin."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            rows = [(s.origin, k, v) for s in part.itertuples() for k, v in _site_status(s).items()]
            yield pd.DataFrame(rows, columns=["origin", "rule_id", "status"])

    judged = sites.mapInPandas(run, "origin string, rule_id string, status string")
    pages = parsed.select("audit_id", "page_id", F.col("facts.origin").alias("origin"))
    score = F.when(F.col("status") == "P", 100).when(F.col("status") == "W", 50).otherwise(0).cast("int")
    return pages.join(judged, "origin").select("audit_id", "page_id", "rule_id", "status", score.alias("score"))


def robots_page_rules(parsed: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages and their scripts against the site's robots rules; sites without rules block nothing and need no Python."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for a, page, text, url, scripts in zip(part.audit_id, part.page_id, part.robots, part.url, part.scripts):
                u = split_url(url or "")
                path = (u[2] + ("?" + u[3] if u[3] else "")) if u else "/"
                shut = R.blocked(text, path, {"*", "googlebot"})
                js = any(R.blocked(text, x, {"*"}) for x in (scripts if scripts is not None else ()))
                rows += [(a, page, "crawl-indexability-conflict", "W" if shut else "P"), (a, page, "js-blocked-resources", "W" if js else "P")]
            out = pd.DataFrame(rows, columns=["audit_id", "page_id", "rule_id", "status"])
            yield out.assign(score=out.status.map({"P": 100, "W": 50}).astype("int32"))

    ruled = sites.where("robots is not null and trim(robots) <> ''").select("origin", "robots")
    pages = parsed.select("audit_id", "page_id", "url", F.col("facts.origin").alias("origin"), F.col("facts.scripts").alias("scripts"))
    free = pages.join(ruled, "origin", "left_anti")
    return (
        pages.join(ruled, "origin")
        .mapInPandas(run, OUT)
        .unionByName(free.select(*_row("crawl-indexability-conflict", F.lit("P"))))
        .unionByName(free.select(*_row("js-blocked-resources", F.lit("P"))))
    )
