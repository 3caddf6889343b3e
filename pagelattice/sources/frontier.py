"""The crawl frontier: breadth-first rounds over a link table, with url normalisation and filters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.session import discard, durable

# Query parameters dropped by default, by prefix; file types that are no pages.
DROP_PREFIXES = ("utm_", "gclid", "fbclid", "mc_", "_ga")
NO_PAGE = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar", ".gz", ".jpg", ".jpeg", ".png", ".gif",
    ".svg", ".webp", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".css", ".js", ".json", ".xml",
)


def glob_pattern(glob: str) -> str:
    """A path glob as an anchored regular expression: ** any path, * within a segment, ? one character."""
    tail = glob.endswith("/**")
    body = glob[:-3] if tail else glob
    out = []
    for part in re.split(r"(\*\*|\*|\?)", body):
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)))
    return "^" + "".join(out) + ("(?:/.*)?$" if tail else "$")


@dataclass
class UrlFilter:
    """Which urls are crawled, and under which name."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    drop: tuple[str, ...] = DROP_PREFIXES

    def should_crawl(self, url: str) -> bool:
        try:
            path = urlsplit(url).path or "/"
        except ValueError:
            return False
        if self.include and not any(re.match(glob_pattern(g), path) for g in self.include):
            return False
        return not any(re.match(glob_pattern(g), path) for g in self.exclude)

    def normalise(self, url: str) -> str:
        """Without fragment, unwanted parameters and final slash, parameters sorted; an unparsable url as it is."""
        try:
            u = urlsplit(url)
        except ValueError:
            return url
        if not u.scheme or not u.netloc:
            return url
        kept = []
        for part in filter(None, u.query.split("&")):
            name = part.partition("=")[0]
            if name in self.allow if self.allow else not name.startswith(self.drop):
                kept.append(part)
        path = u.path or "/"
        if path != "/" and path.endswith("/"):
            path = path.rstrip("/") or "/"
        return urlunsplit((u.scheme, u.netloc.lower(), path, "&".join(sorted(kept)), ""))


def crawl(links: DataFrame, start: list[str], max_pages: int = 100, rule: UrlFilter | None = None) -> DataFrame:
    """(url, depth, ord): pages reached from the start urls, breadth first, in a fixed order, max_pages at most.

    links is (url, href, pos): a page's internal followable links in order. A
    round joins the new frontier to the link table and drops what was seen by
    an anti join; its rows are written to the shared folder, so the plan does
    not grow. Order within a round: by the place of the link that found the url.
    """
    rule = rule or UrlFilter()
    spark = links.sparkSession

    def good(url: str) -> bool:
        return rule.should_crawl(url) and not urlsplit(url).path.lower().endswith(NO_PAGE)

    def edges_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.dropna(subset=["url", "href"])
            known = {u: rule.normalise(u) for u in {*part.url, *part.href}}  # each distinct url once
            out = pd.DataFrame({"src": part.url.map(known), "dst": part.href.map(known), "pos": part.pos})
            fit = {u: good(u) for u in set(out.dst)}
            yield out[out.dst.map(fit).astype(bool)]

    edges = durable(links.select("url", "href", F.col("pos").cast("bigint")).mapInPandas(edges_of, "src string, dst string, pos bigint"))
    first = list(dict.fromkeys(map(rule.normalise, start)))[:max_pages]
    seen = spark.createDataFrame([(u, 0, i) for i, u in enumerate(first)], "url string, depth int, ord bigint")
    frontier, n, depth = seen, len(first), 0
    parts = [frontier]
    while n < max_pages and not frontier.isEmpty():
        depth += 1
        found = (
            frontier.join(edges, F.col("url") == F.col("src"))
            .groupBy("dst")
            .agg(F.min(F.struct("ord", "pos")).alias("at"))
            .join(seen.select(F.col("url").alias("dst")), "dst", "left_anti")
            .orderBy("at.ord", "at.pos", "dst")
            .limit(max_pages - n)  # the crawl's page budget bounds what is numbered in one task
        )
        place = F.row_number().over(Window.orderBy("at.ord", "at.pos", "dst"))
        frontier = durable(
            found.select(
                F.col("dst").alias("url"), F.lit(depth).alias("depth"), (place + F.lit(n - 1)).cast("bigint").alias("ord")
            )
        )
        parts.append(frontier)
        last, seen = seen, durable(seen.unionAll(frontier))
        discard(last)
        n += frontier.count()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
