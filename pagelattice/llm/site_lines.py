"""Lines repeated across one site's pages, as a weighted graph of consecutive lines.

One parse of the pages gives, per crawl, nodes (lines, weighted by the pages
that hold them) and edges (a line and the line after its first occurrence,
weighted by pages). A node's weight is the sum of its edges' weights, so one
record per distinct line and page carries both.

Records are combined per Arrow batch before the shuffle. Only 64-bit hashes are
shuffled; the text travels only from batches in which the line already reaches
the wanted share of that batch's pages of the crawl. A line with that share
overall reaches it in at least one batch, so no result misses its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.lines import lines
from pagelattice.session import durable, small_side

MIN_PAGES = 8
MIN_SHARE = 0.2
#: Pages parsed together: bounds the worker's memory.
CHUNK = 2000

_GRAPH = "crawl_id bigint, a bigint, b bigint, n bigint, line string"


def line_hash(text: str) -> int:
    """Signed 64-bit hash of a line; 0 is kept for "no line"."""
    h = xxhash.xxh3_64_intdigest(text)
    return (h - (1 << 64) if h >> 63 else h) or 1


def _combine(crawls: list[int], htmls: list[str], share: float) -> pa.RecordBatch:
    """Edges of some pages, added up per (crawl, line, next line)."""
    group, first, nxt, pages = [], [], [], {}
    texts: dict[int, str] = {}
    for crawl, html in zip(crawls, htmls):
        pages[crawl] = pages.get(crawl, 0) + 1
        seen: dict[int, int] = {}
        before = 0
        for line in lines(html):
            h = line_hash(line)
            if before and seen[before] == 0:
                seen[before] = h
            if h in seen:
                before = 0
            else:
                seen[h] = 0
                before = h
                texts[h] = line
        group += [crawl] * len(seen)
        first += seen.keys()
        nxt += seen.values()
    g, a, b = (np.array(x, dtype=np.int64) for x in (group, first, nxt))
    if len(g):
        order = np.lexsort((b, a, g))
        g, a, b = g[order], a[order], b[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, len(g)])
        g, a, b = g[at], a[at], b[at]
        node = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1])]
        node_of = np.cumsum(node) - 1
        total = np.bincount(node_of, weights=n)
        size = np.array([pages[x] for x in g[node].tolist()])
        wanted = (total >= share * size)[node_of] & node  # the text once per node
        text = [texts[h] if w else None for h, w in zip(a.tolist(), wanted.tolist())]
    else:
        n, text = np.zeros(0, np.int64), []
    extra = len(pages)
    return pa.record_batch(
        [
            pa.array(np.r_[g, np.fromiter(pages.keys(), np.int64, extra)]),
            pa.array(np.r_[a, np.zeros(extra, np.int64)]),
            pa.array(np.r_[b, np.zeros(extra, np.int64)]),
            pa.array(np.r_[n, np.fromiter(pages.values(), np.int64, extra)].astype(np.int64)),
            pa.array(text + [None] * extra, pa.string()),
        ],
        names=["crawl_id", "a", "b", "n", "line"],
    )


def line_graph(pages: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(crawl_id, a, support, line, edges) of lines on at least min_pages pages, and a = 0 with the crawl's pages.

    pages needs crawl_id and html; rows without either take no part. edges
    holds the followers of a line that stand behind it on min_pages pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crawls: list[int] = []
        htmls: list[str] = []
        for batch in batches:
            crawls += batch.column(0).to_pylist()
            htmls += batch.column(1).to_pylist()
            while len(htmls) >= CHUNK:
                yield _combine(crawls[:CHUNK], htmls[:CHUNK], min_share)
                del crawls[:CHUNK], htmls[:CHUNK]
        if htmls:
            yield _combine(crawls, htmls, min_share)

    parsed = (
        pages.where("crawl_id is not null and html is not null")
        .select(F.col("crawl_id").cast("bigint"), "html")
        .mapInArrow(run, _GRAPH)
    )
    # One shuffle by (crawl, line) serves both sums; the map side is combined already.
    return (
        parsed.repartition("crawl_id", "a")
        .groupBy("crawl_id", "a", "b")
        .agg(F.sum("n").alias("n"), F.max("line").alias("line"))
        .groupBy("crawl_id", "a")
        .agg(
            F.sum("n").alias("support"),
            F.max("line").alias("line"),
            F.collect_list(F.when((F.col("b") != 0) & (F.col("n") >= min_pages), F.struct("b", "n"))).alias("edges"),
        )
        .where((F.col("a") == 0) | (F.col("support") >= min_pages))
    )


def _blocks_of(crawl: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one crawl's kept graph; a block is named by its smallest line hash."""
    root = {a: a for a in crawl.a}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, ends in zip(crawl.a, crawl.ends):
        for b in ends:
            if b in root:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    block = [find(a) for a in crawl.a]
    return pd.DataFrame(
        {"crawl_id": crawl.crawl_id, "block_id": block, "line_key": crawl.a, "line": crawl.line, "pages": crawl.support}
    )


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(crawl_id, block_id, line_key, line, pages): the lines on at least min_pages pages and min_share of a crawl's pages.

    Nodes and edges of that weight stay; the components of what stays are the
    boilerplate blocks. A crawl keeps at most (mean lines of a page) / min_share
    nodes, which bounds the group that finds components. Null or blank html,
    rows without a crawl and empty tables give no rows; a line counts once per
    page row; rows stored twice count twice.
    """
    graph = durable(line_graph(pages, min_pages, min_share))
    sizes = graph.where("a = 0").select("crawl_id", F.col("support").alias("size"))
    need = F.greatest(F.lit(float(min_pages)), min_share * F.col("size"))
    kept = (
        graph.where("a <> 0")
        .join(small_side(sizes), "crawl_id")
        .where(F.col("support") >= need)
        .select(
            "crawl_id",
            "a",
            "support",
            "line",
            F.transform(F.filter("edges", lambda e: e["n"] >= need), lambda e: e["b"]).alias("ends"),
        )
    )
    return kept.groupBy("crawl_id").applyInPandas(
        _blocks_of, "crawl_id bigint, block_id bigint, line_key bigint, line string, pages bigint"
    )


def occurrences(blocks: list[int | None]) -> list[tuple[int, int, int]]:
    """(block, first line, line after the last) of each maximal run of lines of one block; None marks other lines."""
    out = []
    start = 0
    for i in range(1, len(blocks) + 1):
        if i == len(blocks) or blocks[i] != blocks[start]:
            if blocks[start] is not None:
                out.append((blocks[start], start, i))
            start = i
    return out


def without_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """(page_id, crawl_id, text, removed, occurrences): each page without the occurrences of its crawl's boilerplate blocks.

    An occurrence is a run of consecutive lines of one block, down to a single
    line of it. Pages without html give a null text; pages of unknown crawls
    keep all lines.
    """
    found = durable(
        repeated.groupBy("crawl_id").agg(F.collect_list(F.struct("line_key", "block_id")).alias("x")).select(
            "crawl_id", F.col("x.line_key").alias("keys"), F.col("x.block_id").alias("blocks")
        )
    )
    joined = (
        pages.select(F.col("id").alias("page_id"), F.col("crawl_id").cast("bigint").alias("crawl_id"), "html")
        .join(small_side(found), "crawl_id", "left")
        .select("page_id", "crawl_id", "html", "keys", "blocks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int | None, dict[int, int]] = {}
        for batch in batches:
            texts, removed, runs = [], [], []
            for i, (crawl, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if crawl not in tables:
                    if len(tables) > 64:
                        tables.clear()
                    tables[crawl] = dict(zip(batch.column(3)[i].as_py() or (), batch.column(4)[i].as_py() or ()))
                all_lines = lines(html)
                found = occurrences([tables[crawl].get(line_hash(x)) for x in all_lines])
                kept, at = [], 0
                for _, start, end in found:
                    kept += all_lines[at:start]
                    at = end
                kept += all_lines[at:]
                texts.append(None if html is None else "\n".join(kept))
                removed.append(len(all_lines) - len(kept))
                runs.append(len(found))
            yield pa.record_batch(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                names=["page_id", "crawl_id", "text", "removed", "occurrences"],
            )

    return joined.mapInArrow(run, "page_id bigint, crawl_id bigint, text string, removed bigint, occurrences bigint")
