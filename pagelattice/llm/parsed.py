"""Pages parsed once: their lines in a durable table, from which every page operator of this subpackage works.

Html crosses to Python once. What comes back is compact: the lines' 64-bit
hashes, the lines' text, the distinct paths, and per line the number of its
path and its characters inside links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.lines import blocks
from pagelattice.llm.chunk import Line
from pagelattice.llm.site_lines import line_hash
from pagelattice.session import durable

#: Pages parsed together: bounds the worker's memory.
CHUNK = 1024
COLUMNS = "page_id bigint, crawl_id bigint, hashes array<bigint>, text string, paths string, place binary, linked binary"
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, texts, paths, place, linked = [], [], [], [], []
    for html in batch.column(2).to_pylist():
        page = blocks(html)
        table: dict[str, int] = {}
        at = [table.setdefault(p, len(table)) for _, p, _ in page]
        hashes.append([line_hash(t) for t, _, _ in page])
        texts.append("\n".join([t for t, _, _ in page]))
        paths.append("\n".join(table))
        place.append(np.array(at, np.uint32).tobytes())
        linked.append(np.array([n for _, _, n in page], np.uint32).tobytes())
    return pa.record_batch(
        [
            *batch.columns[:2],
            pa.array(hashes, pa.list_(pa.int64())),
            pa.array(texts, pa.string()),
            pa.array(paths, pa.string()),
            pa.array(place, pa.binary()),
            pa.array(linked, pa.binary()),
        ],
        names=NAMES,
    )


def parse(pages: DataFrame) -> DataFrame:
    """One durable row per page row with html, in COLUMNS; pages needs id, crawl_id and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                yield _pack(whole.slice(at, CHUNK))

    return durable(
        pages.where("html is not null")
        .select(F.col("id").cast("bigint").alias("page_id"), F.col("crawl_id").cast("bigint").alias("crawl_id"), "html")
        .mapInArrow(run, COLUMNS)
    )


def unpack(batch: pa.RecordBatch, first: int) -> tuple[list[list[int]], list[list[Line]]]:
    """(hashes, lines) of the pages of a batch whose columns from number `first` on are hashes ... linked."""
    hashes, texts, paths, place, linked = (batch.column(first + i).to_pylist() for i in range(5))
    pages = []
    for text, names, at, n in zip(texts, paths, place, linked):
        named = names.split("\n")
        found = text.split("\n") if text else []
        pages.append(
            [(t, named[i], k) for t, i, k in zip(found, np.frombuffer(at, np.uint32).tolist(), np.frombuffer(n, np.uint32).tolist())]
        )
    return hashes, pages


def line_counts(parsed: DataFrame) -> DataFrame:
    """(crawl_id, a, support): on how many pages of its crawl each line stands, a being its hash; a = 0 counts the pages.

    Added up per Arrow batch before the shuffle. Rows without a crawl take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crawl = batch.column(0).to_numpy()
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            a = lists.flatten().to_numpy()
            page = np.repeat(np.arange(len(crawl)), sizes)
            if len(a):  # a line counts once per page
                order = np.lexsort((a, page))
                a, page = a[order], page[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (page[1:] != page[:-1])]
                a, page = a[new], page[new]
            group, line = np.r_[crawl[page], crawl], np.r_[a, np.zeros(len(crawl), np.int64)]
            if not len(group):
                continue
            order = np.lexsort((line, group))
            group, line = group[order], line[order]
            at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (line[1:] != line[:-1])])
            n = np.diff(np.r_[at, len(group)])
            yield pa.record_batch([pa.array(group[at]), pa.array(line[at]), pa.array(n)], names=["crawl_id", "a", "n"])

    return (
        parsed.where("crawl_id is not null")
        .select("crawl_id", "hashes")
        .mapInArrow(run, "crawl_id bigint, a bigint, n bigint")
        .groupBy("crawl_id", "a")
        .agg(F.sum("n").alias("support"))
    )
