"""The main content of pages, by the recurrent block labeller."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm import page_facts, residue, stuffing
from pagelattice.llm.chunk import Chunk
from pagelattice.llm.page_facts import Extra
from pagelattice.llm.parsed import parse
from pagelattice.session import durable, small_side


def content_pages(pages: DataFrame, links: DataFrame, extra: Extra) -> DataFrame:
    """(page_id, extra's columns) of pages with html that are neither residue nor spam.

    Labels and facts come from one pass; the few pages that turn out to be no
    content are taken out afterwards.
    """
    parsed = parse(pages)
    facts = page_facts.page_facts(parsed, page_facts.site_support(parsed), extra)
    broken = durable(residue.find(facts).select("page_id"))
    out = durable(broken.unionAll(stuffing.stuffed_pages(facts, links, broken).select("page_id")))
    names = [x.split()[0] for x in extra.fields.split(", ")]
    return facts.select("page_id", *names).join(small_side(out), "page_id", "left_anti")


def main_of(chunk: Chunk, main: np.ndarray) -> list[list[str]]:
    """The main lines of each page of a chunk."""
    out: list[list[str]] = [[] for _ in chunk.pages]
    for i in np.flatnonzero(main).tolist():
        out[chunk.page[i]].append(chunk.texts[i])
    return out


def _hashes(chunk: Chunk, main: np.ndarray) -> list[pa.Array]:
    def of(line: str) -> bytes:
        return hashlib.sha256(line.encode("utf-8", "surrogatepass")).digest()[:8]

    return [pa.array([[of(line) for line in dict.fromkeys(m)] for m in main_of(chunk, main)], pa.list_(pa.binary()))]


def main_line_hashes(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, line_hash) of the distinct main lines of every content page.

    A page without main lines, without text or without html has no rows; rows
    stored twice are two pages.
    """
    got = content_pages(pages, links, Extra("hashes array<binary>", _hashes))
    return got.select("page_id", F.explode("hashes").alias("h")).select("page_id", F.lower(F.hex("h")).alias("line_hash"))


def _texts(chunk: Chunk, main: np.ndarray) -> list[pa.Array]:
    return [pa.array(["\n".join(m) for m in main_of(chunk, main)], pa.string())]


def main_texts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, text): the main lines of every content page, in page order."""
    return content_pages(pages, links, Extra("text string", _texts))
