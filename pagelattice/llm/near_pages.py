"""Near-duplicate pages: MinHash LSH forest over main-content shingles, then exact verification.

Pages with equal shingle sets form one class; only one representative of each
class enters the forest, so a text copied over a third of all rows is one row.

Each tree of the forest labels a page with DEPTH min-hashes of its own; the
labels of a tree, sorted, are the paths of a prefix trie. All pages start at the
full depth. In each round the pages that share a prefix in some tree meet and
are verified on their exact sets, unless the counts of their runs in BINS bins
prove that they cannot be similar; then every page that is still searching
shortens its prefixes by one. How far is decided by the data: a page stops as
soon as the recall estimated from its own verified partners reaches RECALL. A
partner of similarity s is met at depth d with the chance 1 - (1 - s^d)^TREES,
so it stands for one over that chance; one more partner right at the threshold
is assumed, lest a page whose partners are all close stops too early. A page of
a dense group thus stops at a long prefix, and a page without partners goes down
to the depth at which the assumed one alone would be met.

Labels come from one permutation: the sorted run hashes of a page are cut into
as many bins as the forest has levels, the least hash of each bin is its value,
and empty bins borrow from others by fixed permutations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm import main_lines
from pagelattice.llm.chunk import Chunk, sort_parts
from pagelattice.llm.page_facts import Extra
from pagelattice.llm.shingles import finish, jaccard, runs, shingle_set
from pagelattice.session import discard, durable, small_side

#: Runs of so many words, the least similarity, and the least words of a page that takes part.
RUN, SIMILAR, LEAST_WORDS = 3, 0.7, 50
#: Trees, min-hashes of each, and the recall at which a page stops searching.
TREES, DEPTH, RECALL = 26, 6, 0.999
#: Bits of a min-hash below the root of a trie: unequal ones that agree only cost a verification.
BITS = 8
#: Bins in which the runs of a page are counted, for a bound on what two pages can share.
BINS = 128


def chance(similar: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair of this similarity shares a prefix of this depth in one of the trees."""
    return 1 - (1 - similar**depth) ** trees


def root_depth(similar: float = SIMILAR, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The depth at which a page without partners stops; 1 where even single hashes fall short of the recall."""
    while depth > 1 and chance(similar, depth, trees) < recall:
        depth -= 1
    return depth


@cache
def _donors(bins: int, attempt: int) -> np.ndarray:
    """Which bin each empty bin asks at this attempt; from `bins` attempts on, one bin after the other."""
    if attempt < bins:
        return np.random.default_rng([bins, attempt]).permutation(bins)
    return (np.arange(bins) + attempt) % bins


def signatures(runs_of: np.ndarray, page: np.ndarray, pages: int, bins: int) -> np.ndarray:
    """[pages, bins] min-hash values from distinct run hashes sorted within each page; pages without any get zeros."""
    high = (runs_of >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    cell = page * bins + high.astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])[: len(cell)]
    sig = np.zeros(pages * bins, np.uint64)
    full = np.zeros(pages * bins, bool)
    sig[cell[first]] = finish(runs_of[first] | np.uint64(1))
    full[cell[first]] = True
    sig, full = sig.reshape(pages, bins), full.reshape(pages, bins)
    todo = np.flatnonzero(full.any(1) & ~full.all(1))
    if len(todo):
        given, has = sig[todo], full[todo]
        got, open_ = given.copy(), ~has
        for attempt in range(2 * bins):
            donor = _donors(bins, attempt)
            use = open_ & has[:, donor]
            got[use] = given[:, donor][use]
            open_ &= ~use
            if not open_.any():
                break
        sig[todo] = got
    return sig


class Classes(NamedTuple):
    """members: (page_id, class_id) of all eligible pages; pairs: (a, b, similarity) of class ids, a < b."""

    members: DataFrame
    pairs: DataFrame


def _labels(trees: int, depth: int, root: int) -> Extra:
    """Makes class key, roots, tails, run counts and text of eligible pages from their main lines; nulls for others.

    A root is the hash of a tree's number and its first `root` min-hashes; a tail
    holds BITS bits of each further one, the nearest to the root highest. Runs
    are counted in BINS bins, a byte each; where a bin overflows there are no
    counts, and nothing is ruled out.
    """
    tree = np.arange(1, trees + 1, dtype=np.uint64)

    def make(chunk: Chunk, main: np.ndarray) -> list[pa.Array]:
        n = len(chunk.pages)
        line = np.flatnonzero(main)
        words = np.bincount(chunk.page, weights=chunk.of_lines("n_words") * main, minlength=n).astype(np.int64)
        page = np.repeat(np.arange(n), words)
        code = runs(chunk.word_hashes(line), RUN)
        page_of = page[: len(code)]
        whole = page_of == page[RUN - 1 :]  # a run never reaches into the next page
        whole &= (words >= LEAST_WORDS)[page_of]
        code, page_of = code[whole], page_of[whole]
        sort_parts(code, np.bincount(page_of, minlength=n))
        new = np.r_[True, (code[1:] != code[:-1]) | (page_of[1:] != page_of[:-1])][: len(code)]
        code, page_of = code[new], page_of[new]
        sig = signatures(code, page_of, n, trees * depth).reshape(n, trees, depth)
        roots = np.broadcast_to(tree, (n, trees))
        for d in range(root):
            roots = finish(roots + sig[:, :, d])
        tails = np.zeros((n, trees), np.int64)
        for d in range(root, depth):
            tails = tails << BITS | (sig[:, :, d] >> np.uint64(64 - BITS)).astype(np.int64)
        ends = np.searchsorted(page_of, np.arange(n + 1)).tolist()
        counts = np.bincount(page_of * BINS + (code & np.uint64(BINS - 1)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
        fits = (counts < 256).all(1)
        counts = counts.astype(np.uint8)
        texts = main_lines.main_of(chunk, main)
        key, root_of, tail_of, bins, text = ([None] * n for _ in range(5))
        for i in np.flatnonzero(words >= LEAST_WORDS).tolist():
            key[i] = xxhash.xxh3_128_digest(code[ends[i] : ends[i + 1]].tobytes())
            root_of[i], tail_of[i], text[i] = roots[i].view(np.int64), tails[i], "\n".join(texts[i])
            bins[i] = counts[i].tobytes() if fits[i] else None
        return [
            pa.array(key, pa.binary()),
            pa.array(root_of, pa.list_(pa.int64())),
            pa.array(tail_of, pa.list_(pa.int64())),
            pa.array(bins, pa.binary()),
            pa.array(text, pa.string()),
        ]

    return Extra("set_key binary, roots array<bigint>, tails array<bigint>, bins binary, text string", make)


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that the similarity of two sets can be, row by row, by their counts in bins."""
    x, y = x.astype(np.int32), y.astype(np.int32)
    shared = np.minimum(x, y).sum(1)
    return shared / np.maximum(x.sum(1) + y.sum(1) - shared, 1)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops candidates that cannot be similar; without counts a candidate stays."""
    nothing = bytes(BINS)
    for batch in batches:
        known = np.asarray(batch.column(2).is_valid()) & np.asarray(batch.column(3).is_valid())
        x, y = (
            np.frombuffer(b"".join(v or nothing for v in batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3)
        )
        keep = pa.array(~known | (bound(x, y) >= SIMILAR))
        yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of all candidates, by their exact sets of runs."""
    kept: dict[int, np.ndarray] = {}

    def shingles(key: int, text: str) -> np.ndarray:
        if key not in kept:
            if len(kept) > 2000:
                kept.clear()
            kept[key] = shingle_set(text, RUN)
        return kept[key]

    for batch in batches:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        got = [jaccard(shingles(x, s), shingles(y, t)) for x, y, s, t in zip(a, b, ta, tb)]
        yield pa.record_batch([*batch.columns[:2], pa.array(got, pa.float64())], names=["a", "b", "similarity"])


class Forest(NamedTuple):
    """tested: (a, b, similarity, depth) of all pairs that met and were verified, and where; stops: (page_id, depth) where each page stopped."""

    tested: DataFrame
    stops: DataFrame


def search(labels: DataFrame, texts: DataFrame, depth: int = DEPTH, trees: int = TREES, recall: float = RECALL) -> Forest:
    """Searches the forest of labels (page_id, root, tail) of a tree each, from the full depth on.

    texts (page_id, bins, text) holds every labelled page. Both should be
    durable. A frequent prefix is split by the adaptive skew join.
    """
    root = root_depth(trees=trees, depth=depth, recall=recall)
    spark = labels.sparkSession
    tested = spark.createDataFrame([], "a bigint, b bigint, similarity double, depth int")
    active = durable(labels.select("page_id").distinct())
    stops = []
    for d in range(depth, root - 1, -1):
        near = labels.select("page_id", "root", F.shiftright("tail", BITS * (depth - d)).alias("t"))
        searching = near.join(active, "page_id", "left_semi")
        met = (
            searching.alias("x")
            .join(near.alias("y"), F.expr("x.root = y.root and x.t = y.t and x.page_id <> y.page_id"))
            .select(F.least("x.page_id", "y.page_id").alias("a"), F.greatest("x.page_id", "y.page_id").alias("b"))
            .distinct()
        )
        candidates = possible = durable(
            met.join(texts.select(F.col("page_id").alias("a"), F.col("bins").alias("x")), "a")
            .join(texts.select(F.col("page_id").alias("b"), F.col("bins").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(_possible, "a bigint, b bigint")
        )
        if d < depth:
            possible = possible.join(tested, ["a", "b"], "left_anti")
        verified = (
            possible.join(texts.select(F.col("page_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("page_id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb")
            .mapInArrow(_verify, "a bigint, b bigint, similarity double")
        )
        now = durable(verified.withColumn("depth", F.lit(d)))
        discard(candidates)
        tested = now if d == depth else tested.unionAll(now)
        if d == root:
            stops.append(active.withColumn("depth", F.lit(d)))
            break
        left = durable(active.join(_satisfied(tested, d, trees, recall), "page_id", "left").select("page_id", "enough"))
        stops.append(left.where("enough").select("page_id", F.lit(d).alias("depth")))
        active = left.where("enough is null").select("page_id")
    out = stops[0]
    for part in stops[1:]:
        out = out.unionAll(part)
    return Forest(tested, out)


def _satisfied(tested: DataFrame, depth: int, trees: int, recall: float) -> DataFrame:
    """(page_id, enough) of the pages whose partners met so far, and one assumed at the threshold, reach the recall."""

    def missed(p: Column) -> Column:
        return (1 - p) / p

    s = F.col("similarity")
    of = F.lit(1.0) - F.pow(F.lit(1.0) - F.pow(s, F.lit(depth)), F.lit(trees))
    both = tested.where(s >= SIMILAR).select(F.explode(F.array("a", "b")).alias("page_id"), missed(of).alias("missed"))
    assumed = (1 - chance(SIMILAR, depth, trees)) / chance(SIMILAR, depth, trees)
    return (
        both.groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("missed").alias("missed"))
        .where((F.col("n") + 1) / (F.col("n") + 1 + F.col("missed") + assumed) >= recall)
        .select("page_id", F.lit(True).alias("enough"))
    )


def similar_classes(pages: DataFrame, links: DataFrame) -> Classes:
    """The classes of equal pages and the pairs of similar classes.

    Pages without html, with less than LEAST_WORDS words in their main lines,
    or that are residue or spam take no part. A class is named by its smallest
    page id.
    """
    content = main_lines.content_pages(pages, links, _labels(TREES, DEPTH, root_depth()))
    signed = content.where("set_key is not null")
    named = durable(signed.groupBy("set_key").agg(F.min("page_id").alias("class_id")))
    members = durable(signed.select("page_id", "set_key").join(named, "set_key").select("page_id", "class_id"))
    heads = small_side(durable(members.where("page_id = class_id").select("page_id")))
    leaves = (
        signed.join(heads, "page_id", "left_semi")
        .select("page_id", F.explode(F.arrays_zip("roots", "tails")).alias("x"))
        .select("page_id", F.col("x.roots").alias("root"), F.col("x.tails").alias("tail"))
    )
    # Roots of one page alone can meet nobody at any depth: only the others go on.
    crowded = durable(leaves.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"))
    labels = durable(leaves.join(small_side(crowded), "root", "left_semi").select("page_id", "root", "tail"))
    some = durable(labels.select("page_id").distinct())
    texts = durable(signed.select("page_id", "bins", "text").join(small_side(some), "page_id", "left_semi"))
    pairs = search(labels, texts).tested.where(F.col("similarity") >= SIMILAR).select("a", "b", "similarity")
    return Classes(members, pairs)


def page_pairs(found: Classes) -> DataFrame:
    """(page_id_a, page_id_b), smaller first, of all similar pages: across similar classes and within each class."""
    m = found.members
    across = (
        found.pairs.join(m.select(F.col("class_id").alias("a"), F.col("page_id").alias("p")), "a")
        .join(m.select(F.col("class_id").alias("b"), F.col("page_id").alias("q")), "b")
        .select(F.least("p", "q").alias("page_id_a"), F.greatest("p", "q").alias("page_id_b"))
    )
    within = (
        m.select("class_id", F.col("page_id").alias("page_id_a"))
        .join(m.select("class_id", F.col("page_id").alias("page_id_b")), "class_id")
        .where("page_id_a < page_id_b")
        .select("page_id_a", "page_id_b")
    )
    return across.unionAll(within)


def groups(found: Classes) -> DataFrame:
    """(page_id, class_id, group_id, links): every page's class, its group of connected classes, and its similar classes.

    Groups are components of the similarity graph, by smallest-label spreading
    with shortcuts; every round is written to the shared folder. Only classes
    with links take part in the rounds.
    """
    edges = durable(
        found.pairs.select("a", "b").unionAll(found.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    held = label = durable(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("g")))
    while True:
        near = (
            edges.join(label.select(F.col("a").alias("b"), F.col("g").alias("gb")), "b")
            .groupBy("a")
            .agg(F.min("gb").alias("gb"))
        )
        nxt = label.join(near, "a").select("a", F.least("g", "gb").alias("h"), "g")
        up = label.select(F.col("a").alias("h"), F.col("g").alias("gh"))
        moved = durable(nxt.join(up, "h", "left").select("a", F.coalesce(F.least("h", "gh"), "h").alias("n"), "g"))
        discard(held)
        held, label = moved, moved.select("a", F.col("n").alias("g"))
        if moved.where("n <> g").isEmpty():
            break
    tags = label.join(degree, "a").withColumnRenamed("a", "class_id")
    return (
        found.members.join(tags, "class_id", "left")
        .select(
            "page_id", "class_id", F.coalesce("g", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
        )
    )
