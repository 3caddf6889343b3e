"""Evaluation items inside documents: a BM25 index of the items, searched by every passage with block-max WAND.

Every document is cut into overlapping passages, so that any run of RUN words
lies whole in one of them. Each passage is a query against the items. The terms
of the index are runs of GRAM words, which few passages share by chance. An
item's weights are divided by the least score that any of its own runs of RUN
words gives, so a passage that holds such a run scores 1 or more: the search
loses no leak. It visits only postings of essential terms (those without which
no score of 1 can be reached), skips blocks of items whose block maxima stay
below 1, and scores the rest in full. What is found is then verified: by the
hashes of its runs, and a shared run by its words.

Counts of terms, items and lengths are taken over all items, whatever part of
the index an item lies in, so scores are comparable. The index is built in
parts by tasks; as many parts as fit a broadcast are searched in one scan of
the documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.shingles import runs, word_hashes, words
from pagelattice.session import BROADCAST_LIMIT, durable

#: Words of a run that counts as a leak, of a term, of a passage; BM25's usual parameters.
RUN, GRAM, PASSAGE, K1, B = 13, 3, 39, 1.2, 0.75
STRIDE = PASSAGE - RUN + 1
#: Items side by side in a block of the index; characters of item text in one part of it, on average.
BLOCK, INDEX_CHARS = 16, 1 << 20
#: Documents searched together: bounds the worker's memory.
CHUNK = 400
EPS = 1e-4


class Index(NamedTuple):
    ids: np.ndarray  # item ids
    grams: list[int]  # sizes of the terms: GRAM, and less for items with fewer words
    keys: np.ndarray  # [terms] hash of the term, rising
    top: np.ndarray  # [terms] largest weight
    starts: np.ndarray  # postings of term t: items[starts[t]:starts[t + 1]], by item
    items: np.ndarray
    weight: np.ndarray  # of each posting, scaled so that a leak scores 1
    block_starts: np.ndarray  # block postings of term t, as above
    blocks: np.ndarray
    block_max: np.ndarray
    run_size: np.ndarray  # [items] RUN, or the item's words if fewer
    item_runs: list[np.ndarray]  # [items] sorted run hashes
    item_words: list[list[str]]  # [items] words, in order


def _terms(h: np.ndarray, gram: int) -> np.ndarray:
    return runs(h, gram) + np.uint64(gram)


class Counts(NamedTuple):
    """Of all items: how many have words, their mean number of terms, and of each term of interest the items with it."""

    items: int
    mean_terms: float
    frequency: dict[int, int]


def counts_of(texts: list[str]) -> Counts:
    """The counts of a few items at hand."""
    terms = [_terms_of(word_hashes(w)) for t in texts if (w := words(t or ""))]
    frequency: dict[int, int] = {}
    for x in terms:
        for k in np.unique(x).tolist():
            frequency[k] = frequency.get(k, 0) + 1
    return Counts(len(terms), sum(map(len, terms)) / max(1, len(terms)), frequency)


def _terms_of(h: np.ndarray) -> np.ndarray:
    return _terms(h, min(GRAM, len(h)))


def build(ids: list[int], texts: list[str], counts: Counts) -> Index:
    """The index of some items under the counts of all; items without words never leak."""
    split = [(i, w) for i, t in zip(ids, texts) if (w := words(t or ""))]
    parsed = [(i, word_hashes(w)) for i, w in split]
    n = len(parsed)
    gram = [min(GRAM, len(h)) for _, h in parsed]
    coded = [_terms(h, g) for (_, h), g in zip(parsed, gram)]
    keys, flat = np.unique(np.concatenate(coded) if coded else np.zeros(0, np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(c) for c in coded])
    pair, tf = np.unique(flat.astype(np.int64) * max(n, 1) + owner, return_counts=True)
    term, item = pair // max(n, 1), pair % max(n, 1)
    df = np.array([counts.frequency[k] for k in keys.tolist()], np.float64)
    sizes = np.array([len(c) for c in coded] or [1], np.float64)
    idf = np.log(1 + (counts.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / max(counts.mean_terms, 1)))
    size = np.array([min(RUN, len(h)) for _, h in parsed], np.int64)
    own = {int(p): w for p, w in zip(pair, weight)}
    at = 0
    least = np.ones(n)
    for j, c in enumerate(coded):
        t = flat[at : at + len(c)]
        at += len(c)
        span = int(size[j]) - gram[j] + 1  # terms within a run
        least[j] = min(sum(own[int(x) * n + j] for x in set(t[s : s + span].tolist())) for s in range(len(c) - span + 1))
    weight = weight / least[item]
    blocks, first = np.unique(term * (n // BLOCK + 1) + item // BLOCK, return_index=True)
    block_term = blocks // (n // BLOCK + 1)
    steps = np.arange(len(keys) + 1)
    top = np.zeros(len(keys))
    np.maximum.at(top, term, weight)
    return Index(
        np.array([i for i, _ in parsed], np.int64),
        sorted(set(gram)),
        keys,
        top,
        np.searchsorted(term, steps),
        item,
        weight,
        np.searchsorted(block_term, steps),
        blocks % (n // BLOCK + 1),
        np.maximum.reduceat(weight, first) if len(weight) else weight,
        size,
        [np.unique(runs(h, int(k))) for (_, h), k in zip(parsed, size)],
        [w for _, w in split],
    )


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + sizes[i] - 1 of all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _queries(index: Index, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(passage, term) of every passage and each distinct index term in it, passages rising.

    A passage is text number * 2**32 + its number within the text.
    """
    sizes = np.array([len(h) for h in texts], np.int64)
    whole = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    pos = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = []
    for g in index.grams:
        if len(whole) < g:
            continue
        key = _terms(whole, g)
        at = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
        hit = np.flatnonzero((index.keys[at] == key) & (doc[: len(key)] == doc[g - 1 :]))
        d, p, t = doc[hit], pos[hit], at[hit]
        last = p // STRIDE
        first = np.maximum(0, -(-(p + g - PASSAGE) // STRIDE))
        two = first < last
        for k, m in ((last, slice(None)), (first, two)):
            found.append(np.stack([(d[m] << 32) + k[m], t[m]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    passage, term = np.concatenate(found, axis=1)
    order = np.lexsort((term, passage))
    passage, term = passage[order], term[order]
    new = np.r_[True, (passage[1:] != passage[:-1]) | (term[1:] != term[:-1])][: len(passage)]
    return passage[new], term[new]


def search(index: Index, texts: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(text number, item number, best passage score) of all passages that score 1 or more; texts as word hashes."""
    passage, term = _queries(index, texts)
    if not len(passage):
        return []
    # Within a passage by rising impact: terms that together cannot reach 1 are not essential.
    order = np.lexsort((index.top[term], passage))
    passage, term = passage[order], term[order]
    begin = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    length = np.diff(np.r_[begin, len(passage)])
    number = np.repeat(np.arange(len(begin)), length)
    total = np.cumsum(index.top[term])
    before = np.repeat(np.r_[0, total[begin[1:] - 1]], length)
    full = np.add.reduceat(index.top[term], begin) >= 1 - EPS
    live = full[number]
    essential = np.flatnonzero(live & (total - before >= 1 - EPS))
    if not len(essential):
        return []
    n_items, n_blocks = len(index.ids), len(index.ids) // BLOCK + 1

    def gather(which: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = starts[term[which] + 1] - starts[term[which]]
        return np.repeat(number[which], count), _ranges(starts[term[which]], count)

    # Sums of block maxima per (passage, block): blocks below 1 are skipped whole.
    alive = np.flatnonzero(live)
    of, at = gather(alive, index.block_starts)
    spot, back = np.unique(of * n_blocks + index.blocks[at], return_inverse=True)
    open_ = spot[np.bincount(back, weights=index.block_max[at]) >= 1 - EPS]
    of, at = gather(essential, index.starts)
    item = index.items[at]
    candidate = np.unique(of * n_items + item)
    candidate = candidate[np.isin(candidate // n_items * n_blocks + candidate % n_items // BLOCK, open_)]
    # Full scores of the candidates, from all postings of their passages.
    of, at = gather(alive, index.starts)
    key = of * n_items + index.items[at]
    place = np.minimum(np.searchsorted(candidate, key), max(len(candidate) - 1, 0))
    mine = candidate[place] == key if len(candidate) else np.zeros(len(key), bool)
    score = np.bincount(place[mine], weights=index.weight[at][mine], minlength=len(candidate))
    out: dict[tuple[int, int], float] = {}
    for c in np.flatnonzero(score >= 1 - EPS):
        d = int(passage[begin[candidate[c] // n_items]] >> 32), int(candidate[c] % n_items)
        out[d] = max(out.get(d, 0.0), float(score[c]))
    return [(d, i, s) for (d, i), s in out.items()]


def _same_words(text: list[str], item: list[str], size: int, hits: np.ndarray) -> bool:
    """Whether a run whose hash both share is the same words in both."""
    wanted = set(hits.tolist())
    places = {int(h): i for i, h in enumerate(runs(word_hashes(item), size).tolist()) if h in wanted}
    for i, h in enumerate(runs(word_hashes(text), size).tolist()):
        if h in places and text[i : i + size] == item[places[h] : places[h] + size]:
            return True
    return False


def index_parts(items: DataFrame) -> DataFrame:
    """(part, index): the pickled parts of the index, each of about INDEX_CHARS characters of items; durable.

    Item rows without words are left out, rows stored twice count once.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, keys, sizes = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if found := words(text):
                    terms = _terms_of(word_hashes(found))
                    kept.append(i)
                    keys.append(np.unique(terms).view(np.int64))
                    sizes.append(len(terms))
            cols = [c.take(pa.array(kept, pa.int64())) for c in batch.columns]
            yield pa.record_batch(
                [*cols, pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                names=["item_id", "text", "keys", "size"],
            )

    parsed = durable(
        items.where("text is not null")
        .select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
        .distinct()
        .mapInArrow(parse, "item_id bigint, text string, keys array<bigint>, size bigint")
    )
    n, mean, chars = parsed.agg(F.count(F.lit(1)), F.avg("size"), F.sum(F.length("text"))).first()
    n_parts = -(-(chars or 1) // INDEX_CHARS)
    terms = parsed.select("item_id", "text", F.explode("keys").alias("key"))
    frequency = terms.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    counted = (
        terms.join(frequency, "key")
        .groupBy("item_id", "text")
        .agg(F.collect_list(F.struct("key", "df")).alias("x"))
        .select("item_id", "text", F.col("x.key").alias("keys"), F.col("x.df").alias("dfs"))
        .withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n_parts)))
    )

    def built(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item_id", "text"])
        frequency = {k: d for ks, ds in zip(group["keys"], group.dfs) for k, d in zip(np.array(ks, np.int64).view(np.uint64).tolist(), ds)}
        index = build(group.item_id.tolist(), group.text.tolist(), Counts(n, mean or 1.0, frequency))
        return pd.DataFrame({"part": [group.part.iloc[0]], "index": [pickle.dumps(index, 5)]})

    return durable(counted.groupBy("part").applyInPandas(built, "part bigint, index binary"))


def _against(documents: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [pickle.loads(x) for x in shared.value]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for at in range(0, len(ids), CHUNK):
                split = [words(t) for t in texts[at : at + CHUNK]]
                found = [word_hashes(w) for w in split]
                cache: dict[tuple[int, int], np.ndarray] = {}
                for index in indexes:
                    for d, i, score in search(index, found):
                        k = int(index.run_size[i])
                        if (d, k) not in cache:
                            cache[d, k] = np.unique(runs(found[d], k))
                        hit = np.intersect1d(cache[d, k], index.item_runs[i], assume_unique=True)
                        if len(hit) and _same_words(split[d], index.item_words[i], k, hit):
                            rows.append((ids[at + d], int(index.ids[i]), score, len(hit) / len(index.item_runs[i])))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                names=["doc_id", "item_id", "score", "overlap"],
            )

    return (
        documents.where("text is not null")
        .select(F.col("doc_id").cast("bigint"), "text")
        .mapInArrow(run, "doc_id bigint, item_id bigint, score double, overlap double")
    )


def leaks(documents: DataFrame, items: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, item_id, score, overlap): documents with RUN consecutive words of an item, or all words of a shorter one.

    overlap is the share of the item's distinct runs that the document holds.
    Null, blank and wordless texts, of documents or items, leak nothing.
    Repeated documents and equal items of different ids each have their own
    rows. The documents are scanned once per `limit` bytes of index.
    """
    parts = index_parts(items)
    out, held, size = None, [], 0
    # The parts are listed by size first, so that no more than one broadcast's worth is fetched at a time.
    sizes = parts.select("part", F.octet_length("index").alias("size")).orderBy("part").collect()
    batches: list[list[int]] = []
    for row in sizes:
        if held and size + row.size > limit:
            batches.append(held)
            held, size = [], 0
        held.append(row.part)
        size += row.size
    if held:
        batches.append(held)
    for wanted in batches:
        fetched = [bytes(r[0]) for r in parts.where(F.col("part").isin(wanted)).orderBy("part").select("index").collect()]
        shared = documents.sparkSession.sparkContext.broadcast(fetched)
        part = _against(documents, shared)
        if len(batches) > 1:  # one broadcast is held at a time
            part = durable(part)
            shared.destroy()
        out = part if out is None else out.unionAll(part)
    if out is None:
        empty = "cast(null as bigint) doc_id, cast(null as bigint) item_id, 0D score, 0D overlap"
        return items.sparkSession.sql(f"select {empty} where false")
    return out
