"""Mixing sources to target token shares by balanced sampling with the cube method."""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import durable

#: Vocabulary of the token count, in tiktoken's format.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how a byte-level BPE of this kind splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents whose flight runs in one task; more are split into buckets whose left-overs fly again.
BUCKET = 4000
SEED = 11


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): null and empty texts have none. The vocabulary must lie at this path on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"]
            )

    return documents.select(F.col("doc_id").cast("bigint"), "source", F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, source string, tokens bigint"
    )


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves inclusion probabilities to 0 or 1 while the expected number and tokens stay; at most 2 stay fractional.

    Each step takes three undecided documents, whose two constraints (count and
    tokens) leave a line of directions, and walks along it, either way with the
    chances that keep the expectation, until one of them is decided.
    """
    p = p.copy()
    active: list[int] = []
    scale = max(1.0, float(tokens.max(initial=0)))
    for k in range(len(p)):
        if not 1e-9 < p[k] < 1 - 1e-9:
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        ta, tb, tc = tokens[a] / scale, tokens[b] / scale, tokens[c] / scale
        u = np.array([tb - tc, tc - ta, ta - tb])
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])  # equal sizes: any move that keeps the count
        x = p[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)))
            down = np.min(np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)))
        x = x + up * u if rng.random() * (up + down) < down else x - down * u
        x = np.where(x < 1e-9, 0.0, np.where(x > 1 - 1e-9, 1.0, x))
        p[active] = x
        active = [i for i, v in zip(active, x) if 0 < v < 1]
    return p


def land(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Decides the last few: the rounding whose count and tokens stay closest to the expected ones."""
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if len(open_):
        t = tokens[open_]
        want = p[open_] @ t, p[open_].sum()
        size = max(1.0, float(t.mean()))
        best = min(
            itertools.product((0.0, 1.0), repeat=len(open_)),
            key=lambda x: (abs(np.dot(x, t) - want[0]) / size + abs(sum(x) - want[1]), x),
        )
        p = p.copy()
        p[open_] = best
    return np.round(p)


def _fly(group: pd.DataFrame, final: bool) -> pd.DataFrame:
    group = group.sort_values("doc_id", kind="stable")
    p, tokens = group.p.to_numpy(float), group.tokens.to_numpy(float)
    # Seeded by the group, so that a task that runs again decides alike.
    rng = np.random.default_rng([SEED, int(group.doc_id.iloc[0]) & 0xFFFFFFFF, len(group)])
    p = flight(p, tokens, rng)
    return group.assign(p=land(p, tokens) if final else p)


def _flier(final: bool):
    return lambda group: _fly(group.drop(columns="bucket"), final)


class Mix(NamedTuple):
    """report: a row per source; sample: (doc_id, source, tokens, repeats)."""

    report: DataFrame
    sample: DataFrame


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY) -> Mix:
    """Samples documents so that each source gives target_share of the total tokens, each at most max_repeats times.

    total is the size of the mix, by default the tokens of all documents of all
    target sources. A source is `short` if the sample uses every one of its
    documents max_repeats times and still stays below its share. Every other
    document is used a fixed number of times plus once more by chance; those
    chances are settled by the cube method, balanced on tokens and documents.
    Documents of other or null sources, null targets and rows without tokens
    are not sampled; copies count as documents; a source without documents is
    short if its share is positive.
    """
    wanted = durable(
        targets.where("source is not null and target_share is not null")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    # One row per source name: bounded by the number of sources; Spark still checks its size before a broadcast.
    counted = durable(token_counts(documents.join(wanted.select("source"), "source", "left_semi"), vocabulary))
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    plan = wanted.join(sums, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("tokens", F.lit(0)).alias("source_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )
    if total is None:
        total = sums.agg(F.sum("tokens")).first()[0] or 0
    plan = durable(
        plan.withColumn("wanted_tokens", F.col("target_share") * F.lit(total)).withColumn(
            "rate",
            F.least(
                F.col("max_repeats").cast("double"), F.coalesce(F.try_divide("wanted_tokens", "source_tokens"), F.lit(0.0))
            ),
        )
    )
    rated = counted.join(plan.select("source", "rate", "documents"), "source").select(
        "doc_id",
        "source",
        "tokens",
        F.floor("rate").cast("bigint").alias("base"),
        (F.col("rate") - F.floor("rate")).alias("p"),
        F.ceil(F.col("documents") / BUCKET).cast("int").alias("buckets"),
    )
    sure = rated.where("p <= 1e-9").select("doc_id", "source", "tokens", F.col("base").alias("repeats"))
    decided = [sure]
    level = rated.where("p > 1e-9")
    salt = 0
    schema = "doc_id bigint, source string, tokens bigint, base bigint, p double, buckets int"
    most = plan.agg(F.max(F.ceil(F.col("documents") / BUCKET))).first()[0] or 1
    while True:
        final = most <= 1
        flown = durable(
            level.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(salt)), "buckets"))
            .groupBy("source", "bucket")
            .applyInPandas(_flier(final), schema)
        )
        settled = "p <= 1e-9 or p >= 1 - 1e-9"
        decided.append(
            flown.where(settled).select("doc_id", "source", "tokens", (F.col("base") + F.round("p").cast("bigint")).alias("repeats"))
        )
        if final:
            break
        # Two per bucket are left at most: the next level is smaller by BUCKET / 2.
        level = flown.where(f"not ({settled})").withColumn(
            "buckets", F.ceil(2 * F.col("buckets") / BUCKET).cast("int")
        )
        most = -(-2 * most // BUCKET)
        salt += 1
    sample = decided[0]
    for part in decided[1:]:
        sample = sample.unionAll(part)
    used = durable(
        sample.groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"),
            F.sum("repeats").alias("used_documents"),
            F.max("repeats").alias("most_repeats"),
            F.min("repeats").alias("least_repeats"),
        )
    )
    mixed = used.agg(F.sum("used_tokens")).first()[0] or 0
    # What the landing left: a source falls short if even all its documents at the most repeats do not fill its share.
    full = F.coalesce(F.col("least_repeats") >= F.col("max_repeats"), F.lit(True))
    short = full & (F.coalesce("used_tokens", F.lit(0)) < F.col("wanted_tokens"))
    report = plan.join(used, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "source_tokens",
        F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.try_divide(F.col("used_tokens"), F.lit(mixed)), F.lit(0.0)).alias("actual_share"),
        short.alias("short"),
    )
    return Mix(report, sample)
