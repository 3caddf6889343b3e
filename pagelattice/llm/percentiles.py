"""Percentiles per group by radix selection on order-preserving integers.

A double's bits become a signed 64-bit key with the same order. Each pass
histograms one digit of DIGIT bits per group and follows only the digits that
hold the wanted ranks, so after 64 / DIGIT passes the value at each rank is
exact. A pass moves at most one row per group and digit value, combined before
the shuffle: the number of rows in a group, or one group holding a third of
all, changes nothing.

`histogram` is the combinable form: counts by the top bits, which add up over
partitions and days, with a relative error below 2 ** -(bits - 12).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import durable

DIGIT = 16
#: Bits of the combinable histogram: sign, 11 of the exponent, the rest of the fraction.
SKETCH_BITS = 20


def to_keys(values: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles; -0.0 counts as 0.0. NaN has no place and must be left out."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def to_values(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _map(df: DataFrame, name: str, kind: str, change) -> DataFrame:
    """Replaces column `name`, the last one, by change(array), batch by batch."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield pa.record_batch([*batch.columns[:-1], pa.array(change(last))], names=[*batch.schema.names[:-1], name])

    return df.mapInArrow(run, f"{fields + ', ' if fields else ''}{name} {kind}")


def long_form(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(group, metric, key) of the non-null, non-negative, non-NaN values of each metric; null groups are left out."""
    stacked = df.where(F.col(group).isNotNull()).select(
        F.col(group),
        F.explode(
            F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
        ).alias("x"),
    )
    values = stacked.select(group, "x.metric", "x.value").where("value >= 0 and not isnan(value)")
    return _map(values, "key", "bigint", lambda v: to_keys(np.ascontiguousarray(v, np.float64)))


def histogram(keys: DataFrame, group: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(group, metric, slot, n): combinable counts by the top bits. Histograms of several sets add up slot by slot."""
    return keys.groupBy(group, "metric", F.shiftright("key", 64 - bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def combine(parts: list[DataFrame], group: str) -> DataFrame:
    """One histogram of several."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy(group, "metric", "slot").agg(F.sum("n").alias("n"))


def from_histogram(hist: DataFrame, group: str, shares: list[float], bits: int = SKETCH_BITS) -> DataFrame:
    """(group, metric, share, value): the value at nearest rank, as the low end of its slot."""
    from pyspark.sql import Window

    w = Window.partitionBy(group, "metric").orderBy("slot")
    run = hist.select(
        group,
        "metric",
        "slot",
        "n",
        F.sum("n").over(w).alias("upto"),
        F.sum("n").over(Window.partitionBy(group, "metric")).alias("total"),
    )
    asked = run.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total")))
    hit = asked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    shifted = hit.select(group, "metric", "share", F.shiftleft("slot", 64 - bits).alias("key"))
    return _map(shifted, "value", "double", lambda k: to_values(np.ascontiguousarray(k, np.int64)))


def select_ranks(keys: DataFrame, group: str, ranks: DataFrame) -> DataFrame:
    """(group, metric, rank, value): the value at each wanted rank (from 1) of (group, metric, rank).

    keys should be durable. Ranks beyond a group's size have no row.
    """
    from pyspark.sql import Window

    # prefix: the digits found so far; left: the rank among the values with that prefix.
    open_ = ranks.select(group, "metric", "rank", F.lit(0).cast("bigint").alias("prefix"), F.col("rank").alias("left"))
    for done in range(0, 64, DIGIT):
        shift = 64 - done - DIGIT
        digit = F.shiftright("key", shift)
        if done == 0:
            live = keys.select(group, "metric", F.lit(0).cast("bigint").alias("prefix"), digit.alias("next"))
        else:
            followed = open_.select(group, "metric", "prefix").distinct()
            live = (
                keys.select(group, "metric", F.shiftright("key", shift + DIGIT).alias("prefix"), digit.alias("next"))
                .join(followed, [group, "metric", "prefix"], "left_semi")
            )
        counts = live.groupBy(group, "metric", "prefix", "next").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(group, "metric", "prefix").orderBy("next")
        upto = counts.withColumn("upto", F.sum("n").over(w))
        open_ = durable(
            open_.join(upto, [group, "metric", "prefix"])
            .where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
            .select(
                group, "metric", "rank", F.col("next").alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")
            )
        )
    return _map(
        open_.select(group, "metric", "rank", "prefix"),
        "value",
        "double",
        lambda k: to_values(np.ascontiguousarray(k, np.int64)),
    )


def percentiles(df: DataFrame, group: str, metrics: list[str], shares: list[float]) -> DataFrame:
    """(group, metric, n, share, value): exact percentiles, linear between neighbouring ranks.

    Null, negative and NaN values are not measured and take no part; groups and
    metrics without values have no rows; ties and repeated rows count each.
    """
    keys = durable(long_form(df, group, metrics))
    sizes = durable(keys.groupBy(group, "metric").agg(F.count(F.lit(1)).alias("n")))
    at = F.col("share") * (F.col("n") - 1)
    asked = sizes.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).select(
        group, "metric", "n", "share", (F.floor(at) + 1).alias("low"), (F.ceil(at) + 1).alias("high"), (at - F.floor(at)).alias("part")
    )
    ranks = asked.select(group, "metric", F.explode(F.array("low", "high")).alias("rank")).distinct()
    values = durable(select_ranks(keys, group, ranks))
    low = values.select(group, "metric", F.col("rank").alias("low"), F.col("value").alias("v_low"))
    high = values.select(group, "metric", F.col("rank").alias("high"), F.col("value").alias("v_high"))
    return (
        asked.join(low, [group, "metric", "low"])
        .join(high, [group, "metric", "high"])
        .select(group, "metric", "n", "share", (F.col("v_low") + F.col("part") * (F.col("v_high") - F.col("v_low"))).alias("value"))
    )
