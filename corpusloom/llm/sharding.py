"""Weighted rendezvous sharding with stable record keys.

Every (key, shard) pair has a score; a record goes to the shard with the best score. A new shard
only ever wins records for itself, so nothing moves between the old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each shard is numbered in so many independent runs, so a hot shard is no single sort.
NUMBERING_RUNS = 256


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) that wins `key`; shard i gets a share in proportion to weights[i].

    The score of shard i is -weights[i] / ln(u), with u in (0, 1) from a 64-bit hash of the key
    and i. Equal scores go to the larger number. A null key is a key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")

    def score(i: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 12).cast("double") + 0.5) / float(2**52)
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(i).alias("shard"))

    return F.array_max(F.array(*[score(i, w) for i, w in enumerate(weights)]))["shard"]


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] = (1.0,) * 16,
    shard_col: str = "shard",
    slot_col: str = "slot",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Add each row's shard and its gapless place in that shard.

    Columns of `df` named like the new ones are replaced. Rows with a null key share one shard;
    rows that agree in key and `tie_break` are interchangeable and get consecutive places. An
    empty table gives an empty result with the same columns.

    Places are numbered in NUMBERING_RUNS runs a shard, each a sort of its own, that are then put
    end to end; the table of run sizes has at most len(weights) * NUMBERING_RUNS rows, which is
    why it may be broadcast.
    """
    order = [key, *tie_break]
    sharded = (
        df.drop(shard_col, slot_col)
        .withColumn(shard_col, rendezvous(F.col(key), weights))
        .withColumn("__run", F.pmod(F.xxhash64(*order, F.lit("run")), F.lit(NUMBERING_RUNS)))
    )
    runs = sharded.groupBy(shard_col, "__run").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(shard_col).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        shard_col, "__run", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    )
    within = Window.partitionBy(shard_col, "__run").orderBy(*order)
    return (
        sharded.withColumn("__place", F.row_number().over(within))
        .join(F.broadcast(starts), [shard_col, "__run"])
        .withColumn(slot_col, F.col("__start") + F.col("__place") - 1)
        .select(*[c for c in df.columns if c not in (shard_col, slot_col)], shard_col, slot_col)
    )
