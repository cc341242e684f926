"""Seeded draws that need no random state: rows are ranked by the md5 of seed and key, so every engine draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.vectors import uniform

_DIGITS = 4


def rank_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def pick_per_group(df: DataFrame, group: list[str], key: str, seed: int, k: int = 1) -> DataFrame:
    """``k`` rows of each group; groups are ranked apart, so no task holds more than one group at a time."""
    order = W.partitionBy(*group).orderBy(rank_key(seed, F.col(key)), F.col(key))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def pick(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """``k`` rows of all: a top-k, so partitions send ``k`` rows each and nothing is sorted as a whole."""
    return df.orderBy(rank_key(seed, F.col(key)), F.col(key)).limit(k)


def pick_share(df: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """``int(n * share)`` rows without replacement, those with the smallest hashes.

    Counts by the first ``_DIGITS`` hex digits of the hash (65,536 at most) tell which of them holds the last row to take. All
    before it are taken by a filter, and only within it rows are ranked.
    """
    hashed = df.withColumn("_hash", rank_key(seed, F.col(key))).withColumn("_head", F.substring("_hash", 1, _DIGITS))
    counts = hashed.groupBy("_head").agg(F.count("*").alias("n"))
    heads = counts.withColumn("upto", F.sum("n").over(W.orderBy("_head")))
    want = int((counts.agg(F.sum("n")).head()[0] or 0) * share)
    last = heads.where(F.col("upto") >= want).orderBy("_head").head() if want else None
    if last is None:
        return df.limit(0)
    below = hashed.where(F.col("_head") < last["_head"])
    edge = hashed.where(F.col("_head") == last["_head"]).orderBy("_hash", key).limit(want - (last["upto"] - last["n"]))
    return below.unionByName(edge).drop("_hash", "_head")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(rank_key(seed, F.col(key)), F.col(key))


def shuffle_array(items: Column, seed: Column) -> Column:
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("|", seed, x)).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def draws(n: int, seed: int, df: DataFrame) -> DataFrame:
    """``draw, u``: ``n`` numbers in [0, 1) for draws with replacement."""
    return df.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))).alias("u"))
