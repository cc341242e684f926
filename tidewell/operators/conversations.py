"""Conversations: lengths, roles, and filters by length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.text import role, words
from tidewell.operators.ordered import running_sum


def short_enough(turns: DataFrame, most: int, key: str = "conv_id") -> DataFrame:
    """``key, n_words`` of conversations with ``most`` words or fewer in all turns."""
    return turns.groupBy(key).agg(F.sum(words(F.col("text"))).alias("n_words")).where(F.col("n_words") <= most)


def lengths(turns: DataFrame, key: str = "conv_id", image: str | None = None) -> DataFrame:
    """``length`` (128 more with an image) and ``modality_length``, negative without one."""
    has = F.max(F.col(image).cast("int")) if image else F.lit(0)
    rows = turns.groupBy(key).agg(F.sum(words(F.col("text"))).alias("_w"), has.alias("_i"))
    return rows.select(key, (F.col("_w") + 128 * F.col("_i")).alias("length"), F.when(F.col("_i") == 1, F.col("_w")).otherwise(-F.col("_w")).alias("modality_length"))


def mapped_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Roles mapped; turns before the first user turn dropped; numbered densely."""
    rows = turns.withColumn("role", role(F.col("role")))
    w = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_on", F.max((F.col("role") == "user").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_on = 1").drop("_on")
    return rows.withColumn("n", F.row_number().over(w) - 1)


def packed_lengths(rows: DataFrame, length: str, order: str, shards: int, most: int) -> DataFrame:
    """Rows dealt to shards, each with the running sum of its truncated lengths and the number of the pack it falls into."""
    cut = F.least(F.col(length), F.lit(most))
    dealt = rows.withColumn("shard", F.pmod(F.col(order), F.lit(shards))).withColumn("cut", cut)
    return running_sum(dealt, ["shard"], order, "cut", "upto").withColumn("pack", F.expr(f"(upto - 1) div {most}"))


def padded(rows: DataFrame, batch: str, most: int, pad: int, ignore: int = -100, left: bool = False) -> DataFrame:
    """``input_ids`` and ``labels`` filled up to the longest of their batch and cut after ``most``; ``attention`` marks ids other than ``pad``."""
    widest = F.max(F.size("input_ids")).over(W.partitionBy(batch))

    def filled(column: str, filler: int):
        items = F.col(column).cast("array<bigint>")
        more = F.array_repeat(F.lit(filler).cast("bigint"), F.col("_width") - F.size(items))
        return F.slice(F.concat(more, items) if left else F.concat(items, more), 1, most)

    out = rows.withColumn("_width", widest).withColumns({"input_ids": filled("input_ids", pad), "labels": filled("labels", ignore)}).drop("_width")
    return out.withColumn("attention", F.transform("input_ids", lambda x: x != pad))


def flattened(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """A row per batch: ``input_ids`` and ``labels`` end to end in ``order``, and ``bounds``, their cumulative lengths from 0."""
    one = rows.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, "input_ids", "labels"))).alias("_r"))
    sizes = F.transform("_r", lambda r: F.size(r["input_ids"]))
    bounds = F.transform(F.sequence(F.lit(0), F.size("_r")), lambda k: F.aggregate(F.slice(F.col("_sizes"), F.lit(1), k), F.lit(0), lambda a, b: a + b))
    return one.withColumn("_sizes", sizes).select(batch, F.flatten(F.transform("_r", lambda r: r["input_ids"])).alias("input_ids"), F.flatten(F.transform("_r", lambda r: r["labels"])).alias("labels"), bounds.alias("bounds"))
