"""Runs and steps: gaps and islands over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.ordered import running_sum

def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``key, run, value, start, end, n``: maximal runs of equal values (nulls equal each other); start and end are values of the first order column."""
    w = W.partitionBy(key).orderBy(*order)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    tagged = df.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return tagged.groupBy(key, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count("*").alias("n"))


def steps(segments: DataFrame, key: str, dictionary: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """Runs as steps: values mapped to texts, quality labels dropped, numbered densely from 0."""
    named = segments.join(dictionary.select(F.col(value).alias("_k"), F.col("text").alias("desc")), F.col(value) == F.col("_k"))
    named = named.where(~F.lower(F.trim("desc")).isin(labels))
    w = W.partitionBy(key).orderBy("run")
    return named.select(key, (F.row_number().over(w) - 1).alias("i"), "desc", "start", "end")


def merge_equal(steps_: DataFrame, key: str) -> DataFrame:
    """Consecutive steps with the same text become one, from the first start to the last end."""
    merged = runs(steps_.select(key, "i", "desc", F.col("start").alias("_s"), F.col("end").alias("_e")), key, ["i"], "desc")
    joined = merged.join(steps_.select(key, F.col("i").alias("start"), F.col("start").alias("_s")), [key, "start"]).join(steps_.select(key, F.col("i").alias("end"), F.col("end").alias("_e")), [key, "end"])
    return joined.select(key, F.col("run").alias("i"), "desc", F.col("_s").alias("start"), F.col("_e").alias("end"))


def as_array(steps_: DataFrame, key: str) -> DataFrame:
    """Steps as one array of (i, desc, start, end) per key."""
    return steps_.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "desc", "start", "end"))).alias("steps"))


def clip_steps(episodes: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Steps from a JSON list of [start, end] pairs; the text is the frame's at the start, else the first frame's."""
    clips = episodes.select(key, F.posexplode(F.from_json("time_clip", "array<array<bigint>>")).alias("i", "c")).select(key, "i", F.get("c", F.lit(0)).alias("start"), F.get("c", F.lit(1)).alias("end"))
    first = frames.groupBy(key).agg(F.min_by("desc", "frame").alias("_first"))
    return clips.join(frames.select(key, F.col("frame").alias("start"), "desc"), [key, "start"], "left").join(first, key, "left").select(key, "i", F.coalesce("desc", "_first").alias("desc"), "start", "end")


def window_gather(df: DataFrame, key: str, order: str, value: str, offsets: list[int], absolute: bool = True) -> DataFrame:
    """Values at ``offsets`` around each row: out of range the first or last value, or zero where ``absolute`` is off."""
    w = W.partitionBy(key).orderBy(order)
    ends = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = lambda o: (F.last(value).over(ends) if o > 0 else F.first(value).over(ends)) if absolute else F.lit(0.0)
    return df.withColumn("window", _gathered(w, value, offsets, edge))


def _gathered(w, value: str, offsets: list[int], edge):
    n, i = F.count("*").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.row_number().over(w)
    return F.array(*[F.when((i + o >= 1) & (i + o <= n), F.lead(value, o).over(w) if o >= 0 else F.lag(value, -o).over(w)).otherwise(edge(o)) for o in offsets])


def start_offsets(df: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """Exclusive running sum of lengths within a key; the order is a number that doesn't repeat within it."""
    return running_sum(df, [key], order, length, "offset").withColumn("offset", F.col("offset") - F.coalesce(F.col(length), F.lit(0)))


def expand_steps(df: DataFrame, length: str) -> DataFrame:
    """A row per step, 0 to ``length`` - 1; none for empty ones."""
    return df.where(F.col(length) > 0).withColumn("step", F.explode(F.sequence(F.lit(0), F.col(length) - 1)))


def ensemble(df: DataFrame, key: str, order: str, vector: str, history: int, alpha: float) -> DataFrame:
    """The last ``history`` predictions averaged with weights ``exp(alpha * cosine to the newest)``."""
    from tidewell.functions.vectors import dot, norm

    w = W.partitionBy(key).orderBy(order).rowsBetween(-(history - 1), 0)
    rows = df.withColumn("_past", F.collect_list(F.col(vector).cast("array<double>")).over(w)).withColumn("_now", F.col(vector).cast("array<double>"))
    rows = rows.withColumn("_w", F.transform("_past", lambda p: F.exp(alpha * dot(p, F.col("_now")) / (norm(p) * norm(F.col("_now")) + 1e-7))))
    total = F.aggregate("_w", F.lit(0.0), lambda t, x: t + x)
    added = F.aggregate(F.zip_with("_past", "_w", lambda p, k: F.transform(p, lambda x: x * k)), F.transform("_now", lambda x: x * 0), lambda t, p: F.zip_with(t, p, lambda x, y: x + y))
    return rows.withColumn("ensemble", F.transform(added, lambda x: x / total)).drop("_past", "_now", "_w")
