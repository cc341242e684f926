"""Episode quality: distance of state and action series, thresholds, reasons and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.ordered import beside, quantiles

# Dataset -> (least frames, distance threshold); None means "report only".
LIMITS = {
    "BC_Z": (41, 1.0), "Bridge": (10, 0.5), "Galaxea-Open-World-Dataset": (50, 0.5), "RT-1": (12, 0.5), "RDT-yhq": (30, 0.3),
    "droid_1.0.1": (40, 0.5), "droid_RoboInter": (40, 0.5), "RH20T-RoboInter": (20, 0.2), "RH20T-fjy": (20, 0.2), "RoboCOIN": (60, 0.2),
    "RoboMindV1.0": (30, 1.0), "RoboMindV2.0": (30, 0.5), "agibotworld_hyy": (None, None), "xvla-soft-fold_franka_v3_franka": (None, None),
}
DEFAULT_THRESHOLD = 0.2


def limits_table(spark: SparkSession, limits: dict = LIMITS) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in limits.items()], "dataset STRING, min_frames INT, threshold DOUBLE")


def with_limits(df: DataFrame, limits: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Limits by exact name, else by top-level folder. A dataset that isn't listed gets the default threshold; a listed null stays null."""
    top = F.substring_index(dataset, "/", 1)
    exact, broad = limits.select(F.col("dataset").alias("_k1"), F.struct("min_frames", "threshold").alias("_l1")), limits.select(F.col("dataset").alias("_k2"), F.struct("min_frames", "threshold").alias("_l2"))
    df = df.join(exact, F.col(dataset) == F.col("_k1"), "left").join(broad, top == F.col("_k2"), "left")
    found = F.coalesce("_l1", "_l2")
    return df.withColumns({"min_frames": found["min_frames"], "threshold": F.when(found.isNull(), DEFAULT_THRESHOLD).otherwise(found["threshold"])}).drop("_k1", "_k2", "_l1", "_l2")


def too_short(length: Column, least: Column) -> Column:
    return F.coalesce(F.coalesce(length, F.lit(0)) < least, F.lit(False))


def blank_tasks(tasks: Column) -> Column:
    return tasks.isNull() | (F.size(tasks) == 0) | F.forall(tasks, lambda t: F.trim(F.coalesce(t, F.lit(""))) == "")


def l2_scores(frames: DataFrame, key: str = "episode", frame: str = "frame", state: str = "state", action: str = "action", mask: str | None = None) -> DataFrame:
    """``episode, n_frames, l2_score``: mean distance of state and action after min-max scaling over both, active dimensions only.

    Under two frames the score is null. When every dimension of one side stands still (population deviation under 1e-3)
    and the other moves it is infinite, and 0 when both stand still. Inactive dimensions have a common range under 0.05 or stand still
    on both sides. Two aggregations over (episode, dimension) and (episode, frame); rows never gather in one list.
    """
    both = F.arrays_zip(F.col(state).cast("array<double>").alias("s"), F.col(action).cast("array<double>").alias("a"), *([F.col(mask).alias("m")] if mask else []))
    cells = frames.select(key, frame, F.posexplode(both).alias("dim", "v")).select(key, frame, "dim", F.col("v.s").alias("s"), F.col("v.a").alias("a"), *([F.col("v.m").alias("m")] if mask else []))
    if mask:
        valid = cells.groupBy(key, "dim").agg(F.bool_and("m").alias("ok")).where("ok").drop("ok")
        cells = cells.drop("m").join(valid, [key, "dim"])
    dims = cells.groupBy(key, "dim").agg(
        F.least(F.min("s"), F.min("a")).alias("lo"), F.greatest(F.max("s"), F.max("a")).alias("hi"), F.stddev_pop("s").alias("ds"), F.stddev_pop("a").alias("da"), F.count("*").alias("n")
    )
    dims = dims.withColumn("active", (F.col("hi") - F.col("lo") >= 0.05) & ~((F.col("ds") < 1e-3) & (F.col("da") < 1e-3)))
    whole = dims.groupBy(key).agg(F.max("n").alias("n_frames"), F.bool_and(F.col("ds") < 1e-3).alias("still_s"), F.bool_and(F.col("da") < 1e-3).alias("still_a"))
    moved = cells.join(dims.where("active").select(key, "dim", "lo", "hi"), [key, "dim"])
    gap = (F.col("s") - F.col("a")) / F.when(F.col("hi") - F.col("lo") < 1e-12, 1.0).otherwise(F.col("hi") - F.col("lo"))
    per_frame = moved.groupBy(key, frame).agg(F.sqrt(F.sum(gap * gap)).alias("d"))
    mean = per_frame.groupBy(key).agg(F.avg("d").alias("mean"))
    score = F.when(F.col("n_frames") < 2, None).when(F.col("still_s") & F.col("still_a"), 0.0).when(F.col("still_s") != F.col("still_a"), float("inf")).otherwise(F.coalesce("mean", F.lit(0.0)))
    return whole.join(mean, key, "left").select(key, "n_frames", score.alias("l2_score"))


def normalised_series(frames: DataFrame, key: str = "episode", frame: str = "frame", state: str = "state", action: str = "action") -> DataFrame:
    """``key, frame, dim, state, action`` scaled as ``l2_scores`` does, for plots.

    Inactive dimensions, and episodes under two frames or without an active dimension, keep their own values.
    """
    both = F.arrays_zip(F.col(state).cast("array<double>").alias("s"), F.col(action).cast("array<double>").alias("a"))
    cells = frames.select(key, frame, F.posexplode(both).alias("dim", "v")).select(key, frame, "dim", F.col("v.s").alias("s"), F.col("v.a").alias("a"))
    dims = cells.groupBy(key, "dim").agg(
        F.least(F.min("s"), F.min("a")).alias("lo"), F.greatest(F.max("s"), F.max("a")).alias("hi"), F.stddev_pop("s").alias("ds"), F.stddev_pop("a").alias("da"), F.count("*").alias("n")
    )
    active = (F.col("n") >= 2) & (F.col("hi") - F.col("lo") >= 0.05) & ~((F.col("ds") < 1e-3) & (F.col("da") < 1e-3))
    rows = cells.join(dims.select(key, "dim", "lo", "hi", active.alias("active")), [key, "dim"])
    scaled = lambda x: F.when(F.col("active"), (F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col(x))
    return rows.select(key, frame, "dim", scaled("s").alias("state"), scaled("a").alias("action"))


def l2_reason(score: Column, threshold: Column) -> Column:
    """Null if the score is fine. NaN is tested first: in Spark it is larger than everything."""
    return F.when(score.isNull(), "no_valid_frames").when(F.isnan(score), "score_not_a_number").when(score > threshold, "l2_above_threshold")


def merge_reasons(sources: list[DataFrame], key: str = "episode_id") -> DataFrame:
    """``key, reasons``: the reasons of all sources in the sources' order, as a full outer join of any number of them would give."""
    tagged = [s.select(key, F.lit(i).alias("src"), "reason") for i, s in enumerate(sources)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("src", "reason"))), lambda r: r["reason"]).alias("reasons"))


def reason_breakdown(merged: DataFrame, distance: list[str]) -> DataFrame:
    """Counts of episodes flagged for distance only, for other reasons only, for both; and in all."""
    is_distance = lambda r: r.isin(distance)
    some, every = F.exists("reasons", is_distance), F.forall("reasons", is_distance)
    return merged.agg(F.count_if(every).alias("only_distance"), F.count_if(~some).alias("only_other"), F.count_if(some & ~every).alias("both"), F.count("*").alias("n_flagged"))


def distribution(df: DataFrame, column: str, finite_only: bool = True) -> DataFrame:
    """Mean, median, population deviation, extremes and upper percentiles; infinite values are counted apart."""
    x = F.col(column)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    value = F.when(~bad, x) if finite_only else F.when(~(x.isNull() | F.isnan(x)), x)
    plain = df.agg(
        F.count(value).alias("n"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return beside(plain, quantiles(df.select(value.alias("_v")), [], "_v", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}), [])


def comparable_slots(slots: str | list[str]) -> list[str]:
    """Slots to compare as a list; grippers aren't compared and are refused."""
    found = [slots] if isinstance(slots, str) else list(slots)
    if wrong := [s for s in found if "gripper" in s]:
        raise ValueError(f"grippers can't be compared: {wrong}")
    return found
