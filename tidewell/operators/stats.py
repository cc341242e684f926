"""Statistics by vector dimension, their mixtures, and sampling weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.picks import draws
from tidewell.operators.ordered import beside, quantiles


def by_dimension(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """``by, dim, mean, std, min, max, q01, q99, n``: a group per dimension, so no aggregate holds whole vectors or all of its values."""
    cells = df.select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    plain = cells.groupBy(*by, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("*").alias("n"))
    return beside(plain, quantiles(cells, [*by, "dim"], "x", {"q01": 0.01, "q99": 0.99}), [*by, "dim"])


def as_arrays(stats: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with an array per statistic, in the order of the dimensions."""
    names = ("mean", "std", "min", "max", "q01", "q99")
    rows = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("dim", *names))).alias("_s"))
    return rows.select(*by, *[F.col(f"_s.{n}").alias(n) for n in names])


def with_stats(df: DataFrame, vector: str) -> DataFrame:
    """Rows with the statistics of all rows as array columns: a single row, read as a subquery."""
    whole = as_arrays(by_dimension(df, vector, []), [])
    names = ("mean", "std", "min", "max", "q01", "q99")
    packed = whole.select(F.struct(*names).alias("s"))
    return df.withColumn("_stats", packed.scalar()).withColumns({f"st_{n}": F.col("_stats")[n] for n in names}).drop("_stats")


def mixture(stats: DataFrame, weights: DataFrame, tag: str = "tag", weighted_quantiles: bool = True) -> DataFrame:
    """Statistics of a weighted mixture by tag and dimension; weights are normalised per tag."""
    w = weights.withColumn("w", F.col("weight") / F.sum("weight").over(W.partitionBy(tag)))
    rows = stats.join(w.select(tag, "dataset", "w"), "dataset")
    mean = F.sum(F.col("w") * F.col("mean"))
    second = F.sum(F.col("w") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean")))
    low, high = (F.sum(F.col("w") * F.col("q01")), F.sum(F.col("w") * F.col("q99"))) if weighted_quantiles else (F.min("q01"), F.max("q99"))
    out = rows.groupBy(tag, "dim").agg(mean.alias("mean"), second.alias("_s"), F.min("min").alias("min"), F.max("max").alias("max"), low.alias("q01"), high.alias("q99"))
    return out.withColumn("std", F.sqrt(F.greatest(F.col("_s") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_s")


def conflicting_tags(metadata: DataFrame, tag: str, fields: list[str]) -> DataFrame:
    """Tags whose datasets disagree on a field; none is what merging requires."""
    rows = metadata.groupBy(tag).agg(*[F.count_distinct(f).alias(f) for f in fields])
    wrong = F.filter(F.array(*[F.when(F.col(f) > 1, f) for f in fields]), lambda x: x.isNotNull())
    return rows.select(tag, wrong.alias("fields")).where(F.size("fields") > 0)


def without_repeats(entries: DataFrame, order: str) -> DataFrame:
    """Mixture entries by (dataset, robot_type), the first wins."""
    w = W.partitionBy("dataset", "robot_type").orderBy(order)
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sampling_weights(datasets: DataFrame, balance: bool = True, floor: float = 1e-8) -> DataFrame:
    """``p``: weight, times length where balanced by size, floored and normalised. One row per dataset."""
    raw = F.col("weight") * F.col("length") if balance else F.col("weight")
    rows = datasets.withColumn("_w", F.greatest(raw.cast("double"), F.lit(floor)))
    return rows.withColumn("p", F.col("_w") / F.sum("_w").over(W.partitionBy())).drop("_w")


def epoch_length(datasets: DataFrame) -> DataFrame:
    """Steps until every primary dataset (weight 1 or more) has been seen once."""
    return datasets.where("weight >= 1").agg(F.floor(F.max(F.col("length") / F.col("p"))).cast("long").alias("epoch_length"))


def weighted_draws(datasets: DataFrame, n: int, seed: int) -> DataFrame:
    """``draw, dataset, step``: ``n`` draws with replacement, a dataset by its ``p``, then a step uniformly.

    Cumulative weights become a sorted array in one row (a row per dataset, few by nature); each draw finds its interval in
    it, so draws are never joined to ranges.
    """
    w = W.orderBy("dataset").rowsBetween(W.unboundedPreceding, 0)
    upto = datasets.withColumn("upto", F.sum("p").over(w))
    table = upto.agg(F.sort_array(F.collect_list(F.struct("upto", "dataset", "length"))).alias("t"))
    first, second = draws(n, seed, datasets), draws(n, seed + 1, datasets).withColumnRenamed("u", "v")
    rows = first.join(second, "draw").withColumn("_t", table.scalar())
    rows = rows.withColumn("_hit", F.coalesce(F.get(F.filter("_t", lambda s: s["upto"] > F.col("u")), F.lit(0)), F.element_at("_t", -1)))
    return rows.select("draw", F.col("_hit.dataset").alias("dataset"), F.floor(F.col("v") * F.col("_hit.length")).cast("long").alias("step"))
