"""Running sums and exact quantiles over a whole order, without a task that holds all of it.

Rows are dealt to slices that follow one another in the order, sums are made within slices, and a window over one row per slice
adds what lies before. The limits between slices are approximate quantiles: they set only how even the slices are, and being
constants of the plan they give every retried task the same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 1024


def limits(df: DataFrame, order: str) -> list[float]:
    """At most ``SLICES`` - 1 values of ``order``, a number, that part ``df`` about evenly."""
    found = df.select(F.col(order).cast("double").alias("x")).where("NOT isnan(x)").approxQuantile("x", [k / SLICES for k in range(1, SLICES)], 0.5 / SLICES)
    return sorted(set(found or []))


def slice_of(x: Column, at: list[float]) -> Column:
    """How many of the sorted limits lie below ``x``, by binary search; 0 for null."""
    if not at:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(at).bit_length()))]
    table = F.lit(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: n + F.when(F.get(table, n + s - 1) < x.cast("double"), s).otherwise(0))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    met = F.lit(True)
    for k in keys:
        met = met & left[k].eqNullSafe(right[f"_r_{k}"])
    return met


def _right(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def _with_slices(df: DataFrame, by: list[str], order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_slice``, and ``*by, _slice, _before, _total``: what the earlier slices and all of them sum to."""
    rows = df.withColumn("_slice", slice_of(F.col(order), limits(df, order)))
    w = W.partitionBy(*by).orderBy("_slice")
    sums = rows.groupBy(*by, "_slice").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows, sums.withColumn("_before", before).withColumn("_total", F.sum("_sum").over(W.partitionBy(*by)))


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the same ``by`` up to this one in ``order``.

    ``order`` is a number that doesn't repeat within ``by``; null comes first. Null values add nothing; 0 where there are none else.
    """
    rows, per = _with_slices(df, by, order, value)
    keys = [*by, "_slice"]
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    right = _right(per.select(*keys, "_before"), keys)
    out = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(right, _same(out, right, keys)).withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``*by`` and a column per name in ``shares``: exact interpolated quantiles of the values that aren't null.

    Slices are counted in one pass that combines on the map side; only values of the slices that hold a wanted rank are shuffled and
    ordered, equal ones counted first. Groups without values have no row.
    """
    cells = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_x"), F.lit(1).alias("_n"))
    rows, per = _with_slices(cells, by, "_x", "_n")
    keys = [*by, "_slice"]
    place = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in shares.items()}
    holds = F.lit(False)
    for p in place.values():
        for rank in (F.floor(p), F.ceil(p)):
            holds = holds | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_sum")))
    right = _right(per.where(holds).select(*keys, "_before", "_total"), keys)
    near = rows.join(right, _same(rows, right, keys)).groupBy(*keys, "_before", "_total", "_x").agg(F.count("*").alias("_n"))
    last = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys).orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("_to", last).withColumn("_from", F.col("_to") - F.col("_n"))
    value_at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_x")))
    ends = [c for name, p in place.items() for c in (value_at(F.floor(p)).alias(f"_lo_{name}"), value_at(F.ceil(p)).alias(f"_hi_{name}"))]
    found = near.groupBy(*by).agg(F.max("_total").alias("_total"), *ends)
    between = lambda name, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_lo_{name}")).otherwise((F.ceil(p) - p) * F.col(f"_lo_{name}") + (p - F.floor(p)) * F.col(f"_hi_{name}"))
    return found.select(*by, *[between(name, p).cast("double").alias(name) for name, p in place.items()])


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on ``by`` where nulls equal each other; without keys ``right`` is one row, or none, read as a subquery."""
    if not by:
        new = [c for c in right.columns]
        return left.withColumn("_one", right.select(F.struct(*new)).scalar()).withColumns({c: F.col("_one")[c] for c in new}).drop("_one")
    renamed = _right(right, by)
    return left.join(renamed, _same(left, renamed, by), "left").drop(*[f"_r_{k}" for k in by])
