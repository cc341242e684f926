"""Which frames of a sequence to take: arrays of positions from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _line(n: Column, m: Column) -> Column:
    """``m`` evenly placed positions of 0 .. n - 1, both ends among them, cut to whole numbers."""
    steps = F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1)
    return F.transform(steps, lambda i: F.when(m <= 1, F.lit(0)).otherwise(F.floor(i * (n - 1) / F.greatest(m - 1, F.lit(1)))).cast("int"))


def by_rate(n: Column, fps: float, target: float, most: int) -> Column:
    """Every ``round(fps / target)``-th frame; if these are more than ``most``, that many evenly placed ones."""
    step = max(1, round(fps / target))
    few = F.sequence(F.lit(0), n - 1, F.lit(step))
    return F.when(n <= 0, F.array().cast("array<int>")).when(F.size(few) > most, _line(n, F.lit(most))).otherwise(few)


def by_ratio(n: Column, ratio: float) -> Column:
    """A share of the frames, one at least, evenly placed and without repeats."""
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.array_distinct(_line(n, F.greatest(F.lit(1), F.bround(n * F.lit(ratio))).cast("int"))))


def evenly(n: Column, most: int) -> Column:
    """All frames if they are no more than ``most``, else that many with the first and the last."""
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(_line(n, F.lit(most)))


def by_clip(n: Column, seconds: Column, interval: float, least: int, most: int) -> Column:
    """One frame each ``interval`` seconds, between ``least`` and ``most``, without repeats."""
    m = F.least(F.lit(most), F.greatest(F.lit(least), F.bround(seconds / F.lit(interval)))).cast("int")
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.array_distinct(_line(n, m)))


def by_interval(times: Column, fps: float) -> Column:
    """Of ascending times those that are due: each sets the next due time to itself plus ``1 / fps``."""
    start = F.struct(F.lit(float("-inf")).alias("due"), F.array().cast("array<double>").alias("kept"))
    return F.aggregate(
        times.cast("array<double>"), start,
        lambda t, x: F.struct(F.when(x >= t["due"], x + 1 / fps).otherwise(t["due"]).alias("due"), F.when(x >= t["due"], F.concat(t["kept"], F.array(x))).otherwise(t["kept"]).alias("kept")),
        lambda t: t["kept"],
    )


def quota(count: Column, total: Column, most: int) -> Column:
    """A view's share of ``most`` frames: by its part of the total, one at least; all if everything fits."""
    return F.when(total <= most, count).otherwise(F.greatest(F.lit(1), F.floor(count / total * most)).cast("long"))
