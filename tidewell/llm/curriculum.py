"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Time runs from 0 to 1. Source ``s`` is read at the rate ``T_s * (1 + a_s * (2 t - 1))``, where ``T_s`` are the words it is to
give and ``a_s`` in [-1, 1] tilts its schedule towards the start or the end. The integral of the rate is the cumulative
demand ``D_s(t) = T_s * ((1 - a_s) t + a_s t^2)``, which ends at ``T_s``. The documents of a source, in hash order, lie one
after the other on its stream of words; a document that begins at word ``c`` is read at the ``t`` with ``D_s(t) = c``. Beyond
the end of the source the stream starts over once, for the second copies.

The mix is range-sorted by position: the rows of ``mix`` by the time of their first copy, ``in_order`` by the time of each.

Targets share ``budget`` times all words by weight; none exceeds ``most`` times its source's words, and what it can't hold is
shared by weight among the others until none is above. That is water filling: the level is found from running sums over the
sources in the order of ``size / weight``.

Running sums of documents are taken in two steps (slices of a source by hash range, then inside a slice), so no source has
to fit into one task however large it is. The number of slices follows the number of rows.

A null or empty text has size 0, is taken for 0 words and has no position, so ``in_order`` leaves it out; if all are empty, all targets are 0. A
null source is a source of its own, last in order. Rows that repeat a doc_id are taken one by one, each for the words of its
own place on the stream; among equal ones it is open which has which place. ``in_order`` reads every row with such an id at
the times of one of them. Equal sizes are no ties, as places follow the hash of the id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import pieces, stash, unused

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """``source, source_size, target, tilt`` from ``source, source_size``: a row for each source, in code point order.

    One row per source reaches the window, so its single task holds a table as small as the list of sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("tilt", F.element_at(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), (F.col("place") % 3 + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("onward", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("all", F.sum("source_size").over(W.partitionBy()))
    rows = rows.withColumn("level", (F.col("all") * F.lit(float(budget)) - F.col("before")) / F.col("onward"))
    rows = rows.withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    rows = rows.withColumn("water", F.min(F.when(F.col("open"), F.struct("before", "place", "level"))).over(W.partitionBy())["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"), "tilt")


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Columns ``doc_id, size, source_size, target, taken, position, position_again, source``, range-sorted by ``position``.

    ``taken`` counts the words that the mix takes from a document, repeats included; the positions are the times at which
    its first and second copy are read, null where there is none. Documents that aren't read come last, equal positions by doc_id.
    """
    return _placed(documents, weights, budget, most, seed).sort(F.col("position").asc_nulls_last(), "doc_id")


def _placed(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of ``mix`` in no order."""
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = stash(sized.withColumn("spot", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    slices = pieces(sized.count(), 2_000, 1 << 20)
    # the hash's upper bits give the slice, so slices follow one another in hash order
    sized = sized.withColumn("slice", F.floor((F.shiftrightunsigned("spot", 33) * F.lit(slices)) / F.lit(1 << 31)))
    per_slice = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    per_slice = per_slice.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "slice_start")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most).withColumnRenamed("source", "t_source")
    inside = W.partitionBy("source", "slice").orderBy(F.shiftrightunsigned("spot", 2), "spot", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = sized.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(per_slice, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    start = F.col("slice_start") + F.col("upto") - F.col("size")
    goal = F.round("target").cast("long")
    share = lambda at: F.greatest(F.lit(0), F.least(F.col("size"), goal - at))
    again = start + F.col("source_size")
    first, second = share(start), share(again)
    return rows.select(
        "doc_id", "size", "source_size", "target", (first + second).alias("taken"),
        F.when(first > 0, _time(start)).alias("position"), F.when(second > 0, _time(again)).alias("position_again"), "source",
    )


def _time(at: Column) -> Column:
    """The ``t`` in [0, 1] with ``(1 - tilt) t + tilt t^2`` equal to the share of the target read so far."""
    share, tilt = at / F.col("target"), F.col("tilt")
    return F.least(F.lit(1.0), 2 * share / (1 - tilt + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)))


def in_order(documents: DataFrame, **how) -> DataFrame:
    """The columns of ``documents``, a row for each copy that the mix reads, range-sorted by training position."""
    columns = documents.columns
    doc, times, time = (unused(documents, n) for n in ("_doc", "_times", "_time"))
    plan = _placed(documents, **how).select(F.col("doc_id").alias(doc), F.filter(F.array("position", "position_again"), lambda x: x.isNotNull()).alias(times))
    plan = plan.where(F.size(times) > 0).dropDuplicates([doc])
    copies = documents.join(plan, documents["doc_id"] == plan[doc]).withColumn(time, F.explode(times))
    return copies.sort(time, doc).select(*columns)
