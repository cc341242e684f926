"""Helpers shared by the training-data operators: stored intermediate tables and sizes of work."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode (tests) only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scope:
    """Gathers the folders that are stashed while it is open, so that they can be deleted together.

    An operator's result reads its last tables until it has been written; who writes it closes the scope then.
    """

    def __init__(self) -> None:
        self.folders: set[str] = set()

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        _scopes.remove(self)

    def close(self, spark: SparkSession) -> None:
        for folder in sorted(self.folders):
            delete(spark, folder)
        self.folders.clear()


_scopes: list[Scope] = []
_stashed: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """A query that starts in here deletes its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell-{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].folders.add(path)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _stashed[back] = path
    return back


def drop(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = _stashed.pop(df, None)
        if path:
            delete(df.sparkSession, path)
            for scope in _scopes:
                scope.folders.discard(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


HOT_PARTS = 1000


def join_spread(rows: DataFrame, told: DataFrame, on: list[str], copies: str, total: int) -> DataFrame:
    """``rows`` joined with ``told``, which has a row per key and in ``copies`` the number of ``rows`` with that key.

    A key with more than a ``HOT_PARTS``-th of all ``total`` rows is looked up by broadcast (there are ``HOT_PARTS`` such keys
    at most), so no task gets all rows of it. The others meet in a join.
    """
    hot = F.col(copies) * HOT_PARTS > total
    few, others = F.broadcast(told.where(hot).drop(copies)), told.where(~hot).drop(copies)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(others, on))


def bitmap(spots: DataFrame, words: int) -> DataFrame:
    """One row with ``bits``, an array of ``words`` longs in which the bits numbered in ``spots(spot)`` are set."""
    each = spots.select(F.expr("spot div 64").alias("at"), F.expr("shiftleft(1L, cast(spot % 64 as int))").alias("bits"))
    every = spots.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    filled = each.unionByName(every).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits"))


def is_set(bits: Column, spot: Column) -> Column:
    word = F.get(bits, F.shiftright(spot, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, (spot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


MOST_BITS = 1 << 26  # 8 MB


def likely(rows: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``on`` isn't in ``keys(key)``, by a bitmap of a bounded size; a join follows."""
    size = 64 * max(1, min(MOST_BITS, 16 * keys.count()) // 64)
    spot = lambda key: F.pmod(F.xxhash64(key), F.lit(size))
    marks = stash(bitmap(keys.select(spot("key").alias("spot")), size // 64), "marks")
    name = unused(rows, "marks")
    return rows.withColumn(name, marks.scalar()).where(is_set(F.col(name), spot(on))).drop(name)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Let Arrow batches have ``rows`` rows and about ``size`` bytes at most: whole texts are long, and an executor runs several Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def pieces(rows: int, per_piece: int, most: int = 1 << 20) -> int:
    """How many tasks or buckets ``rows`` need at about ``per_piece`` each; grows with the input."""
    return max(1, min(most, -(-rows // per_piece)))


def doc_text(df: DataFrame) -> DataFrame:
    """The two columns that whole-text operators read."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slabs(batches: Iterator[pd.DataFrame], column: str = "text", most: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to about ``most`` characters of ``column``, a row at least; memory goes back between them.

    A batch has thousands of rows however long their texts are, and an executor runs several Python workers.
    """
    for pdf in batches:
        ends = np.cumsum([len(t) if t is not None else 0 for t in pdf[column]])
        at = 0
        while at < len(pdf):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield pdf.iloc[at:end]
            at = end
        del pdf
        release()


def release() -> None:
    """Give freed memory back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim is not None:
        trim(0)


_libc = ctypes.CDLL(None)


_kept: list[dict] = []


def kept() -> dict:
    """A cache for tables that one operator builds in a Python worker and wants again in its next task there."""
    _kept.append({})
    return _kept[-1]


def forget() -> None:
    """Empty all such caches: called where another operator's work begins, as workers are reused and an executor runs several."""
    if any(_kept):
        for cache in _kept:
            cache.clear()
        release()
