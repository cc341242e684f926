"""Exact top-k by inner product, with a three-phase uniform threshold.

A vector's dimensions are dealt to ``lists`` equal parts; each part is a score list: the inner products over its dimensions.
The total score is the sum over the lists.

1. In the blocks of rows that are probed (one of ``PROBED``, and the block with the longest vectors) every query gathers the ``k`` best entries of each local list.
   Their totals give a k-th best, a cutoff that no result falls below.
2. The cutoff goes back with the query blocks. A block pair whose bound (the sum over the lists of the products of its longest norms) is below
   all cutoffs isn't met at all. In the others an entry that can matter has ``cutoff / lists`` or more in some list, so those
   entries are sufficient; a list whose bound is below that has none and isn't computed.
3. What is left is resolved: the scores that are missing are looked up for these entries alone, totals are summed, and those that
   reach the cutoff are ranked.

Components are floored multiples of ``scale`` and kept as doubles, which hold them exactly. Products are done in single or double
precision where every partial sum stays below the width of the mantissa; elsewhere the lists are held against the threshold
with room for rounding, and the totals of what passes are summed as Python integers. A total beyond 64 bits becomes the nearest that fits.

Rows are cut into blocks by width, length and hash. Queries meet rows of their own width only. Vectors that are null, empty,
or hold null or non-finite components take no part. Ties go to the smaller id. Rows that repeat an id are rows of their own:
each is a candidate for all others and, where its id is one of a query, a query. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import drop, join_spread, stash

QUERIES_A_BLOCK = 4096
ROWS_A_BLOCK = 16_384
PROBED = 8
_STRIP = 128
_MOST = 2**63 - 1
_ENTRY = "asked long, query_id long, row long, vec_id long, score long"
_SAFE = 1 + 1e-9  # over the rounding of norms and their products


def _parts(width: int, lists: int) -> list[np.ndarray]:
    return [p for p in np.array_split(np.arange(width), lists) if len(p)]


def _norm(x: np.ndarray) -> float:
    top = float(np.abs(x).max(initial=0))
    return min(top * float(np.sqrt(((x / top) ** 2).sum())), 1e308) if top else 0.0


def _packed(scale: int, lists: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            with np.errstate(over="ignore"):
                for v in pdf.embedding:
                    x = np.clip(np.floor(scale * np.asarray(v, dtype=np.float64)), -1e308, 1e308)
                    norms = [_norm(x[p]) for p in _parts(len(x), lists)]
                    length = _norm(np.array(norms))
                    size = int(np.floor(2 * np.log2(length))) if length else -10_000
                    out.append((len(x), size, norms + [0.0] * (lists - len(norms)), x.astype("<f8").tobytes()))
            part = pd.DataFrame(out, columns=["width", "size", "norms", "vec"])
            part.insert(0, "vec_id", pdf.vec_id.to_numpy())
            part.insert(0, "row", pdf.row.to_numpy())
            yield part

    return run


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def _whole(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of two vectors of whole doubles, as a 64-bit number."""
    total = sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))
    return max(-_MOST, min(_MOST, total))


def _tile(k: int, lists: int, cut: bool):
    """The ``k`` best entries per query of a block of queries met with a block of rows; with ``cut`` only those that reach the cutoff."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _ENTRY.split(", ")})
        full_q, full_r = _matrix(queries.vec), _matrix(rows.vec)
        width = full_q.shape[1]
        with np.errstate(over="ignore"):
            bound = width * float(np.abs(full_q).max()) * float(np.abs(full_r).max())
        exact = bound < 2**53
        kind = np.float32 if bound < 2**24 else np.float64
        q, r = full_q.astype(kind), full_r.astype(kind)
        ids, row, own, own_id = (x.to_numpy() for x in (rows.vec_id, rows.row, queries.row, queries.vec_id))
        parts = _parts(width, lists)
        longest = np.array(rows.norms.to_list()).max(axis=0) * np.array(queries.norms.to_list()).max(axis=0) * _SAFE
        out = []
        for at in range(0, len(q), _STRIP):
            strip, names = q[at : at + _STRIP], own[at : at + _STRIP]
            scores: list[np.ndarray | None] = [None] * len(parts)
            picked = np.zeros((len(strip), len(r)), dtype=bool)
            if cut:
                cutoff = queries.cutoff.to_numpy()[at : at + _STRIP]
                share = cutoff.astype(np.float64)[:, None] / len(parts)
                room = 0.0 if exact else bound * width * 2.0**-50 + np.abs(share) * 2.0**-50
            for n, p in enumerate(parts):
                if cut and longest[n] < (share - room).min():
                    continue  # no entry of this list suffices
                with np.errstate(over="ignore", invalid="ignore"):
                    scores[n] = strip[:, p] @ r[:, p].T
                    if cut:
                        picked |= ~(scores[n] < share - room)
                    else:
                        few = min(k + 1, len(r))  # one more: a query may meet itself
                        np.put_along_axis(picked, np.argpartition(scores[n], len(r) - few, axis=1)[:, -few:], True, axis=1)
            picked &= names[:, None] != row[None, :]
            x, y = np.nonzero(picked)
            if exact:
                total = np.zeros(len(x), dtype=np.int64)
                for p, s in zip(parts, scores):  # a list that wasn't computed is looked up
                    some = s[x, y] if s is not None else np.einsum("ij,ij->i", full_q[at + x][:, p], full_r[y][:, p])
                    total += np.rint(some).astype(np.int64)
            else:
                total = np.array([_whole(full_q[at + i], full_r[j]) for i, j in zip(x, y)], dtype=np.int64)
            if cut:
                keep = total >= cutoff[x]
                x, y, total = x[keep], y[keep], total[keep]
            out.append(pd.DataFrame({"asked": names[x], "query_id": own_id[at + x], "row": row[y], "vec_id": ids[y], "score": total}))
        found = pd.concat(out)
        found = found.sort_values(["asked", "score", "vec_id", "row"], ascending=[True, False, True, True])
        return found.groupby("asked").head(k)  # the best k of a tile hold all of its share

    return run


def _meet(queries: DataFrame, rows: DataFrame, tiles: DataFrame, run) -> DataFrame:
    """``run`` over the pairs of blocks that ``tiles(width, qpart, size, part)`` names, a task holding one pair at a time."""
    name = ["width", "qpart", "size", "part"]
    left = queries.join(tiles, ["width", "qpart"]).groupBy(*name)
    return left.cogroup(rows.join(tiles, ["width", "size", "part"]).groupBy(*name)).applyInPandas(run, _ENTRY)


def _longest(lists: int, name: str) -> list[Column]:
    return [F.max(F.get("norms", F.lit(n))).alias(f"{name}{n}") for n in range(lists)]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, lists: int = 2, scale: int = 256) -> DataFrame:
    """Columns ``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding, ...)`` whose id is divisible by ``every``."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size("embedding") > 0))
    numbered = usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    packed = stash(numbered.mapInPandas(_packed(scale, lists), "row long, vec_id long, width int, size int, norms array<double>, vec binary"), "vectors")
    count = lambda df, most, *by: df.groupBy(*by).agg(F.count("*").alias("copies"), F.ceil(F.count("*") / most).alias("blocks"))
    rows = join_spread(packed, count(packed, ROWS_A_BLOCK, "width", "size"), ["width", "size"], "copies", packed.count())
    rows = stash(rows.withColumn("part", F.expr("pmod(xxhash64(row), blocks)")).drop("blocks"), "blocks")
    drop(packed)
    asked = rows.where(F.col("vec_id") % every == 0).drop("size", "part")
    asked = join_spread(asked, count(asked, QUERIES_A_BLOCK, "width"), ["width"], "copies", asked.count())
    asked = stash(asked.withColumn("qpart", F.expr("pmod(xxhash64(row, 1), blocks)")).drop("blocks"), "asked")

    blocks = stash(rows.groupBy("width", "size", "part").agg(*_longest(lists, "r")), "block-norms")
    top = blocks.groupBy("width").agg(F.max(F.struct("size", "part")).alias("top"))
    probed = blocks.join(top, "width").where((F.pmod(F.xxhash64("size", "part"), F.lit(PROBED)) == 0) | (F.struct("size", "part") == F.col("top")))
    tiles = stash(asked.select("width", "qpart").distinct().join(probed.select("width", "size", "part"), "width"), "tiles")
    best = W.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    first = _meet(asked, rows, tiles, _tile(k, lists, False)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoff = first.groupBy("asked").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    told = stash(asked.join(cutoff, asked.row == cutoff.asked, "left").drop("asked").withColumn("cutoff", F.coalesce("cutoff", F.lit(-_MOST))), "cutoffs")

    limits = told.groupBy("width", "qpart").agg(F.min("cutoff").alias("low"), *_longest(lists, "q"))
    reach = F.lit(0.0)
    for n in range(lists):
        reach = reach + F.col(f"q{n}") * F.col(f"r{n}")
    old, tiles = tiles, stash(limits.join(blocks, "width").where(reach * _SAFE >= F.col("low").cast("double")).select("width", "qpart", "size", "part"), "tiles")
    last = stash(_meet(told, rows, tiles, _tile(k, lists, True)), "best")
    drop(rows, asked, blocks, told, old, tiles)
    return last.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
