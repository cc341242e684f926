"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact set intersection.

Every text becomes its set of word shingles. Sizes fall into bands whose limits grow by 1 / threshold, so linked sets lie
in one band or in two neighbours; a *tile* is such a pair of bands. Linked sets of a tile differ in at most ``d`` elements,
which the tile's largest sizes bound. Each set is cut by hash range into ``d + 1 + spare`` cells, so at least ``spare + 1``
cells are equal in both: equal cells are found
by one exchange of their 6-byte keys, packed by part of the key space and grouped by a sort in numpy. Among the sets of a live cell
the bit counts of 2048-bit signatures bound the overlap from above, and only what passes is intersected exactly. Empty cells
prove nothing and give no key, unless a set has more of them than ``spare``; then they do, so no link is lost.

Sets in one cell are compared with its smallest member first. What that leaves in different components is compared in
blocks of at most ``2 * BLOCK`` members, on bitmaps, and each pair in one cell as a rule: no group has to fit into one task
and no list of all pairs is made.
Equal sets are handled once whatever the number of copies.

Null and empty texts, and texts of white space only, have empty sets and no links. Ties do not arise: a component is named
by its smallest document. Repeated rows of a document count once in the result's order but keep their rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import doc_text, drop, forget, join_spread, likely, pieces, slabs, small_batches, stash
from tidewell.llm.graph import components, merged
from tidewell.llm.textkit import U64, mix, shingle_sets

SIGNATURE_WORDS = 32  # 2048 bits
BLOCK = 1024
HELD_KEYS = 1_000_000
_LOW = U64((1 << 48) - 1)
_KEYS = "doc_id long, n_shingles long, lo long, hi long, part int, cells binary"
_MET = "doc_id long, n_shingles long, lo long, hi long, key long"
_CELL = -1  # in the place of a set's size: this row is no document's
_SETS = "node long, n long, sig array<long>, shingles binary"


class Tiles:
    """Bands and cells for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.limits = num, den, [1]

    def band(self, n: int) -> int:
        while self.limits[-1] <= n:  # the next band starts above every size linked with the band's first
            self.limits.append(max(self.limits[-1] + 1, self.limits[-1] * self.den // self.num + 1))
        return int(np.searchsorted(self.limits, n, side="right")) - 1

    def cells(self, tile: int) -> tuple[int, int]:
        """Number of cells and spare ones of the tile that holds bands ``tile`` and ``tile + 1``."""
        self.band(self.top(tile))
        small, large = self.limits[tile + 1] - 1, self.limits[tile + 2] - 1
        most = small + min(large, small * self.den // self.num)
        most = max(most, 2 * small)
        d = most * (self.den - self.num) // (self.den + self.num)
        k, n, spare = d + 1, self.limits[tile], 0
        if d:
            for _ in range(4):
                empty = k * math.exp(-n / k)
                spare = math.ceil(empty + 4 * math.sqrt(empty))
                k = d + 1 + spare
        return k, spare

    def top(self, tile: int) -> int:
        while len(self.limits) < tile + 3:
            self.limits.append(max(self.limits[-1] + 1, self.limits[-1] * self.den // self.num + 1))
        return self.limits[tile + 2]

    def keys(self, s: np.ndarray) -> np.ndarray:
        out, band = [], self.band(len(s))
        mixed = mix(s + U64(0x51ED270B))
        for tile in (band, band - 1):
            if tile < 0:
                continue
            k, spare = self.cells(tile)
            cell = ((s >> U64(32)) * U64(k)) >> U64(32)  # the set is sorted, so cells are runs
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            body = np.add.reduceat(mixed, first)
            at = cell[first]
            if k - len(at) > spare:
                none = np.setdiff1d(np.arange(k, dtype=U64), at)
                at, body = np.concatenate((at, none)), np.concatenate((body, np.zeros(len(none), dtype=U64)))
            out.append(mix(mix(at + U64(tile) * U64(0x1000003D)) + body))
        return np.concatenate(out)


def signature(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SIGNATURE_WORDS, dtype=np.uint8)
    bits[(s & U64(64 * SIGNATURE_WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        lo, hi = mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64)
    return int(lo.view(np.int64)), int(hi.view(np.int64))


def _keyed(words: int, num: int, den: int, parts: int):
    """A row per document with its set's name, and rows of packed cell keys for each of ``parts`` parts of the key space.

    Both kinds go through one exchange, so the keys are on disk once. Numbers are never null, as pandas would make them floats.
    """

    def packed(names: list[int], keys: list[np.ndarray]) -> pd.DataFrame:
        sizes = [len(k) for k in keys]
        flat, owner = np.concatenate(keys), np.repeat(np.array(names, dtype=np.int64), sizes)
        part = (((flat >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        flat, owner, part = flat[order], owner[order], part[order]
        edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        rows = []
        for a, b in zip(edge[:-1], edge[1:]):
            first = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
            runs = np.diff(np.append(first, b - a)).astype("<u4")
            low = (flat[a:b] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((int(part[a]), len(first).to_bytes(4, "little") + owner[a:b][first].astype("<i8").tobytes() + runs.tobytes() + low.tobytes()))
        return pd.DataFrame(rows, columns=["part", "cells"]).assign(doc_id=0, n_shingles=_CELL, lo=0, hi=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        tiles, seen = Tiles(num, den), OrderedDict()
        names, keys, held = [], [], 0
        for pdf in slabs(batches):
            rows = []
            for doc_id, s in zip(pdf.doc_id, shingle_sets(pdf.text.tolist(), words)):
                name = _name(s)
                rows.append((doc_id, len(s), *name, int(mix(np.array([doc_id]).astype(U64))[0]) % parts, None))
                if len(s) and name not in seen:  # copies met before in this task have the same keys
                    names.append(name[0])
                    keys.append(tiles.keys(s))
                    held += len(keys[-1])
                    seen[name] = None
                    if len(seen) > 20_000:
                        seen.popitem(last=False)
                    if held >= HELD_KEYS:
                        yield packed(names, keys)
                        names, keys, held = [], [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "lo", "hi", "part", "cells"])
        if names:
            yield packed(names, keys)

    return run


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``key, lo`` for the cells of this task's parts that two or more different sets share; documents' rows as they came."""
    forget()
    keys, owners = [], []
    for pdf in batches:
        own = pdf.n_shingles != _CELL
        if own.any():
            yield pdf.loc[own, ["doc_id", "n_shingles", "lo", "hi"]].assign(key=0)
            pdf = pdf[~own]
        for part, blob in zip(pdf.part, pdf.cells):
            n = int.from_bytes(blob[:4], "little")
            names = np.frombuffer(blob, dtype="<i8", count=n, offset=4)
            runs = np.frombuffer(blob, dtype="<u4", count=n, offset=4 + 8 * n)
            low = np.zeros((int(runs.sum()), 8), dtype=np.uint8)
            low[:, :6] = np.frombuffer(blob, dtype=np.uint8, offset=4 + 12 * n).reshape(-1, 6)
            keys.append(low.view("<u8").ravel() | (U64(part & 0xFFFF) << U64(48)))
            owners.append(np.repeat(names, runs))
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    keys.clear(), owners.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    found = pd.DataFrame({"key": key[shared].view(np.int64), "lo": owner[order[shared]]}).drop_duplicates()
    found = found[found.duplicated("key", keep=False)]  # the same set from two tasks is no meeting
    found = found.assign(doc_id=0, n_shingles=_CELL, hi=0)
    for at in range(0, len(found), 100_000):
        yield found.iloc[at : at + 100_000]


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in slabs(batches):
            rows = [(node, len(s), signature(s), s.tobytes()) for node, s in zip(pdf.node, shingle_sets(pdf.text.tolist(), words))]
            yield pd.DataFrame(rows, columns=["node", "n", "sig", "shingles"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two sorted runs are merged
    return int((both[1:] == both[:-1]).sum())


def _linked(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in batches:
            keep = []
            for x, y in zip(pdf.shingles_a, pdf.shingles_b):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                inter = _overlap(x, y)
                keep.append(inter * den >= num * (len(x) + len(y) - inter))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _tile_pairs(num: int, den: int):
    """Pairs that bit counts let pass and that lie in different components, from many block pairs at once.

    A pair that shares a smaller cell than this one, as its members' first two cells tell, has been met there.
    """

    def pairs(key: int, left: pd.DataFrame, right: pd.DataFrame) -> list[tuple[int, int]]:
        sig_l, sig_r = (np.stack(x.sig.to_list()).view(U64) for x in (left, right))
        n_r, node_r, comp_r, one_r, two_r = (right[c].to_numpy() for c in ("n", "node", "component", "one", "two"))
        out = []
        for node, comp, n, one, two, sig in zip(*(left[c].tolist() for c in ("node", "component", "n", "one", "two")), sig_l):
            fresh = comp_r != comp
            if one < key:
                fresh &= (one_r != one) & (two_r != one)
            if two < key:
                fresh &= (one_r != two) & (two_r != two)
            at = np.flatnonzero(fresh)
            if len(at):
                apart = np.bitwise_count(sig_r[at] ^ sig).sum(axis=1, dtype=np.int64)
                most = (n + n_r[at] - apart) // 2
                ok = at[most * den >= num * (n + n_r[at] - most)]
                out += [(min(node, x), max(node, x)) for x in node_r[ok].tolist()]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "p", "q"], kind="stable").reset_index(drop=True)
        names = pdf[["key", "p", "q"]].to_numpy()
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        out: set[tuple[int, int]] = set()
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[a:b]
            left, right = part[part.side != 1], part[part.side != 0]  # side 2 is a block met with itself
            if len(left) and len(right):
                out.update(pairs(int(names[a, 0]), left, right))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return run


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are linked. Sets are fetched only for pairs that sizes and bit counts let pass."""
    small = sets.select("node", "n", "sig")
    for side in "ab":
        pairs = pairs.join(small.toDF(side, f"n_{side}", f"sig_{side}"), side)
    apart = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.expr("(n_a + n_b - apart) div 2")
    pairs = pairs.withColumn("apart", apart).withColumn("most", most).where(F.expr(f"most * {den} >= {num} * (n_a + n_b - most)")).select("a", "b")
    pairs = stash(pairs, "shingle-pairs")
    ends = stash(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "shingle-ends")
    full = likely(sets.select("node", "shingles"), "node", ends)
    for side in "ab":
        pairs = pairs.join(full.toDF(side, f"shingles_{side}"), side)
    return pairs.mapInPandas(_linked(num, den), "a long, b long")


def shingle_components(documents: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Columns ``doc_id, n_shingles, component_id`` of ``documents(doc_id, text, ...)``.

    Two documents are linked when ``den * |A & B| >= num * |A | B|`` over their sets of distinct ``words``-word shingles.
    """
    small_batches(documents.sparkSession)
    docs = doc_text(documents)
    total = docs.count()
    parts = pieces(total, 4_000)
    stored = docs.where("doc_id is not null").mapInPandas(_keyed(words, num, den, parts), _KEYS)
    met = stash(stored.repartition(parts, "part").mapInPandas(_met, _MET), "shingle-names")
    keyed = met.where(F.col("n_shingles") != _CELL).select("doc_id", "n_shingles", "lo", "hi")
    named = keyed.where("n_shingles > 0")
    nodes = named.groupBy("lo", "hi").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    cells = met.where(F.col("n_shingles") == _CELL).select("key", "lo")
    members = stash(cells.join(nodes, "lo").select("key", "node"), "shingle-cells")

    wanted = stash(members.select("node").distinct(), "shingle-nodes")
    texts = likely(docs, "doc_id", wanted.select(F.col("node").alias("key"))).join(wanted, F.col("doc_id") == wanted.node).select("node", "text").dropDuplicates(["node"])
    sets = stash(texts.mapInPandas(_sets(words), _SETS), "shingle-sets")
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    star = stash(members.join(hubs, "key").where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "shingle-star")
    # every set is held against its smallest hub first; what that links needs no further look
    edges = stash(_verify(star.groupBy("b").agg(F.min("a").alias("a")), sets, num, den), "shingle-links")
    comp = components(edges)
    drop(edges)
    for step in ("star", "blocks"):
        if step == "star":
            more = _verify(_apart(star, comp), sets, num, den)
        else:
            placed = members.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
            mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("x <> y and size > 2")
            mixed = mixed.groupBy("size", "who").agg(F.min("key").alias("key"))  # equal groups once
            rest = stash(placed.join(mixed.select("key", "size"), "key"), "shingle-rest")
            if rest.isEmpty():
                drop(rest)
                continue
            more = _verify(_block_pairs(rest, sets, num, den), sets, num, den)
        found = stash(more, "shingle-links")
        if not found.isEmpty():
            comp = merged(comp, found)
        drop(found, rest if step == "blocks" else found)

    home = stash(nodes.join(comp, "node", "left").select("lo", "hi", F.coalesce("component", "node").alias("component_id"), "copies"), "shingle-homes")
    drop(members, sets, star, comp)
    linked = join_spread(named, home, ["lo", "hi"], "copies", total).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(keyed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for side in "ab":
        pairs = pairs.join(comp.toDF(side, f"c_{side}"), side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    return pairs.where("c_a <> c_b").select("a", "b")


def _block_pairs(rest: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs inside the groups of ``rest`` that bit counts let pass; many pairs of blocks share a task."""
    first = F.slice(F.array_sort(F.collect_set("key")), 1, 2)  # a set has at most as many cells as elements
    firsts = rest.groupBy("node").agg(first.alias("f")).select("node", F.get("f", F.lit(0)).alias("one"), F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("two"))
    blocks = F.ceil(F.col("size") / BLOCK)
    cut = rest.join(sets.select("node", "n", "sig"), "node").join(firsts, "node").withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", "component", "n", "sig", "one", "two", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1).alias("side")
    )
    tiles = pieces(rest.count(), 4_000)
    met = met.withColumn("tile", F.pmod(F.xxhash64("key", "p", "q"), F.lit(tiles)))
    return met.groupBy("tile").applyInPandas(_tile_pairs(num, den), "a long, b long").distinct()
