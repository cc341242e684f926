"""Best-fit packing into sequences of a fixed length.

Documents are turned into ids and a closing id; longer ones are cut into pieces of ``length`` ids. Pieces are dealt by hash
to streams. A stream is packed online and in bounded space: it has ``open_bins`` open sequences, kept in buckets by free
space with a bitset over the non-empty ones, so the tightest fit is a bit operation. When no open sequence fits and none
may be opened, the fullest closes first. A window of pieces, smaller than the number of bins, waits before them and leaves longest
first, which a bounded buffer allows and which packs tighter than arrival order.

A null or empty text is one piece with the closing id alone. Repeated rows are packed as often as they come; pieces of one
document carry its ``doc_id`` and a number from 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import doc_text, forget, pieces, slabs, small_batches, stash
from tidewell.llm.transducer import transducer

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best fit over a fixed number of open bins."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.most, self.count, self.opened = length, open_bins, 0, 0
        self.filled = 0  # bit f is set while some open bin has f ids free
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, n: int) -> tuple[int, int]:
        """Place a piece of ``n`` ids: its sequence and its offset there."""
        if n == self.length:
            self.count += 1
            return self.count - 1, 0
        fitting = self.filled >> n
        if fitting:
            free = n + ((fitting & -fitting).bit_length() - 1)
            name = self._take(free)
        else:
            if self.opened == self.most:
                self._take((self.filled & -self.filled).bit_length() - 1)  # the fullest closes
            name, free = self.count, self.length
            self.count += 1
        if free > n:
            self._keep(free - n, name)
        return name, self.length - free

    def _take(self, free: int) -> int:
        held = self.bins[free]
        name = held.pop()
        self.opened -= 1
        if not held:
            self.filled ^= 1 << free
        return name

    def _keep(self, free: int, name: int) -> None:
        self.bins[free].append(name)
        self.filled |= 1 << free
        self.opened += 1


def _cut(path: str, length: int, closing: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for pdf in slabs(batches):
            rows = []
            for doc_id, ids in zip(pdf.doc_id, machine.run(pdf.text.tolist(), ids=True)):
                ids = np.append(ids, closing).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _packed(length: int, open_bins: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        forget()
        bins, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 40

        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            at = np.array([bins.put(n) for n in pdf.length.tolist()], dtype=np.int64).reshape(-1, 2)
            return pdf.assign(sequence_id=at[:, 0] + base, offset=at[:, 1])

        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= window:
                yield place(pd.concat(held))
                held, size = [], 0
        if held:
            yield place(pd.concat(held))

    return run


def pack(documents: DataFrame, path: str, length: int = 4096, closing: int = 1, open_bins: int = 8192, window: int = 4096) -> DataFrame:
    """Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row for each piece."""
    small_batches(documents.sparkSession)
    cut = doc_text(documents).mapInPandas(_cut(path, length, closing), _PIECES)
    cut = stash(cut, "pieces")  # ids are made once; what is dealt below is some 40 bytes a piece
    streams = pieces(cut.count(), 60_000)
    # in a fixed order, so that a task that runs again gives the same sequences
    dealt = cut.repartition(streams, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInPandas(_packed(length, open_bins, window), _PIECES + ", sequence_id long, offset long")
