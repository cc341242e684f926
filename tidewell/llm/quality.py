"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors: one for every word, word pair and character n-gram of a word, looked up by hash in a
table of ``buckets`` rows. Word pairs are skip-bigrams: a word with each of the ``SKIPS`` before it, hashed by the exclusive or of the two words'
hashes and their distance; so a pair counts in either order, and all pairs of equal words share one vector. A linear layer and a softmax give the probabilities of the two labels. The table and the layer are
trained together by numpy stochastic gradient descent on the labelled documents, with a falling rate. For scoring, the
product of table and layer is taken once, so a feature costs one look-up; all words of every whole text count.

Training rows: ``train_rows`` at most, those with the smallest hash of their id, so the bound is a parameter and reruns take
the same rows. Each is sent to the driver as the ids and counts of all its features, partition by partition; ``train_rows``
times the features of a document, ``buckets`` at most, bounds what the driver holds. Scoring is a map over all rows; the model, ``4 * buckets`` bytes, goes with the task.

A null or empty text has no features and gets the score of the bias alone. Rows are scored one by one, so repeated rows and
extra columns don't matter; a label given twice counts once. Long texts are worked on window by window. No documents give no
rows. Without labelled rows, or with one label only, every score is that label's share (0.5 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import doc_text, forget, release, slabs, small_batches, stash
from tidewell.llm.textkit import U64, WINDOW, mix, windows, words_in

_GRAMS = (3, 4)
SKIPS = 3
_SPACES = b" \t\n\r\x0b\f"


class Features:
    """Hashed features of texts."""

    def __init__(self, buckets: int, skips: int = SKIPS) -> None:
        self.buckets, self.skips = buckets, skips

    def rows(self, texts: list[str | None], slab: int = 2 * WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts' places and the buckets of feature occurrences, as two arrays; a text's may come in several parts."""
        at = 0
        while at < len(texts):
            held, size, first = [], 0, at
            while at < len(texts) and (not held or size < slab):
                held.append((texts[at] or "").encode("utf-8", "surrogatepass").lower() + b"\n")
                size += len(held[-1])
                at += 1
            for place, hashes in self._slab(held):
                yield place + first, (hashes % U64(self.buckets)).astype(np.int64)

    def _slab(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        docs, words = [], []
        for a, b in windows(data):
            part = data[a:b]
            doc = np.searchsorted(ends, np.arange(a, b), side="right")
            yield from self._grams(part, doc)
            starts, hashes = words_in(part)
            docs.append(doc[starts])
            words.append(hashes)
        doc, word = np.concatenate(docs), np.concatenate(words)
        yield doc, word
        for k in range(1, min(self.skips, len(word) - 1) + 1):
            same = doc[k:] == doc[:-k]
            yield doc[k:][same], mix((word[k:] ^ word[:-k]) + U64(k))[same]

    @staticmethod
    def _grams(data: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        space = np.isin(data, np.frombuffer(_SPACES, dtype=np.uint8))
        word = np.cumsum(space)  # grams don't cross white space
        wide = data.astype(U64) + U64(1)
        rolled = wide
        for n in range(2, max(_GRAMS) + 1):
            if len(rolled) < 2:
                return
            rolled = rolled[:-1] * U64(0x100000001B3) + wide[n - 1 :]
            if n in _GRAMS:
                whole = (word[n - 1 :] == word[: len(rolled)]) & ~space[: len(rolled)]
                yield doc[: len(rolled)][whole], mix(rolled[whole] + U64(n))


class Model:
    """Hashed embedding table averaged per document, linear layer, softmax."""

    def __init__(self, buckets: int, width: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.table = draw.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
        self.layer = np.zeros((width, 2), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        """``rows``: buckets and their shares of the document, which sum to 1."""
        draw = np.random.default_rng(seed + 1)
        share = np.bincount(labels, minlength=2) / len(labels)
        balance = 0.5 / np.maximum(share, 1e-9)
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for i in draw.permutation(len(rows)):
                step = rate * (1 - done / steps)
                done += 1
                at, weight = rows[i]
                hidden = weight @ self.table[at] if len(at) else np.zeros(self.table.shape[1], dtype=np.float32)
                p = _softmax(hidden @ self.layer + self.bias)
                p[labels[i]] -= 1
                p *= balance[labels[i]]
                back = self.layer @ p
                self.layer -= step * np.outer(hidden, p)
                self.bias -= step * p
                if len(at):
                    self.table[at] -= step * weight[:, None] * back

    def weights(self) -> tuple[np.ndarray, float]:
        """Per bucket, and as bias, the difference of the two labels' logits."""
        apart = self.layer[:, 1] - self.layer[:, 0]
        return self.table @ apart, float(self.bias[1] - self.bias[0])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _featured(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        features = Features(buckets)
        for pdf in slabs(batches):
            parts: list[list[np.ndarray]] = [[] for _ in range(len(pdf))]
            for place, bucket in features.rows(pdf.text.tolist()):
                order = np.argsort(place, kind="stable")
                place, bucket = place[order], bucket[order]
                seen, first = np.unique(place, return_index=True)
                for i, b in zip(seen, np.split(bucket, first[1:])):
                    parts[i].append(b)
            out = []
            for i, held in enumerate(parts):
                if held:
                    at, n = np.unique(np.concatenate(held), return_counts=True)
                    out.append((pdf.doc_id.iat[i], int(pdf.quality.iat[i]), at.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "at", "n"])

    return run


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = 5000, buckets: int = 1 << 18, width: int = 8, epochs: int = 4, rate: float = 6.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """The scoring weights learned from ``labels(doc_id, quality)``, of which the caller keeps held-out rows away."""
    small_batches(documents.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").dropDuplicates(["doc_id"])
    marked = marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(train_rows)
    chosen = doc_text(documents).join(F.broadcast(marked), "doc_id")  # train_rows bounds its size
    got = stash(chosen.select("doc_id", "text", "quality").mapInPandas(_featured(buckets), "doc_id long, quality int, at binary, n binary"), "features")
    got = sorted((tuple(r) for r in got.toLocalIterator()), key=lambda r: (r[0], bytes(r[2]), bytes(r[3])))
    y = np.array([r[1] for r in got], dtype=np.int64)
    if len({*y}) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return np.zeros(buckets, dtype=np.float32), 0.0 if share == 0.5 else 20.0 * (2 * share - 1)
    rows = []
    for _, _, at, n in got:
        n = np.frombuffer(n, dtype="<i4").astype(np.float32)
        rows.append((np.frombuffer(at, dtype="<i4"), n / n.sum()))
    model = Model(buckets, width, seed)
    model.train(rows, y, epochs, rate, seed)
    weights = model.weights()
    del got, rows, model
    release()  # thousands of small arrays, which the driver would keep
    return weights


def _scored(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        features = Features(len(weights))
        for pdf in slabs(batches):
            total, count = np.zeros(len(pdf)), np.zeros(len(pdf))
            for place, bucket in features.rows(pdf.text.tolist()):
                total += np.bincount(place, weights[bucket], len(pdf))
                count += np.bincount(place, minlength=len(pdf))
            logit = total / np.maximum(count, 1) + bias
            score = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": score, "predicted": (score >= 0.5).astype("int32")})

    return run


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Columns ``doc_id, score, predicted``: the probability of label 1, and whether it is 0.5 or more."""
    small_batches(documents.sparkSession)
    return doc_text(documents).mapInPandas(_scored(*model), "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _accepted(weights: np.ndarray, bias: float, columns: list[str]):
    scored = _scored(weights, bias)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slabs(batches):
            ok = next(scored(iter([pdf]))).predicted.to_numpy() == 1
            yield pdf.loc[ok, columns]

    return run


def keep_accepted(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of ``documents`` with a score of 0.5 or more, in one pass and without a join."""
    small_batches(documents.sparkSession)
    return documents.mapInPandas(_accepted(*model, documents.columns), documents.schema)
