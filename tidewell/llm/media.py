"""Media columns: bytes kept as baseline JPEG, dimensions and thumbnail hashes read back from them.

``encode_texts`` stores UTF-8 texts as images (see ``jpeg``); ``media_features`` takes any column of baseline JPEG files;
``text_media`` does both in one pass over whole texts and derives checksums. A null or empty text is stored as 64 zero bytes.
Files that aren't baseline JPEG, and nulls, get null features. Work goes in slabs of about a megabyte and a long
text is written part by part, so memory is a few times the longest text's own size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import jpeg
from tidewell.llm.common import doc_text, slabs, small_batches

SLAB = 1 << 20
_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def payload_of(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 if raw else 64)


def _slabs(items: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, x in enumerate(items):
        size += len(x)
        if size >= SLAB or i == len(items) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _features(files: list[bytes | None]) -> list[tuple]:
    """(width, height, hash, coefficients) of each file; Nones for what can't be read."""
    out: list[tuple] = [(None, None, None, None)] * len(files)
    images = {i: image for i, f in enumerate(files) if f and (image := jpeg.parse(f))}
    try:
        coefs = jpeg.read(list(images.values()))
    except (ValueError, KeyError, IndexError):  # some file is broken: one by one
        coefs = []
        for i in list(images):
            try:
                coefs += jpeg.read([images[i]])
            except (ValueError, KeyError, IndexError):
                del images[i]
    for (i, image), c in zip(images.items(), coefs):
        out[i] = image.width, image.height, jpeg.average_hash(jpeg.thumbnail(image, c)), c
    return out


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slabs(batches):
        raws = [payload_of(t.encode("utf-8", "surrogatepass") if t else b"") for t in pdf.text]
        for a, b in _slabs(raws):
            yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[a:b], "media": jpeg.write(raws[a:b])})


def encode_texts(documents: DataFrame) -> DataFrame:
    """Columns ``doc_id, media``: every whole text as a JPEG file that holds it losslessly."""
    small_batches(documents.sparkSession)
    return doc_text(documents).mapInPandas(_encoded, "doc_id long, media binary")


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        files = pdf.media.tolist()
        for a, b in _slabs([f or b"" for f in files]):
            got = _features(files[a:b])
            part = pd.DataFrame([(w, h, s) for w, h, s, _ in got], columns=["width", "height", "thumbnail_hash"])
            part.insert(0, "media_id", pdf.media_id.iloc[a:b].to_numpy())
            yield part.astype({"width": "Int32", "height": "Int32"})


def media_features(files: DataFrame, name: str = "media_id", content: str = "media") -> DataFrame:
    """Columns ``media_id, width, height, thumbnail_hash`` for a table of baseline JPEG files."""
    rows = files.select(F.col(name).cast("long").alias("media_id"), F.col(content).alias("media"))
    return rows.mapInPandas(_measured, "media_id long, width int, height int, thumbnail_hash string")


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slabs(batches):
        ids = pdf.doc_id.tolist()
        raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in pdf.text]
        for a, b in _slabs(raws):
            files, rows = jpeg.write([payload_of(r) for r in raws[a:b]]), []
            for i, r, f, (width, height, mark, coefs) in zip(ids[a:b], raws[a:b], files, _features(files)):
                size = int.from_bytes(jpeg.parse(f).comment, "big")
                back = (coefs.reshape(-1)[:size] + 128).astype("uint8").tobytes()  # from the stored bytes alone
                rows.append((i, len(r), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), f"{width}x{height}:{mark}", width, height))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


def text_media(documents: DataFrame) -> DataFrame:
    """Every whole text stored as JPEG and read back: sizes, checksums, and ``feature`` (dimensions and thumbnail hash)."""
    small_batches(documents.sparkSession)
    return doc_text(documents).mapInPandas(_kept, _OUT)
