"""Token counts by transducer.

``count_tokens`` counts what the tokenizers library would give for every whole text, without special tokens added. A file
of the supported shape is compiled (see ``transducer``); any other file is counted by its library itself.

Null and empty texts have 0 bytes and 0 tokens. Rows are counted one by one, so repeated rows and extra columns don't
matter; very long texts are read in slabs of chunks, and a text's memory is a few times its own size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tidewell.llm.common import doc_text, kept, slabs, small_batches
from tidewell.llm.transducer import Transducer, transducer

_counters: dict[str, Callable[[list], list[int]]] = kept()


def counter(path: str) -> Callable[[list], list[int]]:
    """A function from texts to numbers of tokens for a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
        else:
            with open(path, encoding="utf-8") as f:
                compiled = Transducer.supports(json.load(f))
            if compiled:
                _counters[path] = transducer(path).run
            else:
                from tokenizers import Tokenizer

                library = Tokenizer.from_file(path)
                _counters[path] = lambda texts: [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    return _counters[path]


def _counted(path: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for pdf in slabs(batches):
            texts = pdf.text.tolist()
            n = pd.Series(count(texts), dtype="int64")
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": size, "n_tokens": n.to_numpy(), "over_limit": (n > limit).to_numpy()})

    return run


def count_tokens(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Columns ``doc_id, n_bytes, n_tokens, over_limit``, a row for each row of ``documents(doc_id, text, ...)``."""
    small_batches(documents.sparkSession)
    return doc_text(documents).mapInPandas(_counted(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
