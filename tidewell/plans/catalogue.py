"""All registered queries of the engine's own operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from tidewell.plans import episodes_part, texts_part, vectors_part

_PARTS = [episodes_part, vectors_part, texts_part]
QUERIES: dict = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
