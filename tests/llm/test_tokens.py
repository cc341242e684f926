"""Transducer against the library, and packing's invariants."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm import transducer as t
from tidewell.llm.common import forget
from tidewell.llm.packing import BestFit, pack
from tidewell.llm.token_counts import count_tokens, counter

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = [None, "", " \n", "'re're 'll'l 're'v 'r'e don't it's''s '", "<|endoftext|>a<|startoftext|> <|endoftext|", "é café É", "İstanbul ΑΣ", "日本語 text", "a" * 5000 + "'s", "1234 5é6", "\x00\x1c\x85 x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts(seed, n):
    g = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz'''rvelstmd   .,!?0123456789éèßñüçÀÉΣσ-\t\n\x1c\x85 αβяé<|>"
    return ["".join(g.choice(letters) for _ in range(g.randint(0, 70))) for _ in range(n)]


def test_ids_and_counts_are_the_library_s(library):
    machine = t.transducer(PATH)
    rows = EDGES + texts(1, 4000) + ["".join(random.Random(i).choice("ab") for _ in range(60)) for i in range(200)]
    ids, counts = machine.run(rows, ids=True), machine.run(rows)
    for text, got, n in zip(rows, ids, counts):
        assert got.tolist() == want(library, text), text
        assert n == len(got)


def test_every_usable_code_point(library):
    """All letters below U+3000 and all other marks and numbers; of the large blocks of letters beyond, one in 53."""
    kind = t.classes_of(np.arange(0x110000))
    usable = [chr(c) for c in range(1, 0x110000) if kind[c] != t._UNSURE and (c < 0x3000 or kind[c] != 1 or c % 53 == 0 or chr(c).lower() != chr(c) or unicodedata.category(chr(c)) != "Lo")]
    rows = [f"a{x}b {x} '{x}s" for x in usable]
    wrong = [hex(ord(x)) for x, got, ref in zip(usable, t.transducer(PATH).run(rows, ids=True), library.encode_batch(rows, add_special_tokens=False)) if got.tolist() != ref.ids]
    assert not wrong, (len(wrong), wrong[:40])


def test_texts_that_are_not_composed_are_normalised(library, monkeypatch):
    g = random.Random(5)
    marks, letters = "\u0301\u0308\u0323\u0327\u3099\u0345", "aeonAEcかハ한ᄒ\u1161\u11abé"
    rows = ["".join(g.choice(letters) + g.choice(["", *marks]) * g.randint(1, 2) for _ in range(12)) for _ in range(600)] + ["日本語 text 한국어 🎉🎉 emoji", "<|endoftext|>é<|endoftext|>か\u3099"]
    machine = t.Transducer(PATH)
    monkeypatch.setattr(machine, "_library_ids", lambda text: pytest.fail("not by the transducer"))
    for text, got in zip(rows, machine.run(rows, ids=True)):
        assert got.tolist() == want(library, text), ascii(text)


def test_starting_the_tables_anew_changes_nothing(monkeypatch):
    rows = texts(2, 300) + ["x" * 3000 + "abc" * 500]
    before = [x.tolist() for x in t.Transducer(PATH).run(rows, ids=True)]
    monkeypatch.setattr(t, "MAX_CELLS", 1000)
    monkeypatch.setattr(t, "SLAB", 50)
    monkeypatch.setattr(t, "LONG_PIECE", 5)
    assert [x.tolist() for x in t.Transducer(PATH).run(rows, ids=True)] == before


@pytest.mark.parametrize("length", [1, 7, 1024, 1025, 5000])
def test_chunk_maps_compose(length):
    """States from the prefix scan are those of a run character by character, also without any white space."""
    g = np.random.default_rng(length)
    for classes in (range(10), range(1, 10), (1, 4, 6, 9)):
        cls = g.choice(np.array(list(classes), dtype=np.uint8), size=length)
        state, out = 0, []
        for c in cls:
            state = int(t._TO[state * 10 + int(c)])
            out.append(state)
        assert t.lex_states(cls).tolist() == out


def test_other_vocabularies_are_counted_by_their_library():
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert counter(public_tokenizers.path(name))(["a b", None])[0] > 0


def test_count_query(spark, library):
    rows = [(i, x, "s") for i, x in enumerate(EDGES)] + [(0, EDGES[0], "s")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, limit=3).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(want(library, EDGES[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((EDGES[r.doc_id] or "").encode()), n, n > 3)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_packing(spark, library):
    g = random.Random(3)
    rows = [(i, " ".join("tok" for _ in range(g.randint(0, 90)))) for i in range(400)] + [(900, None), (901, ""), (902, "word " * 333)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, length=64, open_bins=64, window=50).toPandas()
    for i, text in rows:
        ids = [*want(library, text), 1]
        parts = got[got.doc_id == i].sort_values("piece")
        assert parts.piece.tolist() == list(range(len(parts))) and parts.length.sum() == len(ids)
        for p in parts.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
            assert p.length == 64 or p.piece == len(parts) - 1
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    free: list[int] = []
    for n in sorted(got.length, reverse=True):  # first fit over all pieces, longest first
        at = next((k for k, room in enumerate(free) if room >= n), None)
        free, at = (free, at) if at is not None else ([*free, 64], len(free))
        free[at] -= n
    assert got.sequence_id.nunique() <= 1.05 * len(free) + 8
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 9)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert bins.put(8) == (3, 0)  # sequence 2, with 1 free, closes for it
    assert bins.put(4) == (0, 6) and bins.put(1) == (3, 8)


def test_forget_drops_compiled_tables_and_they_are_built_anew():
    text = "some words, and 12 more"
    first = t.transducer(PATH)
    want = first.run([text])
    forget()
    assert t.transducer(PATH) is not first
    assert t.transducer(PATH).run([text]) == want
