"""Byte-pair tokenizers compiled to deterministic finite-state transducers.

Two machines in a row give the ids and counts of the library for vocabularies of words with an end-of-word suffix:

* the *lexer* has nine states and cuts normalised text into pieces (contractions, runs of letters, single numbers, runs of
  other marks). Text is cut into chunks of equal length; every chunk gives a map from entry state to exit state, the maps
  are composed by a parallel prefix scan, and a second pass runs each chunk from its true entry state;
* the *piece transducer* reads a piece's bytes. A state holds what the rest of the piece can depend on: the longest suffix
  that some vocabulary entry starts with, and for each place in it the last token and the number of tokens so far. A
  transition emits the change in the number of tokens (it may be negative: merges undo tokens). States and transitions are
  made when first met and kept in dense tables; beyond ``MAX_CELLS`` the tables are started anew, which changes no result.

Exactly one sequence of tokens with pairwise stable borders spells a piece, and that is the byte-pair encoding. A border is
stable when no merge across it comes earlier than the merges that absorb its two sides.
"""

from __future__ import annotations

import json
import marshal
import re
import unicodedata

import numpy as np

from tidewell.llm.common import kept, release

CHUNK = 1024
SLAB = 1 << 19
MAX_CELLS = 16_000_000
LONG_PIECE = 2048
NONE = 65535  # no token yet; larger vocabularies aren't supported

# The tokenizer's pattern for pieces, as its file has it.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BREAK, _LETTERS, _NUMBER, _MARKS, _QUOTE, _R, _V, _L, _DONE = range(9)
_STATES, _CLASSES = 9, 10
# classes: space, letter, number, mark, apostrophe, one of s t m d, r, v, l, e


def _lexer() -> np.ndarray:
    to = np.empty((_STATES, _CLASSES), dtype=np.uint8)
    to[:, 0], to[:, 2], to[:, 3] = _BREAK, _NUMBER, _MARKS
    to[:, 4] = _QUOTE
    to[[_MARKS, _QUOTE], 4] = _MARKS
    to[:, [1, 5, 6, 7, 8, 9]] = _LETTERS
    to[_QUOTE, 5:9] = [_DONE, _R, _V, _L]
    to[[_R, _V], 9] = _DONE
    to[_L, 8] = _DONE
    return to.ravel()


_TO = _lexer()


_SPACE_POINTS = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_OWN_CLASS = {39: 4, **{ord(x): 5 for x in "stmd"}, ord("r"): 6, ord("v"): 7, ord("l"): 8, ord("e"): 9}
_UNKNOWN, _UNSURE = 254, 255
_kind = np.full(0x110000, _UNKNOWN, dtype=np.uint8)


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))
    if kind in ("Cn", "Cs", "Co"):
        return _UNSURE
    if c in _SPACE_POINTS:
        return 0
    return _OWN_CLASS.get(c) or (1 if kind[0] == "L" else 2 if kind[0] == "N" else 3)


def classes_of(points: np.ndarray) -> np.ndarray:
    """Class of each code point; ``_UNSURE`` where the installed Unicode tables can't be relied on. Made page by page when met."""
    found = _kind[points]
    if (new := found == _UNKNOWN).any():
        for page in np.unique(points[new] >> 8).tolist():
            _kind[page << 8 : (page + 1) << 8] = [_class(c) for c in range(page << 8, (page + 1) << 8)]
        found = _kind[points]
    return found


def lex_states(cls: np.ndarray) -> np.ndarray:
    """The lexer's state after each character, from chunk maps composed by a prefix scan.

    White space sends every state to one, so the maps of all chunks soon turn constant. From there on one state stands for
    all, whatever the entry; what lies before is filled in once the scan has given each chunk its entry state.
    """
    n = len(cls)
    width = -(-n // CHUNK)
    grid = np.zeros(width * CHUNK, dtype=np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(width, CHUNK).T)
    maps = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], width, axis=1)  # state in, chunk -> state out
    apart = CHUNK
    for j in range(CHUNK):
        maps = _TO[maps * np.uint8(_CLASSES) + grid[j]]
        if j % 16 == 15 and (maps[1:] == maps[0]).all():
            apart = j + 1
            break
    out = np.empty((CHUNK, width), dtype=np.uint8)
    state = maps[0]
    for j in range(apart, CHUNK):
        out[j] = state = _TO[state * np.uint8(_CLASSES) + grid[j]]
    if apart < CHUNK:
        maps = np.broadcast_to(state, maps.shape)
    else:
        hop = 1
        while hop < width:  # inclusive scan: the map of chunks 0..k
            maps[:, hop:] = np.take_along_axis(maps[:, hop:], maps[:, :-hop].astype(np.intp), axis=0)
            hop *= 2
    state = np.concatenate((np.array([_BREAK], dtype=np.uint8), maps[_BREAK, :-1]))
    for j in range(apart):
        out[j] = state = _TO[state * np.uint8(_CLASSES) + grid[j]]
    return out.T.ravel()[:n]


def piece_bounds(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a text whose last character is white space."""
    s = lex_states(cls)
    before = np.concatenate((np.array([_BREAK], dtype=np.uint8), s[:-1]))
    after = np.concatenate((s[1:], np.array([_BREAK], dtype=np.uint8)))
    pending = (s == _R) | (s == _V) | (s == _L)
    letters = (s == _LETTERS) & ((before == _BREAK) | (before == _NUMBER) | (before == _MARKS) | (before == _QUOTE) | (before == _DONE))
    marks = ((s == _MARKS) & (before != _MARKS) & (before != _QUOTE)) | (s == _QUOTE)
    start = letters | marks | (s == _NUMBER) | (pending & (after != _DONE))
    filled = s != _BREAK
    follows = np.concatenate((start[1:] | ~filled[1:], [True]))
    return np.flatnonzero(start), np.flatnonzero(filled & follows) + 1


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(extra)) for b in range(256)]


class Transducer:
    """Exact token ids and counts for a vocabulary file whose shape ``supports`` accepts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not self.supports(spec):
            raise ValueError(f"{path}: not a byte-level vocabulary of lower-case words with an end-of-word suffix")
        self.path, self._library = path, None
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.specials}
        back = {c: b for b, c in enumerate(byte_letters())}
        self.inner, self.last, starts = {}, {}, set()
        size = max(model["vocab"].values()) + 1
        if size > NONE:
            raise ValueError(f"{path}: more than {NONE} entries")
        self.width = np.zeros(size, dtype=np.int32)
        for word, i in vocab.items():
            final = word.endswith(end)
            raw = bytes(back[c] for c in (word[: -len(end)] if final else word))
            (self.last if final else self.inner)[raw] = i
            self.width[i] = len(raw)
            starts.update(raw[:k] for k in range(1, len(raw)))
        self.starts = starts
        self.rank, self.parts = {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ia, ib, ic = vocab[a], vocab[b], vocab[a + b]
            if ic in self.parts:
                raise ValueError(f"{path}: two merges make the same entry")
            self.rank[ia, ib] = r
            self.parts[ic] = (ia, ib, r)
        self._stable: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list] = {}
        self._reset()

    @staticmethod
    def supports(spec: dict) -> bool:
        model, norm, pre = spec.get("model", {}), spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        norms, pres = norm.get("normalizers", []), pre.get("pretokenizers", [])
        return bool(
            model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix") and not spec.get("truncation") and not spec.get("padding")
            and [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in pres] == ["Split", "ByteLevel"]
            and pres[0]["pattern"].get("Regex") == PIECE_PATTERN and pres[0]["invert"] and pres[0]["behavior"] == "Removed"
            and not pres[1]["add_prefix_space"] and not pres[1]["use_regex"]
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )

    # --- compilation ---------------------------------------------------------------------------------------------

    def _reset(self) -> None:
        self._names: dict[bytes, int] = {}  # keys as bytes take a fifth of their tuples' memory
        self._keys: list[bytes] = []
        self._column = np.full(256, -1, dtype=np.int32)
        self._columns = 0
        self._next = np.full((1024, 64), -1, dtype=np.int32)
        self._fin = np.full((1024, 64), NONE, dtype=np.uint16)
        self._emit = np.zeros((1024, 64), dtype=np.int8)
        self._fin_emit = np.zeros((1024, 64), dtype=np.int8)
        self._token = np.zeros(1024, dtype=np.int32)
        self._state((b"", ((-1, 0),)))

    def _state(self, key: tuple) -> int:
        packed = marshal.dumps(key, 2)  # this version writes equal keys alike
        at = self._names.get(packed)
        if at is None:
            at = self._names[packed] = len(self._keys)
            self._keys.append(packed)
            if at >= len(self._next):
                rows = len(self._next)  # by a half, but in small steps near the limit
                self._grow(rows + rows // (2 if 3 * self._next.size <= 2 * MAX_CELLS else 8), self._next.shape[1])
            self._token[at] = key[1][-1][0]
        return at

    def _grow(self, rows: int, columns: int) -> None:
        for name in ("_next", "_fin", "_emit", "_fin_emit"):
            old, none = getattr(self, name), {"_next": -1, "_fin": NONE}.get(name, 0)
            if columns == old.shape[1]:  # in place: two copies of a large table would be its peak
                n = len(old)
                old.resize((rows, columns), refcheck=False)
                old[n:] = none
                continue
            new = np.full((rows, columns), none, dtype=old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            setattr(self, name, new)
        token = np.zeros(rows, dtype=np.int32)
        token[: len(self._token)] = self._token
        self._token = token

    def _side(self, token: int, side: int) -> list:
        """The tokens that stand at one edge while ``token`` is built, each with the merge that absorbs it."""
        got = self._edges.get((token, side))
        if got is None:
            got, t, absorbed = [], token, 1 << 60
            while True:
                got.append((t, absorbed))
                if t not in self.parts:
                    break
                absorbed = self.parts[t][2]
                t = self.parts[t][side]
            self._edges[token, side] = got
        return got

    def _holds(self, left: int, right: int) -> bool:
        border = left << 16 | right
        got = self._stable.get(border)
        if got is None:
            rank, rights = self.rank, self._side(right, 0)
            # equal merges are done from the left: the left side's own merge wins a tie, the border's wins over the right's
            got = not any((q := rank.get((a, b))) is not None and q < at_a and q <= at_b for a, at_a in self._side(left, 1) for b, at_b in rights)
            if len(self._stable) > 400_000:
                self._stable.clear()
            self._stable[border] = got
        return got

    def _read(self, key: tuple, byte: int, final: bool) -> tuple[int, int, bytes]:
        """Token that ends with ``byte`` and the number of tokens, relative to before; the text read so far, as kept."""
        window, history = key
        text = window + bytes((byte,))
        table = self.last if final else self.inner
        for at in range(len(text)):
            token = table.get(text[at:])
            if token is not None and (history[at][0] < 0 or self._holds(history[at][0], token)):
                return token, history[at][1] + 1, text
        raise AssertionError("no token ends here")

    def _compile(self, state: int, byte: int) -> None:
        key = marshal.loads(self._keys[state])
        token, count, text = self._read(key, byte, False)
        at = next((k for k in range(len(text)) if text[k:] in self.starts), len(text))
        history = (*key[1], (token, count))[at:]
        target = self._state((text[at:], tuple((t, c - count) for t, c in history)))
        column = self._column[byte]
        self._next[state, column], self._emit[state, column] = target, count

    def _compile_final(self, state: int, byte: int) -> None:
        token, count, _ = self._read(marshal.loads(self._keys[state]), byte, True)
        column = self._column[byte]
        self._fin[state, column], self._fin_emit[state, column] = token, count

    # --- runs ----------------------------------------------------------------------------------------------------

    def _pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray | None) -> np.ndarray:
        """Tokens of each piece of ``data``; ``tokens`` gets the last token at each byte."""
        counts = np.zeros(len(starts), dtype=np.int32)
        if self._next.size > MAX_CELLS:
            self._reset()
        for byte in np.flatnonzero(np.bincount(data, minlength=256)):
            if self._column[byte] < 0:
                if self._columns == self._next.shape[1]:
                    self._grow(self._next.shape[0], self._columns + 16)
                self._column[byte] = self._columns
                self._columns += 1
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state = np.zeros(len(at), dtype=np.int32)
        total = np.zeros(len(at), dtype=np.int32)
        k = 0
        while len(at):
            going = int(np.searchsorted(-left, -(k + 1), side="left"))  # pieces longer than k + 1
            byte = data[at + k]
            column = self._column[byte]
            if going < len(at):
                s, c = state[going:], column[going:]
                cell = self._fin[s, c]
                if (new := cell == NONE).any():
                    for x, y in {*zip(s[new].tolist(), byte[going:][new].tolist())}:
                        self._compile_final(x, y)
                    cell = self._fin[s, c]
                total[going:] += self._fin_emit[s, c]
                counts[order[going : len(at)]] = total[going:]
                if tokens is not None:
                    tokens[at[going:] + k] = cell
                at, left, state, total, column, byte = at[:going], left[:going], state[:going], total[:going], column[:going], byte[:going]
            if going:
                to = self._next[state, column]
                if (to < 0).any():
                    for x, y in {*zip(state[to < 0].tolist(), byte[to < 0].tolist())}:
                        self._compile(x, y)
                    to = self._next[state, column]
                total += self._emit[state, column]
                if tokens is not None:
                    tokens[at + k] = self._token[to]
                state = to
            k += 1
        return counts

    def _library_ids(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library.encode(text, add_special_tokens=False).ids

    def run(self, texts: list[str | None], ids: bool = False):
        """Per text its number of tokens, or with ``ids`` its token ids as an int32 array."""
        out: list = [None] * len(texts)
        held, size = [], 0  # (text's place, its parts)
        for i, t in enumerate(texts):
            t = t or ""
            special = self._special is not None and any(x in t for x in self.specials)
            parts = self._special.split(t) if special else [t]  # before normalisation, as the library does
            if not t.isascii():
                points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if (classes_of(points) == _UNSURE).any():
                    found = np.array(self._library_ids(t), dtype=np.int32)
                    out[i] = found if ids else len(found)
                    continue
                # the library lower-cases characters one by one
                parts[::2] = [unicodedata.normalize("NFC", p).replace("Σ", "σ") for p in parts[::2]]
            held.append((i, parts))
            size += len(t) + 1
            if size >= SLAB:
                self._slab(held, ids, out)
                held, size = [], 0
        if held:
            self._slab(held, ids, out)
        return out

    def _slab(self, held: list, ids: bool, out: list) -> None:
        lines = [p.lower() for _, parts in held for p in parts[::2]]
        text = "\n".join(lines) + "\n"
        raw = text.encode("utf-8")
        data = np.frombuffer(raw, dtype=np.uint8)
        points = data if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        cls = classes_of(points)
        starts, ends = piece_bounds(cls)
        if points is not data:
            place = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)))
            starts, ends = place[starts], place[ends]
        limits = np.concatenate(([0], np.cumsum([len(x) + 1 if x.isascii() else len(x.encode("utf-8")) + 1 for x in lines])))
        tokens = np.zeros(len(data), dtype=np.int32) if ids else None
        lengths = ends - starts
        counts = np.zeros(len(starts), dtype=np.int64)
        short = lengths <= LONG_PIECE
        counts[short] = self._pieces(data, starts[short], lengths[short].astype(np.int32), tokens)
        for j in np.flatnonzero(~short):  # the same transitions, one by one
            counts[j] = self._long(data, int(starts[j]), int(ends[j]), tokens)
        sums = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, limits)]
        if ids:
            cut = np.zeros(len(data), dtype=bool)
            at, low = ends - 1, starts
            while len(at):
                cut[at] = True
                at = at - self.width[tokens[at]]
                at, low = at[(more := at >= low)], low[more]
            found = tokens[cut]
        row = 0
        for i, parts in held:
            n = (len(parts) + 1) // 2
            if not ids:
                out[i] = int(sums[row + n] - sums[row]) + n - 1
            elif n == 1:
                out[i] = found[sums[row] : sums[row + 1]]
            else:
                bits = []
                for k in range(n):
                    bits.append(found[sums[row + k] : sums[row + k + 1]])
                    if k < n - 1:
                        bits.append(np.array([self.specials[parts[2 * k + 1]]], dtype=np.int32))
                out[i] = np.concatenate(bits)
            row += n

    def _long(self, data: np.ndarray, start: int, end: int, tokens: np.ndarray | None) -> int:
        state, total = 0, 0
        for p in range(start, end):
            if self._next.size > MAX_CELLS:
                key = marshal.loads(self._keys[state])
                self._reset()
                state = self._state(key)
            byte = int(data[p])
            if self._column[byte] < 0:
                if self._columns == self._next.shape[1]:
                    self._grow(self._next.shape[0], self._columns + 16)
                self._column[byte] = self._columns
                self._columns += 1
            c = self._column[byte]
            if p == end - 1:
                if self._fin[state, c] == NONE:
                    self._compile_final(state, byte)
                total += int(self._fin_emit[state, c])
                if tokens is not None:
                    tokens[p] = self._fin[state, c]
                return total
            if self._next[state, c] < 0:
                self._compile(state, byte)
            total += int(self._emit[state, c])
            state = int(self._next[state, c])
            if tokens is not None:
                tokens[p] = self._token[state]
        return total


_loaded: dict[str, Transducer] = kept()


def transducer(path: str) -> Transducer:
    """The compiled tokenizer of a file, kept with the states it has met until another operator uses the process."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
        release()
    return _loaded[path]
