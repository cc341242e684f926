"""Baseline JPEG in numpy: a lossless store for bytes, and a decoder for DC-only luminance thumbnails.

Store. The format's unit is the quantised coefficient of an 8 x 8 block. A payload's bytes, less 128, are the coefficients of
a grey image in zigzag order, 64 to a block, and entropy coding keeps them exactly; the first byte of each 64 is the block's
DC value and so its mean grey. Blocks fill a nearly square image, the rest of it with zeros, and a comment segment holds the
number of payload bytes. Every eighth block a restart marker makes the scan decodable in parallel.

Decoder. ``read`` takes any baseline (SOF0) image with 8-bit samples, one scan and up to four components with any sampling:
it parses the markers, cuts the scan at restart markers, and decodes the pieces of many images in lock-step, one symbol of
each at a time. From the luminance component's DC values it makes the thumbnail, a sample per block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

RESTART = 8
PART = 16_384  # blocks, a megabyte; a multiple of RESTART
_U = np.uint64
# The format's markers.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE


def _codes(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body (counts, symbols) and symbol -> (code, length), canonical."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in order:
        n = lengths[s]
        code <<= n - last
        codes[s], last = (code, n), n
        code += 1
        counts[n - 1] += 1
    return bytes(counts) + bytes(order), codes


_DC_BODY, _DC = _codes({s: 4 for s in range(9)})
# short codes for the sizes that letters have
_AC_LENGTHS = {5: 2, 4: 3, 7: 3, 3: 4, 6: 5, 1: 6, 2: 6, 8: 6, 0: 6, 0xF0: 8} | {16 * r + s: 10 for r in range(1, 16) for s in range(1, 9)}
_AC_BODY, _AC = _codes(_AC_LENGTHS)
_DC_CODE, _DC_LEN = (np.array([_DC[s][k] for s in range(9)], dtype=_U) for k in (0, 1))
_AC_CODE, _AC_LEN = (np.array([_AC.get(s, (0, 0))[k] for s in range(256)], dtype=_U) for k in (0, 1))
_SIZE = np.array([abs(v).bit_length() for v in range(-512, 512)], dtype=np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = _segment(DQT, bytes([0, 8] + [1] * 63)) + _segment(DHT, b"\x00" + _DC_BODY) + _segment(DHT, b"\x10" + _AC_BODY)


def shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down for a number of blocks."""
    across = int(np.ceil(np.sqrt(blocks)))
    return across, -(-blocks // across)


def _head(across: int, down: int, size: int) -> bytes:
    frame = bytes([8]) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + _segment(COM, size.to_bytes(8, "big")) + _TABLES + _segment(SOF0, frame) + _segment(DRI, RESTART.to_bytes(2, "big")) + _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))


def write(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload; lengths are positive multiples of 64.

    Restart intervals are coded independently of one another, so a long payload is taken ``PART`` blocks at a time.
    """
    shapes = [shape(len(p) // 64) for p in payloads]
    scans: list[list[bytes]] = [[] for _ in payloads]
    held: list[tuple[int, bytes, int, bool]] = []  # payload, bytes, first interval, whether the image ends here
    size = 0
    for i, (p, (across, down)) in enumerate(zip(payloads, shapes)):
        blocks = across * down
        for at in range(0, blocks, PART):
            n = min(PART, blocks - at)
            part = p[64 * at : 64 * (at + n)]
            held.append((i, part + bytes([128]) * (64 * n - len(part)), at // RESTART, at + n == blocks))
            size += n
            if size >= PART:
                _write_parts(held, scans)
                held, size = [], 0
    _write_parts(held, scans)
    return [_head(a, d, len(p)) + b"".join(scan) + b"\xff\xd9" for p, (a, d), scan in zip(payloads, shapes, scans)]


def _write_parts(held: list[tuple[int, bytes, int, bool]], scans: list[list[bytes]]) -> None:
    """Append to ``scans`` the coded intervals of parts, with the restart markers between them."""
    if not held:
        return
    coefs = np.frombuffer(b"".join(part for _, part, *_ in held), dtype=np.uint8).reshape(-1, 64).astype(np.int64) - 128
    blocks = np.array([len(part) // 64 for _, part, *_ in held])
    first = np.cumsum(blocks) - blocks
    nth = np.arange(len(coefs)) - np.repeat(first, blocks)
    fresh = nth % RESTART == 0
    diff = coefs[:, 0].copy()
    diff[1:] -= np.where(fresh[1:], 0, coefs[:-1, 0])

    value, width = np.zeros(coefs.shape, dtype=_U), np.zeros(coefs.shape, dtype=_U)
    size = _SIZE[diff + 512].astype(_U)
    value[:, 0] = _DC_CODE[size.astype(np.intp)] << size | _amplitude(diff, size)
    width[:, 0] = _DC_LEN[size.astype(np.intp)] + size
    row, col = np.nonzero(coefs[:, 1:])
    col += 1
    new_row = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    before = np.where(new_row, 0, np.concatenate(([0], col[:-1]))[: len(col)])
    run = col - before - 1
    v = coefs[row, col]
    size = _SIZE[v + 512].astype(_U)
    symbol = 16 * (run % 16) + size.astype(np.int64)
    code, n = _AC_CODE[symbol] << size | _amplitude(v, size), _AC_LEN[symbol] + size
    for k in (1, 2, 3):  # sixteen zeros each
        more = run >= 16 * k
        if more.any():
            code[more] |= _AC_CODE[0xF0] << n[more]
            n[more] += _AC_LEN[0xF0]
    value[row, col], width[row, col] = code, n
    end = np.zeros(len(coefs), dtype=np.intp)  # the last token of a block that isn't full takes the end code
    end[row] = col  # ascending, so the last assignment stays
    short = np.flatnonzero(end < 63)
    value[short, end[short]] = value[short, end[short]] << _AC_LEN[0] | _AC_CODE[0]
    width[short, end[short]] += _AC_LEN[0]

    data, sizes = _pack(value, width, fresh)
    parts = -(-blocks // RESTART)
    part_of = np.cumsum(parts) - parts
    last = np.zeros(len(sizes), dtype=bool)
    ending = np.array([end for *_, end in held])
    last[(part_of + parts - 1)[ending]] = True
    room = sizes + np.where(last, 0, 2)
    start = np.cumsum(room) - room
    out = np.empty(int(room.sum()), dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)] = data
    number = np.arange(len(sizes)) - np.repeat(part_of, parts) + np.repeat(np.array([k for _, _, k, _ in held]), parts)
    mark = np.flatnonzero(~last)
    at = start[mark] + sizes[mark]
    out[at] = 0xFF
    out[at + 1] = 0xD0 + number[mark] % 8
    edge = np.append(start, len(out))
    for (i, *_), k, m in zip(held, part_of, parts):
        scans[i].append(out[edge[k] : edge[k + m]].tobytes())


def _amplitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (np.where(v < 0, v - 1, v).astype(np.int64).view(_U)) & ((_U(1) << size) - _U(1))


def _pack(value: np.ndarray, width: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each restart interval, padded with ones and stuffed; all bytes, and the bytes of each interval."""
    interval = np.cumsum(fresh) - 1
    bits = np.bincount(interval, width.sum(axis=1).astype(np.float64)).astype(np.int64)
    words = -(-bits // 64)
    word0 = np.cumsum(words) - words
    flat = width.ravel().astype(np.int64)
    ends = np.cumsum(flat)
    base = np.cumsum(bits) - bits
    shift = np.repeat((64 * word0 - base)[interval], value.shape[1])
    used = flat > 0
    v, n = value.ravel()[used], flat[used]
    at = (ends - flat + shift)[used]
    word, low = at >> 6, at & 63
    over = low + n - 64
    part = np.where(over > 0, v >> np.maximum(over, 0).astype(_U), v << np.maximum(-over, 0).astype(_U))
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros(int(words.sum()), dtype=_U)
    out[word[heads]] = np.bitwise_or.reduceat(part, heads)
    spilt = np.flatnonzero(over > 0)
    out[word[spilt] + 1] |= v[spilt] << (64 - over[spilt]).astype(_U)
    pad = -bits % 8
    tail = bits + pad
    out[word0 + (tail - 1) // 64] |= ((_U(1) << pad.astype(_U)) - _U(1)) << (-tail % 64).astype(_U)
    raw = out.byteswap().view(np.uint8)
    n_bytes = tail // 8
    keep = np.arange(len(raw)) - np.repeat(8 * word0, 8 * words) < np.repeat(n_bytes, 8 * words)
    raw = raw[keep]
    stuffed = raw == 0xFF
    where = np.repeat(np.arange(len(bits)), n_bytes)
    sizes = n_bytes + np.bincount(where, stuffed, len(bits)).astype(np.int64)
    full = np.repeat(raw, 1 + stuffed)
    full[np.flatnonzero(stuffed) + np.cumsum(stuffed)[stuffed]] = 0
    return full, sizes


@dataclass
class Image:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # components: (id, h, v, quantisation table)
    quant: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)
    scan: list = field(default_factory=list)  # (component, DC table, AC table)
    restart: int = 0
    comment: bytes = b""
    data: bytes = b""

    @property
    def tallest(self) -> tuple[int, int]:
        if len(self.scan) == 1:
            return 1, 1
        return max(p[1] for p in self.parts), max(p[2] for p in self.parts)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = self.tallest
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def pattern(self) -> tuple:
        """Blocks of an MCU: (component, DC table, AC table)."""
        one = len(self.scan) == 1
        return tuple((c, dc, ac) for c, dc, ac in self.scan for _ in range(1 if one else self.parts[c][1] * self.parts[c][2]))


def parse(raw: bytes) -> Image | None:
    """The markers of a baseline file; None for anything else."""
    image, at = Image(), 2
    if raw[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            return None
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == COM:
            image.comment = body
        elif marker == DRI:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == DQT:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                image.quant[name] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == SOF0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if body[0] != 8:
                return None
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return None  # another process than baseline
        elif marker == SOS:
            names = [p[0] for p in image.parts]
            image.scan = [(names.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            image.data = raw[at:]
            return image if image.width and image.height and len(image.scan) == len(image.parts) else None
    return None


def _lookup(body: bytes) -> np.ndarray:
    """16 bits ahead -> length * 256 + symbol."""
    out, code, k = np.zeros(65536, dtype=np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + body[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _streams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers, and the length of each piece between restart markers."""
    raw = np.frombuffer(data, dtype=np.uint8)
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[escape + 1]
    stop = escape[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))]
    end = int(stop[0]) if len(stop) else len(raw)
    follow, escape = follow[escape < end], escape[escape < end]
    keep = np.ones(end, dtype=bool)
    keep[escape[follow == 0] + 1] = False
    marks = escape[follow != 0]
    keep[marks], keep[marks + 1] = False, False
    kept = np.cumsum(keep)
    return raw[:end][keep], np.diff(np.concatenate(([0], kept[marks] if len(marks) else [], [kept[-1] if end else 0])).astype(np.int64))


def read(images: list[Image]) -> list[np.ndarray]:
    """Coefficients of each image, a row of 64 in zigzag order for every block, in scan order."""
    out: list = [None] * len(images)
    groups: dict = {}
    for i, image in enumerate(images):
        key = (image.pattern(), tuple(sorted(image.huffman.items())))
        groups.setdefault(key, []).append(i)
    for (pattern, tables), members in groups.items():
        pieces, lengths, todo = [], [], []
        for i in members:
            data, sizes = _streams(images[i].data)
            across, down = images[i].mcus
            units = across * down
            each = images[i].restart or units
            left = np.minimum(each, units - each * np.arange(-(-units // each)))
            if len(left) != len(sizes):
                raise ValueError("restart markers are missing")
            pieces.append(data)
            lengths.append(sizes)
            todo.append(left * len(pattern))
        n = np.concatenate(lengths)
        blocks = np.concatenate(todo)
        coefs = _decode(np.concatenate(pieces), n, blocks, pattern, dict(tables))
        cut = np.cumsum([t.sum() for t in todo])
        for i, part in zip(members, np.split(coefs, cut[:-1])):
            out[i] = part
    return out


def _decode(data: np.ndarray, lengths: np.ndarray, blocks: np.ndarray, pattern: tuple, tables: dict) -> np.ndarray:
    padded = np.concatenate((data, np.full(16, 0xFF, dtype=np.uint8))).astype(_U)
    window = padded[: len(data) + 8].copy()
    for k in range(1, 8):
        window <<= _U(8)
        window |= padded[k : len(data) + 8 + k]
    luts = np.concatenate([_lookup(tables[dc]) for _, dc, _ in pattern] + [_lookup(tables[0x10 + ac]) for *_, ac in pattern])
    m = len(pattern)
    part = np.array([c for c, *_ in pattern])
    coefs = np.zeros((int(blocks.sum()), 64), dtype=np.int16)
    flat = coefs.reshape(-1)
    pos = 8 * (np.cumsum(lengths) - lengths)
    end = 8 * np.cumsum(lengths)
    block = np.cumsum(blocks) - blocks
    last = block + blocks
    k = np.zeros(len(pos), dtype=np.int64)
    j = np.zeros(len(pos), dtype=np.int64)
    dc = np.zeros((len(pos), int(part.max()) + 1), dtype=np.int64)
    live = np.arange(len(pos))
    while len(live):
        bits = window[pos >> 3] << (pos & 7).astype(_U)
        is_dc = k == 0
        hit = luts[((np.where(is_dc, j, m + j)) << 16) + (bits >> _U(48)).astype(np.int64)]
        n, symbol = hit >> 8, hit & 255
        if (n == 0).any():
            raise ValueError("not a code")
        size, run = symbol & 15, symbol >> 4
        amp = (bits << n.astype(_U) >> _U(1) >> (63 - size).astype(_U)).astype(np.int64)
        v = np.where(amp < (1 << size) >> 1, amp - (1 << size) + 1, amp)
        pos = pos + n + size
        if (pos > end).any():
            raise ValueError("the scan ends early")
        stop = ~is_dc & (symbol == 0)
        k = np.where(is_dc, 0, k + run)
        if is_dc.any():
            rows = np.flatnonzero(is_dc)
            dc[rows, part[j[rows]]] += v[rows]
            v[rows] = dc[rows, part[j[rows]]]
        some = ((size > 0) | is_dc) & (k < 64)
        flat[block[some] * 64 + k[some]] = v[some]
        k += 1
        done = stop | (k >= 64)
        if done.any():
            block = block + done
            k[done] = 0
            j = np.where(done, (j + 1) % m, j)
            going = block < last
            if not going.all():
                pos, end, block, last, k, j, dc, live = (x[going] for x in (pos, end, block, last, k, j, dc, live))
    return coefs


def thumbnail(image: Image, coefs: np.ndarray) -> np.ndarray:
    """Grey values from the luminance component's DC coefficients: a sample per 8 x 8 block."""
    pattern = image.pattern()
    mine = [n for n, (c, *_) in enumerate(pattern) if c == 0]
    _, h, v, table = image.parts[0]
    if len(image.scan) == 1:
        h = v = 1
    across, down = image.mcus
    values = coefs.reshape(across * down, len(pattern), 64)[:, mine, 0].reshape(down, across, v, h)
    grid = values.transpose(0, 2, 1, 3).reshape(down * v, across * h)
    top = image.tallest
    grid = grid[: -(-(-(-image.height * v // top[1])) // 8), : -(-(-(-image.width * h // top[0])) // 8)]
    return np.clip(np.rint(grid * image.quant[table][0] / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(grey: np.ndarray) -> str:
    """64 bits in hex: which of 8 x 8 evenly placed samples are above their mean."""
    rows = np.arange(8) * grey.shape[0] // 8
    cols = np.arange(8) * grey.shape[1] // 8
    small = grey[np.ix_(rows, cols)].astype(np.int64)
    return np.packbits(small * 64 > small.sum()).tobytes().hex()
