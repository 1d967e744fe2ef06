"""Media columns as progressive JPEG: payloads kept losslessly as coefficients, decoded to full-resolution RGB tensors.

Stored form. A payload is 64-byte blocks; a byte is a coefficient (byte - 128, zigzag order, quantizer 1), the format's own unit, which
entropy coding keeps exactly. A frame is 16 samples wide, with chroma halved both ways, so that a unit is four luma blocks, a Cb and a Cr block; a
comment tells how many blocks are payload. A payload of over FRAME bytes is a run of frames. Scans: DC at half precision, DC bits,
AC 1-5 and AC 6-63 of each component at half precision, AC bits of each component; restart markers every few blocks.

Reading. Segments between restart markers of all frames and components in a batch are decoded in step, one symbol of each at a time;
scans accumulate in one coefficient array. Correction bits of a refinement scan are applied at once, after its symbols. The inverse
transform is a product of whole numbers (exact in float64), so equal texts give equal tensors in any batch.

Null and empty texts are one block of zero bytes. Null ids and repeated rows are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Blocks of a unit, most units of a frame, blocks between restarts in an AC scan, units between restarts in a DC scan, bytes worked on at once.
UNIT, UNITS, AC_EVERY, DC_EVERY, SLICE = 6, 1024, 8, 4, 2 << 20
FRAME = UNIT * UNITS * 64
#: Blocks of a unit by component (Y, Cb, Cr), and where they stand.
SLOTS = ((0, 4), (4, 5), (5, 6))
BANDS = ((1, 5), (6, 63))
#: AC codes: four bits for the end of a block and sizes 1 to 7 without a run, nine bits for all other symbols. DC codes: four bits.
SHORT = list(range(8))
LONG = [s for s in range(256) if s not in SHORT]
CODE, CODE_BITS = np.zeros(256, np.int64), np.full(256, 9)
CODE[SHORT], CODE_BITS[SHORT] = np.arange(8), 4
CODE[LONG] = 256 + np.arange(len(LONG))
SYMBOL = np.array([SHORT[i >> 5] if i < 256 else LONG[i - 256] if i - 256 < len(LONG) else 0 for i in range(512)], np.int64)
SYMBOL_BITS = np.where(np.arange(512) < 256, 4, 9)
SIZE = np.array([n.bit_length() for n in range(256)])


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


def basis() -> np.ndarray:
    """64 x 64: coefficient in zigzag order to sample, times 2**14, as whole numbers."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()] * (1 << 14))


BASIS = basis()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


TABLES = segment(0xDB, bytes([0] + [1] * 64)) + segment(0xC4, bytes([0x00, 0, 0, 0, 12] + [0] * 12 + list(range(12)))) + segment(0xC4, bytes([0x10, 0, 0, 0, 8, 0, 0, 0, 0, len(LONG)] + [0] * 7 + SHORT + LONG))


def head(units: int, blocks: int) -> bytes:
    frame = segment(0xC2, struct.pack(">BHHB", 8, 16 * units, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return b"\xff\xd8" + segment(0xFE, struct.pack(">I", blocks)) + TABLES + frame


def scan_head(components: list[int], first: int, last: int, before: int, now: int, every: int) -> bytes:
    body = bytes([len(components)] + [x for c in components for x in (c + 1, 0)] + [first, last, before << 4 | now])
    return segment(0xDD, struct.pack(">H", every)) + segment(0xDA, body)


def packed(codes: np.ndarray, bits: np.ndarray, seg: np.ndarray, n: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all n segments (items in order, seg ascending) with stuffing, restart marker marks[i] after segment i (-1: none); ends of the segments."""
    used = np.bincount(seg, bits, n).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(-(-used // 8))]) * 8
    upto = np.cumsum(bits) - bits
    before = np.concatenate([[0], np.cumsum(used)])[:-1]
    at = upto - before[seg] + start[seg]
    pad = -used % 8
    at, bits, codes = (np.concatenate(x) for x in ((at, start[:-1] + used), (bits, pad), (codes, (1 << pad) - 1)))
    room = 64 - bits - (at & 31)  # in two 32-bit words
    wide = codes.astype(np.uint64) << room.astype(np.uint64)
    words = int(start[-1]) // 32 + 3
    word = at >> 5
    total = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    raw = total.astype(np.uint32).astype(">u4").view(np.uint8)[: int(start[-1]) // 8]
    full = raw == 255
    own = np.repeat(np.arange(n), np.diff(start) // 8)
    marked = np.concatenate([[0], np.cumsum(marks >= 0)])
    dest = np.arange(len(raw)) + np.cumsum(full) - full + 2 * marked[own]
    stuffed = np.concatenate([[0], np.cumsum(np.bincount(own, full, n).astype(np.int64))])
    ends = start[1:] // 8 + stuffed[1:] + 2 * marked[1:]
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    out[dest] = raw
    has = marks >= 0
    out[ends[has] - 2], out[ends[has] - 1] = 255, 0xD0 + marks[has] % 8
    return out, ends


def segments_of(counts: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of runs of counts blocks: first block, number of blocks, restart mark (-1 after a run's last)."""
    parts = -(-counts // every)
    run = np.repeat(np.arange(len(counts)), parts)
    k = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(np.cumsum(counts) - counts, parts) + k * every
    return first, np.minimum(every, counts[run] - k * every), np.where(k == parts[run] - 1, -1, k)


def first_items(c: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, bits, block) of a first AC scan of a band, in order."""
    band = c[:, low : high + 1]
    half = np.sign(band) * (np.abs(band) >> 1)
    block, k = np.nonzero(half)
    v = half[block, k].astype(np.int64)
    new = np.diff(block, prepend=-1) != 0
    run = k - np.where(new, 0, np.concatenate([[0], k[:-1] + 1]))
    size = SIZE[np.abs(v)]
    symbol = (run & 15) << 4 | size
    code = CODE[symbol] << size | np.where(v > 0, v, v + (1 << size) - 1)
    times = run >> 4
    last = np.full(len(c), -1)
    last[block] = k
    short = np.flatnonzero(last < high - low)
    key = np.concatenate([block * 64 + k, np.repeat(block * 64 + k, times), short * 64 + 63])
    order = np.argsort(np.concatenate([(block * 64 + k) * 2 + 1, np.repeat(block * 64 + k, times) * 2, short * 128 + 127]), kind="stable")
    codes = np.concatenate([code, np.full(times.sum(), CODE[0xF0]), np.full(len(short), CODE[0])])[order]
    bits = np.concatenate([CODE_BITS[symbol] + size, np.full(times.sum(), CODE_BITS[0xF0]), np.full(len(short), CODE_BITS[0])])[order]
    return codes, bits, key[order] >> 6


def refine_items(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, bits, block) of an AC refinement scan, in order: a symbol stands before the correction bits that it passes."""
    a = np.abs(c[:, 1:])
    old, new = a > 1, a == 1
    fresh, k = np.nonzero(new)
    still = np.cumsum(a <= 1, axis=1, dtype=np.int64)  # places without history up to here
    start = np.where(np.diff(fresh, prepend=-1) != 0, 0, np.concatenate([[0], k[:-1] + 1]))
    ahead = np.where(start > 0, still[fresh, np.maximum(start - 1, 0)], 0)
    run = still[fresh, k] - 1 - ahead
    places, rows = [start], [fresh]
    symbols = [(run & 15) << 4 | 1]
    signs = [(c[fresh, k + 1] > 0).astype(np.int64)]
    for i in np.flatnonzero(run > 15):  # a run of 16 places ends at the sixteenth, and the next symbol follows it
        zero = np.flatnonzero(a[fresh[i], start[i] : k[i]] <= 1) + start[i]
        cuts = zero[15::16][: run[i] >> 4] + 1
        places.append(np.concatenate([[start[i]], cuts[:-1]]))
        places[0][i] = cuts[-1]
        rows.append(np.full(len(cuts), fresh[i]))
        symbols.append(np.full(len(cuts), 0xF0))
        signs.append(np.zeros(len(cuts), np.int64))
    at, row, symbol, sign = map(np.concatenate, (places, rows, symbols, signs))
    tail = np.zeros(len(c), np.int64)
    tail[fresh] = k + 1
    ended = np.flatnonzero(tail < 63)
    block, place = np.nonzero(old)
    bit = a[block, place].astype(np.int64) & 1
    one = symbol & 1
    key = np.concatenate([(row * 64 + at) * 2, (ended * 64 + tail[ended]) * 2, (block * 64 + place) * 2 + 1])
    codes = np.concatenate([CODE[symbol] << one | sign * one, np.full(len(ended), CODE[0]), bit])
    bits = np.concatenate([CODE_BITS[symbol] + one, np.full(len(ended), CODE_BITS[0]), np.ones(len(bit), np.int64)])
    order = np.argsort(key, kind="stable")
    return codes[order], bits[order], key[order] >> 7


def encode(payloads: list[bytes]) -> list[bytes]:
    """A frame for each payload of at most FRAME bytes, a positive multiple of 64."""
    blocks = np.array([len(p) // 64 for p in payloads])
    units = -(-blocks // UNIT)
    first = np.cumsum(units) - units
    c = np.zeros((int(units.sum()) * UNIT, 64), np.int16)
    rows = np.repeat(first * UNIT - (np.cumsum(blocks) - blocks), blocks) + np.arange(blocks.sum())
    c[rows] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int16) - 128
    parts = c.reshape(-1, UNIT, 64)
    out = [[head(int(u), int(b))] for u, b in zip(units, blocks, strict=True)]

    def add(items, counts, every, heading):
        begin, size, marks = segments_of(counts, every)
        codes, bits, block = items
        seg = np.searchsorted(begin, block, "right") - 1
        raw, ends = packed(codes, bits, seg, len(begin), marks)
        cuts = ends[np.cumsum(-(-counts // every)) - 1]
        for i, (a, b) in enumerate(zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True)):
            out[i] += [heading, raw[a:b].tobytes()]

    dc = parts[:, :, 0].astype(np.int64)
    high = dc >> 1
    begin = segments_of(units, DC_EVERY)[0]
    flat = [high[:, a:b].ravel() for a, b in SLOTS]
    for f, (a, b) in zip(flat, SLOTS, strict=True):
        f[1:] -= f[:-1].copy()
        f[begin * (b - a)] = high[begin, a]
    diff = np.concatenate([f.reshape(-1, b - a) for f, (a, b) in zip(flat, SLOTS, strict=True)], axis=1).ravel()
    size = SIZE[np.abs(diff)]
    unit = np.arange(len(diff)) // UNIT
    add((size << size | np.where(diff >= 0, diff, diff + (1 << size) - 1), 4 + size, unit), units, DC_EVERY, scan_head([0, 1, 2], 0, 0, 0, 1, DC_EVERY))
    add((dc.ravel() & 1, np.ones(len(diff), np.int64), unit), units, DC_EVERY, scan_head([0, 1, 2], 0, 0, 1, 0, DC_EVERY))
    for n, (a, b) in enumerate(SLOTS):
        own = parts[:, a:b].reshape(-1, 64)
        for low, top in BANDS:
            add(first_items(own, low, top), units * (b - a), AC_EVERY, scan_head([n], low, top, 0, 1, AC_EVERY))
        add(refine_items(own), units * (b - a), AC_EVERY, scan_head([n], 1, 63, 1, 0, AC_EVERY))
    return [b"".join(o) + b"\xff\xd9" for o in out]


class Bits:
    """Windows of 32 bits at any place of the unstuffed bytes."""

    def __init__(self, raw: np.ndarray):
        wide = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.window = wide[:-4] << np.uint64(32) | wide[1:-3] << np.uint64(24) | wide[2:-2] << np.uint64(16) | wide[3:-1] << np.uint64(8) | wide[4:]
        self.last = (len(self.window) - 1) * 8

    def at(self, pos: np.ndarray) -> np.ndarray:
        pos = np.minimum(pos, self.last)
        return ((self.window[pos >> 3] >> (8 - (pos & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def magnitude(word: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed value of size bits after a code."""
    v = (word >> (32 - code - size)) & ((1 << size) - 1)
    return np.where((v << 1) >> size == 0, v - (1 << size) + 1, v) * (size > 0)


def read_first(bits: Bits, pos: np.ndarray, begin: np.ndarray, count: np.ndarray, low: int, high: int, c: np.ndarray) -> None:
    block, end, k, flat = begin.copy(), begin + count, np.full(len(pos), low), c.reshape(-1)
    while len(pos):
        word = bits.at(pos)
        top = word >> 23
        symbol, code = SYMBOL[top], SYMBOL_BITS[top]
        size = symbol & 15
        k = np.where(symbol == 0, 64, k + (symbol >> 4))
        flat[block * 64 + np.minimum(k, 63)] += np.where(k < 64, magnitude(word, code, size) << 1, 0).astype(np.int16)
        pos = pos + code + size
        k += 1
        done = k > high
        if done.any():
            block, k = block + done, np.where(done, low, k)
            alive = block < end
            if not alive.all():
                pos, block, end, k = pos[alive], block[alive], end[alive], k[alive]


def read_refinement(bits: Bits, pos: np.ndarray, begin: np.ndarray, count: np.ndarray, c: np.ndarray) -> None:
    old = c[:, 1:] != 0
    mixed = np.flatnonzero(~old.all(axis=1))
    spot = np.zeros(len(c), np.int64)
    spot[mixed] = np.arange(1, len(mixed) + 1)
    empty = np.full((len(mixed) + 1, 80), 63, np.int64)  # places without history, then the end
    ranks = np.argsort(old[mixed], axis=1, kind="stable")
    sizes = (~old[mixed]).sum(axis=1)
    empty[1:, :63] = np.where(np.arange(63) < sizes[:, None], ranks, 63)
    before = np.zeros((len(mixed) + 1, 64), np.int64)  # places without history ahead of a place
    before[1:, 1:] = np.cumsum(~old[mixed], axis=1)
    block, end, k = begin.copy(), begin + count, np.zeros(len(pos), np.int64)
    told = []
    while len(pos):
        word = bits.at(pos)
        top = word >> 23
        symbol, code = SYMBOL[top], SYMBOL_BITS[top]
        one = symbol & 1
        row = spot[block]
        target = np.where(symbol == 0, 63, empty[row, np.minimum(before[row, k] + (symbol >> 4), 79)])
        pos = pos + code + one
        passed = target - k - (before[row, target] - before[row, k])
        told.append((block * 64 + k, pos, passed))
        hit = (one == 1) & (target < 63)
        c[block[hit], target[hit] + 1] = np.where((word[hit] >> (31 - code[hit])) & 1, 1, -1)
        pos = pos + passed
        k = target + 1
        done = k > 62
        block, k = block + done, np.where(done, 0, k)
        alive = block < end
        if not alive.all():
            pos, block, end, k = pos[alive], block[alive], end[alive], k[alive]
    key, at, passed = (np.concatenate(x) for x in zip(*told, strict=True))
    order = np.argsort(key, kind="stable")
    at, passed = at[order], passed[order]
    where = np.repeat(at - (np.cumsum(passed) - passed), passed) + np.arange(passed.sum())
    rows, place = np.nonzero(old)
    bit = (bits.at(where) >> 31).astype(np.int16)
    v = c[rows, place + 1]
    c[rows, place + 1] = v + np.sign(v) * bit


def scans_of(raw: bytes, base: int, marks: np.ndarray) -> tuple[int, int, list[tuple]]:
    """Units, payload blocks and scans (components, first, before, start, end) of the frame at base; marks: places of true markers after entropy-coded data."""
    at, units, blocks, scans = base + 2, 0, 0, []
    while raw[at + 1] != 0xD9:
        marker, length = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            blocks = int.from_bytes(body, "big")
        elif marker == 0xC2:
            units = int.from_bytes(body[1:3], "big") // 16
        elif marker == 0xDA:
            end = int(marks[np.searchsorted(marks, at)])
            scans.append((tuple(body[1 : 1 + 2 * body[0] : 2]), body[-3], body[-1] >> 4, at, end))
            at = end
    return units, blocks, scans


def coefficients(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, 6, 64) coefficients of all frames, units of each frame, payload blocks of each frame."""
    raw = b"".join(frames)
    buf = np.frombuffer(raw, np.uint8)
    ff = np.flatnonzero(buf[:-1] == 255)
    after = buf[ff + 1]
    restart = (after >= 0xD0) & (after <= 0xD7)
    marks = ff[(after != 0) & ~restart]
    base = np.cumsum([0] + [len(f) for f in frames])[:-1]
    told = [scans_of(raw, int(b), marks) for b in base]
    units, blocks = np.array([t[0] for t in told]), np.array([t[1] for t in told])
    keep = np.ones(len(buf), bool)
    keep[ff[after == 0] + 1] = False
    moved = np.cumsum(keep) - keep
    bits = Bits(buf[keep])
    resets = ff[restart]

    def starts(scans: list[tuple]) -> np.ndarray:
        """Bit places of the segments of scans in order."""
        a, b = np.array([s[3] for s in scans]), np.array([s[4] for s in scans])
        lo, hi = np.searchsorted(resets, a), np.searchsorted(resets, b)
        n = hi - lo
        inner = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return moved[np.sort(np.concatenate([a, resets[inner] + 2]))] * 8

    out = np.zeros((int(units.sum()), UNIT, 64), np.int16)
    pick = lambda first, before, comps: [s for t in told for s in t[2] if (s[1], s[2], s[0]) == (first, before, comps)]
    begin, count, _ = segments_of(units, DC_EVERY)
    pos = starts(pick(0, 0, (1, 2, 3)))
    last = np.zeros((3, len(pos)), np.int64)
    for step in range(DC_EVERY * UNIT):
        who = np.flatnonzero(step // UNIT < count)
        slot = step % UNIT
        part = max(0, slot - 3)
        word = bits.at(pos[who])
        size = word >> 28
        last[part, who] += magnitude(word, np.full(len(who), 4), size)
        out[begin[who] + step // UNIT, slot, 0] = last[part, who] << 1
        pos[who] += 4 + size
    pos = starts(pick(0, 1, (1, 2, 3)))
    for step in range(DC_EVERY * UNIT):
        who = np.flatnonzero(step // UNIT < count)
        out[begin[who] + step // UNIT, step % UNIT, 0] |= (bits.at(pos[who] + step) >> 31).astype(np.int16)
    own = [np.ascontiguousarray(out[:, a:b]).reshape(-1, 64) for a, b in SLOTS]
    offset = np.cumsum([0] + [len(o) for o in own])
    every = np.concatenate(own)
    cuts = [segments_of(units * (b - a), AC_EVERY) for a, b in SLOTS]
    firsts, counts = np.concatenate([s[0] + o for s, o in zip(cuts, offset, strict=False)]), np.concatenate([s[1] for s in cuts])
    for low, high in BANDS:
        read_first(bits, np.concatenate([starts(pick(low, 0, (n,))) for n in (1, 2, 3)]), firsts, counts, low, high, every)
    read_refinement(bits, np.concatenate([starts(pick(1, 1, (n,))) for n in (1, 2, 3)]), firsts, counts, every)
    for n, (a, b) in enumerate(SLOTS):
        out[:, a:b] = every[offset[n] : offset[n + 1]].reshape(-1, b - a, 64)
    return out, units, blocks


def rgb(c: np.ndarray) -> np.ndarray:
    """(units, 16, 16, 3) RGB samples of (units, 6, 64) coefficients: inverse transform, chroma brought to full resolution, colours."""
    samples = np.floor((c.reshape(-1, 64).astype(np.float64) @ BASIS) / (1 << 14) + 128.5)
    s = np.clip(samples, 0, 255).astype(np.float32).reshape(-1, UNIT, 8, 8)
    y = s[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (s[:, n].repeat(2, axis=1).repeat(2, axis=2) - 128 for n in (4, 5))
    # The colour transform of the file format.
    colours = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.rint(colours), 0, 255).astype(np.uint8)


def tensor(media: list[bytes]) -> np.ndarray:
    """(height, 16, 3) RGB tensor of a run of frames."""
    return rgb(coefficients(media)[0]).reshape(-1, 16, 3)


def frames_of(text: bytes) -> list[bytes]:
    payload = text + b"\0" * (-len(text) % 64 if text else 64)
    return [payload[a : a + FRAME] for a in range(0, len(payload), FRAME)]


class Digest:
    """What is told of one text, grown frame by frame."""

    def __init__(self):
        self.payload, self.media, self.sizes, self.tail, self.sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0], b"", np.zeros(3, np.int64)

    def add(self, payload: bytes, media: bytes, pixels: np.ndarray) -> None:
        self.payload.update(payload)
        self.media.update(media)
        self.tail = payload[-64:]
        self.sums += pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        self.sizes = [a + b for a, b in zip(self.sizes, (len(payload), len(media), 16 * len(pixels)), strict=True)]

    def row(self, doc_id: int | None, n_bytes: int) -> tuple:
        feature = f"16x{self.sizes[2]}:" + ",".join(f"{s / (16 * self.sizes[2]):.3f}" for s in self.sums)
        return doc_id, n_bytes, self.sizes[0], self.payload.hexdigest(), zlib.crc32(self.tail), self.sizes[1], self.media.hexdigest(), feature


KIND = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """KIND of docs(doc_id, text): each text stored as progressive JPEG, read back, and made into RGB tensors."""

    def work(group: list[tuple[int, bytes]], told: dict[int, Digest]) -> None:
        media = encode([p for _, p in group])
        c, units, blocks = coefficients(media)
        pixels = rgb(c)
        at = 0
        for (row, _), one, u, b in zip(group, media, units, blocks, strict=True):
            back = (c[at : at + u].reshape(-1, 64)[:b] + 128).astype(np.uint8).tobytes()
            told.setdefault(row, Digest()).add(back, one, pixels[at : at + u])
            at += u

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            told: dict[int, Digest] = {}
            group: list[tuple[int, bytes]] = []
            size = 0
            for row in range(batch.num_rows):
                for payload in frames_of(texts[row].as_py()):
                    group.append((row, payload))
                    size += len(payload)
                    if size >= SLICE:
                        work(group, told)
                        group, size = [], 0
            if group:
                work(group, told)
            sizes = pc.binary_length(texts).to_pylist()
            rows = [told[r].row(ids[r], sizes[r]) for r in range(batch.num_rows)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(run, KIND)
