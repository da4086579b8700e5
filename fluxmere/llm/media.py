"""Media columns: progressive JPEG decoding into coefficient arrays and RGB tensors.

The decoder accumulates the scans of a progressive file, spectral selection and successive
approximation both, into coefficient arrays; these are dequantised, inverse-transformed
and level-shifted in numpy, chroma is upsampled to full resolution, and RGB tensors come
out. Entropy decoding runs over all restart intervals of all images of a batch in lockstep:
one numpy step decodes one symbol of every interval, so a file cut into many intervals
costs no Python loop of its own; a file without them is one interval.

The encoder writes a payload of bytes losslessly as quantised coefficients: byte b is the
value whose eight magnitude bits are b (b - 255 below 128), sixty-four a block, so it is
read back exactly from the coefficients that the scans accumulate.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 576
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Integer cosine basis: row k is zigzag coefficient k over the 64 samples, times 2**11.
_c = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
BASIS = np.rint(np.einsum("ux,vy->uvxy", _c, _c).reshape(64, 64) * 2048)[ZIGZAG]
_REACH = float(np.abs(BASIS).sum(0).max())


@dataclass(slots=True)
class Scan:
    #: components, first and last coefficient, high and low bit, DC and AC tables
    kind: tuple
    interval: int
    tables: dict
    data: bytes

    parts = property(lambda self: self.kind[0])
    first = property(lambda self: self.kind[1])
    last = property(lambda self: self.kind[2])
    high = property(lambda self: self.kind[3])
    low = property(lambda self: self.kind[4])
    dc = property(lambda self: self.kind[5])
    ac = property(lambda self: self.kind[6])


@dataclass
class Image:
    width: int
    height: int
    #: by component: identifier, horizontal and vertical factor, quantisation table number
    parts: list[tuple[int, int, int, int]]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)


@lru_cache(4096)
def _head(data: bytes):
    """(width, height, parts, quant, tables, interval) of what stands before a scan, or None
    where the bytes end in the middle of a segment. Files of one size share their heads."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, tables, quant, interval = 2, (), {}, {}, 0
    while at < len(data):
        if data[at] != 0xFF or at + 4 > len(data):
            return None
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if at > len(data):
            return None
        if mark == 0xDB:
            i = 0
            while i < len(body):
                wide, k = body[i] >> 4, body[i] & 15
                n = 128 if wide else 64
                quant[k] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                i += 1 + n
        elif mark == 0xC4:
            _read_tables(body, tables)
        elif mark == 0xC2:
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            frame = w, h, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif mark in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman frames are read")
        elif mark == 0xDD:
            interval = int.from_bytes(body, "big")
    return (*frame, quant, tables, interval)


def _read_tables(body: bytes, tables: dict) -> None:
    i = 0
    while i < len(body):
        n = sum(body[i + 1 : i + 17])
        tables[body[i]] = (bytes(body[i + 1 : i + 17]), bytes(body[i + 17 : i + 17 + n]))
        i += 17 + n


def parse(data: bytes) -> Image:
    """Frame, tables and scans of a progressive file, entropy data still coded."""
    at, head = 0, None
    while head is None:
        at = data.index(b"\xff\xda", at + 1)
        head = _head(data[:at])
    width, height, parts, quant, tables, interval = head
    image = Image(width, height, parts, quant)
    names = [p[0] for p in parts]
    while True:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if mark == 0xD9:
            return image
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xC4:
            tables = dict(tables)
            _read_tables(body, tables)
        elif mark == 0xDD:
            interval = int.from_bytes(body, "big")
        elif mark == 0xDA:
            n = body[0]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            if not (stop := _SCAN_END.search(data, at)):
                raise ValueError("a scan doesn't end")
            kind = (tuple(names.index(x) for x in body[1 : 1 + 2 * n : 2]), first, last, approx >> 4, approx & 15, tuple(x >> 4 for x in body[2 : 2 + 2 * n : 2]), tuple(x & 15 for x in body[2 : 2 + 2 * n : 2]))
            image.scans.append(Scan(kind, interval, tables, data[at : stop.start()]))
            at = stop.start()


@lru_cache(64)
def huffman_lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Symbol and code length (as symbol << 5 | length) for each 16-bit window; 0: no code."""
    table, code, at = np.zeros(65536, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            a = code << (16 - n)
            table[a : a + (1 << (16 - n))] = symbols[at] << 5 | n
            code, at = code + 1, at + 1
        code <<= 1
    return table


class Lanes:
    """Bit readers over all restart intervals of some scans, moved together by the caller.

    Stuffed zeros and markers are cut out at once; ``at`` and ``end`` are bit places."""

    def __init__(self, scans: list[bytes]):
        raw = np.frombuffer(b"\xff\xd0".join([*scans, b""]), np.uint8)
        ff = np.flatnonzero(raw == 255)
        after = raw[ff + 1]
        marks = ff[(after & 0xF8) == 0xD0]
        keep = np.ones(len(raw), bool)
        keep[ff[after == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        stop = marks - np.searchsorted(np.flatnonzero(~keep), marks)
        self.raw = np.concatenate([raw[keep], np.full(8, 255, np.uint8)])
        self.at = np.concatenate([[0], stop[:-1]]) * 8
        self.end = stop * 8
        # 32 bits from each byte on: 25 of them can be had at any bit place
        r = self.raw.astype(np.uint32)
        self.word = (r[:-3] << 24 | r[1:-2] << 16 | r[2:-1] << 8 | r[3:]).astype(np.int64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 25 bits (and some), left-aligned in 32."""
        return self.word[np.minimum(at >> 3, len(self.word) - 1)] << (at & 7) & 0xFFFFFFFF

    def coded(self, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, the size bits that follow it as a number, new places); size is symbol & 15."""
        w = self.window(at)
        got = table[w >> 16]
        if not got.all():
            raise ValueError("broken entropy data")
        length, symbol = got & 31, got >> 5
        size = symbol & 15
        used = length + size
        if used.max() > 25:
            bits = self.window(at + length) >> (32 - size)
        else:
            bits = (w << length & 0xFFFFFFFF) >> (32 - size)
        return symbol, bits, at + used

    def bits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.window(at) >> (32 - n)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed value of ``size`` bits; 0 of none."""
    top = (1 << size) - 1
    return bits - top * (bits <= top >> 1)


@lru_cache(4096)
def _grids(width: int, height: int, parts: tuple) -> tuple:
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    return tuple((-(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8), mw * h, mh * v) for _, h, v, _ in parts)


@lru_cache(4096)
def _units(width: int, height: int, parts: tuple, coded: tuple) -> np.ndarray:
    """(2, steps): component within the scan and block number in the image, in coding order."""
    grids = _grids(width, height, parts)
    base = np.cumsum([0, *(w * h for _, _, w, h in grids)])
    if len(coded) == 1:
        w, h, pw, _ = grids[coded[0]]
        blocks = (np.arange(h)[:, None] * pw + np.arange(w)[None, :]).reshape(-1) + base[coded[0]]
        return np.stack([np.zeros(len(blocks), np.int64), blocks])
    rows = []
    for k, i in enumerate(coded):
        _, h, v, _ = parts[i]
        _, _, pw, ph = grids[i]
        b = (np.arange(pw * ph).reshape(ph // v, v, pw // h, h) + base[i]).transpose(0, 2, 1, 3).reshape(-1, h * v)
        rows.append(np.stack([np.full(b.shape, k), b], -1))
    return np.concatenate(rows, 1).reshape(-1, 2).T


def _decode_scan(images: list[tuple[Image, Scan, int]], coef: np.ndarray) -> None:
    """Add one scan of each image to ``coef`` (blocks, 64 in zigzag order); like scans only."""
    scan = images[0][1]
    units, sizes, steps = [], [], []
    for image, s, base in images:
        u = _units(image.width, image.height, tuple(image.parts), s.parts)
        per = sum(image.parts[i][1] * image.parts[i][2] for i in s.parts) if len(s.parts) > 1 else 1
        units.append(u + np.array([[0], [base]]))
        sizes.append(u.shape[1])
        steps.append(s.interval * per or u.shape[1])
    part_of, block_of = np.concatenate(units, 1)
    sizes, steps = np.array(sizes), np.array(steps)
    lanes = Lanes([s.data for _, s, _ in images])
    per_image = -(-sizes // steps)
    if per_image.sum() != len(lanes.at):
        raise ValueError("a restart interval is missing")
    counts = np.repeat(steps, per_image)
    counts[np.cumsum(per_image) - 1] = sizes - (per_image - 1) * steps
    first = np.cumsum(counts) - counts
    pred = np.zeros((len(counts), len(scan.parts)), np.int64)
    run = np.zeros(len(counts), np.int64)
    tables = {k: huffman_lookup(*t) for k, t in scan.tables.items()}
    for step in range(int(counts.max())):
        live = np.flatnonzero(counts > step)
        part, block = part_of[first[live] + step], block_of[first[live] + step]
        if scan.first == 0:
            if scan.high:
                coef[block, 0] |= lanes.bits(lanes.at[live], 1) << scan.low
                lanes.at[live] += 1
                continue
            for k in np.unique(part):
                m = part == k
                symbol, bits, lanes.at[live[m]] = lanes.coded(lanes.at[live[m]], tables[scan.dc[k]])
                pred[live[m], k] += _extend(bits, symbol & 15)
                coef[block[m], 0] = pred[live[m], k] << scan.low
        elif scan.high:
            _refine_ac(lanes, live, block, coef, scan, tables[0x10 | scan.ac[0]], run)
        else:
            _first_ac(lanes, live, block, coef, scan, tables[0x10 | scan.ac[0]], run)
    if (lanes.at > lanes.end).any():
        raise ValueError("a restart interval is too short")


def _first_ac(lanes, live, block, coef, scan, table, run) -> None:
    if run.any():
        skip = run[live] > 0
        run[live[skip]] -= 1
        live, block = live[~skip], block[~skip]
    at, k = lanes.at[live], np.full(len(live), scan.first)
    flat = coef.reshape(-1)
    block = block * 64
    while len(live):
        symbol, bits, at = lanes.coded(at, table)
        size, r = symbol & 15, symbol >> 4
        k += r
        value = _extend(bits, size) << scan.low
        if size.all():
            if k.max() > scan.last:
                raise ValueError("a run leaves its band")
            flat[block + k] = value
            go = k < scan.last
        else:
            some = size > 0
            if some.any() and k[some].max() > scan.last:
                raise ValueError("a run leaves its band")
            flat[(block + k)[some]] = value[some]
            ends = ~some & (r < 15)
            n = r[ends]
            run[live[ends]] = (1 << n) - 1 + np.where(n > 0, lanes.bits(at[ends], n), 0)
            at[ends] += n
            go = ~ends & (k < scan.last)
        k += 1
        if not go.all():
            lanes.at[live] = at
            live, block, k, at = live[go], block[go], k[go], at[go]


def _refine_ac(lanes, live, block, coef, scan, table, run) -> None:
    """Each lane alternates between a symbol and a walk over the band that corrects non-zero
    coefficients and passes zero ones; the walk's bits are taken all at once by rank."""
    bit = 1 << scan.low
    k = np.full(len(live), scan.first)
    place = np.arange(scan.first, scan.last + 1)[None, :]
    flat = coef.reshape(-1)
    while len(live):
        value, zeros = np.zeros(len(live), np.int64), np.full(len(live), 64)
        ask = np.flatnonzero(run[live] == 0)
        if len(ask):
            symbol, bits, at = lanes.coded(lanes.at[live[ask]], table)
            size, r = symbol & 15, symbol >> 4
            ends, new = (size == 0) & (r < 15), size > 0
            n = r[ends]
            run[live[ask[ends]]] = (1 << n) + np.where(n > 0, lanes.bits(at[ends], n), 0)
            at[ends] += n
            lanes.at[live[ask]] = at
            value[ask[new]] = np.where(bits[new] > 0, bit, -bit)
            zeros[ask[~ends]] = r[~ends]
        band = coef[block, scan.first : scan.last + 1]
        filled = band != 0
        open_ = place >= k[:, None]
        zero = ~filled & open_
        if zero.any():
            # the walk stops at the zero coefficient after ``zeros`` passed ones
            stop = zero & (np.cumsum(zero, 1) == zeros[:, None] + 1)
            has = stop.any(1)
            to = np.where(has, scan.first + stop.argmax(1), scan.last + 1)
            fix = filled & open_ & (place < to[:, None])
        else:
            has, to, fix = np.zeros(len(live), bool), np.full(len(live), scan.last + 1), filled & open_
        count = fix.sum(1)
        if count.any():
            begin = lanes.at[live]
            row, col = np.nonzero(fix)
            at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(row))
            up = lanes.raw[np.minimum(at >> 3, len(lanes.raw) - 1)] >> (7 - (at & 7)).astype(np.uint8) & 1
            lanes.at[live] = begin + count
            where = (block * 64 + scan.first)[row] + col
            old = flat[where]
            flat[where] = old + np.where((up > 0) & (np.abs(old) & bit == 0), np.sign(old) * bit, 0).astype(np.int32)
        put = has & (value != 0)
        coef[block[put], to[put]] = value[put]
        over = run[live] > 0
        run[live[over]] -= 1
        k = np.where(has, to + 1, scan.last + 1)
        go = ~over & (k <= scan.last)
        live, block, k = live[go], block[go], k[go]


def decode_coefficients(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of all blocks in zigzag order, first block of each image). An image's
    blocks are its components' in turn, each row by row, padded to whole MCUs. Scans of one
    kind are decoded for all images together."""
    n_blocks = [sum(w * h for _, _, w, h in _grids(i.width, i.height, tuple(i.parts))) for i in images]
    first = np.concatenate([[0], np.cumsum(n_blocks)]).astype(np.int64)
    coef = np.zeros((int(first[-1]), 64), np.int32)
    for n in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict = {}
        for image, base in zip(images, first.tolist()):
            if n < len(image.scans):
                s = image.scans[n]
                kinds.setdefault((s.kind, tuple(s.tables.items())), []).append((image, s, base))
        for like in kinds.values():
            _decode_scan(like, coef)
    return coef, first


def to_rgb(images: list[Image], coef: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """(height, width, 3) uint8 tensors: dequantise, inverse cosine, upsample, convert.

    The transform multiplies whole numbers by an integer basis in floats that hold every sum
    exactly, so an image's samples don't depend on what it is decoded with. Images of one
    geometry are assembled together."""
    alike: dict = {}
    for n, image in enumerate(images):
        alike.setdefault((image.width, image.height, tuple(image.parts), tuple(q.tobytes() for _, q in sorted(image.quant.items()))), []).append(n)
    out: list = [None] * len(images)
    for (width, height, parts, _), members in alike.items():
        grids = _grids(width, height, parts)
        hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
        size = sum(w * h for _, _, w, h in grids)
        blocks = coef[(first[members][:, None] + np.arange(size)).reshape(-1)].reshape(len(members), size, 64)
        quant = images[members[0]].quant
        planes, at = [], 0
        for (_, h_f, v_f, q), (_, _, w, h) in zip(parts, grids):
            own = blocks[:, at : at + w * h].reshape(-1, 64)
            at += w * h
            if (quant[q] != 1).any():
                own = own * quant[q]
            top = max(int(own.max(initial=0)), -int(own.min(initial=0)))
            kind = np.float32 if top * _REACH < 2**24 else np.float64
            x = own.astype(kind) @ BASIS.astype(kind)
            x = (x.astype(np.int64 if kind is np.float64 else np.int32) + (128 * 2048 + 1024)) >> 11
            x = np.clip(x, 0, 255).astype(np.uint8).reshape(len(members), h, w, 8, 8).transpose(0, 1, 3, 2, 4)
            planes.append((x.reshape(len(members), 8 * h, 8 * w), hm // h_f, vm // v_f))
        up = lambda p, hs, vs: np.repeat(np.repeat(p, hs, 2), vs, 1)[:, :height, :width]
        y = up(*planes[0])
        if len(planes) < 3:
            rgb = np.repeat(y[..., None], 3, 3)
        else:
            (cb, *s1), (cr, *s2) = planes[1], planes[2]
            cb, cr = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
            # what chroma adds is worked out before upsampling
            red, blue = ((91881 * cr + 32768) >> 16).astype(np.int16), ((116130 * cb + 32768) >> 16).astype(np.int16)
            y = y.astype(np.int16)
            rgb = np.empty((*y.shape, 3), np.uint8)
            rgb[..., 0] = np.clip(y + up(red, *s2), 0, 255)
            rgb[..., 2] = np.clip(y + up(blue, *s1), 0, 255)
            if s1 == s2:
                green = up(((-22554 * cb - 46802 * cr + 32768) >> 16).astype(np.int16), *s1)
            else:
                green = ((up(-22554 * cb, *s1) + up(-46802 * cr, *s2) + 32768) >> 16).astype(np.int16)
            rgb[..., 1] = np.clip(y + green, 0, 255)
        for n, x in zip(members, rgb):
            out[n] = x
    return out


# --- writing a payload as coefficients -------------------------------------------------

_DC = (bytes([0, 0, 0, 12, *[0] * 12]), bytes(range(12)))  # all codes of 4 bits
_AC = (bytes([1, 1, *[0] * 14]), bytes([0x07, 0x00]))  # 0: value of 7 bits, 10: end of band
SCRIPT = [([0, 1, 2], 0, 0, 0, 1), *(([i], a, b, 0, 1) for i in range(3) for a, b in ((1, 5), (6, 63))), *(([i], 1, 63, 1, 0) for i in range(3)), ([0, 1, 2], 0, 0, 1, 0)]


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def _intervals(rows: np.ndarray, used: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Byte rows, ``used`` bytes of each, as restart intervals; one stream for each range of
    rows that begins at ``first`` (its last item ends them). Stuffed, RST0..7 in between."""
    n, m = rows.shape
    wide = np.concatenate([rows, np.zeros((n, 2), np.uint8)], 1)
    turn = (np.arange(n) - np.repeat(first[:-1], np.diff(first))) % 8
    wide[np.arange(n), used] = 255
    wide[np.arange(n), used + 1] = 0xD0 + turn
    cols = np.arange(m + 2)[None, :]
    data = cols < used[:, None]
    full = (wide == 255) & data
    size = used + 2 + full.sum(1)
    keep = cols < used[:, None] + 2
    flat, mark = wide[keep], full[keep]
    at = np.arange(len(flat)) + np.cumsum(mark) - mark
    out = np.zeros(int(size.sum()), np.uint8)
    out[at] = flat
    ends = np.concatenate([[0], np.cumsum(size)])[first]
    data = out.tobytes()
    return [data[a : b - 2] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _rows(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit rows as byte rows, filled up with ones, and their common size."""
    rows = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)), constant_values=1), axis=1)
    return rows, np.full(len(rows), rows.shape[1])


def _low(x: np.ndarray) -> np.ndarray:
    """The lowest magnitude bit of the coefficient that stands for byte x."""
    return (x ^ (x < 128)) & 1


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """4:2:0 progressive files whose coefficients hold the payloads (whole blocks of 64 bytes).

    MCU m holds bytes 384 m to 384 m + 383: four luma blocks, Cb, Cr, each in zigzag order;
    what is missing in the last MCUs is bytes 255. MCUs go in rows of up to 512. Every block
    or MCU is a restart interval. First scans carry all bits but the lowest, refinement
    scans that one. All payloads are coded together, scan by scan.
    """
    mcus = np.array([-(-len(p) // 384) for p in payloads])
    cols = np.minimum(mcus, 512)
    rows = -(-mcus // cols)
    total = rows * cols
    first = np.concatenate([[0], np.cumsum(total)])
    mcu = np.frombuffer(b"".join(p.ljust(384 * n, b"\xff") for p, n in zip(payloads, total.tolist())), np.uint8).reshape(-1, 6, 64)
    # a component's own block order, as its single scans go
    luma = [np.arange(4 * r * c).reshape(r, c, 2, 2).transpose(0, 2, 1, 3).reshape(-1) + 4 * f for r, c, f in zip(rows.tolist(), cols.tolist(), first.tolist())]
    order = [mcu[:, :4].reshape(-1, 64)[np.concatenate(luma)], mcu[:, 4], mcu[:, 5]]
    begins = [first * 4, first, first]
    scans = []
    for parts, a, b, high, low in SCRIPT:
        if a == 0 and not high:
            dc = mcu[:, :, 0].astype(np.int64)
            dc = np.where(dc < 128, dc - 255, dc) >> 1
            diff = dc.copy()
            diff[:, 1:4] -= dc[:, 0:3]
            size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
            # codes of 4 bits are the sizes themselves; six of them and their values fill 84 bits at most
            code, width = size << size | np.where(diff < 0, diff + (1 << size) - 1, diff), 4 + size
            place = np.cumsum(width, 1) - width
            bits = np.ones((len(diff), 96), np.uint8)
            for j in range(6):
                for t in range(int(width[:, j].max())):
                    m = np.flatnonzero(width[:, j] > t)
                    bits[m, place[m, j] + t] = code[m, j] >> (width[m, j] - 1 - t) & 1
            data = _intervals(np.packbits(bits, axis=1), (width.sum(1) + 7) // 8, first)
        elif a == 0:
            # DC is shifted arithmetically: what that left out is the value's own lowest bit
            dc = mcu[:, :, 0].astype(np.int16)
            data = _intervals(*_rows((np.where(dc < 128, dc - 255, dc) & 1).astype(np.uint8)), first)
        elif not high:
            # code 0, then the upper seven bits: the byte moved right by one
            data = _intervals(*_rows(np.unpackbits(order[parts[0]][:, a : b + 1] >> 1, axis=1)), begins[parts[0]])
        else:
            x = _low(order[parts[0]][:, 1:])
            data = _intervals(*_rows(np.concatenate([np.tile(np.array([1, 0], np.uint8), (len(x), 1)), x], 1)), begins[parts[0]])
        head = bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in parts) + bytes([a, b, high << 4 | low])
        scans.append((_segment(0xDA, head), data))
    tables = _segment(0xC4, b"\x00" + _DC[0] + _DC[1] + b"\x10" + _AC[0] + _AC[1]) + _segment(0xDD, b"\0\1")
    out = []
    for i, (r, c) in enumerate(zip(rows.tolist(), cols.tolist())):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, r * 16, c * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"".join([b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), frame, tables, *(x for head, data in scans for x in (head, data[i])), b"\xff\xd9"]))
    return out


def payload_of(image: Image, blocks: np.ndarray, size: int) -> bytes:
    """The payload back from an image's coefficients, written by ``encode_payloads``."""
    h, w = image.height // 16, image.width // 16
    n = h * w
    luma = blocks[: 4 * n].reshape(h, 2, w, 2, 64).transpose(0, 2, 1, 3, 4).reshape(n, 4, 64)
    x = np.concatenate([luma, blocks[4 * n : 5 * n, None], blocks[5 * n :, None]], 1).reshape(-1)[:size]
    return (x + 255 * (x < 0)).astype(np.uint8).tobytes()


# --- operators ---------------------------------------------------------------------------


def pad(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text) % UNIT) or (0 if text else UNIT))


_BROKEN = (ValueError, TypeError, IndexError, KeyError, AttributeError, struct.error)


def _tensors(files: list[bytes]) -> list[np.ndarray | None]:
    """RGB tensors, all files together; if one breaks that, each by itself, None for bad ones."""
    try:
        images = [parse(f) for f in files]
        return to_rgb(images, *decode_coefficients(images))
    except _BROKEN:
        return [None] if len(files) == 1 else [_tensors([f])[0] for f in files]


def decode_images(df: DataFrame, column: str = "media", key: str = "doc_id", batch_bytes: int = 600_000) -> DataFrame:
    """key, height, width, rgb (height * width * 3 bytes, row by row) of a column of progressive files.

    Null and unreadable files give nulls; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, files in common.byte_chunks(b.column(1), batch_bytes):
                rows = _tensors(files)
                shape = [[None if r is None else r.shape[k] for r in rows] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(x, pa.int32()) for x in shape), pa.array([None if r is None else r.tobytes() for r in rows], pa.binary())], [key, "height", "width", "rgb"])

    return df.select(key, F.col(column).cast("binary")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, height int, width int, rgb binary")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: whole texts (null: empty) as progressive files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in common.byte_chunks(b.column(1), 1_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_payloads([pad(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, rgb_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Read stored files back: payload digests from the coefficients, features from RGB tensors.

    ``feature`` is size, mean of each channel (milli-units), and its 4-bin histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes = b.column(1).to_pylist()
            for i, j, files in common.byte_chunks(b.column(2), 600_000):
                images = [parse(f) for f in files]
                coef, first = decode_coefficients(images)
                tensors = to_rgb(images, coef, first)
                rows = []
                for image, a, z, rgb, n, f in zip(images, first[:-1], first[1:], tensors, n_bytes[i:j], files):
                    size = -(-n // UNIT) * UNIT or UNIT
                    payload = payload_of(image, coef[a:z], size)
                    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (rgb.shape[0] * rgb.shape[1])
                    bins = [np.bincount(rgb[:, :, c].reshape(-1) >> 6, minlength=4).tolist() for c in range(3)]
                    feature = f"{image.width}x{image.height};" + ",".join(map(str, means)) + ";" + "/".join(",".join(map(str, x)) for x in bins)
                    rows.append((n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), image.height, image.width, hashlib.sha256(rgb.tobytes()).hexdigest(), feature))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a progressive file in shared storage, read back and described.
    Repeated rows are described each; null and empty texts are one unit of bytes 255."""
    return media_features(common.stored(text_media(common.documents(spark, sf_dir)), "media"))
