"""Media columns as progressive JPEG, decoded to full-resolution RGB tensors in numpy.

Decoder: scans are accumulated into coefficient arrays of each component. First
scans (spectral selection, with or without a point transform) of all images of a
batch step together, one Huffman symbol in every restart interval at a time;
refinement scans (successive approximation) take their correction bits in bulk
where a run covers known coefficients, and symbol by symbol otherwise. Then an
exact integer inverse transform, chroma upsampling by repetition and colour
conversion give the tensor. Any sampling factors, any script of scans.

Lossless storage: the unit is the quantised coefficient. A payload of 192-byte
groups becomes one 8x8 block for each of three components, coefficient k holding
byte k + 256, with all quantisers 1. Then every coefficient's high bit is set and
the scans are plain: DC and AC bands by their high bits, then one refinement.

Defined results: a null text is empty; equal texts give equal values in any batch
(all arithmetic is exact); repeated rows give the same result; an empty table
gives no rows. A stored image that is cut or damaged raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.llm import _text as T

GROUP = 192
#: Blocks in a restart interval of the first AC scans, and MCUs in one of the first DC scan.
AC_INTERVAL, DC_INTERVAL = 4, 32
_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position."""
    order = sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), (i // 8) if s % 2 else (i % 8)))
    return np.array(order)


ZIGZAG = _zigzag()
_SHIFT = 13
_BASIS = np.array([[round((1 << _SHIFT) * (np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)) for u in range(8)] for x in range(8)], np.float64)


# --- writing ---------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, number: int, symbols: list[int], length: int) -> bytes:
    """A table whose codes all have one length."""
    counts = bytes(len(symbols) if i == length else 0 for i in range(1, 17))
    return bytes([kind << 4 | number]) + counts + bytes(symbols)


#: DC categories take four bits each; a first AC scan has one symbol; runs of blocks take four bits.
_TABLES = _segment(0xC4, _dht(0, 0, list(range(12)), 4) + _dht(1, 0, [0x08], 1) + _dht(1, 1, [n << 4 for n in range(15)], 4))
_ONES = _segment(0xDB, b"\x00" + b"\x01" * 64)


def _sos(parts: list[tuple[int, int, int]], lo: int, hi: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c, d << 4 | a]) for c, d, a in parts) + bytes([lo, hi, high << 4 | low]))


#: (components, first and last coefficient, Ah, Al)
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1),
    ((0,), 1, 63, 1, 0), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0),
)


def _dri(n: int) -> bytes:
    return _segment(0xDD, struct.pack(">H", n))


def _rows_to_scans(bits: np.ndarray, used: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
    """Entropy-coded data of each image. bits: a row per restart interval, of used bits each; of: image of each row."""
    width = bits.shape[1] + (-bits.shape[1]) % 8
    padded = np.ones((len(bits), width), np.uint8)
    padded[:, : bits.shape[1]] = np.where(np.arange(bits.shape[1]) < used[:, None], bits, 1)
    raw = np.packbits(padded, axis=1)
    size = (used + 7) >> 3
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    last = np.append(first[1:], True)
    start = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    restart = 0xD0 + (np.arange(len(of)) - start) % 8
    full = np.concatenate([raw, np.full((len(raw), 1), 0xFF, np.uint8), restart[:, None].astype(np.uint8)], 1)
    keep = np.zeros(full.shape, bool)
    keep[:, :-2] = np.arange(raw.shape[1]) < size[:, None]
    keep[:, -2:] = ~last[:, None]
    stuff = full == 0xFF
    stuff[:, -2:] = False
    flat, stuff = full[keep], stuff[keep]
    out = np.repeat(flat, 1 + stuff)
    at = np.cumsum(1 + stuff) - 1
    out[at[stuff]] = 0
    length = np.bincount(of, size + 2 * ~last, n).astype(np.int64) + np.bincount(np.repeat(of, keep.sum(1)), stuff, n).astype(np.int64)
    data, end = out.tobytes(), np.cumsum(length)
    return [data[e - k : e] for e, k in zip(end.tolist(), length.tolist(), strict=True)]


def _intervals(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, first unit within the batch, units) of each restart interval."""
    rows = -(-count // size)
    of = np.repeat(np.arange(len(count)), rows)
    nth = np.arange(len(of)) - (np.cumsum(rows) - rows)[of]
    return of, (np.cumsum(count) - count)[of] + nth * size, np.minimum(size, count[of] - nth * size)


def _first_ac(values: np.ndarray, count: np.ndarray) -> list[bytes]:
    """values: blocks x coefficients of eight bits with the high bit set; a zero bit is the one symbol's code."""
    width = values.shape[1]
    bits = np.zeros((len(values), width, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(np.ascontiguousarray(values), axis=1).reshape(len(values), width, 8)
    of, at, units = _intervals(count, AC_INTERVAL)
    index = np.minimum(at[:, None] + np.arange(AC_INTERVAL), len(values) - 1)
    return _rows_to_scans(bits.reshape(len(values), -1)[index].reshape(len(of), -1), units * width * 9, of, len(count))


def _first_dc(values: np.ndarray, count: np.ndarray) -> list[bytes]:
    """values: blocks x 3 of DC after the point transform."""
    of, at, units = _intervals(count, DC_INTERVAL)
    slot = np.arange(DC_INTERVAL)
    index = np.minimum(at[:, None] + slot, len(values) - 1)
    v = values[index].astype(np.int64)
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    size = np.where(d == 0, 0, np.int64(np.floor(np.log2(np.maximum(np.abs(d), 1)))) + 1)
    extra = np.where(d < 0, d + (1 << size) - 1, d)
    code, length = (size << size) | extra, 4 + size
    length = np.where(slot[None, :, None] < units[:, None, None], length, 0).reshape(len(of), -1)
    code = code.reshape(len(of), -1)
    end = np.cumsum(length, 1)
    used = end[:, -1]
    bits = np.zeros((len(of), int(used.max())), np.uint8)
    rows = np.arange(len(of))[:, None]
    for b in range(int(length.max())):
        on = length > b
        where = (end - 1 - b)[on]
        bits[np.broadcast_to(rows, on.shape)[on], where] = (code[on] >> b) & 1
    return _rows_to_scans(bits, used, of, len(count))


def _refine(plane: np.ndarray, count: np.ndarray, ac: bool) -> list[bytes]:
    """plane: blocks x coefficients of the low bit."""
    out, at = [], 0
    for n in count.tolist():
        pieces = []
        for i in range(at, at + n, 32767 if ac else n):
            m = min(32767, at + n - i) if ac else n
            if ac:
                k = m.bit_length() - 1
                pieces.append(np.array([(k >> s) & 1 for s in (3, 2, 1, 0)] + [(m >> s) & 1 for s in range(k - 1, -1, -1)], np.uint8))
            pieces.append(plane[i : i + m].ravel())
        bits = np.concatenate(pieces)
        raw = np.packbits(np.concatenate([bits, np.ones((-len(bits)) % 8, np.uint8)])).tobytes()
        out.append(raw.replace(b"\xff", b"\xff\x00"))
        at += n
    return out


def store(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (a positive multiple of 192 bytes)."""
    groups = np.array([len(p) // GROUP for p in payloads])
    if any(len(p) % GROUP or not p for p in payloads):
        raise ValueError("payloads are positive multiples of 192 bytes")
    wide = np.minimum(groups, 8191)
    count = wide * -(-groups // wide)
    raw = b"".join(p + b" " * (GROUP * int(c - g)) for p, c, g in zip(payloads, count, groups, strict=True))
    value = np.frombuffer(raw, np.uint8).reshape(-1, 3, 64)
    high, low = (value >> 1) | 0x80, value & 1  # of byte + 256
    scans = []
    for parts, lo, hi, ah, _ in SCRIPT:
        if ah:
            plane = low[:, :, 0] if lo == 0 else low[:, parts[0], lo : hi + 1]
            scans.append(_refine(plane, count, lo > 0))
        else:
            scans.append(_first_dc(high[:, :, 0], count) if lo == 0 else _first_ac(high[:, parts[0], lo : hi + 1], count))
    heads = [(_dri(DC_INTERVAL if lo == 0 else AC_INTERVAL) if not ah else _dri(0)) + _sos([(c + 1, 0, 1 if ah else 0) for c in parts], lo, hi, ah, al) for parts, lo, hi, ah, al in SCRIPT]
    out = []
    for i, n in enumerate(groups.tolist()):
        w = int(wide[i])
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 8 * int(count[i]) // w, 8 * w, 3) + b"\x01\x11\x00\x02\x11\x00\x03\x11\x00")
        comment = _segment(0xFE, b"groups %d" % n)
        out.append(b"\xff\xd8" + comment + _ONES + frame + _TABLES + b"".join(h + s[i] for h, s in zip(heads, scans, strict=True)) + b"\xff\xd9")
    return out


# --- reading ---------------------------------------------------------------


class Image:
    """A parsed image: its scans, still coded, and coefficient arrays once they are read."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.comments: list[bytes] = []
        self.scans: list[tuple] = []
        quant: dict[int, np.ndarray] = {}
        tables: dict[tuple[int, int], bytes] = {}
        restart, at, self.frame = 0, 2, None
        while True:
            while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            if at + 4 > len(data):
                raise ValueError("cut short")
            size = data[at + 2] << 8 | data[at + 3]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                    quant[body[0] & 15] = raw.astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xDD:
                restart = body[0] << 8 | body[1]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xC2:
                precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if precision != 8:
                    raise ValueError("samples of 8 bits only")
                self.frame = {body[6 + 3 * i]: i for i in range(n)}
                self.sampling = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
                self.quant_of = [body[8 + 3 * i] for i in range(n)]
                self._shape()
            elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a progressive Huffman frame")
            elif marker == 0xDA:
                n = body[0]
                parts = tuple(self.frame[body[1 + 2 * i]] for i in range(n))
                used = tuple(body[2 + 2 * i] for i in range(n))
                lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
                end = _MARK.search(data, at)
                if end is None:
                    raise ValueError("cut short")
                coded = data[at : end.start()]
                at = end.start()
                huff = tuple(tables.get((0, u >> 4) if lo == 0 else (1, u & 15)) for u in used)
                self.scans.append((parts, lo, hi, approx >> 4, approx & 15, huff, restart, coded))
        self.quant = [quant[q] for q in self.quant_of]
        self.base = 0

    def _shape(self):
        hm, vm = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.mcus = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        self.blocks = [(self.mcus[0] * h, self.mcus[1] * v) for h, v in self.sampling]
        self.own = [(-(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)) for h, v in self.sampling]
        self.simple = all(s == (1, 1) for s in self.sampling)

    def units(self, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(component, block) of each data unit of a scan in order, and units to an MCU."""
        if len(parts) == 1:
            w, h = self.own[parts[0]]
            block = (np.arange(h)[:, None] * self.blocks[parts[0]][0] + np.arange(w)).ravel()
            return np.full(len(block), parts[0]), block, 1
        mx, my = self.mcus
        if self.simple:
            block = np.repeat(np.arange(mx * my), len(parts))
            return np.tile(np.array(parts), mx * my), block, len(parts)
        comp, block = [], []
        gy, gx = (g.ravel() for g in np.mgrid[0:my, 0:mx])
        for c in parts:
            h, v = self.sampling[c]
            for y in range(v):
                for x in range(h):
                    comp.append(np.full(mx * my, c))
                    block.append((gy * v + y) * self.blocks[c][0] + gx * h + x)
        return np.stack(comp, 1).ravel(), np.stack(block, 1).ravel(), len(comp)


def _lut(table: bytes | None) -> np.ndarray:
    """(length << 8 | symbol) by the next 16 bits; 0 for no code."""
    if table is None:
        raise ValueError("no Huffman table")
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_LUTS: dict[bytes, np.ndarray] = {}


def lut(table: bytes | None) -> np.ndarray:
    if table not in _LUTS:
        if len(_LUTS) > 64:
            _LUTS.clear()
        _LUTS[table] = _lut(table)
    return _LUTS[table]


class Lanes:
    """Bit readers of many restart intervals that step together."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 8
        raw = np.frombuffer((b"\xff" * 8).join(pieces) + b"\xff" * 16, np.uint8).astype(np.uint64)
        n = len(raw) - 4
        self.window = raw[:n] << np.uint64(32) | raw[1 : n + 1] << np.uint64(24) | raw[2 : n + 2] << np.uint64(16) | raw[3 : n + 3] << np.uint64(8) | raw[4 : n + 4]
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.end = self.at + (sizes - 8) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 33 bits or more, at the top of 40."""
        return (self.window[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF)


def _split(coded: bytes, mcus: int, restart: int) -> list[bytes]:
    pieces = _RST.split(coded) if restart else [coded]
    if restart and len(pieces) != -(-mcus // restart):
        raise ValueError("restart intervals don't match")
    return [p.replace(b"\xff\x00", b"\xff") for p in pieces]


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def _read_first(group: list[tuple[Image, tuple]], store_: list[np.ndarray]) -> None:
    """First scans with the same parameters, of several images at once. store_: coefficient arrays of each component, of all images."""
    parts, lo, hi, _, low, huff, _, _ = group[0][1]
    pieces, lane_units, comp, block = [], [], [], []
    for image, scan in group:
        c, b, per = image.units(parts)
        restart = scan[6]
        got = _split(scan[7], len(c) // per, restart)
        pieces += got
        size = restart * per if restart else len(c)
        lane_units += [min(size, len(c) - i * size) for i in range(len(got))]
        comp.append(c)
        block.append(b + image.bases[parts[0]] if len(parts) == 1 else b + np.array([image.bases[i] for i in range(len(image.bases))])[c])
    comp, block = np.concatenate(comp), np.concatenate(block)
    units = np.array(lane_units)
    first = np.cumsum(units) - units
    lanes = Lanes(pieces)
    at, lane = lanes.at.copy(), np.arange(len(units))
    tables = [lut(h) for h in huff]
    if lo == 0:
        index = {c: i for i, c in enumerate(parts)}
        stacked = np.stack(tables)
        which = np.array([index.get(i, 0) for i in range(max(parts) + 1)])
        pred = np.zeros((len(units), len(parts)), np.int64)
        for step in range(int(units.max())):
            on = lane[units > step]
            u = first[on] + step
            t = which[comp[u]]
            word = lanes.peek(at[on])
            found = stacked[t, (word >> np.uint64(24)).astype(np.int64)]
            length, size = found >> 8, found & 255
            if (found == 0).any() or (size > 11).any():
                raise ValueError("no such code")
            value = ((word >> (np.uint64(40) - (length + size).astype(np.uint64))).astype(np.int64)) & ((1 << size) - 1)
            pred[on, t] += _extend(value, size)
            at[on] += length + size
            value = pred[on, t] << low
            for c in parts:
                mine = comp[u] == c
                store_[c][block[u[mine]], 0] = value[mine]
    else:
        table, target = tables[0], store_[parts[0]].reshape(-1)
        unit, k, left = first.copy(), np.full(len(units), lo), units.copy()
        while len(lane):
            word = lanes.peek(at)
            found = table[(word >> np.uint64(24)).astype(np.int64)]
            length = found >> 8
            run, size = (found & 255) >> 4, found & 15
            plain = size > 0
            extra = np.where(plain | (run == 15), size, run)
            value = (word >> (np.uint64(40) - (length + extra).astype(np.uint64))).astype(np.int64) & ((1 << extra) - 1)
            at = at + length + extra
            if not length.all():
                raise ValueError("no such code")
            if plain.all():
                k = k + run
                if (k > hi).any():
                    raise ValueError("a coefficient beyond its band")
                target[block[unit] * 64 + k] = _extend(value, size) << low if low == 0 else np.sign(_extend(value, size)) * (np.abs(_extend(value, size)) << low)
                k = k + 1
                skip = (k > hi).astype(np.int64)
            else:
                k = k + np.where(plain, run, np.where(run == 15, 16, 0))
                if (k[plain] > hi).any():
                    raise ValueError("a coefficient beyond its band")
                v = _extend(value[plain], size[plain])
                target[block[unit[plain]] * 64 + k[plain]] = np.sign(v) * (np.abs(v) << low)
                k = k + plain
                ends = ~plain & (run < 15)
                skip = np.where(ends, (1 << np.minimum(run, 14)) + value, (k > hi).astype(np.int64))
            moved = skip > 0
            if moved.any():
                unit, left, k = unit + skip, left - skip, np.where(moved, lo, k)
                if (left <= 0).any():
                    if (left < 0).any():
                        raise ValueError("a run beyond its interval")
                    alive = left > 0
                    at, lane, unit, k, left = at[alive], lane[alive], unit[alive], k[alive], left[alive]


def _read_refinement(image: Image, scan: tuple, store_: list[np.ndarray]) -> None:
    """One refinement scan of one image."""
    parts, lo, hi, _, low, huff, restart, coded = scan
    comp, block, per = image.units(parts)
    pieces = _split(coded, len(comp) // per, restart)
    size = restart * per if restart else len(comp)
    for i, piece in enumerate(pieces):
        bits = np.unpackbits(np.frombuffer(piece, np.uint8))
        c, b = comp[i * size : (i + 1) * size], block[i * size : (i + 1) * size]
        if lo == 0:
            if len(bits) < len(c):
                raise ValueError("cut short")
            for p in parts:
                mine = c == p
                store_[p][b[mine] + image.bases[p], 0] |= bits[: len(c)][mine].astype(store_[p].dtype) << low
        else:
            _refine_ac(bits, store_[parts[0]], b + image.bases[parts[0]], lo, hi, low, lut(huff[0]))


def _refine_ac(bits: np.ndarray, target: np.ndarray, block: np.ndarray, lo: int, hi: int, low: int, table: np.ndarray) -> None:
    one = 1 << low
    at = done = 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(bits):
            raise ValueError("cut short")
        value = 0
        for b in bits[at : at + n].tolist():
            value = value << 1 | b
        at += n
        return value

    def correct(rows: np.ndarray, start: int) -> None:
        """Correction bits of the known coefficients from start on, block after block."""
        nonlocal at
        band = target[rows, start : hi + 1]
        known = band != 0
        n = int(known.sum())
        if at + n > len(bits):
            raise ValueError("cut short")
        add = np.zeros(band.shape, band.dtype)
        add[known] = bits[at : at + n].astype(band.dtype) << low
        target[rows, start : hi + 1] = band + np.where(band < 0, -add, add)
        at += n

    while done < len(block):
        k = lo
        row = block[done]
        while k <= hi:
            head = np.concatenate([bits[at : at + 16], np.ones(16, np.uint8)])[:16]
            found = int(table[int(np.packbits(head).view(">u2")[0])])
            if not found:
                raise ValueError("no such code")
            at += found >> 8
            run, size = (found & 255) >> 4, found & 15
            value = 0
            if size:
                value = one if take(1) else -one
            elif run < 15:
                n = (1 << run) + take(run)
                if done + n > len(block):
                    raise ValueError("a run beyond its interval")
                if k > lo:
                    correct(block[done : done + 1], k)
                    n, done = n - 1, done + 1
                if n:
                    correct(block[done : done + n], lo)
                    done += n
                break
            while k <= hi:
                have = int(target[row, k])
                if have:
                    if take(1):
                        target[row, k] = have + (one if have > 0 else -one)
                else:
                    if run == 0:
                        if value:
                            target[row, k] = value
                        k += 1
                        break
                    run -= 1
                k += 1
        else:
            done += 1


def read(stored: list[bytes]) -> tuple[list[Image], list[np.ndarray]]:
    """(images, coefficient arrays of each component over all images: blocks x 64 in zigzag order).

    An image's blocks of component c begin at its bases[c]."""
    images = [Image(x) for x in stored]
    total = defaultdict(int)
    for image in images:
        image.bases = []
        for c, (w, h) in enumerate(image.blocks):
            image.bases.append(total[c])
            total[c] += w * h
    out = [np.zeros((total[c], 64), np.int32) for c in range(len(total))]
    step = 0
    while any(step < len(i.scans) for i in images):
        together: dict[tuple, list] = defaultdict(list)
        for image in images:
            if step < len(image.scans):
                scan = image.scans[step]
                if scan[3]:
                    _read_refinement(image, scan, out)
                else:
                    together[scan[:6]].append((image, scan))
        for group in together.values():
            _read_first(group, out)
        step += 1
    return images, out


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks of 8x8 samples by an exact inverse transform: products and sums of integers in double precision."""
    natural = np.zeros(coefficients.shape, np.float64)
    natural[:, ZIGZAG] = coefficients * quant
    x = natural.reshape(-1, 8, 8)
    y = np.matmul(np.matmul(_BASIS, x), _BASIS.T)
    out = np.floor((y + float(1 << (2 * _SHIFT - 1))) / float(1 << (2 * _SHIFT))) + 128
    return np.clip(out, 0, 255).astype(np.int32)


def tensor(image: Image, planes: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3 of unsigned bytes, from blocks of samples of each component over all images."""
    full = []
    hm, vm = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    for c, (w, h) in enumerate(image.blocks):
        grid = planes[c][image.bases[c] : image.bases[c] + w * h].reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(h * 8, w * 8)
        sh, sv = image.sampling[c]
        grid = np.repeat(np.repeat(grid, vm // sv, 0), hm // sh, 1)
        full.append(grid[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
    half = 1 << 15
    rgb = np.stack([y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half], 2) >> 16
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The RGB tensor of one progressive JPEG."""
    images, coefficients = read([data])
    return tensor(images[0], [samples(c, images[0].quant[i]) for i, c in enumerate(coefficients)])


def feature(rgb: np.ndarray) -> str:
    """Size, sums of the channels and a checksum of a tensor."""
    r, g, b = rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{r},{g},{b}:{zlib.crc32(rgb.tobytes()):08x}"


def payload_of(image: Image, coefficients: list[np.ndarray]) -> bytes:
    """The payload that store() was given."""
    groups = next((int(c[7:]) for c in image.comments if c.startswith(b"groups ")), 0)
    own = np.stack([c[image.bases[i] : image.bases[i] + groups] for i, c in enumerate(coefficients)], 1) - 256
    if own.shape[0] != groups or own.min(initial=0) < 0 or own.max(initial=0) > 255:
        raise ValueError("no stored payload")
    return own.astype(np.uint8).tobytes()


def media_columns(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tensors: bool = False) -> DataFrame:
    """doc_id, n_bytes, media (the stored image), payload (read back from it), feature, and with tensors rgb, height and width."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "media", "payload", "feature"] + ["rgb", "height", "width"] * tensors

    def run(batches):
        for batch in batches:
            parts = T.encode(batch.column(1).cast(pa.binary()).to_pylist())
            padded = [p + b" " * (GROUP - len(p) if len(p) < GROUP else -len(p) % GROUP) for p in parts]
            for i, j in T.blocks(padded, 2 << 20):
                media = store(padded[i:j])
                images, coefficients = read(media)
                planes = [samples(c, images[0].quant[k]) for k, c in enumerate(coefficients)]
                rgb = [tensor(image, planes) for image in images]
                columns = [
                    batch.column(0).slice(i, j - i), pa.array([len(p) for p in parts[i:j]], pa.int64()), pa.array(media, pa.binary()),
                    pa.array([payload_of(image, coefficients) for image in images], pa.binary()), pa.array(map(feature, rgb), pa.string()),
                ]
                if tensors:
                    columns += [pa.array([x.tobytes() for x in rgb], pa.binary()), pa.array([x.shape[0] for x in rgb], pa.int32()), pa.array([x.shape[1] for x in rgb], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string" + ", rgb binary, height int, width int" * tensors)


def digest(stored: bytes) -> str:
    return hashlib.sha256(stored).hexdigest()
