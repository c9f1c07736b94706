"""Byte-level text kernels shared by the operators: whole batches as one flat buffer.

A batch of texts becomes one ``uint8`` array plus offsets; words, shingles and
fixed-length windows are then hashed for all texts at once with a polynomial
prefix hash over 64-bit integers (wrapping), finished by an avalanche mix.
"""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Random 64-bit value of each byte, so that low bits of the polynomial hash are mixed.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, MASK, 256, dtype=np.uint64, endpoint=True)
OTHER_VALUE = np.random.default_rng(20240301).integers(1, MASK, 256, dtype=np.uint64, endpoint=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        np.multiply(out[:more], np.uint64(pow(base, size, 1 << 64)), out=out[size : size + more])
        size += more
    return out[:n]


class Powers:
    """Power tables; those of up to KEEP entries stay for a worker's life, larger ones only while they are used."""

    KEEP = 5 << 18
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int, which: str) -> np.ndarray:
        kept = getattr(cls, which)
        if len(kept) >= n:
            return kept
        made = powers(BASE if which == "up" else INVERSE, n if n > cls.KEEP else cls.KEEP)
        if n <= cls.KEEP:
            setattr(cls, which, made)
        return made


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty, lone surrogates are kept as '?'."""
    return [b"" if t is None or t != t else (t.encode("utf-8", "replace") if isinstance(t, str) else bytes(t)) for t in texts]


def flat(parts: list[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends): the texts after one another with gap after each."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + len(gap)) - len(gap)
    buffer = np.frombuffer(gap.join(parts) + gap, np.uint8)
    return buffer, ends - sizes, ends


def blocks(parts: list[bytes], limit: int):
    """Index ranges of consecutive texts with at most limit bytes, or one text."""
    start = size = 0
    for i, p in enumerate(parts):
        if i > start and size + len(p) > limit:
            yield start, i
            start, size = i, 0
        size += len(p) + 1
    if start < len(parts):
        yield start, len(parts)


def prefix_hash(buffer: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """h with hash(a, b) = (h[b] - h[a]) * INVERSE**a."""
    up = Powers.get(len(buffer) + 1, "up")
    h = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(values[buffer] * up[: len(buffer)], out=h[1:])
    return h


def span_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the byte spans [a, b)."""
    down = Powers.get(len(h), "down")
    return (h[b] - h[a]) * down[a]


def word_spans(buffer: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separator."""
    gap = np.ones(len(buffer) + 2, bool)
    gap[1:-1] = is_space[buffer]
    edge = gap[1:] != gap[:-1]
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


#: Length from which a word's hash is a keyed digest: over long words the polynomial, modulo a power of two, can be made to collide.
LONG = 64


def word_hash(buffer: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words [a, b)."""
    if not len(a):
        return np.zeros(0, np.uint64)
    out = mix(span_hash(prefix_hash(buffer), a, b))
    for i in np.flatnonzero(b - a > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buffer[a[i] : b[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(parts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total): words are runs without ASCII white space."""
    buffer, starts, ends = flat(parts, b" ")
    if lower:
        buffer = LOWER[buffer]
    a, b = word_spans(buffer)
    hashes = word_hash(buffer, a, b)
    first = np.append(np.searchsorted(a, starts), len(a))
    return hashes, first


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(BASE)
        out += values[k : k + n]
        if k + 1 < width:
            out ^= out >> np.uint64(29)
    return mix(out)


def shingles(parts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text number), all occurrences in text order.

    A text with fewer than width words, but at least one, has its whole
    sequence as its only shingle; a text without words has none.
    """
    hashes, first = words(parts)
    count = np.diff(first)
    full = window_hash(hashes, width)
    doc = np.repeat(np.arange(len(parts)), count)
    if len(full):
        same = doc[: len(full)] == doc[width - 1 :]
        full, of = full[same], doc[: len(same)][same]
    else:
        of = np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        more = np.array([_fold(hashes[first[i] : first[i + 1]]) for i in short], np.uint64)
        full, of = np.concatenate([full, more]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        full, of = full[order], of[order]
    return full, of


def _fold(values: np.ndarray) -> int:
    out = len(values)
    for v in values:
        out = ((out ^ (out >> 29)) * BASE + int(v)) & MASK
    return int(mix(np.array([out ^ 0x5851F42D4C957F2D], np.uint64))[0])
