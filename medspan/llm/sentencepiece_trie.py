"""SentencePiece encoding and decoding with forward states shared over word prefixes.

Texts are cut into marked words (a run of word markers with what follows up to
the next marker; a line break stands alone unless a piece holds one), and these into
segments between characters that no piece has side by side. Segments are found in the
flat code points of a block of texts, by 64 bits of a hash, and their pieces kept in a table
(with 64 other bits). The distinct segments that the table lacks are sorted, so that
they lie in trie order, and visited depth first: each keeps the forward states of its
prefixes on a stack, and the next one resumes after the common prefix.

* Unigram models: a state is the best score of a prefix and its last piece
  (Viterbi); unknown characters score the lowest piece's score less ten. Of equal sums
  the longer last piece wins; sums run over a word, so that where two ways tie but for
  rounding, the result can differ from one summed over a whole text.
* BPE models: scores rank merges and don't add up, so the best sum would not be the
  model's own result. There the state of a prefix is the one last piece with which
  merging the prefix ends: the piece that ends there and is compatible with the last
  piece of what stands before it. Two pieces are compatible if no merge over their
  border comes before those that build them. Words that begin with several markers,
  whose pieces tie in score, are merged plainly.

Unknown characters become byte pieces where the model has them. Decoding joins the
pieces, reads byte pieces as UTF-8 and drops the marker that encoding adds.

Defined results: a null or empty text has no pieces and decodes to the empty text;
repeated rows give the same result; an empty table gives no rows. U+2581 in a text
is read as a marker, so it decodes to a space, as in the model's own library.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.llm import _text as T

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Odd multipliers of the two hashes of a character at its place in a segment.
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    """Pieces of a model file, ready for encoding."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    byte_fallback: bool
    dummy_prefix: bool
    squeeze: bool = False
    ids: dict[str, int] = field(default_factory=dict)
    bytes_at: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    spines: dict = field(default_factory=dict)
    #: every ending of a piece, with the piece's number if it is one that encoding can use, else -1
    tails: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _NORMAL}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        self.bytes_at = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        if self.kind == BPE:
            self._make_spines()
        for p in self.ids:
            for i in range(len(p)):
                self.tails.setdefault(p[i:], -1)
        for p, i in self.ids.items():
            if self.kind == UNIGRAM or i in self.spines:
                self.tails[p] = i

    def _make_spines(self):
        """For each piece that merging can build: (part, score of the merge that takes it in) down its left and right edge."""
        split: dict[str, tuple[str, str] | None] = {}
        for p in self.ids:
            if len(p) == 1:
                split[p] = None
            else:
                parts = merge(p, self.ids, self.scores, self.scores[self.ids[p]])
                if len(parts) == 2:
                    split[p] = parts[0], parts[1]
        none = float("-inf")
        for p in split:
            edges = []
            for side in (0, 1):
                part, taken, spine = p, none, []
                while True:
                    spine.append((part, taken))
                    if split.get(part) is None:
                        break
                    taken = self.scores[self.ids[part]]
                    part = split[part][side]
                edges.append(spine)
            self.spines[self.ids[p]] = tuple(edges)


def load(path: str) -> Model:
    """Reads a model file (its protocol buffer is walked by hand; only identity normalisation is supported)."""
    with open(path, "rb") as f:
        return parse(f.read())


def _fields(data: bytes):
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            value = varint()
        elif wire == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 4 if wire == 5 else 8
            value = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n
        yield key >> 3, value


def parse(data: bytes) -> Model:
    pieces, scores, kinds = [], [], []
    kind, byte_fallback, dummy, squeeze, charsmap, escape = UNIGRAM, False, True, True, b"", True
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got.get(1, b"").decode())
            scores.append(got.get(2, 0.0))
            kinds.append(got.get(3, _NORMAL))
        elif number == 2:
            got = dict(_fields(value))
            kind, byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
        elif number == 3:
            got = dict(_fields(value))
            charsmap, dummy, squeeze, escape = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
    if charsmap or not escape or kind not in (UNIGRAM, BPE) or _USER in kinds:
        raise ValueError("a model with identity normalisation and no user-defined pieces is needed")
    return Model(pieces, scores, kinds, kind, byte_fallback, dummy, squeeze)


def merge(word: str, ids: dict[str, int], scores: list[float], over: float = float("-inf")) -> list[str]:
    """Plain merging of a word by the best score, the leftmost first; over: only merges with a higher score."""
    parts = list(word)
    while len(parts) > 1:
        best, at = over, -1
        for i in range(len(parts) - 1):
            k = ids.get(parts[i] + parts[i + 1])
            if k is not None and scores[k] > best:
                best, at = scores[k], i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes texts, with the pieces of segments kept over calls in tables of bounded size."""

    KEEP, KEEP_PAIRS = 1_500_000, 400_000

    def __init__(self, model: Model):
        self.model = model
        self.pairs: dict[int, bool] = {}
        self.worst = min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == _NORMAL), default=0.0) - 10.0
        self.mark = ord(MARK)
        self.alone = ord("\n") if not any("\n" in p for p in model.ids) else self.mark
        #: neighbours that some piece has within: merging can't cross any others
        joined = {p[i : i + 2] for p in model.ids for i in range(len(p) - 1)}
        chars = sorted({ord(c) for pair in joined for c in pair})
        self.char = np.zeros(max(chars, default=0) + 2, np.int64)
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.joined = np.zeros(self.width * self.width, bool)
        self.joined[[self.char[ord(a)] * self.width + self.char[ord(b)] for a, b in joined]] = True
        self.forget()

    def forget(self) -> None:
        """Empties the table of segments: hashes in order, with a second hash and the place of the pieces."""
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def cut(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the segments, whether each starts a word) of code points whose texts start at starts."""
        mark, alone = points == self.mark, points == self.alone
        word = np.zeros(len(points), bool)
        word[starts] = True
        word[1:] |= (mark[1:] & ~mark[:-1]) if self.alone == self.mark else (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
        of = self.char[np.minimum(points, len(self.char) - 1)]
        cut = word.copy()
        cut[1:] |= ~self.joined[of[:-1] * self.width + of[1:]]
        at = np.flatnonzero(cut)
        return at, word[at]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text gives the two pieces again."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            ids, scores = self.model.ids, self.model.scores
            known = True
            for x, taken_x in self.model.spines[a][1]:
                for y, taken_y in self.model.spines[b][0]:
                    k = ids.get(x + y)
                    if k is not None and scores[k] > taken_x and scores[k] >= taken_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) > self.KEEP_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def look_up(self, points: np.ndarray, text: str, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place in the table of every segment; new ones are encoded first, together."""
        within = np.arange(len(points), dtype=np.uint64) - np.repeat(at, sizes).astype(np.uint64)
        letters = points.astype(np.uint64) | (within << np.uint64(21))
        hashes, first, codes = np.unique(np.add.reduceat(T.mix(letters * _FIRST), at), return_index=True, return_inverse=True)
        own, own_sizes = at[first], sizes[first]
        spread = np.repeat(own - (np.cumsum(own_sizes) - own_sizes), own_sizes) + np.arange(int(own_sizes.sum()))
        checks = np.add.reduceat(T.mix(letters[spread] * _SECOND), np.cumsum(own_sizes) - own_sizes)
        if len(self.hashes) > self.KEEP:
            self.forget()
        place = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, _FIRST)[place] == hashes
        known &= place < len(self.hashes)
        if (self.checks[place[known]] != checks[known]).any():  # two segments with one hash
            self.forget()
            known[:] = False
        new = np.flatnonzero(~known)
        if len(new):
            self._keep(hashes, checks, self._visit({text[a : a + n]: i for a, n, i in zip(own[new].tolist(), own_sizes[new].tolist(), new.tolist(), strict=True)}))
            place = np.searchsorted(self.hashes, hashes)
        return place[codes]

    def _keep(self, hashes: np.ndarray, checks: np.ndarray, pieces: dict[int, tuple]) -> None:
        """Adds segments to the table."""
        new = np.fromiter(pieces, np.int64, len(pieces))
        sizes = np.fromiter(map(len, pieces.values()), np.int32, len(pieces))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used : self.used + total] = np.fromiter((k for x in pieces.values() for k in x), np.int32, total)
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += total
        order = np.argsort(new)  # hashes are in order by number
        new, begin, sizes = new[order], begin[order], sizes[order]
        to = np.searchsorted(self.hashes, hashes[new])
        self.hashes, self.checks = np.insert(self.hashes, to, hashes[new]), np.insert(self.checks, to, checks[new])
        self.begin, self.size = np.insert(self.begin, to, begin), np.insert(self.size, to, sizes)

    def _visit(self, words: dict[str, int]) -> dict[int, tuple]:
        """The pieces of segments by their numbers, encoded in trie order, depth first."""
        out = {}
        model, ids = self.model, self.model.ids
        unigram, tails = model.kind == UNIGRAM, model.tails
        single = np.float32  # the model's own sums are in single precision, and ties go to the longer last piece
        pairs = self.pairs
        before, last, length, best = "", [-1], [0], [0.0]
        for word in sorted(words):
            if not unigram and word.startswith(MARK + MARK):
                parts = merge(word, ids, model.scores)
                out[words[word]] = self._pieces([ids.get(p, -1) for p in parts], parts)
                continue
            shared = 0
            for a, b in zip(word, before):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], length[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                found, n = [], 1
                while n <= i:
                    k = tails.get(word[i - n : i])
                    if k is None:
                        break
                    if k >= 0:
                        found.append((n, k))
                    n += 1
                piece, size = -1, 1
                if unigram:
                    top = float("-inf") if found and found[0][0] == 1 else float(single(best[i - 1] + self.worst))
                    for n, k in reversed(found):
                        s = float(single(best[i - n] + model.scores[k]))
                        if s > top:
                            top, piece, size = s, k, n
                    best.append(top)
                else:
                    for n, k in reversed(found):
                        p = last[i - n]
                        if p < 0 or pairs.get(p << 32 | k, None) or self.compatible(p, k):
                            piece, size = k, n
                            break
                last.append(piece)
                length.append(size)
            before = word
            found, at = [], len(word)
            while at:
                found.append((last[at], at - length[at], at))
                at -= length[at]
            found.reverse()
            ks = tuple(k for k, _, _ in found)
            out[words[word]] = ks if -1 not in ks else self._pieces(ks, [word[a:b] for _, a, b in found])
        return out

    def _pieces(self, ids, parts: list[str]) -> tuple[int, ...]:
        model, out = self.model, []
        for k, p in zip(ids, parts, strict=True):
            if k >= 0:
                out.append(k)
            elif model.byte_fallback:
                out.extend(model.bytes_at[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(model.unknown)
        return tuple(out)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts, offsets of the texts)."""
        model, prefix = self.model, MARK if self.model.dummy_prefix else ""
        if model.squeeze:
            texts = [re.sub(" +", " ", t.strip(" ")) if t else "" for t in texts]
        parts = [prefix + t if t else "" for t in texts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths)
        text = "".join(parts).replace(" ", MARK)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64)
        at, word = self.cut(points, (ends - lengths)[lengths > 0])
        place = self.look_up(points, text, at, np.diff(at, append=len(points)))
        size = self.size[place].astype(np.int64)
        stop = np.cumsum(size)
        which = np.arange(int(stop[-1])) + np.repeat(self.begin[place] - (stop - size), size)
        pieces = self.flat[which]
        total = np.concatenate([[0], stop])[np.searchsorted(at, np.concatenate([[0], ends]))]
        if not model.byte_fallback:  # unknown pieces in a row within a word are one
            again = np.zeros(len(pieces), bool)
            again[1:] = (pieces[1:] == model.unknown) & (pieces[:-1] == model.unknown)
            again[(stop - size)[word & (size > 0)]] = False
            total -= np.concatenate([[0], np.cumsum(again)])[total]
            pieces = pieces[~again]
        return pieces, total


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.byte_of = {v: k for k, v in model.bytes_at.items()}
        unknown = " ⁇ "
        self.texts = np.array([unknown if k == _UNKNOWN else "" if k == _CONTROL else p.replace(MARK, " ") for p, k in zip(model.pieces, model.kinds, strict=True)], object)
        self.is_byte = np.array([k == _BYTE for k in model.kinds])

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of pieces; bytes that are no UTF-8 become U+FFFD each."""
        if not self.is_byte[ids].any():
            out = "".join(self.texts[ids])
        else:
            parts: list[str] = []
            run = bytearray()
            for k in ids.tolist():
                if k in self.byte_of:
                    run.append(self.byte_of[k])
                    continue
                if run:
                    parts.append(_utf8(bytes(run)))
                    run.clear()
                parts.append(self.texts[k])
            parts.append(_utf8(bytes(run)))
            out = "".join(parts)
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (4, 3, 2, 1):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_READY: dict[int, tuple[Encoder, Decoder]] = {}


def encode_decode(documents: DataFrame, model: Model, keep: tuple = ("doc_id",), text: str = "text", digest: bool = False) -> DataFrame:
    """The columns keep, with pieces (array of int) and decoded; with digest, n_pieces, pieces_sha256
    (of the numbers as little-endian int32), decoded_sha256 and round_trip in their place."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(text).alias("__text"), *[F.col(c) for c in keep])
    fields = [f.simpleString().split(":", 1) for f in documents.select(*keep).schema]
    added = "n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean" if digest else "pieces array<int>, decoded string"
    names = [*keep, *(x.split()[0] for x in added.split(", "))]

    def run(batches):
        value = shared.value
        if id(value) not in _READY:
            _READY.clear()
            _READY[id(value)] = Encoder(value), Decoder(value)
        encoder, decoder = _READY[id(value)]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            start = size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > 1 << 19:
                    part = texts[start:i]
                    ids, at = encoder.encode(part)
                    back = [decoder.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    head = [c.slice(start, i - start) for c in batch.columns[1:]]
                    if digest:
                        sums = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                        more = [pa.array(np.diff(at)), pa.array(sums, pa.string()), pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back], pa.string()), pa.array([x == (t or "") for x, t in zip(back, part, strict=True)], pa.bool_())]
                    else:
                        more = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(back, pa.string())]
                    if i > start:
                        yield pa.RecordBatch.from_arrays([*head, *more], names)
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in fields), added]))
