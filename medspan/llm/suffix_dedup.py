"""Removal of repeated passages by prefix-free parsing.

A passage is every string of ``length`` bytes; it is removed where it also starts
in a document with a smaller id. Rolling hashes of ``gram`` bytes cut the corpus:
the least hash in a passage is its trigger, and consecutive passages with the same
trigger are a phrase, which overlaps the next one by length - 1 bytes, so that
each passage lies in exactly one phrase, and equal passages have equal triggers.

* The parse: every phrase as (trigger, digest, passages, document, start). Its
  suffixes are ordered as far as a passage reaches, which is one phrase: phrases meet
  by trigger, equal ones lie side by side, in the order of documents, and one
  that stands as a whole in a smaller document is removed as a whole.
* The dictionary: what is left is each distinct phrase in its first document. Only
  where one trigger has several phrases can a passage stand in both. The bytes of
  those phrases get a suffix array, built by prefix doubling up to a passage's
  length; suffixes with a common prefix of that length are one class.
* Both combine into the corpus order: a class of dictionary suffixes with the
  documents of its phrases in the parse, of which the smallest keeps the passage.

No order beyond ``length`` bytes matters, so neither array goes further. Passages of
open phrases are compared by their bytes; whole phrases by 64 bits of a digest and 32
further bits of their trigger.

Buckets of triggers grow in number with the input's bytes, not in size. A trigger that a
sample shows to have more than ``spread`` phrases is hot: its passages travel one by one,
by 128 bits of their own hash, which deals them evenly. At most as many triggers as the
sample's phrases over share * spread can be hot, so the list of them is bounded. Phrases
of a batch are reduced to their first document before they are dealt out, and a task
remembers those that stood twice, so a passage that very many documents share
arrives about once per task. Texts travel once, compressed, and meet their spans by (doc_id,
hash of the text).

Defined results: a null text is empty; a null doc_id counts as the largest id, 2**63 - 1;
documents with one id don't remove each other's passages; repeated rows get the
same result; a text under ``length`` bytes is kept; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.llm import _text as T
from medspan.llm._spark import runs

U = np.uint64
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_SPANS = "doc_id long, k long, n int, spans binary"


@dataclass(frozen=True)
class Passages:
    """length of a passage and gram of a trigger, in bytes; gather: bytes of text whose phrases are reduced together."""


    length: int = 50
    gram: int = 16
    gather: int = 8 << 20
    #: bytes of text for one bucket of triggers
    bucket: int = 64 << 20
    #: phrases of one trigger beyond which it is hot, and the share of documents that are looked at to see it
    spread: int = 1 << 20
    share: float = 1e-3


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of width values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def phrases(parts: list[bytes], how: Passages) -> tuple[np.ndarray, ...]:
    """(text, start, passages, trigger, digest) of every phrase, in order; start counts within the text."""
    buffer, starts, ends = T.flat(parts)
    n = len(buffer) - how.length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = T.prefix_hash(buffer)
    at = np.arange(len(buffer) - how.gram + 1)
    trigger = _sliding_min(T.mix(T.span_hash(h, at, at + how.gram)), how.length - how.gram + 1)[:n]
    inside = np.zeros(n + 1, np.int8)  # passages that lie in one text
    whole = ends - starts >= how.length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - how.length + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(trigger[1:], trigger[:-1], out=first[1:])
    first[starts[whole]] = True
    begin = np.flatnonzero(first & inside)
    border = np.flatnonzero(first | ~inside)
    stop = np.append(border, n)[np.searchsorted(border, begin, "right")]
    text = np.searchsorted(starts, begin, "right") - 1
    # texts of no bytes share their start with the next; the last of them is the one with bytes
    digest = T.mix(T.span_hash(h, begin, stop + how.length - 1) ^ (stop - begin).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return text, begin - starts[text], stop - begin, trigger[begin], digest


def _merged(of: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(of, starts, ends) with the touching and overlapping spans of each document as one."""
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    if not len(of):
        return of, start, end
    shift = np.int64(1 << 40)
    reach = np.maximum.accumulate(end + of.astype(np.int64) * shift) - of.astype(np.int64) * shift
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return of[first], start[first], reach[np.append(first[1:], len(of)) - 1]


def _span_rows(doc: np.ndarray, key: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(doc_ids, keys, counts, blobs): a row for each document that has spans; of numbers doc and key."""
    of, start, end = _merged(of, start, end)
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    both = np.stack([start, end], 1).astype(np.int32)
    stops = np.append(cut[1:], len(of))[: len(cut)]
    return doc[of[cut]], key[of[cut]], stops - cut, [both[a:b].tobytes() for a, b in zip(cut, stops, strict=True)]


_OUT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("k", pa.int64()), ("n", pa.int32()), ("spans", pa.binary())])


def _batch(bucket, doc, key, n, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((bucket, doc, key, n, spans), _OUT, strict=True)], schema=_OUT)


def _least(which: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each row's class."""
    least = np.full(int(which.max(initial=-1)) + 1, LAST)
    np.minimum.at(least, which, doc)
    return least[which]


def _passages(parts: list[bytes], text, start, count, how: Passages):
    """(row, start, digest) of every passage of some phrases; digest: 128 bits as two integers."""
    buffer, starts, _ = T.flat(parts)
    row = np.repeat(np.arange(len(text)), count)
    at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    a = starts[text[row]] + at
    digest = np.empty((len(row), 2), np.uint64)
    for i, values in enumerate((T.BYTE_VALUE, T.OTHER_VALUE)):
        digest[:, i] = T.mix(T.span_hash(T.prefix_hash(buffer, values), a, a + how.length))
    return row, at, digest


def _classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of each pair among the distinct pairs."""
    order = np.lexsort((b, a))
    new = np.zeros(len(a), np.int64)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


class Seen:
    """Phrases that a task has met more than once, with their first document: a table of bounded size."""

    KEEP = 1 << 17

    def __init__(self):
        self.digest, self.trigger, self.doc = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)

    def least(self, digest: np.ndarray, trigger: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The least document of each phrase, of these and those met before; what stands twice is kept."""
        which = _classes(digest, trigger)
        out = _least(which, doc)
        again = np.bincount(which)[which] > 1
        if len(self.digest):
            at = np.minimum(np.searchsorted(self.digest, digest), len(self.digest) - 1)
            known = (self.digest[at] == digest) & (self.trigger[at] == trigger)
            out = np.where(known, np.minimum(out, self.doc[at]), out)
            again |= known
        _, one = np.unique(which[again], return_index=True)
        new = np.flatnonzero(again)[one][: self.KEEP]
        digest, trigger, doc = (np.concatenate([x[new], y]) for x, y in ((digest, self.digest), (trigger, self.trigger), (out, self.doc)))
        first = np.unique(digest, return_index=True)[1]  # the new ones stand first
        first = first[np.argsort(first, kind="stable")[: self.KEEP]]
        first = first[np.argsort(digest[first])]
        self.digest, self.trigger, self.doc = digest[first], trigger[first], doc[first]
        return out


#: What a row of a bucket holds.
_PHRASES, _SINGLE, _TEXTS = 0, 1, 2


def _parse(how: Passages, buckets: int, hot: np.ndarray):
    """Texts to rows of two kinds: a bucket's phrases (doc_id null), and spans to remove that the batch itself shows."""

    def spans(ids, keys, doc, start, end):
        d, k, n, spans = _span_rows(ids, keys, doc, start, end)
        return _batch(((d ^ k) & LAST) % buckets, d, k, n, spans)  # by document too: copies share k

    def single(got, ids, keys):
        """Passages of hot triggers, each in its first document."""
        doc, start, digest = (np.concatenate(x) for x in zip(*got, strict=True))
        again = ids[doc] > _least(_classes(*digest.T), ids[doc])
        yield spans(ids, keys, doc[again], start[again], start[again] + how.length)
        doc, start, digest = doc[~again], start[~again], digest[~again]
        bucket = (digest[:, 0] % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, (o := order[cut[b] : cut[b + 1]]), np.array([ids[doc[o]], keys[doc[o]], start[o]], np.int64).tobytes() + digest[o].tobytes()) for b in np.flatnonzero(np.diff(cut))]
        if rows:
            yield _batch([b for b, _, _ in rows], [None] * len(rows), [_SINGLE] * len(rows), [len(o) for _, o, _ in rows], [x for _, _, x in rows])

    def reduce_(got, hots, ids, keys, seen):
        ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
        if hots:
            yield from single(hots, ids, keys)
        doc, start, passages, trigger, digest = (np.concatenate(x) for x in zip(*got, strict=True))
        again = ids[doc] > seen.least(digest, trigger, ids[doc])
        yield spans(ids, keys, doc[again], start[again], (start + passages + how.length - 1)[again])
        doc, start, passages, trigger, digest = (x[~again] for x in (doc, start, passages, trigger, digest))
        bucket = (trigger % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        doc, start, passages, trigger, digest = (x[order] for x in (doc, start, passages, (trigger >> U(32)).astype(np.uint32), digest))
        rows = [(b, cut[b + 1] - cut[b], _packed_phrases(ids, keys, *(x[cut[b] : cut[b + 1]] for x in (doc, start, passages, trigger, digest)))) for b in np.flatnonzero(np.diff(cut))]
        if rows:
            b, n, blobs = zip(*rows, strict=True)
            yield _batch(b, [None] * len(b), [_PHRASES] * len(b), n, blobs)

    def run(batches):
        got, hots, ids, keys, size, seen = [], [], [], [], 0, Seen()
        for batch in batches:
            parts = T.encode(batch.column(2).cast(pa.binary()).to_pylist())
            doc, key = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in T.blocks(parts, 1 << 20):
                text, start, passages, trigger, digest = phrases(parts[i:j], how)
                if len(hot) and len(trigger):
                    at = np.searchsorted(hot, trigger)
                    own = hot[np.minimum(at, len(hot) - 1)] == trigger
                    row, single_start, single_digest = _passages(parts[i:j], text[own], start[own], passages[own], how)
                    hots.append((text[own][row] + len(ids), single_start, single_digest))
                    text, start, passages, trigger, digest = (x[~own] for x in (text, start, passages, trigger, digest))
                got.append((text + len(ids), start, passages, trigger, digest))
                ids += doc[i:j]
                keys += key[i:j]
                size += sum(map(len, parts[i:j]))
                if size >= how.gather:
                    yield from reduce_(got, hots, ids, keys, seen)
                    got, hots, ids, keys, size = [], [], [], [], 0
        if got:
            yield from reduce_(got, hots, ids, keys, seen)

    return run


_CODEC = pa.Codec("zstd", 1)


def _compress(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True)


def _unpacked(z: bytes, n: int) -> bytes:
    return _CODEC.decompress(z, n, asbytes=True) if n else b""


def _small(x: np.ndarray, kind) -> list[bytes]:
    """Small numbers in few bytes: those that don't fit follow in full."""
    most = np.iinfo(kind).max
    large = x >= most
    return [np.where(large, most, x).astype(kind).tobytes(), x[large].astype(np.int64).tobytes()]


def _packed_phrases(ids, keys, doc, start, passages, trigger, digest) -> bytes:
    """A bucket's phrases, ordered by document and start: what repeats or counts up is compressed, hashes stand as they are."""
    own, of = np.unique(doc, return_inverse=True)
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    step = np.where(first, start, np.diff(start, prepend=0))
    parts = [np.diff(ids[own], prepend=0).tobytes(), *_small(np.bincount(of), np.uint8), *_small(step, np.uint16), *_small(passages, np.uint8)]
    counts = b"".join(parts)
    packed = _compress(counts)
    head = np.array([len(doc), len(own), len(counts), len(packed)], np.int64)
    return b"".join([head.tobytes(), packed, keys[own].astype(np.uint32).tobytes(), trigger.tobytes(), digest.tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(doc_id, key, start, passages, trigger, digest) of a bucket's phrases, in document order; key: its lower 32 bits."""
    n, docs, size, packed = np.frombuffer(blob, np.int64, 4).tolist()
    counts = _unpacked(blob[32 : 32 + packed], size)
    at = 0

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(counts, kind, count, at)
        at += out.nbytes
        return out

    def small(kind, count):
        out = take(kind, count).astype(np.int64)
        large = out == np.iinfo(kind).max
        out[large] = take(np.int64, int(large.sum()))
        return out

    ids = np.cumsum(take(np.int64, docs))
    each = small(np.uint8, docs)
    step = small(np.uint16, n)
    passages = small(np.uint8, n)
    first = np.cumsum(each) - each
    start = np.cumsum(step)
    start -= np.repeat(start[first] - step[first], each)
    at = 32 + packed
    keys, trigger, digest = (np.frombuffer(blob, kind, count, at + skip) for kind, count, skip in ((np.uint32, docs, 0), (np.uint32, n, 4 * docs), (np.uint64, n, 4 * (docs + n))))
    return np.repeat(ids, each), np.repeat(keys.astype(np.int64), each), start, passages, trigger, digest


def _rows_of(doc, key, start, end, kind: int):
    both = np.stack([doc, key], 1)
    own, of = np.unique(both, axis=0, return_inverse=True) if len(both) else (both, np.zeros(0, np.int64))
    if kind == 0:
        d, k, n, spans = _span_rows(own[:, 0], own[:, 1], of.ravel(), start.astype(np.int64), end.astype(np.int64))
        return _batch([0] * len(d), d, k, n, spans)
    order = np.lexsort((start, of.ravel()))
    of = of.ravel()[order]
    pairs = np.stack([start, end], 1).astype(np.int32)[order]
    cut = np.searchsorted(of, np.arange(len(own) + 1))
    return _batch([1] * len(own), own[:, 0], own[:, 1], np.diff(cut), [pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])


def _passed_on(t: pa.Table):
    """The rows of documents, and the rest by kind."""
    ours = pa.compute.is_null(t.column("doc_id"))
    for b in t.filter(pa.compute.invert(ours)).to_batches():
        yield None, _batch([0] * b.num_rows, *b.columns[1:])
    rest = t.filter(ours)
    kinds = rest.column("k").to_pylist()
    for kind in (_PHRASES, _SINGLE, _TEXTS):
        got = [(n, x) for n, x, k in zip(rest.column("n").to_pylist(), rest.column("spans").to_pylist(), kinds, strict=True) if k == kind]
        if got:
            yield kind, got


def _meet(how: Passages):
    """A bucket's phrases to spans to remove (bucket 0) and spans of phrases to look into (bucket 1)."""

    def run(batches):
        for t in runs(batches, ["bucket"]):
            for kind, got in _passed_on(t):
                if kind is None:
                    yield got
                elif kind == _SINGLE:
                    heads = np.concatenate([np.frombuffer(x, np.int64, 3 * n).reshape(3, n) for n, x in got], 1)
                    again = heads[0] > _least(_classes(*np.concatenate([np.frombuffer(x, np.uint64, 2 * n, 24 * n).reshape(n, 2) for n, x in got]).T), heads[0])
                    doc, key, start = heads[:, again]
                    yield _rows_of(doc, key, start, start + how.length, 0)
                else:
                    doc, key, start, passages, trigger, digest = (np.concatenate(x) for x in zip(*(_unpack(x) for _, x in got), strict=True))
                    end = start + passages + how.length - 1
                    which = _classes(digest, (passages.astype(np.uint64) << U(32)) | trigger)
                    again = doc > _least(which, doc)
                    yield _rows_of(doc[again], key[again], start[again], end[again], 0)
                    trigger_of = np.empty(int(which.max(initial=-1)) + 1, np.uint32)
                    trigger_of[which] = trigger
                    _, back, count = np.unique(trigger_of, return_inverse=True, return_counts=True)
                    open_ = ~again & (count[back] > 1)[which]
                    yield _rows_of(doc[open_], key[open_], start[open_], end[open_], 1)

    return run


def _phrase_texts(how: Passages, buckets: int):
    """Texts with their spans, to rows of a bucket's phrases to look into, and the spans to remove as they are."""

    def run(batches):
        rows: dict[int, list] = {}
        size = 0
        for batch in batches:
            ids, keys, packed, sizes, found = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "k", "z", "n_bytes", "found"))
            done = []
            for d, k, z, n, spans in zip(ids, keys, packed, sizes, found, strict=True):
                gone = b"".join(x["spans"] for x in spans if not x["bucket"])
                if gone:
                    done.append((((d ^ k) & LAST) % buckets, d, k, len(gone) // 8, gone))
                inside = b"".join(x["spans"] for x in spans if x["bucket"])
                if not inside:
                    continue
                raw = _unpacked(z, n)
                pairs = np.frombuffer(inside, np.int32).reshape(-1, 2).tolist()
                pieces = [raw[a:b] for a, b in pairs]
                h = _triggers(pieces, how)
                for b, piece, (a, _) in zip((h % U(buckets)).tolist(), pieces, pairs, strict=True):
                    rows.setdefault(b, []).append((d, k, a, piece))
                    size += len(piece) + 100
                if size > how.gather:
                    yield _packed_rows(rows)
                    rows, size = {}, 0
            if done:
                yield _batch(*zip(*done, strict=True))
        if rows:
            yield _packed_rows(rows)

    return run


def _triggers(pieces: list[bytes], how: Passages) -> np.ndarray:
    """The trigger of each phrase: the least hash of its first passage."""
    heads = np.frombuffer(b"".join(p[: how.length] for p in pieces), np.uint8)
    h = T.prefix_hash(heads)
    at = (np.arange(len(pieces)) * how.length)[:, None] + np.arange(how.length - how.gram + 1)
    return T.mix(T.span_hash(h, at.ravel(), at.ravel() + how.gram)).reshape(at.shape).min(1)


def _packed_rows(rows: dict[int, list]) -> pa.RecordBatch:
    out = []
    for b, got in rows.items():
        head = np.array([(d, k, a, len(p)) for d, k, a, p in got], np.int64)
        body = head.T.tobytes() + b"".join(p for *_, p in got)
        out.append((b, len(got), np.int64(len(body)).tobytes() + _compress(body)))
    b, n, blobs = zip(*out, strict=True)
    return _batch(b, [None] * len(b), [_TEXTS] * len(b), n, blobs)


def suffix_classes(buffer: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix of the buffer that starts at one of at, among those starts, by its first length bytes
    (equal ranks: equal bytes). Prefix doubling: ranks by eight bytes, then by as many of
    such ranks in a row as one integer holds, until they reach the length."""
    n = len(buffer)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    covered = min(8, length)
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64) >> U(8 * (8 - covered))
    while covered < length:
        rank = np.unique(key, return_inverse=True)[1].ravel().astype(np.uint64)
        bits = max(1, int(rank.max(initial=0)).bit_length())
        reach = covered
        key = rank
        for _ in range(max(1, 64 // bits - 1)):
            if reach == length:
                break
            step = min(covered, length - reach)
            shift = reach + step - covered
            more = np.zeros(n, np.uint64)
            more[: max(0, n - shift)] = rank[shift:]
            key = (key << U(bits)) | more
            reach += step
        covered = reach
    return np.unique(key[at], return_inverse=True)[1].ravel()


def _sort_suffixes(how: Passages):
    """A bucket's phrases to spans of the passages that stand in smaller documents."""

    def run(batches):
        for t in runs(batches, ["bucket"]):
            for kind, got in _passed_on(t):
                if kind is None:
                    yield got
                    continue
                heads, bodies = [], []
                for n, blob in got:
                    body = _unpacked(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]))
                    heads.append(np.frombuffer(body, np.int64, 4 * n).reshape(4, n))
                    bodies.append(body[32 * n :])
                head = np.concatenate(heads, 1)
                buffer = np.frombuffer(b"".join(bodies), np.uint8)
                del t, got, bodies
                passages = head[3] - how.length + 1
                of = np.repeat(np.arange(len(passages)), passages)
                at = np.arange(len(of)) - np.repeat(np.cumsum(passages) - passages, passages)
                begin = np.cumsum(head[3]) - head[3]
                doc = head[0, of]
                again = doc > _least(suffix_classes(buffer, begin[of] + at, how.length), doc)
                start = (head[2, of] + at)[again]
                yield _rows_of(doc[again], head[1, of][again], start, start + how.length, 0)

    return run


def _pack(batches):
    """Texts compressed: doc_id, k, z, n_bytes, and what follows."""
    for batch in batches:
        parts = T.encode(batch.column(2).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_compress(p) if p else b"" for p in parts], pa.binary()), pa.array(list(map(len, parts)), pa.int64()), *batch.columns[3:]], ["doc_id", "k", "z", "n_bytes", *batch.schema.names[3:]])


def _remove(names: list[str], decoded: bool):
    def run(batches):
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            removed, spans_out, kept = [], [], []
            for z, n, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("z", "n_bytes", "all")), strict=True):
                raw = _unpacked(z, n)
                if not spans:
                    removed.append(0)
                    spans_out.append([])
                    kept.append(raw)
                    continue
                pairs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in spans]).astype(np.int64)
                _, start, end = _merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                removed.append(int((end - start).sum()))
                spans_out.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                edges = np.concatenate([[0], np.stack([start, end], 1).ravel(), [n]]).tolist()
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(removed, pa.int64()), pa.array(spans_out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()), *[pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())] * decoded],
                [*names, "n_removed", "spans", "kept"] + ["kept_text"] * decoded,
            )

    return run


def _buckets(documents: DataFrame, how: Passages, text: str) -> int:
    """How many buckets of triggers: four for each shuffle partition, or more where the input's bytes ask for it."""
    size = int(documents.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 55:  # not known: counted
        size = documents.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    width = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4 * width, -(-3 * size // how.bucket))


def hot_triggers(docs: DataFrame, how: Passages) -> np.ndarray:
    """Triggers that the sampled documents show to have more than spread phrases; at most as many as the sample's phrases over share * spread."""

    def run(batches):
        for batch in batches:
            parts = T.encode(batch.column(0).cast(pa.binary()).to_pylist())
            for i, j in T.blocks(parts, 1 << 20):
                _, _, _, trigger, digest = phrases(parts[i:j], how)
                yield pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(digest.view(np.int64))], ["trigger", "digest"])

    if how.share < 1:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "k"), F.lit(1 << 20)) < int(how.share * (1 << 20)))
    counted = docs.select("text").mapInArrow(run, "trigger long, digest long").groupBy("trigger").agg(F.approx_count_distinct("digest").alias("n"))
    found = counted.where(F.col("n") > how.spread * how.share).select("trigger").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def remove_repeats(documents: DataFrame, how: Passages = Passages(), doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, k (hash of the text), n_bytes, n_removed, spans removed (in bytes), kept (the remaining
    bytes); with carry also kept_text (without cut characters), no_text (whether the text was null) and row, a struct of the document's own columns but the text."""
    blank = "_" * (1 + max(map(len, documents.columns)))  # no other column's name
    row = [F.struct(F.lit(None).cast("int").alias(blank), *[F.col(f"`{c}`") for c in documents.columns if c != text]).alias("row"), F.col(text).isNull().alias("no_text")] * carry
    extra = f", row {documents.select(*row).schema['row'].dataType.simpleString()}, no_text boolean" if carry else ""
    low = F.xxhash64(F.col(text)).bitwiseAND(F.lit(0xFFFFFFFF))
    docs = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), low.alias("k"), F.col(text).alias("text"), F.col(doc_id).isNull().alias("no_id"), *row)
    buckets = _buckets(documents, how, text)
    width = -(-buckets // 4)
    schema = "bucket int, " + _SPANS
    carried = ["doc_id", "k", "z", "n_bytes", "no_id"] + ["row", "no_text"] * carry
    packed = docs.mapInArrow(_pack, "doc_id long, k long, z binary, n_bytes long, no_id boolean" + extra)
    packed = packed.where("doc_id is not null and k is not null")  # always so; written out, both joins read one shuffle of the texts
    parsed = docs.select("doc_id", "k", "text").mapInArrow(_parse(how, buckets, hot_triggers(docs, how)), schema)
    met = parsed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(how), schema)
    found = met.groupBy("doc_id", "k").agg(F.collect_list(F.struct("bucket", "spans")).alias("found"))
    looked = packed.join(found, ["doc_id", "k"]).select(*carried, "found").mapInArrow(_phrase_texts(how, 2 * buckets), schema)
    finer = looked.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_suffixes(how), schema)
    spans = finer.groupBy("doc_id", "k").agg(F.collect_list("spans").alias("all"))
    kept = ["doc_id", "k", "n_bytes", "no_id"] + ["row", "no_text"] * carry
    out = packed.join(spans, ["doc_id", "k"], "left").select(*carried, "all").mapInArrow(_remove(kept, carry), f"doc_id long, k long, n_bytes long, no_id boolean{extra}, n_removed long, spans array<struct<start:int,`end`:int>>, kept binary" + ", kept_text string" * carry)
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def without_repeats(documents: DataFrame, how: Passages = Passages(), text: str = "text") -> DataFrame:
    """The table with each text's repeated passages removed; a character that is cut goes. n_chars, where there is one, is counted anew."""
    out = remove_repeats(documents, how, text=text, carry=True)
    left = F.when(~F.col("no_text"), F.col("kept_text"))
    out = out.select("row", left.alias("kept_text"))
    kind = documents.schema["n_chars"].dataType if "n_chars" in documents.columns else None
    return out.select(*[F.col("kept_text").alias(c) if c == text else F.length("kept_text").cast(kind).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def brute_force(rows: list[tuple], length: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows, by a table of all passages."""
    ids = [LAST if d is None else d for d, _ in rows]
    raw = T.encode([t for _, t in rows])
    first: dict[bytes, int] = {}
    for d, r in zip(ids, raw, strict=True):
        for i in range(len(r) - length + 1):
            p = r[i : i + length]
            if first.get(p, LAST + 1) > d:
                first[p] = d
    out = []
    for (d, _), own, r in zip(rows, ids, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if first[r[i : i + length]] < own:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out
