"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased (ASCII). Runs of ``least`` words
that a text shares with a test item are seeds; they join texts with items. For
each such pair the longest common run of words that are not yet marked is marked
as a tile, again and again, down to ``least`` words; runs are found by Karp-Rabin
hashing at a search length that is halved as long runs are used up. A text is
contaminated if tiles cover at least ``coverage`` of an item's words, in whatever
order they stand. An item under ``least`` words is a seed as a whole.

The items are a query set: they are broadcast in blocks of at most ``block`` bytes,
each block against all texts, one block in a worker at a time.

Defined results: a null or empty text, or a text without words, is clean; null
items and items without words match nothing; repeated items each count; repeated
rows get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from medspan.llm import _text as T

U = np.uint64
_GAP = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _GAP[_lo:_hi] = False
_PRIME, _ROOT = (1 << 61) - 1, 1_000_003


@dataclass(frozen=True)
class Tiling:
    """least words of a tile; coverage of an item's words from which a text is contaminated; block: bytes of items broadcast at once."""

    least: int = 5
    coverage: float = 0.5
    block: int = 16 << 20
    first: int = 20


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total)."""
    buffer, starts, _ = T.flat(parts, b" ")
    a, b = T.word_spans(buffer, _GAP)
    first = np.append(np.searchsorted(a, starts), len(a))
    return T.word_hash(T.LOWER[buffer], a, b), first


def _windows(tokens: list[int], marked: list[bool], size: int):
    """(start, Karp-Rabin hash) of each unmarked window."""
    out = top = 0
    run = 0
    drop = pow(_ROOT, size, _PRIME)
    for i, t in enumerate(tokens):
        if marked[i]:
            run = out = 0
            continue
        out = (out * _ROOT + t) % _PRIME
        run += 1
        if run > size:
            out = (out - tokens[i - size] * drop) % _PRIME
        if run >= size:
            top = i - size + 1
            yield top, out


def tiles(item: list[int], text: list[int], least: int = 5, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, words), longest first; of equal lengths the first in the item, then in the text.

    A pass finds the unmarked runs of at least size words, by hash, where they begin, and marks
    them from the longest down; of a run that meets a mark the free parts go back among the rest."""
    least = max(1, least)
    marked_item, marked_text = [False] * len(item), [False] * len(text)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(first, len(item)))
    while True:
        at: dict[int, list[int]] = {}
        for i, h in _windows(item, marked_item, size):
            at.setdefault(h, []).append(i)
        found = []
        for j, h in _windows(text, marked_text, size) if at else ():
            for i in at.get(h, ()):
                if i and j and item[i - 1] == text[j - 1] and not marked_item[i - 1] and not marked_text[j - 1]:
                    continue  # within a run that begins earlier
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not marked_item[i + n] and not marked_text[j + n]:
                    n += 1
                if n >= size:
                    found.append((-n, i, j))
        longest = -min(found, default=(0, 0, 0))[0]
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(found)
        while found:
            n, i, j = heapq.heappop(found)
            run = 0
            free = [not (marked_item[i + k] or marked_text[j + k]) for k in range(-n)]
            if all(free):
                marked_item[i : i - n] = marked_text[j : j - n] = free
                out.append((i, j, -n))
                continue
            for k, ok in enumerate([*free, False]):
                if ok:
                    run += 1
                    continue
                if run >= size:
                    heapq.heappush(found, (-run, i + k - run, j + k - run))
                run = 0
        if size == least or all(marked_item):
            break
        size = size // 2 if size > 2 * least else least
    return out


def plain_tiles(item: list[int], text: list[int], least: int = 5) -> list[tuple[int, int, int]]:
    """The same by its definition: the longest unmarked common run, again and again."""
    free_item, free_text, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < max(1, least):
            return out
        free_item[i : i + n] = free_text[j : j + n] = [False] * n
        out.append((i, j, n))


class Items:
    """A block of test items with their seeds."""

    def __init__(self, ids: list, texts: list, how: Tiling, kind: pa.DataType):
        self.how, self.kind = how, kind
        hashes, first = word_hashes(T.encode(texts))
        self.ids = ids
        self.words = [hashes[first[i] : first[i + 1]] for i in range(len(ids))]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if len(w):
                n = min(how.least, len(w))
                by.setdefault(n, []).append((T.window_hash(w, n), i))
        for n, got in by.items():
            seeds, owner = np.concatenate([h for h, _ in got]), np.concatenate([np.full(len(h), i) for h, i in got])
            order = np.argsort(seeds, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[seeds >> U(42)] = True
            self.seeds[n] = seeds[order], owner[order], bits

    def matches(self, parts: list[bytes]) -> list[list[tuple]]:
        """(item, coverage) of each text's items that are covered enough."""
        out: list[list[tuple]] = [[] for _ in parts]
        hashes, first = word_hashes(parts)
        doc = np.repeat(np.arange(len(parts)), np.diff(first))
        for n, (seeds, owner, bits) in self.seeds.items():
            grams = T.window_hash(hashes, n)
            at = np.flatnonzero(bits[grams >> U(42)])
            at = at[doc[at] == doc[at + n - 1]]
            lo = np.searchsorted(seeds, grams[at])
            hi = np.searchsorted(seeds, grams[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(at):
                continue
            count = hi - lo
            where = np.repeat(at, count)
            item = owner[np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
            order = np.lexsort((where, item, doc[where]))
            where, item = where[order], item[order]
            cut = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (doc[where[1:]] != doc[where[:-1]])))
            for a, b in zip(cut, np.append(cut[1:], len(where)), strict=True):
                d, i = int(doc[where[a]]), int(item[a])
                got = self._coverage(i, hashes, where[a:b], n)
                if got >= self.how.coverage:
                    out[d].append((self.ids[i], got))
        return out

    def _coverage(self, i: int, hashes: np.ndarray, where: np.ndarray, n: int) -> float:
        words = self.words[i]
        where = np.unique(where)
        if len(np.unique(hashes[where])) and len(where) * n < self.how.coverage * len(words) and len(where) + n - 1 < self.how.coverage * len(words):
            return 0.0  # too few words are shared at all
        cover = np.unique((where[:, None] + np.arange(n)).ravel())
        gaps = np.flatnonzero(np.diff(cover) > 1) + 1
        text: list[int] = []
        for k, run in enumerate(np.split(cover, gaps)):
            text += [*hashes[run].tolist(), -1 - k]  # a separator that no item holds
        found = tiles(words.tolist(), text, n, self.how.first)
        return sum(x[2] for x in found) / len(words)


def _blocks(benchmark: DataFrame, how: Tiling) -> list[Items]:
    """The items, in blocks of bounded size; each is collected on its own."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // how.block))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        got = sorted(((r["item_id"], r["text"]) for r in rows.where(part == i).toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield Items([a for a, _ in got], [b for _, b in got], how, to_arrow_type(benchmark.schema["item_id"].dataType))


def contamination(documents: DataFrame, benchmark: DataFrame, how: Tiling = Tiling(), keep: list[str] | None = None, text: str = "text", name: str = "items") -> DataFrame:
    """The columns keep (all by default, but for one called name) with name: (item_id, coverage) of the test items that a text holds, largest coverage first.

    Items of one block are matched as the texts are read. Those of several blocks are
    matched block by block, each in stages of its own, and what is found meets the texts by their digest."""
    keep = [c for c in (keep or documents.columns) if c != name]
    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = f"array<struct<item_id:{kind},coverage:double>>"
    sorted_ = F.expr("array_sort(__found, (a, b) -> case when a.coverage > b.coverage then -1 when a.coverage < b.coverage then 1 when a.item_id < b.item_id then -1 when a.item_id > b.item_id then 1 else 0 end)")
    context = documents.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in _blocks(benchmark, how)]
    if len(blocks) == 1:
        own = "_" * (1 + max(map(len, documents.columns)))  # no column's name
        rows = documents.select(F.struct(F.col(text).alias(own), *[F.col(f"`{c}`") for c in keep if c != text]).alias("__row"))
        out = rows.mapInArrow(_match(blocks[0]), f"__row {rows.schema['__row'].dataType.simpleString()}, __found {found}")
        return out.select(*[F.col(f"__row.`{own if c == text else c}`").alias(c) for c in keep], sorted_.alias(name))
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = documents.select(F.col(text).alias("__text"), key.alias("__key"))
    parts = [texts.mapInArrow(_match(b, True), f"__key string, __found {found}").withColumn("__block", F.lit(i)) for i, b in enumerate(blocks)]
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("__key", "__block").agg(F.first("__found").alias("__found")).groupBy("__key").agg(F.flatten(F.collect_list("__found")).alias("__found"))
    rows = documents.select(key.alias("__key"), F.struct(F.lit(0).alias("_" * (1 + max(map(len, documents.columns)))), *[F.col(f"`{c}`") for c in keep]).alias("__row")).join(every, "__key", "left")
    rows = rows.withColumn("__found", F.coalesce("__found", F.expr(f"cast(array() as {found})")))
    return rows.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], sorted_.alias(name))


def _match(shared, only_found: bool = False):
    """Rows of a struct that begins with the text, to the struct and the text's items; only_found: of a
    text and its key, to the key, of those that have some."""

    def run(batches):
        for batch in batches:
            column = batch.column(0) if only_found else batch.column(0).flatten()[0]
            parts = T.encode(column.cast(pa.binary()).to_pylist())
            found: list = []
            for i, j in T.blocks(parts, 1 << 20):
                found += shared.value.matches(parts[i:j])
            items = pa.array([[{"item_id": i, "coverage": c} for i, c in f] for f in found], pa.list_(pa.struct([("item_id", shared.value.kind), ("coverage", pa.float64())])))
            out = pa.RecordBatch.from_arrays([batch.columns[-1], items], [batch.schema.names[-1], "__found"])
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_())) if only_found else out

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, how: Tiling = Tiling(), text: str = "text") -> DataFrame:
    """The rows whose text holds no test item, with all their columns."""
    name = "_" * (1 + max(map(len, documents.columns)))  # no column's name
    return contamination(documents, benchmark, how, text=text, name=name).where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in documents.columns])
