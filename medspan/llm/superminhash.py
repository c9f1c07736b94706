"""Near-duplicates by SuperMinHash signatures, banding, verification and components.

Every distinct shingle of a text draws a random permutation of the slots, one
slot at a time; at step j it offers j + r (r random below 1) to the slot drawn.
Slots keep the least offer, and a text stops as soon as no later step can lower
any slot, which for most texts is the first or second step. All texts of a block
step together in numpy.

1. Texts with equal shingle sets form a class, represented by its least id.
2. Representatives meet by band; each is paired with the least id of its bucket.
   Pairs are confirmed on whole shingle sets; links give components.
3. Buckets that still hold several components are dealt in blocks, two by two;
   a block pair compares signatures, and confirms pairs of different components
   whose estimate allows a link on their whole sets, nearest first, until their
   components have met. So no group is ever listed as all its pairs, and every
   link between components that a bucket can show is found.

Defined results: a null text, or one without words, has an empty set and is its
own component; fewer than five words make one shingle of the whole sequence;
repeated rows get the same result each, and rows with one doc_id count as one
document; a null doc_id is never linked (component null, kept). An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.llm import _text as T
from medspan.llm._spark import checkpoint, release, runs

U = np.uint64


@dataclass(frozen=True)
class NearDup:
    """slots of a signature in bands of rows; percent: least intersection per union;
    width of shingles in words; block: members of a bucket in a block; hub: pairs of one document in a task; margin: how far
    under the threshold an estimate may be (over five standard deviations)."""

    bands: int = 32
    rows: int = 4
    percent: int = 75
    width: int = 5
    block: int = 1024
    hub: int = 256
    margin: float = 0.2

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def sets(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order within each text, first of each text and the total)."""
    values, of = T.shingles(parts, width)
    if len(values):
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        values, of = values[new], of[new]
    return values, np.searchsorted(of, np.arange(len(parts) + 1))


def signatures(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash of each set, m slots of (step << 32 | random); texts with empty sets keep the largest value."""
    n = len(first) - 1
    none = U((1 << 64) - 1)
    out = np.full(n * m, none)
    doc = np.repeat(np.arange(n), np.diff(first))
    element, drawn = values, []
    for j in range(m):
        h = T.mix(element + U((j + 1) * 0x9E3779B97F4A7C15 & T.MASK))
        k = j + ((h & U(0xFFFFFFFF)) % U(m - j)).astype(np.int64)
        x = k.copy()
        for i in range(j - 1, -1, -1):  # what earlier swaps have put at place k
            x = np.where(x == drawn[i], i, x)
        np.minimum.at(out, doc * m + x, (U(j) << U(32)) | (h >> U(32)))
        drawn.append(k)
        if j + 1 == m:
            break
        need = np.zeros(n, bool)
        here = np.unique(doc)
        need[here] = (out.reshape(n, m)[here].max(1) >> U(32)) > U(j)
        on = need[doc]
        if not on.any():
            break
        element, doc = element[on], doc[on]
        drawn = [d[on] for d in drawn]
    return out.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature, the band's number mixed in."""
    n, m = sig.shape
    rows = sig.reshape(n, bands, m // bands)
    key = np.broadcast_to(T.mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for r in range(rows.shape[2]):
        key = T.mix(key * U(T.BASE) ^ rows[:, :, r])
    return key


def _describe(how: NearDup):
    def run(batches):
        for batch in batches:
            parts = T.encode(batch.column(1).cast(pa.binary()).to_pylist())
            for i, j in T.blocks(parts, 1 << 20):
                values, first = sets(parts[i:j], how.width)
                size = np.diff(first)
                cum = np.zeros((2, len(values) + 1), np.uint64)
                np.cumsum(T.mix(values ^ U(0xA5A5A5A5A5A5A5A5)), out=cum[0, 1:])
                np.cumsum(T.mix(values * U(T.BASE)), out=cum[1, 1:])
                fp = cum[:, first[1:]] - cum[:, first[:-1]]  # sums over the set: 128 bits
                sig = signatures(values, first, how.slots)
                keys = band_keys(sig, how.bands).view(np.int64)
                short = (T.mix(sig) >> U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * how.bands, pa.int32()), pa.array(keys.ravel())),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp0", "fp1", "keys", "sig"],
                )

    return run


def verified(pairs: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """Those of pairs (a, b, n) whose whole shingle sets are similar enough; n: about how many pairs a has.

    The text of b comes first, one for each pair; the text of a comes last, once for each ``hub``
    pairs, which its salts deal over tasks."""
    pairs = pairs.withColumn("salts", F.ceil(F.col("n") / how.hub).cast("int"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    heads = pairs.select("a", "salts").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = pairs.join(right, "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    both = dealt.join(heads, ["a", "salts", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = T.encode(batch.column(2).cast(pa.binary()).to_pylist()), T.encode(batch.column(3).cast(pa.binary()).to_pylist())
            ok = np.zeros(batch.num_rows, bool)
            weights = [x + y for x, y in zip(*texts, strict=True)]
            for i, j in T.blocks(weights, 1 << 20):
                number = {t: k for k, t in enumerate(dict.fromkeys([*texts[0][i:j], *texts[1][i:j]]))}
                values, first = sets(list(number), how.width)
                parts = [values[first[k] : first[k + 1]] for k in range(len(number))]
                for r in range(i, j):
                    x, y = parts[number[texts[0][r]]], parts[number[texts[1][r]]]
                    ok[r] = linked(x, y, how.percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64())], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): least reachable id, by hooking to the least neighbour and jumping."""
    edges = checkpoint(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct())
    labels = checkpoint(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        far = labels.select(F.col("u").alias("v"), F.col("label").alias("far"))
        met = edges.join(far, "v").groupBy("u").agg(F.min("far").alias("near"))
        hooked = labels.select("u", "label").join(met, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        new = checkpoint(hooked.join(jump, "label", "left").select("u", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        release(labels)
        if new.where("label <> old").isEmpty():
            release(edges)
            return new.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = new


def _shingle_sets(how: NearDup):
    """doc_id and its set as bytes."""

    def run(batches):
        for batch in batches:
            parts = T.encode(batch.column(1).cast(pa.binary()).to_pylist())
            for i, j in T.blocks(parts, 1 << 20):
                values, first = sets(parts[i:j], how.width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["rep", "shingles"])

    return run


def _join_components(how: NearDup):
    """Links between components that a pair of blocks shows: estimates choose and order the pairs, whole sets confirm them.

    A pair is looked at only in the first band that both share, and no more once its components have met here."""
    need = int(np.floor(how.slots * (how.percent / 100 - how.margin)))

    def run(batches):
        for t in runs(batches, ["key", "i", "j"]):
            ids, comp, part = (t.column(c).to_numpy() for c in ("rep", "component", "part"))
            i, j, key = (t.column(c)[0].as_py() for c in ("i", "j", "key"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            keys = np.array(t.column("keys").to_pylist(), np.int64).reshape(len(ids), -1)
            band = int((keys[0] == key).argmax())
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            values, count = np.unique(comp, return_counts=True)
            most = values[count.argmax()]
            found = []
            for mine, others in ((left, right),) if i == j else ((left, right), (right, left)):
                for r in mine[comp[mine] != most]:  # every pair of components has a side outside the largest
                    other = others[comp[others] != comp[r]]
                    same = (sig[other] == sig[r]).sum(1)
                    near = same >= need
                    other, same = other[near], same[near]
                    here = (keys[other] == keys[r]).argmax(1) == band
                    found += zip((-same[here]).tolist(), [int(r)] * int(here.sum()), other[here].tolist(), strict=True)
            met = {int(c): int(c) for c in values}

            def find(x):
                while met[x] != x:  # noqa: B023
                    met[x] = x = met[met[x]]  # noqa: B023
                return x

            blobs, links = t.column("shingles"), []
            for _, r, o in sorted(found):
                a, b = find(int(comp[r])), find(int(comp[o]))
                if a != b:
                    x, y = (np.frombuffer(blobs[k].as_py(), np.uint64) for k in (r, o))
                    if linked(x, y, how.percent):
                        met[max(a, b)] = min(a, b)
                        links.append((int(ids[r]), int(ids[o])))
            a, b = (np.array(x, np.int64) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted distinct values are similar enough."""
    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _hidden_links(members: DataFrame, described: DataFrame, texts: DataFrame, comp: DataFrame, how: NearDup) -> DataFrame:
    """Links (a, b) that the buckets of several components still hold, as a table."""
    known = members.where("n > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    known = checkpoint(known.join(mixed, "key", "left_semi"))
    wanted = known.select("rep").distinct()
    facts = described.join(wanted, "rep").join(texts.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(_shingle_sets(how), "rep long, shingles binary").dropDuplicates(["rep"]), "rep")
    facts = checkpoint(facts)
    parts = F.ceil(F.col("n") / how.block).cast("int")
    dealt = (
        known.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "component")
        .join(facts, "rep")
    )
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    found = checkpoint(dealt.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_join_components(how), "a long, b long").distinct())
    release(known, facts)
    return found


def near_duplicates(documents: DataFrame, how: NearDup = NearDup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = checkpoint(docs.mapInArrow(_describe(how), "doc_id long, n_shingles long, fp0 long, fp1 long, keys array<long>, sig binary"))
    # 1: one representative for each set
    some = described.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("fp0", "fp1", "n_shingles").agg(F.min("doc_id").alias("rep"))
    chosen = some.groupBy("doc_id", "fp0", "fp1", "n_shingles").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig")).withColumnRenamed("doc_id", "rep")
    reps = chosen.join(classes, ["fp0", "fp1", "n_shingles", "rep"], "left_semi")
    met = reps.select("rep", F.explode("keys").alias("key"))
    buckets = met.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = checkpoint(met.join(buckets, "key").select("key", "n", "pivot", "rep"))
    # 2: pairs with the least of each bucket
    tried = checkpoint(members.where("rep <> pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n")))
    wanted = checkpoint(members.select(F.col("rep").alias("doc_id")).distinct())
    texts = checkpoint(docs.join(wanted, "doc_id"))
    links = checkpoint(verified(tried, texts, how))
    comp = components(links)
    # 3: what buckets of several components still hold
    facts = reps.select("rep", "sig", "keys")
    more = _hidden_links(members, facts, texts, comp, how)
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    release(members, tried, wanted, texts, links, more)
    found = comp.withColumnRenamed("node", "rep")
    of = classes.join(found, "rep", "left").select("fp0", "fp1", "n_shingles", F.coalesce("component", "rep").alias("found"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.least("found", "doc_id"), "doc_id"))
    return described.select("doc_id", "n_shingles", "fp0", "fp1").join(of, ["fp0", "fp1", "n_shingles"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept")
    )
