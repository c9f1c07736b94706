"""Language of each word by a linear-chain conditional random field, and of each text.

Emission features of a word: the word itself (lexicon), prefixes and suffixes of
one to four bytes, and all byte bigrams and trigrams with word boundaries, hashed
into one table of weights by language. Transitions and the start are learned with
them, on code-switched sequences spliced from texts of several languages, by the
gradient that forward-backward gives. A text's language has the largest sum of
word marginals; the score is its share.

Words are runs of letters of the lower-cased text. Forward-backward runs over all
texts of a block at once: chunks of words become matrices, which are chained text
by text, and then spread to the words; long texts take no longer path in Python.

Defined results: a null text, or one without any letter, is ``und`` with score 0;
repeated rows get the same result; an empty table gives no rows; without any
learned language everything is ``und``. Labels whose texts have no letter aren't learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.llm import _text as T
from medspan.llm._spark import sampled_rows

U = np.uint64
UNKNOWN = "und"
CHUNK = 32
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[97:123] = False
_NO_LETTER[128:] = False


@dataclass(frozen=True)
class CrfFit:
    """sample: most labelled texts to fit on, in the order of a hash of their ids; bits:
    log2 of the hashed features; steps batches of rows sequences of length words."""

    sample: int = 1200
    sample_bytes: int = 8 << 20
    bits: int = 16
    steps: int = 250
    rows: int = 64
    length: int = 48
    rate: float = 0.5
    l2: float = 1e-6


@dataclass(frozen=True)
class CrfModel:
    langs: tuple
    bits: int
    weights: np.ndarray  # features x languages
    transitions: np.ndarray
    start: np.ndarray


def without_punctuation(buffer: np.ndarray) -> np.ndarray:
    """UTF-8 with blanks for signs that are no letters: of Latin-1, general and ideographic punctuation."""
    lead = np.flatnonzero(np.isin(buffer[:-2], (0xC2, 0xC3, 0xE2, 0xE3)))
    kind, x, y = buffer[lead], buffer[lead + 1], buffer[lead + 2]
    two = (kind == 0xC2) & ~np.isin(x, (0xAA, 0xB5, 0xBA)) | (kind == 0xC3) & np.isin(x, (0x97, 0xB7))
    three = (kind == 0xE2) & ((x == 0x80) | (x == 0x81) & (y < 0xB0)) | (kind == 0xE3) & (x == 0x80) & ((y < 0x85) | (y > 0x87) & (y < 0xA0))
    if not (two.any() or three.any()):
        return buffer
    out = buffer.copy()
    for places, size in ((lead[two], 2), (lead[three], 3)):
        for k in range(size):
            out[places + k] = 32
    return out


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends of words, first word of each text and the total)."""
    parts = T.encode([None if t is None else t.lower() for t in texts])
    buffer, starts, _ = T.flat(parts, b" ")
    buffer = without_punctuation(buffer)
    a, b = T.word_spans(buffer, _NO_LETTER)
    return buffer, a, b, np.append(np.searchsorted(a, starts), len(a))


def word_features(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, word of each): every word's features, words in order of kind."""
    n = b - a
    h = T.prefix_hash(buffer)
    keys, of, every = [], [], np.arange(len(a))

    def add(seed, lo, hi, words):
        keys.append(T.mix(T.span_hash(h, lo, hi) ^ U(seed * 0x9E3779B1)))
        of.append(words)

    add(1, a, b, every)
    for k in range(1, 5):
        long = every[n > k]
        add(10 + k, a[long], a[long] + k, long)
        add(20 + k, b[long] - k, b[long], long)
    for k in (2, 3):
        count = np.maximum(n - k + 1, 0)
        words = np.repeat(every, count)
        at = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count) + a[words]
        add(30 + k, at, at + k, words)
    return (np.concatenate(keys) >> U(64 - bits)).astype(np.int64), np.concatenate(of)


def emissions(buffer, a, b, model: CrfModel) -> np.ndarray:
    """Score of each word by language; equal words are computed once."""
    whole = T.mix(T.span_hash(T.prefix_hash(buffer), a, b))
    _, one, inverse = np.unique(whole, return_index=True, return_inverse=True)
    key, of = word_features(buffer, a[one], b[one], model.bits)
    out = np.empty((len(one), len(model.langs)))
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(of, model.weights[key, k], len(one))
    out /= np.sqrt(np.bincount(of, minlength=len(one)))[:, None]
    return out[inverse]


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of every word's language; first: first word of each text and the total."""
    n, k = emission.shape
    if not n:
        return emission
    e = np.exp(emission - emission.max(1, keepdims=True))
    trans = np.exp(transitions)
    begin = np.exp(start)
    count = np.diff(first)
    chunks = -(-count // CHUNK)  # of each text
    base = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    doc = np.repeat(np.arange(len(count)), chunks)
    nth = np.arange(total) - base[doc]
    at = first[:-1][doc] + nth * CHUNK
    size = np.minimum(CHUNK, first[1:][doc] - at)
    padded = np.ones((CHUNK, total, k))
    where = np.arange(CHUNK)[:, None] < size[None, :]
    index = at[None, :] + np.arange(CHUNK)[:, None]
    padded[where] = e[index[where]]
    # product of each chunk's matrices (transition into a word, then its emission)
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    steps = int(size.max())
    for s in range(steps):
        on = where[s]
        new = (product.reshape(-1, k) @ trans).reshape(total, k, k)
        if s == 0:  # a text's first word takes the start in place of a transition
            new[nth == 0] = begin
        new *= padded[s][:, None, :]
        new /= new.sum((1, 2), keepdims=True)
        product = np.where(on[:, None, None], new, product)
    # messages at chunk borders, text by text in step
    head, tail = np.empty((total, k)), np.ones((total, k))
    order = np.argsort(-chunks, kind="stable")
    depth = int(chunks.max())
    alive = np.searchsorted(-chunks[order], -np.arange(1, depth + 1), "right")
    current = np.full((len(count), k), 1 / k)
    for s in range(depth):
        docs = order[: alive[s]]
        c = base[docs] + s
        head[c] = current[docs]
        moved = np.einsum("ci,cij->cj", current[docs], product[c])
        current[docs] = moved / moved.sum(1, keepdims=True)
    back = np.ones((len(count), k))
    for s in range(depth - 1, -1, -1):
        docs = order[: alive[s]]
        c = base[docs] + s
        tail[c] = back[docs]
        moved = np.einsum("cij,cj->ci", product[c], back[docs])
        back[docs] = moved / moved.sum(1, keepdims=True)
    forward = np.empty((steps, total, k))
    current = head
    for s in range(steps):
        new = current @ trans
        if s == 0:
            new[nth == 0] = begin
        new *= padded[s]
        new /= new.sum(1, keepdims=True)
        current = np.where(where[s][:, None], new, current)
        forward[s] = current
    out = np.empty((n, k))
    current = tail
    for s in range(steps - 1, -1, -1):
        on = where[s]
        both = forward[s] * current
        out[index[s][on]] = (both / both.sum(1, keepdims=True))[on]
        new = (padded[s] * current) @ trans.T
        new /= new.sum(1, keepdims=True)
        current = np.where(on[:, None], new, current)
    return out


def fit(texts: list[str], langs: list[str], how: CrfFit = CrfFit()) -> CrfModel:
    """Learns weights, transitions and start from texts of one language each; a label
    none of whose texts has a letter is no language."""
    lettered = [d for d, t in enumerate(texts) if has_letter(t)]
    texts, langs = [texts[d] for d in lettered], [langs[d] for d in lettered]
    names = tuple(sorted(set(langs)))
    k = len(names)
    size = 1 << how.bits
    model = CrfModel(names, how.bits, np.zeros((size, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    buffer, a, b, first = tokens(texts)
    label = np.array([names.index(x) for x in langs])
    usable = [[d for d in np.flatnonzero(label == j) if first[d + 1] > first[d]] for j in range(k)]
    whole = T.mix(T.span_hash(T.prefix_hash(buffer), a, b))
    _, one, inverse = np.unique(whole, return_index=True, return_inverse=True)
    key, of = word_features(buffer, a[one], b[one], how.bits)
    order = np.argsort(of, kind="stable")
    key, of = key[order], of[order]
    cut = np.searchsorted(of, np.arange(len(one) + 1))
    rng = np.random.default_rng(5)
    square, square_t, square_s = np.full((size, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    for _ in range(how.steps):
        words, truth = np.empty((how.length, how.rows), np.int64), np.empty((how.length, how.rows), np.int64)
        for r in range(how.rows):
            at = 0
            while at < how.length:
                lang = int(rng.integers(k))
                docs = usable[lang]
                d = docs[int(rng.integers(len(docs)))]
                run = min(int(rng.integers(4, 25)), how.length - at, int(first[d + 1] - first[d]))
                s = int(rng.integers(first[d], first[d + 1] - run + 1))
                words[at : at + run, r], truth[at : at + run, r] = inverse[s : s + run], lang
                at += run
        flat = words.ravel()
        count = cut[flat + 1] - cut[flat]
        which = np.repeat(np.arange(len(flat)), count)
        feature = key[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + cut[flat][which]]
        scale = 1 / np.sqrt(count)
        emission = np.stack([np.bincount(which, model.weights[feature, j], len(flat)) for j in range(k)], 1) * scale[:, None]
        e = np.exp(emission - emission.max(1, keepdims=True)).reshape(how.length, how.rows, k)
        trans, begin = np.exp(model.transitions), np.exp(model.start)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t in range(how.length):
            x = (begin if t == 0 else alpha[t - 1] @ trans) * e[t]
            alpha[t] = x / x.sum(1, keepdims=True)
        for t in range(how.length - 2, -1, -1):
            x = (beta[t + 1] * e[t + 1]) @ trans.T
            beta[t] = x / x.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        pair = alpha[:-1, :, :, None] * trans * (e[1:] * beta[1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        target = np.eye(k)[truth]
        error = ((p - target).reshape(-1, k)) * scale[:, None]
        for j in range(k):
            g = np.bincount(feature, error[which, j], size) / how.rows + how.l2 * model.weights[:, j]
            square[:, j] += g * g
            model.weights[:, j] -= how.rate * g / np.sqrt(square[:, j])
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[:-1].ravel(), truth[1:].ravel()), 1)
        g = (pair.sum((0, 1)) - seen) / how.rows
        square_t += g * g
        model.transitions[:] = model.transitions - how.rate * g / np.sqrt(square_t)
        g = (p[0] - target[0]).mean(0)
        square_s += g * g
        model.start[:] = model.start - how.rate * g / np.sqrt(square_s)
    return model


def label_words(text: str, model: CrfModel) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of one code-switched text."""
    buffer, a, b, first = tokens([text])
    p = marginals(emissions(buffer, a, b, model), first, model.transitions, model.start) if len(a) else np.zeros((0, 1))
    raw = buffer.tobytes()
    return [(raw[i:j].decode("utf-8", "replace"), model.langs[int(x.argmax())], float(x.max())) for i, j, x in zip(a, b, p, strict=True)]


def predict(texts: list, model: CrfModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return langs, scores
    sizes = [b"" if t is None else t for t in texts]
    for i, j in T.blocks(sizes, 1 << 19):
        buffer, a, b, first = tokens(texts[i:j])
        if not len(a):
            continue
        p = marginals(emissions(buffer, a, b, model), first, model.transitions, model.start)
        cum = np.vstack([np.zeros(p.shape[1]), np.cumsum(p, 0)])
        share = cum[first[1:]] - cum[first[:-1]]
        count = np.diff(first)
        for d in np.flatnonzero(count):
            if has_letter(texts[i + d]):
                best = int(share[d].argmax())
                langs[i + d], scores[i + d] = model.langs[best], min(1.0, max(0.0, share[d, best] / count[d]))
    return langs, scores


def has_letter(text: str | None) -> bool:
    if text is None:
        return False
    low = text.isascii()
    return any(c.isalpha() for c in text) if not low else not text.isspace() and any("a" <= c <= "z" for c in text.lower())


def training_sample(documents: DataFrame, where, how: CrfFit = CrfFit()) -> tuple[list[str], list[str]]:
    """Texts and languages to fit on: rows under where with both, at most how.sample ids
    and how.sample_bytes, in the order of a hash of the id; one row of each id."""
    chosen = documents.where(where).where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = sampled_rows(chosen.select("doc_id").distinct(), chosen, how.sample, how.sample_bytes)
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify_languages(documents: DataFrame, model: CrfModel, keep: list[str] | None = None, least: float | None = None, text: str = "text") -> DataFrame:
    """The columns in keep (all by default) with lang_pred and score (replacing columns so named).

    With least, only texts with a language and at least that score stay, and no
    column is added: a filter of the table."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (keep or documents.columns) if least is not None or c not in ("lang_pred", "score")]
    at = keep.index(text) if text in keep else len(keep)  # a text that stays is sent once
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], *[F.col(text).alias("__text")] * (at == len(keep)))
    fields = [f.simpleString().split(":", 1) for f in documents.select(*[F.col(f"`{c}`") for c in keep]).schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ("" if least is not None else ", lang_pred string, score double")

    def run(batches):
        for batch in batches:
            langs, scores = predict(batch.column(at).to_pylist(), shared.value)
            columns = batch.columns[: len(keep)]
            if least is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])
            else:
                mask = pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, keep).filter(mask)

    return rows.mapInArrow(run, schema)
