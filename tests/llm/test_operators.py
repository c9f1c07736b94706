"""Each operator against brute force, a round trip or held-out cases, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medspan.llm import _text, chat_render, decontaminate, html_density, lang_crf, media_jpeg, quality_ftrl, sentencepiece_trie, suffix_dedup, superminhash, url_reputation
from medspan.llm.queries import SENTENCEPIECE_MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, items string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, "x") for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


# --- near duplicates -------------------------------------------------------


def brute_components(rows, width=5, percent=75):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_texts(rng):
    base = words(rng, 120).split()
    texts = [" ".join(base)]
    for _ in range(60):  # a loose group: copies of copies
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 20 + [words(rng, 50) for _ in range(30)]
    return texts + [None, "", "  \n ", "one two", "ONE  two", "a b c d e", "A b C d E", "x " * 3000]


def test_near_duplicates_match_all_pairs(spark):
    texts = near_texts(random.Random(1))
    got = {r.doc_id: r for r in superminhash.near_duplicates(frame(spark, texts)).collect()}
    want = brute_components(list(enumerate(texts)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_near_duplicates_in_blocks(spark):
    """A bucket over several blocks: the same components."""
    texts = near_texts(random.Random(2))
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(frame(spark, texts), superminhash.NearDup(block=8)).collect()}
    assert got == {d: c for d, (_, c) in brute_components(list(enumerate(texts))).items()}


def test_pairs_of_a_hub_are_dealt(spark):
    texts = near_texts(random.Random(7)) + [f"{words(random.Random(8), 60)} {i}" for i in range(40)]
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(frame(spark, texts), superminhash.NearDup(hub=3)).collect()}
    assert got == {d: c for d, (_, c) in brute_components(list(enumerate(texts))).items()}


def test_long_words_of_a_morse_pattern_differ():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    x, _ = _text.words([a.encode(), b.encode(), a.encode()])
    assert x[0] == x[2] != x[1]


def test_near_duplicates_edges(spark):
    assert superminhash.near_duplicates(frame(spark, [])).collect() == []
    got = superminhash.near_duplicates(frame(spark, ["a b", "a b", "a b"], [5, 5, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("5", "5", True), ("None", "None", True)]


def plain_superminhash(values, m):
    """The algorithm one element and step at a time."""
    out = [(1 << 64) - 1] * m
    for v in values:
        p = list(range(m))
        for j in range(m):
            h = int(_text.mix(np.array([(int(v) + (j + 1) * 0x9E3779B97F4A7C15) & _text.MASK], np.uint64))[0])
            k = j + (h & 0xFFFFFFFF) % (m - j)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 32 | h >> 32)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_superminhash_early_stop_changes_nothing(n):
    values = np.random.default_rng(n).integers(1, 1 << 62, n).astype(np.uint64)
    got = superminhash.signatures(values, np.array([0, n]), 16)[0]
    assert got.tolist() == plain_superminhash(values, 16)


# --- repeated passages -----------------------------------------------------


def test_repeats_match_table_of_passages(spark):
    rng = random.Random(3)
    shared = [words(rng, 12), "é" * 40, "a" * 200]
    texts = [" ".join(rng.choice([words(rng, rng.randrange(1, 15)), rng.choice(shared)]) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "x" * 49, "x" * 50, "y" * 3000, "y" * 2999]
    ids = [i * 3 % 71 for i in range(len(texts) - 1)] + [None]
    rows = list(zip(ids, texts, strict=True))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(frame(spark, texts, ids)).collect()]
    assert sorted(got, key=str) == sorted(suffix_dedup.brute_force(rows), key=str)


def test_hot_triggers_match_table_of_passages(spark):
    """One trigger in thousands of distinct phrases, whole or dealt out by passage."""
    rng = random.Random(4)
    parts = [f"{rng.random()} {'the very same words again and again' if i % 2 else 'another sentence that stays'} {rng.randrange(40)}{rng.random()}"[3:] for i in range(3000)]
    texts = [" ".join(parts[i : i + 30]) + parts[rng.randrange(3000)] for i in range(0, 3000, 30)]
    want = sorted(suffix_dedup.brute_force(list(enumerate(texts))), key=str)
    docs = frame(spark, texts)
    for how in (suffix_dedup.Passages(gather=4000, bucket=20000), suffix_dedup.Passages(gather=4000, spread=20, share=1)):
        hot = suffix_dedup.hot_triggers(docs.selectExpr("doc_id", "0L as k", "text"), how)
        assert (len(hot) > 0) == (how.share == 1)
        got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(docs, how).collect()]
        assert sorted(got, key=str) == want


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=120), st.sampled_from([3, 8, 13, 20, 50]))
def test_suffix_classes_order_bytes(text, length):
    raw = text.encode()
    at = np.arange(max(0, len(raw) - length + 1))
    own = [raw[i : i + length] for i in at]
    place = {x: i for i, x in enumerate(sorted(set(own)))}
    assert suffix_dedup.suffix_classes(np.frombuffer(raw, np.uint8), at, length).tolist() == [place[x] for x in own]


def test_repeats_keep_the_largest_id_and_any_column(spark):
    last = (1 << 63) - 1
    text = "passage " * 30
    docs = spark.createDataFrame([(last, text, 1, 2), (1, text, 3, 4), (None, text, 5, 6)], "doc_id long, text string, __null int, col1 int")
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()} == {(1, 0), (last, 240), (None, 240)}
    assert sorted(map(tuple, suffix_dedup.without_repeats(docs).collect()), key=str) == sorted([(last, "", 1, 2), (1, text, 3, 4), (None, "", 5, 6)], key=str)


def test_without_repeats_keeps_columns(spark):
    long = "passage " * 30
    out = suffix_dedup.without_repeats(frame(spark, [long, "é" + long + "é", None, "short"]))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert rows[0].text == long and rows[2].text is None and rows[3].text == "short"
    assert rows[1].text == "éé" and rows[1].n_chars == 2 and rows[1].items == "x"
    assert suffix_dedup.without_repeats(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=90), max_size=6))
def test_phrases_hold_each_passage_once(texts):
    how = suffix_dedup.Passages(length=10, gram=4)
    parts = [t.encode() for t in texts]
    text, start, passages, _, _ = suffix_dedup.phrases(parts, how)
    seen = sorted((int(t), int(s) + k) for t, s, n in zip(text, start, passages, strict=True) for k in range(int(n)))
    assert seen == [(i, s) for i, p in enumerate(parts) for s in range(len(p) - 9)]


# --- decontamination -------------------------------------------------------


def test_tiles_are_greedy_and_disjoint():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2)]
        got = decontaminate.tiles(a, b, 2, 4)
        for side in (0, 1):
            marks = [x[side] + k for x in got for k in range(x[2])]
            assert len(marks) == len(set(marks))
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        longest = max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(99) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 99)]), default=0)
        assert (got[0][2] if got else 0) == (longest if longest >= 2 else 0)


def test_tiles_match_their_definition():
    rng = random.Random(14)
    for _ in range(400):
        size = rng.choice((2, 3, 6))
        a, b = [[rng.randrange(size) for _ in range(rng.randrange(1, 30))] for _ in range(2)]
        least, first = rng.randrange(1, 4), rng.randrange(1, 9)
        assert decontaminate.tiles(a, b, least, first) == decontaminate.plain_tiles(a, b, least)


def test_tiles_of_one_word_take_no_cube():
    start = time.process_time()
    assert decontaminate.tiles([7] * 400, [7] * 2000) == [(0, 0, 400)]
    assert decontaminate.tiles([7, 8] * 200, [7] * 2000) == []
    assert time.process_time() - start < 2


def test_coverage_matches_whole_texts(spark):
    """Items against whole texts by the definition of tiles, in one block and in several, beside a column called items."""
    rng = random.Random(15)
    items = [words(rng, rng.randrange(3, 40), 30) for _ in range(12)] + ["same " * 30]
    texts = [" ".join(rng.choice([words(rng, 8, 30), " ".join(rng.choice(items).split()[k : k + rng.randrange(2, 30)])]) for k in range(rng.randrange(1, 9))) for _ in range(60)] + [None, "same " * 900, "same " * 12]
    want = {}
    for d, t in enumerate(texts):
        own = (t or "").split()
        got = [(i, sum(x[2] for x in decontaminate.plain_tiles(item.split(), own, min(5, len(item.split())))) / len(item.split())) for i, item in enumerate(items) if d < 60 or item[0] == "s"]
        want[d] = sorted((i, round(c, 6)) for i, c in got if c >= 0.5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    docs = frame(spark, texts)
    for block in (1 << 20, 300):
        how = decontaminate.Tiling(block=block)
        got = {r.doc_id: sorted((i.item_id, round(i.coverage, 6)) for i in r["items"]) for r in decontaminate.contamination(docs, bench, how, keep=["doc_id"]).collect()}
        assert got == want
        kept = decontaminate.decontaminate(docs, bench, how)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if not want[r.doc_id]), key=str)


def test_decontamination_finds_reordered_passages(spark):
    rng = random.Random(5)
    item = words(rng, 40).split()
    moved = item[20:] + ["and"] + item[:20]
    texts = [words(rng, 60), words(rng, 30) + " " + " ".join(item).upper() + " tail", " ".join(moved), " ".join(item[:12]), None, "", "w1", "tiny item", "x tiny! item y"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "Tiny item"), (1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: [(i.item_id, round(i.coverage, 2)) for i in r["items"]] for r in decontaminate.contamination(frame(spark, texts), bench, keep=["doc_id"]).collect()}
    assert got[1] == got[2] == [(1, 1.0), (1, 1.0)]
    assert got[7] == got[8] == [(4, 1.0)]
    assert all(got[d] == [] for d in (0, 3, 4, 5, 6))
    kept = decontaminate.decontaminate(frame(spark, texts), bench, decontaminate.Tiling(block=50))
    assert {r.doc_id for r in kept.collect()} == {0, 3, 4, 5, 6}
    assert decontaminate.contamination(frame(spark, []), bench).collect() == []
    assert decontaminate.contamination(frame(spark, ["a b c d e"]), bench.limit(0)).count() == 1


# --- SentencePiece ---------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_trie.load(SENTENCEPIECE_MODEL)


def test_pieces_match_the_library(pieces):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab teh  nd\n▁é中😀aaa==--\t") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a" * 500, " " * 40 + "x", "internationalisation of counter-revolutionaries, mississippi", "def f(x):\n        return [1,2,3]\n", "", None, "привет мир ありがとう"]
    encoder, decoder = sentencepiece_trie.Encoder(pieces), sentencepiece_trie.Decoder(pieces)
    ids, at = encoder.encode(texts)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t or ""), t
        assert decoder.decode(ids[a:b]) == library.decode(ids[a:b].tolist())


def test_unigram_takes_the_best_sum():
    """Viterbi against all segmentations."""
    rng = random.Random(7)
    names = ["▁", "a", "b", "▁a", "ab", "ba", "aba", "bb", "▁ab"]
    model = sentencepiece_trie.Model(["<unk>", *names], [0.0, *(-rng.uniform(1, 9) for _ in names)], [2] + [1] * len(names), sentencepiece_trie.UNIGRAM, False, True)
    score = dict(zip(names, model.scores[1:], strict=True))

    def best(s):
        return max((score[s[:n]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in score), default=-1e9) if s else 0.0

    encoder = sentencepiece_trie.Encoder(model)
    for _ in range(200):
        t = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        ids, _ = encoder.encode([t])
        assert sum(model.scores[i] for i in ids) == pytest.approx(best("▁" + t), abs=1e-4)


def test_encode_decode_frame(spark, pieces):
    texts = ["hello world", None, "", " lead  two ", "hello world", "x" * 5000, "￾😀"]
    rows = {r.doc_id: r for r in sentencepiece_trie.encode_decode(frame(spark, texts), pieces).collect()}
    assert [rows[i].decoded for i in range(len(texts))] == [t or "" for t in texts]
    assert rows[1].pieces == [] and rows[0].pieces == rows[4].pieces
    assert sentencepiece_trie.encode_decode(frame(spark, []), pieces, digest=True).collect() == []


def test_words_hold_no_punctuation():
    text = "«Été» – „straße“… £5 µ ª a×b „“ naïve。日本々、ⁿ £"
    buffer, a, b, _ = lang_crf.tokens([text])
    assert [buffer[i:j].tobytes().decode() for i, j in zip(a, b, strict=True)] == ["été", "straße", "µ", "ª", "a", "b", "naïve", "日本々", "ⁿ"]


# --- host reputation -------------------------------------------------------


def test_places_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"), "http://x.com": ("x.com", "", None), "http://x.com/": ("x.com", "/", "com/"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/"), "ftp://h.org?x://y/z": ("h.org", "", None), "no scheme": ("", "", None), None: ("", "", None), "": ("", "", None), "http://": ("", "", None), "a://b/c://d": ("b", "/c://d", None),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, none).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == dict(enumerate(cases.values()))
    empty = pages.limit(0)
    assert url_reputation.judge_urls(empty, none).collect() == url_reputation.judge_urls(empty, F.lit(1)).collect() == []


def test_reputation_shrinks_to_parents(spark):
    outcomes = [(f"http://bad.a.org/{i}", 1) for i in range(40)] + [(f"http://good.b.org/{i}", 0) for i in range(200)] + [("http://once.b.org/", 1), (None, 1), ("http://x.org/", None)]
    pages = [(1, "http://bad.a.org/new"), (2, "http://good.b.org/new"), (3, "http://once.b.org/new"), (4, "http://other.a.org/"), (5, "http://else.where.xyz/"), (2, "http://good.b.org/new")]
    got = [(r.page_id, r.verdict, r.bad_rate) for r in url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "url string, bad int"), rules=()).collect()]
    verdicts = {p: (v, b) for p, v, b in got}
    assert len(got) == 6 and verdicts[1][0] == "block" and verdicts[2][0] == verdicts[3][0] == verdicts[5][0] == "allow"
    assert verdicts[2][1] < verdicts[3][1] < 0.9 and verdicts[4][1] > verdicts[5][1]


def test_common_hosts_are_judged_like_others(spark):
    """Broadcast or joined: the same verdicts, for repeated rows, null urls and clashing columns as well."""
    rng = random.Random(6)
    urls = [f"http://h{min(rng.randrange(40), rng.randrange(40))}.d{rng.randrange(3)}.org/{i}" for i in range(300)] + [None, "x"]
    pages = spark.createDataFrame([(i // 2, u, float(u[7:9] in ("h1", "h2") or i % 9 == 0) if u else None, "clash") for i, u in enumerate(urls)], "page_id long, url string, wrong double, host string")

    def judged(outcomes, hot=1000):
        got = url_reputation.judge_urls(pages, outcomes, (), hot=hot).collect()
        return sorted(((*r[:5], round(r.bad_rate, 9), round(r.bad_bound, 9)) for r in got), key=str)

    wants = [judged(F.col("wrong"), hot) for hot in (1, 10, 10_000)]
    assert wants[0] == wants[1] == wants[2] and len(wants[0]) == len(urls) and {x[4] for x in wants[0]} == {"allow", "block"}
    outcomes = pages.select("url", F.col("wrong").alias("bad"))
    assert judged(outcomes) == wants[0]


def test_thin_pages(spark):
    pages = {"<p>" + "word " * 20 + "<a href=x>l</a>": 1, None: None, "": 0, "<a href=x>l</a>": 1, "<script>var x = 1;</script>" + "word " * 80 + "<A\thref=x>l</A>": 0, "<p>" + "é" * 101 + "<a href=x></a>": 0, "plain": 0}
    got = spark.createDataFrame([(h,) for h in pages], "html string").select(url_reputation.thin_page()).collect()
    assert [r[0] for r in got] == [None if x is None else float(x) for x in pages.values()]


# --- language --------------------------------------------------------------


def test_marginals_match_forward_backward():
    rng = np.random.default_rng(1)
    transitions, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([0, 1, 1, 33, 140, 172])
    emission = rng.normal(size=(172, 3))
    got = lang_crf.marginals(emission, first, transitions, start)
    for a, b in zip(first[:-1], first[1:], strict=True):
        e, n = np.exp(emission[a:b]), b - a
        fwd, bwd = np.ones((n, 3)), np.ones((n, 3))
        for i in range(n):
            fwd[i] = (np.exp(start) if i == 0 else fwd[i - 1] @ np.exp(transitions)) * e[i]
            fwd[i] /= fwd[i].sum()
        for i in range(n - 2, -1, -1):
            bwd[i] = np.exp(transitions) @ (e[i + 1] * bwd[i + 1])
            bwd[i] /= bwd[i].sum()
        want = fwd * bwd
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True)) if n else True


SOUNDS = {"xx": ["ka", "lo", "mi", "the"], "yy": ["sch", "ein", "ung", "die"]}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def crf():
    rng = random.Random(8)
    data = [(tongue(rng, k, 60), k) for _ in range(60) for k in SOUNDS]
    return lang_crf.fit([t for t, _ in data], [k for _, k in data], lang_crf.CrfFit(steps=60))


def test_language_of_unseen_and_mixed_text(spark, crf):
    rng = random.Random(9)
    texts = [tongue(rng, k, 40) for k in SOUNDS for _ in range(20)]
    langs, scores = lang_crf.predict(texts, crf)
    assert langs == [k for k in SOUNDS for _ in range(20)] and (scores > 0.9).all()
    mixed = lang_crf.label_words(tongue(rng, "xx", 10) + " " + tongue(rng, "yy", 10), crf)
    assert np.mean([m[1] == ("xx" if i < 10 else "yy") for i, m in enumerate(mixed)]) >= 0.9
    odd = [None, "", "123 -- 4", "…", "kalomi" * 9000, texts[0], texts[0]]
    rows = {r.doc_id: r for r in lang_crf.identify_languages(frame(spark, odd), crf, ["doc_id"]).collect()}
    assert [rows[i].lang_pred for i in range(7)] == ["und"] * 4 + ["xx"] * 3 and rows[0].score == 0 and rows[5].score == rows[6].score
    out = lang_crf.identify_languages(frame(spark, odd), crf, least=0.4)
    assert out.columns == [x.split()[0] for x in DOCS.split(", ")] and {r.doc_id for r in out.collect()} == {4, 5, 6}
    assert lang_crf.identify_languages(frame(spark, []), crf).collect() == []
    assert lang_crf.predict(["abc"], lang_crf.fit([], []))[0] == ["und"]


def test_label_without_letters_stops_no_learning():
    rng = random.Random(8)
    data = [(tongue(rng, k, 60), k) for _ in range(60) for k in SOUNDS] + [("123 -- 4", "aa"), ("", "aa"), ("… 5", "zz")]
    model = lang_crf.fit([t for t, _ in data], [k for _, k in data], lang_crf.CrfFit(steps=60))
    assert model.langs == tuple(SOUNDS)
    langs, scores = lang_crf.predict([tongue(rng, k, 40) for k in SOUNDS], model)
    assert langs == list(SOUNDS) and (scores > 0.9).all()
    assert lang_crf.predict(["abc"], lang_crf.fit(["1", "2"], ["aa", "zz"]))[0] == ["und"]


def test_samples_go_by_hash_with_one_row_of_each_id(spark):
    rows = [(i, "ka" * 50, "xx") for i in range(40)] + [(7, t, "yy") for t in ["ka" * 50, *["lo" * 60] * 200]] + [(50, None, "xx"), (None, "x", "xx"), (51, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    order = [r.doc_id for r in spark.range(40).selectExpr("id AS doc_id", "xxhash64(id) AS h").orderBy("h").collect()]
    everything = docs["doc_id"] >= 0
    texts, langs = lang_crf.training_sample(docs, everything, lang_crf.CrfFit(sample=40))
    assert texts == ["ka" * 50] * 40 and langs == ["xx"] * 40
    marked = docs.withColumn("text", docs["text"].substr(1, 90)).where("lang = 'xx'").selectExpr("doc_id", "concat(text, lpad(doc_id, 10, '0')) AS text", "lang")
    texts, _ = lang_crf.training_sample(marked, everything, lang_crf.CrfFit(sample=30, sample_bytes=1250))
    assert [int(t[-10:]) for t in texts] == sorted(order[:12])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (60, 1)], "doc_id long, quality int")
    parts, y = quality_ftrl.labelled_sample(marked, labels, labels["doc_id"] >= 0, model=quality_ftrl.Ftrl(sample_bytes=1250))
    assert [int(p[-10:]) for p in parts] == sorted(order[:12]) and y.tolist() == [i % 2 for i in sorted(order[:12])]
    assert lang_crf.training_sample(docs.limit(0), everything) == ([], [])


# --- quality ---------------------------------------------------------------


def test_quality_learns_junk(spark):
    rng = random.Random(10)
    good = [words(rng, 40, 5000) for _ in range(300)]
    bad = [" ".join(f"q{rng.randrange(5000)}" + rng.choice(["###", "&&&"]) for _ in range(40)) for _ in range(100)]
    how = quality_ftrl.Ftrl()
    parts = _text.encode([*good[:200], *bad[:70]])
    weights = quality_ftrl.train(parts, np.array([1] * 200 + [0] * 70), how)
    held = quality_ftrl.score(_text.encode([*good[200:], *bad[70:]]), weights, how.bits)
    assert (held[:100] > 0.7).mean() > 0.95 and (held[100:] < 0.5).mean() > 0.95
    rows = {r.doc_id: r.score for r in quality_ftrl.score_quality(frame(spark, [None, "", good[0], good[0], "w " * 20000]), weights, how.bits).collect()}
    assert rows[0] == rows[1] and rows[2] == rows[3] and all(0 <= s <= 1 for s in rows.values())
    assert quality_ftrl.score_quality(frame(spark, []), weights, how.bits).collect() == []
    assert quality_ftrl.score([b""], quality_ftrl.train([], np.array([])), how.bits)[0] == pytest.approx(0.5)


def test_sparse_scores_match_plain_sums():
    parts = _text.encode(["a b a", "", "Z!! y"])
    weights = np.random.default_rng(2).normal(size=(1 << 10) + 1)
    feature, of, value = quality_ftrl.features(parts, 10)
    want = [1 / (1 + np.exp(-(weights[-1] + sum(weights[f] * v for f, d, v in zip(feature, of, value, strict=True) if d == i)))) for i in range(3)]
    assert np.allclose(quality_ftrl.score(parts, weights, 10), want)


# --- media -----------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_payloads_come_back(parts):
    padded = [p + b" " * (192 - len(p) if len(p) < 192 else -len(p) % 192) for p in parts]
    media = media_jpeg.store(padded)
    images, coefficients = media_jpeg.read(media)
    assert [media_jpeg.payload_of(i, coefficients) for i in images] == padded
    alone = [media_jpeg.store([p])[0] for p in padded]
    assert alone == media


def scalar_jpeg(planes, sampling, script, width, height):
    """A plain progressive encoder of given coefficients, zero runs and unknown coefficients included (symbols of eight bits each)."""
    image = media_jpeg.Image.__new__(media_jpeg.Image)
    image.width, image.height, image.sampling = width, height, sampling
    image._shape()
    out = b"\xff\xd8" + media_jpeg._segment(0xDB, b"\x00" + bytes(range(1, 65)))
    out += media_jpeg._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    symbols = list(range(255))
    table = bytes(255 if i == 8 else 0 for i in range(1, 17))
    for kind in (0, 1):
        out += media_jpeg._segment(0xC4, bytes([kind << 4]) + table + bytes(symbols))
    for parts, lo, hi, ah, al in script:
        bits = []

        def put(value, n):
            bits.extend((value >> s) & 1 for s in range(n - 1, -1, -1))  # noqa: B023

        comp, block, _ = image.units(parts)
        pred = dict.fromkeys(parts, 0)
        for c, b in zip(comp.tolist(), block.tolist(), strict=True):
            row = planes[c][b]
            if lo == 0:
                if ah:
                    put((int(row[0]) >> al) & 1, 1)
                else:
                    v = int(row[0]) >> al
                    d, pred[c] = v - pred[c], v
                    n = abs(d).bit_length()
                    put(n, 8)
                    put(d if d >= 0 else d + (1 << n) - 1, n)
                continue
            run, pending = 0, []
            last = max((k for k in range(lo, hi + 1) if (abs(int(row[k])) >> al if not ah else abs(int(row[k])) >> al == 1)), default=lo - 1)
            for k in range(lo, hi + 1):
                a = abs(int(row[k])) >> al
                if ah and a > 1:
                    pending.append(a & 1)
                    continue
                if k > last:
                    continue
                if a == 0:
                    run += 1
                    if run == 16:
                        put(0xF0, 8)
                        for x in pending:
                            put(x, 1)
                        pending, run = [], 0
                    continue
                n = 1 if ah else a.bit_length()
                put(run << 4 | n, 8)
                put((1 if row[k] > 0 else 0) if ah else (a if row[k] > 0 else a ^ ((1 << n) - 1)), n)
                for x in pending:
                    put(x, 1)
                pending, run = [], 0
            if last < hi or pending:
                put(0, 8)
                for x in pending:
                    put(x, 1)
        bits += [1] * (-len(bits) % 8)
        out += media_jpeg._sos([(c + 1, 0, 0) for c in parts], lo, hi, ah, al) + np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    return out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)]])
def test_any_script_and_sampling(sampling):
    rng = np.random.default_rng(3)
    shape = media_jpeg.Image.__new__(media_jpeg.Image)
    shape.width, shape.height, shape.sampling = 37, 21, sampling
    shape._shape()
    planes = []
    for c, (w, h) in enumerate(shape.blocks):
        x = rng.integers(-40, 41, (w * h, 64)) * (rng.random((w * h, 64)) < 0.25)
        own = (np.arange(h)[:, None] < shape.own[c][1]) & (np.arange(w) < shape.own[c][0])
        x[:, 1:] *= own.ravel()[:, None] if len(sampling) > 1 else 1
        planes.append(x)
    every = tuple(range(len(sampling)))
    script = [(every, 0, 0, 0, 1)] + [((c,), 1, 5, 0, 2) for c in every] + [((c,), 6, 63, 0, 2) for c in every] + [((c,), 1, 63, 2, 1) for c in every] + [(every, 0, 0, 1, 0)] + [((c,), 1, 63, 1, 0) for c in every]
    data = scalar_jpeg(planes, sampling, script, 37, 21)
    images, got = media_jpeg.read([data, data])
    for c in every:
        n = len(planes[c])
        assert (got[c][:n] == planes[c]).all() and (got[c][n:] == planes[c]).all()
    rgb = media_jpeg.decode(data)
    assert rgb.shape == (21, 37, 3)
    x = np.zeros((8, 8))
    x.ravel()[media_jpeg.ZIGZAG] = planes[0][0] * np.arange(1, 65)
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * i + 1) * u * np.pi / 16) for u in range(8)] for i in range(8)])
    want = np.clip(np.floor(basis @ x @ basis.T + 0.5) + 128, 0, 255)
    assert np.abs(media_jpeg.samples(got[0][:1], images[0].quant[0])[0] - want).max() <= 1


def test_media_frame(spark):
    texts = [None, "", "é" * 100, "abc", "abc", "z" * 40000]
    rows = {r.doc_id: r for r in media_jpeg.media_columns(frame(spark, texts), tensors=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert rows[i].n_bytes == len(raw) and rows[i].payload.startswith(raw) and not rows[i].payload[len(raw) :].strip(b" ") and len(rows[i].payload) % 192 == 0
        assert len(rows[i].rgb) == rows[i].height * rows[i].width * 3
    assert rows[3].feature == rows[4].feature and rows[3].media == rows[4].media
    assert media_jpeg.media_columns(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        media_jpeg.read([rows[3].media[:-30]])


# --- pages -----------------------------------------------------------------

ARTICLE = "<h1>Head &amp; line</h1><p>First <b>bold</b> paragraph with quite some words in it, enough to count.<p>Second\n paragraph <a href=x>linked</a> &eacute;&nbsp;too, also long enough to count as content.<br>Broken line.</p><ul><li>one<li>two</ul>"
TEXT = "Head & line First bold paragraph with quite some words in it, enough to count. Second paragraph linked é too, also long enough to count as content. Broken line. one two"
NOISE = {
    "nav": "<nav><ul><li><a href=/a>Menu entry</a></ul></nav>", "header": "<header><h1>Site name</h1></header>", "footer": "<footer>&copy; all rights</footer>", "aside": "<aside>side text</aside>", "form": "<form><label>mail</label><input></form>",
    "script": "<script>var t='</p><p>x';</script>", "style": "<style>p{margin:0}</style>", "ad": "<div class='ad'>buy this now</div>", "cookie": "<div id=cookie-notice>we use cookies</div>", "comments": "<section class='comments'><p>nice post, this comment is a long one with many words.</p></section>",
    "hidden": "<div hidden>secret</div>", "comment": "<!-- <p>not text</p> -->", "sidebar": "<div class='sidebar'><p>other posts of the week</p></div>", "role": "<div role=navigation>skip to</div>",
}


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div><div>{}</div></div>"])
@pytest.mark.parametrize("name", NOISE)
def test_page_noise_goes(wrap, name):
    for page in (f"<html><body>{NOISE[name]}{wrap.format(ARTICLE)}</body></html>", f"<body>{wrap.format(ARTICLE)}{NOISE[name]}", f"<body>{wrap.format(ARTICLE + NOISE[name])}" if name != "header" else f"<body>{wrap.format(ARTICLE)}"):
        assert html_density.main_text(f"<!DOCTYPE html><head><title>T</title></head>{page}") == TEXT


def test_density_alone_finds_the_article():
    links = "".join(f"<div><a href=/{i}>link number {i}</a></div>" for i in range(30))
    assert html_density.main_text(f"<body><div>{links}</div><div>{ARTICLE}</div></body>") == TEXT


def test_names_of_frames_exclude_no_article():
    assert html_density.main_text(f"<body><div id=page class='with sidebar'><div class=sidebar>side</div><article>{ARTICLE}</article></div>") == TEXT
    assert html_density.main_text("<body><div class=widget><p>all there is</p></div>") == "all there is"
    assert html_density.main_text(f"<body><article>{ARTICLE}</article><div>{'dense words all over ' * 12}</div>") == TEXT


@pytest.mark.parametrize("tag", ["article", "main"])
def test_all_dense_sibling_articles_are_kept(tag):
    other = "<p>Another part of the same story, told at some length and without any links.</p>"
    both = f"{TEXT} Another part of the same story, told at some length and without any links."
    cards = "".join(f"<{tag}><a href=/{i}>card {i}</a></{tag}>" for i in range(3))
    assert html_density.main_text(f"<body><{tag}>{ARTICLE}</{tag}><{tag}>{other}</{tag}>{cards}") == both
    assert html_density.main_text(f"<body><div><{tag}>{ARTICLE}</{tag}></div><div><{tag}>{other}</{tag}></div>") == both
    core = "".join(f"<p>paragraph {i} of the text that density finds, well away from any mark</p>" for i in range(6))
    assert html_density.main_text(f"<body><div><{tag}><a href=/x>short card of one line here</a></{tag}></div><div>{core}</div>") == re.sub("<p>|</p>", " ", core).replace("  ", " ").strip()


BOX = "<p>A box of the text itself, which says something worth the reading.</p>"


@pytest.mark.parametrize("name", ["content no-sidebar", "with-sidebar", "has-ads", "legal", "alert", "related", "sidebar", "widget"])
@pytest.mark.parametrize("wrap", ["<body>{}", "<body><article>{}</article>", "<body><nav><a href=/>x</a></nav><div>{}</div>"])
def test_names_exclude_no_main_text(wrap, name):
    body = ARTICLE.partition("</h1>")[2]
    page = wrap.format(f"<h1>Head &amp; line</h1><div class='{name}'>{body}</div>")
    assert html_density.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["legal", "alert", "related", "discussion", "no-ads"])
def test_boxes_of_an_article_stay(name):
    assert html_density.main_text(f"<body><article>{ARTICLE}<div class={name}>{BOX}</div></article>") == f"{TEXT} {BOX[3:-4]}"
    if name != "no-ads":
        assert html_density.main_text(f"<body><article>{ARTICLE}<div class={name}><a href=/1>One more page</a> <a href=/2>Another</a></div></article>") == TEXT


@pytest.mark.parametrize("tag, name", [("section", "discussion"), ("div", "social-science"), ("div", "widget-text"), ("p", "notice-board"), ("p", "copyright-law"), ("table", "menu-prices")])
def test_names_with_other_words_stay(tag, name):
    inner = {"p": BOX[3:-4], "table": f"<tr><td>{BOX[3:-4]}"}.get(tag, BOX)
    for outer in ("article", "main"):
        assert html_density.main_text(f"<body><{outer}>{ARTICLE}<{tag} class='{name}'>{inner}</{tag}></{outer}>") == f"{TEXT} {BOX[3:-4]}"


def test_deep_pages_are_linear():
    start = time.process_time()
    for page in ("<div>" * 100_000 + "deep", "<p>" + "<span>" * 50_000 + "<div>" * 50_000 + "deep", "<div>" * 30_000 + "<li>x" * 30_000, "<b><article>" + "<div>" * 30_000 + "x</b>" * 30_000, "<table><tr><td>" * 20_000 + "deep", "<div>" * 30_000 + "<article><p>some words</article>" * 10_000):
        assert html_density.main_text(page)
    assert time.process_time() - start < 30


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.text("abc  ", max_size=30), lambda inner: st.tuples(st.sampled_from(["div", "p", "a", "span"]), st.lists(inner, max_size=5)), max_leaves=25))
def test_densities_match_their_formula(tree):
    def page(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(page, x[1]))}</{x[0]}>"

    root = html_density.parse(f"<body>{page(tree)}</body>")
    nodes = html_density.measure(root)

    def below(n):
        return [y for x in n.children if not isinstance(x, str) for y in (x, *below(x))]

    def chars(n):
        return sum(len(x.replace(" ", "")) if isinstance(x, str) else chars(x) for x in n.children)

    def linked(n):
        return chars(n) if n.tag == "a" else sum(linked(x) for x in n.children if not isinstance(x, str))

    def density(n):
        c, t, lc, lt = chars(n), max(1, len(below(n))), linked(n), max(1, sum(x.tag == "a" for x in below(n)))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + linked(root) / max(1, chars(root)) * c + math.e)
        odds = c / max(1, lc) * t / lt
        # without links the base is 1, and a logarithm to it isn't defined: characters per tag stand alone
        return c / t * math.log(odds, base) if base > 1.0001 and odds > 1 else c / t * (1e-3 if lc >= c else 1.0)

    assert len(nodes) == 1 + len(below(root))
    for n in nodes:
        assert n.density == pytest.approx(density(n), rel=1e-6, abs=1e-9)
        assert n.total == pytest.approx(sum(density(x) for x in n.children if not isinstance(x, str)), rel=1e-6, abs=1e-9)


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([("t", 1, "u", f"<article>{ARTICLE}</article>", 9)], "text string, page_id long, url string, html string, __html int")
    assert [tuple(r) for r in html_density.extract_text(pages).collect()] == [(1, "u", TEXT, len(TEXT))]


def test_forms_comments_and_formulas():
    assert html_density.main_text(f"<body><form action=x><input type=hidden><div>{ARTICLE}</div></form>") == TEXT
    assert html_density.main_text(f"<body><form role=form id=aspnetForm><nav><a href=/>x</a></nav><article>{ARTICLE}</article><select><option>y</select></form>") == TEXT
    assert html_density.main_text(f"<body><article>{ARTICLE}</article><div class=comments>{BOX * 9}</div>") == TEXT
    assert html_density.main_text(f"<body><div class=ad>{BOX * 9}</div><article><h1>Short</h1></article>") == "Short"
    assert html_density.main_text("<body><article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds for all of them.</p></article>") == "So x=2 holds for all of them."


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>x"), (3, "u", "<p>x"), (4, "u", "<" * 500 + "a"), (5, "u", "<div>" * 20000 + "deep" + "</div>" * 7), (6, "u", "plain &lt;text&gt;")], "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_density.extract_text(pages).collect()]
    assert len(got) == 7
    by = {p: (t, n) for p, t, n in got}
    assert by[1] == by[2] == ("", 0) and by[3] == ("x", 1) and by[5][0] == "deep" and by[6] == ("plain <text>", 12)
    assert html_density.extract_text(pages.limit(0)).collect() == []


# --- chat ------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool<", ""]), st.text(st.sampled_from("ab\\<[]/ \n</s>INST"), max_size=20)), max_size=7))
def test_chat_round_trip(turns):
    out, spans, rewritten = chat_render.locate(chat_render.render_instruct, turns)
    assert rewritten is None and chat_render.parse_instruct(out) == turns
    assert [chat_render.unescape(out[s.text_start : s.text_end]) for s in spans] == [t for _, t in turns]
    assert "".join(out[s.start : s.end] for s in spans) == out


def test_rewriting_template_is_detected():
    def last_only(turns):  # drops what assistants thought before the last turn
        return "".join(f"<{r}>{t if i + 1 == len(turns) or r != 'assistant' else t.split('|')[-1]}</{r}>" for i, (r, t) in enumerate(turns))

    turns = [("user", "q"), ("assistant", "think|answer"), ("user", "next")]
    out, spans, rewritten = chat_render.locate(last_only, turns)
    assert rewritten == 2 and out == "<user>q</user><assistant>answer</assistant><user>next</user>"
    assert out[spans[0].text_start : spans[0].text_end] == "q" and out[spans[2].text_start : spans[2].text_end] == "next"


def test_frames_that_count_turns():
    def counted(turns):
        return "".join(f"Turn {i + 1}{r}:{t}|" for i, (r, t) in enumerate(turns))

    for render in (counted, lambda turns: "".join(f"{i + 1}{t}" for i, (_, t) in enumerate(turns))):
        turns = [("user" if i % 2 else "assistant", f"{i}0 hello") for i in range(25)]
        frames = {}
        for _ in range(2):
            out, spans, rewritten = chat_render.locate(render, turns, frames)
            assert rewritten is None and [out[s.text_start : s.text_end] for s in spans] == [t for _, t in turns]


def test_texts_that_hold_probes():
    def last_only(turns):
        return "".join(f"<{r}>{t if i + 1 == len(turns) or r != 'assistant' else t.split('|')[-1]}</{r}>" for i, (r, t) in enumerate(turns))

    turns = [("user", "⁂a ⁂⁂b⁂"), ("assistant", "x|⁂⁂b⁂ ⁂0⁂"), ("user", "⁂1⁂"), ("assistant", "⁂a")]
    out, spans, rewritten = chat_render.locate(last_only, turns)
    assert rewritten == 2 and [out[s.text_start : s.text_end] for s in spans if s] == ["⁂a ⁂⁂b⁂", "⁂1⁂", "⁂a"]
    out, spans, _ = chat_render.locate(chat_render.render_instruct, turns)
    assert [out[s.text_start : s.text_end] for s in spans] == [chat_render.escape(t) for _, t in turns]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool<", ""]), st.text(st.sampled_from("ab\\<[]/ \n</s>INST"), max_size=20)), max_size=9), st.integers(0, 3))
def test_chat_increments_are_whole_prefixes(turns, reach):
    def answers(turns):  # a frame that depends on the turn before
        return "BOS" + "".join(f"{'>' if i and turns[i - 1][0] == r else '|'}{r}:{t}\n" for i, (r, t) in enumerate(turns))

    for render, least in ((chat_render.render_instruct, 0), (answers, 1)):
        if reach >= least:
            out, spans, rewritten = chat_render.locate(render, turns)
            parts = list(chat_render.increments(render, turns, reach, {}))
            assert rewritten is None and "".join(p for p, _ in parts) == out
            assert [(p, s.text_start, s.text_end) for p, s in parts] == [(out[s.start : s.end], s.text_start - s.start, s.text_end - s.start) for s in spans]


def test_chat_increments_refuse_rewriting():
    with pytest.raises(ValueError, match="rewrites history"):
        list(chat_render.increments(lambda turns: f"{len(turns)}{turns[-1][1]}", [("user", "a"), ("user", "b")], 1, {}))


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_chat_blocks(spark, size):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (2, 0, None, "x"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (3, 0, "user", "t"), (3, 0, "user", "t"), (3, None, "system", "<s>"), (4, 0, "user", "y" * 9000)]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn [{i}] \\" * (i % 5)) for i in range(5000)]  # one conversation has most rows
    rows = spark.createDataFrame([(*r, "extra", 0) for r in rows], "conv_id long, turn long, role string, text string, last string, block int")
    whole = {r.conv_id: r for r in chat_render.format_conversations(rows.where("conv_id is null or conv_id <> 5")).collect()}
    blocks = {}
    for part in chat_render.format_blocks(rows, size=size).rdd.glom().collect():
        for r in part:
            blocks.setdefault(r.conv_id, []).append(r)
    assert set(blocks) == {None, 1, 2, 3, 4, 5}
    for conv, got in blocks.items():
        assert [(r.block, r.last) for r in got] == [(i, i + 1 == len(got)) for i in range(len(got))]
        assert all(len(r.formatted) - (r.spans[-1].end - r.spans[-1].start) < size for r in got)
        reader, text = chat_render.Reader(), "".join(r.formatted for r in got)
        for r in got:
            reader.add(r.formatted, [tuple(s) for s in r.loss_spans])
            assert "".join(r.formatted[a:b] for a, b in r.spans) == r.formatted
        if conv != 5:
            assert text == whole[conv].formatted and reader.result() == chat_render.read_back(text, [tuple(s) for s in whole[conv].loss_spans])
    assert len(blocks[5]) == {1: 5000, 1 << 20: 1}.get(size, len(blocks[5]))
    assert chat_render.parse_instruct("".join(r.formatted for r in blocks[5])) == [("assistant" if i % 2 else "user", f"turn [{i}] \\" * (i % 5)) for i in range(5000)]
    assert chat_render.format_blocks(rows.limit(0)).collect() == []


def test_chat_empty_and_clashing(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", 5)], "conv_id long, turn long, role string, text string, turns string, formatted int")
    assert [r.formatted for r in chat_render.format_conversations(rows).collect()] == ["<s>[INST] a [/INST]"]
    assert chat_render.format_conversations(rows.limit(0)).collect() == []


def test_chat_frame(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (2, 0, None, "x"), (None, 0, "user", "n"), (3, 0, "user", "t"), (3, 0, "user", "t"), (4, 0, "user", "y" * 9000)]
    out = {r.conv_id: r for r in chat_render.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert chat_render.parse_instruct(out[1].formatted) == [("user", "a"), ("assistant", "")]
    assert chat_render.parse_instruct(out[3].formatted) == [("user", "t"), ("user", "t")] and len(out) == 5
    assert chat_render.parse_instruct(out[2].formatted) == [("", "x")] and len(out[1].loss_spans) == 1


def test_crc_of_ids_is_that_of_their_text(spark):
    from medspan.llm.queries import _bucket

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", _bucket(5).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
