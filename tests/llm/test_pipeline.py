"""The pipeline stage by stage against brute force, on a small folder of tables."""

import hashlib
import random

import pytest

import corpus_pipeline
from medspan.llm import suffix_dedup
from medspan.llm.queries import SENTENCEPIECE_MODEL
from test_operators import DOCS, brute_components, tongue, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [(tongue(rng, k, rng.randrange(30, 60)), k) for _ in range(40) for k in ("xx", "yy")]
    item = words(rng, 30)
    passage = " ".join(tongue(rng, "xx", 1) for _ in range(60))
    near = texts[0][0].split()
    near[-1] = "changed"
    more = [(" ".join(near), "xx"), (texts[1][0], "yy"), (texts[2][0] + " " + item + " " + texts[4][0], "xx"), (texts[6][0][:80] + passage, "xx"), (texts[8][0][:80] + passage, "xx"), (None, "xx"), ("", None), ("1 2 3 --", "yy")]
    rows = [(i, t, k, f"s{i % 3}", len(t) if t is not None else None, 1.0, "x") for i, (t, k) in enumerate(texts + more)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_each_stage_does_its_whole_job(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if i < 4:
            assert docs.columns == columns
        if name == "language_id":
            assert set(before) - set(after) == {d for d, r in before.items() if not any(c.isalpha() for c in r.text or "")}
        elif name == "near_dedup":
            assert set(after) == {c for _, c in brute_components([(d, r.text) for d, r in before.items()]).values()}
            assert len(before) - len(after) == 2
        elif name == "suffix_dedup":
            want = {d: h for d, _, _, _, h in suffix_dedup.brute_force([(d, r.text) for d, r in before.items()])}
            assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values()) and any(r.text != before[d].text for d, r in after.items())
        elif name == "decontaminate":
            assert set(before) - set(after) == {82}
        else:
            library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
            assert all(r.pieces == library.encode(before[d].text) and r.n_pieces == len(r.pieces) for d, r in after.items())
        before = after
    run = {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, folder).collect()}
    assert run == {d: r.pieces for d, r in before.items()}


def test_an_empty_table_passes_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
