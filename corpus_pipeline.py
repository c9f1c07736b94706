"""The corpus pipeline: five stages over documents, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages are written as Parquet and read again as
the next one's docs, and deleted once that has written its own. Columns beyond those of documents travel with their rows.

Defined results: null and empty texts have no language and go at the first stage;
rows that share a doc_id count as one document in near-dedup and stay or go
together; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm import _spark, decontaminate, lang_crf, sentencepiece_trie, suffix_dedup, superminhash
from medspan.llm.queries import SENTENCEPIECE_MODEL

#: Share of a text's words that its language must have.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language, or with none that most words agree on."""
    _spark.bounded_batches(spark)
    texts, langs = lang_crf.training_sample(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return lang_crf.identify_languages(docs, lang_crf.fit(texts, langs), least=LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near-duplicates."""
    gone = superminhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that stand in an earlier document."""
    return suffix_dedup.without_repeats(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text that is left: doc_id, lang, source, n_pieces, pieces."""
    model = sentencepiece_trie.load(SENTENCEPIECE_MODEL)
    out = sentencepiece_trie.encode_decode(docs, model, ("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("pieces").alias("n_pieces"), "pieces")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece),
]

#: Trained models and greedy tiling have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = _spark.shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.mode("overwrite").parquet(path := f"{folder}/{i}_{name}")
        docs = spark.read.parquet(path)
        if i:
            _spark.remove(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
