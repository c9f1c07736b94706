"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm import chat_render, decontaminate, html_density, lang_crf, media_jpeg, quality_ftrl, sentencepiece_trie, suffix_dedup, superminhash, url_reputation
from medspan.llm._spark import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(mod: int):
    """crc32(doc_id as text) mod."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(mod)


#: Model file of the SentencePiece queries.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces and decoded again: counts and digests."""
    model = sentencepiece_trie.load(SENTENCEPIECE_MODEL)
    return sentencepiece_trie.encode_decode(_table(spark, sf_dir, "documents"), model, digest=True)


def op2_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that also start in a smaller document, removed."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.coalesce(F.try_element_at("items", F.lit(1))["coverage"], F.lit(0.0)).alias("coverage"), F.sort_array(F.transform("items", lambda x: x["item_id"])).alias("item_ids"),
    )


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by the rules, else by host reputation."""
    pages = _table(spark, sf_dir, "pages")
    out = url_reputation.judge_urls(pages, url_reputation.thin_page())
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model never sees the held-out fifth."""
    documents = _table(spark, sf_dir, "documents")
    texts, langs = lang_crf.training_sample(documents, _bucket(5) != 0)
    model = lang_crf.fit(texts, langs)
    out = lang_crf.identify_languages(documents.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", (_bucket(5) == 0).alias("held_out"), "lang_pred", "score")


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a progressive JPEG, read back and described."""
    media = media_jpeg.media_columns(_table(spark, sf_dir, "documents"))
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the model never sees the held-out quarter."""
    documents = _table(spark, sf_dir, "documents")
    how = quality_ftrl.Ftrl()
    parts, labels = quality_ftrl.labelled_sample(documents, _table(spark, sf_dir, "labels"), _bucket(4) != 2, model=how)
    weights = quality_ftrl.train(parts, labels, how)
    scored = quality_ftrl.score_quality(documents, weights, how.bits)
    return scored.select("doc_id", (_bucket(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_density.extract_text(_table(spark, sf_dir, "pages"))


def op10_chat_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one of control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat_render.format_blocks(rows.unionByName(planted))

    def digest(batches):
        reader = chat_render.Reader()
        for b in batches:
            got = []
            for conv, last, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reader.add(text, [(s["start"], s["end"]) for s in spans])
                if last:
                    got.append((conv, *reader.result(), reader.chars))
                    reader = chat_render.Reader()
            columns = zip(*got, strict=True) if got else [[]] * 6
            types = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return out.select("conv_id", "last", "formatted", "loss_spans").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


QUERIES = {
    "op1_sentencepiece_trie": op1_sentencepiece_trie,
    "op2_prefix_free_parsing": op2_prefix_free_parsing,
    "op3_string_tiling": op3_string_tiling,
    "op4_url_reputation": op4_url_reputation,
    "op5_language_crf": op5_language_crf,
    "op6_superminhash": op6_superminhash,
    "op7_progressive_jpeg": op7_progressive_jpeg,
    "op8_quality_ftrl": op8_quality_ftrl,
    "op9_html_density": op9_html_density,
    "op10_chat_incremental": op10_chat_incremental,
}

SQL = {
    "op2_prefix_free_parsing": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS s FROM d),
g AS (SELECT doc_id, s, md5_number(substr(h, CAST(2 * s + 1 AS INT), 100)) AS v FROM p),
f AS (SELECT v, min(doc_id) AS m FROM g GROUP BY 1),
x AS (SELECT doc_id, s FROM g JOIN f USING (v) WHERE m < doc_id),
y AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) > 50 AS new FROM x),
z AS (SELECT doc_id, s, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM y),
r AS (SELECT doc_id, n, min(s) AS a, max(s) + 50 AS b FROM z GROUP BY 1, 2),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM r),
j AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
  string_agg(substr(h, CAST(2 * c + 1 AS INT), CAST(2 * (a - c) AS INT)) || CASE WHEN last THEN substr(h, CAST(2 * b + 1 AS INT)) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)""",
    "op4_url_reputation": r"""
WITH place AS (
  SELECT page_id, html, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM place),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
o AS (SELECT host, CAST(len(regexp_extract_all(html, '(?i)<a[ >]')) * 100
  > length(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<[^>]*>', '', 'g'), '[ \t\r\n]+', '', 'g')) AS INT) AS bad FROM p),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, array_to_string(string_split(regexp_replace(host, ':\d*$', ''), '.')[-2:], '.') AS domain,
  string_split(regexp_replace(host, ':\d*$', ''), '.')[-1] AS suffix FROM o WHERE bad IS NOT NULL AND host <> '' GROUP BY 1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
t AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS p0 FROM s),
ks AS (SELECT CASE WHEN v > w AND x > 0 THEN least(200, greatest(2, x / (v - w) - 1)) ELSE 200 END AS k FROM (
  SELECT sum(n * p0 * (1 - p0)) AS w, sum(pow(bad - n * p0, 2)) AS v, sum(n * p0 * (1 - p0)) / sum(n) * (sum(n * n) - sum(n)) AS x FROM s, t)),
sp AS (SELECT suffix, p0 * k + bad AS a, (1 - p0) * k + n - bad AS b FROM s, t, ks),
sm AS (SELECT suffix, a / (a + b) AS sm, a * b / ((a + b) * (a + b) * (a + b + 1)) AS sv FROM sp),
kd AS (SELECT CASE WHEN v > w AND x > 0 THEN least(200, greatest(2, x / (v - w) - 1)) ELSE 200 END AS k FROM (
  SELECT sum(n * sm * (1 - sm)) AS w, sum(pow(bad - n * sm, 2)) AS v, sum(n * sm * (1 - sm)) / sum(n) * (sum(n * n) - sum(n)) AS x FROM d JOIN sm USING (suffix))),
dp AS (SELECT domain, sm * k + bad AS a, (1 - sm) * k + n - bad AS b FROM d JOIN sm USING (suffix), kd),
dm AS (SELECT domain, a / (a + b) AS dm, a * b / ((a + b) * (a + b) * (a + b + 1)) AS dv FROM dp),
kh AS (SELECT CASE WHEN v > w AND x > 0 THEN least(200, greatest(2, x / (v - w) - 1)) ELSE 200 END AS k FROM (
  SELECT sum(n * dm * (1 - dm)) AS w, sum(pow(bad - n * dm, 2)) AS v, sum(n * dm * (1 - dm)) / sum(n) * (sum(n * n) - sum(n)) AS x FROM h JOIN dm USING (domain))),
hp AS (SELECT host, dm * k + bad AS a, (1 - dm) * k + n - bad AS b FROM h JOIN dm USING (domain), kh),
hm AS (SELECT host, a / (a + b) AS hm, a * b / ((a + b) * (a + b) * (a + b + 1)) AS hv FROM hp),
j AS (SELECT r.*, coalesce(hm, dm, sm, p0) AS m, coalesce(hv, dv, sv, 0) AS v FROM r LEFT JOIN hm USING (host)
  LEFT JOIN dm ON dm.domain = array_to_string(string_split(regexp_replace(r.host, ':\d*$', ''), '.')[-2:], '.')
  LEFT JOIN sm ON sm.suffix = string_split(regexp_replace(r.host, ':\d*$', ''), '.')[-1], t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN greatest(0, m - sqrt(v)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(m, 6) AS bad_rate, round(greatest(0, m - sqrt(v)), 6) AS bad_bound FROM j""",
    "op6_superminhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id""",
    "op10_chat_incremental": r"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) AS n, length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'user' THEN n + 18 WHEN 'assistant' THEN n + 6 WHEN 'system' THEN n + 18 ELSE n + r + 20 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
