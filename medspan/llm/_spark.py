"""Small helpers for plans: checkpoints, samples and grouped Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _base(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else a temporary one, where there are no other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a table written in the shared folder, until release."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of checkpoint that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def runs(batches, keys: list[str]):
    """Tables of consecutive rows with equal keys, across batch borders; keys have no nulls."""
    pending: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        values = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                piece = pa.Table.from_batches([batch.slice(start, i - start)])
                if last is not None and values[start] != last:
                    yield pa.concat_tables(pending)
                    pending = []
                pending.append(piece)
                last = values[start]
                start = i
    if pending:
        yield pa.concat_tables(pending)


def shared_folder(spark) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    return f"{_base(spark)}/tables-{uuid.uuid4().hex}"


def bounded_batches(spark, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, so that a batch of long texts stays small beside an executor's other memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def sampled_rows(ids: DataFrame, rows: DataFrame, most: int, most_bytes: int) -> list:
    """The first ids in the order of a hash, at most that many, each with its least row by
    length and text, sorted by doc_id. A text that the bytes left don't hold is passed over,
    before it leaves the executors.

    ids: doc_id, once each, and what goes with it; rows: doc_id, text and other columns."""
    first = ids.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = rows.withColumn("n_bytes", F.octet_length("text"))
    known = rows.join(F.broadcast(first), "doc_id").groupBy(*first.columns).agg(F.min("n_bytes").alias("n_bytes"))
    taken, left = [], most_bytes
    for row in sorted(known.withColumn("place", F.xxhash64("doc_id")).collect(), key=lambda r: (r["place"], r["doc_id"])):
        if row["n_bytes"] <= left:
            left -= row["n_bytes"]
            taken.append(tuple(row)[:-1])
    picked = F.broadcast(rows.sparkSession.createDataFrame(taken, known.schema))
    columns = ["text", *(c for c in rows.columns if c not in ("text", *known.columns))]
    got = rows.join(picked, ["doc_id", "n_bytes"]).groupBy(*first.columns).agg(F.min(F.struct(*columns)).alias("row"))
    return sorted(got.select(*first.columns, "row.*").collect(), key=lambda r: r["doc_id"])
