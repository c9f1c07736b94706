"""The driver's tables as models: columns with types for row expressions, resources for populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medspan.functions.core import DECIMAL, E
from medspan.sources.model import Model, Resource, raw_of


def dec(column: str) -> str:
    return f"cast({column} as {DECIMAL})"


def stamp(column: str) -> str:
    """A timestamp column: the tables' stamps carry no zone and are read as UTC, so that predicates reach the scan."""
    return column


#: table: (key columns, names with SQL and type)
COLUMNS = {
    "orders": (["o_orderkey"], {"okey": ("o_orderkey", "Long"), "cust": ("o_custkey", "Long"), "status": ("o_orderstatus", "String"), "price": (dec("o_totalprice"), "Decimal"), "date": (stamp("o_orderdate"), "DateTime!"), "day": ("cast(o_orderdate as date)", "Date!"), "priority": ("o_orderpriority", "String")}),
    "lineitem": (["l_orderkey", "l_linenumber"], {"okey": ("l_orderkey", "Long"), "n": ("l_linenumber", "Integer"), "part": ("l_partkey", "Long"), "quantity": (dec("l_quantity"), "Decimal"), "price": (dec("l_extendedprice"), "Decimal"), "discount": (dec("l_discount"), "Decimal"), "tax": (dec("l_tax"), "Decimal"), "flag": ("l_returnflag", "String"), "status": ("l_linestatus", "String"), "ship": (stamp("l_shipdate"), "DateTime!"), "day": ("cast(l_shipdate as date)", "Date!")}),
    "part": (["p_partkey"], {"pkey": ("p_partkey", "Long"), "name": ("p_name", "String"), "brand": ("p_brand", "String"), "type": ("p_type", "String"), "size": ("p_size", "Integer"), "price": (dec("p_retailprice"), "Decimal")}),
    "customer": (["c_custkey"], {"ckey": ("c_custkey", "Long"), "name": ("c_name", "String"), "nation": ("c_nationkey", "Integer"), "balance": (dec("c_acctbal"), "Decimal"), "segment": ("c_mktsegment", "String")}),
    "events": (["event_id"], {"id": ("event_id", "Long"), "user": ("user_id", "Long"), "type": ("event_type", "String"), "value": (dec("value"), "Decimal"), "ts": (stamp("ts"), "DateTime!"), "day": ("cast(ts as date)", "Date!"), "props": ("props", "String")}),
    "documents": (["doc_id"], {"id": ("doc_id", "Long"), "text": ("text", "String"), "lang": ("lang", "String"), "source": ("source", "String"), "chars": ("n_chars", "Long")}),
    "embeddings": (["vec_id"], {"id": ("vec_id", "Long"), "vector": (f"transform(embedding, x -> cast(x as {DECIMAL}))", ("List", "Decimal")), "label": ("label", "Integer")}),
    "labels": (["doc_id"], {"id": ("doc_id", "Long"), "quality": ("quality", "Integer"), "toxic": ("toxic", "Integer")}),
}


#: Columns of stamps without a zone.
STAMPS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    found = spark.read.parquet(path)
    if table not in STAMPS or found.schema[STAMPS[table]].dataType.simpleString() == "timestamp":
        return found
    schema = ", ".join(f"`{f.name}` {'timestamp' if f.name == STAMPS[table] else f.dataType.simpleString()}" for f in found.schema)
    return spark.read.schema(schema).parquet(path)


def scope(table: str) -> dict[str, E]:
    """The table's columns by name."""
    return {n: E(sql, t, raw=raw_of(sql)) for n, (sql, t) in COLUMNS[table][1].items()}


def clinical(spark: SparkSession, sf_dir: str, value_sets=None) -> Model:
    """Patients are customers, encounters orders of 90 days, medication requests lines, observations events."""
    t = {n: read(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "events")}
    period = stamp("o_orderdate"), f"{stamp('o_orderdate')} + interval '90' day"
    span = stamp("ts"), f"{stamp('ts')} + interval '2' hour"
    return Model(
        {
            "Patient": Resource(t["customer"], {"id": ("c_custkey", "Long"), "name": ("c_name", "String"), "nation": ("c_nationkey", "Integer"), "balance": (dec("c_acctbal"), "Decimal"), "segment": ("c_mktsegment", "String"), "birthDate": ("date_add(DATE'1940-02-29', cast(c_custkey % 20000 as int))", "Date!")}, "c_custkey", code="segment"),
            "Encounter": Resource(t["orders"], {"id": ("o_orderkey", "Long"), "status": ("o_orderstatus", "String"), "class": ("o_orderpriority", "String"), "price": (dec("o_totalprice"), "Decimal"), "date": (stamp("o_orderdate"), "DateTime!"), "period": (period, ("Interval", "DateTime!"))}, "o_custkey", code="class"),
            "MedicationRequest": Resource(t["lineitem"], {"encounter": ("l_orderkey", "Long"), "line": ("l_linenumber", "Integer"), "part": ("l_partkey", "Long"), "date": (stamp("l_shipdate"), "DateTime!"), "dose": (f"named_struct('value', {dec('l_quantity')}, 'unit', 'mg')", "Quantity"), "price": (dec("l_extendedprice"), "Decimal"), "discount": (dec("l_discount"), "Decimal"), "flag": ("l_returnflag", "String")}, through=("encounter", "Encounter", "id"), code="flag"),
            "Observation": Resource(t["events"], {"id": ("event_id", "Long"), "code": ("event_type", "String"), "value": (dec("value"), "Decimal"), "time": (stamp("ts"), "DateTime!"), "span": (span, ("Interval", "DateTime!"))}, "user_id", code="code"),
        },
        "Patient", "id", value_sets or {},
    )
