"""Populations: measures against SQL on the smallest tables, plans, resource bundles, streams, requirements."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from medspan import registry
from medspan.plans.compiler import Compiler, Library
from medspan.plans.population import Population
from medspan.plans.requirements import dump, messages, requirements, restore
from medspan.functions.core import TypeFault
from medspan.sources import fhir, tables
from medspan.sources.libraries import Folder
from medspan.sources.model import union_models
from medspan.streaming.windows import collapse_stream, expand_stream

SF = "/root/testdata/sf0.001"


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "events", "embeddings", "documents", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = want.columns
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["measure_with_during", "measure_without", "measure_with_context", "measure_multi_source", "measure_where_exists"])
def test_no_plan_is_cartesian(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("cond, pushed", [("E.price > 200000", "GreaterThanOrEqual(o_totalprice,199999.999999)"), ("E.price = 5.5", "LessThanOrEqual(o_totalprice,5.500001)"), ("E.date >= @1998-01-01T00:00:00.000", "GreaterThanOrEqual(o_orderdate,1998-01-01 00:00:00.0)"), ("E.status = 'F'", "EqualTo(o_orderstatus,F)")])
def test_filters_reach_the_scan(spark, cond, pushed):
    plan = Population(tables.clinical(spark, SF), f'library L define "D": [Encounter] E where {cond}').row_frame("D").select("ctx")._jdf.queryExecution().executedPlan().toString()
    found = plan[plan.index("PushedFilters") :].split("]")[0]
    assert pushed in found, found


def test_a_scan_reads_only_what_is_used(spark):
    plan = registry.queries()["rows_retrieve_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_aggregates_over_one_row_set_share_it(spark):
    plan = registry.queries()["measure_min_max"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_totalprice") and plan.count("Relation [o_orderkey") == 1 and plan.count("Join") == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


BUNDLE = {
    "resourceType": "Bundle",
    "entry": [
        {"resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1980-05"}},
        {"resource": {"resourceType": "Patient", "id": "p2", "birthDate": "2001-02-03"}},
        {"resource": {"resourceType": "Encounter", "id": "e1", "status": "finished", "subject": {"reference": "Patient/p1"}, "period": {"start": "2023-01-05T10:00:00Z", "end": "2023-01-06"}}},
        {"resource": {"resourceType": "Observation", "id": "o1", "status": "final", "subject": {"reference": "p1"}, "code": {"coding": [{"system": "http://l", "code": "A1"}]}, "effectiveDateTime": "2023-01-05T11:00:00Z", "valueQuantity": {"value": 5.5, "code": "mg"}}},
        {"resource": {"resourceType": "Observation", "id": "o2", "status": "final", "subject": {"reference": "Patient/p2"}, "code": {"coding": [{"system": "http://l", "code": "b2"}]}}},
    ],
}
SET = {"resourceType": "ValueSet", "url": "urn:vs", "compose": {"include": [{"system": "HTTP://L", "concept": [{"code": "a1"}]}]}}


def test_bundles(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(BUNDLE))
    (tmp_path / "s").mkdir()
    (tmp_path / "s/v.json").write_text(json.dumps(SET))
    sets = fhir.value_sets(spark, str(tmp_path / "s"))
    text = """library L valueset "V": 'urn:vs' define "N": Count([Observation: "V"] O with [Encounter] E such that O.effectiveDateTime during E.period)
      define "Q": First([Observation] O return all O.valueQuantity) define "Age": AgeInYearsAt(@2020-06-01) define "Old": Patient.birthDate before @1990-01-01 define "All": Count([Observation])"""
    for given in (sets, fhir.as_codes(sets)):
        p = Population(fhir.model(spark, str(tmp_path / "b.json"), given), text)
        rows = {r.ctx: r for r in p.evaluate("N", "Q", "Age", "Old", "All").collect()}
        assert rows["p1"].N == 1 and rows["p2"].N == 0 and rows["p1"].All == rows["p2"].All == 1
        assert rows["p1"].Q.unit == "mg" and float(rows["p1"].Q.value) == 5.5
        assert rows["p2"].Age == 19 and rows["p1"].Age == 40 and rows["p1"].Old is True and rows["p2"].Old is False
    empty = Population(fhir.model(spark, str(tmp_path / "s")), text).evaluate("Age")
    assert empty.count() == 0


def test_more_of_the_model(spark, tmp_path):
    """Lines of resources, parts of elements, names, several sources, text that is no resource, the store by kind."""
    lines = [
        {"resourceType": "Patient", "id": "p1", "birthDate": "1980-05", "name": [{"family": "Roe", "given": ["Ann", "B"]}], "address": [{"city": "Oslo"}], "extension": [{"url": "urn:race", "valueString": "x"}]},
        {"resourceType": "Immunization", "id": "i1", "patient": {"reference": "Patient/p1"}, "vaccineCode": {"coding": [{"system": "http://l", "code": "A1"}]}, "occurrenceDateTime": "2023-02"},
        {"resourceType": "Encounter", "id": "e1", "subject": {"reference": "p1"}, "period": {"start": "2023-01-05T10:00:00Z"}, "diagnosis": [{"condition": {"reference": "Condition/c1"}, "rank": 1}, {"condition": {"reference": "c2"}, "rank": 2}]},
        {"resourceType": "Claim", "id": "k", "patient": {"reference": "p1"}, "item": [{"sequence": 3, "servicedPeriod": {"start": "2023", "end": "2024"}}]},
    ]
    (tmp_path / "r.ndjson").write_text("\n".join(map(json.dumps, lines)) + "\n{not json\n\n")
    every = fhir.resources(spark, str(tmp_path / "r.ndjson"))
    assert [r.json for r in fhir.broken(every).collect()] == ["{not json"]
    text = """library L valueset "V": 'urn:vs' define "N": First(Patient.name N return all N.family) define "G": Count(First(Patient.name).given) define "C": First(Patient.address A return all A.city)
      define "Ex": exists (Patient.extension X where X.url = 'urn:race' and X.valueString = 'x')
      define "I": Count([Immunization: vaccineCode in "V"] I where I.occurrenceDateTime during Interval[@2023-01-01T, @2023-12-31T])
      define "D": First([Encounter] E return all First(E.diagnosis X where X.rank = 2).condition)
      define "K": Count([Claim] K where exists (K.item X where X.servicedPeriod starts same year as @2023-01-01T))"""
    codes = {"urn:vs": [("http://l", "a1")]}
    for source in (every, fhir.stored(every, str(tmp_path / "store"))):
        row = Population(fhir.model(spark, source, codes), text).evaluate("N", "G", "C", "Ex", "I", "D", "K").collect()
        assert [tuple(r) for r in row] == [("p1", "Roe", 2, "Oslo", True, 1, "c2", 1)]
    two = union_models(fhir.model(spark, every, codes), fhir.model(spark, every.where("kind in ('Immunization', 'Encounter')"), codes))
    assert [tuple(r) for r in Population(two, text).evaluate("I").collect()] == [("p1", 2)]


def test_structure_definitions_give_types(spark):
    def element(path, *codes, most="1"):
        return {"path": path, "max": most, "type": [{"code": x} for x in codes]}

    bundle = {"entry": [{"resource": {"resourceType": "StructureDefinition", "type": name, "kind": kind, "snapshot": {"element": elements}}} for name, kind, elements in (
        ("HumanName", "complex-type", [{"path": "HumanName"}, element("HumanName.given", "string", most="*")]),
        ("Patient", "resource", [{"path": "Patient"}, element("Patient.id", "http://hl7.org/fhirpath/System.String"), element("Patient.name", "HumanName", most="*"), element("Patient.birthDate", "date"), element("Patient.contained", "Resource", most="*")]),
        ("Goal", "resource", [{"path": "Goal"}, element("Goal.id", "id"), element("Goal.subject", "Reference"), element("Goal.category", "CodeableConcept", most="*"), element("Goal.start[x]", "date", "CodeableConcept"), element("Goal.target", "BackboneElement", most="*"), element("Goal.target.measure", "CodeableConcept"), element("Goal.target.due[x]", "date", "Duration")]),
    )]}
    types = fhir.definitions(json.dumps(bundle))
    assert types["Patient"] == ({"id": "string", "name": [{"given": "[string]"}], "birthDate": "date"}, None, None)
    assert types["Goal"] == ({"id": "string", "subject": "Reference", "category": "[CodeableConcept]", "startDate": "date", "startCodeableConcept": "CodeableConcept", "target": [{"measure": "CodeableConcept", "dueDate": "date", "dueDuration": "Quantity"}]}, "subject", "category")
    every = spark.createDataFrame([("Patient", '{"id": "p"}'), ("Goal", '{"id": "g", "subject": {"reference": "Patient/p"}, "target": [{"dueDate": "2024-05"}]}')], "kind string, json string")
    p = Population(fhir.model(spark, every, types=types), 'library L define "T": Count([Goal] G where exists (G.target T where T.dueDate same or after @2024-05))')
    assert [tuple(r) for r in p.evaluate("T").collect()] == [("p", 1)]


def test_value_sets_refer_to_others(spark, tmp_path):
    def one(url, **more):
        return {"resourceType": "ValueSet", "url": url, **more}

    def listed(*codes):
        return {"system": "s", "concept": [{"code": x} for x in codes]}

    sets = [
        one("a", version="1", compose={"include": [listed("1", "2")]}), one("a", version="2", compose={"include": [listed("2", "3")]}),
        one("b", compose={"include": [{"valueSet": ["a|1"]}, listed("9")], "exclude": [listed("2")]}), one("c", compose={"include": [{"valueSet": ["b", "a|7"]}]}),
        one("d", expansion={"contains": [{"system": "s", "code": "1", "contains": [{"system": "s", "code": "5"}, {"system": "s", "abstract": True, "code": "x", "contains": [{"system": "s", "code": "6"}]}]}]}),
        one("loop", compose={"include": [{"valueSet": ["loop", "d"]}]}), one("open", compose={"include": [{"system": "s", "filter": [{"property": "p"}]}]}),
    ]
    (tmp_path / "v.ndjson").write_text("\n".join(map(json.dumps, sets)))
    found: dict = {}
    for r in fhir.value_sets(spark, str(tmp_path / "v.ndjson")).collect():
        found.setdefault(r.vs_id, set()).add(r.code)
    assert found == {"a": {"1", "2", "3"}, "a|1": {"1", "2"}, "a|2": {"2", "3"}, "b": {"1", "9"}, "c": {"1", "2", "3", "9"} - set(), "d": {"1", "5", "6"}, "loop": {"1", "5", "6"}}
    assert [r.url for r in fhir.open_value_sets(spark, str(tmp_path / "v.ndjson")).collect()] == ["open"]
    assert Library("library L valueset \"V\": 'a' version '2' define \"X\": 1").tree["valuesets"] == {"V": "a|2"}


def test_a_folder_of_libraries(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, text in (("a.cql", "library Common version '1.9' define \"N\": 1"), ("x/b.cql", "library Common version '1.10' define \"N\": 2"), ("m.cql", "library Main include Common called C include Common version '1.9' called D define \"S\": C.\"N\" * 10 + D.\"N\"")):
        (tmp_path / name).write_text(text)
    library = Folder(str(tmp_path)).library("Main")
    assert spark.range(1).selectExpr(str(Compiler(library).compile('"S"'))).first()[0] == 21
    assert spark.range(1).selectExpr(str(Compiler(restore(dump(library))).compile('"S"'))).first()[0] == 21
    for name, version in (("Common", "2"), ("None", None)):
        with pytest.raises(TypeFault):
            Folder(str(tmp_path))(name, version)


def test_unfiltered_context(spark):
    text = """library L context Unfiltered define "All": Count([Encounter]) define "Low": Min([Encounter] E where E.price > 100000 return all E.price) context Patient define "Own": Count([Encounter]) define "Both": "Own" + "All" """
    p = Population(tables.clinical(spark, SF), text)
    assert [(r.All, float(r.Low) > 100000) for r in p.evaluate("All", "Low").collect()] == [(1500, True)]
    rows = p.evaluate("Own", "Both").collect()
    assert len(rows) == 150 and all(r.Both == r.Own + 1500 for r in rows)
    with pytest.raises(TypeFault):
        Population(tables.clinical(spark, SF), text.replace("context Patient", "context Patient define \"P\": Count([Encounter]) context Unfiltered define \"W\": \"P\" + 1 context Patient")).evaluate("W")


def test_context_is_joined_only_where_named(spark):
    model = tables.clinical(spark, SF)
    for body, joined in (("[Encounter] AgeOf where AgeOf.price > 1", False), ("[Encounter] E where AgeInYearsAt(@2000-01-01) > 1", True), ("[Encounter] E where E.price > Patient.balance", True), ("[Encounter] E sort by price + Patient.balance", True), ("[Encounter] E where \"Old\"", True)):
        plan = Population(model, f'library L define "Old": AgeInYearsAt(@2000-01-01) > 60 define "D": {body}').row_frame("D")._jdf.queryExecution().analyzed().toString()
        assert ("Join" in plan) == joined, body


def test_streams_merge_and_count(spark, tmp_path):
    events = tables.read(spark, SF, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("sessions", collapse_stream(stream, "ts", ["user_id"], "2 hours", "1 hour")), ("hours", expand_stream(stream, "ts", [], "1 hour", "1 hour"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "sessions" else "complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 1000
    batch = events.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    assert 0 < spark.table("sessions").count() <= batch.count()


def test_requirements_and_trees():
    text = """library L valueset "V": 'urn:v' code "C": 'c' from "S" define "A": [Observation: "V"] union [Observation: "C"] define "B": exists [Encounter] define "D": Message(1, true, 'x', 'Trace', 'said')"""
    library = Library(text)
    assert [r["type"] for r in requirements(library)] == ["Encounter", "Observation"]
    more = Library("""library L define "A": [Observation] define "B": "A" O with [Encounter] E such that O.time during E.period where O.value > 1 return all O.code define "C": First("A" O sort by time).status""")
    assert {r["type"]: r["fields"] for r in requirements(more)} == {"Encounter": ["period"], "Observation": ["code", "status", "time", "value"]}
    assert requirements(library)[1]["code_filters"] == [{"path": None, "value_set": "urn:v", "code": None}, {"path": None, "value_set": None, "code": "c"}]
    again = restore(dump(library))
    assert again.tree["defines"] == library.tree["defines"] and requirements(again) == requirements(library)


def test_messages_are_rows(spark):
    compiler = Compiler()
    compiler.compile("Message(1, true, '7', 'Warning', 'look')")
    assert [tuple(r) for r in messages(spark.range(2), compiler.messages).collect()] == [("7", "Warning", "look")] * 2
