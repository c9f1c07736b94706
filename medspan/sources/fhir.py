"""Resources in FHIR JSON as a model, and value sets as a table.

Input is bundles or single resources, a file each, or lines of resources (ndjson),
which splits over tasks. Each resource type has a schema of fields, converted to the
engine's types on the way: partial dates keep their precision, periods become
closed intervals, references bare ids, choices one field for each kind, and
elements with parts tuples. TYPES holds what measures use most; ``definitions`` takes
the types from published structure definitions instead, for the whole model.

Text that is no JSON of a resource takes no part; ``broken`` gives it back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.functions import library as lib
from medspan.functions.core import DECIMAL, E, fresh, sql_type, text
from medspan.sources.model import Model, Resource

_CODING = "struct<system:string,code:string,version:string,display:string>"
#: kind: (JSON schema, type)
KINDS = {
    "string": ("string", "String"), "boolean": ("boolean", "Boolean"), "integer": ("int", "Integer"), "decimal": (DECIMAL, "Decimal"), "date": ("string", "Date"), "dateTime": ("string", "DateTime"), "time": ("string", "Time"),
    "Quantity": (f"struct<value:{DECIMAL},unit:string,system:string,code:string>", "Quantity"), "Coding": (_CODING, "Code"), "CodeableConcept": (f"struct<coding:array<{_CODING}>,text:string>", "Concept"),
    "Period": ("struct<start:string,end:string>", ("Interval", "DateTime")), "Range": (f"struct<low:struct<value:{DECIMAL},unit:string,system:string,code:string>,high:struct<value:{DECIMAL},unit:string,system:string,code:string>>", ("Interval", "Quantity")),
    "Reference": ("struct<reference:string>", "String"),
}

#: Kinds that are primitive strings or numbers under names of their own.
SAME = {"code": "string", "id": "string", "uri": "string", "url": "string", "canonical": "string", "oid": "string", "uuid": "string", "markdown": "string", "base64Binary": "string", "xhtml": "string", "instant": "dateTime", "positiveInt": "integer", "unsignedInt": "integer", "Age": "Quantity", "Duration": "Quantity", "Count": "Quantity", "Distance": "Quantity", "SimpleQuantity": "Quantity", "http://hl7.org/fhirpath/System.String": "string"}
_NAME = {"use": "string", "family": "string", "given": "[string]", "period": "Period"}
_ADDRESS = {"use": "string", "line": "[string]", "city": "string", "state": "string", "postalCode": "string", "country": "string", "period": "Period"}
_EXTENSION = {"url": "string", "valueString": "string", "valueCode": "string", "valueBoolean": "boolean", "valueDateTime": "dateTime", "valueCodeableConcept": "CodeableConcept", "extension": [{"url": "string", "valueString": "string", "valueCoding": "Coding"}]}

#: type: (fields, field of the patient, primary code path). A kind in brackets repeats; a dict is an element with parts, in a list a repeated one.
TYPES = {
    "Patient": ({"id": "string", "active": "boolean", "gender": "string", "birthDate": "date", "deceasedBoolean": "boolean", "deceasedDateTime": "dateTime", "name": [_NAME], "address": [_ADDRESS], "extension": [_EXTENSION], "maritalStatus": "CodeableConcept"}, None, None),
    "Observation": ({"id": "string", "status": "string", "category": "[CodeableConcept]", "code": "CodeableConcept", "subject": "Reference", "encounter": "Reference", "effectiveDateTime": "dateTime", "effectivePeriod": "Period", "issued": "dateTime", "valueQuantity": "Quantity", "valueString": "string", "valueInteger": "integer", "valueBoolean": "boolean", "valueCodeableConcept": "CodeableConcept", "valueRange": "Range", "component": [{"code": "CodeableConcept", "valueQuantity": "Quantity", "valueCodeableConcept": "CodeableConcept"}]}, "subject", "code"),
    "Condition": ({"id": "string", "clinicalStatus": "CodeableConcept", "verificationStatus": "CodeableConcept", "category": "[CodeableConcept]", "severity": "CodeableConcept", "code": "CodeableConcept", "subject": "Reference", "encounter": "Reference", "onsetDateTime": "dateTime", "onsetPeriod": "Period", "abatementDateTime": "dateTime", "abatementPeriod": "Period", "recordedDate": "dateTime"}, "subject", "code"),
    "Encounter": ({"id": "string", "status": "string", "class": "Coding", "type": "[CodeableConcept]", "subject": "Reference", "period": "Period", "reasonCode": "[CodeableConcept]", "hospitalization": {"dischargeDisposition": "CodeableConcept"}, "location": [{"location": "Reference", "period": "Period"}], "diagnosis": [{"condition": "Reference", "use": "CodeableConcept", "rank": "integer"}]}, "subject", "type"),
    "Procedure": ({"id": "string", "status": "string", "code": "CodeableConcept", "subject": "Reference", "encounter": "Reference", "performedDateTime": "dateTime", "performedPeriod": "Period"}, "subject", "code"),
    "MedicationRequest": ({"id": "string", "status": "string", "intent": "string", "medicationCodeableConcept": "CodeableConcept", "subject": "Reference", "encounter": "Reference", "authoredOn": "dateTime"}, "subject", "medicationCodeableConcept"),
    "SupplyDelivery": ({"id": "string", "status": "string", "type": "CodeableConcept", "patient": "Reference", "occurrenceDateTime": "dateTime"}, "patient", "type"),
    "ServiceRequest": ({"id": "string", "status": "string", "intent": "string", "doNotPerform": "boolean", "code": "CodeableConcept", "subject": "Reference", "encounter": "Reference", "authoredOn": "dateTime", "reasonCode": "[CodeableConcept]"}, "subject", "code"),
    "MedicationAdministration": ({"id": "string", "status": "string", "medicationCodeableConcept": "CodeableConcept", "subject": "Reference", "effectiveDateTime": "dateTime", "effectivePeriod": "Period"}, "subject", "medicationCodeableConcept"),
    "MedicationDispense": ({"id": "string", "status": "string", "medicationCodeableConcept": "CodeableConcept", "subject": "Reference", "quantity": "Quantity", "daysSupply": "Quantity", "whenHandedOver": "dateTime"}, "subject", "medicationCodeableConcept"),
    "Immunization": ({"id": "string", "status": "string", "vaccineCode": "CodeableConcept", "patient": "Reference", "occurrenceDateTime": "dateTime"}, "patient", "vaccineCode"),
    "AllergyIntolerance": ({"id": "string", "clinicalStatus": "CodeableConcept", "verificationStatus": "CodeableConcept", "code": "CodeableConcept", "patient": "Reference", "onsetDateTime": "dateTime", "recordedDate": "dateTime"}, "patient", "code"),
    "Coverage": ({"id": "string", "status": "string", "type": "CodeableConcept", "beneficiary": "Reference", "period": "Period"}, "beneficiary", "type"),
    "Claim": ({"id": "string", "status": "string", "use": "string", "type": "CodeableConcept", "patient": "Reference", "billablePeriod": "Period", "created": "dateTime", "item": [{"sequence": "integer", "productOrService": "CodeableConcept", "servicedDate": "date", "servicedPeriod": "Period"}]}, "patient", "type"),
    "DeviceRequest": ({"id": "string", "status": "string", "intent": "string", "codeCodeableConcept": "CodeableConcept", "subject": "Reference", "authoredOn": "dateTime"}, "subject", "codeCodeableConcept"),
    "Device": ({"id": "string", "status": "string", "type": "CodeableConcept", "patient": "Reference"}, "patient", "type"),
    "CarePlan": ({"id": "string", "status": "string", "intent": "string", "category": "[CodeableConcept]", "subject": "Reference", "period": "Period"}, "subject", "category"),
    "Communication": ({"id": "string", "status": "string", "category": "[CodeableConcept]", "reasonCode": "[CodeableConcept]", "subject": "Reference", "sent": "dateTime", "received": "dateTime"}, "subject", "reasonCode"),
    "DiagnosticReport": ({"id": "string", "status": "string", "code": "CodeableConcept", "subject": "Reference", "effectiveDateTime": "dateTime", "issued": "dateTime"}, "subject", "code"),
}


def _schema(kind) -> str:
    """The JSON schema of a field."""
    if isinstance(kind, dict):
        return "struct<" + ",".join(f"`{n}`:{_schema(k)}" for n, k in kind.items()) + ">"
    if isinstance(kind, list) or kind.startswith("["):
        return f"array<{_schema(kind[0] if isinstance(kind, list) else kind[1:-1])}>"
    return KINDS[kind][0]


def _converted(kind, of: str) -> E:
    """A JSON field as the engine's type."""
    if isinstance(kind, dict):
        parts = [(n, _converted(k, f"{of}.`{n}`")) for n, k in kind.items()]
        t = ("Tuple", tuple((n, e.t) for n, e in parts))
        return E(f"case when {of} is not null then cast(named_struct({', '.join(f'{text(n)}, {e}' for n, e in parts)}) as {sql_type(t)}) end", t)
    if isinstance(kind, list) or kind.startswith("["):
        x = fresh("x")
        inner = _converted(kind[0] if isinstance(kind, list) else kind[1:-1], x)
        return E(f"transform({of}, {x} -> {inner})", ("List", inner.t))
    t = KINDS[kind][1]
    if kind in ("date", "dateTime", "time"):
        return lib.call({"date": "ToDate", "dateTime": "ToDateTime", "time": "ToTime"}[kind], [E(of, "String")])
    if kind == "Quantity":
        return E(f"case when {of} is not null then named_struct('value', {of}.value, 'unit', coalesce({of}.code, {of}.unit, '1')) end", t)
    if kind == "Coding":
        return E(f"case when {of} is not null then {_code(of)} end", t)
    if kind == "CodeableConcept":
        return E(f"case when {of} is not null then named_struct('codes', transform({of}.coding, {(x := fresh('c'))} -> {_code(x)}), 'display', {of}.text) end", t)
    if kind in ("Period", "Range"):
        inner = "dateTime" if kind == "Period" else "Quantity"
        lo, hi = ("start", "end") if kind == "Period" else ("low", "high")
        low, high = _converted(inner, f"{of}.`{lo}`"), _converted(inner, f"{of}.`{hi}`")
        return E(f"case when {of} is not null then cast(named_struct('low', {low}, 'high', {high}, 'lc', true, 'hc', true) as {sql_type(t)}) end", t)
    if kind == "Reference":
        return E(f"regexp_extract({of}.reference, '([^/]+)$', 1)", t)
    return E(of, t)


def _code(of: str) -> str:
    return f"named_struct('code', {of}.code, 'system', {of}.system, 'version', {of}.version, 'display', {of}.display)"


_SUBJECTS = ("subject", "patient", "beneficiary")
_CODES = ("code", "vaccineCode", "medicationCodeableConcept", "codeCodeableConcept", "type", "category", "reasonCode")


def definitions(text_: str, only=None) -> dict:
    """TYPES from structure definitions (the JSON of a bundle of them, as published with the
    standard): every element of the resource types, choices as one field for each kind, elements with parts three
    levels deep. only: the names of the types wanted."""
    found = [e["resource"] for e in json.loads(text_)["entry"]]
    known = {d["type"]: d for d in found if d.get("resourceType") == "StructureDefinition" and d.get("derivation") != "constraint"}

    def fields(d: dict, path: str, depth: int) -> dict:
        out = {}
        for e in d["snapshot"]["element"]:
            at, _, name = e["path"].rpartition(".")
            if at != path or name == "contained":
                continue
            for t in e.get("type", ()):
                code = t["code"]
                kind = SAME.get(code, code)
                if code in ("BackboneElement", "Element"):
                    kind = fields(d, e["path"], depth - 1) if depth else {}
                elif kind not in KINDS:
                    kind = fields(known[code], code, depth - 1) if code in known and known[code]["kind"] == "complex-type" and depth else {}
                if kind:
                    own = name.replace("[x]", code[0].upper() + code[1:])
                    out[own] = kind if e.get("max") != "*" else [kind] if isinstance(kind, dict) else f"[{kind}]"
        return out

    out = {}
    for name, d in known.items():
        if d["kind"] == "resource" and not d.get("abstract") and (only is None or name in only):
            own = fields(d, name, 3)
            single = [n for n, k in own.items() if k in ("Reference", "CodeableConcept", "[CodeableConcept]")]
            out[name] = own, next((n for n in _SUBJECTS if n in single), None), next((n for n in _CODES if n in single), None)
    return out


def resources(spark: SparkSession, path: str) -> DataFrame:
    """One row for each resource under a path: kind (null where there is none) and json. A path
    whose name ends in ndjson, or holds it, is read by lines."""
    if "ndjson" in path.rstrip("/").rsplit("/", 1)[-1]:
        return spark.read.text(path).where("trim(value) <> ''").select(F.get_json_object("value", "$.resourceType").alias("kind"), F.col("value").alias("json"))
    whole = spark.read.text(path, wholetext=True)
    bundle = F.from_json("value", "resourceType string, entry array<struct<resource:string>>")
    entries = whole.select("value", bundle.alias("b")).select(F.when(F.col("b.resourceType") == "Bundle", F.expr("transform(b.entry, e -> e.resource)")).otherwise(F.array("value")).alias("all"))
    return entries.select(F.explode("all").alias("json")).select(F.get_json_object("json", "$.resourceType").alias("kind"), "json")


def broken(every: DataFrame) -> DataFrame:
    """Those of resources that are no JSON of a resource."""
    return every.where("kind is null")


def stored(every: DataFrame, folder: str) -> DataFrame:
    """Resources written by kind, and read again from there: then a type's scan reads its own files only."""
    every.where("kind is not null").write.mode("overwrite").partitionBy("kind").parquet(folder)
    return every.sparkSession.read.schema("json string, kind string").parquet(folder)


def model(spark: SparkSession, path: str | DataFrame, value_sets=None, types: dict | None = None) -> Model:
    """The resources under a path, or those of a frame (kind, json), as a model of patients."""
    every = path if isinstance(path, DataFrame) else resources(spark, path)
    out = {}
    for kind, (fields, patient, code) in (types or TYPES).items():
        schema = ", ".join(f"`{n}` {_schema(k)}" for n, k in fields.items())
        frame = every.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("r"))
        typed = {n: _converted(k, f"r.`{n}`") for n, k in fields.items()}
        frame = frame.selectExpr(*[f"{e} as `{n}`" for n, e in typed.items()])
        out[kind] = Resource(frame, {n: (f"`{n}`", e.t) for n, e in typed.items()}, f"`{patient or 'id'}`", code=code)
    return Model(out, "Patient", "id", value_sets or {})


def _contains(depth: int) -> str:
    return f"array<struct<system:string,code:string,abstract:boolean{',contains:' + _contains(depth - 1) if depth else ''}>>"


def _listed(of: str, depth: int) -> str:
    """The codes of an expansion, those within others too."""
    x, y = fresh("x"), fresh("y")
    own = f"transform(filter({of}, {x} -> {x}.code is not null and not coalesce({x}.abstract, false)), {x} -> struct({x}.system as system, {x}.code as code))"
    if not depth:
        return own
    return f"concat({own}, flatten(transform(filter({of}, {y} -> {y}.contains is not null), {y} -> {_listed(f'{y}.contains', depth - 1)})))"


def _parsed_sets(spark: SparkSession, path: str) -> DataFrame:
    concepts = "array<struct<system:string,concept:array<struct<code:string>>,valueSet:array<string>,filter:array<struct<property:string>>>>"
    schema = f"url string, version string, expansion struct<contains:{_contains(4)}>, compose struct<include:{concepts},exclude:{concepts}>"
    return resources(spark, path).where(F.col("kind") == "ValueSet").select(F.from_json("json", schema).alias("v")).select("v.*")


def _composed(part: str) -> str:
    return f"flatten(transform(filter(compose.{part}, i -> i.concept is not null), i -> transform(i.concept, c -> struct(i.system as system, c.code as code))))"


def value_sets(spark: SparkSession, path: str, rounds: int = 20) -> DataFrame:
    """vs_id, system and code of the value sets under a path: their expansions, else the concepts that they list
    and those of the sets that they refer to, less those excluded. vs_id is the url and, where there is one, url|version too;
    a reference without a version, or to one that isn't there, takes all of that url."""
    sets = _parsed_sets(spark, path)
    ids = F.expr("filter(array(url, concat(url, '|', version)), x -> x is not null)")
    own = sets.select(F.explode(ids).alias("vs_id"), F.expr(f"coalesce({_listed('expansion.contains', 4)}, {_composed('include')})").alias("c"))
    codes = own.select("vs_id", F.explode("c").alias("c")).select("vs_id", "c.system", "c.code").distinct()
    links = sets.where("expansion.contains is null").select(F.explode(ids).alias("vs_id"), F.expr("flatten(transform(filter(compose.include, i -> i.valueSet is not null), i -> i.valueSet))").alias("of"))
    links = links.select("vs_id", F.explode("of").alias("of")).distinct()
    known = sets.select(F.explode(ids).alias("of"))
    links = links.join(known.distinct(), "of", "left_semi").unionByName(links.join(known, "of", "left_anti").withColumn("of", F.substring_index("of", "|", 1)))
    edges = [tuple(r) for r in links.select("vs_id", "of").collect()]  # references between sets: as few as the sets
    reach = {(a, b) for a, b in edges}
    for _ in range(rounds):
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    if reach:
        through = spark.createDataFrame(sorted(reach), "vs_id string, of string")
        codes = codes.unionByName(through.join(codes.withColumnRenamed("vs_id", "of"), "of").select("vs_id", "system", "code")).distinct()
    out = sets.where("expansion.contains is null").select(F.explode(ids).alias("vs_id"), F.explode(F.expr(_composed("exclude"))).alias("x")).select("vs_id", F.col("x.system").alias("x_system"), F.col("x.code").alias("x_code"))
    return codes.join(out, (codes["vs_id"] == out["vs_id"]) & codes["system"].eqNullSafe(out["x_system"]) & (codes["code"] == out["x_code"]), "left_anti")


def open_value_sets(spark: SparkSession, path: str) -> DataFrame:
    """url of the sets that value_sets can't list: those with filters or whole systems and no expansion."""
    whole = "exists(compose.include, i -> i.filter is not null or (i.concept is null and i.valueSet is null))"
    return _parsed_sets(spark, path).where(f"expansion.contains is null and (compose.include is null or {whole})").select("url", "version")


def as_codes(frame: DataFrame, limit: int = 5000) -> dict:
    """A small table of value sets as name to codes; fails beyond limit codes, where the table itself must be joined."""
    rows = frame.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} codes: join the table instead")
    out: dict = {}
    for r in rows:
        out.setdefault(r["vs_id"], []).append((r["system"], r["code"]))
    return out
