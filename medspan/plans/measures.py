"""Measures over the driver's tables as populations: libraries and the SQL of the same results."""

from __future__ import annotations

from medspan.plans.population import Population
from medspan.plans.row_queries import shown
from medspan.sources import tables

#: The library; then name: (definition, SQL of its value by c_custkey).
HEAD = """
library Measures version '1.0'
using Tables version '1.0'
codesystem "Kinds": 'urn:kinds'
valueset "Urgent": 'urn:urgent'
valueset "Actions": 'urn:actions'
code "Purchase": 'purchase' from "Kinds"
parameter "Measurement Period" Interval<DateTime> default Interval[@1996-01-01T00:00:00.000, @1997-12-31T23:59:59.999]
context Unfiltered
define "All Encounters": Count([Encounter])
define "Top Price": Max([Encounter] E return all E.price)
context Patient
define "Encounters": [Encounter]
define "Large Encounters": [Encounter] E where E.price > 200000
define "Urgent Encounters": [Encounter: class in "Urgent"]
define "Medications": [MedicationRequest]
define "Purchases": [Observation: code in "Purchase"]
define "Latest Encounter": Last("Encounters" E sort by date, id)
define function "Is Large"(amount Decimal): amount > 200000
define fluent function doubled(amount Decimal): amount * 2
define "Adult": AgeInYearsAt(@2000-01-01) >= 18
"""

VALUE_SETS = {"urn:urgent": [(None, "1-URGENT"), (None, "2-HIGH")], "urn:actions": [(None, "click"), (None, "view")]}

_BIRTH = "(DATE '1940-02-29' + CAST(c_custkey % 20000 AS INT))"
_PER = "SELECT c_custkey AS ctx, {} AS result FROM customer LEFT JOIN (SELECT o_custkey, {} AS v FROM {} GROUP BY 1) ON o_custkey = c_custkey"


def _by(value: str, source: str = "orders", empty: str | None = None) -> str:
    """SQL of an aggregate of the orders by customer."""
    return _PER.format(f"coalesce(v, {empty})" if empty else "v", value, source)


_USER = "SELECT c_custkey AS ctx, {} AS result FROM customer LEFT JOIN (SELECT user_id, {} AS v FROM events WHERE {} GROUP BY 1) ON user_id = c_custkey"
_MED = "orders JOIN lineitem ON l_orderkey = o_orderkey"

MEASURES = {
    "measure_with_during": ('exists ([Encounter] E with [MedicationRequest] M such that M.encounter = E.id and M.date during E.period)', _by("true", "orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY)", "false")),
    "measure_without": ('Count([Encounter] E without [MedicationRequest] M such that M.encounter = E.id and M.discount > 0.05)', _by("CAST(count(*) AS INT)", "orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05)", "0")),
    "measure_with_context": ('Count([Encounter] E with [Observation] O such that O.value > 200 and E.price > 300000)', _by("CAST(count(*) AS INT)", "orders WHERE o_totalprice > 300000 AND EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND value > 200)", "0")),
    "measure_where_exists": ('Count([Encounter] E where E.price > 100000 and exists ([MedicationRequest] M where M.encounter = E.id and M.flag = \'R\'))', _by("CAST(count(*) AS INT)", "orders WHERE o_totalprice > 100000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", "0")),
    "measure_where_not_exists": ('Count([Encounter] E where not exists ([MedicationRequest] M where M.encounter = E.id and M.flag = \'R\'))', _by("CAST(count(*) AS INT)", "orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", "0")),
    "measure_count": ('Count("Encounters")', _by("CAST(count(*) AS INT)", empty="0")),
    "measure_exists": ('exists "Large Encounters"', _by("true", "orders WHERE o_totalprice > 200000", "false")),
    "measure_sum": ('Sum("Encounters" E return all E.price)', _by("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)")),
    "measure_avg": ('Round(Avg("Encounters" E return all E.price), 0)', _by("CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))) / count(*), 0) AS DOUBLE)")),
    "measure_min_max": ('Max("Encounters" E return all E.price) - Min("Encounters" E return all E.price)', _by("CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) - min(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)")),
    "measure_median": ('Round(Median("Encounters" E return all E.price), 1)', _by("CAST(round(CAST(median(o_totalprice) AS DECIMAL(18,4)), 1) AS DOUBLE)")),
    "measure_mode": ('Mode("Encounters" E return all E.class)', "SELECT c_custkey AS ctx, v AS result FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS v FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1) ON o_custkey = c_custkey"),
    "measure_std_dev": ('Round(StdDev("Encounters" E return all E.price) / 1000, 2)', _by("round(stddev_samp(o_totalprice) / 1000, 2)")),
    "measure_variance": ('Round(Variance("Encounters" E return all E.price / 1000), 1)', _by("round(var_samp(o_totalprice / 1000), 1)")),
    "measure_population_std_dev": ('Round(PopulationStdDev("Encounters" E return all E.price / 1000), 1)', _by("round(stddev_pop(o_totalprice / 1000), 1)")),
    "measure_population_variance": ('Round(PopulationVariance("Encounters" E return all E.price / 1000), 1)', _by("round(var_pop(o_totalprice / 1000), 1)")),
    "measure_all_true": ('AllTrue("Encounters" E return all E.price > 10000)', _by("bool_and(o_totalprice > 10000)", empty="true")),
    "measure_any_true": ('AnyTrue("Encounters" E return all E.price > 450000)', _by("bool_or(o_totalprice > 450000)", empty="false")),
    "measure_product": ('Product("Large Encounters" E return all 2)', _by("CAST(pow(2, count(*)) AS INT)", "orders WHERE o_totalprice > 200000")),
    "measure_geometric_mean": ('Round(GeometricMean("Encounters" E return all E.price) / 1000, 1)', _by("round(exp(avg(ln(o_totalprice))) / 1000, 1)")),
    "measure_sum_quantity": ('Sum("Medications" M return all M.dose).value', _by("CAST(sum(l_quantity) AS DOUBLE)", _MED)),
    "measure_first_sorted": ('First("Encounters" E sort by price, id).id', _by("arg_min(o_orderkey, (o_totalprice, o_orderkey))")),
    "measure_last_sorted": ('"Latest Encounter".id', _by("arg_max(o_orderkey, (o_orderdate, o_orderkey))")),
    "measure_take_sorted": ('Sum(Take(("Encounters" E sort by price desc, id), 2) T return all T.price)', "SELECT c_custkey AS ctx, v AS result FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2 GROUP BY 1) ON o_custkey = c_custkey"),
    "measure_list_sorted": ('("Large Encounters" E sort by date desc, id) X return all X.id', _by("string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderdate DESC, o_orderkey)", "orders WHERE o_totalprice > 200000", "''")),
    "measure_retrieve_value_set": ('Count("Urgent Encounters")', _by("CAST(count(*) AS INT)", "orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", "0")),
    "measure_retrieve_code": ('Count("Purchases")', _USER.format("coalesce(v, 0)", "CAST(count(*) AS INT)", "event_type = 'purchase'")),
    "measure_retrieve_codes": ('Count([Observation: code in "Actions"] O where O.value > 50)', _USER.format("coalesce(v, 0)", "CAST(count(*) AS INT)", "event_type IN ('click', 'view') AND value > 50")),
    "measure_parameter": ('Count("Encounters" E where E.date during "Measurement Period")', _by("CAST(count(*) AS INT)", "orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31 23:59:59.999'", "0")),
    "measure_starts_before": ('Count("Encounters" E where E.period starts before start of "Measurement Period")', _by("CAST(count(*) AS INT)", "orders WHERE o_orderdate < TIMESTAMP '1996-01-01'", "0")),
    "measure_overlaps": ('Count("Encounters" E where E.period overlaps "Measurement Period")', _by("CAST(count(*) AS INT)", "orders WHERE o_orderdate <= TIMESTAMP '1997-12-31 23:59:59.999' AND o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1996-01-01'", "0")),
    "measure_ends_during": ('Count("Encounters" E where E.period ends during "Measurement Period")', _by("CAST(count(*) AS INT)", "orders WHERE o_orderdate + INTERVAL 90 DAY BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31 23:59:59.999'", "0")),
    "measure_multi_source": ('Count(from [Encounter] A, [Encounter] B where A.id < B.id and B.date between A.date and A.date + 30 days)', "SELECT c_custkey AS ctx, coalesce(v, 0) AS result FROM customer LEFT JOIN (SELECT a.o_custkey, CAST(count(*) AS INT) AS v FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderkey < b.o_orderkey AND b.o_orderdate BETWEEN a.o_orderdate AND a.o_orderdate + INTERVAL 30 DAY GROUP BY 1) t ON t.o_custkey = c_custkey"),
    "measure_let": ('Sum("Encounters" E let half: E.price / 2 where half > 100000 return all half)', _by("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) / 2 AS DOUBLE)", "orders WHERE o_totalprice > 200000")),
    "measure_return_distinct": ('Count("Encounters" E return distinct E.class)', _by("CAST(count(DISTINCT o_orderpriority) AS INT)", empty="0")),
    "measure_union": ('Count("Large Encounters" union "Urgent Encounters")', _by("CAST(count(*) AS INT)", "orders WHERE o_totalprice > 200000 OR o_orderpriority IN ('1-URGENT', '2-HIGH')", "0")),
    "measure_intersect": ('Count("Large Encounters" intersect "Urgent Encounters")', _by("CAST(count(*) AS INT)", "orders WHERE o_totalprice > 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')", "0")),
    "measure_except": ('Count("Large Encounters" except "Urgent Encounters")', _by("CAST(count(*) AS INT)", "orders WHERE o_totalprice > 200000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "0")),
    "measure_collapse": ('Count(collapse ("Encounters" E return all E.period))', "SELECT c_custkey AS ctx, coalesce(v, 0) AS result FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(new) AS INT) AS v FROM (SELECT o_custkey, CASE WHEN o_orderdate <= max(o_orderdate + INTERVAL 90 DAY) OVER w + INTERVAL 1 MILLISECOND THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1) ON o_custkey = c_custkey"),
    "measure_collapse_events": ('Count(collapse ([Observation] O return all O.span) per hour)', "SELECT c_custkey AS ctx, coalesce(v, 0) AS result FROM customer LEFT JOIN (SELECT user_id, CAST(sum(new) AS INT) AS v FROM (SELECT user_id, CASE WHEN ts <= max(ts + INTERVAL 2 HOUR) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1) ON user_id = c_custkey"),
    "measure_aggregate_clause": ('"Large Encounters" E aggregate R starting 0: R + 1', _by("CAST(count(*) AS INT)", "orders WHERE o_totalprice > 200000", "0")),
    "measure_unfiltered": ('Count("Encounters") * 100000 div "All Encounters"', _by("CAST(count(*) * 100000 // (SELECT count(*) FROM orders) AS INT)", empty="0")),
    "measure_unfiltered_max": ('"Top Price" - Max("Encounters" E return all E.price)', _by("CAST((SELECT CAST(max(o_totalprice) AS DECIMAL(18,2)) FROM orders) - max(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)")),
    "measure_arithmetic": ('Count("Large Encounters") * 100 div Count("Encounters")', _by("CAST(count(*) FILTER (o_totalprice > 200000) * 100 // count(*) AS INT)")),
    "measure_age": ('AgeInYearsAt(@2000-01-01)', f"SELECT c_custkey AS ctx, CAST(CASE WHEN {_BIRTH} <= DATE '2000-01-01' THEN date_sub('year', {_BIRTH}, DATE '2000-01-01') ELSE 0 END AS INT) AS result FROM customer"),
    "measure_age_today": ('AgeInYears() >= 65', f"SELECT c_custkey AS ctx, date_sub('year', {_BIRTH}, DATE '2020-01-02') >= 65 AS result FROM customer"),
    "measure_logic": ('"Adult" and exists "Large Encounters"', f"SELECT c_custkey AS ctx, date_sub('year', {_BIRTH}, DATE '2000-01-01') >= 18 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS result FROM customer"),
    "measure_function": ('Count("Encounters" E where "Is Large"(E.price))', _by("CAST(count(*) AS INT)", "orders WHERE o_totalprice > 200000", "0")),
    "measure_fluent_function": ('Sum("Encounters" E return all E.price.doubled())', _by("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 2 AS DOUBLE)")),
    "measure_case": ('if Count("Encounters") > 10 then \'many\' else \'few\'', _by("CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END", empty="'few'")),
    "measure_singleton": ('singleton from (Take(("Encounters" E sort by price, id), 1) T return all T.id)', _by("arg_min(o_orderkey, (o_totalprice, o_orderkey))")),
    "measure_patient_field": ('Patient.balance > 0 and exists "Encounters"', "SELECT c_custkey AS ctx, c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS result FROM customer"),
    "measure_null_when_empty": ('Max("Large Encounters" E return all E.price) is null', _by("false", "orders WHERE o_totalprice > 200000", "true")),
}


def _measure(name: str, value_sets=None):
    def run(spark, sf_dir):
        model = tables.clinical(spark, sf_dir, value_sets or VALUE_SETS)
        population = Population(model, HEAD + f'define "It": {MEASURES[name][0]}')
        df = population.evaluate("It")
        tree = population.library.tree["defines"]["It"]
        kind = population.expr(tree, population.outer()).t
        from medspan.functions.core import E

        return df.selectExpr("ctx", f"{shown(E('`It`', kind))} as result")

    return run


def _value_set_table(spark, sf_dir):
    """A retrieve by a value set that is a table: a semi join."""
    sets = spark.createDataFrame([("urn:urgent", None, "1-URGENT"), ("urn:urgent", None, "2-high"), ("urn:actions", None, "click")], "vs_id string, system string, code string")
    model = tables.clinical(spark, sf_dir, sets)
    return Population(model, HEAD).row_frame("Urgent Encounters").selectExpr("ctx", "id")


_EVENTS = "SELECT user_id AS ctx, ts AS lo, ts + INTERVAL 2 HOUR AS hi FROM events WHERE value > 150"
#: name: (definition of rows, columns that come out beside ctx, SQL)
ROWS = {
    "rows_retrieve_filter": ('"Large Encounters"', ["id"], "SELECT o_custkey AS ctx, o_orderkey AS id FROM orders WHERE o_totalprice > 200000"),
    "rows_return": ("[Encounter] E where E.price > 400000 return all E.id", ["value as id"], "SELECT o_custkey AS ctx, o_orderkey AS id FROM orders WHERE o_totalprice > 400000"),
    "rows_distinct": ('distinct ("Encounters" E return all E.class)', ["value as class"], "SELECT DISTINCT o_custkey AS ctx, o_orderpriority AS class FROM orders"),
    "rows_flatten": ('flatten ("Large Encounters" E return all {E.id, E.id + 1})', ["value as id"], "SELECT o_custkey AS ctx, unnest([o_orderkey, o_orderkey + 1]) AS id FROM orders WHERE o_totalprice > 200000"),
    "rows_skip": ('Skip(("Encounters" E sort by price desc, id), 2)', ["id"], "SELECT o_custkey AS ctx, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) > 2"),
    "rows_tail": ('Tail("Encounters" E sort by date, id)', ["id"], "SELECT o_custkey AS ctx, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1"),
    "rows_take": ('Take(("Encounters" E sort by price desc, id), 2)', ["id"], "SELECT o_custkey AS ctx, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "rows_collapse": ("collapse ([Observation] O where O.value > 150 return all O.span)", ["unix_micros(value.low) as low", "unix_micros(value.high) as high"], f"SELECT ctx, CAST(epoch_us(min(lo)) AS BIGINT) AS low, CAST(epoch_us(max(hi)) AS BIGINT) AS high FROM (SELECT *, sum(new) OVER (PARTITION BY ctx ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY ctx ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 MILLISECOND THEN 0 ELSE 1 END AS new FROM ({_EVENTS}))) GROUP BY ctx, island"),
    "rows_expand": ("expand ([Observation] O where O.value > 150 return all O.span) per hour", ["unix_micros(value.low) as low"], f"SELECT ctx, CAST(epoch_us(unnest(generate_series(lo, hi, INTERVAL 1 HOUR))) AS BIGINT) AS low FROM (SELECT ctx, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY ctx ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY ctx ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 MILLISECOND THEN 0 ELSE 1 END AS new FROM ({_EVENTS}))) GROUP BY ctx, island)"),
}


def _rows(name: str):
    def run(spark, sf_dir):
        population = Population(tables.clinical(spark, sf_dir, VALUE_SETS), HEAD + f'define "It": {ROWS[name][0]}')
        return population.row_frame("It").selectExpr("ctx", *ROWS[name][1])

    return run


def queries() -> dict:
    return {n: _measure(n) for n in MEASURES} | {"rows_retrieve_value_set_table": _value_set_table} | {n: _rows(n) for n in ROWS}


def oracle_sql() -> dict:
    out = {n: sql for n, (_, sql) in MEASURES.items()} | {n: sql for n, (*_, sql) in ROWS.items()}
    return out | {"rows_retrieve_value_set_table": "SELECT o_custkey AS ctx, o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"}
