"""Operators on row-sets: frames with a context column ctx."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medspan.functions import core as c
from medspan.functions import library as lib
from medspan.functions.core import DECIMAL, E, base, coerce, sql_type


def coded_in(df: DataFrame, column: E, codes: DataFrame) -> DataFrame:
    """Rows whose code is in a table (__code, __system): a semi join; Spark picks a broadcast where the table's size allows."""
    if column.t == "String":
        return df.join(codes, F.lower(F.expr(column.sql)) == F.col("__code"), "left_semi")
    if column.t == "Code":
        on = (F.lower(F.expr(f"({column}).code")) == F.col("__code")) & (F.expr(f"coalesce(({column}).system, '') = ''") | (F.lower(F.expr(f"({column}).system")) == F.col("__system")))
        return df.join(codes, on, "left_semi")
    listed = f"({column}).codes" if column.t == "Concept" else column.sql
    # membership hangs on the listed codes alone: their text is the key, which a lost partition gives again
    keyed = df.withColumn("__codes", F.expr(f"to_json({listed})"))
    each = keyed.selectExpr("__codes", f"{listed} as __all").distinct().selectExpr("__codes", "explode(__all) as __c")
    hits = each.join(codes, F.expr("lower(__c.code) = __code and (coalesce(__c.system, '') = '' or lower(__c.system) = __system)"), "left_semi").select("__codes").distinct()
    return keyed.join(hits, "__codes", "left_semi").drop("__codes")


def collapse(df: DataFrame, item: E, per: E | None) -> DataFrame:
    """Merged intervals of each context, by gaps and islands: two windows over one partitioning."""
    t = item.t[1]
    lo, hi = lib.start(item), lib.end(item)
    point = sql_type(t)
    if base(t) in c.TEMPORAL and not t.endswith("!"):
        lo, hi = E(c.v(lo), base(t) + "!"), E(c.v(hi), base(t) + "!")
        t = base(t) + "!"
    df = df.selectExpr("ctx", f"{lo} as __lo", f"{hi} as __hi").where("__lo is not null and __hi is not null")
    by = Window.partitionBy("ctx").orderBy("__lo", "__hi")
    reach = df.withColumn("__reach", F.max("__hi").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    e = E("__reach", t)
    limit = lib.call("Add", [e, per]) if per is not None and base(t) in c.TEMPORAL else lib.step(e, 1)
    new = F.expr(f"case when __reach is null or __lo > {limit} then 1 else 0 end")
    island = reach.withColumn("__new", new).withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("ctx", "__island").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    ends = (E("__lo", t), E("__hi", t)) if sql_type(t) == point else tuple(coerce(E(x, t), item.t[1]) for x in ("__lo", "__hi"))
    return out.selectExpr("ctx", f"named_struct('low', {ends[0]}, 'high', {ends[1]}, 'lc', true, 'hc', true) as value")


def limit(df: DataFrame, keys: list[tuple[str, bool]], n: str, skip: bool = False) -> DataFrame:
    """The first n rows of each context, or all but those."""
    order = [F.expr(k).desc_nulls_last() if d else F.expr(k).asc_nulls_first() for k, d in keys]
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy("ctx").orderBy(*order)))
    return numbered.where(f"__n {'>' if skip else '<='} {n}").drop("__n")


def _sorted(value: E, keys) -> str:
    """The list of each context in order: all keys ascending, so descending ones are turned first."""
    if not keys:
        return f"collect_list({value})"
    packed = ", ".join(f"{k} as k{i}" for i, (k, _) in enumerate(keys))
    items = f"collect_list(struct({packed}, {value} as e))"
    tests = []
    for i, (_, d) in enumerate(keys):
        a, b = (f"x.k{i}", f"y.k{i}") if not d else (f"y.k{i}", f"x.k{i}")
        tests.append(f"when x.k{i} is null and y.k{i} is null then 0 when {a} is null then -1 when {b} is null then 1 when {a} < {b} then -1 when {a} > {b} then 1 else 0 end")
    comparison = "0"
    for test in reversed(tests):
        comparison = f"(case when (case {test}) <> 0 then (case {test}) else {comparison} end)"
    return f"transform(array_sort({items}, (x, y) -> {comparison}), z -> z.e)"


def _edge(last: bool):
    def f(value: E, keys):
        if not keys:
            return (f"last({value})" if last else f"first({value})"), value.t, None
        turned = keys[0][1] != last
        if all(d == keys[0][1] for _, d in keys):
            # nulls come first going up: the smallest, so they are kept apart from the key
            parts = ", ".join(f"{key} is not null as n{i}, {key} as k{i}" for i, (key, _) in enumerate(keys))
            return f"{'max_by' if turned else 'min_by'}({value}, struct({parts}))", value.t, None
        return (f"try_element_at({_sorted(value, keys)}, -1)" if last else f"get({_sorted(value, keys)}, 0)"), value.t, None

    return f


def _number(value: E, kind=None) -> E:
    if value.t == "Quantity":
        return E(f"({value}).value", "Decimal")
    return coerce(value, kind) if kind else value


def _unit(value: E, how: E) -> tuple:
    if value.t != "Quantity":
        return how.sql, how.t, None
    return f"case when count(distinct ({value}).unit) = 1 then named_struct('value', cast({how} as {DECIMAL}), 'unit', min(({value}).unit)) end", "Quantity", None


def _simple(name: str, t=None, kind=None):
    def f(value: E, keys):
        x = _number(value, kind)
        out = t or x.t
        return _unit(value, E(f"try_cast({name.format(x)} as {sql_type(out)})", out))

    return f


def _extreme(name: str):
    def f(value: E, keys):
        key = lib.sort_key(value)
        return (f"{name}({value})" if key == value.sql else f"{name}_by({value}, {key})"), value.t, None

    return f


#: name to (value, sort keys) -> (aggregate, type, what an empty list gives).
AGGREGATES = {
    "Count": lambda value, keys: (f"cast(count({value}) as int)", "Integer", "0"),
    "Exists": lambda value, keys: (f"count({value}) > 0", "Boolean", "false"),
    "Sum": _simple("try_sum({})"),
    "Avg": _simple("avg({})", "Decimal", "Decimal"),
    "Min": _extreme("min"),
    "Max": _extreme("max"),
    "Median": _simple("percentile({}, 0.5)", "Decimal", "Decimal"),
    "Mode": lambda value, keys: (f"mode({value}, true)", value.t, None),
    "Product": lambda value, keys: (f"aggregate(collect_list({_number(value)}), cast(1 as {sql_type(_number(value).t)}), (s, x) -> try_cast(try_multiply(s, x) as {sql_type(_number(value).t)}))", _number(value).t, None),
    "GeometricMean": _simple("exp(avg(ln(cast({} as double))))", "Decimal", "Decimal"),
    "AllTrue": lambda value, keys: (f"coalesce(bool_and({value}), true)", "Boolean", "true"),
    "AnyTrue": lambda value, keys: (f"coalesce(bool_or({value}), false)", "Boolean", "false"),
    "StdDev": _simple("stddev_samp(cast({} as double))", "Decimal", "Decimal"),
    "Variance": _simple("var_samp(cast({} as double))", "Decimal", "Decimal"),
    "PopulationStdDev": _simple("stddev_pop(cast({} as double))", "Decimal", "Decimal"),
    "PopulationVariance": _simple("var_pop(cast({} as double))", "Decimal", "Decimal"),
    "First": _edge(False),
    "Last": _edge(True),
    "SingletonFrom": lambda value, keys: (f"case when count(*) > 1 then raise_error('more than one element') else first({value}) end", value.t, None),
    "ToList": lambda value, keys: (_sorted(value, keys), ("List", value.t), f"cast(array() as {sql_type(('List', value.t))})"),
}
