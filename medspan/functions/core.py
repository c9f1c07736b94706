"""Typed SQL expressions: types, literals, conversions and the comparison kernel.

An expression is Spark SQL text with a type. Types are names, or tuples
("List", t), ("Interval", t), ("Tuple", ((name, t), ...)). Dates and times come in
two forms: with a precision of their own, as structs (v, p), and, written with a
mark as in ``DateTime!``, as plain dates and timestamps of full precision, whose
comparisons stay plain predicates that scans and joins can use.

Precision codes: 1 year, 2 month, 3 day, 4 hour, 5 minute, 6 second, 7 millisecond.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

DECIMAL = "decimal(28,8)"
TEMPORAL = ("Date", "DateTime", "Time")
NUMBERS = ("Integer", "Long", "Decimal")
LEVEL = {"year": 1, "month": 2, "week": 3, "day": 3, "hour": 4, "minute": 5, "second": 6, "millisecond": 7}
FULL = {"Date": 3, "DateTime": 7, "Time": 7}
MICROS = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}
_names = itertools.count()


class TypeFault(TypeError):
    """No operator for these types."""


@dataclass(frozen=True)
class E:
    """sql text of type t; p: the precision of a temporal value, where it is known; raw: the
    plain number column that the value is cast from, which predicates on scans can use."""

    sql: str
    t: object
    p: int | None = None
    raw: str | None = None

    def __str__(self):
        return self.sql


def fresh(prefix: str = "x") -> str:
    return f"{prefix}_{next(_names)}"


def base(t):
    return t[:-1] if isinstance(t, str) and t.endswith("!") else t


def is_list(t):
    return isinstance(t, tuple) and t[0] == "List"


def is_interval(t):
    return isinstance(t, tuple) and t[0] == "Interval"


def sql_type(t) -> str:
    simple = {
        "Any": "string", "Boolean": "boolean", "Integer": "int", "Long": "bigint", "Decimal": DECIMAL, "String": "string", "Date!": "date", "DateTime!": "timestamp", "Time!": "int",
        "Date": "struct<v:date,p:int>", "DateTime": "struct<v:timestamp,p:int,o:int>", "Time": "struct<v:int,p:int>", "Quantity": f"struct<value:{DECIMAL},unit:string>",
        "Code": "struct<code:string,system:string,version:string,display:string>", "Concept": "struct<codes:array<struct<code:string,system:string,version:string,display:string>>,display:string>",
        "Ratio": f"struct<numerator:struct<value:{DECIMAL},unit:string>,denominator:struct<value:{DECIMAL},unit:string>>",
    }
    if isinstance(t, str):
        if t not in simple:
            raise TypeFault(f"no such type: {t}")
        return simple[t]
    if t[0] == "List":
        return f"array<{sql_type(t[1])}>"
    if t[0] == "Interval":
        return f"struct<low:{sql_type(t[1])},high:{sql_type(t[1])},lc:boolean,hc:boolean>"
    return "struct<" + ",".join(f"`{n}`:{sql_type(x)}" for n, x in t[1]) + ">"


def null(t="Any") -> E:
    return E(f"cast(null as {sql_type(t)})", t)


def text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


#: Length of text from which an operand that is put in several times gets a variable, so that nesting adds to the text and doesn't multiply it.
LONG = 120


def let(value: E, body) -> E:
    """body(variable) with value computed once; short expressions are put in as they are."""
    if len(value.sql) < LONG:
        return body(value)
    v = fresh("v")
    out = body(E(v, value.t, value.p))
    return E(f"transform(array({value}), {v} -> {out})[0]", out.t, out.p)


# --- temporal values -------------------------------------------------------


def v(e: E) -> str:
    """The point of a temporal value."""
    return e.sql if e.t.endswith("!") else f"({e}).v"


def p(e: E) -> str:
    if e.p:
        return str(e.p)
    return str(FULL[base(e.t)]) if e.t.endswith("!") else f"({e}).p"


def temporal(kind: str, point: str, precision: str | int, offset: str = "cast(null as int)") -> E:
    parts = f"'v', {point}, 'p', {precision}" + (f", 'o', {offset}" if kind == "DateTime" else "")
    return E(f"named_struct({parts})", kind, precision if isinstance(precision, int) else None)


def parse_temporal(kind: str, value: str) -> E:
    """A literal such as @2012-01, @2012-01-01T10:00Z or @T10:30."""
    import datetime as dt

    body = value.lstrip("@")
    offset = None
    if kind == "DateTime":
        m = re.search(r"(Z|[+-]\d\d:\d\d)$", body)
        if m:
            offset = 0 if m[1] == "Z" else (int(m[1][1:3]) * 60 + int(m[1][4:6])) * (1 if m[1][0] == "+" else -1)
            body = body[: m.start()]
    day, _, clock = body.partition("T")
    fields = [int(x) for x in day.split("-")] if day else []
    times = [x for x in re.split("[:.]", clock) if x]
    if kind == "Time":
        h = [int(x) for x in times[:3]] + ([int(times[3].ljust(3, "0"))] if len(times) > 3 else [])
        full = h + [0] * (4 - len(h))
        if full[0] > 23 or full[1] > 59 or full[2] > 59:
            raise TypeFault(f"no such time: {value}")
        return temporal("Time", str(((full[0] * 60 + full[1]) * 60 + full[2]) * 1000 + full[3]), 3 + len(h))
    ymd = fields + [1] * (3 - len(fields))
    date = dt.date(*ymd)
    if kind == "Date":
        return E(f"DATE'{date.isoformat()}'", "Date!") if len(fields) == 3 else temporal("Date", f"DATE'{date.isoformat()}'", len(fields))
    h = [int(x) for x in times[:3]] + ([int(times[3].ljust(3, "0"))] if len(times) > 3 else [])
    full = h + [0] * (4 - len(h))
    at = dt.datetime(*ymd, *full[:3], full[3] * 1000)
    if offset:
        at -= dt.timedelta(minutes=offset)
    n = len(fields) + len(h)
    if n == 7 and offset is None:
        return E(f"TIMESTAMP'{at.isoformat(sep=' ', timespec='milliseconds')}Z'", "DateTime!")
    return temporal("DateTime", f"TIMESTAMP'{at.isoformat(sep=' ', timespec='milliseconds')}Z'", n, str(offset) if offset is not None else "cast(null as int)")


def trunc(kind: str, point: str, level: int) -> str:
    """A point cut to a precision."""
    if level >= FULL[kind]:
        return point
    if kind == "Date":
        return f"trunc({point}, '{('YEAR', 'MM')[level - 1]}')"
    if kind == "DateTime":
        return f"date_trunc('{('YEAR', 'MONTH', 'DAY', 'HOUR', 'MINUTE', 'SECOND')[level - 1]}', {point})"
    unit = {4: 3_600_000, 5: 60_000, 6: 1_000}.get(level, 1)
    return f"({point} - {point} % {unit})"


def trunc_dynamic(kind: str, point: str, level: str) -> str:
    low = 4 if kind == "Time" else 1
    whens = " ".join(f"when {k} then {trunc(kind, point, k)}" for k in range(low, FULL[kind]))
    return f"case {level} {whens} else {point} end"


def aligned(a: E, b: E) -> tuple[E, E]:
    t = unify([a.t, b.t])
    return coerce(a, t), coerce(b, t)


def order_temporal(a: E, b: E, precision: str | None) -> str:
    """-1, 0 or 1; null where the precisions leave it open."""
    kind = base(a.t)
    if precision == "week":
        key = lambda e: f"(year({v(e)}) * 10000 + month({v(e)}) * 100 + int(dayofmonth({v(e)}) / 7))"
        return f"sign(cast({key(a)} as bigint) - cast({key(b)} as bigint))"
    want = LEVEL[precision] if precision else None
    pa, pb = p(a), p(b)
    if pa.isdigit() and pb.isdigit():
        least = min(int(pa), int(pb), want or 9)
        ta, tb = trunc(kind, v(a), least), trunc(kind, v(b), least)
        sure = pa == pb or want is not None and least >= want
        return f"case when {ta} < {tb} then -1 when {ta} > {tb} then 1 " + (f"when {ta} = {tb} then 0 end" if sure else "end")
    least = f"least({pa}, {pb}{f', {want}' if want else ''})"
    ta, tb = trunc_dynamic(kind, v(a), least), trunc_dynamic(kind, v(b), least)
    sure = f"{pa} = {pb}" + (f" or {least} >= {want}" if want else "")
    return f"case when {ta} < {tb} then -1 when {ta} > {tb} then 1 when {sure} then 0 end"


#: Unit, dimension, factor to the dimension's base unit. Calendar years and months are 12 months and months.
UNITS = {
    "m": ("length", "1"), "cm": ("length", "0.01"), "mm": ("length", "0.001"), "km": ("length", "1000"), "[in_i]": ("length", "0.0254"), "inch": ("length", "0.0254"), "[ft_i]": ("length", "0.3048"), "foot": ("length", "0.3048"), "[yd_i]": ("length", "0.9144"), "yard": ("length", "0.9144"),
    "g": ("mass", "1"), "mg": ("mass", "0.001"), "kg": ("mass", "1000"), "ug": ("mass", "0.000001"),
    "L": ("volume", "1"), "mL": ("volume", "0.001"), "dL": ("volume", "0.1"),
    "s": ("time", "1"), "second": ("time", "1"), "seconds": ("time", "1"), "ms": ("time", "0.001"), "millisecond": ("time", "0.001"), "milliseconds": ("time", "0.001"), "min": ("time", "60"), "minute": ("time", "60"), "minutes": ("time", "60"), "h": ("time", "3600"), "hour": ("time", "3600"), "hours": ("time", "3600"),
    "d": ("time", "86400"), "day": ("time", "86400"), "days": ("time", "86400"), "wk": ("time", "604800"), "week": ("time", "604800"), "weeks": ("time", "604800"),
    "mo": ("months", "1"), "month": ("months", "1"), "months": ("months", "1"), "a": ("months", "12"), "year": ("months", "12"), "years": ("months", "12"),
}


def _unit_case(unit: str, column: int, other: str) -> str:
    groups: dict[str, list[str]] = {}
    for u, x in UNITS.items():
        groups.setdefault(x[column], []).append(u)
    return f"case {' '.join(f'when {unit} in (' + ', '.join(text(u) for u in us) + f') then {text(x) if column == 0 else x}' for x, us in groups.items())} else {other} end"


def dimension(q: E) -> str:
    return _unit_case(f"({q}).unit", 0, f"coalesce(({q}).unit, '1')")


def canonical(q: E) -> str:
    return f"(({q}).value * cast({_unit_case(f'({q}).unit', 1, '1')} as decimal(18,6)))"


def let_both(a: E, b: E, body) -> E:
    """body(a, b) with both computed once."""
    return let(a, lambda x: let(b, lambda y: body(x, y)))


@dataclass(frozen=True)
class Comparer:
    """Rules of a type in place of the built-in ones, each a function of two operands to SQL; None keeps the built-in rule.

    equal and order take a precision too and give null where an operand is null or it is open; equivalent is
    asked for two values that aren't null; order gives -1, 0 or 1."""

    equal: Callable[[E, E, str | None], str] | None = None
    equivalent: Callable[[E, E], str] | None = None
    order: Callable[[E, E, str | None], str] | None = None


_COMPARERS: ContextVar[dict[str, Comparer]] = ContextVar("comparers", default={})


@contextmanager
def comparers(by_type: dict[str, Comparer]):
    """Expressions compiled within use these rules, also for elements, bounds and fields of the type. Keys: type names, or List, Interval
    and Tuple for all types of the kind. Grouping, sorting, Min and Max keep the order of the columns."""
    token = _COMPARERS.set(_COMPARERS.get() | by_type)
    try:
        yield
    finally:
        _COMPARERS.reset(token)


def _own(t) -> Comparer:
    return _COMPARERS.get().get(base(t) if isinstance(t, str) else t[0], _BUILT_IN)


_BUILT_IN = Comparer()


def order(a: E, b: E, precision: str | None = None) -> str:
    """-1, 0, 1, or null where either is null or it is open."""
    return let_both(*aligned(a, b), lambda x, y: E(_order(x, y, precision), "Integer")).sql


def _order(a: E, b: E, precision: str | None) -> str:
    if own := _own(a.t).order:
        return own(a, b, precision)
    if base(a.t) in TEMPORAL:
        return order_temporal(a, b, precision)
    if a.t == "Quantity":
        same = f"(coalesce(({a}).unit, '1') = coalesce(({b}).unit, '1') or ({a}).unit = '1' or ({b}).unit = '1')"
        return f"case when {same} then sign(({a}).value - ({b}).value) when {dimension(a)} = {dimension(b)} then sign({canonical(a)} - {canonical(b)}) end"
    if a.t in (*NUMBERS, "String", "Boolean"):
        return f"case when {a} < {b} then -1 when {a} > {b} then 1 when {a} = {b} then 0 end"
    raise TypeFault(f"{a.t} has no order")


_NUMBER = re.compile(r"cast\((-?[\d.]+) as decimal\(28,8\)\)")


def on_raw(a: E, b: E, op: str) -> str:
    """What a comparison with a number implies for the column that the other side is cast from: a wider bound, for scans to prune by."""
    if b.raw and not a.raw:
        return on_raw(b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op))
    number = _NUMBER.fullmatch(b.sql)
    if not a.raw or not number or op not in ("<", "<=", ">", ">=", "="):
        return ""
    value = float(number[1])
    slack = max(1e-6, abs(value) * 1e-12)
    return (f" and {a.raw} <= {value + slack!r}D" if op in ("<", "<=", "=") else "") + (f" and {a.raw} >= {value - slack!r}D" if op in (">", ">=", "=") else "")


def compare(a: E, b: E, op: str, precision: str | None = None) -> E:
    """a op b in three-valued logic; a plain predicate where the types allow."""
    a, b = aligned(a, b)
    if op != "=" and _own(a.t).order:
        return E(f"({order(a, b, precision)} {op} 0)", "Boolean")
    if a.t in (*NUMBERS, "String", "Boolean"):
        return E(f"({a} {op} {b}{on_raw(a, b, op)})", "Boolean")
    if base(a.t) in TEMPORAL and precision != "week":
        pa, pb = p(a), p(b)
        if pa == pb and pa.isdigit():
            level = min(int(pa), LEVEL[precision] if precision else 9)
            return E(f"({trunc(base(a.t), v(a), level)} {op} {trunc(base(b.t), v(b), level)})", "Boolean")
    return E(f"({order(a, b, precision)} {op} 0)", "Boolean")


def equal(a: E, b: E, precision: str | None = None) -> E:
    """CQL equality: null if either side is null or it is open; by field for tuples."""
    a, b = aligned(a, b)
    if own := _own(a.t).equal:
        return let_both(a, b, lambda x, y: E(f"({own(x, y, precision)})", "Boolean"))
    if isinstance(a.t, str) and (base(a.t) in TEMPORAL or a.t in (*NUMBERS, "String", "Boolean", "Quantity")):
        return compare(a, b, "=", precision)
    return let_both(a, b, lambda x, y: _equal(x, y, precision))


def _equal(a: E, b: E, precision: str | None) -> E:
    t = a.t
    if t == "Any":
        return null("Boolean")
    if t in ("Code",):
        parts = [f"(lower(({a}).{f}) = lower(({b}).{f}) or (({a}).{f} is null and ({b}).{f} is null))" for f in ("code", "system", "version", "display")]
        return E(f"case when {a} is null or {b} is null then null else {' and '.join(parts)} end", "Boolean")
    if t in ("Concept", "Ratio"):
        return E(f"({a} = {b})", "Boolean")
    if is_list(t):
        x, y = fresh(), fresh()
        same = equal(E(x, t[1]), E(y, t[1]))
        return E(f"case when {a} is null or {b} is null then null when size({a}) <> size({b}) then false else forall(zip_with({a}, {b}, ({x}, {y}) -> case when {x} is null and {y} is null then true when {x} is null or {y} is null then false else {same} end), z -> z) end", "Boolean")
    if is_interval(t):
        return E(f"({equal(part(a, 'low'), part(b, 'low'), precision)} and {equal(part(a, 'high'), part(b, 'high'), precision)})", "Boolean")
    fields = [f"case when {part(a, n)} is null and {part(b, n)} is null then true else {equal(part(a, n), part(b, n))} end" for n, _ in t[1]]
    return E(f"case when {a} is null or {b} is null then null else {' and '.join(fields) or 'true'} end", "Boolean")


def equivalent(a: E, b: E) -> E:
    """Never null: two nulls are equivalent; strings without regard to case and kind of space; concepts by a common code."""
    return let_both(a, b, _equivalent)


def _equivalent(a: E, b: E) -> E:
    if a.t == b.t and (own := _own(a.t).equivalent):
        return E(f"case when {a} is null or {b} is null then {a} is null and {b} is null else {own(a, b)} end", "Boolean")
    if {a.t, b.t} in ({"Code", "Concept"}, {"Concept"}):
        a, b = coerce(a, "Concept"), coerce(b, "Concept")
        key = lambda e: f"transform(({e}).codes, c -> concat_ws('|', lower(c.code), lower(c.system)))"
        return E(f"case when {a} is null or {b} is null then {a} is null and {b} is null else arrays_overlap({key(a)}, {key(b)}) end", "Boolean")
    a, b = aligned(a, b)
    t = a.t
    if t == "Code":
        same = f"(lower(({a}).code) <=> lower(({b}).code) and lower(({a}).system) <=> lower(({b}).system))"
    elif t == "String":
        fold = lambda e: f"lower(regexp_replace({e}, '\\\\s+', ' '))"
        same = f"({fold(a)} = {fold(b)})"
    elif t == "Decimal":
        same = f"({a} = {b})"
    elif is_list(t):
        x, y = fresh(), fresh()
        same = f"(size({a}) = size({b}) and forall(zip_with({a}, {b}, ({x}, {y}) -> {equivalent(E(x, t[1]), E(y, t[1]))}), z -> z))"
    elif isinstance(t, tuple) and t[0] == "Tuple":
        same = " and ".join(str(equivalent(part(a, n), part(b, n))) for n, _ in t[1]) or "true"
    elif is_interval(t):
        same = f"({equivalent(part(a, 'low'), part(b, 'low'))} and {equivalent(part(a, 'high'), part(b, 'high'))})"
    else:
        same = f"coalesce({equal(a, b)}, false)"
    return E(f"case when {a} is null or {b} is null then {a} is null and {b} is null else {same} end", "Boolean")


def part(e: E, name: str) -> E:
    """A field of a structured value."""
    t = e.t
    if is_interval(t):
        kind = {"low": t[1], "high": t[1], "lc": "Boolean", "hc": "Boolean", "lowClosed": "Boolean", "highClosed": "Boolean"}.get(name)
        name = {"lowClosed": "lc", "highClosed": "hc"}.get(name, name)
    elif isinstance(t, tuple) and t[0] == "Tuple":
        kind = dict(t[1]).get(name)
    elif is_list(t):
        x = fresh()
        inner = part(E(x, t[1]), name)
        return E(f"filter(transform({e}, {x} -> {inner}), {x} -> {x} is not null)", ("List", inner.t))
    else:
        kind = {"Quantity": {"value": "Decimal", "unit": "String"}, "Code": dict.fromkeys(("code", "system", "version", "display"), "String"), "Concept": {"codes": ("List", "Code"), "display": "String"}, "Ratio": {"numerator": "Quantity", "denominator": "Quantity"}}.get(t, {}).get(name)
    if kind is None:
        raise TypeFault(f"{t} has no {name}")
    return E(f"({e}).`{name}`", kind)


# --- conversions of type ---------------------------------------------------

_RANK = {"Integer": 0, "Long": 1, "Decimal": 2, "Quantity": 3}


def unify(types):
    """The least type that all can be taken as."""
    out = "Any"
    for t in types:
        out = _join(out, t)
    return out


def _join(a, b):
    if a == b or b == "Any":
        return a
    if a == "Any":
        return b
    if isinstance(a, str) and isinstance(b, str):
        if a in _RANK and b in _RANK:
            return a if _RANK[a] >= _RANK[b] else b
        if base(a) == base(b):
            return base(a)
        if {base(a), base(b)} == {"Date", "DateTime"}:
            return "DateTime" if {a, b} != {"Date!", "DateTime!"} else "DateTime"
        if {a, b} == {"Code", "Concept"}:
            return "Concept"
    elif isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0]:
        if a[0] != "Tuple":
            return a[0], _join(a[1], b[1])
        if {n for n, _ in a[1]} == {n for n, _ in b[1]}:
            other = dict(b[1])
            return "Tuple", tuple((n, _join(t, other[n])) for n, t in a[1])
    raise TypeFault(f"no common type of {a} and {b}")


def coerce(e: E, t) -> E:
    """e as type t, by the implicit conversions."""
    if e.t == t:
        return e
    if e.t == "Any":
        return null(t)
    if isinstance(t, str) and isinstance(e.t, str):
        if e.t in NUMBERS and t in NUMBERS and _RANK[e.t] < _RANK[t]:
            return E(f"cast({e} as {sql_type(t)})", t)
        if len(e.sql) >= LONG and (t == "Concept" or e.t in NUMBERS and t == "Quantity"):
            return let(e, lambda x: coerce(x, t))
        if e.t in NUMBERS and t == "Quantity":
            return E(f"case when {e} is not null then named_struct('value', cast({e} as {DECIMAL}), 'unit', '1') end", t)
        if e.t == "Code" and t == "Concept":
            return E(f"case when {e} is not null then named_struct('codes', array({e}), 'display', ({e}).display) end", t)
        if base(e.t) in TEMPORAL and base(t) in TEMPORAL:
            kind, want = base(e.t), base(t)
            if kind == want and not t.endswith("!"):
                return let(e, lambda x: E(f"case when {x} is not null then {temporal(want, v(x), p(x))} end", t, e.p or FULL[kind]))
            if kind == "Date" and want == "DateTime":
                if t.endswith("!"):
                    return E(f"cast({v(e)} as timestamp)", t)
                return let(e, lambda x: E(f"case when {x} is not null then {temporal('DateTime', f'cast({v(x)} as timestamp)', p(x))} end", t, int(p(e)) if p(e).isdigit() else None))
            if kind == want:
                return E(v(e), t)
    elif isinstance(t, tuple) and isinstance(e.t, tuple) and t[0] == e.t[0]:
        if t[0] == "List":
            x = fresh()
            return E(f"transform({e}, {x} -> {coerce(E(x, e.t[1]), t[1])})", t)
        if len(e.sql) >= LONG:
            return let(e, lambda x: coerce(x, t))
        if t[0] == "Interval":
            return E(f"case when {e} is not null then named_struct('low', {coerce(part(e, 'low'), t[1])}, 'high', {coerce(part(e, 'high'), t[1])}, 'lc', ({e}).lc, 'hc', ({e}).hc) end", t)
        fields = ", ".join(f"{text(n)}, {coerce(part(e, n), x)}" for n, x in t[1])
        return E(f"case when {e} is not null then named_struct({fields}) end", t)
    raise TypeFault(f"{e.t} is no {t}")
