"""The operator table: name to a function of typed expressions (and a precision)."""

from __future__ import annotations

from medspan.functions import core as c
from medspan.functions.core import DECIMAL, FULL, LEVEL, MICROS, NUMBERS, TEMPORAL, E, TypeFault, base, coerce, compare, equal, equivalent, fresh, is_interval, is_list, null, order, p, part, sql_type, temporal, text, unify, v

OPS: dict = {}
INT_MAX, LONG_MAX, DEC_MAX = "2147483647", "9223372036854775807L", "99999999999999999999.99999999"


def op(*names):
    def add(f):
        for n in names:
            OPS[n] = f
        return f

    return add


def call(name: str, args: list[E], precision: str | None = None, context=None) -> E:
    """An operator by name."""
    f = OPS.get(name)
    if f is None:
        raise TypeFault(f"no operator {name}")
    try:
        return _bound(list(args), [], lambda xs: f(xs, precision) if name not in NEEDS_CONTEXT else f(xs, precision, context))
    except (ValueError, IndexError) as fault:
        raise TypeFault(f"{name} is not for {[a.t for a in args]}: {fault}") from fault


def _bound(left: list[E], done: list[E], body) -> E:
    """body(operands) with long operands as variables, but for rows, lists of codes and intervals whose bounds stand plainly."""
    if not left:
        return body(done)
    a, *rest = left
    plain = is_interval(a.t) and str(a.t[1]).endswith("!") and a.sql.startswith("named_struct")
    if len(a.sql) < 2 * c.LONG or plain or a.t in ("Any", ("List", "Code")) or isinstance(a.t, tuple) and a.t[0] == "Row":
        return _bound(rest, [*done, a], body)
    return c.let(a, lambda x: _bound(rest, [*done, x], body))


NEEDS_CONTEXT = {"Now", "Today", "TimeOfDay", "Age", "AgeAt", "InValueSet", "AnyInValueSet", "ExpandValueSet"}


def when(e: E, body: str, t) -> E:
    """body where e is not null."""
    return E(f"case when {e} is not null then {body} end", t)


def boolean(sql: str) -> E:
    return E(f"({sql})", "Boolean")


def as_(args, *kinds):
    return [coerce(a, k) for a, k in zip(args, kinds, strict=False)]


def number(args):
    t = unify([a.t for a in args])
    if t == "Any":
        t = "Integer"
    if t not in (*NUMBERS, "Quantity"):
        raise TypeFault(f"{t} is no number")
    return [coerce(a, t) for a in args], t


def quantity(value: str, unit: str) -> E:
    return E(f"named_struct('value', cast({value} as {DECIMAL}), 'unit', {unit})", "Quantity")


# --- arithmetic ------------------------------------------------------------


@op("Abs")
def abs_(args, _):
    (a,), t = number(args)
    if t == "Quantity":
        return when(a, str(quantity(f"abs(({a}).value)", f"({a}).unit")), t)
    return E(f"case when {a} < 0 then try_subtract(cast(0 as {sql_type(t)}), {a}) else {a} end", t)


def _arith(args, f, t):
    a, b = args
    return E(f"try_cast({f}({a}, {b}) as {sql_type(t)})", t)


def _same_unit(a: E, b: E) -> str:
    unit = lambda q: f"regexp_replace(coalesce(({q}).unit, '1'), '^(year|month|week|day|hour|minute|second|millisecond)s$', '$1')"
    return f"{unit(a)} = {unit(b)}"


def _plus(args, precision, f, sign):
    a, b = args
    if isinstance(a.t, str) and base(a.t) in TEMPORAL:
        return add_temporal(a, coerce(b, "Quantity"), sign)
    if a.t == "String" or b.t == "String":
        if f == "try_add":
            return OPS["Concatenate"](args, None)
    (a, b), t = number(args)
    if t == "Quantity":
        return E(f"case when {_same_unit(a, b)} then {quantity(f'{f}(({a}).value, ({b}).value)', f'({a}).unit')} end", t)
    return _arith([a, b], f, t)


@op("Add")
def add(args, precision):
    return _plus(args, precision, "try_add", 1)


@op("Subtract")
def subtract(args, precision):
    return _plus(args, precision, "try_subtract", -1)


@op("Multiply")
def multiply(args, _):
    (a, b), t = number(args)
    if t == "Quantity":
        one = lambda q: f"coalesce(({q}).unit, '1') = '1'"
        return E(f"case when {one(a)} or {one(b)} then {quantity(f'try_multiply(({a}).value, ({b}).value)', f'case when {one(a)} then ({b}).unit else ({a}).unit end')} end", t)
    if t == "Decimal":
        # operands that fit are taken narrower, so that the product keeps all eight places
        small = f"abs({a}) < 10000000000 and abs({b}) < 10000000000"
        return E(f"case when {small} then cast(cast({a} as decimal(18,8)) * cast({b} as decimal(18,8)) as {DECIMAL}) else try_cast(try_multiply({a}, {b}) as {DECIMAL}) end", t)
    return _arith([a, b], "try_multiply", t)


@op("Divide")
def divide(args, _):
    (a, b), t = number(args)
    if t == "Quantity":
        unit = f"case when coalesce(({b}).unit, '1') = '1' then ({a}).unit when {_same_unit(a, b)} then '1' end"
        return E(f"case when {unit} is not null and ({b}).value <> 0 then {quantity(f'try_divide(({a}).value, ({b}).value)', unit)} end", t)
    a, b = as_([a, b], "Decimal", "Decimal")
    return E(f"try_cast(try_divide({a}, {b}) as {DECIMAL})", "Decimal")


@op("TruncatedDivide")
def truncated_divide(args, _):
    (a, b), t = number(args)
    if t == "Quantity":
        return E(f"case when ({b}).value <> 0 and {_same_unit(a, b)} then {quantity(f'cast(({a}).value / ({b}).value as decimal(28,0))', text('1'))} end", t)
    if t == "Decimal":
        q = f"try_divide({a}, {b})"
        return E(f"try_cast(case when {q} < 0 then ceil({q}) else floor({q}) end as {DECIMAL})", t)
    return E(f"try_cast(case when {b} <> 0 then {a} div {b} end as {sql_type(t)})", t)


@op("Modulo")
def modulo(args, _):
    (a, b), t = number(args)
    if t == "Quantity":
        return E(f"case when {_same_unit(a, b)} then {quantity(f'try_mod(({a}).value, ({b}).value)', f'({a}).unit')} end", t)
    return E(f"cast(try_mod({a}, {b}) as {sql_type(t)})", t)


@op("Negate")
def negate(args, _):
    (a,), t = number(args)
    if t == "Quantity":
        return when(a, str(quantity(f"- ({a}).value", f"({a}).unit")), t)
    return E(f"try_subtract(cast(0 as {sql_type(t)}), {a})" if t != "Decimal" else f"cast(- {a} as {DECIMAL})", t)


def _double(sql: str, scale: str = DECIMAL) -> E:
    x = fresh()
    return E(f"transform(array({sql}), {x} -> case when not isnan({x}) and abs({x}) < 1e20 then try_cast({x} as {scale}) end)[0]", "Decimal")


@op("Power")
def power(args, _):
    a, b = as_(args, "Decimal", "Decimal")
    return _double(f"pow(cast({a} as double), cast({b} as double))")


@op("Exp")
def exp(args, _):
    return _double(f"exp(cast({coerce(args[0], 'Decimal')} as double))")


@op("Ln")
def ln(args, _):
    a = coerce(args[0], "Decimal")
    return _double(f"case when {a} > 0 then ln(cast({a} as double)) end")


@op("Log")
def log(args, _):
    a, b = as_(args, "Decimal", "Decimal")
    return _double(f"case when {a} > 0 and {b} > 0 and {b} <> 1 then log(cast({b} as double), cast({a} as double)) end")


@op("Round")
def round_(args, _):
    a = coerce(args[0], "Decimal")
    if len(args) < 2:
        return E(f"cast(round({a}, 0) as {DECIMAL})", "Decimal")
    n = coerce(args[1], "Integer")
    if n.sql.isdigit():
        return E(f"cast(round({a}, {n}) as {DECIMAL})", "Decimal")
    scale = f"cast(pow(10, coalesce({n}, 0)) as decimal(10,0))"
    return E(f"cast(round({a} * {scale}, 0) / {scale} as {DECIMAL})", "Decimal")


def _to_int(f):
    def g(args, _):
        (a,), t = number(args)
        return a if t in ("Integer", "Long") else E(f"try_cast({f.format(a)} as int)", "Integer")

    return g


OPS["Truncate"] = _to_int("case when {0} < 0 then ceil({0}) else floor({0}) end")
OPS["Ceiling"] = _to_int("ceil({})")
OPS["Floor"] = _to_int("floor({})")


def step(a: E, sign: int) -> E:
    """Successor or predecessor; null past the ends."""
    t = a.t
    name = "try_add" if sign > 0 else "try_subtract"
    if t in ("Integer", "Long"):
        return E(f"{name}({a}, cast(1 as {sql_type(t)}))", t)
    if t == "Decimal":
        return E(f"cast({name}({a}, cast(0.00000001 as {DECIMAL})) as {DECIMAL})", t)
    if a.t == "Any":
        return null("Integer")
    if len(a.sql) >= c.LONG:
        return c.let(a, lambda x: step(x, sign))
    if t == "Quantity":
        return when(a, str(quantity(str(step(E(f"({a}).value", "Decimal"), sign)), f"({a}).unit")), t)
    kind = base(t)
    if kind == "Time":
        unit = {"4": "3600000", "5": "60000", "6": "1000", "7": "1"}.get(p(a)) or f"case {p(a)} when 4 then 3600000 when 5 then 60000 when 6 then 1000 else 1 end"
        moved = f"{v(a)} {'+' if sign > 0 else '-'} {unit}"
        point = f"case when {moved} between 0 and 86399999 then {moved} end"
    elif kind == "Date":
        point = _by_level(a, {1: f"add_months({v(a)}, {12 * sign})", 2: f"add_months({v(a)}, {sign})", 3: f"date_add({v(a)}, {sign})"})
        point = f"case when {v(a)} {'<' if sign > 0 else '>'} DATE'{'9999-12-31' if sign > 0 else '0001-01-01'}' then {point} end"
    else:
        micros = {3: MICROS["day"], 4: MICROS["hour"], 5: MICROS["minute"], 6: MICROS["second"], 7: MICROS["millisecond"]}
        point = _by_level(a, {1: f"{v(a)} + interval '{sign}' year", 2: f"{v(a)} + interval '{sign}' month"} | {k: f"timestamp_micros(unix_micros({v(a)}) + {m * sign}L)" for k, m in micros.items()})
        point = f"case when {v(a)} {'<' if sign > 0 else '>'} TIMESTAMP'{'9999-12-31 23:59:59.999' if sign > 0 else '0001-01-01 00:00:00'}' then {point} end"
    return rebuilt(a, point)


def _by_level(a: E, choices: dict[int, str]) -> str:
    level = p(a)
    if level.isdigit():
        return choices[int(level)]
    return f"case {level} {' '.join(f'when {k} then {x}' for k, x in choices.items())} end"


def rebuilt(a: E, point: str) -> E:
    """A temporal value of a's form and precision at another point."""
    if a.t.endswith("!"):
        return E(f"({point})", a.t)
    out = temporal(a.t, point, p(a), f"({a}).o" if a.t == "DateTime" else "")
    x = fresh()
    return E(f"transform(array({out}), {x} -> case when {x}.v is not null then {x} end)[0]", a.t, a.p)


@op("Successor")
def successor(args, _):
    return step(args[0], 1)


@op("Predecessor")
def predecessor(args, _):
    return step(args[0], -1)


def extreme(t, high: bool) -> E:
    kind = base(t) if isinstance(t, str) else t
    if kind == "Quantity":
        return quantity(("" if high else "-") + DEC_MAX, "'1'")
    got = {
        "Integer": INT_MAX if high else "cast(-2147483648 as int)", "Long": LONG_MAX if high else "(-9223372036854775807L - 1L)", "Decimal": f"cast({'' if high else '-'}{DEC_MAX} as {DECIMAL})",
        "Date": f"DATE'{'9999-12-31' if high else '0001-01-01'}'", "DateTime": f"TIMESTAMP'{'9999-12-31 23:59:59.999' if high else '0001-01-01 00:00:00'}'", "Time": "86399999" if high else "0",
    }.get(kind)
    if got is None:
        raise TypeFault(f"{t} has no extremes")
    if kind in TEMPORAL:
        return E(got, kind + "!") if t.endswith("!") else temporal(kind, got, FULL[kind])
    return E(got, kind)


OPS["MinValue"] = lambda args, _: extreme(args[0].sql, False)
OPS["MaxValue"] = lambda args, _: extreme(args[0].sql, True)

_DIGITS = {1: 4, 2: 6, 3: 8, 4: 10, 5: 12, 6: 14, 7: 17}


@op("Precision")
def precision_(args, _):
    a = args[0]
    if base(a.t) in TEMPORAL:
        shift = 8 if base(a.t) == "Time" else 0
        return E(f"case {p(a)} {' '.join(f'when {k} then {d - shift}' for k, d in _DIGITS.items() if d > shift)} end", "Integer")
    a = coerce(a, "Decimal")
    return E(f"length(regexp_replace(split_part(cast({a} as string), '.', 2), '0+$', ''))", "Integer")


def _boundary(args, high: bool):
    a = args[0]
    if base(a.t) not in TEMPORAL:
        a = coerce(a, "Decimal")
        n = coerce(args[1], "Integer") if len(args) > 1 else E("8", "Integer")
        digits = f"length(regexp_replace(split_part(cast({a} as string), '.', 2), '0+$', ''))"
        add = f"cast({'' if high else '-'}(pow(10, -{digits}) - pow(10, -{n})) as {DECIMAL})" if high else "0"
        return E(f"case when {n} between 0 and 8 then cast(case when {digits} < {n} then {a} + {add} else {a} end as {DECIMAL}) end", "Decimal")
    kind = base(a.t)
    shift = 8 if kind == "Time" else 0
    want = coerce(args[1], "Integer") if len(args) > 1 else E({"Date": "8", "DateTime": "17", "Time": "9"}[kind], "Integer")
    to = f"case {want} {' '.join(f'when {d - shift} then {k}' for k, d in _DIGITS.items() if d > shift and k <= FULL[kind])} end"
    if not high:
        return E(f"transform(array({to}), q -> case when q is not null and {v(a)} is not null then {temporal(kind, v(a), 'q')} end)[0]", kind)
    low = 4 if kind == "Time" else 1
    ends = {}
    for k in range(low, FULL[kind]):
        if kind == "Date":
            ends[k] = f"date_sub(add_months(trunc({v(a)}, '{('YEAR', 'MM')[k - 1]}'), {(12, 1)[k - 1]}), 1)"
        elif kind == "DateTime":
            start = c.trunc(kind, v(a), k)
            ends[k] = f"({start} + interval '1' {('year', 'month', 'day', 'hour', 'minute', 'second')[k - 1]} - interval '0.001' second)"
        else:
            ends[k] = f"({c.trunc(kind, v(a), k)} + {({4: 3_600_000, 5: 60_000, 6: 1_000})[k] - 1})"
    point = _by_level(a, ends | {FULL[kind]: v(a)})
    return E(f"transform(array({to}), q -> case when q is not null and {v(a)} is not null then {temporal(kind, c.trunc_dynamic(kind, point, 'q'), 'q')} end)[0]", kind)


OPS["LowBoundary"] = lambda args, _: _boundary(args, False)
OPS["HighBoundary"] = lambda args, _: _boundary(args, True)


# --- logic and nulls -------------------------------------------------------


def _logic(f):
    return lambda args, _: boolean(f.format(*as_(args, "Boolean", "Boolean")))


OPS["And"] = _logic("{0} and {1}")
OPS["Or"] = _logic("{0} or {1}")
OPS["Xor"] = _logic("case when {0} is not null and {1} is not null then {0} <> {1} end")
OPS["Implies"] = _logic("not {0} or {1}")
OPS["Not"] = _logic("not {0}")
OPS["IsNull"] = lambda args, _: boolean(f"{args[0]} is null")
OPS["IsTrue"] = _logic("{0} <=> true")
OPS["IsFalse"] = _logic("{0} <=> false")


@op("Coalesce", "CoalesceValueTypes")
def coalesce(args, _):
    if len(args) == 1 and is_list(args[0].t):
        x = fresh()
        return E(f"get(filter({args[0]}, {x} -> {x} is not null), 0)", args[0].t[1])
    t = unify([a.t for a in args])
    return E(f"coalesce({', '.join(str(coerce(a, t)) for a in args)})", t)


# --- comparison ------------------------------------------------------------

for _name, _op in (("Greater", ">"), ("GreaterOrEqual", ">="), ("Less", "<"), ("LessOrEqual", "<=")):
    OPS[_name] = lambda args, _, o=_op: compare(*args, o)
OPS["Equal"] = OPS["ListEqual"] = OPS["EnumEqualsString"] = lambda args, _: equal(*args)
OPS["NotEqual"] = OPS["ListNotEqual"] = lambda args, _: boolean(f"not {equal(*args)}")
OPS["Equivalent"] = lambda args, _: equivalent(*args)
OPS["NotEquivalent"] = OPS["ListNotEquivalent"] = lambda args, _: boolean(f"not {equivalent(*args)}")


@op("Between")
def between(args, precision):
    x, lo, hi = args
    if is_interval(x.t):
        return boolean(f"{compare(start(x), lo, '>=')} and {compare(end(x), hi, '<=')}")
    return boolean(f"{compare(x, lo, '>=', precision)} and {compare(x, hi, '<=', precision)}")


@op("ProperBetween")
def proper_between(args, precision):
    return boolean(f"{compare(args[0], args[1], '>')} and {compare(args[0], args[2], '<')}")


# --- strings ---------------------------------------------------------------


def strings(args, *kinds):
    return as_(args, *(kinds or ("String",) * len(args)))


OPS["Concatenate"] = lambda args, _: E(f"concat({', '.join(map(str, strings(args)))})", "String")
OPS["ConcatenateLoose"] = lambda args, _: E("concat(" + ", ".join(f"coalesce({a}, '')" for a in strings(args)) + ")", "String")
OPS["StartsWith"] = lambda args, _: boolean("startswith({}, {})".format(*strings(args)))
OPS["EndsWith"] = lambda args, _: boolean("endswith({}, {})".format(*strings(args)))
OPS["PositionOf"] = lambda args, _: E("(instr({1}, {0}) - 1)".format(*strings(args)), "Integer")
OPS["Lower"] = lambda args, _: E(f"lower({strings(args)[0]})", "String")
OPS["Upper"] = lambda args, _: E(f"upper({strings(args)[0]})", "String")
OPS["ReplaceMatches"] = lambda args, _: E("regexp_replace({}, {}, {})".format(*strings(args)), "String")
OPS["Matches"] = lambda args, _: boolean("rlike({0}, concat('^(?:', {1}, ')$'))".format(*strings(args)))
OPS["SplitOnMatches"] = lambda args, _: E("split({}, {}, -1)".format(*strings(args)), ("List", "String"))


@op("LastPositionOf")
def last_position(args, _):
    a, b = strings(args)
    return E(f"case when instr({b}, {a}) = 0 then -1 else length({b}) - instr(reverse({b}), reverse({a})) - length({a}) + 1 end", "Integer")


@op("Split")
def split(args, _):
    a, b = strings(args)
    return E(f"case when {a} is null then null when {b} is null then array({a}) else split({a}, concat('\\\\Q', {b}, '\\\\E'), -1) end", ("List", "String"))


@op("Combine")
def combine(args, _):
    a = coerce(args[0], ("List", "String"))
    sep = f"coalesce({coerce(args[1], 'String')}, '')" if len(args) > 1 else "''"
    return E(f"array_join(transform({a}, x -> coalesce(x, '')), {sep})", "String")


@op("Substring")
def substring(args, _):
    a, i = coerce(args[0], "String"), coerce(args[1], "Integer")
    n = coerce(args[2], "Integer") if len(args) > 2 else E(f"length({a})", "Integer")
    return E(f"case when {i} >= 0 and {i} < length({a}) and {n} >= 0 then substring({a}, {i} + 1, {n}) end", "String")


@op("Indexer")
def indexer(args, _):
    a, i = args[0], coerce(args[1], "Integer")
    if is_list(a.t):
        return E(f"get({a}, {i})", a.t[1])
    a = coerce(a, "String")
    return E(f"case when {i} >= 0 and {i} < length({a}) then substring({a}, {i} + 1, 1) end", "String")


@op("Length")
def length(args, _):
    a = args[0]
    return E(f"case when {a} is null then 0 else size({a}) end" if is_list(a.t) else f"length({coerce(a, 'String')})", "Integer")


# --- dates and times -------------------------------------------------------


@op("Date")
def date(args, _):
    y, m, d = [coerce(a, "Integer") for a in args] + [null("Integer")] * (3 - len(args))
    point = f"try_cast(concat(lpad({y}, 4, '0'), '-', lpad(coalesce({m}, 1), 2, '0'), '-', lpad(coalesce({d}, 1), 2, '0')) as date)"
    level = min(len(args), 3) if all(a.sql.isdigit() for a in args) else f"case when {m} is null then 1 when {d} is null then 2 else 3 end"
    out = temporal("Date", point, level)
    return E(f"case when {y} is not null then {out} end", "Date", out.p)


@op("DateTime")
def date_time(args, _):
    zone = coerce(args[7], "Decimal") if len(args) > 7 else None
    parts = [coerce(a, "Integer") for a in args[:7]]
    parts += [null("Integer")] * (7 - len(parts))
    y, mo, d, h, mi, s, ms = (f"coalesce({x}, {low})" for x, low in zip(parts, (1, 1, 1, 0, 0, 0, 0), strict=True))
    point = f"try_make_timestamp({y}, {mo}, {d}, {h}, {mi}, {s} + {ms} / 1000.0)"
    offset = "cast(null as int)"
    if zone:
        offset = f"cast({zone} * 60 as int)"
        point = f"timestamp_micros(unix_micros({point}) - cast({zone} * 3600000000 as bigint))"
    known = [a.sql.isdigit() for a in args[:7]]
    level = len(known) if all(known) else "case " + " ".join(f"when {parts[k]} is null then {k}" for k in range(1, 7)) + " else 7 end"
    out = temporal("DateTime", point, level, offset)
    return E(f"case when {parts[0]} is not null then {out} end", "DateTime", out.p)


@op("Time")
def time(args, _):
    parts = [coerce(a, "Integer") for a in args] + [null("Integer")] * (4 - len(args))
    h, mi, s, ms = (f"coalesce({x}, 0)" for x in parts)
    level = 3 + len(args) if all(a.sql.isdigit() for a in args) else "case " + " ".join(f"when {parts[k]} is null then {k + 3}" for k in range(1, 4)) + " else 7 end"
    out = temporal("Time", f"((({h} * 60 + {mi}) * 60 + {s}) * 1000 + {ms})", level)
    return E(f"case when {parts[0]} is not null then {out} end", "Time", out.p)


@op("DateTimeComponentFrom")
def component(args, precision):
    a = args[0]
    kind = base(a.t)
    if kind == "Time":
        f = {"hour": "({0} div 3600000)", "minute": "({0} div 60000 % 60)", "second": "({0} div 1000 % 60)", "millisecond": "({0} % 1000)"}[precision]
    else:
        f = {"year": "year({0})", "month": "month({0})", "day": "dayofmonth({0})", "week": "weekofyear({0})", "hour": "hour({0})", "minute": "minute({0})", "second": "second({0})", "millisecond": "(unix_millis({0}) % 1000)"}[precision]
    return E(f"cast(case when {p(a)} >= {LEVEL[precision]} then {f.format(v(a))} end as int)", "Integer")


@op("TimezoneOffsetFrom")
def offset(args, _):
    a = args[0]
    return E(f"cast(({a}).o / 60 as {DECIMAL})" if not a.t.endswith("!") else f"cast(0 as {DECIMAL})", "Decimal")


@op("DateFrom")
def date_from(args, _):
    a = args[0]
    if base(a.t) == "Date":
        return a
    if a.t.endswith("!"):
        return E(f"cast({a} as date)", "Date!")
    return when(a, str(temporal("Date", f"cast({v(a)} as date)", f"least({p(a)}, 3)")), "Date")


@op("TimeComponent", "TimeFrom")
def time_from(args, _):
    a = args[0]
    ms = f"cast((unix_millis({v(a)}) % 86400000 + 86400000) % 86400000 as int)"
    if a.t.endswith("!"):
        return E(ms, "Time!")
    return E(f"case when {p(a)} > 3 then {temporal('Time', ms, p(a))} end", "Time")


def _least(a, b, level: int) -> str:
    pa, pb = p(a), p(b)
    return "true" if pa.isdigit() and pb.isdigit() and min(int(pa), int(pb)) >= level else f"least({pa}, {pb}) >= {level}"


def _micros(kind, e):
    return f"({v(e)} * 1000L)" if kind == "Time" else f"unix_micros(cast({v(e)} as timestamp))"


@op("DifferenceBetween")
def difference(args, precision):
    return c.let_both(*c.aligned(*args), lambda a, b: _difference(a, b, precision))


def _difference(a, b, precision):
    kind = base(a.t)
    if kind != "Time" and precision in ("year", "month"):
        f = f"year({v(b)}) - year({v(a)})" if precision == "year" else f"(year({v(b)}) - year({v(a)})) * 12 + month({v(b)}) - month({v(a)})"
    elif precision == "week":
        f = f"cast(floor(datediff({v(b)}, DATE'1970-01-04') / 7) - floor(datediff({v(a)}, DATE'1970-01-04') / 7) as int)"
    elif precision == "day":
        f = f"datediff({v(b)}, {v(a)})"
    else:
        f = f"cast(floor({_micros(kind, b)} / {MICROS[precision]}) - floor({_micros(kind, a)} / {MICROS[precision]}) as int)"
    return E(f"case when {_least(a, b, LEVEL[precision])} then {f} end", "Integer")


@op("DurationBetween")
def duration(args, precision):
    return c.let_both(*c.aligned(*args), lambda a, b: _duration(a, b, precision))


def _duration(a, b, precision):
    kind = base(a.t)
    if kind != "Time" and precision == "year":
        key = lambda e: f"(month({v(e)}) * 100 + dayofmonth({v(e)}))"
        diff = f"year({v(b)}) - year({v(a)})"
        f = f"case when {diff} > 0 and {key(b)} < {key(a)} then {diff} - 1 when {diff} < 0 and {key(a)} < {key(b)} then {diff} + 1 else {diff} end"
    elif kind != "Time" and precision == "month":
        diff = f"((year({v(b)}) - year({v(a)})) * 12 + month({v(b)}) - month({v(a)}))"
        f = f"case when {diff} > 0 and dayofmonth({v(b)}) < dayofmonth({v(a)}) then {diff} - 1 when {diff} < 0 and dayofmonth({v(a)}) < dayofmonth({v(b)}) then {diff} + 1 else {diff} end"
    elif kind == "Date" and precision in ("day", "week"):
        f = f"datediff({v(b)}, {v(a)})" + (" div 7" if precision == "week" else "")
    else:
        f = f"(({_micros(kind, b)} - {_micros(kind, a)}) div {MICROS[precision]})"
    needed = min(LEVEL[precision], FULL[kind])  # full dates count finer units from midnight
    return E(f"cast(case when {_least(a, b, needed)} then {f} end as int)", "Integer")


_STEPS = {"year": ("years", "a"), "month": ("months", "mo"), "week": ("weeks", "wk"), "day": ("days", "d"), "hour": ("hours", "h"), "minute": ("minutes", "min"), "second": ("seconds", "s"), "millisecond": ("milliseconds", "ms")}


def add_temporal(a: E, q: E, sign: int) -> E:
    """Point plus a quantity in calendar units or wk, d, h, min, s, ms; whole units of the point's precision; null past the ends."""
    return c.let_both(a, q, lambda x, y: _add_temporal(x, y, sign))


def _add_temporal(a: E, q: E, sign: int) -> E:
    kind = base(a.t)
    n = f"cast(({q}).value as bigint)" if sign > 0 else f"(- cast(({q}).value as bigint))"
    unit = f"({q}).unit"
    names = lambda k: f"{unit} in ({', '.join(text(x) for x in (k, *(_STEPS[k] if k not in ('year', 'month') else _STEPS[k][:1])))})"
    whens = []
    level = p(a)
    for k in _STEPS:
        if kind == "Time":
            if k in ("year", "month", "week", "day"):
                continue
            point = f"cast((({v(a)} + {n} * {MICROS[k] // 1000}) % 86400000 + 86400000) % 86400000 as int)"
        elif k in ("year", "month"):
            months = f"cast({n} * {12 if k == 'year' else 1} as int)"
            # a quantity finer than the value's precision counts in whole units of it
            if k == "month":
                months = f"cast(case when {level} < 2 then ({n} div 12) * 12 else {n} end as int)" if not level.isdigit() or int(level) < 2 else months
            point = f"add_months({v(a)}, {months})" if kind == "Date" else f"({v(a)} + make_ym_interval(0, {months}))"
        else:
            days = f"({n} * {MICROS[k]} div {MICROS['day']})"
            if kind == "Date":
                point = _by_level(a, {1: f"add_months({v(a)}, cast({days} div 365 * 12 as int))", 2: f"add_months({v(a)}, cast({days} div 30 as int))", 3: f"date_add({v(a)}, cast({days} as int))"})
            else:
                exact = f"timestamp_micros(unix_micros({v(a)}) + {n} * {MICROS[k]})"
                choices = {1: f"({v(a)} + make_ym_interval(0, cast({days} div 365 * 12 as int)))", 2: f"({v(a)} + make_ym_interval(0, cast({days} div 30 as int)))"}
                for at, u in ((3, "day"), (4, "hour"), (5, "minute"), (6, "second")):
                    choices[at] = f"timestamp_micros(unix_micros({v(a)}) + {n} * {MICROS[k]} div {MICROS[u]} * {MICROS[u]})" if MICROS[k] < MICROS[u] else exact
                point = _by_level(a, choices | {7: exact})
        whens.append(f"when {names(k)} then {point}")
    if kind != "Time":
        lo, hi = extreme(kind + "!", False), extreme(kind + "!", True)
        x = fresh()
        point = f"transform(array(case {' '.join(whens)} end), {x} -> case when {x} between {lo} and {hi} then {x} end)[0]"
    else:
        point = f"case {' '.join(whens)} end"
    return rebuilt(a, point)


@op("SamePrecision")
def same_precision(args, _):
    return boolean(f"{p(args[0])} = {p(args[1])}")


@op("GreaterOrSamePrecision")
def greater_precision(args, precision):
    return boolean(f"{p(args[0])} >= {LEVEL[precision]}")


OPS["Now"] = lambda args, _, ctx: temporal("DateTime", f"TIMESTAMP'{ctx.now}'", 7, "0")
OPS["Today"] = lambda args, _, ctx: E(f"DATE'{ctx.now[:10]}'", "Date!")
OPS["TimeOfDay"] = lambda args, _, ctx: temporal("Time", f"cast(unix_millis(TIMESTAMP'{ctx.now}') % 86400000 as int)", 7)


@op("CalculateAge")
def calculate_age(args, precision):
    raise TypeFault("CalculateAge needs the context's today; use CalculateAgeAt")


OPS["CalculateAgeAt"] = lambda args, precision: OPS["DurationBetween"](_age_pair(args), precision)


def _age_pair(args):
    a, b = args
    if base(a.t) == "Date" and base(b.t) == "DateTime":
        a = coerce(a, "DateTime")
    return [a, b]


# --- intervals -------------------------------------------------------------


def make_interval(low: E, high: E, low_closed: bool, high_closed: bool) -> E:
    """Closed at construction: an open bound moves one step in; an open null bound is unknown."""
    t = unify([low.t, high.t])
    if t == "Any":
        return null(("Interval", "Integer"))
    low, high = coerce(low, t), coerce(high, t)
    if not t.endswith("!") and max(len(low.sql), len(high.sql)) >= c.LONG:
        return c.let_both(low, high, lambda x, y: make_interval(x, y, low_closed, high_closed))
    lo = low if low_closed else step(low, 1)
    hi = high if high_closed else step(high, -1)
    lc = "true" if low_closed else f"{low} is not null"
    hc = "true" if high_closed else f"{high} is not null"
    body = f"named_struct('low', {lo}, 'high', {hi}, 'lc', {lc}, 'hc', {hc})"
    if t.endswith("!"):
        return E(body, ("Interval", t))
    return E(f"case when {low} is null and {high} is null then null else {body} end", ("Interval", t))


OPS["Interval"] = lambda args, _: make_interval(args[0], args[1], args[2].sql == "true", args[3].sql == "true")
OPS["ToClosed"] = lambda args, _: args[0]


def start(i: E) -> E:
    if not i.sql.startswith("named_struct") and len(i.sql) >= c.LONG:
        return c.let(i, start)
    low = part(i, "low")
    return E(f"case when {low} is null and ({i}).lc then {extreme(low.t, False)} else {low} end", low.t) if not i.sql.startswith("named_struct") else low


def end(i: E) -> E:
    if not i.sql.startswith("named_struct") and len(i.sql) >= c.LONG:
        return c.let(i, end)
    high = part(i, "high")
    return E(f"case when {high} is null and ({i}).hc then {extreme(high.t, True)} else {high} end", high.t) if not i.sql.startswith("named_struct") else high


OPS["Start"] = lambda args, _: start(args[0])
OPS["End"] = lambda args, _: end(args[0])
OPS["Width"] = lambda args, _: OPS["Subtract"]([end(args[0]), start(args[0])], None)
OPS["IntervalSize"] = OPS["Size"] = lambda args, _: E(f"coalesce({step(OPS['Subtract']([end(args[0]), start(args[0])], None), 1)}, 0)" if args[0].t[1] != "Decimal" else f"coalesce({step(OPS['Subtract']([end(args[0]), start(args[0])], None), 1)}, cast(0 as {DECIMAL}))", args[0].t[1])


@op("PointFrom")
def point_from(args, _):
    i = args[0]
    return E(f"case when {i} is null then null when {order(start(i), end(i))} = 0 then {start(i)} else raise_error('not a point interval') end", i.t[1])


def _ivl(e: E) -> bool:
    return is_interval(e.t)


def _bounds(e: E) -> tuple[E, E]:
    return (start(e), end(e)) if _ivl(e) else (e, e)


def _cmp(a, b, o, precision=None) -> str:
    return compare(a, b, o, precision).sql


@op("After")
def after(args, precision):
    (lo, _), (_, hi) = _bounds(args[0]), _bounds(args[1])
    return compare(lo, hi, ">", precision)


@op("Before")
def before(args, precision):
    (_, hi), (lo, _) = _bounds(args[0]), _bounds(args[1])
    return compare(hi, lo, "<", precision)


@op("SameAs")
def same_as(args, precision):
    a, b = args
    if _ivl(a) and _ivl(b):
        return boolean(f"{_cmp(start(a), start(b), '=', precision)} and {_cmp(end(a), end(b), '=', precision)}")
    (a0, a1), (b0, b1) = _bounds(a), _bounds(b)
    return boolean(f"{_cmp(a0, b0, '=', precision)} and {_cmp(a1, b1, '=', precision)}") if _ivl(a) or _ivl(b) else compare(a, b, "=", precision)


@op("SameOrAfter")
def same_or_after(args, precision):
    return compare(_bounds(args[0])[0], _bounds(args[1])[1], ">=", precision)


@op("SameOrBefore")
def same_or_before(args, precision):
    return compare(_bounds(args[0])[1], _bounds(args[1])[0], "<=", precision)


def contains(i: E, x: E, precision=None) -> E:
    return boolean(f"{_cmp(x, start(i), '>=', precision)} and {_cmp(x, end(i), '<=', precision)}")


def includes(i: E, j: E, precision=None) -> E:
    return boolean(f"{_cmp(start(i), start(j), '<=', precision)} and {_cmp(end(i), end(j), '>=', precision)}")


def _has(a: E, x: E) -> E:
    """Whether list a holds x; a null list holds nothing; null is found by null."""
    t = unify([a.t[1], x.t])
    y = fresh()
    one = coerce(E(y, a.t[1]), t)
    same = f"({one} <=> {coerce(x, t)})" if t in (*NUMBERS, "String", "Boolean") else f"coalesce({equal(one, coerce(x, t))}, {one} is null and {x} is null)"
    return boolean(f"coalesce(exists({a}, {y} -> {same}), false)")


def _all_in(a: E, b: E) -> E:
    """Every element of b in a."""
    x = fresh()
    return boolean(f"case when {a} is null or {b} is null then null else forall({b}, {x} -> {_has(a, E(x, b.t[1]))}) end")


@op("Contains")
def contains_(args, precision):
    a, x = args
    return _has(a, x) if is_list(a.t) else contains(a, x, precision)


@op("In")
def in_(args, precision):
    return contains_([args[1], args[0]], precision)


@op("Includes", "ListIncludesList", "ListIncludesElement", "IntervalIncludesElement", "IntervalIncludesInterval")
def includes_(args, precision):
    a, b = args
    if is_list(a.t):
        return _all_in(a, b) if is_list(b.t) else _has(a, b)
    return includes(a, b, precision) if _ivl(b) else contains(a, b, precision)


@op("IncludedIn", "ListIncludedInList", "ElementIncludedInList", "IntervalIncludedIn")
def included_in(args, precision):
    return includes_([args[1], args[0]], precision)


@op("ProperIncludes", "ListProperlyIncludesList", "ListProperlyIncludesElement", "IntervalProperlyIncludesInterval", "IntervalProperlyIncludesElement", "ProperContains")
def proper_includes(args, precision):
    a, b = args
    if is_list(a.t):
        more = f"size({a}) > size({b})" if is_list(b.t) else f"size({a}) > 1"
        return boolean(f"{includes_(args, precision)} and {more}")
    if _ivl(b):
        return boolean(f"{includes(a, b, precision)} and not {OPS['SameAs']([a, b], precision)}")
    return boolean(f"{_cmp(b, start(a), '>', precision)} and {_cmp(b, end(a), '<', precision)}")


@op("ProperIncludedIn", "ListProperlyIncludedInList", "ElementProperlyIncludedInList", "IntervalProperlyIncludedInInterval", "ElementProperlyIncludedInInterval", "ProperIn")
def proper_included_in(args, precision):
    return proper_includes([args[1], args[0]], precision)


def overlaps(a: E, b: E, precision=None) -> E:
    return boolean(f"{_cmp(start(a), end(b), '<=', precision)} and {_cmp(end(a), start(b), '>=', precision)}")


OPS["Overlaps"] = lambda args, precision: overlaps(*args, precision)
OPS["OverlapsBefore"] = lambda args, precision: boolean(f"{overlaps(*args, precision)} and {_cmp(start(args[0]), start(args[1]), '<', precision)}")
OPS["OverlapsAfter"] = lambda args, precision: boolean(f"{overlaps(*args, precision)} and {_cmp(end(args[0]), end(args[1]), '>', precision)}")
OPS["Starts"] = lambda args, precision: boolean(f"{_cmp(start(args[0]), start(args[1]), '=', precision)} and {_cmp(end(args[0]), end(args[1]), '<=', precision)}")
OPS["Ends"] = lambda args, precision: boolean(f"{_cmp(start(args[0]), start(args[1]), '>=', precision)} and {_cmp(end(args[0]), end(args[1]), '=', precision)}")


@op("MeetsBefore")
def meets_before(args, precision):
    a, b = args
    return compare(step(end(a), 1), start(b), "=", precision)


@op("MeetsAfter")
def meets_after(args, precision):
    return meets_before([args[1], args[0]], precision)


@op("Meets")
def meets(args, precision):
    return boolean(f"coalesce({meets_before(args, precision)}, false) or {meets_after(args, precision)}")


@op("Within")
def within(args, precision):
    x, q, b = args
    lo, hi = OPS["Subtract"]([_bounds(b)[0], q], None), OPS["Add"]([_bounds(b)[1], q], None)
    first, last = _bounds(x)
    a, z = (">", "<") if precision == "properly" else (">=", "<=")
    return boolean(f"{_cmp(first, lo, a)} and {_cmp(last, hi, z)}")


def _built(i: E, low: str, high: str) -> str:
    return f"named_struct('low', {low}, 'high', {high}, 'lc', true, 'hc', true)"


@op("Intersect")
def intersect(args, precision):
    a, b = c.aligned(*args)
    if is_list(a.t):
        x = fresh()
        return E(f"array_distinct(filter({a}, {x} -> {_has(b, E(x, a.t[1]))}))", a.t)
    lo = f"case when {_cmp(start(a), start(b), '>=')} then {start(a)} else {start(b)} end"
    hi = f"case when {_cmp(end(a), end(b), '<=')} then {end(a)} else {end(b)} end"
    return E(f"case when {overlaps(a, b)} then {_built(a, lo, hi)} end", a.t)


@op("Union")
def union(args, precision):
    a, b = c.aligned(*args)
    if is_list(a.t):
        empty = f"cast(array() as {sql_type(a.t)})"
        return E(f"case when {a} is null and {b} is null then null else array_union(coalesce({a}, {empty}), coalesce({b}, {empty})) end", a.t)
    lo = f"case when {_cmp(start(a), start(b), '<=')} then {start(a)} else {start(b)} end"
    hi = f"case when {_cmp(end(a), end(b), '>=')} then {end(a)} else {end(b)} end"
    return E(f"case when {overlaps(a, b)} or {meets([a, b], None)} then {_built(a, lo, hi)} end", a.t)


@op("Except")
def except_(args, precision):
    a, b = c.aligned(*args)
    if is_list(a.t):
        x = fresh()
        return E(f"array_distinct(filter({a}, {x} -> {b} is null or not {_has(b, E(x, a.t[1]))}))", a.t)
    left = f"{_cmp(start(b), start(a), '>')}"
    right = f"{_cmp(end(b), end(a), '<')}"
    return E(f"case when not {overlaps(a, b)} then {a} when {left} and not {right} then {_built(a, str(start(a)), str(step(start(b), -1)))} when {right} and not {left} then {_built(a, str(step(end(b), 1)), str(end(a)))} end", a.t)


def sort_key(e: E) -> str:
    """Something that Spark's own order sorts as CQL does."""
    if e.t == "Quantity":
        return canonical_key(e)
    return v(e) if isinstance(e.t, str) and base(e.t) in TEMPORAL else str(e)


def canonical_key(q: E) -> str:
    return c.canonical(q)


@op("Collapse")
def collapse(args, precision):
    """Array form: a fold over the intervals in order of their low bounds; with per, gaps under it close too."""
    a = args[0]
    i, acc = fresh("i"), fresh("acc")
    t = a.t[1]
    last = E(f"element_at({acc}, -1)", t)
    x = E(i, t)
    joined = f"{overlaps(last, x)} or {meets([last, x], None)}"
    if len(args) > 1 and args[1].t == "Quantity":
        near = _cmp(start(x), OPS["Add"]([end(last), args[1]], None), "<=") if base(t[1]) in TEMPORAL or t[1] == "Quantity" else _cmp(start(x), OPS["Add"]([end(last), E(f"({args[1]}).value", "Decimal")], None), "<=")
        joined = f"{joined} or {near}"
    merged = _built(x, str(start(last)), f"case when {_cmp(end(x), end(last), '>')} then {end(x)} else {end(last)} end")
    k = fresh("k")
    keyed = f"array_sort(transform(filter({a}, {k} -> {k} is not null), {k} -> struct({sort_key(start(E(k, t)))} as a, {sort_key(end(E(k, t)))} as b, {k} as i)))"
    body = f"case when size({acc}) > 0 and ({joined}) then concat(slice({acc}, 1, size({acc}) - 1), array({merged})) else concat({acc}, array({i})) end"
    return E(f"case when {a} is not null then aggregate(transform({keyed}, {k} -> {k}.i), cast(array() as {sql_type(a.t)}), ({acc}, {i}) -> {body}) end", a.t)


@op("Expand")
def expand(args, precision):
    """An interval to its points, a list of intervals to unit intervals, per a quantity."""
    a = args[0]
    per = args[1] if len(args) > 1 else quantity("1", "'1'")
    if is_list(a.t):
        t = a.t[1]
        i, x = fresh("i"), fresh()
        points = expand([E(i, t), *args[1:]], precision)
        nxt = step(OPS["Add"]([E(x, t[1]), _per_of(t[1], per, len(args) > 1)], None), -1)
        return E(f"flatten(transform({collapse([a], None)}, {i} -> transform({points}, {x} -> {_built(a, x, str(nxt))})))", a.t)
    t = a.t[1]
    lo, hi = start(a), end(a)
    n = f"({per}).value"
    ok = f"({a}).lc and ({a}).hc and {_cmp(lo, hi, '<=')}"
    if t in ("Integer", "Long"):
        seq = f"sequence({lo}, {hi}, cast({n} as {sql_type(t)}))"
    elif t == "Decimal":
        x = fresh()
        seq = f"transform(sequence(0L, cast(floor(({hi} - {lo}) / {n}) as bigint)), {x} -> cast({lo} + {x} * {n} as {DECIMAL}))"
    elif base(t) == "Time":
        x = fresh()
        unit = f"({n} * case regexp_replace(({per}).unit, 's$', '') when 'hour' then 3600000 when 'minute' then 60000 when 'second' then 1000 else 1 end)"
        seq = f"transform(sequence({v(lo)}, {v(hi)}, cast({unit} as int)), {x} -> {x if t.endswith('!') else temporal('Time', x, 7)})"
    else:
        x = fresh()
        unit = f"regexp_replace(({per}).unit, 's$', '')"
        k = f"cast({n} as int)"
        day = f"case {unit} when 'year' then make_interval({k}) when 'month' then make_interval(0, {k}) when 'week' then make_interval(0, 0, {k}) when 'hour' then make_interval(0, 0, 0, 0, {k}) when 'minute' then make_interval(0, 0, 0, 0, 0, {k}) when 'second' then make_interval(0, 0, 0, 0, 0, 0, {k}) else make_interval(0, 0, 0, {k}) end"
        whole = f"sequence({v(lo)}, {v(hi)}, {day})"
        seq = whole if t.endswith("!") else f"transform({whole}, {x} -> {temporal(base(t), x, FULL[base(t)])})"
    return E(f"case when {a} is not null then case when {ok} then {seq} else cast(array() as {sql_type(('List', t))}) end end", ("List", t))


def _per_of(t, per: E, given: bool) -> E:
    if base(t) in TEMPORAL:
        return per if given else quantity("1", "'day'")
    return coerce(E(f"cast(({per}).value as {sql_type(t)})", t), t) if t != "Quantity" else per


# --- lists -----------------------------------------------------------------

OPS["Exists"] = lambda args, _: boolean(f"coalesce(exists({args[0]}, x -> x is not null), false)")
OPS["First"] = lambda args, _: E(f"get({args[0]}, 0)", args[0].t[1])
OPS["Last"] = lambda args, _: E(f"try_element_at({args[0]}, -1)", args[0].t[1])
OPS["ListSkip"] = OPS["Skip"] = lambda args, _: E(f"case when {args[1]} is null then {args[0]} when {args[1]} < 0 then cast(array() as {sql_type(args[0].t)}) else slice({args[0]}, {args[1]} + 1, size({args[0]})) end", args[0].t)
OPS["ListTake"] = OPS["Take"] = lambda args, _: E(f"slice({args[0]}, 1, greatest(coalesce({coerce(args[1], 'Integer')}, 0), 0))", args[0].t)
OPS["Tail"] = lambda args, _: E(f"slice({args[0]}, 2, size({args[0]}))", args[0].t)
OPS["Slice"] = lambda args, _: E("case when {1} < 0 or {2} < {1} then cast(array() as {3}) else slice({0}, {1} + 1, {2} - {1}) end".format(args[0], coerce(args[1], "Integer"), coerce(args[2], "Integer"), sql_type(args[0].t)), args[0].t)
OPS["Flatten"] = OPS["FlattenLateBoundList"] = lambda args, _: E(f"flatten(filter({args[0]}, x -> x is not null))", args[0].t[1])
OPS["IndexOf"] = lambda args, _: E("case when {0} is not null and {1} is not null then cast(array_position({0}, {1}) - 1 as int) end".format(args[0], coerce(args[1], args[0].t[1])), "Integer")
OPS["SingletonFrom"] = lambda args, _: E("case when size({0}) > 1 then raise_error('more than one element') else get({0}, 0) end".format(args[0]), args[0].t[1])
OPS["ToList"] = lambda args, _: E(f"array({args[0]})", ("List", args[0].t))


@op("Distinct")
def distinct(args, _):
    return E(f"array_distinct({args[0]})", args[0].t)


def sort_list(a: E, key=None, descending: bool = False) -> E:
    """Nulls first going up, last going down; stable."""
    x, y, k = fresh(), fresh(), fresh()
    t = a.t[1]
    keyed = f"transform({a}, ({x}, {y}) -> struct({sort_key(key(E(x, t)) if key else E(x, t))} as k, {'-' if descending else ''}{y} as n, {x} as e))"
    return E(f"transform(sort_array({keyed}, {'false' if descending else 'true'}), {k} -> {k}.e)", a.t)


OPS["ListSort"] = lambda args, _: sort_list(args[0], None, len(args) > 1 and args[1].sql == "true")
OPS["SortBy"] = OPS["ListSort"]


# --- aggregates (array form) -----------------------------------------------


def _present(a: E) -> str:
    return f"filter({a}, x -> x is not null)"


def _numbers(args, kind=None):
    a = args[0]
    if a.t == "Any":
        a = null(("List", kind or "Decimal"))
    t = a.t[1] if a.t[1] != "Any" else (kind or "Decimal")
    if t not in (*NUMBERS, "Quantity"):
        raise TypeFault(f"{t} is no number")
    if kind and t in NUMBERS:
        t = kind
    return coerce(a, ("List", t)), t


def _quantities(a: E, f) -> E:
    """f on the values, where all units agree."""
    vals = E(f"transform({_present(a)}, x -> x.value)", ("List", "Decimal"))
    units = f"array_distinct(transform({_present(a)}, x -> x.unit))"
    out = f(vals)
    return E(f"case when size({units}) = 1 then {quantity(str(out), f'{units}[0]')} end", "Quantity")


OPS["AllTrue"] = lambda args, _: boolean(f"coalesce(forall({_present(coerce(args[0], ('List', 'Boolean')))}, x -> x), true)")
OPS["AnyTrue"] = lambda args, _: boolean(f"coalesce(exists({_present(coerce(args[0], ('List', 'Boolean')))}, x -> x), false)")
OPS["Count"] = lambda args, _: E(f"case when {args[0]} is not null then size({_present(args[0])}) end", "Integer")


@op("Sum")
def sum_(args, _):
    a, t = _numbers(args)
    if t == "Quantity":
        return _quantities(a, lambda x: sum_([x], None))
    return E(f"case when size({_present(a)}) > 0 then aggregate({_present(a)}, cast(0 as {sql_type(t)}), (s, x) -> try_cast(try_add(s, x) as {sql_type(t)})) end", t)


@op("Product")
def product(args, _):
    a, t = _numbers(args)
    if t == "Quantity":
        return _quantities(a, lambda x: product([x], None))
    return E(f"case when size({_present(a)}) > 0 then aggregate({_present(a)}, cast(1 as {sql_type(t)}), (s, x) -> try_cast(try_multiply(s, x) as {sql_type(t)})) end", t)


@op("Avg")
def avg(args, _):
    a, t = _numbers(args, "Decimal")
    if t == "Quantity":
        return _quantities(a, lambda x: avg([x], None))
    return E(f"case when size({_present(a)}) > 0 then cast({sum_([a], None)} / size({_present(a)}) as {DECIMAL}) end", "Decimal")


@op("GeometricMean")
def geometric_mean(args, _):
    a, _t = _numbers(args, "Decimal")
    return _double(f"case when size({_present(a)}) > 0 then pow(cast({product([a], None)} as double), 1.0D / size({_present(a)})) end")


def _extreme(args, high):
    a, t = args[0], args[0].t[1]
    x = fresh()
    name = "array_max" if high else "array_min"
    return E(f"{name}(transform({_present(a)}, {x} -> struct({sort_key(E(x, t))} as k, {x} as e))).e", t)


OPS["Max"] = lambda args, _: _extreme(args, True)
OPS["Min"] = lambda args, _: _extreme(args, False)


@op("Median")
def median(args, _):
    a, t = _numbers(args)
    if t == "Quantity":
        return _quantities(a, lambda x: median([x], None))
    s, n = f"sort_array({_present(a)})", f"size({_present(a)})"
    mid = f"cast((get({s}, cast({n} / 2 as int) - 1) + get({s}, cast({n} / 2 as int))) / 2 as {sql_type(t)})" if t == "Decimal" else f"cast((get({s}, cast({n} / 2 as int) - 1) + get({s}, cast({n} / 2 as int))) div 2 as {sql_type(t)})"
    return E(f"case when {n} = 0 then null when {n} % 2 = 1 then get({s}, cast(floor({n} / 2) as int)) else {mid} end", t)


@op("Mode")
def mode(args, _):
    a, t = args[0], args[0].t[1]
    x, y = fresh(), fresh()
    counted = f"transform(array_distinct({_present(a)}), ({x}, i) -> struct(size(filter({a}, {y} -> {y} = {x})) as n, -i as i, {x} as e))"
    return E(f"array_max({counted}).e", t)


def _variance(a: E, sample: bool) -> str:
    n, mean = f"size({_present(a)})", f"(aggregate({_present(a)}, 0.0D, (s, x) -> s + cast(x as double)) / size({_present(a)}))"
    least = 1 if sample else 0
    return f"case when {n} > {least} then aggregate({_present(a)}, 0.0D, (s, x) -> s + pow(cast(x as double) - {mean}, 2)) / ({n}{' - 1' if sample else ''}) end"


def _spread(sample, root):
    def f(args, _):
        a, t = _numbers(args, "Decimal")
        if t == "Quantity":
            return _quantities(a, lambda x: f([x], None))
        body = _variance(a, sample)
        return _double(f"sqrt({body})" if root else body)

    return f


OPS["StdDev"], OPS["Variance"] = _spread(True, True), _spread(True, False)
OPS["PopulationStdDev"], OPS["PopulationVariance"] = _spread(False, True), _spread(False, False)


# --- conversions -----------------------------------------------------------

_TRUE, _FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def _listed(values):
    return ", ".join(text(x) for x in values)


@op("ToBoolean")
def to_boolean(args, _):
    a = args[0]
    if a.t == "Boolean":
        return a
    if a.t in NUMBERS:
        return boolean(f"case when {a} = 1 then true when {a} is not null then false end")
    a = coerce(a, "String")
    return boolean(f"case when lower({a}) in ({_listed(_TRUE)}) then true when lower({a}) in ({_listed(_FALSE)}) then false end")


def _to_number(t):
    def f(args, _):
        a = args[0]
        if a.t == "Boolean":
            return E(f"cast(cast({a} as int) as {sql_type(t)})", t)
        if a.t in NUMBERS:
            return E(f"try_cast({a} as {sql_type(t)})", t)
        a = coerce(a, "String")
        pattern = r"^[+-]?\\d+$" if t != "Decimal" else r"^[+-]?\\d+(\\.\\d+)?$"
        return E(f"case when rlike({a}, '{pattern}') then try_cast({a} as {sql_type(t)}) end", t)

    return f


OPS["ToInteger"], OPS["ToLong"], OPS["ToDecimal"] = _to_number("Integer"), _to_number("Long"), _to_number("Decimal")


def plain_decimal(a: str) -> str:
    return f"regexp_replace(regexp_replace(cast({a} as string), '(\\\\.\\\\d*?)0+$', '$1'), '\\\\.$', '.0')"


@op("ToString")
def to_string(args, _):
    a = args[0]
    t = a.t
    if t in ("String", "Any"):
        return coerce(a, "String")
    if t == "Decimal":
        return E(plain_decimal(a.sql), "String")
    if t == "Quantity":
        value = plain_decimal(f"({a}).value")
        return E(f"concat(regexp_replace({value}, '\\\\.0$', ''), case when coalesce(({a}).unit, '1') = '1' then ' \\'1\\'' else concat(' \\'', ({a}).unit, '\\'') end)", "String")
    if t == "Ratio":
        return E(f"concat({to_string([part(a, 'numerator')], None)}, ':', {to_string([part(a, 'denominator')], None)})", "String")
    if isinstance(t, str) and base(t) in TEMPORAL:
        kind = base(t)
        if kind == "Date":
            full, cuts = f"date_format({v(a)}, 'yyyy-MM-dd')", {1: 4, 2: 7, 3: 10}
        elif kind == "DateTime":
            full, cuts = f"date_format({v(a)}, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")", {1: 4, 2: 7, 3: 10, 4: 13, 5: 16, 6: 19, 7: 23}
        else:
            full, cuts = f"date_format(timestamp_millis({v(a)}), 'HH:mm:ss.SSS')", {4: 2, 5: 5, 6: 8, 7: 12}
        return E(f"substring({full}, 1, case {p(a)} {' '.join(f'when {k} then {n}' for k, n in cuts.items())} end)", "String")
    return E(f"cast({a} as string)", "String")


_DATE_PATTERN = r"^(\\d{4})(?:-(\\d\\d)(?:-(\\d\\d))?)?$"
_STAMP = r"^(\\d{4})(?:-(\\d\\d)(?:-(\\d\\d))?)?(?:T(?:(\\d\\d)(?::(\\d\\d)(?::(\\d\\d)(?:\\.(\\d{1,3})\\d*)?)?)?)?)?(Z|[+-]\\d\\d:\\d\\d)?$"
_CLOCK = r"^T?(\\d\\d)(?::(\\d\\d)(?::(\\d\\d)(?:\\.(\\d{1,3})\\d*)?)?)?(Z|[+-]\\d\\d:\\d\\d)?$"


def _groups(a: E, pattern: str, n: int, body) -> E:
    """body(groups of the pattern), each group taken once."""
    g = fresh("g")
    found = c.let(a, lambda x: E("array(" + ", ".join(f"nullif(regexp_extract({x}, '{pattern}', {k}), '')" for k in range(1, n + 1)) + ")", ("List", "String")))
    out = body(*(f"{g}[{k}]" for k in range(n)))
    return E(f"transform(array({found}), {g} -> {out})[0]", out.t, out.p)


@op("ToDate")
def to_date(args, _):
    a = args[0]
    if isinstance(a.t, str) and base(a.t) in TEMPORAL:
        return OPS["DateFrom"]([a], None)
    a = coerce(a, "String")
    return _groups(a, _DATE_PATTERN, 3, _date_of)


def _date_of(y, m, d):
    point = f"try_cast(concat({y}, '-', coalesce({m}, '01'), '-', coalesce({d}, '01')) as date)"
    return _if_point(temporal("Date", point, f"case when {m} is null then 1 when {d} is null then 2 else 3 end"))


def _if_point(e: E) -> E:
    x = fresh()
    return E(f"transform(array({e}), {x} -> case when {x}.v is not null then {x} end)[0]", e.t, e.p)


@op("ToDateTime")
def to_date_time(args, _):
    a = args[0]
    if isinstance(a.t, str) and base(a.t) in TEMPORAL:
        return coerce(a, "DateTime")
    a = coerce(a, "String")
    return _groups(a, _STAMP, 8, _date_time_of)


def _date_time_of(y, mo, d, h, mi, s, ms, z):
    zone = f"case when {z} is null then null when {z} = 'Z' then 0 else (case when {z} like '-%' then -1 else 1 end) * (cast(substring({z}, 2, 2) as int) * 60 + cast(substring({z}, 5, 2) as int)) end"
    point = f"try_cast(concat({y}, '-', coalesce({mo}, '01'), '-', coalesce({d}, '01'), ' ', coalesce({h}, '00'), ':', coalesce({mi}, '00'), ':', coalesce({s}, '00'), '.', rpad(coalesce({ms}, '0'), 3, '0'), coalesce({z}, 'Z')) as timestamp)"
    level = f"case when {mo} is null then 1 when {d} is null then 2 when {h} is null then 3 when {mi} is null then 4 when {s} is null then 5 when {ms} is null then 6 else 7 end"
    return _if_point(temporal("DateTime", point, level, f"cast({zone} as int)"))


@op("ToTime")
def to_time(args, _):
    a = args[0]
    if isinstance(a.t, str) and base(a.t) == "DateTime":
        return OPS["TimeComponent"]([a], None)
    if isinstance(a.t, str) and base(a.t) == "Time":
        return a
    a = coerce(a, "String")
    return _groups(a, _CLOCK, 5, _time_of)


def _time_of(h, mi, s, ms, _z):
    ok = f"cast({h} as int) < 24 and coalesce(cast({mi} as int), 0) < 60 and coalesce(cast({s} as int), 0) < 60"
    point = f"case when {ok} then ((cast({h} as int) * 60 + coalesce(cast({mi} as int), 0)) * 60 + coalesce(cast({s} as int), 0)) * 1000 + coalesce(cast(rpad({ms}, 3, '0') as int), 0) end"
    return _if_point(temporal("Time", point, f"case when {mi} is null then 4 when {s} is null then 5 when {ms} is null then 6 else 7 end"))


@op("ToQuantity")
def to_quantity(args, _):
    a = args[0]
    if a.t in NUMBERS or a.t == "Quantity":
        return coerce(a, "Quantity")
    a = coerce(a, "String")
    pattern = r"^([+-]?\\d+(?:\\.\\d+)?)\\s*(?:\\\'([^\\\']*)\\\'|([a-z]+))?$"
    n, quoted, word = (f"nullif(regexp_extract({a}, '{pattern}', {k}), '')" for k in (1, 2, 3))
    return E(f"case when {n} is not null then {quantity(n, f'coalesce({quoted}, {word}, {text(str(1))})')} end", "Quantity")


@op("ToRatio")
def to_ratio(args, _):
    """Two quantities with a colon between."""
    if args[0].t == "Ratio":
        return args[0]
    a = coerce(args[0], "String")
    one, two = (to_quantity([E(f"trim(split_part({a}, ':', {k}))", "String")], None) for k in (1, 2))
    return E(f"case when {one} is not null and {two} is not null then named_struct('numerator', {one}, 'denominator', {two}) end", "Ratio")


@op("ToChars")
def to_chars(args, _):
    a = coerce(args[0], "String")
    return E(f"case when {a} = '' then cast(array() as array<string>) else transform(sequence(1, length({a})), i -> substring({a}, i, 1)) end", ("List", "String"))


OPS["TimezoneFrom"] = OPS["TimezoneOffsetFrom"]


@op("ToConcept")
def to_concept(args, _):
    a = args[0]
    if is_list(a.t):
        return when(a, f"named_struct('codes', {a}, 'display', cast(null as string))", "Concept")
    return coerce(a, "Concept")


@op("Quantity")
def quantity_(args, _):
    return quantity(str(coerce(args[0], "Decimal")), str(coerce(args[1], "String")))


@op("ConvertQuantity")
def convert_quantity(args, _):
    q, unit = args[0], coerce(args[1], "String")
    to = quantity("1", str(unit))
    factor = c._unit_case(str(unit), 1, "null")
    return E(f"case when coalesce(({q}).unit, '1') = {unit} then {q} when {c.dimension(q)} = {c.dimension(to)} and {factor} is not null then {quantity(f'{c.canonical(q)} / cast({factor} as decimal(18,6))', str(unit))} end", "Quantity")


@op("CanConvertQuantity")
def can_convert_quantity(args, _):
    return boolean(f"case when {args[0]} is not null and {args[1]} is not null then {convert_quantity(args, None)} is not null end")


for _t in ("Boolean", "Integer", "Long", "Decimal", "String", "Date", "DateTime", "Time", "Quantity", "Ratio"):
    OPS["ConvertsTo" + _t] = lambda args, _, f="To" + _t: boolean(f"case when {args[0]} is not null then {OPS[f](args, None)} is not null end")
for _name in (
    "BooleanToInteger BooleanToLong BooleanToDecimal BooleanToString IntegerToBoolean IntegerToLong IntegerToDecimal IntegerToQuantity IntegerToString LongToBoolean LongToInteger LongToDecimal LongToQuantity LongToString "
    "DecimalToBoolean DecimalToQuantity DecimalToString QuantityToString RatioToString StringToBoolean StringToInteger StringToLong StringToDecimal StringToQuantity StringToDate StringToDateTime StringToTime "
    "DateToString DateToDateTime DateTimeToString DateTimeToDate TimeToString CodeToConcept"
).split():
    _from, _, _to = _name.partition("To")
    OPS["Convert" + _name] = lambda args, _, f="To" + _to, k=_from: OPS[f]([coerce(args[0], k) if not (isinstance(args[0].t, str) and base(args[0].t) == k) else args[0]], None)


@op("ConvertConceptToListOfCodes")
def concept_codes(args, _):
    a = args[0]
    return to_concept(args, _) if is_list(a.t) else part(a, "codes")


def convert(e: E, t) -> E:
    """convert e to t."""
    if e.t == t or isinstance(e.t, str) and base(e.t) == t:
        return e
    return call(f"To{t}", [e]) if f"To{t}" in OPS else coerce(e, t)


# --- terminology -----------------------------------------------------------


def _code_key(e: E) -> str:
    return f"concat_ws('|', lower(({e}).system), lower(({e}).code))"


def _in_codes(e: E, codes: E) -> str:
    """Membership by code and system; by code alone where the system is blank."""
    x = fresh()
    return f"exists({codes}, {x} -> lower({x}.code) = lower(({e}).code) and (coalesce(({e}).system, '') = '' or lower({x}.system) = lower(({e}).system)))"


@op("InValueSet", "AnyInValueSet")
def in_value_set(args, precision, context):
    """Codes, strings or concepts, single or listed, against a value set's codes (an array of the plan, or a table that the compiler joins)."""
    a, codes = args
    t = a.t
    if t == "Any":
        return boolean("false")
    if is_list(t):
        x = fresh()
        return boolean(f"coalesce(exists({a}, {x} -> {in_value_set([E(x, t[1]), codes], None, context)}), false)")
    if t == "String":
        x = fresh()
        return boolean(f"case when {a} is null then null else exists({codes}, {x} -> lower({x}.code) = lower({a})) end")
    if t == "Code":
        return boolean(f"case when {a} is null then null else {_in_codes(a, codes)} end")
    return in_value_set([part(coerce(a, "Concept"), "codes"), codes], None, context)


OPS["ExpandValueSet"] = lambda args, _, ctx: args[0]
OPS["ResolveValueSet"] = OPS["CreateValueSetFacade"] = lambda args, _: args[0]
for _name in ("StringInValueSet", "StringsInValueSet", "CodeInValueSet", "CodesInValueSet", "ConceptInValueSet", "ConceptsInValueSet"):
    OPS[_name] = lambda args, _: in_value_set(args, None, None)
OPS["CodeInList"] = lambda args, _: contains_([args[1], args[0]], None)
OPS["ValueSetUnion"] = lambda args, _: union(args, None)


@op("Message")
def message(args, _):
    return args[0]


@op("Children", "Descendents")
def children(args, _):
    raise TypeFault("Children and Descendents are not supported")
