"""Trees to typed SQL expressions: everything that lives inside one row.

Lists inside a row are arrays, and queries over them become higher-order functions.
What reads whole tables is in medspan.plans.population, which hooks in through
``rows``: it is asked first for every node, and may return an expression that its
plan computes.
"""

from __future__ import annotations

from medspan.functions import core as c
from medspan.functions import library as lib
from medspan.functions.core import E, TypeFault, base, coerce, fresh, is_interval, is_list, null, part, unify
from medspan.syntax.parser import PRECISIONS, parse_expression, parse_library

_AGES = {f"CalculateAgeIn{p.capitalize()}s{a}": (p, a) for p in ("year", "month", "week", "day", "hour", "minute", "second") for a in ("", "At")}
_AGES |= {k.replace("Calculate", ""): (p, a) for k, (p, a) in list(_AGES.items())}
_ALIASES = {"ToBoolean": "ToBoolean", "Skip": "ListSkip", "Take": "ListTake", "Concat": "Concatenate", "ProperContains": "ProperIncludes", "TimeOfDay": "TimeOfDay"}


class Library:
    """A parsed library with what it includes."""

    def __init__(self, text: str, include=None):
        self.tree = parse_library(text)
        self.name = self.tree["name"]
        self.includes = {}
        for name, version, alias in self.tree["includes"]:
            if include is None:
                raise TypeFault(f"nothing to include {name} from")
            self.includes[alias] = Library(include(name, version), include)


class Compiler:
    """Compiles trees. now: the fixed evaluation time. codes: value set name or url to a list of (system, code)."""

    def __init__(self, library: Library | None = None, parameters: dict | None = None, now: str = "2020-01-02 03:04:00Z", codes: dict | None = None, externals: dict | None = None):
        self.library = library
        self.now = now
        self.codes = codes or {}
        self.parameters = parameters or {}
        self.externals = externals or {}
        self.messages: list[tuple] = []
        self.depth = 0

    # -- entry
    def compile(self, text: str, scope: dict | None = None) -> E:
        return self.expr(parse_expression(text), scope or {})

    def rows(self, tree, scope):
        return None

    def expr(self, tree, scope) -> E:
        got = self.rows(tree, scope)
        if got is not None:
            return got
        return getattr(self, "x_" + tree[0].replace("-", "_"))(tree, scope)

    # -- literals
    def x_literal(self, tree, scope):
        _, kind, value = tree
        if kind == "Boolean":
            return E(value, "Boolean")
        if kind == "String":
            return E(c.text(value), "String")
        if kind == "Integer":
            if int(value) > 2147483648:
                raise TypeFault(f"{value} is no Integer")
            return E(value, "Integer") if int(value) < 2147483648 else E("2147483648L", "Long")
        if kind == "Long":
            return E(f"{value}L", "Long")
        if kind == "Decimal":
            if len(value.partition(".")[2]) > 8:
                raise TypeFault(f"{value} has over 8 places")
            return E(f"cast({value} as {c.DECIMAL})", "Decimal")
        return c.parse_temporal(kind, value)

    def x_null(self, tree, scope):
        return null()

    def x_type(self, tree, scope):
        return E(tree[1] if isinstance(tree[1], str) else str(tree[1]), tree[1])

    def x_quantity(self, tree, scope):
        return lib.quantity(tree[1], c.text(tree[2]))

    def x_interval(self, tree, scope):
        return lib.make_interval(self.expr(tree[1], scope), self.expr(tree[2], scope), tree[3], tree[4])

    def x_list(self, tree, scope):
        items = [self.expr(x, scope) for x in tree[1]]
        t = unify([i.t for i in items] + ([self.named_type(tree[2])] if tree[2] else []))
        if not items:
            return E(f"cast(array() as {c.sql_type(('List', t))})", ("List", t))
        return E(f"array({', '.join(str(coerce(i, t)) for i in items)})", ("List", t))

    def x_tuple(self, tree, scope):
        fields = [(n, self.expr(x, scope)) for n, x in tree[1]]
        return E("named_struct(" + ", ".join(f"{c.text(n)}, {e}" for n, e in fields) + ")", ("Tuple", tuple((n, e.t) for n, e in fields)))

    def x_code(self, tree, scope):
        _, code, system, display = tree
        systems = self.library.tree["codesystems"] if self.library else {}
        url = systems.get(system, system)
        return E(f"named_struct('code', {c.text(code)}, 'system', {c.text(url)}, 'version', cast(null as string), 'display', {c.text(display) if display else 'cast(null as string)'})", "Code")

    def x_concept(self, tree, scope):
        codes = ", ".join(str(self.expr(x, scope)) for x in tree[1])
        return E(f"named_struct('codes', array({codes}), 'display', {c.text(tree[2]) if tree[2] else 'cast(null as string)'})", "Concept")

    def x_instance(self, tree, scope):
        """Type { field: value, ... } of a structured system type."""
        _, kind, fields = tree
        given = {n: self.expr(x, scope) for n, x in fields}
        names = {"Code": ("code", "system", "version", "display"), "Quantity": ("value", "unit"), "Concept": ("codes", "display"), "Ratio": ("numerator", "denominator")}.get(kind)
        if names is None or set(given) - set(names):
            raise TypeFault(f"no instance of {kind} with {sorted(given)}")
        parts = []
        for n in names:
            t = part(E("x", kind), n).t
            e = given.get(n, null())
            if is_list(t) and not is_list(e.t) and e.t != "Any":
                e = lib.call("ToList", [e])
            parts.append(f"{c.text(n)}, {coerce(e, t)}")
        return E(f"named_struct({', '.join(parts)})", kind)

    def x_paren(self, tree, scope):
        return self.expr(tree[1], scope)

    # -- references
    def x_ref(self, tree, scope):
        name = tree[1]
        if name in scope:
            return scope[name]
        if name in self.parameters:
            return self.parameter(self.parameters[name])
        tree_ = self.library.tree if self.library else None
        if tree_:
            if name in tree_["defines"]:
                return self.nested(lambda: self.expr(tree_["defines"][name], self.globals(scope)))
            if name in tree_["codes"]:
                return self.expr(tree_["codes"][name], scope)
            if name in tree_["concepts"]:
                return self.expr(tree_["concepts"][name], scope)
            if name in tree_["valuesets"]:
                return self.value_set(tree_["valuesets"][name], name)
            if name in tree_["parameters"]:
                kind, default = tree_["parameters"][name]
                return self.expr(default, {}) if default else null(self.named_type(kind) if kind else "Any")
        raise TypeFault(f"no such name: {name}")

    def globals(self, scope):
        return {k: x for k, x in scope.items() if k in ("Patient", "$context")}

    def nested(self, f):
        self.depth += 1
        if self.depth > 60:
            raise TypeFault("definitions refer to themselves")
        try:
            return f()
        finally:
            self.depth -= 1

    def parameter(self, value) -> E:
        return value if isinstance(value, E) else self.compile(value) if isinstance(value, str) else self.compile(repr(value))

    def value_set(self, url: str, name: str) -> E:
        got = self.codes.get(url, self.codes.get(url.partition("|")[0], self.codes.get(name)))
        if got is None:
            raise TypeFault(f"no value set {name}")
        items = ", ".join(f"named_struct('code', {c.text(code)}, 'system', {c.text(system) if system is not None else 'cast(null as string)'}, 'version', cast(null as string), 'display', cast(null as string))" for system, code in got)
        return E(f"array({items})" if got else f"cast(array() as {c.sql_type(('List', 'Code'))})", ("List", "Code"))

    def x_property(self, tree, scope):
        _, of, name = tree
        if of[0] == "ref" and self.library and of[1] in self.library.includes and of[1] not in scope:
            return self.included(of[1]).expr(("ref", name), self.globals(scope))
        e = self.expr(of, scope)
        if isinstance(e.t, tuple) and e.t[0] == "Row":
            fields = dict(e.t[1])
            if name not in fields:
                raise TypeFault(f"no {name}")
            return fields[name]
        return part(e, name)

    def included(self, alias):
        inner = type(self)(self.library.includes[alias], self.parameters, self.now, self.codes, self.externals)
        inner.depth = self.depth
        return inner

    # -- types
    def named_type(self, t):
        if isinstance(t, tuple):
            return ("Tuple", tuple((n, self.named_type(x)) for n, x in t[1])) if t[0] == "Tuple" else (t[0], self.named_type(t[1]))
        c.sql_type(t)
        return t

    def x_as(self, tree, scope):
        _, of, kind, strict = tree
        e, t = self.expr(of, scope), self.named_type(kind)
        if e.t == "Any":
            return null(t)
        if e.t == t or isinstance(e.t, str) and base(e.t) == t:
            return e
        if isinstance(e.t, tuple) and isinstance(t, tuple):
            return coerce(e, t)
        if strict:
            raise TypeFault(f"{e.t} can't be cast to {t}")
        try:
            return coerce(e, t)
        except TypeFault:
            return null(t)

    def x_is(self, tree, scope):
        e, t = self.expr(tree[1], scope), self.named_type(tree[2])
        same = e.t == t or isinstance(e.t, str) and base(e.t) == t
        return E(f"({e} is not null)" if same else "false", "Boolean")

    def x_convert(self, tree, scope):
        e = self.expr(tree[1], scope)
        if isinstance(tree[2], tuple) and tree[2][0] == "unit":
            return lib.call("ConvertQuantity", [e, E(c.text(tree[2][1]), "String")])
        return lib.convert(e, self.named_type(tree[2]))

    def x_case(self, tree, scope):
        _, of, whens, other = tree
        subject = self.expr(of, scope) if of else None
        pairs = []
        for w, then in whens:
            cond = self.expr(w, scope)
            pairs.append((lib.call("Equal", [subject, cond]) if subject else coerce(cond, "Boolean"), self.expr(then, scope)))
        last = self.expr(other, scope)
        t = unify([x.t for _, x in pairs] + [last.t])
        return E("case " + " ".join(f"when {w} then {coerce(x, t)}" for w, x in pairs) + f" else {coerce(last, t)} end", t)

    # -- calls
    def x_call(self, tree, scope):
        name, args = tree[1], tree[2]
        precision = tree[3] if len(tree) > 3 else None
        fluent = len(tree) > 4
        if fluent and args[0][0] == "ref" and self.library and args[0][1] in self.library.includes and args[0][1] not in scope:
            inner = self.included(args[0][1])
            return inner.apply(name, [self.expr(a, scope) for a in args[1:]], scope, precision)
        if name == "Negate" and args[0] == ("literal", "Integer", "2147483648"):
            return E("cast(-2147483648 as int)", "Integer")
        if name == "Negate" and args[0] == ("literal", "Long", "9223372036854775808"):
            return lib.extreme("Long", False)
        if name == "Precision" and args[0][:2] == ("literal", "Decimal"):
            return E(str(len(args[0][2].partition(".")[2])), "Integer")
        if name == "Message":
            return self.message([self.expr(a, scope) for a in args])
        return self.apply(name, [self.expr(a, scope) for a in args], scope, precision)

    def message(self, args):
        """The source; what is said goes to messages with the condition under which it is."""
        self.messages.append(tuple(str(a) for a in args))
        return args[0]

    def apply(self, name, args, scope, precision=None) -> E:
        user = self.library.tree["functions"].get(name) if self.library else None
        if user:
            return self.user(name, user, args, scope)
        if name in self.externals:
            t, f = self.externals[name]
            return E(f"{f}({', '.join(map(str, args))})", t)
        if name in _AGES:
            precision, at = _AGES[name]
            if not name.startswith("Calculate"):
                patient = scope.get("Patient") or scope.get("$context")
                if patient is None or "birthDate" not in dict(patient.t[1]):
                    raise TypeFault(f"{name} needs a context with a birthDate")
                args = [dict(patient.t[1])["birthDate"], *args]
            if not at:
                args = [args[0], lib.call("Today" if base(args[0].t) == "Date" else "Now", [], None, self)]
            return lib.call("CalculateAgeAt", args, precision)
        if name in ("In", "IncludedIn") and len(args) == 2 and args[1].t == ("List", "Code") and (args[0].t in ("Code", "Concept", "String") or args[0].t in (("List", "Code"), ("List", "Concept"), ("List", "String"))):
            return lib.call("InValueSet", args, None, self)
        if name == "Minimum":
            name = "MinValue"
        name = {"Concat": "Concatenate", "Ceil": "Ceiling", "ConcatenateOperator": "Concatenate"}.get(name, name)
        if name in ("Length", "Exists", "First", "Last", "Count", "Distinct", "Flatten", "Tail") and args and args[0].t == "Any":
            args = [null("String" if name == "Length" else ("List", ("List", "Any")) if name == "Flatten" else ("List", "Any")), *args[1:]]
        if name in ("Contains", "In", "Includes", "IncludedIn", "ProperIncludes", "ProperIncludedIn", "Overlaps", "Before", "After", "Starts", "Ends", "Meets") and len(args) == 2:
            args = self.typed_nulls(name, args)
        return lib.call(name, args, precision, self)

    def typed_nulls(self, name, args):
        a, b = args
        if a.t == "Any" and b.t == "Any":
            return [null(("Interval", "Integer")), null("Integer")]
        if a.t == "Any":
            a = null(b.t if not (is_list(b.t) or is_interval(b.t)) or name not in ("In", "IncludedIn", "ProperIncludedIn") else b.t[1])
            if name in ("Contains", "Includes", "ProperIncludes") and not isinstance(b.t, tuple):
                a = null(("List", b.t))
        elif b.t == "Any":
            b = null(a.t[1] if isinstance(a.t, tuple) and name in ("Contains", "Includes", "ProperIncludes") else a.t)
            if name in ("In", "IncludedIn", "ProperIncludedIn") and not isinstance(a.t, tuple):
                b = null(("List", a.t))
        return [a, b]

    def user(self, name, overloads, args, scope):
        for operands, body, _fluent, _returns in overloads:
            if len(operands) != len(args):
                continue
            try:
                given = {n: a if isinstance(a.t, tuple) and a.t[0] == "Row" else coerce(a, self.named_type(t)) if not (isinstance(a.t, str) and base(a.t) == t) else a for (n, t), a in zip(operands, args, strict=True)}
            except TypeFault:
                continue
            if body is None and name in self.externals:
                t, f = self.externals[name]
                return E(f"{f}({', '.join(map(str, given.values()))})", t)
            if body is None:
                raise TypeFault(f"external function {name} is not registered")
            return self.nested(lambda b=body, g=given: self.expr(b, self.globals(scope) | g))
        raise TypeFault(f"no {name} for {[a.t for a in args]}")

    def x_offset(self, tree, scope):
        """[n units or more/less, more/less than] [on or] before/after."""
        _, name, left, right, quantity, relative, inclusive, precision = tree
        a, b, q = self.expr(left, scope), self.expr(right, scope), self.expr(quantity, scope)
        before = name == "before"
        point = (lib.end(a) if before else lib.start(a)) if is_interval(a.t) else a
        edge = (lib.start(b) if before else lib.end(b)) if is_interval(b.t) else b
        return c.let_both(point, edge, lambda x, y: self.offset(x, y, q, before, relative, inclusive, precision))

    def offset(self, point, edge, q, before, relative, inclusive, precision):
        far = lib.call("Subtract" if before else "Add", [edge, q])
        if relative is None:
            return lib.call("SameAs", [point, far], precision)
        if relative in ("or more", "more"):
            op = ("<=" if before else ">=") if relative == "or more" else ("<" if before else ">")
            return c.compare(point, far, op, precision)
        near_op = ("<=" if before else ">=") if inclusive else ("<" if before else ">")
        far_op = (">=" if before else "<=") if relative == "or less" else (">" if before else "<")
        return E(f"({edge} is not null and {c.compare(point, far, far_op, precision)} and {c.compare(point, edge, near_op, precision)})", "Boolean")

    # -- queries over arrays
    def x_query(self, tree, scope):
        q = tree[1]
        sources = [(self.expr(s, scope), alias) for s, alias in q["sources"]]
        scalar = all(not is_list(s.t) for s, _ in sources)
        sources = [(s if is_list(s.t) else E(f"case when {s} is not null then array({s}) end", ("List", s.t)), alias) for s, alias in sources]
        x = fresh("q")
        if len(sources) == 1:
            items, alias = sources[0]
            row = E(x, items.t[1])
            inner = scope | {alias: row}
        else:
            kinds = tuple((alias, s.t[1]) for s, alias in sources)
            names = [fresh("s") for _ in sources]
            body = "named_struct(" + ", ".join(f"{c.text(alias)}, {n}" for n, (_, alias) in zip(names, sources, strict=True)) + ")"
            items_sql = f"transform({sources[-1][0]}, {names[-1]} -> {body})"
            for n, (s, _) in list(zip(names, sources, strict=True))[-2::-1]:
                items_sql = f"flatten(transform({s}, {n} -> {items_sql}))"
            items = E(items_sql, ("List", ("Tuple", kinds)))
            row = E(x, items.t[1])
            inner = scope | {alias: part(row, alias) for _, alias in sources}
        for n, e in q["lets"]:
            inner[n] = self.expr(e, inner)
        for kind, source, alias, cond in q["links"]:
            other = self.expr(source, scope)
            y = fresh("w")
            found = f"coalesce(exists({other}, {y} -> coalesce({self.expr(cond, inner | {alias: E(y, other.t[1])})}, false)), false)"
            items = E(f"filter({items}, {x} -> {'' if kind == 'with' else 'not '}{found})", items.t)
        if q["where"]:
            items = E(f"filter({items}, {x} -> {coerce(self.expr(q['where'], inner), 'Boolean')})", items.t)
        if q["return"]:
            out = self.expr(q["return"], inner)
            items = E(f"transform({items}, {x} -> {out})", ("List", out.t))
            if q["distinct"]:
                items = E(f"array_distinct({items})", items.t)
        if q["aggregate"]:
            name, seed, body, distinct = q["aggregate"]
            if distinct:
                items = E(f"array_distinct({items})", items.t)
            acc = fresh("acc")
            start = self.expr(seed, scope)
            first = self.expr(body, inner | {name: E(acc, start.t)})
            t = unify([start.t, first.t])
            step = coerce(self.expr(body, inner | {name: E(acc, t)}), t)
            return E(f"aggregate({items}, {coerce(start, t)}, ({acc}, {x}) -> {step})", t)
        for key, descending in reversed(q["sort"] or []):
            items = lib.sort_list(items, (lambda e, k=key: self.expr(k, self.fields(e, inner) | {"$this": e})) if key else None, descending)
        if scalar:
            return lib.call("SingletonFrom", [items])
        return items

    def fields(self, e: E, scope):
        if isinstance(e.t, tuple) and e.t[0] == "Tuple":
            return scope | {n: part(e, n) for n, _ in e.t[1]}
        return scope


def evaluate(spark, text: str, **how):
    """One expression's value, as a frame of one row and the column result."""
    e = Compiler(**how).compile(text)
    return spark.range(1).selectExpr(f"{e} as result")


__all__ = ["PRECISIONS", "Compiler", "Library", "evaluate"]
