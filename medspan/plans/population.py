"""Definitions over whole populations: row-sets keyed by the context, and one value per context.

A retrieve is a scan, its terminology a predicate on it or a semi join with the
value set table; ``with`` and ``without`` are semi and anti joins on the context
with the condition as residue; several sources join on the context; sorting is
kept as keys until First, Last or a list needs it. Aggregates group by the
context and are joined to its rows once each, with what an empty list gives. Those of
definitions in the Unfiltered context are taken over all rows and joined as one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.functions import core as c
from medspan.functions import library as lib
from medspan.functions.core import E, TypeFault, base, coerce, is_interval, is_list, part
from medspan.operators import rows as row_ops
from medspan.plans.compiler import _AGES, Compiler, Library
from medspan.sources.model import Model, field_columns, field_value, source_of


@dataclass
class Rows:
    """df has ctx; item: the element, a Row of columns or a value; order: (expression, descending)."""

    df: DataFrame
    item: E
    order: list = field(default_factory=list)
    kind: str | None = None


_AGGREGATES = {"Count", "Exists", "Sum", "Avg", "Min", "Max", "Median", "Mode", "Product", "GeometricMean", "AllTrue", "AnyTrue", "StdDev", "Variance", "PopulationStdDev", "PopulationVariance", "First", "Last", "SingletonFrom", "ToList"}
_ROW_CALLS = {"Union", "Intersect", "Except", "Distinct", "Collapse", "Expand", "ListTake", "Take", "ListSkip", "Skip", "Tail", "Flatten"}


class Population(Compiler):
    """Evaluates a library's definitions for all rows of the model's context."""

    def __init__(self, model: Model, text: str | Library, parameters=None, now="2020-01-02 03:04:00Z", include=None, externals=None):
        library = text if isinstance(text, Library) else Library(text, include)
        codes = model.value_sets if isinstance(model.value_sets, dict) else {}
        super().__init__(library, parameters, now, codes, externals)
        self.model, self.done, self.spine, self.attached, self.pending, self.quiet, self.whole = model, {}, None, {}, {}, 0, False

    # -- results
    def evaluate(self, *names: str) -> DataFrame:
        """ctx and one column for each definition, for every row of the context."""
        key = self.model.resources[self.model.context].fields[self.model.key][0]
        prefix = "Patient"
        base_ = self.model.resources[self.model.context]
        if all(self.unfiltered(n) for n in names):
            self.spine = base_.frame.sparkSession.range(1).selectExpr("cast(null as string) as ctx")
        else:
            self.spine = base_.frame.selectExpr(f"{key} as ctx", *[x for n, (e, _) in base_.fields.items() for x in field_columns(f"{prefix}__{n}", e)])
        self.attached, self.pending = {}, {}
        scope = {prefix: self.model.scope(self.model.context, prefix), "$context": self.model.scope(self.model.context, prefix)}
        out = []
        for n in names:
            tree = self.library.tree["defines"][n]
            self.whole = self.unfiltered(n)
            rows = self.row_set(tree, scope)
            e = self.aggregate("ToList", rows, tree, tree) if rows is not None else self.expr(tree, scope)
            out.append(f"{e} as `{n}`")
        self.whole = False
        for (whole, _), (rows, columns) in self.pending.items():
            if whole:  # one row
                self.spine = self.spine.crossJoin(F.broadcast(rows.df.agg(*columns)))
            else:
                self.spine = self.spine.join(rows.df.groupBy("ctx").agg(*columns), "ctx", "left")
        return self.spine.selectExpr("ctx", *out)

    def row_frame(self, name: str) -> DataFrame:
        """The rows of a definition that is a list: ctx and its columns, or value."""
        rows = self.row_set(self.library.tree["defines"][name], self.outer())
        if rows is None:
            raise TypeFault(f"{name} is no list of rows")
        if isinstance(rows.item.t, tuple) and rows.item.t[0] == "Row":
            return rows.df.selectExpr("ctx", *[f"{e} as `{n}`" for n, e in rows.item.t[1]])
        return rows.df.selectExpr("ctx", f"{rows.item} as value")

    def unfiltered(self, name: str) -> bool:
        """Whether a definition stands in the Unfiltered context: of all rows, whoever they belong to."""
        return self.library.tree.get("contexts", {}).get(name) == "Unfiltered"

    def x_ref(self, tree, scope):
        name, before = tree[1], self.whole
        if name in scope or name not in self.library.tree["defines"]:
            return super().x_ref(tree, scope)
        self.whole = self.unfiltered(name)
        if before and not self.whole:
            raise TypeFault(f"{name} has a value for each row of the context")
        try:
            return super().x_ref(tree, scope)
        finally:
            self.whole = before

    def outer(self):
        s = self.model.scope(self.model.context, "Patient")
        return {"Patient": s, "$context": s}

    # -- the hook of the row compiler
    def rows(self, tree, scope):
        if self.quiet or self.spine is None:
            return None
        if tree[0] == "call" and tree[1] in _AGGREGATES and len(tree[2]) == 1 and len(tree) <= 4:
            got = self.row_set(tree[2][0], scope)
            if got is not None:
                return self.aggregate(tree[1], got, tree, tree[2][0])
        if tree[0] == "query" and tree[1]["aggregate"]:
            got = self.row_set(("query", tree[1] | {"aggregate": None, "sort": None}), scope, keep=True)
            if got is not None:
                return self.fold(got, tree, scope)
        if tree[0] in ("retrieve", "query") or tree[0] == "call" and tree[1] in _ROW_CALLS or tree[0] == "ref" and tree[1] not in scope and tree[1] in self.library.tree["defines"]:
            got = self.row_set(tree, scope)
            if got is not None:
                return self.aggregate("ToList", got, tree, tree)
        return None

    # -- row-sets
    def row_set(self, tree, scope, keep=False) -> Rows | None:
        """The row-set that a tree is, or null."""
        kind = tree[0]
        if kind == "paren":
            return self.row_set(tree[1], scope)
        if kind == "retrieve":
            return self.retrieve(tree, scope)
        if kind == "ref" and tree[1] not in scope and tree[1] in self.library.tree["defines"]:
            name = tree[1]
            if name not in self.done:
                self.done[name] = self.nested(lambda: self.row_set(self.library.tree["defines"][name], self.globals(scope)))
            return self.done[name]
        if kind == "query":
            return self.query_rows(tree, scope)
        if kind == "call" and tree[1] in _ROW_CALLS:
            return self.call_rows(tree, scope)
        if kind == "property":
            rows = self.row_set(tree[1], scope)
            if rows is not None:
                e = dict(rows.item.t[1])[tree[2]] if rows.item.t[0] == "Row" else part(rows.item, tree[2])
                return Rows(rows.df.selectExpr("ctx", f"{e} as value").where("value is not null"), E("value", e.t, e.p))
        return None

    def retrieve(self, tree, scope, direct=False) -> Rows:
        _, kind, path, terms = tree
        r = self.model.resources.get(kind)
        if r is None:
            raise TypeFault(f"no resource type {kind}")
        df = self.model.rows(kind, direct)
        item = E(kind, ("Row", tuple((n, field_value(n, e, t)) for n, (e, t) in r.fields.items())))
        if terms:
            df = self.coded(df, r, path or r.code, terms, scope)
        return Rows(df, item, kind=kind)

    def coded(self, df, r, path, terms, scope) -> DataFrame:
        """Rows whose code is in a terminology: a predicate for listed codes, a semi join for a value set table."""
        if path not in r.fields:
            raise TypeFault(f"no code path {path}")
        column = E(f"`{path}`", r.fields[path][1])
        sets = self.library.tree["valuesets"]
        if terms[0] == "ref" and terms[1] in sets and not isinstance(self.model.value_sets, dict):
            codes = self.model.value_sets.where(F.lower("vs_id") == sets[terms[1]].lower()).selectExpr("lower(code) as __code", "lower(system) as __system").distinct()
            return row_ops.coded_in(df, column, codes)
        e = self.expr(terms, scope)
        if e.t == "Code":
            e = lib.call("ToList", [e])
        if is_list(e.t) and e.t[1] == "Concept":
            e = lib.call("Flatten", [part(e, "codes")])
        if column.t == "String":
            listed = self.listed(terms)
            if listed is not None:
                return df.where(F.col(path).isin([x for _, x in listed]))
        return df.where(str(lib.call("InValueSet", [column, e], None, self)))

    def listed(self, terms):
        """The codes of a value set or code by name."""
        if terms[0] != "ref":
            return None
        name = terms[1]
        if name in self.library.tree["valuesets"]:
            url = self.library.tree["valuesets"][name]
            return self.codes.get(url, self.codes.get(url.partition("|")[0], self.codes.get(name)))
        if name in self.library.tree["codes"]:
            return [(None, self.library.tree["codes"][name][1])]
        return None

    def aliased(self, rows: Rows, alias: str) -> tuple[DataFrame, E]:
        """Rows with columns of their own names under an alias."""
        if isinstance(rows.item.t, tuple) and rows.item.t[0] == "Row":
            columns = [x for n, e in rows.item.t[1] for x in field_columns(f"{alias}__{n}", source_of(e))]
            item = E(alias, ("Row", tuple((n, field_value(f"{alias}__{n}", source_of(e), e.t)) for n, e in rows.item.t[1])))
        else:
            columns = [f"{rows.item} as `{alias}__value`"]
            item = E(f"`{alias}__value`", rows.item.t, rows.item.p)
        orders = [f"{e} as `{alias}__order{i}`" for i, (e, _) in enumerate(rows.order)]
        return rows.df.selectExpr(*(["ctx"] if "ctx" in rows.df.columns else []), *columns, *orders), item

    def query_rows(self, tree, scope) -> Rows | None:
        q = tree[1]
        if q["aggregate"]:
            return None
        sources = [(self.row_set(s, scope), alias) for s, alias in q["sources"]]
        if all(s is None for s, _ in sources):
            return None
        df, inner, rows_of = None, dict(scope), sources[0][0]
        arrays = []
        for s, alias in sources:
            if s is None:
                arrays.append((alias, self.quietly(next(x for x, a in q["sources"] if a == alias), scope)))
                continue
            more, item = self.aliased(s, alias)
            inner[alias] = item
            if df is not None and self.whole:
                raise TypeFault("several sources need a context")
            df = more if df is None else df.join(more, "ctx")
        for alias, e in arrays:
            items = e if is_list(e.t) else lib.call("ToList", [e])
            df = df.selectExpr("*", f"explode({items}) as `{alias}__value`")
            inner[alias] = E(f"`{alias}__value`", items.t[1])
        df, inner = self.with_context(df, q, inner)
        for n, e in q["lets"]:
            inner[n] = self.quietly(e, inner)
        for kind, source, alias, cond in q["links"]:
            df = self.link(df, inner, kind, source, alias, cond, scope)
        if q["where"]:
            df = self.filtered(df, q["where"], inner, scope)
        order = [(E(f"`{sources[0][1]}__order{i}`", e.t), d) for i, (e, d) in enumerate(rows_of.order)] if rows_of is not None and len(sources) == 1 else []
        if q["return"]:
            value = self.quietly(q["return"], inner)
            if isinstance(value.t, tuple) and value.t[0] == "Row":
                out = Rows(df, value, order)
            else:
                keys = [f"{e} as __k{i}" for i, (e, _) in enumerate(order)]
                df = df.selectExpr("ctx", f"{value} as value", *keys)
                out = Rows(df, E("value", value.t, value.p), [(E(f"__k{i}", e.t), d) for i, (e, d) in enumerate(order)])
                if q["distinct"]:
                    out = Rows(df.select("ctx", "value").distinct(), out.item)
        elif len(sources) == 1 and not arrays:
            out = Rows(df, inner[sources[0][1]], order, rows_of.kind)
        else:
            fields = [(alias, inner[alias]) for _, alias in q["sources"]]
            flat = tuple((f"{a}_{n}", e) for a, x in fields for n, e in (x.t[1] if x.t[0] == "Row" else (("value", x),)))
            out = Rows(df, E("all", ("Row", flat)))
        if q["sort"]:
            keys = []
            for key, descending in q["sort"]:
                names = {n: e for n, e in out.item.t[1]} if isinstance(out.item.t, tuple) and out.item.t[0] == "Row" else {n: part(out.item, n) for n, _ in out.item.t[1]} if isinstance(out.item.t, tuple) and out.item.t[0] == "Tuple" else {}
                keys.append((self.quietly(key, scope | names | {"$this": out.item}) if key else out.item, descending))
            out = replace(out, order=keys)
        return out

    def with_context(self, df, q, inner):
        """Joins the context's own columns where the query names them."""
        if not self.names_context((q["lets"], q["links"], q["where"], q["return"], q["sort"]), set(inner) - {"Patient"}):
            return df, inner
        r = self.model.resources[self.model.context]
        own = r.frame.selectExpr(f"{r.fields[self.model.key][0]} as ctx", *[x for n, (e, _) in r.fields.items() for x in field_columns(f"Patient__{n}", e)])
        return df.join(own, "ctx"), inner

    def names_context(self, tree, bound, seen=frozenset()) -> bool:
        """Whether a tree refers to the context's row: itself, by an age, or through definitions and functions. bound: names that stand for something else."""
        if isinstance(tree, dict):
            return any(self.names_context(x, bound, seen) for x in tree.values())
        if not isinstance(tree, (tuple, list)):
            return False
        through = None
        if len(tree) > 1 and tree[0] == "ref" and isinstance(tree[1], str) and tree[1] not in bound:
            if tree[1] == "Patient":
                return True
            through = self.library.tree["defines"].get(tree[1])
        elif len(tree) > 2 and tree[0] == "call":
            if tree[1] in _AGES and not tree[1].startswith("Calculate"):
                return True
            through = [body for _, body, *_ in self.library.tree["functions"].get(tree[1], [])]
        elif len(tree) == 2 and tree[0] == "query":
            bound = {*bound, *(a for _, a in tree[1]["sources"]), *(n for n, _ in tree[1]["lets"]), *(a for _, _, a, _ in tree[1]["links"])}
        if through and tree[1] not in seen and self.names_context(through, (), seen | {tree[1]}):
            return True
        return any(self.names_context(x, bound, seen) for x in tree)

    def quietly(self, tree, scope) -> E:
        """An expression over the columns at hand, without plans of its own."""
        self.quiet += 1
        try:
            return self.expr(tree, scope)
        finally:
            self.quiet -= 1

    def link(self, df, inner, kind, source, alias, cond, scope) -> DataFrame:
        rows, direct = None, False
        if source[0] == "retrieve":
            r = self.model.resources.get(source[1])
            if r is not None and r.through and not r.context and self.by_parent(cond, alias, r, inner):
                rows, direct = self.retrieve(source, scope, direct=True), True
        rows = rows or self.row_set(source, scope)
        if rows is None:
            items = self.quietly(source, inner)
            y = c.fresh("w")
            found = f"coalesce(exists({items}, {y} -> coalesce({self.quietly(cond, inner | {alias: E(y, items.t[1])})}, false)), false)"
            return df.where(found if kind == "with" else f"not {found}")
        more, item = self.aliased(rows, alias)
        more = more.withColumnRenamed("ctx", "__ctx") if not direct else more
        such = F.expr(str(coerce(self.quietly(cond, inner | {alias: item}), "Boolean")))
        on = such if direct or self.whole else (F.col("ctx") == F.col("__ctx")) & such
        return df.join(more, on, "left_semi" if kind == "with" else "left_anti")

    def by_parent(self, cond, alias, r, inner) -> bool:
        """Whether the condition ties a type to its parent by the parent's id, so that the context follows."""
        of, _parent, at = r.through

        def ties(t):
            if t[0] == "call" and t[1] == "And":
                return any(ties(x) for x in t[2])
            if t[0] == "call" and t[1] == "Equal":
                a, b = t[2]
                sides = [(x[1][1], x[2]) for x in (a, b) if x[0] == "property" and x[1][0] == "ref"]
                return (alias, of) in sides and any(n != alias and p_ == at and n in inner for n, p_ in sides)
            return False

        return ties(cond)

    def filtered(self, df, cond, inner, scope) -> DataFrame:
        """A where clause: its exists parts over row-sets become semi and anti joins."""
        parts, todo = [], [cond]
        while todo:
            t = todo.pop()
            if t[0] == "call" and t[1] == "And":
                todo += t[2]
                continue
            negate, inner_t = (True, t[2][0]) if t[0] == "call" and t[1] == "Not" else (False, t)
            if inner_t[0] == "call" and inner_t[1] == "Exists":
                got = self.exists_join(df, inner_t[2][0], inner, scope, negate)
                if got is not None:
                    df = got
                    continue
            parts.append(t)
        for t in reversed(parts):
            df = df.where(str(coerce(self.quietly(t, inner), "Boolean")))
        return df

    def exists_join(self, df, tree, inner, scope, negate):
        if tree[0] == "paren":
            tree = tree[1]
        if tree[0] == "query" and len(tree[1]["sources"]) == 1 and not tree[1]["links"] and not tree[1]["return"] and not tree[1]["lets"]:
            (source, alias), cond = tree[1]["sources"][0], tree[1]["where"] or ("literal", "Boolean", "true")
        elif tree[0] == "retrieve":
            source, alias, cond = tree, c.fresh("e"), ("literal", "Boolean", "true")
        else:
            return None
        if source[0] != "retrieve" and self.row_set(source, scope) is None:
            return None
        return self.link(df, inner, "without" if negate else "with", source, alias, cond, scope)

    def call_rows(self, tree, scope) -> Rows | None:
        name = tree[1]
        first = self.row_set(tree[2][0], scope)
        if first is None:
            return None
        if name in ("Union", "Intersect", "Except"):
            second = self.row_set(tree[2][1], scope)
            if second is None:
                return None
            a, b = self.plain(first), self.plain(second)
            item = a.item
            if name == "Union":
                if isinstance(item.t, tuple) and item.t[0] == "Row" and isinstance(b.item.t, tuple) and b.item.t[0] == "Row":
                    item = E(item.sql, ("Row", tuple((dict(b.item.t[1]) | dict(item.t[1])).items())))
                return Rows(a.df.unionByName(b.df, allowMissingColumns=True).distinct(), item, kind=first.kind)
            return Rows(a.df.distinct().join(b.df.distinct(), a.df.columns, "left_semi") if name == "Intersect" else a.df.distinct().join(b.df, a.df.columns, "left_anti"), item, kind=first.kind)
        if name == "Distinct":
            return replace(first, df=self.plain(first).df.distinct(), item=self.plain(first).item)
        if name == "Collapse":
            per = self.expr(tree[2][1], scope) if len(tree[2]) > 1 else None
            if not is_interval(first.item.t):
                return None
            return Rows(row_ops.collapse(first.df, first.item, per), E("value", ("Interval", first.item.t[1])))
        if name == "Expand" and is_interval(first.item.t):
            merged = row_ops.collapse(first.df, first.item, None)
            per = [self.expr(x, scope) for x in tree[2][1:]]
            units = lib.call("Expand", [lib.call("ToList", [E("value", ("Interval", first.item.t[1]))]), *per])
            return Rows(merged.selectExpr("ctx", f"explode({units}) as value"), E("value", units.t[1]))
        if name in ("ListTake", "Take", "ListSkip", "Skip", "Tail") and first.order:
            n = E("1", "Integer") if name == "Tail" else self.expr(tree[2][1], scope)
            return Rows(row_ops.limit(first.df, self.keys(first), str(n), skip=name in ("ListSkip", "Skip", "Tail")), first.item, first.order, first.kind)
        if name == "Flatten" and is_list(first.item.t):
            return Rows(first.df.selectExpr("ctx", f"explode({first.item}) as value"), E("value", first.item.t[1]))
        return None

    def plain(self, rows: Rows) -> Rows:
        """Rows with only their own columns."""
        if isinstance(rows.item.t, tuple) and rows.item.t[0] == "Row":
            fields = [(n, replace(e, raw=None)) for n, e in rows.item.t[1]]
            df = rows.df.selectExpr("ctx", *[x for n, e in fields for x in field_columns(n, source_of(e))])
            return Rows(df, E(rows.item.sql, ("Row", tuple((n, field_value(n, source_of(e), e.t)) for n, e in fields))), kind=rows.kind)
        return Rows(rows.df.selectExpr("ctx", f"{rows.item} as value"), E("value", rows.item.t, rows.item.p), kind=rows.kind)

    def keys(self, rows: Rows) -> list[tuple[str, bool]]:
        return [(lib.sort_key(e), d) for e, d in rows.order]

    # -- one value per context
    def packed(self, rows: Rows) -> E:
        if isinstance(rows.item.t, tuple) and rows.item.t[0] == "Row":
            fields = rows.item.t[1]
            return E("named_struct(" + ", ".join(f"{c.text(n)}, {e}" for n, e in fields) + ")", ("Tuple", tuple((n, e.t) for n, e in fields)))
        return rows.item

    def aggregate(self, name: str, rows: Rows, tree, source) -> E:
        """A column of the spine with an aggregate of a row-set; aggregates of one source are taken together."""
        mark = f"{name}|{self.whole}|{tree!r}"
        if mark not in self.attached:
            rows, columns = self.pending.setdefault((self.whole, repr(source)), (rows, []))
            value = self.packed(rows)
            column = f"a{len(self.attached)}"
            how, t, empty = row_ops.AGGREGATES[name](value, self.keys(rows))
            columns.append(F.expr(how).alias(column))
            self.attached[mark] = E(f"coalesce({column}, {empty})" if empty else column, t)
        return self.attached[mark]

    def fold(self, rows: Rows, tree, scope) -> E:
        """The aggregate clause: a fold over the context's sorted list."""
        q = tree[1]
        items = self.aggregate("ToList", rows, ("fold", repr(tree)), ("fold", repr(tree)))
        alias = q["sources"][0][1]
        return Compiler.x_query(self, ("query", {"sources": [(("given",), alias)], "lets": [], "links": [], "where": None, "return": None, "distinct": False, "aggregate": q["aggregate"], "sort": None}), scope | {"$given": items})

    def x_given(self, tree, scope):
        return scope["$given"]
