"""Models: resource types as frames with typed fields and the context they belong to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from medspan.functions.core import E


_PAIR = re.compile(r"named_struct\('low', `([^`]+)`, 'high', `([^`]+)`, 'lc', true, 'hc', true\)")


_CAST = re.compile(r"cast\((\w+) as decimal\(28,8\)\)")


def field_columns(name: str, sql) -> list[str]:
    """Select items that give a field a name; a number that is cast keeps the column it is cast from beside it."""
    if isinstance(sql, tuple):
        return [f"{sql[0]} as `{name}__low`", f"{sql[1]} as `{name}__high`"]
    raw = raw_of(sql)
    return [f"{sql} as `{name}`"] + ([f"{raw} as `{name}__raw`"] if raw else [])


def field_value(name: str, sql, t) -> E:
    """The field as an expression over those columns."""
    if isinstance(sql, tuple):
        return E(f"named_struct('low', `{name}__low`, 'high', `{name}__high`, 'lc', true, 'hc', true)", t)
    return E(f"`{name}`", t, raw=f"`{name}__raw`" if raw_of(sql) else None)


def raw_of(sql) -> str | None:
    """The column that a number is cast from."""
    if isinstance(sql, E):
        return sql.raw
    found = _CAST.fullmatch(sql)
    return found[1] if found else None


def source_of(e: E):
    """An expression as field_columns takes it."""
    pair = _PAIR.fullmatch(e.sql)
    return (f"`{pair[1]}`", f"`{pair[2]}`") if pair else e


@dataclass
class Resource:
    """frame: the rows. fields: name to (SQL over the frame, type); a closed interval whose
    bounds are never null may be given as (low, high), and then stays two plain columns. context: SQL of the
    context's id, or null for types that reach it through another: (field, parent type,
    parent's field). code: the primary code path."""

    frame: DataFrame
    fields: dict
    context: str | None = None
    through: tuple | None = None
    code: str | None = None


@dataclass
class Model:
    """resources by type; context: the type whose rows are the population; value_sets: a
    frame (vs_id, system, code), or a dict of name to [(system, code)]."""

    resources: dict
    context: str
    key: str
    value_sets: object = field(default_factory=dict)

    def rows(self, kind: str, direct: bool = False) -> DataFrame:
        """Columns ctx and the fields of a type; direct: without a context of its own."""
        r = self.resources[kind]
        frame = r.frame
        if r.context or direct:
            return frame.selectExpr(*([f"{r.context} as ctx"] if r.context and not direct else []), *[x for n, (e, _) in r.fields.items() for x in field_columns(n, e)])
        of, parent, at = r.through
        up = self.rows(parent).selectExpr("ctx", f"`{at}` as __up")
        own = frame.selectExpr(*[x for n, (e, _) in r.fields.items() for x in field_columns(n, e)])
        return own.join(up, own[of] == up["__up"]).drop("__up")

    def scope(self, kind: str, prefix: str) -> E:
        """A row of a type whose fields are columns with a prefix."""
        return E(prefix, ("Row", tuple((n, field_value(f"{prefix}__{n}", e, t)) for n, (e, t) in self.resources[kind].fields.items())))


def union_models(*models: Model) -> Model:
    """Several sources as one model: of each type the rows of all that have it, with the fields of the first."""
    first = models[0]
    out = {}
    for kind in dict.fromkeys(k for m in models for k in m.resources):
        own = [m.resources[kind] for m in models if kind in m.resources]
        frame = own[0].frame
        for r in own[1:]:
            frame = frame.unionByName(r.frame.select(*[c for c in r.frame.columns if c in frame.columns]), allowMissingColumns=True)
        out[kind] = replace(own[0], frame=frame)
    return replace(first, resources=out)
