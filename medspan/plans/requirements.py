"""What a library reads, and its tree as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.plans.compiler import Library


def _walk(tree):
    if isinstance(tree, tuple):
        yield tree
    items = tree.values() if isinstance(tree, dict) else tree if isinstance(tree, (tuple, list)) else ()
    for x in items:
        yield from _walk(x)


def _type_of(tree, lib: Library, depth: int = 0) -> str | None:
    """The resource type of a source's elements, where it can be told from the tree."""
    if not isinstance(tree, tuple) or not tree or depth > 60:
        return None
    if tree[0] == "retrieve":
        return tree[1]
    if tree[0] == "ref":
        return _type_of(lib.tree["defines"].get(tree[1]), lib, depth + 1)
    if tree[0] == "query" and not tree[1]["return"] and not tree[1]["aggregate"] and len(tree[1]["sources"]) == 1:
        return _type_of(tree[1]["sources"][0][0], lib, depth + 1)
    if tree[0] == "paren":
        return _type_of(tree[1], lib, depth + 1)
    return _type_of(tree[2][0], lib, depth + 1) if tree[0] == "call" and tree[2] else None


def _fields(lib: Library):
    """(type, field) of what queries read of their aliases, and of First, Last and other refs."""
    for node in _walk(lib.tree):
        if node and node[0] == "query":
            q = node[1]
            types = {alias: _type_of(s, lib) for s, alias in q["sources"]} | {alias: _type_of(s, lib) for _, s, alias, _ in q["links"]}
            for p in _walk(q):
                if len(p) == 3 and p[0] == "property" and p[1][0] == "ref" and types.get(p[1][1]):
                    yield types[p[1][1]], p[2]
        elif len(node) == 3 and node[0] == "property" and (kind := _type_of(node[1], lib)):
            yield kind, node[2]


def requirements(library: Library) -> list[dict]:
    """Each resource type with its code filters and the fields that are read of it, merged."""
    out: dict[str, dict] = {}
    for lib in (library, *library.includes.values()):
        for node in _walk(lib.tree):
            if node and node[0] == "retrieve":
                entry = out.setdefault(node[1], {"type": node[1], "code_filters": [], "fields": []})
                if node[3] is not None:
                    terms = node[3]
                    name = terms[1] if terms[0] == "ref" else None
                    found = {"path": node[2], "value_set": lib.tree["valuesets"].get(name), "code": lib.tree["codes"].get(name, (None, name))[1] if name not in lib.tree["valuesets"] else None}
                    if found not in entry["code_filters"]:
                        entry["code_filters"].append(found)
    for lib in (library, *library.includes.values()):
        for kind, field in _fields(lib):
            if kind in out and field not in out[kind]["fields"]:
                out[kind]["fields"] = sorted([*out[kind]["fields"], field])
    return [out[k] for k in sorted(out)]


def dump(library: Library) -> str:
    """The parsed tree as JSON, with those of the libraries that it includes."""
    return json.dumps(library.tree | {"included": {alias: json.loads(dump(x)) for alias, x in library.includes.items()}})


def _tuples(x):
    if isinstance(x, list):
        items = [_tuples(i) for i in x]
        return tuple(items) if items and isinstance(items[0], str) else items
    return {k: _tuples(v) for k, v in x.items()} if isinstance(x, dict) else x


def restore(text: str) -> Library:
    """A library from its JSON."""
    library = Library.__new__(Library)
    tree = json.loads(text)
    included = tree.pop("included", {})
    library.tree = {k: _tuples(v) for k, v in tree.items()}
    library.tree["includes"] = [tuple(x) for x in tree["includes"]]
    library.name, library.includes = tree["name"], {alias: restore(json.dumps(x)) for alias, x in included.items()}
    return library


def messages(df: DataFrame, said: list[tuple]) -> DataFrame:
    """Rows of what Message calls say where their condition holds: code, severity and text. said: a compiler's messages."""
    out = None
    for parts in said:
        condition, code, severity, text = (list(parts[1:]) + ["true", "null", "'Message'", "null"][len(parts) - 1 :])[:4]
        rows = df.where(condition).select(*[F.expr(f"cast({x} as string)").alias(n) for x, n in ((code, "code"), (severity, "severity"), (text, "text"))])
        out = rows if out is None else out.unionByName(rows)
    return out
