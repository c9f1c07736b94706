"""Libraries of a folder, found by name and version."""

from __future__ import annotations

import re
from pathlib import Path

from medspan.functions.core import TypeFault
from medspan.plans.compiler import Library

_HEAD = re.compile(r"^\s*library\s+(\"[^\"]+\"|[\w.]+)(?:\s+version\s+'([^']*)')?", re.M)


class Folder:
    """The ``*.cql`` files under a folder; called with a name and a version, gives the text, as Library's include does.

    Without a version the highest one is taken, number by number; a library without one is the lowest."""

    def __init__(self, path: str):
        self.texts: dict[str, dict[str | None, str]] = {}
        for f in sorted(Path(path).rglob("*.cql")):
            text = f.read_text("utf-8-sig")
            head = _HEAD.search(text)
            name, version = (head[1].strip('"'), head[2]) if head else (f.stem, None)
            if version in self.texts.setdefault(name, {}):
                raise TypeFault(f"{name} {version or ''} is there twice: {f}")
            self.texts[name][version] = text

    def __call__(self, name: str, version: str | None = None) -> str:
        found = self.texts.get(name, {})
        if version is not None and version not in found or not found:
            raise TypeFault(f"no library {name} {version or ''}")
        return found[version if version is not None else max(found, key=_order)]

    def library(self, name: str, version: str | None = None) -> Library:
        """A library with all that it includes."""
        return Library(self(name, version), self)


def _order(version: str | None):
    return [] if version is None else [(0, int(x), "") if x.isdigit() else (-1, 0, x) for x in re.split(r"[.-]", version)]
