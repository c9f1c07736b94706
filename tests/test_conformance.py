"""Cases of the language by group, one file for each chapter: an expression and one that gives what it must."""

from pathlib import Path

import pytest

from medspan.functions import core
from medspan.plans.compiler import Compiler

FILES = sorted((Path(__file__).parent / "cases").glob("*.txt"))


def cases(path: Path) -> list[str]:
    return [x for x in path.read_text("utf-8").splitlines() if x and not x.startswith("#")]


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.stem)
def test_cases(spark, path):
    compiler, checks = Compiler(), []
    for line in cases(path):
        left, _, right = line.partition(" => ")
        a, b = compiler.compile(left), compiler.compile(right)
        checks.append((line, f"coalesce({core.equal(a, b)}, ({a}) is null and ({b}) is null)"))
    wrong = []
    for i in range(0, len(checks), 20):
        part = checks[i : i + 20]
        row = spark.range(1).selectExpr(*[f"{sql} as c{k}" for k, (_, sql) in enumerate(part)]).first()
        wrong += [line for (line, _), ok in zip(part, row, strict=True) if ok is not True]
    assert wrong == []


def test_enough_cases():
    assert sum(len(cases(p)) for p in FILES) > 400
