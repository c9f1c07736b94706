"""Expressions and what they must give, evaluated by Spark; null is written null."""

import pytest

from medspan.functions import core
from medspan.functions.core import TypeFault
from medspan.functions.library import OPS
from medspan.plans.compiler import Compiler, Library
from medspan.syntax.lexer import SyntaxFault
from medspan.syntax.parser import parse_expression

CASES = """
1 + 2 * 3 ^ 2 => 19.0
2147483647 + 1 => null
-2147483648 - 1 => null
9223372036854775807L + 1L => null
7 div 2 => 3
(-7) div 2 => -3
(-7) mod 2 => -1
1 / 0 => null
1.5 * 0.00000002 => 0.00000003
Round(-0.5) => -1.0
Round(3.14159, 2) => 3.14
Ln(-1) => null
Exp(0) => 1.0
successor of 1.0 => 1.00000001
predecessor of @2000-01-01 => @1999-12-31
successor of @T23:59:59.999 => null
Precision(@2014-01) => 6
HighBoundary(@2020-02, 8) => @2020-02-29
LowBoundary(@2014, 6) => @2014-01
5 'mg' + 2 'mg' => 7 'mg'
1 'm' = 100 'cm' => true
1 'm' > 1 'kg' => null
5 days = 120 hours => true
null + 1 => null
true and null => null
false and null => false
true or null => true
null implies true => true
not null => null
true xor null => null
1 = null => null
1 ~ null => false
null ~ null => true
'Abc' ~ 'aBC' => true
{1, null} = {1, null} => true
{1, 2} = {2, 1} => false
Tuple { a: 1, b: null } = Tuple { a: 1, b: null } => true
@2014-01 < @2014-02-01 => true
@2014-01 < @2014-01-15 => null
@2014-01 = @2014-01-15 => null
@2014-01-01T10:00:00.000Z = @2014-01-01T12:00:00.000+02:00 => true
@2014-02-28 + 1 year => @2015-02-28
@2016-02-29 + 1 year => @2017-02-28
@2014 + 24 months => @2016
@T23:00 + 2 hours => @T01:00
years between @2020-02-29 and @2025-02-28 => 4
months between @2020-01-31 and @2020-02-29 => 0
difference in months between @2020-01-31 and @2020-02-01 => 1
difference in weeks between @2020-01-04 and @2020-01-05 => 1
days between @2014 and @2015 => null
year from @2014-05 => 2014
day from @2014-05 => null
date from @2014-05-06T10 => @2014-05-06
Interval[1, 5) = Interval[1, 4] => true
start of Interval(1, 5] => 2
end of Interval[1, null] => 2147483647
3 in Interval[1, null) => null
0 in Interval[1, null) => false
Interval[1, 5] overlaps Interval[5, 9] => true
Interval[1, 4] meets before Interval[5, 9] => true
Interval[1, 9] properly includes Interval[1, 9] => false
width of Interval[2, 9] => 7
Interval[1, 4] union Interval[5, 9] => Interval[1, 9]
Interval[1, 4] union Interval[6, 9] => null
Interval[1, 6] intersect Interval[4, 9] => Interval[4, 6]
Interval[1, 6] except Interval[4, 9] => Interval[1, 3]
Interval[1, 9] except Interval[4, 5] => null
collapse { Interval[1, 4], Interval[9, 12], Interval[5, 7], null } => { Interval[1, 7], Interval[9, 12] }
collapse { Interval[@2020-01-01, @2020-01-31], Interval[@2020-02-01, @2020-02-03] } => { Interval[@2020-01-01, @2020-02-03] }
expand Interval[1, 7] per 3 '1' => { 1, 4, 7 }
expand { Interval[1, 2], Interval[2, 3] } => { Interval[1, 1], Interval[2, 2], Interval[3, 3] }
expand Interval[@2020-01-30, @2020-02-01] per day => { @2020-01-30, @2020-01-31, @2020-02-01 }
Interval[@2020-01-05, @2020-01-09] starts 2 days or less after end of Interval[@2020-01-01, @2020-01-03] => true
@2020-01-01 3 days before @2020-01-04 => true
@2020-01-01 less than 3 days before @2020-01-04 => false
@2020-01-01 within 3 days of @2020-01-04 => true
@2020-01-31 same month as @2020-01-01 => true
@2020-03-01 same month or before @2020-03-31 => true
@2020-03-31 after month of @2020-03-01 => false
First({}) => null
Last({ 1, 2, null }) => null
{ 1, 2, 3 }[5] => null
exists { null } => false
Length(null as String) => null
IndexOf({ 1, 2 }, 3) => -1
singleton from { 1 } => 1
flatten { { 1 }, null, { 2, 3 } } => { 1, 2, 3 }
{ 1, 1, null, null } intersect { 1, null } => { 1, null }
{ 1, 2 } except { 2 } => { 1 }
null contains 1 => false
{ 1, 2, 3 } includes { 1, 3 } => true
{ 1, 2 } properly includes 1 => true
({ 3, null, 1 }) X sort desc => { 3, 1, null }
Skip({ 1, 2, 3 }, 2) => { 3 }
Take({ 1, 2, 3 }, null) => { }
Sum({ 1, null }) => 1
Sum({ 2147483647, 1 }) => null
Sum({ 1 'mg', 2 'g' }) => null
Avg({ 1.0, null, 2.0 }) => 1.5
Median({ 3, 1, 2 }) => 2
StdDev({ 1.0 }) => null
Mode({ 2, 1, 2, 1 }) => 2
AllTrue({ }) => true
AnyTrue({ null }) => false
Product({ 2, null, 4 }) => 8
GeometricMean({ 2.0, 8.0 }) => 4.0
Combine({ 'a', null, 'b' }, ',') => 'a,,b'
Split('a.b', '.') => { 'a', 'b' }
Substring('abc', 3) => null
Substring('abc', 1, 9) => 'bc'
PositionOf('z', 'abc') => -1
LastPositionOf('a', 'banana') => 5
Matches('abc', 'ab') => false
ReplaceMatches('a1b2', '([0-9])', '<$1>') => 'a<1>b<2>'
'a' & null => 'a'
'a' + null => null
convert '5' to Integer => 5
ToInteger('x') => null
ToBoolean('y') => true
ToDecimal('1.50') => 1.5
ToDate('2014-13') => null
ToDateTime('2014-01-01T10:30') => @2014-01-01T10:30
ToQuantity('5.5 \\'cm\\'') => 5.5 'cm'
ToString(1.0) => '1.0'
ToString(@2014-01) => '2014-01'
ConvertQuantity(1 'm', 'cm') => 100 'cm'
5 is Integer => true
'5' is Integer => false
1 as String => null
if null then 1 else 2 => 2
case 3 when 1 then 'a' when 3 then 'b' else 'c' end => 'b'
({ 1, 2, 3 }) X where X > 1 return X * 2 => { 4, 6 }
from { 1, 2 } A, { 10, 20 } B return all A + B => { 11, 21, 12, 22 }
({ 1, 2, 3, 4 }) N aggregate R starting 1: R * N => 24
({ 1, 2 }) A with { 2, 3 } B such that A = B => { 2 }
({ 1, 2 }) A without { 2, 3 } B such that A = B => { 1 }
(5) X return X + 1 => 6
Concept { Code '1' from "s" } ~ Concept { Code '1' from "s", Code '2' from "s" } => true
AgeInYearsAt(@2000) => null
CalculateAgeInYearsAt(@1976-01-01, @2020-01-02) => 44
days between Today() and @2020-01-05 => 3
""".strip().splitlines()


def test_expressions_give_what_they_must(spark):
    compiler, checks = Compiler(), []
    for line in CASES:
        left, _, right = line.partition(" => ")
        if left.startswith("AgeIn"):
            continue
        a, b = compiler.compile(left), compiler.compile(right)
        checks.append((line, f"coalesce({core.equal(a, b)}, ({a}) is null and ({b}) is null)"))
    for i in range(0, len(checks), 24):
        part = checks[i : i + 24]
        row = spark.range(1).selectExpr(*[f"{sql} as c{k}" for k, (_, sql) in enumerate(part)]).first()
        assert [line for (line, _), ok in zip(part, row, strict=True) if ok is not True] == []


@pytest.mark.parametrize("text", ["1 +", "Interval[1, 2", "'open", "#", "case when true then 1 end"])
def test_faults_are_told(text):
    with pytest.raises(SyntaxFault):
        parse_expression(text)


@pytest.mark.parametrize("text", ["true + 1", "nothing", "Sum({'a'})", "1 = 'a'", "Children(1)"])
def test_wrong_types_are_told(text):
    with pytest.raises(TypeFault):
        Compiler().compile(text)


def test_libraries_include_and_define(spark):
    other = "library Common define function Double(x Integer): x * 2 define \"Three\": 3"
    library = Library("library Main include Common called C parameter \"P\" Integer default 4 define \"A\": C.Double(\"P\") + C.\"Three\" define \"B\": \"A\" + 1", lambda name, version: other)
    assert spark.range(1).selectExpr(f"{Compiler(library).compile('\"B\"')}").first()[0] == 12
    assert spark.range(1).selectExpr(f"{Compiler(library, {'P': '1'}).compile('\"B\"')}").first()[0] == 6
    loop = Compiler(Library('library L define "A": "B" define "B": "A"'))
    with pytest.raises(TypeFault):
        loop.compile('"A"')


def test_external_functions_run(spark):
    spark.udf.register("twice_py", lambda x: None if x is None else 2 * x, "int")
    compiler = Compiler(Library("library L define function Twice(x Integer) returns Integer: external"), externals={"Twice": ("Integer", "twice_py")})
    assert spark.range(1).selectExpr(f"{compiler.compile('Twice(4)')}").first()[0] == 8
    with pytest.raises(TypeFault):
        Compiler(compiler.library).compile("Twice(4)")


def test_comparers_of_a_type(spark):
    by_length = core.Comparer(
        equal=lambda a, b, _: f"length({a}) = length({b})",
        equivalent=lambda a, b: f"abs(length({a}) - length({b})) < 2",
        order=lambda a, b, _: f"sign(length({a}) - length({b}))",
    )
    cases = {
        "'ab' = 'xy'": (False, True), "'ab' != 'xy'": (True, False), "'ab' ~ 'xyz'": (False, True), "'b' < 'ab'": (False, True), "'ab' between 'z' and 'aaa'": (False, True),
        "{'ab', 'c'} = {'xy', 'd'}": (False, True), "'ab' = null": (None, None), "'ab' ~ null": (False, False), "null < 'ab'": (None, None), "1 = 1": (True, True), "1 < 2": (True, True),
        "Tuple { a: 'ab' } = Tuple { a: 'xy' }": (False, True), "Interval['a', 'c'] ~ Interval['x', 'z']": (False, True),
    }
    for expression, (plain, own) in cases.items():
        with core.comparers({"String": by_length}):
            changed = Compiler().compile(expression).sql
        assert list(spark.range(1).selectExpr(Compiler().compile(expression).sql, changed).first()) == [plain, own], expression


@pytest.mark.parametrize("expression, step", [("ToDate('2014')", " + 1 year"), ("ToDateTime('2014-02')", " - 3 days"), ("Interval[ToDateTime('2013'), ToDateTime('2015-01')]", " union Interval[ToDateTime('2014'), ToDateTime('2016')]")])
def test_text_grows_by_addition(expression, step):
    """Partial dates: each step adds the same length of text, and little of it."""
    sizes = [len(Compiler().compile(expression + step * n).sql) for n in range(1, 7)]
    more = [b - a for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    assert max(more) < 1.1 * min(more) < 40_000


def test_table_is_complete():
    assert len(OPS) >= 230
