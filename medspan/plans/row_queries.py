"""Operators on the rows of a table: (name, table, expression, SQL of the same value).

Each becomes a query of the table's keys and the column result. Decimals come out as
doubles, dates and times as text, lists of either as text.
"""

from __future__ import annotations

from medspan.functions import core as c
from medspan.functions import library as lib
from medspan.functions.core import E, base, is_interval, is_list
from medspan.plans.compiler import Compiler
from medspan.sources import tables

SPECS = [
    # arithmetic
    ("math_abs", "customer", "Abs(balance)", "CAST(abs(c_acctbal) AS DOUBLE)"),
    ("math_add_integer", "part", "size + 2147483640", "CASE WHEN p_size > 7 THEN NULL ELSE CAST(p_size + 2147483640 AS INT) END"),
    ("math_add_decimal", "lineitem", "price + quantity", "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE)"),
    ("math_add_quantity", "lineitem", "(Quantity(quantity, 'mg') + 5 'mg').value", "CAST(l_quantity + 5 AS DOUBLE)"),
    ("math_subtract", "lineitem", "price - quantity", "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE)"),
    ("math_multiply", "lineitem", "price * discount", "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DOUBLE)"),
    ("math_multiply_overflow", "part", "size * 100000000", "CASE WHEN p_size > 21 THEN NULL ELSE CAST(p_size * 100000000 AS INT) END"),
    ("math_divide", "lineitem", "price / 8", "l_extendedprice / 8"),
    ("math_divide_zero", "part", "10.0 / (size mod 2)", "CASE WHEN p_size % 2 = 0 THEN NULL ELSE 10.0::DOUBLE END"),
    ("math_truncated_divide", "part", "size div 7", "p_size // 7"),
    ("math_truncated_divide_negative", "part", "(-size) div 7", "-(p_size // 7)"),
    ("math_modulo", "part", "(-size) mod 7", "-(p_size % 7)"),
    ("math_negate", "part", "-size", "-p_size"),
    ("math_power", "part", "Power(size, 2)", "CAST(p_size * p_size AS DOUBLE)"),
    ("math_exp", "part", "Round(Exp(size / 50.0), 4)", "round(exp(p_size / 50.0), 4)"),
    ("math_ln", "part", "Round(Ln(size), 4)", "round(ln(p_size), 4)"),
    ("math_log", "part", "Round(Log(size, 2), 4)", "round(log2(p_size), 4)"),
    ("math_round", "lineitem", "Round(price, 1)", "CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE)"),
    ("math_truncate", "customer", "Truncate(balance)", "CAST(trunc(c_acctbal) AS INT)"),
    ("math_ceiling", "customer", "Ceiling(balance)", "CAST(ceil(CAST(c_acctbal AS DECIMAL(18,2))) AS INT)"),
    ("math_floor", "customer", "Floor(balance)", "CAST(floor(CAST(c_acctbal AS DECIMAL(18,2))) AS INT)"),
    ("math_successor", "part", "successor of size", "p_size + 1"),
    ("math_successor_date", "orders", "ToString(successor of day)", "CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR)"),
    ("math_predecessor", "part", "predecessor of size", "p_size - 1"),
    ("math_predecessor_date", "orders", "ToString(predecessor of day)", "CAST(CAST(o_orderdate AS DATE) - 1 AS VARCHAR)"),
    ("math_min_value", "part", "minimum Integer + size", "CAST(-2147483648 + p_size AS INT)"),
    ("math_max_value", "part", "maximum Integer - size", "CAST(2147483647 - p_size AS INT)"),
    ("math_precision", "part", "Precision(price)", "CAST(length(regexp_replace(split_part(CAST(CAST(p_retailprice AS DECIMAL(18,8)) AS VARCHAR), '.', 2), '0+$', '')) AS INT)"),
    ("math_low_boundary", "orders", "ToString(LowBoundary(day, 6))", "strftime(o_orderdate, '%Y-%m')"),
    ("math_high_boundary", "orders", "ToString(HighBoundary(Date(year from day, month from day), 8))", "CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR)"),
    # strings
    ("string_combine", "part", "Combine({name, brand, null}, '-')", "p_name || '-' || p_brand || '-'"),
    ("string_concatenate", "part", "name + brand", "p_name || p_brand"),
    ("string_concatenate_loose", "part", "name & null & brand", "p_name || p_brand"),
    ("string_ends_with", "part", "EndsWith(name, 'ring')", "ends_with(p_name, 'ring')"),
    ("string_starts_with", "part", "StartsWith(name, 'small')", "starts_with(p_name, 'small')"),
    ("string_position_of", "part", "PositionOf('r', name)", "CAST(instr(p_name, 'r') - 1 AS INT)"),
    ("string_last_position_of", "part", "LastPositionOf('r', name)", "CAST(CASE WHEN instr(p_name, 'r') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'r') END AS INT)"),
    ("string_lower", "part", "Lower(type)", "lower(p_type)"),
    ("string_upper", "part", "Upper(name)", "upper(p_name)"),
    ("string_matches", "part", "Matches(brand, 'Brand#[1-3]')", "regexp_full_match(p_brand, 'Brand#[1-3]')"),
    ("string_replace_matches", "part", "ReplaceMatches(brand, '[0-9]+', 'N')", "regexp_replace(p_brand, '[0-9]+', 'N', 'g')"),
    ("string_split", "part", "Split(name, ' ')", "array_to_string(string_split(p_name, ' '), '|')"),
    ("string_split_on_matches", "part", "SplitOnMatches(brand, '#')", "array_to_string(regexp_split_to_array(p_brand, '#'), '|')"),
    ("string_substring", "part", "Substring(name, 2, 3)", "CASE WHEN length(p_name) > 2 THEN substr(p_name, 3, 3) END"),
    ("string_substring_to_end", "part", "Substring(name, 6)", "CASE WHEN length(p_name) > 6 THEN substr(p_name, 7) END"),
    ("string_indexer", "part", "name[4]", "CASE WHEN length(p_name) > 4 THEN substr(p_name, 5, 1) END"),
    ("string_length", "documents", "Length(text)", "CAST(length(text) AS INT)"),
    # dates and times
    ("date_date", "orders", "ToString(Date(year from date, 2))", "strftime(o_orderdate, '%Y') || '-02'"),
    ("date_date_time", "orders", "ToString(DateTime(year from date, 3, 4, 5))", "strftime(o_orderdate, '%Y') || '-03-04T05'"),
    ("date_time", "part", "ToString(Time(size mod 24, 30))", "lpad(CAST(p_size % 24 AS VARCHAR), 2, '0') || ':30'"),
    ("date_component_year", "orders", "year from date", "CAST(year(o_orderdate) AS INT)"),
    ("date_component_month", "orders", "month from date", "CAST(month(o_orderdate) AS INT)"),
    ("date_component_day", "orders", "day from date", "CAST(day(o_orderdate) AS INT)"),
    ("date_component_hour", "events", "hour from ts", "CAST(hour(ts) AS INT)"),
    ("date_component_minute", "events", "minute from ts", "CAST(minute(ts) AS INT)"),
    ("date_component_second", "events", "second from ts", "CAST(second(ts) AS INT)"),
    ("date_component_millisecond", "events", "millisecond from ts", "CAST(millisecond(ts) % 1000 AS INT)"),
    ("date_component_missing", "part", "hour from DateTime(2020, 1, 1, if size > 25 then size mod 24 else null)", "CASE WHEN p_size > 25 THEN p_size % 24 END"),
    ("date_timezone_offset", "part", "timezoneoffset from DateTime(2020, 1, 1, size mod 24, 0, 0, 0, size / 4 - 6)", "CAST(p_size / 4 - 6 AS DOUBLE)"),
    ("date_date_from", "events", "ToString(date from ts)", "CAST(CAST(ts AS DATE) AS VARCHAR)"),
    ("date_time_component", "events", "ToString(time from ts)", "strftime(date_trunc('millisecond', ts), '%H:%M:%S.%g')"),
    ("date_difference_years", "orders", "difference in years between day and @2000-06-15", "CAST(2000 - year(o_orderdate) AS INT)"),
    ("date_difference_months", "orders", "difference in months between day and @2000-06-15", "CAST((2000 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) AS INT)"),
    ("date_difference_weeks", "orders", "difference in weeks between day and @2000-06-15", "CAST(floor(date_diff('day', DATE '1970-01-04', DATE '2000-06-15') / 7.0) - floor(date_diff('day', DATE '1970-01-04', CAST(o_orderdate AS DATE)) / 7.0) AS INT)"),
    ("date_difference_days", "orders", "difference in days between day and @2000-06-15", "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-06-15') AS INT)"),
    ("date_difference_hours", "events", "difference in hours between @2024-01-01T00:30:00.000 and ts", "CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS INT)"),
    ("date_duration_years", "orders", "years between day and @2000-06-15", "CAST(CASE WHEN o_orderdate <= TIMESTAMP '2000-06-15' THEN date_sub('year', CAST(o_orderdate AS DATE), DATE '2000-06-15') ELSE -date_sub('year', DATE '2000-06-15', CAST(o_orderdate AS DATE)) END AS INT)"),
    ("date_duration_months", "orders", "months between day and @2005-06-15", "CAST((2005 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) - CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END AS INT)"),
    ("date_duration_weeks", "orders", "weeks between day and @2005-06-15", "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2005-06-15') // 7 AS INT)"),
    ("date_duration_days", "orders", "days between day and @2005-06-15", "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2005-06-15') AS INT)"),
    ("date_duration_hours", "events", "hours between @2024-01-01T00:00:00.000 and ts", "CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS INT)"),
    ("date_duration_minutes", "events", "minutes between @2024-01-01T00:00:00.000 and ts", "CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS INT)"),
    ("date_add_years", "orders", "ToString(day + 1 year)", "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS VARCHAR)"),
    ("date_add_months", "orders", "ToString(day + 1 month)", "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR)"),
    ("date_add_days", "orders", "ToString(day + 10 days)", "CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR)"),
    ("date_subtract_weeks", "orders", "ToString(day - 2 weeks)", "CAST(CAST(o_orderdate AS DATE) - 14 AS VARCHAR)"),
    ("date_add_hours", "events", "ts + 90 minutes", "strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0')"),
    ("date_add_partial", "orders", "ToString(Date(year from day) + 24 months)", "CAST(year(o_orderdate) + 2 AS VARCHAR)"),
    ("date_now", "orders", "difference in days between date and Now()", "CAST(date_diff('day', o_orderdate, TIMESTAMP '2020-01-02 03:04:00') AS INT)"),
    ("date_today", "orders", "days between day and Today()", "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2020-01-02') AS INT)"),
    ("date_time_of_day", "events", "TimeOfDay() after (time from ts)", "CAST(date_trunc('millisecond', ts) AS TIME) < TIME '03:04:00'"),
    ("date_compare_uncertain", "orders", "Date(year from day) < @1998-03", "CASE WHEN year(o_orderdate) <> 1998 THEN year(o_orderdate) < 1998 END"),
    ("date_same_as", "orders", "day same month as @1998-03-01", "strftime(o_orderdate, '%Y-%m') = '1998-03'"),
    ("date_same_or_before", "orders", "day same month or before @1998-03-01", "strftime(o_orderdate, '%Y-%m') <= '1998-03'"),
    ("date_same_or_after", "orders", "day same year or after @1998-03-01", "year(o_orderdate) >= 1998"),
    ("date_after", "orders", "day after month of @1998-03-15", "strftime(o_orderdate, '%Y-%m') > '1998-03'"),
    ("date_before", "orders", "day before @1998-03-15", "CAST(o_orderdate AS DATE) < DATE '1998-03-15'"),
    ("date_same_precision", "part", "SamePrecision(Date(2020, if size > 25 then 3 else null), Date(2019, 2))", "p_size > 25"),
    # comparison, equality, logic, nulls
    ("compare_between", "part", "size between 10 and 20", "p_size BETWEEN 10 AND 20"),
    ("compare_proper_between", "part", "size properly between 10 and 20", "p_size > 10 AND p_size < 20"),
    ("compare_greater", "lineitem", "quantity > 25.5", "l_quantity > 25.5"),
    ("compare_greater_or_equal", "lineitem", "quantity >= 25", "l_quantity >= 25"),
    ("compare_less", "lineitem", "quantity < 25", "l_quantity < 25"),
    ("compare_less_or_equal", "lineitem", "quantity <= 25", "l_quantity <= 25"),
    ("compare_quantity", "part", "ToQuantity(size) < 10 '1'", "p_size < 10"),
    ("compare_quantity_units", "part", "Quantity(size, 'cm') >= 0.2 'm'", "p_size >= 20"),
    ("compare_null", "part", "(if size > 25 then size else null) > 30", "CASE WHEN p_size > 25 THEN p_size > 30 END"),
    ("compare_equal", "part", "type = 'ECONOMY'", "p_type = 'ECONOMY'"),
    ("compare_not_equal", "part", "type != 'ECONOMY'", "p_type <> 'ECONOMY'"),
    ("compare_equal_list", "part", "{size, null} = {11, null}", "p_size = 11"),
    ("compare_not_equal_list", "part", "{size, 1} != {11, 1}", "p_size <> 11"),
    ("compare_equal_tuple", "part", "Tuple { a: size, b: 'x' } = Tuple { a: 11, b: 'x' }", "p_size = 11"),
    ("compare_equivalent", "part", "Upper(type) ~ 'economy'", "p_type = 'ECONOMY'"),
    ("compare_not_equivalent", "part", "type !~ 'economy'", "p_type <> 'ECONOMY'"),
    ("compare_equivalent_null", "part", "(if size > 25 then size else null) ~ null", "p_size <= 25"),
    ("compare_equivalent_list", "part", "{type} ~ {'economy'}", "p_type = 'ECONOMY'"),
    ("compare_equivalent_concept", "part", "Concept { Code '1' from \"s\" } ~ ToConcept(Code { code: ToString(size), system: 's' })", "p_size = 1"),
    ("logic_and", "part", "size > 10 and (if size > 20 then true else null)", "CASE WHEN p_size <= 10 THEN false WHEN p_size > 20 THEN true END"),
    ("logic_or", "part", "size > 10 or (if size > 5 then null else false)", "CASE WHEN p_size > 10 THEN true WHEN p_size <= 5 THEN false END"),
    ("logic_xor", "part", "size > 10 xor size > 20", "p_size > 10 AND p_size <= 20"),
    ("logic_not", "part", "not (size > 10)", "p_size <= 10"),
    ("logic_implies", "part", "size > 10 implies size > 20", "p_size <= 10 OR p_size > 20"),
    ("null_coalesce", "part", "Coalesce(if size > 25 then size else null, 0)", "CASE WHEN p_size > 25 THEN p_size ELSE 0 END"),
    ("null_coalesce_list", "part", "Coalesce({null, if size > 25 then size else null, 7})", "CASE WHEN p_size > 25 THEN p_size ELSE 7 END"),
    ("null_is_null", "part", "(if size > 25 then size else null) is null", "p_size <= 25"),
    ("null_is_true", "part", "(if size > 25 then true else null) is true", "p_size > 25"),
    ("null_is_false", "part", "(if size > 25 then false else null) is false", "p_size > 25"),
    ("query_if", "part", "if size > 25 then 'big' else 'small'", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
    ("query_case", "part", "case when size > 40 then 'L' when size > 20 then 'M' else 'S' end", "CASE WHEN p_size > 40 THEN 'L' WHEN p_size > 20 THEN 'M' ELSE 'S' END"),
    ("query_case_comparand", "part", "case type when 'ECONOMY' then 1 when 'PROMO' then 2 else 3 end", "CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END"),
    # intervals
    ("interval_start", "part", "start of Interval(size, 60]", "p_size + 1"),
    ("interval_end", "part", "end of Interval[1, size)", "p_size - 1"),
    ("interval_end_closed_null", "part", "end of Interval[1, if size > 25 then size else null]", "CASE WHEN p_size > 25 THEN p_size ELSE 2147483647 END"),
    ("interval_width", "part", "width of Interval[size, 60]", "60 - p_size"),
    ("interval_size", "part", "Size(Interval[size, 60])", "61 - p_size"),
    ("interval_point_from", "part", "point from Interval[size, size]", "p_size"),
    ("interval_contains", "part", "Interval[10, 20) contains size", "p_size BETWEEN 10 AND 19"),
    ("interval_in", "part", "size in Interval(10, 20]", "p_size BETWEEN 11 AND 20"),
    ("interval_in_open_null", "part", "size in Interval[10, null)", "CASE WHEN p_size < 10 THEN false END"),
    ("interval_after", "part", "Interval[size, 60] after Interval[1, 20]", "p_size > 20"),
    ("interval_before", "part", "Interval[1, size] before Interval[30, 40]", "p_size < 30"),
    ("interval_after_point", "part", "Interval[size, 60] after 20", "p_size > 20"),
    ("interval_before_point", "part", "size before Interval[30, 40]", "p_size < 30"),
    ("interval_starts", "part", "Interval[10, size] starts Interval[10, 30]", "p_size <= 30 "),
    ("interval_ends", "part", "Interval[size, 50] ends Interval[20, 50]", "p_size >= 20"),
    ("interval_meets", "part", "Interval[1, size] meets Interval[31, 40]", "p_size = 30"),
    ("interval_meets_before", "part", "Interval[1, size] meets before Interval[31, 40]", "p_size = 30"),
    ("interval_meets_after", "part", "Interval[size, 60] meets after Interval[0, 29]", "p_size = 30"),
    ("interval_overlaps", "part", "Interval[size, size + 5] overlaps Interval[20, 30]", "p_size <= 30 AND p_size + 5 >= 20"),
    ("interval_overlaps_before", "part", "Interval[size, size + 5] overlaps before Interval[20, 30]", "p_size < 20 AND p_size + 5 >= 20"),
    ("interval_overlaps_after", "part", "Interval[size, size + 5] overlaps after Interval[20, 30]", "p_size <= 30 AND p_size + 5 > 30"),
    ("interval_same_as", "part", "Interval[size, 40] same as Interval[20, 40]", "p_size = 20"),
    ("interval_same_or_after", "part", "Interval[size, 60] same or after Interval[1, 20]", "p_size >= 20"),
    ("interval_same_or_before", "part", "Interval[0, size] same or before Interval[20, 30]", "p_size <= 20"),
    ("interval_includes", "part", "Interval[0, size] includes Interval[5, 20]", "p_size >= 20"),
    ("interval_includes_element", "part", "Interval[0, size] includes 20", "p_size >= 20"),
    ("interval_included_in", "part", "Interval[5, size] included in Interval[0, 20]", "p_size <= 20"),
    ("interval_properly_includes", "part", "Interval[5, size] properly includes Interval[5, 20]", "p_size > 20"),
    ("interval_properly_includes_element", "part", "Interval[5, size] properly includes 20", "p_size > 20"),
    ("interval_properly_included_in", "part", "Interval[5, size] properly included in Interval[5, 20]", "p_size < 20"),
    ("interval_element_properly_included_in", "part", "size properly included in Interval[5, 20]", "p_size > 5 AND p_size < 20"),
    ("interval_union", "part", "width of (Interval[0, size] union Interval[20, 60])", "CASE WHEN p_size >= 19 THEN greatest(60, p_size) END"),
    ("interval_intersect", "part", "width of (Interval[0, size] intersect Interval[20, 60])", "CASE WHEN p_size >= 20 THEN p_size - 20 END"),
    ("interval_except", "part", "end of (Interval[0, 30] except Interval[size, 60])", "CASE WHEN p_size <= 0 THEN NULL WHEN p_size > 30 THEN 30 ELSE p_size - 1 END"),
    ("interval_during_dates", "orders", "day during Interval[@1996-01-01, @1997-12-31]", "CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"),
    ("interval_during_month", "orders", "day during month of Interval[@1996-02-15, @1997-02-15]", "strftime(o_orderdate, '%Y-%m') BETWEEN '1996-02' AND '1997-02'"),
    ("interval_within", "orders", "day within 30 days of @1998-03-15", "CAST(o_orderdate AS DATE) BETWEEN DATE '1998-02-13' AND DATE '1998-04-14'"),
    ("interval_offset_before", "orders", "day 30 days or less before @1998-03-15", "CAST(o_orderdate AS DATE) >= DATE '1998-02-13' AND CAST(o_orderdate AS DATE) < DATE '1998-03-15'"),
    ("interval_offset_after", "orders", "day more than 1 year after @1998-03-15", "CAST(o_orderdate AS DATE) > DATE '1999-03-15'"),
    ("interval_offset_exact", "orders", "day 1 month after day of @1998-02-15", "CAST(o_orderdate AS DATE) = DATE '1998-03-15'"),
    ("interval_collapse", "part", "Count(collapse {Interval[1, 10], Interval[size, size + 3], Interval[50, 60]})", "CASE WHEN p_size <= 11 OR p_size >= 46 THEN 2 ELSE 3 END"),
    ("interval_expand", "part", "Count(expand Interval[1, size] per 2 '1')", "CAST((p_size - 1) // 2 + 1 AS INT)"),
    ("interval_expand_list", "part", "Count(expand {Interval[1, size], Interval[5, 60]} per 1 '1')", "CASE WHEN p_size >= 4 THEN greatest(60, p_size) ELSE p_size + 56 END"),
    ("interval_expand_days", "orders", "Count(expand Interval[day, @2005-01-01] per month)", "CAST(1 + (2005 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) - CASE WHEN day(o_orderdate) > 1 THEN 1 ELSE 0 END AS INT)"),
    # lists
    ("list_sort", "part", "({size, 25, null, 3}) X sort asc", "array_to_string(list_transform(list_sort([p_size, 25, NULL, 3], 'ASC', 'NULLS FIRST'), lambda x: coalesce(CAST(x AS VARCHAR), 'null')), '|')"),
    ("list_sort_desc", "part", "({size, 25, 3}) X sort desc", "array_to_string(list_sort([p_size, 25, 3], 'DESC'), '|')"),
    ("list_sort_by", "part", "First(({Tuple { a: size, b: 1 }, Tuple { a: 25, b: 2 }}) X sort by a desc, b desc).b", "CASE WHEN p_size > 25 THEN 1 ELSE 2 END"),
    ("list_skip", "part", "Skip({1, 2, size}, 2)", "CAST(p_size AS VARCHAR)"),
    ("list_take", "part", "Take({size, 2, 3}, 2)", "p_size || '|2'"),
    ("list_tail", "part", "Tail({1, size, 3})", "p_size || '|3'"),
    ("list_slice", "part", "Slice({1, size, size + 1, 4}, 1, 3)", "p_size || '|' || (p_size + 1)"),
    ("list_first", "part", "First({size, 2})", "p_size"),
    ("list_last", "part", "Last({2, size})", "p_size"),
    ("list_distinct", "part", "Count(distinct {size, 11, size, 12})", "CASE WHEN p_size IN (11, 12) THEN 2 ELSE 3 END"),
    ("list_except", "part", "Count({size, 11, 12} except {11, 99})", "CASE WHEN p_size IN (11, 12) THEN 1 ELSE 2 END"),
    ("list_intersect", "part", "Count({size, 12} intersect {11, 12})", "CASE WHEN p_size = 11 THEN 2 ELSE 1 END"),
    ("list_union", "part", "Count({size, 12} union {11, 12})", "CASE WHEN p_size IN (11, 12) THEN 2 ELSE 3 END"),
    ("list_exists", "part", "exists {null, if size > 25 then size else null}", "p_size > 25"),
    ("list_flatten", "part", "Sum(flatten {{size, 1}, {2}})", "p_size + 3"),
    ("list_index_of", "part", "IndexOf({11, 12, size}, size)", "CASE p_size WHEN 11 THEN 0 WHEN 12 THEN 1 ELSE 2 END"),
    ("list_indexer", "embeddings", "vector[3]", "round(CAST(embedding[4] AS DOUBLE), 8)"),
    ("list_length", "embeddings", "Length(vector)", "CAST(len(embedding) AS INT)"),
    ("list_singleton_from", "part", "singleton from {size}", "p_size"),
    ("list_to_list", "part", "Sum(ToList(size))", "p_size"),
    ("list_includes", "part", "{11, 12, 13} includes {size, 12}", "p_size IN (11, 12, 13)"),
    ("list_included_in", "part", "{size, 12} included in {11, 12, 13}", "p_size IN (11, 12, 13)"),
    ("list_includes_element", "part", "{11, 12, 13} includes size", "p_size IN (11, 12, 13)"),
    ("list_element_included_in", "part", "size included in {11, 12, 13}", "p_size IN (11, 12, 13)"),
    ("list_properly_includes", "part", "{11, 12, 13} properly includes {size, 12}", "p_size IN (11, 12, 13)"),
    ("list_properly_includes_element", "part", "{11, 12} properly includes size", "p_size IN (11, 12)"),
    ("list_properly_included_in", "part", "{size} properly included in {11, 12}", "p_size IN (11, 12)"),
    ("list_element_properly_included_in", "part", "size properly included in {11, 12}", "p_size IN (11, 12)"),
    ("list_contains", "part", "{11, 12} contains size", "p_size IN (11, 12)"),
    ("list_in", "part", "size in {11, 12}", "p_size IN (11, 12)"),
    ("list_contains_null", "part", "{11, null} contains (if size > 25 then size else null)", "p_size <= 25"),
    # aggregates of lists
    ("aggregate_all_true", "part", "AllTrue({size > 5, null, size > 10})", "p_size > 10"),
    ("aggregate_any_true", "part", "AnyTrue({size > 5, null, size > 10})", "p_size > 5"),
    ("aggregate_avg", "part", "Avg({size, null, 4})", "(p_size + 4) / 2.0::DOUBLE"),
    ("aggregate_count", "part", "Count({size, null, if size > 20 then 4 else null})", "CASE WHEN p_size > 20 THEN 2 ELSE 1 END"),
    ("aggregate_geometric_mean", "part", "Round(GeometricMean({size, 2.0}), 4)", "round(sqrt(p_size * 2.0), 4)"),
    ("aggregate_max", "part", "Max({size, null, 25})", "greatest(p_size, 25)"),
    ("aggregate_min", "part", "Min({size, null, 25})", "least(p_size, 25)"),
    ("aggregate_median", "part", "Median({30.0, size, 10.0})", "CAST(greatest(10, least(30, p_size)) AS DOUBLE)"),
    ("aggregate_median_even", "part", "Median({size, 10})", "(p_size + 10) // 2"),
    ("aggregate_mode", "part", "Mode({size, 11, 12, 11})", "CASE WHEN p_size = 12 THEN 12 ELSE 11 END"),
    ("aggregate_population_std_dev", "part", "Round(PopulationStdDev({size, 0.0}), 4)", "round(p_size / 2.0, 4)"),
    ("aggregate_population_variance", "part", "Round(PopulationVariance({size, 0.0}), 4)", "round(p_size * p_size / 4.0, 4)"),
    ("aggregate_product", "part", "Product({size, null, 3})", "p_size * 3"),
    ("aggregate_std_dev", "part", "Round(StdDev({size, 0.0}), 4)", "round(sqrt(p_size * p_size / 2.0), 4)"),
    ("aggregate_sum", "part", "Sum({size, null, 3})", "p_size + 3"),
    ("aggregate_sum_overflow", "part", "Sum({size, 2147483640})", "CASE WHEN p_size > 7 THEN NULL ELSE CAST(p_size + 2147483640 AS INT) END"),
    ("aggregate_sum_quantity", "part", "Sum({Quantity(size, 'mg'), 3 'mg'}).value", "CAST(p_size + 3 AS DOUBLE)"),
    ("aggregate_sum_vector", "embeddings", "Round(Sum(vector), 4)", "CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DECIMAL(28,8)))), 4) AS DOUBLE)"),
    ("aggregate_max_vector", "embeddings", "Max(vector)", "round(CAST(list_max(embedding) AS DOUBLE), 8)"),
    ("aggregate_variance", "part", "Round(Variance({size, 0.0}), 4)", "round(p_size * p_size / 2.0, 4)"),
    ("aggregate_clause", "part", "({1, 2, size}) X aggregate R starting 1: R * X", "2 * p_size"),
    ("aggregate_clause_distinct", "part", "({2, 2, 3}) X aggregate distinct R starting size: R + X", "p_size + 5"),
    # queries over lists
    ("query_select", "part", "Sum(({1, 2, size}) X return all X * 2)", "2 * (3 + p_size)"),
    ("query_return_distinct", "part", "Count(({size, size, 3}) X return X)", "CASE WHEN p_size = 3 THEN 1 ELSE 2 END"),
    ("query_where", "part", "Count(({1, 20, size}) X where X > 10)", "CASE WHEN p_size > 10 THEN 2 ELSE 1 END"),
    ("query_let", "part", "Sum(({1, size}) X let Y: X * 3 return all Y + 1)", "3 * (1 + p_size) + 2"),
    ("query_with", "part", "Count(({1, 20, size}) X with {20, 30} Y such that X = Y)", "CASE WHEN p_size IN (20, 30) THEN 2 ELSE 1 END"),
    ("query_without", "part", "Count(({1, 20, size}) X without {20, 30} Y such that X = Y)", "CASE WHEN p_size IN (20, 30) THEN 1 ELSE 2 END"),
    ("query_multi_source", "part", "Sum(from {1, 2} A, {10, size} B return all A * B)", "3 * (10 + p_size)"),
    ("query_cross_join_3", "part", "Sum(from {1, 2} A, {1, size} B, {1, 2, 3} C return all A + B + C)", "48 + 6 * p_size"),
    ("query_scalar_source", "part", "(size) X return X + 1", "p_size + 1"),
    ("query_tuple", "part", "Tuple { a: size, b: name }.b", "p_name"),
    # types and conversions
    ("convert_boolean_to_integer", "part", "ConvertBooleanToInteger(size > 25)", "CAST(p_size > 25 AS INT)"),
    ("convert_boolean_to_long", "part", "ConvertBooleanToLong(size > 25)", "CAST(p_size > 25 AS BIGINT)"),
    ("convert_boolean_to_decimal", "part", "ConvertBooleanToDecimal(size > 25)", "CAST(p_size > 25 AS DOUBLE)"),
    ("convert_boolean_to_string", "part", "ConvertBooleanToString(size > 25)", "CAST(p_size > 25 AS VARCHAR)"),
    ("convert_integer_to_boolean", "part", "ConvertIntegerToBoolean(size)", "p_size = 1"),
    ("convert_integer_to_long", "part", "ConvertIntegerToLong(size)", "CAST(p_size AS BIGINT)"),
    ("convert_integer_to_decimal", "part", "ConvertIntegerToDecimal(size)", "CAST(p_size AS DOUBLE)"),
    ("convert_integer_to_quantity", "part", "ConvertIntegerToQuantity(size).value", "CAST(p_size AS DOUBLE)"),
    ("convert_integer_to_string", "part", "ConvertIntegerToString(size)", "CAST(p_size AS VARCHAR)"),
    ("convert_long_to_boolean", "part", "ConvertLongToBoolean(pkey)", "p_partkey = 1"),
    ("convert_long_to_integer", "part", "ConvertLongToInteger(pkey * 10000000L)", "CASE WHEN p_partkey * 10000000 <= 2147483647 THEN CAST(p_partkey * 10000000 AS INT) END"),
    ("convert_long_to_decimal", "part", "ConvertLongToDecimal(pkey)", "CAST(p_partkey AS DOUBLE)"),
    ("convert_long_to_quantity", "part", "ConvertLongToQuantity(pkey).value", "CAST(p_partkey AS DOUBLE)"),
    ("convert_long_to_string", "part", "ConvertLongToString(pkey)", "CAST(p_partkey AS VARCHAR)"),
    ("convert_decimal_to_boolean", "part", "ConvertDecimalToBoolean(price - 899.0)", "CAST(p_retailprice AS DECIMAL(18,2)) - 899 = 1"),
    ("convert_decimal_to_quantity", "part", "ConvertDecimalToQuantity(price).value", "p_retailprice"),
    ("convert_decimal_to_string", "part", "ConvertDecimalToString(price)", "CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS INT) AS VARCHAR) || '.0' ELSE rtrim(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0') END"),
    ("convert_quantity_to_string", "part", "ConvertQuantityToString(Quantity(size, 'mg'))", "p_size || ' ''mg'''"),
    ("convert_ratio_to_string", "part", "ConvertRatioToString(Ratio { numerator: Quantity(size, 'mg'), denominator: 2 'mL' })", "p_size || ' ''mg'':2 ''mL'''"),
    ("convert_string_to_boolean", "part", "ConvertStringToBoolean(if size > 25 then 'yes' else type)", "CASE WHEN p_size > 25 THEN true END"),
    ("convert_string_to_integer", "part", "ConvertStringToInteger(Substring(brand, 6))", "CAST(substr(p_brand, 7) AS INT)"),
    ("convert_string_to_integer_bad", "part", "ConvertStringToInteger(if size > 25 then brand else ToString(size))", "CASE WHEN p_size <= 25 THEN p_size END"),
    ("convert_string_to_long", "part", "ConvertStringToLong(Substring(brand, 6))", "CAST(substr(p_brand, 7) AS BIGINT)"),
    ("convert_string_to_decimal", "part", "ConvertStringToDecimal(Substring(brand, 6) + '.5')", "CAST(substr(p_brand, 7) || '.5' AS DOUBLE)"),
    ("convert_string_to_quantity", "part", "ConvertStringToQuantity(ToString(size) + ' \\'mg\\'').value", "CAST(p_size AS DOUBLE)"),
    ("convert_string_to_date", "part", "year from ConvertStringToDate('20' + Substring(ToString(100 + size), 1) + '-05')", "CAST(2000 + p_size AS INT)"),
    ("convert_string_to_date_time", "part", "hour from ConvertStringToDateTime('2020-01-01T' + Substring(ToString(100 + size mod 24), 1) + ':00')", "CAST(p_size % 24 AS INT)"),
    ("convert_string_to_time", "part", "ToString(ConvertStringToTime('T' + Substring(ToString(100 + size mod 24), 1) + ':30'))", "lpad(CAST(p_size % 24 AS VARCHAR), 2, '0') || ':30'"),
    ("convert_date_to_string", "orders", "ConvertDateToString(day)", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
    ("convert_date_to_date_time", "orders", "ToString(ConvertDateToDateTime(day))", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
    ("convert_date_time_to_string", "events", "ConvertDateTimeToString(ts)", "strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g')"),
    ("convert_date_time_to_date", "events", "ToString(ConvertDateTimeToDate(ts))", "CAST(CAST(ts AS DATE) AS VARCHAR)"),
    ("convert_time_to_string", "events", "ConvertTimeToString(time from ts)", "strftime(date_trunc('millisecond', ts), '%H:%M:%S.%g')"),
    ("convert_code_to_concept", "part", "First(ConvertCodeToConcept(Code { code: type }).codes).code", "p_type"),
    ("convert_concept_to_codes", "part", "First(ConvertConceptToListOfCodes(ToConcept(Code { code: type }))).code", "p_type"),
    ("convert_quantity_units", "part", "ConvertQuantity(Quantity(size, 'm'), 'cm').value", "CAST(p_size * 100 AS DOUBLE)"),
    ("convert_can_convert_quantity", "part", "CanConvertQuantity(Quantity(size, if size > 25 then 'm' else 'g'), 'mg')", "p_size <= 25"),
    ("convert_converts_to_boolean", "part", "ConvertsToBoolean(if size > 25 then type else 'yes')", "p_size <= 25"),
    ("convert_converts_to_date", "part", "ConvertsToDate('2020-' + Substring(ToString(100 + size), 1))", "p_size BETWEEN 1 AND 12"),
    ("convert_converts_to_date_time", "part", "ConvertsToDateTime('2020-' + Substring(ToString(100 + size), 1) + '-01T00:00')", "p_size BETWEEN 1 AND 12"),
    ("convert_converts_to_decimal", "part", "ConvertsToDecimal(if size > 25 then brand else Substring(brand, 6))", "p_size <= 25"),
    ("convert_converts_to_long", "part", "ConvertsToLong(if size > 25 then brand else ToString(size))", "p_size <= 25"),
    ("convert_converts_to_integer", "part", "ConvertsToInteger(ToString(size * 100000000L))", "p_size <= 21"),
    ("convert_converts_to_quantity", "part", "ConvertsToQuantity(ToString(size) + (if size > 25 then ' days' else ' 1x'))", "p_size > 25"),
    ("convert_converts_to_string", "part", "ConvertsToString(if size > 25 then size else null)", "CASE WHEN p_size > 25 THEN true END"),
    ("convert_converts_to_time", "part", "ConvertsToTime(Substring(ToString(100 + size), 1) + ':00')", "p_size < 24"),
    ("convert_to_chars", "part", "ToChars(brand)", "array_to_string(string_split(p_brand, ''), '|')"),
    ("convert_to_ratio", "part", "ToRatio(ToString(size) + ' \\'mg\\':2 \\'mL\\'').numerator.value", "CAST(p_size AS DOUBLE)"),
    ("convert_converts_to_ratio", "part", "ConvertsToRatio(if size > 25 then name else ToString(size) + ':2')", "p_size <= 25"),
    ("query_select_many", "part", "Sum(flatten (({1, 2}) X return all ({size, X}) Y return all Y))", "2 * p_size + 3"),
    ("query_nested", "part", "Count(({1, 20, 40}) X where exists (({size}) Y where Y > X))", "CASE WHEN p_size > 40 THEN 3 WHEN p_size > 20 THEN 2 WHEN p_size > 1 THEN 1 ELSE 0 END"),
    ("convert_expression", "part", "convert size to String", "CAST(p_size AS VARCHAR)"),
    ("type_is", "part", "(if size > 25 then size else null) is Integer", "p_size > 25"),
    ("type_as", "part", "size as Integer", "p_size"),
    ("type_quantity", "part", "Quantity(size, 'mg').value", "CAST(p_size AS DOUBLE)"),
    ("type_message", "part", "Message(size, true, '1', 'Trace', name)", "p_size"),
    # partial dates and times
    ("compare_not_equivalent_list", "part", "{size, 1} !~ {1, 1}", "p_size <> 1"),
    ("interval_after_point_dates", "orders", "Interval[day, day + 10 days] after @1996-03-01", "CAST(o_orderdate AS DATE) > DATE '1996-03-01'"),
    ("interval_before_point_dates", "orders", "Interval[day, day + 10 days] before @1996-03-01", "CAST(o_orderdate AS DATE) + INTERVAL 10 DAY < DATE '1996-03-01'"),
    ("interval_point_after_dates", "orders", "@1996-03-01 after Interval[day, day + 10 days]", "DATE '1996-03-01' > CAST(o_orderdate AS DATE) + INTERVAL 10 DAY"),
    ("interval_point_before_dates", "orders", "day before Interval[@1996-01-01, @1996-12-31]", "CAST(o_orderdate AS DATE) < DATE '1996-01-01'"),
    ("partial_during_months", "orders", "DateTime(year from date, month from date) during Interval[DateTime(1996, 1), DateTime(1996, 6)]", "year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199601 AND 199606"),
    ("partial_year_during_months", "orders", "DateTime(year from date) during Interval[DateTime(1996, 3), DateTime(1996, 9)]", "CASE WHEN year(o_orderdate) <> 1996 THEN false END"),
    ("partial_stamp_during_months", "orders", "date during Interval[DateTime(1996, 3), DateTime(1996, 9)]", "CASE WHEN year(o_orderdate) * 100 + month(o_orderdate) < 199603 OR year(o_orderdate) * 100 + month(o_orderdate) > 199609 THEN false WHEN year(o_orderdate) * 100 + month(o_orderdate) NOT IN (199603, 199609) THEN true END"),
    ("partial_stamp_during_month_of", "orders", "date during month of Interval[DateTime(1996, 3), DateTime(1996, 9)]", "year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199603 AND 199609"),
    ("partial_overlaps", "orders", "Interval[DateTime(1996, 3), DateTime(1996, 9)] overlaps Interval[date, date + 30 days]", "CASE WHEN year((o_orderdate + INTERVAL 30 DAY)) * 100 + month((o_orderdate + INTERVAL 30 DAY)) < 199603 OR year(o_orderdate) * 100 + month(o_orderdate) > 199609 THEN false WHEN year((o_orderdate + INTERVAL 30 DAY)) * 100 + month((o_orderdate + INTERVAL 30 DAY)) > 199603 AND year(o_orderdate) * 100 + month(o_orderdate) < 199609 THEN true END"),
    ("partial_before", "orders", "DateTime(year from date, month from date) before DateTime(1996, 5, 1)", "CASE WHEN year(o_orderdate) * 100 + month(o_orderdate) < 199605 THEN true WHEN year(o_orderdate) * 100 + month(o_orderdate) > 199605 THEN false END"),
    ("partial_same_month", "orders", "date same month as DateTime(1996, 5)", "year(o_orderdate) * 100 + month(o_orderdate) = 199605"),
    ("partial_add_months", "orders", "DateTime(year from date, month from date) + 14 months", "strftime(date_trunc('month', o_orderdate) + INTERVAL 14 MONTH, '%Y-%m')"),
    ("partial_start", "orders", "start of Interval[DateTime(year from date), DateTime(2010)]", "CAST(year(o_orderdate) AS VARCHAR)"),
    ("partial_includes", "orders", "Interval[DateTime(1996, 3), DateTime(1996, 9)] includes Interval[DateTime(year from date, month from date), DateTime(year from date, month from date)]", "year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199603 AND 199609"),
    ("partial_meets_before", "orders", "Interval[DateTime(1990, 1), DateTime(year from date, month from date)] meets before Interval[DateTime(1996, 3), DateTime(2000, 1)]", "year(o_orderdate) * 100 + month(o_orderdate) = 199602"),
    ("partial_string_during", "orders", "ToDateTime(Substring(ToString(day), 0, 7)) during Interval[ToDateTime('1996-01'), ToDateTime('1996-06')]", "year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199601 AND 199606"),
    ("partial_duration", "orders", "months between DateTime(year from date, month from date) and DateTime(2000, 1)", "CAST((2000 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) AS INT)"),
    # terminology within rows
    ("terms_code_in_list", "part", "Code { code: type, system: 's' } in {Code { code: 'ECONOMY', system: 's' }, Code { code: 'PROMO', system: 's' }}", "p_type IN ('ECONOMY', 'PROMO')"),
    ("terms_string_in_value_set", "part", "type in kinds", "p_type IN ('ECONOMY', 'PROMO')"),
    ("terms_strings_in_value_set", "part", "{'x', type} in kinds", "p_type IN ('ECONOMY', 'PROMO')"),
    ("terms_code_in_value_set", "part", "Code { code: Lower(type), system: 'S' } in kinds", "p_type IN ('ECONOMY', 'PROMO')"),
    ("terms_code_in_value_set_other_system", "part", "Code { code: type, system: (if size > 25 then 's' else 'other') } in kinds", "p_type IN ('ECONOMY', 'PROMO') AND p_size > 25"),
    ("terms_concept_in_value_set", "part", "ToConcept(Code { code: type, system: 's' }) in kinds", "p_type IN ('ECONOMY', 'PROMO')"),
    ("terms_codes_in_value_set", "part", "{Code { code: 'x' }, Code { code: type, system: 's' }} in kinds", "p_type IN ('ECONOMY', 'PROMO')"),
    ("terms_concepts_in_value_set", "part", "{ToConcept(Code { code: type, system: 's' })} in kinds", "p_type IN ('ECONOMY', 'PROMO')"),
    ("terms_expand_value_set", "part", "Count((ExpandValueSet(kinds)) K where K.code = type)", "CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1 ELSE 0 END"),
    ("terms_value_set_union", "part", "Count(ValueSetUnion(kinds, {Code { code: type, system: 's' }}))", "CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 2 ELSE 3 END"),
    ("age_calculate_age_at", "orders", "CalculateAgeInYearsAt(day, @2020-02-28)", "CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2020-02-28') AS INT)"),
    ("age_calculate_age", "orders", "CalculateAgeInMonths(day)", "CAST((2020 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) - CASE WHEN day(o_orderdate) > 2 THEN 1 ELSE 0 END AS INT)"),
]

#: Fixed value set of the terminology expressions: (system, code).
KINDS = [("s", "ECONOMY"), ("s", "PROMO")]


def shown(e: E) -> str:
    """A result in a form that any engine writes alike."""
    t = e.t
    if t == "Decimal":
        return f"cast({e} as double)"
    if is_list(t):
        x = c.fresh()
        return f"array_join(transform({e}, {x} -> coalesce({lib.call('ToString', [E(x, t[1])])}, 'null')), '|')"
    if isinstance(t, str) and base(t) in c.TEMPORAL:
        return str(lib.call("ToString", [e]))
    if is_interval(t) or isinstance(t, tuple):
        return f"to_json({e})"
    return str(e)


def _month_known(scope):
    """Whether a date that lacks its month in some rows is known to the month: a helper of the operators, without syntax of its own."""
    return lib.call("GreaterOrSamePrecision", [Compiler().compile("Date(2020, if size > 25 then 3 else null)", scope)], "month")


SPECS.append(("date_greater_or_same_precision", "part", _month_known, "p_size > 25"))


def query(table: str, text):
    """A function of (spark, sf_dir) that evaluates an expression, or what a function of the scope gives, for each row."""

    def run(spark, sf_dir):
        compiler = Compiler()
        kinds = Compiler(codes={"kinds": KINDS}).value_set("kinds", "kinds")
        scope = tables.scope(table) | {"kinds": kinds}
        e = text(scope) if callable(text) else compiler.compile(text, scope)
        keys = tables.COLUMNS[table][0]
        return tables.read(spark, sf_dir, table).selectExpr(*keys, f"{shown(e)} as result")

    return run


def queries() -> dict:
    return {name: query(table, text) for name, table, text, sql in SPECS}


def oracle_sql() -> dict:
    return {name: f"SELECT {', '.join(tables.COLUMNS[table][0])}, {sql} AS result FROM {table}" for name, table, _, sql in SPECS}
