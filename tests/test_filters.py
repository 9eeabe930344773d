"""Predicates against hand-written SQL on an independent engine."""

import pytest
from pyspark.sql import types as T

from gridlens.functions.kinds import Field
from gridlens.operators import rows
from gridlens.plans import filters as L

#: Column, operator, what the spec holds besides, the same in SQL.
CASES = [
    ("town", "in", {"values": ["Oslo", "Bergen", "nowhere"]}, "town IN ('Oslo', 'Bergen')"),
    ("town", None, {"values": [None, "Bergen"]}, "coalesce(town, 'Bergen') = 'Bergen'"),
    ("town", "in", {"values": [L.NULL_TOKEN]}, "town IS NULL"),
    ("town", "In", {"values": ["OSLO"], "case_sensitive": False}, "town ILIKE 'oslo'"),
    ("town", "in", {"values": ["OSLO"]}, "FALSE"),
    ("town", "not_in", {"values": ["Narvik", "oslo"]}, "town IS NULL OR town NOT IN ('Narvik', 'oslo')"),
    ("town", "not_in", {"values": ["Narvik", None]}, "town <> 'Narvik'"),
    ("town", "not_in", {"values": [None]}, "town IS NOT NULL"),
    ("town", "not_in", {"values": ["oSLO"], "case_sensitive": False}, "town IS NULL OR lower(town) <> 'oslo'"),
    ("nights", "in", {"values": ["-2", 3.5, "7.5"]}, "nights IN (-2, 4, 8)"),
    ("settled", "in", {"values": ["no", None]}, "settled IS DISTINCT FROM TRUE"),
    ("score", "between", {"value": "-1.5", "value2": 7}, "score BETWEEN -1.5 AND 7"),
    ("score", "between", {"value": "", "value2": "2.125"}, "score <= 2.125"),
    ("score", "not_between", {"value": -4, "value2": 12.5}, "score NOT BETWEEN -4 AND 12.5"),
    ("nights", "not_between", {"value2": 0}, "nights > 0"),
    ("entered", "between", {"value": "2000-03-01", "value2": "2000/3/2 06:00:00"}, "entered BETWEEN TIMESTAMP '2000-03-01' AND TIMESTAMP '2000-03-02 06:00:00'"),
    ("bill", "eq", {"value": "-4.5"}, "bill = -4.5"),
    ("bill", "gt", {"value": 0.0004}, "bill > 0"),
    ("nights", "ne", {"value": "4.0"}, "nights <> 4"),
    ("nights", "lte", {"value": "-1e0"}, "nights <= -1"),
    ("arrived", "lt", {"value": "2000-2-29"}, "arrived < DATE '2000-02-29'"),
    ("arrived", "gte", {"value": "2001-12-05 23:00:00"}, "arrived >= DATE '2001-12-05'"),
    ("woken", "gte", {"value": "12:30:00"}, "woken >= TIME '12:30:00'"),
    ("settled", "ne", {"value": "T"}, "NOT settled"),
    ("town", "gt", {"value": "O"}, "town > 'O'"),
    ("remark", "contains", {"value": "_1"}, "contains(remark, '_1')"),
    ("remark", "contains", {"value": "%!"}, "contains(remark, '%!')"),
    ("town", "contains", {"value": "SL"}, "lower(town) LIKE '%sl%'"),
    ("town", "contains", {"value": "SL", "case_sensitive": True}, "FALSE"),
    ("town", "not_contains", {"value": "r"}, "town IS NULL OR NOT contains(lower(town), 'r')"),
    ("remark", "starts_with", {"value": "BED_3"}, "starts_with(remark, 'bed_3')"),
    ("remark", "ends_with", {"value": "!!"}, "suffix(remark, '!!')"),
    ("remark", "regex", {"value": "_[12]?7%!*$"}, "regexp_matches(remark, '_[12]?7%!*$')"),
    ("score", "contains", {"value": ".375"}, "contains(CAST(score AS VARCHAR), '.375')"),
    ("extras", "contains", {"value": "[B4, null"}, "contains(lower(CAST(extras AS VARCHAR)), '[b4, null')"),
    ("room", "ends_with", {"value": "'wing': NULL}"}, "suffix(CAST(room AS VARCHAR), concat(chr(39), 'wing', chr(39), ': NULL}'))"),
    ("remark", "is_null", {}, "remark IS NULL"),
    ("score", "is_not_null", {}, "score IS NOT NULL"),
    ("remark", "is_empty", {}, "coalesce(remark, '') = ''"),
    ("remark", "is_not_empty", {}, "length(remark) > 0"),
    ("entered", "eq", {"value": "3", "transform": "month"}, "month(entered) = 3"),
    ("arrived", "in", {"values": [1999, "2002"], "transform": "year"}, "year(arrived) IN (1999, 2002)"),
    ("arrived_words", "gt", {"value": 20, "transform": "day", "date_format": "%d-%b-%Y"}, "day(arrived) > 20"),
    ("arrived_digits", "between", {"value": 2, "value2": "4", "transform": "month", "date_format": "%Y%m%d"}, "month(arrived) BETWEEN 2 AND 4"),
    ("remark", "eq", {"value": "x' OR 1=1 --"}, "FALSE"),
]


@pytest.mark.parametrize(("column", "op", "more", "where"), CASES)
def test_predicate(data, sql, column, op, more, where):
    got = rows.filtered(data, [{"column": column, "op": op} | more]).select("stay").collect()
    assert sorted(r.stay for r in got) == [k for (k,) in sql(f"SELECT stay FROM fixture WHERE {where} ORDER BY 1")]


@pytest.mark.parametrize(("column", "more"), [
    ("gone", {"op": "is_null", "enabled": False}), ("bill", {"op": "gt", "value": "cheap"}), ("town", {"op": "starts_with", "value": ""}), ("score", {"op": "not_between", "value": "", "value2": None}),
    ("town", {"op": "not_in", "values": None}), ("town", {"values": {"Oslo"}}), ("nights", {"op": "near", "value": 2}), ("entered", {"op": "lt", "value": "2000-13-01"}), ("nights", {"op": "lt", "value": 40_000}),
    ("nights", {"op": "eq", "value": float("nan")}), ("town", {"op": "eq", "value": 1, "transform": "day"}), ("arrived", {"op": "eq", "value": 1, "transform": "hour"}), ("settled", {"op": "eq", "value": "2"}), ("bill", {"op": "eq", "value": "1e12"}),
])
def test_refused(data, column, more):
    with pytest.raises(L.FilterError):
        rows.filtered(data, [{"column": column} | more])


def test_all_hold_but_disabled_and_skipped_ones(data, sql):
    specs = [{"column": "nights", "op": "gt", "value": 1}, {"column": "town", "op": "eq", "value": "Narvik"}, {"column": "stay", "op": "is_null", "enabled": False}]
    for skip, where in ((None, "nights > 1 AND town = 'Narvik'"), ("town", "nights > 1"), ("nights", "town = 'Narvik'")):
        assert rows.filtered(data, specs, skip=skip).count() == sql(f"SELECT count(*) FROM fixture WHERE {where}")[0][0]


def test_filters_and_columns_reach_the_scan(data):
    plan = rows.filtered(data, [{"column": "stay", "op": "in", "values": [1001, "1002"]}]).select("bill")._jdf.queryExecution().toString()
    assert "In(stay, [1001,1002])" in plan and "ReadSchema: struct<stay:int,bill:decimal(12,3)>" in plan


def test_rounding_of_operands(spark):
    read = lambda kind, *values: [spark.range(1).select(L.operand(v, kind)).first()[0] for v in values]
    assert read(T.ShortType(), "0.5", "-7.5", 0.5, 1.5, False, "12e1") == [1, -8, 0, 2, 0, 120]
    assert [str(v) for v in read(T.DecimalType(6, 1), "0.05", 12, "-3.25")] == ["0.1", "12.0", "-3.3"]


def test_sentences():
    long = L.describe({"column": "k", "op": "not_in", "values": [f"v{i}" for i in range(20)]})
    assert long.startswith("k is none of [v0, v1,") and long.endswith("v11 ... (+8 more)]")
    told = {("op", "is_not_empty"): "k is not empty", ("op", "between"): "k between 2 .. None", ("transform", "year"): "k (year) is any of [(blank)]"}
    for (name, value), text in told.items():
        assert L.describe({"column": "k", "value": 2, "values": [None], name: value}) == text


def test_pasted_lists():
    assert L.pasted(' 7 ,,8\t"9, 10"\r\n7\n "a ""b"" c" ') == ["7", "8", "9, 10", 'a "b" c']


def test_typed_specs():
    kinds = {"when": T.TimestampType(), "plain": T.TimestampNTZType(), "yes": T.BooleanType(), "n": T.DoubleType(), "word": T.StringType()}
    typed = lambda kind, **spec: L.normalized({"column": "c"} | spec, Field("c", kinds[kind]))
    assert typed("when", op="eq", value=" 1987-6-5 ") == {"column": "c", "op": "between", "value": "1987-6-5 00:00:00", "value2": "1987-6-5 23:59:59.999999"}
    assert [typed("plain", op=op, value="1987-06-05")["value"][11:13] for op in ("lt", "lte", "gt", "gte")] == ["00", "23", "23", "00"]
    assert typed("plain", op="not_between", value="1987-06-05 10:00:00", value2="1987-06-06")["value2"] == "1987-06-06 23:59:59.999999"
    assert [typed("yes", op="eq", value=v)["value"] for v in ("NO", 1, "true")] == [False, True, True]
    assert typed("word", values=["x"])["case_sensitive"] is False and typed("word", values=["x"], case_sensitive=True)["case_sensitive"] is True
    for kind, spec in (("when", {"values": ["1987-06-05"]}), ("n", {"op": "not_in", "values": ["1", "Infinity"]}), ("yes", {"op": "eq", "value": "oui"})):
        with pytest.raises(L.FilterError):
            typed(kind, **spec)


def test_stale_specs_go():
    specs = [{"column": "c", "transform": "day", "date_format": f} for f in ("%Y%m%d", "iso")] + [{"column": "c"}, {"column": "e", "transform": "day"}]
    assert L.still_valid(specs, "c", "day", "iso") == specs[1:2] + specs[3:]
    assert L.still_valid(specs, "c", None) == specs[2:]


def test_operators_offered(data):
    offered = {f.name: set(L.offered(f)) for f in data.fields}
    assert "between" in offered["bill"] and "contains" not in offered["nights"] and offered["settled"] == {"eq", "is_null", "is_not_null"}
    assert "regex" in offered["room"] and "in" not in offered["extras"] and set(L.offered(data.by_name["arrived_words"], "year")) == offered["nights"]
    for name, ops in offered.items():  # whatever is offered works
        for op in ops:
            value = {"temporal": "2000-01-01", "numeric": "1", "boolean": "yes"}.get(data.by_name[name].category, "a") if name != "woken" else "01:00:00"
            L.predicate({"column": name, "op": op, "value": value, "value2": value, "values": [value]}, data.by_name[name])
