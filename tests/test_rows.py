"""Rows, counts, values, statistics."""

import decimal
import statistics

import pytest

from gridlens.functions.kinds import text_of
from gridlens.operators import rows
from gridlens.plans.filters import FilterError


def test_projection_keeps_the_order_asked_for(data, sql):
    page = rows.preview(data, columns=["bill", "unknown", "town"], order_by="stay", descending=True, limit=3, offset=2)
    assert [c["name"] for c in page["columns"]] == ["bill", "town"]
    assert page["rows"] == [[float(b), t] for b, t in sql("SELECT bill, town FROM fixture ORDER BY stay DESC LIMIT 3 OFFSET 2")]
    assert [c["name"] for c in rows.preview(data, columns=["unknown"])["columns"]] == [f.name for f in data.fields]
    assert len(rows.preview(data)["rows"]) == 10


def test_extractions_keep_the_name(data, sql):
    asked = {"arrived_words": {"part": "month", "format": "%d-%b-%Y"}, "entered": "day"}
    page = rows.preview(data, columns=list(asked), transforms=asked, order_by="arrived_words", limit=143)
    assert [c["type"] for c in page["columns"]] == ["bigint"] * 2
    assert sorted(map(tuple, page["rows"])) == sql("SELECT month(arrived), day(entered) FROM fixture ORDER BY ALL") and [m for m, _ in page["rows"]] == sorted(m for m, _ in page["rows"])


@pytest.mark.parametrize("bad", [{"unknown": "day"}, {"arrived": "decade"}, {"score": "month"}, {"woken": "year"}, {"arrived_digits": {"part": "day", "format": "%q"}}])
def test_bad_extractions(data, bad):
    with pytest.raises(FilterError):
        rows.preview(data, transforms=bad)


@pytest.mark.parametrize("column", ["score", "town", "settled"])
@pytest.mark.parametrize("way", ["ASC", "DESC"])
def test_blanks_sort_last(data, sql, column, way):
    got = [r[0] for r in rows.preview(data, columns=[column], order_by=column, descending=way == "DESC", limit=143)["rows"]]
    assert got == [v for (v,) in sql(f"SELECT {column} FROM fixture ORDER BY 1 {way} NULLS LAST")]


def test_values_by_frequency(data, sql):
    under = [{"column": "town", "op": "eq", "value": "Oslo"}, {"column": "nights", "op": "gte", "value": 0}]  # the column's own filter doesn't count
    got = rows.distinct_values(data, "town", under)
    assert [(v["value"], v["count"]) for v in got["values"]] == sql("SELECT town, count(*) AS n FROM fixture WHERE nights >= 0 GROUP BY 1 ORDER BY n DESC, town NULLS LAST") and not got["truncated"]


def test_values_limited_searched_and_looked_up(data, sql):
    few = rows.distinct_values(data, "stay", limit=7)
    assert few["truncated"] and [v["value"] for v in few["values"]] == list(range(1000, 1007))
    assert [v["value"] for v in rows.distinct_values(data, "town", search="ERG")["values"]] == ["Bergen"]
    assert {v["value"] for v in rows.distinct_values(data, "town", search="zz", exact=["OSLO", "BERGEN"])["values"]} == {"Oslo", "oslo", "Bergen"}
    years = rows.distinct_values(data, "arrived_digits", transform="year", date_format="%Y%m%d")["values"]
    assert [(v["value"], v["count"]) for v in years] == sql("SELECT year(arrived), count(*) FROM fixture GROUP BY 1 ORDER BY 1")
    assert {v["value"] for v in rows.distinct_values(data, "extras")["values"]} == {f"[b{i}, NULL, x]" for i in range(6)}


@pytest.mark.parametrize("column", ["score", "bill", "nights"])
def test_statistics_of_numbers(data, sql, column):
    got = rows.column_stats(data, column, [{"column": column, "op": "is_null"}])
    known = sorted(float(v) for (v,) in sql(f"SELECT {column} FROM fixture WHERE {column} IS NOT NULL"))
    assert (got["total"], got["non_null"], got["nulls"]) == (143, len(known), 143 - len(known))
    assert (got["lo"], got["hi"], got["mean"], got["med"]) == pytest.approx((known[0], known[-1], statistics.fmean(known), statistics.median(known)))
    assert abs(got["distinct_approx"] - len(set(known))) <= 0.1 * len(set(known))


def test_statistics_of_others(data):
    assert {"lo", "hi"} <= rows.column_stats(data, "woken").keys() and "med" not in rows.column_stats(data, "entered")
    assert not {"lo", "mean"} & rows.column_stats(data, "room").keys()
    none = rows.column_stats(data, "score", [{"column": "stay", "op": "lt", "value": 0}])
    assert none["total"] == 0 and none["med"] is None and none["mean"] is None


def test_chunks(data):
    sizes = [len(chunk) for _, chunk in rows.iter_rows(data, chunk_size=50)]
    assert sizes == [50, 50, 43]
    got = [r.stay for _, chunk in rows.iter_rows(data, columns=["stay"], order_by="stay", row_limit=60, chunk_size=25) for r in chunk]
    assert got == list(range(1000, 1060))


def test_jsonable():
    told = rows.jsonable({"a": (decimal.Decimal("-0.25"), float("-inf")), 2: [bytes(range(70)), None, True]})
    assert told == {"a": [-0.25, "-inf"], "2": ["0x" + bytes(range(64)).hex(), None, True]}


@pytest.mark.parametrize("column", ["score", "extras", "room", "settled", "entered", "arrived", "bill", "nights", "remark"])
def test_text_form(data, sql, column):
    got = data.df.orderBy("stay").select(text_of(data.df[column], data.by_name[column].kind)).collect()
    assert [r[0] for r in got] == [t for (t,) in sql(f"SELECT CAST({column} AS VARCHAR) FROM fixture ORDER BY stay")]


def test_text_of_floats(spark, con):
    values = [3e25, -4.25e-9, 98765432.5, 0.00025, 7e15, -6.5e-5, 31415926535.75, float("nan"), float("-inf"), -0.0, 1.0, 123.456]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(text_of(df.v, df.schema["v"].dataType)).collect()]
    assert got == [con.execute("SELECT CAST(? AS VARCHAR)", [v]).fetchall()[0][0] for v in values]
