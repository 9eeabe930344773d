"""Opening files, folders and unions; text dates."""

import os

import duckdb
import pytest

from gridlens.functions import dates
from gridlens.sources import parquet


def _copy(path, select):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with duckdb.connect() as con:
        con.execute(f"COPY ({select}) TO '{path}' (FORMAT parquet)")
    return str(path)


def test_open(data, fixture_path):
    assert (data.row_count, data.file_count, data.file_size) == (143, 1, os.path.getsize(fixture_path)) and len(data.id) == 12
    kinds = {}
    for f in data.fields:
        kinds.setdefault(f.category, []).append(f.name)
    assert kinds == {"numeric": ["stay", "score", "nights", "bill", "arrived_digits"], "text": ["town", "remark", "arrived_words"], "boolean": ["settled"], "temporal": ["arrived", "entered", "woken"], "complex": ["extras", "room"]}
    assert {f.name: f.date_formats for f in data.fields if f.date_formats} == {"arrived_words": ("%d-%b-%Y",), "arrived_digits": ("%Y%m%d",)}


def test_folder_reads_all_files(spark, tmp_path):
    _copy(tmp_path / "p1.parquet", "SELECT 1 AS a")
    _copy(tmp_path / "sub/p2.PARQUET", "SELECT 2 AS a")
    _copy(tmp_path / ".hidden/p3.parquet", "SELECT 3 AS a")
    one = parquet.open_path(spark, str(tmp_path))
    assert sorted(r.a for r in one.df.collect()) == [1, 2] and one.file_count == 2 and one.display_name == tmp_path.name


def test_folder_promotes_and_fills(spark, tmp_path):
    _copy(tmp_path / "1.parquet", "SELECT 1::INTEGER AS a, 1::INTEGER AS b")
    _copy(tmp_path / "2.parquet", "SELECT 5000000000 AS a, 2.5::DOUBLE AS b, 'x' AS c")
    one = parquet.open_path(spark, str(tmp_path))
    assert sorted(map(tuple, one.df.collect())) == [(1, 1.0, None), (5_000_000_000, 2.5, "x")]
    assert [f.type for f in one.fields] == ["bigint", "double", "string"]


def test_hive_folders(spark, tmp_path):
    _copy(tmp_path / "k=1/a.parquet", "SELECT 1 AS a")
    _copy(tmp_path / "k=2/a.parquet", "SELECT 2 AS a")
    one = parquet.open_path(spark, str(tmp_path))
    assert sorted(map(tuple, one.df.collect())) == [(1, 1), (2, 2)] and one.by_name["k"].type == "bigint"


def test_cannot_open(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        parquet.open_path(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        parquet.open_path(spark, str(tmp_path / "no.parquet"))
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(ValueError, match="can't be read"):
        parquet.open_path(spark, str(tmp_path / "bad.parquet"))


def test_union(spark, tmp_path):
    a = _copy(tmp_path / "a.parquet", "SELECT 1 AS x, 'p' AS y")
    b = _copy(tmp_path / "b c+.parquet", "SELECT 'q' AS y, 2 AS x")
    one = parquet.open_union(spark, [a, " ", b])
    assert sorted(map(tuple, one.df.collect())) == [(1, "p", "a.parquet"), (2, "q", "b c+.parquet")] and one.source_column == "source_file"
    assert parquet.open_union(spark, [a, b], source_column=False).df.columns == ["x", "y"]


def test_union_names_and_refusals(spark, tmp_path):
    a = _copy(tmp_path / "1/a.parquet", "SELECT 1 AS x, 'f' AS source_file")
    b = _copy(tmp_path / "2/a.parquet", "SELECT 2 AS x, 'g' AS source_file")
    one = parquet.open_union(spark, [a, b])
    assert one.source_column == "source_file_2" and {r.source_file_2 for r in one.df.collect()} == {a, b}
    c = _copy(tmp_path / "c.parquet", "SELECT '1' AS x, 2 AS z")
    with pytest.raises(ValueError, match="missing 'source_file'.*extra 'z'.*'x' is string, not int"):
        parquet.open_union(spark, [a, c])
    with pytest.raises(ValueError, match="File 2 is the same as file 1"):
        parquet.open_union(spark, [a, a])
    with pytest.raises(ValueError):
        parquet.open_union(spark, [a])


LAYOUTS = {
    "iso": ("2024-01-31", "iso"), "mdy": ("01/31/2024", "%m/%d/%Y"), "dotted": ("31.01.2024", "%d.%m.%Y"), "words": ("January 31, 2024", "%B %d, %Y"), "short": ("31-Jan-24", "%d-%b-%y"),
    "stamp": ("31/01/2024 10:11:12", "%d/%m/%Y %H:%M:%S"), "compact": ("20240131101112", "%Y%m%d%H%M%S"), "slashes": ("2024/1/31", "iso"),
}


def test_detects_and_parses_layouts(spark):
    df = spark.createDataFrame([tuple(v for v, _ in LAYOUTS.values())], list(LAYOUTS))
    found = dates.detect(df)
    for name, (_, fmt) in LAYOUTS.items():
        assert found[name][0] == fmt, name
        assert df.select(dates.part(df[name], df.schema[name].dataType, "day", fmt)).first()[0] == 31, name


def test_detection_refuses_lookalikes(spark):
    df = spark.createDataFrame([("ab12", "1.2.3", "32/13/2024", "N/A", "12/05", 12345, "05/06/2024"), ("cd34", "2.0.1", "31/12/2024", None, "13/05", 20240231, "07/08/2024")], "code string, version string, impossible string, blank string, no_year string, n int, either string")
    assert dates.detect(df) == {"either": ("%d/%m/%Y", "%m/%d/%Y")}


def test_parsing_edges(spark):
    read = lambda v, fmt: spark.createDataFrame([(v,)], "v string").select(dates.parsed(dates.F.col("v"), fmt)).first()[0]
    assert read("01/01/69", "%d/%m/%y").year == 1969 and read("01/01/68", "%d/%m/%y").year == 2068
    assert read("Jan  31, 2024", "%b %d, %Y").day == 31 and read("30/02/2024", "%d/%m/%Y") is None
    assert read("2024", "iso") is None and read("now", "iso") is None and read(None, "iso") is None
    assert dates.label("%d/%m/%Y %H:%M") == "DD/MM/YYYY hh:mm"
    with pytest.raises(ValueError):
        dates.parsed(dates.F.lit("x"), "%Q")
