from __future__ import annotations

import duckdb
import pytest

from gridlens.session import session
from gridlens.sources import parquet

#: Stays in hostels: squares and co-primes spread NULLs, blanks, ties and wildcards over 143 rows.
FIXTURE = """
SELECT (1000 + k)::INTEGER AS stay,
  CASE k * k % 13 WHEN 0 THEN NULL WHEN 1 THEN 'Oslo' WHEN 3 THEN 'Bergen' WHEN 4 THEN 'oslo' ELSE 'Narvik' END AS town,
  CASE WHEN k % 12 = 5 THEN '' WHEN k % 12 = 8 THEN NULL ELSE 'bed_' || (k % 31) || '%' || repeat('!', (k % 3)::INTEGER) END AS remark,
  CASE WHEN k % 17 <> 6 THEN (k * 29 % 143) / 8 - 4 END::DOUBLE AS score,
  (k % 11 - 3)::SMALLINT AS nights,
  (k * 7.125 - 90)::DECIMAL(12, 3) AS bill,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS settled,
  make_date(1999 + (k % 4)::INTEGER, 1 + (k * 5 % 12)::INTEGER, 1 + (k % 28)::INTEGER) AS arrived,
  TIMESTAMP '2000-02-28 22:10:05.25' + to_seconds(k * 4111) AS entered,
  TIME '00:00:30' + to_seconds(k * 601) AS woken,
  strftime(make_date(1999 + (k % 4)::INTEGER, 1 + (k * 5 % 12)::INTEGER, 1 + (k % 28)::INTEGER), '%d-%b-%Y') AS arrived_words,
  strftime(make_date(1999 + (k % 4)::INTEGER, 1 + (k * 5 % 12)::INTEGER, 1 + (k % 28)::INTEGER), '%Y%m%d')::BIGINT AS arrived_digits,
  ['b' || (k % 6), NULL, 'x'] AS extras,
  {'floor': k % 4, 'wing': CASE WHEN k % 9 > 0 THEN 'w' || (k % 2) END} AS room
FROM range(143) t(k)
"""


@pytest.fixture(scope="session")
def spark():
    one = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g")
    one.sparkContext.setLogLevel("ERROR")
    yield one
    one.stop()


@pytest.fixture(scope="session")
def con():
    with duckdb.connect() as one:
        one.execute(f"CREATE TABLE fixture AS {FIXTURE}")
        yield one


@pytest.fixture(scope="session")
def fixture_path(con, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "fixture.parquet")
    con.execute(f"COPY fixture TO '{path}' (FORMAT parquet)")
    return path


@pytest.fixture(scope="session")
def data(spark, fixture_path):
    return parquet.open_path(spark, fixture_path)


@pytest.fixture(scope="session")
def sql(con):
    return lambda text: con.execute(text).fetchall()
