"""Queries over the driver's tables, one per operator, each beside the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions import dates
from gridlens.functions.kinds import Field
from gridlens.operators import crosstab, rows
from gridlens.plans import filters
from gridlens.plans import pivot as P
from gridlens.session import prepared
from gridlens.sinks import files
from gridlens.sources import parquet

#: Derived tables: NULLs, blanks and dates as text, which the driver's tables don't hold. Expressions that both engines read.
DERIVED = {
    "ev": ("events", "SELECT event_id, ts, user_id, value, nullif(event_type, 'click') AS kind, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 <> 0 THEN event_type END AS label, nullif(user_id % 50, 3) AS bucket, value > 50 AS high FROM events"),
    "od": ("orders", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS priority, {day} AS day_text, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS day_int FROM orders"),
    "li": ("lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_shipdate, nullif(l_returnflag, 'R') AS flag, l_linestatus AS status FROM lineitem"),
}
_DAY = {"spark": "date_format(o_orderdate, 'dd/MM/yyyy')", "duckdb": "strftime(o_orderdate, '%d/%m/%Y')"}



def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, on one machine else."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return f"{top}/explorer-{uuid.uuid4().hex}"
    return "file://" + tempfile.mkdtemp(prefix="gridlens-")


Query = Callable[[SparkSession, str], DataFrame]


def dataset(spark: SparkSession, df: DataFrame, formats: dict[str, tuple[str, ...]] | None = None) -> parquet.Dataset:
    """A table that is already a DataFrame."""
    prepared(spark)
    fields = [Field(f.name, f.dataType, (formats or {}).get(f.name, ())) for f in df.schema]
    return parquet.Dataset("", df, fields, -1, 0, 0, "")


def table(spark: SparkSession, sf_dir: str, name: str) -> parquet.Dataset:
    prepared(spark)
    source, sql = DERIVED.get(name, (name, None))
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if sql:
        df = spark.sql(sql.format(day=_DAY["spark"]).replace(f"FROM {source}", "FROM {frame}"), frame=df)
    return dataset(spark, df)


def _from(name: str) -> str:
    source, sql = DERIVED.get(name, (name, None))
    return f"({sql.format(day=_DAY['duckdb'])}) t" if sql else name


def _filter(name: str, where: str, *specs: dict, show: str = "") -> tuple[Query, str]:
    """Rows of a derived table that pass the specs."""
    key = {"ev": "event_id", "od": "o_orderkey", "li": "l_orderkey"}[name]
    columns = [key, *show.split()]

    def query(spark, sf_dir):
        return rows.rows_frame(table(spark, sf_dir, name), specs, columns)[0]

    return query, f"SELECT {', '.join(columns)} FROM {_from(name)} WHERE {where}"


def _pivot(name: str, fields: tuple[list[str], list[str]], values: list[dict], measures: dict[str, str], sets: str, filters=(), where="TRUE", subtotals=True, casts: dict[str, str] | None = None) -> tuple[Query, str]:
    """Long cells of a cross-tab: keys, flags, measures (``casts``: what each is rounded or cast by, in both engines)."""
    casts = casts or {}

    def query(spark, sf_dir):
        out = crosstab.cells_frame(table(spark, sf_dir, name), *fields, values, filters, subtotals)
        return out.withColumns({k: F.expr(c.format(k)) for k, c in casts.items()})

    both = [*fields[0], *fields[1]]
    flags = [f"CAST(grouping({f}) AS INT) AS g_{f}" for f in both]
    told = [f"{casts.get(k, '{}').format(sql)} AS {k}" for k, sql in measures.items()]
    return query, f"SELECT {', '.join([*both, *flags, *told])} FROM {_from(name)} WHERE {where} GROUP BY GROUPING SETS ({sets})"



def _filters() -> dict[str, tuple[Query, str]]:
    f = lambda column, op, **more: {"column": column, "op": op, **more}
    out = {
        "f_in": _filter("ev", "kind IN ('view', 'purchase')", f("kind", "in", values=["view", "purchase"])),
        "f_in_null": _filter("ev", "kind IN ('view') OR kind IS NULL", f("kind", "in", values=["view", None])),
        "f_in_only_null": _filter("ev", "kind IS NULL", f("kind", "in", values=["__PQS_NULL__"])),
        "f_not_in": _filter("ev", "kind NOT IN ('view') OR kind IS NULL", f("kind", "not_in", values=["view"])),
        "f_not_in_null": _filter("ev", "kind NOT IN ('view') AND kind IS NOT NULL", f("kind", "not_in", values=["view", None])),
        "f_in_fold": _filter("ev", "lower(kind) IN ('view')", f("kind", "in", values=["VIEW"], case_sensitive=False)),
        "f_in_number": _filter("ev", "bucket IN (1, 6)", f("bucket", "in", values=["1", "5.6"])),
        "f_between": _filter("ev", "value BETWEEN 10.5 AND 60", f("value", "between", value="10.5", value2=60)),
        "f_between_open": _filter("ev", "value >= 42", f("value", "between", value=42, value2="")),
        "f_between_time": _filter("ev", "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:30:00'", f("ts", "between", value="2024-01-05", value2="2024-01-20 12:30:00")),
        "f_not_between": _filter("ev", "bucket NOT BETWEEN 5 AND 40", f("bucket", "not_between", value=5, value2=40)),
        "f_contains": _filter("ev", "contains(lower(label), 'ew')", f("label", "contains", value="EW")),
        "f_contains_case": _filter("ev", "contains(label, 'ew')", f("label", "contains", value="ew", case_sensitive=True)),
        "f_contains_number": _filter("ev", "contains(CAST(user_id AS VARCHAR), '12')", f("user_id", "contains", value="12")),
        "f_not_contains": _filter("ev", "NOT contains(lower(label), 'ew') OR label IS NULL", f("label", "not_contains", value="ew")),
        "f_starts_with": _filter("ev", "starts_with(lower(label), 'pu')", f("label", "starts_with", value="Pu")),
        "f_ends_with": _filter("ev", "ends_with(lower(label), 'w')", f("label", "ends_with", value="W")),
        "f_regex": _filter("ev", "regexp_matches(label, '^[a-m].*k?$')", f("label", "regex", value="^[a-m].*k?$")),
        "f_is_null": _filter("ev", "label IS NULL", f("label", "is_null")),
        "f_is_not_null": _filter("ev", "label IS NOT NULL", f("label", "is_not_null")),
        "f_is_empty": _filter("ev", "label IS NULL OR label = ''", f("label", "is_empty")),
        "f_is_not_empty": _filter("ev", "label IS NOT NULL AND label <> ''", f("label", "is_not_empty")),
        "f_boolean": _filter("ev", "high = TRUE", f("high", "eq", value="yes")),
        "f_year_eq": _filter("od", "year(o_orderdate) = 1995", f("o_orderdate", "eq", value=1995, transform="year")),
        "f_text_date_month": _filter("od", "month(strptime(day_text, '%d/%m/%Y')) IN (1, 12)", f("day_text", "in", values=[1, 12], transform="month", date_format="%d/%m/%Y")),
        "f_int_date_day": _filter("od", "day_int % 100 <= 3", f("day_int", "lte", value=3, transform="day", date_format="%Y%m%d")),
        "f_multi_and": _filter("ev", "value > 20 AND value < 80 AND kind = 'view'", f("value", "gt", value=20), f("value", "lt", value=80), f("kind", "eq", value="view")),
        "f_disabled": _filter("ev", "value > 90", f("value", "gt", value=90), f("kind", "eq", value="none", enabled=False)),
    }
    for op, sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
        out[f"f_{op}"] = _filter("ev", f"bucket {sign} 7", f("bucket", op, value="7"))
    return out


def _rows() -> dict[str, tuple[Query, str]]:
    def frame(name, **how):
        return lambda spark, sf_dir: rows.rows_frame(table(spark, sf_dir, name), **how)[0]

    def values(name, column, **how):
        return lambda spark, sf_dir: rows.values_frame(table(spark, sf_dir, name), column, **({"limit": None} | how))

    def stats(name, column, *keep, **how):
        return lambda spark, sf_dir: rows.stats_frame(table(spark, sf_dir, name), column, **how).select("total", "non_null", *[F.expr(k) for k in keep])

    def approximate(spark, sf_dir):
        """Is the approximate count of distinct values within a twentieth of the exact one?"""
        data = table(spark, sf_dir, "ev")
        exact = data.df.agg(F.count_distinct("user_id").alias("exact"))
        return rows.stats_frame(data, "user_id").select((F.abs(F.col("distinct_approx") - exact.scalar()) <= exact.scalar() * 0.05).alias("within"))

    high = [{"column": "value", "op": "gt", "value": 50}]
    ev, od = _from("ev"), _from("od")
    return {
        "p_project": (frame("ev", columns=["label", "nope", "event_id"]), f"SELECT label, event_id FROM {ev}"),
        "p_extract": (frame("od", columns=["o_orderkey", "o_orderdate"], transforms={"o_orderdate": "year"}), f"SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate FROM {od}"),
        "p_extract_text": (frame("od", columns=["o_orderkey", "day_text"], transforms={"day_text": {"part": "day", "format": "%d/%m/%Y"}}), f"SELECT o_orderkey, CAST(day(o_orderdate) AS BIGINT) AS day_text FROM {od}"),
        "p_extract_int": (frame("od", columns=["o_orderkey", "day_int"], transforms={"day_int": {"part": "month", "format": "%Y%m%d"}}), f"SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS day_int FROM {od}"),
        "o_sort_nulls_last": (frame("od", columns=["priority"], order_by="priority"), f"SELECT priority FROM {od} ORDER BY priority NULLS LAST"),
        "o_sort_desc": (frame("od", columns=["priority"], order_by="priority", descending=True), f"SELECT priority FROM {od} ORDER BY priority DESC NULLS LAST"),
        "o_page": (frame("od", columns=["o_orderkey"], order_by="o_orderkey", limit=50, offset=100), f"SELECT o_orderkey FROM {od} ORDER BY o_orderkey LIMIT 50 OFFSET 100"),
        "o_topk": (frame("od", columns=["o_orderkey"], order_by="o_orderkey", descending=True, limit=25), f"SELECT o_orderkey FROM {od} ORDER BY o_orderkey DESC LIMIT 25"),
        "a_count": (lambda spark, sf_dir: rows.filtered(table(spark, sf_dir, "ev"), high).agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM {ev} WHERE value > 50"),
        "a_values": (values("ev", "kind", filters=high), f"SELECT kind AS value, count(*) AS n FROM {ev} WHERE value > 50 GROUP BY 1"),
        "a_values_own": (values("ev", "value", filters=high), f"SELECT value, count(*) AS n FROM {ev} GROUP BY 1"),
        "a_values_search": (values("ev", "label", search="IE"), f"SELECT label AS value, count(*) AS n FROM {ev} WHERE contains(lower(label), 'ie') GROUP BY 1"),
        "a_values_exact": (values("ev", "label", exact=["VIEW", "Purchase"]), f"SELECT label AS value, count(*) AS n FROM {ev} WHERE lower(label) IN ('view', 'purchase') GROUP BY 1"),
        "a_values_year": (values("od", "o_orderdate", transform="year"), f"SELECT CAST(year(o_orderdate) AS BIGINT) AS value, count(*) AS n FROM {od} GROUP BY 1"),
        "a_stats": (stats("ev", "bucket", "lo", "hi", "round(mean, 6) AS mean", "med"), f"SELECT count(*) AS total, count(bucket) AS non_null, min(bucket) AS lo, max(bucket) AS hi, round(avg(CAST(bucket AS DOUBLE)), 6) AS mean, median(CAST(bucket AS DOUBLE)) AS med FROM {ev}"),
        "a_stats_time": (stats("ev", "ts", "lo", "hi"), f"SELECT count(*) AS total, count(ts) AS non_null, min(ts) AS lo, max(ts) AS hi FROM {ev}"),
        "a_stats_text": (stats("ev", "label"), f"SELECT count(*) AS total, count(label) AS non_null FROM {ev}"),
        "a_values_top": (values("ev", "bucket", limit=7), f"SELECT bucket AS value, count(*) AS n FROM {ev} GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 7"),
        "a_values_days": (values("od", "day_text", transform="day", date_format="%d/%m/%Y", limit=12), f"SELECT CAST(day(o_orderdate) AS BIGINT) AS value, count(*) AS n FROM {od} GROUP BY 1 ORDER BY 1 LIMIT 12"),
        "a_values_nested": (lambda spark, sf_dir: rows.values_frame(dataset(spark, table(spark, sf_dir, "ev").df.select(F.struct("high", "kind").alias("pair"))), "pair", limit=None), f"SELECT CAST({{'high': high, 'kind': kind}} AS VARCHAR) AS value, count(*) AS n FROM {ev} GROUP BY 1"),
        "a_stats_unique": (stats("li", "l_extendedprice", "lo", "hi", "round(med, 6) AS med"), f"SELECT count(*) AS total, count(l_extendedprice) AS non_null, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(median(l_extendedprice), 6) AS med FROM {_from('li')}"),
        "a_stats_approx": (approximate, "SELECT TRUE AS within"),
    }


def _pivots() -> dict[str, tuple[Query, str]]:
    price = {"column": "l_extendedprice", "agg": "sum", "label": "revenue"}
    both, money = "(flag, status), (flag), (status), ()", "round({}, 2)"
    aggregates = {
        "sum": ("l_quantity", "sum(l_quantity)", "round({}, 2)"),
        "sum_whole": ("l_partkey", "sum(l_partkey)", "CAST({} AS BIGINT)"),
        "avg": ("l_discount", "avg(CAST(l_discount AS DOUBLE))", "round({}, 6)"),
        "min": ("l_shipdate", "min(l_shipdate)", "{}"),
        "max": ("status", "max(status)", "{}"),
        "count": ("flag", "count(flag)", "{}"),
        "count_distinct": ("l_partkey", "count(DISTINCT l_partkey)", "{}"),
        "median": ("l_quantity", "median(CAST(l_quantity AS DOUBLE))", "{}"),
        "stddev": ("l_quantity", "stddev_samp(CAST(l_quantity AS DOUBLE))", "round({}, 6)"),
        "count_rows": ("", "count(*)", "{}"),
    }
    out = {
        "g_rows": _pivot("li", (["flag", "status"], []), [price], {"revenue": "sum(l_extendedprice)"}, "(flag, status), (flag), ()", casts={"revenue": money}),
        "g_rows_cols": _pivot("li", (["flag"], ["status"]), [price], {"revenue": "sum(l_extendedprice)"}, both, casts={"revenue": money}),
        "g_no_subtotals": _pivot("li", (["flag", "status"], ["l_linenumber"]), [price], {"revenue": "sum(l_extendedprice)"}, "(flag, status, l_linenumber), (flag, status), (l_linenumber), ()", subtotals=False, casts={"revenue": money}),
        "g_cols_only": _pivot("li", ([], ["status"]), [price], {"revenue": "sum(l_extendedprice)"}, "(status), ()", casts={"revenue": money}),
        "g_three_levels": _pivot("li", (["flag", "status", "l_linenumber"], []), [{"agg": "count_rows", "label": "n"}], {"n": "count(*)"}, "(flag, status, l_linenumber), (flag, status), (flag), ()"),
        "g_wide_key": _pivot("od", (["o_custkey"], []), [{"column": "o_totalprice", "agg": "sum", "label": "total"}], {"total": "sum(o_totalprice)"}, "(o_custkey), ()", casts={"total": money}),
        "g_empty": _pivot("li", (["flag"], []), [{"agg": "count_rows", "label": "n"}, price], {"n": "count(*)", "revenue": "sum(l_extendedprice)"}, "(flag), ()", filters=[{"column": "l_quantity", "op": "lt", "value": 0}], where="l_quantity < 0", casts={"revenue": money}),
        "g_mixed": _pivot("li", (["flag"], []), [{"column": c, "agg": a, "label": f"m_{a}"} for a, (c, _, _) in aggregates.items() if a in ("sum", "count_distinct", "median", "stddev")], {f"m_{a}": s for a, (_, s, _) in aggregates.items() if a in ("sum", "count_distinct", "median", "stddev")}, "(flag), ()", casts={f"m_{a}": k for a, (_, _, k) in aggregates.items() if a in ("sum", "count_distinct", "median", "stddev")}),
    }
    for name, (column, sql, cast) in aggregates.items():
        spec = {"column": column, "agg": name.removesuffix("_whole"), "label": "m"}
        out[f"g_{name}"] = _pivot("li", (["status"], ["flag"]), [spec], {"m": sql}, both, casts={"m": cast})

    def windowed(spark, sf_dir):
        data = table(spark, sf_dir, "od")
        window = P.key_window(data.df, ["o_custkey"], 40)
        cells = P.cells(P.within(data.df, window, ["o_custkey"]), ["o_custkey"], [], P.checked(["o_custkey"], [], [{"agg": "count_rows"}], data.by_name), sets=[["o_custkey"]])
        return cells.select(F.col("_k0").alias("o_custkey"), F.col("_m0").alias("n"))

    def assembled(name, fields, values, **how):
        """Rows of an assembled cross-tab, with their place."""
        def query(spark, sf_dir):
            found = crosstab.compute(table(spark, sf_dir, name), *fields, values, **how)["rows"]
            told = [(n, r["kind"], r["level"], " / ".join(r["labels"]), *[None if c is None else round(float(c), 2) for c in r["cells"]]) for n, r in enumerate(found)]
            width = len(told[0]) - 4
            return spark.createDataFrame(told, "place long, kind string, level long, labels string, " + ", ".join(f"c{i} double" for i in range(width)))

        return query

    def null_window(spark, sf_dir):
        data = table(spark, sf_dir, "ev")
        keys = P.key_window(data.df.where("bucket IS NULL OR bucket > 45"), ["bucket"], 10)
        return P.within(data.df, keys, ["bucket"]).select("event_id", "bucket")

    li, od = _from("li"), _from("od")
    n, name = {"agg": "count_rows", "label": "n"}, "coalesce({}, '(blank)')"
    flag, status = name.format("flag"), name.format("status")
    sums = f"SELECT flag, sum(l_extendedprice) AS s FROM {li} GROUP BY 1"
    out |= {
        "g_window_null": (null_window, f"SELECT event_id, bucket FROM {_from('ev')} WHERE bucket IS NULL OR bucket > 45"),
        "g_median_unique": _pivot("li", (["flag"], ["status"]), [{"column": "l_extendedprice", "agg": "median", "label": "m"}], {"m": "median(l_extendedprice)"}, both, casts={"m": "round({}, 6)"}),
        "g_value_sort": (assembled("li", (["flag"], []), [price], sort={"by": "value", "descending": True}), f"""
            SELECT row_number() OVER (ORDER BY s DESC NULLS LAST) - 1 AS place, 'data' AS kind, 1::BIGINT AS level, {flag} AS labels, round(s, 2) AS c0 FROM ({sums})
            UNION ALL SELECT (SELECT count(DISTINCT {flag}) FROM {li}), 'grand', 0, 'Grand Total', round(sum(l_extendedprice), 2) FROM {li}"""),
        "g_subtotal_rows": (assembled("li", (["flag", "status"], []), [n]), f"""
            SELECT row_number() OVER (ORDER BY gf, flag NULLS LAST, gs, status NULLS LAST) - 1 AS place, CASE WHEN gf = 1 THEN 'grand' WHEN gs = 1 THEN 'subtotal' ELSE 'data' END AS kind, (2 - gf - gs)::BIGINT AS level,
              CASE WHEN gf = 1 THEN 'Grand Total / ' WHEN gs = 1 THEN {flag} || ' Total / ' ELSE {flag} || ' / ' || {status} END AS labels, n::DOUBLE AS c0
            FROM (SELECT flag, status, grouping(flag) AS gf, grouping(status) AS gs, count(*) AS n FROM {li} GROUP BY ROLLUP (flag, status))"""),
        "g_cut": (assembled("od", (["o_custkey"], []), [n], max_rows=15), f"""
            (SELECT row_number() OVER (ORDER BY o_custkey) - 1 AS place, 'data' AS kind, 1::BIGINT AS level, CAST(o_custkey AS VARCHAR) AS labels, count(*)::DOUBLE AS c0 FROM {od} GROUP BY o_custkey ORDER BY o_custkey LIMIT 15)
            UNION ALL SELECT 15, 'grand', 0, 'Grand Total', count(*) FROM {od}"""),
    }
    out["g_windowed"] = (windowed, f"SELECT o_custkey, count(*) AS n FROM {od} WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 40) GROUP BY 1")
    out["g_row_groups"] = (lambda spark, sf_dir: P.row_groups(table(spark, sf_dir, "li").df, ["flag", "status"]).agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM (SELECT DISTINCT flag, status FROM {li})")
    out["g_outer_sizes"] = (lambda spark, sf_dir: P.outer_sizes(table(spark, sf_dir, "li").df, ["flag", "l_linenumber"]), f"SELECT flag AS value, count(*) AS groups FROM (SELECT DISTINCT flag, l_linenumber FROM {li}) GROUP BY 1")

    def overall(spark, sf_dir):
        data = table(spark, sf_dir, "li")
        return P.cells(data.df, [], [], [P.measure(price, data.by_name)], sets=[[]]).select(F.round("_m0", 2).alias("revenue"))

    out["g_overall"] = (overall, f"SELECT round(sum(l_extendedprice), 2) AS revenue FROM {li}")
    return out


def _sources() -> dict[str, tuple[Query, str]]:
    def opened(spark, sf_dir):
        return parquet.open_path(prepared(spark), f"{sf_dir}/nation.parquet").df

    def folder(spark, sf_dir):
        top = tempfile.mkdtemp()
        os.makedirs(f"{top}/k=1/below")
        for n, where in ((1, "k=1/below/a.PARQUET"), (2, "b.parquet")):
            files.write(spark.read.parquet(f"{sf_dir}/nation.parquet").where(F.col("n_regionkey") % 2 == n % 2), f"{top}/{where}", "parquet")
        return parquet.open_path(prepared(spark), top).df

    def union(spark, sf_dir):
        top, orders = tempfile.mkdtemp(), spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
        for name, rest in (("even.parquet", 0), ("odd.parquet", 1)):
            files.write(orders.where(F.col("o_orderkey") % 2 == rest).select(*orders.columns[:: 1 - 2 * rest]), f"{top}/{name}", "parquet")
        return parquet.open_union(prepared(spark), [f"{top}/even.parquet", f"{top}/odd.parquet"]).df

    def hive(spark, sf_dir):
        top = _scratch(spark)
        spark.read.parquet(f"{sf_dir}/nation.parquet").write.partitionBy("n_regionkey").parquet(f"{top}/t")
        return parquet.open_path(prepared(spark), f"{top}/t").df

    def merged(spark, sf_dir):
        """Parts with other columns and narrower types."""
        top, nation = _scratch(spark), spark.read.parquet(f"{sf_dir}/nation.parquet")
        nation.where("n_nationkey < 10").write.parquet(f"{top}/t/a")
        nation.where("n_nationkey >= 10").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.upper("n_name").alias("shout")).write.parquet(f"{top}/t/b")
        return parquet.open_path(prepared(spark), f"{top}/t").df

    def listed(values, names):
        return lambda spark, sf_dir: spark.createDataFrame(values(), ", ".join(f"{n} string" for n in names.split()))

    specs = [{"column": "a", "op": "not_in", "values": [None, 2]}, {"column": "b", "op": "between", "value": 1, "value2": 5, "transform": "year"}, {"column": "c", "op": "is_not_empty"}, {"column": "d", "op": "gte", "value": "x"}]
    sentences = ["a is none of [(blank), 2]", "b (year) between 1 .. 5", "c is not empty", "d gte x"]
    values_sql = lambda told, name: f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in told)}) AS t({name})"

    def detected(spark, sf_dir):
        found = dates.detect(table(spark, sf_dir, "od").df)
        return spark.createDataFrame([(k, ", ".join(v)) for k, v in found.items()], "name string, formats string")

    def exported(fmt):
        def query(spark, sf_dir):
            path = os.path.join(tempfile.mkdtemp(), f"out.{fmt}")
            files.write(rows.rows_frame(table(spark, sf_dir, "nation"), [{"column": "n_regionkey", "op": "in", "values": [1, 2]}], order_by="n_nationkey")[0], path, fmt)
            schema = "n_nationkey int, n_name string, n_regionkey int"
            return {"csv": lambda: spark.read.schema(schema).csv(path, header=True), "json": lambda: spark.read.schema(schema).json(path, multiLine=True), "parquet": lambda: spark.read.parquet(path)}[fmt]()

        return query

    some = "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2)"
    return {
        "s_hive": (hive, "SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
        "s_merge": (merged, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey < 10 THEN n_name END AS n_name, CASE WHEN n_nationkey < 10 THEN n_regionkey END AS n_regionkey, CASE WHEN n_nationkey >= 10 THEN upper(n_name) END AS shout FROM nation"),
        "f_describe": (listed(lambda: [(filters.describe(f),) for f in specs], "sentence"), values_sql(sentences, "sentence")),
        "u_pasted": (listed(lambda: [(v,) for v in filters.pasted('a, "b, c"\t d\n\na')], "value"), values_sql(["a", "b, c", "d"], "value")),
        "d_labels": (listed(lambda: [(f, dates.label(f)) for f in ("iso", "%d-%b-%y", "%m/%d/%Y %H:%M")], "format label"), "SELECT * FROM (VALUES ('iso', 'YYYY-MM-DD'), ('%d-%b-%y', 'DD-Mon-YY'), ('%m/%d/%Y %H:%M', 'MM/DD/YYYY hh:mm')) AS t(format, label)"),
        "s_open": (opened, "SELECT * FROM nation"),
        "s_folder": (folder, "SELECT * FROM nation"),
        "s_union_source": (union, "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even.parquet' ELSE 'odd.parquet' END AS source_file FROM orders"),
        "d_detect": (detected, "SELECT * FROM (VALUES ('day_text', '%d/%m/%Y'), ('day_int', '%Y%m%d')) AS t(name, formats)"),
        **{f"x_{fmt}": (exported(fmt), some) for fmt in ("csv", "json", "parquet")},
    }


def _all() -> dict[str, tuple[Query, str]]:
    return _filters() | _rows() | _pivots() | _sources()


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
