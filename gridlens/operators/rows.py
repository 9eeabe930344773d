"""The four query families on one table: rows, count, values of a column, statistics of a column.

Each has a lazy form (``*_frame``) that stays in Spark and a form that returns plain data.
"""

from __future__ import annotations

import datetime
import decimal
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.kinds import Field, category, text_of
from gridlens.plans.filters import FilterError, conjunction, extracted
from gridlens.plans.pivot import medians
from gridlens.sources.parquet import Dataset

MOST_BYTES_SHOWN = 64


def filtered(data: Dataset, filters=(), skip: str | None = None) -> DataFrame:
    keep = conjunction(filters, data.by_name, skip)
    return data.df if keep is None else data.df.where(keep)


def _transform(value) -> tuple[str | None, str | None]:
    return (value, None) if isinstance(value, str) or value is None else (value.get("part"), value.get("format"))


def projection(data: Dataset, columns=None, transforms=None) -> list[tuple[Column, Field]]:
    """Chosen columns in request order, unknown ones dropped, all if none is left; extractions keep the column's name."""
    fields, transforms = data.by_name, transforms or {}
    for name in transforms:
        if name not in fields:
            raise FilterError(f"Unknown column: {name!r}")
    chosen = [fields[c] for c in columns or () if c in fields] or data.fields
    out = []
    for f in chosen:
        c, kind = extracted(f, *_transform(transforms.get(f.name)))
        out.append((c.alias(f.name), f if kind == f.kind else Field(f.name, kind)))
    for name, value in transforms.items():  # columns that aren't shown must have valid ones too
        extracted(fields[name], *_transform(value))
    return out


def rows_frame(data: Dataset, filters=(), columns=None, order_by=None, descending=False, transforms=None, limit=None, offset=0) -> tuple[DataFrame, list[Field]]:
    """Filtered, projected, sorted, paged rows. NULLs sort last either way, by the extraction if there is one; an unknown sort column is ignored."""
    chosen = projection(data, columns, transforms)
    df = filtered(data, filters)
    if order_by in data.by_name:
        key, _ = extracted(data.by_name[order_by], *_transform((transforms or {}).get(order_by)))
        df = df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())
    df = df.select(*[c for c, _ in chosen])
    if offset:
        df = df.offset(offset)
    return (df.limit(limit) if limit else df), [f for _, f in chosen]


def jsonable(value):
    """A value as JSON holds it."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return "0x" + bytes(value)[:MOST_BYTES_SHOWN].hex()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    return str(value) if isinstance(value, (datetime.timedelta, uuid.UUID)) else str(value)


def preview(data: Dataset, filters=(), columns=None, limit=10, offset=0, order_by=None, descending=False, transforms=None) -> dict:
    df, fields = rows_frame(data, filters, columns, order_by, descending, transforms, limit, offset)
    return {"columns": [f.told() for f in fields], "rows": [[jsonable(v) for v in r] for r in df.collect()]}  # a page


def count(data: Dataset, filters=()) -> int:
    return filtered(data, filters).count()


def values_frame(data: Dataset, name: str, filters=(), search="", limit=500, exact=None, transform=None, date_format=None) -> DataFrame:
    """(value, n) of a column under the other columns' filters, most frequent first, a date part in calendar order.

    ``exact`` (texts, case ignored) wins over ``search`` (part of the text, case ignored).
    """
    if name not in data.by_name:
        raise FilterError(f"Unknown column: {name!r}")
    c, kind = extracted(data.by_name[name], transform, date_format)
    shown = text_of(c, kind) if category(kind) == "complex" else c
    df = filtered(data, filters, skip=name)
    if exact:
        df = df.where(F.lower(text_of(c, kind)).isin(*[str(x).lower() for x in exact]))
    elif search:
        df = df.where(F.contains(F.lower(text_of(c, kind)), F.lit(str(search).lower())))
    df = df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.asc_nulls_last("value")] if transform else [F.desc("n"), F.asc_nulls_last("value")]
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def distinct_values(data: Dataset, name: str, filters=(), search="", limit=500, exact=None, transform=None, date_format=None) -> dict:
    rows = values_frame(data, name, filters, search, limit + 1, exact, transform, date_format).collect()  # limit + 1 rows
    return {"column": name, "values": [{"value": jsonable(v), "count": n} for v, n in rows[:limit]], "truncated": len(rows) > limit}


def stats_frame(data: Dataset, name: str, filters=(), transform=None, date_format=None) -> DataFrame:
    """One row: total, non_null, distinct_approx; lo, hi of numbers and times; mean, med of numbers."""
    if name not in data.by_name:
        raise FilterError(f"Unknown column: {name!r}")
    c, kind = extracted(data.by_name[name], transform, date_format)
    key = text_of(c, kind) if category(kind) == "complex" else c
    out = [F.count(F.lit(1)).alias("total"), F.count(c).alias("non_null"), F.approx_count_distinct(key).alias("distinct_approx")]
    if category(kind) in ("numeric", "temporal"):
        out += [F.min(c).alias("lo"), F.max(c).alias("hi")]
    if category(kind) == "numeric":
        out.append(F.avg(c.cast("double")).alias("mean"))
    df = filtered(data, filters, skip=name)
    if category(kind) != "numeric":
        return df.agg(*out)
    middle = medians(df.select(c.cast("double").alias("_v")), [], [[]], "_v", "med")
    return df.agg(*out).select("*", middle.scalar().alias("med"))


def column_stats(data: Dataset, name: str, filters=(), transform=None, date_format=None) -> dict:
    row = stats_frame(data, name, filters, transform, date_format).first().asDict()
    _, kind = extracted(data.by_name[name], transform, date_format)
    return {k: jsonable(v) for k, v in row.items()} | {"column": name, "category": category(kind), "nulls": row["total"] - row["non_null"]}


def iter_rows(data: Dataset, filters=(), columns=None, order_by=None, descending=False, chunk_size=50_000, row_limit=None, transforms=None) -> Iterator[tuple[list[Field], list]]:
    """(fields, rows) by chunks; one partition at a time is on the driver. A falsy limit means none."""
    df, fields = rows_frame(data, filters, columns, order_by, descending, transforms, row_limit or None)
    chunk = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) >= chunk_size:
            yield fields, chunk
            chunk = []
    if chunk:
        yield fields, chunk
