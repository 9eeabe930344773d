"""Categories of types, and the text form of any value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as C
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIME = getattr(T, "TimeType", ())
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType, *([_TIME] if _TIME else []))


def category(kind: T.DataType) -> str:
    """boolean, complex, temporal, numeric, text or other: what may be done with a column."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return "complex"
    if isinstance(kind, TEMPORAL):
        return "temporal"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return "text"
    return "other"


def has_calendar(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


@dataclass(frozen=True)
class Field:
    """A column as users see it: name, type, category and the date formats its text may have."""

    name: str
    kind: T.DataType
    date_formats: tuple[str, ...] = ()

    @property
    def category(self) -> str:
        return category(self.kind)

    @property
    def type(self) -> str:
        return self.kind.simpleString()

    def told(self) -> dict:
        return {"name": self.name, "type": self.type, "category": self.category, "date_formats": list(self.date_formats)}


def _decimal_text(c: C, scale: int) -> C:
    plain = F.rtrim(c.cast(f"decimal(38,{scale})").cast("string"), F.lit("0"))
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)


def _float_text(c: C) -> C:
    """Plain notation from 1e-4 to 1e16, else like 1e+20; Spark's own differs outside 1e-3 to 1e7."""
    size, own = F.abs(c), c.cast("string")
    power = F.regexp_extract(own, r"E(-?[0-9]+)$", 1)
    base = F.regexp_replace(F.regexp_extract(own, r"^([^E]*)E", 1), r"\.0$", "")
    sign = F.when(power.startswith("-"), F.lit("-")).otherwise(F.lit("+"))
    digits = F.regexp_replace(power, "-", "")
    far = F.concat(base, F.lit("e"), sign, F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    words = F.lower(F.regexp_replace(own, "Infinity", "inf"))
    return (
        F.when(F.isnan(c) | (size == float("inf")), words)
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), own)
        .when((size >= 1e7) & (size < 1e16), _decimal_text(c, 10))
        .when((size >= 1e-4) & (size < 1e-3), _decimal_text(c, 25))
        .otherwise(far)
    )


def text_of(c: C, kind: T.DataType) -> C:
    """The text that filters and value lists compare."""
    if isinstance(kind, T.StringType):
        return c.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _float_text(c)
    if isinstance(kind, T.BinaryType):
        pairs = F.regexp_replace(F.hex(c), "(..)", r"\\\\x$1")
        plain = c.cast("string")
        return F.when(plain.rlike(r"^[ !#-&(-\[\]-~]*$"), plain).otherwise(pairs)
    if isinstance(kind, T.ArrayType):
        each = F.transform(c, lambda x: F.coalesce(text_of(x, kind.elementType), F.lit("NULL")))
        return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))
    if isinstance(kind, T.StructType):
        each = [F.concat(F.lit(f"'{f.name}': "), F.coalesce(text_of(c.getField(f.name), f.dataType), F.lit("NULL"))) for f in kind]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *each), F.lit("}")))
    if isinstance(kind, T.MapType):
        value = lambda e: F.coalesce(text_of(e.getField("value"), kind.valueType), F.lit("NULL"))
        each = F.transform(F.map_entries(c), lambda e: F.concat(text_of(e.getField("key"), kind.keyType), F.lit("="), value(e)))
        return F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))
    return c.cast("string")
