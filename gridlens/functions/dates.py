"""Dates held as text or integers: formats, parsing, detection from a sample."""

from __future__ import annotations

import datetime
import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats tried, in this order (day first wins a tie), and blanks that stand for no date.
FORMATS = (
    "iso",
    "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y",
    "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M",
    "%d-%m-%Y %H:%M:%S", "%d.%m.%Y %H:%M:%S",
    "%Y%m%d", "%Y%m%d%H%M%S",
    "%d-%b-%Y", "%d %b %Y", "%d-%b-%y", "%b %d, %Y", "%b %d %Y", "%d %B %Y", "%B %d, %Y",
    "%d/%m/%y", "%m/%d/%y",
)
COMPACT = ("%Y%m%d", "%Y%m%d%H%M%S")
PLACEHOLDERS = {"", "null", "none", "n/a", "na", "nan", "nat", "-", "--"}
SAMPLE = 2_000
PARTS = ("year", "month", "day")
#: Spark's letters for a directive, and what people read.
DIRECTIVES = {"%Y": ("yyyy", "YYYY"), "%y": ("yy", "YY"), "%m": ("M", "MM"), "%d": ("d", "DD"), "%H": ("H", "hh"), "%M": ("m", "mm"), "%S": ("s", "ss"), "%b": ("MMM", "Mon"), "%B": ("MMMM", "Month")}
#: A year, month and day that one sign separates; a time may follow.
ISO = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}([ T]|$)"
#: Some date, written in each format to see what its texts look like.
_SOME = datetime.datetime(2001, 9, 20, 10, 11, 12)


def _mapped(fmt: str, column: int) -> str:
    return functools.reduce(lambda text, d: text.replace(d, DIRECTIVES[d][column]), DIRECTIVES, fmt)


def label(fmt: str) -> str:
    """A format as people write it, like DD/MM/YYYY."""
    return "YYYY-MM-DD" if fmt == "iso" else _mapped(fmt, 1)


def outline(text: str) -> str:
    """``text`` with each run of digits as 0, of letters as a, of blanks as one: what differs between layouts."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "0", re.sub(r"\s+", " ", text)))


def _looks_like(text: str, fmt: str) -> bool:
    """Cheap and never wrong to refuse; :func:`_reads` decides."""
    if fmt == "iso":
        return bool(re.match(ISO, text))
    if fmt in COMPACT:
        return text.isdigit() and len(text) == len(_SOME.strftime(fmt))
    return outline(text) == outline(_SOME.strftime(fmt))


def checked(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported date format: {fmt!r}")
    return fmt


def parsed(c: Column, fmt: str) -> Column:
    """Text or integers read as timestamps without zone; what doesn't fit is NULL."""
    text = F.trim(c.cast("string"))
    if checked(fmt) == "iso":
        dashed = F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}"), F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/", "$1-$2-")).otherwise(text)
        return F.when(text.rlike(ISO), dashed.try_cast("timestamp_ntz"))
    pattern = "yyyyMMdd" + ("HHmmss" if "%H" in fmt else "") if fmt in COMPACT else _mapped(fmt, 0)
    if " " in fmt:
        text = F.regexp_replace(text, " +", " ")
    out = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    # Two-digit years from 69 on are of the last century.
    return F.when(F.year(out) >= 2069, out - F.expr("INTERVAL 100 YEARS")).otherwise(out) if "%y" in fmt else out


def part(c: Column, kind: T.DataType, name: str, fmt: str | None = None) -> Column:
    """year, month or day of a date, a timestamp, or of text or integers in ``fmt``, as bigint."""
    if name not in PARTS:
        raise ValueError(f"Unsupported extraction: {name!r}")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        when = c
    elif fmt:
        when = parsed(c, fmt)
    else:
        raise ValueError(f"Only dates, timestamps and columns that hold dates have a {name}, not {kind.simpleString()}")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[name](when).cast("bigint")


def _reads(text: str, fmt: str) -> bool:
    """Does one sampled text parse?"""
    text = re.sub(" +", " ", text.strip(" "))
    try:
        if fmt == "iso":
            if not re.match(ISO, text):
                return False
            day, _, rest = text.replace("T", " ", 1).partition(" ")
            y, m, d = map(int, re.split("[-/]", day))
            datetime.date(y, m, d)
            return not rest or bool(re.fullmatch(r"([01]?\d|2[0-3]):[0-5]?\d(:[0-5]?\d(\.\d*)?)?( ?(Z|UTC|[+-]\d{1,2}(:?\d{2})?))?", rest.strip()))
        datetime.datetime.strptime(text, fmt)
    except ValueError:
        return False
    return True


def detect(df: DataFrame) -> dict[str, tuple[str, ...]]:
    """Formats that every value of a sample of ``SAMPLE`` rows fits, by column. Never fails an open.

    Text columns may have any format, int and bigint ones the compact two. The sample is read
    once and both checked for shape and parsed on the driver.
    """
    tries = {f.name: FORMATS if isinstance(f.dataType, T.StringType) else COMPACT for f in df.schema if isinstance(f.dataType, (T.StringType, T.IntegerType, T.LongType))}
    if not tries:
        return {}
    try:
        quoted = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in tries]
        rows = df.select(*quoted).limit(SAMPLE).collect()
    except Exception:  # noqa: BLE001 - a column that can't be sampled has no formats
        return {}
    out = {}
    for k, (name, formats) in enumerate(tries.items()):
        values = {r[k].strip() for r in rows if r[k] is not None}
        values = {v for v in values if v.lower() not in PLACEHOLDERS}
        if values:
            fits = tuple(f for f in formats if all(_looks_like(v, f) for v in values) and all(_reads(v, f) for v in values))
            if fits:
                out[name] = fits
    return out
