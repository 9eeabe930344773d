"""One file from a DataFrame: executors write parts, the driver joins them as streams."""

from __future__ import annotations

import glob
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.kinds import category, text_of


def write(df: DataFrame, destination: str, fmt: str) -> None:
    """``destination`` as csv, parquet (zstd) or json (one array); anything else is a KeyError."""
    writer = {"csv": _csv, "parquet": _parquet, "json": _json}[fmt]
    folder = tempfile.mkdtemp(prefix=".gridlens-", dir=os.path.dirname(os.path.abspath(destination)))
    try:
        writer(df, f"{folder}/out", destination)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _parts(folder: str) -> list[str]:
    return sorted(p for p in glob.glob(f"{folder}/part-*") if os.path.getsize(p))


def _texts(df: DataFrame, nested: bool) -> DataFrame:
    """``df`` with what the format has no form for as text: times of day and binary, for CSV nested columns too."""
    plain = (T.BooleanType, T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    own = lambda f: isinstance(f.dataType, plain) or category(f.dataType) == "complex" and not nested
    c = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    return df.select(*[c(f) if own(f) else text_of(c(f), f.dataType).alias(f.name) for f in df.schema])


def _csv(df: DataFrame, folder: str, destination: str) -> None:
    """Parts without headers after one header line; sorted parts stay in order."""
    stamp = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    _texts(df, nested=True).write.options(header=False, emptyValue='""', escape='"', timestampFormat=stamp, timestampNTZFormat=stamp).csv("file://" + folder)
    quoted = ['"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in df.columns]
    with open(destination, "wb") as out:
        out.write((",".join(quoted) + "\n").encode())
        for part in _parts(folder):
            with open(part, "rb") as data:
                shutil.copyfileobj(data, out, 1 << 20)


def _parquet(df: DataFrame, folder: str, destination: str) -> None:
    df.coalesce(1).write.option("compression", "zstd").parquet("file://" + folder)
    shutil.move(glob.glob(f"{folder}/part-*")[0], destination)


def _json(df: DataFrame, folder: str, destination: str) -> None:
    _texts(df, nested=False).write.options(ignoreNullFields=False).json("file://" + folder)
    with open(destination, "wb") as out:
        out.write(b"[")
        first = True
        for part in _parts(folder):
            with open(part, "rb") as data:
                for line in data:
                    out.write(b"\n\t" if first else b",\n\t")
                    out.write(line.rstrip(b"\n"))
                    first = False
        out.write(b"\n]\n")
