"""Parquet files, folders and unions of them as one lazy table.

Files are listed by Hadoop's file system, so any store that Spark reads will do, and read by
name with a base path: a plain folder read would miss files below it or lose ``k=v`` columns.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions import dates
from gridlens.functions.kinds import Field

_RANK = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


@dataclass
class Dataset:
    """An open table: a lazy DataFrame and what is known of it."""

    path: str | list[str]
    df: DataFrame
    fields: list[Field]
    row_count: int
    file_size: int
    file_count: int
    display_name: str
    is_temp: bool = False
    source_column: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    @property
    def by_name(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}

    @property
    def path_label(self) -> str:
        return self.path if isinstance(self.path, str) else " + ".join(self.path)

    def told(self) -> dict:
        return {"id": self.id, "path": self.path, "display_name": self.display_name, "columns": [f.told() for f in self.fields], "row_count": self.row_count, "file_size": self.file_size, "file_count": self.file_count, "is_temp": self.is_temp, "source_column": self.source_column}


def resolve(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """(base path, [(file, bytes)]) of a parquet file or of all below a folder, whatever their case; hidden ones are skipped."""
    path = os.path.expanduser(path.strip())
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("/") else os.path.abspath(path))
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise FileNotFoundError(f"No such file or folder: {path}")
    status = store.getFileStatus(where)
    if status.isFile():
        return status.getPath().toString(), [(status.getPath().toString(), status.getLen())]
    found, below = [], store.listFiles(where, True)
    root = status.getPath().toString()
    while below.hasNext():
        one = below.next()
        name = one.getPath().toString()
        parts = name[len(root) :].split("/")
        if name.lower().endswith(".parquet") and not any(p.startswith((".", "_")) for p in parts if p):
            found.append((name, one.getLen()))
    if not found:
        raise FileNotFoundError(f"No parquet files in {path}")
    return root, sorted(found)


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both, for files of one source."""
    if a == b:
        return a
    if type(a) in _RANK and type(b) in _RANK:
        return max(a, b, key=lambda t: _RANK.index(type(t)))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        return T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    raise ValueError(f"{a.simpleString()} and {b.simpleString()} don't go together")


def _hive(base: str, files: list[str]) -> list[str]:
    """Names of the ``k=v`` folders that every file has; a layout that some files lack is no partitioning."""
    keys = [[p.partition("=")[0] for p in f[len(base) :].split("/")[:-1] if "=" in p] for f in files]
    return keys[0] if all(k == keys[0] for k in keys) else []


def _reader(spark: SparkSession, base: str, files: list[str]):
    """Reads exactly ``files``: with partition columns where all have them, else without looking for any, which would lose files."""
    return spark.read.option("basePath", base) if _hive(base, files) else spark.read.option("recursiveFileLookup", "true")


def _schema(spark: SparkSession, base: str, files: list[str]) -> T.StructType:
    """Columns of all files by name, types promoted; executors read the footers unless types differ."""
    reader = lambda: _reader(spark, base, files)
    try:
        return reader().option("mergeSchema", "true").parquet(*files).schema
    except (PySparkException, Py4JError) as error:
        if "MERGE_SCHEMA" not in str(error) and "INCOMPATIBLE" not in str(error):
            raise _unreadable(error) from error
    with ThreadPoolExecutor(8) as pool:
        schemas = list(pool.map(lambda f: reader().parquet(f).schema, files))
    out: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema:
            try:
                out[f.name] = promoted(out[f.name], f.dataType) if f.name in out else f.dataType
            except ValueError as clash:
                raise ValueError(f"Column {f.name!r} differs between files: {clash}") from None
    return T.StructType([T.StructField(n, t) for n, t in out.items()])


def _unreadable(error: Exception) -> ValueError:
    return ValueError(f"The parquet can't be read: {str(error).splitlines()[0]}")


def _frame(spark: SparkSession, base: str, files: list[str]) -> DataFrame:
    schema = _schema(spark, base, files)
    if not len(schema):
        raise ValueError("The file has no columns")
    df = _reader(spark, base, files).schema(schema).parquet(*files)
    hive = _hive(base, files)
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("bigint") for f in df.schema if f.name in hive and isinstance(f.dataType, T.IntegerType)})


def _told(progress: Callable[[str], None] | None, text: str) -> None:
    if progress:
        progress(text)


def _fields(df: DataFrame) -> list[Field]:
    formats = dates.detect(df)
    return [Field(f.name, f.dataType, formats.get(f.name, ())) for f in df.schema]


def open_path(spark: SparkSession, path: str, is_temp: bool = False, display_name: str | None = None, progress=None) -> Dataset:
    """One file or folder. The row count comes from the footers: no column is read for it."""
    _told(progress, "Reading the schema")
    base, files = resolve(spark, path)
    df = _frame(spark, base, [f for f, _ in files])
    _told(progress, "Looking for dates in text columns")
    fields = _fields(df)
    _told(progress, "Counting rows")
    try:
        rows = df.count()
    except (PySparkException, Py4JError) as error:
        raise _unreadable(error) from error
    clean = os.path.expanduser(path.strip())
    return Dataset(clean, df, fields, rows, sum(n for _, n in files), len(files), display_name or os.path.basename(clean.rstrip("/")), is_temp)


def _provenance(df: DataFrame, whole: bool) -> DataFrame:
    """``df`` with each row's file, by name or as a whole path."""
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    path = F.regexp_replace(path, r"^file:/+", "/")
    return df.select("*", (path if whole else F.substring_index(path, "/", -1)).alias("__source"))


def open_union(spark: SparkSession, paths: list[str], source_column: bool = True, progress=None) -> Dataset:
    """Two or more sources with the same columns, in any order, as one table; by default with a column for each row's file."""
    paths = [p.strip() for p in paths if p and p.strip()]
    if len(paths) < 2:
        raise ValueError("A union needs two files or more")
    seen: dict[str, int] = {}
    sources = []
    for k, path in enumerate(paths, 1):
        base, files = resolve(spark, path)
        if base in seen:
            raise ValueError(f"File {k} is the same as file {seen[base]}")
        seen[base] = k
        _told(progress, f"Reading the schema of file {k}")
        sources.append((base, files, _frame(spark, base, [f for f, _ in files])))
    first = {f.name: f.dataType for f in sources[0][2].schema}
    wrong = []
    for k, (_, _, df) in enumerate(sources[1:], 2):
        own = {f.name: f.dataType for f in df.schema}
        said = [f"missing {n!r}" for n in first if n not in own] + [f"extra {n!r}" for n in own if n not in first]
        said += [f"{n!r} is {own[n].simpleString()}, not {t.simpleString()}" for n, t in first.items() if n in own and own[n] != t]
        if said:
            wrong.append(f"file {k}: " + ", ".join(said))
    if wrong:
        raise ValueError("The files don't have the same columns: " + "; ".join(wrong))
    name = None
    frames = [df for _, _, df in sources]
    if source_column:
        name, k = "source_file", 1
        while name in first:
            k += 1
            name = f"source_file_{k}"
        names = [os.path.basename(base) for base, _, _ in sources]
        whole = len(set(names)) < len(names) or any(len(files) > 1 for _, files, _ in sources)
        frames = [_provenance(df, whole).withColumnRenamed("__source", name) for df in frames]
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other)
    _told(progress, "Looking for dates in text columns")
    fields = _fields(df)
    _told(progress, "Counting rows")
    files = [f for _, fs, _ in sources for f in fs]
    label = " + ".join(os.path.basename(p.rstrip("/")) for p in paths)
    return Dataset(paths, df, fields, df.count(), sum(n for _, n in files), len(files), label, source_column=name)
