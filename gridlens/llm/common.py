"""Shared pieces: durable lineage cuts, component search, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none, and runs in one JVM, a temporary folder is set.
    """
    spec = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spec:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spec = "file://" + tempfile.mkdtemp(prefix="gridlens-")
        spark.sparkContext.setCheckpointDir(spec)
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (survives lost executors).

    What was shuffled to compute it is deleted at once rather than when the driver happens to
    collect its garbage: nothing reads it again.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_dir(spark)
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting it is made under
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def release(*frames: DataFrame) -> None:
    """Deletes what :func:`cut` wrote for ``frames``, which nothing may read any more."""
    for df in frames:
        spark = df.sparkSession
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_batches(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices each batch so that what one step holds is bounded by bytes, not by rows."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from a stream sorted by them.

    A run that spans batches is held until it ends; all others pass at once.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        same = np.ones(batch.num_rows, bool)
        for column in last:
            same &= np.asarray(pc.equal(column, column[-1]))
        ends = np.flatnonzero(~same)
        start = int(ends[-1]) + 1 if len(ends) else 0
        if held and (start or any(h != c[0] for h, c in zip([held[-1].column(held[-1].schema.get_field_index(k))[-1] for k in keys], last))):
            whole, tail = [*held, batch.slice(0, start)], batch.slice(start)
            yield pa.Table.from_batches(whole)
            held = [tail]
        elif start:
            yield pa.Table.from_batches([batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def forest(linked, labels: np.ndarray) -> list[tuple[int, int]]:
    """Edges that tie together the rows of a graph which have different ``labels``; rows of one label count as tied.

    ``linked(i, others)`` masks the neighbours of i among others. Rows that are tied already are not compared again.
    """
    rest, edges = np.arange(len(labels)), []
    while len(rest):
        own = labels[rest] == labels[rest[0]]
        queue, rest = rest[own].tolist(), rest[~own]
        while queue and len(rest):
            i = queue.pop()
            found = rest[linked(i, rest)]
            if len(found):
                new, at = np.unique(labels[found], return_index=True)
                edges += [(i, int(j)) for j in found[at]]
                own = np.isin(labels[rest], new)
                queue += rest[own].tolist()
                rest = rest[~own]
    return edges


#: Most edges (16 bytes each) whose components the driver finds; those of more are found by joins.
FEW = 1 << 18


def roots_of(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (v, u), each once, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate((v, u)), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    root, seen = np.arange(len(nodes)), None
    while seen is None or (root != seen).any():
        seen, root = root, root.copy()
        least = np.minimum(seen[a], seen[b])
        np.minimum.at(root, seen[a], least)
        np.minimum.at(root, seen[b], least)
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node of its component.

    ``FEW`` edges are collected: dozens of shuffles over all partitions would cost more than they hold.
    For more, alternating large-star and small-star steps: each is a combinable minimum and a join
    that adaptive execution can split on a hub, so no node's neighbours meet in one task.
    Every round is written to the shared folder in place of the last. Rows with nulls or a = b link nothing.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now = cut(now)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        if seen is None and mark[0] <= FEW:
            few = now.toArrow()  # FEW rows at most
            release(now)
            return spark.createDataFrame(pa.table(dict(zip(("node", "root"), roots_of(few["v"].to_numpy(), few["u"].to_numpy())))))
        seen = mark
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select("v", F.col("m").alias("u")).union(joined.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")))
        old, now = now, cut(small.distinct())
        release(old)
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.union(stars.select(F.col("root"), F.col("root")).distinct())
