"""Embedding near-dedup by cross-polytope hashing.

Each of ``TABLES`` tables concatenates ``PARTS`` cross-polytope hashes: the vector, after
three rounds of random signs and a fast Hadamard transform, goes to the nearest signed axis.
Besides its own bucket a vector probes the buckets that swap one part for its runner-up,
nearest first. Vectors that share a bucket are compared by cosine. Equal vectors are hashed
once. A bucket of over ``BLOCK`` vectors is compared in pairs of blocks, each a task of its
own; a linked pair counts in the first bucket that both share, so that link counts are sums
and no pair is ever shipped, and each comparison gives spanning links only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE = 0.95
TABLES, PARTS, PROBES = 10, 3, 4
BLOCK = 512
SEED = 20


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        h *= 2
    return x


def buckets(vectors: np.ndarray) -> np.ndarray:
    """(rows, TABLES, PROBES) bucket codes of unit vectors, the own bucket first."""
    n, d = vectors.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    rng = np.random.default_rng([SEED, d])
    signs = rng.integers(0, 2, (TABLES, PARTS, 3, width)) * 2.0 - 1
    out = np.empty((n, TABLES, PROBES), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        own, second, loss = [], [], []
        for p in range(PARTS):
            y = padded
            for r in range(3):
                y = _hadamard(y * signs[t, p, r]) / np.sqrt(width)
            both = np.concatenate([y, -y], 1)
            top = np.argpartition(-both, 1, 1)[:, :2]
            values = np.take_along_axis(both, top, 1)
            first = (values[:, 1] > values[:, 0]).astype(int)
            own.append(top[rows, first])
            second.append(top[rows, 1 - first])
            loss.append(values[rows, first] - values[rows, 1 - first])
        code = sum(o.astype(np.int64) * (2 * width) ** p for p, o in enumerate(own))
        swaps = np.stack([code + (s - o).astype(np.int64) * (2 * width) ** p for p, (o, s) in enumerate(zip(own, second))], 1)
        order = np.argsort(np.stack(loss, 1), 1, kind="stable")[:, : PROBES - 1]
        out[:, t, 0] = code
        out[:, t, 1:] = np.take_along_axis(swaps, order, 1)
    return out


def _key(codes: np.ndarray, dims: int) -> np.ndarray:
    """One long for (dimensions, table, code)."""
    tables = np.arange(TABLES)[None, :, None]
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (tables + TABLES * dims).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def _unit(rows: list) -> list[np.ndarray]:
    """Rows scaled to length one in double precision."""
    out = []
    for row in rows:
        x = np.asarray(row, np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    return out


def _by_length(rows: list[np.ndarray]):
    """(indices, matrix) of the rows of each length."""
    lengths = np.array([len(r) for r in rows])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.stack([rows[i] for i in at])


def _keyed(batches):
    for batch in common.text_batches(batches, 1 << 20):
        for at, x in _by_length(_unit(batch.column(1).to_pylist())):
            keys = _key(buckets(x), x.shape[1]).reshape(len(at), -1)
            rows, which = np.divmod(np.arange(keys.size), keys.shape[1])
            # A probe that falls in a bucket the vector is in already adds nothing.
            sort = np.sort(keys, 1)
            new = np.ones_like(sort, bool)
            new[:, 1:] = sort[:, 1:] != sort[:, :-1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[rows][new.ravel()])), pa.array(sort[new])], ["cid", "key"])


def _first_shared(mine: np.ndarray, theirs: np.ndarray, key: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Is ``key`` the least that both rows of each pair have?"""
    a, b = pairs
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 4096):
        left, right = mine[a[at : at + 4096]], theirs[b[at : at + 4096]]
        below = [(left == right[:, [k]]).any(1) & (right[:, k] < key) for k in range(right.shape[1])]
        out[at : at + 4096] = ~np.any(below, 0)
    return out


def _compared(cosine: float):
    def run(batches):
        """From a stream sorted by (key, i, j): links of each block pair. other = cid: a count of links, else a spanning link."""
        for table in common.sorted_runs(batches, ["key", "i", "j"]):
            key, i, j, block, cid, many = (table[c].to_numpy() for c in ("key", "i", "j", "block", "cid", "many"))
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
            vectors = table["embedding"]
            found = [[], [], []]
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                for at, x in _by_length(_unit(vectors[s:e].to_pylist())):
                    _block_pair(x, key[s], block[s:e][at], i[s], j[s], cid[s:e][at], many[s:e][at], cosine, found)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], ["cid", "other", "n"])

    return run


def _block_pair(x, key, block, i, j, cid, many, cosine, found):
    inside = i == j
    left, right = (np.arange(len(x)),) * 2 if inside else (np.flatnonzero(block == i), np.flatnonzero(block == j))
    if not len(left) or not len(right):
        return
    close = x[left] @ x[right].T >= cosine
    if inside:
        close = np.triu(close, 1)
    if not close.any():
        return
    a, b = np.nonzero(close)
    own = np.zeros(len(x), bool)
    own[left[a]] = own[right[b]] = True
    keys = np.zeros((len(x), TABLES * PROBES), np.int64)
    keys[own] = _key(buckets(x[own]), x.shape[1]).reshape(int(own.sum()), -1)
    first = _first_shared(keys, keys, key, (left[a], right[b]))
    a, b = left[a[first]], right[b[first]]
    if not len(a):
        return
    links = np.bincount(a, many[b], len(x)) + np.bincount(b, many[a], len(x))
    some = np.flatnonzero(links)
    found[0].append(cid[some]), found[1].append(cid[some]), found[2].append(links[some].astype(np.int64))
    root = _roots(len(x), a, b)
    tied = np.flatnonzero(root != np.arange(len(x)))
    found[0].append(cid[tied]), found[1].append(cid[root[tied]]), found[2].append(np.zeros(len(tied), np.int64))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each row's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    Vectors link where their cosine in double precision is ``cosine`` or more and their
    lengths agree. Null, empty and zero vectors and those with null or non-finite components
    link with nothing: n_links 0, component their own id, kept. Equal rows each count as a
    vector, also where they share an id. Other columns are ignored, whatever their names.
    """
    n = common.parts(vectors.sparkSession)
    own = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = "coalesce(size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0), false)"
    own = own.select("_id", F.expr(f"CASE WHEN {fine} THEN embedding END").alias("embedding"))
    marks = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    good = own.where("embedding IS NOT NULL").select("_id", *marks, "embedding")
    grouped = good.groupBy("h1", "h2").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("embedding").alias("embedding"))
    classes = common.cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    keys = common.cut(classes.select("cid", "embedding").mapInArrow(_keyed, "cid long, key long"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = shared.withColumn("block", F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    paired = placed.join(classes.select("cid", "many", "embedding"), "cid").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = paired.select("key", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "cid", "many", "embedding")
    tasks = tasks.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = common.cut(tasks.mapInArrow(_compared(cosine), "cid long, other long, n long"))
    counted = found.where("cid = other").groupBy("cid").agg(F.sum("n").alias("links"))
    roots = common.components(found.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    known = classes.select("cid", "h1", "h2", "least", "many").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    top = known.groupBy("root").agg(F.min("least").alias("component_id"))
    label = known.join(top, "root").join(counted, "cid", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = good.select("_id", "h1", "h2").join(label, ["h1", "h2"]).select("_id", "n_links", "component_id")
    alone = own.where("embedding IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return out.union(alone).select(F.col("_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
