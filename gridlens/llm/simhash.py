"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within three bits leave one of three bit blocks in which they differ at
least once (or they are closer still), so on the other two blocks they are within two
bits. There both emit every variant within one bit, half that radius; at least one variant
is common to both. Fingerprints meet on (blocks kept, variant) and are verified in full.
:func:`near_duplicates` links fingerprints; :func:`similar` links texts, by the Jaccard
similarity of their shingles, with ball hashing as the first search for pairs.
"""

from __future__ import annotations

from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
RADIUS = 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Shingles hashed at a time, which bounds what a long text holds.
STEP = 50_000
#: Longest run of equal variants whose pairs are all compared by shifting; longer ones go by a search.
SHIFTS = 8


def hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of UTF-8 bytes, in order and with repeats; none without words."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts, ends)])
    return np.frombuffer(raw, ">u8")


def voted(own: np.ndarray) -> int:
    """Unsigned fingerprint: the bits set in over half of ``own`` (big-endian), zero if that is empty."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), STEP):
        counts += np.unpackbits(own[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(own)).tobytes(), "big")


def fingerprint(data: bytes, shingle: int) -> int:
    """Unsigned fingerprint of UTF-8 bytes; zero without words."""
    return voted(hashes(data, shingle)) if data else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id_col, fp: signed long) for each row; null and blank texts give zero."""

    def run(batches):
        for batch in common.text_batches(batches):
            out = [fingerprint(x, shingle) for x in common.binary_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _balls(radius: int) -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of every variant within ``radius`` (0 or 1), as signed longs."""
    out = []
    for low, high in BLOCKS:
        keep = ~(((1 << high) - 1) ^ ((1 << low) - 1)) & ((1 << 64) - 1)
        flips = [0, *(1 << b for b in range(64) if keep >> b & 1 and radius)]
        out += [(_signed(keep), _signed(f)) for f in flips]
    return out


def variants(fps: DataFrame, radius: int = 1) -> DataFrame:
    """(key, fp, label): every variant of every distinct fingerprint."""
    ball = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(f).cast("long").alias("f")) for k, f in _balls(radius)])
    each = fps.select("fp", "label", F.explode(ball).alias("b"))
    # The bits left out hold a mark of the block, so that the three families seldom share a key.
    return each.select(F.expr("((fp & b.k) ^ b.f) | (~b.k & 6148914691236517205)").alias("key"), "fp", "label")


def _verified(batches):
    """Links of each run of equal keys that tie together fingerprints of different labels."""
    for table in common.sorted_runs(batches, ["key"]):
        key, fp, label = (table[c].to_numpy() for c in ("key", "fp", "label"))
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        size = np.repeat(ends - starts, ends - starts)
        pairs = []
        for d in range(1, SHIFTS):
            at = np.flatnonzero((key[d:] == key[:-d]) & (label[d:] != label[:-d]) & (size[d:] <= SHIFTS)) if len(key) > d else np.empty(0, int)
            at = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= RADIUS]
            pairs.append(np.stack([fp[at], fp[at + d]], 1))
        for i in np.flatnonzero(ends - starts > SHIFTS):
            own = fp[starts[i] : ends[i]]
            near = lambda a, rest, own=own: np.bitwise_count((own[rest] ^ own[a]).view(np.uint64)) <= RADIUS
            found = common.forest(near, label[starts[i] : ends[i]])
            if found:
                pairs.append(own[np.array(found)])
        both = np.concatenate(pairs)
        if len(both):
            both = np.unique(np.sort(both, 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _met(labelled: DataFrame, radius: int) -> DataFrame:
    each = variants(labelled, radius).repartition(common.parts(labelled.sparkSession), "key").sortWithinPartitions("key", "fp")
    return common.cut(each.mapInArrow(_verified, "a long, b long").distinct())


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints ``fp`` that span the same components as all links.

    In a group of near copies every variant would give a spanning tree of its own. So fingerprints
    that agree on two blocks meet first; then all variants do, and only links between
    different components are told.
    """
    first = _met(fps.select("fp", F.col("fp").alias("label")), 0)
    roots = common.components(first)
    return first.union(_met(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("label")), 1))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (least id reachable).

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than
    ``shingle`` is one shingle, one without words (null, empty) has fingerprint zero, which
    links like any other. Equal texts share a fingerprint, which is searched once however
    many rows hold it. Repeated ids keep their rows; a null id is never the least one, so a
    group of null ids has a null component. Other columns are ignored, whatever their names.
    """
    own = common.cut(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "_id"))
    nodes = common.cut(own.groupBy("fp").agg(F.min("_id").alias("least")))
    roots = common.components(common.cut(links(nodes.select("fp"))))
    known = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = known.groupBy("root").agg(F.min("least").alias("component_id"))
    label = known.join(top, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(label, "fp").select(F.col("_id").alias(id_col), hexed, "component_id")


# Similar texts: candidates by ball hashing, closed by prefix filtering, all verified on their shingles.

SIMILARITY = 0.8
#: Documents (about) whose shingles set the order, least times one occurs among them to count as common, most common ones. All links are found
#: in any order; this one keeps common passages out of the prefixes.
SAMPLE, OFTEN, COMMON = 10_000, 3, 200_000
#: Rows of a run of equal shingles that are compared with all its others, in rounds, before all pairs are. Most near copies are tied by the first.
HUBS = (1, 8)
#: Counts that sum up a shingle set; by them most pairs that share a rare shingle but are not similar are refused without reading their texts.
SKETCH = 256
#: Pairs held at a time; longest run whose pairs are found by shifting.
PAIRS, SHORT = 1 << 18, 32
#: Most texts to verify whose ids are broadcast (24 bytes each); beyond, they are joined by shuffling.
NAMED = 1_000_000


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are common in a sample of ``texts`` (_id, _t), sorted, and how often each occurs there."""
    step = max(1, texts.count() // SAMPLE)

    def run(batches):
        for batch in common.text_batches(batches):
            for x in common.binary_values(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(x, shingle)).astype(np.uint64).view(np.int64))], ["h"])

    each = texts.where(F.pmod(F.xxhash64("_id"), F.lit(step)) == 0).select("_t").mapInArrow(run, "h long")
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    rows = often.orderBy(F.desc("n"), "h").limit(COMMON).collect()  # COMMON rows at most
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _described(shingle: int, share: Fraction, often: np.ndarray, times: np.ndarray):
    """Of each text (_id, h, _t): fingerprint, digest and size of its shingle set, and the first shingles, from the least to the most common.

    Sets that are similar enough have one of these in common, whatever the order. The sketch
    counts shingles by their last bits; two sets share no more than the sum of the lesser counts.
    """

    def one(x: bytes) -> tuple[int, bytes, int, bytes, bytes]:
        every = hashes(x, shingle)
        own = np.unique(every).astype(np.uint64)
        n, mark = len(own), xxhash.xxh3_128_digest(own.tobytes())
        counts = np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        sketch = counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\xff" * SKETCH
        if len(often) and n:
            at = np.minimum(np.searchsorted(often, own), len(often) - 1)
            own = own[np.argsort(np.where(often[at] == own, times[at], 0), kind="stable")]
        return _signed(voted(every)), mark, n, own[: n - -(-share.numerator * n // share.denominator) + 1 if n else 0].tobytes(), sketch

    def run(batches):
        for batch in common.text_batches(batches, 1 << 20):
            fp, mark, n, first, sketch = zip(*[one(x) for x in common.binary_values(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(mark, pa.binary()), pa.array(n, pa.int32()), pa.array(first, pa.binary()), pa.array(sketch, pa.binary())], ["_id", "h", "fp", "mark", "n", "first", "sketch"])

    return run


def _prefixes(batches):
    """(key, cid, n, at): the first shingles of each set (cid, n, first)."""
    for batch in common.text_batches(batches):
        sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        if sizes.sum():
            at = np.concatenate([np.arange(m) for m in sizes.tolist()]).astype(np.int32)
            same = [np.repeat(batch.column(k).to_numpy(), sizes) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(sets), *same, at)], ["key", "cid", "n", "at"])


def _shared(batches):
    """Rows whose key two rows have, from a stream sorted by key; holds one row of the open key at most."""
    held, open_key = None, None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = [np.concatenate(x) for x in zip(held, now)] if held else now
        key = now[0]
        if not len(key):
            continue
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        size = np.diff(np.append(starts, len(key)))
        both = (size > 1) | (key[starts] == open_key if open_key is not None else False)
        open_key, end = (key[-1], len(key)) if both[-1] else (None, int(starts[-1]))
        keep = np.repeat(both, size)[:end]
        held = [x[end:] for x in now]
        yield pa.RecordBatch.from_arrays([pa.array(x[:end][keep]) for x in now], batch.schema.names)


def _fit(share: Fraction, n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Can rows ``a`` and ``b`` be similar enough, if this is the first shingle that both have?"""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    shared = np.minimum(n[a] - at[a], n[b] - at[b])
    return (share.denominator * low >= share.numerator * high) & (shared * (share.numerator + share.denominator) >= share.numerator * (low + high))


def _runs(table: pa.Table):
    key = table["key"].to_numpy()
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    n, at = (table[c].to_numpy().astype(np.int64) for c in ("n", "at"))
    return starts, np.diff(np.append(starts, len(key))), table["cid"].to_numpy(), table["root"].to_numpy(), n, at


def _fit_sketched(share: Fraction, sketch: np.ndarray, n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`_fit` for rows whose sketches let them be similar too."""
    out = _fit(share, n, at, a, b)
    some = np.flatnonzero(out)
    for k in range(0, len(some), 1 << 14):
        part = some[k : k + (1 << 14)]
        out[part] = _may_link(share, sketch[a[part]], sketch[b[part]], n[a[part]] + n[b[part]])
    return out


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)


def _stars(share: Fraction, hubs: int):
    """Pairs of each run's first ``hubs`` rows with those after them that are not in one component (``root``) yet, nor refused by sketches if rows have them."""

    def run(batches):
        for table in common.sorted_runs(batches, ["key"]):
            starts, size, cid, root, n, at = _runs(table)
            first, rows, found = np.repeat(starts, size), np.arange(len(cid)), []
            fits = partial(_fit_sketched, share, _sketches(table)) if "sketch" in table.column_names else partial(_fit, share)
            for d in range(hubs):
                b = rows[rows > first + d]
                b = b[root[first[b] + d] != root[b]]
                a = first[b] + d
                fit = fits(n, at, a, b)
                found.append(np.stack([cid[a[fit]], cid[b[fit]]], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _mixed(batches):
    """The runs whose rows are in several components."""
    for table in common.sorted_runs(batches, ["key"]):
        starts, size, _, root, _, _ = _runs(table)
        keep = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), size)
        yield from table.filter(pa.array(keep)).to_batches()


def _rest(share: Fraction, hubs: int):
    """All other pairs of each run whose rows aren't in one component yet and whose sketches let them be similar."""

    def some(table):
        starts, size, cid, root, n, at = _runs(table)
        first = np.repeat(starts, size)
        length = np.repeat(size, size)
        sketch = _sketches(table)

        def fit(a, b):
            out = (a >= first[a] + hubs) & (root[a] != root[b])
            out[out] = _fit_sketched(share, sketch, n, at, a[out], b[out])
            return out

        for d in range(1, SHORT):
            a = np.flatnonzero(length <= SHORT)
            a = a[a + d < first[a] + length[a]]
            a = a[fit(a, a + d)]
            yield cid[a], cid[a + d]
        for s, e in zip(starts[size > SHORT], (starts + size)[size > SHORT]):
            for i in range(s + hubs, e if (root[s:e] != root[s]).any() else s):
                b = np.arange(i + 1, e)
                b = b[fit(np.full(len(b), i), b)]
                yield np.full(len(b), cid[i]), cid[b]

    def batch(held):
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*held)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        for table in common.sorted_runs(batches, ["key"]):
            held, many = [], 0
            for pair in some(table):
                held, many = [*held, pair] if len(pair[0]) else held, many + len(pair[0])
                if many > PAIRS:
                    yield batch(held)
                    held, many = [], 0
            if held:
                yield batch(held)

    return run


def _linked(share: Fraction):
    """The pairs whose sets are similar enough."""

    def near(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate((a, b)))
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return share.denominator * shared >= share.numerator * (len(both) - shared)

    def run(batches):
        for whole in batches:
            for batch in common.text_batches([whole]):
                yield batch.select(["a", "b"]).filter(pa.array([near(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_()))

    return run


def _may_link(share: Fraction, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Do sketches leave room for the similarity? ``n``: sizes of both sets together. A count of 255 may be more."""
    most = np.where((x.max(1) == 255) | (y.max(1) == 255), 1 << 40, np.minimum(x, y).sum(1, dtype=np.int64))
    return most * (share.numerator + share.denominator) >= share.numerator * n


def _sketched(share: Fraction):
    """The pairs (a, b, n, two sketches) that may be similar."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (3, 4))
                keep = _may_link(share, x, y, batch.column(2).to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in common.text_batches(batches, 1 << 20):
            sets = [np.unique(hashes(x, shingle)).astype(np.uint64).tobytes() for x in common.binary_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return run


def _verified_pairs(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, share: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b: as :func:`common.cut` left them, and released) whose sets have a Jaccard similarity of ``share`` or more.

    Only their texts are read again.
    """
    of = lambda c, d: nodes.select(F.col("cid").alias(c), F.col("one.n").cast("long").alias(f"n{d}"), F.col("one.sketch").alias(f"k{d}"))
    told = pairs.join(of("a", 1), "a").join(of("b", 2), "b").select("a", "b", (F.col("n1") + F.col("n2")).alias("n"), "k1", "k2")
    all_, pairs = pairs, common.cut(told.mapInArrow(_sketched(share), "a long, b long"))
    common.release(all_)
    both = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    named = common.cut(nodes.join(both, "cid").select("cid", F.col("one._id").alias("_i"), F.col("one.h").alias("_h")))
    few = F.broadcast(named) if named.count() <= NAMED else named
    some = texts.join(few, (F.col("h") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i"))).select("cid", "_t")
    sets = common.cut(some.mapInArrow(_sets(shingle), "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("s")))  # rows may be repeated
    second = pairs.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("t")), "b")
    first = second.join(sets.select(F.col("cid").alias("a"), "s"), "a")
    out = common.cut(first.select("a", "b", "s", "t").mapInArrow(_linked(share), "a long, b long"))
    common.release(named, sets, pairs)
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id_col, component_id, linking texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Ball hashing of the fingerprints gives the first pairs. What it may miss, prefix filtering
    adds: similar sets have one of their first shingles in common, in any order of all shingles,
    and meet there. A few sets of each run (``HUBS``) are compared with the others; then all pairs
    that are not in one component by that. Every link is verified on the shingle sets, so the result is
    exact but for collisions of 64-bit hashes. Null, blank and repeated rows are as in
    :func:`near_duplicates`; texts without words link with each other alone.
    """
    n, share = common.parts(docs.sparkSession), Fraction(str(similarity))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).select("_id", F.xxhash64("_t").alias("h"), "_t")
    own = texts.mapInArrow(_described(shingle, share, *_common(texts, shingle)), f"_id {kind}, h long, fp long, mark binary, n int, first binary, sketch binary")
    whole = common.cut(own.withColumn("row", F.monotonically_increasing_id()))
    one = F.min_by(F.struct("_id", "h", "fp", "n", "first", "sketch"), "row").alias("one")
    full = common.cut(whole.groupBy("mark").agg(F.min("_id").alias("least"), F.min("row").alias("cid"), one))
    own = common.cut(whole.select("_id", "mark"))
    common.release(whole)
    dealt = lambda rows: rows.repartition(n, "key").sortWithinPartitions("key", F.xxhash64("cid"), "cid")
    schema = "key long, cid long, n int, at int"
    met = common.cut(dealt(full.select("cid", "one.n", "one.first").mapInArrow(_prefixes, schema)).mapInArrow(_shared, schema))
    nodes = common.cut(full.withColumn("one", F.col("one").dropFields("first")))
    common.release(full)
    verified = lambda pairs: _verified_pairs(common.cut(pairs), texts, nodes, shingle, share)

    fps = common.cut(nodes.groupBy(F.col("one.fp").alias("fp")).agg(F.min("cid").alias("cid")))
    near = links(fps.select("fp")).join(fps.select(F.col("fp").alias("a"), F.col("cid").alias("u")), "a").join(fps.select(F.col("fp").alias("b"), F.col("cid").alias("v")), "b")
    same = nodes.select(F.col("one.fp").alias("fp"), F.col("cid").alias("v")).join(fps, "fp").where("cid <> v")
    found = verified(near.select(F.col("u").alias("a"), F.col("v").alias("b")).union(same.select("cid", "v")))

    rooted = lambda rows: rows.join(common.components(found), F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    columns, rooted_schema = ["key", "cid", "root", "n", "at"], "key long, cid long, root long, n int, at int"
    again = lambda: dealt(rooted(met).select(*columns))
    mixed = lambda: again().mapInArrow(_mixed, rooted_schema).join(nodes.select("cid", "one.sketch"), "cid").select(*columns, "sketch")
    found = found.union(verified(again().mapInArrow(_stars(share, HUBS[0]), "a long, b long").distinct()))
    for pairs in (*[_stars(share, hubs) for hubs in HUBS[1:]], _rest(share, HUBS[-1])):
        found = found.union(verified(dealt(mixed()).mapInArrow(pairs, "a long, b long").distinct()))
    label = common.cut(rooted(nodes.select("mark", "least", "cid")).select("mark", "least", "root"))
    common.release(fps, met, nodes)
    top = label.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("_id", "mark").join(label.join(top, "root").select("mark", "component_id"), "mark").select(F.col("_id").alias(id_col), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group of similar texts. Rows that share an id stay or go together; null ids stay."""
    found = similar(docs, id_col, text_col, shingle, similarity)
    least = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_least")).distinct()
    named = docs.join(least, docs[id_col] == least["_least"], "left_semi")
    return named.union(docs.where(F.col(id_col).isNull()))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3)
