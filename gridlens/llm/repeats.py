"""Removal of passages that an earlier document has too, by bucket-pointer refinement.

Every ``SPAN``-byte string holds an anchor: the ``GRAM``-byte gram of least hash in it, a
function of the string alone. So equal strings have equal anchors at equal places, and only
suffixes around anchors that two documents share need sorting.

1. An anchor's gram is its initial bucket, of all suffixes that start so. Anchors (about one in
   eighteen positions) meet on the gram's hash, each with a digest of its surroundings, the
   ``SIDE`` bytes on either side. Of equal surroundings all but the least document are
   covered; each task settles its own before it ships any, so that a passage in a third of
   all documents costs one row a task. What is left is one of each surroundings, where a
   gram has several.
2. Of these the bytes meet. Buckets are refined byte by byte to the right of the gram, each
   depth reusing the pointers of the last; so are the bytes to its left. A string that starts
   left of the anchor is then sorted on its left bucket and the pointer of the suffix at the
   later offset, which gives its bucket of equal strings and their least document.
   A bucket of over ``BLOCK`` suffixes is split first: strings that start early and late go
   to two families, dealt by the gram and all bytes that a family's strings share, and so on
   down to families of one string (six steps at most), where equal surroundings settle all.
3. Covered spans are merged and cut out of each text.

Surroundings count as equal if a 64-bit digest and the gram's 64-bit hash agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, GRAM = 50, 16
SIDE = SPAN - GRAM
WIDTH = SIDE + SPAN
#: Bytes of text whose anchors are found at a time.
SEGMENT = 1 << 20
#: Suffixes of one bucket refined together, and rows of small buckets pooled for one pass.
BLOCK, POOL = 16_384, 50_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of every ``width`` consecutive values."""
    done, n = values, 1
    while 2 * n <= width:
        done, n = least(done[:-n], done[n:]), 2 * n
    return done if n == width else least(done[: len(done) - (width - n)], done[width - n :])


def _mixed(rows: np.ndarray, seed) -> np.ndarray:
    """64-bit digest of each row of bytes."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words, h = padded.view("<u8"), np.zeros(n, np.uint64) + np.asarray(seed).astype(np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _MIX[k % 3]
        h ^= h >> np.uint64(31)
    h *= _MIX[1]
    return h ^ h >> np.uint64(29)


def anchors(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of texts laid end to end; ``ends`` are their ends."""
    n = len(data)
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.ndarray((n + GRAM - 8,), "<u8", data + bytes(GRAM), strides=(1,)).copy()
    h = words[:n] * _MIX[0]
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += words[k : n + k]
        h *= _MIX[k // 8]
    h ^= h >> np.uint64(32)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # bytes to the end of the own text
    rank = (h >> np.uint64(32)).astype(np.uint32)
    rank[left < GRAM] = 0xFFFFFFFF
    low = _slide(rank, SIDE + 1, np.minimum)
    low[left[: len(low)] < SPAN] = 0
    high = _slide(np.concatenate([np.zeros(SIDE, np.uint32), low, np.zeros(SIDE, np.uint32)]), SIDE + 1, np.maximum)
    at = np.flatnonzero((rank == high[:n]) & (left >= GRAM))
    return at, h[at].view(np.int64)


def _segments(texts: list[bytes]):
    """Lists of (text index, offset of the part, where its own anchors begin and end, part) of about ``SEGMENT`` bytes.

    A part of a long text has the surroundings of all its own anchors.
    """
    some, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), SEGMENT):
            low = max(0, at - SIDE)
            part = text[low : at + SEGMENT + SPAN] if len(text) > SEGMENT else text
            some.append((i, low, at, at + SEGMENT, part))
            held += len(part)
            if held >= SEGMENT:
                yield some
                some, held = [], 0
    if some:
        yield some


def _around(data: bytes, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``WIDTH`` bytes around each anchor, zero where its text has none."""
    flat = np.frombuffer(bytes(SIDE) + data + bytes(SIDE), np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[at]
    for i in np.flatnonzero((left < SIDE) | (right < SIDE)):
        out[i, : SIDE - left[i]] = 0
        out[i, SIDE + GRAM + right[i] :] = 0
    return out


def _merged(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row, those that touch made one."""
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    far = np.maximum.accumulate(e + row * (1 << 33)) - row * (1 << 33)  # rows don't reach into one another
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] > far[:-1])
    first = np.flatnonzero(new)
    return row[first], s[first], far[np.append(first[1:], len(row)) - 1] if len(row) else far


def _packed(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return s.astype(np.int64) << 32 | e.astype(np.int64)


def _anchored(batches):
    """(key, around, id, mark, at): each anchor's gram and surroundings; at packs the bytes left and right of it and its place.

    Spans that an earlier text of the batch has go on as (.., at = -1) with the span in ``around``.
    """
    for batch in common.text_batches(batches):
        found = []
        for some in _segments(common.binary_values(batch.column(2))):
            ends = np.cumsum([len(x[4]) for x in some])
            data = b"".join(x[4] for x in some)
            at, key = anchors(data, ends)
            part = np.searchsorted(ends, at, "right")
            index, low, first, last = (np.array([x[k] for x in some], np.int64)[part] for k in range(4))
            starts = np.concatenate(([0], ends[:-1]))[part]
            pos = at - starts + low
            own = (pos >= first) & (pos < last)
            left, right = np.minimum(SIDE, at - starts), np.minimum(SIDE, ends[part] - GRAM - at)
            digest = _mixed(_around(data, at, left, right), left * 64 + right).view(np.int64)
            found.append([x[own] for x in (key, digest, index, pos, left, right)])
        if not found:
            continue
        key, digest, index, pos, left, right = (np.concatenate(x) for x in zip(*found))
        ids, marks = (batch.column(k).to_numpy() for k in (0, 1))
        own = ids[index]
        order = np.lexsort((own, digest, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])
        late = np.zeros(len(order), bool)
        late[order] = own[order] > own[order][new][np.cumsum(new) - 1]
        row, s, e = _merged(index[late], (pos - left)[late], (pos + GRAM + right)[late])
        keep = ~late
        at = (left * 64 + right)[keep] << 32 | pos[keep]
        columns = [np.concatenate(x) for x in ((key[keep], marks[row].astype(np.int64) * 0x9E3779B1), (digest[keep], _packed(s, e)), (own[keep], ids[row]), (marks[index[keep]], marks[row]), (at, np.full(len(row), -1)))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "around", "id", "mark", "at"])


def _met(batches):
    """From a stream sorted by (key, around, id): spans that an earlier id has (place -1), and one id of each surroundings (span -1) where a gram has several.

    Holds one id's rows of one gram at most.
    """
    held, state, several = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)], None, None
    for batch in batches:
        key, around, own, mark, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = at < 0
        out = [(own[done], mark[done], around[done], np.full(int(done.sum()), -1))]
        key, around, own, mark, at = (x[~done] for x in (key, around, own, mark, at))
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1])
            new[0] = state is None or state[0] != key[0] or state[1] != around[0]
            group = np.cumsum(new)
            least = np.concatenate(([state[2] if state else 0], own[new]))[group]
            state = (key[-1], around[-1], least[-1])
            late = own > least
            ends, pos = at[late] >> 32, at[late] & 0xFFFFFFFF
            out.append((own[late], mark[late], _packed(pos - ends // 64, pos + GRAM + ends % 64), np.full(len(pos), -1)))
            first = [np.concatenate(x) for x in zip(held, (key[~late], own[~late], at[~late] & 0xFFFFFFFF, mark[~late]))]
            if len(first[0]):
                starts = np.concatenate(([0], np.flatnonzero(np.diff(first[0])) + 1))
                size = np.diff(np.append(starts, len(first[0])))
                many = np.minimum.reduceat(first[1], starts) != np.maximum.reduceat(first[1], starts)
                many |= first[0][starts] == several if several is not None else False
                ready = len(first[0]) if many[-1] else int(starts[-1])
                several = first[0][-1] if many[-1] else None
                take = np.flatnonzero(np.repeat(many, size)[:ready])
                out.append((first[1][take], first[3][take], np.full(len(take), -1), first[2][take]))
                held = [x[ready:] for x in first]
        own, mark, span, place = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mark), pa.array(span), pa.array(place.astype(np.int32))], ["id", "mark", "span", "place"])


_SUFFIX = "key long, digest long, family int, id long, mark int, places binary, around binary"
_NAMES = [x.split()[0] for x in _SUFFIX.split(", ")]


def _rows(offsets: np.ndarray, width: int) -> pa.Array:
    """Rows of bytes as a binary array."""
    bounds = pa.py_buffer((np.arange(len(offsets) + 1, dtype=np.int64) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets), [None, bounds, pa.py_buffer(np.ascontiguousarray(offsets))])


def _contexts(batches):
    """Each place's surroundings: lengths left and right, then the bytes, padded with zeros; equal ones of a text once, with all places."""
    for batch in common.text_batches(batches):
        for row, (text, places) in enumerate(zip(common.binary_values(batch.column(2)), batch.column(3))):
            pos = np.unique(places.values.to_numpy())
            pos = pos[pos <= len(text) - GRAM].astype(np.int64)
            if not len(pos):
                continue
            around = np.empty((len(pos), WIDTH + 2), np.uint8)
            around[:, 0], around[:, 1] = np.minimum(SIDE, pos), np.minimum(SIDE, len(text) - GRAM - pos)
            around[:, 2:] = _around(text, pos, around[:, 0], around[:, 1])
            digest = _mixed(around, 0)
            order = np.argsort(digest, kind="stable")
            new = np.concatenate(([True], np.diff(digest[order].view(np.int64)) != 0))
            first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(pos))
            listed = [pos[order[a:b]].astype("<i4").tobytes() for a, b in zip(first, last)]
            around, n = around[order[first]], len(first)
            key = _mixed(around[:, 2 + SIDE : 2 + SIDE + GRAM], 1).view(np.int64)
            same = lambda c: batch.column(c).take(pa.array(np.full(n, row)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest[order[first]].view(np.int64)), pa.array(np.full(n, SIDE, np.int32)), same(0), same(1), pa.array(listed, pa.binary()), _rows(around, WIDTH + 2)], _NAMES)


def _refined(bucket: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Buckets split by ``pointer``; -1, for a member alone in its bucket, stays."""
    out = np.full(len(bucket), -1, np.int64)
    live = np.flatnonzero((bucket >= 0) & (pointer >= 0))
    if len(live):
        _, back, many = np.unique(bucket[live] * (int(pointer[live].max()) + 1) + pointer[live], return_inverse=True, return_counts=True)
        out[live] = np.where(many[back] > 1, back, -1)
    return out


def covered(run: np.ndarray, own: np.ndarray, around: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """For each suffix and each string of its family: does an earlier id in its run have the string?

    String c starts SIDE - c bytes left of the anchor and reaches c bytes right of the gram; the family is c from low to high.
    """
    high = SIDE if high is None else high
    left, right, text = around[:, 0].astype(np.int64), around[:, 1].astype(np.int64), around[:, 2:]
    _, bucket = np.unique(run, return_inverse=True)
    for k in range(SIDE, SIDE + GRAM, 8):  # runs share a hash; the gram itself makes the initial bucket
        _, code = np.unique(np.ascontiguousarray(text[:, k : k + 8]).view("<u8").ravel(), return_inverse=True)
        bucket = _refined(bucket, code)
    after, before = [bucket], [bucket]
    for k in range(1, high + 1):
        after.append(_refined(after[-1], np.where(right >= k, text[:, SIDE + GRAM + k - 1].astype(np.int64), -1)))
    for k in range(1, SIDE - low + 1):
        before.append(_refined(before[-1], np.where(left >= k, text[:, SIDE - k].astype(np.int64), -1)))
    found = np.zeros((len(run), high - low + 1), bool)
    for c in range(low, high + 1):
        pointer = _refined(before[SIDE - c], after[c])
        live = np.flatnonzero(pointer >= 0)
        if len(live):
            by = live[np.lexsort((own[live], pointer[live]))]
            start = np.concatenate(([True], np.diff(pointer[by]) != 0))
            found[by, c - low] = own[by] > own[by][start][np.cumsum(start) - 1]
    return found


def _halves(family: int, around: np.ndarray):
    """(key, digest, half, rows) for either half of a family: the suffixes that have one of its strings, dealt by the bytes that all its strings share."""
    low, high = divmod(family, 64)
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        left, right = around[:, 0].astype(np.int64), around[:, 1].astype(np.int64)
        take = np.flatnonzero(np.maximum(a, SIDE - left) <= np.minimum(b, right))
        text, left, right = around[take, 2:], np.minimum(left[take], SIDE - a), np.minimum(right[take], b)
        seen = text[:, a : SIDE + GRAM + b].copy()
        column = np.arange(seen.shape[1])
        seen[(column < (SIDE - a - left)[:, None]) | (column >= (SIDE - a + GRAM + right)[:, None])] = 0
        key = _mixed(text[:, b : SIDE + GRAM + a], 64 * a + b + 2).view(np.int64)
        yield key, _mixed(seen, left * 64 + right).view(np.int64), 64 * a + b, take


def _spans(batches):
    """From a stream sorted by (key, digest, id): covered spans, and the suffixes of large buckets in two families each."""

    def told(own, mark, places, s, e):
        """Spans from s to e beside each of a suffix's places."""
        lists = [np.frombuffer(x, "<i4") for x in places]
        many = [len(x) for x in lists]
        at = np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)
        span = _packed(at + np.repeat(s, many), at + np.repeat(e, many))
        n = len(at)
        none = pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(span), pa.array(span), pa.array(np.full(n, -1, np.int32)), pa.array(np.repeat(own, many)), pa.array(np.repeat(mark, many)), none, none], _NAMES)

    def settled(family, own, mark, places, around):
        """Spans of suffixes whose surroundings an earlier id has too: all strings of the family."""
        low, high = divmod(family, 64)
        a, b = np.maximum(low, SIDE - around[:, 0].astype(np.int64)), np.minimum(high, around[:, 1].astype(np.int64))
        some = np.flatnonzero(a <= b)
        return told(own[some], mark[some], places[some], a[some] - SIDE, b[some] - SIDE + SPAN)

    def least_of(key, digest, own):
        """(whether each row starts new surroundings, the least id of its surroundings), going on from ``state``."""
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        new[0] = state is None or state[0] != key[0] or state[1] != digest[0]
        return np.concatenate(([state[2] if state else 0], own[new]))[np.cumsum(new)]

    def refined(family, run, own, mark, places, around):
        low, high = divmod(family, 64)
        hit = covered(run, own, around, low, high)
        row, c = np.nonzero(hit)  # the covered strings of a suffix need not be next to one another
        row, s, e = _merged(row, c + low, c + low + SPAN)
        return told(own[row], mark[row], places[row], s - SIDE, e - SIDE)

    def split(family, own, mark, places, around):
        for key, digest, half, take in _halves(family, around):
            order = np.lexsort((own[take], digest, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])
            late = np.zeros(len(order), bool)
            late[order] = own[take[order]] > own[take[order[new]]][np.cumsum(new) - 1]
            some, rest = take[late], take[~late]
            yield settled(half, own[some], mark[some], places[some], around[some])
            columns = [pa.array(x) for x in (key[~late], digest[~late], np.full(len(rest), half, np.int32), own[rest], mark[rest])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places[rest], pa.binary()), _rows(around[rest], WIDTH + 2)], _NAMES)

    def work(rows, final):
        """What comes of the first suffixes of each surroundings, as batches; those of an open bucket that is not large yet are left."""
        nonlocal large
        key, family, own, mark, places, around = rows
        begin = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        hot = np.bincount(run) > BLOCK
        hot[0] |= large == key[0]
        wait = len(key) if final or hot[-1] else begin[-1]
        large = key[-1] if hot[-1] else None
        now, out = np.arange(len(key)) < wait, []
        for f in np.unique(family[now]):
            if f // 64 == f % 64:
                continue  # one string: equal surroundings have settled it
            for is_hot, step in ((False, lambda f, run, *x: [refined(f, run, *x)]), (True, lambda f, run, *x: split(f, *x))):
                some = np.flatnonzero(now & (family == f) & (hot[run] == is_hot))
                if len(some):
                    out += step(int(f), run[some], own[some], mark[some], places[some], around[some])
        return out, [x[wait:] for x in rows]

    state, large, held = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, digest, family, own, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        raw = batch.column(6)
        base = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
        around = np.frombuffer(raw.buffers()[2], np.uint8)[base : base + len(raw) * (WIDTH + 2)].reshape(-1, WIDTH + 2)
        places = np.empty(len(raw), object)
        places[:] = batch.column(5).to_pylist()
        least = least_of(key, digest, own)
        state, late = (key[-1], digest[-1], least[-1]), own > least
        for f in np.unique(family[late]):
            some = np.flatnonzero(late & (family == f))
            yield settled(int(f), own[some], mark[some], places[some], around[some])
        held.append([x[~late] for x in (key, family, own, mark, places, around)])
        if sum(len(x[0]) for x in held) >= POOL:
            out, left = work([np.concatenate(x) for x in zip(*held)], False)
            yield from out
            held = [left]
    if held and sum(len(x[0]) for x in held):
        yield from work([np.concatenate(x) for x in zip(*held)], True)[0]


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark, t; rows without an id are neither earlier nor later than any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).where("id IS NOT NULL").select("id", _mark(), "t")


def _mark():
    """Tells texts of one id apart."""
    return F.expr("CAST(xxhash64(t) & 2147483647 AS INT)").alias("mark")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans, more): byte spans of each text that an earlier id has too, start << 32 | end, as two unordered arrays that may be null.

    Texts without any may be absent. Each step is written to the shared folder and its shuffle files go.
    """
    n, own = common.parts(docs.sparkSession), _own(docs, id_col, text_col)
    grams = own.select("id", "mark", "t").mapInArrow(_anchored, "key long, around long, id long, mark int, at long")
    met = grams.repartition(n, "key").sortWithinPartitions("key", "around", "id").mapInArrow(_met, "id long, mark int, span long, place int")
    listed = lambda c: F.collect_list(F.when(F.col(c) >= 0, F.col(c)))
    met = common.cut(met.groupBy("id", "mark").agg(listed("span").alias("spans"), listed("place").alias("places")))
    texts = own.join(met.where("size(places) > 0").select("id", "mark", "places"), ["id", "mark"]).select("id", "mark", "t", "places")
    rows, spans = texts.mapInArrow(_contexts, _SUFFIX), None
    for _ in range(SIDE.bit_length() + 1):
        found = common.cut(rows.repartition(n, "key").sortWithinPartitions("key", "digest", "id").mapInArrow(_spans, _SUFFIX))
        some = found.where("family < 0").select("id", "mark", F.col("key").alias("span"))
        spans, rows = some if spans is None else spans.union(some), found.where("family >= 0")
        if rows.isEmpty():
            break
    more = spans.groupBy("id", "mark").agg(F.collect_list("span").alias("more"))
    return met.select("id", "mark", "spans").join(more, ["id", "mark"], "full")


def _cut_out(text: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    """What is left of ``text`` without packed, perhaps overlapping spans, and how many runs went."""
    if not len(spans):
        return text, 0
    _, s, e = _merged(np.zeros(len(spans), np.int64), spans >> 32, spans & 0xFFFFFFFF)
    bounds = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(bounds[::2], bounds[1::2])]), len(s)


def _both(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The spans of each row, from its last two columns."""
    lists = [[np.empty(0, np.int64) if x.values is None else x.values.to_numpy() for x in batch.column(k)] for k in (2, 3)]
    return [np.concatenate(x) for x in zip(*lists)]


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` as a struct, their text and their spans."""
    spans = repeated_spans(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("t"))
    return own.withColumn("mark", _mark()).join(spans, ["id", "mark"], "left").select("row", "t", "spans", "more")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256.

    Ids are integers (or cast to them). Null texts are empty. Rows that share an id are never
    earlier than one another; a null id is earlier or later than none. Texts of under ``SPAN``
    bytes stay whole; long ones are searched whole, in parts. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in common.text_batches(batches):
            out = []
            for text, spans in zip(common.binary_values(batch.column(1)), _both(batch)):
                left, runs = _cut_out(text, spans)
                out.append((len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _joined(docs.select(id_col, text_col), id_col, text_col).select(F.col("row").getField(id_col).alias("_id"), "t", "spans", "more")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut from the text; bytes of a character cut in two go with it.

    Null texts stay null; rows that share an id, null ids and short or long texts are as in :func:`removed`.
    """
    def run(batches):
        for batch in common.text_batches(batches):
            texts = common.binary_values(batch.column(1))
            left = [_cut_out(t, s)[0].decode("utf-8", "ignore") if len(s) else None for t, s in zip(texts, _both(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], ["row", "left"])

    kind = docs.schema.simpleString()
    rows = _joined(docs, id_col, text_col).mapInArrow(run, f"row {kind}, left string")
    return rows.select(*[F.coalesce("left", F.col("row").getField(c)).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
