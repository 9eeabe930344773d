"""Best-fit packing by bin completion over length classes.

Only how many pieces have each length matters to how few sequences hold them, and there are
at most ``size`` lengths, so the search runs on the driver over that histogram. Best-fit
decreasing gives the first incumbent. Branch and bound then takes the longest length left,
enumerates the undominated fillings beside it, least waste first, each only when its turn
comes, and prunes by waste against the incumbent; it ends at the lower bound, when all is
searched, or after ``NODES`` fillings, the one limit (:class:`Plan` tells the gap that is left).
A branch fills as many equal sequences as the counts allow but ``SINGLE``, which are decided
one by one: where no length occurs oftener, a search that ends is exact. The plan is small;
ranks within a length, salted, join pieces to it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZE, END = 1024, 2
#: Fillings tried, dominated ones too, which bounds time alone: any plan holds all pieces. Equal sequences decided one by one.
NODES, SINGLE = 4_000, 3
#: Open nodes of the search whose fillings are held half enumerated, which bounds the driver's memory and changes no result.
KEPT = 64
#: Salts that split one length's pieces over tasks.
SALTS = 256
#: Chunks whose ids a worker remembers at least, over all its tasks; at twice as many it forgets those not met since. Longer chunks aren't remembered.
REMEMBERED, LONG = 100_000, 64
#: Below this code point both tokenizer libraries class characters alike.
PLAIN = "\u0250"
#: Fixed value: how byte-level BPE files of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Single blanks between two other characters.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Stands for a line feed at the front of a chunk.
_LINE = "\0"


class _Odd(Exception):
    """White space that single blanks and line feeds don't describe."""


class _Known(dict):
    """Ids by chunk: a word stands for itself after a blank, or after a line feed if it begins with ``_LINE``."""

    def __init__(self, encoded, blank: str = " "):
        super().__init__()
        self.encoded, self.blank, self.old = encoded, blank, {}

    def aged(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if (out := self.old.get(word)) is not None:
            self[word] = out
            return out
        line = word[:1] == _LINE
        bare = word[1:] if line else word
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise _Odd
        out = self.encoded(("\n" if line else self.blank) + bare)
        if len(word) <= LONG:
            self[word] = out
        return out


class Tokens:
    """Ids of texts under a byte-level BPE file, remembered by chunk.

    No pre-token of this kind of tokenizer has a blank inside or at its end, so a text splits
    before every single blank that stands between two other characters, and around single
    line feeds that do. Texts with other runs of white space split at such blanks alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = _ranked(json.loads(self.whole.to_str()))
        self.known, self.first = _Known(self.encoded), _Known(self.encoded, "")

    def encoded(self, chunk: str) -> bytes:
        if self.fast and max(chunk) < PLAIN and not self.special_in(chunk):
            return array("I", self.fast(chunk)).tobytes()
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        self.known.aged()
        self.first.aged()
        return [self.of(t) for t in texts]

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if _LINE in text or self.special_in(text):
            return self.encoded(text)
        first, *rest = text.replace("\n", " " + _LINE).split(" ")
        try:
            return b"".join([self.first[first] if first or not rest else b"", *map(self.known.__getitem__, rest)])
        except _Odd:
            first, *rest = _SINGLE.split(text)
            return b"".join([self.encoded(first), *(self.encoded(" " + x) for x in rest)])

    def special_in(self, text: str) -> bool:
        return any(s in text for s in self.special)


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    """One for all tasks of a worker."""
    return Tokens(path)


def _ranked(spec: dict):
    """An encoder that merges by rank, where the file's merges are in the order of its ids; else None.

    It gives the file's ids for texts below ``PLAIN``, where both libraries class characters alike.
    """
    import tiktoken

    model, pre, vocab = spec["model"], spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or merged != sorted(merged):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """A row per piece: _id, piece, start, length, ids_crc32; with _row, which tells rows of equal ids apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tokens, tail = _tokens(path), np.array([end], "<u4").tobytes()
        for batch in common.text_batches(batches, 2 << 20):
            out = []
            texts = [x or "" for x in batch.column(2).to_pylist()]
            for i, ids in enumerate(tokens.ids(texts)):
                ids += tail
                n = len(ids) // 4
                first = n % size or size
                bounds = [0, *range(first, n + 1, size)]
                out += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            rows, *numbers = (np.array(c, np.int64) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:])], ["_id", "_row", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).cast("string").alias("_t"))
    return own.mapInArrow(run, f"_id {kind}, _row long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Sequences as (how many, lengths of one); how many there are, and at least have to be."""

    patterns: list[tuple[int, list[int]]]
    used: int
    least: int


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing: each item, longest first, goes to the fullest sequence that has room. Equal sequences are filled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            room = min((r for r in open_ if r >= x), default=None)
            held = open_.pop(room) if room is not None else {(): -(-left // (size // x))}
            room = size if room is None else room
            for one, many in held.items():
                each = min(room // x, left)  # the fullest that fits stays so until it is full
                for n, take in ((min(many, left // each) if each else 0, each), (1, left % each if each and many > left // each else 0)):
                    if n and take:
                        at = open_.setdefault(room - take * x, {})
                        key = (*one, *[x] * take)
                        at[key] = at.get(key, 0) + n
                        many, left = many - n, left - n * take
                if many and one:
                    at = open_.setdefault(room, {})
                    at[one] = at.get(one, 0) + many
    return [(many, list(one)) for held in open_.values() for one, many in held.items()]


def least_sequences(counts: dict[int, int], size: int) -> int:
    """Lower bound: for each k, items over size - k have a sequence each, and what those of k or more need beyond the room of these."""
    out = 0
    for k in {0, *(x for x in counts if 2 * x <= size)}:
        alone = sum(n for x, n in counts.items() if x > size - k)
        half = {x: n for x, n in counts.items() if size < 2 * x <= 2 * (size - k)}
        rest = sum(x * n for x, n in counts.items() if k <= x and 2 * x <= size)
        free = sum(n * (size - x) for x, n in half.items())
        out = max(out, alone + sum(half.values()) + max(0, -(-(rest - free) // size)))
    return out


def _dominated(one: list[int], left: dict[int, int], room: int) -> bool:
    """Could a single item that is left out replace some of those beside the first, being as long as they are or longer?"""
    sums, several = 1, 0  # bit s: some items, two or more items, have the sum s
    for x in one[1:]:
        several |= several << x | (sums & ~1) << x
        sums |= sums << x
    for y, n in left.items():
        if n > one.count(y):
            low = max(0, y - room)
            if (sums >> low) & ((1 << (y - low)) - 1) & (-2 if low == 0 else -1) or several >> y & 1:
                return True
    return False


def fillings(left: dict[int, int], size: int, most: int):
    """Fillings beside the longest length left that waste at most ``most``, least waste first, as (waste, lengths); None in place of dominated ones."""
    longest = max(left)
    lengths = [x for x in sorted(left, reverse=True) if x <= size - longest]
    many = {x: min(left[x] - (x == longest), (size - longest) // x) for x in lengths}
    limit = (1 << (size - longest + 1)) - 1
    reach = [1]  # reach[k]: bits of the sums that the last k lengths have
    for x in reversed(lengths):
        sums = reach[-1]
        for _ in range(many[x]):
            sums |= reach[-1] if sums == sums | (sums << x & limit) else sums << x & limit
        reach.append(sums)

    def grow(k: int, want: int, one: list[int]):
        if not want:
            yield one
        for j in range(k, len(lengths) if want else 0):
            if not reach[len(lengths) - j] >> want & 1:
                return
            x = lengths[j]
            for n in range(min(many[x], want // x), 0, -1):
                yield from grow(j + 1, want - n * x, [*one, *[x] * n])

    for waste in range(min(most, size - longest) + 1):
        for one in grow(0, size - longest - waste, [longest]):
            yield waste, None if _dominated(one, left, waste) else one


def complete(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Few sequences that hold all pieces, by branch and bound on waste."""
    total, least = sum(x * n for x, n in counts.items()), least_sequences(counts, size)
    patterns = best_fit(counts, size)
    best = Plan(patterns, sum(n for n, _ in patterns), least)
    # The deepest open node: what it has left, what it wastes, the plan that led there. Of each open node, its
    # fillings (dropped but for the last ``KEPT``, enumerated anew on return) and how many of them were tried.
    left, wasted, plan, levels, nodes, seen, enter = dict(counts), 0, [], [], 0, {}, True
    while (enter or levels) and best.used > least and nodes < NODES:
        spare = (best.used - 1) * size - total - wasted  # more waste can't make a better packing
        back = False
        if enter:
            enter = False
            if not left:
                used = sum(n for n, *_ in plan)
                if used < best.used:
                    best = Plan([(n, one) for n, one, _ in plan], used, least)
                back = True
            else:
                mark = hashlib.blake2b(np.array(sorted(left.items())).tobytes(), digest_size=16).digest()
                back = spare < 0 or seen.get(mark, wasted + 1) <= wasted
                if not back:
                    seen[mark] = wasted
                    levels.append([fillings(left, size, spare), 0])
                    if len(levels) > KEPT:
                        levels[-KEPT - 1][0] = None
        if not back:
            node = levels[-1]
            if node[0] is None:
                node[0] = itertools.islice(fillings(left, size, spare), node[1], None)
            found = next(node[0], None)
            if found is None or found[0] > spare:
                levels.pop()
                back = True
        if back:
            if plan:
                many, one, lost = plan.pop()
                wasted -= many * lost
                for x in one:
                    left[x] = left.get(x, 0) + many
            continue
        node[1] += 1
        nodes += 1
        lost, one = found
        if one is None:
            continue
        used = Counter(one)
        many = max(1, min(left[x] // n for x, n in used.items()) - SINGLE)
        for x, n in used.items():
            left[x] -= many * n
            if not left[x]:
                del left[x]
        plan.append((many, one, lost))
        wasted += many * lost
        enter = True
    return best


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty: one piece that holds the end id alone. Repeated rows are packed each
    for itself, null ids too. Full pieces are sequences of their own; the order in which equal
    lengths fill a plan is by salt, then id. An empty table gives no rows. Other columns are ignored.
    """
    own = common.cut(tokenized(docs, path, id_col, text_col, size, end).withColumn("_salt", F.pmod(F.xxhash64("_row", "piece"), F.lit(SALTS)).cast("int")))
    counted = common.cut(own.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    counts = {x: n for x, n in counted.groupBy("length").agg(F.sum("n")).collect()}  # size rows at most
    plan = complete(counts, size).patterns if counts else []
    slots, at, first = [], dict.fromkeys(counts, 0), 0
    for many, one in plan:
        offset = 0
        for x in one:
            slots.append((x, at[x], at[x] + many, first - at[x], offset))
            at[x] += many
            offset += x
        first += many
    spark = docs.sparkSession
    by_length: dict[int, list] = {}
    for x, *slot in slots:
        by_length.setdefault(x, []).append(tuple(slot))
    # One row a length, with as many slots as the plan's patterns have of it, whatever the table's size.
    planned = spark.createDataFrame([(x, sorted(s)) for x, s in by_length.items()], "length long, slots array<struct<low: long, high: long, shift: long, offset: long>>")
    # size x SALTS rows at most, dealt by the keys that the ranks are dealt by.
    salts = counted.select("length", "_salt", F.expr("sum(n) OVER (PARTITION BY length ORDER BY _salt) - n").alias("before"))
    ranked = own.withColumn("rank", F.expr("row_number() OVER (PARTITION BY length, _salt ORDER BY _row, piece) - 1L"))
    ranked = ranked.join(salts, ["length", "_salt"]).join(F.broadcast(planned), "length").withColumn("rank", F.col("rank") + F.col("before"))
    slot = F.expr("filter(slots, x -> x.low <= rank AND rank < x.high)[0]")
    out = ranked.withColumn("slot", slot).select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.expr("rank + slot.shift").alias("sequence_id"), F.col("slot.offset").alias("offset"))
    return out


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
