"""SentencePiece models read as unigram models: encoding, decoding and token counts.

Blanks become the mark U+2581, one is put in front, and no piece holds a mark after another
character, so a text splits exactly before each run of marks. Each distinct chunk is scored
once by a worker. Scores are added in double precision; of equally good segmentations the
one whose last piece is longest wins. Characters in no piece go to byte pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Fixed value: how far below the least score a character in no piece is.
UNKNOWN = 10.0
#: Chunks, or trie nodes, that a worker remembers; beyond, it starts anew.
REMEMBERED = 400_000
NODES = 2_000_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Model:
    """Pieces, scores and byte pieces of a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(own.get_piece_size())
        normal = [i for i in ids if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.names = [own.id_to_piece(i) for i in ids]
        self.ids = {self.names[i]: i for i in normal}
        self.score = {p: own.get_score(i) for p, i in self.ids.items()}
        self.unknown_score = min(self.score.values()) - UNKNOWN
        self.unknown = own.unk_id()
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if own.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.quiet = {i for i in ids if own.is_control(i)}

    def chunks(self, text: str) -> list[str]:
        """The text with marks, split where no piece reaches across."""
        if not text:
            return []
        if self.whole:
            return [MARK + text.replace(" ", MARK)]
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return _CHUNK.findall(MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def spelled(self, character: str) -> list[int]:
        if not self.byte_of:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode()]

    def decode(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.quiet:
                out.append(self.names[i])
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Viterbi over the matches that an Aho-Corasick automaton of all pieces reports at each position."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.known = model, {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            self.automaton.add_word(piece, (len(piece), model.score[piece], i))
        self.automaton.make_automaton()

    def best(self, chunk: str) -> list[int]:
        """Ids of the best segmentation, in one pass; output links give each position's pieces, longest first."""
        n, model = len(chunk), self.model
        score, piece, back = [0.0] + [-float("inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        at = 0

        def settle(upto: int) -> None:
            # A character no piece covers alone may still be unknown.
            nonlocal at
            while at < upto:
                at += 1
                if chunk[at - 1] not in model.ids and score[at - 1] + model.unknown_score > score[at]:
                    score[at], piece[at], back[at] = score[at - 1] + model.unknown_score, -1, at - 1

        for end, (length, gain, i) in self.automaton.iter(chunk):
            end += 1
            if end > at + 1:
                settle(end - 1)
            total = score[end - length] + gain
            if total > score[end]:
                score[end], piece[end], back[end] = total, i, end - length
        settle(n)
        out: list[list[int]] = []
        while n:
            out.append([piece[n]] if piece[n] >= 0 else model.spelled(chunk[n - 1]))
            n = back[n]
        return [i for part in reversed(out) for i in part]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            each = self.model.chunks(text)
            try:
                out.append(b"".join([known[c] for c in each]))
            except KeyError:
                for c in each:
                    if c not in known:
                        known[c] = array("I", self.best(c)).tobytes()
                out.append(b"".join([known[c] for c in each]))
        return out


class Counter:
    """Token counts of chunks from one trie: a node has the best score and count of its prefix, found once."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.count, self.known = [0.0], [0], {}

    def add(self, chunks: list[str]) -> None:
        """Inserts distinct chunks, sorted, so that each starts where it leaves the one before."""
        if len(self.score) > NODES:
            self.clear()
        model, scores, children = self.model, self.model.score, self.children
        before, path = "", [0]
        for chunk in sorted(set(chunks)):
            shared = 0
            for a, b in zip(before, chunk):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(chunk) + 1):
                c = chunk[end - 1]
                node = children.get((path[-1], c))
                if node is None:
                    node = len(self.score)
                    children[path[-1], c] = node
                    self._forward(chunk, end, path, c)
                path.append(node)
            self.known[chunk] = self.count[path[-1]]
            before = chunk

    def _forward(self, chunk: str, end: int, path: list[int], c: str) -> None:
        """Best score of the prefix that ends at ``end``, over the pieces that end there, longest first."""
        scores, best, count = self.model.score, -float("inf"), 0
        for start in range(max(0, end - self.model.longest), end):
            gain = scores.get(chunk[start:end])
            if gain is not None and self.score[path[start]] + gain > best:
                best, count = self.score[path[start]] + gain, self.count[path[start]] + 1
        if c not in scores:
            total = self.score[path[-1]] + self.model.unknown_score
            if total > best:
                best, count = total, self.count[path[-1]] + len(self.model.spelled(c))
        self.score.append(best)
        self.count.append(count)

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(chunks, tokens) of each text."""
        each = [self.model.chunks(t) for t in texts]
        if len(self.score) > NODES:
            self.clear()
        new = {c for chunks in each for c in chunks if c not in self.known}
        if new:
            self.add(list(new))
        known = self.known
        return [(len(chunks), sum([known[c] for c in chunks])) for chunks in each]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(1).to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids (array of int). Null and empty texts have none; rows are encoded each for itself."""

    def run(batches):
        encoder = Encoder(Model(path))
        for batch in common.text_batches(batches, 2 << 20):
            raw = encoder.encode(_texts(batch))
            offsets = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id_col, text. Null ids give null; bytes that are no UTF-8 give U+FFFD."""

    def run(batches):
        model = Model(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_pieces, ids_crc32, lossless (the ids decode to the text, marks read as blanks)."""

    def run(batches):
        model = Model(path)
        encoder = Encoder(model)
        for batch in common.text_batches(batches, 2 << 20):
            texts = _texts(batch)
            raw = encoder.encode(texts)
            same = [model.decode(array("I", x)) == t.replace(MARK, " ") for x, t in zip(raw, texts)]
            columns = [pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_pieces", "ids_crc32", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, lossless boolean")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_chunks, n_tokens; null and empty texts have none. Other columns are ignored."""

    def run(batches):
        counter = Counter(Model(path))
        for batch in common.text_batches(batches, 2 << 20):
            rows = counter.counts(_texts(batch))
            columns = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], [id_col, "n_chunks", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, n_chunks long, n_tokens long")


def _file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), _file())


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _file())
