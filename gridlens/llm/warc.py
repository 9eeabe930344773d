"""WARC archives: a writer with revisit records and a salvage reader.

The reader checks each record (gzip member, version line, header fields, length, digests).
After a failed check it searches for the next valid member or version line, recovers the
later records and logs the bytes between as a gap. Files are read by stream through
pyarrow's file systems, a record at a time, one task a file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are always written out.
LEAST_BYTES = 100
#: Bytes read at a time; most bytes of a record's header block; level of compression.
CHUNK, HEADER, LEVEL = 1 << 20, 1 << 16, 1
#: Fixed values of the format.
ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length"}
VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD = "kind string, path string, offset long, length long, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record, uncompressed. A revisit has HTTP headers alone, which tell the payload's size."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "unknown:"


def _name(page) -> str:
    return "<urn:page:>" if page is None else f"<urn:page:{page}>"


def _written(folder: str):
    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        path, count, out = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in common.text_batches(batches):
            page, url, digest, size, first = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for k, payload in enumerate(common.binary_values(batch.column(2))):
                if out is None:
                    out = store.open_output_stream(path, compression=None)
                again = first[k] is not None and first[k] != page[k]
                body = record("revisit", _name(page[k]), _uri(url[k]), b"", digest[k], size[k], _name(first[k])) if again else record("response", _name(page[k]), _uri(url[k]), payload, digest[k], size[k])
                press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(press.compress(body) + press.flush())
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives of gzip members in ``folder``, a record per row; returns (path, records) of each file, already written.

    Of rows with equal payloads of ``LEAST_BYTES`` or more the one of least id is the
    response, others revisit it; rows that share that id too are responses all, and rows
    without id are, unless one with an id has their payload. A task that is tried again writes a file of its own, and
    only the files listed count. Null payloads are empty. Other columns are ignored.
    """
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    own = own.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    large = own.where(F.col("n") >= LEAST_BYTES)
    first = large.groupBy("digest").agg(F.min("page").alias("first"))
    rows = large.join(first, "digest").select("page", "url", "payload", "digest", "n", "first").union(own.where(F.col("n") < LEAST_BYTES).withColumn("first", F.lit(None).cast("long")))
    return common.cut(rows.mapInArrow(_written(folder), "path string, records long"))


class _Salvage:
    """Walks one archive; ``records`` yields rows of ``RECORD`` without the path."""

    def __init__(self, stream, size: int, payloads: bool):
        self.stream, self.size, self.payloads = stream, size, payloads

    def read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def records(self) -> Iterator[tuple]:
        at, bad, reason = 0, None, ""
        while at < self.size:
            try:
                row, end = self.one(at)
            except (ValueError, zlib.error) as error:
                if bad is None:
                    bad, reason = at, str(error)
                at = self.next(at + 1)
                continue
            if bad is not None:
                yield self.gap(bad, at, reason)
                bad = None
            yield ("record", at, end - at, None, *row)
            at = end
        if bad is not None:
            yield self.gap(bad, self.size, reason)

    def gap(self, at: int, end: int, reason: str) -> tuple:
        return ("gap", at, end - at, reason[:200], *[None] * 7)

    def next(self, at: int) -> int:
        """Where the next member or version line begins that reads as one, or the end."""
        while at < self.size:
            data = self.read(at, CHUNK)
            for m in re.finditer(re.escape(MAGIC) + b"|" + re.escape(VERSION), data):
                if self.likely(at + m.start()):
                    return at + m.start()
            if at + len(data) >= self.size:
                break
            at += max(1, len(data) - len(VERSION))
        return self.size

    def likely(self, at: int) -> bool:
        start = self.read(at, 512)
        if start.startswith(MAGIC):
            try:
                start = zlib.decompressobj(31).decompress(start, 64)
            except zlib.error:
                return False
        return bool(re.match(rb"WARC/1\.[0-9]+\r?\n", start))

    def one(self, at: int) -> tuple[tuple, int]:
        """The record at ``at`` and where it ends; ValueError or zlib.error if a check fails."""
        if self.read(at, len(MAGIC)) != MAGIC:
            fields, start = self.head(self.read(at, HEADER))
            size = self.length(fields)
            block = self.read(at + start, size)
            end = at + start + size
            tail = self.read(end, 4)
            if tail != b"\r\n\r\n":
                raise ValueError("no blank lines after the record")
            return self.checked(fields, block, size), end + 4
        unzip, parts, here = zlib.decompressobj(31), [], at
        while not unzip.eof:
            chunk = self.read(here, CHUNK if here - at >= CHUNK else CHUNK >> 4)
            if not chunk:
                raise ValueError("the member has no end")
            parts.append(unzip.decompress(chunk))
            here += len(chunk)
        data = b"".join(parts)
        fields, start = self.head(data[:HEADER])
        size = self.length(fields)
        if data[start + size :] != b"\r\n\r\n":
            raise ValueError("the member's length is not its record's")
        return self.checked(fields, data[start : start + size], size), here - len(unzip.unused_data)

    def head(self, data: bytes) -> tuple[dict[str, str], int]:
        end = data.find(b"\r\n\r\n")
        if not re.match(rb"WARC/1\.[0-9]+\r\n", data) or end < 0:
            raise ValueError("no version line or header block")
        fields = {}
        for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError("a header line without a colon")
            name = name.strip().lower()
            if name in fields and name in ONCE:
                raise ValueError("a header field comes twice")
            fields[name] = value.strip()
        return fields, end + 4

    def length(self, fields: dict[str, str]) -> int:
        size = fields.get("content-length", "")
        if not size.isdigit() or int(size) > self.size << 12:
            raise ValueError("no valid Content-Length")
        return int(size)

    def checked(self, fields: dict[str, str], block: bytes, size: int) -> tuple:
        if len(block) != size:
            raise ValueError("the record is cut off")
        if not fields.get("warc-type") or not fields.get("warc-record-id"):
            raise ValueError("a required header field is missing")
        self.same(fields.get("warc-block-digest"), block)
        head, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
        n, told = len(payload), fields.get("warc-payload-digest")
        if fields["warc-type"] == "revisit":
            m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
            n = int(m[1]) if m else None
            digest = told.partition(":")[2] if told else None
        else:
            self.same(told, payload)
            digest = hashlib.sha256(payload).hexdigest()
        return fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), n, digest, payload if self.payloads else None

    def same(self, told: str | None, data: bytes) -> None:
        name, _, value = (told or "").partition(":")
        if name == "sha256" and value != hashlib.sha256(data).hexdigest():
            raise ValueError("a digest differs")


def _read(payloads: bool, folder: str):
    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_file(path) as stream:
                    for kind, *row in _Salvage(stream, stream.size(), payloads).records():
                        rows.append((kind, path, *row))
                        held += 500 + len(row[-1] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def read(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Rows of ``RECORD`` for the archives whose paths, in the file system of ``folder``, are the first column of ``files``.

    kind is record, or gap for bytes that were quarantined, with the reason. An empty file has neither.
    """
    return files.select(F.col(files.columns[0]).alias("path")).repartition(common.parts(files.sparkSession)).mapInArrow(_read(payloads, folder), RECORD)


def _page(name: str):
    return F.expr(f"CAST(nullif(regexp_extract({name}, '^<urn:page:(-?[0-9]*)>$', 1), '') AS LONG)")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    rows = read(files, folder, payloads=False).where("kind = 'record'")
    return rows.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))
