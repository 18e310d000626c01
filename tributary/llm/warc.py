"""WARC archives of web pages: written one gzip member a record, read back sequentially.

Writing. Of the pages whose payloads (the html in UTF-8) are equal and have at least ``MIN_REVISIT`` bytes, those with the
largest page_id are ``response`` records, which hold the payload; the others are ``revisit`` records, which hold headers
only and name the response. Payloads are equal when their SHA-256 and length are; the archives carry the customary SHA-1.
The join that tells each page its record's type has one row for each payload on its other side, so that Spark can split
the pages of a hot payload. Each task then appends records to a file of its own and begins another after ``FILE_BYTES``.

Reading. ``Reader`` goes through a file once, forward only, in pieces of ``PIECE`` bytes: it inflates one gzip member
after the other, frames the header by its empty line and the block by Content-Length, hands the block out in pieces, and
then checks that the two closing line ends follow, that the member ends with the record, and that both digests hold. So
memory is a few pieces, whatever the size of a record. A record that breaks a rule raises ``WarcError`` with the file and
offset; with ``strict=False`` reading of that file ends with one row that says what is wrong.

Files have unique names, and only those in the manifest count, so a task that is run again does no harm.

Defined results: a null html is an empty payload; rows with equal page_id are records of their own, and all rows with
the largest page_id of their payload are responses; a null page_id counts as smaller than all others; a null url gives no
target URI; line ends and other control characters in a url are percent-encoded; an empty table gives no files; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import save, shared_dir

#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 1000
FILE_BYTES = 1 << 30
PIECE = 256 << 10
#: A record's header may be so long at most when read, so that a broken file can't fill the memory.
MAX_HEADER = 8 << 20
MANIFEST = "path string, n_records long, n_bytes long"

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tributary:page")

_CONTROL = {c: f"%{c:02X}" for c in [*range(0x21), 0x7F]}


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def plan(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, and for revisits ``refers_to`` and ``refers_url`` of the response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    large = F.octet_length("html") >= min_revisit
    rows = rows.withColumn("payload_key", F.when(large, F.concat_ws(":", F.sha2("html", 256), F.octet_length("html").cast("string"))))
    first = rows.where(large).groupBy("payload_key").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select(F.col("payload_key").alias("known_key"), F.col("response.page_id").alias("response_id"), F.col("response.url").alias("response_url"))
    again = F.col("response_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("response_id")))
    return rows.join(first, F.col("payload_key") == F.col("known_key"), "left").select(
        "page_id", "url", "html", F.when(again, F.col("response_id")).alias("refers_to"), F.when(again, F.col("response_url")).alias("refers_url")
    )


def _digest(h) -> str:
    return "sha1:" + base64.b32encode(h.digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(_NAMES, str(page_id)).urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None, date: str = EPOCH) -> bytes:
    """One record, not compressed: a response, or a revisit where ``refers_to`` is given."""
    revisit = refers_to is not None
    head = _HTTP.format(len(payload)).encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.translate(_CONTROL)))
    fields += [("WARC-Payload-Digest", _digest(hashlib.sha1(payload))), ("WARC-Block-Digest", _digest(hashlib.sha1(block)))]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", refers_url.translate(_CONTROL)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields += [("Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"".join((VERSION, b"\r\n", lines, b"\r\n", block, b"\r\n\r\n"))


def write_archives(pages: DataFrame, out_dir: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Writes all pages under ``out_dir`` and returns the manifest (saved): path, n_records, n_bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = pafs.FileSystem.from_uri(out_dir)
        part, number, sink, n, size = TaskContext.get().partitionId(), 0, None, 0, 0
        name = ""

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{out_dir}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

        for batch in batches:
            ids, urls, refers, refer_urls = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            html = batch.column(2).cast(pa.large_binary())
            for i, page_id in enumerate(ids):
                if sink is None:
                    fs.create_dir(local, recursive=True)
                    name = f"pages-{part:06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
                    sink, n, size, number = fs.open_output_stream(f"{local}/{name}", compression=None), 0, 0, number + 1
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page_id, urls[i], html[i].as_py(), refers[i], refer_urls[i])
                packed = member.compress(raw) + member.flush()
                sink.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= file_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return save(plan(pages, min_revisit).mapInArrow(write, MANIFEST), "warc-manifest")


class Record:
    """A record while its reader stands on it: ``headers`` by lower-case name, and the block in pieces, once."""

    def __init__(self, reader: Reader, offset: int, headers: dict[str, str]):
        self.reader, self.offset, self.headers = reader, offset, headers
        try:
            self.left = int(headers["content-length"])
        except (KeyError, ValueError):
            raise reader.error("a record without a whole number as Content-Length", offset) from None
        if self.left < 0:
            raise reader.error("a negative Content-Length", offset)
        self._block = hashlib.sha1()

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def pieces(self) -> Iterator[bytes]:
        """What is left of the block; after its end the block's digest has been checked."""
        while self.left:
            data = self.reader.take(min(self.left, PIECE))
            if not data:
                raise self.reader.error(f"the block ends {self.left} bytes early", self.offset)
            self.left -= len(data)
            self._block.update(data)
            yield data
        self.check("warc-block-digest", self._block)

    def payload(self) -> Iterator[bytes]:
        """The block without the HTTP head, of records that have one; after a response's end its digest has been checked."""
        digest, head = hashlib.sha1(), b"" if self.headers.get("content-type", "").startswith("application/http") else None
        for data in self.pieces():
            if head is not None:
                head += data
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    if len(head) > MAX_HEADER:
                        raise self.reader.error("the HTTP head does not end", self.offset)
                    continue
                data, head = head[at + 4 :], None
            digest.update(data)
            yield data
        if head:
            raise self.reader.error("the HTTP head does not end", self.offset)
        if self.kind != "revisit":
            self.check("warc-payload-digest", digest)

    def check(self, field: str, digest) -> None:
        said = self.headers.get(field, "")
        if said.lower().startswith("sha1:") and said[5:].strip().upper() not in (_digest(digest)[5:], digest.hexdigest().upper()):
            raise self.reader.error(f"{field} says {said}, the bytes have {_digest(digest)}", self.offset)


class Reader:
    """The records of one archive, in order. ``read(n)`` gives the next n bytes of the file at most."""

    def __init__(self, read: Callable[[int], bytes], name: str = ""):
        self.read, self.name = read, name
        self.raw, self.raw_at, self.inflated = b"", 0, b""
        self.member = None

    def error(self, what: str, offset: int | None = None) -> WarcError:
        return WarcError(f"{self.name} at {self.raw_at if offset is None else offset}: {what}")

    def _fill(self) -> bool:
        """Inflates more of the member; False where it has ended."""
        if self.member is None or self.member.eof:
            return False
        data = self.raw or self.read(PIECE)
        if not data:
            raise self.error("the file ends within a gzip member")
        try:
            self.inflated += self.member.decompress(data, PIECE)
        except zlib.error as e:
            raise self.error(f"not a gzip member: {e}") from None
        rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        self.raw_at += len(data) - len(rest)
        self.raw = rest
        return True

    def take(self, n: int) -> bytes:
        """Up to n bytes of the member, none at its end."""
        while not self.inflated and self._fill():
            pass
        out, self.inflated = self.inflated[:n], self.inflated[n:]
        return out

    def _header(self, offset: int) -> dict[str, str]:
        while (at := self.inflated.find(b"\r\n\r\n")) < 0:
            if len(self.inflated) > MAX_HEADER or not self._fill():
                raise self.error("a record's header does not end", offset)
        lines = self.inflated[:at].split(b"\r\n")
        self.inflated = self.inflated[at + 4 :]
        if not lines[0].startswith(b"WARC/"):
            raise self.error("no WARC record", offset)
        found: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            text = line.decode("utf-8", "replace")
            if text[:1] in " \t" and last:  # a folded line
                found[last] += " " + text.strip()
                continue
            key, colon, value = text.partition(":")
            if not colon:
                raise self.error(f"a header line without a colon: {text[:80]!r}", offset)
            last = key.strip().lower()
            found[last] = value.strip()
        return found

    def __iter__(self) -> Iterator[Record]:
        while True:
            self.raw = self.raw or self.read(PIECE)
            if not self.raw:
                return
            offset, self.member, self.inflated = self.raw_at, zlib.decompressobj(31), b""
            found = Record(self, offset, self._header(offset))
            yield found
            for _ in found.pieces():  # what the caller has left
                pass
            tail = b""
            while len(tail) < 5 and (data := self.take(5 - len(tail))):
                tail += data
            if tail != b"\r\n\r\n":
                raise self.error("the record does not end where its Content-Length says", offset)
            while self._fill():
                if self.inflated:
                    raise self.error("a gzip member of more than one record", offset)


RECORDS = (
    "path string, offset long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, "
    "headers map<string,string>, problem string"
)


def _whole(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


def _said_digest(headers: dict[str, str]) -> str | None:
    """The payload's SHA-1 as the header has it, in hexadecimal."""
    kind, _, value = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def _row(path: str, found: Record, size: int, digest: str) -> dict:
    h = found.headers
    revisit = found.kind == "revisit"
    return {
        "path": path, "offset": found.offset, "record_type": found.kind, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "page_id": _whole(h.get("page-id")), "refers_to": _whole(h.get("refers-to-page-id")),
        "payload_bytes": _whole(h.get("payload-length")) if revisit else size, "payload_digest": _said_digest(h) if revisit else digest, "headers": list(h.items()), "problem": None,
    }


def read_archives(manifest: DataFrame, strict: bool = True, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives in ``path``, one task a file: path, offset, record_type, record_id,
    target_uri, page_id, refers_to, payload_bytes, payload_digest (hexadecimal), headers, problem[, payload]. Size and
    digest are those of the bytes read; of a revisit, which has none, those of its header."""
    kinds = {"offset": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string())}
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([(x, kinds.get(x, pa.string())) for x in names] + [("payload", pa.binary())] * with_payload)

    def rows_of(path: str) -> Iterator[dict]:
        fs, local = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(local, compression=None) as source:
            try:
                for found in Reader(lambda n: source.read(n), path):
                    digest, size, kept = hashlib.sha1(), 0, []
                    for data in found.payload():
                        digest.update(data)
                        size += len(data)
                        if with_payload:
                            kept.append(data)
                    yield _row(path, found, size, digest.hexdigest()) | ({"payload": b"".join(kept)} if with_payload else {})
            except WarcError as e:
                if strict:
                    raise
                yield {"path": path, "problem": str(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                waiting, size = [], 0
                for row in rows_of(path):
                    waiting.append(row)
                    size += 1000 + len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(waiting, schema)
                        waiting, size = [], 0
                if waiting:
                    yield pa.RecordBatch.from_pylist(waiting, schema)

    files = manifest.select("path")
    return files.repartition(max(1, manifest.count())).mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def report(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes all pages under the shared folder and returns what the archives say of each."""
    out_dir = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, out_dir, min_revisit)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
