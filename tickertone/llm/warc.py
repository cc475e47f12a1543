"""WARC archives: writing, the normaliser that gives each record a gzip member of its own, reading by index.

Files lie in a folder that driver and executors share and are reached through pyarrow's file systems.
A task names its files by a random part and reports them in its rows; files of lost tasks are not in
the manifest and are never read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickertone.llm.shared import shared_folder, written

#: Payloads of fewer bytes are never replaced by a revisit record.
MIN_REVISIT_BYTES = 100
#: A file is closed once it holds this many bytes before compression.
FILE_BYTES = 64 << 20
_COPY = 1 << 20
_GZIP = zlib.MAX_WBITS | 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def payload_columns(html: Column) -> list[Column]:
    content = F.coalesce(html, F.lit(""))
    return [F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")]


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, n_bytes and original: the smallest page_id of an equal payload, null for a response.

    A null html is an empty payload. Pages without an id can only be revisits. All rows with the
    smallest id are responses. Only payloads that occur twice are joined back; that table is written
    first, so that Spark broadcasts it by its known size or else joins in a way that splits hot keys.
    """
    rows = pages.select("page_id", "url", "html", *payload_columns(F.col("html")))
    shared = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    shared = written(shared.where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), small=True)
    joined = rows.join(shared, "digest", "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("n_bytes") >= min_bytes)
    return joined.select("page_id", "url", "html", "digest", "n_bytes", F.when(is_revisit, F.col("first")).alias("original"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC record with its two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if original is not None:
        head += [f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of pages as with_originals gives them, each file one gzip stream; rows: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_folder(folder)
        system.create_dir(base, recursive=True)
        out, path, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [count]})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, html, digest, _, original = (x.as_py() for x in row)
                if out is None:
                    path, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = system.open_output_stream(f"{base}/{path}", compression=None), zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                data = record(page_id, url, (html or "").encode(), digest, original)
                out.write(packer.compress(data))
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return pages.mapInArrow(run, "path string, records long")


class _Inflated:
    """Bytes of a gzip file, of one member or several, read in pieces."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.inflater, self.held = source, zlib.decompressobj(_GZIP), bytearray()

    def fill(self) -> bool:
        """More bytes, or False at the end of the file."""
        data = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        data = data or self.source.read(_COPY)
        if self.inflater.eof:
            if not data:
                return False
            self.inflater = zlib.decompressobj(_GZIP)
        # Bytes may wait in the inflater after all input is read.
        more = self.inflater.decompress(data, _COPY)
        if not data and not more:
            raise ValueError("gzip stream ends early")
        self.held += more
        return True

    def head(self) -> bytes | None:
        """Lines up to and with the next empty one; None if nothing is left."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(self.held)
            if not self.fill():
                if self.held.strip():
                    raise ValueError("a record ends within its head")
                return None
        out = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.fill():
                raise ValueError("a record ends within its block")
            piece = bytes(self.held[:size])
            del self.held[: len(piece)]
            size -= len(piece)
            if piece:
                yield piece


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, without the first line."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines if x)}


def normalise_file(source: pa.NativeFile, out: pa.NativeFile) -> Iterator[dict]:
    """Copy each record of a gzip file into a member of its own; gives the place and name of each."""
    stream = _Inflated(source)
    at = 0
    while (head := stream.head()) is not None:
        fields = fields_of(head)
        packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
        length = out.write(packer.compress(head))
        for piece in stream.take(int(fields["content-length"]) + 4):  # with the two line ends after the block
            length += out.write(packer.compress(piece))
        length += out.write(packer.flush())
        yield {"offset": at, "length": length, "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}
        at += length


def _each_row(work: Callable[[fs.FileSystem, str, str], dict]) -> Callable:
    """A mapInArrow function that calls work with the file system and path of each row's file, and its folder's address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                yield from work(*_open_folder(uri), uri)

    return run


def _spread(files: DataFrame) -> DataFrame:
    """One file, or a few, for each task."""
    return files.repartition(max(1, files.count()), "path")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Each file rewritten with a member for each record, and beside it an index of one JSON line for each record.

    Rows: path, index_path, records. Input files may be one gzip stream or many members.
    """

    def work(system: fs.FileSystem, path: str, _: str) -> Iterator[pa.RecordBatch]:
        target, base = _open_folder(folder)
        target.create_dir(base, recursive=True)
        name, count = f"{uuid.uuid4().hex}.warc.gz", 0
        with system.open_input_stream(path, compression=None) as source, target.open_output_stream(f"{base}/{name}", compression=None) as out:
            with target.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                for entry in normalise_file(source, out):
                    index.write(json.dumps(entry).encode() + b"\n")
                    count += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "index_path": [f"{folder}/{name}.idx"], "records": [count]})

    return _spread(files).mapInArrow(_each_row(work), "path string, index_path string, records long")


def parse_record(data: bytes) -> tuple[int | None, str | None, str, bytes | None, int, str, int | None]:
    """page_id, url, type, payload (None in a revisit), bytes of the full payload, its digest, refers_to."""

    def number(name: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(found[1]) if found else None

    head, _, block = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    url = fields.get("warc-target-uri")
    url = None if url is None else re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), url)
    is_revisit = fields["warc-type"] == "revisit"
    size = int(fields_of(http)["content-length"]) if is_revisit else len(payload)
    return number(fields["warc-record-id"]), url, fields["warc-type"], None if is_revisit else payload, size, fields["warc-payload-digest"].removeprefix("sha256:"), number(fields.get("warc-refers-to"))


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, url, payload (null in a revisit), payload_bytes, payload_digest, record_type, refers_to of each record.

    Records are found by the index beside each file; the digest of a response is held against its payload.
    """

    def work(system: fs.FileSystem, path: str, uri: str) -> Iterator[pa.RecordBatch]:
        import hashlib

        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            ids, urls, kinds, payloads, sizes, digests, refers = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.int64())],
                names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

        with system.open_input_file(path) as archive, system.open_input_stream(f"{path}.idx", compression=None) as index:
            lines = index.read().splitlines()
            for entry in map(json.loads, lines):
                found = parse_record(zlib.decompress(archive.read_at(entry["length"], entry["offset"]), _GZIP))
                if found[3] is not None and hashlib.sha256(found[3]).hexdigest() != found[5]:
                    raise ValueError(f"payload of {entry['id']} in {uri} differs from its digest")
                rows.append(found)
                held += len(found[3] or b"")
                if held >= _COPY * 4:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _spread(files).mapInArrow(_each_row(work), schema)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written as monolithic archives, normalised, and the manifest of the normalised files."""
    folder = folder or shared_folder(spark)
    whole = written(write_archives(with_originals(pages), f"{folder}/whole"))
    return written(normalise(whole, f"{folder}/members"))
