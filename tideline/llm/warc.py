"""WARC archives: writing, and normalising monolithic gzip files to one member a record.

Tasks write their records as WARC/1.1 into archives that are one gzip stream
each. The normaliser inflates such a file once as a stream, cuts it into records
by their Content-Length, rewrites every record as a gzip member of its own and
writes a sidecar index (one line for each record: offset, length, type, id). With
it, readers fetch and inflate single records.

Archives go below a folder that all executors share, by Arrow's file systems, so
any store that Arrow knows serves. A file's name is unique to the attempt that
writes it and counts only once its task has reported it, so a lost executor
leaves an orphan and no wrong record.

Archives of others are read too: their records have a record_id and no page_id,
their chunked, compressed or other blocks come as they stand, and only SHA-256
digests in hexadecimal digits are checked.

Defined cases: null html is an empty payload; null url leaves the target out; a
url with line ends, or white space at its ends, has a percent-encoded twin in the
header QUOTED, from which it is read back; rows that repeat a page_id are a
record each, and if theirs is the smallest page_id of a payload, all are responses.
An archive without records has an empty index; one that ends early is an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import look_up, settle, shared_dir, small_batches

CHUNK = 1 << 20
QUOTED = "X-Target-URI-Quoted"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if refers_to is given; its block is the HTTP head and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        plain = url.replace("\r", "%0D").replace("\n", "%0A").strip()
        head += [f"WARC-Target-URI: {plain}"] + [f"{QUOTED}: {quote(url, safe='')}"] * (plain != url)
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def urn_page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">") if value.startswith("<urn:page:") else ""
    return int(number) if number.lstrip("-").isdigit() else None


def mark_revisits(pages: DataFrame, least_bytes: int = 100, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, html (null: empty), digest and refers_to.

    Of equal payloads of least_bytes or more, the others refer to the smallest page_id.
    They are found on ids and digests alone. Up to broadcast_rows of them are
    broadcast to the pages (some 100 bytes each); more are joined by a shuffle.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    long = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    firsts = settle(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    again = look_up(long, firsts, ["digest"], "n", ["page_id"]).filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = settle(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first"))
    again = F.broadcast(again) if again.count() <= broadcast_rows else again.hint("merge")
    known = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return known.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_monoliths(records: DataFrame, folder: str, archive_bytes: int = 128 << 20) -> DataFrame:
    """Write each partition's records to archives of one gzip stream each; returns path and n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        out = packer = path = None
        size = count = 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "n_records"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path = f"{top}/{uuid.uuid4().hex}.whole.warc.gz"
                    out, packer, size, count = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                record = record_bytes(page_id, url, html.encode(), digest, refers_to)
                out.write(packer.compress(record))
                size, count = size + len(record), count + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.mapInArrow(write, "path string, n_records long")


def records_of(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of a gzip stream (of one member or several), inflated piece by piece."""
    unpack, held, inside = zlib.decompressobj(31), bytearray(), False
    while data := stream.read(chunk):
        while data:
            held += unpack.decompress(data)
            data, inside = unpack.unused_data, not unpack.eof
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            at = 0
            while (end := held.find(b"\r\n\r\n", at)) >= 0:
                whole = end + 8 + int(headers(bytes(held[at:end]))["content-length"])
                if len(held) < whole:
                    break
                yield bytes(held[at:whole])
                at = whole
            del held[:at]
    if inside or held.strip():
        raise ValueError("the archive ends early")


def normalise(monoliths: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives with a member for each record and a sidecar index; returns the index: path, offset, length, record_type, record_id."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = path.removesuffix(".whole.warc.gz") + f"-{uuid.uuid4().hex[:8]}.warc.gz"
                rows, at = [], 0
                with store.open_input_stream(path, compression=None) as stream, store.open_output_stream(target, compression=None) as out:
                    for record in records_of(stream):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        head = headers(record[: record.find(b"\r\n\r\n")])
                        out.write(member)
                        rows.append((target, at, len(member), head["warc-type"], head["warc-record-id"]))
                        at += len(member)
                with store.open_output_stream(target + ".idx", compression=None) as out:
                    out.write("".join(f"{o} {n} {kind} {name}\n" for _, o, n, kind, name in rows).encode())
                names = ["path", "offset", "length", "record_type", "record_id"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return monoliths.select("path").mapInArrow(rewrite, "path string, offset long, length long, record_type string, record_id string")


def read_members(index: DataFrame, folder: str) -> DataFrame:
    """Fetch every indexed record by its offset: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), record_id.

    A response's digest and length are those of the payload found; a revisit's
    stand in its own head, which describes the payload that it refers to. In
    archives of others a revisit may have neither, and records of any type come:
    their payload is the block behind the HTTP head, or the whole block if it has none.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record_id"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def parse(raw: bytes) -> tuple:
        warc, _, block = raw[:-4].partition(b"\r\n\r\n")
        head = headers(warc)
        name, kind = head["warc-record-id"], head["warc-type"]
        http, _, payload = block.partition(b"\r\n\r\n") if "msgtype=" in head.get("content-type", "").replace(" ", "") or kind == "revisit" else (b"", b"", block)
        url = unquote(head[QUOTED.lower()]) if QUOTED.lower() in head else head.get("warc-target-uri")
        given = head.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "revisit":
            size = headers(http).get("content-length")
            return urn_page(name), url, None if size is None else int(size), given or None, kind, urn_page(head.get("warc-refers-to", "")), None, name
        found = hashlib.sha256(payload).hexdigest()
        if len(given) == 64 and given != found:
            raise ValueError(f"{name}: the payload does not match its digest")
        return urn_page(name), url, len(payload), found, kind, None, payload, name

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        path = source = None
        for batch in batches:
            rows = list(zip(*[batch.column(n).to_pylist() for n in ("path", "offset", "length")], strict=True))
            for i in range(0, len(rows), 500):
                out = []
                for name, offset, length in rows[i : i + 500]:
                    if name != path:
                        path, source = name, store.open_input_file(name)
                    out.append(parse(zlib.decompress(source.read_at(length, offset), 31)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return index.mapInArrow(fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string")


def archive(pages: DataFrame, least_bytes: int = 100) -> tuple[DataFrame, str]:
    """Write pages to monolithic archives and normalise them; returns the index and the folder."""
    small_batches(pages.sparkSession)
    folder = shared_dir(pages.sparkSession)
    spread = pages.sparkSession.sparkContext.defaultParallelism
    whole = settle(write_monoliths(mark_revisits(pages, least_bytes), folder))
    return settle(normalise(whole.repartition(max(spread, 1)), folder)), folder
