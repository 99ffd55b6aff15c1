"""WARC archives with an index first, and reads of selected records as coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.session import pin, shared_folder

END = b"\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_url(url: str | None) -> str | None:
    """``url`` without what would end a header line."""
    return None if url is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of the page ``refers_to`` without it.

    ``X-Page-Id``, ``X-Refers-To`` and ``X-Payload-Length`` are extension fields; readers may ignore them.
    """
    urn = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {n}')}>"
    http = b"HTTP/1.1 200 OK" + END + b"Content-Type: text/html; charset=utf-8" + END + f"Content-Length: {len(payload)}".encode() + END + END
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", plain_url(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to)), ("X-Refers-To", str(refers_to))]
    fields += [("X-Payload-Length", str(len(payload))), ("WARC-Payload-Digest", "sha1:" + digest_of(payload)), ("WARC-Block-Digest", "sha1:" + digest_of(block))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1" + END + b"".join(f"{k}: {v}".encode() + END for k, v in fields) + END
    return head + block + END + END


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the payload of one record, its digests checked."""
    head, _, rest = raw.partition(END + END)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(END + END)[2]
    if "sha1:" + digest_of(block) != fields["WARC-Block-Digest"]:
        raise ValueError("block digest does not match")
    if fields["WARC-Type"] == "response" and "sha1:" + digest_of(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError("payload digest does not match")
    return fields, payload


INDEX = "page_id long, url string, record_type string, digest string, file string, offset long, length long"


def _write(folder: str, date: str, file_bytes: int, level: int):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, at, rows = None, "", 0, []
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                page, url, payload, refers = page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py()
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    name, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []  # an attempt that fails leaves a file no index names
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(page, url, payload, refers, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                kind = "response" if refers is None else "revisit"
                rows.append({"page_id": page, "url": url, "record_type": kind, "digest": digest_of(payload), "file": name, "offset": at, "length": len(member)})
                at += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 27, level: int = 1) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``folder`` and return the index, itself written.

    ``folder`` is a URI that every executor can reach. Of equal payloads of at least ``min_bytes``, the page
    with the largest page_id is the response and the others revisit it. Every record is a gzip member of its own.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest"))
    big = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    last = rows.filter(big).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = rows.join(last, "digest", "left")
    refers = F.when(big & (F.col("page_id") < F.col("last")), F.col("last"))
    told = told.select("page_id", "url", "html", refers.alias("refers_to"))
    return pin(told.mapInArrow(_write(folder, date, file_bytes, level), INDEX))


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _read(folder: str, gap: int, most: int, with_html: bool):
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = pa.schema(fields + [("html", pa.string())] * with_html)

    def ranges(batches):
        """Runs of neighbouring records of one file: apart by at most ``gap`` bytes, ``most`` in all or a single one."""
        run = []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if run and (name != run[0][0] or offset > run[-1][1] + run[-1][2] + gap or offset + length - run[0][1] > most):
                    yield run
                    run = []
                run.append((name, offset, length))
        if run:
            yield run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for members in ranges(batches):
            if members[0][0] != name:
                name, file = members[0][0], store.open_input_file(f"{root}/{members[0][0]}")
            begin = members[0][1]
            raw, out = file.read_at(members[-1][1] + members[-1][2] - begin, begin), []
            for _, offset, length in members:
                head, payload = parsed(zlib.decompress(raw[offset - begin : offset - begin + length], 31))
                number = lambda key: int(head[key]) if key in head else None  # noqa: E731, B023
                row = {"page_id": number("X-Page-Id"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To"), "payload_bytes": number("X-Payload-Length"), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:")}
                if with_html:
                    row["html"] = payload.decode() if head["WARC-Type"] == "response" else None
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def read(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 1 << 23, with_html: bool = False) -> DataFrame:
    """RECORDS (and html, null for revisits) of the records that ``index`` lists; pass a filtered index to read a selection.

    The selected index rows are sorted by file and offset in range partitions, so a task opens few
    files and reads neighbouring records at once. All record digests are checked.
    """
    placed = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_read(folder, gap, most, with_html), RECORDS + ", html string" * with_html)


def folder_for(pages: DataFrame) -> str:
    """A new folder for archives under the session's shared one, as a URI."""
    base = shared_folder(pages.sparkSession)
    uri = base if re.match(r"\w+://|file:/", base) else "file://" + base
    uri = f"{uri}/warc/{uuid.uuid4().hex}"
    store, root = pafs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    return uri


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """RECORDS of every row of ``pages``, written to archives and read back.

    A null html is an empty payload, a null url has no target and comes back null; control characters of a
    url come back percent-encoded. Rows that share page_id and payload are all responses if no larger page_id
    has that payload. A null page_id is never the one revisited and revisits nothing. Other columns are not
    read. An empty table gives an empty result.
    """
    folder = folder_for(pages)
    return read(write(pages, folder, min_bytes), folder)
