"""WARC archives with an index first: where each record lies is written before anything is read.

Every task writes archives of its own, a gzip member per record, below the shared folder and
returns an index row per record: file, offset, length, URL and payload digest. The files of a
task that was lost are never named by the index that was committed. Selected records are read
back by byte ranges: the index is dealt out by file and stretch of a file, sorted by offset, and
neighbouring ranges are fetched together.

Of records with equal payloads of at least ``min_bytes`` the one with the largest ``page_id`` is
a response with the payload, and the others are revisits that refer to it.

Defined results: a null payload is an empty one; a null URL is left out of the headers; a page
without id is a response and nothing refers to it; repeated rows of the page that others refer
to are responses each; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import arrow_schema, slices
from uqframe.operators.skew import attach, fits
from uqframe.sources.session import cut_lineage, new_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("file string, offset long, length long, url string, digest string, page_id long, "
         "record_type string")
ROLL_BYTES = 1 << 30
STRETCH = 64 << 20
GAP, MOST_READ = 64 << 10, 8 << 20


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed. ``refers_to`` makes it a revisit, without the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record does not start where the index says")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def page_of(name: str | None) -> int | None:
    return int(name[10:-1]) if name and name.startswith("<urn:page:") else None


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex) and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    long = rows.where(F.length("payload") >= min_bytes)
    same = long.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    same = cut_lineage(same.where("n > 1").select("sha1", "last"), "copies")
    rows = attach(rows, same, ["sha1"], bounded=fits(same), salt_by=["page_id"])
    other = F.col("page_id").isNotNull() & (F.col("page_id") != F.col("last"))
    other &= F.length("payload") >= min_bytes
    return rows.withColumn("refers_to", F.when(other, F.col("last"))).drop("last")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0,
                   level: int = 3) -> DataFrame:
    """Write the pages below ``folder`` and return the index, which is written there too."""
    kind = arrow_schema(INDEX)

    def write(batches):
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        task, out, at, name = TaskContext.get().partitionId(), None, 0, None
        try:
            for part in slices(batches, 64):
                rows = []
                for page, url, payload, digest, other in zip(*(part[c].to_pylist() for c in (
                        "page_id", "url", "payload", "sha1", "refers_to"))):
                    if out is None or at >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name = f"pages-{task:05d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                    digest = base64.b32encode(bytes.fromhex(digest)).decode()
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = pack.compress(record_bytes(page, url, payload, digest, other))
                    data += pack.flush()
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data), "url": url,
                                 "digest": digest, "page_id": page,
                                 "record_type": "response" if other is None else "revisit"})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
        finally:
            if out is not None:
                out.close()

    rows = with_references(pages, min_bytes)
    return cut_lineage(rows.mapInArrow(write, INDEX), "index")


RECORD = ("page_id long, url string, record_type string, refers_to long, payload binary, "
          "payload_bytes long, payload_digest string")


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` selects. Payload, its length and its digest are those read
    (for revisits: no payload, and the digest that the record states)."""
    kind = arrow_schema(RECORD)

    def flush(source, run):
        start = run[0][0]
        data = source.read_at(run[-1][0] + run[-1][1] - start, start)
        for offset, length in run:
            raw = zlib.decompress(data[offset - start:offset - start + length], 31)
            fields, payload = parse_record(raw)
            revisit = fields["WARC-Type"] == "revisit"
            yield {"page_id": page_of(fields["WARC-Record-ID"]),
                   "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
                   "refers_to": page_of(fields.get("WARC-Refers-To")),
                   "payload": payload if with_payload and not revisit else None,
                   "payload_bytes": None if revisit else len(payload),
                   "payload_digest": fields["WARC-Payload-Digest"][5:] if revisit
                   else sha1_base32(payload)}

    def read(batches):
        fs, base = open_folder(folder)
        name, source, run, rows = None, None, [], []
        for part in slices(batches):
            for f, offset, length in zip(*(part[c].to_pylist() for c in ("file", "offset",
                                                                         "length"))):
                last = run[-1][0] + run[-1][1] if run else 0
                if run and (f != name or offset - last > GAP or offset + length - run[0][0] > MOST_READ):
                    rows += flush(source, run)
                    run = []
                if f != name:
                    name, source = f, fs.open_input_file(f"{base}/{f}")
                run.append((offset, length))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows = []
        if run:
            yield pa.RecordBatch.from_pylist(list(flush(source, run)), schema=kind)

    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = index.select("file", "offset", "length").repartition("file", stretch)
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read all records back, and give each page its type and the length and
    digest of its full payload; those of a revisit are its response's."""
    folder = new_path(pages.sparkSession, "archives")
    index = write_archives(pages, folder, min_bytes)
    found = cut_lineage(read_records(index, folder, with_payload=False).drop("payload", "url"),
                        "records")
    wanted = found.where("refers_to is not null").select(F.col("refers_to").alias("page_id"))
    full = (found.where("record_type = 'response'").join(wanted.distinct(), "page_id", "left_semi")
            .groupBy("payload_digest").agg(F.max("payload_bytes").alias("full_bytes")))
    full = cut_lineage(full, "responses")
    out = attach(found, full, ["payload_digest"], bounded=fits(full), salt_by=["page_id"])
    return out.select("page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"),
                      "payload_digest", "record_type", "refers_to")
