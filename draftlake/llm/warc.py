"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record is built from a page, written as WARC/1.1 bytes, and read again from them.
From each come two records that name it in WARC-Refers-To and repeat its target, date and digests: a
``metadata`` record (JSON: source headers, HTTP headers, title, links) and a ``conversion``
record (the text without markup).  Record ids are version 5 UUIDs of what they name, so
a run gives the same ids again; a response's names its page, target and payload, so that pages with one id
and url but different html are told apart.  A null url is an empty target, a null page has no payload;
rows that are alike in all three give repeated records.  Title and links come from the markup of the page only: attributes by their names,
nothing in comments and scripts, in time that grows with the page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .main_text import blocks_of, title_and_links

DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:draftlake:warc")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(parts))}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    payload = (page or "").encode("utf-8", "surrogatepass")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return record({"WARC-Type": "response", "WARC-Record-ID": record_id("response", str(page_id), target, digest(payload)), "WARC-Target-URI": target, "WARC-Date": date, "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response"}, block)


def plain_text(page: str) -> str:
    """Text without markup: a line for each block, white space folded."""
    return "\n".join(b.text for b in blocks_of(page))


def derive(source: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response record."""
    head, block = parse(source)
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *fields = http.decode().split("\r\n")
    page = payload.decode("utf-8", "replace")
    title, links = title_and_links(page)
    about = {"source": {k: v for k, v in head.items() if k.startswith("WARC-") or k == "Content-Type"}, "status": status, "http": dict(f.split(": ", 1) for f in fields), "title": title, "links": links}
    blocks = {"metadata": ("application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()), "conversion": ("text/plain; charset=utf-8", plain_text(page).encode())}
    kept = {k: head[k] for k in ("WARC-Target-URI", "WARC-Date")}
    return [record({"WARC-Type": kind, "WARC-Record-ID": record_id(kind, head["WARC-Record-ID"]), "WARC-Refers-To": head["WARC-Record-ID"], **kept, "WARC-Source-Block-Digest": head["WARC-Block-Digest"], "WARC-Source-Payload-Digest": head["WARC-Payload-Digest"], "WARC-Block-Digest": digest(b), "Content-Type": of}, b) for kind, (of, b) in blocks.items()]


def responses(pages: DataFrame) -> DataFrame:
    """page_id and the response record of each page (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([response(*r) for r in rows], pa.binary())], names=["page_id", "record"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, record binary")


def derivatives(sources: DataFrame) -> DataFrame:
    """page_id and the derived records, two for each response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, d) for p, r in zip(b.column("page_id").to_pylist(), b.column("record").to_pylist(), strict=True) for d in derive(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["page_id", "record"])

    return sources.mapInArrow(run, "page_id long, record binary")


def fields(records: DataFrame) -> DataFrame:
    """The records' header fields and contents as columns."""
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "block_digest": "WARC-Block-Digest", "source_payload_digest": "WARC-Source-Payload-Digest"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [parse(r) for r in b.column("record").to_pylist()]
            columns = [pa.array([h.get(f) for h, _ in parts], pa.string()) for f in names.values()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *columns, pa.array([len(x) for _, x in parts], pa.int64()), pa.array([x.decode() for _, x in parts], pa.string())], names=["page_id", *names, "content_length", "content"])

    schema = "page_id long, " + ", ".join(f"{n} string" for n in names) + ", content_length long, content string"
    return records.mapInArrow(run, schema)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, record) as one .warc.gz for each partition, a gzip member for each record; uri and n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri, n = f"{folder}/part-{task.partitionId():06d}.warc.gz", 0
        place, path = fs.FileSystem.from_uri(uri)
        place.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with place.open_output_stream(f"{path}.{task.taskAttemptId()}.tmp", compression=None) as out:
            for b in batches:
                for r in b.column("record").to_pylist():
                    out.write(gzip.compress(r, mtime=0))
                    n += 1
        place.move(f"{path}.{task.taskAttemptId()}.tmp", path)
        yield pa.RecordBatch.from_pylist([{"uri": uri, "n_records": n}])

    return records.mapInArrow(run, "uri string, n_records long")
