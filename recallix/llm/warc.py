"""WARC archives, index first.

Writing gives an index row per record: file, offset, length, URL, digest. Reading selects index rows, sorts them by
place, coalesces neighbouring byte ranges into few reads and parses the records in them. Files lie in a folder that
driver and executors share, under any scheme that pyarrow's file systems know. A lost or repeated task leaves at most
a file that no index row names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_count, fresh_dir, plan_size, quoted, short_batches

#: Bytes after which a task opens its next file; the most that one read spans, the gap that it may bridge, and
#: the bytes that a task reads.
FILE_BYTES, READ_BYTES, GAP_BYTES, TASK_BYTES = 256 << 20, 8 << 20, 64 << 10, 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def member(head: list[str], block: bytes) -> bytes:
    """A record as a gzip member."""
    raw = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def named(place: str) -> str:
    """A record's id, from its file and offset, so that repeated rows have ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def info(name: str) -> bytes:
    """The record that opens a file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {named(name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return member(head, b"software: recallix\r\nformat: WARC File Format 1.1\r\n")


def record(place: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, target: str | None = None) -> bytes:
    """One page's record. A revisit holds no payload, but its size and digest, and names the URL and date of the response
    that has it."""
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP.format(len(payload)).encode() + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {named(place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + escaped(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
        if target is not None:
            head.append("WARC-Refers-To-Target-URI: " + escaped(target))
    return member(head, block)


def parsed(data: bytes) -> dict:
    """A record's fields; a response's size and digest are those of the payload that is there."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    page = int(h["x-page-id"]) if "x-page-id" in h else None
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    out = {"page_id": page, "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": None, "payload": None, "payload_bytes": int(h["x-payload-length"]), "payload_digest": digest}
    if h["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        found = hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"the payload of page {page} does not have its digest")
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
    else:
        out["refers_to"] = int(h["x-refers-to-page-id"])
    return out


def planned(pages: DataFrame, least: int = 100, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload (binary), digest, and refers_to and target (its URL) where the record is to be a revisit.

    Payloads are compared by SHA-256 and only from `least` bytes on; digests meet without their payloads, and counts
    are taken before the shuffle, so that a payload with many copies is no burden to a task.
    """
    payload = F.coalesce(F.col(quoted(html)), F.lit("")).cast("binary")
    rows = pages.select(F.col(quoted(key)).cast("bigint").alias("page_id"), F.col(quoted(url)).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    small = rows.where(F.octet_length("payload") >= least).select("page_id", "digest", "url")
    least_url = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    many = small.groupBy("digest").agg(least_url.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = small.join(many, "digest").where("page_id > first.page_id")
    marks = marks.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("target")).distinct()
    return rows.join(marks, (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left").drop("_p", "_d")


def write_warc(pages: DataFrame, folder: str | None = None, **names) -> tuple[str, DataFrame]:
    """Write a record per row; the folder and its index, which lies there as Parquet.

    Null html is the empty payload; a null url has no target; null page ids are responses. Of rows with equal payloads
    of 100 bytes or more, those with the smallest page_id are responses (each of them, if it repeats) and the others
    revisit it. Extra columns are left out. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    short_batches(spark)
    folder = folder or fresh_dir(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        out, name, at, number = None, "", 0, 0
        stem = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                rows = []
                for p, u, payload, digest, refers, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out:
                            out.close()
                        name, at, number = f"{stem}-{number:03d}.warc.gz", 0, number + 1
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(first := info(name))
                        at = len(first)
                    data = record(f"{name}:{at}", p, u, payload, digest, refers, target)
                    out.write(data)
                    rows.append((p, u, name, at, len(data), len(payload), digest, "response" if refers is None else "revisit", refers))
                    at += len(data)
                cols = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _kinds(INDEX), strict=True)], _names(INDEX))
        finally:
            if out:
                out.close()

    rows = planned(pages, **names).select("page_id", "url", "payload", "digest", "refers_to", "target")
    rows.mapInArrow(write, INDEX).coalesce(file_count(spark, size=plan_size(pages))).write.parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _kinds(schema: str) -> list[pa.DataType]:
    return [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]


def read_warc(folder: str, index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the index rows given, read from the archives by coalesced byte ranges in the order of places."""
    spark = index.sparkSession
    total = index.agg(F.sum("length").alias("s")).first()["s"] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ordered = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        run: list[tuple[int, int]] = []
        name, source, source_name = None, None, None

        def records():
            nonlocal source, source_name
            if source_name != name:
                if source:
                    source.close()
                source, source_name = system.open_input_file(f"{path}/{name}"), name
            start = run[0][0]
            data = source.read_at(run[-1][0] + run[-1][1] - start, start)
            rows = [parsed(data[o - start : o - start + n]) for o, n in run]
            cols = [[r[k] for r in rows] for k in _names(RECORD)]
            if not payload:
                cols[-1] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _kinds(RECORD), strict=True)], _names(RECORD))

        for batch in batches:
            for f, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (f != name or o - (run[-1][0] + run[-1][1]) > GAP_BYTES or o + n - run[0][0] > READ_BYTES):
                    yield records()
                    run = []
                name = f
                run.append((o, n))
        if run:
            yield records()
        if source:
            source.close()

    return ordered.mapInArrow(read, RECORD).coalesce(parts)
