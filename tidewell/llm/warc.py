"""WARC archives with an index written first and range reads planned from it.

Writing: each task writes its records, one gzip member each, to archive files of its own in the shared folder and
yields an index row per record: file, offset, length, URL, digest. The index is stored as Parquet before anything
is read; a lost or repeated task only leaves an archive that no index row names.

Reading: the selected index rows are dealt out by stretches of files, sorted by offset, and neighbouring byte
ranges are read as one; the number of reading tasks follows from the payloads' bytes. Payloads are checked against their digests.

Of equal payloads only the one of the smallest id is stored; the others are revisit records that name it.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import col, each_salt, new_path, salted, salts_seen

LEAST, FILE_BYTES, STRETCH, TASK, GAP, RANGE = 100, 256 << 20, 2 << 20, 64 << 20, 64 << 10, 8 << 20
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_ID = "urn:tidewell:page:"
#: Header with the URL as it was, for URLs with control characters, which WARC-Target-URI has percent-encoded.
_EXACT = "X-Exact-URI"


def _store(uri: str):
    """(pyarrow file system, path) of a URI; any store that pyarrow reaches: local or shared disks, HDFS, S3, GCS."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def decided(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to); payload is null for revisits.

    Only digests that repeat take part in the join, by (digest, salt), so one payload on a third of all pages
    spreads over SALTS tasks.
    """
    payload = F.encode(F.coalesce(col(html_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("salt", salted(F.col("page_id")))
    first = (
        base.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"), salts_seen(F.col("salt")).alias("salts")).where("n > 1 and first_id is not null")
        .select("payload_digest", "first_id", each_salt(F.col("salts")).alias("salt"))
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return base.join(first, ["payload_digest", "salt"], "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _header_safe(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url, payload, size, digest, kind, refers_to, date: str) -> bytes:
    """One uncompressed WARC record."""
    body = payload if payload is not None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(url)}")
        if _header_safe(url) != url:
            lines.append(f"{_EXACT}: {json.dumps(url)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    number = lambda x: None if x is None or x[1:-1] == f"{_ID}null" else int(x[1 + len(_ID) : -1])
    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    url = json.loads(fields[_EXACT]) if _EXACT in fields else fields.get("WARC-Target-URI")
    return number(fields["WARC-Record-ID"]), url, size, digest, kind, number(fields.get("WARC-Refers-To")), body if kind == "response" else None


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, at, name = None, None, 0, ""
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, size, digest, kind, refers_to in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        if store is None:
                            store, root = _store(folder)
                            store.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    packed = gzip.compress(record(page_id, url, payload, size, digest, kind, refers_to, date), 6, mtime=0)
                    out.write(packed)
                    rows.append((page_id, url, digest, size, kind, refers_to, f"{folder}/{name}", at, len(packed)))
                    at += len(packed)
                yield _batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return write


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def write_archive(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", **names) -> DataFrame:
    """Writes the archive and its index under `folder` (a new one in the shared folder) and returns the index as stored."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    records = decided(pages, **names)
    records.mapInArrow(_writer(f"{folder}/records", date), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows sorted by file and offset; reads ranges that follow each other closely in one go."""
    name, source = None, None
    for b in batches:
        start, rows = 0, list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        while start < len(rows):
            file, low, size = rows[start]
            high, end = low + size, start + 1
            while end < len(rows) and rows[end][0] == file and rows[end][1] - high <= GAP and rows[end][1] + rows[end][2] - low <= RANGE:
                high, end = max(high, rows[end][1] + rows[end][2]), end + 1
            if file != name:
                if source is not None:
                    source.close()
                store, path = _store(file)
                name, source = file, store.open_input_file(path)
            data = source.read_at(high - low, low)
            yield _batch([parsed(zlib.decompress(data[o - low : o - low + n], 31)) for _, o, n in rows[start:end]], RECORDS)
            start = end
    if source is not None:
        source.close()


def read_records(selected: DataFrame) -> DataFrame:
    """The records of the selected index rows, read back from the archives: the columns of RECORDS; payload is null for revisits."""
    spark = selected.sparkSession
    places = selected.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    # By the bytes to be read, not by those of the index: a number that is given is kept as it is.
    payload = selected.agg(F.sum("payload_bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-payload // TASK))
    return places.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(_reader, RECORDS)


def archived(pages: DataFrame, **names) -> DataFrame:
    """All pages written to an archive and read back.

    Null html is an empty payload; a null URL has no WARC-Target-URI; a null id is kept as such and is never the
    one that others refer to unless no payload-equal page has an id (then none refers). Rows that repeat the
    smallest id of a payload are all responses. Payloads under LEAST bytes are always responses. An empty table
    gives an empty result. Other columns are ignored.
    """
    return read_records(write_archive(pages, **names))
