"""WARC archives: writing pages as records, and a sequential reader.

Written files hold one gzip member per record, so each record can be read on its own. The reader goes through a file
once, in blocks of ``BLOCK`` bytes: it inflates member after member, takes header lines, then exactly Content-Length
bytes, and checks the digests of block and payload. Only one record is in memory at a time. Files are opened with
pyarrow's file systems, on whatever store the shared folder is.

Payload: the html in UTF-8, null as empty. Of records with equal payloads of ``min_bytes`` or more, that with the
smallest page_id is a response and the others revisit it, without a block of their own; rows that repeat the smallest
page_id are all responses, and so are rows without a page_id. Rows that repeat are records each. An empty table gives no
archives. A null url is written as no target; further columns are not written. A file that is cut off or framed
wrongly raises ValueError; a digest that does not fit is told in ``digest_ok``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placespark.llm.common import shared_folder, stored

BLOCK = 1 << 16
MIN_REVISIT = 100
#: Bytes of a written file from which the next one is begun.
ROLL = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

FILES = "path string, n_records long, n_bytes long"
RECORDS = (
    "path string, record_no long, record_id string, record_type string, target_uri string, page_id long,"
    " refers_to long, payload_digest string, payload binary, payload_bytes long, digest_ok boolean"
)


def record_id(page_id: int | None, salt: str = "") -> str:
    name = f"page:{page_id}" if page_id is not None else f"unnamed:{salt}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _header(text: str) -> str:
    """A value on one line."""
    return " ".join(text.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, salt: str) -> bytes:
    """One record, uncompressed. A revisit has the http header only."""
    revisit = refers_to is not None
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, salt)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, payload digest, page_id of the response) of pages whose payload a smaller page_id has."""
    digests = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes")
    )
    digests = digests.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = first.filter("first < last").drop("last")
    return digests.drop("bytes").join(first, "digest").filter("page_id > first").distinct()


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT, roll: int = ROLL) -> DataFrame:
    """Write archives into the folder; the rows of FILES, stored. A task that runs again replaces its own files."""

    def task(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        number, out, path, n, size, total = 0, None, "", 0, 0, 0
        done = []

        def close():
            out.close()
            store.move(f"{path}.{attempt}.open", path)
            done.append((f"{part:06d}-{number - 1:04d}.warc.gz", n, size))

        for batch in batches:
            columns = (batch[c] for c in ("page_id", "url", "html", "digest", "first"))
            for page_id, url, html, digest, first in zip(*columns, strict=True):
                if out is None or size >= roll:
                    if out is not None:
                        close()
                    if not number:
                        store.create_dir(root, recursive=True)
                    path, n, size = f"{root}/{part:06d}-{number:04d}.warc.gz", 0, 0
                    number += 1
                    out = store.open_output_stream(f"{path}.{attempt}.open", compression=None)
                payload = (html.as_py() or "").encode()
                salt = f"{part}-{total}"
                data = member(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), first.as_py(), salt))
                out.write(data)
                n, size, total = n + 1, size + len(data), total + 1
        if out is not None:
            close()
        rows = [{"path": f"{folder}/{p}", "n_records": k, "n_bytes": b} for p, k, b in done]
        yield pa.RecordBatch.from_pylist(
            rows, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
        )

    of = stored(revisits(pages, min_bytes), "warc-revisits")
    of = of.select(F.col("page_id").alias("id"), F.col("digest").alias("same"), "first")
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    rows = rows.join(of, (rows["page_id"] == of["id"]) & (rows["digest"] == of["same"]), "left")
    return stored(rows.select("page_id", "url", "html", "digest", "first").mapInArrow(task, FILES), "warc-files")


class _Members:
    """Bytes of a file of gzip members, inflated as they are asked for; knows where a member ends."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""
        self.gzip = None

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.stream.read(BLOCK)
        self.gzip = zlib.decompressobj(31) if self.rest else None
        return self.gzip is not None

    def more(self) -> bytes:
        """The next inflated bytes, b"" at the end of the member."""
        while not self.gzip.eof:
            data = self.gzip.unconsumed_tail or self.rest or self.stream.read(BLOCK)
            found = self.gzip.decompress(data, BLOCK)
            if not data and not found:
                raise ValueError("the file ends within a member")
            self.rest = self.gzip.unused_data if self.gzip.eof else b""
            if found:
                return found
        return b""


def _framed(members: _Members) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record in this member."""
    data = bytearray()
    while (end := data.find(b"\r\n\r\n")) < 0:
        if not (more := members.more()):
            raise ValueError("a record without the end of its headers")
        data += more
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    del data[: end + 4]
    while len(data) < length + 4 and (more := members.more()):
        data += more
    if len(data) != length + 4 or data[length:] != b"\r\n\r\n" or members.more():
        raise ValueError("the content length does not fit the record")
    return headers, bytes(data[:length])


def records(stream) -> Iterator[dict]:
    """Records of an opened archive, in order."""
    members, number = _Members(stream), 0
    while members.next_member():
        headers, block = _framed(members)
        kind = headers.get("warc-type")
        payload = block
        if headers.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        given = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
        ok = headers.get("warc-block-digest", "").removeprefix("sha256:") in ("", hashlib.sha256(block).hexdigest())
        if kind == "revisit":
            payload = None
        elif given is not None:
            ok = ok and given == hashlib.sha256(payload).hexdigest()
        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
        yield {
            "record_no": number, "record_id": headers.get("warc-record-id"), "record_type": kind,
            "target_uri": headers.get("warc-target-uri"), "page_id": None if page is None else int(page),
            "refers_to": None if refers is None else int(refers), "payload_digest": given, "payload": payload,
            "payload_bytes": None if payload is None else len(payload), "digest_ok": ok,
        }
        number += 1


def read(spark: SparkSession, files: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the archives at ``path``, each read by one task from front to back."""
    schema = RECORDS if payload else RECORDS.replace(" payload binary,", "")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def task(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"].to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for found in records(stream):
                        rows.append(found | {"path": path})
                        size += found["payload_bytes"] or 0
                        if len(rows) >= 1000 or size >= BLOCK << 6:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(tasks, "path").mapInArrow(task, schema)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write the pages, read the archives, and give each revisit the size of the response that it refers to."""
    spark = pages.sparkSession
    files = write(pages, shared_folder(spark, "warc"), min_bytes)
    found = stored(read(spark, files, payload=False), "warc-records")
    response = found.filter("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("id"), F.col("payload_digest").alias("same"), F.col("payload_bytes").alias("size")
    )
    response = response.distinct()
    joined = found.join(
        response, (found["refers_to"] == response["id"]) & (found["payload_digest"] == response["same"]), "left"
    )
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        (F.col("digest_ok") & (F.col("refers_to").isNull() | F.col("id").isNotNull())).alias("digest_ok"),
    )


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= {MIN_REVISIT} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
    CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first THEN first END AS refers_to, true AS digest_ok
FROM d LEFT JOIN f ON d.digest = f.digest AND n >= {MIN_REVISIT}"""
