"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by range, each task writes its range to files that it rolls by compressed size, and every header and
digest is made anew from the payload. Files get temporary names; a file's manifest, written when the file is whole, tells
its name, size and digest, and only files with a manifest are archives. A task that runs again writes the same bytes and
puts the same files in place. Of records with equal payloads of some size one holds the payload, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import kept, parts, shared_path

#: Bytes of a compressed file, and of a payload from which on repeats are revisits.
FILE_BYTES, REVISIT_BYTES = 64 << 20, 1000
#: All records have one date, so that files don't depend on when they are written.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
_CHUNK = 1 << 13
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(record: bytes) -> bytes:
    """A gzip member without a time."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, length: int) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    digest32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "").replace("\r", "").replace("\n", ""))]
    head += [("WARC-Payload-Digest", f"sha1:{digest32}"), ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")]
    if kind == "revisit":
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    head += [("X-Page", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(length)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest) of every row; null pages are empty."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return own.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))


def revisits(rows: DataFrame, *, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to): of equal payloads of ``least`` bytes or more the largest page_id holds the payload, others refer to it.

    Repeated rows of the largest page_id all hold it. Rows without an id never hold a payload for others; a digest that
    only they have is not revisited. Only ids and digests meet in the join, so a page that very many rows repeat costs
    no more than its rows.
    """
    long = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    holder = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return long.distinct().join(holder, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_warc(pages: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) to files in ``folder``; returns the manifests: name, records, bytes, sha256.

    Files are sorted by page_id, digest and url, null ids last. What a page refers to travels as a row before the page's
    own, so payloads are shuffled once. A task writes under a temporary name of its own, renames a whole
    file and then writes its manifest in the same way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _place(folder)
        shard, made, stream, told = task.partitionId(), [], None, (None, None, None)

        def put(name: str, data: bytes | None, temporary: str | None = None) -> None:
            if data is not None:
                temporary = f"{root}/_tmp-{name}-{task.taskAttemptId()}"
                with fs.open_output_stream(temporary, compression=None) as out:
                    out.write(data)
            fs.move(temporary, f"{root}/{name}")

        def finish() -> None:
            stream.close()
            put(name, None, temporary)
            manifest = {"name": name, "records": count, "bytes": size, "sha256": sha.hexdigest()}
            put(f"{name}.manifest", json.dumps(manifest, sort_keys=True).encode())
            made.append(manifest)

        for batch in batches:
            for page, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if html is None:
                    told = page, digest, refers_to
                    continue
                refers_to = told[2] if told[:2] == (page, digest) else None
                if stream is None:
                    name, size, count, sha = f"pages-{shard:05d}-{len(made):05d}.warc.gz", 0, 0, hashlib.sha256()
                    temporary = f"{root}/_tmp-{name}-{task.taskAttemptId()}"
                    stream = fs.open_output_stream(temporary, compression=None)
                payload = html.encode()
                data = _member(_record("response" if refers_to is None else "revisit", page, url, digest, payload, refers_to, len(payload)))
                stream.write(data)
                sha.update(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    finish()
                    stream = None
        if stream is not None:
            finish()
        yield pa.RecordBatch.from_pylist(made, pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    rows = payloads(pages)
    notes = revisits(rows).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    both = rows.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(notes)
    order = [F.col("page_id").asc_nulls_last(), F.col("digest")]
    lined = both.repartitionByRange(parts(pages.sparkSession), *order).sortWithinPartitions(*order, F.col("html").isNotNull(), "url")
    return kept(lined.mapInArrow(run, "name string, records bigint, bytes bigint, sha256 string"))


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and block of every record of a file of gzip members, each digest checked."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, chunks = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            chunks.append(z.decompress(view[at : at + _CHUNK]))
            at += len(view[at : at + _CHUNK]) - len(z.unused_data)
        record = b"".join(chunks)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = rest[: int(headers["Content-Length"])]
        if headers["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
            raise ValueError("a block differs from its digest")
        yield headers, block


def read_warc(spark: SparkSession, folder: str, manifests: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every record in the archives of ``folder``.

    Reads the files that ``manifests`` names, and fails where one differs from its manifest.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        for batch in batches:
            for name, sha in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
                    data = file.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                rows, size = [], 0
                for h, block in read_records(data):
                    payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                        raise ValueError("a payload differs from its digest")
                    refers = h.get("X-Refers-To-Page")
                    rows.append((int(h["X-Page"]) if h["X-Page"] else None, h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, h["WARC-Type"], int(refers) if refers else None, payload))
                    size += len(payload or b"")
                    if size > 8 << 20:
                        yield told(rows)
                        rows, size = [], 0
                yield told(rows)

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)], [*kinds])

    spread = manifests.select("name", "sha256").repartition(parts(spark))
    return spread.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def archive_pages(pages: DataFrame, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The columns of op9: every row of ``pages`` (page_id, url, html) written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    manifests = write_warc(pages, folder, file_bytes=file_bytes)
    return read_warc(spark, folder, manifests).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
