"""WARC archives: written as one gzip stream a file, normalised to one gzip member a record with a sidecar offset index.

A whole-file gzip stream can only be read from its start. The normaliser inflates it once, in chunks, and rewrites
each record as a member of its own; the index of members (offset, length) then lets any record be read alone, and the
reading be spread over tasks by bytes whatever the files' sizes.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.llm import files
from oddsmill.llm.common import materialise, scratch

#: Payloads shorter than this are never revisits; uncompressed bytes of an archive file; bytes of records that a task reads.
LEAST_REVISIT, FILE_BYTES, TASK_BYTES = 1000, 32 << 20, 8 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """A response record, or a revisit if refers_to is given: that keeps the HTTP head but not the payload."""
    page_id = "null" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes, end: int) -> dict[str, str]:
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(inflated: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) from chunks of an inflated archive; a record may span chunks, one at a time is held."""
    held = bytearray()
    need = -1
    fields: dict[str, str] = {}
    for chunk in inflated:
        held += chunk
        at = 0
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = parse_head(bytes(held[at:end]), end - at)
                need = end - at + 4 + int(fields["content-length"]) + 4
            if len(held) - at < need:
                break
            yield fields, bytes(held[at : at + need])
            at, need = at + need, -1
        del held[:at]
    if held.strip():
        raise ValueError(f"archive ends within a record ({len(held)} bytes)")


def inflate(stream) -> Iterator[bytes]:
    """Chunks of a gzip file of one or more members."""
    z = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            yield z.decompress(raw)
            raw = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): of equal payloads of LEAST_REVISIT bytes or more, the largest page_id's is kept."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    many = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    many = many.filter("n > 1 and best is not null").drop("n")
    met = rows.join(many, "sha1", "left")  # a hot payload's rows are split by adaptive skew handling
    return met.select("page_id", "url", "payload", "sha1", F.when(F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))


def write_archives(rows: DataFrame, uri: str) -> DataFrame:
    """Write rows of with_revisits as .warc.gz files of one gzip stream each under uri; (path, n_records, raw_bytes) of each."""
    files.make_dir(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = f"part-{TaskContext.get().partitionId():05d}"
        path, out, z, n, size = "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "raw_bytes": [size]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("raw_bytes", pa.int64())]))

        for b in batches:
            for x in b.to_pylist():
                if out is None:
                    path = files.new_name(uri, stem, ".warc.gz")
                    out, z, n, size = files.write_stream(path), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                raw = record(x["page_id"], x["url"], x["payload"], x["sha1"], x["refers_to"])
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(rows.mapInArrow(run, "path string, n_records long, raw_bytes long"), "warc-manifest")


INDEX = "path string, offset long, length long, record_id string, type string, refers_to string"


def normalise(archives: DataFrame, uri: str) -> DataFrame:
    """Rewrite the files in column path with one gzip member a record, each beside a sidecar index (.idx, JSON lines).

    Returns the index: (path, offset, length, record_id, type, refers_to). Archives that already have a member a record
    come through as they are; a file that ends within a record is an error.
    """
    files.make_dir(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                to = files.new_name(uri, path.rpartition("/")[2].removesuffix(".warc.gz"), ".warc.gz")
                rows, at = [], 0
                with files.read_stream(path) as source, files.write_stream(to) as out, files.write_stream(f"{to}.idx") as sidecar:
                    for fields, raw in records(inflate(source)):
                        member = gzip.compress(raw, 6, mtime=0)
                        out.write(member)
                        rows.append({"path": to, "offset": at, "length": len(member), "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to")})
                        at += len(member)
                        if len(rows) == 5000:
                            sidecar.write("".join(json.dumps(r) + "\n" for r in rows).encode())
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    sidecar.write("".join(json.dumps(r) + "\n" for r in rows).encode())
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string())])
    n = max(1, archives.count())
    return materialise(archives.select("path").coalesce(1).repartition(n).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """(record_id, type, refers_to, payload_bytes, payload_digest) of each record, by its offset in the index.

    The digest is taken from the payload that is read; for a revisit, size and digest are those its record states.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    spark = index.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(total // TASK_BYTES) + 1)
    dealt = index.select("path", "offset", "length").repartition(n, "path", F.floor(F.col("offset") / (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for b in batches:
            out = []
            for x in sorted(b.to_pylist(), key=lambda x: (x["path"], x["offset"])):
                if x["path"] != path:
                    if source:
                        source.close()
                    path, source = x["path"], files.read_file(x["path"])
                source.seek(x["offset"])
                raw = gzip.decompress(source.read(x["length"]))
                end = raw.index(b"\r\n\r\n")
                fields = parse_head(raw, end)
                block = raw[end + 4 : end + 4 + int(fields["content-length"])]
                head, _, payload = block.partition(b"\r\n\r\n")
                if fields["warc-type"] == "revisit":
                    size = int(next(v for k, _, v in (h.partition(b":") for h in head.split(b"\r\n")) if k.strip().lower() == b"content-length"))
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                else:
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                out.append((fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), size, digest))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 3 else pa.string()) for k, c in enumerate(columns)], names=["record_id", "type", "refers_to", "payload_bytes", "payload_digest"])
        if source:
            source.close()

    return dealt.mapInArrow(run, "record_id string, type string, refers_to string, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, normalise them, read them back by their index.

    A null html is an empty payload, a null url leaves the target out; a page_id that is null comes back null and is
    never referred to. Rows that are equal in page_id and payload are all responses.
    """
    spark = pages.sparkSession
    manifest = write_archives(with_revisits(pages), scratch(spark, "warc-whole"))
    return read_records(normalise(manifest, scratch(spark, "warc")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every page as it comes back from the normalised archives."""
    page = lambda c: F.regexp_extract(c, rf"^<{ID}(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
