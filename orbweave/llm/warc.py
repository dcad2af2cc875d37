"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id; ranges are cut by exact bytes of payload, so that the same pages give the same files
under any partitioning; a range is a shard whose files roll over by compressed size. Every record is a
gzip member of its own, with headers and digests made anew. Of equal payloads of at least `least` bytes the one with the
largest page_id is the response and the others are revisits that name it. Files are written under temporary names,
renamed when whole to names of their attempt, and listed in a manifest; readers open what the manifest lists.

Cases: null html is an empty payload; a null url leaves the header out, and characters that can't stand in a header are
percent-encoded; null page_ids come first and are written without the page header; of rows that repeat the largest
page_id of a payload the first by url is the response and the others are revisits; an empty table gives no files and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import fresh_dir, small_batches, stored, table
from orbweave.llm.shards import boundaries, dealt
from orbweave.llm.token_file import file_system

# Fixed values of the public WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILES = "shard int, seq int, path string, n_records long, n_bytes long, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(kind: str, page_id: int | None, digest: str, turn: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}:{turn}')}>"


def record(page_id: int | None, url: str | None, html: str | None, digest: str, n_bytes: int, refers: int | None, revisit: bool, turn: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + (html or "").encode("utf-8", "surrogatepass")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id("revisit", page_id, digest, turn) if revisit else record_id("response", page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=-._~"),
        "WARC-Payload-Digest": base32(bytes.fromhex(digest)),
        "WARC-Block-Digest": base32(hashlib.sha1(block).digest()),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id("response", refers, digest) if revisit else None,
        "X-Page-Id": page_id,
        "X-Payload-Length": n_bytes if revisit else None,
        "X-Refers-To-Page-Id": refers if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


class Files:
    """The files of one shard; one member is held at a time."""

    def __init__(self, uri: str, shard: int, roll: int, attempt: int):
        self.uri, self.shard, self.roll, self.attempt = uri, shard, roll, attempt
        self.fs, self.root = file_system(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.seq, self.out, self.done = 0, None, []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.seq:06d}.{self.attempt}.warc.gz"
            self.temporary = f"{self.root}/_{self.name}.{os.getpid()}-{os.urandom(4).hex()}"
            self.out, self.n, self.size, self.first = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, page_id
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = pack.compress(data) + pack.flush()
        self.out.write(packed)
        self.n, self.size, self.last = self.n + 1, self.size + len(packed), page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.done.append((self.shard, self.seq, f"{self.uri}/{self.name}", self.n, self.size, self.first, self.last))
        self.seq, self.out = self.seq + 1, None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*self.done, strict=True), kinds, strict=True)], names=["shard", "seq", "path", "n_records", "n_bytes", "first_id", "last_id"])


def write_shards(batches: Iterator[pa.RecordBatch], uri: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, page_id, digest, kind); a row of kind 0 names the response of the pages that follow it."""
    files = role = of = None
    turn = 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("shard", "page_id", "digest", "kind", "url", "html", "n_bytes", "main")]
        for shard, page_id, digest, kind, url, html, n_bytes, main in zip(*columns, strict=True):
            if kind == 0:
                role, of, turn = (page_id, digest), main, 0
                continue
            if files is None or files.shard != shard:
                if files:
                    yield files.manifest()
                files = Files(uri, shard, roll, TaskContext.get().taskAttemptId())
            known = role == (page_id, digest)
            revisit = known and (of != page_id or turn > 0)
            files.add(page_id, record(page_id, url, html, digest, n_bytes, of if revisit else None, revisit, turn))
            turn += known
    if files:
        yield files.manifest()


def members(path: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    fs, name = file_system(path)
    with fs.open_input_stream(name, compression=None) as f:
        left = b""
        while left or (left := f.read(step)):
            unpack = zlib.decompressobj(31)
            out = [unpack.decompress(left)]
            while not unpack.eof:
                if not (more := f.read(step)):
                    raise ValueError(f"{path} is cut off")
                out.append(unpack.decompress(more))
            left = unpack.unused_data
            yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; lengths and digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = dict(x.decode().split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n" or base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=re.findall(r"(\w+) \w+", RECORDS))

    for batch in batches:
        for path in batch["path"].to_pylist():
            rows = []
            for data in members(path):
                fields, block = parsed(data)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if fields["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                    n, refers = len(payload), None
                else:
                    n, refers = int(fields["X-Payload-Length"]), fields.get("X-Refers-To-Page-Id")
                page = fields.get("X-Page-Id")
                rows.append((page and int(page), fields.get("WARC-Target-URI"), n, digest, fields["WARC-Type"], refers and int(refers)))
                if len(rows) == 8192:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def warc_written(pages: DataFrame, uri: str | None = None, least: int = 1000, roll: int = 64 << 20) -> DataFrame:
    """Write pages(page_id, url, html) to the folder uri and return the manifest."""
    spark = pages.sparkSession
    small_batches(spark, 1024, 8)
    uri = uri or fresh_dir(spark, "warc")
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"), "url", "html")
    # Digests that repeat, aggregated before the shuffle; only these narrow rows are joined, a hot digest is split by AQE.
    narrow = stored(rows.where(F.col("n_bytes") >= least).select("page_id", "digest"), "digests")
    main = narrow.groupBy("digest").agg(F.max("page_id").alias("main"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "main")
    roles = stored(narrow.join(main, F.col("digest") == F.col("of")).select("page_id", "digest", "main").distinct(), "roles")
    # Roles travel to their pages by the deal to shards, the only shuffle of payloads.
    pages_ = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", "n_bytes", F.lit(None).cast("long").alias("main"))
    roles = roles.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("long").alias("n_bytes"), "main")
    firsts = boundaries(pages.select(F.col("page_id").cast("long").alias("key"), (F.octet_length(body) + 512).cast("long").alias("n")))
    rows = dealt(pages_.unionByName(roles), "page_id", firsts, "shard", "page_id", "digest", "kind", "url")
    return stored(rows.mapInArrow(partial(write_shards, uri=uri, roll=roll), FILES), "manifest")


def warc_read(manifest: DataFrame) -> DataFrame:
    """One row per record of the files that the manifest lists."""
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read_files, RECORDS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_read(warc_written(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6}
ORACLES = {
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS page_id FROM p WHERE n >= 1000 GROUP BY 1)
SELECT p.page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN m.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.page_id <> p.page_id THEN m.page_id END AS refers_to
FROM p LEFT JOIN m ON m.d = p.d AND p.n >= 1000"""
}
