"""Token ids as files of independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a stream of little-endian unsigned 32-bit ids in ascending doc_id order, cut into frames at document ends
(long documents span frames), an index frame (skippable), and a seek table as in the public zstd seekable format:
compressed size, size and the low half of XXH64 of each frame, then the number of frames, a flag byte and the magic
number. The index holds doc_id, a null flag, and the count of ids of each document, so that readers decompress only
the frames of the documents they ask for.

Shards are ranges of doc_id cut by bytes of text, so that the same table gives the same files under any partitioning.
They are written under temporary names and renamed to names of their attempt; the manifest lists those of the attempts
that counted. `start` of a shard's first document is the sum of the ids of the shards before it.

Cases: null and empty texts have the end id only; a null doc_id comes first; rows that repeat a doc_id are kept, in
order of their texts, null first; an empty table gives no file and no rows; other columns are ignored. Strings of special
tokens are those tokens, wherever they stand, as the library has it.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import fresh_dir, release, small_batches, stored, table
from orbweave.llm.shards import boundaries, dealt

# Fixed values of the public zstd seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids in a frame, about, and at most.
FRAME, FRAME_MOST = 1 << 18, 1 << 20
END = 2
#: White space of the tokenizer; chunks without it but for a blank in front and single line ends inside.
SPACE = r"\s\v\x{1c}-\x{1f}\x{85}\p{Z}"
PLAIN = rf"\A ?[^{SPACE}]+(\n[^{SPACE}]+)*\z"
#: Encoders of this worker process, by path; its later tasks find their memory filled.
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SHARDS = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class Writer:
    """One file, written frame by frame; nothing but the open frame and the index is held."""

    def __init__(self, uri: str, name: str):
        self.fs, self.root = file_system(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.final = name, f"{self.root}/{name}"
        self.temporary = f"{self.root}/_{name}.{os.getpid()}-{os.urandom(4).hex()}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.compress = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.open = bytearray()
        self.docs: list[tuple[int, int, int]] = []
        self.size = 0

    def flush(self) -> None:
        while self.open:
            part = bytes(self.open[:FRAME_MOST])
            del self.open[:FRAME_MOST]
            packed = self.compress.compress(part)
            self.out.write(packed)
            self.size += len(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray, end: int) -> None:
        self.open += ids.astype("<u4", copy=False).tobytes() + struct.pack("<I", end)
        self.docs.append((doc_id or 0, doc_id is None, len(ids) + 1))
        if len(self.open) >= FRAME:
            self.flush()

    def close(self) -> None:
        self.flush()
        index = self.compress.compress(b"".join(struct.pack("<q?Q", *d) for d in self.docs))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        tail = struct.pack("<II", SKIPPABLE, len(index)) + index
        tail += struct.pack("<II", SEEK_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(tail)
        self.size += len(tail)
        self.out.close()
        self.fs.move(self.temporary, self.final)


class Reader:
    """Documents of one file; only the frames that hold the asked ones are read."""

    def __init__(self, path: str):
        self.fs, name = file_system(path)
        self.file = self.fs.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"no seek table: {path}")
        raw = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.frames = np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        begin = int(self.at[-1])
        kind, length = struct.unpack("<II", self.file.read_at(8, begin))
        if kind != SKIPPABLE:
            raise ValueError(f"no index: {path}")
        self.decompress = zstandard.ZstdDecompressor()
        index = self.decompress.decompress(self.file.read_at(length, begin + 8)) if length else b""
        self.index = np.frombuffer(index, np.dtype([("id", "<i8"), ("null", "?"), ("n", "<u8")]))
        self.doc_at = np.concatenate([[0], np.cumsum(self.index["n"].astype(np.int64))])
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.kept[0] != i:
            raw = self.decompress.decompress(self.file.read_at(int(self.frames[i, 0]), int(self.at[i])), max_output_size=int(self.frames[i, 1]))
            if len(raw) != self.frames[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[i, 2]:
                raise ValueError(f"frame {i} is damaged")
            self.kept = (i, raw)
        return self.kept[1]

    def pieces(self, k: int) -> Iterator[bytes]:
        """The ids of document k, frame by frame."""
        a, b = 4 * int(self.doc_at[k]), 4 * int(self.doc_at[k + 1])
        i = int(np.searchsorted(self.raw_at, a, "right")) - 1
        while a < b:
            lo, hi = int(self.raw_at[i]), int(self.raw_at[i + 1])
            yield self.frame(i)[a - lo : min(b, hi) - lo]
            a, i = min(b, hi), i + 1

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(k)), "<u4")


class Encoder:
    """The tokenizer behind a bounded memory of blank-separated chunks.

    A blank that follows a non-blank, or that precedes one, begins a new piece of the tokenizer's own splitting, so that
    such chunks are encoded alone to the same ids; texts where a blank stands inside a run of white space, and texts that
    hold the string of an added token, go whole.
    The memory has two generations of at most `most` chunks: a full one becomes the old one, of which chunks that are met
    again are carried over.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.most = most
        line = self.whole(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str], plain: np.ndarray, lines: np.ndarray) -> list[bytes]:
        """Encode new chunks; plain ones go many to a call, a line end between them."""
        out: list[bytes | None] = [None] * len(chunks)
        at = np.flatnonzero(plain) if self.line is not None else np.zeros(0, np.int64)
        parts = [at[i : i + 256] for i in range(0, len(at), 256)]
        for part, ids in zip(parts, self.whole(["\n".join([chunks[i] for i in p.tolist()]) for p in parts]), strict=True):
            flat = np.array(ids, "<u4")
            found = np.flatnonzero(flat == self.line)
            own = np.cumsum(lines[part] + 1)
            if len(found) == own[-1] - 1:
                raw, cut = flat.tobytes(), found[own[:-1] - 1]
                begin, end = np.concatenate([[0], 4 * cut + 4]).tolist(), np.append(4 * cut, len(raw)).tolist()
                for i, a, b in zip(part.tolist(), begin, end, strict=True):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([chunks[i] for i in rest]), strict=True):
            out[i] = np.array(x, "<u4").tobytes()
        return out

    def look_up(self, values: list[str], plain: np.ndarray, lines: np.ndarray) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        gc.disable()  # many small objects and no cycles
        found = list(map(known.get, values))
        missed = [i for i, x in enumerate(found) if x is None]
        if missed and old:
            own = [values[i] for i in missed]
            again = [(i, v, x) for i, v, x in zip(missed, own, map(old.get, own), strict=True) if x is not None]
            for i, v, x in again:
                found[i] = known[v] = x
            if again:
                missed = [i for i in missed if found[i] is None]
        if missed:
            own = [values[i] for i in missed]
            new = self.learn(own, plain[missed], lines[missed])
            known.update(zip(own, new, strict=True))
            for i, x in zip(missed, new, strict=True):
                found[i] = x
        gc.enable()
        return found

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every row."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, rf"[{SPACE}] ([{SPACE}]|$)").to_numpy(zero_copy_only=False)
        for x in self.special:
            odd = odd | pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", column), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        first = np.zeros(len(words), bool)
        first[at[:-1][at[:-1] < len(words)]] = True
        # The first chunk of a text has no blank before it.
        chunks = pc.if_else(pa.array(first), words, pc.binary_join_element_wise("", words, " ")).dictionary_encode()
        different = chunks.dictionary
        plain = pc.match_substring_regex(different, PLAIN).to_numpy(zero_copy_only=False)
        found = self.look_up(different.to_numpy(zero_copy_only=False).tolist(), plain, pc.count_substring(different, "\n").to_numpy())
        place = chunks.indices.to_numpy()
        lengths = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ends = np.cumsum(lengths, dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u4")
        size = lengths[place]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int32)]).astype(np.int32)
        flat = ids[np.repeat((ends - lengths)[place] - total[:-1], size) + np.arange(total[-1], dtype=np.int32)]
        for r in range(len(column)):
            yield np.array(self.whole([column[r].as_py()])[0], np.uint32) if odd[r] else flat[total[at[r]] : total[at[r + 1]]]


def bounded(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def write_shards(batches: Iterator[pa.RecordBatch], uri: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard and doc_id; a shard's file has the name of this attempt."""
    writer, n, shard = None, 0, -1
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def closed() -> pa.RecordBatch:
        writer.close()
        row = [[shard], [f"{uri}/{writer.name}"], [len(writer.docs)], [n], [writer.size]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "path", "n_docs", "n_ids", "n_bytes"])

    for batch in batches:
        for b in bounded(batch, 4 << 20):
            for s, doc_id, ids in zip(b["shard"].to_pylist(), b["doc_id"].to_pylist(), encoder_of(path).encode(b["text"]), strict=True):
                if s != shard:
                    if writer:
                        yield closed()
                    shard, n = s, 0
                    writer = Writer(uri, f"shard-{s:06d}.{TaskContext.get().taskAttemptId()}.zst")
                writer.add(doc_id, ids, end)
                n += len(ids) + 1
    if writer:
        yield closed()


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoders.clear()  # a worker that writes no more needs no chunks
    for batch in batches:
        for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
            r = Reader(path)
            for lo in range(0, len(r.index), 1 << 14):
                own = r.index[lo : lo + (1 << 14)]
                crc = np.zeros(len(own), np.int64)
                for k in range(len(own)):
                    for piece in r.pieces(lo + k):
                        crc[k] = zlib.crc32(piece, int(crc[k]))
                ids = pa.array(own["id"].astype(np.int64), mask=own["null"].copy())
                yield pa.RecordBatch.from_arrays([ids, pa.array(start + r.doc_at[lo : lo + len(own)]), pa.array(own["n"].astype(np.int64)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def tokens_written(docs: DataFrame, path: str, uri: str | None = None, end: int = END) -> DataFrame:
    """Encode docs(doc_id, text), write the shards to the folder uri, and return their manifest with `start`."""
    spark = docs.sparkSession
    small_batches(spark, 2048, 4)
    release(spark)
    uri = uri or fresh_dir(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    firsts = boundaries(rows.select(F.col("doc_id").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")))
    rows = dealt(rows, "doc_id", firsts, "shard", "doc_id", "text").select("shard", "doc_id", "text")
    done = stored(rows.mapInArrow(partial(write_shards, uri=uri, path=path, end=end), SHARDS), "manifest")
    # A row a shard: the prefix sum runs over as many rows as there are files.
    before = done.select("shard", "n_ids").orderBy("shard").collect()
    starts, total = [], 0
    for r in before:
        starts.append((r["shard"], total))
        total += r["n_ids"]
    return done.join(F.broadcast(spark.createDataFrame(starts, "shard int, start long")), "shard")


def tokens_read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files."""
    files = manifest.count()
    return manifest.select("path", "start").repartition(max(1, files), "path").mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_read(tokens_written(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op5_token_file": op5}
ORACLES: dict[str, str] = {}
