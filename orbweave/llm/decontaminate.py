"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of `size` consecutive words of the benchmark items (an item of fewer words is one pattern);
patterns of one length are searched together. The block is the last one to three words under the window: a shift table
says how far the window can move where that block is no pattern's, suffix-hash buckets give the patterns that end with
it, and comparison of the bytes confirms every occurrence. Texts are scanned side by side in pieces that overlap by a
pattern less one word, so that a long text is no longer chain than others.

Cases: null texts, empty texts and items without words have no words; repeated rows are kept; items that repeat an
item_id count once; null item_ids are left out; other columns of the documents are ignored. The tables of shifts and
suffixes are built once, on the driver, and broadcast; an item table larger than `block_bytes` is searched in blocks, one
pass over the documents each, whose hits are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.bytetext import ALNUM, U, Words, windows, words
from orbweave.llm.common import small_batches, stored, table

HITS = "rid long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


@dataclass
class Table:
    """The patterns of one length m: shifts by block, and patterns by the block that they end with.

    Pattern i is bytes lo[i]..hi[i] of Patterns.data, for items of[at[i]] .. of[at[i + 1]]; patterns are in order of suffix.
    """

    m: int
    block: int
    keys: np.ndarray
    shift: np.ndarray
    suffix: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    of: np.ndarray


class Patterns:
    """Tables of one block of items, by pattern length; flat arrays, so that a broadcast holds some 40 bytes a window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.ids = [i for i, _ in items]
        self.size = size
        # Items as their words with one blank between: a window is a slice of these bytes.
        parts, hashes, begin, end, item = [], [], [], [], []
        used = 0
        for w in words(pa.array([t for _, t in items], pa.string()), ALNUM, True):
            n = w.end - w.start
            to = np.cumsum(n + 1)
            own = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
            put = np.ones(len(own), bool)
            put[to - 1] = False
            own[put] = w.data[np.repeat(w.start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            parts.append(own)
            hashes.append(w.hashes())
            begin.append(used + to - 1 - n)
            end.append(used + to - 1)
            item.append(w.lo + np.repeat(np.arange(w.hi - w.lo), np.diff(w.first)))
            used += len(own)
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.data = flat(parts, np.uint8).tobytes()
        h, begin, end, item = flat(hashes, U), flat(begin, np.int64), flat(end, np.int64), flat(item, np.int64)
        count = np.bincount(item, minlength=len(items))
        first = np.cumsum(count) - count
        length = np.minimum(size, count)
        self.tables = [self.table(int(m), h, begin, end, item, first, count, length == m) for m in np.unique(length[length > 0])]

    def table(self, m: int, h: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, first: np.ndarray, count: np.ndarray, mine: np.ndarray) -> Table:
        block = min(m, 3)
        n = np.where(mine, count - m + 1, 0)
        start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        b, whole = windows(h, block), windows(h, m)[start]
        # Equal windows once, with all their items; equality is that of bytes within a hash.
        lo, hi = begin[start], end[start + m - 1]
        same: dict[tuple[int, bytes], int] = {}
        which = np.fromiter((same.setdefault((int(x), self.data[p:q]), len(same)) for x, p, q in zip(whole.tolist(), lo.tolist(), hi.tolist(), strict=True)), np.int64, len(start))
        one = np.unique(which, return_index=True)[1]
        suffix = b[start[one] + m - block]
        order = np.argsort(suffix, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[which], item[start]]), axis=1)
        keys, inverse = np.unique(np.concatenate([b[start[one] + o] for o in range(m - block + 1)]), return_inverse=True)
        shift = np.full(len(keys), m, np.int64)
        np.minimum.at(shift, inverse, np.repeat(np.arange(m - block, -1, -1), len(one)))
        return Table(m, block, keys, shift, suffix[order], lo[one][order], hi[one][order], np.searchsorted(pairs[0], np.arange(len(order) + 1)), pairs[1].astype(np.int32))

    def search(self, w: Words, h: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Occurrences (first word, word after) and items of every row."""
        spans: list = [[] for _ in range(w.hi - w.lo)]
        items: list = [set() for _ in range(w.hi - w.lo)]
        for t in self.tables:
            m, block, far = t.m, t.block, t.m - t.block + 1
            blocks = windows(h, block)
            # Pieces of a row: the places where a pattern may end, 512 at a time.
            first, last = w.first[:-1] + m - 1, w.first[1:]
            pieces = np.maximum(0, -(-(last - first) // 512))
            row = np.repeat(np.arange(len(first)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = first[row] + 512 * k
            stop = np.minimum(at + 512, last[row])
            while len(at):
                b = blocks[at - block + 1]
                i = np.searchsorted(t.keys, b)
                i[i == len(t.keys)] = 0
                known = t.keys[i] == b
                move = np.where(known, t.shift[i], far)
                now = np.flatnonzero(move == 0)
                low, high = np.searchsorted(t.suffix, b[now]), np.searchsorted(t.suffix, b[now], "right")
                for j, x, y in zip(now, low, high, strict=True):
                    end, r = int(at[j]), int(row[j])
                    begin = end - m + 1
                    text = b" ".join(w.data[p:q].tobytes() for p, q in zip(w.start[begin : end + 1], w.end[begin : end + 1], strict=True)) if y > x else b""
                    for z in range(x, y):
                        if t.hi[z] - t.lo[z] == len(text) and self.data[t.lo[z] : t.hi[z]] == text:
                            spans[r].append((begin - int(w.first[r]), end + 1 - int(w.first[r])))
                            items[r].update(self.ids[q] for q in t.of[t.at[z] : t.at[z + 1]])
                at = at + np.maximum(move, 1)
                go = at < stop
                at, stop, row = at[go], stop[go], row[go]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    patterns: Patterns = held.value
    for batch in batches:
        n, starts, ends, ids = [], [], [], []
        for w in words(batch["text"], ALNUM, True):
            spans, found = patterns.search(w, w.hashes())
            n.append(np.diff(w.first))
            for s, x in zip(spans, found, strict=True):
                s = merged(s)
                starts.append([a for a, _ in s])
                ends.append([b for _, b in s])
                ids.append(sorted(x))
        yield pa.RecordBatch.from_arrays(
            [batch["rid"], batch["doc_id"], pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))],
            names=["rid", "doc_id", "n_words", "starts", "ends", "items"],
        )


def item_blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The stated set of items, in blocks of about `most` bytes: what the driver holds and a broadcast carries is bounded."""
    block, used = [], 0
    for x in benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        block.append((x["id"], x["text"]))
        used += len(x["text"])
        if used >= most:
            yield block
            block, used = [], 0
    if block:
        yield block


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, spans (first word, word after) and item_ids, sorted as strings."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    searched = lambda b: rows.mapInArrow(partial(scan, held=docs.sparkSession.sparkContext.broadcast(Patterns(b, size))), HITS)
    blocks = item_blocks(benchmark, block_bytes)
    found, block = searched(next(blocks, [])), next(blocks, None)
    if block is not None:
        # Rows meet by document only; hits of each block are bounded by the document itself.
        found = stored(found, "hits")
        while block is not None:
            found = found.unionByName(stored(searched(block), "hits"))
            block = next(blocks, None)
        found = found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = F.sort_array(F.arrays_zip("starts", "ends"))
    hit = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s.n + F.greatest(x.ends - F.greatest(x.starts, s.to), F.lit(0))).alias("n"), F.greatest(s.to, x.ends).alias("to")), lambda s: s.n)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), spans.alias("spans"), F.col("items").alias("item_ids"))


def clean(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """The rows without an occurrence, as they are."""
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for w in words(batch["text"], ALNUM, True):
            spans, _ = held.value.search(w, w.hashes())
            keep[w.lo : w.hi] = [not s for s in spans]
        yield batch.filter(pa.array(keep, pa.bool_()))


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the rows that hold an occurrence; each block of items is one pass that passes on what it leaves."""
    small_batches(docs.sparkSession)
    out = docs
    for block in item_blocks(benchmark, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Patterns(block, size))
        out = out.mapInArrow(partial(clean, held=held), docs.schema)
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op8_benchmark_decontamination": op8}
ORACLES = {
    "op8_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT m FROM p),
t AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, k WHERE len(w) >= m)),
h AS (SELECT doc_id, m, i, item_id FROM t JOIN p USING (m, g)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
}
