"""N-gram Jaccard join by universe partition and pigeonhole.

The shingle set of a document is sorted by hash and its universe cut into segments whose number depends on the size
band (powers of two). Two linked sets of sizes x and y differ in at most h = (1 - t) / t * min-side elements, so of any
segments whose weights sum to more than h one must agree: exactly (weight 1) or but for one element (weight 2, indexed
by one-deletion neighbourhoods). Each set indexes only its first segments, in universe order, whose non-empty weights
reach h + 1: the shorter of two such prefixes already holds an agreeing, non-empty segment. A cost model picks per band
how many segments use neighbourhoods. Sets with too few non-empty segments also index single elements (prefix filter).
Documents of equal segments meet in buckets; parity bitmaps give an exact lower bound of the difference and leave weak
clusters; inside these, blocks of sets are intersected exactly and give spanning edges, of which components are made.
Clusters of several blocks first link what meets within a block, then one set of each part so found; only sets outside
the largest part that is left then meet all blocks, so that a cluster of n near copies costs n sets and not n squared.

Cases: null text, empty text and text without words have no shingles and link with nothing; rows that repeat a text or
a doc_id are kept, equal texts share a component; a null doc_id counts only where a component has no other; other
columns are ignored. Hash equality of 64 bits stands for equality of shingles, and of 128 bits for that of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.bytetext import SPACED, U, mixed, windows, words
from orbweave.llm.common import fresh_dir, release, removed, small_batches, stored, stored_at, table, with_row_id
from orbweave.llm.components import connected_components

FEATURES = "rid long, doc_id long, n_shingles long, sh1 long, sh2 long, bits binary, sigs array<long>"
#: Members of a bucket, and sets of a cluster, that are compared in one block.
BUCKET, BLOCK = 2048, 1024
#: Elements of the sets of a block, about.
ELEMENTS = 1 << 20


def allocation(n_docs: int, num: int, den: int, shared: float = 0.01, verify: float = 0.5) -> dict[int, tuple[int, int]]:
    """Per size band: (segments, how many of the first use one-deletion neighbourhoods), of least expected cost.

    shared: chance that a shingle is also in an unrelated set; verify: cost of a false candidate in index rows.
    """
    out = {}
    for band in range(32):
        need = (den - num) * (2 * 2**band - 1) // num + 1
        best = None
        for k1 in sorted({0, need // 4, need // 2}):
            k0 = need - 2 * k1
            m = max(1, -(-(k0 + k1) * 23 // 20) + (need > 1))
            size = 1.5 * 2**band / m
            false = k0 * shared**size + k1 * (shared**size + size * shared ** max(size - 1, 0))
            cost = k0 + k1 * (1 + size) + verify * n_docs * false
            if best is None or cost < best[0]:
                best = (cost, m, k1)
        out[band] = best[1:]
    return out


def signatures(s: np.ndarray, plan: dict, num: int, den: int) -> np.ndarray:
    """Index keys of one sorted set."""
    n = len(s)
    h = (den - num) * n // num
    band = n.bit_length() - 1
    out, lone = [], False
    own = mixed(s, 11)
    for b in (band, band + 1):
        if b > band and n * den < num * 2**b:
            continue
        m, k1 = plan[b]
        seg = ((s >> U(32)) * U(m)) >> U(32)
        at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        size = np.diff(np.append(at, n))
        ids = seg[at].astype(np.int64)
        weight = 1 + ((ids < k1) & (size > 1))
        reach = np.cumsum(weight)
        k = int(np.searchsorted(reach, h + 1)) + 1
        lone |= k > len(ids)
        sums = np.add.reduceat(own, at)[:k]
        salt = (seg[at][:k] + U(b << 32)) * U(0xD1342543DE82EF95)
        out.append(mixed(sums + salt, 23))
        for j in np.flatnonzero(weight[:k] == 2):
            out.append(mixed(sums[j] - own[at[j] : at[j] + size[j]] + salt[j], 23))
    if lone:
        out.append(mixed(own[: h + 1], 37))
    return np.unique(np.concatenate(out))


def parity(s: np.ndarray) -> bytes:
    bits = 1 << min(max(len(s).bit_length(), 8), 17)
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of every row."""
    for w in words(column, SPACED, True):
        h = w.hashes()
        grams = windows(h, k)
        for r in range(w.hi - w.lo):
            a, b = w.first[r], w.first[r + 1]
            yield np.unique(grams[a : b - k + 1]) if b - a >= k else np.unique(windows(h[a:b], b - a)) if b > a else h[:0]


def two_sums(s: np.ndarray) -> tuple[int, int]:
    return (int(mixed(s, 101).sum().astype(np.int64)), int(mixed(s, 202).sum().astype(np.int64))) if len(s) else (0, 0)


def features(batches: Iterator[pa.RecordBatch], k: int, plan: dict, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys, bits, sigs, at = [], [], [], [], [0]
        for s in shingle_sets(batch["text"], k):
            n.append(len(s))
            keys.append(two_sums(s))
            bits.append(parity(s) if len(s) else None)
            if len(s):
                sigs.append(signatures(s, plan, num, den))
            at.append(at[-1] + (len(sigs[-1]) if len(s) else 0))
        flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
        keys = np.array(keys, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch["rid"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
            names=["rid", "doc_id", "n_shingles", "sh1", "sh2", "bits", "sigs"],
        )


def buckets(batches: Iterator[pa.RecordBatch], most: int = BUCKET) -> Iterator[pa.RecordBatch]:
    """Runs of two or more reps of one signature, from rows sorted by (sig, rep), as blocks of `most` at the most."""
    names = ["sig", "block", "members", "same", "same2"]

    def out(runs: list) -> pa.RecordBatch:
        lists = pa.array([r[2] for r in runs], pa.list_(pa.int64()))
        same = np.array([r[3] for r in runs], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int32()), lists, pa.array(same[:, 0]), pa.array(same[:, 1])], names=names)

    seen: set[tuple[int, int, int]] = set()
    sig_open, open_, block = None, np.zeros(0, np.int64), 0

    def close(final: bool, runs: list) -> None:
        """Emit the open run; a whole run equal to one emitted before is left out."""
        if len(open_) + (block > 0) < 2 or not len(open_):
            return
        same = two_sums(open_.view(U))
        if final and block == 0:
            if (*same, len(open_)) in seen:
                return
            if len(seen) < 1 << 20:
                seen.add((*same, len(open_)))
        runs.append((int(sig_open), block, open_, same))

    for batch in batches:
        sig, rep = batch["sig"].to_numpy(), batch["rep"].to_numpy()
        if not len(sig):
            continue
        at = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig))
        long = np.flatnonzero(np.diff(at) > 1)
        use = np.union1d(long, [0, len(at) - 2])
        runs: list = []
        for i in use:
            a, b = at[i], at[i + 1]
            if sig_open is None or sig[a] != sig_open:
                close(True, runs)
                sig_open, open_, block = sig[a], rep[a:b].copy(), 0
            else:
                open_ = np.concatenate([open_, rep[a:b]])
            while len(open_) > most:
                rest, open_ = open_[most:], open_[:most]
                close(False, runs)
                open_, block = rest, block + 1
        if runs:
            yield out(runs)
    runs = []
    close(True, runs)
    if runs:
        yield out(runs)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows of one key each, from sorted rows."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy() for k in key]
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if kept and now != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = now
    if kept:
        yield pa.Table.from_batches(kept)


class Forest:
    """Spanning edges among few members: an edge is kept when it joins two parts."""

    def __init__(self, n: int):
        self.part = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others:
            if self.part[i] != self.part[j]:
                self.part[self.part == self.part[j]] = self.part[i]
                self.edges.append((i, int(j)))


def ends(rep: np.ndarray, edges: list) -> pa.RecordBatch:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rep[e[:, 0]]), pa.array(rep[e[:, 1]])], names=["a", "b"])


def weak_edges(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Per bucket: a forest of the pairs whose parity bitmaps allow a link; side 1 is compared with side 0 and not itself."""
    for t in groups(batches, ["bid", "bid2"]):
        rep, side, n = t["rep"].to_numpy(), t["side"].to_numpy(), t["n"].to_numpy()
        raw = t["bits"].to_pylist()
        width = min(map(len, raw))
        rows = np.zeros((len(raw), width), np.uint8)
        for i, x in enumerate(raw):
            rows[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0)
        rows = rows.view(U)
        cross, forest = side.any(), Forest(len(rep))
        for i in range(len(rep) - 1):
            if cross and side[i]:
                break
            j = np.flatnonzero(side == 1) if cross else np.arange(i + 1, len(rep))
            j = j[forest.part[j] != forest.part[i]]
            if not len(j):
                continue
            least = np.minimum(n[j], n[i])
            apart = np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1, dtype=np.int64)
            fits = (apart * (num + den) <= (den - num) * (n[j] + n[i])) & (least * den >= num * np.maximum(n[j], n[i]))
            forest.link(i, j[fits])
        if forest.edges:
            yield ends(rep, forest.edges)


def repeated(elements: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of sets of 64-bit elements: their sizes, and for the elements that occur more than once (row, col), ascending by col, and the number of cols."""
    at = np.frombuffer(elements.buffers()[1], np.int32)[elements.offset : elements.offset + len(elements) + 1] // 8
    flat = np.frombuffer(elements.buffers()[2], U, at[-1])[at[0] :]
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    times = np.diff(np.append(np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])), len(flat)))
    often = times > 1
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[order][np.repeat(often, times)]
    return np.diff(at).astype(np.int64), row, np.repeat(np.arange(often.sum(), dtype=np.int32), times[often]), int(often.sum())


def exact_edges(batches: Iterator[pa.RecordBatch], num: int, den: int, cells: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Per (cid, b1, b2): a forest of links by exact intersection sizes, of side 0 with side 1, or within where all are 0.

    Elements that several sets have are columns of matrices of `cells` cells at the most, one of either side at a time.
    """
    for t in groups(batches, ["cid", "b1", "b2"]):
        rep, side = t["rep"].to_numpy(), t["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        if not len(left) or not len(right):
            continue
        size, row, col, total = repeated(t["elements"].combine_chunks())
        both = np.zeros((len(left), len(right)), np.float32)
        wide = max(1, cells // len(rep))
        place = np.zeros(len(rep), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        for lo in range(0, total, wide):
            a, b = np.searchsorted(col, [lo, lo + wide])
            r, c = row[a:b], col[a:b] - lo
            one = np.zeros((len(left), min(wide, total - lo)), np.float32)
            two = one if right is left else np.zeros((len(right), one.shape[1]), np.float32)
            for own, to in ((0, one), (1, two))[: 1 + (right is not left)]:
                some = side[r] == own
                to[place[r[some]], c[some]] = 1
            both += one @ two.T
        both = np.rint(both).astype(np.int64)
        linked = den * both >= num * (size[left][:, None] + size[right][None, :] - both)
        forest = Forest(len(rep))
        for i, x in enumerate(left):
            forest.link(int(x), right[linked[i]])
        if forest.edges:
            yield ends(rep, forest.edges)


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sets of the rows that are their class's representative; others of the same doc_id are left out."""
    for batch in batches:
        sh = batch["sh1"].to_numpy(), batch["sh2"].to_numpy()
        keep, elements = [], []
        for i, s in enumerate(shingle_sets(batch["text"], k)):
            if two_sums(s) == (sh[0][i], sh[1][i]):
                keep.append(i)
                elements.append(s.tobytes())
        own = batch.select(["cid", "nb", "block", "rep"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(elements, pa.binary())], names=[*own.schema.names, "elements"])


def blocks_of(sets: DataFrame) -> DataFrame:
    """sets(cid, rep, elements) with the blocks of their cluster, of about BLOCK sets and ELEMENTS elements: nb, block."""
    size = sets.groupBy("cid").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("elements")) / (8 * ELEMENTS))).cast("int").alias("nb"))
    return sets.select("cid", "rep", "elements").join(size, "cid").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))


def met(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges of rows(cid, b1, b2, side, rep, elements)."""
    rows = rows.select("cid", "b1", "b2", "side", "rep", "elements").repartition("cid", "b1", "b2").sortWithinPartitions("cid", "b1", "b2", "rep")
    return stored(rows.mapInArrow(partial(exact_edges, num=num, den=den), "a long, b long"), "links")


def across(sets: DataFrame, within: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between the blocks of clusters of several: sets(cid, nb, block, rep, elements), within: the edges inside blocks."""
    parts = connected_components(within.join(sets.select(F.col("rep").alias("a")), "a", "left_semi"))
    of = stored(sets.select("cid", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("cid", "rep", F.coalesce("label", "rep").alias("part")), "parts")
    # One set of each part meets all others, in pairs of blocks.
    heads = blocks_of(sets.join(of.where("part = rep").select("rep").hint("shuffle_hash"), "rep"))
    heads = heads.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"b1": F.least("block", "o"), "b2": F.greatest("block", "o")})
    second = met(heads.withColumn("side", (F.col("block") > F.col("b1")).cast("int")), num, den)
    joined = connected_components(second).select(F.col("node").alias("part"), "label")
    of = stored(of.join(joined, "part", "left").select("cid", "rep", F.coalesce("label", "part").alias("part")), "parts")
    # What is outside a cluster's largest part meets every block.
    most = of.groupBy("cid", "part").agg(F.count("*").alias("n")).groupBy("cid").agg(F.max_by("part", F.struct("n", "part")).alias("most"))
    apart = of.join(most, "cid").where("part <> most").select("rep")
    guests = blocks_of(sets.join(apart.hint("shuffle_hash"), "rep"))
    halls = guests.groupBy("cid").agg(F.max("nb").alias("halls"))
    hosts = sets.join(halls.hint("shuffle_hash"), "cid").withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("halls") - 1)))
    hosts = hosts.select("cid", F.col("block").alias("b1"), "b2", F.lit(0).alias("side"), "rep", "elements")
    of_cluster = sets.groupBy("cid").agg(F.max("nb").alias("all"))
    guests = guests.join(of_cluster, "cid").withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    guests = guests.select("cid", "b1", F.col("block").alias("b2"), F.lit(1).alias("side"), "rep", "elements")
    # A set that is host and guest in one meeting links with itself, which is no edge between rows.
    return second.union(met(hosts.union(guests), num, den)).where("a <> b")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id; linked: den * common >= num * united."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    plan = allocation(max(1, docs.count()), num, den)
    full = stored_at(rows.mapInArrow(partial(features, k=k, plan=plan, num=num, den=den), FEATURES), path := fresh_dir(spark, "features"))
    feat = stored(full.drop("sigs", "bits"), "rows")
    of_class = full.where("n_shingles > 0").groupBy("sh1", "sh2")
    reps = stored(of_class.agg(F.min("rid").alias("rep"), F.min_by("doc_id", "rid").alias("rep_doc"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits")), "classes")
    # Buckets of equal signatures; those of the same members once.
    index = of_class.agg(F.min("rid").alias("rep"), F.first("sigs").alias("sigs")).select("rep", F.explode("sigs").alias("sig")).repartition("sig").sortWithinPartitions("sig", "rep")
    found = stored(index.mapInArrow(buckets, "sig long, block int, members array<long>, same long, same2 long"), "buckets")
    removed(spark, path)
    del full, of_class, index
    release(spark)
    split = found.where("block > 0").select("sig").distinct().withColumn("split", F.lit(True))
    found = found.join(split, "sig", "left")
    single = found.where("split IS NULL").groupBy("same", "same2", F.size("members")).agg(F.first("members").alias("members"))
    single = single.select(F.col("same").alias("bid"), F.col("same2").alias("bid2"), F.lit(0).alias("side"), F.explode("members").alias("rep"))
    parts = found.where("split").select("sig", "block", "members")
    other = parts.select("sig", F.col("block").alias("block2"), F.col("members").alias("members2"))
    crossed = parts.join(other, "sig").where("block <= block2").withColumn("bid", F.xxhash64("sig", "block", "block2"))
    crossed = crossed.select("bid", F.col("sig").alias("bid2"), F.explode(F.when(F.expr("block = block2"), F.array(F.struct(F.lit(0).alias("side"), F.col("members")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("members")), F.struct(F.lit(1).alias("side"), F.col("members2").alias("members"))))).alias("x"))
    crossed = crossed.select("bid", "bid2", "x.side", F.explode("x.members").alias("rep"))
    tested = single.union(crossed).join(reps.select("rep", "n", "bits"), "rep").repartition("bid", "bid2").sortWithinPartitions("bid", "bid2", "side", "rep")
    weak = connected_components(tested.mapInArrow(partial(weak_edges, num=num, den=den), "a long, b long"))
    # Sets of each weak cluster, in blocks.
    size = weak.join(reps.select("rep", "n"), F.col("node") == F.col("rep")).groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).cast("int").alias("nb"))
    cluster = weak.join(size, "label").select(F.col("label").alias("cid"), F.col("node").alias("rep"), "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("block"))
    wanted = stored(cluster.join(reps.select("rep", "rep_doc", "sh1", "sh2"), "rep"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep_doc")))
    sets = texts.select("cid", "nb", "block", "rep", "sh1", "sh2", "text").mapInArrow(partial(sets_of, k=k), "cid long, nb int, block int, rep long, elements binary")
    sets = stored(sets, "sets")
    links = met(sets.select("cid", F.col("block").alias("b1"), F.col("block").alias("b2"), F.lit(0).alias("side"), "rep", "elements"), num, den)
    if not (several := sets.where("nb > 1")).isEmpty():
        links = links.union(across(several, links, num, den))
    label = connected_components(links)
    release(spark)
    # Back to rows, by class.
    named = reps.select("sh1", "sh2", "rep", "least").join(label, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "rep"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "comp").select("sh1", "sh2", "component_id")
    out = feat.select("doc_id", "n_shingles", "sh1", "sh2").join(classes, ["sh1", "sh2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The first row of each component by doc_id (null last) and row; rows without a shingle link with none and stay."""
    rows = with_row_id(docs, "_orb_row")
    found = stored(jaccard_components(rows.select(F.col("_orb_row").alias("doc_id"), "text"), k, num, den).select(F.col("doc_id").alias("_orb_row"), "n_shingles", "component_id"), "found")
    release(docs.sparkSession)
    linked = found.where("n_shingles > 0").join(rows.select("_orb_row", F.col("doc_id").cast("long").alias("_orb_doc")), "_orb_row")
    # A component is named by one of its rows; only rows of components of several can go.
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("_orb_doc").isNull(), "_orb_doc", "_orb_row")).alias("first"), F.count("*").alias("size")).where("size > 1").select("component_id", F.col("first._orb_row").alias("_orb_first"))
    gone = found.where("n_shingles > 0").join(first, "component_id").where("_orb_row <> _orb_first").select("_orb_row")
    return rows.join(gone.hint("shuffle_hash"), "_orb_row", "left_anti").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


QUERIES = {"op9_ngram_jaccard_join": op9}
#: The join has no short SQL; DuckDB can list the links of a small table pair by pair.
ORACLES = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 3], ' ') END AS g, len(words) < 4 AS short
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g, short) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.to_id = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.to_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2"""
}
