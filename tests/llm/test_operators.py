"""The llm operators against brute force, on rows with nulls, empty and long texts, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, jaccard_join, language_id, mixing, quality_classifier, quality_rules, shards, token_file, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = [f"w{i}" for i in range(200)]


def texts():
    long = " ".join(f"x{i % 977}" for i in range(30_000))
    out = [(1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join([*BASE[:195], "a", "b", "c"])), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One TWO"), (9, long), (10, long + " end")]
    out += [(20 + i, " ".join(BASE[: 100 + 5 * i])) for i in range(12)] + [(40, "é ß 日本 word, the\nthe\nthe\n#* the"), (None, "no id at all here now"), (50, " ".join(["dup"] * 80))]
    return out


SCHEMA = "doc_id long, text string, source string, lang string, rid long, turn int, size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", None, 1, 2, 3) for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_components(docs, k, num, den):
    rows = texts()
    sets = [shingles(t, k) for _, t in rows]
    part = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            part = [part[a] if p == part[b] else p for p in part]
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        want.append((d, len(sets[i]), min(ids) if ids else None))
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs, k, num, den).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_buckets_and_blocks_split(docs, monkeypatch):
    """Small bounds, so that buckets and clusters are cut into blocks, change nothing."""
    want = sorted(map(str, jaccard_join.jaccard_components(docs, 4, 85, 100).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "ELEMENTS", 300)
    assert sorted(map(str, jaccard_join.jaccard_components(docs, 4, 85, 100).collect())) == want
    monkeypatch.setattr(jaccard_join.buckets, "__defaults__", (2,))
    assert sorted(map(str, jaccard_join.jaccard_components(docs, 4, 85, 100).collect())) == want


def test_blocks_of_linked_and_apart_sets(spark, monkeypatch):
    """A chain, a dense group and loose sets, all in one weak cluster of many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = random.Random(9)
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 60 - rng.randrange(4)], f"own{i}"])) for i in range(25)]
    rows += [(100 + i, " ".join(f"d{j}" for j in range(4 * i, 4 * i + 60))) for i in range(14)]
    rows += [(200 + i, " ".join([*base[: 44 - i], *(f"e{i}{j}" for j in range(9))])) for i in range(8)]
    sets = {d: shingles(t, 3) for d, t in rows}
    part = {d: d for d in sets}
    for a, b in combinations(sets, 2):
        if 4 * len(sets[a] | sets[b]) <= 5 * len(sets[a] & sets[b]):
            old, new = max(part[a], part[b]), min(part[a], part[b])
            part = {d: new if p == old else p for d, p in part.items()}
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 4, 5).collect()
    assert {r.doc_id: r.component_id for r in got} == part and len(set(part.values())) > 5


def test_join_of_an_empty_table(none):
    assert jaccard_join.jaccard_components(none).count() == 0 and jaccard_join.first_of_each(none).count() == 0


def test_first_of_each_keeps_columns(docs):
    out = jaccard_join.first_of_each(docs.union(docs.where("doc_id = 40")), 4, 85, 100)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and ids.count(40) == 1 and 1 in ids and 2 not in ids and 4 in ids and None in ids


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for d, t in texts():
        w = WORD.findall(t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + j for i, g in enumerate(grams) if g in often for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == want
        assert got[d].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def shares_of(sizes, weights=(5, 2, 1)):
    """Targets by filling up, source after source; sizes is {source: tokens}, None last."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    w, left, out = {s: weights[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    while len(out) < len(order):
        open_ = [s for s in order if s not in out]
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * level > 2 * sizes[s]]
        for s in full or open_:
            out[s] = 2 * sizes[s] if full else w[s] * level
            left -= out[s]
    return {s: out[s] for s in order}


def slow_mix(rows, slots, gold=mixing.GOLD):
    """Tokens taken of each (doc_id, text, source), slot by slot along the points, token by token of the streams."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = {}
    for (_, _, s), n in zip(rows, sizes, strict=True):
        by[s] = by.get(s, 0) + n
    target = shares_of(by)
    total, upto, ends = sum(target.values()), 0.0, []
    for s, x in target.items():
        upto += x
        ends.append((s, round(upto / total * mixing.UNIT)))
    import hashlib

    stream = {s: [i for _, i in sorted((int(hashlib.md5(f"mix:{rows[i][0]}".encode()).hexdigest()[:15], 16), i) for i in range(len(rows)) if rows[i][2] == s) for _ in range(sizes[i])] for s in by}
    wide, used, taken, rank = total / slots, dict.fromkeys(by, 0), [0] * len(rows), dict.fromkeys(by, 0)
    for i in range(slots):
        s = next(s for s, e in ends if i * gold % mixing.UNIT < e and target[s] > 0)
        rank[s] += 1
        for _ in range(min(int(rank[s] * wide + 0.001), 2 * by[s]) - used[s]):
            taken[stream[s][used[s] % by[s]]] += 1
            used[s] += 1
    for s in by:
        if not rank[s] and target[s] > 0:
            for k in range(round(target[s])):
                taken[stream[s][k % by[s]]] += 1
    return target, taken


def test_mixing(spark, docs, none):
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in texts() if i is not None] + [(99, "lone word here", "tiny")]
    table = spark.createDataFrame([(i, t, s, None, 1, 2, 3) for i, t, s in rows], SCHEMA).repartition(3)
    for least, gold in ((500, mixing.GOLD), (46368, mixing.GOLD), (500, 4_000_000)):
        got = {r.doc_id: r for r in mixing.mixed(table, least=least, block=1 << 20, gold=gold).collect()}
        target, taken = slow_mix(rows, least, gold)
        assert [got[i].taken for i, _, _ in rows] == taken
        assert all(got[i].target == pytest.approx(target[s]) for i, _, s in rows)
    used = {s: sum(got[i].size for i, _, x in rows if x == s) for s in target}
    close = mixing.mixed(table, block=1 << 20, least=20_000).collect()
    for s in used:
        assert abs(sum(r.taken for r in close if r.source == s) - target[s]) <= 5 * sum(target.values()) / 20_000 + 2
    assert all(r.taken <= 2 * r.size for r in close) and mixing.mixed(none).count() == 0
    again = docs.union(docs)
    out = mixing.mixed(again).collect()
    assert len(out) == 2 * len(texts()) and all(r.taken <= 2 * r.size for r in out)


def test_hot_buckets_are_split(spark, monkeypatch):
    table = spark.createDataFrame([(7, f"a b c {i}", "s") for i in range(60)] + [(i, "x y", "t") for i in range(30)], "doc_id long, text string, source string").repartition(3)
    monkeypatch.setattr(mixing, "BUCKET", 2)
    out = mixing.mixed(table).collect()
    assert len(out) == 90 and all(r.taken <= 2 * r.size for r in out)
    for s in "st":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3


def test_mixture_follows_the_schedule(spark, docs):
    docs = docs.where("doc_id IS NOT NULL")
    out = mixing.mixture(docs, least=500, block=1 << 20)
    got = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns
    _, spans, _ = mixing.mixed_spans(docs, F.col("doc_id"), least=500, block=1 << 20)
    first = {}
    for r in spans.collect():
        first[r.rid, r.turn] = min(first.get((r.rid, r.turn), 1 << 40), r.slot)
    assert Counter(got) == Counter(k[0] for k in first)
    slots = sorted((s, k[0]) for k, s in first.items())
    at = {}
    for s, d in slots:
        at.setdefault(s, set()).add(d)
    pos = 0
    for s in sorted(at):
        n = sum(x == s for x, _ in slots)
        assert set(got[pos : pos + n]) == at[s]
        pos += n
    per = Counter()
    for r in spans.collect():
        per[r.sid, r["rank"]] += r.end - r.begin
    for s in {k[0] for k in per}:
        sizes = [n for (a, k), n in per.items() if a == s and k < max(k for x, k in per if x == s)]
        assert not sizes or max(sizes) - min(sizes) <= 1


ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items):
    """Words, hit words and items of a text, window by window; items are (id, text)."""
    grams = {}
    for i, t in items:
        w = ALNUM_WORD.findall((t or "").lower())
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m and i is not None else 0):
            grams.setdefault(tuple(w[k : k + m]), set()).add(i)
    w, hit, ids = ALNUM_WORD.findall((text or "").lower()), set(), set()
    for m in {len(g) for g in grams}:
        for k in range(len(w) - m + 1):
            if own := grams.get(tuple(w[k : k + m])):
                hit |= set(range(k, k + m))
                ids |= own
    return len(w), len(hit), sorted(ids)


def test_decontamination(spark, docs, none):
    items = [("a", " ".join(BASE[10:24])), ("b", "TWO"), ("c", None), ("d", ""), ("a", "one, two"), (None, "w1"), ("e", " ".join(BASE[12:40])), ("f", " ".join(f"x{i}" for i in range(900, 977)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (4 << 20, 1):
        got = {r.doc_id: r for r in decontaminate.contaminated_spans(docs, bench, block_bytes=size).collect()}
        assert {d: (r.n_words, r.n_hit, list(r.item_ids)) for d, r in got.items()} == {d: hits(t, items) for d, t in texts()}
    assert decontaminate.contaminated_spans(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contaminated_spans(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.contaminated_spans(docs.union(docs), bench).count() == 2 * len(texts())


def test_patterns_of_random_items_are_found():
    rng = random.Random(5)
    pool = [rng.choice("abc") * rng.randint(1, 3) for _ in range(6)]
    items = [(str(i), " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows = [" ".join(rng.choice(pool) for _ in range(700)) for _ in range(20)]
    import pyarrow as pa

    patterns = decontaminate.Patterns(items, 10)
    for w in decontaminate.words(pa.array(rows), decontaminate.ALNUM, True):
        spans, found = patterns.search(w, w.hashes())
        for r, s, x in zip(range(w.lo, w.hi), spans, found, strict=True):
            hit = {i for a, b in s for i in range(a, b)}
            assert (700, len(hit), sorted(x)) == hits(rows[r], items)


SPECIAL = "<|endoftext|>"


def test_token_files(spark, docs, none):
    public = pytest.importorskip("public_tokenizers")
    import numpy as np
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    more = [(60, f"{SPECIAL}alpha beta"), (61, f"alpha {SPECIAL} beta"), (62, f"alpha beta{SPECIAL}"), (63, SPECIAL), (64, "a <|endof text|> b\n\nc  d \n e"), (9, "again"), (9, None), (9, "more"), (65, "two\u00a0 kinds\u2003of \u2003blank\n x")]
    extra = spark.createDataFrame([(i, t, None, None, 1, 2, 3) for i, t in more], SCHEMA).repartition(2)
    rows = sorted(texts() + more, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    got = sorted(token_file.tokens_read(token_file.tokens_written(docs.union(extra), path)).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(path), 0
    for r, (d, t) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_file.tokens_read(token_file.tokens_written(none, path)).count() == 0


def digests(manifest, key):
    """Hash of the bytes of every file of a manifest, by its place."""
    return {key(r): zlib.crc32(open(r.path.removeprefix("file://").removeprefix("file:"), "rb").read()) for r in manifest.collect()}


def test_files_are_the_same_under_any_partitioning(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(shards.boundaries, "__defaults__", (4000, 1 << 16))
    path = public.path("byte_bpe_50k.json")
    rows = [(i % 700, f"text {i} " + "w " * (i % 90)) for i in range(900)] + [(None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (digests(token_file.tokens_written(docs.repartition(n), path), lambda r: r.shard) for n in (2, 7))
    assert one == two and len(one) > 10
    pages = docs.selectExpr("doc_id AS page_id", "concat('http://', doc_id) AS url", "repeat(text, 5 + doc_id % 9) AS html")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    one = digests(warc.warc_written(pages.repartition(3), roll=2000), lambda r: (r.shard, r.seq))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    two = digests(warc.warc_written(pages.repartition(5), roll=2000), lambda r: (r.shard, r.seq))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == two and len(one) > 20


def test_boundaries(spark):
    rng = random.Random(2)
    rows = [(rng.choice([5, 5, 5, rng.randrange(-50, 50)]), rng.randrange(0, 90)) for _ in range(500)] + [(None, 3)]
    got = shards.boundaries(spark.createDataFrame(rows, "key long, n long").repartition(4), 700)
    per = Counter()
    for k, n in rows:
        if k is not None:
            per[k] += n
    total, want = 0, {}
    for k in sorted(per):
        want.setdefault(total // 700, k)
        total += per[k]
    assert got == sorted(want.values())[1:] and shards.boundaries(spark.createDataFrame([], "key long, n long")) == []


def test_one_document_is_read_alone(docs):
    public = pytest.importorskip("public_tokenizers")
    files = token_file.tokens_written(docs, public.path("byte_bpe_50k.json")).collect()
    r = token_file.Reader(files[0].path)
    assert sum(len(r.ids(k)) for k in range(len(r.index))) == files[0].n_ids


def test_warc(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/", big), (2, "http://b/ \r\n", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", "é"), (3, None, big), (7, "http://l/", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1, 2, "y", 0) for r in rows], "page_id long, url string, html string, digest string, kind int, main long, shard string, n_bytes int")
    got = warc.warc_read(warc.warc_written(pages, roll=500)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (1, "revisit", 3), (2, "revisit", 3), (3, "response", 0), (3, "revisit", 3), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "response", 0)]
    assert {r.payload_bytes for r in got if r.page_id == 2} == {2003} and {r.payload_bytes for r in got if r.page_id == 7} == {1_000_000}
    assert warc.warc_read(warc.warc_written(pages.limit(0))).count() == 0


def test_classifiers_without_labels(spark, docs, none):
    m = language_id.learnt(docs)
    assert {r.lang_pred for r in language_id.identified(docs, m).collect()} == {"und"}
    q = quality_classifier.fit(docs, docs.selectExpr("doc_id", "size AS quality").limit(0), "quality")
    assert {r.score for r in quality_classifier.scored(docs, q).collect()} == {0.5} and quality_classifier.scored(none, q).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in language_id.op10(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.98 * len(got)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality_classifier.op2(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.9 * len(got)


def test_stages_decide_by_row(spark):
    a, b, c, d = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    rows = [(1, a, "1"), (None, a, "n-a"), (None, b, "n-b"), (None, b, "n-b2"), (2, c, "2-c"), (2, a, "2-a"), (3, d, "3-d"), (3, d, "3-d2"), (4, b[::-1], "4-b"), (4, c[::-1], "4-c"), (5, [], "5"), (None, [], "n"), (None, [], "n2")]
    docs = spark.createDataFrame([(i, " ".join(t), None, s) for i, t, s in rows], "doc_id long, text string, lang string, source string").repartition(3)
    got = [r.source for r in jaccard_join.first_of_each(docs).collect()]
    kept = sorted(s for s in got if s[:3] not in ("n-b", "3-d"))
    assert kept == ["1", "2-c", "4-b", "4-c", "5", "n", "n2"] and len(got) == 9 and {s[:3] for s in got} >= {"n-b", "3-d"}
    items = spark.createDataFrame([("x", " ".join(a[5:20]))], "item_id string, text string")
    for size in (4 << 20, 1):
        assert sorted(r.source for r in decontaminate.decontaminated(docs, items.union(items.limit(0)).union(spark.createDataFrame([("y", "nowhere at all")], items.schema)), block_bytes=size).collect()) == sorted(s for _, t, s in rows if t != a)
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(rows)
    docs = docs.unionByName(spark.createDataFrame([(i, " ".join(t), "en", f"l{i}") for i, t in enumerate((a, b, c, d), 100)], docs.schema)).drop("lang").withColumn("lang", F.when(F.col("doc_id") >= 100, "en"))
    out = language_id.known_language(docs)
    assert out.columns == docs.columns and sorted(r.source for r in out.collect()) == sorted([s for _, t, s in rows if t] + ["l100", "l101", "l102", "l103"])


def test_urls(spark):
    entries = spark.sql("SELECT * FROM VALUES ('a.org', 'block', timestamp '2024-01-01'), ('a.org', 'allow', timestamp '2024-03-01'), ('x.a.org/p/', 'block', timestamp '2024-02-01'), (null, 'block', timestamp '2024-01-01') AS t(pattern, action, since)")
    pages = spark.sql("SELECT * FROM VALUES (1, 'http://x.a.org/q', timestamp '2024-02-10'), (2, 'http://x.a.org/q', timestamp '2024-03-01'), (3, 'https://X.A.org:80/p/z', timestamp '2024-05-01'), (4, null, timestamp '2024-05-01'), (5, 'http://a.org', null), (6, 'http://ba.org/', timestamp '2024-02-10'), (7, 'http://a.org', timestamp '2023-12-31') AS t(page_id, url, fetched)")
    assert {r.page_id: r.verdict for r in url_filter.filtered(pages, entries).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def test_exact_edges_hold_little(spark):
    """Two full blocks: the same links as set by set, while what is held stays below 100 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    sets = []
    for i in range(2048):
        new = {rng.getrandbits(64) for _ in range(1000 if i % 7 or not sets else 10)}
        sets.append(np.array(sorted(new if i % 7 or not sets else new | set(sets[-1].tolist()[rng.randrange(300) :])), np.uint64))
    side = np.arange(2048, dtype=np.int32) % 2
    zero = np.zeros(2048, np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (zero, zero, zero, side, np.arange(2048))] + [pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "b1", "b2", "side", "rep", "elements"])
    tracemalloc.start()
    (out,) = jaccard_join.exact_edges(iter([rows]), 4, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {frozenset(x) for x in zip(*(out[c].to_pylist() for c in "ab"), strict=True)}
    both = [(i - 1, i, len(np.intersect1d(sets[i - 1], sets[i], assume_unique=True))) for i in range(7, 2048, 7)]
    assert got == {frozenset((i, j)) for i, j, c in both if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c)} and len(got) > 50
    assert most < 100e6
