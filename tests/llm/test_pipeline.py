"""The corpus pipeline against brute force, stage by stage, on a whole table."""

import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
import regex

from orbweave.llm import language_id
from tests.llm.test_operators import WORD, hits, shingles, slow_mix

SF = "/root/testdata/sf0.001"


def first_of_each(rows):
    """The least doc_id of every component of similar texts; texts without words stay."""
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in rows}
    part = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = max(part[a], part[b]), min(part[a], part[b])
            part = {d: new if p == old else p for d, p in part.items()}
    return [r for r in rows if part[r["doc_id"]] == r["doc_id"]]


def test_pipeline_equals_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    import numpy as np
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    def mixed(rows):
        _, taken = slow_mix([(r["doc_id"], r["text"], r["source"]) for r in rows], 46368)
        size = [len(WORD.findall(r["text"] or "")) for r in rows]
        return [r for r, n, s in zip(rows, taken, size, strict=True) if n for _ in range(-(-n // s))]

    def encoded(rows):
        tokenizer, at, out = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0, []
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            out.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        return out

    brute = {
        "language": lambda rows: [r for r in rows if regex.search(r"\p{L}", r["text"] or "")],
        "near_copies": first_of_each,
        "benchmark": lambda rows: [r for r in rows if not hits(r["text"], items)[1]],
        "mix": mixed,
        "tokens": encoded,
    }
    assert [n for n, _ in pipeline.STAGES] == list(brute)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = brute[name](rows)
        if name == "tokens":
            assert sorted(map(tuple, docs.collect())) == sorted(rows)
        else:
            assert docs.columns == columns
            assert Counter(map(str, docs.collect())) == Counter(str(r) for r in spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema).collect())


def test_language_decision_by_hand(spark):
    """Codewords, votes and the least loss of a text, in plain Python with the fitted weights."""
    import math

    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learnt(docs)
    got = {r.doc_id: r for r in language_id.identified(docs, model).collect()}
    for r in docs.collect()[:60]:
        if not regex.search(r"\p{L}", r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        raw = re.sub(rb"[ \t\n\x0b\x0c\r]", b" ", b" " + r.text.encode() + b" ")
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
        margin = np.array(model.bias, float)
        for g in grams:
            h = 0
            for b in g:
                h = (h * 257 + b) % 2**32
            margin += language_id.SCALE * model.weight[h * 2654435761 % 2**32 >> (32 - language_id.BITS)] / len(grams)
        loss = [sum(t * math.log1p(math.exp(-2 * m * c)) for t, m, c in zip(model.trust, margin, word, strict=True)) for word in model.code]
        near = [math.exp(min(loss) - x) for x in loss]
        assert got[r.doc_id].lang_pred == model.languages[loss.index(min(loss))]
        assert got[r.doc_id].score == pytest.approx(max(near) / sum(near), abs=1e-3)
    assert model.margins(pa.array(["", None])).shape == (2, len(model.bias))


def test_a_row_without_language_teaches_nothing(spark):
    rows = [(i, " ".join(["aa bb cc"] * 9), "xx") for i in range(1, 30)] + [(i, " ".join(["zz yy ww"] * 9), "yy") for i in range(31, 60)]
    schema = "doc_id long, text string, lang string"
    one = language_id.learnt(spark.createDataFrame(rows, schema))
    two = language_id.learnt(spark.createDataFrame(rows + [(i, "zz yy ww qq", None) for i in range(1, 30)], schema))
    assert (one.weight == two.weight).all() and (one.bias == two.bias).all()
    single = language_id.learnt(spark.createDataFrame(rows[:29], schema))
    assert {r.lang_pred for r in language_id.identified(spark.createDataFrame(rows, schema), single).collect()} == {"xx"}
