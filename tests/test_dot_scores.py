"""Links scored by inner products: the pairs without an edge that are taken, and their scores."""

import numpy as np
from pyspark.sql import functions as F

from orbweave.functions.dialect import query
from orbweave.operators.skipgram import inner_products, skip_gram
from orbweave.plans.embedding import SQL, first_by_hash

SF = "/root/testdata/sf0.001"


def test_first_by_hash_equals_sort(spark):
    no = query(SQL["w18_negative_edges"])(spark, SF).localCheckpoint()
    total = no.count()
    for k in (0, 1, total // 3, total, total + 5):
        want = no.orderBy(F.md5(F.concat_ws(":", "src", "dst")), "src", "dst").limit(k)
        assert sorted(first_by_hash(spark, no, k).collect()) == sorted(want.collect())


def test_inner_products_move_no_vectors(spark):
    walks = spark.createDataFrame([(x, 0, [x, (x * 7) % 300, (x + 1) % 300]) for x in range(300)], "walk BIGINT, turn INT, path ARRAY<BIGINT>")
    path = skip_gram(spark, walks)
    x = {r["id"]: np.array(r["x"]) for r in spark.read.parquet(path).collect()}
    # 900 has no vector, nor have all of its block.
    pairs = [(a, (a * a + 3) % 300, float(a % 2)) for a in range(0, 300, 3)] + [(5, 900, 1.0)]
    got = inner_products(spark, spark.createDataFrame(pairs, "src BIGINT, dst BIGINT, label DOUBLE"), path, block=64)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r["src"], r["dst"], r["label"]): r["dot"] for r in got.collect()}
    assert set(got) == {p for p in pairs if p[1] != 900} and all(abs(d - x[a] @ x[b]) < 1e-9 for (a, b, _), d in got.items())
