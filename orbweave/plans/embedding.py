"""Learners of embeddings and their supervised evaluation with the ML library. Their results have no SQL; tests hold properties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.dialect import graph, oracle, query, ranked
from orbweave.functions.shared import release, written
from orbweave.operators.factors import nonnegative_factors
from orbweave.operators.graph_blocks import placed
from orbweave.operators.profiles import profile_distances
from orbweave.operators.regression import explained
from orbweave.operators.skipgram import inner_products
from orbweave.plans.diffusion import HEAT
from orbweave.plans.features import BFS, QUERIES as FEATURES
from orbweave.plans.iterative import betweenness_of, cores, refex, refex_bins
from orbweave.plans.layered import vectors_path
from orbweave.plans.motifs import LABELS, ORB, ORBITS
from orbweave.plans.similarity import CAND, candidates
from orbweave.plans.walks import LONG, W5

G = graph()
SEED = 7


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL")
    return v.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), (F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(10)) < 7).alias("train"))


def _scores(predicted: DataFrame) -> DataFrame:
    """Accuracy (equal to micro F1) and macro F1 of (label, prediction), from their counts."""
    c = predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    ends = c.select(F.explode(F.array("label", "prediction")).alias("cls"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), "n")
    f1 = ends.groupBy("cls").agg((F.sum("tp") / F.sum("n")).alias("f1")).agg(F.round(F.avg("f1"), 4).alias("f1_macro"))
    return c.agg(F.round(hit / F.sum("n"), 4).alias("f1_micro"), F.sum("n").alias("n")).crossJoin(f1)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-versus-rest logistic regression with balanced classes on 70%, scored on the rest."""
    v = written(_vectors(spark, sf_dir), spark, "vectors")
    train = v.where("train")
    per = train.groupBy("label").agg(F.count("*").alias("c"))
    total = train.count()
    weighted = train.join(F.broadcast(per), "label").withColumn("weight", total / (F.col("c") * max(1, per.count())))
    model = OneVsRest(classifier=LogisticRegression(featuresCol="x", maxIter=50, regParam=0.01), featuresCol="x", weightCol="weight").fit(weighted)
    return _scores(model.transform(v.where("NOT train")).select("label", "prediction"))


def multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(_vectors(spark, sf_dir), spark, "vectors")
    model = LogisticRegression(featuresCol="x", maxIter=50, regParam=0.01, family="multinomial").fit(v.where("train"))
    return _scores(model.transform(v.where("NOT train")).select("label", "prediction"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, cluster) with as many clusters as labels."""
    v = written(_vectors(spark, sf_dir), spark, "vectors")
    k = int((v.agg(F.max("label")).head()[0] or 0) + 1)
    return KMeans(k=max(2, k), seed=SEED, featuresCol="x", predictionCol="cluster").fit(v).transform(v).select("id", "label", "cluster", "x")


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette by squared distances, which needs sums of clusters only and no pairs."""
    s = ClusteringEvaluator(featuresCol="x", predictionCol="cluster").evaluate(clustered(spark, sf_dir))
    return spark.createDataFrame([(round(s, 4),)], "silhouette DOUBLE")


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    y = PCA(k=2, inputCol="x", outputCol="y").fit(v).transform(v).select("id", "label", vector_to_array("y").alias("y"))
    return y.select("id", "label", F.round(F.col("y")[0], 4).alias("x0"), F.round(F.col("y")[1], 4).alias("x1"))


def factorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of nodes: non-negative factors of the quantised recursive features, by alternating least squares."""
    bins = refex_bins(spark, sf_dir)
    # One row per column name: as many as features were kept.
    cols = {c: 4 * i for i, c in enumerate(sorted(r["col"] for r in bins.select("col").distinct().collect()))}
    first = F.element_at(F.create_map(*[F.lit(x) for kv in cols.items() for x in kv]), F.col("col")) if cols else F.lit(0)
    hot = bins.select(F.col("id").cast("int").alias("id"), first.alias("first"), "bin", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    hot = written(hot.select("id", (F.col("first") + F.col("k")).alias("fid"), (F.col("k") == F.col("bin")).cast("double").alias("value")), spark, "one-hot")
    model = ALS(rank=4, maxIter=10, regParam=0.01, nonnegative=True, userCol="id", itemCol="fid", ratingCol="value", seed=SEED).fit(hot)
    return model.userFactors.select(F.col("id").cast("bigint").alias("id"), *[F.col("features")[i].cast("double").alias(f"role_{i}") for i in range(4)])


def repeated_scores(spark: SparkSession, sf_dir: str, repeats: int = 2) -> DataFrame:
    """Mean and sample deviation of the scores of multinomial regression for train shares of 10% to 90%, each drawn `repeats` times."""
    v = written(_vectors(spark, sf_dir).drop("train"), spark, "vectors")
    learner, out = LogisticRegression(featuresCol="x", maxIter=20, regParam=0.01, family="multinomial"), None
    for ratio in range(1, 10):
        for turn in range(repeats):
            split = v.withColumn("train", F.pmod(F.crc32(F.concat_ws(":", F.lit(turn), "id").cast("binary")), F.lit(1000)) < 100 * ratio)
            s = _scores(learner.fit(split.where("train")).transform(split.where("NOT train")).select("label", "prediction"))
            s = s.select(F.lit(ratio / 10).alias("ratio"), "f1_micro", "f1_macro")
            out = s if out is None else out.unionByName(s)
    stats = [f(c).alias(f"{c}_{n}") for c in ("f1_micro", "f1_macro") for n, f in (("mean", F.avg), ("deviation", F.stddev_samp))]
    return out.groupBy("ratio").agg(*[F.round(x, 4).alias(n) for x, n in zip(stats, ("f1_micro", "f1_micro_deviation", "f1_macro", "f1_macro_deviation"), strict=True)])


def cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of clusters and labels over the mean of their entropies."""
    t = written(clustered(spark, sf_dir).groupBy("label", "cluster").agg(F.count("*").alias("n")), spark, "contingency")
    total = F.lit(max(1, t.agg(F.sum("n")).head()[0] or 1)).cast("double")
    entropy = lambda c: t.groupBy(c).agg((F.sum("n") / total).alias("p")).agg((-F.sum(F.col("p") * F.log("p"))).alias(f"h_{c}"))
    of = lambda c: t.groupBy(c).agg((F.sum("n") / total).alias(f"p_{c}"))
    both = F.col("n") / total
    mi = t.join(of("label"), "label").join(of("cluster"), "cluster").agg(F.sum(both * F.log(both / (F.col("p_label") * F.col("p_cluster")))).alias("mi"))
    rows = mi.crossJoin(entropy("label")).crossJoin(entropy("cluster"))
    return rows.select(F.round(F.try_divide(2 * F.col("mi"), F.col("h_label") + F.col("h_cluster")), 6).alias("nmi"))


def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out edges against as many pairs without an edge, by logistic regression on pairs of node features; the
    features see only the edges that are kept. One row for each way to join two nodes: auc, precision average and f1."""
    held = written(query(SQL["w18_held_out_edges"])(spark, sf_dir), spark, "held")
    kept = held.where("held = 0").select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.*")
    deg = kept.groupBy("u").agg(F.count("*").alias("deg"))
    near = kept.join(deg.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.count("*").alias("deg"), F.sum("deg").alias("total"), F.avg("deg").alias("mean"), F.stddev_pop("deg").alias("spread"), F.max("deg").alias("most"), F.min("deg").alias("least"))
    feats = written(near.select("u", F.array(*[F.log1p(F.col(c).cast("double")) for c in near.columns[1:]]).alias("f")), spark, "node-features")
    yes = written(held.where("held = 1").select("src", "dst"), spark, "held-edges")
    no = query(SQL["w18_negative_edges"])(spark, sf_dir).orderBy(F.md5(F.concat_ws(":", "src", "dst")), "src", "dst").limit(yes.count())
    pairs = yes.withColumn("label", F.lit(1.0)).unionByName(no.withColumn("label", F.lit(0.0)))
    pairs = pairs.join(feats.select(F.col("u").alias("src"), F.col("f").alias("a")), "src").join(feats.select(F.col("u").alias("dst"), F.col("f").alias("b")), "dst")
    pairs = written(pairs.withColumn("train", F.pmod(F.crc32(F.concat_ws(":", "src", "dst").cast("binary")), F.lit(10)) < 7), spark, "pairs")
    out = None
    for name, joined in (("hadamard", F.zip_with("a", "b", lambda x, y: x * y)), ("average", F.zip_with("a", "b", lambda x, y: (x + y) / 2))):
        rows = pairs.withColumn("x", array_to_vector(joined))
        got = written(LogisticRegression(featuresCol="x", maxIter=50, regParam=0.01).fit(rows.where("train")).transform(rows.where("NOT train")).select("label", F.round(vector_to_array("probability")[1], 6).alias("p")), spark, "scored")
        s = ranking_scores(got).withColumn("features", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def ranking_scores(scored: DataFrame, times: str | None = None) -> DataFrame:
    """auc (ties count half), step-wise average precision, f1 and recall at 0.5 of (label 0 or 1, p rounded to 6 places); a row
    stands as often as the column `times` says.

    Windows run over counts of the values of p: at most 1,000 cells, and 1,001 values within a cell.
    """
    n = F.col(times) if times else F.lit(1)
    g = scored.groupBy(F.floor(F.col("p") * 1000).alias("cell"), "p").agg(F.sum(F.col("label") * n).alias("pos"), F.sum((1 - F.col("label")) * n).alias("neg"))
    cells = g.groupBy("cell").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("cp").over(above), F.lit(0.0)).alias("p0"), F.coalesce(F.sum("cn").over(above), F.lit(0.0)).alias("n0"))
    upto = Window.partitionBy("cell").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = g.withColumns({"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto)}).join(cells, "cell").withColumns({"tp": F.col("tp") + F.col("p0"), "fp": F.col("fp") + F.col("n0")})
    hit, wrong = F.sum(F.when(F.col("p") > 0.5, F.col("pos")).otherwise(0)), F.sum(F.when(F.col("p") > 0.5, F.col("neg")).otherwise(0))
    auc = 1 - F.try_divide(F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))
    ap = F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos"))
    return r.agg(F.round(auc, 6).alias("auc"), F.round(ap, 6).alias("average_precision"), F.round(F.try_divide(2 * hit, hit + wrong + F.sum("pos")), 6).alias("f1"), F.round(F.try_divide(hit, F.sum("pos")), 6).alias("recall"))


def first_by_hash(spark: SparkSession, rows: DataFrame, k: int) -> DataFrame:
    """The first k of rows(src, dst), written, in the order of (md5, src, dst): whole cells of hashes and a part of one, without a sort of all rows."""
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", "src", "dst").cast("binary"))).withColumn("_cell", F.substring("_h", 1, 4))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("c"))
    # At most 65,536 cells.
    below, cut = 0, None
    for cell, c in sorted(map(tuple, counts.collect())):
        if below + c > k:
            cut = cell
            break
        below += c
    if cut is None:
        return rows.select("src", "dst")
    some = rows.where(F.col("_cell") == cut).orderBy("_h", "src", "dst").limit(k - below)
    return rows.where(F.col("_cell") < cut).unionByName(some).select("src", "dst")


def dot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out edges against as many pairs without an edge by the inner products of walk vectors, as probabilities."""
    yes = written(query(SQL["w18_held_out_edges"])(spark, sf_dir).where("held = 1").select("src", "dst"), spark, "held-edges")
    release(spark)
    no = written(query(SQL["w18_negative_edges"])(spark, sf_dir), spark, "no-edges")
    release(spark)
    pairs = yes.withColumn("label", F.lit(1.0)).unionByName(first_by_hash(spark, no, yes.count()).withColumn("label", F.lit(0.0)))
    dots = inner_products(spark, pairs, vectors_path(spark, sf_dir))
    return ranking_scores(written(dots.select("label", F.round(1 / (1 + F.exp(-F.col("dot"))), 6).alias("p")).groupBy("label", "p").agg(F.count("*").alias("n")), spark, "scored"), "n")


def role_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph vectors of nodes: a skip-gram in which a node is next to the motif tokens of the nodes that its walk meets."""
    words = query(f"{G}, {W5}, {LONG}, {LABELS} SELECT array(concat('n', walk), concat('t', token)) AS words FROM pos JOIN lab ON lab.id = pos.node")(spark, sf_dir)
    model = Word2Vec(vectorSize=16, minCount=0, windowSize=1, maxIter=1, seed=SEED, inputCol="words").fit(written(words, spark, "node-words"))
    return model.getVectors().where("word LIKE 'n%'").select(F.substring("word", 2, 20).cast("bigint").alias("id"), vector_to_array("vector").alias("x"))


def nmf_roles(spark: SparkSession, sf_dir: str, rank: int = 4) -> DataFrame:
    """Weights of roles: non-negative factors of the recursive features, each column over its maximum."""
    rows, names = refex(spark, sf_dir)
    rows = written(rows, spark, "features")
    most = rows.agg(*[F.max(c).alias(c) for c in names]).head()
    f = F.array(*[F.coalesce(F.col(c).cast("double") / F.lit(float(most[c] or 1)), F.lit(0.0)) for c in names])
    w, _ = nonnegative_factors(spark, rows.select("id", f.alias("f")), len(names), rank)
    return w.select("id", *[F.round(F.col("w")[k], 4).alias(f"role_{k}") for k in range(rank)])


def roles_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the roles say of degree, clustering, core number and betweenness."""
    roles = written(nmf_roles(spark, sf_dir), spark, "roles")
    of = FEATURES["f02_egonet_features"](spark, sf_dir).select("id", "deg", "clustering")
    rows = roles.join(of, "id").join(cores(spark, sf_dir).select("id", "core"), "id").join(betweenness_of(spark, sf_dir), "id")
    out = explained(spark, rows, roles.columns[1:], ["deg", "clustering", "core", "betweenness"])
    return out.select("measure", "role", F.round("weight", 3).alias("weight"), F.round("relative", 3).alias("relative"))


def clustered_labels(spark: SparkSession, sf_dir: str, rank: int = 8, k: int = 50) -> DataFrame:
    """Labels of nodes: clusters of non-negative factors of the logarithms of their orbit counts."""
    orb = query(f"{G}, {ORB} SELECT * FROM orb")(spark, sf_dir)
    w, _ = nonnegative_factors(spark, written(orb.select("id", F.array(*[F.log1p(F.col(c).cast("double")) for c in ORBITS]).alias("f")), spark, "orbits"), len(ORBITS), rank)
    w = written(w.select("id", array_to_vector("w").alias("x")), spark, "weights")
    return KMeans(k=k, seed=SEED, featuresCol="x", predictionCol="label").fit(w).transform(w).select("id", "label")


def heat_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = placed(spark, query(f"{G} SELECT u, v, deg AS w FROM adj JOIN n ON n.id = v")(spark, sf_dir))
    return profile_distances(spark, path, candidates(spark, sf_dir)).select("x", "y", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("ks", "area")])


HOPS = f"{G}, {BFS}, hg AS (SELECT root, concat(d, ':', cast(floor(ln(deg) / ln(2)) AS BIGINT)) AS part, count(*) AS freq FROM hop JOIN n ON n.id = node WHERE d > 0 GROUP BY 1, 2), sk AS (SELECT root, b.id AS bit, sum(CASE WHEN @u(concat('hop:', b.id, ':', part))@ < 0.5 THEN -freq ELSE freq END) AS y FROM hg CROSS JOIN @range(16)@ b GROUP BY root, b.id)"
SQL = {
    "w18_negative_edges": f"{G}, nc AS (SELECT id, cast(floor(id / 4096.0) AS BIGINT) AS cell FROM n), {ranked('nc', 'cell', 'x.id')}, pr AS (SELECT cast(floor(@u(concat('na:', n.id, ':', k.id))@ * t.m) AS BIGINT) + 1 AS ra, cast(floor(@u(concat('nb:', n.id, ':', k.id))@ * t.m) AS BIGINT) + 1 AS rb FROM n CROSS JOIN @range(16)@ k CROSS JOIN (SELECT max(total) AS m FROM rk) t), ng AS (SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM pr JOIN rk a ON a.r = pr.ra JOIN rk b ON b.r = pr.rb WHERE a.id <> b.id) SELECT ng.src, ng.dst FROM ng LEFT JOIN e ON e.src = ng.src AND e.dst = ng.dst WHERE e.src IS NULL",
    "e08_hop_sketch": f"{HOPS} SELECT root AS id, cast(bit AS BIGINT) AS bit, (sign(y) + 1) / 2.0 AS value FROM sk",
    "n04_band_tables": f"{HOPS} SELECT cast(floor(bit / 4.0) AS BIGINT) AS band, cast(sum(CASE WHEN y > 0 THEN 1 ELSE 0 END * power(2, bit % 4)) AS BIGINT) AS bucket, root AS id FROM sk GROUP BY root, floor(bit / 4.0)",
    "h03_chebyshev_coefficients": "SELECT k, s, round(sum(2.0 / 30 * cos(k * y) * exp(-s * (cos(y) + 1))) * max(CASE WHEN k = 0 THEN 0.5 ELSE 1.0 END) + 1e-9, 6) + 0.0 AS c FROM (SELECT k.id AS k, s.id + 19 AS s, 3.141592653589793 * (j.id + 0.5) / 30 AS y FROM @range(31)@ k CROSS JOIN @range(2)@ s CROSS JOIN @range(30)@ j) x GROUP BY k, s",
    "m22_heat_profiles": f"{G}, {HEAT}, {CAND}, prof AS (SELECT j, row_number() OVER (PARTITION BY j ORDER BY round(x, 9) DESC, i) AS r, x FROM heat) SELECT cand.x, cand.y, round(max(abs(a.x - b.x)) + 1e-9, 5) AS ks, round(sum(abs(a.x - b.x)) + 1e-9, 5) AS area FROM cand JOIN prof a ON a.j = cand.x JOIN prof b ON b.j = cand.y AND b.r = a.r GROUP BY cand.x, cand.y",
    "w12_anonymous_dictionary": "SELECT 0 AS a0, 1 AS a1, b.id AS a2, c.id AS a3, d.id AS a4 FROM @range(3)@ b JOIN @range(4)@ c ON c.id <> b.id AND c.id <= greatest(1, b.id) + 1 JOIN @range(5)@ d ON d.id <> c.id AND d.id <= greatest(1, b.id, c.id) + 1 WHERE b.id <> 1",
    "w16_walk_triplets": f"{G}, {W5}, {LONG}, z AS (SELECT walk, node, count(*) AS c FROM pos WHERE k > 0 GROUP BY walk, node), r AS (SELECT walk, node, row_number() OVER (PARTITION BY walk ORDER BY c DESC, node) AS hi, row_number() OVER (PARTITION BY walk ORDER BY c, node DESC) AS lo FROM z) SELECT a.walk AS i, a.node AS near, b.node AS far FROM r a JOIN r b ON b.walk = a.walk AND a.hi = 1 AND b.lo = 1 WHERE a.node <> b.node",
    "w18_held_out_edges": f"{G}, h AS (SELECT u, v, md5(concat(least(u, v), ':', greatest(u, v))) AS h FROM adj), k AS (SELECT u, min(h) AS h FROM h GROUP BY u), f AS (SELECT e.src, e.dst, md5(concat(e.src, ':', e.dst)) AS h FROM e) SELECT f.src, f.dst, CASE WHEN f.h <> a.h AND f.h <> b.h AND @u(concat('held:', f.src, ':', f.dst))@ < 0.3 THEN 1 ELSE 0 END AS held FROM f JOIN k a ON a.u = f.src JOIN k b ON b.u = f.dst",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: query(v) for k, v in SQL.items()} | {
    "m22_heat_profiles": heat_profiles,
    "e01_role_factors": factorised,
    "v01_one_versus_rest": classified,
    "v13_multinomial": multinomial,
    "e02_nmf_roles": nmf_roles,
    "e07_role_vectors": role_vectors,
    "f11_clustered_labels": clustered_labels,
    "f26_roles_explained": roles_explained,
    "v01_repeated_scores": repeated_scores,
    "v02_cluster_agreement": cluster_agreement,
    "v03_link_prediction": link_scores,
    "v12_dot_scores": dot_scores,
    "v02_kmeans": lambda spark, sf_dir: clustered(spark, sf_dir).select("id", F.col("label").cast("int"), "cluster"),
    "v02_silhouette": silhouette,
    "v06_projection": projected,
}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
