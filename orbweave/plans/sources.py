"""Round trips through the text formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import graph, oracle, query
from orbweave.functions.shared import shared_dir
from orbweave.sources import graph_files as files

EDGES = f"{graph()} SELECT src, dst FROM e"
LINES = f"{graph()} SELECT u, @list(cast(v AS VARCHAR(20)))@ AS vs FROM adj GROUP BY u"


def _edges(spark: SparkSession, sf_dir: str) -> str:
    path = shared_dir(spark, "edges")
    files.write_edges(query(EDGES)(spark, sf_dir), path)
    return path


def _text(lines: DataFrame, name: str) -> str:
    path = shared_dir(lines.sparkSession, name)
    lines.write.text(path)
    return path


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = query(LINES)(spark, sf_dir).select(F.concat_ws(" ", "u", F.translate("vs", "_", " ")))
    return files.adjacency_list(spark, _text(lines, "adjacency"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ids from a nation's key to ten times it, as `cat first last`."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat_ws(" ", "n_regionkey", "n_nationkey", F.col("n_nationkey") * 10))
    return files.categories(spark, _text(n, "categories"))


def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("\t", "user_id", "event_id", F.lit("1.5"), F.unix_timestamp("ts")))
    return files.temporal_edges(spark, _text(e, "temporal"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings through the CSV format and its reader with the fallback name; a row for each id."""
    folder = shared_dir(spark, "emb")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    dim = v.agg(F.max(F.size("x"))).head()[0] or 0
    files.write_vectors(v, f"{folder}/vectors.emb", dim)
    return files.embedding(spark, folder, "vectors", dim).select("id", F.size("x").cast("bigint").alias("dim"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 3).alias("total"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat_ws(" ", "vec_id", "label", F.col("label") + 100))
    return files.labels(spark, _text(v, "labels"))


def separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges through a file whose name says that commas separate."""
    path = shared_dir(spark, "edges") + ".csv"
    files.write_edges(query(EDGES)(spark, sf_dir), path, files.separator(path))
    return files.edge_list(spark, path)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by regions: the line of a region holds, by column, the difference of keys."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey")
    cells = r.crossJoin(r.select(F.col("r_regionkey").alias("c")))  # five regions
    lines = cells.groupBy("r_regionkey").agg(F.sort_array(F.collect_list(F.struct("c", ((F.col("r_regionkey") - F.col("c")) * 0.5).alias("s")))).alias("x"))
    lines = lines.orderBy("r_regionkey").coalesce(1).select(F.array_join(F.transform("x", lambda z: z["s"].cast("double").cast("string")), ","))
    return files.similarity_matrix(spark, _text(lines, "matrix"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "w2v")
    v = _embeddings(spark, sf_dir)
    files.write_word2vec(v, path, v.agg(F.max(F.size("x"))).head()[0] or 0)
    return files.vectors(spark, path).select("id", F.size("x").cast("bigint").alias("dim"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 3).alias("total"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of counts appended to one sink."""
    path = shared_dir(spark, "metrics")
    counts = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    for k in (1, 2):
        files.append_metrics(counts.select(F.lit(k).alias("round"), "event_type", (F.col("n") * k).alias("n")), path)
    return spark.read.parquet(path)


def gephi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and labelled nodes through the two CSV folders: an edge with the labels of its ends."""
    folder = shared_dir(spark, "gephi")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("label"))
    files.write_gephi(query(EDGES)(spark, sf_dir), part, folder)
    e = spark.read.option("header", True).schema("Source BIGINT, Target BIGINT").csv(f"{folder}/edges")
    n = spark.read.option("header", True).schema("Id BIGINT, Label INT").csv(f"{folder}/nodes")
    e = e.join(n.select(F.col("Id").alias("Source"), F.col("Label").alias("a")), "Source").join(n.select(F.col("Id").alias("Target"), F.col("Label").alias("b")), "Target")
    return e.select(F.col("Source").alias("src"), F.col("Target").alias("dst"), F.col("a").alias("src_label"), F.col("b").alias("dst_label"))


def centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "scores")
    files.write_scores(query(f"{graph()} SELECT id, deg / 8.0 AS score FROM n")(spark, sf_dir), path)
    return files.scores(spark, path)


def tu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes of the graph of their nation, in lines of ascending key; each node with the graph it is in."""
    folder = shared_dir(spark, "tu")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").coalesce(1)
    s.select(F.col("s_nationkey").cast("string")).write.text(f"{folder}/S_graph_indicator.txt")
    s.select(F.concat_ws(", ", "s_suppkey", F.col("s_suppkey") + 1)).write.text(f"{folder}/S_A.txt")
    edges, nodes = files.tu_graphs(spark, folder, "S")
    return nodes.join(edges, nodes.id == edges.src, "left").select("id", "graph", "dst")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s01_edge_list": lambda spark, sf_dir: files.edge_list(spark, _edges(spark, sf_dir)),
    "s02_edge_list_nodes": lambda spark, sf_dir: files.nodes_of(spark, _edges(spark, sf_dir)),
    "s03_shifted_edge_list": lambda spark, sf_dir: files.edge_list(spark, _edges(spark, sf_dir), shift=1),
    "s04_adjacency_list": adjacency,
    "s07_temporal_edges": temporal,
    "s08_categories": categories,
    "s12_labels": labelled,
    "s14_embedding_files": vectors,
    "s05_from_matrix": lambda spark, sf_dir: files.from_matrix(matrix(spark, sf_dir)),
    "s09_separator_by_name": separated,
    "s10_similarity_matrix": matrix,
    "s11_word2vec_files": word2vec,
    "s15_appended_metrics": metrics,
    "s16_gephi_tables": gephi,
    "s19_centrality_files": centralities,
    "s20_graph_collections": tu,
}
ORACLES = {
    "s01_edge_list": oracle(EDGES),
    "s02_edge_list_nodes": oracle(f"{graph()} SELECT id FROM n"),
    "s03_shifted_edge_list": oracle(f"{graph()} SELECT src + 1 AS src, dst + 1 AS dst FROM e"),
    "s04_adjacency_list": oracle(f"{graph()} SELECT u, v FROM adj"),
    "s07_temporal_edges": "SELECT user_id AS src, event_id AS dst, 1.5::DOUBLE AS weight, floor(epoch(ts))::BIGINT AS ts FROM events",
    "s08_categories": "SELECT n_regionkey::INTEGER AS cat, unnest(range(n_nationkey::BIGINT, n_nationkey::BIGINT * 10 + 1)) AS id FROM nation",
    "s12_labels": "SELECT vec_id AS id, unnest([label, label + 100])::INTEGER AS label FROM embeddings",
    "s14_embedding_files": "SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 3) AS total FROM embeddings",
    "s05_from_matrix": "SELECT a.r_regionkey::BIGINT AS u, b.r_regionkey::BIGINT AS v FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey",
    "s09_separator_by_name": oracle(EDGES),
    "s10_similarity_matrix": "SELECT a.r_regionkey::BIGINT AS i, b.r_regionkey::BIGINT AS j, ((a.r_regionkey - b.r_regionkey) * 0.5)::DOUBLE AS s FROM region a, region b",
    "s11_word2vec_files": "SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 3) AS total FROM embeddings",
    "s15_appended_metrics": "SELECT k::INTEGER AS round, event_type, (count(*) * k)::BIGINT AS n FROM events, (VALUES (1), (2)) t(k) GROUP BY k, event_type",
    "s16_gephi_tables": oracle(f"{graph()} SELECT src, dst, a.p_size::INTEGER AS src_label, b.p_size::INTEGER AS dst_label FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst"),
    "s19_centrality_files": oracle(f"{graph()} SELECT id, (deg / 8.0)::DOUBLE AS score FROM n"),
    "s20_graph_collections": "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_nationkey::BIGINT AS graph FROM supplier) SELECT id, graph, s_suppkey + 1 AS dst FROM s LEFT JOIN supplier ON s_suppkey = id",
}
