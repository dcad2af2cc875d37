"""Text formats of graphs, labels, similarities and embeddings. Readers declare their schema, so no pass infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators by file extension.
SEPARATORS = {".csv": ",", ".tsv": "\t"}


def separator(path: str) -> str:
    return next((s for end, s in SEPARATORS.items() if path.endswith(end)), " ")


def _tokens(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    line = F.regexp_replace("value", r"[\r\n]+$", "")
    cut = r"\s+" if (sep or separator(path)).isspace() else sep or separator(path)
    return spark.read.text(path).select(F.split(F.trim(line), cut).alias("t")).where(F.col("t")[0] != "")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(i, value): lines with their numbers from 0. Only an RDD numbers lines without bringing them to one task."""
    return spark.read.text(path).rdd.zipWithIndex().map(lambda p: (p[1], p[0].value)).toDF("i BIGINT, value STRING")


def edge_list(spark: SparkSession, path: str, sep: str | None = None, shift: int = 0, loops: bool = True) -> DataFrame:
    """(src, dst) of a headerless edge list; lines of other than numbers (a header, one node alone) give no edge."""
    t = _tokens(spark, path, sep)
    e = t.select(F.expr("try_cast(get(t, 0) AS BIGINT)").alias("src"), F.expr("try_cast(get(t, 1) AS BIGINT)").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    e = e.select((F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"))
    return e if loops else e.where("src <> dst")


def rejected_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(reason, n): how many lines of an edge list give no edge, as nodes alone or as malformed."""
    t = _tokens(spark, path, sep)
    first, second = F.expr("try_cast(get(t, 0) AS BIGINT)"), F.expr("try_cast(get(t, 1) AS BIGINT)")
    bad = t.where(first.isNull() | second.isNull())
    return bad.groupBy(F.when(first.isNotNull() & (F.size("t") == 1), "node alone").otherwise("malformed").alias("reason")).agg(F.count("*").alias("n"))


def from_neighbours(spark: SparkSession, neighbours: dict[int, list[int]], directed: bool = False) -> DataFrame:
    """adj(u, v) of a mapping held by the driver; both directions unless directed, each once."""
    pairs = {(a, b) for a, bs in neighbours.items() for b in bs}
    pairs |= set() if directed else {(b, a) for a, b in pairs}
    return spark.createDataFrame(sorted(pairs), "u BIGINT, v BIGINT")


def from_matrix(cells: DataFrame) -> DataFrame:
    """adj(u, v) of the cells (i, j, s) of a matrix that are not 0."""
    return cells.where("s <> 0").select(F.col("i").alias("u"), F.col("j").alias("v"))


def nodes_of(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Every node id of an edge list, those that stand alone on their line too."""
    return _tokens(spark, path, sep).select(F.explode("t").alias("x")).select(F.expr("try_cast(x AS BIGINT)").alias("id")).where("id IS NOT NULL").distinct()


def temporal_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight, ts) of a tab-separated file."""
    return spark.read.schema("src BIGINT, dst BIGINT, weight DOUBLE, ts BIGINT").option("sep", "\t").csv(path)


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of lines `u v1 v2 ...`; repeated neighbours count once."""
    return _tokens(spark, path).select(F.col("t")[0].cast("bigint").alias("u"), F.explode(F.expr("transform(array_distinct(slice(t, 2, greatest(size(t) - 1, 0))), v -> cast(v AS BIGINT))")).alias("v"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(cat, id) of lines `cat id` or `cat first last`."""
    t = _tokens(spark, path).select(F.col("t")[0].cast("int").alias("cat"), F.col("t")[1].cast("bigint").alias("a"), F.expr("cast(coalesce(get(t, 2), get(t, 1)) AS BIGINT)").alias("b"))
    return t.select("cat", F.explode(F.sequence("a", "b")).alias("id"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label), a row for each label of a line."""
    return _tokens(spark, path).select(F.col("t")[0].cast("bigint").alias("id"), F.explode(F.expr("transform(slice(t, 2, greatest(size(t) - 1, 0)), v -> cast(v AS INT))")).alias("label"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of the `n d` then `id v1 .. vd` format; the header is the line of two tokens that are whole numbers."""
    t = _tokens(spark, path, " ").where("NOT (size(t) = 2 AND t[0] RLIKE '^[0-9]+$' AND t[1] RLIKE '^[0-9]+$')")
    return t.select(F.col("t")[0].cast("bigint").alias("id"), F.expr("transform(slice(t, 2, size(t) - 1), v -> cast(v AS DOUBLE))").alias("x"))


def embedding(spark: SparkSession, folder: str, dataset: str, dim: int) -> DataFrame:
    """(id, x) of `{dataset}_{dim}.emb`, or of `{dataset}.emb` where that is missing."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f"{folder}/{dataset}_{dim}.emb", f"{folder}/{dataset}.emb"]
    path = next((n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n))), names[-1])
    wide = spark.read.option("header", True).csv(path)
    return wide.select(F.col("id").cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in wide.columns if c != "id"]).alias("x"))


def similarity_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(i, j, s) of a square text matrix; i is the line's number."""
    cells = _numbered(spark, path).select("i", F.posexplode(F.split(F.trim("value"), r"\s+" if sep.isspace() else sep)).alias("j", "s"))
    return cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("s").cast("double").alias("s"))


def tu_graphs(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the `_A.txt`, `_graph_indicator.txt` layout; a node's id is its line's number."""
    e = _tokens(spark, f"{folder}/{name}_A.txt", ",").select(F.trim(F.col("t")[0]).cast("bigint").alias("src"), F.trim(F.col("t")[1]).cast("bigint").alias("dst"))
    return e, _numbered(spark, f"{folder}/{name}_graph_indicator.txt").select((F.col("i") + 1).alias("id"), F.trim("value").cast("bigint").alias("graph"))


def write_edges(edges: DataFrame, path: str, sep: str = " ") -> None:
    edges.select(F.concat_ws(sep, "src", "dst").alias("value")).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str, dim: int) -> None:
    """CSV files `id,x_0,..`, in ascending id over the files of the folder."""
    vectors.select("id", *[F.col("x")[i].alias(f"x_{i}") for i in range(dim)]).orderBy("id").write.mode("overwrite").option("header", True).csv(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def write_gephi(edges: DataFrame, nodes: DataFrame, folder: str) -> None:
    """Two CSV folders: edges (Source, Target) and nodes (Id, Label)."""
    edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target")).write.mode("overwrite").option("header", True).csv(f"{folder}/edges")
    nodes.select(F.col("id").alias("Id"), F.col("label").alias("Label")).write.mode("overwrite").option("header", True).csv(f"{folder}/nodes")


def write_word2vec(vectors: DataFrame, path: str, dim: int) -> None:
    """Lines `id v1 .. vd` in ascending id after the line `n d`, over the files of the folder."""
    n = vectors.count()
    lines = vectors.select(F.col("id").alias("k"), F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.col("x").cast("array<string>"), " ")).alias("value"), F.lit(1).alias("o"))
    head = vectors.sparkSession.createDataFrame([(0, f"{n} {dim}", 0)], "k BIGINT, value STRING, o INT")
    head.unionByName(lines).orderBy("o", "k").select("value").write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Tab-separated `id score` of centralities, in ascending id."""
    scores.select("id", "score").orderBy("id").write.mode("overwrite").option("sep", "\t").csv(path)


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id BIGINT, score DOUBLE").option("sep", "\t").csv(path)
