"""Queries of the layered context graph. Warping has no SQL; tests hold plain loops over a small graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.dialect import graph, query
from orbweave.functions.shared import release, removed, written
from orbweave.operators.graph_blocks import placed
from orbweave.operators.layered import gamma, kept_gaps, layer_gaps, layered_walks, rings, weights
from orbweave.operators.skipgram import skip_gram
from orbweave.plans.similarity import candidates

G = graph()
SEED = 7
_tables: dict[tuple[str, str, str], DataFrame] = {}
_vectors: dict[tuple[str, str], str] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = written(make(), spark, f"kept-{name}")
    return _tables[key]


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact degree sequences of layers of up to two hops of all nodes."""

    def make() -> DataFrame:
        path = placed(spark, query(f"{G} SELECT u, v, deg AS w FROM adj JOIN n ON n.id = v")(spark, sf_dir))
        return rings(spark, path, query(f"{G} SELECT id FROM n")(spark, sf_dir))

    return _kept(spark, sf_dir, "rings", make)


def gaps(spark: SparkSession, sf_dir: str, both: bool = False) -> DataFrame:
    """Layers of up to two hops of all candidate pairs."""
    return layer_gaps(spark, candidates(spark, sf_dir), sequences(spark, sf_dir), both)


def layer_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(_kept(spark, sf_dir, "gaps", lambda: gaps(spark, sf_dir).select("x", "y", "d", "f")))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "layered")
    if key not in _tables:
        path = kept_gaps(spark, candidates(spark, sf_dir), sequences(spark, sf_dir))
        release(spark)
        _kept(spark, sf_dir, "layered", lambda: layered_walks(spark, path))
        removed(spark, path)
    return _tables[key]


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir, both=True).select("d", "u", "v", F.round(F.exp(-F.col("f")) / F.col("total"), 6).alias("p"))


def vectors_path(spark: SparkSession, sf_dir: str) -> str:
    """The folder of skip-gram vectors with hierarchical softmax over the layered walks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vectors:
        _vectors[key] = skip_gram(spark, walks(spark, sf_dir), size=16, window=5, seed=SEED)
    return _vectors[key]


def walk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(vectors_path(spark, sf_dir))


QUERIES = {
    "m11_layer_distances": lambda spark, sf_dir: gaps(spark, sf_dir).select("x", "y", "d", F.round("c", 6).alias("c")),
    "m13_cumulative_distance": lambda spark, sf_dir: gaps(spark, sf_dir).select("x", "y", "d", F.round("f", 6).alias("f")),
    "m14_layer_weights": normalised,
    "m15_layer_gamma": lambda spark, sf_dir: gamma(layer_weights(spark, sf_dir)),
    "w05_layered_walks": walks,
    "e05_walk_vectors": walk_vectors,
}
ORACLES: dict[str, str] = {}
