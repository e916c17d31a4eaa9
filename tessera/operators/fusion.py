"""Fusion of a dense and a sparse result list per query: a full outer join, scored, ranked again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.vectors import EPSILON
from .ranking import rounded, top_k


def _joined(dense: DataFrame, sparse: DataFrame, column: str) -> DataFrame:
    a = dense.select("query_id", "doc_id", F.col("score").alias("dense"), F.col(column).alias("d"))
    b = sparse.select("query_id", "doc_id", F.col("score").alias("sparse"), F.col(column).alias("s"))
    return a.join(b, ["query_id", "doc_id"], "full")


def _ranked(df: DataFrame, k: int, min_score: float | None) -> DataFrame:
    return top_k(df, k, min_score=min_score).select("query_id", "doc_id", "dense_score", "sparse_score", "score", "rank")


def _min_max(df: DataFrame, normalize: bool) -> DataFrame:
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("n", F.when(F.abs(high - low) < EPSILON, F.lit(0.5)).otherwise((F.col("score") - low) / (high - low)) if normalize else F.col("score"))


def _z(df: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id")
    return df.withColumn("n", (F.col("score") - F.avg("score").over(w)) / F.greatest(F.stddev_pop("score").over(w), F.lit(EPSILON)))


def _weighted(a: DataFrame, b: DataFrame, dense_weight: float, sparse_weight: float, k: int, min_score: float | None) -> DataFrame:
    d, s = F.coalesce("d", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    out = _joined(a, b, "n").select("query_id", "doc_id", rounded(d).alias("dense_score"), rounded(s).alias("sparse_score"), rounded(dense_weight * d + sparse_weight * s).alias("score"))
    return _ranked(out, k, min_score)


def fuse_weighted(dense: DataFrame, sparse: DataFrame, dense_weight: float = 0.5, sparse_weight: float = 0.5, k: int = 10, normalize: bool = True, min_score: float | None = None) -> DataFrame:
    """query_id, doc_id, dense_score, sparse_score (each side between its least and greatest score of the query; 0.5 where
    those are equal), score, rank. A document that a side lacks has 0 there."""
    return _weighted(_min_max(dense, normalize), _min_max(sparse, normalize), dense_weight, sparse_weight, k, min_score)


def fuse_distribution(dense: DataFrame, sparse: DataFrame, dense_weight: float = 0.5, sparse_weight: float = 0.5, k: int = 10, min_score: float | None = None) -> DataFrame:
    """As fuse_weighted with z-scores (population deviation)."""
    return _weighted(_z(dense), _z(sparse), dense_weight, sparse_weight, k, min_score)


def fuse_rrf(dense: DataFrame, sparse: DataFrame, constant: int = 60, k: int = 10, min_score: float | None = None) -> DataFrame:
    """Reciprocal ranks: the sum of 1 / (constant + rank + 1) over the sides; dense_score and sparse_score are the raw ones."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")) - 1
    one = lambda df: df.withColumn("n", 1 / (constant + place + 1))
    d, s = F.coalesce("d", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    out = _joined(one(dense), one(sparse), "n").select("query_id", "doc_id", F.coalesce("dense", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse", F.lit(0.0)).alias("sparse_score"), rounded(d + s, 9).alias("score"))
    return _ranked(out, k, min_score)


def merged_score(vector_results: DataFrame, paths: DataFrame) -> DataFrame:
    """query_id, score: the mean of the best semantic score and the best path confidence; a side without rows counts 0."""
    a = vector_results.groupBy("query_id").agg(F.max("score").alias("a"))
    b = paths.groupBy("query_id").agg(F.max("confidence").alias("b"))
    return a.join(b, "query_id", "full").select("query_id", rounded((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / 2).alias("score"))
