"""Reranking of result lists (query_id, doc_id, score): keyword, semantic, hybrid, pair overlap, and pipelines of rerankers.

results come with `query_text` and `text` (and for the semantic side `query_vector` and `vector`): the texts of a result
list are few, so they ride along and every reranker is one pass over the list's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import column, words
from ..functions.vectors import cosine
from .ranking import rounded, top_k

Reranker = Callable[[DataFrame], DataFrame]


def _bm25(query_text: Column, text: Column, average: Column, k1: float, b: float) -> Column:
    """Terms of the query with their repeats, frequencies in the document, no idf."""
    doc = words(F.lower(text))
    part = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size(doc) / average))
    tf = lambda t: F.size(F.filter(doc, lambda w: w == t)).cast("double")
    return F.aggregate(F.transform(F.filter(words(F.lower(query_text)), lambda t: F.array_contains(doc, t)), lambda t: part(tf(t))), F.lit(0.0), lambda acc, x: acc + x)


def finalized(df: DataFrame, k: int, threshold: float) -> DataFrame:
    return top_k(df.drop("rank"), k, min_score=threshold)


def keyword(results: DataFrame, k: int = 10, threshold: float = 0.0, k1: float = 1.2, b: float = 0.75, corrected: bool = False) -> DataFrame:
    """score = half the old score and half min(BM25, 1). The mean document length of a query's list is in bytes, a document's
    own in words, as in the engine whose results are matched; corrected=True takes words for both. Null texts count as empty."""
    r = results.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("query_text", F.coalesce("query_text", F.lit("")))
    size = F.size(words("text")) if corrected else F.octet_length("text")
    average = F.avg(size.cast("double")).over(W.partitionBy("query_id"))
    score = _bm25(F.col("query_text"), F.col("text"), F.greatest(F.col("_average"), F.lit(1e-9)), k1, b)
    out = r.withColumn("_average", average).withColumn("score", rounded(0.5 * F.col("score") + 0.5 * F.least(score, F.lit(1.0)))).drop("_average")
    return finalized(out, k, threshold)


def semantic(results: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """score = half the old score and half the cosine of query_vector and vector; without either vector the cosine is 0."""
    score = F.coalesce(cosine("query_vector", "vector"), F.lit(0.0))
    return finalized(results.withColumn("score", rounded(0.5 * F.col("score") + 0.5 * score)), k, threshold)


def hybrid(results: DataFrame, k: int = 10, threshold: float = 0.0, keyword_weight: float = 0.3, **options) -> DataFrame:
    """Both of the above, each with its own cut; a document that the keyword side cut away has 0 there."""
    kw = keyword(results, k, threshold, **options).select("query_id", "doc_id", F.col("score").alias("_keyword"))
    out = semantic(results, k, threshold).join(kw, ["query_id", "doc_id"], "left")
    score = keyword_weight * F.coalesce("_keyword", F.lit(0.0)) + (1 - keyword_weight) * F.col("score")
    return finalized(out.withColumn("score", rounded(score, 9)).drop("_keyword"), k, threshold)


def pair_score(query_text: Column | str, text: Column | str, base: float = 0.5) -> Column:
    """base + overlap (1 - base), the overlap being the Jaccard similarity of the lower-case word sets (0 for two empty texts)."""
    a, b = F.array_distinct(words(F.lower(query_text))), F.array_distinct(words(F.lower(text)))
    union = F.size(F.array_union(a, b))
    return base + F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0)) * (1 - base)


def pair_bm25(query_text: Column | str, text: Column | str, average: float = 100.0, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 of a single pair, for documents of so many words on average. Null texts count as empty."""
    return _bm25(F.coalesce(column(query_text), F.lit("")), F.coalesce(column(text), F.lit("")), F.lit(average), k1, b)


def scaled(results: DataFrame, factor: float, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """A reranker that multiplies scores."""
    return finalized(results.withColumn("score", rounded(F.col("score") * factor)), k, threshold)


def weighted(results: DataFrame, rerankers: list[tuple[Reranker, float]], k: int = 10, threshold: float = 0.0) -> DataFrame:
    """Weighted mean of the rerankers' scores. A document that a reranker drops gets nothing from it, and its other scores
    keep their own weights (the engine whose results are matched shifts them to the weights before)."""
    if not rerankers:
        return results
    total = sum(w for _, w in rerankers)
    share = [w / total if total > 0 else 1 / len(rerankers) for _, w in rerankers]
    parts = None
    for (f, _), w in zip(rerankers, share):
        part = f(results).select("query_id", "doc_id", (F.col("score") * w).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    summed = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("_sum"))
    out = results.join(summed, ["query_id", "doc_id"], "left").withColumn("score", rounded(F.coalesce("_sum", F.lit(0.0)), 9)).drop("_sum")
    return finalized(out, k, threshold)


def cascade(results: DataFrame, rerankers: list[Reranker], k: int = 10, threshold: float = 0.0, keep: int = 20) -> DataFrame:
    """One reranker after the other, each given the best `keep` of the list before it."""
    for f in rerankers:
        results = f(top_k(results.drop("rank"), keep))
    return finalized(results, k, threshold)


def reciprocal(results: DataFrame, rerankers: list[Reranker], k: int = 10, threshold: float = 0.0, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank + 1) over the rerankers; a document that none returns keeps its old score."""
    if not rerankers:
        return results
    parts = None
    for f in rerankers:
        part = f(results).select("query_id", "doc_id", (1 / (constant + F.col("rank") + 1)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    summed = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("_sum"))
    out = results.join(summed, ["query_id", "doc_id"], "left").withColumn("score", rounded(F.coalesce("_sum", "score"), 9)).drop("_sum")
    return finalized(out, k, threshold)
