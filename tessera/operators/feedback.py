"""Relevance feedback: scores adjusted by past judgments, and term models of judged documents.

Judgments are (query_id, document_id, relevant, rating, ts); ages count in whole days up to an explicit `as_of`. A null
`relevant` is no judgment and is left out; a null rating counts 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import ALNUM, words
from ..functions.vectors import clamp
from .ranking import rounded


def decay(ts: Column | str, as_of: str, factor: float = 0.95) -> Column:
    """factor to the power of the age in whole days, future judgments having age 0."""
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / F.lit(86_400_000_000))
    return F.pow(F.lit(factor), F.greatest(F.lit(0), days).cast("double"))


def document_signals(judgments: DataFrame, as_of: str, positive_weight: float = 1.0, negative_weight: float = 0.5, factor: float = 0.95) -> DataFrame:
    """document_id, signal, positive, negative, n: decayed sums; rows of a popular document are summed before the shuffle."""
    d = decay("ts", as_of, factor) * F.coalesce(F.col("rating").cast("double"), F.lit(1.0))
    j = judgments.filter(F.col("relevant").isNotNull() & F.col("document_id").isNotNull())
    plus, minus = F.when(F.col("relevant"), d).otherwise(F.lit(0.0)), F.when(~F.col("relevant"), d).otherwise(F.lit(0.0))
    sums = j.groupBy("document_id").agg(F.sum(plus).alias("positive"), F.sum(minus).alias("negative"), F.count("*").alias("n"))
    return sums.select("document_id", (F.col("positive") * positive_weight - F.col("negative") * negative_weight).alias("signal"), "positive", "negative", "n")


def sufficient(judgments: DataFrame, least: int = 3) -> bool:
    """Whether the whole feedback (not that of one document) has at least `least` judgments."""
    return judgments.filter("relevant is not null").limit(least).count() >= least


def _reranked(results: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")) - 1
    return results.withColumn("rank", place)


def rocchio(results: DataFrame, judgments: DataFrame, as_of: str, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15, least: int = 3, **weights) -> DataFrame:
    """results with score = clamp(alpha score + (beta or gamma) signal) where a document has a signal (beta for a positive
    one), ranked again. With fewer than `least` judgments in all nothing changes."""
    if not sufficient(judgments, least):
        return results
    s = document_signals(judgments, as_of, **weights).select(F.col("document_id").alias("doc_id"), "signal")
    score = F.when(F.col("signal").isNull(), F.col("score")).otherwise(clamp(alpha * F.col("score") + F.when(F.col("signal") > 0, beta).otherwise(gamma) * F.col("signal")))
    return _reranked(results.join(s, "doc_id", "left").withColumn("score", rounded(score)).drop("signal"))


def boost(results: DataFrame, judgments: DataFrame, as_of: str, positive_boost: float = 0.2, negative_penalty: float = 0.1, positive_weight: float = 1.0, negative_weight: float = 0.5, least: int = 3, factor: float = 0.95) -> DataFrame:
    """results with score = clamp(score + positive 0.2 w+ - negative 0.1 w-), ranked again."""
    if not sufficient(judgments, least):
        return results
    s = document_signals(judgments, as_of, factor=factor).select(F.col("document_id").alias("doc_id"), "positive", "negative")
    moved = clamp(F.col("score") + F.col("positive") * positive_boost * positive_weight - F.col("negative") * negative_penalty * negative_weight)
    return _reranked(results.join(s, "doc_id", "left").withColumn("score", rounded(F.coalesce(moved, F.col("score")))).drop("positive", "negative"))


def model_terms(text: Column | str) -> Column:
    """Lower-case words of more than two bytes, then of their letters and digits only; empty ones dropped."""
    long = F.filter(F.transform(words(text), F.lower), lambda w: F.octet_length(w) > 2)
    return F.filter(F.transform(long, lambda w: F.regexp_replace(w, f"[^{ALNUM}]+", "")), lambda w: w != "")


def relevance_model(judged: DataFrame, beta: float = 0.75, gamma: float = 0.15) -> DataFrame:
    """term, weight: beta for each occurrence in a relevant document of (text, relevant), minus gamma for each in another;
    positive weights only."""
    ts = judged.filter("relevant is not null").select("relevant", F.explode(model_terms("text")).alias("term"))
    weights = ts.groupBy("term").agg(F.count_if(F.col("relevant")).alias("p"), F.count_if(~F.col("relevant")).alias("q"))
    return weights.select("term", rounded(F.col("p") * beta - F.col("q") * gamma).alias("weight")).filter("weight > 0")


def boost_model(judged: DataFrame) -> DataFrame:
    """term, weight 1: terms of relevant documents that no other document has."""
    ts = judged.filter("relevant is not null").select("relevant", F.explode(F.array_distinct(model_terms("text"))).alias("term"))
    return ts.groupBy("term").agg(F.bool_and("relevant").alias("only")).filter("only").select("term", F.lit(1.0).alias("weight"))


def top_terms(model: DataFrame, k: int = 10) -> DataFrame:
    return model.orderBy(F.col("weight").desc(), "term").limit(k)
