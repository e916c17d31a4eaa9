"""Ranking within queries: ties always go to the smaller key, ranks count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows up to which a query-side table may be broadcast.
SMALL = 200_000


def top_k(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", score: str = "score", min_score: float | None = None) -> DataFrame:
    """The k best rows of each query (partly cut down before the shuffle), with their rank. Null scores are dropped."""
    scored = scored.filter(F.col(score).isNotNull() & (F.col(score) >= min_score if min_score is not None else F.lit(True)))
    return first_rows(scored, [query], [F.col(score).desc(), doc], k, "rank")


def first_rows(df: DataFrame, by: list[str], order: list, k: int, to: str) -> DataFrame:
    """The first k rows of each group, with their place from 0 in the column `to`. The condition is on row_number() itself, as
    only then Spark cuts groups down before the shuffle."""
    cut = df.withColumn(to, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(to) <= k)
    return cut.withColumn(to, F.col(to) - 1)


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, marked for broadcast if a count shows at most `rows` rows; else Spark joins by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)
