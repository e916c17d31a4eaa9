"""Hidden states: pooling, layer similarity and selection, and reuse of cached states by text prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import column
from ..functions.vectors import cosine, doubles, total
from .ranking import first_rows


def pool(states: Column | str, how: str = "mean") -> Column:
    """One vector of a sequence of vectors: mean, max or cls (the first). An empty sequence gives null."""
    s = column(states)
    place = F.sequence(F.lit(0), F.size(s[0]) - 1)
    match how:
        case "mean":
            value = F.transform(place, lambda i: total(F.transform(s, lambda v: F.get(v, i))) / F.size(s))
        case "max":
            value = F.transform(place, lambda i: F.array_max(F.transform(s, lambda v: F.get(v, i).cast("double"))))
        case "cls":
            value = doubles(s[0])
        case _:
            raise ValueError(f"unknown pooling {how!r}")
    return F.when(F.size(s) > 0, value)


def layer_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """left_id, right_id, layer, similarity for frames (id, layer, vec) joined on the pair of ids given in a as `other`."""
    x = a.select(F.col("id").alias("left_id"), F.col("other").alias("right_id"), "layer", F.col("vec").alias("v"))
    y = b.select(F.col("id").alias("right_id"), "layer", F.col("vec").alias("w"))
    return x.join(y, ["right_id", "layer"]).select("left_id", "right_id", "layer", cosine("v", "w").alias("similarity"))


def average_similarity(layers: DataFrame, weights: Column | None = None) -> DataFrame:
    """left_id, right_id, similarity: the (weighted) mean over layers."""
    w = F.lit(1.0) if weights is None else weights
    return layers.groupBy("left_id", "right_id").agg((F.sum(F.col("similarity") * w) / F.sum(w)).alias("similarity"))


def divergences(layers: DataFrame, threshold: float = 0.5, most: int = 5) -> DataFrame:
    """id, layer, similarity, place: layers whose best similarity with any context is below the threshold; the lowest `most`."""
    best = layers.groupBy(F.col("left_id").alias("id"), "layer").agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") < threshold)
    return first_rows(best, ["id"], ["similarity", "layer"], most, "place")


def verdict(similarity: Column, diverges: Column) -> tuple[Column, Column]:
    """(decision, confidence) from the greatest similarity with the contexts (null: there are none) and whether layers diverge."""
    decision = F.when(similarity.isNull(), "accept").when(similarity >= 0.7, F.when(diverges, "revise").otherwise("accept")).when(similarity >= 0.35, "revise").otherwise("reject")
    confidence = F.when(similarity.isNull(), 1.0).when((similarity >= 0.7) & diverges, similarity * 0.9).otherwise(similarity)
    return decision, confidence


def layers(states: DataFrame, how: str, n: int, count: int) -> DataFrame:
    """Rows of a frame with a `layer` column: the last n, every n-th, or the middle n of `count` layers."""
    keep = {"last": F.col("layer") >= count - n, "every": F.col("layer") % n == 0, "middle": F.col("layer").between(max(0, (count - n) // 2), max(0, (count - n) // 2) + n - 1)}[how]
    return states.filter(keep)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Characters up to the first difference, by halving: equal prefixes are compared as strings, never character by character."""
    a, b = column(a), column(b)
    start = F.struct(F.lit(0).alias("low"), F.least(F.length(a), F.length(b)).alias("high"))

    def halve(acc, _):
        middle = F.ceil((acc["low"] + acc["high"]) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(acc["low"]).alias("low"), F.when(same, acc["high"]).otherwise(middle - 1).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, lambda acc, i: F.when(acc["low"] < acc["high"], halve(acc, i)).otherwise(acc))["low"]


def reuse(new: Column | str, cached: Column | str, length: Column, least: int = 10) -> tuple[Column, Column]:
    """(tokens that can be reused, quality) of a cached text's states (a token is four characters): one text must begin with
    the other and share `least` characters. Quality is 0.7 of the new text's share and 0.3 of the cached one's, in bytes."""
    a, b = column(new), column(cached)
    p = common_prefix(a, b)
    tokens = F.ceil(F.least(p, F.octet_length(b)) / 4).cast("int")
    can = (p >= least) & (F.startswith(a, b) | F.startswith(b, a)) & (length >= tokens)
    quality = 0.7 * p / F.greatest(F.octet_length(a), F.lit(1)) + 0.3 * p / F.greatest(F.octet_length(b), F.lit(1))
    return F.when(can, F.least(tokens, length)).otherwise(F.lit(0)), F.when(can, F.least(F.lit(1.0), quality)).otherwise(F.lit(0.0))


def _tokens(characters: Column) -> Column:
    return F.ceil(characters / 4).cast("int")


def length_reuse(new: Column | str, cached: Column | str, length: Column, most_ratio: float = 2.0, least_overlap: float = 0.3) -> tuple[Column, Column]:
    """(tokens, quality) of texts of about one length, in bytes, that begin alike: 0.4 of the likeness in length, 0.6 of the common beginning's
    share of the shorter."""
    a, b = F.greatest(F.octet_length(column(new)), F.lit(1)), F.greatest(F.octet_length(column(cached)), F.lit(1))
    p = common_prefix(new, cached)
    overlap = p / F.least(a, b)
    can = (F.greatest(a / b, b / a) <= most_ratio) & (overlap >= least_overlap)
    quality = F.least(F.lit(1.0), (1 - F.abs(a - b) / F.greatest(a, b)) * 0.4 + overlap * 0.6)
    return F.when(can, F.least(_tokens(p), length)).otherwise(F.lit(0)), F.when(can, quality).otherwise(F.lit(0.0))


def semantic_reuse(norm: Column, length: Column, threshold: float = 0.85) -> tuple[Column, Column]:
    """(tokens, quality) by the pooled state alone: all tokens, with the threshold as quality if its norm is between 0.1 and 10, 0.8 of it
    otherwise; nothing without a pooled state (null norm)."""
    quality = F.when((norm > 0.1) & (norm < 10), F.lit(threshold)).otherwise(F.lit(threshold * 0.8))
    return F.when(norm.isNotNull(), length).otherwise(F.lit(0)), F.when(norm.isNotNull(), quality).otherwise(F.lit(0.0))


def hybrid_reuse(parts: list[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """(tokens, quality) of weighted strategies (tokens, quality, weight): of those that can reuse anything the tokens of the heaviest (the
    most of equal ones) and the weighted mean of the qualities."""
    best = F.greatest(*[F.when(q > 0, F.struct(F.lit(w).alias("w"), t.cast("int").alias("t"))) for t, q, w in parts])
    weight = sum((F.when(q > 0, w).otherwise(0.0) for _, q, w in parts), F.lit(0.0))
    quality = sum((F.when(q > 0, q * w).otherwise(0.0) for _, q, w in parts), F.lit(0.0))
    return F.coalesce(best["t"], F.lit(0)), F.when(weight > 0, quality / weight).otherwise(F.lit(0.0))


def adaptive_reuse(new: Column | str, cached: Column | str, by_prefix: tuple, by_length: tuple, by_meaning: tuple) -> tuple[Column, Column]:
    """The prefix strategy if over half of the shorter text (in bytes) is common, else that of lengths if none is twice the other, else that of meaning."""
    a, b = F.octet_length(column(new)), F.octet_length(column(cached))
    shorter, ratio = F.least(a, b), F.greatest(a, F.lit(1)) / F.greatest(b, F.lit(1))
    begin = (shorter > 0) & (common_prefix(new, cached) / F.greatest(shorter, F.lit(1)) > 0.5)
    return tuple(F.when(begin, x).when(ratio.between(0.5, 2.0), y).otherwise(z) for x, y, z in zip(by_prefix, by_length, by_meaning))


def sliced(matrix: Column | str, dimension: int, start: int, end: int) -> Column:
    """Rows (dimension 0) or columns (1) start to end - 1 of a matrix (array of arrays); null where it has no such range."""
    m = column(matrix)
    size = F.size(m) if dimension == 0 else F.size(m[0])
    cut = F.slice(m, start + 1, end - start) if dimension == 0 else F.transform(m, lambda r: F.slice(r, start + 1, end - start))
    return F.when(F.lit(start < end) & (size >= end), cut)


def concatenated(a: Column | str, b: Column | str, dimension: int) -> Column:
    """Two matrices, one below (dimension 0) or beside (1) the other; null where the other dimension differs."""
    x, y = column(a), column(b)
    if dimension == 0:
        return F.when(F.size(x[0]) == F.size(y[0]), F.concat(x, y))
    return F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda r, s: F.concat(r, s)))
