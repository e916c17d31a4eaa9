"""The arithmetic of speculative decoding: which draft tokens a target model accepts, and what replaces the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import column
from ..functions.vectors import argmax
from .ranking import rounded


def accepted(target: Column, draft: Column, ratio: float = 0.8) -> Column:
    """Whether the target's probability of a token is at least the draft's, or at least `ratio` of it."""
    return (target >= draft) | ((draft > 0) & (target / draft >= ratio))


def correction(target: Column | str, draft: Column | str) -> Column:
    """The token with the greatest surplus of the target's over the draft's probabilities; that of the target if there is none."""
    t, d = column(target), column(draft)
    surplus = F.zip_with(t, d, lambda x, y: F.greatest(F.lit(0.0), x - y))
    return F.when(F.array_max(surplus) > 0, argmax(surplus)).otherwise(argmax(t))


def statistics(steps: DataFrame, hit: Column) -> DataFrame:
    """steps, accepted, rate and speedup = (accepted + corrected) / steps over rows that are draft tokens of a `step`; a step's
    first rejected token is corrected."""
    per = steps.groupBy("step").agg(F.count_if(hit).alias("a"), F.count("*").alias("n"))
    total = per.agg(F.count("*").alias("steps"), F.sum("a").alias("accepted"), F.sum("n").alias("n"), F.count_if(F.col("a") < F.col("n")).alias("c"))
    return total.select("steps", "accepted", rounded(F.col("accepted") / F.col("n")).alias("rate"), rounded((F.col("accepted") + F.col("c")) / F.col("steps")).alias("speedup"))
