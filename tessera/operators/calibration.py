"""Confidence calibration over (predicted, correct). Rows with a null in either are left out. Fits that need an ordered or
repeated pass first add the rows up in CELLS cells of the prediction, a summary of fixed size whatever the input."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import clamp
from .ranking import rounded

CELLS = 10_000


def clean(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("predicted").cast("double").alias("predicted"), "correct").filter("predicted is not null and correct is not null")


def cells(rows: DataFrame) -> np.ndarray:
    """[mean prediction, rows, correct rows, least prediction] by cell, in order: at most CELLS + 1 rows."""
    at = F.floor(clamp(F.col("predicted")) * CELLS)
    summed = clean(rows).groupBy(at.alias("cell")).agg(F.avg("predicted").alias("x"), F.count("*").alias("n"), F.count_if("correct").alias("k"), F.min("predicted").alias("first"))
    found = sorted((r["cell"], r["x"], r["n"], r["k"], r["first"]) for r in summed.collect())
    return np.array([r[1:] for r in found], np.float64).reshape(-1, 4)


def fit_platt(rows: DataFrame, rounds: int = 100, rate: float = 0.1) -> tuple[float, float]:
    """(a, b) of sigmoid(a x + b) after that many steps of gradient descent from (1, 0)."""
    c = cells(rows)
    if c[:, 1].sum() < 2:
        raise ValueError("calibration needs at least two rows")
    a, b, n = 1.0, 0.0, c[:, 1].sum()
    for _ in range(rounds):
        error = c[:, 1] / (1 + np.exp(-(a * c[:, 0] + b))) - c[:, 2]
        a, b = a - rate * (error * c[:, 0]).sum() / n, b - rate * error.sum() / n
    return float(a), float(b)


def fit_isotonic(rows: DataFrame) -> list[tuple[float, float]]:
    """(x, y) of the pooled blocks, x being a block's first prediction; rows of one cell are one block from the start."""
    blocks: list[list[float]] = []
    for _, n, k, x in cells(rows):
        blocks.append([x, k / n, n])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            _, y, m = blocks.pop()
            first = blocks[-1]
            first[1], first[2] = (first[1] * first[2] + y * m) / (first[2] + m), first[2] + m
    return [(x, y) for x, y, _ in blocks]


def histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, centre, n, value: the share of correct rows by bin [start, end), the centre for an empty bin; a prediction of
    exactly 1 is in no bin."""
    counted = clean(rows).filter("predicted >= 0 and predicted < 1").groupBy(F.floor(F.col("predicted") * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    centre = (F.col("bin") + 0.5) / bins
    return every.join(counted, "bin", "left").select("bin", rounded(centre).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), rounded(F.coalesce(F.col("k") / F.col("n"), centre)).alias("value"))


def by_platt(x: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a * clamp(x) + b)))


def by_temperature(x: Column, temperature: float) -> Column:
    """In logit space; predictions are kept 1e-7 off 0 and 1."""
    p = clamp(x, 1e-7, 1 - 1e-7)
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / max(temperature, 0.01)))


def by_isotonic(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points around x, from (0, 0) and to (1, 1) outside them. The points, at most CELLS + 1, travel with
    the function: as literals of an expression they would be searched one by one for every row."""
    if not points:
        return clamp(x)
    xs, ys = (np.array(c) for c in zip(*points))
    if xs[0] > 0:
        xs, ys = np.insert(xs, 0, 0.0), np.insert(ys, 0, 0.0)
    if xs[-1] < 1:
        xs, ys = np.append(xs, 1.0), np.append(ys, 1.0)

    @F.pandas_udf("double")
    def at(p: pd.Series) -> pd.Series:
        return pd.Series(np.interp(p.to_numpy(float), xs, ys)).where(p.notna().reset_index(drop=True))

    return at(clamp(x))


def by_histogram(x: Column, bins: int, values: list[float]) -> Column:
    """Value of the bin with the nearest centre, the lower of two."""
    at = F.least(F.greatest(F.ceil(clamp(x) * bins) - 1, F.lit(0)), F.lit(bins - 1))
    return F.array(*[F.lit(v) for v in values])[at.cast("int")]


def statistics(rows: DataFrame, calibrated: Column | None = None, bins: int = 10) -> DataFrame:
    """n, ece, mce, brier of the (calibrated) predictions: two small aggregations, all zero for no rows."""
    r = clean(rows).select((calibrated if calibrated is not None else F.col("predicted")).alias("p"), F.col("correct").cast("double").alias("t"))
    per = r.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("t").alias("t"), F.sum(F.pow(F.col("p") - F.col("t"), F.lit(2.0))).alias("s"))
    gap = F.abs(F.col("p") - F.col("t"))
    zero = lambda c: rounded(F.coalesce(c, F.lit(0.0)))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), zero(F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), zero(F.max(gap)).alias("mce"), zero(F.sum("s") / F.sum("n")).alias("brier"))
