"""Distillation losses of teacher and student vectors, as columns. Empty vectors give 0, different lengths the greatest double
(feature losses compare the common part instead)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import column, let
from .vectors import EPSILON, cosine, dot, log_softmax, mse, norm, normalize, softmax, total

GREATEST = 1.7976931348623157e308


def _guarded(t: Column, s: Column, value: Column) -> Column:
    return F.when((F.size(t) == 0) | (F.size(s) == 0), F.lit(0.0)).when(F.size(t) != F.size(s), F.lit(GREATEST)).otherwise(value)


def kl(teacher: Column | str, student: Column | str, temperature: float = 1.0) -> Column:
    """Divergence of the softened distributions, times the squared temperature."""
    t, s = column(teacher), column(student)
    p, q = softmax(t, temperature), log_softmax(s, temperature)
    value = total(F.zip_with(p, q, lambda x, y: F.when(x > EPSILON, x * (F.log(x) - y)).otherwise(F.lit(0.0))))
    return _guarded(t, s, value * temperature * temperature)


def soft_target(teacher: Column | str, student: Column | str, temperature: float = 1.0) -> Column:
    """Cross entropy with the softened teacher, times the squared temperature."""
    t, s = column(teacher), column(student)
    return _guarded(t, s, -dot(softmax(t, temperature), log_softmax(s, temperature)) * temperature * temperature)


def hard_target(labels: Column | str, student: Column | str) -> Column:
    """Cross entropy with given labels."""
    y, s = column(labels), column(student)
    return _guarded(y, s, -dot(y, log_softmax(s)))


def squared(teacher: Column | str, student: Column | str) -> Column:
    return mse(teacher, student)


def cosine_loss(teacher: Column | str, student: Column | str) -> Column:
    t, s = column(teacher), column(student)
    return _guarded(t, s, 1 - cosine(t, s))


def combined(parts: list[tuple[Column, float]]) -> Column:
    """Weighted sum."""
    out = F.lit(0.0)
    for value, weight in parts:
        out = out + value * weight
    return out


def _common(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    a, b = column(a), column(b)
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def feature(kind: str, teacher: Column | str, student: Column | str) -> Column:
    """mse, l1, cosine (1 where a norm is 0) or attention (mean squared difference of the squared elements' shares), over the common length."""
    t, s = _common(teacher, student)
    match kind:
        case "mse":
            value = mse(t, s)
        case "l1":
            value = total(F.zip_with(t, s, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(t)
        case "cosine":
            n = norm(t) * norm(s)
            value = F.when((norm(t) < EPSILON) | (norm(s) < EPSILON), F.lit(1.0)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(t, s) / n)))
        case "attention":
            share = lambda v: let(F.greatest(dot(v, v), F.lit(EPSILON)), lambda n: F.transform(v, lambda x: x.cast("double") * x.cast("double") / n))
            value = mse(share(t), share(s))
        case _:
            raise ValueError(f"unknown feature loss {kind!r}")
    return F.when(F.size(t) == 0, F.lit(0.0)).otherwise(value)


def gram(features: Column) -> Column:
    """Products of all rows of a small matrix (array of arrays), over rows times columns, row by row."""
    cells = F.flatten(F.transform(features, lambda a: F.transform(features, lambda b: dot(a, b))))
    return F.transform(cells, lambda x: x / (F.size(features) * F.greatest(F.size(features[0]), F.lit(1))))


def gram_loss(teacher: Column, student: Column) -> Column:
    return mse(gram(teacher), gram(student))


def attention_transfer(teacher: Column | str, student: Column | str, temperature: float = 1.0) -> Column:
    """Mean over the maps both have (arrays of arrays) of the mean squared difference of their softened distributions; 0 without maps."""
    t, s = column(teacher), column(student)
    n = F.least(F.size(t), F.size(s))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(s, F.lit(1), n), lambda x, y: feature("mse", softmax(x, temperature), softmax(y, temperature)))
    return F.when(n > 0, total(pairs) / n).otherwise(F.lit(0.0))


def feature_distillation(teacher: Column | str, student: Column | str, weights: list[float], kind: str = "mse", normalized: bool = True) -> Column:
    """Weighted mean of the feature losses of mapped layers (the i-th of both, arrays of arrays); layers that one side lacks don't count."""
    t, s = column(teacher), column(student)
    unit = (lambda v: normalize(v)) if normalized else (lambda v: v)
    parts = [(F.when((F.size(t) > i) & (F.size(s) > i), feature(kind, unit(t[i]), unit(s[i]))), w) for i, w in enumerate(weights)]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    value = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    return F.when(weight > EPSILON, value / weight).otherwise(F.lit(0.0))
