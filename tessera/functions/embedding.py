"""Turning texts into vectors: a deterministic hashed embedding, token vectors, and embedding each distinct text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .text import column, words
from .vectors import normalize


def hashed(text: Column | str, dimension: int = 64) -> Column:
    """A unit vector that depends on the text alone (not on its meaning); null stays null. Eight numbers come of one MD5 sum, of the text and
    the sum's place: four hexadecimal digits each, as -1 to 1."""
    t = column(text)
    sums = F.transform(F.sequence(F.lit(0), F.lit((dimension - 1) // 8)), lambda b: F.md5(F.concat(t, F.lit("|"), b.cast("string")).cast("binary")))
    digits = F.flatten(F.transform(sums, lambda m: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(m, 4 * i + 1, F.lit(4)), 16, 10).cast("double") / 32767.5 - 1)))
    return F.when(t.isNotNull(), normalize(F.slice(digits, 1, dimension)))


def token_vectors(texts: DataFrame, key: str, text: str, dimension: int = 16) -> DataFrame:
    """key, pos, token, vec: a unit vector per white-space separated token, from its characters' codes, repeated to the dimension, and
    a tenth of the sine of its place."""
    tokens = texts.select(key, F.posexplode(words(text)).alias("pos", "token"))
    code = lambda i: F.ascii(F.substring("token", F.pmod(i, F.length("token")) + 1, F.lit(1))) / 127.5 - 1 + 0.1 * F.sin(F.col("pos").cast("double"))
    return tokens.withColumn("vec", normalize(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), code)))


def embed(rows: DataFrame, text: str, provider: Callable[[Column], Column], to: str = "embedding") -> DataFrame:
    """rows with the vector of their text; the provider sees each distinct text once. Null texts get null."""
    known = rows.select(F.col(text).alias("_t")).filter("_t is not null").distinct().withColumn(to, provider(F.col("_t")))
    return rows.drop(to).join(known, F.col(text) == F.col("_t"), "left").drop("_t")
