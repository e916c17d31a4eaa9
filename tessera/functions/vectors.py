"""Vector expressions over arrays. All compute in double precision; a null vector gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import column, let

EPSILON = 1.1920929e-07


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the shorter of the two lengths."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def euclidean_similarity(a: Column | str, b: Column | str) -> Column:
    return 1 / (1 + euclidean(a, b))


def normalize(v: Column | str) -> Column:
    """A zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v)))


def softmax(v: Column | str, temperature: float = 1.0) -> Column:
    """Softmax of v / temperature, shifted by the maximum."""
    e = let(F.array_max(column(v)), lambda m: F.transform(v, lambda x: F.exp((x.cast("double") - m) / temperature)))
    return let(e, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(v: Column | str, temperature: float = 1.0) -> Column:
    z = let(F.array_max(column(v)), lambda m: F.transform(v, lambda x: (x.cast("double") - m) / temperature))
    return let(z, lambda z: let(F.log(total(F.transform(z, F.exp))), lambda t: F.transform(z, lambda x: x - t)))


def argmax(v: Column | str) -> Column:
    """Place of the first maximum, from 0."""
    return F.array_position(column(v), F.array_max(column(v))) - 1


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def quantize(v: Column | str, levels: int) -> Column:
    """(scale, codes): symmetric integer codes in -levels..levels, halves away from zero; the scale of a zero vector is 1."""
    biggest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return let(F.when(biggest > 0, biggest / levels).otherwise(F.lit(1.0)), lambda scale: _codes(v, scale, levels))


def _codes(v: Column | str, scale: Column, levels: int) -> Column:
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: clamp(F.round(x.cast("double") / scale), -levels, levels).cast("int")).alias("codes"))


def dequantize(scale: Column, codes: Column) -> Column:
    return F.transform(codes, lambda q: q * scale)


def binary_words(v: Column | str, bits: int = 32) -> Column:
    """Signs as words of `bits` bits, the first element in the lowest bit; a bit is set where the element is above 0."""
    signs = F.transform(v, lambda x: F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    place = F.sequence(F.lit(0), F.ceil(F.size(signs) / bits).cast("int") - 1)
    return F.transform(place, lambda w: F.aggregate(F.reverse(F.slice(signs, w * bits + 1, F.lit(bits))), F.lit(0).cast("bigint"), lambda acc, b: acc * 2 + b))


def binary_dequantize(words: Column, size: Column, bits: int = 32) -> Column:
    """1 for every bit of binary_words that is set, -1 for the others."""
    bit = lambda i: F.pmod(F.floor(F.get(words, F.floor(i / bits).cast("int")) / F.pow(F.lit(2.0), i % bits)), F.lit(2))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(bit(i) == 1, 1.0).otherwise(-1.0))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def mse(a: Column | str, b: Column | str) -> Column:
    """Mean squared difference; the greatest double where lengths differ, 0 for empty vectors."""
    a, b = column(a), column(b)
    return F.when(F.size(a) != F.size(b), F.lit(1.7976931348623157e308)).when(F.size(a) == 0, F.lit(0.0)).otherwise(F.pow(euclidean(a, b), F.lit(2.0)) / F.size(a))


def snr_db(original: Column | str, copy: Column | str) -> Column:
    """Signal to noise in dB; the greatest double where there is no noise, null where lengths differ."""
    original, copy = column(original), column(copy)
    noise = F.pow(euclidean(original, copy), F.lit(2.0))
    return F.when(F.size(original) == F.size(copy), F.when(noise <= 0, F.lit(1.7976931348623157e308)).otherwise(10 * F.log10(dot(original, original) / noise)))
