"""Problem 1: the most frequent values of a column, in bounded memory.

A count-sketch (signed hashes) is kept for each of LEVELS prefixes of a value's 64-bit hash. Descending from the shortest
prefix and keeping only heavy ones leaves at most about 2/share candidates; a second scan counts those exactly."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, mix

LEVELS, BITS = 8, 8


def query_pattern(text: Column | str) -> Column:
    """Lower case, only letters, digits and single blanks. Null stays null."""
    kept = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{SPACE}]+", "")
    return F.trim(F.regexp_replace(kept, f"[{SPACE}]+", " "))


def _seeds(rows: int) -> np.ndarray:
    return mix(np.arange(1, LEVELS * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(LEVELS, rows)


def _cells(prefix: np.ndarray, seed: np.uint64, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(prefix ^ seed)
    return (h & np.uint64(width - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def _prefix(h: np.ndarray, level: int) -> np.ndarray:
    return h >> np.uint64(64 - BITS * (level + 1))


def hash_sketch(hashes: DataFrame, rows: int = 5, width: int = 8192) -> tuple[np.ndarray, int]:
    """The merged sketch [LEVELS, rows, width] of a one-column frame of 64-bit hashes, and the number of rows. Its size is
    fixed by the parameters; partitions are summed as a stream, one cell block per reducer, so no group is gathered."""
    seeds = _seeds(rows)

    def build(batches):
        sketch, n = np.zeros((LEVELS * rows, width), np.int64), 0
        for b in batches:
            h, c = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            n += b.num_rows
            for level in range(LEVELS):
                p = _prefix(h, level)
                for r in range(rows):
                    cell, sign = _cells(p, seeds[level, r], width)
                    sketch[level * rows + r] += np.bincount(cell, sign * c, width).astype(np.int64)
        if n:
            blocks = [zlib.compress(x.tobytes(), 1) for x in sketch]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([n] * len(blocks)), pa.array(blocks, pa.binary())], ["block", "n", "cells"])

    def merge(batches):
        total = {}
        for b in batches:
            for k, n, cells in zip(*(x.to_pylist() for x in b.columns)):
                x = np.frombuffer(zlib.decompress(cells), np.int64)
                total[k] = (total[k][0] + n, total[k][1] + x) if k in total else (n, x.copy())
        for k, (n, x) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n]), pa.array([x.tobytes()], pa.binary())], ["block", "n", "cells"])

    schema = "block int, n long, cells binary"
    merged = hashes.mapInArrow(build, schema).repartition("block").mapInArrow(merge, schema).collect()
    sketch, n = np.zeros((LEVELS, rows, width), np.int64), 0
    for r in merged:  # LEVELS * rows blocks of fixed size
        sketch[divmod(r["block"], rows)], n = np.frombuffer(r["cells"], np.int64), r["n"]
    return sketch, n


def _estimates(sketch: np.ndarray, level: int, prefix: np.ndarray) -> np.ndarray:
    rows, width = sketch.shape[1:]
    each = []
    for r, seed in enumerate(_seeds(rows)[level]):
        cell, sign = _cells(prefix, seed, width)
        each.append(sketch[level, r, cell] * sign)
    return np.median(each, axis=0)


def noise(sketch: np.ndarray) -> float:
    """The spread of the cells that hold no heavy value, on the worst level: by the median, which the few heavy cells don't move."""
    return float((np.median(np.abs(sketch), axis=2) / 0.6745).max())


def descend(sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes whose estimate is at least `least` on every level of prefixes, and their estimates."""
    child = np.arange(1 << BITS, dtype=np.uint64)
    heavy = np.zeros(1, np.uint64)
    for level in range(LEVELS):
        heavy = ((heavy[:, None] << np.uint64(BITS)) | child).ravel()
        estimate = _estimates(sketch, level, heavy)
        heavy, estimate = heavy[estimate >= least], estimate[estimate >= least]
    return heavy, estimate


def fitted_sketch(hashes: DataFrame, share: float, rows: int = 5, width: int | None = None, most_width: int = 1 << 20) -> tuple[np.ndarray, int]:
    """A sketch whose noise is at most an eighth of the least count that is looked for, and the number of rows. The width begins at
    16 / share and is raised to what the noise asks for, which falls with its root; an error where that is beyond most_width (a share
    of so few rows that a sketch can't tell it)."""
    width = width or 1 << max(10, int(np.ceil(np.log2(16 / share))))
    while True:
        if width > most_width:
            raise ValueError(f"a share of {share} needs a sketch of {width} cells, more than most_width = {most_width}")
        sketch, n = hash_sketch(hashes, rows, width)
        over = 8 * noise(sketch) / max(1.0, share * n)
        if over <= 1:
            return sketch, n
        width <<= max(1, int(np.ceil(2 * np.log2(over))))


def heavy_hitters(values: DataFrame, share: float = 0.002, rows: int = 5, width: int | None = None) -> DataFrame:
    """Values (the frame's only column) that hold at least `share` of its rows: value, estimate (of the sketch), n (exact),
    rows_total. Nulls are left out of both; an empty frame gives no rows. Ties don't matter: it is a threshold, not a
    limit. The descent admits estimates from half the share on, four times the noise below it, so that the sketch's error loses
    nothing; at most about 2/share hashes are looked for in the second scan."""
    name = values.columns[0]
    value = values.select(F.col(f"`{name}`").alias("value")).filter("value is not null")
    sketch, n = fitted_sketch(value.select(F.xxhash64("value").alias("h")), share, rows, width)
    found, estimate = descend(sketch, max(1.0, share * n / 2)) if n else (np.zeros(0, np.uint64), np.zeros(0))
    spark = values.sparkSession
    guess = spark.createDataFrame([(int(h), int(e)) for h, e in zip(found.view(np.int64), estimate)], "h long, estimate long")
    exact = value.withColumn("h", F.xxhash64("value")).filter(F.col("h").isin(found.view(np.int64).tolist())) if len(found) else value.withColumn("h", F.xxhash64("value")).limit(0)
    counted = exact.groupBy("value", "h").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(guess), "h").filter(F.col("n") >= share * n).select("value", "estimate", "n", F.lit(n).alias("rows_total"))
