"""Shared pieces: word splitting, 64-bit mixing, one row per key."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import cut  # noqa: F401 (used by the other modules)

#: Repeated keys whose hashes may be broadcast.
REPEATED = 1_000_000
WORD = re.compile(r"[^\W_]+")
#: The same classes for Java and DuckDB regular expressions.
WORD_CLASS = r"[\p{L}\p{N}]"
#: White space (Python's definition); Java's `\s` lacks some of it, so it is written out.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits (Unicode), lower-cased; an underscore separates."""
    if "İ" in text:  # its lower case holds a combining mark, which would split the word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def terms(text: str | None) -> list[str]:
    """Words of more than one UTF-8 byte; null and empty texts have none."""
    return [w for w in words(text) if len(w) > 1 or w > "\x7f"] if text else []


class _Memo(dict):
    """White-space-free stretch -> what `make` gives for it. Bounded: cleared at `limit` entries; long ones aren't kept."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, stretch: str):
        made = self.make(stretch)
        if len(stretch) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[stretch] = made
        return made


class Splitter:
    """`words` or `terms` of many texts. No word holds white space, so texts are split there first and each distinct
    stretch is taken apart once."""

    def __init__(self, of=terms, limit: int = 300_000):
        self.strings = _Memo(lambda s: tuple(of(s)), limit)
        self.numbers = _Memo(lambda s: tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in of(s)), limit)

    def __call__(self, text: str | None) -> list[str]:
        return list(chain.from_iterable(map(self.strings.__getitem__, text.split()))) if text else []

    def hashes(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.numbers.__getitem__, text.split()))) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (two multiply-xorshift rounds) over uint64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bits of a `bitmap`: 8 MB, whatever the input.
BITMAP_BITS = 1 << 26


def bitmap(numbers: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP_BITS places for the numbers of a one-column frame of longs: what isn't in it needn't be shuffled. Tasks send
    compressed blocks, which are merged where they meet; at most BITMAP_BITS / 8 bytes reach the driver."""
    schema = "block int, bits binary"

    def coded(parts):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in parts], pa.binary())], ["block", "bits"])

    def build(batches):
        bits = np.zeros(BITMAP_BITS // 8, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(BITMAP_BITS - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield coded([(k, x) for k, x in enumerate(bits.reshape(64, -1)) if x.any()])

    def merge(batches):
        total: dict = {}
        for b in batches:
            for k, x in zip(*(x.to_pylist() for x in b.columns)):
                y = np.frombuffer(zlib.decompress(x), np.uint8)
                total[k] = total[k] | y if k in total else y
        yield coded(list(total.items()))

    bits = np.zeros((64, BITMAP_BITS // 8 // 64), np.uint8)
    for r in numbers.mapInArrow(build, schema).repartition("block").mapInArrow(merge, schema).collect():
        bits[r["block"]] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return bits.ravel()


def in_bitmap(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each number (64 bits) may be among those of the bitmap."""
    at = numbers.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over at least as many partitions as there are cores: where a table is a few small files, a shuffle of it costs less than
    what is done to each row. Any larger table is left as it lies."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key (repeated deliveries hold the same values). Rows with a null key are no records and are dropped.

    Only keys are shuffled, to see which repeat: rows of other keys stay where they are, and rows of repeated keys are reduced
    to one, on the map side first, so a key that holds a third of all rows has one row per map task left. Where more keys repeat than
    may be broadcast, all rows are."""
    rows = df.filter(df[key].isNotNull())
    repeated = cut(rows.select(F.xxhash64(key).alias("_h")).groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1").select("_h"))
    n = repeated.limit(REPEATED + 1).count()
    if n > REPEATED:
        return rows.dropDuplicates([key])
    if not n:
        return rows
    known = F.broadcast(repeated)  # at most REPEATED numbers
    marked = rows.withColumn("_h", F.xxhash64(key))
    alone = marked.join(known, "_h", "left_anti").drop("_h")
    return alone.unionByName(marked.join(known, "_h", "left_semi").drop("_h").dropDuplicates([key]))
