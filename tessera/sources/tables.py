"""Reading tables, and the document store: keys, upserts, merges, vacuum, snapshots, all as whole-table plans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row per non-null key: the last by `order` (ties: any), or any where rows of a key are equal anyway."""
    rows = rows.filter(F.col(key).isNotNull())
    if order is None:
        return rows.dropDuplicates([key])
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("_row")).select("_row.*")


def divisible(key: Column | str, by: int = 100) -> Column:
    """Whether a hexadecimal key of up to 16 digits is divisible by `by`."""
    return F.pmod(F.conv(key, 16, 10).cast("decimal(20,0)"), F.lit(by)) == 0


def checked(docs: DataFrame, key: str, embedding: str, dimension: int, existing: DataFrame | None = None, capacity: int = 0) -> DataFrame:
    """The rows with their verdict in `status`: `dimension`, `capacity`, `duplicate` or `ok`, tested in this order. Capacity counts existing rows
    and earlier new ones, in order of the key; 0 is no limit. A key is a duplicate if it exists or comes earlier in the batch."""
    rows = docs.withColumn("_fits", F.coalesce(F.size(embedding) == dimension, F.lit(False)))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(F.col("_fits").desc())))
    if existing is not None:
        rows = rows.join(existing.select(F.col(key), F.lit(True).alias("_there")).distinct(), key, "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("boolean"))
    duplicate = F.coalesce("_there", F.lit(False)) | (F.col("_nth") > 1)
    status = F.when(~F.col("_fits"), "dimension").when(duplicate, "duplicate").otherwise("ok")
    rows = rows.withColumn("status", status)
    if capacity:
        held = existing.count() if existing is not None else 0
        room = max(0, capacity - held)
        # a top-k of at most `room` keys; its last one is where the store becomes full
        fitting = rows.filter("status = 'ok'").select(key).orderBy(key).limit(room)
        n, last = fitting.agg(F.count("*"), F.max(key)).first()
        if n == room:
            full = F.lit(True) if not room else (F.col(key) > F.lit(last)) | ((F.col(key) == F.lit(last)) & (F.col("_nth") > 1))
            rows = rows.withColumn("status", F.when((F.col("status") != "dimension") & full, "capacity").otherwise(F.col("status")))
    return rows.drop("_fits", "_nth", "_there")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new inserted or in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def update_vectors(old: DataFrame, new: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """old with the vectors of new where it has any; keys only in new are ignored (see missing)."""
    fresh = new.select(key, F.col(vector).alias("_new"))
    return old.join(fresh, key, "left").withColumn(vector, F.coalesce("_new", vector)).drop("_new").select(*old.columns)


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys asked for that don't exist."""
    return wanted.select(key).distinct().join(there, key, "left_anti")


def get(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the keys asked for (each once)."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def cleared(rows: DataFrame) -> DataFrame:
    """A store of the same columns without rows."""
    return rows.limit(0)


def with_vectors(docs: DataFrame, key: str, text: str, provider, dimension: int, existing: DataFrame | None = None, capacity: int = 0) -> DataFrame:
    """A batch to be indexed: docs with the provider's vector of their text, made once for each different text, and the verdict of `checked`.
    A text without a vector (null) is `dimension`, as it has none."""
    from ..functions.embedding import embed

    return checked(embed(docs, text, provider), key, "embedding", dimension, existing, capacity)


def compacted(rows: DataFrame, folder: str, rows_per_file: int = 1_000_000, by: str | None = None) -> DataFrame:
    """The rows written anew in files of at most rows_per_file rows, sorted by `by` within each, and read back: what is left of a store after
    deletions and many small additions."""
    files = max(1, -(-rows.count() // rows_per_file))
    dealt = rows.repartitionByRange(files, by).sortWithinPartitions(by) if by else rows.repartition(files)
    dealt.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def merge(first: DataFrame, second: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Both tables with one row per key; for a key in both, that of `first`, or of `second` if overwrite."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    keep = F.max_by if overwrite else F.min_by
    return both.groupBy(key).agg(keep(F.struct(*[F.col(f"`{c}`") for c in both.columns if c != "_from"]), "_from").alias("_row")).select("_row.*")


def statistics(rows: DataFrame, vector: str, pending: DataFrame | None = None) -> DataFrame:
    """documents, dimension, memory_bytes = n * (4 d + 256), fragmentation = pending / n (0 for an empty table)."""
    both = rows.select(F.size(vector).alias("d"), F.lit(0).alias("waiting"))
    if pending is not None:
        both = both.unionByName(pending.select(F.lit(None).cast("int").alias("d"), F.lit(1).alias("waiting")))
    there = F.col("waiting") == 0
    base = both.agg(F.count_if(there).alias("documents"), F.coalesce(F.mode(F.when(there, F.col("d"))), F.lit(0)).alias("dimension"), F.count_if(~there).alias("pending"))
    return base.select("documents", "dimension", (F.col("documents") * (4 * F.col("dimension") + 256)).alias("memory_bytes"), F.when(F.col("documents") > 0, F.col("pending") / F.col("documents")).otherwise(F.lit(0.0)).alias("fragmentation"))


def snapshot(rows: DataFrame, folder: str, version: str | None = None) -> str:
    """Writes all rows to a new version under the folder and returns its name; a version is whole or, without its _SUCCESS mark, not there."""
    version = version or uuid.uuid4().hex
    rows.write.mode("errorifexists").parquet(f"{folder}/{version}")
    return version


def restore(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{version}")


def export_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("errorifexists").json(folder)


def import_json(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(folder)
