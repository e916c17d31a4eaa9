"""Problem 7: texts packed into containers of fixed capacity (shortest-pack-first over the length histogram)."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def byt5_tokens(text: Column | str) -> Column:
    """Tokens of the public ByT5 tokenizer: one per UTF-8 byte and an end token."""
    return F.octet_length(text) + 1


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(size, items of it), ...]) for each packing pattern. Sizes are placed longest first, each into the
    shortest packs that it fits, else into new ones. A pattern whose count isn't used up is split; equal steps are taken
    together, so the work depends on the number of sizes, not of items."""
    heap: list[tuple[int, int, int, tuple]] = []  # filled, order, count, items
    done, order = [], 0

    def put(filled: int, count: int, items: tuple) -> None:
        nonlocal order
        order += 1
        heapq.heappush(heap, (filled, order, count, items))

    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        while left:
            if heap and heap[0][0] + size <= capacity:
                filled, _, count, items = heapq.heappop(heap)
                # as many to each pack as it takes while it stays the shortest
                ahead = heap[0][0] if heap else capacity
                each = max(1, min((ahead - filled) // size, (capacity - filled) // size))
                if left < each * count:
                    each = max(1, left // count)
                used = min(count, left // each)
                put(filled + each * size, used, (*items, (size, each)))
                if count > used:
                    put(filled, count - used, items)
                left -= used * each
            else:
                each = min(capacity // size, left)
                used = left // each
                put(each * size, used, ((size, each),))
                left -= used * each
    done = [(count, list(items)) for _, _, count, items in heap]
    return done


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, rows_per_bucket: int = 100_000) -> DataFrame:
    """Parts of records in containers: key, part (from 0), parts, first_token, size, container, position.

    Only a text of more than `capacity` tokens has several parts: full ones, and the rest. Null and empty texts and null
    keys are left out; an empty table gives no rows. The histogram has at most `capacity` sizes, whatever the input.
    Items of a size are ranked within buckets of a hash of their key and the buckets' counts summed, so a size that a third
    of all items have is ranked in pieces. Ties within a bucket go by key and part; rows repeated whole (same key, same
    size) are interchangeable, each gets its place."""
    sizes = docs.select(F.col(key).alias("key"), byt5_tokens(text).cast("long").alias("tokens")).filter("key is not null and tokens > 1")
    n = F.ceil(F.col("tokens") / capacity)
    part = sizes.withColumn("parts", n.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = part.withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("int"))
    histogram = {r["size"]: r["n"] for r in part.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = max(1, sum(histogram.values()) // rows_per_bucket)
    part = part.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)))
    ranked = part.withColumn("local", F.row_number().over(W.partitionBy("size", "bucket").orderBy("key", "part")) - 1)
    before = part.groupBy("size", "bucket").agg(F.count("*").alias("n")).select("size", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranked.join(before, ["size", "bucket"]).withColumn("rank", F.col("local") + F.col("before"))

    spans: dict[int, list] = {}
    container, given = 0, {}
    for count, items in plan_packs(histogram, capacity):
        position = 0
        for size, each in items:
            start = given.get(size, 0)
            given[size] = start + count * each
            spans.setdefault(size, []).append((start, given[size], each, container, position))
            position += size * each
        container += count
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, x) for s, x in spans.items()], "size int, spans array<struct<start:long,stop:long,each:long,container:long,position:long>>")
    # the plan's size depends on `capacity` only, so it may be broadcast
    placed = ranked.join(F.broadcast(plan), "size").withColumn("at", F.filter("spans", lambda x: (x["start"] <= F.col("rank")) & (F.col("rank") < x["stop"]))[0])
    step = F.col("rank") - F.col("at.start")
    return placed.select(
        F.col("key").alias(key), "part", "parts", (F.col("part") * capacity).alias("first_token"), "size",
        (F.col("at.container") + F.floor(step / F.col("at.each"))).alias("container"), (F.col("at.position") + step % F.col("at.each") * F.col("size")).alias("position"),
    )
