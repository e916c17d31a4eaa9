"""Streams: windows with watermarks, de-duplication, and keyed state. Each takes and gives a streaming (or plain) DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def parquet_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def processed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, name: str = "processed") -> StreamingQuery:
    """Runs work (a search, a pipeline: any function of a plain DataFrame) on all rows that have arrived, batch by batch, and ends. A batch's
    result is written below folder/out under the batch's number, so a batch that is repeated after a failure replaces its own; what
    was read is kept in folder/progress, so a later call goes on where this one ended. See `results`."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return stream.writeStream.queryName(name).foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All batches' rows, with the batch's number."""
    return spark.read.parquet(f"{folder}/out")


def windowed(events: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """start, end, by..., n, total per tumbling (or, with `slide`, sliding) window; rows later than `late` are dropped by a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    total = F.round(F.sum(value), 6) if value else F.lit(None).cast("double")
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), total.alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """start, end, by..., n per session: a run of rows no further apart than `gap`."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def once(events: DataFrame, ts: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Each key once; a stream forgets a key after the watermark delay."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def breakers(requests: DataFrame, failures: int = 5, cool_seconds: float = 30.0, successes: int = 3) -> DataFrame:
    """key, at, state: a circuit breaker per key over requests (key, ts, ok): open after so many failures in a row, half open
    when the cooling time is over, closed after so many successes. One row for each change. State: a few numbers per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, bad, good, since = state.get if state.exists else ("closed", 0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows["ts"], rows["ok"]):
            now = ts.timestamp()
            if name == "open" and now - since >= cool_seconds:
                name, good = "half_open", 0
                out.append((key[0], ts, name))
            if name == "open":
                continue
            bad = 0 if ok else bad + 1
            good = good + 1 if ok else 0
            if name == "half_open" and ok and good >= successes:
                name = "closed"
                out.append((key[0], ts, name))
            elif not ok and (name == "half_open" or bad >= failures):
                name, since, bad = "open", now, 0
                out.append((key[0], ts, name))
        state.update((name, bad, good, since))
        yield pd.DataFrame(out, columns=["key", "at", "state"])

    return requests.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, state string", "name string, bad int, good int, since double", "append", GroupStateTimeout.NoTimeout)


def caches(requests: DataFrame, capacity: int = 100, ttl_seconds: float = 3600.0) -> DataFrame:
    """owner, at, key, hit: a least-recently-used cache with time to live per owner over requests (owner, ts, key). State: at most
    `capacity` keys with their times per owner."""

    def step(owner: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, times = state.get if state.exists else ([], [])
        held = dict(zip(keys, times))  # in order of use
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, key in zip(rows["ts"], rows["key"]):
            now = ts.timestamp()
            put = held.pop(key, None)
            hit = put is not None and now - put < ttl_seconds
            held[key] = put if hit else now
            if len(held) > capacity:
                held.pop(next(iter(held)))
            out.append((owner[0], ts, key, hit))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["owner", "at", "key", "hit"])

    return requests.groupBy("owner").applyInPandasWithState(step, "owner string, at timestamp, key string, hit boolean", "keys array<string>, times array<double>", "append", GroupStateTimeout.NoTimeout)
