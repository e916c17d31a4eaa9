"""Operational metrics over an event log: exact nearest-rank percentiles, latency summaries, retry delays, cache replays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import column
from ..sources.scratch import cut
from .ranking import rounded


def nearest_rank(rows: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """group, percent, value: the element at place max(n p - 1, 1) / 100 (whole part, from 0) of the group's sorted values.

    Equal values of a group are counted first, so that a value any number of rows share is one row. The different values are sorted by
    range partitions; the partitions' counts tell in which one a place lies, and only there it is looked up, so no group is
    gathered. Null groups and values are left out."""
    slim = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("m"))
    spread = cut(slim.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    counts = spread.groupBy("g", "part").agg(F.sum("m").alias("n"))
    w = W.partitionBy("g").orderBy("part")
    counts = counts.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(W.partitionBy("g")))
    wanted = counts.select("g", "part", "before", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.floor(F.greatest(F.col("total") * p - 1, F.lit(1)) / 100).alias("at")) for p in percents])).alias("x"))
    wanted = wanted.select("g", "part", "x.percent", (F.col("x.at") - F.col("before")).alias("k"), "n").filter("k >= 0 and k < n")
    upto = F.sum("m").over(W.partitionBy("g", "part").orderBy("v"))
    placed = spread.join(wanted.select("g", "part").distinct(), ["g", "part"], "left_semi").withColumn("upto", upto)
    return placed.join(wanted, ["g", "part"]).filter("k < upto and k >= upto - m").select(F.col("g").alias(group), "percent", F.col("v").alias(value))


def previous(rows: DataFrame, group: str, order: list[str], value: str, to: str, seconds: int = 86_400) -> DataFrame:
    """rows with the `value` of the group's row before, by `order` (the first of it a timestamp), in the column `to`; null for the first.

    A group is cut into spans of so many seconds, each sorted by itself; a span's first row takes the last value of the spans before,
    which are one row each. So a group that holds a third of all rows is spread over as many tasks as it has spans."""
    span = F.floor(F.unix_timestamp(order[0]) / seconds)
    spanned = rows.withColumn("_span", span).withColumn("_last", F.struct(*order, value))
    inside = spanned.withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(W.partitionBy(group, "_span").orderBy(*order)))
    ends = spanned.groupBy(group, "_span").agg(F.max("_last").alias("_last"))
    carried = ends.select(group, "_span", F.lag(F.struct(F.col(f"_last.{value}").alias("v"))).over(W.partitionBy(group).orderBy("_span")).alias("_carried"))
    joined = inside.join(carried, (inside[group] == carried[group]) & inside["_span"].eqNullSafe(carried["_span"])).select(*[inside[c] for c in rows.columns], "_before", "_carried")
    return joined.withColumn(to, F.coalesce("_before", "_carried")["v"]).drop("_before", "_carried")


def summary(rows: DataFrame, group: str, value: str, ok: Column) -> DataFrame:
    """group, requests, succeeded, rate, mean (of the successful), least, most."""
    a = rows.groupBy(group).agg(F.count("*").alias("requests"), F.count_if(ok).alias("succeeded"), rounded(F.avg(F.when(ok, F.col(value)))).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return a.select(group, "requests", "succeeded", rounded(F.col("succeeded") / F.col("requests")).alias("rate"), "mean", "least", "most")


def retry_delay(attempt: Column, initial_ms: float = 100.0, factor: float = 2.0, most_ms: float = 5000.0) -> Column:
    """Delay before an attempt (from 0), without jitter."""
    return F.least(F.lit(most_ms), initial_ms * F.pow(F.lit(factor), attempt.cast("double")))


def fingerprint(text: Column | str, summary_length: int = 50) -> Column:
    """(hash, bytes, first characters) of a text."""
    t = column(text)
    return F.struct(F.xxhash64(t).alias("hash"), F.octet_length(t).alias("bytes"), F.substring(t, 1, summary_length).alias("summary"))


def rolling_hash(text: Column | str, base: int = 31) -> Column:
    """hash = hash * base + code point, over a text's characters, modulo 2 ** 64; 0 for an empty text. So the hash of a text and one
    more character follows from the text's."""
    codes = F.transform(F.filter(F.split(column(text), ""), lambda c: c != ""), lambda c: F.ascii(c))
    step = lambda acc, c: ((acc * F.lit(base).cast("decimal(4,0)") + c.cast("decimal(10,0)")) % F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.aggregate(codes, F.lit(0).cast("decimal(20,0)"), step)


def prefix_lengths(text: Column | str, least: int = 16, step: int = 16) -> Column:
    """least, least + step, ... and the text's own length; only the latter for a text not longer than `least`."""
    n = F.length(column(text))
    return F.when(n > least, F.array_union(F.sequence(F.lit(least), n, F.lit(step)), F.array(n))).otherwise(F.array(n))


def _in_order(new: DataFrame, cached: DataFrame) -> DataFrame:
    """text, new, cached (whether it is among them), part: all distinct texts, sorted by ranges, whose numbers are `part`."""
    text = lambda df, is_new: df.filter("text is not null and text <> ''").select("text", F.lit(is_new).alias("new"), F.lit(not is_new).alias("cached"))
    every = text(new, True).unionByName(text(cached, False)).groupBy("text").agg(F.max("new").alias("new"), F.max("cached").alias("cached"))
    return cut(every.repartitionByRange("text").withColumn("part", F.spark_partition_id()))


def _opened(parts: DataFrame, side: str) -> dict[int, list[str]]:
    """For each range the texts of a side that its first text begins with and that come before it, shortest first: one chain of prefixes a range."""
    starts = parts.groupBy("part").agg(F.min("text").alias("start"))
    begun = parts.filter(side).select("text").join(F.broadcast(starts), F.startswith("start", F.col("text")) & (F.col("text") < F.col("start")))
    out: dict[int, list[str]] = {}
    for r in begun.select("part", "text").collect():
        out.setdefault(r.part, []).append(r.text)
    return {part: sorted(texts, key=len) for part, texts in out.items()}


def _walked(parts: DataFrame, side: str, visit, schema: str) -> DataFrame:
    """Goes through each range in order with the stack of a side's texts that the current text begins with; visit(text, new, cached, stack)
    gives rows (text, number)."""
    opened = _opened(parts, side)

    def run(batches):
        at, stack = None, []
        for b in batches:
            out: list[tuple] = []
            for x, is_new, is_cached, part in zip(*(c.to_pylist() for c in b.columns)):
                if part != at:
                    at, stack = part, list(opened.get(part, ()))
                while stack and not x.startswith(stack[-1]):
                    stack.pop()
                out += visit(x, is_new, is_cached, stack)
                if is_new if side == "new" else is_cached:
                    if not stack or stack[-1] != x:
                        stack.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32())], ["text", "number"])

    return parts.select("text", "new", "cached", "part").repartition("part").sortWithinPartitions("part", "text").mapInArrow(run, schema)


def prefix_hits(new: DataFrame, cached: DataFrame, key: str = "query_id") -> DataFrame:
    """key, length, kind: for each new text the longest cached text (text) of any length that it begins with: `hit` if it is the
    whole text, else `partial`.

    The distinct texts are sorted by ranges. In that order the cached texts a text begins with are those still open, so a
    task keeps a stack of them; the ones that are open where a range begins are looked up once for each range."""
    longest = lambda x, is_new, is_cached, stack: [(x, len(x) if is_cached else len(stack[-1]))] if is_new and (is_cached or stack) else []
    met = _walked(_in_order(new, cached), "cached", longest, "text string, number int")
    found = new.select(key, "text").join(met, "text").select(key, F.col("number").alias("length"), (F.col("number") == F.length("text")).alias("w"))
    return found.groupBy(key).agg(F.max("length").alias("length"), F.bool_or("w").alias("w")).select(key, "length", F.when(F.col("w"), "hit").otherwise("partial").alias("kind"))


def extensions(new: DataFrame, cached: DataFrame) -> DataFrame:
    """text, n, longest: for each different new text how many cached texts begin with it, itself left out, and the longest one's length; texts
    without any have no row. In sorted order these follow the text, so a task keeps a stack of the new texts that are still open."""
    within = lambda x, is_new, is_cached, stack: [(t, len(x)) for t in stack if t != x] if is_cached else []
    return _walked(_in_order(new, cached), "new", within, "text string, number int").groupBy("text").agg(F.count("*").alias("n"), F.max("number").alias("longest"))


def cache_replay(log: DataFrame, key: Column, ts: str = "ts", ttl_seconds: int = 3600) -> DataFrame:
    """kind, n: hits and misses of a cache with time to live and no size limit: a request hits if the same key was put (by its
    last miss or use) less than ttl ago. Only neighbouring uses of a key matter."""
    # a hot key is a log's hot question: its rows are first thinned to one per second, which changes no verdict
    seconds = log.filter(F.col(ts).isNotNull()).select(key.alias("k"), F.unix_timestamp(ts).alias("s")).filter("k is not null").groupBy("k", "s").agg(F.count("*").alias("n"))
    gap = F.col("s") - F.lag("s").over(W.partitionBy("k").orderBy("s"))
    miss = gap.isNull() | (gap >= ttl_seconds)
    return seconds.withColumn("m", miss).agg(F.sum(F.when(F.col("m"), 1).otherwise(0)).alias("misses"), F.sum("n").alias("requests")).select("requests", "misses", rounded((F.col("requests") - F.col("misses")) / F.col("requests")).alias("hit_rate"))


def tier(idle_seconds: Column, hits: Column) -> Column:
    """Level of a cache entry: promoted at three hits, demoted after 300 s (first level) or 600 s (second) without use."""
    hot = hits >= 3
    return F.when(hot & (idle_seconds <= 300), "L1").when(hot | (idle_seconds <= 600), "L2").otherwise("L3")


def invalid(age: Column, idle: Column, ttl: float | None = None, most_age: float | None = None, most_idle: float | None = None) -> Column:
    """Whether any of the given limits is passed; never without limits."""
    out = F.lit(False)
    for x, limit in ((age, ttl), (age, most_age), (idle, most_idle)):
        if limit is not None:
            out = out | (x > limit)
    return out
