"""Distillation analytics over a query log: patterns, question-answer pairs, candidates, triggers, models and training runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import ALNUM, SPACE, words
from ..sources.scratch import cut
from .ranking import first_rows, rounded


def pattern(text: Column | str) -> Column:
    """Lower case, letters, digits and single blanks only."""
    return F.array_join(words(F.regexp_replace(F.lower(text), f"[^{ALNUM}{SPACE}]+", "")), " ")


def pairs(log: DataFrame, most: int = 50) -> DataFrame:
    """pattern, text, answer, confidence, ts, place: different (question, answer) pairs of each pattern, the first `most` by time.
    Pairs are made distinct and cut per task before the shuffle, so a pattern with a third of all rows stays small."""
    rows = log.filter("text is not null and answer is not null").select(pattern("text").alias("pattern"), "text", "answer", F.col("confidence").cast("double").alias("confidence"), "ts").filter("pattern <> ''")
    first = rows.groupBy("pattern", "text", "answer").agg(F.min("ts").alias("ts"), F.min_by("confidence", "ts").alias("confidence"))
    return first_rows(first, ["pattern"], ["ts", "text", "answer"], most, "place")


def expired(p: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """Pairs collected longer ago than that."""
    return p.filter(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("ts") > seconds)


def exported(p: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Pairs as training examples (input, output, confidence); without a confidence it counts as 0."""
    c = F.coalesce("confidence", F.lit(0.0))
    return p.filter(c >= least_confidence).select(F.col("text").alias("input"), F.col("answer").alias("output"), rounded(c).alias("confidence"))


def pair_statistics(p: DataFrame) -> DataFrame:
    """pairs, patterns, confidence (mean; null counts as 0), pairs_per_pattern; zeros without pairs."""
    per = p.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    mean = lambda a, b: rounded(F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0)))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("patterns"), mean("c", "n").alias("confidence"), rounded(F.coalesce(F.avg("n"), F.lit(0.0))).alias("pairs_per_pattern"))


def similar_patterns(patterns: DataFrame, threshold: float = 0.9) -> DataFrame:
    """first, second (first < second), similarity of different patterns (column pattern) whose word sets have shared / united of at
    least the threshold. Sets of a and b words that do differ by at most (a + b) (1 - threshold) / (1 + threshold) words. Equal sets meet
    by their hash, and sets that differ by one word by that of the larger one without it. Only sets so large that they may differ by
    more are compared by their rarest words (_by_rare_words)."""
    more = threshold / max(1 - threshold, 1e-9) - 1e-6  # words of the smaller set from which one may differ; from twice as many, two
    sets = lambda c: F.array_sort(F.array_distinct(words(c)))
    p = cut(patterns.select("pattern").distinct().filter(F.size(words("pattern")) > 0))
    each = p.select("pattern", sets("pattern").alias("ws"))
    less = F.transform("ws", lambda w: F.xxhash64(F.array_remove("ws", w)))
    whole = each.select("pattern", (F.size("ws") >= more).alias("meets"), F.xxhash64("ws").alias("h"), F.lit(True).alias("whole"))
    larger = each.filter(F.size("ws") > more).select("pattern", F.lit(False).alias("meets"), F.explode(less).alias("h"), F.lit(False).alias("whole"))
    # only hashes that a whole set shares; one shuffle of hashes and patterns
    same = W.partitionBy("h")
    met = whole.unionByName(larger).withColumn("n", F.count("*").over(same)).withColumn("some", F.max("whole").over(same)).filter("n > 1 and some").drop("n", "some")
    met = cut(met)
    side = lambda s: met.filter("whole" if s == "a" else "true").select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("pattern", "meets", "whole")])
    both = side("a").join(side("b"), "h").filter(F.when(F.col("whole_b"), F.col("pattern_a") < F.col("pattern_b")).otherwise(F.col("meets_a")))
    both = both.select("whole_b", "pattern_a", "pattern_b", sets("pattern_a").alias("ws_a"), sets("pattern_b").alias("ws_b"))
    k = F.size("ws_a")
    similarity = F.when(F.col("whole_b"), F.lit(1.0)).otherwise(k / (k + 1))
    # the hashes only propose
    both = both.filter(F.when(F.col("whole_b"), F.col("ws_a") == F.col("ws_b")).otherwise((F.size("ws_b") == k + 1) & (F.size(F.array_except("ws_a", "ws_b")) == 0)) & (similarity >= threshold - 1e-9))
    found = both.select(F.least("pattern_a", "pattern_b").alias("first"), F.greatest("pattern_a", "pattern_b").alias("second"), rounded(similarity).alias("similarity"))
    large = each.filter(F.size("ws") >= 2 * more)
    return found.unionByName(_by_rare_words(large, threshold)) if large.limit(1).count() else found


def _by_rare_words(p: DataFrame, threshold: float) -> DataFrame:
    """similar_patterns of sets (pattern, ws) that differ by two words or more. Words are ordered by how few patterns have them; sets that
    reach the threshold share one of their rarest, as many as the threshold asks for, so only patterns with one of these in common, and of
    sizes that can do, are compared."""
    each = p.select("pattern", F.explode("ws").alias("w"))
    rare = each.groupBy("w").agg(F.count("*").alias("n"))
    ordered = each.join(rare, "w").groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("ws"))
    size = F.size("ws")
    prefix = ordered.select("pattern", "ws", size.alias("k"), F.posexplode(F.slice("ws", F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)).alias("at", "w"))
    prefix = cut(prefix)
    side = lambda s: prefix.select("w", *[F.col(c).alias(f"{c}_{s}") for c in ("pattern", "ws", "k", "at")])
    met = side("a").join(side("b"), "w").filter((F.col("pattern_a") < F.col("pattern_b")) & (F.least("k_a", "k_b") >= threshold * F.greatest("k_a", "k_b") - 1e-9))
    # only where the first common word is met, so that a pair comes once
    common = F.array_intersect("ws_a", "ws_b")
    met = met.filter(common[0] == F.col("w")).withColumn("o", F.size(common)).filter(F.col("k_a") + F.col("k_b") - 2 * F.col("o") >= 2)
    similarity = F.col("o") / (F.col("k_a") + F.col("k_b") - F.col("o"))
    return met.filter(similarity >= threshold - 1e-9).select(F.col("pattern_a").alias("first"), F.col("pattern_b").alias("second"), rounded(similarity).alias("similarity"))


def model_sizes(spark: SparkSession, start: tuple[float, int, int], end: tuple[float, int, int], stages: int, decay: float | None = None) -> DataFrame:
    """stage, parameters (millions), layers, hidden: the sizes at the bounds of stages from one model to a smaller one, in equal steps, or
    with `decay` in steps that shrink."""
    t = F.when(F.lit(stages) == 0, 1.0).otherwise(F.col("id") / F.lit(max(stages, 1)))
    left = 1 - t if decay is None else F.pow(F.lit(1.0 - decay), t)
    at = lambda i: F.lit(float(end[i])) + F.lit(float(start[i] - end[i])) * left
    return spark.range(stages + 1).select(F.col("id").alias("stage"), rounded(at(0)).alias("parameters"), F.round(at(1)).cast("int").alias("layers"), F.round(at(2)).cast("int").alias("hidden"))


def candidates(log: DataFrame, least_frequency: int = 5, least_confidence: float = 0.85, most_pairs: int = 50) -> DataFrame:
    """pattern, frequency, pairs (at most most_pairs), confidence (mean of the kept pairs; 0 without any), first_seen, last_seen,
    ready, priority = 0.4 frequency + 35 confidence + 0.25 pairs. Questions with an empty pattern are left out."""
    seen = log.filter("text is not null").select(pattern("text").alias("pattern"), "ts").filter("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("frequency"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    kept = pairs(log, most_pairs).groupBy("pattern").agg(F.count("*").alias("pairs"), F.avg("confidence").alias("confidence"))
    c = seen.join(kept, "pattern", "left").select("pattern", "frequency", F.coalesce("pairs", F.lit(0)).alias("pairs"), rounded(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), "first_seen", "last_seen")
    ready = (F.col("frequency") >= least_frequency) & (F.col("pairs") >= 1) & (F.col("confidence") >= least_confidence)
    return c.withColumn("ready", ready).withColumn("priority", rounded(F.col("frequency") * 0.4 + F.col("confidence") * 35 + F.col("pairs") * 0.25))


def readiness(c: DataFrame) -> DataFrame:
    """candidates, ready, ratio."""
    return c.agg(F.count("*").alias("candidates"), F.count_if("ready").alias("ready"), rounded(F.coalesce(F.avg(F.col("ready").cast("double")), F.lit(0.0))).alias("ratio"))


@dataclass(frozen=True)
class Trigger:
    """kind: frequency, pairs, confidence_below, confidence_above, age (seconds since first seen), all, any."""

    kind: str
    value: float = 0
    parts: tuple = ()

    def column(self, as_of: str | None = None) -> Column:
        match self.kind:
            case "frequency":
                return F.col("frequency") >= self.value
            case "pairs":
                return F.col("pairs") >= self.value
            case "confidence_below":
                return (F.col("pairs") > 0) & (F.col("confidence") < self.value)
            case "confidence_above":
                return (F.col("pairs") > 0) & (F.col("confidence") >= self.value)
            case "age":
                return F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("first_seen") >= self.value
            case "all" | "any":
                return reduce(and_ if self.kind == "all" else or_, [p.column(as_of) for p in self.parts], F.lit(self.kind == "all"))
        raise ValueError(f"unknown trigger {self.kind!r}")


DEFAULT_TRIGGER = Trigger("all", parts=(Trigger("frequency", 5), Trigger("pairs", 3), Trigger("confidence_above", 0.7)))


def inactive(c: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """Candidates not seen for that long."""
    return c.filter(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_seen") > seconds)


def matched(output: Column, expected: Column, how: str = "exact", threshold: float = 0.85) -> Column:
    """exact, any_case, or overlap (Jaccard of lower-case word sets of at least the threshold). Nulls count as empty."""
    a, b = F.coalesce(output, F.lit("")), F.coalesce(expected, F.lit(""))
    if how == "exact":
        return a == b
    if how == "any_case":
        return F.lower(a) == F.lower(b)
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union >= threshold).otherwise(F.lit(True))


def evaluated(rows: DataFrame, hit: Column, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, precision, recall, f1 of outputs (output, expected): a wrong output that isn't empty is a false positive, a
    missed expected one that isn't empty a false negative."""
    r = rows.select(*(by or []), hit.alias("hit"), (~hit & (F.coalesce("output", F.lit("")) != "")).alias("fp"), (~hit & (F.coalesce("expected", F.lit("")) != "")).alias("fn"))
    c = r.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if("hit").alias("tp"), F.count_if("fp").alias("fp"), F.count_if("fn").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, q = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*(by or []), "n", rounded(ratio(F.col("tp"), F.col("n"))).alias("accuracy"), rounded(p).alias("precision"), rounded(q).alias("recall"), rounded(ratio(2 * p * q, p + q)).alias("f1"))


def compared(teacher: Column, student: Column) -> Column:
    """(retention, speedup, compression, quality) of structs (accuracy, latency_ms, size): quality weighs them 0.5, 0.3, 0.2, speedup and compression up to 10."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    retention, speedup, compression = ratio(student["accuracy"], teacher["accuracy"]), ratio(teacher["latency_ms"], student["latency_ms"]), ratio(teacher["size"], student["size"])
    quality = retention * 0.5 + F.least(speedup / 10, F.lit(1.0)) * 0.3 + F.least(compression / 10, F.lit(1.0)) * 0.2
    return F.struct(retention.alias("retention"), speedup.alias("speedup"), compression.alias("compression"), quality.alias("quality"))


def stale(models: DataFrame, as_of: str, seconds: int, last: str = "last_used") -> DataFrame:
    """models with active: whether each was used within so many seconds before."""
    idle = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(last)
    return models.withColumn("active", F.coalesce(idle <= seconds, F.lit(False)))


def registry_statistics(models: DataFrame) -> DataFrame:
    """models, active, uses (of all), latency and accuracy (means over the active ones; 0 without any)."""
    on = F.col("active")
    mean = lambda c: rounded(F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0)))
    return models.agg(F.count("*").alias("models"), F.count_if(on).alias("active"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), mean("latency").alias("latency"), mean("accuracy").alias("accuracy"))


def turns(requests: DataFrame, models: DataFrame, pattern_: str = "pattern", order: str = "ts") -> DataFrame:
    """requests (their pattern and order) with the model whose turn it is: the models of a pattern (by name) take turns. Requests are numbered
    within hours and the hours' counts summed, so a pattern that a third of the requests have is numbered in pieces."""
    names = models.groupBy(pattern_).agg(F.array_sort(F.collect_set("model")).alias("names"))  # a pattern's few models
    hour = requests.withColumn("_h", F.floor(F.unix_timestamp(order) / 3600))
    local = hour.withColumn("_n", F.row_number().over(W.partitionBy(pattern_, "_h").orderBy(order, *[c for c in requests.columns if c not in (pattern_, order)])) - 1)
    before = hour.groupBy(pattern_, "_h").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(W.partitionBy(pattern_).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = F.col("_n") + F.col("_before")
    return local.join(before, [pattern_, "_h"]).join(names, pattern_).select(*requests.columns, F.get("names", F.pmod(at, F.size("names")).cast("int")).alias("model"))


def best_models(models: DataFrame, by: str = "accuracy") -> DataFrame:
    """One model per pattern of (pattern, model, accuracy, latency, uses): by accuracy, latency or uses; ties by name."""
    order = {"accuracy": F.col("accuracy").desc(), "latency": F.col("latency").asc(), "uses": F.col("uses").desc()}[by]
    return models.withColumn("_p", F.row_number().over(W.partitionBy("pattern").orderBy(order, "model"))).filter("_p = 1").drop("_p")


def training_history(epochs: DataFrame, patience: int = 3, run: str = "run") -> DataFrame:
    """epochs (run, epoch, loss) with best (running least loss), change from the epoch before, and converged (no loss of the
    last `patience` epochs below that of their first). A run is a training run's few epochs."""
    w = W.partitionBy(run).orderBy("epoch")
    last = w.rowsBetween(-(patience - 1), 0)
    enough = F.count("*").over(last) >= patience
    return epochs.select(run, "epoch", "loss", rounded(F.min("loss").over(w)).alias("best"), rounded(F.col("loss") - F.lag("loss").over(w)).alias("change"), (enough & (F.min("loss").over(last) >= F.first("loss").over(last))).alias("converged"))


def improvement(epochs: DataFrame, run: str = "run") -> DataFrame:
    """run, best_epoch, rate = (first loss - last loss) / (epochs - 1), 0 for a single epoch."""
    a = epochs.groupBy(run).agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min_by("loss", "epoch").alias("a"), F.max_by("loss", "epoch").alias("b"), F.count("*").alias("n"))
    return a.select(run, "best_epoch", rounded(F.when(F.col("n") > 1, (F.col("a") - F.col("b")) / (F.col("n") - 1)).otherwise(F.lit(0.0))).alias("rate"))
