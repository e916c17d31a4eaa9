"""Drafts from search results, and their checking by rules and by staged verification. One row per query; a draft's context is
its result list, bounded by the search's k, so it rides along as an array."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import let, sentences, words
from ..functions.vectors import clamp
from .ranking import rounded

# Signs of uncertainty.
UNCERTAIN = ["maybe", "might", "possibly", "i think", "not sure", "uncertain"]
# Negations, looked for as substrings.
NEGATIONS = ["not", "never", "no", "none", "neither", "without", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "cannot", "couldn't"]
# Verbs that part a subject from what is said of it.
MARKERS = ["is", "are", "was", "were"]
NO_RESULT = "No relevant information found."


def drafts(queries: DataFrame, results: DataFrame, texts: int = 3) -> DataFrame:
    """query_id, query_text, content (the first `texts` results' texts joined by blanks), confidence (mean of all scores),
    context (all texts by rank), scores. A query without results has a fixed text, confidence 0 and an empty context."""
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"), "score"))).alias("r"))
    q = queries.select("query_id", F.col("text").alias("query_text")).join(listed, "query_id", "left")
    none = F.col("r").isNull()
    context = F.when(none, F.array().cast("array<string>")).otherwise(F.transform("r", lambda x: x["text"]))
    scores = F.when(none, F.array().cast("array<double>")).otherwise(F.transform("r", lambda x: x["score"]))
    q = q.select("query_id", "query_text", context.alias("context"), scores.alias("scores"))
    content = F.when(F.size("context") > 0, F.array_join(F.slice("context", 1, texts), " ")).otherwise(F.lit(NO_RESULT))
    return q.select("query_id", "query_text", content.alias("content"), mean("scores").alias("confidence"), "context", "scores")


def mean(values: Column | str) -> Column:
    """Of an array; 0 if it is empty."""
    v = F.col(values) if isinstance(values, str) else values
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)).otherwise(F.lit(0.0))


def _long(text: Column, bytes_: int) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: F.octet_length(w) > bytes_))


def issues(content: Column, context: Column) -> Column:
    """What a rule finds wrong with a draft. The overlap with the context is of words of more than four bytes, case kept."""
    mine, theirs = _long(content, 4), _long(F.array_join(context, " "), 4)
    overlap = F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, theirs)) / F.size(mine)).otherwise(F.lit(0.0))
    found = [
        F.when(F.octet_length(content) < 10, F.lit("Draft is too short")),
        F.when((F.size(context) > 0) & (overlap < 0.1), F.lit("Draft does not appear to use information from context")),
        *[F.when(F.contains(F.lower(content), F.lit(m)), F.lit(f"Draft contains uncertainty marker: '{m}'")) for m in UNCERTAIN],
    ]
    return F.when(F.trim(content) == "", F.array(F.lit("Draft is empty"))).otherwise(F.array_compact(F.array(*found)))


def speculated(d: DataFrame, accept: float = 0.9, reject: float = 0.3) -> DataFrame:
    """Drafts with issues, speculation (its confidence) and decision: accept, revise or reject."""
    d = d.withColumn("issues", issues(F.col("content"), F.col("context")))
    boost = F.when(F.size("context") > 0, (mean("scores") - 0.5) * 0.3).otherwise(F.lit(0.0))
    confidence = clamp(1.0 - F.size("issues") * 0.15 + (F.col("confidence") - 0.5) * 0.2 + boost)
    d = d.withColumn("speculation", rounded(F.when(F.trim("content") == "", F.lit(0.0)).otherwise(confidence)))
    return d.withColumn("decision", F.when(F.col("speculation") >= accept, "accept").when(F.col("speculation") <= reject, "reject").otherwise("revise"))


def revised(d: DataFrame) -> DataFrame:
    """content and confidence of drafts as revision makes them: the first 100 characters of three context texts before, the
    issues as a note behind; the confidence is that of the speculation plus 0.1, not clamped."""
    note = F.when(F.size("issues") > 0, F.concat(F.lit("\n\n[Revision notes: "), F.array_join("issues", "; "), F.lit("]"))).otherwise(F.lit(""))
    summary = F.array_join(F.transform(F.slice("context", 1, 3), lambda t: F.substring(t, 1, 100)), " ... ")
    content = F.when(F.size("context") > 0, F.concat(F.lit("Based on the available information: "), summary, F.lit("\n\n"), "content", note)).otherwise(F.concat("content", note))
    return d.withColumn("content", content).withColumn("confidence", F.col("speculation") + 0.1)


# verification stages: each gives (confidence, whether to go on) --------------------------------------------------------


def keyword_stage(content: Column, context: Column, least: float = 0.1) -> tuple[Column, Column]:
    """Share of the draft's words (more than three bytes, any case) that the context has."""
    mine, theirs = _long(F.lower(content), 3), _long(F.lower(F.array_join(context, " ")), 3)
    share = F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, theirs)) / F.size(mine)).otherwise(F.lit(0.0))
    confidence = F.when(F.size(context) == 0, F.lit(0.5)).otherwise(share)
    return confidence, (F.size(context) == 0) | (F.size(mine) == 0) | (confidence >= least)


def ngram_stage(content: Column, context: Column, least: float = 0.5) -> tuple[Column, Column]:
    """Jaccard similarity of the sets of character 3-, 4- and 5-grams, weighed 0.2, 0.3, 0.5."""
    value = _gram_similarity(content, F.array_join(context, " "))
    confidence = F.when(F.size(context) == 0, F.lit(0.5)).otherwise(clamp(value))
    return confidence, (F.size(context) == 0) | (confidence >= least)


@F.pandas_udf(DoubleType())
def _gram_similarity(content: pd.Series, context: pd.Series) -> pd.Series:
    """A context has tens of thousands of n-grams; a window of a column expression would walk the text for each of them."""
    out = []
    for a, b in zip(content.fillna(""), context.fillna("")):
        a, b, value = a.lower(), b.lower(), 0.0
        for n, w in ((3, 0.2), (4, 0.3), (5, 0.5)):
            x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
            if x and y:
                both = len(x & y)
                value += w * both / (len(x) + len(y) - both)
        out.append(value)
    return pd.Series(out, dtype="float64")


def assertions(text: Column) -> Column:
    """(subject, said, negated) around the first ` is `, ` are `, ` was `, ` were ` of each sentence of five bytes or more."""
    low = F.filter(F.transform(sentences(text), F.lower), lambda s: F.octet_length(s) >= 5)

    def around(s: Column) -> Column:
        parts = []
        for m in MARKERS:
            at = F.locate(f" {m} ", s)
            subject, said = F.trim(F.substring(s, F.lit(1), at - 1)), F.trim(F.substring(s, at + len(m) + 2, F.length(s)))
            negated = F.coalesce(said.rlike("|".join(NEGATIONS)), F.lit(False))
            parts.append(F.when((at > 0) & (subject != "") & (said != ""), F.struct(subject.alias("subject"), said.alias("said"), negated.alias("negated"))))
        return F.array_compact(F.array(*parts))

    return F.flatten(F.transform(low, around))


def factual_stage(content: Column, context: Column, penalty: float = 0.2) -> tuple[Column, Column]:
    """Assertions of the draft supported and contradicted by those of the context: same or containing subject, a shared word
    as substring, same or opposite polarity."""

    def count(mine: Column, theirs: Column, same: bool) -> Column:
        fits = lambda p, q: (F.contains(p["subject"], q["subject"]) | F.contains(q["subject"], p["subject"])) & ((p["negated"] == q["negated"]) if same else (p["negated"] != q["negated"])) & F.exists(words(p["said"]), lambda w: F.contains(q["said"], w))
        return F.aggregate(mine, F.lit(0), lambda acc, p: acc + F.size(F.filter(theirs, lambda q: fits(p, q))))

    def judge(mine: Column, theirs: Column) -> Column:
        def value(n: Column) -> Column:
            good, bad = n["good"], n["bad"]
            base = F.when(good + bad > 0, good / (good + bad)).otherwise(F.lit(0.6))
            return clamp(base - bad * penalty)

        return F.when(F.size(mine) == 0, F.lit(0.7)).otherwise(let(F.struct(count(mine, theirs, True).alias("good"), count(mine, theirs, False).alias("bad")), value))

    found = let(assertions(content), lambda a: let(assertions(F.array_join(context, " ")), lambda b: judge(a, b)))
    confidence = F.when(F.size(context) == 0, F.lit(0.5)).otherwise(found)
    return confidence, F.lit(True)


STAGES = {"keyword": keyword_stage, "ngram": ngram_stage, "factual": factual_stage}


def verified(d: DataFrame, stages: tuple[str, ...] = ("keyword", "ngram", "factual"), method: str = "average", accept: float = 0.95, reject: float = 0.1) -> DataFrame:
    """Drafts with ran (confidences of the stages that ran), verification and verdict. A stage stops the run if it says so or
    its confidence is at least `accept` or at most `reject`. method: average, minimum, maximum, weighted (by place) or last."""
    for s in stages:
        confidence, on = STAGES[s](F.col("content"), F.col("context"))
        d = d.withColumn(f"_{s}", F.struct(rounded(confidence).alias("c"), on.alias("on")))
    every = F.array(*[F.col(f"_{s}") for s in stages])
    stops = lambda x: ~x["on"] | (x["c"] >= accept) | (x["c"] <= reject)
    d = d.withColumn("_all", every)
    last = F.array_min(F.filter(F.transform("_all", lambda x, i: F.when(stops(x), i)), lambda i: i.isNotNull()))
    d = d.withColumn("ran", F.transform(F.slice("_all", F.lit(1), F.coalesce(last + 1, F.lit(len(stages)))), lambda x: x["c"])).drop("_all", *[f"_{s}" for s in stages])
    return d.withColumn("verification", rounded(aggregated("ran", method))).withColumn("verdict", F.when(F.col("verification") >= accept, "accept").when(F.col("verification") <= reject, "reject").otherwise("revise"))


def aggregated(values: str, method: str) -> Column:
    """0.5 without values."""
    v = F.col(values)
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x) / (F.size(v) * (F.size(v) + 1) / 2)
    pick = {"average": mean(v), "minimum": F.array_min(v), "maximum": F.array_max(v), "weighted": weighted, "last": F.element_at(v, -1)}[method]
    return F.when(F.size(v) > 0, pick).otherwise(F.lit(0.5))


def supported(draft: Column | str, context: Column | str) -> Column:
    """How far a draft's long words (over three bytes, lower case) are the context's: half plus half their share; a half where either has none."""
    long = lambda x: F.array_distinct(F.filter(words(F.lower(x)), lambda w: F.octet_length(w) > 3))
    mine, theirs = long(draft), long(context)
    return F.when((F.size(mine) == 0) | (F.size(theirs) == 0), 0.5).otherwise(0.5 + 0.5 * F.size(F.array_intersect(mine, theirs)) / F.size(mine))
