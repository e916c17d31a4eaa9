"""Query expansion and reformulation. Rules on one query are column expressions; feedback from results is an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ALNUM, ENDINGS, STOP_WORDS, array_ngrams, column, let, literals, stem, strip, words
from .ranking import first_rows, rounded

# Synonyms.
SYNONYMS = {
    "search": ["find", "query", "lookup"],
    "machine": ["computer", "device", "system"],
    "learning": ["training", "education"],
    "algorithm": ["method", "procedure", "technique"],
    "data": ["information", "records"],
    "fast": ["quick", "rapid", "speedy"],
    "big": ["large", "huge", "massive"],
    "small": ["tiny", "little", "compact"],
    "error": ["mistake", "fault", "bug"],
    "function": ["method", "procedure", "routine"],
    "create": ["make", "build", "generate"],
    "delete": ["remove", "erase", "drop"],
    "update": ["modify", "change", "edit"],
    "retrieve": ["fetch", "get", "obtain"],
    "store": ["save", "keep", "persist"],
    "process": ["handle", "manage", "execute"],
}
# Separators of sub-queries, applied in this order.
SEPARATORS = [" and ", " or ", " but ", " versus ", " vs ", " compared to ", "? ", ". ", "; ", " - "]


def _appended(text: Column, extra: Column) -> Column:
    return F.when(F.size(extra) > 0, F.concat_ws(" ", text, F.array_join(extra, " "))).otherwise(text)


def synonym_terms(text: Column | str, most: int = 5, dictionary: dict[str, list[str]] = SYNONYMS) -> Column:
    """Synonyms of the words in order, at most `most` for each word."""
    table = F.create_map(*[x for k, v in dictionary.items() for x in (F.lit(k), literals(v))])
    return F.flatten(F.transform(words(text), lambda w: F.slice(F.coalesce(F.element_at(table, F.lower(w)), F.array().cast("array<string>")), 1, most)))


def expand_synonyms(text: Column | str, most: int = 5, dictionary: dict[str, list[str]] = SYNONYMS) -> Column:
    """The text with its synonyms appended; null stays null."""
    t = column(text)
    return _appended(t, synonym_terms(t, most, dictionary))


def stem_terms(text: Column | str, most: int = 5) -> Column:
    """For each word its stem (if that differs) and the stem's first two forms (if they differ from the word), at most `most`
    per word on average."""
    pairs = F.transform(words(text), lambda w: F.struct(F.lower(w).alias("w"), stem(w).alias("s")))
    first = lambda x: F.transform(literals(ENDINGS[1:3]), lambda e: F.concat(x["s"], e))  # noqa: E731 (the first form is the stem)
    each = lambda x: F.filter(F.concat(F.array(x["s"]), first(x)), lambda f: f != x["w"])
    return let(pairs, lambda ps: F.slice(F.flatten(F.transform(ps, each)), F.lit(1), F.greatest(F.lit(1), F.size(ps) * most)))


def expand_stems(text: Column | str, most: int = 5) -> Column:
    t = column(text)
    return _appended(t, stem_terms(t, most))


def stemmed(text: Column | str) -> Column:
    """All words replaced by their stems."""
    return F.array_join(F.transform(words(text), stem), " ")


def _first_of_any_case(pieces: Column, but: Column | None = None) -> Column:
    """Elements without later repeats in any case, and without `but`."""
    paired = F.transform(pieces, lambda g: F.struct(F.lower(g).alias("k"), g.alias("g")))
    if but is not None:
        paired = let(but, lambda b: F.filter(paired, lambda x: x["k"] != b))
    seen = lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x))
    return F.transform(F.aggregate(paired, F.array().cast("array<struct<k:string,g:string>>"), seen), lambda x: x["g"])


def ngram_terms(text: Column | str, least: int = 2, longest: int = 3, most: int = 5) -> Column:
    """Word n-grams, then the first three character trigrams of each word of four bytes or more, without repeats in any case
    and without the text itself, at most `most`. A text of fewer words than n is its own only n-gram."""
    t = column(text)
    return let(words(t), lambda ws: _ngram_terms(t, ws, least, longest, most))


def _ngram_terms(t: Column, ws: Column, least: int, longest: int, most: int) -> Column:
    grams = F.flatten(F.array(*[F.when(F.size(ws) < n, F.array(t)).otherwise(array_ngrams(ws, n)) for n in range(least, longest + 1)]))
    long = F.filter(ws, lambda w: F.octet_length(w) >= 4)
    # a word of fewer than three characters (but four bytes) has no trigram
    trigram = lambda w: F.transform(F.filter(literals([1, 2, 3]), lambda i: i + 2 <= F.length(w)), lambda i: F.substring(w, i, F.lit(3)))
    pieces = F.concat(grams, F.flatten(F.transform(long, trigram)))
    return F.slice(_first_of_any_case(pieces, F.lower(t)), 1, most)


def expand_ngrams(text: Column | str, least: int = 2, longest: int = 3, most: int = 5) -> Column:
    t = column(text)
    return _appended(t, ngram_terms(t, least, longest, most))


def composite_terms(*lists: Column) -> Column:
    """Terms of several expanders, without repeats in any case, first come first."""
    return _first_of_any_case(F.concat(*lists))


def simplify(text: Column | str) -> Column:
    """Without stop words and one-byte words; the text itself if nothing is left."""
    t = column(text)
    kept = F.filter(words(t), lambda w: (F.octet_length(w) > 1) & ~F.array_contains(literals(STOP_WORDS), F.lower(w)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(t)


def clarify(text: Column | str, context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws(" ", column(text), context)).otherwise(column(text))


def _split_at(separator: str):
    return lambda p: F.transform(F.split(p, f"\\Q{separator}\\E"), strip)


def decompose(text: Column | str) -> Column:
    """Sub-queries between the separators, trimmed, of more than two bytes; the text itself if there are none."""
    t = column(text)
    parts = F.array(t)
    for s in SEPARATORS:
        parts = F.filter(F.flatten(F.transform(parts, _split_at(s))), lambda p: p != "")
    parts = F.filter(parts, lambda p: F.octet_length(p) > 2)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(t))


def as_question(text: Column | str) -> Column:
    t = column(text)
    s = strip(t)
    asks = F.lower(s).rlike("^(how to |what is |what are )")
    return F.when(F.endswith(s, F.lit("?")), t).when(asks, F.concat(s, F.lit("?"))).otherwise(F.concat(F.lit("What is "), s, F.lit("?")))


def _result_terms(results: DataFrame, documents: int) -> DataFrame:
    """query_id, query_text, rank, score, term of the first results, without the query's own words."""
    own = words(F.lower("query_text"))
    trimmed = lambda w: F.regexp_replace(w, f"^[^{ALNUM}]+|[^{ALNUM}]+$", "")
    first = results.filter(F.col("rank") < documents).select("query_id", "query_text", "rank", "score", F.explode(F.transform(words(F.lower("text")), trimmed)).alias("term"))
    return first.filter((F.octet_length("term") > 2) & ~F.array_contains(own, F.col("term")))


def feedback_terms(results: DataFrame, documents: int = 3, most: int = 5) -> DataFrame:
    """query_id, term, score, place: terms of the first results (query_id, query_text, rank, score, text), each occurrence
    weighing score / (rank + 1), without stop words and the query's words; the best `most`, ties by term."""
    ts = _result_terms(results, documents).filter(~F.col("term").isin(STOP_WORDS))
    scored = ts.groupBy("query_id", "term").agg(rounded(F.sum(F.col("score") / (F.col("rank") + 1))).alias("score"))
    return first_rows(scored, ["query_id"], [F.col("score").desc(), "term"], most, "place")


def frequent_terms(results: DataFrame, documents: int = 3, least: int = 2, most: int = 5) -> DataFrame:
    """query_id, term, n, place: terms that occur at least `least` times in the first results; the most frequent `most`."""
    counted = _result_terms(results, documents).groupBy("query_id", "term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return first_rows(counted, ["query_id"], [F.col("n").desc(), "term"], most, "place")


def reformulated(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, text with the terms of feedback_terms or frequent_terms appended in order (at most a few per query)."""
    extra = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("extra"))
    return queries.join(extra, "query_id", "left").select("query_id", _appended(F.col("text"), F.coalesce("extra", F.array().cast("array<string>"))).alias("text"))
