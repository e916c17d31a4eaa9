"""Problem 6: oversized texts cut at natural boundaries, with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, one_per_key

#: Characters that end a sentence.
STOPS = ".!?。！？"


def core_pattern(limit: int, overlap: int) -> str:
    """One core piece (without overlap), the strongest boundary first: what is left; the last blank line, sentence end or
    white space that leaves the overlap its room, a blank line or sentence end only if the piece is then no stub; a boundary
    that needs the overlap's room; else (the only group) that many characters."""
    room = limit - overlap
    least = max(1, room // 4)
    bound = f"[{SPACE}{STOPS}]"
    return (
        rf"(?s:.{{1,{room}}}\z"
        rf"|.{{{least},{room}}}(?<=\n[^\S\n]{{0,3}}\n)"
        rf"|.{{{least},{room}}}(?:(?<=[.!?][\"')\]]?)(?=[{SPACE}]|\z)|(?<=[。！？]))"
        rf"|.{{1,{room}}}(?<=[{SPACE}])"
        rf"|.{{1,{room}}}(?<=[{STOPS}])"
        rf"|.{{1,{limit}}}(?:(?<={bound})|(?={bound}|\z))"
        rf"|(.{{1,{room}}}))"
    )


def cores(text: Column | str, limit: int, overlap: int) -> Column:
    return F.regexp_extract_all(text, F.lit(core_pattern(limit, overlap)), F.lit(0))


def is_forced(text: Column | str, limit: int, overlap: int) -> Column:
    """Whether some cut had to fall between any two characters."""
    return F.exists(F.regexp_extract_all(text, F.lit(core_pattern(limit, overlap)), F.lit(1)), lambda x: x != "")


def split_pieces(docs: DataFrame, key: str = "id", text: str = "content", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of at most `limit` characters (code points): key, piece (from 0), start, text, cut. A text within the limit is
    one piece, `whole`; a longer one is cut, each piece after the first beginning with the `overlap` characters before its
    core (fewer where the core needs their room), and is marked `natural`, or `forced` if a cut found no boundary.
    The cores of a record, put together, are its text. Null texts and null keys give no rows; an empty text one empty
    piece. Repeated keys are one record."""
    d = one_per_key(docs.select(F.col(key).alias("key"), F.col(text).alias("body")), "key").filter("body is not null")
    short = F.length("body") <= limit
    d = d.withColumn("cores", F.when(short, F.array("body")).otherwise(cores("body", limit, overlap)))
    d = d.withColumn("cut", F.when(short, "whole").when(is_forced("body", limit, overlap), "forced").otherwise("natural"))
    ends = F.aggregate("cores", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    d = d.withColumn("ends", ends).select("key", "body", "ends", "cut", F.posexplode("cores").alias("piece", "core"))
    at = F.element_at("ends", F.col("piece") + 1)
    back = F.least(F.lit(overlap), at, F.lit(limit) - F.length("core"))
    return d.select(F.col("key").alias(key), "piece", (at - back).alias("start"), F.substring(F.col("body"), at - back + 1, back + F.length("core")).alias("text"), "cut")


def rebuilt(pieces: DataFrame, key: str = "id") -> DataFrame:
    """key, text, pieces, longest, cut of every record, put together again from its pieces; a record's pieces meet in one row."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "start", "text")))
    whole = F.aggregate("parts", F.lit(""), lambda acc, x: F.concat(acc, F.substring(x["text"], F.length(acc) - x["start"] + 1, F.length(x["text"]))))
    r = pieces.groupBy(key).agg(parts.alias("parts"), F.max(F.length("text")).alias("longest"), F.min("cut").alias("cut"))
    return r.select(key, whole.alias("text"), F.size("parts").alias("pieces"), "longest", "cut")
