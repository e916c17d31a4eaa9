"""The training-data queries: pN_found gives the rows that TESTDATA.md defines, the others the operators' full reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import one_per_key, spread, table
from .frequent import heavy_hitters, query_pattern
from .leaks import leaked_items
from .lookalike import look_alike_members, look_alike_pairs, with_canonical
from .packing import pack
from .pairs import defective_pairs
from .pieces import rebuilt, split_pieces
from .similar import similar_classes, similar_pairs
from .vocabulary import marked_vocabulary, term_divergence


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "query_log").select("text")).select(query_pattern("text").alias("query_pattern")).filter("query_pattern != ''")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).select("query_pattern")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Patterns with at least 0.2 % of the questions: the exact count, all rows, and whether the sketch's estimate is as near as its width
    promises (half the least count, four times the noise it was fitted for)."""
    near = F.abs(F.col("estimate") - F.col("n")) <= 0.5 * 0.002 * F.col("rows_total")
    return heavy_hitters(_patterns(spark, d)).select(F.col("value").alias("query_pattern"), "n", "rows_total", near.alias("near"))


def store_records(spark: SparkSession, d: str) -> DataFrame:
    """One row (id, least, text) per record, least being the prf_min_frequency of its collection."""
    configs = table(spark, d, "expansion_configs").filter("collection is not null").groupBy("collection").agg(F.max_by("prf_min_frequency", "config_id").alias("least"))
    default = configs.filter("collection = 'default'").first()  # one row of a table of fixed size
    docs = one_per_key(table(spark, d, "store_docs").select("id", F.element_at("metadata", "collection").alias("collection"), "content"), "id")
    known = docs.join(F.broadcast(configs), "collection", "left")
    return known.select("id", F.coalesce("least", F.lit(default["least"] if default else None).cast("int")).alias("least"), F.col("content").alias("text"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return term_divergence(store_records(spark, d)).withColumn("score", F.round("score", 9))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_scores(spark, d).select("id", "term")


def p3_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return marked_vocabulary(table(spark, d, "store_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_vocabulary(spark, d).filter("mark is not null").select("term", "mark")


#: TESTDATA.md's setting of problem 4.
VERSIONS = {"threshold": 0.6, "width": 3, "least_terms": 20}


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record's class of versions of one text."""
    return similar_classes(table(spark, d, "store_docs"), **VERSIONS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "store_docs"), **VERSIONS)


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return defective_pairs(table(spark, d, "training_examples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_flags(spark, d).select("example_id", "defect")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_pieces(table(spark, d, "store_docs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).filter("cut != 'whole' and piece = 0").select("id", "cut")


def p6_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every record put together again from its pieces, and whether all of them keep the limit."""
    r = rebuilt(p6_pieces(spark, d))
    return r.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("characters"), (F.col("longest") <= 2000).alias("within"), (F.col("pieces") > 1).alias("several"), "cut")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The split documents, out of the packing."""
    return p7_containers(spark, d).filter("parts > 1 and part = 0").select("doc_id")


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """What of each document was packed: tokens, parts, whether the parts lie within containers and follow each other."""
    p = p7_containers(spark, d)
    ok = F.bool_and((F.col("position") >= 0) & (F.col("position") + F.col("size") <= 4096) & (F.col("first_token") == 4096 * F.col("part")))
    return p.groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("parts"), ok.alias("within"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Tokens packed, whether any place is given twice (a container's items follow each other without gap), and whether less than
    two per cent of the containers' room, and one container, is left over."""
    c = p7_containers(spark, d).groupBy("container").agg(F.sum("size").alias("tokens"), F.max(F.col("position") + F.col("size")).alias("end"))
    room = 4096 * F.count("*")
    return c.agg(F.sum("tokens").alias("tokens"), F.bool_and((F.col("tokens") == F.col("end")) & (F.col("end") <= 4096)).alias("disjoint"), (room - F.sum("tokens") <= 0.02 * room + 4096).alias("full"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they hold word for word: how many ten-word windows are equal, and where the first one is."""
    found = leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter("distance = 0").select("doc_id", "item_id", F.col("exact_windows").alias("windows"), F.col("exact_first").alias("first_word"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).select("doc_id", "item_id")


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold about a whole item, with at most two words changed, added or left out."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), window=None, edits=2, recall=0.95).select("doc_id", "item_id", "distance")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each text's class of equal looks: its representative, how many different texts it has, and the copies of this one."""
    return look_alike_members(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text in the one form, case folded."""
    return with_canonical(table(spark, d, "documents").select("doc_id", "text"), to="canonical").select("doc_id", "canonical")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_scores, p3_found, p3_vocabulary, p4_found, p4_classes, p5_found, p5_flags, p6_found, p6_pieces, p6_rebuilt, p7_found, p7_containers, p7_placed, p7_fill, p8_found, p8_report, p8_edited, p9_found, p9_forms, p9_canonical)}
