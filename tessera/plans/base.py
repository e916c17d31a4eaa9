"""The tables as the engine sees them, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import ALNUM, SPACE  # noqa: F401
from ..sources.tables import divisible, latest, table

#: White space and non-alphanumerics as DuckDB's regular expressions have them.
SQL_SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQL_ALNUM = r"\p{L}\p{N}"


def store(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: doc_id, text, title, source, metadata, embedding, created_at, updated_at."""
    return latest(table(spark, d, "store_docs").select(F.col("id").alias("doc_id"), F.col("content").alias("text"), "title", "source", "metadata", "embedding", "created_at", "updated_at"), "doc_id")


def store_queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set of the searches over the store: the records whose key is divisible by 100, asking by title and vector."""
    return store(spark, d).filter(divisible("doc_id")).select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"), "embedding")


def log(spark: SparkSession, d: str) -> DataFrame:
    """One row per question of the log."""
    return latest(table(spark, d, "query_log"), "query_id")


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """Every judgment once."""
    return table(spark, d, "feedback").distinct()


def examples(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "training_examples"), "example_id")


STORE = "store as (select id as doc_id, any_value(content) as text, any_value(title) as title, any_value(source) as source, any_value(metadata) as metadata, any_value(embedding)::double[] as embedding, any_value(created_at) as created_at, any_value(updated_at) as updated_at from store_docs where id is not null group by id)"
ASKED = "asked as (select doc_id as query_id, title as text, embedding from store where ('0x' || doc_id)::ubigint % 100 = 0)"
LOG = "log as (select query_id, any_value(text) as text, any_value(answer) as answer, any_value(confidence)::double as confidence, any_value(filters) as filters, any_value(client_id) as client_id, any_value(ts) as ts, any_value(ingested_at) as ingested_at from query_log where query_id is not null group by query_id)"
JUDGMENTS = "judgments as (select distinct * from feedback)"
EXAMPLES = "examples as (select example_id, any_value(input) as input, any_value(output) as output, any_value(confidence)::double as confidence, any_value(collected_at) as collected_at from training_examples where example_id is not null group by example_id)"


def sql_terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[{SQL_ALNUM}]+'), lambda w: strlen(w) > 1)"


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{SQL_SPACE}]+')"


def sql_bare(text: str) -> str:
    return f"list_filter(list_transform({sql_words(text)}, lambda w: lower(regexp_replace(w, '[^{SQL_ALNUM}]+', '', 'g'))), lambda w: w != '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')"


def sql_sentences(text: str, stops: str = ".!?") -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[{stops}]'), lambda s: {sql_strip('s')}), lambda s: s != '')"


def sql_strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_top(source: str, k: int, columns: str = "query_id, doc_id, score", where: str = "true", key: str = "query_id", order: str = "score desc, doc_id") -> str:
    """select: the k best rows of each key of `source`, with rank."""
    return f"select {columns}, row_number() over (partition by {key} order by {order}) - 1 as rank from {source} where score is not null and {where} qualify row_number() over (partition by {key} order by {order}) <= {k}"
