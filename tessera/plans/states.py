"""Queries of quantized search, of losses over layers, and of reusing states."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import losses
from ..operators import distill, hidden, search, service
from ..operators.service import previous
from ..registry import query
from ..sources.tables import table
from .base import LOG, log, sql_top
from .vectors import _PAIRS, _pairs, _r, _rows, _sql_codes, _sql_rows, _sql_scale, _sql_soft

# quantized search ----------------------------------------------------------------------------------------------------

_QUANTIZED = {
    "int8": (f"{_sql_codes(127)}::double[]", "list_dot_product(q.c, x.c) / sqrt(list_dot_product(q.c, q.c) * list_dot_product(x.c, x.c))"),
    "int4": (f"{_sql_codes(7)}::double[]", "list_dot_product(q.c, x.c) * q.s * x.s / greatest(64 * q.s * x.s, 1)"),
    "binary": ("list_transform(embedding, lambda v: case when v > 0 then 1.0 else 0.0 end)", "(64 - list_sum(list_transform(list_zip(q.c, x.c), lambda z: abs(z[1] - z[2])))) / 64"),
}


def _register_quantized() -> None:
    for kind, (codes, score) in _QUANTIZED.items():
        sql = f"with x as (select vec_id, {codes} as c, {_sql_scale(7)} as s from embeddings), scored as (select q.vec_id as query_id, x.vec_id as doc_id, round({score}, 6) + 0.0 as score from x as q, x where q.vec_id % 100 = 0) {sql_top('scored', 10)}"

        def run(spark, d, kind=kind):
            docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
            return search.quantized_knn(docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), docs, kind=kind)

        query(sql, f"quantized_knn_{kind}")(run)


_register_quantized()


# losses over layers: a vector's four quarters are its layers ---------------------------------------------------------

_MAPS = f"{_PAIRS}, m as (select vec_id, {_sql_rows('a')} as a, {_sql_rows('b')} as b from p)"
_ATTENTION = "(" + " + ".join(f"list_sum(list_transform(list_zip({_sql_soft(f'a[{i}]', 2.0)}, {_sql_soft(f'b[{i}]', 2.0)}), lambda z: (z[1] - z[2]) ** 2)) / 16" for i in range(1, 5)) + ") / 4"


def _sql_layer(i: int) -> str:
    unit = lambda v: f"list_transform({v}[{i}], lambda x: x / sqrt(list_dot_product({v}[{i}], {v}[{i}])))"
    return f"list_sum(list_transform(list_zip({unit('a')}, {unit('b')}), lambda z: (z[1] - z[2]) ** 2)) / 16"


_FEATURES = "(" + " + ".join(f"{i} * {_sql_layer(i)}" for i in range(1, 5)) + ") / 10"


def _maps(spark, d) -> DataFrame:
    return _pairs(spark, d).select("vec_id", _rows("a").alias("t"), _rows("b").alias("s"))


@query(f"with {_MAPS} select vec_id, round({_ATTENTION}, 12) as attention from m")
def loss_attention_transfer(spark, d):
    return _maps(spark, d).select("vec_id", _r(losses.attention_transfer("t", "s", 2.0), 12).alias("attention"))


@query(f"with {_MAPS} select vec_id, round({_FEATURES}, 9) as features, round({_FEATURES} + 0.5 * {_ATTENTION}, 9) as total from m")
def loss_feature_distillation(spark, d):
    """Later layers weigh more; attention counts half."""
    features = losses.feature_distillation("t", "s", [1.0, 2.0, 3.0, 4.0])
    return _maps(spark, d).select("vec_id", _r(features, 9).alias("features"), _r(features + 0.5 * losses.attention_transfer("t", "s", 2.0), 9).alias("total"))


@query("select kind, i as stage, round(p, 6) as parameters, round(l)::int as layers, round(h)::int as hidden from (select 'linear' as kind, i, 700 + 2000 * (1 - i / 4) as p, 12 + 20 * (1 - i / 4) as l, 768 + 1792 * (1 - i / 4) as h from range(5) r(i) union all select 'shrinking', i, 700 + 2000 * 0.4 ** (i / 4), 12 + 20 * 0.4 ** (i / 4), 768 + 1792 * 0.4 ** (i / 4) from range(5) r(i))")
def distill_model_sizes(spark, d):
    make = lambda kind, decay: distill.model_sizes(spark, (2700.0, 32, 2560), (700.0, 12, 768), 4, decay).select(F.lit(kind).alias("kind"), "*")
    return make("linear", None).unionByName(make("shrinking", 0.6))


# states: of matrices, and what of a text's states another text can reuse ----------------------------------------------


@query(f"with {_MAPS} select vec_id, flatten(list_transform(a[2:3], lambda r: list_transform(r, lambda x: round(x, 6) + 0.0))) as rows, flatten(list_transform(a, lambda r: list_transform(r[5:8], lambda x: round(x, 6) + 0.0))) as columns, 8 as below, 32 as beside, null::double[] as none from m")
def hidden_slices(spark, d):
    """Rows and columns of a state, and the sizes of two states put together."""
    flat = lambda m: F.transform(F.flatten(m), lambda x: _r(x.cast("double")))
    m = _maps(spark, d)
    below, beside = hidden.concatenated("t", "s", 0), hidden.concatenated("t", "s", 1)
    return m.select("vec_id", flat(hidden.sliced("t", 0, 1, 3)).alias("rows"), flat(hidden.sliced("t", 1, 4, 8)).alias("columns"), F.size(below).alias("below"), F.size(beside[0]).alias("beside"), flat(hidden.sliced("t", 0, 3, 9)).alias("none"))


_REUSE = f"""{LOG}, t as (select query_id, text, lag(text) over (partition by client_id order by ts, query_id) as cached from log where text is not null and client_id is not null),
c as (select *, greatest(strlen(text), 1) as a, greatest(strlen(cached), 1) as b, ceil(length(cached) / 4)::int as held, coalesce(list_max(list_filter(range(0, least(length(text), length(cached)) + 1), lambda n: left(text, n) = left(cached, n))), 0) as p from t where cached is not null),
x as (select *, p >= 10 and (starts_with(text, cached) or starts_with(cached, text)) and held >= ceil(least(p, strlen(cached)) / 4) as can_begin, greatest(a / b, b / a) <= 2 and p / least(a, b) >= 0.3 as can_length from c),
s as (select query_id, p, a, b, strlen(text) as ra, strlen(cached) as rb, held, can_begin, can_length, case when can_begin then least(ceil(least(p, rb) / 4)::int, held) else 0 end as t_begin, case when can_begin then least(1, 0.7 * p / a + 0.3 * p / b) else 0 end as q_begin,
case when can_length then least(ceil(p / 4)::int, held) else 0 end as t_length, case when can_length then least(1, (1 - abs(a - b) / greatest(a, b)) * 0.4 + p / least(a, b) * 0.6) else 0 end as q_length from x)"""
_ADAPTIVE = "case when least(ra, rb) > 0 and p / greatest(least(ra, rb), 1) > 0.5 then {0} when a / b between 0.5 and 2 then {1} else {2} end"


@query(
    f"""with {_REUSE} select query_id, t_length as by_length, round(q_length, 6)::double as length_quality, held as by_meaning, case when can_begin then t_begin else held end as hybrid, round(case when can_begin then 0.7 * q_begin + 0.3 * 0.85 else 0.85 end, 6)::double as hybrid_quality,
{_ADAPTIVE.format('t_begin', 't_length', 'held')} as adaptive, round({_ADAPTIVE.format('q_begin', 'q_length', '0.85')}, 6)::double as adaptive_quality from s"""
)
def hidden_reuse_strategies(spark, d):
    """What a question could reuse of the states of its client's question before, by other strategies than a common beginning."""
    asked = log(spark, d).filter("text is not null and client_id is not null").select("query_id", "client_id", "ts", "text")
    t = previous(asked, "client_id", ["ts", "query_id"], "text", "cached").filter("cached is not null")
    held = F.ceil(F.length("cached") / 4).cast("int")
    begin, length, meaning = hidden.reuse("text", "cached", held), hidden.length_reuse("text", "cached", held), hidden.semantic_reuse(F.lit(1.0), held)
    hybrid, adaptive = hidden.hybrid_reuse([(*begin, 0.7), (*meaning, 0.3)]), hidden.adaptive_reuse("text", "cached", begin, length, meaning)
    return t.select("query_id", length[0].alias("by_length"), _r(length[1]).alias("length_quality"), meaning[0].alias("by_meaning"), hybrid[0].alias("hybrid"), _r(hybrid[1]).alias("hybrid_quality"), adaptive[0].alias("adaptive"), _r(adaptive[1]).alias("adaptive_quality"))


@query(f"with {LOG} select query_id, list_reduce(list_prepend(0::hugeint, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::hugeint)), lambda h, c: (h * 31 + c) % 18446744073709551616::hugeint)::varchar as hash from log where text is not null")
def cache_rolling_hashes(spark, d):
    return log(spark, d).filter("text is not null").select("query_id", service.rolling_hash("text").cast("string").alias("hash"))
