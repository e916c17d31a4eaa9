"""Queries of vector functions, quantization, losses and hidden states. Neighbouring vectors (vec_id and the next) are the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import losses, vectors as V
from ..functions import embedding
from ..operators import hidden, speculative
from ..operators.ranking import rounded
from ..operators.service import previous
from ..registry import query
from ..sources.tables import table
from .base import LOG, log, sql_words

_PAIRS = "p as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b, a.label from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _pairs(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a"), "label").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def _r(x: Column, digits: int = 6) -> Column:
    return rounded(x, digits)


_DOT = "list_dot_product(a, b)"
_NA, _NB = "sqrt(list_dot_product(a, a))", "sqrt(list_dot_product(b, b))"
_D2 = "list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) ** 2))"


@query(f"with {_PAIRS} select vec_id, round({_DOT}, 6) + 0.0 as dot, round({_DOT} / ({_NA} * {_NB}), 6) + 0.0 as cosine, round(1 / (1 + sqrt({_D2})), 6) as euclidean from p")
def vector_similarities(spark, d):
    return _pairs(spark, d).select("vec_id", _r(V.dot("a", "b")).alias("dot"), _r(V.cosine("a", "b")).alias("cosine"), _r(V.euclidean_similarity("a", "b")).alias("euclidean"))


@query("select vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) + 0.0) as unit from embeddings")
def vector_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.normalize("embedding"), lambda x: _r(x)).alias("unit"))


def _sql_codes(levels: int, v: str = "embedding") -> str:
    return f"list_transform({v}, lambda x: greatest(-{levels}, least({levels}, round(x::double / (list_max(list_transform({v}, lambda y: abs(y::double))) / {levels}))))::int)"


def _sql_scale(levels: int, v: str = "embedding") -> str:
    return f"(list_max(list_transform({v}, lambda y: abs(y::double))) / {levels})"


@query(f"select vec_id, round({_sql_scale(127)}, 9) as scale, {_sql_codes(127)} as codes from embeddings")
def quantize_int8(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", V.quantize("embedding", 127).alias("q"))
    return q.select("vec_id", _r(F.col("q.scale"), 9).alias("scale"), F.col("q.codes").alias("codes"))


@query(f"with c as (select vec_id, {_sql_codes(7)} as c from embeddings) select vec_id, list_transform(range(0, 32), lambda i: (c[2 * i + 1] + 8) * 16 + c[2 * i + 2] + 8) as packed from c")
def quantize_int4_packed(spark, d):
    """Two codes in a byte, the first in the high half, each plus 8."""
    q = table(spark, d, "embeddings").select("vec_id", V.quantize("embedding", 7)["codes"].alias("c"))
    half = F.sequence(F.lit(0), F.ceil(F.size("c") / 2).cast("int") - 1)
    return q.select("vec_id", F.transform(half, lambda i: (F.get("c", 2 * i) + 8) * 16 + F.coalesce(F.get("c", 2 * i + 1), F.lit(-8)) + 8).alias("packed"))


def _sql_error(levels: int) -> str:
    back = f"list_transform(c, lambda q: q * s)"
    return f"with c as (select vec_id, embedding::double[] as v, {_sql_codes(levels)} as c, {_sql_scale(levels)} as s from embeddings), e as (select vec_id, list_dot_product(v, v) as power, list_sum(list_transform(list_zip(v, {back}), lambda z: (z[1] - z[2]) ** 2)) as noise from c) select vec_id, round(noise / 64, 9) as mse, round(10 * log10(power / noise), 4) as snr_db from e"


def _error(levels: int):
    def run(spark, d):
        q = table(spark, d, "embeddings").select("vec_id", "embedding", V.quantize("embedding", levels).alias("q"))
        back = q.select("vec_id", "embedding", V.dequantize(F.col("q.scale"), F.col("q.codes")).alias("back"))
        return back.select("vec_id", _r(V.mse("embedding", "back"), 9).alias("mse"), _r(V.snr_db("embedding", "back"), 4).alias("snr_db"))

    return run


query(_sql_error(127), "quantize_int8_error")(_error(127))
query(_sql_error(7), "quantize_int4_error")(_error(7))


@query(f"with {_PAIRS} select vec_id, len(list_filter(list_zip(a, b), lambda z: (z[1] > 0) != (z[2] > 0)))::int as hamming, round(1 - len(list_filter(list_zip(a, b), lambda z: (z[1] > 0) != (z[2] > 0))) / 64, 6) as similarity from p")
def quantize_binary(spark, d):
    h = V.hamming(V.binary_words("a"), V.binary_words("b"))
    return _pairs(spark, d).select("vec_id", h.alias("hamming"), _r(1 - h / F.size("a")).alias("similarity"))


@query("select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1.0::double else -1.0::double end) as back, round(list_sum(list_transform(embedding, lambda x: (x::double - case when x > 0 then 1.0::double else -1.0::double end) ** 2)) / 64, 9) as mse from embeddings")
def quantize_binary_back(spark, d):
    """Vectors of signs, out of the packed words, and how far they are from the vectors."""
    q = table(spark, d, "embeddings").select("vec_id", "embedding", V.binary_dequantize(V.binary_words("embedding"), F.size("embedding")).alias("back"))
    return q.select("vec_id", "back", _r(V.mse("embedding", "back"), 9).alias("mse"))


@query(f"with {_PAIRS}, c as (select vec_id, {_sql_codes(127, 'a')}::double[] as a8, {_sql_codes(127, 'b')}::double[] as b8, {_sql_codes(7, 'a')}::double[] as a4, {_sql_codes(7, 'b')}::double[] as b4, {_sql_scale(7, 'a')} as sa, {_sql_scale(7, 'b')} as sb from p) select vec_id, round(list_dot_product(a8, b8) / sqrt(list_dot_product(a8, a8) * list_dot_product(b8, b8)), 6) + 0.0 as int8_cosine, round(list_dot_product(a4, b4) * sa * sb / greatest(64 * sa * sb, 1), 6) + 0.0 as int4_dot from c")
def quantized_similarity(spark, d):
    c = _pairs(spark, d).select("vec_id", *[V.quantize(x, n).alias(f"{x}{k}") for x in "ab" for n, k in ((127, 8), (7, 4))])
    scale = F.col("a4.scale") * F.col("b4.scale")
    return c.select("vec_id", _r(V.cosine("a8.codes", "b8.codes")).alias("int8_cosine"), _r(V.dot("a4.codes", "b4.codes") * scale / F.greatest(F.size("a4.codes") * scale, F.lit(1.0))).alias("int4_dot"))


@query("select 'float32' as kind, count(*) * 64 * 4 as bytes, 1.0::double as ratio from embeddings union all select 'int8', count(*) * 64, 4.0 from embeddings union all select 'int4', count(*) * 32, 8.0 from embeddings union all select 'binary', count(*) * 8, 32.0 from embeddings")
def quantize_sizes(spark, d):
    n = table(spark, d, "embeddings").agg(F.sum(F.size("embedding")).alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(r)).alias("ratio")) for k, r in (("float32", 1), ("int8", 4), ("int4", 8), ("binary", 32))])
    return n.select("n", F.inline(kinds)).select("kind", F.ceil(F.col("n") * 4 / F.col("ratio")).alias("bytes"), "ratio")


# losses --------------------------------------------------------------------------------------------------------------


def _sql_soft(v: str, t: float) -> str:
    return f"list_transform({v}, lambda x: exp((x - list_max({v})) / {t}) / list_sum(list_transform({v}, lambda y: exp((y - list_max({v})) / {t}))))"


def _sql_log(v: str, t: float) -> str:
    return f"list_transform({v}, lambda x: (x - list_max({v})) / {t} - ln(list_sum(list_transform({v}, lambda y: exp((y - list_max({v})) / {t})))))"


@query(f"with {_PAIRS}, s as (select vec_id, a, b, {_sql_soft('a', 2.0)} as p, {_sql_log('b', 2.0)} as q from p) select vec_id, round(4 * list_sum(list_transform(list_zip(p, q), lambda z: z[1] * (ln(z[1]) - z[2]))), 6) + 0.0 as kl, round(-4 * list_dot_product(p, q), 6) as soft, round({_D2} / 64, 6) as mse, round(1 - {_DOT} / ({_NA} * {_NB}), 6) as cosine from s")
def loss_distillation(spark, d):
    return _pairs(spark, d).select("vec_id", _r(losses.kl("a", "b", 2.0)).alias("kl"), _r(losses.soft_target("a", "b", 2.0)).alias("soft"), _r(losses.squared("a", "b")).alias("mse"), _r(losses.cosine_loss("a", "b")).alias("cosine"))


@query(f"with {_PAIRS} select vec_id, round(-({_sql_log('b', 1.0)})[label + 1], 6) as hard, round(0.7 * {_D2} / 64 - 0.3 * ({_sql_log('b', 1.0)})[label + 1], 6) as combined from p")
def loss_hard_and_combined(spark, d):
    y = F.transform(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    p = _pairs(spark, d).withColumn("y", y)
    hard = losses.hard_target("y", "b")
    return p.select("vec_id", _r(hard).alias("hard"), _r(losses.combined([(losses.squared("a", "b"), 0.7), (hard, 0.3)])).alias("combined"))


@query(f"with {_PAIRS} select vec_id, round({_D2} / 64, 6) as mse, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / 64, 6) as l1, round(1 - greatest(-1, least(1, {_DOT} / ({_NA} * {_NB}))), 6) as cosine, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] ** 2 / list_dot_product(a, a) - z[2] ** 2 / list_dot_product(b, b)) ** 2)) / 64, 9) as attention from p")
def loss_feature(spark, d):
    return _pairs(spark, d).select("vec_id", *[_r(losses.feature(k, "a", "b"), 9 if k == "attention" else 6).alias(k) for k in ("mse", "l1", "cosine", "attention")])


def _sql_rows(v: str) -> str:
    return f"[{v}[1:16], {v}[17:32], {v}[33:48], {v}[49:64]]"


@query(f"with {_PAIRS}, r as (select vec_id, {_sql_rows('a')} as a, {_sql_rows('b')} as b from p), g as (select vec_id, flatten(list_transform(a, lambda x: list_transform(a, lambda y: list_dot_product(x, y) / 64))) as a, flatten(list_transform(b, lambda x: list_transform(b, lambda y: list_dot_product(x, y) / 64))) as b from r) select vec_id, round({_D2} / 16, 12) as gram_loss from g")
def loss_gram(spark, d):
    return _pairs(spark, d).select("vec_id", _r(losses.gram_loss(_rows("a"), _rows("b")), 12).alias("gram_loss"))


def _rows(v: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 16 + 1, F.lit(16)))


@query(f"with {_PAIRS} select count(*) as pairs, round(avg(case when list_position(a, list_max(a)) = list_position(b, list_max(b)) then 1.0 else 0.0 end), 6) as agreement, round(avg({_D2} / 64), 6) as mse from p")
def student_evaluation(spark, d):
    """How often teacher and student have the same greatest logit, and their mean squared difference."""
    same = F.when(V.argmax("a") == V.argmax("b"), 1.0).otherwise(0.0)
    return _pairs(spark, d).agg(F.count("*").alias("pairs"), _r(F.avg(same)).alias("agreement"), _r(F.avg(V.mse("a", "b"))).alias("mse"))


# hidden states -------------------------------------------------------------------------------------------------------


@query(f"with r as (select vec_id, {_sql_rows('(embedding::double[])')} as s from embeddings) select vec_id, list_transform(range(1, 17), lambda i: round((s[1][i] + s[2][i] + s[3][i] + s[4][i]) / 4, 6) + 0.0) as mean, list_transform(range(1, 17), lambda i: round(greatest(s[1][i], s[2][i], s[3][i], s[4][i]), 6) + 0.0) as max, list_transform(s[1], lambda x: round(x, 6) + 0.0) as cls from r")
def hidden_pooling(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", _rows("embedding").alias("s"))
    return s.select("vec_id", *[F.transform(hidden.pool("s", how), lambda x: _r(x)).alias(how) for how in ("mean", "max", "cls")])


def _states(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("other"), F.posexplode(_rows("embedding")).alias("layer", "vec"))


_LAYERS = f"{_PAIRS}, l as (select vec_id as left_id, vec_id + 1 as right_id, i as layer, list_dot_product(a[i * 16 + 1 : i * 16 + 16], b[i * 16 + 1 : i * 16 + 16]) / sqrt(list_dot_product(a[i * 16 + 1 : i * 16 + 16], a[i * 16 + 1 : i * 16 + 16]) * list_dot_product(b[i * 16 + 1 : i * 16 + 16], b[i * 16 + 1 : i * 16 + 16])) as similarity from p, range(4) r(i))"


@query(f"with {_LAYERS} select left_id, right_id, layer, round(similarity, 6) + 0.0 as similarity from l")
def hidden_layer_similarity(spark, d):
    s = _states(spark, d)
    return hidden.layer_similarity(s, s).withColumn("similarity", _r(F.col("similarity")))


@query(f"with {_LAYERS} select left_id, right_id, round(sum(similarity * (layer + 1)) / 10, 6) + 0.0 as similarity from l group by all")
def hidden_weighted_similarity(spark, d):
    s = _states(spark, d)
    return hidden.average_similarity(hidden.layer_similarity(s, s), F.col("layer") + 1.0).withColumn("similarity", _r(F.col("similarity")))


@query(f"with {_LAYERS}, r as (select left_id as id, layer, round(similarity, 6) + 0.0 as similarity from l where round(similarity, 6) < 0.5) select *, row_number() over (partition by id order by similarity, layer) - 1 as place from r")
def hidden_divergence(spark, d):
    s = _states(spark, d)
    return hidden.divergences(hidden.layer_similarity(s, s).withColumn("similarity", _r(F.col("similarity"))))


@query(f"with {_LAYERS}, m as (select left_id as id, max(similarity) as s, bool_or(similarity < 0.5) as d from l group by 1) select id, case when s >= 0.7 then case when d then 'revise' else 'accept' end when s >= 0.35 then 'revise' else 'reject' end as decision, round(case when s >= 0.7 and d then s * 0.9 else s end, 6) + 0.0 as confidence from m")
def hidden_verify(spark, d):
    s = _states(spark, d)
    m = hidden.layer_similarity(s, s).groupBy(F.col("left_id").alias("id")).agg(F.max("similarity").alias("s"), F.bool_or(F.col("similarity") < 0.5).alias("d"))
    decision, confidence = hidden.verdict(F.col("s"), F.col("d"))
    return m.select("id", decision.alias("decision"), _r(confidence).alias("confidence"))


@query(f"with {_LAYERS} select layer, count(*) as n, round(avg(similarity), 6) + 0.0 as similarity from l where layer >= 2 group by 1")
def hidden_last_layers(spark, d):
    s = _states(spark, d)
    return hidden.layers(hidden.layer_similarity(s, s), "last", 2, 4).groupBy("layer").agg(F.count("*").alias("n"), _r(F.avg("similarity")).alias("similarity"))


@query(
    f"""with {LOG}, t as (select query_id, text, lag(text) over (partition by client_id order by ts, query_id) as cached from log where text is not null and client_id is not null), c as (select *, case when starts_with(text, cached) then length(cached) when starts_with(cached, text) then length(text) else 0 end as n from t where cached is not null),
u as (select *, ceil(least(n, strlen(cached)) / 4)::int as tokens, ceil(length(cached) / 4)::int as held from c) select query_id, least(tokens, held)::int as reused, round(least(1, 0.7 * n / greatest(strlen(text), 1) + 0.3 * n / greatest(strlen(cached), 1)), 6) as quality from u where n >= 10 and held >= tokens"""
)
def hidden_reuse(spark, d):
    """What a question could reuse of the states of its client's question before."""
    asked = log(spark, d).filter("text is not null and client_id is not null").select("query_id", "client_id", "ts", "text")
    t = previous(asked, "client_id", ["ts", "query_id"], "text", "cached").filter("cached is not null")
    tokens, quality = hidden.reuse("text", "cached", F.ceil(F.length("cached") / 4).cast("int"))
    return t.select("query_id", tokens.alias("reused"), _r(quality).alias("quality")).filter("reused > 0")


# speculative decoding and embedding ------------------------------------------------------------------------------------

_SOFT = f"{_PAIRS}, s as (select vec_id, label, {_sql_soft('a', 1.0)} as t, {_sql_soft('b', 1.0)} as d from p)"


def _soft(spark, d) -> DataFrame:
    return _pairs(spark, d).select("vec_id", "label", V.softmax("a").alias("t"), V.softmax("b").alias("d"))


@query(f"with {_SOFT}, c as (select *, list_transform(list_zip(t, d), lambda z: greatest(0, z[1] - z[2])) as e from s) select vec_id, t[label + 1] >= 0.8 * d[label + 1] as accepted, (list_position(e, list_max(e)) - 1)::bigint as correction from c")
def speculative_tokens(spark, d):
    """Whether the target accepts the token `label` of the draft, and what would replace it."""
    at = F.col("label") + 1
    hit = speculative.accepted(F.element_at("t", at), F.element_at("d", at))
    return _soft(spark, d).select("vec_id", hit.alias("accepted"), speculative.correction("t", "d").alias("correction"))


@query(f"with {_SOFT}, h as (select vec_id // 4 as step, t[label + 1] >= 0.8 * d[label + 1] as hit from s), g as (select step, count(*) filter (hit) as a, count(*) as n from h group by 1) select count(*) as steps, sum(a)::bigint as accepted, round(sum(a) / sum(n), 6) as rate, round((sum(a) + count(*) filter (a < n)) / count(*), 6) as speedup from g")
def speculative_statistics(spark, d):
    at = F.col("label") + 1
    rows = _soft(spark, d).withColumn("step", F.floor(F.col("vec_id") / 4))
    return speculative.statistics(rows, speculative.accepted(F.element_at("t", at), F.element_at("d", at)))


_DIGITS = "flatten(list_transform(range(2), lambda b: list_transform(range(8), lambda i: ('0x' || substring(md5(text || '|' || b), (4 * i + 1)::int, 4))::int / 32767.5 - 1)))"


@query(f"with {LOG}, r as (select query_id, {_DIGITS} as v from log where text is not null) select query_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6) + 0.0) as embedding from r union all select query_id, null from log where text is null")
def embed_hashed(spark, d):
    """A hashed vector for each question of the log, made once for each different text."""
    return embedding.embed(log(spark, d).select("query_id", "text"), "text", lambda t: embedding.hashed(t, 16)).select("query_id", F.transform("embedding", lambda x: _r(x)).alias("embedding"))


_CODES = "list_transform(range(16), lambda i: unicode(substring(token, (i % length(token) + 1)::int, 1)) / 127.5 - 1 + 0.1 * sin(pos))"


@query(f"with {LOG}, t as (select query_id, p - 1 as pos, ws[p] as token from (select query_id, {sql_words('text')} as ws from log where text is not null), unnest(range(1, len(ws) + 1)) r(p)), r as (select *, {_CODES} as v from t) select query_id, pos, token, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6) + 0.0) as vec from r")
def embed_tokens(spark, d):
    """Every word of every question as a vector."""
    return embedding.token_vectors(log(spark, d).filter("text is not null"), "query_id", "text").withColumn("vec", F.transform("vec", lambda x: _r(x)))
