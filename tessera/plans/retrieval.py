"""Queries of search, fusion, reranking, expansion and feedback."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.text import ENDINGS, STOP_WORDS, SUFFIXES, stem, terms
from ..operators import expand, feedback, filters as flt, fusion, rerank, search, sparse
from ..operators.ranking import rounded, top_k
from ..registry import query
from ..sources.scratch import shared_folder
from ..sources.tables import table
from ..streaming import flows
from .base import ASKED, JUDGMENTS, LOG, SQL_ALNUM, STORE, judgments, log, sql_strings, sql_strip, sql_terms, sql_top, sql_words, store, store_queries

METRICS = {
    "cosine": "case when n > 0 then dot / n else 0 end",
    "dot": "dot",
    "euclidean": "1 / (1 + sqrt(distance))",
}
AS_OF = "2026-01-01 00:00:00"


def _pairs(condition: str = "true") -> str:
    return f"""pairs as (select query_id, doc_id, list_dot_product(q.embedding, x.embedding) as dot, sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(x.embedding, x.embedding)) as n,
list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: (z[1] - z[2]) ** 2)) as distance from asked q join store x on len(q.embedding) = len(x.embedding) where {condition})"""


def _scores(metric: str) -> str:
    return f"scored as (select query_id, doc_id, round({METRICS[metric]}, 6) + 0.0 as score from pairs)"


def _knn_sql(metric: str, k: int = 10, where: str = "true", condition: str = "true") -> str:
    return f"with {STORE}, {ASKED}, {_pairs(condition)}, {_scores(metric)} {sql_top('scored', k, where=where)}"


# vectors -------------------------------------------------------------------------------------------------------------


@query(_knn_sql("cosine"))
def knn_cosine(spark, d):
    return search.knn(store_queries(spark, d), store(spark, d))


@query(_knn_sql("dot"))
def knn_dot(spark, d):
    return search.knn(store_queries(spark, d), store(spark, d), metric="dot")


@query(_knn_sql("euclidean"))
def knn_euclidean(spark, d):
    return search.knn(store_queries(spark, d), store(spark, d), metric="euclidean")


@query(_knn_sql("cosine", 50, "score >= 0.9"))
def knn_min_score(spark, d):
    return search.knn(store_queries(spark, d), store(spark, d), k=50, min_score=0.9)


_FILTER = flt.all_of(flt.eq("lang", "en"), flt.any_of(flt.contains("collection", "o"), flt.not_exists("author")), flt.ne("collection", "ledger"))


@query(_knn_sql("cosine", 10, condition="coalesce(x.metadata['lang'] = 'en', false) and (coalesce(contains(x.metadata['collection'], 'o'), false) or x.metadata['author'] is null) and coalesce(x.metadata['collection'] != 'ledger', true)"))
def knn_filtered(spark, d):
    """The filter is applied before the search."""
    return search.knn(store_queries(spark, d), store(spark, d).filter(_FILTER.column()))


_VECTORS = "store as (select vec_id as doc_id, embedding::double[] as embedding from embeddings), asked as (select doc_id as query_id, embedding from store where doc_id % 100 = 0)"


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


@query(f"with {_VECTORS}, {_pairs()}, {_scores('cosine')} {sql_top('scored', 10)}")
def knn_embeddings(spark, d):
    docs = _vectors(spark, d)
    return search.knn(docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), docs)


_INDICES: dict[tuple[str, str], search.VectorIndex] = {}


def _index(spark, d) -> search.VectorIndex:
    """The index of a folder's vectors, built at its first use in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDICES:
        _INDICES[key] = search.VectorIndex.build(_vectors(spark, d), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _INDICES[key]


@query()
def knn_index(spark, d):
    """By the inverted-file index over all rows; its recall is measured in the tests."""
    return _index(spark, d).search(_vectors(spark, d).filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


@query(f"with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id as doc_id, round(list_dot_product(q, embedding::double[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) + 0.0 as score from q, embeddings), k as ({sql_top('s', 10)}) select query_id, count(*) as wanted, true as reached from k group by 1")
def knn_index_recall(spark, d):
    """Of how many nearest vectors each query's are found: whether the mean over all queries is at least 0.9, beside the number wanted."""
    exact = knn_embeddings(spark, d).select("query_id", "doc_id")
    found = knn_index(spark, d).select("query_id", "doc_id", F.lit(1).alias("hit"))
    each = exact.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    mean = each.agg((F.sum("hits") >= 0.9 * F.sum("wanted")).alias("reached"))
    return each.select("query_id", "wanted").join(F.broadcast(mean))  # one row


@query("select count(*) as rows, true as even from embeddings")
def knn_index_statistics(spark, d):
    """All rows lie in a cell, and none holds more than a quarter of them where there are sixteen or more."""
    s = _index(spark, d).statistics()
    return s.select("rows", ((F.col("most") <= 0.25 * F.col("rows")) | (F.col("cells") < 16)).alias("even"))


@query("select count(*) filter (label != 0) as rows, 0 as found from embeddings")
def knn_index_removed(spark, d):
    """The rows of an index when all vectors of one label are removed from it, and how many of these a search still finds."""
    docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    index = search.VectorIndex.build(docs, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", cells=4)
    gone = docs.filter("label = 0").select("doc_id")
    index.remove(gone)
    found = index.search(docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")).join(gone, "doc_id", "left_semi")
    n = found.count()
    return index.rows().agg(F.count("*").alias("rows")).withColumn("found", F.lit(n))


def _tokens(df: DataFrame, key: str, width: int = 16) -> DataFrame:
    """A vector's consecutive parts of `width` numbers, as token vectors."""
    return df.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * width + 1, F.lit(width)))).alias("pos", "vec"))


@query(
    f"""with {_VECTORS}, t as (select doc_id, p as pos, embedding[p * 16 + 1 : p * 16 + 16] as vec from store, range(4) r(p)),
best as (select q.doc_id as query_id, q.pos, t.doc_id, max(list_dot_product(q.vec, t.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(t.vec, t.vec))) as s from t q, t where q.doc_id % 100 = 0 group by all),
scored as (select query_id, doc_id, round(sum(s), 6) as score from best group by all) {sql_top('scored', 10)}"""
)
def search_maxsim(spark, d):
    docs = _vectors(spark, d)
    return search.maxsim(_tokens(docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), "query_id"), _tokens(docs, "doc_id"))


# filters -------------------------------------------------------------------------------------------------------------

_CONDITIONS = {
    "eq": (flt.eq("collection", "ledger"), "coalesce(metadata['collection'] = 'ledger', false)"),
    "ne": (flt.ne("author", "Polpraa Löalda"), "coalesce(metadata['author'] != 'Polpraa Löalda', true)"),
    "contains": (flt.contains("author", "or"), "coalesce(contains(metadata['author'], 'or'), false)"),
    "exists": (flt.exists("author"), "metadata is not null and list_contains(map_keys(metadata), 'author')"),
    "not_exists": (flt.not_exists("lang"), "metadata is null or not list_contains(map_keys(metadata), 'lang')"),
    "tree": (flt.any_of(flt.all_of(flt.eq("lang", "de"), flt.exists("author")), flt.all_of(flt.ne("lang", "en"), flt.contains("collection", "no"))), "(coalesce(metadata['lang'] = 'de', false) and metadata['author'] is not null) or (coalesce(metadata['lang'] != 'en', true) and coalesce(contains(metadata['collection'], 'no'), false))"),
    "empty_or": (flt.any_of(), "true"),
}


def _register_filters() -> None:
    for name, (condition, sql) in _CONDITIONS.items():
        query(f"with {STORE} select doc_id from store where {sql}", f"filter_{name}")(lambda spark, d, c=condition: store(spark, d).filter(c.column()).select("doc_id"))


_register_filters()


@query(f"with {LOG}, {STORE}, f as (select distinct filters from log where len(map_keys(filters)) > 0) select array_to_string(list_sort(list_transform(map_entries(filters), lambda e: e.key || '=' || e.value)), '&') as filters, count(*) as records from f join store on len(list_filter(map_entries(filters), lambda e: coalesce(metadata[e.key] = e.value, false))) = len(map_keys(filters)) group by 1")
def filter_of_questions(spark, d):
    """How many records meet the filters that questions came with. The distinct filters are few and are broadcast if a count says so."""
    f = log(spark, d).select(F.array_sort(F.map_entries("filters")).alias("f")).filter(F.size("f") > 0).distinct()
    own = F.filter(F.array_sort(F.map_entries("metadata")), lambda e: F.lit(True))
    # every subset of a record's few entries is a filter that it meets
    subsets = F.aggregate(own, F.array(F.array().cast("array<struct<key:string,value:string>>")), lambda acc, e: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, F.struct(e["key"].alias("key"), e["value"].alias("value"))))))
    met = store(spark, d).filter("metadata is not null").select(F.explode(subsets).alias("f"))
    named = lambda c: F.array_join(F.array_sort(F.transform(c, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&")
    return met.select(named("f").alias("filters")).join(f.select(named(F.col("f")).alias("filters")), "filters").groupBy("filters").agg(F.count("*").alias("records"))


# sparse --------------------------------------------------------------------------------------------------------------


def _bm25(docs: str, asked: str) -> str:
    """CTEs tf, n, model, weights, wanted, sparse over docs(doc_id, text) and asked(query_id, text)."""
    weight = "idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(average, 1)))"
    return f"""ts as (select doc_id, {sql_terms('text')} as ts from {docs}), tf as (select doc_id, len(ts) as dl, term, count(*) as tf from (select doc_id, ts, unnest(ts) as term from ts) group by all),
n as (select count(*) as n, sum(coalesce(len(ts), 0)) / count(*) as average from ts), model as (select term, count(*) as df, greatest(ln((any_value(n.n) + 1) / (count(*) + 0.5)), 1.1920929e-07) as idf from tf, n group by term),
weights as (select doc_id, term, {weight} as weight from tf join model using (term), n),
qs as (select query_id, {sql_terms('text')} as ts from {asked}), qtf as (select query_id, len(ts) as dl, term, count(*) as tf from (select query_id, ts, unnest(ts) as term from qs) group by all),
wanted as (select query_id, term, {weight} as query_weight from qtf join model using (term), n),
sparse as (select query_id, doc_id, round(sum(weight * query_weight), 6) as score from weights join wanted using (term) group by all having round(sum(weight * query_weight), 6) > 0)"""


@query(f"with {STORE}, {ASKED}, {_bm25('store', 'asked')} select term, df, round(idf, 6) as idf from model")
def bm25_model(spark, d):
    docs = store(spark, d)
    n, _ = sparse.collection(docs)
    return sparse.fit(sparse.term_frequencies(docs), n).withColumn("idf", rounded(F.col("idf")))


@query(f"with {STORE}, {ASKED}, {_bm25('store', 'asked')} select doc_id, term, round(weight, 6) as weight from weights")
def bm25_encode(spark, d):
    docs = store(spark, d)
    n, average = sparse.collection(docs)
    tf = sparse.term_frequencies(docs)
    return sparse.encode(tf, sparse.fit(tf, n), average).withColumn("weight", rounded(F.col("weight")))


@query(f"with {STORE}, {ASKED}, {_bm25('store', 'asked')} {sql_top('sparse', 10)}")
def search_bm25(spark, d):
    return sparse.search(store_queries(spark, d), store(spark, d))


@query(f"with docs as (select doc_id, text from documents), asked as (select item_id as query_id, text from eval_items where item_id % 100 = 0), {_bm25('docs', 'asked')} {sql_top('sparse', 10)}")
def search_bm25_documents(spark, d):
    asked = table(spark, d, "eval_items").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    return sparse.search(asked, table(spark, d, "documents").select("doc_id", "text"))


@query(f"""with {STORE}, {ASKED}, {_bm25('store', 'asked')}, qn as (select query_id, sqrt(sum(query_weight ** 2)) as m from wanted group by 1), dn as (select doc_id, sqrt(sum(weight ** 2)) as n from weights group by 1),
c as (select query_id, doc_id, sum(weight * query_weight) as dot from weights join wanted using (term) group by all) select query_id as left_id, doc_id as right_id, round(dot / (m * n), 6) as cosine from c join qn using (query_id) join dn using (doc_id)""")
def sparse_cosine(spark, d):
    return sparse.cosines(store_queries(spark, d), store(spark, d))


@query("select vec_id as id, i - 1 as term, round(embedding[i], 6) as weight from embeddings, range(1, 65) r(i) where abs(embedding[i]) > 1.1920929e-07")
def sparse_from_dense(spark, d):
    return sparse.to_sparse(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("weight", rounded(F.col("weight").cast("double")))


@query("select vec_id as id, list_transform(embedding, lambda x: case when abs(x) > 1.1920929e-07 then round(x::double, 6) else 0.0 end) as vector from embeddings")
def sparse_to_dense(spark, d):
    made = sparse.to_dense(sparse.to_sparse(table(spark, d, "embeddings"), "vec_id", "embedding"), 64)
    return made.select("id", F.transform("vector", lambda x: rounded(x)).alias("vector"))


@query(_knn_sql("cosine"))
def stream_search(spark, d):
    """Queries that arrive in files, searched batch by batch."""
    docs = store(spark, d)
    return arriving(spark, store_queries(spark, d), lambda batch: search.knn(batch, docs))


def arriving(spark, queries: DataFrame, work) -> DataFrame:
    """The result of work over queries that arrive in four files, one a batch."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    queries.repartition(4).write.parquet(f"{folder}/in")
    flows.processed(flows.parquet_stream(spark, f"{folder}/in", queries.schema, 1), work, folder).awaitTermination()
    return flows.results(spark, folder).drop("batch")


@query(f"with {STORE}, {ASKED}, {_bm25('store', 'asked')} select doc_id, term, round(weight, 6) as weight from weights where doc_id not in (select query_id from asked)")
def sparse_removed(spark, d):
    """The encoded store without the records that are queries."""
    docs = store(spark, d)
    n, average = sparse.collection(docs)
    frequencies = sparse.term_frequencies(docs)
    weights = sparse.encode(frequencies, sparse.fit(frequencies, n), average)
    return sparse.removed(weights, store_queries(spark, d), "query_id").withColumn("weight", rounded(F.col("weight")))


# fusion --------------------------------------------------------------------------------------------------------------


def _lists(spark, d, k: int = 20) -> tuple[DataFrame, DataFrame]:
    return search.knn(store_queries(spark, d), store(spark, d), k), sparse.search(store_queries(spark, d), store(spark, d), k)


_LISTS = f"{STORE}, {ASKED}, {_pairs()}, {_scores('cosine')}, {_bm25('store', 'asked')}, a as ({sql_top('scored', 20)}), b as ({sql_top('sparse', 20)})"
_FUSED = "query_id, doc_id, dense_score, sparse_score, score"


def _fuse_sql(normal: str) -> str:
    return f"""with {_LISTS}, x as (select *, {normal} as n from a), y as (select *, {normal} as n from b),
fused as (select coalesce(x.query_id, y.query_id) as query_id, coalesce(x.doc_id, y.doc_id) as doc_id, round(coalesce(x.n, 0), 6) + 0.0 as dense_score, round(coalesce(y.n, 0), 6) + 0.0 as sparse_score, round(0.5 * coalesce(x.n, 0) + 0.5 * coalesce(y.n, 0), 6) + 0.0 as score from x full join y on x.query_id = y.query_id and x.doc_id = y.doc_id)
{sql_top('fused', 10, _FUSED)}"""


_W = "over (partition by query_id)"


@query(_fuse_sql(f"case when abs(max(score) {_W} - min(score) {_W}) < 1.1920929e-07 then 0.5 else (score - min(score) {_W}) / (max(score) {_W} - min(score) {_W}) end"))
def search_hybrid_weighted(spark, d):
    return fusion.fuse_weighted(*_lists(spark, d))


@query(_fuse_sql(f"(score - avg(score) {_W}) / greatest(stddev_pop(score) {_W}, 1.1920929e-07)"))
def search_hybrid_distribution(spark, d):
    return fusion.fuse_distribution(*_lists(spark, d))


@query(f"""with {_LISTS}, fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.score, 0) as dense_score, coalesce(b.score, 0) as sparse_score, round(coalesce(1 / (61 + a.rank), 0) + coalesce(1 / (61 + b.rank), 0), 9) as score
from a full join b on a.query_id = b.query_id and a.doc_id = b.doc_id) {sql_top('fused', 10, _FUSED)}""")
def search_hybrid_rrf(spark, d):
    return fusion.fuse_rrf(*_lists(spark, d))


# reranking -----------------------------------------------------------------------------------------------------------


def _results(spark, d, k: int = 20) -> DataFrame:
    """The dense list with texts and vectors, joined only after the cut to k."""
    docs, asked = store(spark, d), store_queries(spark, d)
    listed = search.knn(asked, docs, k)
    return listed.join(docs.select("doc_id", "text", F.col("embedding").alias("vector")), "doc_id").join(asked.select("query_id", F.col("text").alias("query_text"), F.col("embedding").alias("query_vector")), "query_id")


def results_sql(k: int = 20) -> str:
    return f"{STORE}, {ASKED}, {_pairs()}, {_scores('cosine')}, a as ({sql_top('scored', k)}), results as (select a.*, coalesce(store.text, '') as text, coalesce(asked.text, '') as query_text, asked.embedding as query_vector, store.embedding as vector from a join store using (doc_id) join asked using (query_id))"


_RESULTS = results_sql()


def _keyword_sql(source: str, to: str, k: int = 10) -> str:
    """CTEs `to`_s and `to`: the keyword reranker over `source`."""
    tf = "len(list_filter(ws, lambda w: w = t))"
    return f"""{to}_w as (select *, {sql_words('lower(text)')} as ws, avg(strlen(text)) over (partition by query_id) as average from {source}),
{to}_s as (select * exclude (score, rank, ws, average), round(0.5 * score + 0.5 * least(coalesce(list_sum(list_transform(list_filter({sql_words('lower(query_text)')}, lambda t: list_contains(ws, t)), lambda t: {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(ws) / average)))), 0), 1), 6) as score from {to}_w),
{to} as ({sql_top(to + '_s', k, '*')})"""


@query(f"""with {_RESULTS}, w as (select query_id, doc_id, {sql_words('lower(query_text)')} as ts, {sql_words('lower(text)')} as ws from results) select query_id, doc_id, round(coalesce(list_sum(list_transform(list_filter(ts, lambda t: list_contains(ws, t)), lambda t: len(list_filter(ws, lambda w: w = t)) * 2.2 / (len(list_filter(ws, lambda w: w = t)) + 1.2 * (0.25 + 0.75 * len(ws) / 100.0)))), 0), 6)::double as score from w""")
def rerank_pair_bm25(spark, d):
    """Every result scored as a pair of texts."""
    return _results(spark, d).select("query_id", "doc_id", rounded(rerank.pair_bm25("query_text", "text")).alias("score"))


def _semantic_sql(source: str, to: str, k: int = 10) -> str:
    cos = "case when list_dot_product(vector, vector) > 0 and list_dot_product(query_vector, query_vector) > 0 then list_dot_product(vector, query_vector) / sqrt(list_dot_product(vector, vector) * list_dot_product(query_vector, query_vector)) else 0 end"
    return f"{to}_s as (select * exclude (score, rank), round(0.5 * score + 0.5 * {cos}, 6) as score from {source}), {to} as ({sql_top(to + '_s', k, '*')})"


_LISTED = "query_id, doc_id, score, rank"


@query(f"with {_RESULTS}, {_keyword_sql('results', 'kw')} select {_LISTED} from kw where score >= 0")
def rerank_keyword(spark, d):
    return rerank.keyword(_results(spark, d)).select("query_id", "doc_id", "score", "rank")


@query(f"with {_RESULTS}, {_semantic_sql('results', 'se')} select {_LISTED} from se where score >= 0")
def rerank_semantic(spark, d):
    return rerank.semantic(_results(spark, d)).select("query_id", "doc_id", "score", "rank")


@query(f"with {_RESULTS}, {_keyword_sql('results', 'kw')}, {_semantic_sql('results', 'se')}, h as (select se.query_id, se.doc_id, round(0.3 * coalesce(kw.score, 0) + 0.7 * se.score, 9) as score from se left join kw using (query_id, doc_id)) {sql_top('h', 10)}")
def rerank_hybrid(spark, d):
    return rerank.hybrid(_results(spark, d)).select("query_id", "doc_id", "score", "rank")


@query(f"with {_RESULTS}, s as (select query_id, doc_id, list_distinct({sql_words('lower(query_text)')}) as a, list_distinct({sql_words('lower(text)')}) as b from results) select query_id, doc_id, round(0.5 + 0.5 * case when len(list_distinct(a || b)) > 0 then len(list_intersect(a, b)) / len(list_distinct(a || b)) else 0 end, 6) as score from s")
def rerank_pair_overlap(spark, d):
    text = lambda c: F.coalesce(c, F.lit(""))
    return _results(spark, d).select("query_id", "doc_id", rounded(rerank.pair_score(text("query_text"), text("text"))).alias("score"))


@query(f"with {_RESULTS}, {_keyword_sql('results', 'kw')}, {_semantic_sql('results', 'se')}, u as (select query_id, doc_id, 0.25 * score as part from kw union all select query_id, doc_id, 0.75 * score from se), w as (select query_id, doc_id, round(coalesce(sum(part), 0), 9) as score from results left join u using (query_id, doc_id) group by 1, 2) {sql_top('w', 10)}")
def rerank_weighted(spark, d):
    return rerank.weighted(_results(spark, d), [(rerank.keyword, 1.0), (rerank.semantic, 3.0)]).select("query_id", "doc_id", "score", "rank")


@query(f"with {_RESULTS}, {_keyword_sql('results', 'kw')}, {_semantic_sql('kw', 'se')} select {_LISTED} from se")
def rerank_cascade(spark, d):
    return rerank.cascade(_results(spark, d), [rerank.keyword, rerank.semantic]).select("query_id", "doc_id", "score", "rank")


@query(f"with {_RESULTS}, {_keyword_sql('results', 'kw')}, {_semantic_sql('results', 'se')}, u as (select query_id, doc_id, 1 / (61 + rank) as part from kw union all select query_id, doc_id, 1 / (61 + rank) from se), w as (select query_id, doc_id, round(coalesce(sum(part), any_value(results.score)), 9) as score from results left join u using (query_id, doc_id) group by 1, 2) {sql_top('w', 10)}")
def rerank_rrf(spark, d):
    return rerank.reciprocal(_results(spark, d), [rerank.keyword, rerank.semantic]).select("query_id", "doc_id", "score", "rank")


# expansion -----------------------------------------------------------------------------------------------------------


def _sql_stem(w: str) -> str:
    low = f"lower({w})"
    cases = " ".join(f"when strlen({low}) > {len(s) + 2} and ends_with({low}, '{s}') then left({low}, length({low}) - {len(s)})" for s in SUFFIXES)
    return f"case {cases} else {low} end"


def _sql_appended(extra: str) -> str:
    return f"case when len({extra}) > 0 then text || ' ' || array_to_string({extra}, ' ') else text end"


_SYNONYMS_SQL = "map {" + ", ".join(f"'{k}': {sql_strings(v)}" for k, v in expand.SYNONYMS.items()) + "}"
_ASKED_TEXT = f"{LOG}, q as (select query_id, text from log where text is not null)"


def _questions(spark, d) -> DataFrame:
    return log(spark, d).select("query_id", "text").filter("text is not null")


@query(f"with {_ASKED_TEXT}, e as (select query_id, text, flatten(list_transform({sql_words('text')}, lambda w: coalesce({_SYNONYMS_SQL}[lower(w)], []::varchar[]))) as extra from q) select query_id, {_sql_appended('extra')} as text from e")
def expand_synonyms(spark, d):
    return _questions(spark, d).select("query_id", expand.expand_synonyms("text").alias("text"))


_FORMS = sql_strings(ENDINGS)


@query(f"""with {_ASKED_TEXT}, w as (select query_id, text, list_transform({sql_words('text')}, lambda w: {{'w': lower(w), 's': {_sql_stem('w')}}}) as ws from q),
e as (select query_id, text, flatten(list_transform(ws, lambda x: list_filter([x.s], lambda s: s != x.w) || list_filter(list_filter(list_transform({_FORMS}, lambda e: x.s || e), lambda f: f != x.s)[1:2], lambda f: f != x.w)))[1 : greatest(1, 5 * len(ws))] as extra from w) select query_id, {_sql_appended('extra')} as text from e""")
def expand_stems(spark, d):
    return _questions(spark, d).select("query_id", expand.expand_stems("text").alias("text"))


@query(f"with {_ASKED_TEXT} select query_id, array_to_string(list_transform({sql_words('text')}, lambda w: {_sql_stem('w')}), ' ') as text from q")
def reformulate_stems(spark, d):
    return _questions(spark, d).select("query_id", expand.stemmed("text").alias("text"))


def _sql_grams(n: int) -> str:
    return f"case when len(ws) < {n} then [text] else list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i : i + {n - 1}], ' ')) end"


@query(f"""with {_ASKED_TEXT}, w as (select query_id, text, {sql_words('text')} as ws from q), g as (select query_id, text, {_sql_grams(2)} || {_sql_grams(3)} || flatten(list_transform(list_filter(ws, lambda w: strlen(w) >= 4), lambda w: list_transform(list_filter([1, 2, 3], lambda i: i + 2 <= length(w)), lambda i: substring(w, i, 3)))) as g from w),
e as (select query_id, text, list_filter(g, lambda x, i: lower(x) != lower(text) and list_position(list_transform(g, lambda y: lower(y)), lower(x)) = i)[1:5] as extra from g) select query_id, {_sql_appended('extra')} as text from e""")
def expand_ngrams(spark, d):
    return _questions(spark, d).select("query_id", expand.expand_ngrams("text").alias("text"))


@query(f"""with {_ASKED_TEXT}, e as (select query_id, flatten(list_transform({sql_words('text')}, lambda w: coalesce({_SYNONYMS_SQL}[lower(w)], []::varchar[]))) || list_transform({sql_words('text')}, lambda w: {_sql_stem('w')}) as g from q)
select query_id, array_to_string(list_filter(g, lambda x, i: list_position(list_transform(g, lambda y: lower(y)), lower(x)) = i), ' ') as terms from e""")
def expand_composite(spark, d):
    """Synonyms and stems, without repeats."""
    stems = F.transform(expand.words("text"), stem)
    return _questions(spark, d).select("query_id", F.array_join(expand.composite_terms(expand.synonym_terms("text"), stems), " ").alias("terms"))


@query(f"with {_ASKED_TEXT}, w as (select query_id, text, list_filter({sql_words('text')}, lambda w: strlen(w) > 1 and not list_contains({sql_strings(STOP_WORDS)}, lower(w))) as k from q) select query_id, case when len(k) > 0 then array_to_string(k, ' ') else text end as text from w")
def reformulate_simplify(spark, d):
    return _questions(spark, d).select("query_id", expand.simplify("text").alias("text"))


def _sql_decompose() -> str:
    out = "[text]"
    for s in expand.SEPARATORS:
        out = f"list_filter(flatten(list_transform({out}, lambda p: list_transform(string_split(p, '{s}'), lambda x: {sql_strip('x')}))), lambda x: x != '')"
    return f"list_filter({out}, lambda p: strlen(p) > 2)"


@query(f"with {_ASKED_TEXT}, p as (select query_id, text, {_sql_decompose()} as p from q), e as (select query_id, case when len(p) > 0 then p else [text] end as p from p) select query_id, i - 1 as part, p[i] as text from e, unnest(range(1, len(p) + 1)) r(i)")
def reformulate_decompose(spark, d):
    return _questions(spark, d).select("query_id", F.posexplode(expand.decompose("text")).alias("part", "text"))


@query(f"with {_ASKED_TEXT}, s as (select *, {sql_strip('text')} as s from q) select query_id, case when ends_with(s, '?') then text when regexp_matches(lower(s), '^(how to |what is |what are )') then s || '?' else 'What is ' || s || '?' end as text from s")
def reformulate_question(spark, d):
    return _questions(spark, d).select("query_id", expand.as_question("text").alias("text"))


@query(f"with {LOG} select query_id, case when coalesce(filters['collection'], '') != '' then text || ' ' || filters['collection'] else text end as text from log where text is not null")
def reformulate_clarify(spark, d):
    """The collection that a question is restricted to, as its context."""
    q = log(spark, d).filter("text is not null")
    return q.select("query_id", expand.clarify("text", F.element_at("filters", "collection")).alias("text"))


_RESULT_TERMS = f"""{_RESULTS}, first as (select query_id, query_text, rank, score, unnest(list_transform({sql_words('lower(text)')}, lambda w: regexp_replace(w, '^[^{SQL_ALNUM}]+|[^{SQL_ALNUM}]+$', '', 'g'))) as term from results where rank < 3),
kept as (select * from first where strlen(term) > 2 and not list_contains({sql_words('lower(query_text)')}, term))"""


def _with_text(spark, d) -> DataFrame:
    return _results(spark, d).withColumn("query_text", F.coalesce("query_text", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))


@query(f"with {_RESULT_TERMS}, s as (select query_id, term, round(sum(score / (rank + 1)), 6) + 0.0 as score from kept where not list_contains({sql_strings(STOP_WORDS)}, term) group by all) select *, row_number() over (partition by query_id order by score desc, term) - 1 as place from s qualify row_number() over (partition by query_id order by score desc, term) <= 5")
def feedback_terms(spark, d):
    return expand.feedback_terms(_with_text(spark, d))


@query(f"with {_RESULT_TERMS}, s as (select query_id, term, count(*) as n from kept group by all having count(*) >= 2) select *, row_number() over (partition by query_id order by n desc, term) - 1 as place from s qualify row_number() over (partition by query_id order by n desc, term) <= 5")
def frequent_result_terms(spark, d):
    return expand.frequent_terms(_with_text(spark, d))


@query(f"with {_RESULT_TERMS}, s as (select query_id, term, round(sum(score / (rank + 1)), 6) + 0.0 as score from kept where not list_contains({sql_strings(STOP_WORDS)}, term) group by all), t as (select *, row_number() over (partition by query_id order by score desc, term) as p from s), x as (select query_id, string_agg(term, ' ' order by p) as x from t where p <= 5 group by 1) select query_id, case when x is not null and text is not null then text || ' ' || x when text is null then x else text end as text from asked left join x using (query_id)")
def reformulate_feedback(spark, d):
    return expand.reformulated(store_queries(spark, d), expand.feedback_terms(_with_text(spark, d)))


# feedback ------------------------------------------------------------------------------------------------------------

_SIGNALS = f"""{JUDGMENTS}, sig as (select document_id as doc_id, sum(case when relevant then w else 0 end) as positive, sum(case when not relevant then w else 0 end) as negative, count(*) as n
from (select *, 0.95 ** greatest(0, floor((epoch_us(timestamptz '{AS_OF}+00') - epoch_us(ts)) / 86400000000)) * coalesce(rating::double, 1) as w from judgments where relevant is not null and document_id is not null) group by 1)"""


@query(f"with {_SIGNALS} select doc_id as document_id, round(positive - 0.5 * negative, 6) + 0.0 as signal, round(positive, 6) as positive, round(negative, 6) as negative, n from sig")
def feedback_signals(spark, d):
    s = feedback.document_signals(judgments(spark, d), AS_OF)
    return s.select("document_id", *[rounded(F.col(c)).alias(c) for c in ("signal", "positive", "negative")], "n")


@query(f"with {_RESULTS}, {_SIGNALS}, s as (select query_id, doc_id, round(case when n is null then score else least(1, greatest(0, score + case when positive - 0.5 * negative > 0 then 0.75 else 0.15 end * (positive - 0.5 * negative))) end, 6) as score from results left join sig using (doc_id)) {sql_top('s', 20)}")
def feedback_rocchio(spark, d):
    return feedback.rocchio(_results(spark, d), judgments(spark, d), AS_OF).select("query_id", "doc_id", "score", "rank")


@query(f"with {_RESULTS}, {_SIGNALS}, s as (select query_id, doc_id, round(case when n is null then score else least(1, greatest(0, score + 0.2 * positive - 0.05 * negative)) end, 6) as score from results left join sig using (doc_id)) {sql_top('s', 20)}")
def feedback_boost(spark, d):
    return feedback.boost(_results(spark, d), judgments(spark, d), AS_OF).select("query_id", "doc_id", "score", "rank")


_JUDGED = f"{JUDGMENTS}, {STORE}, judged as (select j.relevant, unnest(list_filter(list_transform(list_filter({sql_words('lower(text)')}, lambda w: strlen(w) > 2), lambda w: regexp_replace(w, '[^{SQL_ALNUM}]+', '', 'g')), lambda w: w != '')) as term from judgments j join store on document_id = doc_id where relevant is not null)"


def _judged(spark, d) -> DataFrame:
    return judgments(spark, d).select("relevant", F.col("document_id").alias("doc_id")).join(store(spark, d).select("doc_id", "text"), "doc_id")


@query(f"with {_JUDGED} select term, round(0.75 * sum(relevant::int) - 0.15 * sum((not relevant)::int), 6)::double as weight from judged group by 1 having round(0.75 * sum(relevant::int) - 0.15 * sum((not relevant)::int), 6) > 0")
def relevance_model(spark, d):
    return feedback.relevance_model(_judged(spark, d))


@query(f"with {_JUDGED} select term, 1.0::double as weight from judged group by 1 having bool_and(relevant)")
def relevance_model_boost(spark, d):
    return feedback.boost_model(_judged(spark, d))


@query(f"with {_JUDGED}, m as (select term, round(0.75 * sum(relevant::int) - 0.15 * sum((not relevant)::int), 6)::double as weight from judged group by 1) select * from m where weight > 0 order by weight desc, term limit 10")
def relevance_top_terms(spark, d):
    """The ten heaviest terms of the relevance model."""
    return feedback.top_terms(feedback.relevance_model(_judged(spark, d)))


@query(f"with {STORE} select doc_id, {sql_terms('text')} as terms from store")
def text_terms(spark, d):
    return store(spark, d).select("doc_id", terms("text").alias("terms"))


@query(f"with {_RESULTS}, s as (select query_id, doc_id, round(score * 0.5, 6) as score from results) {sql_top('s', 10, where='score >= 0.2')}")
def rerank_scaled(spark, d):
    """Scores halved, and cut off below a fifth."""
    return rerank.scaled(_results(spark, d), 0.5, 10, 0.2).select("query_id", "doc_id", "score", "rank")
