"""Queries of drafts, their verification, calibration, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import calibration, claims, drafts, search
from ..operators.ranking import rounded
from ..registry import query
from .base import JUDGMENTS, LOG, SQL_SPACE, STORE, judgments, log, sql_sentences, sql_strings, sql_words, store, store_queries
from .knowledge import _VERDICT, claims_sql
from .retrieval import _RESULTS, _results, arriving, results_sql


def _drafts(spark, d) -> DataFrame:
    return drafts.drafts(store_queries(spark, d), _results(spark, d))


_NONE = drafts.NO_RESULT
_DRAFTS = f"""{_RESULTS}, g as (select query_id, list(text order by rank) as context, list(score order by rank) as scores from results group by 1),
drafts as (select query_id, asked.text as query_text, coalesce(context, []) as context, coalesce(scores, []) as scores, case when len(context) > 0 then array_to_string(context[1:3], ' ') else '{_NONE}' end as content, coalesce(list_sum(scores) / len(scores), 0) as confidence from asked left join g using (query_id))"""


@query(f"with {_DRAFTS} select query_id, content, round(confidence, 6) as confidence from drafts")
def draft_generate(spark, d):
    return _drafts(spark, d).select("query_id", "content", rounded(F.col("confidence")).alias("confidence"))


def _sql_long(text: str, n: int) -> str:
    return f"list_distinct(list_filter({sql_words(text)}, lambda w: strlen(w) > {n}))"


_CONTEXT = "array_to_string(context, ' ')"
_MARKED = " || ".join(f"case when contains(lower(content), '{m}') then ['Draft contains uncertainty marker: ''{m}'''] else [] end" for m in drafts.UNCERTAIN)
_SPECULATED = f"""{_DRAFTS}, w as (select *, {_sql_long('content', 4)} as mine, {_sql_long(_CONTEXT, 4)} as theirs from drafts),
i as (select *, case when trim(content) = '' then ['Draft is empty'] else (case when strlen(content) < 10 then ['Draft is too short'] else [] end) || (case when len(context) > 0 and coalesce(len(list_intersect(mine, theirs)) / nullif(len(mine), 0), 0) < 0.1 then ['Draft does not appear to use information from context'] else [] end) || {_MARKED} end as issues from w),
s as (select *, round(case when trim(content) = '' then 0 else least(1, greatest(0, 1.0::double - len(issues) * 0.15::double + (confidence - 0.5) * 0.2 + case when len(context) > 0 then (list_sum(scores) / len(scores) - 0.5) * 0.3 else 0 end)) end, 6) as speculation from i),
speculated as (select *, case when speculation >= 0.9 then 'accept' when speculation <= 0.3 then 'reject' else 'revise' end as decision from s)"""


@query(f"with {_SPECULATED} select query_id, array_to_string(issues, '; ') as issues, speculation, decision from speculated")
def draft_speculate(spark, d):
    return drafts.speculated(_drafts(spark, d)).select("query_id", F.array_join("issues", "; ").alias("issues"), "speculation", "decision")


@query(f"""with {_SPECULATED} select query_id, case when len(context) > 0 then 'Based on the available information: ' || array_to_string(list_transform(context[1:3], lambda t: left(t, 100)), ' ... ') || chr(10) || chr(10) || content else content end || case when len(issues) > 0 then chr(10) || chr(10) || '[Revision notes: ' || array_to_string(issues, '; ') || ']' else '' end as content, round(speculation + 0.1, 6) as confidence from speculated where decision = 'revise'""")
def draft_revise(spark, d):
    r = drafts.revised(drafts.speculated(_drafts(spark, d)).filter("decision = 'revise'"))
    return r.select("query_id", "content", rounded(F.col("confidence")).alias("confidence"))


def _sql_grams(text: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({text}) - {n - 2}), lambda i: substring({text}, i, {n})))"


def _sql_jaccard(n: int) -> str:
    a, b = f"a{n}", f"b{n}"
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) else 0 end"


def _sql_assertions(text: str) -> str:
    low = f"list_filter(list_transform({sql_sentences(text)}, lambda s: lower(s)), lambda s: strlen(s) >= 5)"
    one = "list_filter(list_transform([' is ', ' are ', ' was ', ' were '], lambda m: case when position(m in s) > 0 then {'subject': trim(left(s, position(m in s) - 1)), 'said': trim(substring(s, position(m in s) + length(m)))} end), lambda x: x is not null and x.subject != '' and x.said != '')"
    negated = " or ".join("contains(x.said, '{}')".format(n.replace("'", "''")) for n in drafts.NEGATIONS)
    return f"list_transform(flatten(list_transform({low}, lambda s: {one})), lambda x: {{'subject': x.subject, 'said': x.said, 'negated': {negated}}})"


def _sql_count(sign: str) -> str:
    shared = f"len(list_filter({sql_words('p.said')}, lambda w: contains(q.said, w))) > 0"
    return f"coalesce(list_sum(list_transform(mine_a, lambda p: len(list_filter(theirs_a, lambda q: (contains(p.subject, q.subject) or contains(q.subject, p.subject)) and p.negated {sign} q.negated and {shared})))), 0)"


_STAGES = f"""{_DRAFTS}, k as (select *, {_sql_long('lower(content)', 3)} as mine, {_sql_long(f'lower({_CONTEXT})', 3)} as theirs, lower(content) as lc, lower({_CONTEXT}) as lx from drafts),
ng as (select *, {', '.join(f"{_sql_grams('lc', n)} as a{n}, {_sql_grams('lx', n)} as b{n}" for n in (3, 4, 5))}, {_sql_assertions('content')} as mine_a, {_sql_assertions(_CONTEXT)} as theirs_a from k),
f as (select *, {_sql_count('=')} as good, {_sql_count('!=')} as bad from ng),
stages as (select query_id, case when len(context) = 0 then 0.5::double else round(coalesce(len(list_intersect(mine, theirs)) / nullif(len(mine), 0), 0), 6) end as keyword, len(context) = 0 or len(mine) = 0 or len(list_intersect(mine, theirs)) >= 0.1 * len(mine) as keyword_on,
case when len(context) = 0 then 0.5::double else round(0.2::double * {_sql_jaccard(3)} + 0.3::double * {_sql_jaccard(4)} + 0.5::double * {_sql_jaccard(5)}, 6) end as ngram,
case when len(context) = 0 then 0.5::double when len(mine_a) = 0 then 0.7::double else round(greatest(0, least(1, case when good + bad > 0 then good / (good + bad) else 0.6::double end - bad * 0.2::double)), 6) end as factual from f)"""


@query(f"with {_STAGES} select query_id, keyword, ngram, factual from stages")
def draft_stages(spark, d):
    q = _drafts(spark, d)
    made = {n: f(F.col("content"), F.col("context"))[0] for n, f in drafts.STAGES.items()}
    return q.select("query_id", *[rounded(c).alias(n) for n, c in made.items()])


@query(f"""with {_STAGES}, r as (select query_id, case when not keyword_on or keyword >= 0.95 or keyword <= 0.1 then [keyword] when ngram < 0.5 or ngram >= 0.95 then [keyword, ngram] else [keyword, ngram, factual] end as ran from stages)
select query_id, len(ran)::int as stages, round(list_sum(ran) / len(ran), 6) as verification, round(list_sum(list_transform(ran, lambda x, i: x * i)) / (len(ran) * (len(ran) + 1) / 2), 6) as weighted, case when round(list_sum(ran) / len(ran), 6) >= 0.95 then 'accept' when round(list_sum(ran) / len(ran), 6) <= 0.1 then 'reject' else 'revise' end as verdict from r""")
def draft_verify(spark, d):
    v = drafts.verified(_drafts(spark, d))
    return v.select("query_id", F.size("ran").alias("stages"), "verification", rounded(drafts.aggregated("ran", "weighted")).alias("weighted"), "verdict")


@query(f"with {_STAGES}, v as (select query_id, {_sql_long('lower(content)', 3)} as mine, {_sql_long(f'lower({_CONTEXT})', 3)} as theirs from drafts) select query_id, round(case when len(mine) = 0 or len(theirs) = 0 then 0.5 else 0.5 + 0.5 * len(list_intersect(mine, theirs)) / len(mine) end, 6)::double as supported from v")
def draft_supported(spark, d):
    return _drafts(spark, d).select("query_id", rounded(drafts.supported("content", F.array_join("context", " "))).alias("supported"))


# calibration: the answers' confidences against the judgments of their questions ---------------------------------------


def _outcomes(spark, d) -> DataFrame:
    right = judgments(spark, d).filter("relevant is not null").groupBy("query_id").agg(F.avg(F.col("relevant").cast("double")).alias("share"))
    return log(spark, d).select("query_id", F.col("confidence").cast("double").alias("predicted")).join(right, "query_id").select("query_id", "predicted", (F.col("share") > 0.5).alias("correct"))


_OUTCOMES = f"{LOG}, {JUDGMENTS}, outcomes as (select query_id, confidence as predicted, avg(relevant::int) > 0.5 as correct from log join judgments j using (query_id) where relevant is not null group by query_id, confidence)"
_KNOWN = f"{_OUTCOMES}, known as (select * from outcomes where predicted is not null)"


@query(f"with {_KNOWN}, b as (select floor(predicted * 10)::int as bin, count(*) as n, count(*) filter (correct) as k from known where predicted >= 0 and predicted < 1 group by 1) select i::int as bin, round((i + 0.5) / 10, 6)::double as centre, coalesce(n, 0) as n, round(coalesce(k / n, (i + 0.5) / 10), 6)::double as value from range(10) r(i) left join b on b.bin = i")
def calibration_histogram(spark, d):
    return calibration.histogram(_outcomes(spark, d))


def _sql_statistics(p: str) -> str:
    return f"with {_KNOWN}, c as (select {p} as p, correct::int::double as t from known), b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as p, avg(t) as t, sum((p - t) ** 2) as s from c group by 1) select coalesce(sum(n), 0)::bigint as n, round(coalesce(sum(abs(p - t) * n) / sum(n), 0), 6) as ece, round(coalesce(max(abs(p - t)), 0), 6) as mce, round(coalesce(sum(s) / sum(n), 0), 6) as brier from b"


@query(_sql_statistics("predicted"))
def calibration_statistics(spark, d):
    return calibration.statistics(_outcomes(spark, d))


_TEMPERED = "1 / (1 + exp(-ln(greatest(1e-7, least(1 - 1e-7, predicted)) / (1 - greatest(1e-7, least(1 - 1e-7, predicted)))) / 1.5))"


@query(_sql_statistics(_TEMPERED))
def calibration_temperature_statistics(spark, d):
    return calibration.statistics(_outcomes(spark, d), calibration.by_temperature(F.col("predicted"), 1.5))


@query(f"with {_KNOWN} select query_id, round({_TEMPERED}, 6) as calibrated from known")
def calibration_temperature(spark, d):
    return _outcomes(spark, d).filter("predicted is not null").select("query_id", rounded(calibration.by_temperature(F.col("predicted"), 1.5)).alias("calibrated"))


_PLATT = f"""with recursive {_KNOWN}, ce as (select floor(greatest(0, least(1, predicted)) * 10000) as cell, avg(predicted) as x, count(*) as n, count(*) filter (correct) as k from known group by 1), total as (select sum(n) as t from ce),
fit(i, a, b) as (select 0, 1.0::double, 0.0::double union all select i + 1, a - 0.1::double * sum((n / (1 + exp(-(a * x + b))) - k) * x) / any_value(t), b - 0.1::double * sum(n / (1 + exp(-(a * x + b))) - k) / any_value(t) from fit, ce, total where i < 100 group by i, a, b)"""


@query(f"{_PLATT} select query_id, round(1 / (1 + exp(-(a * greatest(0, least(1, predicted)) + b))), 6) as calibrated from known, fit where i = 100")
def calibration_platt(spark, d):
    rows = _outcomes(spark, d)
    a, b = calibration.fit_platt(rows)
    return rows.filter("predicted is not null").select("query_id", rounded(calibration.by_platt(F.col("predicted"), a, b)).alias("calibrated"))


# by the greatest convex minorant: a cell's value is the greatest, over beginnings, of the least mean of a stretch around it, and a block begins
# where the sums of values and outcomes meet
_ISOTONIC = f"""with {_KNOWN}, ce as (select floor(greatest(0, least(1, predicted)) * 10000) as cell, min(predicted) as x, count(*) as n, count(*) filter (correct) as k from known group by 1),
o as (select row_number() over (order by cell) as i, x, n, k, sum(n) over (order by cell) as sn, sum(k) over (order by cell) as sk from ce),
means as (select a.i as j, b.i as e, (b.sk - a.sk + a.k) / (b.sn - a.sn + a.n) as m from o a join o b on b.i >= a.i), least_means as (select j, e, min(m) over (partition by j order by e desc) as m from means),
fitted as (select o.i, x, n, k, sk, max(m) as y from o join least_means on e = o.i group by all), summed as (select *, sum(n * y) over (order by i) - sk as over from fitted),
starts as (select x, y from summed qualify i = 1 or abs(lag(over) over (order by i)) < 1e-7), ends as (select x, y from starts union all select 0.0, 0.0 from starts having min(x) > 0 union all select 1.0, 1.0 from starts having max(x) < 1),
points as (select x, y, lead(x) over (order by x) as x2, lead(y) over (order by x) as y2 from ends), asked as (select query_id, greatest(0.0::double, least(1.0::double, predicted)) as p from known)"""


@query(f"{_ISOTONIC} select query_id, round(case when x2 is null then y else y + (p - x) * (y2 - y) / (x2 - x) end, 6) as calibrated from asked asof join points on p >= x")
def calibration_isotonic(spark, d):
    rows = _outcomes(spark, d)
    return rows.filter("predicted is not null").select("query_id", rounded(calibration.by_isotonic(F.col("predicted"), calibration.fit_isotonic(rows))).alias("calibrated"))


# the pipeline ----------------------------------------------------------------------------------------------------------


def answered(queries: DataFrame, results: DataFrame, fast: float = 0.95, skip: float = 0.9) -> DataFrame:
    """query_id, answer, confidence, layers, status: a draft whose best result scores `fast` is the answer; else it is
    speculated on (revised, or replaced if rejected), and one whose speculation reaches `skip` is the answer; the others go
    through the judge, whose confidence is averaged with the draft's."""
    from ..sources.scratch import cut

    d = drafts.speculated(drafts.drafts(queries, results)).withColumn("best", F.coalesce(F.array_max("scores"), F.lit(0.0)))
    quick = F.col("best") >= fast
    rejected = F.lit("I cannot provide a reliable answer based on the available information.")
    r = drafts.revised(d.select("query_id", "content", "confidence", "context", "issues", "speculation")).select("query_id", F.col("content").alias("revised"), F.col("confidence").alias("revised_confidence"))
    d = d.join(r, "query_id")
    changed = lambda plain, new, none: F.when(quick | (F.col("decision") == "accept"), plain).when(F.col("decision") == "revise", new).otherwise(none)
    d = d.withColumn("text", changed(F.col("content"), F.col("revised"), rejected)).withColumn("sure", changed(F.when(quick, F.col("best")).otherwise(F.col("confidence")), F.col("revised_confidence"), F.lit(0.2)))
    d = cut(d.withColumn("stage", F.when(quick, "fast").when(F.col("speculation") >= skip, "speculated").otherwise("judged")))
    done = d.filter("stage <> 'judged'").select("query_id", F.col("text").alias("answer"), rounded(F.col("sure")).alias("confidence"), F.when(F.col("stage") == "fast", "search").otherwise("search,speculation").alias("layers"), F.lit(None).cast("string").alias("status"))
    rest = d.filter("stage = 'judged'")
    whole = rest.select("query_id", F.concat_ws(" ", "text", F.array_join("context", " ")).alias("text"))
    verdicts = claims.judged(whole).select("query_id", F.col("status"), F.col("confidence").alias("c"))
    judged = rest.join(verdicts, "query_id").select("query_id", F.col("text").alias("answer"), rounded((F.col("sure") + F.col("c")) / 2).alias("confidence"), F.lit("search,speculation,judge").alias("layers"), "status")
    return done.unionByName(judged)


_REVISED = "case when len(context) > 0 then 'Based on the available information: ' || array_to_string(list_transform(context[1:3], lambda t: left(t, 100)), ' ... ') || chr(10) || chr(10) || content else content end || case when len(issues) > 0 then chr(10) || chr(10) || '[Revision notes: ' || array_to_string(issues, '; ') || ']' else '' end"
_PIPELINE = f"""{_SPECULATED.replace(_RESULTS, results_sql(5))}, q as (select *, coalesce(list_max(scores), 0) as best from speculated),
pa as (select *, case when best >= 0.95 or decision = 'accept' then content when decision = 'revise' then {_REVISED} else 'I cannot provide a reliable answer based on the available information.' end as said, case when best >= 0.95 then best when decision = 'accept' then confidence when decision = 'revise' then speculation + 0.1 else 0.2 end as sure,
case when best >= 0.95 then 'fast' when speculation >= 0.9 then 'speculated' else 'judged' end as stage from q),
whole as (select query_id as doc_id, concat_ws(' ', said, array_to_string(context, ' ')) as text from pa where stage = 'judged'), {claims_sql('whole').replace('s as (', 'sn as (', 1).replace(' from s),', ' from sn),', 1)},
jf as (select *, {_VERDICT} as v from (select * from claims qualify row_number() over (partition by doc_id order by pos) <= 10)), jg as (select doc_id, count(*) filter (confidence >= 0.5) as n, count(*) filter (confidence >= 0.5 and v = 'verified') as verified, count(*) filter (confidence >= 0.5 and v = 'falsified') as falsified from jf group by 1),
pipeline as (select query_id, said as answer, round(case when stage = 'judged' then (sure + round(case when n > 0 then verified / n else 0.5 end, 6)) / 2 else sure end, 6)::double as confidence, case stage when 'fast' then 'search' when 'speculated' then 'search,speculation' else 'search,speculation,judge' end as layers,
case when stage = 'judged' then case when n is null then 'unknown' when falsified > 0 then 'falsified' when verified = n then 'verified' else 'unknown' end end as status from pa left join jg on doc_id = query_id)"""


@query(f"with {_PIPELINE} select * from pipeline")
def pipeline(spark, d):
    """Search, draft, speculation and judge over the query set, the results of vector search as the context."""
    return answered(store_queries(spark, d), _results(spark, d, 5))


def chunks(answers: DataFrame, size: int = 50) -> DataFrame:
    """query_id, chunk, kind, content, progress: an answer replayed as a sequence of events, its text in pieces."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("answer") / size).cast("int") - 1, F.lit(0))), lambda i: F.substring("answer", i * size + 1, F.lit(size)))
    text = lambda k: lambda p: F.struct(F.lit(k).alias("kind"), p.alias("content"))
    layers = F.transform(F.split("layers", ","), text("layer_done"))
    events = F.concat(F.array(text("started")(F.lit(""))), layers, F.transform(pieces, text("text")), F.array(text("finished")(F.col("confidence").cast("string"))))
    e = answers.withColumn("events", events)
    return e.select("query_id", F.posexplode("events").alias("chunk", "e"), F.size("events").alias("n")).select("query_id", "chunk", "e.kind", "e.content", rounded((F.col("chunk") + 1) / F.col("n")).alias("progress"))


_CHUNKS = f"""with {_PIPELINE}, ce as (select query_id, [{{'kind': 'started', 'content': ''}}] || list_transform(string_split(layers, ','), lambda l: {{'kind': 'layer_done', 'content': l}}) || list_transform(range(0, greatest(1, ceil(length(answer) / 50)::int)), lambda i: {{'kind': 'text', 'content': substring(answer, (i * 50 + 1)::int, 50)}}) || [{{'kind': 'finished', 'content': confidence::varchar}}] as es from pipeline)
select query_id, c - 1 as chunk, es[c].kind as kind, es[c].content as content, round(c / len(es), 6) as progress from ce, unnest(range(1, len(es) + 1)) r(c)"""


@query(_CHUNKS)
def pipeline_chunks(spark, d):
    return chunks(pipeline(spark, d))


@query(_CHUNKS)
def stream_pipeline(spark, d):
    """Queries that arrive in files, answered batch by batch as events."""
    docs = store(spark, d)

    def work(asked: DataFrame) -> DataFrame:
        listed = search.knn(asked, docs, 5)
        texts = listed.join(docs.select("doc_id", "text", F.col("embedding").alias("vector")), "doc_id").join(asked.select("query_id", F.col("text").alias("query_text"), F.col("embedding").alias("query_vector")), "query_id")
        return chunks(answered(asked, texts))

    return arriving(spark, store_queries(spark, d), work)


def search_chunks(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk, kind, content, score: a search replayed as events: started, each result by its rank (its key as content), done."""
    each = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("rs"))  # at most k a query
    e = queries.select("query_id").join(each, "query_id", "left").withColumn("rs", F.coalesce("rs", F.array().cast(each.schema["rs"].dataType)))
    event = lambda kind, content, score: F.struct(F.lit(kind).alias("kind"), content.cast("string").alias("content"), score.cast("double").alias("score"))
    events = F.concat(F.array(event("search_started", F.lit(""), F.lit(None))), F.transform("rs", lambda r: event("result", r["doc_id"], r["score"])), F.array(event("search_done", F.size("rs"), F.lit(None))))
    return e.select("query_id", F.posexplode(events).alias("chunk", "e")).select("query_id", "chunk", "e.*")


@query(f"""with {_RESULTS}, sg as (select asked.query_id, coalesce(list({{'kind': 'result', 'content': doc_id, 'score': score}} order by rank) filter (doc_id is not null), []) as rs from asked left join results on results.query_id = asked.query_id group by 1),
se as (select query_id, [{{'kind': 'search_started', 'content': '', 'score': null}}] || rs || [{{'kind': 'search_done', 'content': len(rs)::varchar, 'score': null}}] as es from sg) select query_id, c - 1 as chunk, es[c].kind as kind, es[c].content as content, es[c].score as score from se, unnest(range(1, len(es) + 1)) r(c)""")
def pipeline_search_chunks(spark, d):
    return search_chunks(_results(spark, d), store_queries(spark, d))


def verification_chunks(texts: DataFrame, key: str = "doc_id", most: int = 10) -> DataFrame:
    """key, chunk, kind, content: a judgment replayed as events: started, each of the first `most` claims as found and with its verdict, done with the status."""
    c = claims.extracted(texts, key, "text", most).select(key, F.struct("pos", "sentence", claims.verdict().alias("v")).alias("c"))
    each = c.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    j = claims.judged(texts, key, "text", most).select(key, "status").join(each, key, "left").withColumn("cs", F.coalesce("cs", F.array().cast(each.schema["cs"].dataType)))
    event = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    middle = F.flatten(F.transform("cs", lambda x: F.array(event("claim_found", x["sentence"]), event("claim_judged", x["v"]))))
    events = F.concat(F.array(event("verification_started", F.lit(""))), middle, F.array(event("verification_done", F.col("status"))))
    return j.select(key, F.posexplode(events).alias("chunk", "e")).select(key, "chunk", "e.*")


@query(f"""with {STORE}, {claims_sql('store')}, vf as (select *, {_VERDICT} as v from (select * from claims qualify row_number() over (partition by doc_id order by pos) <= 10)),
vg as (select doc_id, flatten(list([{{'kind': 'claim_found', 'content': sentence}}, {{'kind': 'claim_judged', 'content': v}}] order by pos)) as cs, count(*) filter (confidence >= 0.5) as n, count(*) filter (confidence >= 0.5 and v = 'verified') as verified, count(*) filter (confidence >= 0.5 and v = 'falsified') as falsified from vf group by 1),
ve as (select doc_id, [{{'kind': 'verification_started', 'content': ''}}] || coalesce(cs, []) || [{{'kind': 'verification_done', 'content': case when cs is null then 'unknown' when falsified > 0 then 'falsified' when verified = n then 'verified' else 'unknown' end}}] as es from store left join vg using (doc_id))
select doc_id, c - 1 as chunk, es[c].kind as kind, es[c].content as content from ve, unnest(range(1, len(es) + 1)) r(c)""")
def pipeline_verification_chunks(spark, d):
    return verification_chunks(store(spark, d))
