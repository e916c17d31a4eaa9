"""Queries of the store's upkeep, distillation, service metrics and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import distill as D, service as S
from ..operators.ranking import rounded
from ..registry import query
from ..sources import tables as T
from ..streaming import flows
from .base import EXAMPLES, LOG, SQL_ALNUM, SQL_SPACE, STORE, examples, log, sql_words, store

# the store --------------------------------------------------------------------------------------------------------------


@query("select status, count(*) as n from (select case when embedding is null or len(embedding) != 3 then 'dimension' when row_number() over (partition by id order by (embedding is not null and len(embedding) = 3) desc) > 1 then 'duplicate' else 'ok' end as status from store_docs) group by 1")
def store_insert_checked(spark, d):
    """What becomes of the rows when they are inserted into an empty store of three dimensions."""
    return T.checked(T.table(spark, d, "store_docs"), "id", "embedding", 3).groupBy("status").agg(F.count("*").alias("n"))


_HALVES = f"{STORE}, old as (select doc_id, text from store where metadata['lang'] is distinct from 'fr'), new as (select doc_id, text || '!' as text from store where metadata['lang'] is distinct from 'de')"


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    s = store(spark, d)
    lang = F.element_at("metadata", "lang")
    return s.filter(~lang.eqNullSafe(F.lit("fr"))).select("doc_id", "text"), s.filter(~lang.eqNullSafe(F.lit("de"))).select("doc_id", F.concat("text", F.lit("!")).alias("text"))


@query(f"with {_HALVES} select * from new union all select * from old where doc_id not in (select doc_id from new)")
def store_upsert(spark, d):
    return T.upsert(*_halves(spark, d), "doc_id")


@query(f"with {_HALVES} select * from old union all select * from new where doc_id not in (select doc_id from old)")
def store_merge_keep(spark, d):
    return T.merge(*_halves(spark, d), "doc_id")


@query(f"with {_HALVES} select * from new union all select * from old where doc_id not in (select doc_id from new)")
def store_merge_overwrite(spark, d):
    return T.merge(*_halves(spark, d), "doc_id", overwrite=True)


@query(f"with {_HALVES} select * from old where doc_id not in (select doc_id from new)")
def store_vacuum(spark, d):
    old, new = _halves(spark, d)
    return T.delete(old, new, "doc_id")


@query(f"with {_HALVES} select distinct doc_id from new where doc_id not in (select doc_id from old)")
def store_missing(spark, d):
    old, new = _halves(spark, d)
    return T.missing(new, old, "doc_id")


@query("select count(*) as documents, 64 as dimension, count(*) * (4 * 64 + 256) as memory_bytes, count(*) filter (label = 0) / count(*) as fragmentation from embeddings")
def store_statistics(spark, d):
    """With the vectors of label 0 waiting to be deleted."""
    e = T.table(spark, d, "embeddings")
    return T.statistics(e, "embedding", e.filter("label = 0"))


@query(f"with {STORE} select doc_id, text, title, source from store")
def store_snapshot(spark, d):
    """All records written to a version and read back."""
    from ..sources.scratch import shared_folder

    folder = f"{shared_folder(spark)}/snapshots"
    return T.restore(spark, folder, T.snapshot(store(spark, d).select("doc_id", "text", "title", "source"), folder))


@query(f"with {_HALVES} select * from old where doc_id in (select doc_id from new)")
def store_get(spark, d):
    old, new = _halves(spark, d)
    return T.get(old, new, "doc_id")


@query(f"with {_HALVES} select old.doc_id, new.text from old join new using (doc_id) union all select * from old where doc_id not in (select doc_id from new)")
def store_update(spark, d):
    """The rows of one half with the texts of the other where it has any."""
    old, new = _halves(spark, d)
    return T.update_vectors(old, new, "doc_id", "text")


@query(f"with {STORE} select doc_id, text from store where metadata['lang'] is distinct from 'fr'")
def store_compacted(spark, d):
    from ..sources.scratch import shared_folder

    return T.compacted(_halves(spark, d)[0], f"{shared_folder(spark)}/compacted-{uuid.uuid4().hex}", by="doc_id")


@query(f"with {STORE} select doc_id, text, title, metadata from store")
def store_json(spark, d):
    """All records written as JSON and read back."""
    from ..sources.scratch import shared_folder

    folder, rows = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}", store(spark, d).select("doc_id", "text", "title", "metadata")
    T.export_json(rows, folder)
    return T.import_json(spark, folder, rows.schema)


@query("select status, count(*) as n from (select case when content is null then 'dimension' when row_number() over (partition by id order by (content is not null) desc) > 1 then 'duplicate' else 'ok' end as status from store_docs where id is not null) group by 1")
def store_index_batch(spark, d):
    """What becomes of the rows when they are embedded and indexed as a batch."""
    from ..functions.embedding import hashed

    docs = T.table(spark, d, "store_docs").filter("id is not null").select("id", "content")
    return T.with_vectors(docs, "id", "content", lambda t: hashed(t, 16), 16).groupBy("status").agg(F.count("*").alias("n"))


# distillation -------------------------------------------------------------------------------------------------------------

_PATTERN = f"array_to_string({sql_words(f'''regexp_replace(lower(text), '[^{SQL_ALNUM}{SQL_SPACE}]+', '', 'g')''')}, ' ')"
_PAIRS = f"{LOG}, r as (select *, {_PATTERN} as pattern from log where text is not null), f as (select pattern, text, answer, min(ts) as ts, arg_min_null(confidence, ts) as confidence from r where answer is not null and pattern != '' group by 1, 2, 3), pairs as (select *, row_number() over (partition by pattern order by ts, text, answer) - 1 as place from f qualify row_number() over (partition by pattern order by ts, text, answer) <= 50)"
_CANDIDATES = f"""{_PAIRS}, seen as (select pattern, count(*) as frequency, min(ts) as first_seen, max(ts) as last_seen from r where pattern != '' group by 1), kept as (select pattern, count(*) as pairs, avg(confidence) as confidence from pairs group by 1),
c as (select pattern, frequency, coalesce(pairs, 0) as pairs, round(coalesce(confidence, 0), 6) as confidence, first_seen, last_seen from seen left join kept using (pattern)),
candidates as (select *, frequency >= 5 and pairs >= 1 and confidence >= 0.85 as ready, round(0.4::double * frequency + 35 * confidence + 0.25::double * pairs, 6) as priority from c)"""


@query(f"with {LOG}, r as (select {_PATTERN} as pattern from log where text is not null) select pattern, count(*) as n from r where pattern != '' group by 1")
def query_patterns(spark, d):
    return log(spark, d).filter("text is not null").groupBy(D.pattern("text").alias("pattern")).agg(F.count("*").alias("n")).filter("pattern <> ''")


@query(f"with {_PAIRS} select pattern, text, answer, place from pairs")
def qa_pairs(spark, d):
    return D.pairs(log(spark, d)).select("pattern", "text", "answer", "place")


@query(f"with {_CANDIDATES} select pattern, frequency, pairs, confidence, ready, priority from candidates")
def distill_candidates(spark, d):
    return D.candidates(log(spark, d)).select("pattern", "frequency", "pairs", "confidence", "ready", "priority")


@query(f"with {_CANDIDATES} select pattern, priority from candidates where ready order by priority desc, pattern limit 10")
def distill_top_ready(spark, d):
    """The ten most urgent ready candidates."""
    return D.candidates(log(spark, d)).filter("ready").orderBy(F.col("priority").desc(), "pattern").limit(10).select("pattern", "priority")


@query(f"with {_CANDIDATES} select count(*) as candidates, count(*) filter (ready) as ready, round(coalesce(avg(ready::int), 0), 6) as ratio from candidates")
def distill_readiness(spark, d):
    return D.readiness(D.candidates(log(spark, d)))


@query(f"with {_CANDIDATES} select pattern, frequency, confidence from candidates where not ready and frequency >= 3")
def distill_near_ready(spark, d):
    return D.candidates(log(spark, d)).filter("not ready and frequency >= 3").select("pattern", "frequency", "confidence")


@query(f"with {_CANDIDATES} select pattern from candidates where frequency >= 5 and pairs >= 3 and confidence >= 0.7")
def distill_triggered(spark, d):
    return D.candidates(log(spark, d)).filter(D.DEFAULT_TRIGGER.column()).select("pattern")


@query(f"with {_CANDIDATES} select pattern from candidates where epoch(timestamptz '2026-01-01 00:00:00+00') - floor(epoch(last_seen)) > 7776000")
def distill_inactive(spark, d):
    return D.inactive(D.candidates(log(spark, d)), "2026-01-01 00:00:00", 90 * 86400).select("pattern")


@query(f"with {_PAIRS}, per as (select pattern, count(*) as n, sum(coalesce(confidence, 0)) as c from pairs group by 1) select sum(n)::bigint as pairs, count(*) as patterns, round(sum(c) / sum(n), 6) as confidence, round(avg(n), 6) as pairs_per_pattern from per")
def qa_statistics(spark, d):
    return D.pair_statistics(D.pairs(log(spark, d)))


@query(f"with {_PAIRS} select text as input, answer as output, round(confidence, 6) as confidence from pairs where confidence >= 0.7")
def qa_export(spark, d):
    """Pairs sure enough to train on."""
    return D.exported(D.pairs(log(spark, d)), 0.7)


@query(f"with {_PAIRS} select pattern, count(*) as pairs, round(avg(coalesce(confidence, 0)), 6) as confidence from pairs group by 1")
def qa_pattern_confidence(spark, d):
    return D.pairs(log(spark, d)).groupBy("pattern").agg(F.count("*").alias("pairs"), rounded(F.avg(F.coalesce("confidence", F.lit(0.0)))).alias("confidence"))


@query(f"with {_PAIRS} select pattern, text, answer from pairs where epoch(timestamptz '2025-12-01 00:00:00+00') - floor(epoch(ts)) > 7776000")
def qa_expired(spark, d):
    """Pairs more than ninety days old."""
    return D.expired(D.pairs(log(spark, d)), "2025-12-01 00:00:00", 90 * 86400).select("pattern", "text", "answer")


_SIMILAR = f"""{LOG}, ps as (select distinct {_PATTERN} as pattern from log where text is not null), w as (select pattern, list_distinct(string_split(pattern, ' ')) as ws from ps where pattern != ''),
r as (select unnest(ws) as w, count(*) as n from w group by 1), o as (select pattern, w.ws, list(x.w order by n, x.w) as o from w, unnest(w.ws) x(w) join r on r.w = x.w group by 1, 2), f as (select pattern, ws, unnest(o[1 : len(ws) - ceil(0.9 * len(ws) - 1e-9)::int + 1]) as w from o),
met as (select distinct a.pattern as first, b.pattern as second, a.ws as x, b.ws as y from f a join f b using (w) where a.pattern < b.pattern), similar_pairs as (select first, second, len(list_intersect(x, y)) / len(list_distinct(x || y)) as similarity from met)"""


@query(f"with {_SIMILAR} select first, second, round(similarity, 6) as similarity from similar_pairs where similarity >= 0.9 - 1e-9")
def query_patterns_similar(spark, d):
    """Patterns nine tenths of whose words are the same."""
    return D.similar_patterns(log(spark, d).filter("text is not null").select(D.pattern("text").alias("pattern")), 0.9)


_EVAL = f"{EXAMPLES}, x as (select *, len(list_distinct({sql_words('lower(input)')} || {sql_words('lower(output)')})) as u, len(list_intersect(list_distinct({sql_words('lower(input)')}), list_distinct({sql_words('lower(output)')}))) as i from (select coalesce(input, '') as input, coalesce(output, '') as output from examples)), h as (select *, case when u > 0 then i / u >= 0.85 else true end as hit from x), c as (select count(*) as n, count(*) filter (hit) as tp, count(*) filter (not hit and output != '') as fp, count(*) filter (not hit and input != '') as fn from h)"


@query(f"with {_EVAL}, r as (select *, tp / n as a, tp / (tp + fp) as p, tp / (tp + fn) as q from c) select n, round(a, 6) as accuracy, round(p, 6) as precision, round(q, 6) as recall, round(2 * p * q / (p + q), 6) as f1 from r")
def evaluate_overlap(spark, d):
    """A student that gives the questions back, against the collected answers."""
    e = examples(spark, d).select("output", F.col("input").alias("expected"))
    return D.evaluated(e, D.matched(F.col("output"), F.col("expected"), "overlap"))


_MODELS = "models as (select event_type as pattern, 'm' || (user_id % 7) as model, round(avg(value), 6) as accuracy, round(avg(case when event_type = 'error' then value + 1 else value end), 6) as latency, count(*) as uses from events group by 1, 2)"


def _models(spark, d) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("pattern"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model")).agg(rounded(F.avg("value")).alias("accuracy"), rounded(F.avg(F.when(F.col("event_type") == "error", F.col("value") + 1).otherwise(F.col("value")))).alias("latency"), F.count("*").alias("uses"))


def _register_models() -> None:
    for by, order in (("accuracy", "accuracy desc"), ("latency", "latency"), ("uses", "uses desc")):
        query(f"with {_MODELS} select * from models qualify row_number() over (partition by pattern order by {order}, model) = 1", f"model_select_{by}")(lambda spark, d, b=by: D.best_models(_models(spark, d), b))


_register_models()

_USED = "used as (select 'm' || (user_id % 7) as model, round(avg(value), 6) as accuracy, round(avg(case when event_type = 'error' then value + 1 else value end), 6) as latency, count(*) as uses, max(ts) as last_used from events where event_type in ('error', 'purchase') group by 1)"


def _used(spark, d) -> DataFrame:
    e = T.table(spark, d, "events").filter("event_type in ('error', 'purchase')")
    return e.groupBy(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model")).agg(rounded(F.avg("value")).alias("accuracy"), rounded(F.avg(F.when(F.col("event_type") == "error", F.col("value") + 1).otherwise(F.col("value")))).alias("latency"), F.count("*").alias("uses"), F.max("ts").alias("last_used"))


@query(f"with {_USED}, a as (select *, epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(last_used)) <= 90000 as active from used) select count(*) as models, count(*) filter (active) as active, sum(uses)::bigint as uses, round(coalesce(avg(latency) filter (active), 0), 6) as latency, round(coalesce(avg(accuracy) filter (active), 0), 6) as accuracy from a")
def model_statistics(spark, d):
    return D.registry_statistics(D.stale(_used(spark, d), "2024-01-31 00:00:00", 90_000))


@query(f"with {_MODELS}, n as (select pattern, list(model order by model) as names from models group by 1) select event_id, event_type as pattern, names[(row_number() over (partition by event_type order by ts, event_id) - 1) % len(names) + 1] as model from events join n on pattern = event_type")
def model_select_turns(spark, d):
    """Every event's model, the models of a kind of event taking turns."""
    e = T.table(spark, d, "events").select("event_id", F.col("event_type").alias("pattern"), "ts")
    return D.turns(e, _models(spark, d)).select("event_id", "pattern", "model")


_RATIO = "case when {1} > 0 then {0} / {1} else 0 end"


@query(f"with {_MODELS}, t as (select * from models qualify row_number() over (partition by pattern order by accuracy desc, model) = 1), r as (select m.pattern, m.model, {_RATIO.format('m.accuracy', 't.accuracy')} as retention, {_RATIO.format('t.latency', 'm.latency')} as speedup, {_RATIO.format('t.uses', 'm.uses')} as compression from models m join t using (pattern)) select *replace (round(retention, 6) as retention, round(speedup, 6) as speedup, round(compression, 6) as compression), round(retention * 0.5 + least(speedup / 10, 1) * 0.3 + least(compression / 10, 1) * 0.2, 6) as quality from r")
def distill_compared(spark, d):
    """Every model against the surest of its pattern."""
    m = _models(spark, d)
    side = lambda df: df.select("pattern", "model", F.struct("accuracy", F.col("latency").alias("latency_ms"), F.col("uses").alias("size")).alias("m"))
    pairs = side(m).join(side(D.best_models(m)).select("pattern", F.col("m").alias("t")), "pattern")
    return pairs.select("pattern", "model", D.compared(F.col("t"), F.col("m")).alias("c")).select("pattern", "model", *[rounded(F.col(f"c.{x}")).alias(x) for x in ("retention", "speedup", "compression", "quality")])


_EPOCHS = "epochs as (select event_type as run, date_diff('day', timestamp '2024-01-01', ts) as epoch, round(avg(value), 6) as loss from events group by 1, 2)"


def _epochs(spark, d) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("run"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("epoch")).agg(rounded(F.avg("value")).alias("loss"))


@query(f"with {_EPOCHS} select run, epoch, loss, min(loss) over w as best, round(loss - lag(loss) over w, 6) + 0.0 as change, count(*) over p >= 3 and min(loss) over p >= first_value(loss) over p as converged from epochs window w as (partition by run order by epoch), p as (partition by run order by epoch rows between 2 preceding and current row)")
def training_convergence(spark, d):
    """The mean value of a kind of event by day, seen as a loss by epoch."""
    return D.training_history(_epochs(spark, d))


@query(f"with {_EPOCHS} select run, min_by(epoch, (loss, epoch)) as best_epoch, round((min_by(loss, epoch) - max_by(loss, epoch)) / (count(*) - 1), 6) + 0.0 as rate from epochs group by 1")
def training_improvement(spark, d):
    return D.improvement(_epochs(spark, d))


# service ------------------------------------------------------------------------------------------------------------------


@query("with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null and event_type is not null) select event_type, p as percent, value from s, (values (50), (95), (99)) t(p) where k = floor(greatest(n * p - 1, 1) / 100)")
def latency_percentiles(spark, d):
    return S.nearest_rank(T.table(spark, d, "events"), "event_type", "value")


@query("select event_type, count(*) as requests, count(*) filter (value > 10) as succeeded, round(count(*) filter (value > 10) / count(*), 6) as rate, round(avg(value) filter (value > 10), 6) as mean, min(value) as least, max(value) as most from events group by 1")
def latency_summary(spark, d):
    return S.summary(T.table(spark, d, "events"), "event_type", "value", F.col("value") > 10)


@query("select i as attempt, least(5000.0::double, 100.0::double * 2 ** i) as delay_ms from range(8) r(i)")
def retry_delays(spark, d):
    return spark.range(8).select(F.col("id").alias("attempt"), S.retry_delay(F.col("id")).alias("delay_ms"))


@query(f"with {LOG}, t as (select distinct text from log where text is not null and text != ''), n as (select query_id, text, unnest(list_distinct(case when length(text) > 16 then list_append(range(16, length(text) + 1, 16), length(text)) else [length(text)] end)) as n from log where text is not null), m as (select query_id, n.text, n from n join t on t.text = left(n.text, n)) select query_id, max(n)::int as length, case when bool_or(n = length(text)) then 'hit' else 'partial' end as kind from m group by 1")
def cache_prefixes(spark, d):
    """For each question the longest question of the log that it begins with."""
    q = log(spark, d)
    return S.prefix_hits(q.select("query_id", "text"), q.select("text"))


@query(f"with {LOG}, t as (select distinct text from log where text is not null and text != '') select a.text, count(*) as n, max(length(b.text))::int as longest from t a join t b on b.text > a.text and b.text < a.text || chr(1114111) and starts_with(b.text, a.text) group by 1")
def cache_extensions(spark, d):
    """For each question the longer questions of the log that begin with it."""
    q = log(spark, d).select("text")
    return S.extensions(q, q)


@query(f"with s as (select {_PATTERN} as k, floor(epoch(ts))::bigint as s, count(*) as n from query_log where ts is not null and text is not null group by 1, 2), g as (select *, s - lag(s) over (partition by k order by s) as gap from s) select sum(n)::bigint as requests, sum((gap is null or gap >= 3600)::int)::bigint as misses, round((sum(n) - sum((gap is null or gap >= 3600)::int)) / sum(n), 6) as hit_rate from g")
def cache_replay(spark, d):
    """Every row of the log as a request for its pattern."""
    return S.cache_replay(T.table(spark, d, "query_log"), D.pattern("text"))


@query(f"with s as (select {_PATTERN} as k, count(*) as hits, epoch(timestamptz '2025-12-31 00:00:00+00') - floor(epoch(max(ts))) as idle from query_log where text is not null and ts is not null group by 1) select case when hits >= 3 and idle <= 300 then 'L1' when hits >= 3 or idle <= 600 then 'L2' else 'L3' end as tier, count(*) as n from s group by 1")
def cache_tiers(spark, d):
    s = T.table(spark, d, "query_log").filter("text is not null and ts is not null").groupBy(D.pattern("text").alias("k")).agg(F.count("*").alias("hits"), F.max("ts").alias("last"))
    idle = F.unix_timestamp(F.lit("2025-12-31 00:00:00").cast("timestamp")) - F.unix_timestamp("last")
    return s.groupBy(S.tier(idle, F.col("hits")).alias("tier")).agg(F.count("*").alias("n"))


@query(f"with {LOG} select query_id, strlen(text) as bytes, left(text, 20) as summary from log where text is not null")
def cache_fingerprints(spark, d):
    """Of every question, without its hash."""
    f = S.fingerprint("text", 20)
    return log(spark, d).filter("text is not null").select("query_id", f["bytes"].alias("bytes"), f["summary"].alias("summary"))


_AGES = f"with s as (select {_PATTERN} as k, epoch(timestamptz '2025-12-31 00:00:00+00') - floor(epoch(min(ts))) as age, epoch(timestamptz '2025-12-31 00:00:00+00') - floor(epoch(max(ts))) as idle from query_log where text is not null and ts is not null group by 1)"


@query(f"{_AGES} select age > 17280000 or idle > 7776000 as gone, count(*) as n from s group by 1")
def cache_invalidated(spark, d):
    """How many questions' entries are too old or too long unused at the end of the year."""
    s = T.table(spark, d, "query_log").filter("text is not null and ts is not null").groupBy(D.pattern("text").alias("k")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    since = lambda c: F.unix_timestamp(F.lit("2025-12-31 00:00:00").cast("timestamp")) - F.unix_timestamp(c)
    return s.groupBy(S.invalid(since("a"), since("b"), most_age=17280000, most_idle=7776000).alias("gone")).agg(F.count("*").alias("n"))


@query(f"{_AGES} select k, idle from s where idle <= 7776000")
def cache_persisted(spark, d):
    """The entries that are left when the cache is written, read again and cleared of what was long unused."""
    from ..sources.scratch import shared_folder

    s = T.table(spark, d, "query_log").filter("text is not null and ts is not null").groupBy(D.pattern("text").alias("k")).agg(F.max("ts").alias("last"))
    folder = f"{shared_folder(spark)}/cache"
    entries = T.restore(spark, folder, T.snapshot(s, folder))
    idle = F.unix_timestamp(F.lit("2025-12-31 00:00:00").cast("timestamp")) - F.unix_timestamp("last")
    return entries.select("k", idle.alias("idle")).filter(~S.invalid(F.lit(0), F.col("idle"), most_idle=7776000))


# windows ------------------------------------------------------------------------------------------------------------------

_BUCKET = "time_bucket(interval '6 hours', ts)"


@query(f"select {_BUCKET} as start, {_BUCKET} + interval '6 hours' as \"end\", event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def window_tumbling(spark, d):
    return flows.windowed(T.table(spark, d, "events"), "ts", ["event_type"], "6 hours", value="value")


@query(f"with e as (select time_bucket(interval '3 hours', ts) - i * interval '3 hours' as start, event_type, value from events, range(2) r(i)) select start, start + interval '6 hours' as \"end\", event_type, count(*) as n, round(sum(value), 6) as total from e group by all")
def window_sliding(spark, d):
    return flows.windowed(T.table(spark, d, "events"), "ts", ["event_type"], "6 hours", "3 hours", value="value")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select min(ts) as start, max(ts) + interval '30 minutes' as \"end\", user_id, count(*) as n from s group by user_id, s")
def window_session(spark, d):
    return flows.sessions(T.table(spark, d, "events"), "ts", ["user_id"], "30 minutes")
