"""Queries of claims and the knowledge graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import claims as C, dependency, graph as G
from ..operators.ranking import rounded
from ..registry import query
from ..sources.scratch import cut
from ..sources.tables import table
from .base import STORE, sql_bare, sql_sentences, sql_strings, sql_strip, sql_words, store


def _map(table_: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in table_.items()) + "}"


def _place(known, first: int, tokens: str = "ts") -> str:
    return f"list_min(list_filter(list_transform({tokens}, lambda t, i: case when list_contains({sql_strings(known)}, t) and i >= {first + 1} and i < len({tokens}) then i end), lambda i: i is not null))"


def _join(tokens: str, a: str, b: str) -> str:
    return f"array_to_string({tokens}[{a} : {b}], ' ')"


_COND_REST = "case " + " ".join(f"when starts_with(lower(sentence), '{w}') then {sql_strip(f'substring(sentence, {len(w) + 1})')}" for w in C.CONDITIONS) + " end"
def claims_sql(source: str) -> str:
    """CTEs from the sentences s to `claims`, of the texts (doc_id, text) of a source."""
    return f"""s as (select doc_id, i - 1 as pos, ss[i] as sentence from (select doc_id, {sql_sentences('text')} as ss from {source} where text is not null), unnest(range(1, len(ss) + 1)) r(i)),
c1 as (select *, {sql_bare('sentence')} as ts, {_COND_REST} as rest from s),
c2 as (select *, case when position('then' in rest) > 0 then position('then' in rest) else position(',' in rest) end as cut_at, {_place(list(C.MODALS), 0)} as m, {_place(list(C.CAUSES), 1)} as ca, {_place(list(C.TIMES), 1)} as ti, {_place(list(C.COMPARISONS), 1)} as co, {_place(C.VERBS, 1)} as v from c1 where len(ts) >= 2),
c3 as (select *, ts[m + 1 :] as rs from c2), c4 as (select *, {_place(C.VERBS, 1, 'rs')} as w, case when coalesce(cut_at, 0) > 0 then 'implies' when m is not null then 'modal' when ca is not null then 'causal' when ti is not null then 'temporal' when co is not null then 'comparison' when v is not null then 'predicate' end as kind from c3),
c5 as (select *, case kind when 'causal' then ca when 'temporal' then ti when 'comparison' then co end as q from c4 where kind is not null),
claims as (select doc_id, pos, sentence, kind,
case kind when 'implies' then {sql_strip('left(rest, cut_at - 1)')} when 'modal' then case when w is null then array_to_string(rs, ' ') else {_join('rs', '1', 'w - 1')} end when 'predicate' then {_join('ts', '1', 'v - 1')} else {_join('ts', '1', 'q - 1')} end as "left",
case kind when 'modal' then {_map(C.MODALS)}[ts[m]] when 'causal' then {_map(C.CAUSES)}[ts[q]] when 'temporal' then {_map(C.TIMES)}[ts[q]] when 'comparison' then {_map(C.COMPARISONS)}[ts[q]] when 'predicate' then ts[v] end as operator,
case kind when 'implies' then {sql_strip("regexp_replace(substring(rest, cut_at), '^,*(?:then)*', '')")} when 'modal' then case when w is not null then rs[w] end when 'predicate' then null else {_join('ts', 'q + 1', 'len(ts)')} end as "right",
case when kind = 'modal' and w is not null then {_join('rs', 'w + 1', 'len(rs)')} when kind = 'predicate' then {_join('ts', 'v + 1', 'len(ts)')} end as object,
round(case kind when 'implies' then 0.65::double when 'modal' then 0.6::double when 'causal' then 0.65::double when 'temporal' then 0.7::double when 'comparison' then 0.7::double else least(0.9::double, 0.5::double + least(strlen(sentence) / 200, 0.4::double)) end * case when list_has_any(ts, {sql_strings(C.NEGATIONS)}) then 0.9::double else 1 end, 6) as confidence, list_has_any(ts, {sql_strings(C.NEGATIONS)}) as negated from c5)"""


_CLAIMS = f"{STORE}, {claims_sql('store')}"


def _claims(spark, d) -> DataFrame:
    return C.extracted(store(spark, d))


@query(f"with {_CLAIMS} select * from claims")
def claims_extract(spark, d):
    return _claims(spark, d)


def _register_kinds() -> None:
    for kind in ("implies", "modal", "causal", "temporal", "comparison", "predicate"):
        query(f"with {_CLAIMS} select negated, count(*) as n, count(distinct doc_id) as records, round(avg(confidence), 6) as confidence from claims where kind = '{kind}' group by negated", f"claims_{kind}")(
            lambda spark, d, k=kind: _claims(spark, d).filter(F.col("kind") == k).groupBy("negated").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("records"), rounded(F.avg("confidence")).alias("confidence"))
        )


_register_kinds()

_SYM = "'|' || replace({}, ' ', '_') || '|'"
_L, _R = _SYM.format('"left"'), _SYM.format('"right"')
_VERB = "'(' || {} || ' ' || " + _L + " || ' ' || " + _SYM.format("coalesce(object, 'true')") + " || ')'"
_BODY = f"""case kind when 'implies' then '(=> ' || {_L} || ' ' || {_R} || ')' when 'modal' then '(' || operator || ' ' || case when "right" is null then {_L} else {_VERB.format('"right"')} end || ')' when 'predicate' then {_VERB.format('operator')} else '(' || operator || ' ' || {_L} || ' ' || {_R} || ')' end"""


@query(f"with {_CLAIMS} select doc_id, pos, '(assert ' || case when negated then '(not ' || {_BODY} || ')' else {_BODY} end || ')' as smt from claims")
def claims_smtlib(spark, d):
    return _claims(spark, d).select("doc_id", "pos", C.smtlib().alias("smt"))


_NAME = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '_', 'g')"
_SAME = _NAME.format('"left"') + " = " + _NAME.format('"right"')
_NL, _NR = 'try_cast(trim("left") as bigint)', 'try_cast(trim("right") as bigint)'
_VERDICT = f"""case when negated then 'verified' when kind = 'comparison' then case when {_NL} is not null and {_NR} is not null then case when case operator when '>' then {_NL} > {_NR} when '<' then {_NL} < {_NR} else {_NL} = {_NR} end then 'verified' else 'falsified' end when {_SAME} and operator in ('<', '>') then 'falsified' else 'verified' end
when kind = 'temporal' and {_SAME} and operator in ('before', 'after') then 'falsified' else 'verified' end"""


@query(f"with {_CLAIMS} select kind, {_VERDICT} as verdict, count(*) as n from claims group by 1, 2")
def claims_verify(spark, d):
    return _claims(spark, d).groupBy("kind", C.verdict().alias("verdict")).agg(F.count("*").alias("n"))


_WHOLE = ", ".join(f"coalesce(lower(trim({c})), '') as {c}" for c in ("kind", '"left"', "operator", '"right"', "object"))


@query(f"""with {_CLAIMS}, w as (select doc_id, pos, sentence, confidence, negated, {_WHOLE} from claims) select doc_id, kind, "left", operator, "right", object, negated, count(*) as n, min_by(sentence, pos) as sentence, round(case when count(*) > 1 then least(1, avg(confidence) * 1.1) else avg(confidence) end, 6) as confidence from w group by all""")
def claims_deduplicate(spark, d):
    return C.deduplicated(_claims(spark, d))


@query(f"""with {_CLAIMS}, f as (select *, {_VERDICT} as v from (select * from claims qualify row_number() over (partition by doc_id order by pos) <= 10)), g as (select doc_id, count(*) as extracted, count(*) filter (confidence >= 0.5) as claims, count(*) filter (confidence >= 0.5 and v = 'verified') as verified, count(*) filter (confidence >= 0.5 and v = 'falsified') as falsified from f group by 1)
select doc_id, coalesce(claims, 0) as claims, coalesce(verified, 0) as verified, coalesce(falsified, 0) as falsified, case when extracted is null then 'unknown' when falsified > 0 then 'falsified' when verified = claims then 'verified' else 'unknown' end as status, round(case when claims > 0 then verified / claims else 0.5 end, 6)::double as confidence from store left join g using (doc_id)""")
def judge(spark, d):
    return C.judged(store(spark, d), "doc_id")


@query(f"""with {_CLAIMS}, g as (select doc_id, count(*) as claims, avg(confidence) as c from (select * from claims qualify row_number() over (partition by doc_id order by pos) <= 5) group by 1), h as (select doc_id, coalesce(claims, 0) as claims, round(coalesce(c, 0.5), 6)::double as confidence from store left join g using (doc_id)) select *, case when confidence >= 0.7 then 'verified' when confidence <= 0.3 then 'falsified' else 'unknown' end as status from h""")
def judge_quick(spark, d):
    return C.quickly_judged(store(spark, d), "doc_id")


_AGAINST = "map {" + ", ".join(f"'{p}': {sql_strings(q)}" for p, q in C._AGAINST.items()) + "}"
_LOW = ", ".join(f"coalesce(lower(trim({c})), '') as {n}" for c, n in (('"left"', "l"), ("operator", "o"), ('"right"', "r"), ("object", "b")))
_SPECIFIC = """case kind when 'implies' then 2 when 'causal' then 3 when 'modal' then case when "right" is null then 2 else 4 end else 3 end + negated::int"""


def _sided_sql(claims: str) -> str:
    """CTEs n, sides (a row for each conflict a claim may be part of), groups (those with several sides)."""
    opposed = f"list_distinct(coalesce({_AGAINST}[o], []) || ['not ' || o] || case when starts_with(o, 'not ') then [substring(o, 5)] else [] end)"
    pairs = "[least(l, r), greatest(l, r)]"
    two = lambda name, a, b: f"union all select *, '{name}', ['straight', l, r], o from n where kind = '{name}' and not negated and o in ('{a}', '{b}') union all select *, '{name}', ['crossed', o, least(l, r), greatest(l, r)], l from n where kind = '{name}' and not negated and o in ('{a}', '{b}')"
    return f"""n as (select doc_id, pos, kind, negated, confidence, {_SPECIFIC} as specific, {_LOW} from {claims}),
sides as (select *, 'contradiction' as conflict, [kind, l, o] as about, negated::varchar as side from n where kind = 'predicate' union all select *, 'contradiction', [kind, l, o, r, b], negated::varchar from n where kind != 'predicate'
union all select *, 'predicate', ['objects', l, o], b from n where kind = 'predicate' and not negated and b != '' union all select *, 'modal', [l, r, b], o from n where kind = 'modal' and not negated and o in ('necessarily', 'unlikely')
union all select *, 'causal', {pairs}, l from n where kind = 'causal' and not negated and l != r {two('comparison', '<', '>')} {two('temporal', 'before', 'after')}
union all select n.*, 'predicate', ['verbs', l, least(o, q), greatest(o, q)], o from n, unnest({opposed}) u(q) where kind = 'predicate' and not negated),
groups as (select conflict, about from sides group by all having count(distinct side) > 1)"""


@query(f"""with {_CLAIMS}, {_sided_sql('claims')} select conflict, about, side, kind, l as "left", o as operator, r as "right", b as object, negated, doc_id, pos, confidence from sides semi join groups using (conflict, about)""")
def claim_conflicts(spark, d):
    """Between all records, as disputes with their members."""
    return C.disputes(_claims(spark, d)).drop("structure")


@query(f"""with {_CLAIMS}, {_sided_sql('claims')}, cs as (select conflict, about, side, kind, l, o, r, b, negated, round(avg(confidence), 6) as c, max(specific) as s, min((doc_id, pos)) as at from sides semi join groups using (conflict, about) group by all),
cp as (select x.conflict as conflict, x.about, x.at as first, y.at as second, x.c - y.c as gap, x.s as s1, y.s as s2 from cs x join cs y on x.conflict = y.conflict and x.about = y.about and x.side != y.side and (x.at, x.l, x.o, x.r, x.b, x.negated) < (y.at, y.l, y.o, y.r, y.b, y.negated)),
a as (select conflict, 'prioritize' as action from cp where abs(gap) > 0.1 union all select conflict, 'remove' from cp where s1 != s2 union all select conflict, 'add_exception' from cp where conflict in ('temporal', 'predicate') union all select conflict, 'modify' from cp where conflict = 'predicate')
select conflict as kind, action, count(*) as n from a group by 1, 2""")
def claim_resolutions(spark, d):
    """How many pairs of structures in conflict ask for each action."""
    return C.structure_resolutions(_claims(spark, d)).groupBy("kind", "action").agg(F.count("*").alias("n"))


@query(f"""with {_CLAIMS}, {_sided_sql('claims')}, own as (select doc_id, conflict, about from sides group by all having count(distinct side) > 1), ck as (select doc_id, count(distinct (kind, l, o, r, b, negated)) as contested from sides semi join own using (doc_id, conflict, about) group by 1),
m as (select doc_id, count(*) as claims from claims group by 1) select doc_id, coalesce(claims, 0) as claims, coalesce(contested, 0) as contested, contested is null as consistent from store left join m using (doc_id) left join ck using (doc_id)""")
def claims_consistency(spark, d):
    """Whether each record's own claims can hold together."""
    return C.consistent(store(spark, d), _claims(spark, d))


@query(f"""with {_CLAIMS}, w as (select doc_id, pos, negated, {_WHOLE} from claims) select kind, "left", operator, "right", object, negated, count(*) as n, count(distinct doc_id) as texts, min((doc_id, pos))[1] as first_id, min((doc_id, pos))[2] as first_pos from w group by 1, 2, 3, 4, 5, 6""")
def claim_groups(spark, d):
    return C.grouped(_claims(spark, d)).select(*C.PARTS, "n", "texts", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos"))


_PATTERNED = " union all ".join(f"select doc_id, pos, {i} as place, sentence, '{k}' as kind, list_filter({sql_strings(ws)}, lambda w: contains(lower(sentence), w))[1] as operator from s where len(list_filter({sql_strings(ws)}, lambda w: contains(lower(sentence), w))) > 0" for i, (k, ws) in enumerate(C.PATTERNS.items()))


@query(f"with {_CLAIMS}, x as ({_PATTERNED}) select doc_id, pos, kind, operator from x qualify row_number() over (partition by doc_id order by pos, place) <= 10")
def claims_patterned(spark, d):
    return C.patterned(store(spark, d), most=10).select("doc_id", "pos", "kind", "operator")


_LABEL = "case v " + " ".join(f"when '{k}' then '{x[1]}'" for k, x in C.STATUS.items()) + " end"
_SAID = "concat_ws(' ', \"left\", operator, \"right\")"
_DESCRIBED = f"""case when negated then 'Negation' when kind = 'predicate' then concat_ws(' ', 'Predicate:', "left", operator, nullif(object, '')) when kind = 'comparison' then 'Comparison: ' || {_SAID} when kind = 'temporal' then 'Temporal: ' || {_SAID} when kind = 'causal' then 'Causal (' || operator || ')' when kind = 'modal' then 'Modal (' || operator || ')' else 'Implication' end"""
_WHY = f"""case when v = 'falsified' and not negated then case kind when 'comparison' then 'The comparison ' || chr(39) || {_SAID} || chr(39) || ' cannot be satisfied with the given constraints.' when 'temporal' then 'The temporal relationship ' || chr(39) || {_SAID} || chr(39) || ' is contradicted by the context.' end end"""
_P1 = "printf('%.1f%%', {} * 100)"
_LINE = "'- {0}: ' || {1} || '/' || claims || ' (' || " + _P1.format("({1})::double / claims") + " || ')'"


@query(f"""with {_CLAIMS}, f as (select *, {_VERDICT} as v from (select * from claims qualify row_number() over (partition by doc_id order by pos) <= 10)),
g as (select doc_id, count(*) as extracted, count(*) filter (confidence >= 0.5) as claims, count(*) filter (confidence >= 0.5 and v = 'verified') as verified, count(*) filter (confidence >= 0.5 and v = 'falsified') as falsified,
list('**Text:** "' || sentence || '"' || chr(10) || '**Structure:** ' || {_DESCRIBED} || chr(10) || '**Status:** ' || {_LABEL} || coalesce(chr(10) || '**Explanation:** ' || {_WHY}, '') order by pos) filter (confidence >= 0.5) as ds from f group by 1),
cj as (select doc_id, coalesce(claims, 0) as claims, coalesce(verified, 0) as verified, coalesce(falsified, 0) as falsified, coalesce(ds, []) as ds, case when extracted is null then 'unknown' when falsified > 0 then 'falsified' when verified = claims then 'verified' else 'unknown' end as status, round(case when claims > 0 then verified / claims else 0.5 end, 6)::double as confidence from store left join g using (doc_id)),
cp as (select *, printf('%.0f%%', confidence * 100) as sure from cj)
select doc_id, case status when 'verified' then 'All ' || claims || ' claims verified successfully with ' || sure || ' confidence.' when 'falsified' then falsified || ' of ' || claims || ' claims falsified. Only ' || verified || ' claims verified. Confidence: ' || sure else 'Verification inconclusive. ' || verified || ' of ' || claims || ' claims verified. Confidence: ' || sure end as summary,
'## Verification Status' || chr(10) || case status {' '.join(f"when '{k}' then '{x[0]}'" for k, x in C.STATUS.items())} end || chr(10) || chr(10) || '## Confidence Analysis' || chr(10) || 'Overall confidence: ' || {_P1.format('confidence')} || chr(10)
|| case when claims > 0 then {_LINE.format('Verified', 'verified')} || chr(10) || {_LINE.format('Falsified', 'falsified')} || chr(10) || {_LINE.format('Unknown', '(claims - verified - falsified)')} else 'No claims were extracted for verification.' end
|| case when len(ds) > 0 then chr(10) || chr(10) || '## Claim Details' || chr(10) || array_to_string(list_transform(ds[1:5], lambda x, i: chr(10) || '### Claim ' || i || chr(10) || x), '') || case when len(ds) > 5 then chr(10) || '... and ' || (len(ds) - 5) || ' more claims not shown.' else '' end else '' end as explanation from cp""")
def claims_explained(spark, d):
    return C.explained(store(spark, d))


@query(f"""with {_CLAIMS} select "left" as subject, operator as verb, count(distinct object) as objects, count(*) as claims from claims where kind = 'predicate' and not negated and object != '' group by 1, 2 having count(distinct object) > 1""")
def claims_contested(spark, d):
    return C.contested(_claims(spark, d))


@query()
def claims_dependency(spark, d):
    """Subject, verb and object of every sentence."""
    return dependency.triples(store(spark, d))


@query()
def claims_dependency_conflicts(spark, d):
    """Between all records, as disputes with their members."""
    return C.disputes(dependency.as_claims(dependency.triples(store(spark, d))))


# the graph -------------------------------------------------------------------------------------------------------------


_CAPITAL = r"regexp_matches(regexp_replace(w, '^[-_]+|[-_]+$', '', 'g'), '^\p{Lu}') and strlen(regexp_replace(w, '^[-_]+|[-_]+$', '', 'g')) > 1"
_KIND = "case " + " ".join(f"when len(list_filter({sql_strings(known)}, lambda k: contains(lower(s), k))) > 0 then '{name}'" for name, known in G._TYPED) + " else 'concept' end"
_ENTITIES = rf"""{STORE}, es as (select doc_id, i, ss[i] as s from (select doc_id, regexp_split_to_array(text, '[.!?]') as ss from store where text is not null), unnest(range(1, len(ss) + 1)) r(i)),
ew as (select doc_id, i, s, {_KIND} as kind, list_transform({sql_words('s')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}_-]+|[^\p{{L}}\p{{N}}_-]+$', '', 'g')) as ws from es),
em as (select doc_id, i, kind, array_to_string(list_transform(ws, lambda w: case when {_CAPITAL} then w when list_contains({sql_strings(G.TECHNOLOGY)}, w) then chr(10) || w || chr(10) else chr(10) end), ' ') as marked from ew),
en as (select doc_id, i, kind, list_filter(regexp_split_to_array(marked, ' ?
(?: ?
)* ?'), lambda n: n != '') as names from em),
ee as (select doc_id, i, n, names[n] as name, case when list_contains({sql_strings(G.TECHNOLOGY)}, names[n]) then 'technology' else kind end as type from en, unnest(range(1, len(names) + 1)) r(n)),
ef as (select * from ee qualify row_number() over (partition by doc_id, lower(name) order by i, n) = 1), entities as (select doc_id, name, type, row_number() over (partition by doc_id order by i, n) - 1 as pos from ef)"""
_BETWEEN = "case when p < q then substring(clause, p + length(a), greatest(0, q - p - length(a))) else substring(clause, q + length(b), greatest(0, p - q - length(b))) end"
_HAS = "case " + " ".join(f"when len(list_filter({sql_strings(patterns)}, lambda y: contains(x, y))) > 0 then '{kind}'" for kind, patterns in G.RELATIONS) + " else 'related_to' end"
_RELATIONS = f"""{_ENTITIES}, rc as (select doc_id, c, cs[c] as clause from (select doc_id, regexp_split_to_array(lower(text), '[.!?;,]') as cs from store where text is not null), unnest(range(1, len(cs) + 1)) r(c)),
rh as (select doc_id, c, clause, pos, name from rc join entities using (doc_id) where contains(clause, lower(name))),
rp as (select x.doc_id, x.name as a0, y.name as b0, lower(x.name) as a, lower(y.name) as b, min_by(x.clause, x.c) as clause from rh x join rh y on x.doc_id = y.doc_id and x.c = y.c and x.pos < y.pos group by all),
rb as (select *, position(a in clause) as p, position(b in clause) as q from rp), rx as (select *, {_BETWEEN} as x from rb), rk as (select *, {_HAS} as type from rx),
relations as (select doc_id, case when onward then a0 else b0 end as src, case when onward then b0 else a0 end as dst, type from (select *, case type when 'related_to' then true when 'created_by' then p >= q else p < q end as onward from rk))"""


@query(f"with {_ENTITIES} select doc_id, pos, name, type, 0.7::double as confidence from entities")
def graph_entities(spark, d):
    return G.entities(store(spark, d))


@query(f"with {_RELATIONS} select doc_id, src, dst, type, 0.6::double as confidence from relations")
def graph_relations(spark, d):
    return G.relations(store(spark, d))


_INDEXED = f"""{_RELATIONS}, ev as (select doc_id, name, lower(name) || '|' || type as id, type from entities), vertices as (select id, min(name) as name, any_value(type) as type, count(*) as texts from ev group by id),
edges as (select x.id as src, y.id as dst, r.type, count(*) as texts from relations r join ev x on x.doc_id = r.doc_id and x.name = r.src join ev y on y.doc_id = r.doc_id and y.name = r.dst where x.id != y.id group by all)"""


@query(f"with {_INDEXED} select name, type, texts, coalesce(a, 0) as onward, coalesce(b, 0) as back from vertices left join (select src as id, count(*) as a from edges group by 1) using (id) left join (select dst as id, count(*) as b from edges group by 1) using (id)")
def graph_indexed(spark, d):
    """The graph of the store's texts: each vertex with its texts and the numbers of edges from and to it."""
    vertices, edges = G.indexed(store(spark, d))
    edges = cut(edges)
    number = lambda side, to: edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias(to))
    v = vertices.join(number("src", "onward"), "id", "left").join(number("dst", "back"), "id", "left")
    return v.select("name", "type", "texts", F.coalesce("onward", F.lit(0)).alias("onward"), F.coalesce("back", F.lit(0)).alias("back"))


_START = "lower((select name from vertices where length(name) > 3 order by texts desc, name limit 1))"


@query(f"""with recursive {_INDEXED}, steps as (select src as a, dst as t from edges union all select dst, src from edges), w(start, "end", hops, path) as (select id, id, 0, [id] from vertices where lower(name) = {_START} union all select w.start, s.t, hops + 1, list_append(path, s.t) from w join steps s on s.a = w."end" where hops < 1 and not list_contains(path, s.t))
select vs.name as start, ve.name as "end", ve.type, hops, count(*) as paths from w join vertices vs on vs.id = w.start join vertices ve on ve.id = w."end" group by all""")
def graph_related(spark, d):
    """What is beside the entity that most texts name."""
    vertices, edges = (cut(x) for x in G.indexed(store(spark, d)))
    first = vertices.filter(F.length("name") > 3).orderBy(F.col("texts").desc(), "name").first()
    found = G.related(vertices, edges, first["name"] if first else "", 1)
    name = lambda side: vertices.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"))
    named = found.join(name("start"), "start").join(name("end"), "end")
    return named.groupBy(F.col("start_name").alias("start"), F.col("end_name").alias("end"), F.col("end_type").alias("type"), "hops").agg(F.count("*").alias("paths"))


@query(f"with {_INDEXED} select type, count(*) as n, sum(texts)::bigint as texts from vertices group by 1")
def graph_entities_by_type(spark, d):
    return G.indexed(store(spark, d))[0].groupBy("type").agg(F.count("*").alias("n"), F.sum("texts").alias("texts"))


def _star(spark, d) -> tuple[DataFrame, DataFrame]:
    """The star schema as a property graph: order -> customer -> nation -> region, supplier -> nation, and by lineitem order -> part and
    part -> supplier, once for each pair."""
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    t = lambda n: table(spark, d, n)
    v = lambda n, k, c, name: t(n).select(tag(k, c).alias("id"), F.col(name).cast("string").alias("name"), F.lit(k).alias("type"))
    vertices = [v("region", "R", "r_regionkey", "r_name"), v("nation", "N", "n_nationkey", "n_name"), v("customer", "C", "c_custkey", "c_name"), v("supplier", "S", "s_suppkey", "s_name"), v("orders", "O", "o_orderkey", "o_orderkey"), v("part", "P", "p_partkey", "p_name")]
    e = lambda df, a, b, kind, c: df.select(tag(*a).alias("src"), tag(*b).alias("dst"), F.lit(kind).alias("type"), F.lit(c).alias("confidence"))
    edges = [
        e(t("nation"), ("N", "n_nationkey"), ("R", "n_regionkey"), "part_of", 0.9),
        e(t("customer"), ("C", "c_custkey"), ("N", "c_nationkey"), "located_in", 0.8),
        e(t("supplier"), ("S", "s_suppkey"), ("N", "s_nationkey"), "located_in", 0.8),
        e(t("orders"), ("O", "o_orderkey"), ("C", "o_custkey"), "created_by", 0.7),
        e(t("lineitem").select("l_orderkey", "l_partkey").distinct(), ("O", "l_orderkey"), ("P", "l_partkey"), "uses", 0.95),
        e(t("lineitem").select("l_partkey", "l_suppkey").distinct(), ("P", "l_partkey"), ("S", "l_suppkey"), "created_by", 0.9),
    ]
    return reduce(DataFrame.unionByName, vertices), reduce(DataFrame.unionByName, edges)


_EDGES = """edges as (select 'N' || n_nationkey as src, 'R' || n_regionkey as dst, 'part_of' as type, 0.9::double as confidence from nation union all select 'C' || c_custkey, 'N' || c_nationkey, 'located_in', 0.8 from customer
union all select 'S' || s_suppkey, 'N' || s_nationkey, 'located_in', 0.8 from supplier union all select 'O' || o_orderkey, 'C' || o_custkey, 'created_by', 0.7 from orders
union all select distinct 'O' || l_orderkey, 'P' || l_partkey, 'uses', 0.95 from lineitem union all select distinct 'P' || l_partkey, 'S' || l_suppkey, 'created_by', 0.9 from lineitem),
vertices as (select 'R' || r_regionkey as id, 'R' as type from region union all select 'N' || n_nationkey, 'N' from nation union all select 'C' || c_custkey, 'C' from customer union all select 'S' || s_suppkey, 'S' from supplier union all select 'O' || o_orderkey, 'O' from orders union all select 'P' || p_partkey, 'P' from part)"""


def _walk(start: str, step: str, hops: int, condition: str = "true", edges: str = "edges") -> str:
    step = step.replace("from edges", f"from {edges}")
    return f"""with recursive {_EDGES}, steps as ({step}), w(start, "end", hops, confidence, path) as (select id, id, 0, 1.0::double, [id] from vertices where {start} union all select w.start, s.t, hops + 1, w.confidence * s.c, list_append(path, s.t) from w join steps s on s.a = w."end" where hops < {hops} and not list_contains(path, s.t) and {condition})"""


_OUT = "select src as a, dst as t, confidence as c from edges"
_BOTH = f"{_OUT} union all select dst, src, confidence from edges"


@query(f"""{_walk("type = 'P'", _OUT, 3)} select start, "end", hops, round(confidence, 6) as confidence, path from w""")
def graph_paths(spark, d):
    """Where every part comes from: its suppliers, their nations, and these nations' regions."""
    vertices, edges = _star(spark, d)
    return G.traverse(vertices.filter("type = 'P'"), vertices, edges, 3, "outgoing")


@query(f"""{_walk("type = 'R'", _BOTH, 2, "w.confidence * s.c >= 0.75")} select start, "end", hops, round(confidence, 6) as confidence, path from w""")
def graph_paths_confident(spark, d):
    vertices, edges = _star(spark, d)
    return G.traverse(vertices.filter("type = 'R'"), vertices, edges, 2, "both", 0.75)


@query(f"""{_walk("type = 'R'", _BOTH, 3)} select start, "end" as id, min(hops) as hops from w where "end" != start and "end" not like 'N%' group by 1, 2""")
def graph_within_hops(spark, d):
    """Customers, suppliers, orders and parts within three steps of a region; nations are passed through."""
    vertices, edges = _star(spark, d)
    return G.within_hops(vertices.filter("type = 'R'"), vertices, edges, 3, "both", ["C", "S", "O", "P", "R"])


@query(f"""{_walk("type = 'S'", _BOTH, 2)} select start, "end", min(hops) as hops, arg_min(path, (hops, path)) as path from w where hops > 0 and "end" like 'S%' group by 1, 2""")
def graph_shortest_paths(spark, d):
    """From every supplier to the suppliers that share a part or the nation with it; of several such paths the least."""
    vertices, edges = _star(spark, d)
    near = G.within_hops(vertices.filter("type = 'S'"), vertices, edges, 2, "both", ["S"])
    return G.shortest_paths(near.select("start", F.col("id").alias("end")), edges, 2, "both")


@query(f"""{_walk("type = 'N'", _BOTH, 3, edges="edges where type in ('located_in', 'part_of')")} select start, "end", hops, round(confidence, 6) as confidence, path from w where "end" like 'N%'""")
def graph_cycles(spark, d):
    """From nation to nation: over the region, never twice through a vertex, as customers and suppliers lead back to where they came from."""
    vertices, edges = _star(spark, d)
    found = G.traverse(vertices.filter("type = 'N'"), vertices, edges, 3, "both", edge_types=["located_in", "part_of"])
    return found.filter(F.startswith("end", F.lit("N")))


@query(f"with recursive {_EDGES}, c(id, depth) as (select 'R0', 0 union select src, depth + 1 from c join edges on dst = c.id) select id, min(depth) as depth from c where depth > 0 group by 1")
def graph_dependents(spark, d):
    """Everything that depends on the first region: what its invalidation invalidates."""
    vertices, edges = _star(spark, d)
    return G.closure(vertices.filter("id = 'R0'"), edges.select(F.col("src").alias("id"), F.col("dst").alias("on")))


@query(f"with {_EDGES} select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by 1")
def graph_degrees(spark, d):
    return G.degrees(_star(spark, d)[1])


@query(f"with {_EDGES} select src as at, dst as \"to\", type, confidence from edges where type = 'part_of' union all select dst, src, type, confidence from edges where type = 'part_of'")
def graph_neighbours(spark, d):
    """Nations and regions, both ways."""
    vertices, edges = _star(spark, d)
    return G.directed(G.valid_edges(edges.filter("type = 'part_of'"), vertices))


@query(f"with {_EDGES} select src as at, dst as \"to\", type, confidence, row_number() over (partition by src order by confidence desc, dst, type) - 1 as rank from edges qualify row_number() over (partition by src order by confidence desc, dst, type) <= 3")
def graph_best_neighbours(spark, d):
    """The three surest steps from every vertex."""
    return G.best_neighbours(_star(spark, d)[1])


_UNMARKED = "regexp_replace(lower(" + sql_strip("sentence") + r"), '[!-/:-@\[-`{-~]+', '', 'g')"


@query(f"with {_CLAIMS} select doc_id, pos, array_to_string({sql_words(_UNMARKED)}, ' ') as said from claims")
def claims_normalized(spark, d):
    from ..functions.text import normalized

    return _claims(spark, d).select("doc_id", "pos", normalized(F.col("sentence"), True).alias("said"))
