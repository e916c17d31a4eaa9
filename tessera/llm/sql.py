"""DuckDB SQL for the training-data queries that SQL can express."""

_SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TERMS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda x: strlen(x) > 1)"
_RECORDS = "records as (select id, any_value(content) as content, any_value(metadata['collection']) as collection from store_docs where id is not null group by id)"

_PATTERN = rf"trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}{_SPACE}]+', '', 'g'), '[{_SPACE}]+', ' ', 'g'))"
_P1 = f"with p as (select query_pattern from (select {_PATTERN} as query_pattern from query_log) where query_pattern != ''), t as (select count(*) as total from p)"

_P2 = f"""
with {_RECORDS},
settings as (select collection, max_by(prf_min_frequency, config_id) as least from expansion_configs where collection is not null group by collection),
r as (select id, coalesce(s.least, (select least from settings where collection = 'default'), 1) as least, {_TERMS.format("content")} as ts from records left join settings s using (collection)),
uses as (select id, unnest(ts) as term from r),
tf as (select id, term, count(*) as tf from uses group by id, term),
stats as (select term, count(*) as records, sum(tf) as occurrences from tf group by term)
"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_WINDOWS = "select distinct {key}, i - 1 as place, array_to_string(ws[i : i + 9], ' ') as passage from (select {key}, {words} as ws from {table} where {key} is not null and text is not null), unnest(range(1, len(ws) - 8)) r(i)"
_P8 = f"select doc_id, item_id, d.place from ({_WINDOWS.format(key='doc_id', words=_WORDS, table='documents')}) d join ({_WINDOWS.format(key='item_id', words=_WORDS, table='eval_items')}) i using (passage)"

_P4 = f"""with recursive {_RECORDS}, t as (select id, {_TERMS.format("content")} as ts from records),
s as (select id, list_distinct(list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2])) as s from t where len(ts) >= 20),
x as (select id, len(s) as n, unnest(s) as g from s),
o as (select a.id as id_a, b.id as id_b, a.n as n_a, b.n as n_b, count(*) as o from x a join x b on a.g = b.g and a.id < b.id and a.n >= 0.59 * b.n and b.n >= 0.59 * a.n group by all),
pairs as (select id_a, id_b from o where o >= 0.6 * (n_a + n_b - o) - 1e-9)"""

SQL = {
    "p1_found": f"{_P1} select query_pattern from p, t group by query_pattern, total having count(*) >= 0.002 * total",
    "p1_counts": f"{_P1} select query_pattern, count(*) as n, total as rows_total, true as near from p, t group by query_pattern, total having count(*) >= 0.002 * total",
    "p2_found": f"{_P2} select id, term from tf join r using (id) join stats using (term) where tf >= least and records between 2 and 15",
    "p2_scores": f"""{_P2}, n as (select sum(tf)::double as total from tf), l as (select id, count(*) as length from uses group by id),
s as (select id, term, tf, records, occurrences / total as q, length from tf join r using (id) join l using (id) join stats using (term), n where tf >= least and records between 2 and 15),
p as (select *, (tf + 2000.0::double * q) / (length + 2000.0::double) as p from s) select id, term, tf, records, round(p * ln(p / q), 9) as score from p""",
    "p3_found": f"""with {_RECORDS}, uses as (select id, unnest({_TERMS.format("content")}) as term from records), n as (select count(distinct id) as n from records),
stats as (select term, count(distinct id) as records from uses group by term)
select term, case when records >= 0.5 * n then 'common' else 'rare' end as mark from stats, n where records = 1 or records >= 0.5 * n""",
    "p3_vocabulary": f"""with {_RECORDS}, uses as (select id, unnest({_TERMS.format("content")}) as term from records), n as (select count(distinct id) as n from records)
select term, row_number() over (order by term) - 1 as term_id, count(*) as occurrences, count(distinct id) as records, case when count(distinct id) >= 0.5 * n then 'common' when count(distinct id) <= 1 then 'rare' end as mark, n as records_total
from uses, n group by term, n""",
    "p4_found": f"{_P4} select id_a, id_b from pairs",
    "p4_classes": f"""{_P4}, u as (select id, coalesce(array_to_string(list_sort(s), chr(1)), 'text ' || md5(content), 'null') as same from records left join s using (id)),
e as (select id_a as a, id_b as b from pairs union select id_b, id_a from pairs union select x.id, y.id from u x join u y on x.same = y.same),
reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
k as (select u.id, count(distinct v.same) filter (v.same != u.same) as links from u left join pairs p on u.id in (p.id_a, p.id_b) left join u v on v.id = case when p.id_a = u.id then p.id_b else p.id_a end group by 1),
c as (select same, count(*) as copies from u group by 1)
select id, min(b) as class, any_value(links) as links, any_value(copies) as copies from reach join k on k.id = reach.a join u using (id) join c using (same) group by id""",
    "p6_found": rf"""with long as (select distinct id, content from store_docs where id is not null and length(content) > 2000)
select distinct id, case when list_max(list_transform(regexp_split_to_array(content, '[{_SPACE}.!?。！？]+'), lambda x: length(x))) > 2000 then 'forced' else 'natural' end as cut from long""",
    "p6_rebuilt": rf"""with {_RECORDS}, c as (select id, content, case when length(content) <= 2000 then 'whole' when list_max(list_transform(regexp_split_to_array(content, '[{_SPACE}.!?。！？]+'), lambda x: length(x))) > 2000 then 'forced' else 'natural' end as cut from records where content is not null)
select id, md5(content) as text_md5, length(content) as characters, true as within, cut != 'whole' as several, cut from c""",
    "p7_placed": "select doc_id, strlen(text) + 1 as tokens, (strlen(text) + 4096) // 4096 as parts, true as within from documents where doc_id is not null and strlen(text) > 0",
    "p7_fill": "select sum(strlen(text) + 1)::bigint as tokens, true as disjoint, true as full from documents where doc_id is not null and strlen(text) > 0",
    "p8_found": f"select distinct doc_id, item_id from ({_P8})",
    "p8_report": f"select doc_id, item_id, count(distinct place) as windows, min(place) as first_word from ({_P8}) group by 1, 2",
    "p7_found": "select doc_id from documents where doc_id is not null and strlen(text) + 1 > 4096",
}
