"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from evidentia.functions.text import LEAK_MARKERS, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


def _folded(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def _words(c: str) -> str:
    return rf"regexp_extract_all({_folded(c)}, '[\p{{L}}\p{{N}}_]+')"


def _normalized(c: str) -> str:
    return f"array_to_string({_words(c)}, ' ')"


def _terms(c: str) -> str:
    found = rf"regexp_extract_all({_folded(c)}, '[\p{{L}}\p{{Nl}}\p{{No}}]+')"
    return f"list_distinct(list_transform(list_filter({found}, lambda w: length(w) > 2 and w not in ({_STOP})), lambda w: substr(w, 1, 5)))"


def _years(c: str) -> str:
    # Neighbouring signs are checked on the text with every year set apart.
    return rf"list_distinct(list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '20[0-9]{{2}}')))"


_LEXICAL = f"""
q as (select item_id as query_id, {_terms("text")} as t from benchmark),
d as (select doc_id as id, {_terms("text")} as t from documents),
qt as (select query_id, len(t) as n, unnest(t) as term from q),
dt as (select id, len(t) as m, unnest(t) as term from d),
lexical as (select *, row_number() over (partition by query_id order by s desc, id) as rank from (
  select query_id, id, count(*) / sqrt(n * m) as s from qt join dt using (term) group by query_id, id, n, m))"""
_KEYWORD = f"""
kq as (select item_id as query_id, unnest(list_distinct({_words("text")})) as w from benchmark),
kd as (select doc_id as id, unnest(list_distinct({_words("text")})) as w from documents),
keyword as (select *, row_number() over (partition by query_id order by matched desc, id) as rank from (
  select query_id, id, count(*) as matched from kq join kd using (w) group by query_id, id))"""
_LEAKED = f"""
leaked as (select b.item_id as id, d.doc_id as key from (select item_id, {_normalized("text")} as q from benchmark) b
  join (select doc_id, {_normalized("text")} as p from documents) d on b.q <> '' and contains(d.p, b.q))"""
_VECTORS = """
hits as (select *, row_number() over (partition by query_id order by s desc, id) as rank from (
  select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as s
  from embeddings a, embeddings b where a.vec_id % 50 = 0))"""
_SUBSTANTIVE = r"length(trim(text)) >= 80 and len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) >= 12"
_REPLIES = """
t as (select *, lag(text) over w as asked, lag(role) over w as asker from conversations window w as (partition by conv_id order by turn)),
r as (select conv_id, turn, text as answer, asked from t where role = 'assistant' and asker = 'user')"""
_METRICS = f"""
{_REPLIES},
x as (select conv_id, turn, {_words("answer")} as a, {_words("asked")} as b from r),
m as (select conv_id, turn, case when len(b) > 0 then (a = b)::int::double end as exact_match,
  case when len(b) = 0 then null when len(a) = 0 then 0.0
    else round(2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))), 0) / (len(a) + len(b)), 9) end as token_f1
  from x)"""
_RANKED = f"""
{_KEYWORD},
{_LEAKED},
rk as (select query_id as id, list(id order by rank) as ranked from (select * from keyword where rank <= 10) group by query_id),
rq as (select id, list(distinct key) as required from leaked group by id),
i as (select item_id as id, coalesce(ranked, []) as ranked, coalesce(required, []) as required from benchmark left join rk on rk.id = item_id left join rq on rq.id = item_id)"""


def _hit(k: int) -> str:
    return f"case when len(required) > 0 then list_has_any(required, ranked[1:{k}])::int::double end"


def _recall(k: int) -> str:
    return f"case when len(required) > 0 then round(len(list_intersect(required, ranked[1:{k}]))::double / len(required), 9) end"


def _first(ranked: str) -> str:
    return f"list_min(list_filter(list_transform({ranked}, lambda x, j: case when list_contains(required, x) then j end), lambda x: x is not null))"


_ID = """'["corpus", "' || source || '", "' || doc_id || '", "' || replace(replace(replace(replace(substr(text, 1, 80), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"]'"""


_ITEMS = """it as (select doc_id as id, case when doc_id % 3 = 0 then 'test' else 'development' end as split,
  case when quality is null then 'unreviewed' when toxic = 1 then 'rejected' when quality = 1 then 'approved' else 'needs_revision' end as review_status,
  case lang when 'de' then 'official_faq' when 'fr' then 'student_office' else 'synthetic' end as generation_method from documents left join labels using (doc_id))"""


def _run() -> str:
    from evidentia.plans.queries import ASK_MOST

    return f"""
{_LEXICAL},
h as (select query_id, count(*) as n, string_agg(source, chr(10) order by rank) as r, sum(n_chars)::bigint as c from lexical join documents on doc_id = id where rank <= 3 group by query_id),
stop as (select min(item_id) as stop from benchmark where length(text) > {ASK_MOST}),
a as (select item_id as id, item_id % 3 <> 0 as answerable, item_id % 2 = 0 as approved, item_id % 5 = 0 as faq, length(text) > {ASK_MOST} as bad, row_number() over (order by item_id) - 1 as place, h.*
  from benchmark left join h on query_id = item_id),
x as (select *, case when bad then null when n is null then 'no_evidence' else 'evidence_found' end as status, case when bad then 0 else coalesce(c, 0) end as tokens from a, stop where stop is null or id <= stop),
t as (select *, case when coalesce(status = case when answerable then 'evidence_found' else 'no_evidence' end, false) then 1.0 else 0.0 end::double as status_match,
  case when not answerable then coalesce(status = 'no_evidence', false)::int::double end as unanswerable_detection, case when answerable then coalesce(status = 'no_evidence', false)::int::double end as false_refusal from x)"""


def oracle_sql() -> dict[str, str]:
    from evidentia.plans.queries import CAPTURE_BYTES

    diff = """
a as (select split_part(text, chr(10), 1) as key, min(sha256(text)) as d from documents where source = 'src0' group by 1),
b as (select split_part(text, chr(10), 1) as key, min(sha256(text)) as d from documents where source = 'src1' group by 1),
diff as (select coalesce(a.key, b.key) as key, case when a.d is null then 'added' when b.d is null then 'removed' when a.d = b.d then 'unchanged' else 'changed' end as status
  from a full join b on a.key = b.key)"""
    primary = f"""
{_KEYWORD},
sub as (select doc_id as id, lang || ':' || source as article, {_SUBSTANTIVE} as substantive from documents),
nb as (select *, lag(id) over w as previous, lead(id) over w as next from sub window w as (partition by article order by id)),
pr as (select * from (select query_id, id, row_number() over (partition by query_id order by rank) as rank from keyword join sub using (id) where rank <= 15 and substantive) where rank <= 5),
of as (
  select query_id, rank, seed, side, o.id from (
    select query_id, rank, pr.id as seed, 0 as side, previous as id from pr join nb using (id) union all select query_id, rank, pr.id, 1, next from pr join nb using (id)) o
  join sub on sub.id = o.id
  where rank < 5 and substantive and not exists (select 1 from pr p where p.query_id = o.query_id and p.id = o.id)),
ch as (select * from (select *, row_number() over (partition by query_id order by rank, side) as n from of) where n = 1),
al as (select query_id, rank::double as place, id, 'ranked' as origin, null::bigint as seed_id from pr union all select query_id, rank + 0.5, id, 'article_neighbor', seed from ch)"""
    slots = f"""
{_LEXICAL},
{_KEYWORD},
fr as (select query_id, rank, id from lexical where rank <= 5), fx as (select query_id, rank, id from keyword where rank <= 5),
n as (select query_id, count(*) as n from fx group by query_id),
al as (select fr.query_id, id, rank as r, 'fresh' as origin, case when rank <= (case when coalesce(n, 0) > 0 then 3 else 5 end) then 0 else 2 end as tier from fr left join n using (query_id)
  union all select query_id, id, rank, 'fixed', 1 from fx)"""
    leak = " or ".join(f"contains(text, '{m}')" for m in LEAK_MARKERS)
    findings = "source_missing source_unexpected passage_missing passage_unexpected source_differs page_missing offsets_differ vector_orphan vector_missing payload_differs vector_repeated"
    rr = f"case when len(required) > 0 then round(coalesce(1.0 / {_first('ranked')}, 0.0), 9) end"
    rr5 = f"case when len(required) > 0 then round(coalesce(1.0 / {_first('ranked[1:5]')}, 0.0), 9) end"
    return {
        "run": f"""with {_run()} select id, place, status, case when bad then '' else coalesce(r, '') end as response, case when bad then 0 else coalesce(n, 0) end as n_cited, coalesce(n, 0) as n_retrieved,
  status_match, unanswerable_detection, false_refusal, case when bad then 'ValidationError' end as error, sum(tokens) over (order by place)::bigint as cumulative_tokens from t""",
        "run_summary": f"""with {_run()},
g as (select case when faq then 'official_faq' else 'document_derived' end as origin, case when approved then 'reviewed' else 'needs_review' end as review, answerable, bad, status_match, false_refusal from t)
select origin, review, answerable, grouping(origin, review, answerable) as grouping, count(*) as n, count(*) filter (bad) as errors, round(avg(status_match), 9) as status_match_mean, round(avg(false_refusal), 9) as false_refusal_mean
from g group by grouping sets ((origin), (review), (answerable), ())
union all select null, null, null, -1, count(*), null, null, null from a, stop where id > stop""",
        "fetched_passages": f"""with {_KEYWORD}
select doc_id, length(text) as n_chars, sha256(text) as sha256 from documents where doc_id in (select id from keyword where rank <= 3)""",
        "scoped_find": "select source, count(*) as n_found, count(*) as n_vectors from documents group by source",
        "snapshot_audit_damaged": """with d as (select doc_id as i from documents),
p as (select i, false as stray from d where i % 13 <> 0 union all select i, true from d where i % 41 = 0),
v as (select i from d where i % 19 <> 0 union all select i from d where i % 19 <> 0 and i % 29 = 0)
select 'source_missing' as finding, count(*) filter (i % 7 = 0) as n from d union all select 'source_unexpected', 0 union all select 'source_differs', count(*) filter (i % 7 <> 0 and i % 5 = 0) from d
union all select 'passage_missing', count(*) filter (i % 13 = 0) from d union all select 'passage_unexpected', count(*) filter (stray) from p
union all select 'page_missing', count(*) filter (i % 11 = 0) from p union all select 'offsets_differ', count(*) filter (i % 11 <> 0 and i % 17 = 0 and not stray) from p
union all select 'vector_orphan', count(*) filter (i % 13 = 0) from v union all select 'vector_missing', count(*) filter (i % 19 = 0 or stray) from p
union all select 'payload_differs', count(*) filter (i % 13 <> 0 and i % 23 = 0) from v union all select 'vector_repeated', count(*) filter (i % 19 <> 0 and i % 29 = 0) from d""",
        "captured_pages": f"""with b as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages)
select page_id, case when n > {CAPTURE_BYTES} then 'too large' end as error, case when n <= {CAPTURE_BYTES} then n end as n_bytes, case when n <= {CAPTURE_BYTES} then sha256(h) end as sha256 from b""",
        "redirected_pages": """with recursive p as (select page_id as i, case when page_id % 11 = 0 then 'https://other.example/' else 'https://own.example/' end || page_id as url, page_id % 11 <> 0 as ok from pages),
r(i, now, hops, error) as (select i, i, 0, case when not ok then 'address not allowed' end from p
  union all select r.i, case when hops < 3 and t.ok then t.i else now end, case when hops < 3 and t.ok then hops + 1 else hops end, case when hops >= 3 then 'too many redirects' when not t.ok then 'redirect not allowed' end
  from r join p t on t.i = now // 2 where error is null and now % 3 <> 0 and now > 1),
l as (select i, arg_max(struct_pack(now := now, hops := hops, error := error), hops * 2 + (error is not null)::int) as x from r group by i)
select i as page_id, url as final, x.hops as hops, x.error as error from l join (select i as n, url from p) u on u.n = x.now""",
        "refresh_candidates": """with s as (select distinct source as key from documents)
select 0 as refresh, key, 'added' as status, null as error, true as accepted from s
union all select 1, key, case when key in ('src3', 'src4') then 'failed' else 'unchanged' end, case when key in ('src3', 'src4') then 'status 500' end, false from s
union all select 2, key, case key when 'src0' then 'removed' when 'src1' then 'changed' else 'unchanged' end, null, true from s""",
        "case_import_faults": """select 'the audit names no snapshot' as fault, null as key
union all select 'only in the corpus', unnest(['src2', 'src3']) union all select 'only in the audit', unnest(['src3', 'src5', 'src6'])
union all select 'unknown evidence', item_id || ':' || x from (select item_id, unnest(list_distinct([item_id * 7, item_id * -3])) as x from benchmark) where x not in (select doc_id from documents)""",
        "file_sync": """with d as (select sha256(text) as url, doc_id as pos, source, lang, n_chars, case source when 'src0' then 0 when 'src1' then 1 else 2 end as tier from documents),
f as (select url, case tier when 0 then case when n_chars % 2 = 0 then 'regulation_or_instruction' else 'form_template_or_pricing' end when 1 then 'regulation_or_instruction' else 'pricing' end as kind
  from (select *, row_number() over (partition by url order by tier, pos) as n from d) where n = 1),
r as (select f.*, m % 11 <> 0 and m % 7 <> 0 as done, m % 11 <> 0 and m % 7 <> 0 and m % 5 <> 0 as ready, en as known from f join (select url, min(n_chars) as m, bool_or(lang = 'en') as en from d group by url) using (url))
select kind, count(*) as n, count(*) filter (known) as known, null as expected_pdfs, null as downloaded, null as prepared, null as new_to_previous_corpus, null as download_complete, null as corpus_complete from r group by kind
union all select null, null, null, count(*), count(*) filter (done), count(*) filter (ready), count(*) filter (not known), bool_and(done), bool_and(ready) from r""",
        "page_pdfs": "select page_id, case when page_id % 3 = 0 then '/files/' || page_id || '.PDF?v=1' end as path, case when page_id % 3 = 0 then 'File' end as title, case when page_id % 3 <> 0 then 'no link to a PDF' end as fault from pages",
        "capture_status": """select count(*) + (select count(*) from documents) as documents, count(*) as website_sources, 1700000000 + min(page_id) * 3600 as website_capture_oldest, 1700000000 + max(page_id) * 3600 as website_capture_newest,
  (select count(*) from conversations) as chunks from pages""",
        "faq_reference_faults": """with i as (select doc_id as id, trim(substr(text, length(split_part(text, chr(10), 1)) + 2)) as answer from documents where contains(text, chr(10)))
select * from (select id, case when id % 19 = 0 then 'no such section' when id % 23 = 0 then 'other address' when id % 7 = 0 then 'other capture' when id % 11 = 0 then 'question differs'
  when id % 13 = 0 and answer <> '' then 'answer differs' when id % 17 = 0 then 'evidence differs' end as fault from i) where fault is not null""",
        "preparation_faults": """with l as (select doc_id as i, string_split(text, chr(10)) as l from documents),
x as (select i, unnest(case when i % 7 = 0 then [1, 2, 3] when i % 5 = 0 then [2] else [] end) as p from l),
k as (select i, len(list_filter(l, lambda t, j: trim(t) <> '' and not (i % 7 = 0 and j <= 3) and not (i % 7 <> 0 and i % 5 = 0 and j = 2))) as n from l)
select x.i as doc_id, 'excluded page doesn''t exist' as fault, p as page from x join l using (i) where p > len(l) union all select i, 'no passage', null from k where n = 0""",
        "corpus_violations_damaged": """with t as (select doc_id as i, sha256(text) as v, text from documents),
d as (select i, v from t where i % 7 <> 0), d2 as (select * from d union all select * from d where i % 11 = 0),
p as (select i, text, i % 19 = 0 as gone from t where i % 13 <> 0), p2 as (select * from p union all select * from p where i % 17 = 0),
c as (select i, case when i % 29 = 0 then 'old' else v end as v, length(text) + case when i % 31 = 0 then 1 else 0 end as e, text || case when i % 37 = 0 then '!' else '' end as t from t),
c2 as (select * from c union all select * from c where i % 23 = 0),
j as (select c2.*, d2.v as dv, p2.i as pi, p2.text as pt, gone, e > 0 and e <= length(p2.text) as fits from c2 left join d2 using (i) left join p2 on p2.i = c2.i),
f as (select 'duplicate_source' as rule, i from d2 group by i having count(*) > 1 union all select 'duplicate_page', i from p2 group by i having count(*) > 1 union all select 'duplicate_passage', i from c2 group by i having count(*) > 1
  union all select 'unknown_source', i from j where dv is null union all select 'wrong_version', i from j where dv <> v union all select 'unknown_page', i from j where pi is null
  union all select 'excluded_page', i from j where gone union all select 'bad_offsets', i from j where pi is not null and not fits union all select 'text_differs', i from j where fits and substr(pt, 1, e) <> t)
select rule, count(*) as n from f group by rule""",
        "coverage_damaged": r"""with w as (select doc_id as i, text, unnest(generate_series(0, length(text) // 250)) as n from documents),
c as (select i, n, text, n * 250 as s, least(n * 250 + 300, length(text)) as e, (i * 7 + n) % 31 <> 0 as same from w where n * 250 < length(text) and (i + n) % 9 <> 0),
g as (select *, coalesce(max(e) over (partition by i order by n rows between unbounded preceding and 1 preceding), 0) as reach from c),
k as (select i, bool_and(same) as exact, bool_and(s <= reach or not regexp_matches(substr(text, reach + 1, s - reach), '\S')) as inner_, max(e) as last from g group by i)
select doc_id, coalesce(exact, true) as exact, coalesce(inner_, true) and not regexp_matches(substr(text, coalesce(last, 0) + 1), '\S') as covered from documents left join k on i = doc_id""",
        "prepared_pages": r"""with l as (select doc_id as i, string_split(text, chr(10)) as l from documents),
x as (select i, len(l) as n, case when i % 7 = 0 then [1, 2, 3] when i % 5 = 0 then [2] else [] end as x, unnest(l) as t, generate_subscripts(l, 1) as p, regexp_replace(trim(l[1], E' \t\r'), '\s+', ' ', 'g') as head from l),
k as (select *, list_contains(x, p) or (i % 3 = 0 and not regexp_matches(t, '\S')) as gone, not regexp_matches(t, '\S') or (i % 4 = 0 and regexp_replace(trim(t, E' \t\r'), '\s+', ' ', 'g') = head) as mute from x)
select i as doc_id, count(*) filter (not gone) as n_pages, count(*) filter (not gone and not mute) as n_cited,
  count(*) filter (not gone and mute) + len(list_filter(any_value(x), lambda p: p > any_value(n))) + (count(*) filter (not gone and not mute) = 0)::int as n_faults from k group by i""",
        "catalog_rejects": r"""with c as (select 'd' || doc_id as key, text || case when doc_id % 13 = 0 then ' "expected_answer"' else '' end as t, doc_id % 5 = 0 as pdf, false as page, doc_id % 13 = 0 as marked, doc_id % 11 <> 0 as ok from documents
  union all select 'p' || page_id, coalesce(html, ''), false, true, false, page_id % 7 <> 0 from pages),
j as (select *, case when not ok then 'content_type' when min(key) over (partition by t) <> key then 'duplicate_content' when marked then 'evaluation artefact' end as reject from c),
l as (select key, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as p from j where pdf and reject is null)
select key, reject from j where reject is not null
union all select key, 'no passage' from j where reject is null and not pdf and case when page then length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(t, '<article[^>]*>(.*?)</article>', 1, 's'),
  '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) < 100 else not regexp_matches(t, '\S') end
union all select key, 'no native text ' || p from l where not regexp_matches(x, '\S')
union all select key, 'no passage' from l group by key having count(*) filter (regexp_matches(x, '\S')) = 0""",
        "silver_items": rf"""with q as (select *, sha256('42:' || doc_id) as o from documents where length(text) between 100 and 2500 order by o, doc_id limit 24),
a as (select *, 'Kaj določa dokument »' || source || '«, ' || case doc_id % 3 when 0 then lang when 1 then (doc_id % 50) || '. člen' else 'stran ' || (doc_id % 9 + 1) end || ', v odlomku »' || regexp_replace(substr(text, 1, 70), '^\s+|\s+$', '', 'g') || '«?' as question from q),
n as (select *, row_number() over (partition by {_normalized("question")} order by o, doc_id) as n from a)
select 'synthetic-' || doc_id as id, question, sha256(text) as sha256, doc_id::varchar as source_id, (doc_id % 9 + 1)::int as page, 'https://h/' || source as url, doc_id::varchar as family_id, 'development' as split, 'unreviewed' as review_status from n where n = 1""",
        "review_faults": """select -doc_id as id, 'unknown item' as fault from documents where doc_id % 43 = 1
union all select * from (select doc_id as id, case when doc_id % 41 = 0 then 'decided more than once' when doc_id % 17 = 0 then 'other content' when doc_id % 31 = 0 then 'context edited'
  when doc_id % 3 <> 0 and doc_id % 11 = 0 then 'no reviewer' when doc_id % 3 = 1 and doc_id % 13 = 0 then 'checks missing' end as fault from documents) where fault is not null""",
        "running_usage": "select conv_id, turn, length(text) as chars, sum(length(text)) over (order by conv_id, turn)::bigint as cumulative_chars from conversations",
        "keyword_top": f"with {_KEYWORD} select query_id, rank, id, matched from keyword where rank <= 5",
        "lexical_top": f"with {_LEXICAL} select query_id, rank, id, round(s, 9) as score from lexical where rank <= 5",
        "fresh_top": f"""with
q as (select item_id as query_id, {_terms("text")} as t, {_years("text")} as y from benchmark),
d as (select doc_id as id, {_terms("text")} as t, {_terms("split_part(text, chr(10), 1)")} as h, {_years("split_part(text, chr(10), 1)")} as y from documents where trim(text) <> trim(split_part(text, chr(10), 1))),
s as (select query_id, id, len(list_intersect(q.t, d.t)) / sqrt(greatest(20, len(d.t))) + len(list_intersect(q.t, d.h)) / greatest(1, len(q.t)) + case when list_has_any(q.y, d.y) then 0.5 else 0.0 end as score
  from q join d on list_has_any(q.t, d.t) where len(q.y) = 0 or len(d.y) = 0 or list_has_any(q.y, d.y))
select query_id, rank, id, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 5""",
        "term_vocabulary": f"select term, count(*) as n_docs from (select unnest({_terms('text')}) as term from documents) group by term",
        "content_duplicates": "select sha256(text) as sha256, count(*) as n from documents group by 1 having count(*) > 1",
        "stable_ids": f"""with h as (select doc_id, sha256(text) as version, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({_ID})) as h from documents)
select doc_id, version, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as source_id from h""",
        "passage_audit": "select doc_id, true as exact, true as covered from documents",
        "text_predicates": rf"select doc_id, {_SUBSTANTIVE} as substantive, len({_years('text')}) as n_years, len(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'))) as n_numbers, {leak} as leaks from documents",
        "vector_top": f"with {_VECTORS} select query_id, rank, id, round(s, 6) as score from hits where rank <= 5",
        "vector_problems": """select problem, count(*) as n from (select case when embedding is null then 'missing' when len(embedding) <> 64 then 'dimension'
  when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0 then 'not_finite' when len(list_filter(embedding, lambda x: x <> 0)) = 0 then 'zero' end as problem from embeddings) group by problem""",
        "label_recall": f"with {_VECTORS} select a.label, count(*) as n, round(avg((a.label = b.label)::int), 9) as share from hits join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = id where rank <= 6 and id <> query_id group by a.label",
        "leaked_questions": f"with {_LEAKED} select id, key from leaked",
        "near_questions": f"""with f as (select {_normalized("split_part(text, chr(10), 1)")} as t, min(doc_id) as id from documents group by 1),
w as materialized (select id, list_distinct(string_split(t, ' ')) as w from f where t <> '')
select x.id as a, y.id as b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 9) as overlap from w x join w y on x.id < y.id
where len(x.w) > 0 and len(y.w) > 0 and len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.85""",
        "review_coverage": """select lang, quality, grouping(lang, quality) as grouping, count(*) as n, count(toxic) as n_reviewed, round(avg(toxic), 9) as toxic_mean
from documents left join labels using (doc_id) group by grouping sets ((lang), (quality), ())""",
        "review_states": """with s as (select case when toxic = 1 then 'rejected' when quality = 1 then 'approved' else 'needs_revision' end as s from labels)
select v as review_status, (select count(*) from s where s.s = v) as n from (values ('unreviewed'), ('approved'), ('rejected'), ('needs_revision')) t(v)""",
        "retrieval_text": """with u as (select conv_id, turn, text, list(text) over (partition by conv_id order by turn rows between 4 preceding and current row) as l from conversations where role = 'user'),
q as (select conv_id, turn, case when len(l) = 1 then text else 'Aktualno vprašanje: ' || text || chr(10) || 'Prejšnja vprašanja (kontekst pogovora):' || chr(10) || array_to_string(l[1:len(l) - 1], chr(10)) end as q from u)
select conv_id, turn, sha256(q) as sha256, length(q) as n_chars from q""",
        "turn_neighbours": "select conv_id, turn, lag(turn) over w as previous, lead(turn) over w as next from conversations window w as (partition by conv_id order by turn)",
        "neighbour_expansion": f"with {primary} select query_id, rank, id, origin, seed_id from (select *, row_number() over (partition by query_id order by place) as rank from al) where rank <= 5",
        "merged_slots": f"with {slots} select query_id, rank, id, origin from (select *, row_number() over (partition by query_id order by tier, r) as rank from al) where rank <= 5",
        "answer_status": f"""with {_LEXICAL},
p as (select query_id, count(*) as n, sum(length(text)) + count(*) - 1 as c from lexical join documents on doc_id = id where rank <= 3 group by query_id)
select item_id as query_id, case when n is null then 'no_evidence' else 'evidence_found' end as status, coalesce(n, 0) as n_citations,
  coalesce(c, 94)::bigint as n_chars, case when n is null then 0 else 3 end::bigint as n_warnings from benchmark left join p on query_id = item_id""",
        "overlap_metrics": f"with {_METRICS} select conv_id, turn, exact_match, token_f1 from m",
        "attempt_summary": f"""with {_METRICS} select turn, grouping(turn) as grouping, count(*) as n, count(*) filter (token_f1 = 0) as errors, round(avg(token_f1), 9) as token_f1_mean, count(token_f1) as token_f1_n
from m group by grouping sets ((turn), ())""",
        "worst_replies": f"with {_METRICS} select conv_id * 1000 + turn as id, exact_match, token_f1 from m order by exact_match nulls first, token_f1 nulls first, id limit 10",
        "latency_percentiles": "select event_type, round(median(value), 9) as p50, round(quantile_disc(value, 0.95), 9) as p95, count(value) as n from events group by event_type",
        "retrieval_scores": f"""with {_RANKED} select id, {", ".join(f"{_hit(k)} as hit_rate_at_{k}, {_recall(k)} as recall_at_{k}" for k in (1, 3, 5))}, {rr} as reciprocal_rank,
  case when len(required) > 0 then list_has_any(required, ranked)::int::double end as any_correct_source from i""",
        "evidence_scores": f"""with {_RANKED} select id, {_recall(5)} as evidence_recall_at_5,
  case when len(required) > 0 then (len(list_intersect(required, ranked[1:5])) = len(required))::int::double end as all_evidence_at_5, {rr5} as reciprocal_rank_at_5 from i""",
        "source_statistics": "select source, count(*) as n_docs, sum(n_chars)::bigint as n_chars, string_agg(distinct lang, ',' order by lang) as langs from documents group by source",
        "refresh_diff": f"with {diff} select key, status from diff",
        "refresh_report": f"""with {diff} select {", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("added", "changed", "unchanged", "removed", "failed"))},
  coalesce(bool_or(status in ('added', 'changed', 'removed')), false) as index_update_required from diff""",
        "first_listed": """select url, pos, source from (select *, row_number() over (partition by url order by case source when 'src0' then 0 when 'src1' then 1 else 2 end, pos) as n
from (select sha256(text) as url, doc_id as pos, source from documents)) where n = 1""",
        "url_checks": r"""select page_id, regexp_extract(lower(url), '^https://([^/:?#@]*)', 1) in ('blog.tionsh.example.net', 'ththth.example.net') and regexp_matches(url, '^https://[^/:?#@]*(:443)?([/?#]|$)') as allowed,
  case when regexp_extract(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')), '([^.]*)$', 1) in ('pdf', 'doc', 'docx')
    then regexp_extract(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')), '([^.]*)$', 1) else 'html' end as kind,
  regexp_replace(url, '#.*$', '') || '#page=2' as citation from pages""",
        "link_inventory": r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 as pos, url as base from pages),
x as (select page_id, pos, regexp_extract(base, '^[a-z]+://[^/?#]*') || regexp_extract(a, 'href="([^"]*)"', 1) as url, regexp_extract(a, '>([^<]*)<', 1) as title from l)
select page_id, url, min(pos) as pos, arg_max(title, pos) as title from x group by page_id, url""",
        "selected_items": f"with {_ITEMS} select id, review_status, generation_method from it where split = 'test' and review_status = 'approved' and generation_method = 'synthetic' order by id limit 50",
        "saved_run_faults": """with b as (select doc_id as id, substr(text, 1, 40) as q from documents where doc_id < 400),
r as (select id, id as o, case when id % 50 = 7 then 'altered' else q end as q from b where id % 40 <> 3 union all select id, id, q from b where id % 90 = 1 union all select -5, id, q from b where id = 5),
p as (select *, o + case when id % 60 = 9 then 1 else 0 end as pos from r),
f as (select id, 'repeated' as fault from p group by id having count(*) > 1 union all select id, 'unknown' from p where id < 0
  union all select p.id, 'differs from its item' from p join b using (id) where p.q <> b.q
  union all select coalesce(p.id, b.id), 'not as selected' from p full join b on p.id = b.id where b.id is null or (b.id % 40 <> 4) <> (p.pos is not null) or p.pos <> b.id)
select id, fault, count(*) as n from f group by id, fault""",
        "provenance_faults": "select doc_id % 10 as id, doc_id as passage_id, case when doc_id % 17 = 3 then 'unknown passage' else 'provenance differs' end as fault from documents where doc_id % 5 = 0 and (doc_id % 17 = 3 or doc_id % 35 = 0)",
        "source_labels": """with n as (select *, row_number() over (partition by source order by doc_id) as n from documents),
t as (select source, n, source || case when lang <> 'en' then ' — ' || lang when doc_id % 2 = 1 then ' — page 1' else '' end as t, doc_id from n where n <= 10),
l as (select source, case when doc_id % 3 = 0 then '[' || t || '](https://h/)' else t end as l, min(n) as n from t group by all),
m as (select source, l, min(n) as n from l group by source, l)
select source, string_agg(l, '; ' order by n) as labels from m group by source""",
        "refresh_totals": f"""with {diff}, z as (select split_part(text, chr(10), 1) as key, sum(n_chars) as c, count(*) as d from documents where source = 'src1' group by 1)
select {", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("added", "changed", "unchanged", "removed", "failed"))}, coalesce(bool_or(status in ('added', 'changed', 'removed')), false) as index_update_required,
  coalesce(sum(c), 0)::bigint as total_chars, coalesce(sum(d), 0)::bigint as total_documents, coalesce(sum(c) filter (status in ('added', 'changed')), 0)::bigint as new_chars,
  coalesce(sum(d) filter (status in ('added', 'changed')), 0)::bigint as new_documents from diff left join z using (key)""",
        "smoke_search": f"""with {_LEXICAL} select item_id as query_id, 'en' as family, coalesce(bool_or(lang = 'en'), false) as family_found, count(id) as n_hits
from benchmark left join (select query_id, id from lexical where rank <= 5) on query_id = item_id left join documents on doc_id = id group by item_id""",
        "snapshot_audit": "select * from (values " + ", ".join(f"('{f}', 0::bigint)" for f in findings.split()) + ") t(finding, n)",
    }
