"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from evidentia.llm.quality_rules import CHANCE, FENCE, POOL_SHARE, PRIOR_ROWS, RULES

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _op10() -> str:
    ratios = {
        "mark_ratio": "case when word_chars > 0 then n_marks::double / word_chars::double else 0.0 end",
        "upper_ratio": "case when word_chars > 0 then n_upper::double / word_chars::double else 0.0 end",
        "mean_word": "case when n_words > 0 then word_chars::double / n_words::double else 0.0 end",
    }
    quartiles = ", ".join(f"quantile_disc({m}, 0.25) as a_{m}, quantile_disc({m}, 0.75) as b_{m}" for m in RULES)

    def drawn(own: str, wider: str) -> str:
        low = lambda m: f"({own}.qn * {own}.a_{m} + {PRIOR_ROWS} * {wider}.a_{m}) / ({own}.qn + {PRIOR_ROWS})"
        high = lambda m: f"({own}.qn * {own}.b_{m} + {PRIOR_ROWS} * {wider}.b_{m}) / ({own}.qn + {PRIOR_ROWS})"
        return ", ".join(f"{low(m)} as a_{m}, {high(m)} as b_{m}, greatest({high(m)} - {low(m)}, {POOL_SHARE} * {wider}.s_{m}) as s_{m}" for m in RULES)

    tests = []
    for m, side in RULES.items():
        chance = f"{CHANCE} * (b_{m} / 2 / sqrt(greatest(n_words, 1)::double))" if m == "mean_word" else f"{CHANCE} * sqrt(b_{m} / greatest(word_chars, 1)::double)"
        within = f"{m} <= b_{m} + {FENCE} * s_{m} + {chance}"
        if side == "both":
            within += f" and {m} >= a_{m} - {FENCE} * s_{m} - {chance}"
        tests.append(f"((select s_{m} from e) = 0 or {within})")
    return f"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text, {WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
g as (select rid, unnest(range(1, len(w) - 3)) as i, w from d where len(w) >= 5),
h as (select rid, i, array_to_string(w[i:i+4], ' ') as g from g),
r as (select rid, i from (select *, count(*) over (partition by rid, g) as n from h) where n > 1),
c as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from r) group by rid),
f as (
  select d.rid, doc_id, lang, source, len(w)::bigint as n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words,
         length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{M}}\\x20\\x09-\\x0D]+', '', 'g')) as n_marks,
         length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) as n_upper
  from d left join c using (rid)),
m as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {", ".join(f"{v} as {k}" for k, v in ratios.items())} from f),
q as (select lang as ql, source as qs, grouping(lang, source) as lv, count(*) as qn, {quartiles} from m group by grouping sets ((lang, source), (lang), ())),
e as (select *, {", ".join(f"b_{m} - a_{m} as s_{m}" for m in RULES)} from q where lv = 3),
w as (select q.ql, {drawn("q", "e")} from q, e where q.lv = 1),
t as (select q.ql, q.qs, {drawn("q", "w")} from q join w on q.ql is not distinct from w.ql where q.lv = 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {" and ".join(tests)} as kept
from m join t on lang is not distinct from ql and source is not distinct from qs"""


def _op2() -> str:
    from evidentia.llm.mixing import PART, TEMPERATURE

    def uniform(text: str) -> str:
        return f"('0x' || substr(sha256({text}), 1, 13))::bigint::double / {float(16**13)}"

    # The distribution function is summed up once per source; a document then looks its number up.
    return f"""
with recursive n as (select source, count(*)::double as n from documents group by source),
t as (select sum(n) as whole, sum(pow(n, {TEMPERATURE})) as weights from n),
s as (select source as ss, whole * pow(n, {TEMPERATURE}) / weights / n as rate from n, t),
m as (select *, greatest(1, ceil(rate / {PART}))::int as parts from s),
p as (
  select ss, rate / parts as mean, 0 as k, exp(-(rate / parts)) as p, exp(-(rate / parts)) as c from m
  union all
  select ss, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from p where k < ceil(mean + 12 * sqrt(mean) + 20)),
l as (select ss, list(c order by k) as cs from p group by ss),
d as (select *, coalesce(doc_id::varchar, '') as key from documents),
j as (select d.*, cs, parts from d join m on d.source is not distinct from m.ss join l on d.source is not distinct from l.ss),
k as (
  select *, list_sum(list_transform(range(1, parts + 1), lambda x: len(list_filter(cs, lambda c: c <= {uniform("'0:' || key || ':' || x")}))))::int as times
  from j),
e as (select *, unnest(range(0, times))::int as copy from k)
select doc_id, text, lang, source, n_chars, copy, sha256('order0:' || key || ':' || copy) as shuffle_key from e"""


def _op4() -> str:
    return "select doc_id, text, lang, source, n_chars from documents"


def _op9() -> str:
    # Base 32 of a digest: 32 groups of five bits, each inside two hexadecimal digits.
    base32 = (
        "list_reduce(list_transform(range(0, 32), lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
        "1 + ((('0x' || substr(d || '0', 1 + (5 * x) // 4, 2))::int >> (3 - (5 * x) % 4)) & 31), 1)), lambda a, b: a || b)"
    )
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as d from pages),
g as (select d as gd, max(page_id) as first from p group by d)
select page_id, octet_length(b)::bigint as payload_bytes, {base32} as payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is not distinct from first then null else first end as refers_to
from p join g on d = gd"""


def _components(edges: str, rows: str, key: str) -> str:
    """CTEs that end in ``comp(key, id)``: the smallest key reachable over ``e(a, b)``."""
    return f"""
e as ({edges}),
reach(a, b) as (select {key}, {key} from ({rows}) union select r.a, e.b from reach r join e on r.b = e.a),
comp as (select a, min(b) as id from reach group by a),
deg as (select a, count(*) as n from e group by a)"""


def _op1() -> str:
    edges = "select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.9"
    return f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
{_components(edges, "select vec_id from embeddings", "vec_id")}
select vec_id, coalesce(deg.n, 0)::bigint as n_links, comp.id as component_id, vec_id = comp.id as kept
from embeddings join comp on comp.a = vec_id left join deg on deg.a = vec_id"""


def _op8() -> str:
    edges = """
  select x.doc_id as a, y.doc_id as b from (select x.doc_id as i, y.doc_id as j, count(*) as common from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all) p
  join c x on x.doc_id = i join c y on y.doc_id = j where common::double / (x.n + y.n - common) >= 0.8"""
    return f"""
with recursive d as (select doc_id, {WORDS} as w from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as g from d where len(w) > 0)),
c as (select doc_id, count(*) as n from s group by doc_id),
{_components(edges, "select doc_id from documents", "doc_id")}
select documents.doc_id, comp.id as class_id, coalesce(deg.n, 0)::bigint as n_links
from documents join comp on comp.a = documents.doc_id left join deg on deg.a = documents.doc_id"""


def _op11() -> str:
    from evidentia.llm.centroids import CLUSTERS, DIMENSIONS, LARGEST, ROUNDS, SCALE, SEED

    sound = f"len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs(x::double * {SCALE}) >= {LARGEST})) = 0"
    steps = [
        f"v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings where {sound})",
        f"x as materialized (select rid, unnest(x) as x, generate_subscripts(x, 1) as d from v)",
        f"o as (select row_number() over (order by sha256('{SEED}:' || vec_id), x) - 1 as k, x from v qualify k < {CLUSTERS})",
        "c0 as materialized (select k, unnest(x) as x, generate_subscripts(x, 1) as d from o)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} as materialized (select rid, arg_min(k, struct_pack(s := s, k := k)) as k, min(s) as s from (select rid, k, sum((x.x - c.x) * (x.x - c.x))::bigint as s from x join c{r} c using (d) group by rid, k) group by rid)")
        if r < ROUNDS:
            steps.append(
                f"c{r + 1} as materialized (select c.k, c.d, coalesce(m.x, c.x) as x from c{r} c left join (select k, d, ((s - ((s % n) + n) % n) // n)::bigint as x "
                f"from (select k, d, sum(x)::bigint as s, count(*) as n from x join a{r} using (rid) group by k, d)) m on m.k = c.k and m.d = c.d)"
            )
    return f"""
with {", ".join(steps)},
h as (select k, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from c{ROUNDS} group by k),
i as (select k, sum(s)::bigint as cluster_inertia from a{ROUNDS} group by k)
select vec_id, k::int as cluster, s as distance, cluster_inertia, (select sum(s)::bigint from a{ROUNDS}) as inertia, centroid_sha256 from a{ROUNDS} join v using (rid) join h using (k) join i using (k)"""


def _op13() -> str:
    from evidentia.llm.lexical_search import TOP

    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with d as materialized (select row_number() over () as rid, doc_id, {found} as t from documents),
s as (select count(*)::bigint as whole, sum(len(t))::bigint as l from d where len(t) > 0),
t as materialized (select rid, t as term, count(*) as tf from (select rid, unnest(t) as t from d) group by all),
q as materialized (select row_number() over () as qid, item_id, {found} as t from benchmark),
qt as (select qid, t as term, count(*) as times from (select qid, unnest(t) as t from q) group by all),
w as (select term, floor(1000 * ln((2 * whole + 2)::double / (2 * count(*) + 1)::double))::bigint as w from t, s group by term, whole),
p as (select qid, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.t) * whole) // l))))::bigint as score
  from qt join w using (term) join t using (term) join d using (rid), s group by qid, rid)
select item_id, rank::int as rank, doc_id, score from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) as rank from p join d using (rid) where score > 0) join q using (qid) where rank <= {TOP}"""


def oracle() -> dict[str, str]:
    return {"op1_embedding_dedup": _op1(), "op2_poisson_mixing": _op2(), "op4_sharding": _op4(), "op8_jaccard_join": _op8(), "op9_warc": _op9(), "op10_quality_rules": _op10(), "op11_centroid_clustering": _op11(), "op13_lexical_search": _op13()}
