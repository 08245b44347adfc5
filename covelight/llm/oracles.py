"""DuckDB forms of the queries that SQL can express. Words are split as the contracts say; everything runs over whole tables."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, SEPARATORS

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BOILER = "|".join(BOILERPLATE)
_SEPS = ", ".join(f"'{s}'" for s in SEPARATORS)

QUALITY_RULES = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
g as (select r, i, list_reduce(w[i:i + 4], lambda a, b: a || ' ' || b) as g from (select r, w, unnest(range(1, greatest(len(w) - 3, 1))) as i from d)),
c as (select r, i, count(*) over (partition by r, g) as n from g),
v as (select r, count(distinct i + k) as n_repeat_words from c, range(0, 5) x(k) where n > 1 group by r),
l as (select r, pos, line, {_WORDS.format("line")} as w from (select r, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from d)),
m as (select r, line, len(w) as n, list_reduce(w, lambda a, b: a || b) as j, w, count(*) over (partition by r, line) as same, row_number() over (partition by r, line order by pos) as nth from l where len(w) > 0),
s as (select *, strlen(j) as bytes, length(j) as chars, len(regexp_extract_all(j, '[#*$%&|<>]')) as symbols, len(regexp_extract_all(j, '[A-Z]')) as upper, len(regexp_extract_all(j, '[A-Za-z]')) as letters,
len(list_filter(w, lambda x: x in ({_SEPS}))) as seps, regexp_matches(right(j, 1), '[.!?:;)\]"'']') as closed, regexp_matches(lower(line), '{_BOILER}') as boiler from m),
b as (select r, chars, nth, (n < 8 and not closed) or (seps >= 3 and 5 * seps > n) or (boiler and n < 25) or 10 * symbols > bytes or (n >= 5 and 10 * upper > 6 * letters) as bad from s),
t as (select r, count(*) as n_lines, sum(bad::int) as n_bad_lines, sum((nth > 1)::int) as n_dup_lines, sum(case when bad then 0 else chars end) as kept_chars from b group by r),
f as (select d.doc_id, len(w)::bigint as n_words, coalesce(length(list_reduce(w, lambda a, b: a || b)), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_bad_lines, 0)::bigint as n_bad_lines, coalesce(kept_chars, 0)::bigint as kept_chars from d left join v using (r) left join t using (r))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and kept_chars >= 0.5 * word_chars as kept from f
"""

SUBSTRING_DEDUP = rf"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
g as (select doc_id, i, list_reduce(w[i:i + 19], lambda a, b: a || ' ' || b) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from d)),
n as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as nth from g),
lost as (select distinct doc_id, i + k as i from n, range(0, 20) x(k) where nth > 1),
u as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
k as (select u.doc_id, string_agg(word, ' ' order by u.i) as kept, count(*) as n from u left join lost using (doc_id, i) where lost.doc_id is null group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

NGRAM_JOIN = rf"""
with recursive d as (select doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then list_reduce(w, lambda a, b: a || ' ' || b) else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
z as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join z a on a.doc_id = x join z b on b.doc_id = y where 100 * p.n >= 90 * (a.n + b.n - p.n)),
e as (select x, y from l union select y, x from l),
reach(x, y) as (select x, y from e union select reach.x, e.y from reach join e on e.x = reach.y),
c as (select x as doc_id, min(y) as least from reach group by 1)
select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id from d left join z using (doc_id) left join c using (doc_id)
"""

_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, 3988292384::bigint * (c & 1)))), 4294967295)"""

CONVERSATION_TRIE = rf"""with t as materialized (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, sha256(concat_ws(':', length(role), role, text))) - 1 as i
from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
c as materialized (select conv_id, {_CRC} % 4 as h from t group by 1),
r as (select c.conv_id, t.i, t.role, t.text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.i < c.h union all select c.conv_id, t.i, t.role, t.text from c join t using (conv_id) where t.i >= c.h),
x as materialized (select conv_id, row_number() over w as depth, list({{'r': role, 't': text}}) over w as pre, text as last from r window w as (partition by conv_id order by i)
union all select conv_id, 0, []::struct(r varchar, t varchar)[], '' from c),
l as (select conv_id, max(depth) as length from x group by 1),
n as materialized (select min(conv_id) as conv_id, depth, pre, count(*) as n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')) as own, coalesce(string_agg(case when depth = length then conv_id::varchar end, ',' order by conv_id), '') as ends from x join l using (conv_id) group by depth, pre),
p as materialized (select a.conv_id, a.depth, b.conv_id as parent_conv_id from n a join n b on b.depth = a.depth - 1 and b.pre = a.pre[1:a.depth - 1]),
k as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from p group by 1, 2),
s as (select a.conv_id, a.depth, sum(d.own)::bigint as saved_tokens, count(*) filter (k.n_children is null) as n_leaves from n a join n d on d.depth >= a.depth and d.pre[1:a.depth] = a.pre left join k on k.conv_id = d.conv_id and k.depth = d.depth group by 1, 2)
select n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::bigint as n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) as ends_sha256
from n join s using (conv_id, depth) left join p using (conv_id, depth) left join k using (conv_id, depth)"""


def vector_codes(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Nearest entries and floored means, each round as tables of its own."""
    d = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::bigint"
    sql = f"""with p as materialized (select vec_id, label, part, list_slice(q, part * (len(q) // {parts}) + 1, (part + 1) * (len(q) // {parts})) as v
from (select vec_id, label, list_transform(embedding::double[], lambda x: floor(4096 * x)::bigint) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), range({parts}) y(part)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as e, v from p qualify e < {entries})"""
    for k in range(rounds + 1):
        sql += f""", a{k} as materialized (select p.vec_id, p.part, any_value(p.label) as label, any_value(p.v) as v, min({{'d': {d}, 'e': b.e}}) as m from p join b{k} b using (part) group by 1, 2)"""
        if k < rounds:
            sql += f""", s{k} as (select part, e, list(x order by i) as v from (select part, e, i, floor(sum(x) / count(*))::bigint as x from (select part, m.e as e, unnest(v) as x, unnest(range(len(v))) as i from a{k}) group by 1, 2, 3) group by 1, 2),
b{k + 1} as materialized (select b.part, b.e, coalesce(s.v, b.v) as v from b{k} b left join s{k} s using (part, e))"""
    return sql + f""", f as (select vec_id, any_value(label) as label, string_agg(printf('%02x', m.e), '' order by part) as code, sum(m.d)::bigint as error from a{rounds} group by 1)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by part, e)) from b{rounds}) as codebooks_sha256 from f"""


VECTOR_CODES = vector_codes()
