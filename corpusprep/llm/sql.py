"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D]+"

OP10 = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, list_filter(regexp_split_to_array(t, '{WS}'), lambda x: x <> '') as w from d),
g as (select k, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
h as (select k, i, count(*) over (partition by k, w[i], w[i + 1], w[i + 2]) as c from g),
rep as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from h where c > 1) group by k),
x as (select k, unnest(string_split(t, chr(10))) as x from d),
y as (select k, x, regexp_replace(x, '{WS}', '', 'g') <> '' as filled,
        (length(x) - length(translate(x, '#*$%&|<>', ''))) * 100 > 8 * length(x)
        or length(x) - length(translate(x, '|»›•', '')) >= 3
        or (length(x) <= 200 and regexp_matches(x, 'all rights reserved|licen[sc]ed under|released under the|general public license|terms of (use|service)|privacy policy|cookie|javascript|click here|subscribe|sign in|log in|copyright (©|\(c\))|lorem ipsum', 'i'))
        or (length(x) - length(translate(x, ' ', '')) >= 4 and not regexp_matches(x, '\p{{Po}}')) as bad from x),
l as (select k, count(*) as n_lines, count(*) filter (where bad) as n_failed_lines,
        count(*) filter (where filled) - count(distinct x) filter (where filled) as n_dup_lines,
        coalesce(sum(length(x)) filter (where not bad), 0) + greatest(count(*) filter (where not bad) - 1, 0) as rest from y group by k),
a as (select d.k, doc_id, len(w) as n_words, length(regexp_replace(t, '{WS}', '', 'g')) as word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
        n_lines, n_failed_lines, (length(t) - rest) * 100 > 40 * length(t) as lost
      from d join w using (k) join l using (k) left join rep using (k))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not lost as kept,
  n_lines::bigint as n_lines, n_failed_lines::bigint as n_failed_lines
from a
"""

OP6 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from c),
p as (select *, k = 1 or role <> lag(role) over (partition by conv_id order by k) as first from n),
e as (select *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'),
    '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') as body from p)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  (sum(length(body) + case when not first then 10 else 12 + length(role) + 10 + 11 end))::bigint as formatted_chars,
  (count(*) filter (where first))::bigint as n_messages
from e group by conv_id
"""

OP4 = r"""
with u as (select doc_id, text, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
v as (select doc_id, pos, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as x from u),
w as (select doc_id, pos, md5(x) as md5, ('0x' || substr(md5(x), 1, 15))::bigint as h, least(len(regexp_split_to_array(x, '[\x20\x09-\x0D]+')), 25) as words from v where x <> ''),
l as (select *, coalesce(sum(words) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as upto from w),
g as (select *, sum(words) over gram as gw, max(pos) over gram as last,
    md5(array_to_string(list(md5) over gram, ' ')) as gh,
    coalesce(list({'h': h, 'pos': pos}) over (partition by doc_id order by upto range between 25 preceding and 1 preceding), []) as before,
    coalesce(list({'h': h, 'pos': pos}) over (partition by doc_id order by upto range between 25 following and 100 following), []) as after
  from l window gram as (partition by doc_id order by upto range between current row and 24 following)),
f as (select *, case when gw >= 25 then gh end as fp, min(case when gw >= 25 then {'fp': gh, 'neg': -pos} end)
    over (partition by doc_id order by upto range between current row and 24 following) as least from g),
p as (select doc_id, pos, fp, last, list_reverse(before) as before, after, list_contains(list(-least.neg) over
    (partition by doc_id order by upto range between 24 preceding and current row), pos) as picked from f),
s as (select * from p where picked and fp is not null),
a as (select fp, min({'doc_id': doc_id, 'pos': pos}) as k, count(*) as n,
    arg_min({'before': before, 'after': after}, {'doc_id': doc_id, 'pos': pos}) as c from s group by fp having count(*) > 1),
m as (select s.*, k, c, least(len(before), len(c.before)) as nb, least(len(after), len(c.after)) as na from s join a using (fp) where {'doc_id': doc_id, 'pos': pos} > k),
q as (select *, coalesce(list_position(list_transform(range(1, nb + 1), lambda i: before[i].h = c.before[i].h), false) - 1, nb) as eb,
    coalesce(list_position(list_transform(range(1, na + 1), lambda i: after[i].h = c.after[i].h), false) - 1, na) as ea from m),
x as (select doc_id, pos, last, fp, 'before' as side, before[eb + 1:] as rest from q union all select doc_id, pos, last, fp, 'after', after[ea + 1:] from q),
z as (select *, list_transform(rest[:i], lambda y: y.h) as stretch, rest[i].pos as line_at from (select *, unnest(range(1, len(rest) + 1)) as i from x) as x2),
y as (select fp, side, stretch, min({'doc_id': doc_id, 'pos': pos}) as k2 from z group by all having count(*) > 1),
r as (select doc_id, case when eb = 0 then pos else before[eb].pos end as s, case when ea = 0 then last else after[ea].pos end as e from q
    union select doc_id, least(line_at, pos), greatest(line_at, last) from z join y using (fp, side, stretch) where {'doc_id': doc_id, 'pos': pos} > k2),
t as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as far from r),
o as (select *, sum(case when far is null or s > far + 1 then 1 else 0 end) over (partition by doc_id order by s, e rows unbounded preceding) as island from t),
i as (select doc_id, min(s) as s, max(e) as e from o group by doc_id, island),
d as (select doc_id, string_agg(s || '-' || e, ',' order by s) as removed, sum(e - s + 1)::bigint as n_removed from i group by doc_id),
k as (select u.doc_id, coalesce(string_agg(x, chr(10) order by pos) filter (where not exists (select 1 from i where i.doc_id = u.doc_id and pos between s and e)), '') as text from u group by u.doc_id)
select doc_id, k.text as text, coalesce(removed, '') as removed, coalesce(n_removed, 0)::bigint as n_removed from k left join d using (doc_id)
"""

OP11 = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, term, count(*) as repeats from i group by all),
c as (select count(*)::hugeint::bigint as n, sum(len(t))::bigint as l from d where len(t) > 0),
f as (select k, doc_id, len(t) as size, unnest(t) as term from d),
tf as (select k, doc_id, size, term, count(*) as tf from f where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, c group by term, n),
s as (select item_id, k, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l))))::bigint as score
      from q join tf using (term) join w using (term), c group by item_id, k, doc_id)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 20
"""

OP12 = rf"""
with crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select row_number() over () as k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '') as w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from documents, crc),
s as (select k, doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as on_, h // 10 as g, (h // 10) % len(w) as a from d),
e as (select k, unnest(w) as x, generate_subscripts(w, 1) - 1 as i from s where on_ is not true
  union all select k, w[j + 1] as x, i from (select k, w, i, case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end as j from (select *, unnest(range(n)) as i from s where on_))),
-- five words on: a run of period q has at least that many places that equal those q words on
f as (select k, i, hash(x, lead(x, 1) over o, lead(x, 2) over o, lead(x, 3) over o, lead(x, 4) over o) as h5, count(*) over (partition by k) as n from e window o as (partition by k order by i)),
f5 as (select * from f where i + 5 <= n),
m as (select f5.k, f5.i, v.i - f5.i as q from f5 join f5 as v on f5.k = v.k and f5.h5 = v.h5 and v.i > f5.i where 4 * (v.i - f5.i) <= f5.n),
b as (select k, q, min(i) as start, max(i) + 5 + q - min(i) as length from (select *, i - row_number() over (partition by k, q order by i) as island from m) group by k, q, island),
r as (select k, start, length, min(q) as period from b where length >= greatest(6, 4 * q) group by k, start, length),
a as (select k, count(*) as n_runs, arg_max({{'s': start, 'n': length, 'p': period}}, [length, -start, -period]) as best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by k),
gone as (select distinct k, unnest(range(start + period, start + length)) as i from r),
c as (select e.k, string_agg(x, ' ' order by e.i) as t from e anti join gone on e.k = gone.k and e.i = gone.i group by e.k)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.n::bigint as length, best.p::bigint as period, (1000 * best.n // best.p)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(c.t, '')) as collapsed_sha256
from d left join a using (k) left join c using (k)
"""

OP13 = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, e.vec_id, list_inner_product(q.v, e.v)::bigint as score from e as q, e where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

ORACLES = {"op11_sliced_bloom_search": OP11, "op4_line_dedup": OP4, "op6_chat_formatting": OP6, "op10_quality_rules": OP10, "op12_periodic_runs": OP12, "op13_pivot_distance_topk": OP13}
