"""SQL twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from airloom.llm.chat import CONTROLS, DONE, SAYS, TURN

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = f"""
with recursive w as (
  select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' '))
      when len(ws) > 0 then [list_aggregate(ws, 'string_agg', ' ')] else [] end) as g from w)),
n as (select doc_id, count(*) as size, md5(string_agg(g, '|' order by g)) as own from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as inter from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b, x.own as mine, y.own as other from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * inter >= 75 * (x.size + y.size - inter)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as component from r group by 1),
l as (select a, count(distinct other) filter (other <> mine) as links from e group by 1)
select d.doc_id, coalesce(n.size, 0) as n_shingles, c.component as component_id, coalesce(l.links, 0) as n_links
from documents d left join n on n.doc_id = d.doc_id left join l on l.a = d.doc_id join c on c.a = d.doc_id"""

SPAN_DEDUP = f"""
with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
k as (select doc_id, unnest(range(1, len(ws) - 18)) as i, ws from w where len(ws) >= 20),
g as (select doc_id, i, md5(list_aggregate(ws[i:i + 19], 'string_agg', ' ')) as h from k),
f as (select *, row_number() over (partition by h order by doc_id, i) > 1 as again from g),
m as (
  select p.doc_id, p.i, p.word,
    coalesce(max(case when f.again then p.i end) over (partition by p.doc_id order by p.i rows between 19 preceding and current row), -1) >= 0 as gone
  from p left join f on f.doc_id = p.doc_id and f.i = p.i)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, cast(coalesce(sum(cast(m.gone as integer)), 0) as bigint) as n_removed,
  sha256(coalesce(string_agg(m.word, ' ' order by m.i) filter (not m.gone), '')) as kept_sha256
from w left join m on m.doc_id = w.doc_id group by w.doc_id, w.ws"""

SUFFIX_DEDUP = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
s as (select doc_id, x, cast(len(x) // 2 as bigint) as n from b),
p as (select doc_id, unnest(range(0, n)) as i, x, n from s),
g as (select doc_id, i, substr(x, 2 * i + 1, 2) as byte, case when i + 50 <= n then md5(substr(x, 2 * i + 1, 100)) end as h from p),
f as (select doc_id, i, byte, h is not null and doc_id > min(doc_id) over (partition by h) as later from g),
m as (select doc_id, i, byte, bool_or(later) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from f),
t as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from m)
select s.doc_id, s.n as n_bytes, cast(coalesce(sum(cast(gone as integer)), 0) as bigint) as n_removed,
  cast(coalesce(sum(cast(starts as integer)), 0) as bigint) as n_spans,
  sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (not gone), ''))) as kept_sha256
from s left join t on t.doc_id = s.doc_id group by s.doc_id, s.n"""


def _escaped(text: str) -> str:
    out = f"replace(coalesce({text}, ''), '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT_FORMATS = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(TURN) + len(SAYS) + len(DONE)} + length({_escaped('role')}) + length({_escaped('text')})) as bigint) as formatted_chars
from t group by 1"""

_MIX_CLASSES = range(16, -1, -1)


def _mix_class(c: int) -> str:
    """One class of sizes: the step of each source, the copies of its documents, and what they took."""
    last = f"a{c + 1}" if c + 1 in _MIX_CLASSES else "a"
    return f"""
p{c} as (
  select {last}.*, q.n as n, case when q.below > 0 then floor(least(greatest((target - cast(taken as double)) / cast(q.below as double), 0), 2) * 4294967296.0) else 0 end as step
  from {last} left join q on q.key = {last}.key and q.class = {c}),
k{c} as (
  select d.doc_id, d.size, source_size, target, d.key,
    cast((upto + i * cast(step as hugeint)) // 4294967296 - (upto + (i - 1) * cast(step as hugeint)) // 4294967296 as bigint) as copies
  from d join p{c} on d.key = p{c}.key where d.class = {c}),
a{c} as (
  select p{c}.key, source_size, target, taken + coalesce(w, 0) as taken, upto + coalesce(n, 0) * cast(step as hugeint) as upto
  from p{c} left join (select key, sum(size * copies) as w from k{c} group by key) x on x.key = p{c}.key)"""


SOURCE_MIX = f"""
with w as (
  select doc_id, coalesce('=' || source, 'null') as key, source, cast(len({_WORDS.format(text="coalesce(text, '')")}) as bigint) as size from documents),
v as (select *, case when size > 0 then (length(bin(size)) + 1) // 2 else 0 end as class from w),
d as (
  select *, row_number() over (partition by key, class
    order by size, cast('0x' || substr(sha256('11:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint), doc_id) as i from v),
q as (
  select key, class, count(*) as n, cast(sum(sum(size)) over (partition by key order by class) as bigint) as below from d group by key, class),
s as (
  select key, source, cast(sum(size) as bigint) as n, [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 as integer) + 1] as w
  from d group by key, source),
o as (
  select *, sum(n) over () as every, coalesce(sum(n) over (order by n / w, key rows between unbounded preceding and 1 preceding), 0) as smaller,
    sum(w) over (order by n / w, key rows between current row and unbounded following) as shares from s),
c as (select *, w * (3 * every - 4 * smaller) >= 4 * n * shares as capped from o),
t as (
  select key, n as source_size, case when capped then cast(2 * n as double)
    else cast(w * (3 * every - 4 * coalesce(sum(n) filter (capped) over (), 0)) as double) / cast(2 * sum(w) filter (not capped) over () as double) end as target from c),
a as (
  select key, source_size, target, cast(0 as hugeint) as taken, cast(cast('0x' || substr(sha256('11:' || key), 1, 8) as bigint) as hugeint) as upto from t),
{",".join(_mix_class(c) for c in _MIX_CLASSES)}
{" union all ".join(f"select doc_id, size, source_size, target, size * copies as taken, copies from k{c}" for c in _MIX_CLASSES)}"""

# CRC-32 of a text of ASCII letters, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length({text}) + 1), lambda i: cast(ascii({text}[i]) as bigint))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

PREFIX_TRIE = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id
    order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, count(*) as n, {_CRC.format(text="cast(conv_id as varchar)")} % 6 as h from t group by 1, 2),
d as (select c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) as lent from c left join c b on b.conv_id = c.base),
r as (
  select d.conv_id, p, role, text from d join t on t.conv_id = d.base where p <= h
  union all select d.conv_id, lent + p - h, role, text from d join t on t.conv_id = d.conv_id where p > h),
l as (select d.conv_id, coalesce(list({{'role': role, 'text': text}} order by p) filter (p is not null), []) as ts from d left join r on r.conv_id = d.conv_id group by 1),
x as (select conv_id, ts, unnest(range(0, len(ts) + 1)) as depth from l),
n as (
  select depth, ts[1:depth] as path, min(conv_id) as conv_id, count(*) as n_convs, case when depth = 0 then 0 else length(any_value(ts[depth].text)) end as chars,
    string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(ts) = depth) as ends
  from x group by depth, ts[1:depth]),
k as (select depth - 1 as depth, path[1:depth - 1] as path, count(*) as n_children from n where depth > 0 group by 1, 2),
w as (select n.*, coalesce(n_children, 0) as kids from n left join k on k.depth = n.depth and k.path = n.path),
u as (select unnest(range(0, depth + 1)) as top, path, kids, (n_convs - 1) * chars as saved from w),
s as (select top as depth, path[1:top] as path, sum(cast(kids = 0 as integer)) as n_leaves, sum(saved) as saved_tokens from u group by 1, 2)
select w.conv_id, w.depth, o.conv_id as parent_conv_id, w.n_convs, w.kids as n_children, cast(s.n_leaves as bigint) as n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from w join s on s.depth = w.depth and s.path = w.path left join n o on o.depth = w.depth - 1 and o.path = w.path[1:w.depth - 1]"""

def _gap(p: str, q: str) -> str:
    return f"cast((cast({p} - {q} as hugeint) * ({p} - {q})) // ({p} + {q}) as bigint)"


SOURCE_DIVERGENCE = rf"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
w as (select row, lang, source, unnest(ts) as term from d),
k as (select lang, term, count(*) as n from w group by 1, 2 having count(distinct row) >= 10),
v as (select lang, count(*) as terms, sum(n) as total from k group by 1),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as n from w join k on k.lang = w.lang and k.term = w.term group by 1, 2, 3),
t as (select lang, source, sum(n) as total from c group by 1, 2),
a as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + cast(1000000000 * (cast(coalesce(c.n, 0) as hugeint) + 2) // (coalesce(t.total, 0) + 2 * v.terms) as bigint) as p,
    1 + cast(1000000000 * (cast(k.n as hugeint) + 2) // (v.total + 2 * v.terms) as bigint) as q
  from g join k on k.lang = g.lang join v on v.lang = g.lang left join t on t.lang = g.lang and t.source = g.source
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (
  select x.lang, x.source, y.source as item, sum({_gap('x.p', 'y.p')}) as value
  from a x join a y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by 1, 2, 3),
r as (
  select x.lang, x.source, 'pair' as part, y.source as item, cast(coalesce(p.value, 0) as bigint) as value
  from g x join g y on y.lang = x.lang and y.source <> x.source left join p on p.lang = x.lang and p.source = x.source and p.item = y.source
  union all select lang, source, 'term', term, {_gap('p', 'q')} from a where n > 0 and p > q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from r qualify part = 'pair' or rank <= 10"""

SQL = {
    "op11_source_mix": SOURCE_MIX,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_source_divergence": SOURCE_DIVERGENCE,
    "op3_ngram_join": NGRAM_JOIN,
    "op8_suffix_dedup": SUFFIX_DEDUP,
    "op9_span_dedup": SPAN_DEDUP,
    "op10_chat_formats": CHAT_FORMATS,
}
