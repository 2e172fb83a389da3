"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

EXACT = r"""
with t as (select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h from documents),
g as (select h, min_by(doc_id, (-n, doc_id)) keep_id, count(*) group_size from t group by h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from t join g using (h)
"""

SUBSTRING = rf"""
with d as (select doc_id, {WORDS} w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) pos from d where len(w) >= 50),
h as (select doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) k from p),
f as (select k, min(doc_id) first_id from h group by k),
r as (select distinct doc_id, unnest(range(pos, pos + 50)) i from h join f using (k) where first_id < doc_id),
g as (select doc_id, list(i) gone from r group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
  sha256(array_to_string(case when gone is null then w else [w[i] for i in range(1, len(w) + 1) if not list_contains(gone, i)] end, ' ')) kept_sha256
from d left join g using (doc_id)
"""

JACCARD = rf"""
with recursive d as (select doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
s as (select distinct doc_id, array_to_string(w[pos:pos + 4], ' ') k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) pos from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
o as (select a.doc_id u, b.doc_id v, count(*) shared from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
l as (select u, v from o join n x on x.doc_id = u join n y on y.doc_id = v where 100 * shared >= 75 * (x.n + y.n - shared)),
e as (select u, v from l union select v, u from l),
c as (select doc_id as node, doc_id as reach from n union select c.node, e.v from c join e on e.u = c.reach),
m as (select node, min(reach) component_id from c group by node)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(component_id, d.doc_id) component_id
from d left join n on n.doc_id = d.doc_id left join m on m.node = d.doc_id
"""

EMBEDDING = r"""
with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings),
g as (select vec_id, e from v where e is not null and not list_contains(list_transform(e, lambda x: x is null or isnan(x) or isinf(x)), true) and list_contains(list_transform(e, lambda x: x <> 0), true)),
l as (select a.vec_id u, b.vec_id v from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
c as (select vec_id as node, vec_id as reach from v union select c.node, l.v from c join l on l.u = c.reach),
m as (select node, min(reach) component_id from c group by node),
n as (select u, count(*) n from l group by u)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id as kept
from v join m on m.node = vec_id left join n on n.u = vec_id
"""

TOPK = r"""
with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) x from embeddings
  where vec_id is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)), true)),
s as (select a.vec_id query_id, a.x q, b.vec_id, cast(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) as bigint) score
  from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id, q order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
with d as (select row_number() over () r, doc_id, {TERMS} w from documents),
a as (select count(*) docs, sum(len(w)) length from d where len(w) > 0),
p as (select r, doc_id, len(w) n, unnest(w) term from d),
c as (select r, doc_id, n, term, count(*) tf from p group by all),
f as (select term, count(*) df from c group by term),
q as (select distinct item_id, unnest({TERMS}) term from benchmark),
s as (select item_id, r, doc_id,
  cast(sum(cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // cast(length as bigint))))) as bigint) score
  from q join c using (term) join f using (term), a group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from s where score > 0 qualify rank <= 10
"""

CONVERSATIONS = r"""
with recursive k as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') key from conversations),
h as (select *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: cast(ascii(c) as bigint))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 kind from k),
d as (select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end text
  from h join (values (1), (2)) c(copy) on copy = 1 or kind = 3 where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) i from d),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '' end fault,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) pair from o),
ids as (select distinct conv_id from conversations),
n as (select ids.conv_id, count(i) n from ids left join f on ids.conv_id is not distinct from f.conv_id group by ids.conv_id),
moves as (select * from (values (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']),
  (3, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 3, 2, ['user:', 'assistant:'])) m(a, b, k, made)),
edits as (select * from (values ('D'), ('K'), ('R')) e(letter)),
p as (
  select conv_id, 0 as i, 0 as st, {'cost': 0, 'audit': '', 'made': cast([] as varchar[])} as best from n
  union all
  select conv_id, i, st, min(best) from (
    select p.conv_id, p.i + 1 as i,
      case letter when 'D' then m.b when 'R' then [2, 2, 3, 2][m.b + 1]
        else case left(role, 1) when 's' then case when m.b = 0 then 1 end when 'u' then case when m.b <> 2 then 2 end when 'a' then case when m.b = 2 then 3 end when '' then m.b end end st,
      {'cost': p.best.cost + 3 * m.k + case letter when 'D' then 4 else case letter when 'R' then 3 else 0 end + case when fault = 't' then 3 else 0 end end,
       'audit': p.best.audit || repeat('I', m.k) || letter,
       'made': list_concat(list_concat(p.best.made, m.made), case letter when 'D' then [] when 'K' then [role || ':' || text] else [[null, 'user', 'assistant'][[2, 2, 3, 2][m.b + 1]] || ':' || text] end)} best
    from p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1 join moves m on m.a = p.st, edits
    where letter = 'D' or fault not in ('b', 'd')) where st is not null group by conv_id, i, st),
z as (select p.conv_id, min({'cost': p.best.cost + 3 * m.k, 'audit': p.best.audit || repeat('I', m.k), 'made': list_concat(p.best.made, m.made)}) best
  from p join n on n.conv_id is not distinct from p.conv_id and n.n = p.i join moves m on m.a = p.st where m.b in (0, 3) group by p.conv_id),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
  count(*) filter (fault = 't') truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from f group by conv_id)
select z.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  cast(best.cost as bigint) as cost, best.audit as audit, sha256(array_to_string(best.made, chr(10))) repaired_sha256
from z left join g on g.conv_id is not distinct from z.conv_id
"""


def url(rules, sites: str) -> str:
    parts = " ".join(
        f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{verdict} {h}{p}'"
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a),
c as (select *, case {parts} end hit, host || regexp_replace(path, '/+$', '') key from b),
listed as (select distinct key from c where host <> '' and regexp_matches(host, '{sites}'))
select page_id, host, path, substr(hit, instr(hit, ' ') + 1) as rule,
  case when hit is not null then substr(hit, 1, instr(hit, ' ') - 1) when listed.key is not null then 'block' else 'allow' end verdict,
  hit is null and listed.key is not null as listed
from c left join listed on c.key = listed.key and c.host <> ''
"""
