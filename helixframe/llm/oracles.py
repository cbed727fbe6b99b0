"""DuckDB SQL for the operators that SQL can express, over the same whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A hex digest in base32: 20-bit groups of five hex digits, four letters each.
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, 5 * (i // 4) + 1, 5))::bigint >> (5 * (3 - i % 4))) & 31)::int + 1, 1) for i in range(0, 32)], '')"

OP7_WARC = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hx from pages),
f as (select html, min(page_id) as first_id from p group by html)
select page_id, strlen(p.html)::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from p join f using (html)
"""

OP6_SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
w as (select doc_id, unnest([{'p': p, 's': md5_number(substr(hx, (2 * p + 1)::int, 100))} for p in range(0, length(hx) // 2 - 49)]) as x from d where length(hx) >= 100),
k as (select doc_id, x.p as p, x.s as s from w),
least_of as (select s, min(doc_id) as first_id from k group by s),
m as (select doc_id, p from k join least_of using (s) where first_id < doc_id),
y as (select doc_id, unnest([{'p': p, 'byte': substr(hx, (2 * p + 1)::int, 2)} for p in range(0, length(hx) // 2)]) as x from d where length(hx) > 0),
b as (select doc_id, x.p as p, x.byte as byte from y),
c as (select b.doc_id, b.p, byte, max(case when m.p is null then 0 else 1 end) over (partition by b.doc_id order by b.p rows between 49 preceding and current row) as gone
  from b left join m on m.doc_id = b.doc_id and m.p = b.p),
e as (select *, lag(gone, 1, 0) over (partition by doc_id order by p) as before from c),
o as (select doc_id, sum(gone)::bigint as n_removed, count(*) filter (where gone = 1 and before = 0) as n_spans, coalesce(string_agg(byte, '' order by p) filter (where gone = 0), '') as kept from e group by doc_id)
select d.doc_id, (length(hx) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join o using (doc_id)
"""

OP10_NGRAM_JOIN = f"""
with recursive t as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end as g from t),
n as (select doc_id, len(g)::bigint as n from s),
x as (select doc_id, unnest(g) as k from s),
c as (select a.doc_id as u, b.doc_id as v, count(*) as shared from x a join x b on a.k = b.k and a.doc_id <> b.doc_id group by all),
l as (select u, v from c join n a on a.doc_id = u join n b on b.doc_id = v where 100 * shared >= 75 * (a.n + b.n - shared)),
r(doc_id, to_id) as (select doc_id, doc_id from n union select r.doc_id, l.v from r join l on l.u = r.to_id)
select n.doc_id, any_value(n.n) as n_shingles, min(to_id) as component_id from r join n using (doc_id) group by n.doc_id
"""

OP9_VECTOR_SEARCH = """
with v as (select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(c.e, q.e) as score from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

ORACLE_SQL = {"op6_suffix_dedup": OP6_SUFFIX_DEDUP, "op7_warc": OP7_WARC, "op9_vector_search": OP9_VECTOR_SEARCH, "op10_ngram_join": OP10_NGRAM_JOIN}
