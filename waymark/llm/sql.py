"""DuckDB SQL for the queries that SQL can express over whole tables in fair time."""

ORACLES: dict[str, str] = {
    "op1_warc_salvage": """
with d as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first, count(*) as n from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when n > 1 and page_id <> first then 'revisit' else 'response' end as record_type, case when n > 1 and page_id <> first then first end as refers_to
from d left join f using (payload_digest)""",
    "op9_circulant_minhash": r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case len(w) when 0 then []::varchar[] when 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as g from t),
n as (select doc_id, len(g)::bigint as n_shingles from s),
e as (select doc_id, unnest(g) as shingle from s),
f as (select e.doc_id, e.shingle as h, n.n_shingles as n from e join n using (doc_id)),
p as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as common_n from f a join f b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
l as (select x, y from p where 100 * common_n >= 80 * (nx + ny - common_n)),
d as (select x, y from l union select y, x from l),
r as (select doc_id as x, doc_id as y from documents union select r.x, d.y from r join d on r.y = d.x)
select n.doc_id, n.n_shingles, min(r.y) as component_id, n.doc_id = min(r.y) as kept from n join r on r.x = n.doc_id group by n.doc_id, n.n_shingles""",
    "quality_base_columns": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
c as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from l),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as three from t),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, three) as n from g) where n > 1),
q as (select doc_id, count(distinct i + k)::bigint as n from r, (select unnest([0, 1, 2]) as k) group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, n_words < 50 or 100 * coalesce(n, 0) > 50 * n_words as base_failed from c left join q using (doc_id)""",
    "pii_base_spans": r"""
with k as (select * from (values (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) as v(kind, name, pattern)),
t as (select doc_id, kind, name, pattern, coalesce(text, '') as text from documents, k),
m as (select doc_id, kind, name, regexp_extract_all(text, pattern) as found, string_split_regex(text, pattern) as gaps from t),
s as (select doc_id, kind, name, unnest(found) as span, unnest(list_transform(range(1, len(found) + 1), lambda i: length(array_to_string(gaps[1:i], '')) + length(array_to_string(found[1:i - 1], '')))) as start from m),
d as (select *, regexp_replace(span, '[^0-9]', '', 'g') as digits from s),
o as (select * from d where case kind
  when 0 then true
  when 1 then list_max(list_transform(string_split(span, '.'), lambda x: coalesce(try_cast(x as bigint), 999))) <= 255
  when 2 then length(digits) between 12 and 19 and list_sum(list_transform(range(0, length(digits)), lambda i: case when i % 2 = 0 then digits[length(digits) - i]::int else (2 * digits[length(digits) - i]::int) // 10 + (2 * digits[length(digits) - i]::int) % 10 end)) % 10 = 0
  else length(digits) between 9 and 15 end),
g as (select doc_id, count(*) filter (kind = 0) as n_email, count(*) filter (kind = 1) as n_ip, count(*) filter (kind = 2) as n_card, count(*) filter (kind = 3) as n_phone, string_agg(name || ':' || start || ':' || (start + length(span)), ',' order by start, kind) as spans from o group by doc_id)
select doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card, coalesce(n_phone, 0)::bigint as n_phone, sha256(coalesce(spans, '')) as base_sha256 from documents left join g using (doc_id)""",
    "shard_sizes": """
select docs // 40 + k as size_rows, case k when 0 then 40 - docs % 40 else docs % 40 end as n_shards, true as gapless
from (select count(*) as docs from documents), (select unnest([0, 1]) as k) where docs // 40 + k > 0 and (k = 0 or docs % 40 > 0)""",
}
