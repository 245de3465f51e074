"""DuckDB SQL for the queries that SQL can express, over the tables as views."""

from __future__ import annotations

#: Lower-cases A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = rf"""
with recursive docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select distinct rid, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from docs
), sizes as (
  select rid, count(*) as n from grams group by rid
), signatures as (
  select rid, n, s, min(rid) over (partition by s) as rep from (select rid, count(*) as n, md5(string_agg(g, chr(10) order by g)) as s from grams group by rid)
), own as (
  select rid, g from grams semi join (select distinct rep from signatures) r on grams.rid = r.rep
), pairs as (
  select a.rid as a, b.rid as b, count(*) as k from own a join own b on a.g = b.g and a.rid < b.rid group by all
), links as (
  select a, b from pairs join sizes x on x.rid = a join sizes y on y.rid = b where 100 * k >= 80 * (x.n + y.n - k)
  union all select rep, rid from signatures where rep <> rid
), edges as (
  select a, b from links union select b, a from links
), reach as (
  select rid as a, rid as b from sizes union select r.a, e.b from reach r join edges e on r.b = e.a
), least as (
  select a as rid, min(doc_id) as component_id from reach join docs on docs.rid = reach.b group by a
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from docs d left join sizes using (rid) left join least using (rid)
"""

WARC = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), first as (
  select payload_digest, max(page_id) as response from p where payload_bytes >= 1000 group by payload_digest
)
select page_id, payload_bytes, payload_digest,
  case when response is null or response = page_id then 'response' else 'revisit' end as record_type,
  case when response <> page_id then response end as refers_to
from p left join first using (payload_digest)
"""

DECONTAMINATE = rf"""
with docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item, least(len(w), 10) as k, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) as text from items where len(w) > 0
), sizes as (
  select distinct k from windows
), places as (
  select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as text from (select rid, k, w, unnest(range(1, len(w) - k + 2)) as i from docs, sizes where len(w) >= k)
), hits as (
  select rid, i, k, item from places join windows using (k, text)
), covered as (
  select rid, count(distinct j) as n_hit from (select rid, unnest(range(i, i + k)) as j from (select distinct rid, i, k from hits)) group by rid
), found as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from hits) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (rid) left join found using (rid)
"""
