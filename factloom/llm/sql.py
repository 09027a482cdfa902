"""DuckDB SQL for the queries that it can express: the same rules written a plainer way."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as materialized (select row_number() over () rid, doc_id, {_WORDS} w from documents),
b as materialized (select item_id::varchar item, w, least(len(w), 10) n from (select item_id, {_WORDS} w from benchmark) where len(w) > 0),
win as (select distinct item, n, array_to_string(w[k:k + n - 1], ' ') g from (select item, n, w, unnest(range(1, len(w) - n + 2)) k from b)),
grams as (select rid, p, n, array_to_string(w[p:p + n - 1], ' ') g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from win))),
hit as materialized (select distinct rid, p, n, item from grams join win using (n, g)),
pos as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + n)) q from hit) group by rid),
which as (select rid, list_sort(list(distinct item)) l from hit group by rid)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(len(l), 0) n_items, sha256(coalesce(array_to_string(l, ','), '')) items_sha256, n_hit is not null contaminated
from d left join pos using (rid) left join which using (rid)"""

URLS = r"""
with pages_ as (select page_id, url, date '2024-01-01' + (page_id % 366)::int fetched,
  nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') host from pages),
parts as (select page_id, fetched, array_to_string(p[i:], '.') pattern from (select page_id, fetched, string_split(host, '.') p, unnest(range(1, len(string_split(host, '.')) + 1)) i from pages_ where host is not null)),
dated as (select pattern, date '2024-01-01' + ((ascii(pattern) * 31 + length(pattern) * 17) % 400)::int as_of from (select distinct pattern from parts) where contains(pattern, '.') and length(pattern) % 3 <> 0),
entries as (select pattern, as_of, true added from dated union all select pattern, as_of + 45, false from dated where length(pattern) % 2 = 0 union all select pattern, as_of + 90, true from dated where length(pattern) % 4 = 0),
found as (select page_id, max_by({pattern: pattern, since: e.as_of}, length(pattern)) best from parts join entries e using (pattern)
  where added and as_of <= fetched and not exists (select 1 from entries x where x.pattern = e.pattern and not x.added and x.as_of > e.as_of and x.as_of <= fetched) group by page_id)
select page_id, url, fetched, host, best is not null blocked, best.pattern pattern, best.since since from pages_ left join found using (page_id)"""

ORACLE_SQL = {"op4_decontamination": DECONTAMINATION, "op6_urls": URLS}
