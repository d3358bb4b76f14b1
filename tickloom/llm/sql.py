"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mixing"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 15))::bigint as draw
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from d group by source
), b as (
  select *, 3 * source_size as cap, (sum(source_size) over ())::double as budget from s
), l as (
  select *, budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as room,
         sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_left
  from b
), f as (select *, cap::double * weight_left <= room * weight as is_full from l
), t as (
  select source, source_size,
         case when is_full then cap::double
              else (budget - coalesce(sum(case when is_full then cap end) over (), 0)) * weight / (sum(case when not is_full then weight end) over ()) end as target
  from f
), w as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from t
), r as (
  select d.doc_id, d.size, w.source_size, w.target, w.whole, d.draw,
         w.target - w.whole * w.source_size as need,
         sum(d.size) over (partition by d.source order by d.draw, d.doc_id::varchar, d.size rows unbounded preceding) as upto
  from d join w on d.source is not distinct from w.source
)
select doc_id, size::bigint as size, source_size, target,
       (size * (whole + case when need > 0 and 2 * upto - size <= 2 * need then 1 else 0 end))::bigint as taken
from r
"""

_PARTS = r"""
parts as (
  select page_id, url,
         case when url like '%://%' then translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when url like '%://%' then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path
  from (select page_id, url, substr(url, strpos(url, '://') + 3) as rest from pages)
), keyed as (
  select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '') as key from parts
)"""

ORACLES["op8_url_filter"] = f"""
with {_PARTS}, listed as (
  select distinct key from keyed where regexp_matches(url, '://[^/?#]*(cheap|pills|casino|poker|loans)') and key <> ''
), ruled as (
  select page_id, host, path, key,
    case when (host = 'example.com' or host like '%.example.com') and path like '/en/7%' then 'example.com/en/7'
         when (host = 'example.net' or host like '%.example.net') and path like '/de/8%' then 'example.net/de/8'
         when (host = 'com' or host like '%.com') and path like '/en/%' then 'com/en/'
         when (host = 'net' or host like '%.net') and path like '/de/%' then 'net/de/'
         when (host = 'org' or host like '%.org') and path like '/es/%' then 'org/es/' end as rule
  from keyed
)
select page_id, host, path, rule,
  case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block'
       when key in (select key from listed) then 'block' else 'allow' end as verdict
from ruled
"""


ORACLES["op5_decontamination"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bw as (
  select item_id, array_to_string(w[i : i + 9], ' ') as k, least(len(w), 10) as n
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
), sizes as (select distinct n from bw), dw as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes)
), hits as (
  select distinct doc_id, item_id, i, dw.n from dw join bw on dw.k = bw.k and dw.n = bw.n
), hw as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id
), hi as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""

ORACLES["op6_minhash"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), g as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from g group by doc_id
), e as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by all
), links as (
  select a, b from e join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
), reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union select links.b, reach.r from reach join links on links.a = reach.doc_id where reach.r < links.b
), comp as (select doc_id, min(r) as component_id from reach group by doc_id)
select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, documents.doc_id = component_id as kept
from documents left join n using (doc_id) join comp using (doc_id)
"""

ORACLES["op4_line_dedup"] = r"""
with l as (
  select doc_id, i, lines[i] as t, strlen(lines[i]) as n
  from (select doc_id, lines, unnest(generate_series(1, len(lines))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))
), f as (
  select t, n, min(row(doc_id, i)) as f from l where n >= 30 or regexp_matches(t, '[0-9A-Za-z]') or strlen(t) <> length(t) group by t, n
), near as (
  select distinct y.t from f x join f y on x.n >= 30 and y.n >= 30 and x.n between y.n - 2 and y.n + 2 and x.f < y.f and levenshtein(x.t, y.t) <= 2
), j as (
  select l.*, row(doc_id, i) <> f.f or near.t is not null as gone
  from l left join f on f.t = l.t left join near on near.t = l.t
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(t, chr(10) order by i) filter (not coalesce(gone, false)), '')) as kept_sha256
from j group by doc_id
"""


# CRC-32 of column x of table `hashed` (name, x = hex of the bytes): its table follows from the polynomial.
_CRC = """
crc_table as (
  select list_transform(range(256), lambda b: list_reduce([b::bigint] || range(8), lambda c, s: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), crc as (
  select name, xor(list_reduce([4294967295] || [('0x' || substr(x, 2 * i + 1, 2))::bigint for i in range(length(x) // 2)], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from hashed, crc_table
)"""

# In a run of length >= max(6, 4 * q) five words or more in a row come again q words later, so windows of five words find every period.
ORACLES["op11_periodic_runs"] = rf"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), hashed as (select distinct doc_id as name, hex(encode(doc_id::varchar)) as x from d), {_CRC},
planted as (
  select doc_id, w, len(w) as n, crc, crc // 10 as g from d join crc on name = doc_id
), p as (
  select *, case when crc % 10 = 0 and n > 0 then g % n else n end as a,
         case when crc % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) else 1 end as per from planted
), words as (
  select doc_id, i, case when i >= a then w[a + (i - a) % per + 1] else w[i + 1] end as word
  from (select *, unnest(range(n)) as i from p)
), grams as (
  select doc_id, i, word || ' ' || lead(word, 1) over v || ' ' || lead(word, 2) over v || ' ' || lead(word, 3) over v || ' ' || lead(word, 4) over v as gram
  from words window v as (partition by doc_id order by i)
), pairs as (
  select x.doc_id, y.i - x.i as q, x.i from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i
), stretches as (
  select doc_id, q, min(i) as start, count(*) + 4 + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as k from pairs) group by doc_id, q, k
), long as (select * from stretches where length >= greatest(6, 4 * q)
), runs as (
  select * from long x where not exists (
    select 1 from long y where y.doc_id = x.doc_id and y.q < x.q and x.q % y.q = 0 and y.start <= x.start and y.start + y.length >= x.start + x.length)
), best as (
  select doc_id, count(*) as n_runs, max(row(length, -start, -q)) as b, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as listed
  from runs group by doc_id
), gone as (select distinct doc_id, unnest(range(start + q, start + length)) as i from runs
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id
)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, (-b[2])::bigint as start, b[1]::bigint as length, (-b[3])::bigint as period,
       (1000 * b[1] // -b[3])::bigint as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from d left join best using (doc_id) left join kept using (doc_id)
"""

ORACLES["op12_importance_resampling"] = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), dw as (select doc_id, unnest(w) as word from d), bw as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from benchmark
), counts as (
  select word as name, sum(s) as s, sum(t) as t from (select word, 1 as s, 0 as t from dw union all select word, 0, 1 from bw) group by word
), hashed as (select name, hex(encode(name)) as x from counts), {_CRC},
bucket as (
  select crc % 10000 as b, sum(s)::double as s, sum(t)::double as t from counts join crc using (name) group by b
), gain as (
  select b, floor(1000 * ln((t + 1) * ((sum(s) over ()) + 10000) / ((s + 1) * ((sum(t) over ()) + 10000))))::bigint as gain from bucket
), f as (
  select doc_id, count(*) as n, floor(sum(gain) / count(*))::bigint as weight from dw join crc on name = word join gain on b = crc % 10000 group by doc_id
), scored as (
  select doc_id, coalesce(n, 0) as n, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from d left join f using (doc_id)
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as eligible from scored where n >= 20
)
select doc_id, n::bigint as n_features, weight, score::bigint as score, case when 10 * eligible // 100 >= rank then rank end as rank
from scored left join ranked using (doc_id)
"""

ORACLES["op13_substring_dedup"] = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i : i + 49], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)
), first as (select k, min(doc_id) as least from windows group by k
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as i from windows join first using (k) where doc_id > least
), words as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id
), n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""
