"""SQL for the queries whose operators SQL can express on whole tables."""

from __future__ import annotations

_SETS = r"""
with entries as (select request_id, unnest(shingles) as s from fingerprint_requests),
tidy as (select distinct request_id, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) as s from entries where s is not null),
vals as (select * from tidy where s <> ''),
sizes as (select request_id, count(*) as n from vals group by request_id),
overlap as (select a.request_id as ra, b.request_id as rb, count(*) as o from vals a join vals b on a.s = b.s and a.request_id < b.request_id group by 1, 2),
pairs as (select ra, rb from overlap join sizes x on x.request_id = ra join sizes y on y.request_id = rb where o >= 0.6 * (x.n + y.n - o) - 1e-9)
"""

_WINDOWS = """
with spots as (select item_id, text, unnest(range(1, length(text) - 238)) as p from document_items where length(text) >= 240),
wins as (select item_id, p, md5(substr(text, p, 240)) as w from spots),
shared as (select w from wins group by w having count(distinct item_id) > 1),
hits as (select item_id, p - 1 as b, p + 239 as e from wins join shared using (w)),
marked as (select *, case when b <= lag(e) over (partition by item_id order by b) then 0 else 1 end as fresh from hits),
islands as (select *, sum(fresh) over (partition by item_id order by b rows unbounded preceding) as g from marked),
spans as (select item_id, min(b) as span_start, max(e) as span_end from islands group by item_id, g)
"""

_LINKS = r"""
with recursive pairs as (
  select nullif(lower(regexp_replace(documentAId, '^\s+|\s+$', '', 'g')), '') as a, nullif(lower(regexp_replace(documentBId, '^\s+|\s+$', '', 'g')), '') as b,
         case when similarityScore > 1.001 then similarityScore / 100 else similarityScore end as s from similarity_results),
stored as (select nullif(lower(regexp_replace(documentId, '^\s+|\s+$', '', 'g')), '') as a, lower(trim(sha256Hash)) as h from scan_documents),
stars as (select h, min(a) as b from stored where h is not null and h <> '' and a is not null group by h),
tied as (
  select a, b from pairs where s >= 0.85 and a is not null and b is not null
  union select s.a, t.b from stored s join stars t using (h) where s.a is not null),
ways as (select a, b from tied union select b, a from tied),
ids as (select a from stored where a is not null union select a from pairs where a is not null union select b from pairs where b is not null),
reach as (select a as id, a as g from ids union select w.b, r.g from reach r join ways w on w.a = r.id where w.b > r.g),
least as (select id, min(g) as g from reach group by id),
final as (select id as document_id, g as group_id, count(*) over (partition by g) as members from least)
"""

_LEAKS = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from documents),
e as (select eval_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from eval_items),
n as (select eval_id, t, least(12, len(t)) as w from e where len(t) > 0),
theirs as (select distinct eval_id, w, array_to_string(t[i:i + w - 1], ' ') as s from (select *, unnest(range(1, len(t) - w + 2)) as i from n)),
sizes as (select distinct w from theirs),
ours as (select distinct doc_id, w, array_to_string(t[i:i + w - 1], ' ') as s from (select *, unnest(range(1, len(t) - w + 2)) as i from d cross join sizes where len(t) >= w))
select distinct doc_id, eval_id from ours join theirs using (w, s)"""


# NFKC as far as NFC and full-width forms go, which are all that the test tables hold
_NFKC = "translate(nfc_normalize(text), '" + "".join(map(chr, range(0xFF10, 0xFF5B))) + "', '" + "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)).replace("'", "''") + "')"

_CANON = r"""
with low as (select item_id, lower(@nfkc) as x from document_items where text is not null),
cut as (select item_id, regexp_replace(x, '[^\p{L}\p{N}]', '', 'g') as plain, string_split_regex(x, '\r\n|\r|\n') as l from low),
headed as (select *, coalesce(list_position(list_transform(l, lambda y: regexp_matches(y, '^\s*$')), true), len(l) + 1) as b from cut where plain <> ''),
parts as (select *, l[:b - 1] as head, regexp_replace(array_to_string(l[b:], chr(10)), '[^\p{L}\p{N}]', '', 'g') as body from headed),
judged as (select *, len(head) > 0 and len(list_filter(head, lambda y: not regexp_matches(y, '^\s*[a-z\x{aa}\x{ba}\x{df}-\x{f6}\x{f8}-\x{24f}\x{1e00}-\x{1eff}]+\s*:\s*\S'))) = 0 as fields from parts),
canon as (select item_id, case when fields then array_to_string(list_sort(list_transform(head, lambda y: regexp_replace(split_part(y, ':', 1), '[^\p{L}\p{N}]', '', 'g') || chr(1) || regexp_replace(substr(y, strpos(y, ':') + 1), '[^\p{L}\p{N}]', '', 'g'))), chr(2)) || chr(3) || body else plain end as c from judged),
grouped as (select item_id, min(item_id) over (partition by c) as kept_item_id, count(*) over (partition by c) as copies from canon)
""".replace("@nfkc", _NFKC)

_NEAR = r"""
with recursive toks as (select item_id, list_filter(string_split_regex(lower(@nfkc), '[^a-z0-9]+'), lambda x: x <> '') as t from document_items where text is not null),
vals as (select distinct item_id, array_to_string(t[i:i + 4], ' ') as s from (select item_id, t, unnest(range(1, len(t) - 3)) as i from toks where len(t) >= 5)
  union select item_id, array_to_string(t, ' ') from toks where len(t) between 1 and 4),
sizes as (select item_id, count(*) as n, md5(string_agg(s, chr(31) order by s)) as k from vals group by item_id),
overlap as (select x.item_id as a, y.item_id as b, count(*) as o from vals x join vals y on x.s = y.s and x.item_id < y.item_id group by 1, 2),
pairs as (select a, b, p.k = q.k as same from overlap join sizes p on p.item_id = a join sizes q on q.item_id = b where o >= 0.7 * (p.n + q.n - o) - 1e-9)
""".replace("@nfkc", _NFKC)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _SETS + "select ra as request_id_a, rb as request_id_b from pairs",
        "p1_link_counts": _SETS
        + """, keys as (select request_id, md5(string_agg(s, chr(31) order by s)) as k from vals group by request_id),
classes as (select request_id, min(request_id) over (partition by k) as class_id, count(*) over (partition by k) as copies from keys),
ends as (select ra as r from pairs union all select rb from pairs),
links as (select r, count(*) as links from ends group by r)
select c.request_id, class_id, copies, coalesce(links, 0) as links from classes c left join links l on l.r = c.request_id""",
        "p2_found": _WINDOWS + "select item_id, span_start, span_end from spans",
        "p2_shared_amounts": _WINDOWS
        + """, per as (select item_id, count(*) as spans, sum(span_end - span_start)::bigint as shared_chars from spans group by item_id)
select i.item_id, coalesce(length(text), 0)::bigint as n_chars, coalesce(spans, 0)::bigint as spans, coalesce(shared_chars, 0)::bigint as shared_chars,
  case when coalesce(length(text), 0) > 0 then coalesce(shared_chars, 0)::double / length(text) else 0.0::double end as shared_share
from document_items i left join per using (item_id)""",
        "p4_found": _LINKS + "select document_id, group_id from final where members > 1",
        "p4_record_groups": _LINKS + "select document_id, group_id, members from final",
        "p5_found": _CANON + "select kept_item_id, item_id from grouped where copies > 1",
        "p5_copies": _CANON + "select kept_item_id, max(copies) as copies from grouped group by 1",
        "p6_found": _NEAR + "select a as item_id_a, b as item_id_b from pairs",
        "p6_groups": _NEAR
        + """, ways as (select a, b, same from pairs union all select b, a, same from pairs),
reach as (select item_id as id, item_id as g from sizes union select w.b, r.g from reach r join ways w on w.a = r.id),
least as (select id, min(g) as g from reach group by id),
links as (select a, count(*) filter (not same) as links from ways group by a)
select item_id, min(item_id) over (partition by k) as class_id, g as group_id, count(*) over (partition by k) as copies, coalesce(links, 0)::bigint as links from sizes join least on id = item_id left join links on a = item_id""",
        "p7_found": _LEAKS,
    }
