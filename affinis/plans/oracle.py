"""SQL for the queries that SQL can express."""

from __future__ import annotations

from affinis.functions.hashing import FNV_OFFSET, FNV_PRIME, MODULUS, coefficients
from affinis.functions.words import BOILERPLATE, CODE_KEYWORDS, STOP_WORDS


def _list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _half(x: str, digits: int) -> str:
    m = float(10**digits)
    return f"(floor(({x}) * {m}::double + 0.5) / {m}::double)"


_TOKENS = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
_T = _TOKENS.format(c="text")

_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), chr(160), ' '), '\r\n|\r', chr(10), 'g'), '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[ \t]+', ' ', 'g'),
 '(?m)^[ \t\f\x0B]+|[ \t\f\x0B]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


def _shingled(k: int = 5) -> str:
    later = ", ".join(f"lead(w, {i}) over (partition by doc_id order by p) as w{i}" for i in range(1, k))
    joined = " || ' ' || ".join(["w", *[f"w{i}" for i in range(1, k)]])
    return f"""
toks as (select doc_id, {_T} as t from documents),
words as (select doc_id, unnest(t) as w, unnest(range(1, len(t) + 1)) as p from toks),
runs as (select doc_id, w, {later} from words),
vals as (select distinct doc_id, {joined} as s from runs where w{k - 1} is not null
         union select doc_id, array_to_string(t, ' ') from toks where len(t) between 1 and {k - 1}),
sizes as (select doc_id, count(*) as n from vals group by doc_id)"""


_OVERLAP = """
overlap as (select x.doc_id as a, y.doc_id as b, count(*) as shared from vals x join vals y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2)"""
def _jaccard(k: int, least: float) -> str:
    return f"""with {_shingled(k)}, {_OVERLAP},
pairs as (select a, b, shared, shared::double / (p.n + q.n - shared) as jaccard from overlap join sizes p on p.doc_id = a join sizes q on q.doc_id = b),
alike as (select * from pairs where jaccard >= {least} - 1e-12),
sets as (select doc_id, md5(string_agg(s, chr(31) order by s)) as k from vals group by doc_id),
equal as (select doc_id, k, min(doc_id) over (partition by k) as r from sets),
kept as (select s.* from alike s join equal x on x.doc_id = a join equal y on y.doc_id = b where (x.r = a and y.r = b) or (x.r = y.r and a = x.r))
"""


_JACCARD = _jaccard(5, 0.5)


def _coefficients() -> str:
    a, b = coefficients(128)
    return "coef(i, a, b) as (values " + ", ".join(f"({i}, {x}::ubigint, {y}::ubigint)" for i, (x, y) in enumerate(zip(a, b))) + ")"


def _fnv_list(c: str) -> str:
    step = f"((xor(h, x) * {FNV_PRIME}::ubigint) & 4294967295::ubigint)"
    return f"list_reduce(list_transform(string_split({c}, ''), lambda x: ord(x)::ubigint), lambda h, x: {step}, {FNV_OFFSET}::ubigint)"


def _fnv_bytes(c: str) -> str:
    """FNV-1a over the UTF-8 bytes of a text."""
    step = f"((xor(h, x) * {FNV_PRIME}::ubigint) & 4294967295::ubigint)"
    return f"list_reduce(list_transform(string_split_regex(rtrim(regexp_replace(hex(encode({c})), '(..)', '\\1 ', 'g')), ' '), lambda x: ('0x' || x)::ubigint), lambda h, x: {step}, {FNV_OFFSET}::ubigint)"


_SIGNED = f"""{_shingled()}, {_coefficients()},
hashed as (select s, {_fnv_list('s')} as x from (select distinct s from vals)),
sig as (select doc_id, i, min(least((a * x + b) % {MODULUS}::ubigint, 4294967295::ubigint))::bigint as value from vals join hashed using (s) cross join coef group by doc_id, i)"""
_BANDS = """
bands as (select doc_id, i // 4 as band, string_agg(value::varchar, ',' order by i) as k from sig group by doc_id, i // 4),
whole as (select doc_id, md5(string_agg(value::varchar, ',' order by i)) as k from sig group by doc_id),
twins as (select doc_id, min(doc_id) over (partition by k) as r from whole),
lsh as (select distinct x.doc_id as a, y.doc_id as b from bands x join bands y on x.band = y.band and x.k = y.k and x.doc_id < y.doc_id
          where x.doc_id in (select r from twins) and y.doc_id in (select r from twins)
        union select r, doc_id from twins where r <> doc_id)"""
_EXACT_TIES = f"""
hashes as (select doc_id, sha256(text) as sha, sha256({_NORM}) as norm_hash from documents where {_NORM} <> ''),
ties as (select distinct r as a, doc_id as b from (select doc_id, min(doc_id) over (partition by sha) as r from hashes union all select doc_id, min(doc_id) over (partition by norm_hash) from hashes) where r <> doc_id)"""
_EXACT = f"""{_EXACT_TIES},
cand as (select a, b, max(e) = 1 as is_exact from (select a, b, 1 as e from ties union all select a, b, 0 from lsh) group by a, b)"""
_CAND = f"with {_SIGNED}, {_BANDS}, {_EXACT}"

_DOCS = r"""
docs as (select scan_id, doc_id, filename, fileType as file_type, fileSize as file_size, lower(sha256Hash) as sha, lower(normalizedHash) as norm_hash, tokenCount as token_count from (
  select *, row_number() over (partition by scan_id, doc_id order by createdAt desc, filename desc) as rn from (
    select *, nullif(lower(regexp_replace(scanId, '^\s+|\s+$', '', 'g')), '') as scan_id, nullif(lower(regexp_replace(documentId, '^\s+|\s+$', '', 'g')), '') as doc_id from scan_documents)
  where scan_id is not null and doc_id is not null) where rn = 1)"""
_PAIRS = r"""
raw as (select nullif(lower(regexp_replace(scanId, '^\s+|\s+$', '', 'g')), '') as scan_id, nullif(lower(regexp_replace(documentAId, '^\s+|\s+$', '', 'g')), '') as a,
  nullif(lower(regexp_replace(documentBId, '^\s+|\s+$', '', 'g')), '') as b, fileName1 as name_a, fileName2 as name_b, case when similarityScore > 1.001 then similarityScore / 100.0::double else similarityScore end as score,
  coalesce(len(matchingPassages), 0)::bigint as n_passages, coalesce(len(evidence.images), 0)::bigint as n_images, coalesce(len(evidence.code), 0)::bigint as n_code, coalesce(len(evidence.tables), 0)::bigint as n_tables, createdAt from similarity_results),
pairs as (select * exclude (rn, createdAt) from (select *, row_number() over (partition by scan_id, a, b order by createdAt, coalesce(score, -1) desc, coalesce(name_a, ''), coalesce(name_b, ''), n_passages, n_images, n_code, n_tables) as rn
  from raw where scan_id is not null and a is not null and b is not null) where rn = 1),
sides as (select scan_id, score, a as doc_id, b as other_id, name_b as other_name from pairs union all select scan_id, score, b, a, name_a from pairs)"""


def _class(x: str) -> str:
    return f"case when {x} is null then 'No Data' when {x} >= 70 then 'High Similarity' when {x} >= 40 then 'Moderate Similarity' else 'Low Similarity' end"


_STORED = f"with {_DOCS}, {_PAIRS}"
_AVERAGES = f"""{_STORED},
twice as (
  select scan_id, doc_id from docs join (select scan_id, sha from docs where sha <> '' group by 1, 2 having count(*) > 1) using (scan_id, sha)
  union select scan_id, doc_id from docs join (select scan_id, norm_hash from docs where norm_hash <> '' group by 1, 2 having count(*) > 1) using (scan_id, norm_hash)
  union select s.scan_id, s.doc_id from sides s join docs x on x.scan_id = s.scan_id and x.doc_id = s.doc_id join docs y on y.scan_id = s.scan_id and y.doc_id = s.other_id where score >= 0.9999 and s.doc_id <> s.other_id),
stats as (select scan_id, doc_id, sum(score::decimal(18, 8))::double as s, count(*) as n, max(score) as m from sides where score < 0.9999 group by 1, 2),
averages as (select *, {_class("average")} as class from (
  select d.scan_id, d.doc_id, filename, file_type, file_size, t.doc_id is not null as is_duplicate, {_half("s / n * 100", 2)} as average, {_half("m * 100", 2)} as max_similarity, coalesce(n, 0)::bigint as comparisons
  from docs d left join stats using (scan_id, doc_id) left join twice t on t.scan_id = d.scan_id and t.doc_id = d.doc_id))
"""
_PCT = _half("score * 100", 2)
_IS_EXACT = "coalesce(score between 0.9999 and 1.0001 or score between 99.99 and 100.01, false)"
_SUMMARY = f"""{_STORED},
summed as (select *, {_PCT} as percentage, {_IS_EXACT} as is_exact, case when {_IS_EXACT} then 'Exact Duplicate' else {_class(_PCT)} end as class,
  coalesce(nullif(concat_ws(',', case when n_passages > 0 then 'text' end, case when n_images > 0 then 'images' end, case when n_code > 0 then 'code' end, case when n_tables > 0 then 'tables' end), ''), 'text') as kinds from pairs),
ranked as (select *, row_number() over (partition by scan_id order by score desc nulls last, name_a nulls first, name_b nulls first, a, b) as rank, count(*) over (partition by scan_id) as total_rows from summed)
"""

_STOP = _list(STOP_WORDS)
_LONG = "list_filter({t}, lambda x: len(x) > 1)"


def _content(c: str) -> str:
    return f"list_filter({_TOKENS.format(c=c)}, lambda x: len(x) > 1 and x not in ({_STOP}))"


def _cell(c: str) -> str:
    t = rf"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"
    number = f"(floor(abs({t}::double) * 10000 + 0.5) / 10000)"
    tidy = rf"regexp_replace(regexp_replace(printf('%.4f', {number}), '0+$', ''), '\.$', '')"
    return rf"case when regexp_matches({t}, '^[-+]?[0-9]*\.?[0-9]+(e[-+]?[0-9]+)?$') then case when {t}::double < 0 and {tidy} <> '0' then '-' else '' end || {tidy} else {t} end"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["tokenize_stats"] = f"select doc_id, len({_T})::bigint as n_tokens, len(list_distinct({_T}))::bigint as n_distinct from documents"
    sql["text_statistics"] = rf"select doc_id, length(text)::bigint as n_chars, len(string_split_regex(text, '\s+'))::bigint as n_pieces, len({_LONG.format(t=_T)})::bigint as n_long_tokens from documents"
    sql["normalized_hashes"] = f"select doc_id, sha256(text) as sha, sha256({_NORM}) as norm_hash from documents"
    sql["shingle_counts"] = f"""with {_shingled()}, three as (select doc_id, count(distinct w || ' ' || w1 || ' ' || w2) as n from runs where w2 is not null group by doc_id)
select d.doc_id, coalesce(s.n, 0)::bigint as k5, coalesce(t.n, 0)::bigint as k3 from documents d left join sizes s on s.doc_id = d.doc_id left join three t on t.doc_id = d.doc_id"""
    sql["fnv_hashes"] = f"select doc_id, {_fnv_list('filename')}::bigint as fnv from documents where filename is not null"
    sql["html_escaped"] = "select eval_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') as html from eval_items"
    sql["safe_filenames"] = r"select documentId, regexp_replace(filename, '[^a-zA-Z0-9._-]', '_', 'g') as safe, coalesce(nullif(trim(regexp_replace(filename, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')), ''), '--') as shown from scan_documents"
    sql["cell_values"] = f"select p_partkey, name, {_cell('v')} as value from (select p_partkey, 'p_name' as name, p_name as v from part union all select p_partkey, 'p_retailprice', p_retailprice::varchar from part union all select p_partkey, 'p_size', p_size::varchar from part)"
    lines = r"""raw as (select doc_id, string_split_regex(text, '\r\n|\r|\n') as l from documents),
lines as (select * from (select doc_id, unnest(range(1, len(l) + 1))::integer as line_no, unnest(l) as line from raw) where regexp_matches(line, '\S'))"""
    sql["sentence_overlap"] = f"""with {lines}, c as (select doc_id, line_no, {_content('line')} as x from lines),
j as (select * from (select *, lead(x) over (partition by doc_id order by line_no) as y from c) where y is not null),
m as (select *, len(list_filter(x, lambda w: list_contains(y, w))) as matched, len(list_intersect(list_distinct(x), list_distinct(y))) as shared from j)
select doc_id, line_no, case when shared > 0 then least(100.0::double, {_half("(0.35::double * shared / len(list_distinct(list_concat(x, y))) + 0.35::double * shared / least(len(x), len(y)) + 0.30::double * 2 * matched / (len(x) + len(y))) * 100", 1)}) else 0.0::double end as score, shared::bigint as shared from m"""
    known = _list(BOILERPLATE)
    sql["boilerplate_lines"] = rf"""with {lines}, c as (select doc_id, line_no, trim(regexp_replace(lower(trim(line)), '[^a-z0-9\s]', '', 'g')) as clean, {_content('trim(line)')} as w from lines)
select doc_id, line_no, clean in ({known}) or (len(w) <= 2 and array_to_string(w, ' ') in ({known})) or (len(w) <= 3 and len(list_filter(w, lambda x: x not in ({known}))) = 0) as generic from c"""
    sql["minhash_signatures"] = f"""with {_SIGNED} select doc_id, i::bigint as i, value from sig
union all select doc_id, i, 4294967295 from documents cross join range(128) r(i) where doc_id not in (select doc_id from sizes)"""
    sql["fingerprints"] = f"""with {_coefficients()},
src as (select request_id, case when shingles is not null then null when tokens is not null then list_filter(tokens, lambda x: x is not null and x <> '') else {_T} end as t, shingles from fingerprint_requests),
runs as (select request_id, unnest(shingles) as s from src where shingles is not null
  union all select request_id, array_to_string(t[i:i + 4], ' ') from (select request_id, t, unnest(range(1, len(t) - 3)) as i from src where len(t) >= 5)
  union all select request_id, array_to_string(t, ' ') from src where len(t) between 1 and 4),
vals as (select distinct request_id, s from runs where s is not null and s <> ''),
hashed as (select s, {_fnv_bytes('s')} as x from (select distinct s from vals)),
n as (select request_id, count(*) as n from vals group by 1),
sig as (select request_id, i, min(least((a * x + b) % {MODULUS}::ubigint, 4294967295::ubigint))::bigint as v from vals join hashed using (s) cross join coef group by 1, 2)
select r.request_id, coalesce(n.n, 0)::bigint as n_shingles, p.i::bigint as i, coalesce(f.v, 4294967295) as value from fingerprint_requests r cross join range(128) p(i) left join n using (request_id)
left join sig f on f.request_id = r.request_id and f.i = p.i"""
    sql["lsh_candidates"] = f"with {_SIGNED}, {_BANDS} select a, b from lsh"
    sql["candidate_pairs"] = f"{_CAND} select a, b, is_exact from cand"
    reduction = _half("(possible - c) / possible::double * 100", 2)
    sql["candidate_stats"] = f"""{_CAND}, t as (select (select count(*) from documents) as d, (select count(*) from cand) as c, (select count(*) from cand where is_exact) as e), u as (select *, (d * (d - 1) // 2) as possible from t)
select d as documents, possible::bigint as possible_pairs, c as candidate_pairs, e as exact_duplicates, c - e as jaccard_pairs, case when possible > 0 then {reduction} else 0.0::double end as reduction_percent from u"""
    scored = f"""{_CAND}, {_OVERLAP},
sc as (select c.a, c.b, is_exact, coalesce(shared, 0) as shared, coalesce(shared, 0)::double / nullif(coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(shared, 0), 0) as j, coalesce(shared, 0)::double / nullif(least(coalesce(p.n, 0), coalesce(q.n, 0)), 0) as k
  from cand c left join overlap o on o.a = c.a and o.b = c.b left join sizes p on p.doc_id = c.a left join sizes q on q.doc_id = c.b)"""
    sql["containment_pairs"] = f"{scored} select a, b, is_exact, shared, coalesce(j, 0) as jaccard, coalesce(k, 0) as containment from sc"
    sql["text_only_scores"] = f"{scored} select a, b, is_exact, case when is_exact then 1.0::double else {_half('coalesce(j, 0)', 4)} end as score, case when is_exact then 100.0::double else {_half(_half('coalesce(j, 0)', 4) + ' * 100', 2)} end as percentage from sc"
    sql["minhash_estimates"] = f"{_CAND} select c.a, c.b, count(*) filter (x.value = y.value) / 128.0::double as estimate from cand c join sig x on x.doc_id = c.a join sig y on y.doc_id = c.b and y.i = x.i group by 1, 2"
    sql["jaccard_pairs"] = f"{_JACCARD} select a, b, shared, jaccard from kept"
    sql["level1_scores"] = f"""{_jaccard(3, 0.2).rstrip()}, {_EXACT_TIES}, found as (select a, b, max(e) = 1 as is_exact, max(j) as j from (select a, b, 1 as e, 1.0::double as j from ties union all select a, b, 0, jaccard from kept) group by a, b),
t as (select a, b, is_exact, case when is_exact then 1.0::double else {_half('j', 4)} end as score from found) select *, {_half('score * 100', 2)} as percentage from t"""
    sql["ranked_pairs"] = f"""{_JACCARD}, top as (select a, b, jaccard, {_half("jaccard * 100", 2)} as percentage from kept order by jaccard desc, a, b limit 20)
select *, case when jaccard between 0.9999 and 1.0001 then 'Exact Duplicate' else {_class("percentage")} end as class from top"""
    sql["lsh_recall"] = _JACCARD.rstrip() + f""", {_coefficients()}, hashed as (select s, {_fnv_list('s')} as x from (select distinct s from vals)),
sig as (select doc_id, i, min(least((a * x + b) % {MODULUS}::ubigint, 4294967295::ubigint))::bigint as value from vals join hashed using (s) cross join coef group by doc_id, i), {_BANDS}, {_EXACT},
hit as (select count(*) as t, count(c.a) as f from kept k left join cand c on c.a = k.a and c.b = k.b)
select t as true_pairs, f as found_pairs, case when t > 0 then f / t::double else 1.0::double end as recall from hit"""
    sql["candidate_probability_curve"] = "select i / 20.0::double as similarity, 1 - pow(1 - pow(i / 20.0::double, 4), 32) as probability from range(21) r(i)"
    sql["code_detection"] = f"""with c as (select doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '\\b[a-z_][a-z0-9_]*\\b'), lambda w: w in ({_list(CODE_KEYWORDS)}))))::bigint as k,
  {_count(';')} as sc, {_count('[{}' + chr(92) + '[' + chr(92) + ']()]')} as br, {_count('[=+' + chr(92) + '-*/<>!&|]=?')} as op, regexp_matches(text, '\\S') as filled from documents),
p as (select *, (case when k >= 3 then 35 else 0 end + case when k >= 6 then 25 else 0 end + case when sc >= 2 then 15 else 0 end + case when br >= 4 then 15 else 0 end + case when op >= 3 then 10 else 0 end) as s from c)
select doc_id, filled and (s >= 45 or (k >= 4 and br >= 2)) as is_code, case when filled then s else 0 end::integer as confidence, case when filled then k else 0 end as keywords from p"""
    sql["table_similarity"] = f"""with c as (select n_regionkey as r, n_nationkey::varchar as k, lower(n_name[1:1]) as l from nation), n as (select r, count(*) as rows from c group by r),
v as (select r, k as x from c union select r, l from c), s as (select r, count(*) as n from v group by r),
o as (select p.r as a, q.r as b, count(*) filter (p.x = q.x) as shared from v p join v q on p.r < q.r group by 1, 2)
select a, b, {_half("least(1.0, 0.3::double * ((least(x.rows, y.rows)::double / greatest(x.rows, y.rows) + 1) / 2) + 0.7::double * shared / (p.n + q.n - shared))", 4)} as similarity, shared as matching_cells, 0::bigint as matching_rows
from o join s p on p.r = a join s q on q.r = b join n x on x.r = a join n y on y.r = b"""
    close = """c as (select lower(dhash) as h, ('0x' || dhash)::ubigint as v, min(documentId) as doc, count(distinct documentId) as docs from i where regexp_matches(dhash, '^[0-9a-fA-F]{16}$') group by 1, 2),
p as (select x.h as dhash_a, y.h as dhash_b, bit_count(xor(x.v, y.v))::integer as distance from c x join c y on x.h < y.h where x.doc <> y.doc or x.docs > 1 or y.docs > 1)
select *, case when distance <= 0 then 1.0::double when distance >= 32 then 0.0::double else floor((1 - distance / 32.0::double) * 10000 + 0.5) / 10000.0::double end as similarity from p where distance <= 12"""
    sql["image_candidates"] = f"with i as (select dhash, documentId from images), {close}"
    sql["planted_image_candidates"] = f"""with o as (select dhash, documentId, ('0x' || dhash[13:16])::integer as v, [1057, 3891, 4095, 8191][('0x' || dhash[1:1])::integer % 4 + 1] as m from images where regexp_matches(dhash, '^[0-9a-fA-F]{{16}}$')),
i as (select dhash, documentId from o union all select dhash[1:12] || printf('%04x', xor(v, m)), documentId || '-planted' from o), {close}"""
    sql["image_copies"] = """with g as (select lower(sha256) as h, min(imageId) as first_image_id, count(distinct documentId) as documents from images where sha256 is not null and imageId is not null group by 1 having count(distinct documentId) > 1)
select imageId as image_id, first_image_id, documents from images join g on g.h = lower(sha256) where imageId is not null"""
    clean = r"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(ocrText, ''), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    sql["ocr_gating"] = f"select imageId, coalesce(width >= 120 and height >= 40, false) as wanted, length({clean}) > 15 and not contains('', substr({clean}, 1, 30)) as added, length({clean})::bigint as n_chars from images"
    sql["scanned_files"] = r"""with p as (select documentId, count(*) as pages, sum(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')))::bigint as chars from pages where documentId is not null group by 1), i as (select documentId, count(*) as n from images group by 1)
select p.documentId, pages, chars, coalesce(n, 0)::bigint as images, chars / pages::double < 30 and coalesce(n, 0) > 0 as sparse, chars < 50 and coalesce(n, 0) > 0 as scanned from p left join i using (documentId)"""
    sql["latest_documents"] = f"with {_DOCS} select * from docs"
    sql["stored_results"] = f"{_STORED} select * from pairs"
    sql["document_averages"] = f"{_AVERAGES} select * from averages"
    sql["duplicate_files"] = f"{_AVERAGES} select scan_id, doc_id, filename, file_type, coalesce(file_size, 0) as file_size from averages where is_duplicate"
    sql["dashboard_page"] = f"""{_AVERAGES}, r as (select *, row_number() over (partition by scan_id order by average desc nulls last, coalesce(filename, '') collate icu_noaccent, doc_id) as rank, count(*) over (partition by scan_id) as total_rows from averages)
select scan_id, rank::integer as rank, doc_id, filename, average, comparisons, class, total_rows, greatest(1, ceil(total_rows / 24.0))::bigint as total_pages from r where rank <= 24"""
    sql["ranked_results"] = f"{_SUMMARY} select scan_id, rank::integer as rank, a, b, score, percentage, is_exact, class, kinds, total_rows, greatest(1, ceil(total_rows / 20.0))::bigint as total_pages from ranked where rank between 21 and 40"
    sql["report_top_pairs"] = f"{_SUMMARY} select scan_id, rank::integer as rank, a, b, percentage, class from ranked where rank <= 30"
    sql["evidence_summary"] = f"{_SUMMARY} select scan_id, a, b, n_passages, n_images, n_code, n_tables, kinds, percentage, is_exact, class from summed"
    sql["filtered_pairs"] = f"{_STORED} select scan_id, a, b, name_a, name_b, score from pairs where n_passages > 0 and score between 0.4 and 0.95 and (contains(lower(name_a), 'lab') or contains(lower(name_b), 'lab'))"
    sql["score_categories"] = f"{_STORED} select scan_id, count(*) as pairs, count(*) filter (score >= 0.9999) as exact, count(*) filter (score >= 0.7 and score < 0.9999) as high, count(*) filter (score >= 0.4 and score < 0.7) as moderate, count(*) filter (score < 0.4) as low from pairs group by 1"
    sql["report_summary"] = f"{_AVERAGES} select scan_id, count(*) as documents, count(*) filter (is_duplicate) as duplicate_files, count(average) as files_with_similarity, {_half('sum(average::decimal(18, 2))::double / count(average)', 2)} as overall_average, max(average) as highest_average, min(average) as lowest_average from averages group by 1"
    sql["document_similarities"] = f"{_STORED} select s.scan_id, s.doc_id, other_id, other_name, {_PCT} as percentage from sides s join docs d on d.scan_id = s.scan_id and d.doc_id = s.doc_id where score < 0.9999"
    sql["document_view_averages"] = f"""{_STORED}, shown as (select s.scan_id, s.doc_id, {_PCT} as percentage from sides s join docs d on d.scan_id = s.scan_id and d.doc_id = s.doc_id where score < 0.9999)
select scan_id, doc_id, count(*) as comparisons, {_half('sum(percentage::decimal(18, 2))::double / count(*)', 2)} as average from shown where percentage is not null group by 1, 2"""
    sql["pair_lookup"] = f"{_STORED} select scan_id, a, b, score from pairs where a <> b"
    sql["history"] = rf"""{_STORED}, done as (select nullif(lower(regexp_replace(scanId, '^\s+|\s+$', '', 'g')), '') as scan_id, coalesce(completedAt, createdAt) as finished_at from scans where status = 'completed' order by createdAt desc nulls last, scan_id limit 100),
names as (select scan_id, count(*) as n, arg_min(filename, doc_id) as f, arg_max(filename, doc_id) as l from docs group by 1),
best as (select * from (select scan_id, name_a, name_b, score, row_number() over (partition by scan_id order by score desc, a, b) as rn from pairs where score is not null) where rn = 1)
select scan_id, case when n is null then 'No documents' when n > 2 and score is not null then name_a else f end as file_name_1, case when n is null then 'No documents' when n = 1 then 'None (Single Document)' when n > 2 and score is not null then name_b else l end as file_name_2,
coalesce({_PCT}, 0.0::double) as similarity, finished_at from done left join names using (scan_id) left join best using (scan_id)"""
    sql["scan_progress"] = rf"""select nullif(lower(regexp_replace(scanId, '^\s+|\s+$', '', 'g')), '') as scan_id, status, case when status = 'completed' then 100.0::double else {_half("coalesce(completedComparisons, 0)::double / (case when candidatePairs > 0 then candidatePairs when totalPossiblePairs > 0 then totalPossiblePairs else 1 end) * 100", 1)} end as percentage from scans"""
    sql["scan_summary"] = f"""{_STORED}, d as (select scan_id, count(*) as documents from docs group by 1), p as (select scan_id, count(score) as sp, count(*) filter (score >= 0.999) as ex, count(*) filter (score >= 0.8) as hi from pairs group by 1),
j as (select scan_id, documents, coalesce(sp, 0)::bigint as scored_pairs, coalesce(ex, 0)::bigint as exact_pairs, coalesce(hi, 0)::bigint as high_pairs, (documents * (documents - 1) // 2)::bigint as possible_pairs from d left join p using (scan_id))
select *, case when possible_pairs > 0 then {_half("(possible_pairs - scored_pairs) / possible_pairs::double * 100", 2)} else 0.0::double end as reduction_percent from j"""
    sql["recent_scans"] = "select scanId, status, createdAt from scans order by createdAt desc nulls last, scanId limit 50"
    sql["stored_counts"] = "select scanId, count(*) as records, count(distinct documentId) as documents, count(minhashSignature) as signed, count(*) filter (len(minhashSignature) >= 128) as signed_whole from scan_documents where scanId is not null group by 1"
    sql["insert_if_absent"] = """with o as (select distinct scanId, documentAId, documentBId from similarity_results where createdAt < timestamp '2025-07-01')
select n.scanId, n.documentAId, n.documentBId, min(createdAt) as createdAt from similarity_results n where createdAt >= timestamp '2025-07-01'
and not exists (select 1 from o where o.scanId is not distinct from n.scanId and o.documentAId is not distinct from n.documentAId and o.documentBId is not distinct from n.documentBId) group by 1, 2, 3"""
    sql["upload_selection"] = "select filename, fileSize, min(documentId) as documentId, count(*) as uploads from scan_documents group by filename, fileSize, createdAt"
    sql["fused_scores"] = f"""{_STORED}, w as (select p.*, coalesce(x.token_count, 0) as na, coalesce(y.token_count, 0) as nb from pairs p join docs x on x.scan_id = p.scan_id and x.doc_id = p.a join docs y on y.scan_id = p.scan_id and y.doc_id = p.b),
m as (select *, greatest(least(coalesce(score, 0), 1.0::double), 0.0::double) as st, (na + nb) / 2.0::double as mt, n_images * 150.0::double as mi, n_code * 20.0::double as mc, n_tables * 30.0::double as mb,
  case when n_images > 0 then 0.8::double else 0.0::double end as si, case when n_code > 0 then 0.8::double else 0.0::double end as sc, case when n_tables > 0 then 0.8::double else 0.0::double end as sb from w),
e as (select *, case when n_images > n_code and mi > 0 and mc > 0 then mc * 0.5::double else mc end as wc from m),
f as (select *, mt + mi + wc + mb as mass from e),
g as (select *, case when coalesce(score >= 0.99995, false) then 1.0::double when mass <= 0 then greatest(st, si, sc, sb)
  when (mt <= 0 or st >= 0.999) and (mi <= 0 or si >= 0.999) and (wc <= 0 or sc >= 0.999) and (mb <= 0 or sb >= 0.999) then 1.0::double else least(1.0::double, (st * mt + si * mi + sc * wc + sb * mb) / mass) end as raw from f)
select scan_id, a, b, {_half("raw", 4)} as fused, {_half("raw * 100", 2)} as percentage, {_half("raw * 100", 2)} >= 99.99 as is_exact from g"""
    return sql
