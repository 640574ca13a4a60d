"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lemmata.llm.quality import LIMITS, LINE_LIMIT

_SAID = "</s>[INST] ok [/INST]"
_WORD = r"[^\x20\x09-\x0D]+"

_OP2 = """
with s as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as x, max(page_id) over (partition by coalesce(html, '')) as m from pages)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31))::int, 1)), '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type, case when page_id <> m then m end as refers_to from s"""

_OP3 = rf"""
with c as (select conv_id, turn, 0 as part, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from (values (-1, 0, 0, 'user', '{_SAID}'), (-1, 0, 1, 'assistant', '{_SAID}')) v(a, b, c, d, e))
select conv_id::bigint as conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, part, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, part, role, text), '')) as loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '\\|\[/?(?:INST|SYS|OUT|ROLE)|</s>')) + case role when 'user' then 15 when 'system' then 13 when 'assistant' then 11 end)::bigint as formatted_chars from c group by conv_id"""


def _op7() -> str:
    lengths = ", ".join(f"({n})" for n in (3, *LIMITS))
    chars = {n: f"coalesce(sum(chars) filter (n = {n}), 0)::bigint" for n in LIMITS}
    dup = ", ".join(f"{c} as dup_{n}gram_chars" for n, c in chars.items())
    fits = " and ".join(f"100 * dup_{n}gram_chars <= {most} * word_chars" for n, most in LIMITS.items())
    return rf"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
u as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from w),
la as (select doc_id, length(line) as n, row_number() over (partition by doc_id, line order by k) > 1 as again from l where regexp_matches(line, '{_WORD}')),
ls as (select doc_id, count(*) filter (again) as n_dup_lines, coalesce(sum(n) filter (again), 0) as dup_line_chars, sum(n) as line_chars from la group by doc_id),
g as (select doc_id, n, i, md5(array_to_string(ws[i:i + n - 1], ' ')) as gram from w, (values {lengths}) v(n), unnest(range(1, greatest(len(ws) - n + 2, 1))) r(i)),
c as (select distinct doc_id, n, i + o as i from (select *, count(*) over (partition by doc_id, n, gram) as k from g) x, unnest(range(0, n)) r(o) where k > 1),
x as (select doc_id, n, count(*) as words, sum(length(word)) as chars from c join u using (doc_id, i) group by all),
y as (select doc_id, coalesce(sum(words) filter (n = 3), 0)::bigint as n_repeat_words, {dup} from x group by doc_id),
z as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  coalesce(dup_line_chars, 0)::bigint as dup_line_chars, coalesce(line_chars, 0) as line_chars, {", ".join(f"coalesce(dup_{n}gram_chars, 0)::bigint as dup_{n}gram_chars" for n in LIMITS)} from w left join ls using (doc_id) left join y using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from z)
select * exclude (line_chars), not base_failed and 100 * dup_line_chars <= {LINE_LIMIT} * line_chars and {fits} as kept from b"""


#: Connected by recursion over pairs that share a shingle; for small tables.
_OP1 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
s as (select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) as g from w, unnest(range(1, greatest(len(ws) - 3, 2))) r(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
k as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
e as (select a, b from k union select b, a from k), r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce((select min(r.b) from r where r.a = w.doc_id), w.doc_id)) as component_id from w left join n using (doc_id)"""

#: CRC-32 from its table of 256 registers; ``tab`` is that table.
_CRC_TABLE = "select list_transform(range(256), lambda b: list_reduce(range(8), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, b)) as tab"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (1 + 2 * i)::int, 2))::bigint), lambda v, x: xor(tab[((xor(v, x) & 255) + 1)::int], v >> 8), 4294967295), 4294967295)"


#: Runs are islands of equal words at one distance.
_OP11 = rf"""
with tab as ({_CRC_TABLE}),
w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws, {_crc("doc_id::varchar")} as h from documents, tab),
l as (select doc_id, ws, len(ws) as n, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a, (h // 10) % 8 as g from w),
x as (select doc_id, generate_subscripts(ws, 1) - 1 as i, unnest(list_transform(range(n), lambda i: ws[(1 + case when i >= a then a + (i - a) % (1 + (n - a) // (3 + g)) else i end)::int])) as word, n from l where n > 0),
p as (select x.doc_id, y.i - x.i as d, x.i as i from x join x y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
s as (select doc_id, d, min(i) as start, count(*) + d as length from (select *, i - row_number() over (partition by doc_id, d order by i) as island from p) group by doc_id, d, island having count(*) + d >= greatest(24, 3 * d)),
r as (select doc_id, start, length, min(d) as period from s group by doc_id, start, length),
b as (select doc_id, count(*) as n_runs, arg_min(struct_pack(start, length, period), (-length::double / period, start, period)) as best, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as runs_sha256 from r group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
k as (select doc_id, sha256(string_agg(word, ' ' order by i)) as collapsed_sha256 from x anti join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period, (1000 * best.length // best.period)::bigint as exponent_milli,
  coalesce(runs_sha256, sha256('')) as runs_sha256, coalesce(collapsed_sha256, sha256('')) as collapsed_sha256 from documents left join b using (doc_id) left join k using (doc_id)"""

_OP13 = rf"""
with tab as ({_CRC_TABLE}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws, 0 as target from documents
  union all select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1 from benchmark),
f as (select target, doc_id, unnest(ws || list_transform(range(greatest(len(ws) - 1, 0)), lambda i: ws[(i + 1)::int] || ' ' || ws[(i + 2)::int])) as gram from d),
c as (select target, doc_id, gram, count(*) as k from f group by all),
h as (select gram, {_crc("gram")} % 10000 as bucket from (select distinct gram from c), tab),
n as (select bucket, sum(k) filter (target = 0) as s, sum(k) filter (target = 1) as t from c join h using (gram) group by bucket),
a as (select coalesce(sum(s), 0) as big_s, coalesce(sum(t), 0) as big_t from n),
g as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (big_s + 10000)) / ((coalesce(s, 0) + 1)::double * (big_t + 10000))))::bigint as gain from n, a),
w as (select doc_id, sum(k * gain)::bigint as total, sum(k)::bigint as n_features from c join h using (gram) join g using (bucket) where target = 0 group by doc_id),
z as (select d.doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(floor(total::double / n_features), 0)::bigint as weight, ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::bigint as h from d left join w using (doc_id) where target = 0),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from z),
q as (select doc_id, row_number() over (order by score desc, doc_id) as rank from y where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= (select count(*) from q) * 25 // 100 then rank end as rank from y left join q using (doc_id)"""

ORACLES: dict[str, str] = {"op1_ngram_join": _OP1, "op2_warc": _OP2, "op3_chat": _OP3, "op7_quality": _op7(), "op11_runs": _OP11, "op13_resampling": _OP13}
