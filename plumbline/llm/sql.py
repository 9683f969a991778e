"""DuckDB SQL for the operators that SQL can express: decontamination, WARC derivatives, collocations and lexical search."""

from __future__ import annotations

from .decontaminate import SIMILARITY
from .warc import EPOCH, LANG, NAMED, REFERENCE, TAG

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

# Every diagonal with a word in common is counted, without seeds.
OP2 = f"""
with d as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from (select doc_id, {WORDS.format('text')} as w from documents where text is not null)),
b as (select item_id, len(w) as n_words, unnest(w) as word, unnest(range(0, len(w))) as pos from (select item_id, {WORDS.format('text')} as w from benchmark where item_id is not null)),
same as (select doc_id, item_id, n_words, d.pos - b.pos as diag, count(*) as n from d join b using (word) group by all),
best as (select doc_id, item_id, n_words, max(n) as n from same group by all)
select doc_id, item_id, n as n_matched, cast(n_words as bigint) as n_words, n::double / n_words as overlap from best where n::double / n_words >= {SIMILARITY}
"""


def _urn(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _unescaped(t: str) -> str:
    named = "map {" + ", ".join(f"'{k}': {v}" for k, v in sorted(NAMED.items())) + "}"
    ref = f"regexp_extract(p, {_quoted(REFERENCE)}, 1)"
    code = f"case when {ref} ilike '#x%' then ('0x' || substr({ref}, 3))::int when {ref} like '#%' then substr({ref}, 2)::int else {named}[{ref}] end"
    char = f"case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr({code}) || substr(p, length({ref}) + 2) end"
    return f"replace(array_to_string(list_transform(string_split({t}, '&'), lambda p, i: case when i = 1 then p when {ref} = '' then '&' || p else coalesce({char}, '&' || p) end), ''), chr(160), ' ')"


def _text(html: str) -> str:
    t = f"regexp_replace({html}, '(?s)<!--.*?(?:-->|\\z)', ' ', 'g')"
    for tag in ("script", "style", "noscript", "template"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?(?:</{tag}[ \\t\\r\\n\\f]*>|\\z)', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<(?:br|hr|/p|/div|/li|/tr|/table|/ul|/ol|/h[1-6]|/title|/section|/article|/nav|/footer|/header)\\b[^>]*>', chr(10), 'g')"
    t = _unescaped(f"regexp_replace({t}, '{TAG}', '', 'g')")
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n+', chr(10), 'g')"
    return f"regexp_replace({t}, '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"


_CRLF = "chr(13) || chr(10)"
OP4 = f"""
with r as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload from pages),
s as (select *, {_urn("'response'", "coalesce(page_id::varchar, '')", 'target_uri', f"'{EPOCH}'", "'sha256:' || sha256(payload)")} as refers_to,
  'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || octet_length(encode(payload)) as source_headers,
  'sha256:' || sha256(payload) as source_digest, {_text('payload')} as body from r),
m as (select *, 'title: ' || trim(regexp_replace({_unescaped("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)")}, '[ \\t\\r\\n\\f]+', ' ', 'g')) || {_CRLF}
  || 'lang: ' || lower(regexp_extract(payload, {_quoted(LANG)}, 1)) || {_CRLF}
  || 'links: ' || len(regexp_extract_all(payload, '(?i)<a[ \\t\\r\\n\\f][^>]*href')) || {_CRLF}
  || 'scripts: ' || len(regexp_extract_all(payload, '(?i)<script\\b')) || {_CRLF}
  || 'text-bytes: ' || octet_length(encode(body)) || {_CRLF}
  || 'source-digest: ' || source_digest || {_CRLF}
  || 'source-headers: ' || replace(source_headers, {_CRLF}, ' | ') || {_CRLF} as fields from s),
u as (select *, 'metadata' as record_type, 'application/warc-fields' as content_type, fields as block from m
  union all select *, 'conversion', 'text/plain; charset=utf-8', body from m)
select page_id, record_type, {_urn('record_type', 'refers_to')} as record_id, refers_to, target_uri, '{EPOCH}' as date, content_type, source_headers, source_digest,
  'sha256:' || sha256(block) as block_digest, octet_length(encode(block)) as block_length, block from u
"""

# All phrases are counted, without sketch or automaton.
OP11 = r"""
with p as (select row_number() over () as pid, coalesce(lang, 'und') as lang, piece from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
s as (select pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
w as (select pid, lang, unnest(ws) as word, generate_subscripts(ws, 1) as pos from s),
n as (select lang, count(*) as n from w group by lang),
t as (select *, lead(word) over o as w2, lead(word, 2) over o as w3 from w window o as (partition by pid order by pos)),
g as (select lang, 1 as k, word as phrase from t union all select lang, 2, word || ' ' || w2 from t where w2 is not null
  union all select lang, 3, word || ' ' || w2 || ' ' || w3 from t where w3 is not null),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 10),
cuts as (select c.lang, c.phrase, c.k, c.a, j, string_split(c.phrase, ' ') as ws from f c, range(1, 3) u(j) where c.k > 1 and j < c.k),
scored as (select c.lang, c.phrase, c.k, c.a, j, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as score from cuts c
  join f x on x.lang = c.lang and x.phrase = array_to_string(ws[1:j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(ws[j + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
held as (select lang, phrase, max(a) as over from (select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from cuts where k = 3) group by all),
kept as (select best.* from best left join held using (lang, phrase) where k = 3 or over is null or 100 * over < 50 * best.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000
"""

OP13 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
b as (select item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
c as (select count(*) as nd, sum(len(ts))::bigint as lt from d where len(ts) > 0),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(ts) as n, unnest(ts) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by term, nd),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // lt)))))::bigint as score from b join w using (term) join p using (term), c group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""

ORACLES = {"op2_decontaminate": OP2, "op4_warc": OP4, "op11_collocations": OP11, "op13_lexical": OP13}
