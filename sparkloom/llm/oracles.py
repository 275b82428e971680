"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from sparkloom.llm.licenses import PHRASES, TEMPLATES, measures

#: Lower-cased A-Z and words, as in operators 7 and 10.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {SPACED} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, (SELECT unnest(range(8)) AS j) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, w.source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
    FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_chars > 12 * n_words OR word_chars < 2 * n_words AS misshapen,
    greatest(10::DOUBLE * n_symbols / greatest(n_words, 1), 2.5::DOUBLE * n_dup_lines / greatest(n_lines, 1), 2.5::DOUBLE * n_capitals / greatest(word_chars, 1), 10::DOUBLE * n_repeat_words / (3::DOUBLE * greatest(n_words, 1))) AS burden FROM m),
hosts AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR misshapen OR burden > 1) AS failures FROM f GROUP BY 1),
p AS (SELECT avg(failures / docs) AS m, coalesce(var_samp(failures / docs), 0) AS v, avg(1 / docs) AS inverse FROM hosts),
prior AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inverse, 1e-9) - 1, 1), 10000) AS strength FROM p),
rates AS (SELECT source, (failures + m * strength) / (docs + strength) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT misshapen AND burden <= greatest(0.5, 1 - host_rate) AS kept, round(host_rate, 6) AS host_rate
FROM f LEFT JOIN rates ON f.source IS NOT DISTINCT FROM rates.source"""

OP6 = r"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT AS formatted_chars FROM rows GROUP BY 1)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM whole"""

OP7 = f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM wins), docs AS (SELECT doc_id, {WORDS} AS ws FROM documents),
places AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, sizes WHERE len(ws) >= m)),
hits AS (SELECT doc_id, i, wins.m, item FROM places JOIN wins USING (m, win)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(m)) AS j FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY 1)
SELECT docs.doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (doc_id) LEFT JOIN named t USING (doc_id)"""

_PHRASES = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', {known}, {len(known)}, {need}, {span})" for label, t in TEMPLATES.items() for known, need, span in [measures(t, 0.9)])
OP10 = rf"""WITH docs AS (SELECT doc_id, {WORDS} AS ws FROM documents), phrases(phrase, m, label) AS (VALUES {_PHRASES}),
places AS (SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, ws, phrase, m, label, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, phrases WHERE len(ws) >= m) WHERE array_to_string(ws[i:i + m - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS names FROM places GROUP BY 1),
templates(label, words, size, need, span) AS (VALUES {_TEMPLATES}), known AS (SELECT label, size, need, span, unnest(words) AS w FROM templates),
tokens AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
places10 AS (SELECT doc_id, label, i, w, size, need, span FROM tokens JOIN known USING (w)),
enough AS (SELECT doc_id, label FROM places10 GROUP BY 1, 2 HAVING count(DISTINCT w) >= max(need)),
near10 AS (SELECT p.* FROM places10 p JOIN enough USING (doc_id, label)),
blocks AS (SELECT a.doc_id, a.label, a.i, max(a.size) AS size, count(DISTINCT b.w) AS n FROM near10 a JOIN near10 b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i >= a.i AND b.i < a.i + a.span GROUP BY 1, 2, 3 HAVING count(DISTINCT b.w) >= max(a.need)),
found AS (SELECT doc_id, list_distinct(list(label)) AS names, max(n / size) AS containment FROM blocks GROUP BY 1)
SELECT docs.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.names), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(found.names, [])))), ','), '') AS labels,
    round(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(containment, 0) END, 6)::DOUBLE AS score FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP12 = """WITH sized AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
placed AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM sized)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, true AS intact FROM placed"""

SQL = {"op3_quality_rules": OP3, "op6_chat_formatting": OP6, "op7_benchmark_decontamination": OP7, "op10_license_scan": OP10, "op12_warc": OP12}
