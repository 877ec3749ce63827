"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS key
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM sized GROUP BY source),
caps AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight::DOUBLE AS full_at, sum(source_size) OVER ()::BIGINT AS budget FROM named),
levels AS (
  SELECT *, row_number() OVER o AS pos,
         (budget - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS try_level
  FROM caps WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
level AS (SELECT arg_min(try_level, pos) FILTER (WHERE try_level <= full_at) AS v FROM levels),
targets AS (
  SELECT source, source_size, weight, budget, least(cap::DOUBLE, weight * coalesce((SELECT v FROM level), full_at)) AS target FROM levels),
queued AS (
  SELECT s.*, t.source_size, t.weight, t.budget, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT doc_id, source, size, budget, epoch, (epoch * source_size + sent)::DOUBLE / weight::DOUBLE AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM entries),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM cut WHERE upto <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t USING (doc_id)
"""

OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (
  SELECT *, coalesce(role <> lag(role) OVER w, true) AS opens, row_number() OVER w AS pos
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
           + CASE WHEN opens THEN 12 + 1 + length(role) + 11 ELSE 10 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


OP8 = r"""
WITH clean AS (
  SELECT page_id, regexp_replace(regexp_replace(lower(url), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g') AS u FROM pages),
places AS (SELECT page_id, string_split(regexp_extract(u, '^(?:(?:https?|wss?|ftp):[/\\]*|[a-z][a-z0-9+.\-]*:[/\\]{2})([^/?#\\]*)', 1), '@')[-1] AS place FROM clean),
captures AS (
  SELECT page_id, DATE '2024-01-01' + (page_id % 365)::INTEGER AS fetched,
         nullif(rtrim(CASE WHEN place[1] = '[' THEN split_part(place, ']', 1) || ']' ELSE translate(split_part(place, ':', 1), '。．｡', '...') END, '.'), '') AS host
  FROM places),
hosts AS (
  SELECT DISTINCT host, CASE WHEN host[1] = '[' OR regexp_full_match(host, '[0-9]{1,3}(\.[0-9]{1,3}){3}') THEN [host] ELSE string_split(host, '.') END AS labels
  FROM captures WHERE host IS NOT NULL),
cuts AS (SELECT host, labels, unnest(range(0, greatest(len(labels) - 2, 0)::BIGINT + 1)) AS i FROM hosts),
domains AS (SELECT host, i, array_to_string(labels[i + 1:], '.') AS domain, i = greatest(len(labels) - 2, 0) AS top FROM cuts),
numbered AS (
  SELECT host AS domain, ('0x' || substr(md5(host), 1, 7))::BIGINT AS k FROM hosts
  UNION ALL SELECT DISTINCT domain, ('0x' || substr(md5(domain), 1, 7))::BIGINT + 1 FROM domains WHERE top),
listed AS (
  SELECT domain, 'block' AS verdict, DATE '2024-01-01' + (k % 200)::INTEGER AS listed_on FROM numbered WHERE k % 3 = 0
  UNION ALL SELECT domain, 'allow', DATE '2024-01-01' + (k % 200 + 60)::INTEGER FROM numbered WHERE k % 6 = 0
  UNION ALL SELECT domain, 'allow', DATE '2024-01-01' + (k % 100)::INTEGER FROM numbered WHERE k % 5 = 0
  UNION ALL SELECT domain, 'block', DATE '2024-01-01' + (k % 100 + 150)::INTEGER FROM numbered WHERE k % 10 = 0),
daily AS (SELECT domain, listed_on, max(verdict) AS verdict FROM listed GROUP BY ALL),
valid AS (
  SELECT domain, verdict, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS valid_to FROM daily),
matched AS (
  SELECT c.page_id, arg_max(v.domain, length(v.domain)) AS rule, arg_max(v.verdict, length(v.domain)) AS verdict
  FROM captures c JOIN domains d ON c.host = d.host
  JOIN valid v ON v.domain = d.domain AND v.valid_from <= c.fetched AND (v.valid_to IS NULL OR c.fetched < v.valid_to)
  GROUP BY c.page_id)
SELECT page_id, host, fetched::DATE::VARCHAR AS fetched, rule, coalesce(verdict, 'none') AS verdict, coalesce(verdict, 'none') <> 'block' AS kept
FROM captures LEFT JOIN matched USING (page_id)
"""


def _rules() -> str:
    parts = []
    for r in RULES:
        parts += [f"{r.measure} >= {r.low!r}"] * (r.low is not None) + [f"{r.measure} <= {r.high!r}"] * (r.high is not None)
    return " AND ".join(parts)


OP9 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM texts WHERE len(w) >= 3),
counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
repeated AS (
  SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS words FROM counted WHERE n > 1),
covered AS (SELECT doc_id, sum(words)::BIGINT AS n_repeat_words FROM repeated GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars0,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '[#*$%&|<>]+')) AS runs, len(regexp_extract_all(t, '!+')) AS bangs,
         len(regexp_extract_all(t, '\p{{Lu}}')) AS uppers, len(regexp_extract_all(t, '\p{{L}}')) AS letters,
         len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS stops,
         len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS dots,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•‣]'))) AS bullets
  FROM texts LEFT JOIN covered USING (doc_id)),
r AS (
  SELECT *, coalesce(chars0, 0)::BIGINT AS word_chars,
         CASE WHEN n_words > 0 THEN coalesce(chars0, 0) / n_words::DOUBLE ELSE 0 END AS mean_word_length,
         CASE WHEN n_words > 0 THEN runs / n_words::DOUBLE ELSE 0 END AS symbol_word_ratio,
         CASE WHEN n_words > 0 THEN bangs / n_words::DOUBLE ELSE 0 END AS bang_word_ratio,
         CASE WHEN letters > 0 THEN uppers / letters::DOUBLE ELSE 0 END AS upper_letter_ratio,
         CASE WHEN n_words > 0 THEN stops / n_words::DOUBLE ELSE 0 END AS stop_word_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines::DOUBLE ELSE 0 END AS duplicate_line_ratio,
         CASE WHEN n_lines > 0 THEN dots / n_lines::DOUBLE ELSE 0 END AS ellipsis_line_ratio,
         CASE WHEN n_lines > 0 THEN bullets / n_lines::DOUBLE ELSE 0 END AS bullet_line_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rules()} AS kept
FROM r
"""

OP11 = r"""
WITH p AS (
  SELECT page_id, url, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id,
         lower(regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]', '', 'g')) AS u,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 31536000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM p),
parts AS (SELECT *, regexp_extract(u, '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS x FROM g),
keyed AS (SELECT *, regexp_replace(x.host, ':(80|443)?$', '') AS place FROM parts)
SELECT page_id, payload_bytes, payload_digest, captured,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to,
       CASE WHEN x.host = '' THEN u ELSE
         array_to_string(list_reverse(string_split(rtrim(split_part(place, ':', 1), '.'), '.')), ',')
         || CASE WHEN contains(place, ':') THEN ':' || split_part(place, ':', 2) ELSE '' END
         || ')' || coalesce(nullif(x.path, ''), '/') || CASE WHEN len(x.query) > 1 THEN x.query ELSE '' END END AS url_key
FROM keyed
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWERED.format("text")}, '{_TERM}') AS w FROM documents),
sized AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM sized),
asked AS (
  SELECT q, item_id, term, count(*)::BIGINT AS repeats
  FROM (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all({_LOWERED.format("text")}, '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
postings AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings, whole GROUP BY term, nd),
scored AS (
  SELECT q, item_id, r, doc_id,
         sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nl))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""

OP13 = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
words AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({_LOWERED.format("text")}, '{_TERM}'), []) AS w FROM documents),
of_docs AS (SELECT r, word, count(*)::BIGINT AS n FROM (SELECT r, unnest(w) AS word FROM words) GROUP BY ALL),
of_target AS (
  SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all({_LOWERED.format("text")}, '{_TERM}')) AS word FROM benchmark) GROUP BY ALL),
bytes AS (
  SELECT word, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT) AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM of_docs UNION SELECT word FROM of_target))),
bucket AS (
  SELECT word, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM of_docs JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM of_target JOIN bucket USING (word) GROUP BY bucket),
whole AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), whole),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM of_docs JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, r, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN place END::BIGINT AS rank
FROM scored LEFT JOIN drawn USING (r)
"""

ORACLES = {"op4_mix_sources": OP4, "op7_chat_format": OP7, "op8_url_filter": OP8, "op9_quality_rules": OP9, "op11_warc": OP11, "op12_lexical_search": OP12, "op13_resample": OP13}
