"""The results of the queries in SQL."""

from __future__ import annotations

from ..functions.scalars import VERHOEFF_D, VERHOEFF_P
from ..operators.pii import CARD_WORDS
from ..operators.scoring import WEIGHTS

# The patterns of the detectors again, in the other engine's syntax.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_S = "[\\s ﻿]"
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "credit-card": r"\b(?:[0-9][ -]?){13,19}\b",
    "aadhaar": rf"\b[0-9]{{4}}(?:{_S}|-)?[0-9]{{4}}(?:{_S}|-)?[0-9]{{4}}\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "phone": rf"(?:\+?[0-9]{{1,3}}(?:{_S}|-)?)?(?:\([0-9]{{2,5}}\)(?:{_S}|-)?)?(?:[0-9]{{4}}(?:{_S}|-)[0-9]{{3}}(?:{_S}|-)[0-9]{{3}}|[0-9]{{3}}(?:{_S}|-)[0-9]{{3}}(?:{_S}|-)[0-9]{{4}}|[0-9]{{5}}(?:{_S}|-)[0-9]{{5}})",
    "ip-address": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
}


def _found(kind: str, source: str = "documents") -> str:
    """doc_id, type, value, start0, text of one pattern's matches; offsets from the gaps."""
    p = _PATTERNS[kind].replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS type, v[i] AS value, text,
      (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::INT AS s
    FROM (SELECT doc_id, text, v, g, unnest(range(1, len(v) + 1)) AS i
          FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS v, regexp_split_to_array(text, '{p}') AS g FROM {source} WHERE text IS NOT NULL))"""


def _matrix(rows: tuple) -> str:
    return "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in rows) + "]"


_FOUND = "\n  UNION ALL ".join(_found(k) for k in _PATTERNS)
_PII = rf"""
found AS ({_FOUND}),
digits AS (
  SELECT *, regexp_replace(value, '[\s-]', '', 'g') AS plain, regexp_replace(value, '[^0-9]', '', 'g') AS numbers,
         lower(substr(text, greatest(s - 23, 1), least(s, 24))) AS before FROM found),
checked AS (
  SELECT *, CASE WHEN regexp_full_match(plain, '[0-9]{{13,19}}') THEN
      list_sum(list_transform(range(0, length(plain)), lambda i: CASE WHEN i % 2 = 1
        THEN CASE WHEN 2 * plain[length(plain) - i]::INT > 9 THEN 2 * plain[length(plain) - i]::INT - 9 ELSE 2 * plain[length(plain) - i]::INT END
        ELSE plain[length(plain) - i]::INT END)) % 10 = 0 ELSE false END AS luhn,
    CASE WHEN type = 'aadhaar' THEN list_reduce(list_concat([0], range(0, 12)::INT[]), lambda c, i:
      {_matrix(VERHOEFF_D)}[c + 1][{_matrix(VERHOEFF_P)}[i % 8 + 1][plain[12 - i]::INT + 1] + 1]) = 0 ELSE false END AS verhoeff
  FROM digits),
pii AS (
  SELECT doc_id, type, CASE WHEN type IN ('credit-card', 'aadhaar', 'phone') THEN trim(value) ELSE value END AS value, s AS start, (s + length(value))::INT AS "end", text FROM checked
  WHERE CASE type WHEN 'credit-card' THEN luhn OR (regexp_matches(before, '{CARD_WORDS}') AND length(numbers) >= 13)
                  WHEN 'aadhaar' THEN verhoeff
                  WHEN 'phone' THEN length(numbers) BETWEEN 10 AND 13 AND NOT regexp_matches(numbers, '^(?:19|20)[0-9]{{2}}')
                  ELSE true END)"""

_TURNS = "(SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"
_LIST = r"^\s*(?:([0-9]+)[.)]|([•●▪◦*-]))\s+(.+)$"


def _privacy() -> str:
    flags = list(WEIGHTS)
    terms = [f"CASE WHEN doc_id % {k + 2} = 0 THEN {WEIGHTS[n]} ELSE 0 END" for k, n in enumerate(flags) if n not in ("gps", "exif")]
    counts = [f"CASE WHEN doc_id % {k + 2} = 0 THEN 1 ELSE 0 END" for k, n in enumerate(flags) if n not in ("gps", "exif")]
    gps, exif = flags.index("gps") + 2, flags.index("exif") + 2
    terms += ["CASE WHEN n_chars % 9 > 0 THEN least(12, 6 + n_chars % 9) ELSE 0 END", "least(8, n_chars % 12)", f"CASE WHEN doc_id % {gps} = 0 THEN 20 WHEN doc_id % {exif} = 0 THEN 2 ELSE 0 END"]
    counts += ["CASE WHEN n_chars % 9 > 0 THEN 1 ELSE 0 END", "CASE WHEN n_chars % 12 > 0 THEN 1 ELSE 0 END", f"CASE WHEN doc_id % {gps} = 0 OR doc_id % {exif} = 0 THEN 1 ELSE 0 END"]
    return f"SELECT doc_id, ({' + '.join(counts)})::BIGINT AS n_findings, greatest(0, 100 - ({' + '.join(terms)}))::BIGINT AS score FROM documents"


ORACLES = {
    "catalog_search": """
WITH t AS (SELECT p_partkey AS id, p_name AS name, lower(concat_ws(' ', p_name, p_partkey, 'part', 'catalog')) AS hay FROM part)
SELECT id, name FROM t WHERE contains(hay, '1') AND contains(hay, 'part')""",
    "csv_blocks": """
SELECT c_custkey // 100 AS doc_id, 0 AS block, count(*)::INT AS n_rows, sha256(string_agg(c_custkey || '|' || c_name || '|' || c_acctbal, chr(10) ORDER BY c_custkey || '|' || c_name || '|' || c_acctbal)) AS sha256 FROM customer GROUP BY 1""",
    "layout_tables": """
WITH c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
SELECT doc_id, 'table-p1-1' AS table_id, n::INT AS n_rows, 4 AS n_columns, round(0.4 + 0.2 + least(1.0::DOUBLE, n / 5.0::DOUBLE) * 0.04 + 0.2 + 0.16, 6) AS confidence FROM c""",
    "paginated_lines": r"""
WITH RECURSIVE src AS (
  SELECT doc_id, i, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM documents))),
words AS (SELECT doc_id, i, trim(line) = '' AS blank, regexp_split_to_array(line, '\s+') AS w FROM src),
fill AS (
  SELECT doc_id, i, w, 1 AS k, CASE WHEN blank THEN 0 ELSE length(w[1]) END AS now, 1 AS row, CASE WHEN blank THEN 1 ELSE len(w) END AS n FROM words
  UNION ALL
  SELECT doc_id, i, w, k + 1, CASE WHEN now > 0 AND now + 1 + length(w[k + 1]) > 80 THEN length(w[k + 1]) WHEN now = 0 THEN length(w[k + 1]) ELSE now + 1 + length(w[k + 1]) END,
         CASE WHEN now > 0 AND now + 1 + length(w[k + 1]) > 80 THEN row + 1 ELSE row END, n FROM fill WHERE k < n),
rows AS (SELECT doc_id, i, row, max(now) AS len FROM fill GROUP BY 1, 2, 3),
placed AS (SELECT doc_id, len, (row_number() OVER (PARTITION BY doc_id ORDER BY i, row) - 1) // 50 + 1 AS page FROM rows)
SELECT doc_id, page::INT AS page, count(*) AS n_lines, max(len)::INT AS longest FROM placed GROUP BY 1, 2""",
    "pii_matches": f'WITH {_PII} SELECT doc_id, type, value, start, "end" FROM pii',
    "pii_by_type": f"WITH {_PII} SELECT type, count(*) AS matches, count(DISTINCT doc_id) AS documents FROM pii GROUP BY type",
    "redacted_documents": f"""
WITH {_PII},
chars AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, text FROM documents WHERE doc_id IN (SELECT doc_id FROM pii)),
masked AS (
  SELECT c.doc_id, c.i, CASE WHEN EXISTS (SELECT 1 FROM pii p WHERE p.doc_id = c.doc_id AND c.i > p.start AND c.i <= p."end") THEN '█' END AS m, c.text[c.i] AS ch FROM chars c),
done AS (SELECT doc_id, count(m) AS n, sha256(string_agg(coalesce(m, ch), '' ORDER BY i)) AS h FROM masked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::INT AS n_masked, coalesce(h, sha256(text)) AS sha256 FROM documents d LEFT JOIN done USING (doc_id)""",
    "redaction_leftovers": rf"""
WITH {_PII},
words AS (SELECT string_split(text, ' ') AS w FROM benchmark),
terms AS (SELECT DISTINCT trim(array_to_string(w[i : i + 2], ' ')) AS term FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
needles AS (SELECT term, lower(regexp_replace(term, '\s+', '', 'g')) AS needle FROM terms WHERE length(term) >= 3),
chars AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, text FROM documents WHERE doc_id IN (SELECT doc_id FROM pii)),
masked AS (
  SELECT c.doc_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM pii p WHERE p.doc_id = c.doc_id AND c.i > p.start AND c.i <= p."end") THEN '█' ELSE c.text[c.i] END, '' ORDER BY c.i) AS t FROM chars c GROUP BY 1),
hays AS (SELECT lower(regexp_replace(coalesce(t, text), '\s+', '', 'g')) AS hay FROM documents LEFT JOIN masked USING (doc_id))
SELECT term FROM needles WHERE EXISTS (SELECT 1 FROM hays WHERE contains(hay, needle))""",
    "search_marks": r"""
SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * 14)::INT AS start,
       (list_sum(list_transform(g[1:i], lambda x: length(x))) + i * 14)::INT AS "end", v[i] AS value
FROM (SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '(?i)licensed under') AS v, regexp_split_to_array(text, '(?i)licensed under') AS g FROM documents))""",
    "doc_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "size_bucket_counts": """
SELECT CASE WHEN n < 1048576 THEN '<1MB' WHEN n < 10485760 THEN '1-10MB' WHEN n < 52428800 THEN '10-50MB' WHEN n < 104857600 THEN '50-100MB' ELSE '>100MB' END AS bucket,
       count(*) AS documents, sum(n)::BIGINT AS bytes FROM (SELECT strlen(text) * 1000 AS n FROM documents) GROUP BY 1""",
    "duration_buckets": """
SELECT CASE WHEN ms < 1000 THEN '<1s' WHEN ms < 5000 THEN '1-5s' WHEN ms < 15000 THEN '5-15s' WHEN ms < 60000 THEN '15-60s' ELSE '>60s' END AS bucket,
       event_type, count(*) AS events FROM (SELECT value * 100 AS ms, event_type FROM events) GROUP BY 1, 2""",
    "page_count_buckets": f"""
SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 10 THEN '2-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' ELSE '>200' END AS bucket, count(*) AS documents FROM {_TURNS} GROUP BY 1""",
    "formatted_sizes": """
SELECT doc_id, CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size
FROM (SELECT doc_id, strlen(text) AS n FROM documents)""",
    "every_n_segments": f"""
SELECT conv_id, (i // 3)::INT AS segment, (i + 1)::INT AS start, least(i + 3, n)::INT AS "end" FROM (SELECT conv_id, n, unnest(range(0, n, 3)) AS i FROM {_TURNS})""",
    "turn_runs": """
SELECT conv_id, min(turn) AS start, max(turn) AS "end", count(*) AS length FROM (
  SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'user'))
GROUP BY conv_id, island""",
    "page_labels": """
SELECT conv_id AS doc_id, turn + 1 AS page, n::INT AS n, total, n || ' / ' || total AS label FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE turn > 0)""",
    "page_ranges": """
WITH x AS (SELECT doc_id, doc_id % 7 + 1 AS a, doc_id % 11 + 1 AS b, doc_id % 23 + 1 AS c FROM documents),
y AS (SELECT doc_id, c, a > b AS turned, c > 20 AS bad, range(least(a, b), greatest(a, b) + 1) AS r FROM x)
SELECT doc_id, CASE WHEN NOT bad THEN array_to_string(CASE WHEN list_contains(r, c) THEN r ELSE list_append(r, c) END, ',') END AS pages,
       CASE WHEN NOT bad THEN 2 END AS n_segments, CASE WHEN NOT bad THEN turned::INT END AS n_warnings,
       CASE WHEN bad THEN 'page range out of bounds' END AS error FROM y""",
    "arranged_pages": """
WITH t AS (SELECT DISTINCT conv_id AS doc_id, turn AS page FROM conversations)
SELECT doc_id, -page AS out_idx, page, (270 + page * 90) % 360 AS rotation FROM t UNION ALL SELECT doc_id, 1, page, 270 FROM t WHERE page = 0""",
    "merged_pages": """
WITH t AS (SELECT DISTINCT conv_id AS file, turn + 1 AS page FROM conversations), n AS (SELECT file, max(page) AS n FROM t GROUP BY file),
o AS (SELECT file, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT file, page, (before + page)::BIGINT AS out_page FROM t JOIN o USING (file)""",
    "ocr_gate": r"""SELECT lang, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) < 40 AS ocr, count(*) AS documents FROM documents GROUP BY 1, 2""",
    "privacy_scores": _privacy(),
    "preflight_classes": """
WITH f AS (SELECT doc_id, n_chars * 20000 AS b, doc_id % 40 + 1 AS p, doc_id % 50 AS i, doc_id % 3 = 0 AS o FROM documents),
c AS (SELECT *, CASE WHEN i >= greatest(1, p) THEN 'image-heavy' WHEN i > 0 THEN 'mixed' ELSE 'text' END AS content, b / greatest(p, 1)::DOUBLE AS a FROM f)
SELECT doc_id, content,
  CASE WHEN o AND a < 307200 THEN 'low' WHEN content = 'image-heavy' OR a > 768000 THEN 'high' WHEN i > 0 OR a > 204800 THEN 'moderate' ELSE 'low' END AS compressibility,
  CASE WHEN 4 * b + 67108864 > 629145600 THEN 'high' WHEN 4 * b + 67108864 > 262144000 THEN 'moderate' ELSE 'low' END AS memory_risk,
  CASE WHEN p + b / 2097152.0 > 120 THEN 'long' WHEN p + b / 2097152.0 > 25 THEN 'moderate' ELSE 'short' END AS time_class FROM c""",
    "target_profiles": """
SELECT doc_id, CASE WHEN 1e6 / ((n_chars + 1) * 1000.0) >= 0.65 THEN 'light,medium,heavy,retry-1' WHEN 1e6 / ((n_chars + 1) * 1000.0) >= 0.3 THEN 'medium,heavy,retry-1,retry-2' ELSE 'heavy,retry-1,retry-2' END AS profiles
FROM documents""",
    "best_attempts": """
SELECT doc_id, attempt, out_bytes, greatest(0, 50000 - out_bytes) AS saved, floor(greatest(0, 50000 - out_bytes) / 50000.0::DOUBLE * 1000 + 0.5) / 10 AS percent,
       out_bytes < 50000 AS beneficial, out_bytes <= 20000 AS target_reached
FROM (SELECT l_orderkey AS doc_id, l_linenumber AS attempt, floor(l_extendedprice)::BIGINT AS out_bytes,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice)::BIGINT, l_linenumber) AS place FROM lineitem) WHERE place = 1""",
    "event_allowlist": """
WITH k AS (SELECT event_id, list_sort(list_append(json_keys(props), 'fileName')) AS others, event_id % 130 <= 64 AS short FROM events)
SELECT event_id, CASE WHEN short THEN 'errorCode,toolId' ELSE 'toolId' END AS kept,
       array_to_string(list_sort(CASE WHEN short THEN others ELSE list_append(others, 'errorCode') END), ',') AS dropped FROM k""",
    "recent_history": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "recent_by_user": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3",
    "text_ebooks": r"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS block, t AS text FROM (
  SELECT doc_id, i, trim(p[i], ' ') AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n') AS p FROM documents))) WHERE t <> ''""",
    "html_titles": r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""",
    "html_links": r"""
WITH h AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), lambda x: trim(x)) AS l FROM pages)
SELECT page_id, (i - 1)::INT AS n, l[i] AS href, regexp_matches(l[i], '(?i)^(?:https?:|mailto:)') AS safe FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM h)""",
    "repeated_lines": r"""
WITH g AS (SELECT doc_id, concat_ws('/', source, substr(md5(string_split(text, chr(10))[1]), 1, 2)) AS "group", text FROM documents),
n AS (SELECT "group", count(*) AS n FROM g GROUP BY 1),
l AS (SELECT DISTINCT "group", doc_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS norm
      FROM (SELECT "group", doc_id, unnest(string_split(text, chr(10))) AS line FROM g)),
k AS (SELECT "group", norm, count(*) AS n_docs FROM l WHERE length(norm) >= 2 GROUP BY 1, 2)
SELECT "group", norm, n_docs FROM k JOIN n USING ("group") WHERE n >= 2 AND n_docs >= greatest(2, ceil(n * 0.6))""",
    "text_blocks": rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents)),
k AS (SELECT doc_id, i, a[i] AS t, CASE WHEN trim(a[i]) = '' THEN 'blank' WHEN regexp_matches(a[i], '{_LIST}') AND regexp_extract(a[i], '{_LIST}', 1) <> '' THEN 'ordered'
             WHEN regexp_matches(a[i], '{_LIST}') THEN 'bullets' ELSE 'paragraph' END AS kind FROM l),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT *, (kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i), 'blank'))::INT AS new FROM k)),
b AS (SELECT doc_id, island, kind, count(*)::INT AS n_lines, CASE WHEN kind = 'paragraph' THEN string_agg(trim(t), ' ' ORDER BY i) ELSE string_agg(regexp_extract(t, '{_LIST}', 3), chr(10) ORDER BY i) END AS text
      FROM n WHERE kind <> 'blank' GROUP BY doc_id, island, kind)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INT AS block, CASE WHEN kind = 'paragraph' THEN 'paragraph' ELSE 'list' END AS kind, kind = 'ordered' AS ordered, n_lines, text FROM b""",
    "transcript_runs": r"""
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS paragraph, 0 AS line,
       CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS stamp,
       length(role || ': ' || replace(text, chr(10), ' '))::INT AS n_chars
FROM (SELECT *, turn * 1000 AS s FROM conversations)""",
    "rectangles": """
WITH r AS (SELECT o_orderkey, (o_orderkey % 700 - 50)::DOUBLE AS x, (o_orderkey % 900 - 50)::DOUBLE AS y, (o_orderkey % 130 + 1)::DOUBLE AS w, (o_orderkey % 170 + 1)::DOUBLE AS h FROM orders),
s AS (SELECT *, greatest(x, 0) AS sx, greatest(y, 0) AS sy, least(x + w, 595) - greatest(x, 0) AS sw, least(y + h, 842) - greatest(y, 0) AS sh FROM r)
SELECT o_orderkey, CASE WHEN sw > 0 AND sh > 0 THEN sx ELSE 0 END AS shared_x, CASE WHEN sw > 0 AND sh > 0 THEN sy ELSE 0 END AS shared_y,
       CASE WHEN sw > 0 AND sh > 0 THEN sw ELSE 0 END AS shared_width, CASE WHEN sw > 0 AND sh > 0 THEN sh ELSE 0 END AS shared_height,
       least(greatest(x, 0), 595 - w) AS inside_x, least(greatest(y, 0), 842 - h) AS inside_y, least(595 / w, 842 / h) AS scale FROM s""",
    "event_windows": """SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "layout_lines": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM documents),
l AS (SELECT doc_id, a, unnest(range(0, (len(a) + 7) // 8)) AS k FROM w)
SELECT doc_id, (k // 40 + 1)::INT AS page_number, (k % 40)::INT AS ord, array_to_string(a[k * 8 + 1 : k * 8 + 8], ' ') AS text FROM l""",
    "baseline_lines": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM documents),
l AS (SELECT doc_id, a, unnest(range(0, (len(a) + 7) // 8)) AS k FROM w)
SELECT doc_id, (k // 40 + 1)::INT AS page_number, (k % 40)::INT AS line, array_to_string(a[k * 8 + 1 : k * 8 + 8], ' ') AS text FROM l""",
    "layout_plain": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM documents),
l AS (SELECT doc_id, a, unnest(range(0, (len(a) + 7) // 8)) AS k FROM w),
p AS (SELECT doc_id, k // 40 AS page, string_agg(array_to_string(a[k * 8 + 1 : k * 8 + 8], ' '), chr(10) ORDER BY k) AS t FROM l GROUP BY 1, 2)
SELECT doc_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS sha256 FROM p GROUP BY 1""",
    "match_rectangles": f"""
WITH {_PII}
SELECT doc_id, 1 AS page_number, count(*) AS n, round(sum(greatest(6.0::DOUBLE, ("end" - start) * 5.0 + 2) * 11.8), 3) AS area FROM pii GROUP BY doc_id""",
    "page_chunks": """
SELECT doc_id, chunk::BIGINT AS chunk, min(page) AS first, max(page) AS last FROM (
  SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) // 4 AS chunk FROM (SELECT DISTINCT conv_id AS doc_id, turn AS page FROM conversations)) GROUP BY 1, 2""",
    "edited_pages": """
WITH t AS (SELECT DISTINCT conv_id AS doc_id, turn AS page FROM conversations WHERE turn <> 1),
d AS (SELECT doc_id, page, 0 AS copy FROM t UNION ALL SELECT doc_id, page, 1 FROM t WHERE page = 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, copy) - 1)::INT AS out_idx, page AS src_idx, 90 AS rotate_delta FROM d""",
    "edit_log": """
WITH RECURSIVE log AS (
  SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
         ['rotate', 'delete', 'duplicate', 'move', 'undo', 'duplicate', 'redo', 'reset', 'move', 'rotate'][(conv_id * 3 + turn * 7) % 10 + 1] AS command,
         [(turn % 4)::INT, ((turn + conv_id) % 7)::INT] AS keys, (90 * (turn % 4 + 1))::INT AS delta, (turn % 3)::INT AS source, ((turn + conv_id) % 4)::INT AS target FROM conversations),
run AS (
  SELECT conv_id AS doc_id, 0::BIGINT AS k, n, list_transform(range(n), lambda i: {'key': i::INT, 'src': i::INT, 'rot': 0}) AS pages,
         []::STRUCT("key" INT, src INT, rot INT)[][] AS undo, []::STRUCT("key" INT, src INT, rot INT)[][] AS redo, n AS free
  FROM (SELECT conv_id, (conv_id % 4 + 3)::INT AS n FROM conversations GROUP BY conv_id)
  UNION ALL
  SELECT doc_id, k, n, CASE WHEN back THEN undo[-1] WHEN forth THEN redo[-1] ELSE coalesce(e, pages) END,
         CASE WHEN back THEN undo[:-2] WHEN forth OR e IS NOT NULL THEN list_append(undo, pages) ELSE undo END,
         CASE WHEN back THEN list_append(redo, pages) WHEN forth THEN redo[:-2] WHEN e IS NOT NULL THEN [] ELSE redo END,
         (free + CASE command WHEN 'duplicate' THEN len(chosen) WHEN 'reset' THEN n ELSE 0 END)::INT
  FROM (
    SELECT *, CASE command
      WHEN 'rotate' THEN list_transform(pages, lambda p: {'key': p.key, 'src': p.src, 'rot': CASE WHEN list_contains(keys, p.key) THEN (p.rot + delta) % 360 ELSE p.rot END})
      WHEN 'delete' THEN list_filter(pages, lambda p: NOT list_contains(keys, p.key))
      WHEN 'duplicate' THEN flatten(list_transform(pages, lambda p: CASE WHEN list_contains(keys, p.key) THEN [p, {'key': (free + list_position(chosen, p.key) - 1)::INT, 'src': p.src, 'rot': p.rot}] ELSE [p] END))
      WHEN 'move' THEN CASE WHEN source < len(pages) AND target < len(pages) THEN list_insert_at END
      WHEN 'reset' THEN list_transform(range(n), lambda i: {'key': (free + i)::INT, 'src': i::INT, 'rot': 0}) END AS e
    FROM (
      SELECT r.doc_id, l.k, n, pages, undo, redo, free, command, keys, delta, source, target, command = 'undo' AND len(undo) > 0 AS back, command = 'redo' AND len(redo) > 0 AS forth,
             list_transform(list_filter(pages, lambda p: list_contains(keys, p.key)), lambda p: p.key) AS chosen,
             (pages[:source] || pages[source + 2:])[:target] || pages[source + 1 : source + 1] || (pages[:source] || pages[source + 2:])[target + 1:] AS list_insert_at
      FROM run r JOIN log l ON l.doc_id = r.doc_id AND l.k = r.k + 1))),
last AS (SELECT doc_id, arg_max(pages, k) AS pages FROM run GROUP BY doc_id)
SELECT doc_id, (i - 1)::INT AS out_idx, pages[i].src AS src_idx, pages[i].rot AS rotate_delta, pages[i].key AS "key" FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM last)""",
    "segment_names": f"""
SELECT conv_id, i::INT AS segment, 'conv.' || conv_id || CASE WHEN i * 3 + 1 = least(i * 3 + 3, n) THEN '-page-' || (i * 3 + 1) ELSE '-pages-' || (i * 3 + 1) || '-' || least(i * 3 + 3, n) END || '.pdf' AS name
FROM (SELECT conv_id, n, unnest(range(0, (n + 2) // 3)) AS i FROM {_TURNS})""",
    "column_names": """
WITH k AS (SELECT c_custkey, c_custkey % 18000 AS i FROM customer)
SELECT c_custkey, CASE WHEN i >= 702 THEN chr((65 + (i - 702) // 676)::INT) ELSE '' END || CASE WHEN i >= 26 THEN chr((65 + (i - 26) // 26 % 26)::INT) ELSE '' END || chr((65 + i % 26)::INT) AS name, i::BIGINT AS back FROM k""",
    "error_codes": """
SELECT CASE event_id % 5 WHEN 0 THEN 'ENCRYPTED_PDF' WHEN 1 THEN 'WRONG_PASSWORD' WHEN 2 THEN 'QUOTA_EXCEEDED' ELSE 'UNKNOWN' END AS code, count(*) AS events FROM events GROUP BY 1""",
    "placements": """
WITH i AS (SELECT o_orderkey, o_orderkey % 9 AS k, (o_orderkey % 130 + 1)::DOUBLE AS w, (o_orderkey % 170 + 1)::DOUBLE AS h FROM orders),
p AS (SELECT *, [20.0::DOUBLE, (595 - w) / 2, 595 - w - 20][k % 3 + 1] AS x, [842 - h - 20, (842 - h) / 2, 20.0::DOUBLE][k // 3 + 1] AS y FROM i)
SELECT o_orderkey, ['top', 'middle', 'bottom'][k // 3 + 1] || '-' || ['left', 'center', 'right'][k % 3 + 1] AS position, x, y, x * 1.5::DOUBLE AS "left", (842 - y - h) * 1.5::DOUBLE AS top FROM p""",
    "header_zones": """
SELECT p_partkey, split_part(p_name, ' ', 1) AS "left", split_part(p_name, ' ', 2) AS center, split_part(p_name, ' ', 3) AS "right" FROM part""",
    "workbook_rows": """
SELECT c_custkey // 100 AS doc_id, count(*)::INT AS n_rows, sha256(string_agg(c_name || chr(9) || c_mktsegment || chr(9) || c_acctbal, chr(10) ORDER BY c_name, c_mktsegment, c_acctbal::VARCHAR)) AS sha256 FROM customer GROUP BY 1""",
    "package_blocks": """
WITH t AS (SELECT conv_id AS doc_id, role, 'said: ' || md5(text) AS said FROM conversations WHERE text IS NOT NULL)
SELECT doc_id, 'heading' AS kind, count(*) AS blocks, min(role) AS least, max(role) AS most FROM t GROUP BY 1 UNION ALL SELECT doc_id, 'paragraph', count(*), min(said), max(said) FROM t GROUP BY 1""",
    "output_names": r"""
WITH n AS (SELECT source, lang, doc_id, array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:2], ' ') || '.pdf' AS name FROM documents),
s AS (SELECT source, lang, list(trim(regexp_replace(name, '\.[^.]+$', '')) ORDER BY doc_id) AS l FROM n GROUP BY 1, 2),
k AS (SELECT source, lang, list_filter(l, lambda x: x <> '') AS l FROM s),
j AS (SELECT source, lang, CASE WHEN len(l) = 0 THEN 'document' WHEN len(l) <= 3 THEN array_to_string(l, '+') ELSE l[1] || '+' || (len(l) - 1) || '-more' END AS x FROM k),
c AS (SELECT source, lang, substr(trim(regexp_replace(regexp_replace(x, '[/\\?%*:|"<>\x00-\x1f]', '', 'g'), '\s+', ' ', 'g')), 1, 180) AS x FROM j)
SELECT source, lang, CASE WHEN x = '' THEN 'document' ELSE x END || '-merged.pdf' AS name FROM c""",
    "redaction_verified": rf"""
WITH {_PII},
chars AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, text FROM documents WHERE doc_id IN (SELECT doc_id FROM pii)),
masked AS (
  SELECT c.doc_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM pii p WHERE p.doc_id = c.doc_id AND c.i > p.start AND c.i <= p."end") THEN '█' ELSE c.text[c.i] END, '' ORDER BY c.i) AS t FROM chars c GROUP BY 1),
hays AS (SELECT doc_id, lower(regexp_replace(t, '\s+', '', 'g')) AS hay FROM masked),
again AS (SELECT DISTINCT doc_id FROM hays JOIN (SELECT DISTINCT doc_id, lower(regexp_replace(value, '\s+', '', 'g')) AS needle FROM pii WHERE length(trim(value)) >= 3) USING (doc_id) WHERE contains(hay, needle))
SELECT count(*) AS documents, (SELECT count(*) FROM again)::BIGINT AS with_leftovers FROM hays""",
    "items_recognised": """
WITH o AS (SELECT l_orderkey AS doc_id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT doc_id, CASE WHEN r > 0 THEN r ELSE n END AS items, r::BIGINT AS again FROM o""",
    "unread_regions": """
SELECT l_orderkey AS doc_id, count(*) AS regions, count(DISTINCT l_linenumber) AS pages FROM lineitem
WHERE NOT (l_linenumber BETWEEN 1 AND 4 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)) GROUP BY 1""",
    "pii_in_order": f"""
WITH {_PII},
o AS (SELECT *, list_position(['email', 'credit-card', 'aadhaar', 'pan', 'phone', 'ip-address'], type) AS d FROM pii)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start, d) - 1)::INT AS place, type, start FROM o""",
    "flags_in_order": """
WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY first_line, l_returnflag) AS flags FROM f GROUP BY 1""",
    "recorded_history": """
WITH e AS (SELECT event_id, ts, event_type FROM events UNION ALL SELECT event_id, ts + INTERVAL 1 DAY, event_type FROM events WHERE event_id % 2 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) AS k FROM e)
SELECT event_id, event_type FROM l WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 50""",
}
