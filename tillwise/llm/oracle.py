"""SQL for the operators that SQL can express."""

from __future__ import annotations

from tillwise.llm.notices import NOTICES

EXACT_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept,
       sha256(norm) AS text_sha256
FROM texts
WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""

URL_FILTERS = """
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM parts JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
)
SELECT parts.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN fitting ON parts.page_id = fitting.page_id AND place = 1
"""

CHAT_FORMATTING = """
WITH distinct_turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), talks AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM distinct_turns GROUP BY conv_id
), answered AS (
  SELECT conv_id, turns, list_max(list_transform(generate_series(1, len(turns)), lambda i: CASE WHEN turns[i].role = 'assistant' THEN i END)) AS n FROM talks
), replies AS (
  SELECT conv_id, turns[1:n] AS a, lag(conv_id) OVER ids AS other_id, lag(turns[n].text) OVER ids AS other, n
  FROM answered WHERE n IS NOT NULL WINDOW ids AS (ORDER BY conv_id)
), openings AS (
  SELECT conv_id, turns, lag(conv_id) OVER same AS other_id, lag(turns) OVER same AS other
  FROM talks WINDOW same AS (PARTITION BY turns[1].role, turns[1].text ORDER BY conv_id)
), pairs AS (
  SELECT 'opening' AS kind, other_id AS chosen_id, conv_id AS rejected_id, other AS a, turns AS b FROM openings WHERE other_id IS NOT NULL
  UNION ALL
  SELECT 'reply', conv_id, other_id, a, list_concat(a[1:n - 1], [{'role': 'assistant', 'text': other}]) FROM replies WHERE other_id IS NOT NULL
), shared AS (
  SELECT *, len(list_filter(generate_series(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS k FROM pairs
), cut AS (
  SELECT kind, chosen_id, rejected_id, k, a[1:k] AS p, a[k + 1:] AS c, b[k + 1:] AS r FROM shared
), shown AS (
  SELECT *, list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)) AS ct,
         list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)) AS rt
  FROM cut
)
SELECT kind, chosen_id, rejected_id, CAST(k AS INTEGER) AS prompt_turns,
       array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), '') AS prompt,
       array_to_string(ct, '') AS chosen_text, array_to_string(rt, '') AS rejected_text,
       array_to_string(list_transform(list_filter(generate_series(1, len(c)), lambda i: c[i].role = 'assistant'),
         lambda i: (length(array_to_string(ct[1:i - 1], '')) + length(c[i].role) + 5)::VARCHAR || ':' || length(array_to_string(ct[1:i], ''))::VARCHAR), ',') AS chosen_mask,
       array_to_string(list_transform(list_filter(generate_series(1, len(r)), lambda i: r[i].role = 'assistant'),
         lambda i: (length(array_to_string(rt[1:i - 1], '')) + length(r[i].role) + 5)::VARCHAR || ':' || length(array_to_string(rt[1:i], ''))::VARCHAR), ',') AS rejected_mask
FROM shown
"""

def _secret_spans(kind: str, number: int, pattern: str, least: int, group: int, options: str, guard: str = "") -> str:
    """Matches of one kind: the text is cut at all matches, and short ones are dropped afterwards."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT row_no, '{kind}' AS kind, {number} AS number, starts[i] AS start, starts[i] + length(found[i]) AS stop
  FROM (
    SELECT row_no, found, part, list_transform(generate_series(1, len(found)),
             lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0)) AS starts
    FROM (
      SELECT row_no, regexp_split_to_array(text, {quoted}, '{options}') AS gaps,
             regexp_extract_all(text, {quoted}, 0, '{options}') AS found, regexp_extract_all(text, {quoted}, {group}, '{options}') AS part
      FROM texts WHERE regexp_matches(text, {f"'{guard}'" if guard else quoted}, '{options}')
    )
  ), generate_series(1, len(found)) AS s(i)
  WHERE length(part[i]) >= {least}"""


_SECRETS = " UNION ALL ".join(
    [
        _secret_spans("assign", 0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, "i"),
        _secret_spans("access", 1, "AKIA[A-Z0-9]+", 20, 0, "c"),
        _secret_spans("hex", 2, "[0-9a-f]+", 24, 0, "c", "[0-9a-f]{24}"),
        _secret_spans("github", 3, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "c"),
        _secret_spans("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "c"),
        _secret_spans("pem", 5, "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0, "c"),
    ]
)

SECRET_SCANS = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
), spans AS ({_SECRETS}
), grouped AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, number) FILTER (number < 3) AS base,
         string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, number) AS spans
  FROM spans GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN grouped USING (row_no)
"""

def _notice_rows() -> str:
    return ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in NOTICES.items())


# Every shingle of every document against every template, on windows of its own account.
LICENSE_SCANS = rf"""
WITH RECURSIVE class_sizes(size) AS (
  SELECT 8 UNION ALL SELECT size * 5 // 4 FROM class_sizes WHERE size < 2000
), notices(license, text) AS (VALUES {_notice_rows()}
), worded AS (
  SELECT license, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words FROM notices
), classed AS (
  SELECT license, any_value(words) AS words, CASE WHEN len(any_value(words)) <= 8 THEN len(any_value(words)) ELSE min(size) END AS size
  FROM worded JOIN class_sizes ON size >= len(words) GROUP BY license
), asked AS (
  SELECT DISTINCT license, greatest(1, size // 4) AS stride,
         size + CASE WHEN size > 8 THEN greatest(8, size // 4) ELSE 0 END + greatest(1, size // 4) - 1 AS width,
         array_to_string(words[i:i + 4], ' ') AS shingle
  FROM classed, generate_series(1, len(words) - 4) AS s(i)
), sizes AS (
  SELECT license, count(*) AS n FROM asked GROUP BY license
), texts AS (
  SELECT DISTINCT doc_id, text FROM documents
), split AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words FROM texts
), hits AS (
  SELECT doc_id, text, place, license, stride, width, asked.shingle
  FROM (
    SELECT doc_id, text, place, array_to_string(words[place + 1:place + 5], ' ') AS shingle
    FROM split, generate_series(0, len(words) - 5) AS s(place) WHERE len(words) >= 5
  ) AS shown JOIN asked USING (shingle)
), covered AS (
  SELECT doc_id, text, license, no, min(place) AS first_place, count(DISTINCT shingle) AS shared
  FROM hits, generate_series(greatest(0, CAST(ceil((place + 5 - width) / stride) AS BIGINT)), place // stride) AS g(no)
  GROUP BY ALL
), matching AS (
  SELECT doc_id, text, license, first_place, shared / n AS containment FROM covered JOIN sizes USING (license) WHERE shared / n >= 0.8
)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_min(first_place, (-containment, first_place)) AS INTEGER) AS first_word, count(*) AS windows
FROM matching GROUP BY doc_id, text, license
"""

# Prefixes as whole lists, and every node under each of its ancestors.
PREFIX_TRIE = r"""
WITH ordered AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  -- CRC-32 of the decimal id, bit by bit.
  SELECT c, turns, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
         ), 4294967295) % 6 AS h
  FROM ordered
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM heads AS a LEFT JOIN ordered AS b ON b.c = a.c - a.c % 100
), prefixes AS (
  SELECT c, d, turns[1:d] AS prefix, d = len(turns) AS ended, CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars
  FROM rebuilt, generate_series(0, len(turns)) AS depths(d)
), nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY d, prefix
), children AS (
  SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, prefix)
), totals AS (
  SELECT up AS d, prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM known, generate_series(0, d) AS ups(up) GROUP BY ALL
)
SELECT known.conv_id, known.d AS depth, parent.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves, saved_tokens, known.ends_sha256
FROM known JOIN totals USING (d, prefix) LEFT JOIN nodes AS parent ON parent.d = known.d - 1 AND parent.prefix = known.prefix[1:known.d - 1]
"""

def _base32(hexadecimal: str) -> str:
    """Five hexadecimal digits at a time as a number, and its four characters."""
    char = lambda at, bits: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr({hexadecimal}, {at}, 5))::INTEGER >> {bits}) & 31) + 1, 1)"
    return " || ".join(char(at, bits) for at in range(1, 41, 5) for bits in (15, 10, 5, 0))


WARC = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), placed AS (
  SELECT *, row_number() OVER best AS place, first_value(page_id) OVER best AS first_id
  FROM payloads WINDOW best AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, strlen(html) AS payload_bytes, {_base32("sha")} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first_id END AS refers_to
FROM placed
"""

# Every run of one to four words, counted as text; no hashes and no summaries.
PHRASE_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), counted AS (
  SELECT lang, k AS words, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM split, generate_series(1, 4) AS lengths(k), generate_series(1, len(words) - k + 1) AS starts(i)
  GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang
), listed AS (
  SELECT *, string_split(phrase, ' ') AS list FROM counted
), cuts AS (
  SELECT c.lang, c.phrase, c.f, k, a.f AS l, b.f AS r, (2000000::HUGEINT * c.f) // (a.f + b.f)::HUGEINT AS score
  FROM listed AS c, generate_series(1, c.words - 1) AS cut(k)
  JOIN counted AS a ON a.lang = c.lang AND a.phrase = array_to_string(c.list[1:k], ' ')
  JOIN counted AS b ON b.lang = c.lang AND b.phrase = array_to_string(c.list[k + 1:], ' ')
  WHERE c.words >= 2
), weakest AS (
  SELECT lang, phrase, f AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score)::BIGINT AS score FROM cuts GROUP BY lang, phrase, f
), inner_phrases AS (
  SELECT lang, array_to_string(list[i:i + k - 1], ' ') AS phrase, max(f) AS longer
  FROM listed, generate_series(2, words - 1) AS lengths(k), generate_series(1, words - k + 1) AS starts(i) WHERE words > 2 GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest AS w LEFT JOIN inner_phrases USING (lang, phrase) WHERE 100 * coalesce(longer, 0)::HUGEINT < 80 * a::HUGEINT
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

SQL = {
    "op12_warc": WARC,
    "op11_prefix_trie": PREFIX_TRIE,
    "op13_phrase_collocations": PHRASE_COLLOCATIONS,
    "op5_license_scans": LICENSE_SCANS,
    "op2_exact_dedup": EXACT_DEDUP,
    "op3_url_filters": URL_FILTERS,
    "op6_secret_scans": SECRET_SCANS,
    "op4_chat_formatting": CHAT_FORMATTING,
}
