"""SQL that gives the rows of op4, op6 and op10, for DuckDB."""

from __future__ import annotations

from .chat_format import CONTROL, MARKS
from .quality_rules import LINE_FLOOR, LINE_PERCENT, MAX_REPEAT_PERCENT, MIN_LEFT_SHARE, MIN_LEFT_WORDS, MIN_WORDS

_REST = "|".join("".join("\\" + c if c in r"|[]<>/\\" else c for c in x[1:]) for x in CONTROL)
_MARKS = sum(map(len, MARKS.values()))


def _escaped(column: str) -> str:
    """A backslash behind what opens a control string, and behind those that are there."""
    return rf"regexp_replace(coalesce({column}, ''), '([<\[]\\*)({_REST})', '\1\\\2', 'g')"


OP4 = f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10) AS whole, CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END AS loss,
    {_MARKS} + length({_escaped("role")}) + length({_escaped("text")}) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(coalesce(text, ''))) AS k FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(whole, '' ORDER BY k)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY k)) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: SHA-1 in hex to base32: 40 digits of 4 bits are 32 digits of 5.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5),
  lambda b: ((strpos('0123456789abcdef', hex[CAST((5 * i + b) // 4 + 1 AS INT)]) - 1) >> CAST(3 - (5 * i + b) % 4 AS INT) & 1) << CAST(4 - b AS INT))) AS INT), 1)), '')"""
OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS winner FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM winner THEN NULL ELSE winner END AS refers_to
FROM d
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(CAST(source AS VARCHAR), '') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
line AS (
  SELECT uid, doc_id, host, l, translate(array_to_string({_WORDS.format("l")}, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, len({_WORDS.format("l")}) AS n
  FROM (SELECT uid, doc_id, host, unnest(string_split(text, chr(10))) AS l FROM d)),
good AS (SELECT * FROM line WHERE n > 0),
dup AS (SELECT uid, count(*) - count(DISTINCT l) AS n_dup_lines FROM good GROUP BY uid),
win AS (SELECT uid, s, array_to_string(w[s : s + 2], chr(10)) AS t FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
often AS (SELECT uid, t FROM win GROUP BY uid, t HAVING count(*) > 1),
cov AS (SELECT uid, count(DISTINCT p) AS n_repeat_words FROM (SELECT uid, unnest(range(s, s + 3)) AS p FROM win JOIN often USING (uid, t)) GROUP BY uid),
of_host AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
frequent AS (
  SELECT host, h FROM (SELECT host, h, count(DISTINCT doc_id) AS k FROM good GROUP BY host, h) JOIN of_host USING (host)
  WHERE k > {LINE_FLOOR} AND 100 * k > {LINE_PERCENT} * n),
gone AS (SELECT uid, sum(n) AS n, count(DISTINCT h) AS lines FROM good JOIN frequent USING (host, h) GROUP BY uid),
base AS (
  SELECT d.uid, doc_id, CAST(len(w) AS BIGINT) AS n_words, length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_left_words, coalesce(lines, 0) AS n_removed_lines
  FROM d LEFT JOIN dup USING (uid) LEFT JOIN cov USING (uid) LEFT JOIN gone USING (uid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_left_words >= {MIN_LEFT_WORDS} AND n_left_words >= {MIN_LEFT_SHARE} * n_words AS kept,
  n_left_words, n_removed_lines
FROM base
"""
