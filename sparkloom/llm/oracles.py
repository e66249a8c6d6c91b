"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op6_decontamination() -> str:
    doc = _WORDS.format(_LOWER.format("coalesce(text, '')"))
    return f"""
WITH d AS (SELECT doc_id, {doc} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {doc} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s
      FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(k) WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM p),
c AS (SELECT doc_id, k, l.n, array_to_string(w[k : k + l.n - 1], ' ') AS s
      FROM d, l, unnest(range(1, len(w) - l.n + 2)) AS u(k)),
h AS (SELECT doc_id, k, c.n, item FROM c JOIN p ON c.n = p.n AND c.s = p.s),
m AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM h, unnest(range(k, k + n)) AS u(x) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op3_quality_rules() -> str:
    return r"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
     FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
g AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(k)),
h AS (SELECT doc_id, unnest(list(k)) AS k FROM g GROUP BY doc_id, s HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT x) AS n FROM h, unnest(range(k, k + 8)) AS u(x) GROUP BY doc_id),
z AS (SELECT doc_id, count(*) AS n FROM d, unnest(range(2, len(w) + 1)) AS u(k) WHERE w[k] = w[k - 1] GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
       len(lines) AS n_lines, coalesce(z.n, 0) AS stutter,
       length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
     FROM d LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * upper > 50 * letters
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * stutter > 30 * n_words) AS kept
FROM f"""


def op10_chat_format() -> str:
    return r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\[\]<>]', '', 'g')) AS body,
      length(role) + length(regexp_replace(role, '[^\\\[\]<>\n]', '', 'g')) AS name FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN body + 6 ELSE body + name + 15 END) AS BIGINT) AS formatted_chars, false AS rewritten
FROM e GROUP BY conv_id"""


def op11_periodic_runs() -> str:
    """Pairs of equal words up to a quarter of the text apart, their islands, and of islands alike that of the least distance."""
    return r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b:
         list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS h
     FROM documents),
e AS (SELECT *, len(w0) AS n, (h // 10) % len(w0) AS a, 1 + (len(w0) - (h // 10) % len(w0)) // (3 + (h // 10) % 8) AS p FROM d),
f AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w FROM e),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS pos FROM f),
q AS (SELECT l.doc_id, l.pos, r.pos - l.pos AS dist FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.pos > l.pos AND (r.pos - l.pos) * 4 <= l.n),
s AS (SELECT doc_id, dist, min(pos) AS start, count(*) + dist AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, dist ORDER BY pos) AS island FROM q) GROUP BY doc_id, dist, island),
r AS (SELECT doc_id, start, length, min(dist) AS period FROM s WHERE length >= greatest(6, 4 * dist) GROUP BY doc_id, start, length),
g AS (SELECT doc_id, count(*) AS n_runs, max_by(start, (length, -start, -period)) AS start, max(length) AS length, max_by(period, (length, -start, -period)) AS period,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM x ANTI JOIN o USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)"""


def op12_lexical_search() -> str:
    terms = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
    return f"""
WITH d AS (SELECT doc_id, {terms} AS t FROM documents),
c AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
z AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM c),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY term, n_docs),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN p USING (term) JOIN c USING (doc_id), z GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


def op13_line_dedup() -> str:
    key = _LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, pos, line, {key} AS key FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d)),
s AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
k AS (SELECT doc_id, pos, line, top IS NOT NULL AND doc_id <> top AS gone FROM l LEFT JOIN s USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op3_quality_rules, op6_decontamination, op10_chat_format, op11_periodic_runs, op12_lexical_search, op13_line_dedup)}
