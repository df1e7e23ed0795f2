"""DuckDB SQL for those corpus queries that SQL can express."""

from cipherlake.llm.url_reputation import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = (
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all("""
    + _LOWER.format("coalesce(text, '')")
    + r""", '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links
), reach(doc_id, other) AS (
  SELECT u, v FROM sym UNION SELECT r.doc_id, b.v FROM reach r JOIN sym b ON r.other = b.u
), component AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.doc_id = d.doc_id
"""
)

OP6 = r"""
WITH lines AS (
  SELECT doc_id, regexp_extract_all(text, '(?:[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]+){1,25}[\x20\x09\x0B-\x0D]*\n?|[\x20\x09\x0B-\x0D]*\n|[\x20\x09\x0B-\x0D]+') AS ls FROM documents WHERE text IS NOT NULL
), places AS (
  SELECT doc_id, i AS pos, ls[i + 1] AS line, regexp_replace(ls[i + 1], '[\x20\x09-\x0D]+$', '') AS x FROM lines, unnest(range(0, len(ls))) AS r(i)
), threes AS (
  SELECT doc_id, pos, x AS x1, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3 FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT doc_id, pos, x1 || chr(10) || x2 || chr(10) || x3 AS w FROM threes WHERE x3 IS NOT NULL AND x1 || x2 || x3 <> ''
), ranked AS (
  SELECT *, row_number() OVER o AS k, first_value(doc_id) OVER o AS first_doc, first_value(pos) OVER o AS first_pos FROM windows WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)
), covered AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM ranked, unnest(range(0, 3)) AS r(j) WHERE k > 1 AND (doc_id <> first_doc OR pos + j >= first_pos + 3)
), kept AS (
  SELECT p.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed, string_agg(p.line, '' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS text
  FROM places p LEFT JOIN covered c ON c.doc_id = p.doc_id AND c.pos = p.pos GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(k.n_removed, 0) > 0 AND regexp_full_match(coalesce(k.text, ''), '[\s]*') AS removed_all,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def _level(name, keys, prior, rows):
    """Two relations: ``{name}_k``, the prior strength of a level by moments, and ``name``, its posterior means."""
    return f"""{name}_p AS (SELECT {keys}, sum(n) AS n, sum(bad) AS bad, {prior} AS prior FROM {rows} GROUP BY ALL),
{name}_m AS (SELECT sum(pow(bad / CAST(n AS DOUBLE) - prior, 2) * n) AS v, sum(prior * (1 - prior) * n) AS s, count(*) AS g, CAST(sum(n) AS DOUBLE) AS p FROM {name}_p WHERE n > 0),
{name}_k AS (SELECT CASE WHEN g > 1 AND s > 0 THEN least(greatest(1 / least(greatest((v / s - g / p) / greatest(1 - g / p, 1e-9), 1e-4), 0.9) - 1, 1), 1000) ELSE 50 END AS k FROM {name}_m),
{name} AS (SELECT {name}_p.*, (bad + k * prior) / (n + k) AS mean, n + k AS strength FROM {name}_p, {name}_k)"""


_RULES = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))
) + " END"
_ORDERED = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))

OP2 = (
    r"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), urls AS (
  SELECT page_id, """
    + _LOWER.format("regexp_extract(r, '^([^/?#]*)', 1)")
    + r""" AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), marked AS (
  SELECT *, TRY_CAST(regexp_extract(path, '/(\d{1,18})(?:[./]|$)', 1) AS BIGINT) AS doc_id FROM urls
), worst AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), hosts AS (
  SELECT host, regexp_extract(host, '(^|\.)(([^.]*\.)?((ac|co|com|edu|gov|ne|net|or|org)\.[a-z][a-z]|[^.]*))$', 2) AS domain,
         regexp_extract(host, '(^|\.)((ac|co|com|edu|gov|ne|net|or|org)\.[a-z][a-z]|[^.]*)$', 2) AS suffix, count(b.bad) AS n, coalesce(sum(b.bad), 0) AS bad
  FROM marked m LEFT JOIN worst b ON b.doc_id = m.doc_id GROUP BY host
), overall AS (
  SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 1) / CAST(sum(n) + 2 AS DOUBLE) ELSE 0.5 END AS rate FROM hosts
), """
    + _level("sx", "suffix", "(SELECT rate FROM overall)", "hosts")
    + ", "
    + _level("dm", "domain, suffix", "(SELECT mean FROM sx WHERE sx.suffix = hosts.suffix)", "hosts")
    + ", "
    + _level("hs", "host, domain", "(SELECT mean FROM dm WHERE dm.domain = hosts.domain)", "hosts")
    + ", bounded AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (strength + 1)) AS bound FROM hs) SELECT page_id, u.host, path, "
    + _RULES.format(*[f"'{h}{p}'" for _, h, p in _ORDERED]).replace("host =", "u.host =").replace("ends_with(host", "ends_with(u.host")
    + " AS rule, coalesce("
    + _RULES.format(*[f"'{a}'" for a, _, _ in _ORDERED]).replace("host =", "u.host =").replace("ends_with(host", "ends_with(u.host")
    + ", CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM urls u JOIN bounded b ON b.host = u.host"
)

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length('### ') + length(role) + len(regexp_extract_all(role, '[\\#:<\n]')) + length(': ') + length(text)
    + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</turn>')) + length('</turn>') + 1
    + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(coalesce(text, '')) AS chars FROM documents
), keyed AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
           / CASE WHEN size >= 20 AND chars >= 3 * size AND chars <= 12 * size THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS key
  FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST(3 * source_size AS DOUBLE) AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sources
), levelled AS (
  SELECT *, row_number() OVER r AS k,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed WINDOW r AS (ORDER BY most / w, source NULLS LAST)
), first_free AS (
  SELECT k, level FROM levelled WHERE level * w <= most ORDER BY k LIMIT 1
), goals AS (
  SELECT source, source_size, round(CASE WHEN f.k IS NULL OR l.k < f.k THEN most ELSE f.level * w END, 6) AS target
  FROM levelled l LEFT JOIN first_free f ON true
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals
), summed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed
)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * (p.epochs + CASE WHEN 2 * s.before + s.size <= 2 * (p.target - p.epochs * p.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents
), grams AS (
  SELECT doc_id, i AS pos, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
  FROM doc_words, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS r(i)
), hits AS (
  SELECT g.doc_id, g.pos, g.size, v.item_id FROM grams g JOIN windows v ON g.s = v.s AND g.size = v.size
), places AS (
  SELECT doc_id, count(DISTINCT pos + j) AS n_hit FROM hits, unnest(range(0, size)) AS r(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

ORACLES = {"op1_minhash_near_dedup": OP1, "op2_url_reputation": OP2, "op3_chat_format": OP3, "op4_source_mixing": OP4, "op6_line_dedup": OP6, "op7_decontaminate": OP7}
