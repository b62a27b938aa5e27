"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(column: str) -> str:
    return rf"replace(replace(replace({column}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"


OP1 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_escaped('role')}, ':', '\:')) + 2 + length({_escaped('text')}) + 9) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def op3(shards: tuple[str, ...]) -> str:
    """The filled table is a list in the text; it is held against a slot-by-slot filling in the tests."""
    from larkspur.llm.sharding import fill_table, next_prime

    size = next_prime(100 * len(shards))
    slots = [shards[i] for i in fill_table(shards, size)]
    return f"""
WITH filled AS (SELECT unnest(range({size})) AS slot, unnest({slots}) AS shard),
placed AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents)
SELECT slot, doc_id, shard FROM placed JOIN filled USING (slot)"""


def op4(rules, reported: str) -> str:
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = [f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')" for r in ordered]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r.text}'" for c, r in zip(fits, ordered, strict=True)) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{r.action}'" for c, r in zip(fits, ordered, strict=True)) + " END"
    return rf"""
WITH parts AS (
  SELECT page_id, contains(coalesce(url, ''), '://') AS has,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)='))) AS query
  FROM pages),
whole AS (
  SELECT *, CASE WHEN has THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END ELSE '' END AS canonical_url FROM parts),
list AS (
  SELECT DISTINCT canonical_url FROM whole
  WHERE canonical_url <> '' AND starts_with(md5(CAST(page_id AS VARCHAR)), '{reported}'))
SELECT page_id, host, path, {rule} AS rule,
  coalesce({action}, CASE WHEN canonical_url IN (SELECT canonical_url FROM list) THEN 'block' ELSE 'allow' END) AS verdict,
  canonical_url, canonical_url IN (SELECT canonical_url FROM list) AS listed
FROM whole"""


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = rf"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS part FROM starts),
words AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT p.row, p.i, p.n, x.item FROM (SELECT row, i, n, array_to_string(w[i : i + n - 1], ' ') AS part FROM places) p JOIN windows x USING (n, part)),
hits AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS place FROM found) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (row) LEFT JOIN named USING (row)"""

#: The mix's totals in closed form: whole epochs, and of the last one the blocks that come before the target is reached.
OP11 = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS key FROM documents),
streams AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM docs),
weighed AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
filled AS (
  SELECT *, sum(source_size) OVER () AS words, sum(w) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
    coalesce(sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0 FROM weighed),
split AS (SELECT *, 3 * source_size < w / (weights - w0) * (words - s0) AS above FROM filled),
rest AS (SELECT sum(w) AS w_free, min(s0) AS s_above FROM split WHERE NOT above),
targets AS (
  SELECT source, source_size, CASE WHEN above THEN 3.0::DOUBLE * source_size ELSE 1000000 * w * CAST(words - s_above AS DOUBLE) / (1000000 * w_free) END AS target FROM split, rest),
wanted AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS wanted FROM targets),
ends AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS epochs, source_size // 1024 AS full_blocks FROM wanted),
pieces AS (
  SELECT s.doc_id, s.key, s.start, s.size, e.*, unnest(range(s.start // 1024, (s.start + s.size - 1) // 1024 + 1)) AS block
  FROM streams s JOIN ends e ON s.source IS NOT DISTINCT FROM e.source WHERE s.size > 0),
ranked AS (
  SELECT *, CASE WHEN block < full_blocks THEN (block::HUGEINT * [2147483647, 2147483629, 2147483587, 2147483579][CAST(epochs + 1 AS INTEGER)]) % full_blocks ELSE block END AS rank FROM pieces),
taken AS (
  SELECT source, key, start, sum(greatest(0, least(start + size - block * 1024, 1024, wanted - epochs * source_size - rank * 1024) - greatest(start - block * 1024, 0))) AS partly
  FROM ranked GROUP BY source, key, start)
SELECT s.doc_id, s.size, e.source_size, e.target, CAST(e.epochs * s.size + coalesce(t.partly, 0) AS BIGINT) AS taken
FROM streams s JOIN ends e ON s.source IS NOT DISTINCT FROM e.source
LEFT JOIN taken t ON s.size > 0 AND s.source IS NOT DISTINCT FROM t.source AND s.key = t.key AND s.start = t.start"""


OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
counted AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (c + 5)) // (CAST(sum(c) OVER (PARTITION BY lang) AS BIGINT) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM kept),
own AS (
  SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, k.q,
    1 + (1000000000 * (coalesce(x.c, 0) + 5)) // (CAST(sum(coalesce(x.c, 0)) OVER (PARTITION BY g.lang, g.source) AS BIGINT) + 5 * count(*) OVER (PARTITION BY g.lang, g.source)) AS p
  FROM groups g JOIN whole k USING (lang) LEFT JOIN counted x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM own WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50"""
