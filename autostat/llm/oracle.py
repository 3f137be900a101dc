"""DuckDB SQL for the text queries that SQL can express on whole tables."""

from __future__ import annotations

from autostat.llm.mixing import HEX_DIGITS, PART, STEPS
from autostat.llm.quality import BASE_RULES, RULES, STOP_WORDS, Rule


def keeps(r: Rule) -> str:
    limits = [f"{r.feature} >= {r.least}"] * (r.least is not None) + [f"{r.feature} <= {r.most}"] * (r.most is not None)
    return "(" + " AND ".join(limits) + ")"


STOPS = ", ".join(f"'{w}', '{w.capitalize()}'" for w in STOP_WORDS)

QUALITY = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY r
), f AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: x IN ({STOPS}))) AS n_stop_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered USING (r)
), q AS (
  SELECT *, 100.0 * n_repeat_words / greatest(n_words, 1) AS repeat_percent, word_chars / greatest(n_words, 1) AS mean_word_chars,
    n_symbols / greatest(n_words, 1) AS symbol_ratio, n_stop_words / greatest(n_words, 1) AS stop_ratio,
    n_letter_words / greatest(n_words, 1) AS letter_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_capitals / greatest(word_chars, 1) AS capital_ratio
  FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, NOT ({" AND ".join(map(keeps, BASE_RULES))}) AS base_failed,
  {" AND ".join(map(keeps, (*BASE_RULES, *RULES)))} AS kept
FROM q
"""

# Conversations as lists of turns; a snapshot equals the beginning of a longer list.
CONVERSATIONS = """
WITH d AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM d
), whole AS (
  SELECT conv_id, n_turns, list({'role': role, 'text': text} ORDER BY position) AS turns FROM p GROUP BY conv_id, n_turns
), kept AS (
  SELECT a.conv_id FROM whole a WHERE NOT EXISTS (
    SELECT 1 FROM whole b WHERE b.turns[1].text IS NOT DISTINCT FROM a.turns[1].text AND b.turns[1:a.n_turns] = a.turns
      AND (b.n_turns > a.n_turns OR b.conv_id < a.conv_id))
)
SELECT conv_id, n_turns, position, role,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS segment
FROM p WHERE conv_id IN (SELECT conv_id FROM kept)
"""


def uniform(seed: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce({p}::VARCHAR, 'null')" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, {HEX_DIGITS}))::BIGINT::DOUBLE / {16**HEX_DIGITS}.0)"


MIXING = f"""
WITH c AS (
  SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source
), m AS (
  SELECT source, (SELECT sum(n) FROM c) * weight / (SELECT sum(weight) FROM c) / n AS mean FROM c
), parts AS (
  SELECT source, ceil(mean / {PART}) AS parts, mean / ceil(mean / {PART}) AS mean FROM m
), pmf AS (
  SELECT source, parts, mean, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM parts, range({STEPS}) AS t(k)
), below AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM pmf
), steps AS (
  SELECT source, list(below ORDER BY k) AS below FROM below GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, d.lang, d.text, s.below, unnest(range(1, parts::BIGINT + 1)) AS part
  FROM documents d JOIN parts USING (source) JOIN steps s USING (source)
), copies AS (
  SELECT doc_id, source, lang, text, sum(len(list_filter(below, lambda x: x <= {uniform("mix", "doc_id", "part")})))::BIGINT AS copies
  FROM drawn GROUP BY ALL
), copied AS (
  SELECT *, unnest(range(1, copies + 1)) AS copy FROM copies
)
SELECT doc_id, source, lang, text, copies, copy, {uniform("mix:order", "doc_id", "copy")} AS shuffle_key FROM copied
"""

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIVE = "('0x' || substr(sha1(html), 5 * i + 1, 5))::INTEGER"
BASE32 = " || ".join(f"substr('{ALPHABET}', (({FIVE} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, list_aggregate(list_transform(range(8), lambda i: {BASE32}), 'string_agg', '') AS payload_digest
  FROM p
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM o
"""

# The lookup table of crc32, from its polynomial.
CRC = """table_of_crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS tab
)"""

RESAMPLING = rf"""
WITH {CRC}, base AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), split AS (
  SELECT kind, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM base
), runs AS (
  SELECT kind, r, unnest(list_concat(list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM split
), counts AS (
  SELECT kind, r, f, count(*) AS n FROM runs GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counts)
), hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM hexed, table_of_crc
), placed AS (
  SELECT kind, r, bucket, sum(n) AS n FROM counts JOIN hashed USING (f) GROUP BY ALL
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM placed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM buckets) + 10000)
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS gain FROM buckets
), weights AS (
  SELECT r, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r
), scored AS (
  SELECT r, doc_id, len(ws) AS n_words, (greatest(len(ws), 0) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (r) WHERE kind = 0
), placed_by_score AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS large FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * large // 100 THEN place END AS rank
FROM placed_by_score
"""

# Prefixes as lists of turns; sums over subtrees by unnesting the prefixes of every node.
TRIE = rf"""
WITH {CRC}, logged AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), wanted AS (
  SELECT c, turns, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1]), 4294967295)) % 4 AS h
  FROM logged, table_of_crc
), rebuilt AS (
  SELECT w.c, list_concat(coalesce(f.turns[1:h], []), w.turns[h + 1:]) AS turns FROM wanted w LEFT JOIN logged f ON f.c = w.c - w.c % 20
), paths AS (
  SELECT c, len(turns) AS n, turns[1:d] AS path, d FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM paths GROUP BY path, d
), children AS (
  SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), valued AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN d > 0 THEN (n - 1) * len(list_filter(regexp_split_to_array(path[d].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) ELSE 0 END AS saved
  FROM nodes LEFT JOIN children USING (path, d)
), above AS (
  SELECT path[1:a] AS path, a AS d, saved, n_children FROM (SELECT path, saved, n_children, unnest(range(d + 1)) AS a FROM valued)
), sums AS (
  SELECT path, d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY path, d
)
SELECT v.c AS conv_id, v.d AS depth, u.c AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
  sha256(v.ends) AS ends_sha256
FROM valued v JOIN sums USING (path, d) LEFT JOIN nodes u ON u.d = v.d - 1 AND u.path = v.path[1:v.d - 1]
"""

ORACLE = {
    "op3_quality_rules": QUALITY,
    "op4_chat_snapshots": CONVERSATIONS,
    "op7_source_mixing": MIXING,
    "op10_warc": WARC,
    "op11_resampling": RESAMPLING,
    "op13_prefix_trie": TRIE,
}
