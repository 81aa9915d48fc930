"""DuckDB SQL for the queries that SQL can express."""

from helixframe.llm.quality import STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *, length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '<\|(?:turn|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>')) + length(role) - length(replace(role, chr(10), ''))
    + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<\|(?:turn|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>')) + 16 AS chars
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

#: When a share of a source's demand has come: the inverse of the integral of 0.5 + t, of 1, and of 1.5 - t (which is
#: 0.625 at t = 0.5, where the schedule has a knot).
TIME = """CASE rank % 3 WHEN 0 THEN least(2 * {y} / (0.5 + sqrt(greatest(0.25 + 2 * {y}, 0))), 1) WHEN 1 THEN least({y}, 1)
    ELSE CASE WHEN {y} >= 0.625 THEN 0.5 + least(2 * ({y} - 0.625) / (1 + sqrt(greatest(1 - 2 * ({y} - 0.625), 0))), 0.5)
      ELSE least(2 * {y} / (1.5 + sqrt(greatest(2.25 - 2 * {y}, 0))), 0.5) END END"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(source_size * CAST(2 AS DOUBLE)) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size * CAST(2 AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, rank, least(source_size * CAST(2 AS DOUBLE), max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT d.*, source_size, target, rank, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, least(greatest(floor(target) - before, 0), size) AS one, least(greatest(floor(target) - source_size - before, 0), size) AS two,
    least(before / greatest(target, 1e-300), CAST(1 AS DOUBLE)) AS y1, least((before + source_size) / greatest(target, 1e-300), CAST(1 AS DOUBLE)) AS y2
  FROM p
), due AS (
  SELECT *, CASE WHEN one > 0 THEN {TIME.format(y="y1")} END AS t1, CASE WHEN two > 0 THEN {TIME.format(y="y2")} END AS t2 FROM c
)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken, round(coalesce(t1, t2), 9) AS position, CASE WHEN one > 0 THEN round(t2, 9) END AS again
FROM due
"""

OP10 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), win AS (
  SELECT r, i, list_slice(words, i, i + 4) AS x FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c >= 2
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) FROM dup) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), stops AS (
  SELECT r, count(*) AS n FROM (SELECT r, unnest(words) AS x FROM w) WHERE lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(stops.n, 0) AS n_stop
  FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r) LEFT JOIN stops USING (r)
), v AS (
  SELECT *, concat_ws(',',
    CASE WHEN n_words < 10 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeated_windows' END,
    CASE WHEN 100 * n_symbols > 25 * n_words AND n_words >= 10 THEN 'symbols' END,
    CASE WHEN 100 * word_chars < 200 * n_words AND n_words >= 10 THEN 'short_words' END,
    CASE WHEN 100 * word_chars > 1500 * n_words AND n_words >= 10 THEN 'long_words' END,
    CASE WHEN 100 * n_dup_lines > 50 * n_lines AND n_words >= 10 THEN 'duplicate_lines' END,
    CASE WHEN 100 * n_stop < 2 * n_words AND n_words >= 40 THEN 'stop_words' END) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed_rules = '' AS kept, failed_rules
FROM v
"""

OP1 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), n AS (
  SELECT r, doc_id, x, length(x) // 2 AS n FROM d
), w AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1
), edge AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit
), run AS (
  SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM edge) GROUP BY r, g
), gap AS (
  SELECT r, a, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM run
), kept AS (
  SELECT gap.r, min(a) AS first, sum(z - a) AS removed, count(*) AS spans,
    string_agg(substr(x, 2 * z + 1, 2 * (coalesce(next, n) - z)), '' ORDER BY a) AS rest
  FROM gap JOIN n USING (r) GROUP BY gap.r
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN first IS NULL THEN x ELSE substr(x, 1, 2 * first) || rest END)) AS kept_sha256
FROM n LEFT JOIN kept USING (r)
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_slice(w, i, i + 1) END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS dest FROM documents
  UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.dest
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(dest) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""

ORACLES = {"op1_suffix_dedup": OP1, "op3_near_dedup": OP3, "op6_chat_format": OP6, "op9_curriculum_mix": OP9, "op10_quality_rules": OP10}
