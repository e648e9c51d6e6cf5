"""SQL over the same tables for the queries that SQL can express."""

from __future__ import annotations

from fleetfootprint.llm import pii, rules

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, count(*) AS source_rows FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank, sum(source_size) OVER () AS total
  FROM sources
), weighed AS (SELECT *, source_rank % 3 AS weight_class, source_rank % 3 + 1 AS weight, 3 * source_size AS stop FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(stop) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY stop::DOUBLE / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, weight_class, least(stop::DOUBLE, weight * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, weight_class, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY substr(place, 1, 8), place, doc_id NULLS FIRST, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, greatest(least(floor(target)::BIGINT - (start + e * source_size), size), 0) AS words, start / target AS share
  FROM placed, range(3) r(e)
)
SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken,
       round(max(CASE WHEN e = 0 AND words > 0 THEN
         CASE weight_class
           WHEN 0 THEN (sqrt(greatest(2.25 + share * -2.0, 0.0)) - 1.5) / -1.0
           WHEN 1 THEN share
           ELSE CASE WHEN share < 0.375 THEN (sqrt(greatest(0.25 + share * 2.0, 0.0)) - 0.5) / 1.0
                     ELSE 0.5 + (sqrt(greatest(1.0 + (share - 0.375) * 2.0, 0.0)) - 1.0) / 1.0 END
         END END), 9) + 0.0 AS first_position
FROM passes GROUP BY doc_id, size, source_size, target, start
"""

STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)

OP6 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), spread AS (
  SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts
), windows AS (
  SELECT row, place, word || ' ' || lead(word) OVER by_row || ' ' || lead(word, 2) OVER by_row AS three
  FROM spread WINDOW by_row AS (PARTITION BY row ORDER BY place)
), found AS (
  SELECT row, place, count(*) OVER (PARTITION BY row, three) AS times FROM windows WHERE three IS NOT NULL
), covered AS (
  SELECT row, count(DISTINCT place + k) AS n_repeat_words FROM found, range(3) r(k) WHERE times > 1 GROUP BY row
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(words, lambda w: lower(w) IN ({STOPS})))::BIGINT AS n_stop_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars::DOUBLE / n_words BETWEEN 2 AND 15 AND n_symbols::DOUBLE / n_words <= 0.25
         AND n_stop_words::DOUBLE / n_words >= 0.02 AND n_dup_lines::DOUBLE / n_lines <= 0.4
         AND n_repeat_words::DOUBLE / n_words <= 0.5 AND n_capitals::DOUBLE / word_chars <= 0.4 AS kept
FROM measured
"""

OP4 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
), components AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

# the patterns as the contract states them; possessive repeats and guards are a matter of speed
PROPOSALS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
} | {kind.name: kind.pattern for kind in pii.KINDS if not kind.base}
HITS = " UNION ALL ".join(
    f"""SELECT row, text, {i} AS kind_no, '{kind.name}' AS kind, {kind.base} AS base, {kind.score}::DOUBLE AS score, '{kind.context}' AS context,
      regexp_extract_all(text, '{PROPOSALS[kind.name]}') AS m, string_split_regex(text, '{PROPOSALS[kind.name]}') AS g FROM texts"""
    for i, kind in enumerate(pii.KINDS)
)

OP8 = rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({HITS}),
placed AS (
  SELECT * EXCLUDE (m, g), m[i] AS match,
         (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start_at
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)
), detailed AS (
  SELECT *, start_at + length(match) AS end_at, regexp_replace(match, '[^0-9]', '', 'g') AS digits,
         CASE WHEN start_at > 0 THEN substr(text, start_at, 1) ELSE '' END AS before, substr(text, start_at + length(match) + 1, 1) AS after,
         replace(match, ' ', '') AS account
  FROM placed
), checked AS (
  SELECT *,
    list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN substr(digits, -k, 1)::INT
           ELSE substr(digits, -k, 1)::INT * 2 - CASE WHEN substr(digits, -k, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS luhn,
    kind = 'iban' AND list_reduce(
      list_transform(string_split(substr(account, 5) || substr(account, 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
      lambda rest, n: (rest * CASE WHEN n > 9 THEN 100 ELSE 10 END + n) % 97) = 1 AS mod97
  FROM detailed
), valid AS (
  SELECT *, score + CASE WHEN regexp_matches(lower(substr(text, greatest(start_at - 40, 0) + 1, least(start_at, 40))), context) THEN 0.3 ELSE 0 END AS total
  FROM checked
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND luhn
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN NOT regexp_matches(before || after, '[A-Za-z0-9]') AND mod97
    WHEN 'tel' THEN NOT regexp_matches(after, '[0-9]')
    WHEN 'pan' THEN NOT regexp_matches(before || after, '[0-9]') AND luhn
    ELSE NOT regexp_matches(before || after, '[0-9-]') AND NOT regexp_matches(match, '^(?:000|666|9)|-00-|-0000$') END
), kept AS (
  SELECT * FROM valid v
  WHERE base OR total >= 0.5 AND NOT EXISTS (
    FROM valid b WHERE b.base AND b.row = v.row AND b.start_at <= v.start_at AND b.end_at >= v.end_at)
), written AS (
  SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind_no) FILTER (base) AS base_spans,
         string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind_no) AS spans
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
       coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN written USING (row)
"""

ORACLE = {"op8_personal_data": OP8, "op4_vector_neighbours": OP4, "op1_source_mix": OP1, "op6_quality_rules": OP6}
