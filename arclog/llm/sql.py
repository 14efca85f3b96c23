"""DuckDB SQL for the queries that SQL can express."""

SPACE = "[ \\t\\n\\x0B\\f\\r]"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"

OP4 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) + length(role)
      + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM told
"""

OP5 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM w, unnest(range(1, len(w) - 1)) AS u(i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), n AS (
  SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m
), f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT
    + 16 * (word_chars > 12 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
    + 64 * (2 * n_upper > word_chars)::BIGINT)::BIGINT AS failed
  FROM n
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


#: Each base32 digit of the SHA-1 is five bits out of two neighbouring hex digits.
OP8 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p
), b AS (
  SELECT *, list_transform(range(32), lambda i: (
    (('0x' || substr(h || '0', ((i * 5) // 4 + 1)::BIGINT, 2))::BIGINT >> (3 - (i * 5) % 4)) & 31)) AS v
  FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""




def _dealt(name: str, parent: str, children: str) -> str:
    """A table's rows with their budget; ``children`` has total, capacity and weight."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_ranked AS (
  SELECT *, row_number() OVER s AS rank_, coalesce(sum(capacity) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy,
    coalesce(sum(weight) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS light
  FROM ({children}) WINDOW s AS ({by} ORDER BY capacity::DOUBLE / weight, {name})
), {name}_first AS (
  SELECT *, min(rank_) FILTER (WHERE capacity * heavy > weight * (total - taken)) OVER ({by}) AS first_ FROM {name}_ranked
), {name}_shared AS (
  SELECT *, max(total - taken) FILTER (WHERE rank_ = first_) OVER ({by}) AS rest,
    max(heavy) FILTER (WHERE rank_ = first_) OVER ({by}) AS weights,
    max(light) FILTER (WHERE rank_ = first_) OVER ({by}) AS base
  FROM {name}_first
), {name}_dealt AS (
  SELECT * EXCLUDE (total), CASE WHEN rank_ >= first_
    THEN least((rest * (light + weight - base)) // weights - (rest * (light - base)) // weights, capacity)
    ELSE capacity END AS budget
  FROM {name}_shared
)"""


_CHILDREN = """
  SELECT {keys}, max(tokens) AS tokens, sum(capacity) AS capacity, max({weight}) AS weight, max(total) AS total
  FROM leaves {join} GROUP BY {keys}"""

OP1 = rf"""
WITH t AS (
  SELECT doc_id, ['web', 'books', 'forum'][(('0x' || substr(md5(coalesce(source, '')), 1, 1))::BIGINT % 3) + 1] AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 4 AS capacity,
    CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS w_domain,
    CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 4 WHEN 'de' THEN 3 WHEN 'es' THEN 3 ELSE 1 END AS w_lang, 1 AS w_source
  FROM t GROUP BY ALL
), {_dealt("domain", "", _CHILDREN.format(keys="domain", weight="w_domain", join="CROSS JOIN (SELECT sum(tokens) // 2 AS total FROM leaves)"))
}, {_dealt("lang", "domain", _CHILDREN.format(keys="domain, lang", weight="w_lang", join="JOIN (SELECT domain, budget AS total FROM domain_dealt) USING (domain)"))
}, {_dealt("source", "domain, lang", _CHILDREN.format(keys="domain, lang, source", weight="w_source", join="JOIN (SELECT domain, lang, budget AS total FROM lang_dealt) USING (domain, lang)"))
}, p AS (
  SELECT domain, lang, source, budget, budget // tokens AS full_, budget % tokens AS rest FROM source_dealt WHERE tokens > 0 AND budget > 0
), h AS (
  SELECT t.*, budget, full_, rest, md5('17:' || (full_ + 1)::VARCHAR || ':' || key) AS h
  FROM t JOIN p USING (domain, lang, source) WHERE n_tokens > 0
), c AS (
  SELECT *, greatest(0, least(n_tokens, rest - (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens))) AS part FROM h
), e AS (
  SELECT *, unnest(range(1, (full_ + CASE WHEN part > 0 THEN 1 ELSE 0 END + 1)::BIGINT)) AS epoch FROM c
)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens,
  (CASE WHEN epoch <= full_ THEN n_tokens ELSE part END)::BIGINT AS take_tokens, budget::BIGINT AS leaf_budget
FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op4_chat_formatting": OP4, "op5_quality_rules": OP5, "op8_warc": OP8}
