"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

JSON_LOG = """json_log AS (
  SELECT 'json_log' AS archive_id, event_id AS line_no,
    '{"timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z", "level": "' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END
    || '", "user": "u' || user_id || '", "ip": "10.0.' || (user_id % 256) || '.' || (event_id % 256) || '", "action": "' || event_type
    || '", "message": "event ' || event_id || '", "props": ' || props || '}' AS raw
  FROM events)"""

SYSLOG_LOG = """syslog_log AS (
  SELECT 'syslog_log' AS archive_id, event_id AS line_no,
    strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 8) || ' app: ' || event_type || ' id=' || event_id AS raw
  FROM events)"""

PLAIN_LOG = """plain_log AS (
  SELECT 'plain_log' AS archive_id, doc_id * 1000000 + place - 1 AS line_no, lines[place] AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(place))"""

CHAT_LOG = """chat_log AS (
  SELECT 'chat_log' AS archive_id, conv_id * 1000000 + turn AS line_no, replace(role || ': ' || text, chr(10), ' ') AS raw
  FROM conversations)"""

TOKENS = "list_filter(regexp_split_to_array(raw, '[ \":\\n\\r\\t,{}\\[\\]]+'), lambda x: x <> '')"


def placed(log: str = "json_log", source: str = JSON_LOG, name: str = "placed", where: str = "true") -> str:
    """Lines with offset and chunk."""
    return f"""{source}, {name} AS (
  SELECT *, "offset" // 65536 AS chunk_id FROM (
    SELECT *, coalesce(sum(strlen(raw) + 1) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM {log} WHERE {where}))"""


def _hashes(column: str) -> str:
    """The three hashes of a text column by folding its bytes."""
    data = f"list_transform(range(1, strlen({column}) + 1), lambda i: ('0x' || substr(hex({column}), (2 * i - 1)::BIGINT, 2))::BIGINT)"
    return f"""list_reduce({data}, lambda h, x: (h * 33 + x) & 4294967295, 5381::BIGINT) AS djb2,
    list_reduce({data}, lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS fnv1a,
    list_reduce({data}, lambda h, x: (x + h * 65599) & 4294967295, 0::BIGINT) AS sdbm"""


EPOCH = "epoch(strptime(json_extract_string(raw, '$.timestamp'), '%Y-%m-%dT%H:%M:%SZ'))::BIGINT"

ZONES = f"zones AS (SELECT chunk_id, min({EPOCH}) AS min_ts, max({EPOCH}) AS max_ts FROM placed GROUP BY chunk_id)"
ALL = "WITH " + placed() + ", " + ZONES

FROM, TO = 1704240000, 1704499199

KEYS = ("user", "user_id", "username", "ip", "ip_address", "action", "level", "severity")
VALUES = "list_filter([" + ", ".join(f"json_extract_string(raw, '$.{k}')" for k in KEYS) + "], lambda x: x IS NOT NULL)"

TEXT_BITS = f"""text_bits AS (
  SELECT DISTINCT chunk_id, unnest([djb2 % 8192, fnv1a % 8192, sdbm % 8192]) AS bit FROM (
    SELECT chunk_id, {_hashes("token")} FROM (SELECT DISTINCT chunk_id, unnest({TOKENS}) AS token FROM placed)))"""
FIELD_BITS = f"""field_bits AS (
  SELECT DISTINCT chunk_id, unnest([djb2 % 4096, fnv1a % 4096, sdbm % 4096]) AS bit FROM (
    SELECT chunk_id, {_hashes("token")} FROM (SELECT DISTINCT chunk_id, unnest({VALUES}) AS token FROM placed)))"""


def _may_hold(table: str, bits: int, value: str, name: str) -> str:
    """Chunks whose filter has all bits of a constant."""
    return f"""{name} AS (
  SELECT chunk_id FROM {table} WHERE bit IN (SELECT unnest([djb2 % {bits}, fnv1a % {bits}, sdbm % {bits}]) FROM (SELECT {_hashes("v")} FROM (SELECT '{value}' AS v)))
  GROUP BY chunk_id HAVING count(DISTINCT bit) = (SELECT count(DISTINCT b) FROM (SELECT unnest([djb2 % {bits}, fnv1a % {bits}, sdbm % {bits}]) AS b
    FROM (SELECT {_hashes("v")} FROM (SELECT '{value}' AS v)))))"""


def _lines(where: str, log: str = ALL) -> str:
    return f"{log} SELECT chunk_id, raw FROM placed JOIN zones USING (chunk_id) WHERE raw <> '' AND {where}"


PLAIN = "WITH " + placed("plain_log", PLAIN_LOG)

BODIES = """bodies AS (
  SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS seq, string_agg(raw || chr(10), '' ORDER BY line_no) AS raw FROM placed GROUP BY chunk_id)"""


def chained(bodies: str = "bodies") -> str:
    return f"""chained AS (
  SELECT seq, sha256(raw) AS chunk_hash FROM {bodies} WHERE seq = 0
  UNION ALL SELECT b.seq, sha256(unhex(c.chunk_hash) || encode(b.raw)) FROM chained c JOIN {bodies} b ON b.seq = c.seq + 1)"""


CHAIN = "WITH RECURSIVE " + placed() + ", " + BODIES + ", " + chained()
HEAD = "(SELECT chunk_hash FROM chained ORDER BY seq DESC LIMIT 1)"

HALVES = ("WITH RECURSIVE " + placed(where="line_no % 1000 < 500") + ", " + BODIES.replace("bodies AS", "old AS") + ", "
          + placed(name="placed2", where="line_no % 1000 >= 500").split(", placed2 AS", 1)[1].join(["placed2 AS", ""]) + ", "
          + BODIES.replace("bodies AS", "new AS").replace("placed", "placed2")
          + ", bodies AS (SELECT * FROM old UNION ALL SELECT seq + (SELECT count(*) FROM old), raw FROM new)")


def _verdict(status: str, n: str, bad: str, reason: str, expected: str, got: str, chain16: str) -> str:
    return f"""{CHAIN} SELECT 'json_log' AS archive_id, '{status}' AS status, {n} AS num_chunks, {bad}::BIGINT AS bad_chunk, '{reason}' AS reason,
  {expected} AS expected16, {got} AS got16, {chain16} AS chain16"""


#: The log's bytes, all ASCII, in slices of 64 KiB that cut lines.
SLICES = "WITH RECURSIVE " + JSON_LOG + """, whole AS (SELECT string_agg(raw || chr(10), '' ORDER BY line_no) AS t FROM json_log),
bodies AS (SELECT i AS seq, i AS chunk_id, substr(t, i * 65536 + 1, 65536) AS raw FROM whole, unnest(range((length(t) + 65535) // 65536)) AS u(i)),
placed AS (SELECT chunk_id, raw FROM bodies),
zones AS (
  SELECT chunk_id, min(s) AS min_ts, max(s) AS max_ts FROM (
    SELECT chunk_id, epoch(strptime(json_extract_string(x, '$.timestamp'), '%Y-%m-%dT%H:%M:%SZ'))::BIGINT AS s
    FROM (SELECT chunk_id, unnest(string_split(raw, chr(10))) AS x FROM bodies) WHERE json_valid(x)) GROUP BY chunk_id)"""

N = "(SELECT count(*) FROM bodies)"
NONE = "NULL::VARCHAR"

RECORD = "coalesce(json_extract_string(raw, '$.timestamp'), '') AS timestamp, " + ", ".join(
    f"coalesce(json_extract_string(raw, '$.{k}'), '') AS {k if k != 'user' else '\"user\"'}" for k in ("level", "user", "ip", "action", "message")) + ", raw"

OBJECTS = """objects AS (
  SELECT CASE WHEN k % 5 = 0 THEN 'other' ELSE 'logs' END AS bucket,
    CASE k % 3 WHEN 0 THEN 'audit/' WHEN 1 THEN 'app/' ELSE 'app/old/' END || k || CASE WHEN k % 2 = 0 THEN '.logz' ELSE '.log' END AS key,
    epoch(o_orderdate)::BIGINT AS modified,
    CASE k % 7 WHEN 0 THEN 'COMPLIANCE' WHEN 1 THEN 'GOVERNANCE' ELSE '' END AS lock_mode,
    CASE k % 7 WHEN 0 THEN '1' || lpad((k % 1000)::VARCHAR, 3, '0') || '-01-01' WHEN 1 THEN '2999-01-01' ELSE '' END AS until
  FROM (SELECT *, o_orderkey AS k FROM orders)),
locked AS (SELECT *, CASE WHEN until <> '' THEN (epoch(until::TIMESTAMP)::BIGINT - 1735689600) / 86400.0 END AS days FROM objects),
streams(name, bucket, regex, retention_days, lock) AS (VALUES
  ('audit', 'logs', '^audit/[^/]*\\.logz$', 2555, true), ('app', 'logs', '^app/[^/]*\\.logz$', 9000, false),
  ('all', 'other', '^[^/]*/[^/]*$', 30, true), ('new', 'logs', '^app/[^/]*\\.log$', 20000, true))"""


_LOGS = f"WITH {JSON_LOG}, {SYSLOG_LOG}, {PLAIN_LOG}, {CHAT_LOG}, lines AS (FROM json_log UNION ALL FROM syslog_log UNION ALL FROM plain_log UNION ALL FROM chat_log)"
_FORMAT = _LOGS.replace("{", "{{").replace("}", "}}") + """, first AS (
  SELECT archive_id, raw FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY line_no) AS r FROM lines WHERE {where}) WHERE r <= 5
), votes AS (
  SELECT archive_id, count(*) AS n, count_if({json}) AS json, count_if({syslog}) AS syslog FROM first GROUP BY archive_id
) SELECT archive_id, CASE WHEN json >= {least} THEN 'json' WHEN syslog >= {least} THEN 'syslog' ELSE 'plaintext' END AS format FROM votes"""


def oracle_sql() -> dict[str, str]:
    found = {
        "tokenize": f"WITH {JSON_LOG} SELECT line_no, (place - 1)::INT AS place, tokens[place] AS token FROM (SELECT line_no, {TOKENS} AS tokens FROM json_log), unnest(range(1, len(tokens) + 1)) AS u(place)",
        "chunk_sizes": ALL + ' SELECT chunk_id, count(*) AS lines, min("offset") AS first_byte, sum(strlen(raw) + 1)::BIGINT AS bytes FROM placed GROUP BY chunk_id',
        "chunk_time_zone": ALL + " SELECT chunk_id, min_ts, max_ts FROM zones",
        "chunk_time_first_last": ALL + f" SELECT chunk_id, arg_min({EPOCH}, line_no) AS first_ts, arg_max({EPOCH}, line_no) AS last_ts FROM placed GROUP BY chunk_id",
        "bloom_bits": "WITH " + placed() + ", " + TEXT_BITS + " SELECT chunk_id, bit FROM text_bits",
        "field_bloom_bits": "WITH " + placed() + ", " + FIELD_BITS + " SELECT chunk_id, bit FROM field_bits",
        "bloom_fill": "WITH " + placed() + ", " + TEXT_BITS + ", " + FIELD_BITS + """ SELECT chunk_id, a.n AS text_bits, b.n AS field_bits
          FROM (SELECT chunk_id, count(*) AS n FROM text_bits GROUP BY 1) a JOIN (SELECT chunk_id, count(*) AS n FROM field_bits GROUP BY 1) b USING (chunk_id)""",
        "detect_format": _FORMAT.format(least="greatest(1, least(3, n))", where="true", json="json_valid(raw)", syslog="regexp_matches(raw, '^\\w{3}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2}\\s')"),
        "detect_format_quick": _FORMAT.format(least="2", where="raw <> ''", json="regexp_matches(raw, '^\\{.*\\}[ \\t\\r]*$')",
                                              syslog="left(raw, 3) IN ('Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec')"),
        "iso_epoch": "SELECT event_id AS line_no, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events",
        "numeric_epoch": "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 10000 AND 89999 OR (o_orderkey = 90000 AND o_orderkey % 2 = 1) THEN o_orderkey * 100000 END AS epoch FROM orders",
        "syslog_epoch": "SELECT event_id AS line_no, epoch(strptime('2024' || strftime(ts, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'))::BIGINT AS epoch FROM events",
        "line_epoch": """SELECT 'json_log' AS archive_id, event_id AS line_no, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events
          UNION ALL SELECT 'syslog_log', event_id, epoch(strptime('2024' || strftime(ts, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'))::BIGINT FROM events""",
        "json_fields": f"WITH {JSON_LOG} SELECT line_no, " + ", ".join(f"json_extract_string(raw, '$.{k}') AS \"{k}\"" for k in ("timestamp", "level", "user", "ip", "action", "message")) + " FROM json_log",
        "search_text_exact": _lines("""contains(raw, '"user": "u7", "ip')"""),
        "search_text_reference": "WITH " + placed() + ", " + TEXT_BITS + ", " + _may_hold("text_bits", 8192, "erro", "held") + " SELECT chunk_id, raw FROM placed JOIN held USING (chunk_id) WHERE contains(raw, 'erro')",
        "search_subtoken_exact": _lines("contains(raw, 'erro')"),
        "search_plain_exact": PLAIN + " SELECT chunk_id, raw FROM placed WHERE contains(raw, 'the ')",
        "search_time_chunk": _lines(f"max_ts >= {FROM} AND min_ts <= {TO}"),
        "search_time_exact": _lines(f"{EPOCH} BETWEEN {FROM} AND 1704371400"),
        "search_field_chunk": "WITH " + placed() + ", " + FIELD_BITS + ", " + _may_hold("field_bits", 4096, "u7", "held") + " SELECT chunk_id, raw FROM placed JOIN held USING (chunk_id)",
        "search_field_exact": _lines("json_extract_string(raw, '$.user') = 'u7' AND json_extract_string(raw, '$.action') = 'click'"),
        "search_combined": _lines(f"contains(raw, 'event 1') AND {EPOCH} BETWEEN {FROM} AND {TO} AND json_extract_string(raw, '$.user') = 'u7' AND json_extract_string(raw, '$.level') = 'ERROR'"),
        "search_empty_query": _lines("true"),
        "search_stats": "WITH " + placed() + ", " + ZONES + ", " + TEXT_BITS + ", " + FIELD_BITS + ", " + _may_hold("field_bits", 4096, "u7", "user_held") + ", " + _may_hold("text_bits", 8192, "error", "text_held") + f""",
          layers AS (SELECT chunk_id, NOT (max_ts >= {FROM} AND min_ts <= {TO}) AS t, chunk_id NOT IN (FROM user_held) AS f, chunk_id NOT IN (FROM text_held) AS b FROM zones)
          SELECT count(*) AS total, count_if(NOT t AND NOT f AND NOT b)::BIGINT AS scanned, count_if(t)::BIGINT AS skipped_by_time,
            count_if(NOT t AND f)::BIGINT AS skipped_by_field, count_if(NOT t AND NOT f AND b)::BIGINT AS skipped_by_bloom,
            (SELECT count(*) FROM placed JOIN layers USING (chunk_id) WHERE NOT t AND NOT f AND NOT b AND contains(raw, 'error')) AS matches FROM layers""",
        "export_records": f"WITH {JSON_LOG} SELECT {RECORD} FROM json_log",
        "export_plain": f"WITH {PLAIN_LOG} SELECT '' AS timestamp, '' AS level, '' AS \"user\", '' AS ip, '' AS action, '' AS message, regexp_replace(raw, '[\\r\\n]+$', '') AS raw FROM plain_log WHERE raw <> ''",
        "export_time_window": ALL + f" SELECT {RECORD} FROM placed JOIN zones USING (chunk_id) WHERE max_ts >= {FROM} AND min_ts <= {TO}",
        "export_time_window_exact": ALL + f" SELECT {RECORD} FROM placed WHERE {EPOCH} BETWEEN {FROM} AND {TO}",
        "export_stats": ALL + f""" SELECT (SELECT count(*) FROM placed JOIN zones USING (chunk_id) WHERE max_ts >= {FROM} AND min_ts <= {TO}) AS lines,
          count_if(max_ts >= {FROM} AND min_ts <= {TO})::BIGINT AS chunks, count_if(NOT (max_ts >= {FROM} AND min_ts <= {TO}))::BIGINT AS skipped FROM zones""",
        "csv_quoted": f"WITH {JSON_LOG} SELECT line_no, '\"' || replace(raw, '\"', '\"\"') || '\"' AS cell FROM json_log",
        "hash_chain": CHAIN + " SELECT seq, chunk_hash FROM chained",
        "verify_clean": _verdict("VERIFIED", N, "NULL", "", NONE, NONE, f"left({HEAD}, 16)"),
        "verify_tampered": _verdict(
            "TAMPERED", N, "1", "chunk", "(SELECT left(chunk_hash, 16) FROM chained WHERE seq = 1)",
            "(SELECT left(sha256(unhex(c.chunk_hash) || encode('#' || substr(b.raw, 2))), 16) FROM chained c JOIN bodies b ON b.seq = 1 WHERE c.seq = 0)", NONE),
        "verify_zeroed_hash": _verdict("TAMPERED", N, "0", "chunk", "repeat('0', 16)", "(SELECT left(chunk_hash, 16) FROM chained WHERE seq = 0)", NONE),
        "verify_footer_mismatch": _verdict("TAMPERED", N + " + 1", "NULL", "footer", f"left({HEAD}, 16)", f"left({HEAD}, 16)", NONE),
        "logz_roundtrip": SLICES + ", " + chained() + """ SELECT chunk_id, strlen(raw) AS orig_size, min_ts, max_ts, chunk_hash, sha256(raw) AS digest
          FROM bodies JOIN zones USING (chunk_id) JOIN chained USING (seq)""",
        "logz_pruned": SLICES + ", " + TEXT_BITS + ", " + _may_hold("text_bits", 8192, "u7", "held") + f""" SELECT chunk_id, strlen(raw) AS orig_size
          FROM bodies JOIN zones USING (chunk_id) JOIN held USING (chunk_id) WHERE max_ts >= {FROM} AND min_ts <= {TO}""",
        "restore_digest": "WITH " + placed() + ", " + BODIES + " SELECT seq // 16 AS block, sha256(string_agg(raw, '' ORDER BY seq)) AS digest, sum(strlen(raw))::BIGINT AS bytes FROM bodies GROUP BY 1",
        "append_chain": HALVES + ", " + chained() + " SELECT seq, chunk_hash FROM chained",
        "append_union": HALVES + " SELECT seq, strlen(raw) AS bytes FROM bodies",
        "archive_stats": ALL + """ SELECT 'json_log' AS archive_id, count(DISTINCT chunk_id) AS chunks, count(*) AS lines, sum(strlen(raw) + 1)::BIGINT AS bytes,
          round(count(DISTINCT chunk_id) * 1600 * 100 / sum(strlen(raw) + 1), 4)::DOUBLE AS index_percent FROM placed""",
        "retention_plan": f"""WITH {OBJECTS} SELECT name, bucket, key, CASE WHEN lock_mode <> '' AND floor(days) > 0 THEN 'OK_LOCKED'
            WHEN lock AND 1735689600 < modified + retention_days * 86400 THEN 'LOCK' WHEN 1735689600 >= modified + retention_days * 86400 THEN 'DELETE' ELSE 'OK_UNLOCKED' END AS action
          FROM locked JOIN streams USING (bucket) WHERE regexp_matches(key, regex)""",
        "lock_status": f"""WITH {OBJECTS} SELECT bucket, key, CASE WHEN lock_mode <> '' AND floor(days) > 0
          THEN 'LOCKED — ' || lock_mode || ' mode, retain until ' || until ELSE 'NOT LOCKED' END AS status FROM locked""",
        "s3_url_parse": f"WITH {OBJECTS} SELECT 's3://' || bucket || '//' || key AS url, bucket, key FROM objects",
        "glob_match": f"WITH {OBJECTS} SELECT name, count(*) AS n FROM objects JOIN streams ON regexp_matches(key, regex) GROUP BY name",
    }
    found |= {
        "archive_create": found["archive_stats"], "archive_append": found["append_chain"],
        "archive_stream": f"WITH {SYSLOG_LOG} SELECT raw FROM syslog_log",
        "utf8_replaced": f"WITH {SYSLOG_LOG} SELECT raw || chr(65533) AS raw FROM syslog_log",
        "export_csv": found["export_records"], "export_jsonl": found["export_records"],
        "verify_index": "SELECT 'json_log' AS archive_id, 'VERIFIED' AS index_status, NULL::BIGINT AS bad_entry",
        "verify_index_tampered": "SELECT 'json_log' AS archive_id, 'TAMPERED' AS index_status, 1::BIGINT AS bad_entry",
        "policy_streams": """SELECT * FROM (VALUES ('audit', 's3://logs/audit/*.logz', 2555::BIGINT, true, 'logs/audit/'), ('app', 's3://logs/app/*.logz', 9000, false, 'logs/app/'),
          ('all', 's3://other/*/*', 30, true, 'other/'), ('new', 's3://logs/app/*.log', 20000, true, 'logs/app/')) AS s(name, pattern, retention_days, lock, listed)""",
        "retention_actions": f"SELECT action, count(*) AS n FROM ({found['retention_plan']}) GROUP BY action",
        "url_encoded": f"WITH {OBJECTS}, keys AS (SELECT key || ' é+~*%/' || bucket AS key FROM objects) SELECT key, replace(url_encode(key), '%2F', '/') AS encoded FROM keys",
    }
    for name in ("djb2", "fnv1a", "sdbm"):
        found[name] = f"WITH {CHAT_LOG}, words AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM chat_log) SELECT token, {name} AS hash FROM (SELECT token, {_hashes('token')} FROM words)"
    return found
