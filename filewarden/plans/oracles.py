"""The registered queries as SQL for an independent engine, over the same tables."""

from __future__ import annotations

from filewarden.plans import corpus as cp
from filewarden.plans import queries as q
from filewarden.sources import catalogue as cat


def _s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_s(v) for v in values) + "]"


def _pick(values, number: str) -> str:
    return f"{_list(values)}[1 + ({number}) % {len(values)}]"


def _re2(pattern: str) -> str:
    """Our regexes in the RE2 dialect: inline flags and the word start differ."""
    pattern = pattern.replace("(?di)", "(?i)").replace("(?d)", "")
    return pattern.replace(cat.WORD_START, r"\b")


_FOLDER = "CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN {_s(v)}" for k, v in cp.FOLDERS.items()) + " ELSE lang END"

FILES = f"""files AS (
  SELECT '/site/' || source || '/' || ({_FOLDER}) || '/' || doc_id || '.' || {_pick(cp.EXTENSIONS, "doc_id")} AS path,
         CASE WHEN doc_id % 3 = 0 THEN line || chr(10) || text ELSE text || chr(10) || line END AS content, doc_id AS file_no
  FROM (SELECT *, {_pick(cp.AROUND, "doc_id // 20")} || {_pick(cp.SNIPPETS, "doc_id")} || {_pick(cp.AROUND, "doc_id // 20 + 2")} AS line FROM documents)
  UNION ALL
  SELECT '/web/' || regexp_extract(url, '://([^/]+)', 1) || '/' || page_id || '.html', html, page_id FROM pages)"""

PLAIN = """plain AS (
  SELECT '/doc/' || doc_id AS path, text AS content FROM documents
  UNION ALL SELECT '/page/' || page_id, html FROM pages)"""

_EXTENSION = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"
_FOLDER_OK = " AND ".join(
    f"strpos(regexp_replace(path, '/[^/]*$', ''), {_s(x)}) = 0"
    for x in (
        "wp-content/cache",
        "wp-content/backup",
        "wp-content/uploads",
        "wp-admin/includes",
        "wp-includes",
        ".git",
        "node_modules",
        "vendor",
    )
)
_SELECTED = f"{_EXTENSION} IN ('php','js','html','htm','css') AND {_FOLDER_OK}"

_CHUNKS = rf"""{FILES}, chunks0 AS (
  SELECT path, sha256(content) AS sha256, regexp_extract(path, '\.([^./]*)$', 1) AS file_type, encode(content) AS bytes FROM files),
chunks AS (
  SELECT path, sha256, file_type, chunk, bytes[chunk * 3800 + 1:chunk * 3800 + 4000] AS part
  FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((octet_length(bytes) - 200) / 3800) AS BIGINT), 1))) AS chunk FROM chunks0))"""

_LINE = (
    "CASE WHEN p = 0 THEN 0 ELSE length(substring(content, 1, p - 1)) "
    "- length(replace(substring(content, 1, p - 1), chr(10), '')) + 1 END"
)
_CONTEXT = "substring(content, greatest(p - 100, 1), p + length(m) + 100 - greatest(p - 100, 1))"


def _match_rule(rule: cat.Rule, files: str) -> str:
    pattern = _s(_re2(rule.pattern))
    found = (
        f"SELECT path, content, file_no, m, strpos(content, m) AS p FROM (SELECT path, content, file_no, "
        f"regexp_extract(content, {pattern}, 0) AS m FROM {files} WHERE regexp_matches(content, {pattern}))"
    )
    if rule.layer == "function":
        fired = " OR ".join(f"regexp_matches(ctx, {_s(p)})" for p in cat.FUNCTION_CONTEXT[rule.name])
        confidence = f"{cat.FUNCTION_BASE_CONFIDENCE}::DOUBLE" + "".join(
            f" + CASE WHEN regexp_matches(ctx, {_s(p)}) THEN {w}::DOUBLE ELSE 0::DOUBLE END"
            for p, w in cat.FUNCTION_CONFIDENCE_WEIGHTS
        )
        found = f"SELECT * FROM (SELECT *, {_CONTEXT} AS ctx FROM ({found})) WHERE {fired}"
        shown, confidence = "ctx", f"least({confidence}, 1::DOUBLE)"
    else:
        shown, confidence = "m", f"{rule.confidence}::DOUBLE"
    return (
        f"SELECT path, content, file_no, {rule.rule_ord} AS rule_ord, {_s(rule.type)} AS type, {_s(rule.severity)} AS severity, "
        f"{_s(rule.description)} AS description, {confidence} AS confidence, substring({shown}, 1, 200) AS evidence, "
        f"{_LINE} AS line_number FROM ({found})"
    )


def _whole_matches() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT path, {_s(r.name)} AS name, {_s(r.severity)} AS severity, regexp_extract(content, {_s(_re2(r.pattern))}, 0) AS m "
        f"FROM files WHERE regexp_matches(content, {_s(_re2(r.pattern))})"
        for r in cat.default_signatures()
    )


def _rules(rules, files: str = "files") -> str:
    return "\nUNION ALL\n".join(_match_rule(r, files) for r in rules)


_TRIMMED = (
    "CASE WHEN right(head, 1) = '-' THEN left(head, length(head) - 1) ELSE head END"
)
OBFUSCATION = f"""obf0 AS (
  SELECT *, CASE WHEN left(content, 1) IN ('''', '-') THEN substring(content, 2) ELSE content END AS head FROM files),
obf1 AS (
  SELECT path, content, file_no,
    len(regexp_extract_all(content, '[A-Za-z0-9+/=]{{50,}}')) AS long_runs,
    len(regexp_extract_all(content, '\\\\x[0-9A-Fa-f]{{2}}')) AS hex_escapes,
    len(regexp_extract_all(content, 'str_rot13|base64_decode|gzinflate|gzuncompress')) AS decoder_names,
    len(regexp_extract_all({_TRIMMED}, '[A-Za-z''-]+')) AS words,
    octet_length(encode(content)) AS bytes
  FROM obf0),
obf AS (
  SELECT *, least(long_runs * 0.1::DOUBLE + hex_escapes * 0.05::DOUBLE + decoder_names * 0.2::DOUBLE
    + CASE WHEN bytes::DOUBLE / (words + 1)::DOUBLE > 20 THEN 0.3::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE) AS score
  FROM obf1)"""

_BEHAVIOUR = " + ".join(
    f"CASE WHEN regexp_matches(content, {_s(_re2(p))}) THEN {w}::DOUBLE ELSE 0::DOUBLE END" for p, w in cat.BEHAVIOURS
)
BEHAVIOUR = f"beh AS (SELECT path, content, file_no, least({_BEHAVIOUR}, 1::DOUBLE) AS score FROM files)"

_SHORT = r"regexp_replace(CAST(round(score, 2) AS VARCHAR), '\.0$', '')"
_ALL_RULES = [*cat.default_signatures(), *cat.function_rules(), *cat.HEURISTICS, *cat.PATTERNS]

LOCAL = f"""{FILES},
{OBFUSCATION},
{BEHAVIOUR},
local_threats AS (
{_rules(_ALL_RULES)}
UNION ALL
SELECT path, content, file_no, {cat.OBFUSCATION_ORD}, 'obfuscated_code', 'medium', 'Heavily obfuscated code detected', score,
  'High obfuscation score: ' || {_SHORT}, 0 FROM obf WHERE score > 0.7::DOUBLE
UNION ALL
SELECT path, content, file_no, {cat.BEHAVIOUR_ORD}, 'malicious_behavior', 'high', 'Code exhibits malicious behavioral patterns', score,
  'Behavioral analysis score: ' || {_SHORT}, 0 FROM beh WHERE score > 0.6::DOUBLE)"""

_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def _ranked(threats: str, threshold: float = 0.5) -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_RANK} DESC, confidence DESC, rule_ord) AS rank
  FROM {threats} WHERE confidence >= {threshold}::DOUBLE)"""


_THREAT_COLUMNS = (
    "path, sha256(content) AS file_hash, rank, type, severity, confidence, evidence, line_number, {source} AS source"
)
_STORED = "CAST(CAST(CAST(confidence AS DECIMAL(9,6)) AS DECIMAL(3,2)) AS DOUBLE)"

RESULTS = f"""{LOCAL},
{_ranked("local_threats")},
results AS (
  SELECT sha256('scan_' || (file_no % 5) || '|' || path || '|' || rule_ord) AS id, 'scan_' || (file_no % 5) AS scan_id,
    path AS file_path, sha256(content) AS file_hash, type AS threat_type, severity AS threat_severity,
    description AS threat_description, {_STORED} AS confidence_score, {_pick(cp.STATUSES, "file_no")} AS status,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(file_no % 30 AS INTEGER)) AS detected_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(file_no % 30 AS INTEGER)) AS updated_at
  FROM ranked)"""


def _time(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {alias or column}"


_RESULT_COLUMNS = (
    "id, scan_id, file_path, file_hash, threat_type, threat_severity, threat_description, confidence_score, status, "
    + _time("detected_at")
    + ", "
    + _time("updated_at")
)

_LABELLED = f"""{FILES},
labelled AS (
  SELECT f.file_no, f.content, sha256(f.content) AS sha256, l.toxic, l.quality
  FROM files f JOIN labels l ON l.doc_id = f.file_no WHERE f.path LIKE '/site/%')"""

REPUTATION = """reputation AS (
  SELECT sha256, max(toxic * (file_no % 10)) AS malicious, max(file_no % 6) AS clean, max(file_no % 3) AS suspicious,
    max(file_no % 4) AS undetected
  FROM labelled GROUP BY sha256),
rep_threats AS (
  SELECT f.path, f.content, f.file_no, {ord} AS rule_ord, 'virustotal_detection' AS type,
    CASE WHEN malicious > 5 THEN 'critical' WHEN malicious > 2 THEN 'high' ELSE 'medium' END AS severity,
    'VirusTotal detected malware: ' || malicious || '/' || (malicious + clean + suspicious + undetected)
      || ' engines flagged this file' AS description,
    least(malicious::DOUBLE / greatest(malicious + clean + suspicious + undetected, 1)::DOUBLE * 1.5::DOUBLE, 1::DOUBLE) AS confidence,
    'File hash: ' || r.sha256 AS evidence, 0 AS line_number, 'VirusTotal' AS source
  FROM files f JOIN reputation r ON r.sha256 = sha256(f.content) WHERE malicious > 0)""".replace(
    "{ord}", str(cat.REPUTATION_ORD)
)

MODEL = """model AS (
  SELECT sha256, min(file_no) AS n, arg_min(quality, file_no) AS quality FROM labelled GROUP BY sha256),
model_threats AS (
  SELECT f.path, f.content, f.file_no, {ord} AS rule_ord, 'openai_detection' AS type,
    CASE WHEN n % 7 = 0 THEN 'medium' ELSE ['low','medium','high','critical','low'][1 + n % 5] END AS severity,
    CASE WHEN n % 3 = 0 THEN 'OpenAI detected potential malware' ELSE 'case ' || n END AS description,
    CASE WHEN n % 4 = 0 THEN 70 ELSE 50 + n % 50 END::DOUBLE / 100::DOUBLE AS confidence,
    'AI analysis' AS evidence, 0 AS line_number, 'OpenAI' AS source
  FROM files f JOIN model ON model.sha256 = sha256(f.content) WHERE quality = 0)""".replace("{ord}", str(cat.MODEL_ORD))

_FULL_LOCAL = LOCAL.replace(FILES, _LABELLED)
_WITH_SOURCE = "SELECT *, NULL AS source FROM local_threats WHERE confidence >= 0.5::DOUBLE"

SNAPSHOTS = f"""{PLAIN}, numbered AS (
  SELECT path, content, CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) AS n FROM plain WHERE content IS NOT NULL),
base AS (
  SELECT CASE WHEN n % 17 = 0 THEN '/old' || path ELSE path END AS path, sha256(content) AS sha256 FROM numbered),
cur AS (
  SELECT CASE WHEN n % 13 = 0 THEN '/new' || path ELSE path END AS path,
    sha256(CASE WHEN n % 7 = 0 THEN content || '!' ELSE content END) AS sha256 FROM numbered)"""

LISTINGS = f"""{FILES}, sized AS (
  SELECT path, file_no AS n, octet_length(encode(content)) AS size, TIMESTAMP '2024-01-01' + to_seconds(file_no) AS mtime FROM files WHERE content IS NOT NULL),
base AS (SELECT CASE WHEN n % 17 = 0 THEN '/old' || path ELSE path END AS path, size, mtime FROM sized),
cur AS (SELECT CASE WHEN n % 13 = 0 THEN '/new' || path ELSE path END AS path, size + CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS size,
  CASE WHEN n % 5 = 0 THEN mtime + INTERVAL 1 SECOND ELSE mtime END AS mtime FROM sized)"""

AUDIT = """audit AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_type, 'event ' || event_id AS description,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'critical' ELSE 'info' END AS severity,
    user_id, props AS metadata, ts AS created_at
  FROM events)"""
_AUDIT_COLUMNS = "id, event_type, description, severity, user_id, metadata, " + _time("created_at")
_ACTION = q.ACTION_TIME.strftime("%Y-%m-%d %H:%M:%S")
_ACTION_NAME = q.ACTION_TIME.strftime("%Y-%m-%d_%H-%M-%S")
_AS_OF = f"TIMESTAMP '{q.AS_OF}'"

_SEVERITY_SUMS = ", ".join(
    f"CAST(count(*) FILTER (WHERE threat_severity = '{s}') AS BIGINT) AS {s}_threats" for s in ("critical", "high", "medium", "low")
)
_STATS = f"""stats AS (
  SELECT count(*) FILTER (WHERE status = 'active') AS total_threats,
    {", ".join(f"count(*) FILTER (WHERE status = 'active' AND threat_severity = '{s}') AS {s}_threats" for s in ("critical", "high", "medium", "low"))},
    count(DISTINCT CASE WHEN detected_at >= {_AS_OF} - INTERVAL 7 DAY THEN scan_id END) AS recent_scans
  FROM results)"""


def _summary(rows: str) -> str:
    return f"""summary AS (
  SELECT scan_id, count(*) AS total_threats, {_SEVERITY_SUMS}, count(DISTINCT file_path) AS affected_files FROM {rows} GROUP BY scan_id),
types AS (
  SELECT scan_id, '{{' || string_agg('"' || threat_type || '":' || n, ',' ORDER BY threat_type) || '}}' AS threat_types
  FROM (SELECT scan_id, threat_type, count(*) AS n FROM {rows} GROUP BY ALL) GROUP BY scan_id)"""


_NEWEST = "SELECT * FROM results {where} ORDER BY detected_at DESC, id LIMIT {n}"


def _newest(n: int) -> str:
    return f"WITH {RESULTS}\nSELECT {_RESULT_COLUMNS} FROM ({_NEWEST.format(where='', n=n)})"


_ADMIT = f"""calls AS (
  SELECT event_id AS call_id, event_type AS api, CAST(floor(epoch(ts)) AS BIGINT) AS s,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k
  FROM events),
steps(call_id, api, k, live, accepted) AS (
  SELECT call_id, api, k, [s], TRUE FROM calls WHERE k = 1
  UNION ALL
  SELECT call_id, api, k, CASE WHEN ok THEN list_append(kept, s) ELSE kept END, ok FROM (
    SELECT *, len(kept) < CASE WHEN api = 'error' THEN 3 ELSE {q.ADMISSION_LIMIT} END AS ok FROM (
      SELECT c.call_id, c.api, c.k, c.s, list_filter(p.live, lambda x: c.s - x < {q.ADMISSION_WINDOW}) AS kept
      FROM steps p JOIN calls c ON c.api = p.api AND c.k = p.k + 1)))"""

FLAGGED = f"""{RESULTS},
flagged AS (
  SELECT file_path AS path, arg_min(threat_description, id) AS reason FROM results
  WHERE threat_severity = 'critical' GROUP BY file_path),
quarantined AS (
  SELECT g.path AS file_path, f.content, g.reason,
    'quarantine/{_ACTION_NAME}_' || left(md5(g.path), 8) || '_' || regexp_extract(g.path, '([^/]*)$', 1) AS backup_path
  FROM flagged g JOIN files f ON f.path = g.path)"""

_PLACEHOLDER = (
    f"'<?php' || chr(10) || '/*' || chr(10) || ' * QUARANTINED FILE - {q.ALERTS.site_name}' || chr(10) || ' *' || chr(10) "
    f"|| ' * Original file: ' || f.path || chr(10) || ' * Quarantined: {_ACTION}' || chr(10) || ' * Reason: ' || g.reason || chr(10) "
    f"|| ' *' || chr(10) || ' * Contact: {q.ALERTS.admin_email}' || chr(10) || ' * The original can be restored from quarantine.' "
    "|| chr(10) || ' */' || chr(10) || 'exit(''This file is in quarantine.'');' || chr(10)"
)

STORE = f"""{FILES},
store AS (
  SELECT path || '#' || c AS id, path AS file_path, content || 'copy ' || c AS content, file_no,
    CASE c WHEN 1 THEN TIMESTAMP '2024-01-03 00:00:00' ELSE TIMESTAMP '2024-01-09 00:00:00' END AS quarantined_at,
    (file_no + c) % 3 = 0 AS restored
  FROM files, (VALUES (1), (2)) AS v(c)),
newest AS (
  SELECT file_path AS path, arg_max(id, quarantined_at) AS id, arg_max(content, quarantined_at) AS content
  FROM store WHERE NOT restored GROUP BY file_path)"""

_CLEANED = (
    r"regexp_replace(regexp_replace(regexp_replace(content, 'eval\s*\([^)]*\)+;?', '', 'g'), '<\?php|\?>', '', 'g'), "
    "'(?i)COINHIVE', '', 'g')"
)
CLEANED = f"""{FILES},
cleaned AS (
  SELECT path, content, file_no, {_CLEANED} AS result FROM files)"""
_BACKUP = (
    f"'quarantine/backup_{_ACTION_NAME}_' || left(md5(path), 8) || '_' || regexp_extract(path, '([^/]*)$', 1)"
)


def _alert(subject: str, lines: list[str]) -> str:
    body = " || chr(10) || ".join([*lines, "''", _s(f"See {q.ALERTS.dashboard_url}")])
    return (
        f"{_s(q.ALERTS.notification_email)} AS recipient, "
        f"{_s(f'[{q.ALERTS.site_name}] filewarden: {subject}')} AS subject, {body} AS body"
    )


def _config(modulus: int, day: str) -> str:
    return (
        f"SELECT CASE WHEN c_custkey % {modulus} = 0 THEN 'key_' ELSE 'day{modulus}_' END || c_custkey AS config_key, "
        f"'{{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment "
        f"|| '\",\"day\":\"{day}\"}}' AS config_value, TIMESTAMP '{day} 00:00:00' AS updated_at FROM customer"
    )


_DEFAULT_RULES = ", ".join(
    f"({cat.SIGNATURE_ORD + i}, {_s(n)}, {_s(p)}, {_s(sev)}, {_s(d)})" for i, (n, p, sev, d) in enumerate(cat.SIGNATURES)
)
RULES = f"""old AS (SELECT * FROM (VALUES {_DEFAULT_RULES}) AS v(rule_ord, name, pattern, severity, description)),
new AS (
  SELECT p_partkey AS rule_ord,
    CASE WHEN p_partkey BETWEEN 0 AND 7 THEN {_list(n for n, *_ in cat.SIGNATURES)}[1 + p_partkey] ELSE 'part_' || p_partkey END AS name,
    '/' || p_brand || '/i' AS pattern, 'low' AS severity, p_name AS description
  FROM part),
merged AS (
  SELECT COALESCE(old.rule_ord, (SELECT max(rule_ord) FROM old) + 1 + new.rule_ord - (SELECT min(rule_ord) FROM new)) AS rule_ord,
    COALESCE(new.name, old.name) AS name, COALESCE(new.pattern, old.pattern) AS pattern,
    COALESCE(new.severity, old.severity) AS severity, COALESCE(new.description, old.description) AS description
  FROM old FULL JOIN new ON old.name = new.name)"""

_EVENT = "event_type, description, severity, metadata, {at}"


_BAND = (
    "CASE WHEN entropy < 4 THEN 'structured' WHEN entropy < 6 THEN 'normal' WHEN entropy < 7 THEN 'monitor' "
    "WHEN entropy <= 7.5 THEN 'warning' ELSE 'alert' END"
)
_ALERT = "round((entropy - 7.5) / 2, 4)"
_BINARY = """bin AS (
  SELECT '/bin/' || doc_id || '.php' AS path, array_to_string(list_transform(range(1, [1, 2, 4, 8, 32][1 + doc_id % 5] + 1),
    lambda i: sha256(i || ':' || coalesce(text, ''))), '') AS hex FROM documents),
hist AS (SELECT path, b, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(hex, '..')) AS b FROM bin) GROUP BY path, b),
ent AS (
  SELECT path, any_value(file_hash) AS file_hash, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0 AS entropy
  FROM hist JOIN (SELECT path, sha256(unhex(hex)) AS file_hash FROM bin) USING (path) GROUP BY path)"""


def oracle_queries() -> dict[str, str]:
    threat_columns = _THREAT_COLUMNS.format(source="CAST(NULL AS VARCHAR)")
    hit_columns = "path, type, severity, description, confidence, evidence, line_number"
    entropy = f"""WITH {PLAIN},
hist AS (
  SELECT path, b, count(*) AS n FROM (
    SELECT path, unnest(regexp_extract_all(hex(encode(content)), '..')) AS b FROM plain) GROUP BY path, b),
ent AS (
  SELECT path, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0 AS entropy FROM hist GROUP BY path),
filled AS (SELECT plain.path, COALESCE(ent.entropy, 0) AS entropy FROM plain LEFT JOIN ent ON ent.path = plain.path)
"""
    event_at = _time("created_at")
    action_at = f"'{_ACTION}' AS created_at"
    queries = {
        "flagged_severities": f"""WITH {LOCAL}, {_ranked(f"(SELECT * FROM local_threats WHERE {_SELECTED})")}
SELECT severity, count(*) AS threats, count(DISTINCT path) AS files FROM ranked GROUP BY severity""",
        "corpus_select": f"WITH {FILES} SELECT path, octet_length(encode(content)) AS size FROM files WHERE {_SELECTED}",
        "content_hash_dups": f"""WITH {PLAIN} SELECT sha256(content) AS sha256, count(*) AS copies, min(path) AS first_path
FROM plain GROUP BY 1 HAVING count(*) > 1""",
        "content_copies": f"""WITH {PLAIN}, h AS (SELECT path, sha256(content) AS sha256 FROM plain)
SELECT path, h.sha256, copies FROM h JOIN (SELECT sha256, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1) d
ON d.sha256 = h.sha256""",
        "content_folders": """SELECT sha256(text) AS sha256, count(*) AS copies, count(DISTINCT source) AS folders
FROM documents GROUP BY 1 HAVING count(*) > 1""",
        "signature_hits": f"WITH {FILES}, t AS ({_rules(cat.default_signatures())}) SELECT {hit_columns} FROM t",
        "function_hits": f"WITH {FILES}, t AS ({_rules(cat.function_rules())}) SELECT {hit_columns} FROM t",
        "heuristic_hits": f"WITH {FILES}, t AS ({_rules(cat.HEURISTICS)}) SELECT {hit_columns} FROM t",
        "pattern_hits": f"WITH {FILES}, t AS ({_rules(cat.PATTERNS)}) SELECT {hit_columns} FROM t",
        "obfuscation_scores": f"""WITH {FILES}, {OBFUSCATION}
SELECT path, long_runs, hex_escapes, decoder_names, words, score AS obfuscation_score,
  CASE WHEN score < 0.3::DOUBLE THEN 'none' WHEN score < 0.5::DOUBLE THEN 'low' WHEN score <= 0.7::DOUBLE THEN 'medium' ELSE 'alert' END AS obfuscation_band,
  score > 0.7::DOUBLE AS is_obfuscated FROM obf""",
        "behaviour_scores": f"""WITH {FILES}, {BEHAVIOUR}
SELECT path, score AS behaviour_score, score > 0.6::DOUBLE AS is_malicious FROM beh""",
        "byte_entropy": entropy
        + """SELECT path, entropy, CASE WHEN entropy < 4 THEN 'structured' WHEN entropy < 6 THEN 'normal'
WHEN entropy < 7 THEN 'monitor' WHEN entropy <= 7.5 THEN 'warning' ELSE 'alert' END AS entropy_band FROM filled""",
        "binary_entropy": f"WITH {_BINARY} SELECT path, entropy, {_BAND} AS entropy_band, CASE WHEN entropy > 7.5 THEN {_ALERT} END AS alert_confidence FROM ent",
        "binary_threats": f"WITH {_BINARY} SELECT path, file_hash, 'medium' AS severity, {_ALERT} AS confidence, 0 AS line_number FROM ent WHERE {_ALERT} >= 0.1 AND entropy > 7.5",
        "histogram_entropy": entropy + "SELECT path, entropy FROM filled",
        "byte_histogram": entropy
        + "SELECT path, CAST(('0x' || b) AS BIGINT) AS byte_value, n FROM hist",
        "scan_threats": f'WITH {LOCAL}, {_ranked("local_threats")} SELECT {threat_columns} FROM ranked',
        "scan_threats_low_threshold": f'WITH {LOCAL}, {_ranked("local_threats", 0.1)} SELECT {threat_columns} FROM ranked',
        "top_threat": f"""WITH {LOCAL}, {_ranked("local_threats")}
SELECT path, type, severity, confidence, line_number FROM ranked WHERE rank = 1""",
        "reputation_join": f"""WITH {_FULL_LOCAL}, {REPUTATION},
both_ AS ({_WITH_SOURCE} UNION ALL SELECT * FROM rep_threats), {_ranked("both_")}
SELECT {_THREAT_COLUMNS.format(source="source")} FROM ranked WHERE source IS NOT NULL""",
        "verdict_join": f"""WITH {_FULL_LOCAL}, {MODEL},
both_ AS ({_WITH_SOURCE} UNION ALL SELECT * FROM model_threats), {_ranked("both_")}
SELECT path, rank, type, severity, description, confidence, evidence, source FROM ranked WHERE source IS NOT NULL""",
        "full_scan_gated": f"""WITH {_FULL_LOCAL}, {REPUTATION}, {MODEL}, kept AS ({_WITH_SOURCE}),
both_ AS (SELECT * FROM kept UNION ALL SELECT * FROM (SELECT * FROM model_threats UNION ALL SELECT * FROM rep_threats)
  WHERE path IN (SELECT path FROM kept)), {_ranked("both_")}
SELECT {_THREAT_COLUMNS.format(source="source")} FROM ranked""",
        "request_chunks": f"""WITH {_CHUNKS} SELECT path, sha256, file_type, chunk, octet_length(part) AS sample_bytes, md5(part) AS sample_md5 FROM chunks""",
        "request_table": f"""WITH {_CHUNKS} SELECT path, sha256, file_type, count(*) AS chunks, CAST(sum(octet_length(part)) AS BIGINT) AS sent_bytes
FROM chunks GROUP BY ALL""",
        "folded_verdicts": f"""WITH {_CHUNKS}, n AS (SELECT DISTINCT sha256, chunk, CAST('0x' || left(md5(part), 4) AS BIGINT) AS v FROM chunks)
SELECT sha256, arg_max('{{"analysis":{{"is_malicious":' || CASE WHEN v % 3 = 0 THEN 'true' ELSE 'false' END || ',"risk_level":"'
  || ['low', 'medium', 'high', 'critical'][1 + v % 4] || '","confidence":' || (v % 100) || '}}}}',
  CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END * 1000000000 + (v % 4) * 100000000 + (v % 100) * 1000000 - chunk) AS response FROM n GROUP BY sha256""",
        "skipped": f"""WITH {FILES}, s AS (SELECT path, octet_length(encode(content)) AS size, CASE
  WHEN NOT ({_FOLDER_OK}) THEN 'excluded_folder' WHEN {_EXTENSION} NOT IN ('php','js','html','htm','css') THEN 'extension'
  WHEN octet_length(encode(content)) > 3000 THEN 'too_large' WHEN length(path) - length(replace(path, '/', '')) > 4 THEN 'too_deep' END AS reason FROM files)
SELECT path, size, reason FROM s WHERE reason IS NOT NULL""",
        "submit_queue": f"""WITH {_LABELLED} SELECT path, sha256(content) AS sha256, octet_length(encode(content)) AS bytes FROM files
WHERE sha256(content) NOT IN (SELECT sha256 FROM labelled)""",
        "integrity_verify": f"""WITH {SNAPSHOTS} SELECT base.path, base.sha256 AS expected_sha256, cur.sha256 AS current_sha256,
  COALESCE(cur.sha256 = base.sha256, FALSE) AS intact FROM base LEFT JOIN cur ON cur.path = base.path""",
        "integrity_diff": f"""WITH {SNAPSHOTS} SELECT COALESCE(base.path, cur.path) AS path, base.sha256 AS old_sha256, cur.sha256 AS new_sha256,
  CASE WHEN base.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'removed' WHEN base.sha256 <> cur.sha256 THEN 'modified'
  ELSE 'unchanged' END AS change FROM base FULL JOIN cur ON cur.path = base.path""",
        "listing_changes": f"""WITH {LISTINGS} SELECT COALESCE(cur.path, base.path) AS path, COALESCE(cur.size, base.size) AS size,
  strftime(COALESCE(cur.mtime, base.mtime), '%Y-%m-%d %H:%M:%S') AS mtime, CASE WHEN base.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'removed'
  WHEN cur.size = base.size AND cur.mtime = base.mtime THEN 'unchanged' ELSE 'modified' END AS change FROM base FULL JOIN cur ON cur.path = base.path""",
        "listing_to_read": f"""WITH {LISTINGS} SELECT path, size, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM cur
WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.path = cur.path AND base.size = cur.size AND base.mtime = cur.mtime)""",
        "stream_progress": f"""WITH {LOCAL}, {_ranked("local_threats")}
SELECT 'stream' AS run, (SELECT count(*) FROM files WHERE content IS NOT NULL) AS files, count(*) AS threats FROM ranked""",
        "delta_scan": f"""WITH {SNAPSHOTS} SELECT path, sha256 FROM cur WHERE NOT EXISTS
  (SELECT 1 FROM base WHERE base.path = cur.path AND base.sha256 = cur.sha256)""",
        "stream_skip_seen": f"WITH {RESULTS} SELECT file_path, file_hash, threat_type, threat_severity FROM results",
        "stream_audit_rolling": """WITH w AS (
  SELECT 'day' AS span, date_trunc('hour', ts) + to_hours(k) AS e, event_type, ts FROM events, range(1, 25) r(k)
  UNION ALL SELECT 'week', date_trunc('day', ts) + to_days(CAST(k AS INTEGER)), event_type, ts FROM events, range(1, 8) r(k)
)
SELECT span, strftime(e, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'other' END AS severity,
  count(*) AS n FROM w WHERE e <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""",
        "scan_results": f"WITH {RESULTS} SELECT {_RESULT_COLUMNS} FROM results",
        "triage_queue": f"""WITH {RESULTS} SELECT id, CASE threat_severity
  WHEN 'critical' THEN CASE WHEN confidence_score > 0.8 THEN 1 ELSE 2 END WHEN 'high' THEN CASE WHEN confidence_score > 0.8 THEN 3 ELSE 4 END
  WHEN 'medium' THEN CASE WHEN confidence_score > 0.7 THEN 5 ELSE 6 END WHEN 'low' THEN 7 END AS priority,
  CAST(round(confidence_score * 100) AS BIGINT) AS confidence_percent FROM results WHERE status = 'active'""",
        "results_filtered": f"""WITH {RESULTS} SELECT {_RESULT_COLUMNS} FROM results
WHERE scan_id = 'scan_3' AND threat_severity = 'high' AND status = 'active'""",
        "recent_results": _newest(100),
        "scan_history": _newest(10),
        "recent_threats": _newest(5),
        "threat_stats": f"WITH {RESULTS}, {_STATS} SELECT * FROM stats",
        "site_status": f"""WITH {RESULTS}, {_STATS} SELECT CASE WHEN critical_threats > 0 THEN 'critical'
WHEN high_threats > 0 THEN 'warning' ELSE 'safe' END AS site_status FROM stats""",
        "scan_summary": f"""WITH {RESULTS}, {_summary("results")}
SELECT summary.*, threat_types FROM summary JOIN types ON types.scan_id = summary.scan_id""",
        "affected_files": f"WITH {RESULTS} SELECT DISTINCT scan_id, file_path FROM results",
        "type_counts": f"WITH {RESULTS} SELECT scan_id, threat_type, count(*) AS n FROM results GROUP BY ALL",
        "daily_trend": f"""WITH {RESULTS} SELECT strftime(detected_at, '%Y-%m-%d') AS day, threat_severity, count(*) AS threats
FROM results GROUP BY ALL""",
        "most_affected": f"""WITH {RESULTS} SELECT file_path, count(*) AS threats, max(confidence_score) AS max_confidence
FROM results GROUP BY file_path ORDER BY threats DESC, file_path LIMIT 20""",
        "type_severity_rollup": f"""WITH {RESULTS} SELECT threat_severity, threat_type, count(*) AS threats
FROM results GROUP BY ROLLUP (threat_severity, threat_type)""",
        "status_update": f"""WITH {RESULTS}, numbered AS (SELECT *, CAST(('0x' || left(id, 2)) AS BIGINT) AS v FROM results),
updated AS (SELECT * REPLACE (
    CASE WHEN v % 3 <> 0 THEN status WHEN v % 2 = 0 THEN 'ignored' ELSE 'quarantined' END AS status,
    CASE WHEN v % 3 <> 0 THEN updated_at ELSE TIMESTAMP '{_ACTION}' END AS updated_at) FROM numbered)
SELECT {_RESULT_COLUMNS} FROM updated""",
        "retention_results": f"""WITH {RESULTS} SELECT {_RESULT_COLUMNS} FROM results
WHERE NOT (detected_at < TIMESTAMP '2024-02-14' - INTERVAL 30 DAY AND status = 'ignored')""",
        "scan_progress": f"""WITH {FILES}, c AS (SELECT 'scan_' || (file_no % 5) AS scan_id, count(*) AS total_files,
  count(*) FILTER (WHERE file_no % 3 <> 0) AS scanned_files FROM files GROUP BY 1)
SELECT scan_id, total_files, scanned_files, round(scanned_files::DOUBLE / total_files * 100, 2) AS percentage, 3600 AS elapsed_time,
  CAST(round(3600::DOUBLE / scanned_files * (total_files - scanned_files)) AS BIGINT) AS estimated_time FROM c""",
        "scan_outcome": f"""WITH {LOCAL}, {_ranked("local_threats")}
SELECT 'scan_all' AS scan_id, 'completed' AS status, (SELECT count(*) FROM files WHERE {_SELECTED}) AS total_files,
  (SELECT count(*) FROM files WHERE {_SELECTED}) AS scanned_files, (SELECT count(*) FROM ranked WHERE {_SELECTED}) AS threats_found""",
        "config_upsert": f"""WITH a AS ({_config(2, "2024-01-01")}), b AS ({_config(3, "2024-01-02")}),
m AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE config_key NOT IN (SELECT config_key FROM b))
SELECT config_key, config_value, {_time("updated_at")} FROM m""",
        "config_get": f"""WITH a AS ({_config(2, "2024-01-01")})
SELECT 'key_' || c_custkey AS config_key, COALESCE(a.config_value, '{{}}') AS config_value
FROM customer LEFT JOIN a ON a.config_key = 'key_' || c_custkey""",
        "latest_per_key": f"""WITH {AUDIT}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM audit)
SELECT user_id, id, event_type, {event_at} FROM r WHERE rn = 1""",
        "rule_merge": f"WITH {RULES} SELECT rule_ord, name, pattern, severity, description FROM merged",
        "merged_rule_scan": f"""WITH {FILES}, t AS ({_whole_matches()})
SELECT path, name, severity, octet_length(encode(m))::BIGINT AS match_length, sha256(m) AS evidence_hash FROM t
UNION ALL SELECT DISTINCT '/orders/' || l_orderkey || '.txt', 'part_' || l_partkey, 'low',
  length('Item ' || l_partkey || ';')::BIGINT, sha256('Item ' || l_partkey || ';') FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "merged_rule_update": "SELECT 'last_signature_update' AS config_key, '1706745600' AS config_value, 8 + count(*) AS rule_count FROM part",
        "rule_count": f"WITH {RULES} SELECT count(*) AS rule_count FROM merged",
        "audit_page": f"""WITH {AUDIT} SELECT {_AUDIT_COLUMNS} FROM (SELECT * FROM audit WHERE event_type = 'error'
AND created_at >= TIMESTAMP '2024-01-05' ORDER BY created_at DESC, id LIMIT 50 OFFSET 25)""",
        "audit_filter": f"""WITH {AUDIT} SELECT {_AUDIT_COLUMNS} FROM audit WHERE severity = 'warning'
AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'""",
        "audit_stats": f"""WITH {AUDIT} SELECT count(*) AS total_events,
  count(*) FILTER (WHERE created_at >= {_AS_OF} - INTERVAL 24 HOUR) AS last_24h,
  count(*) FILTER (WHERE created_at >= {_AS_OF} - INTERVAL 7 DAY) AS last_7d,
  {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_events" for s in ("info", "warning", "error", "critical"))} FROM audit""",
        "audit_severities": f"WITH {AUDIT} SELECT severity, count(*) AS n FROM audit GROUP BY severity",
        "top_events": f"""WITH {AUDIT} SELECT event_type, count(*) AS n FROM audit GROUP BY event_type
ORDER BY n DESC, event_type LIMIT 10""",
        "audit_retention": f"""WITH {AUDIT}, old AS (SELECT count(*) AS n FROM audit WHERE created_at < TIMESTAMP '2024-01-15')
SELECT event_type, description, severity, user_id, {event_at} FROM audit WHERE created_at >= TIMESTAMP '2024-01-15'
UNION ALL SELECT 'audit_cleanup', 'Cleaned up ' || n || ' old audit log entries', 'info', NULL, '2024-01-25 00:00:00' FROM old WHERE n > 0""",
        "threat_audit_events": f"""WITH {RESULTS} SELECT 'threat_detected' AS event_type,
  'Threat detected: ' || threat_type || ' in ' || file_path AS description,
  CASE WHEN threat_severity IN ('critical', 'high') THEN 'critical' ELSE 'warning' END AS severity,
  '{{"file_path":"' || file_path || '","threat_type":"' || threat_type || '","threat_severity":"' || threat_severity || '"}}' AS metadata,
  {_time("detected_at", "created_at")} FROM results""",
        "scan_audit_events": f"""WITH {RESULTS}, s AS (SELECT scan_id, count(*) AS t, count(DISTINCT file_path) AS f FROM results GROUP BY 1)
SELECT 'scan_started' AS event_type, 'Security scan started (ID: ' || scan_id || ')' AS description, 'info' AS severity,
  '{{"scan_id":"' || scan_id || '","scan_type":"full"}}' AS metadata, {action_at} FROM s
UNION ALL SELECT 'scan_completed', 'Security scan completed (ID: ' || scan_id || ')', CASE WHEN t > 0 THEN 'warning' ELSE 'info' END,
  '{{"scan_id":"' || scan_id || '","files_scanned":' || f || ',"threats_found":' || t || '}}', '{_ACTION}' FROM s""",
        "change_audit_events": f"""SELECT 'settings_changed' AS event_type, 'Security scanner settings updated' AS description, 'info' AS severity,
  '{{"changed_fields":["' || c_name || '","segment_' || c_mktsegment || '"]}}' AS metadata, {action_at} FROM customer
UNION ALL SELECT 'api_key_changed', c_name || ' API key ' || a, 'info', '{{"api_name":"' || c_name || '","action":"' || a || '"}}', '{_ACTION}'
FROM (SELECT c_name, CASE WHEN c_acctbal > 0 THEN 'configured' ELSE 'removed' END AS a FROM customer)""",
        "client_addresses": """WITH e AS (SELECT event_id, '10.' || (user_id % 300) || '.' || (event_id % 256) || '.7' AS address, user_id % 300 < 256 AS good,
  '2001:db8::' || lower(printf('%x', event_id % 65536)) AS v6 FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN good THEN address ELSE 'unknown' END
  WHEN event_id % 5 = 2 THEN 'unknown' WHEN event_id % 3 = 0 THEN v6 WHEN event_id % 3 = 1 THEN 'unknown'
  WHEN event_id % 2 = 0 THEN v6 ELSE 'unknown' END AS user_ip FROM e""",
        "rate_window": f"""SELECT event_id AS call_id, event_type AS api, count(*) OVER (PARTITION BY event_type
  ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN {q.RATE_WINDOW - 1} PRECEDING AND CURRENT ROW) AS calls_in_window FROM events""",
        "remaining_calls": """WITH c AS (SELECT event_type AS api, CAST(floor(epoch(ts)) AS BIGINT) AS s,
  CAST(epoch(TIMESTAMP '2024-01-30 23:30:00') AS BIGINT) AS now FROM events),
g AS (SELECT api, now, count(*) FILTER (WHERE now - s < 7200 AND s <= now) AS n, min(s) FILTER (WHERE now - s < 7200 AND s <= now) AS oldest
  FROM c GROUP BY api, now)
SELECT api, n AS calls_in_window, greatest(0, 10 - n) AS remaining, COALESCE(greatest(0, oldest + 7200 - now), 0) AS reset_seconds FROM g""",
        "admission_control": f"WITH RECURSIVE {_ADMIT} SELECT call_id, api, accepted FROM steps",
        "admission_audit": f"""WITH RECURSIVE {_ADMIT} SELECT 'rate_limit_exceeded' AS event_type,
  'Rate limit exceeded for ' || api || ' API' AS description, 'warning' AS severity, count(*) AS n FROM steps WHERE NOT accepted GROUP BY api""",
        "quarantine_outcomes": f"""WITH {FLAGGED} SELECT id, file_path, 'ok' AS outcome FROM results WHERE threat_severity = 'critical'
UNION ALL SELECT id || 'x', NULL, 'threat_not_found' FROM results WHERE threat_severity = 'critical'""",
        "quarantine_rows": f"""WITH {FLAGGED} SELECT file_path, sha256(content) AS content_hash, backup_path, reason AS quarantine_reason,
  '{_ACTION}' AS quarantined_at FROM quarantined""",
        "quarantine_audit": f"""WITH {FLAGGED} SELECT 'file_quarantined' AS event_type, 'File quarantined: ' || file_path AS description,
  'warning' AS severity, '{{"file_path":"' || file_path || '","reason":"' || reason || '"}}' AS metadata, {action_at} FROM quarantined""",
        "quarantine_status": f"""WITH {FLAGGED} SELECT id, 'quarantined' AS status, '{_ACTION}' AS updated_at FROM results
WHERE threat_severity = 'critical'""",
        "quarantine_alerts": f"""WITH {FLAGGED} SELECT """
        + _alert(
            "file locked away",
            [
                _s("One file was taken out of service. Its content is stored in the quarantine table."),
                "''",
                "'Path = ' || file_path",
                "'Cause = ' || reason",
                f"'At = {_ACTION}'",
            ],
        )
        + " FROM quarantined",
        "quarantine_overlay": f"""WITH {FLAGGED}, o AS (SELECT f.path, CASE WHEN g.path IS NULL THEN f.content ELSE {_PLACEHOLDER} END AS c
  FROM files f LEFT JOIN flagged g ON g.path = f.path)
SELECT path, octet_length(encode(c)) AS size, sha256(c) AS content_hash FROM o""",
        "quarantine_size": f"""WITH {FLAGGED} SELECT CAST(sum(octet_length(encode(content))) AS BIGINT) AS quarantine_bytes FROM quarantined""",
        "restore": f"""WITH {STORE}, asked AS (SELECT path FROM files WHERE file_no % 2 = 0
  UNION ALL SELECT path || '.bak' FROM files WHERE file_no % 2 = 0)
SELECT asked.path, n.id, sha256(n.content) AS content_hash, CASE WHEN n.id IS NULL THEN 'file_not_quarantined' ELSE 'ok' END AS outcome
FROM asked LEFT JOIN newest n ON n.path = asked.path""",
        "restore_marks": f"""WITH {STORE} SELECT id, file_path, {_time("quarantined_at")}, CASE WHEN restored THEN strftime(quarantined_at, '%Y-%m-%d %H:%M:%S')
  WHEN file_no % 2 = 0 AND id IN (SELECT id FROM newest) THEN '{_ACTION}' END AS restored_at FROM store""",
        "restore_overlay": f"""WITH {STORE}, o AS (SELECT f.path, CASE WHEN f.file_no % 2 = 0 AND n.id IS NOT NULL THEN n.content ELSE f.content END AS c
  FROM files f LEFT JOIN newest n ON n.path = f.path)
SELECT path, octet_length(encode(c)) AS size, sha256(c) AS content_hash FROM o""",
        "restore_audit": f"""WITH {STORE} SELECT 'file_restored' AS event_type, 'File restored from quarantine: ' || path AS description,
  'info' AS severity, '{{"file_path":"' || path || '"}}' AS metadata, {action_at} FROM newest""",
        "open_quarantine": f"WITH {STORE} SELECT id, file_path, {_time('quarantined_at')} FROM store WHERE NOT restored",
        "retention_quarantine": f"""WITH {STORE} SELECT id, file_path, {_time('quarantined_at')} FROM store
WHERE NOT (restored AND quarantined_at < TIMESTAMP '2024-04-05' - INTERVAL 90 DAY)""",
        "clean_files": f"""WITH {CLEANED} SELECT path, CASE WHEN result <> content THEN 'ok' ELSE 'no_changes' END AS outcome,
  sha256(result) AS content_hash, CASE WHEN result <> content THEN sha256(content) END AS backup_hash,
  CASE WHEN result <> content THEN {_BACKUP} END AS backup_path FROM cleaned""",
        "clean_status": f"""WITH {RESULTS.replace(FILES, CLEANED)} SELECT id, 'cleaned' AS status, '{_ACTION}' AS updated_at FROM results
WHERE status = 'active' AND file_path IN (SELECT path FROM cleaned WHERE result <> content)""",
        "clean_alerts": f"WITH {CLEANED} SELECT "
        + _alert(
            "code cut out of a file",
            [
                _s("Matches of the given patterns were cut out of one file. Its former content is stored as a backup."),
                "''",
                "'Path = ' || path",
                f"'Patterns applied = {len(q.CLEAN_PATTERNS)}'",
                f"'At = {_ACTION}'",
            ],
        )
        + " FROM cleaned WHERE result <> content",
        "scan_alerts": f"WITH {RESULTS}, s AS (SELECT scan_id, count(*) AS t, count(DISTINCT file_path) AS f FROM results GROUP BY 1) SELECT "
        + _alert(
            "scan with findings",
            [
                _s("The timed scan ended with findings."),
                "''",
                "'Files read = ' || f",
                "'Findings = ' || t",
                "'Scan = ' || scan_id",
                f"'At = {_ACTION}'",
            ],
        )
        + " FROM s",
        "posture_rules": f"""WITH s AS (SELECT c_name AS site, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 = 1 END AS no_edit,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 5 = 1 END AS debug,
  concat_ws('.', c_custkey % 3 + 5, c_custkey % 12, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 END) AS version FROM customer)
SELECT site, 'Built-in file editor is on' AS title,
  'DISALLOW_FILE_EDIT is not true: whoever gets hold of an administrator session can change code on this site.' AS description, 'high' AS severity
FROM s WHERE NOT COALESCE(no_edit, FALSE)
UNION ALL SELECT site, 'Debug output is on', 'WP_DEBUG is not false: visitors may get to see file paths, queries and error texts.', 'medium'
FROM s WHERE COALESCE(debug, TRUE)
UNION ALL SELECT site, 'Core is behind', 'The site runs core ' || version || '; the newest release is {q.LATEST_VERSION}.', 'high'
FROM s WHERE CAST(string_split(version, '.') AS BIGINT[]) < [{q.LATEST_VERSION.replace(".", ", ")}]::BIGINT[]""",
        "protect_roundtrip": "SELECT doc_id, TRUE AS is_encrypted, md5(text) AS text_md5, md5(text) AS plain_md5 FROM documents",
        "stream_scan": f'WITH {LOCAL}, {_ranked("local_threats")} SELECT path, rank, type, severity, confidence, line_number FROM ranked',
        "stream_audit_hours": f"""WITH {AUDIT} SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, event_type, severity,
  count(*) AS n FROM audit GROUP BY ALL""",
        "rolling_audit_day": f"""WITH {AUDIT}, h AS (SELECT date_trunc('hour', created_at) AS hour, event_type, severity, count(*) AS n FROM audit GROUP BY ALL)
SELECT strftime(hour + to_hours(CAST(k + 1 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_end, event_type, severity, CAST(sum(n) AS BIGINT) AS n
FROM h, range(24) AS r(k) GROUP BY ALL""",
        "stream_admission": f"WITH RECURSIVE {_ADMIT} SELECT call_id, api, accepted FROM steps",
    }
    # Stored tables return what the same rows give without a store.
    same = {
        "stored_results": "scan_results",
        "stored_quarantine": "quarantine_rows",
        "rewritten_status": "status_update",
        "rewritten_results": "retention_results",
        "rewritten_quarantine": "retention_quarantine",
        "rewritten_audit": "audit_retention",
        "partial_stats": "threat_stats",
        "partial_summary": "scan_summary",
        "partial_trend": "daily_trend",
    }
    return {
        **queries,
        **{stored: queries[direct] for stored, direct in same.items()},
        "stored_audit": f"WITH {AUDIT} SELECT {_AUDIT_COLUMNS} FROM audit",
        "exported_results": f"""WITH {RESULTS} SELECT {_RESULT_COLUMNS}, format
FROM results, (VALUES ('csv'), ('json'), ('parquet')) AS f(format)""",
    }
