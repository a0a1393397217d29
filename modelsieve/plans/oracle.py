"""The registered queries as DuckDB SQL over the same tables.

Byte formats (pickle, GGUF, SafeTensors) are not decoded here: the expected rows
follow from how the derived views build them, which checks the decoders
independently.
"""

from __future__ import annotations

from modelsieve.functions.cvss import (ATTACK_COMPLEXITY, ATTACK_VECTOR, IMPACT, PRIVILEGES_CHANGED,
                                       PRIVILEGES_UNCHANGED, USER_INTERACTION)
from modelsieve.operators.gguf import STRING_RULES
from modelsieve.operators.intel import BUILTIN_PATTERNS
from modelsieve.operators.literals import PICKLE_RULES, SDK_LITERALS
from modelsieve.operators.safetensors import TEXT_RULES
from modelsieve.operators.signatures import SIGNATURES
from modelsieve.sources.derived import EXTENSIONS, KEYWORDS, PAYLOADS, PICKLE_IMPORTS, STAGES


def lit(value) -> str:
    if value is None:
        return "NULL"
    return "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({names})"


def pick(items, index: str) -> str:
    return "[" + ", ".join(lit(x) for x in items) + f"][({index}) + 1]"


def band_sql(score: str, steps, rest: str, null: str | None = None) -> str:
    cases = f"WHEN {score} IS NULL THEN {lit(null)} "
    cases += " ".join(f"WHEN {score} {op} {b} THEN {lit(label)}" for op, b, label in steps)
    return f"CASE {cases} ELSE {lit(rest)} END"


ENGINE = ([("<=", 0, "clean"), ("<", 40, "suspicious"), ("<", 70, "malicious")], "critical")
SDK = ([("<", 30, "clean"), ("<", 60, "suspicious"), ("<", 85, "malicious")], "critical")
INSPECTOR = ([("<=", 10, "clean"), ("<=", 40, "suspicious"), ("<=", 70, "malicious")], "critical")
BADGE = ([("<", 30, "clean"), ("<", 60, "suspicious"), ("<", 85, "dangerous")], "critical", "unknown")
COLOR = ([("<", 30, "#2ECC71"), ("<", 60, "#E67E22"), ("<", 85, "#E74C3C")], "#C0392B", "#9f9f9f")
CVE = ([(">=", 9, "critical"), (">=", 7, "high"), (">=", 4, "medium")], "low", "none")
VERDICT = ([("<", 30, "SAFE"), ("<", 60, "SUSPICIOUS"), ("<", 85, "DANGEROUS")], "CRITICAL")

SEV = "CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
SCAN_EXTS = [".pkl", ".pickle", ".pt", ".pth", ".gguf", ".safetensors", None]

VIEWS: dict[str, str] = {
    "v_artifacts": f"""
        SELECT doc_id AS artifact_id, 'model_' || doc_id || ext AS filename, ext, payload, body, encode(body) AS content
        FROM (SELECT doc_id, {pick(EXTENSIONS, 'doc_id % 7')} AS ext, {pick(PAYLOADS, 'doc_id % 23')} AS payload,
                     text || ' ' || {pick(PAYLOADS, 'doc_id % 23')} AS body FROM documents)""",
    "v_scans": f"""
        SELECT *, {band_sql('risk_score', *ENGINE)} AS risk_level FROM (
        SELECT event_id::VARCHAR AS scan_id, 'scan_' || event_id || coalesce({pick(SCAN_EXTS, 'event_id % 7')}, '') AS filename,
               floor(value * 1048576)::BIGINT AS file_size, {pick(SCAN_EXTS, 'event_id % 7')} AS file_extension,
               sha256('h' || event_id % 500) AS file_hash,
               CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE (event_id * 37) % 101 END::DOUBLE AS risk_score,
               event_id % 4 AS n_threats,
               list_transform(range(event_id % 4), lambda x: {{'pattern': 'CODE-001', 'severity': 'critical',
                    'description': 'dynamic evaluation', 'location': 'scan_' || event_id, 'category': 'code_execution'}}) AS threats,
               CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE 'SUSPICIOUS' END AS ai_verdict,
               CASE WHEN event_id % 2 = 0 THEN event_id % 101 END AS ai_confidence,
               CASE WHEN event_id % 5 <> 0 THEN user_id::VARCHAR END AS user_id,
               CASE WHEN event_id % 9 <> 0 THEN '10.0.0.' || user_id % 40 END AS ip_address,
               event_id % 10 <> 0 AS is_public, ts AS created_at FROM events)""",
    "v_findings": """
        SELECT l_orderkey AS artifact_id,
               ((l_linenumber::BIGINT * 10000000 + l_partkey) * 1000000 + l_suppkey) * 100 + l_quantity::BIGINT AS ordinal,
               p_type AS pattern, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 5 END AS cvss_score,
               CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 35 THEN 'high'
                    WHEN l_quantity >= 20 THEN 'medium' ELSE 'low' END AS severity, l_linestatus AS category
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_users": """
        SELECT c_custkey::VARCHAR AS id, c_name || '@example.com' AS email, c_name AS username, c_name AS display_name,
               NULL::VARCHAR AS avatar_url, 'github' AS provider, 'p' || c_custkey AS provider_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'FURNITURE' THEN 'enterprise' ELSE 'free' END AS plan
        FROM customer""",
    "v_cves": f"""
        SELECT 'CVE-2024-' || lpad(d.doc_id::VARCHAR, 6, '0') AS cve_id, text AS description,
               CASE WHEN l.doc_id IS NOT NULL THEN (d.doc_id % 101) / 10.0 END::DOUBLE AS cvss_score,
               CASE WHEN d.doc_id % 29 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((d.doc_id % 365)::INT) END AS published_date,
               {pick(KEYWORDS, 'd.doc_id % 9')} AS affected_tech
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # the feed as the parser should see it
    "v_feed_parsed": f"""
        SELECT {pick(KEYWORDS, 'k')} AS keyword, k AS kpos, doc_id AS pos,
               CASE WHEN doc_id % 31 = 0 THEN 'UNKNOWN' ELSE 'CVE-2025-' || lpad(doc_id::VARCHAR, 6, '0') END AS cve_id,
               CASE WHEN lang = 'en' THEN text ELSE 'No description available.' END AS description,
               CASE WHEN doc_id % 4 <> 3 THEN (doc_id % 101) / 10.0 END::DOUBLE AS cvss_score,
               CASE WHEN doc_id % 29 <> 0 THEN TIMESTAMP '2025-01-01' + to_days((doc_id % 365)::INT) END AS published_date
        FROM (SELECT *, unnest([doc_id % 9, (doc_id + 4) % 9]) AS k FROM documents)""",
    "v_iocs": """
        SELECT sha256(text) AS file_hash, 'malicious' AS severity, bool_or(quality = 1) AS is_verified,
               TIMESTAMP '2024-01-01' + to_days((min(d.doc_id) % 365)::INT) AS reported_at
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1 GROUP BY 1""",
    "v_hashes": "SELECT doc_id AS artifact_id, sha256(text) AS file_hash FROM documents",
    "v_webhook_subs": f"""
        SELECT c_custkey AS id, (c_custkey % 150)::VARCHAR AS user_id, 'https://hooks.example/' || c_custkey AS url,
               sha256(c_name) AS secret_token, {pick(['scan.completed', 'threat.critical', 'all'], 'c_custkey % 3')} AS listens,
               c_acctbal > 0 AS is_active FROM customer""",
    "v_webhook_logs": """
        SELECT o_orderkey AS id, o_custkey AS subscription_id,
               CASE WHEN o_orderstatus = 'F' THEN 'threat.critical' ELSE 'scan.completed' END AS event_type,
               CASE WHEN o_orderkey % 8 = 0 THEN 500 ELSE 200 END AS response_status, o_orderdate AS triggered_at
        FROM orders""",
    "v_safetensors": """
        SELECT *, octet_length(encode(header)) AS n_header FROM (
        SELECT doc_id, 'm_' || doc_id || '.safetensors' AS filename, note, 'https://x.example/' || doc_id AS url,
               CASE doc_id % 11 WHEN 1 THEN '{"a": ' WHEN 2 THEN '[1, 2]'
                    WHEN 3 THEN '{"__metadata__":[1],"w":{"dtype":"F32"}}'
                    ELSE '{"__metadata__":{"note":"' || note || '","url":"https://x.example/' || doc_id
                         || '"},"w":{"dtype":"F32"}}' END AS header
        FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')
                     || CASE doc_id % 11 WHEN 6 THEN repeat('ab-', 3400)
                             WHEN 7 THEN ' eval (1) <script x> __import__ (' ELSE '' END AS note FROM documents))""",
    "v_pickles": f"""
        SELECT doc_id AS artifact_id, 'm_' || doc_id || '.pkl' AS filename, module, name, doc_id % 7 = 0 AS cut,
               8 + n AS open_at, 11 + n + length(module) + length(name) AS close_at
        FROM (SELECT doc_id, octet_length(encode(text)) AS n, {pick([m for m, _ in PICKLE_IMPORTS], 'doc_id % 6')} AS module,
                     {pick([n for _, n in PICKLE_IMPORTS], 'doc_id % 6')} AS name FROM documents)""",
    "v_gguf": f"""
        SELECT doc_id AS artifact_id, 'm_' || doc_id || '.gguf' AS filename, 'model-' || doc_id % 50 AS model,
               {pick(PAYLOADS, 'doc_id % 23')} AS template, text FROM documents""",
    "signatures": "SELECT * FROM " + values(
        [(k, s.id, s.category, "(?i)" + s.regex, s.severity, *s.letters(), s.desc) for k, s in enumerate(SIGNATURES)],
        "position, id, category, regex, severity, av, ac, pr, ui, s, c, i, a, description"),
}

DEPENDS = {"scored_signatures": ["signatures"], "hits": ["v_artifacts", "scored_signatures"]}


def _choice(column: str, weights: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {w}::DOUBLE" for k, w in weights.items()) + " END"


def cvss_columns(mode: str = "reference") -> str:
    """SELECT list fragment: cvss_score over columns av..a (see the functions module for the two modes)."""
    pr = f"CASE WHEN s = 'U' THEN {_choice('pr', PRIVILEGES_UNCHANGED)} ELSE {_choice('pr', PRIVILEGES_CHANGED)} END"
    exploit = (f"(8.22::DOUBLE * {_choice('av', ATTACK_VECTOR)} * {_choice('ac', ATTACK_COMPLEXITY)} * ({pr}) "
               f"* {_choice('ui', USER_INTERACTION)})")
    gone = " * ".join(f"(1 - {_choice(x, IMPACT)})" for x in "cia")
    iss = f"(1 - ({gone}))"
    base = f"({iss} - 0.02)" if mode == "spec" else f"({iss} * 0.02::DOUBLE)"
    impact = (f"(CASE WHEN s = 'U' THEN 6.42::DOUBLE * {iss} "
              f"ELSE 7.52::DOUBLE * ({iss} - 0.029) - 3.25::DOUBLE * pow({base}, 15) END)")
    total = f"least(CASE WHEN s = 'U' THEN {impact} + {exploit} ELSE 1.08::DOUBLE * ({impact} + {exploit}) END, 10.0)"
    if mode == "spec":
        n = f"round({total} * 100000)::BIGINT"
        up = f"(CASE WHEN {n} % 10000 = 0 THEN {n} / 100000.0 ELSE ({n} // 10000 + 1) / 10.0 END)"
    else:
        n = f"trunc({total} * 100000)::BIGINT"
        up = f"(({n} + CASE WHEN {n} % 100000 > 0 THEN 10000 ELSE 0 END) // 10000 / 10.0)"
    return f"(CASE WHEN {impact} <= 0 THEN 0.0 ELSE {up} END)::DOUBLE"


CVSS_SEVERITY = ("CASE WHEN cvss_score = 0 THEN 'none' WHEN cvss_score <= 3.9 THEN 'low' WHEN cvss_score <= 6.9 THEN 'medium' "
                 "WHEN cvss_score <= 8.9 THEN 'high' ELSE 'critical' END")
CVSS_VECTOR = "'CVSS:3.1/AV:' || av || '/AC:' || ac || '/PR:' || pr || '/UI:' || ui || '/S:' || s || '/C:' || c || '/I:' || i || '/A:' || a"

VIEWS["scored_signatures"] = f"""
    SELECT *, {CVSS_SEVERITY} AS cvss_severity, {CVSS_VECTOR} AS cvss_vector
    FROM (SELECT *, {cvss_columns()} AS cvss_score FROM signatures)"""
VIEWS["hits"] = """
    SELECT artifact_id, position, id AS pattern_id, category, severity, cvss_score, cvss_vector,
           (list_sum(list_transform(parts[1:k], lambda x: octet_length(encode(x))))
            + coalesce(list_sum(list_transform(found[1:k-1], lambda x: octet_length(encode(x)))), 0))::BIGINT AS offset
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (
          SELECT a.artifact_id, s.*, string_split_regex(body, regex) AS parts, regexp_extract_all(body, regex) AS found
          FROM v_artifacts a JOIN scored_signatures s ON regexp_matches(body, regex)))"""


def sql(body: str, *views: str) -> str:
    """``body`` headed by the CTEs it uses, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in views:
        visit(name)
    head = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " " if order else ""
    return head + body


ORACLE: dict[str, str] = {}

# ---- sources and sinks
ORACLE["artifact_manifest"] = sql("SELECT filename, ext, octet_length(content) AS length FROM v_artifacts", "v_artifacts")
ORACLE["file_hashes"] = sql("""SELECT filename, octet_length(content) AS length, sha256(content) AS file_hash
    FROM v_artifacts""", "v_artifacts")
ORACLE["artifact_chunks"] = sql("""
    SELECT filename, chunk_no, least(1024, octet_length(content) - chunk_no * 1024) AS own_len,
           sha256(content[chunk_no * 1024 + 1 : chunk_no * 1024 + 1024]) AS chunk_hash
    FROM (SELECT filename, content, unnest(range(0, greatest(1, (octet_length(content) + 1023) // 1024))) AS chunk_no
          FROM v_artifacts)""", "v_artifacts")
ORACLE["scan_store_read"] = sql("""SELECT scan_id, filename, file_size, risk_score, n_threats AS n, created_at
    FROM v_scans""", "v_scans")
ORACLE["scan_store_append"] = sql("""SELECT strftime(created_at, '%Y-%m-%d') AS scan_day, count(*) AS scans,
    sum(file_size)::BIGINT AS bytes FROM v_scans GROUP BY 1""", "v_scans")
ORACLE["cve_feed_read"] = sql("""SELECT keyword, count(*) AS items,
    count(DISTINCT CASE WHEN pos % 31 <> 0 THEN cve_id END) AS ids, count(*) FILTER (pos % 4 = 0) AS v31
    FROM v_feed_parsed GROUP BY 1""", "v_feed_parsed")
ORACLE["export_results_json"] = sql("""SELECT scan_id, to_json({'scan_id': scan_id, 'filename': filename,
    'file_size': file_size, 'risk_level': risk_level, 'threats': threats, 'ai_verdict': ai_verdict})::VARCHAR AS document
    FROM v_scans""", "v_scans")

# ---- admission
ORACLE["sanitize_filename"] = r"""
    SELECT doc_id, coalesce(nullif(substring(regexp_replace(regexp_replace(base, '^[\s\v\x1c-\x1f\x85\p{Z}]+|[\s\v\x1c-\x1f\x85\p{Z}]+$', '', 'g'),
           '[\p{C}\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g'), 1, 500), ''), 'unknown') AS clean_name
    FROM (SELECT doc_id, regexp_extract(CASE WHEN doc_id % 13 = 0 THEN 'dir/  ' ELSE
             '../a/ ' || text || chr(9) || chr(10) || doc_id || '.pkl ' END, '[^/]*$') AS base FROM documents)"""
ORACLE["admit_extension"] = sql("""SELECT artifact_id, ext, ext <> '.onnx' AS admitted,
    CASE WHEN ext = '.onnx' THEN 'unsupported extension ''.onnx''' END AS reason FROM v_artifacts""", "v_artifacts")
ORACLE["admit_url"] = f"""
    SELECT page_id, variant, reason IS NULL AS admitted, reason,
           CASE WHEN reason IS NULL THEN page_id || ext END AS filename,
           CASE WHEN reason IS NULL THEN lower(ext) END AS ext
    FROM (SELECT page_id, unnest([0, 1])::BIGINT AS variant, {pick(['.pkl', '.GGUF', '.zip', '.safetensors'], 'page_id % 4')} AS ext,
                 CASE WHEN variant = 0 THEN 'host' WHEN page_id % 5 = 1 THEN 'scheme' WHEN page_id % 5 = 2 THEN 'too_long'
                      WHEN page_id % 5 = 3 THEN 'empty' WHEN page_id % 4 = 2 THEN 'extension' END AS reason
          FROM pages)""".replace("unnest([0, 1])::BIGINT AS variant", "variant").replace(
    "FROM pages", "FROM pages CROSS JOIN (SELECT unnest([0, 1])::BIGINT AS variant)")
ORACLE["quota_admission"] = sql("""
    SELECT scan_id, file_size, plan, size_limit,
           CASE WHEN file_size = 0 THEN 'empty' WHEN file_size > size_limit THEN 'too_large' END AS reason,
           NOT (file_size = 0 OR file_size > size_limit) AS admitted
    FROM (SELECT scan_id, file_size, plan, CASE WHEN u.id IS NULL THEN 52428800 WHEN plan = 'pro' THEN 2147483648
                 ELSE 209715200 END::BIGINT AS size_limit
          FROM v_scans s LEFT JOIN v_users u ON s.user_id = u.id)""", "v_scans", "v_users")
ORACLE["content_hash"] = sql("SELECT artifact_id, sha256(content) AS file_hash FROM v_artifacts", "v_artifacts")
ORACLE["identify_format"] = sql("""
    SELECT artifact_id, filename, CASE ext WHEN '.gguf' THEN 'gguf' WHEN '.safetensors' THEN 'safetensors'
           WHEN '.onnx' THEN 'onnx' ELSE 'pickle' END AS format FROM v_artifacts
    UNION ALL SELECT artifact_id, filename, 'pickle' FROM v_pickles
    UNION ALL SELECT artifact_id, filename, 'gguf' FROM v_gguf""", "v_artifacts", "v_pickles", "v_gguf")
VIEWS["magic_rows"] = """
    SELECT artifact_id, filename, 'valid_magic' AS type, 'clean' AS severity, 0.0::DOUBLE AS weight FROM v_pickles
    UNION ALL SELECT artifact_id, filename, 'valid_magic', 'clean', 0.0 FROM v_gguf
    UNION ALL SELECT artifact_id, filename,
        CASE WHEN ext = '.gguf' OR octet_length(content) < 4 THEN 'invalid_magic' ELSE 'unknown_magic' END,
        CASE WHEN ext = '.gguf' OR octet_length(content) < 4 THEN 'malicious' ELSE 'suspicious' END,
        CASE WHEN ext = '.gguf' THEN 30.0 WHEN octet_length(content) < 4 THEN 20.0 ELSE 10.0 END FROM v_artifacts"""
DEPENDS["magic_rows"] = ["v_pickles", "v_gguf", "v_artifacts"]
ORACLE["magic_check"] = sql("SELECT * FROM magic_rows", "magic_rows")
ORACLE["format_risk_note"] = sql("""
    SELECT scan_id, 'format_risk' AS type, 'suspicious' AS severity FROM v_scans WHERE file_extension IN ('.pkl', '.pickle')
    UNION ALL SELECT scan_id, 'extension_warning', 'suspicious' FROM v_scans
        WHERE file_extension IS NULL OR file_extension NOT IN ('.pkl', '.pickle', '.pt', '.pth')
    UNION ALL SELECT scan_id, 'scan_limit', 'clean' FROM v_scans WHERE file_size >= 104857600""", "v_scans")

# ---- detection
ORACLE["signature_catalog"] = sql("""
    SELECT s.id, s.category, s.severity, s.cvss_score, s.cvss_severity, s.cvss_vector, count(DISTINCT h.artifact_id) AS artifacts
    FROM scored_signatures s LEFT JOIN hits h ON s.id = h.pattern_id GROUP BY ALL""", "hits")
ORACLE["signature_hits"] = sql("""SELECT artifact_id, pattern_id, category, "offset", severity, cvss_score, cvss_vector
    FROM hits""", "hits")
ORACLE["signature_hit_counts"] = sql("""SELECT artifact_id, pattern_id, category, severity, count(*) AS hits
    FROM hits GROUP BY ALL""", "hits")
VIEWS["sdk_threats"] = ("SELECT artifact_id, pattern, severity, category, description, ext FROM v_artifacts JOIN "
                        + values(SDK_LITERALS, "pattern, severity, category, description") + " ON contains(body, pattern)")
DEPENDS["sdk_threats"] = ["v_artifacts"]
ORACLE["literal_presence"] = sql("SELECT artifact_id, pattern, severity, category, description FROM sdk_threats", "sdk_threats")
ORACLE["weighted_pattern_counts"] = sql(f"""
    SELECT artifact_id, pattern, hits::BIGINT AS hits, weight, CASE WHEN weight >= 40 THEN 'malicious' ELSE 'suspicious' END AS severity
    FROM (SELECT artifact_id, pattern, weight::DOUBLE AS weight,
                 len(regexp_extract_all(body, regex)) - CASE WHEN pattern = '__reduce__'
                     THEN len(regexp_extract_all(body, '__reduce_ex__')) ELSE 0 END AS hits
          FROM v_artifacts CROSS JOIN {values([(l, r, w) for l, r, _, w in PICKLE_RULES], 'pattern, regex, weight')})
    WHERE hits > 0""", "v_artifacts")
ORACLE["chunk_entropy"] = sql("""
    SELECT artifact_id, "offset", size, round(bits, 3) AS entropy, bits > 7.8 AS flagged
    FROM (SELECT artifact_id, "offset", sum(n)::BIGINT AS size, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits
          FROM (SELECT artifact_id, "offset", b, count(*) AS n
                FROM (SELECT artifact_id, "offset", unnest(regexp_extract_all(substring(h, "offset" * 2 + 1, 16384), '..')) AS b
                      FROM (SELECT artifact_id, hex(content) AS h, unnest(range(0, octet_length(content), 8192)) AS "offset"
                            FROM v_artifacts WHERE octet_length(content) >= 256))
                GROUP BY ALL) GROUP BY ALL)
    WHERE size >= 64""", "v_artifacts")
ORACLE["text_entropy"] = """
    SELECT d.doc_id, coalesce(round(bits, 3), 0.0) AS entropy, coalesce(bits, 0) > 4.5 AND length(text) > 64 AS flagged
    FROM documents d LEFT JOIN (
        SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits
        FROM (SELECT doc_id, b, count(*) AS n
              FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY ALL)
        GROUP BY doc_id) e ON d.doc_id = e.doc_id"""
ORACLE["safetensors_header"] = sql("""
    SELECT doc_id AS artifact_id, CASE WHEN doc_id % 11 = 5 THEN 'too_small'
               WHEN doc_id % 11 IN (0, 1, 2, 3, 4) THEN 'malformed' ELSE 'ok' END AS status,
           CASE doc_id % 11 WHEN 5 THEN NULL WHEN 0 THEN n_header + 1000 WHEN 4 THEN 0 ELSE n_header END::BIGINT AS header_len,
           CASE WHEN doc_id % 11 > 5 THEN 1 END::BIGINT AS n_tensors,
           CASE WHEN doc_id % 11 > 5 THEN note END AS note, CASE WHEN doc_id % 11 > 5 THEN url END AS url
    FROM v_safetensors""", "v_safetensors")
VIEWS["header_rows"] = """
    SELECT doc_id, filename, header, doc_id % 11 = 3 OR doc_id % 11 > 5 AS parsed, doc_id % 11 > 5 AS has_values, note, url,
           CASE doc_id % 11 WHEN 5 THEN 'invalid_header' WHEN 4 THEN 'empty_header' WHEN 0 THEN 'truncated_header'
                WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_header_type' WHEN 3 THEN 'invalid_metadata_type'
                ELSE 'header_info' END AS type,
           CASE WHEN doc_id % 11 IN (5, 0, 1, 2) THEN 'malicious' WHEN doc_id % 11 IN (3, 4) THEN 'suspicious'
                ELSE 'clean' END AS severity,
           CASE doc_id % 11 WHEN 5 THEN 25 WHEN 4 THEN 5 WHEN 0 THEN 20 WHEN 1 THEN 25 WHEN 2 THEN 20 WHEN 3 THEN 10
                ELSE 0 END::DOUBLE AS weight
    FROM v_safetensors"""
DEPENDS["header_rows"] = ["v_safetensors"]
ORACLE["safetensors_header_rules"] = sql(
    "SELECT doc_id AS artifact_id, type, severity, weight FROM header_rows", "header_rows")
VIEWS["metadata_rows"] = f"""
    SELECT doc_id AS artifact_id, 'engine' AS profile, 'url' AS key, 'suspicious_url_metadata' AS type, 'medium' AS severity,
           url AS pattern, 1::BIGINT AS hits, 0.0::DOUBLE AS weight, 5.5::DOUBLE AS cvss_score FROM header_rows WHERE has_values
    UNION ALL SELECT doc_id, 'inspector', 'note', 'large_metadata_value', 'suspicious', NULL, 1, 5.0, NULL
        FROM header_rows WHERE has_values AND length(note) > 10000
    UNION ALL SELECT doc_id, 'inspector', NULL, 'header_pattern', CASE WHEN w >= 20 THEN 'malicious' ELSE 'suspicious' END,
        label, len(regexp_extract_all(header, regex)), w::DOUBLE, NULL
        FROM header_rows JOIN {values([(l, "(?i)" + r, w) for l, r, w in TEXT_RULES], 'label, regex, w')}
        ON parsed AND regexp_matches(header, regex)"""
DEPENDS["metadata_rows"] = ["header_rows"]
ORACLE["metadata_rules"] = sql("SELECT * FROM metadata_rows", "metadata_rows")
VIEWS["pickle_rows"] = """
    SELECT artifact_id, 'unsafe_global' AS type, 'code_execution' AS category, open_at::BIGINT AS "offset",
           CASE WHEN module IN ('os', 'sys', 'builtins') THEN 'high' ELSE 'medium' END AS severity,
           CASE WHEN module IN ('os', 'builtins') THEN 8.4 ELSE 5.5 END::DOUBLE AS cvss_score,
           'CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' AS cvss_vector, filename
    FROM v_pickles WHERE module NOT IN ('collections', 'numpy')
    UNION ALL SELECT artifact_id, 'reduce_execution', 'deserialization_exploit', close_at + 1, 'critical', 9.8,
           'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H', filename FROM v_pickles
    UNION ALL SELECT artifact_id, 'malformed_pickle', 'obfuscation_payload', 0, 'medium', 5.5,
           'CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:H', filename FROM v_pickles WHERE cut"""
DEPENDS["pickle_rows"] = ["v_pickles"]
ORACLE["pickle_opcode_audit"] = sql("""SELECT artifact_id, type, category, "offset", severity, cvss_score, cvss_vector
    FROM pickle_rows""", "pickle_rows")
ORACLE["pickle_unsafe_imports"] = sql("""SELECT module, name, count(DISTINCT artifact_id) AS artifacts, count(*) AS hits
    FROM v_pickles WHERE module NOT IN ('collections', 'numpy') GROUP BY ALL""", "v_pickles")
ORACLE["pickle_op_counts"] = sql("""SELECT artifact_id, 1::BIGINT AS global_count, 0::BIGINT AS stack_global_count,
    1::BIGINT AS reduce_count FROM v_pickles""", "v_pickles")
ORACLE["gguf_metadata"] = sql("""
    SELECT artifact_id, 3::BIGINT AS version, 0::BIGINT AS tensors, 3::BIGINT AS pairs, 0::BIGINT AS position,
           'general.name' AS key, 8::BIGINT AS vtype, model AS value FROM v_gguf
    UNION ALL SELECT artifact_id, 3, 0, 3, 1, 'tokenizer.chat_template', 8, template FROM v_gguf
    UNION ALL SELECT artifact_id, 3, 0, 3, 2, 'general.description', 8, text FROM v_gguf""", "v_gguf")
ORACLE["gguf_key_table"] = sql("""
    SELECT 'general.name' AS key, 8::BIGINT AS vtype, count(*) AS artifacts, count(DISTINCT model) AS distinct_values FROM v_gguf
    UNION ALL SELECT 'tokenizer.chat_template', 8, count(*), count(DISTINCT template) FROM v_gguf
    UNION ALL SELECT 'general.description', 8, count(*), count(DISTINCT text) FROM v_gguf""", "v_gguf")
VIEWS["gguf_rows"] = f"""
    SELECT artifact_id, source, 'chat_template_injection' AS type, 'malicious' AS severity, label AS pattern,
           len(regexp_extract_all(template, regex))::BIGINT AS hits, 20.0::DOUBLE AS weight, filename
    FROM v_gguf CROSS JOIN (SELECT unnest(['metadata[tokenizer.chat_template]', 'chat_template']) AS source)
         JOIN {values([(l, "(?i)" + r) for l, _, r in STRING_RULES], 'label, regex')} ON regexp_matches(template, regex)"""
DEPENDS["gguf_rows"] = ["v_gguf"]
ORACLE["gguf_metadata_rules"] = sql("""SELECT artifact_id, source, type, severity, pattern, hits, weight
    FROM gguf_rows""", "gguf_rows")
VIEWS["template_rows"] = """
    SELECT artifact_id, 'ssti_risk' AS type, 'critical' AS severity, 9.8::DOUBLE AS cvss_score,
           'Template injection risk, dangerous names requested: os' AS desc, payload AS block, ext
    FROM v_artifacts WHERE artifact_id % 23 = 13"""
DEPENDS["template_rows"] = ["v_artifacts"]
ORACLE["template_injection"] = sql("SELECT artifact_id, type, severity, cvss_score, \"desc\", block FROM template_rows",
                                   "template_rows").replace("AS desc,", 'AS "desc",')
VIEWS["onnx_rows"] = """
    SELECT artifact_id, op, octet_length(encode(body)) - octet_length(encode(payload)) + pos AS "offset", ext
    FROM v_artifacts CROSS JOIN (VALUES ('PyOp', 0), ('CustomOp', 5)) AS t(op, pos) WHERE artifact_id % 23 = 14"""
DEPENDS["onnx_rows"] = ["v_artifacts"]
ORACLE["onnx_op_indicators"] = sql("""SELECT artifact_id, op, "offset"::BIGINT AS "offset", 'critical' AS severity,
    9.8::DOUBLE AS cvss_score, 'Suspicious ONNX Operator found: ' || op || '. Can execute arbitrary code.' AS "desc"
    FROM onnx_rows""", "onnx_rows")
ORACLE["ioc_screen"] = sql("""
    SELECT artifact_id, h.file_hash, CASE WHEN i.file_hash IS NOT NULL THEN 'IOC-BLACKLIST' END AS pattern,
           CASE WHEN i.file_hash IS NOT NULL THEN 100 END::BIGINT AS risk_score,
           CASE WHEN i.file_hash IS NOT NULL THEN 'critical' END AS risk_level
    FROM v_hashes h LEFT JOIN v_iocs i ON h.file_hash = i.file_hash""", "v_hashes", "v_iocs")
ORACLE["scan_dispatch"] = sql("""
    SELECT filename AS artifact_id, 'pattern_match' AS type, pattern_id, category, "offset" + frame AS "offset", severity, cvss_score,
           position * 1000000000000 + "offset" + frame AS ordinal
    FROM hits h JOIN (SELECT *, CASE WHEN ext IN ('.pkl', '.pickle', '.pt', '.pth') THEN 5 ELSE 0 END AS frame FROM v_artifacts) a
         ON h.artifact_id = a.artifact_id AND (ext <> '.safetensors' OR octet_length(content) >= 8)
    UNION ALL SELECT filename, type, NULL, category, "offset", severity, cvss_score,
        1000000000000000000 + "offset" + CASE WHEN type = 'malformed_pickle' THEN 1000000000000 ELSE 0 END FROM pickle_rows
    UNION ALL SELECT 'model_' || artifact_id || ext, type, NULL, 'command_injection', 0, severity, cvss_score, 1000000000000000000
        FROM template_rows WHERE ext = '.gguf'
    UNION ALL SELECT 'model_' || artifact_id || ext, 'dangerous_onnx_op', NULL, 'code_execution', "offset", 'critical', 9.8,
        1000000000000000000 + "offset" + CASE op WHEN 'CustomOp' THEN 1000000000000 ELSE 0 END FROM onnx_rows WHERE ext = '.onnx'
    UNION ALL SELECT filename, 'malformed_safetensors', NULL, 'obfuscation_payload', 0, 'low', 3.3, 1000000000000000000
        FROM v_artifacts WHERE ext = '.safetensors' AND octet_length(content) >= 8""",
                              "hits", "pickle_rows", "template_rows", "onnx_rows")
ORACLE["scan_dispatch_sdk"] = sql("SELECT artifact_id, pattern, severity FROM sdk_threats", "sdk_threats")
ORACLE["scan_dispatch_inspector"] = sql(f"""
    SELECT filename AS artifact_id, 'valid_magic' AS type, 'clean' AS severity, NULL::VARCHAR AS pattern, NULL::BIGINT AS hits,
           0.0::DOUBLE AS weight FROM v_pickles
    UNION ALL SELECT filename, 'valid_magic', 'clean', NULL, NULL, 0.0 FROM v_gguf
    UNION ALL SELECT filename, type, severity, pattern, hits, weight FROM gguf_rows
    UNION ALL SELECT filename, type, severity, NULL, NULL, weight FROM header_rows
    UNION ALL SELECT 'm_' || artifact_id || '.safetensors', type, severity, pattern, hits, weight FROM metadata_rows
        WHERE profile = 'inspector'""", "v_pickles", "gguf_rows", "header_rows", "metadata_rows")

ORACLE["inspector_notes"] = sql("""
    SELECT artifact_id, 'header_info' AS type, 'clean' AS severity, 'GGUF v3 — 0 tensor(s), 3 metadata key-value pair(s).' AS detail, 'gguf' AS format
    FROM v_gguf
    UNION ALL SELECT artifact_id, 'chat_template_found', 'clean', 'Chat template found in key ''tokenizer.chat_template'' (' || length(template) || ' chars).',
        'gguf' FROM v_gguf
    UNION ALL SELECT doc_id, 'metadata_info', 'clean', '__metadata__ contains 2 key(s): note, url', 'safetensors' FROM header_rows WHERE has_values
    UNION ALL SELECT doc_id, 'format_safety', 'clean',
        'SafeTensors format does not support arbitrary code execution. This is inherently safer than Pickle.', 'safetensors'
        FROM header_rows WHERE parsed AND doc_id NOT IN (SELECT artifact_id FROM metadata_rows WHERE severity = 'malicious')""",
                             "v_gguf", "header_rows", "metadata_rows")

# ---- scoring
_SETS = {"av": "NALP", "ac": "LH", "pr": "NLH", "ui": "NR", "s": "UC", "c": "HLN", "i": "HLN", "a": "HLN"}
_DEF = {"av": "L", "ac": "L", "pr": "N", "ui": "N", "s": "U", "c": "H", "i": "H", "a": "H"}


def _metric_view() -> str:
    cols, step = [], 1
    for name, letters in _SETS.items():
        cols.append(f"CASE WHEN event_id % 17 = 0 THEN {lit(_DEF[name])} ELSE "
                    f"{pick(letters, f'(event_id // {step}) % {len(letters)}')} END AS {name}")
        step *= len(letters)
    return f"SELECT event_id, {', '.join(cols)} FROM events"


VIEWS["metric_rows"] = _metric_view()
for _key, _mode in (("cvss_base_score", "reference"), ("cvss_base_score_spec", "spec")):
    ORACLE[_key] = sql(f"""SELECT event_id, cvss_score, {CVSS_SEVERITY} AS cvss_severity, {CVSS_VECTOR} AS cvss_vector
        FROM (SELECT *, {cvss_columns(_mode)} AS cvss_score FROM metric_rows)""", "metric_rows")
VIEWS["artifact_scores"] = """
    SELECT artifact_id, coalesce(max(cvss_score) FILTER (cvss_score > 0), 0.0) AS cvss_score,
           coalesce(first(severity ORDER BY cvss_score DESC, ordinal) FILTER (cvss_score > 0), 'None') AS severity,
           count(*) AS threats_found FROM v_findings GROUP BY 1"""
DEPENDS["artifact_scores"] = ["v_findings"]
ORACLE["artifact_cvss"] = sql("SELECT * FROM artifact_scores", "artifact_scores")
_RISK = "least(trunc(cvss_score * 10)::BIGINT, 100)"
ORACLE["engine_risk"] = sql(f"""SELECT artifact_id, cvss_score, {_RISK} AS risk_score,
    {band_sql(_RISK, *ENGINE)} AS risk_level FROM artifact_scores""", "artifact_scores")
ORACLE["sdk_risk"] = sql(f"""
    SELECT artifact_id, filename, risk_score, threats_found, {band_sql('risk_score', *SDK)} AS risk_level FROM (
    SELECT a.artifact_id, filename, count(pattern) AS threats_found, least(
             CASE a.ext WHEN '.pkl' THEN 30 WHEN '.pickle' THEN 30 WHEN '.pt' THEN 25 WHEN '.pth' THEN 25 WHEN '.gguf' THEN 5
                  WHEN '.safetensors' THEN 3 ELSE 15 END
             + coalesce(sum(CASE severity WHEN 'critical' THEN 35 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END) FILTER (severity IS NOT NULL), 0),
             100)::BIGINT AS risk_score
    FROM v_artifacts a LEFT JOIN sdk_threats t ON a.artifact_id = t.artifact_id
    GROUP BY a.artifact_id, filename, a.ext)""", "v_artifacts", "sdk_threats")
ORACLE["inspector_risk"] = sql(f"""
    SELECT artifact_id, risk_score, {band_sql('risk_score', *INSPECTOR)} AS risk_level FROM (
    SELECT artifact_id, greatest(least(CASE WHEN bool_or(type IN ('header_info', 'invalid_metadata_type'))
               AND NOT bool_or(severity = 'malicious') THEN greatest(sum(weight), 5.0) ELSE sum(weight) END, 100.0), 0.0) AS risk_score
    FROM (SELECT doc_id AS artifact_id, type, severity, weight FROM header_rows UNION ALL
          SELECT artifact_id, type, severity, weight FROM metadata_rows WHERE profile = 'inspector') GROUP BY 1)""",
                               "header_rows", "metadata_rows")
ORACLE["risk_bands"] = sql(f"""
    SELECT scan_id, score, {band_sql('score', *ENGINE)} AS band_engine, {band_sql('score', *SDK)} AS band_sdk,
           {band_sql('score', *INSPECTOR)} AS band_inspector, {band_sql('score', *BADGE)} AS band_badge_label,
           {band_sql('score', *COLOR)} AS band_badge_color, {band_sql('(score / 10)', *CVE)} AS band_cve
    FROM (SELECT scan_id, CASE WHEN risk_score <> 7 THEN risk_score END AS score FROM v_scans)""", "v_scans")
ORACLE["final_verdict"] = sql(f"""
    SELECT scan_id, CASE WHEN ai_verdict IS NOT NULL THEN coalesce(nullif(ai_verdict, ''), 'UNKNOWN')
           ELSE {band_sql('risk_score', *VERDICT)} END AS verdict, risk_score < 30 AS is_safe FROM v_scans""", "v_scans")
ORACLE["rank_findings"] = sql(f"""
    SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY {SEV} DESC, ordinal, pattern, category, cvss_score NULLS FIRST) AS rank, ordinal,
           severity, pattern FROM v_findings""", "v_findings")
VIEWS["ranked"] = f"""
    SELECT *, coalesce(CASE WHEN category = 'O' THEN 'O' END, 'unknown') AS cat,
           row_number() OVER (PARTITION BY artifact_id ORDER BY {SEV} DESC, ordinal, pattern, cat) AS rank FROM v_findings"""
VIEWS["result_rows"] = f"""
    SELECT o_orderkey AS artifact_id, 'model_' || o_orderkey || '.pkl' AS filename, floor(o_totalprice)::BIGINT AS file_size,
           least(coalesce(trunc(s.cvss_score * 10)::BIGINT, 0), 100) AS risk_score, coalesce(threats_found, 0) AS threats_found,
           {band_sql('least(coalesce(trunc(s.cvss_score * 10)::BIGINT, 0), 100)', *ENGINE)} AS risk_level
    FROM orders LEFT JOIN artifact_scores s ON o_orderkey = s.artifact_id"""
DEPENDS |= {"ranked": ["v_findings"], "result_rows": ["artifact_scores"]}
ORACLE["assemble_results"] = sql("""
    SELECT r.artifact_id, filename, 0::BIGINT AS page, risk_score, risk_level,
           CASE WHEN threats_found > 0 THEN 'danger' ELSE 'safe' END AS status, threats_found,
           'Analyzed ' || file_size || ' bytes. Found ' || threats_found || ' potential threats.' AS details,
           coalesce(threat_list, '') AS threat_list, '.pkl' AS extension
    FROM result_rows r LEFT JOIN (
        SELECT artifact_id, string_agg(pattern || '|' || severity || '|' || cat, ';' ORDER BY rank) AS threat_list
        FROM ranked GROUP BY 1) t ON r.artifact_id = t.artifact_id""", "result_rows", "ranked")
ORACLE["assemble_results_paged"] = sql("""
    SELECT r.artifact_id, coalesce(page, 0)::BIGINT AS page, coalesce(n, 0)::BIGINT AS threats_on_page, threats_found
    FROM result_rows r LEFT JOIN (SELECT artifact_id, (rank - 1) // 2 AS page, count(*) AS n FROM ranked GROUP BY ALL) t
    ON r.artifact_id = t.artifact_id""", "result_rows", "ranked")
ORACLE["verdict_prompt_rows"] = sql("""
    SELECT r.artifact_id, coalesce(n, 0)::BIGINT AS threats_shown,
           'File: ' || filename || chr(10) || 'Extension: .pkl' || chr(10) || 'File size: ' || file_size || ' bytes' || chr(10)
           || 'Risk score: ' || risk_score || '/100' || chr(10) || 'Risk level: ' || risk_level || chr(10)
           || 'Threats found: ' || threats_found || chr(10) || 'Threat details: ' || coalesce(shown, '[]') || chr(10)
           || 'Answer with one JSON object: verdict, confidence, summary_en, summary_ar, key_risks, recommendation, recommendation_ar, technical_details.' AS prompt
    FROM result_rows r LEFT JOIN (
        SELECT artifact_id, count(*) AS n, '[' || string_agg(to_json({'pattern': pattern, 'severity': severity, 'description': '',
               'location': 'model_' || artifact_id || '.pkl', 'category': cat})::VARCHAR, ',' ORDER BY rank) || ']' AS shown
        FROM ranked WHERE rank <= 2 GROUP BY 1) t ON r.artifact_id = t.artifact_id""", "result_rows", "ranked")
ORACLE["parse_verdict_responses"] = """
    SELECT event_id::VARCHAR AS scan_id,
           CASE WHEN event_id % 5 < 3 THEN 'DANGEROUS' WHEN event_id % 5 = 3 THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END AS verdict,
           CASE WHEN event_id % 5 < 3 THEN event_id % 101 ELSE 50 END::BIGINT AS confidence,
           CASE WHEN event_id % 5 < 3 THEN 'seen ' || event_type WHEN event_id % 5 = 3 THEN 'short' ELSE '' END AS summary_en,
           CASE WHEN event_id % 5 < 3 THEN 'a,b' ELSE '' END AS key_risks, '' AS recommendation FROM events"""

# ---- threat intelligence
ORACLE["cve_parse"] = sql("SELECT keyword, pos, cve_id, description, cvss_score, published_date FROM v_feed_parsed",
                          "v_feed_parsed")
ORACLE["cve_merge"] = sql("""
    SELECT cve_id, description, cvss_score, published_date, keyword AS affected_tech FROM (
        SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY kpos, pos) AS rn FROM v_feed_parsed)
    WHERE rn = 1 AND cve_id NOT IN (SELECT cve_id FROM v_feed_parsed WHERE pos % 3 = 0)""", "v_feed_parsed")
ORACLE["cve_recent"] = sql("SELECT * FROM v_cves ORDER BY published_date DESC NULLS FIRST, cve_id LIMIT 50", "v_cves")
ORACLE["cve_search"] = sql("""SELECT cve_id, affected_tech FROM v_cves WHERE contains(lower(cve_id), 'th')
    OR contains(lower(description), 'th') OR contains(lower(affected_tech), 'th')""", "v_cves")
ORACLE["ioc_lookup"] = sql("""
    SELECT artifact_id, h.file_hash, CASE WHEN i.file_hash IS NULL THEN 'clean' ELSE 'found' END AS status, severity,
           is_verified, reported_at FROM v_hashes h LEFT JOIN v_iocs i ON h.file_hash = i.file_hash""", "v_hashes", "v_iocs")
ORACLE["ioc_merge"] = sql("""
    SELECT event_id AS report_id, file_hash, CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE 'malicious' END AS severity,
           user_id::VARCHAR AS reporter_id,
           CASE WHEN row_number() OVER (PARTITION BY file_hash ORDER BY event_id) = 1 AND file_hash NOT IN (
               SELECT file_hash FROM v_scans WHERE risk_level = 'malicious' AND risk_score > 60)
               THEN 'success' ELSE 'ignored' END AS status
    FROM (SELECT *, sha256('h' || event_id % 500) AS file_hash FROM events)""", "v_scans")
VIEWS["patterns"] = """
    SELECT p_type AS pattern, 'high' AS severity, 'part' AS category, max(p_brand) AS description_en,
           min(p_brand) AS description_ar, sum(p_size)::BIGINT AS times_detected, count(*) % 3 <> 0 AS is_active
    FROM part GROUP BY 1"""
ORACLE["pattern_catalog_active"] = sql("""SELECT pattern, severity, category, description_en, description_ar, times_detected,
    'database' AS source FROM patterns WHERE is_active""", "patterns")
ORACLE["pattern_catalog_fallback"] = ("SELECT pattern, severity, category, 'builtin' AS source FROM "
                                      + values([r[:3] for r in BUILTIN_PATTERNS], "pattern, severity, category"))
ORACLE["pattern_detection_counts"] = sql("""SELECT p.pattern, count(f.pattern) AS times_detected FROM patterns p
    LEFT JOIN v_findings f ON p.pattern = f.pattern GROUP BY 1""",
                                         "patterns", "v_findings")

# ---- analytics
_LEVEL = lambda name: f"count(*) FILTER (risk_level = '{name}') AS {name}"
_LEVELS = ", ".join(_LEVEL(n) for n in ("clean", "suspicious", "malicious", "critical"))
_BAD = "risk_level IN ('malicious', 'critical')"
ORACLE["platform_stats"] = sql(f"""SELECT count(*) AS total, {_LEVELS}, coalesce(round(avg(risk_score), 1), 0.0) AS avg_risk_score
    FROM v_scans""", "v_scans")
ORACLE["overview"] = sql(f"""SELECT count(*) AS total_scans, count(*) FILTER ({_BAD}) AS threats_found,
    count(*) FILTER (risk_level = 'clean') AS clean_models FROM v_scans""", "v_scans")
ORACLE["threat_statistics"] = sql(f"""SELECT count(*) AS total_scans, count(*) FILTER ({_BAD}) AS malicious_scans,
    count(*) - count(*) FILTER ({_BAD}) AS clean_scans, (SELECT count(*) FROM v_cves) AS total_cves,
    (SELECT count(*) FROM v_iocs) AS total_iocs FROM v_scans""", "v_scans", "v_cves", "v_iocs")
ORACLE["recent_scans"] = sql("""SELECT scan_id, filename, risk_score, risk_level,
    coalesce(nullif(ai_verdict, ''), 'UNKNOWN') AS verdict, n_threats AS threats_count, created_at FROM v_scans
    WHERE is_public ORDER BY created_at DESC, scan_id LIMIT 10""", "v_scans")
ORACLE["scan_detail"] = sql("""
    SELECT o_orderkey::VARCHAR AS scan_id, s.scan_id IS NOT NULL AS found, filename, risk_score, risk_level, n_threats AS threats,
           created_at, CASE WHEN s.scan_id IS NOT NULL THEN coalesce(nullif(ai_verdict, ''), 'UNKNOWN') END AS verdict,
           CASE WHEN s.scan_id IS NOT NULL THEN coalesce(ai_confidence, 0) END::BIGINT AS confidence,
           CASE WHEN risk_level <> 'clean' THEN file_size::VARCHAR END AS metadata_size,
           CASE WHEN risk_level <> 'clean' THEN 'https://x.example/' || s.scan_id END AS source_url,
           CASE WHEN s.scan_id IS NOT NULL THEN CASE WHEN risk_level <> 'clean' THEN coalesce('seen in ' || filename, '') ELSE '' END END AS summary_en,
           CASE WHEN s.scan_id IS NOT NULL THEN '' END AS summary_ar, CASE WHEN s.scan_id IS NOT NULL THEN '' END AS recommendation,
           CASE WHEN s.scan_id IS NOT NULL THEN '' END AS recommendation_ar,
           CASE WHEN s.scan_id IS NOT NULL THEN CASE WHEN risk_level <> 'clean' THEN risk_level ELSE '' END END AS key_risks
    FROM orders LEFT JOIN v_scans s ON o_orderkey::VARCHAR = s.scan_id""", "v_scans")
for _name, _days in (("daily_trend", 7), ("daily_trend_90d", 90)):
    ORACLE[_name] = sql(f"""
        SELECT strftime(d, '%Y-%m-%d') AS date, count(*) FILTER (risk_level IN ('clean', 'suspicious')) AS safe,
               count(*) FILTER ({_BAD}) AS threats
        FROM (SELECT unnest(generate_series(DATE '2024-01-20' - {_days}, DATE '2024-01-20', INTERVAL 1 DAY))::DATE AS d)
        LEFT JOIN (SELECT * FROM v_scans WHERE created_at >= TIMESTAMP '2024-01-20 12:00:00' - to_days({_days})) s
        ON s.created_at::DATE = d GROUP BY 1""", "v_scans")
ORACLE["level_pivot_by_day"] = sql(f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, {_LEVELS} FROM v_scans GROUP BY 1""",
                                   "v_scans")
ORACLE["threats_by_extension"] = sql(f"""SELECT coalesce(nullif(file_extension, ''), 'unknown') AS name, n AS value
    FROM (SELECT file_extension, count(*) AS n FROM v_scans WHERE {_BAD} GROUP BY 1)""", "v_scans")
ORACLE["severity_distribution"] = sql("""
    SELECT name, count(s.risk_level) AS count, fill FROM (VALUES ('Critical', 'critical', '#E74C3C'),
        ('High/Malicious', 'malicious', '#E67E22'), ('Medium/Suspicious', 'suspicious', '#F1C40F'),
        ('Low/Clean', 'clean', '#2ECC71')) AS t(name, level, fill)
    LEFT JOIN v_scans s ON s.risk_level = level GROUP BY name, fill""", "v_scans")
ORACLE["traffic_by_ip"] = sql("""SELECT ip_address, count(*) AS scans FROM v_scans WHERE ip_address IS NOT NULL
    GROUP BY 1 ORDER BY scans DESC, ip_address LIMIT 100""", "v_scans")
ORACLE["compare_scans"] = sql("""
    SELECT a.scan_id AS scan_a, b.scan_id AS scan_b, a.risk_score AS a_score, a.risk_level AS a_level,
           a.n_threats AS a_threat_count, b.risk_score AS b_score, b.risk_level AS b_level, b.n_threats AS b_threat_count,
           CASE WHEN a.risk_score <= b.risk_score THEN a.scan_id ELSE b.scan_id END AS safer,
           abs(a.risk_score - b.risk_score) AS risk_difference
    FROM orders JOIN v_scans a ON o_orderkey::VARCHAR = a.scan_id JOIN v_scans b ON o_custkey::VARCHAR = b.scan_id""", "v_scans")
ORACLE["badge_rows"] = sql(f"""
    SELECT scan_id, to_json({{'schemaVersion': 1, 'label': 'modelsieve', 'message': risk_level, 'color': CASE risk_level
           WHEN 'clean' THEN 'brightgreen' WHEN 'suspicious' THEN 'yellow' WHEN 'malicious' THEN 'orange'
           WHEN 'critical' THEN 'red' ELSE 'lightgrey' END, 'namedLogo': 'shield'}})::VARCHAR AS payload,
           {band_sql('risk_score', *BADGE)} AS score_label, {band_sql('risk_score', *COLOR)} AS score_color
    FROM v_scans""", "v_scans")
ORACLE["report_rows"] = sql("""
    SELECT scan_id, unnest(range(n_threats)) AS pos, 'Code Execution' AS category, 'CRITICAL' AS severity, 'CODE-001' AS pattern,
           'dynamic evaluation' AS description FROM v_scans
    UNION ALL SELECT scan_id, 0, NULL, NULL, NULL, 'No malicious threats or dangerous patterns were identified in this file.'
    FROM v_scans WHERE n_threats = 0""", "v_scans")
ORACLE["policy_gate"] = sql(f"""
    SELECT ip_address AS batch, count(*) AS scans, count(*) FILTER ({_BAD}) AS failing,
           bool_or(risk_level = 'critical')::BIGINT AS exit_critical, bool_or({_BAD})::BIGINT AS exit_dangerous
    FROM v_scans GROUP BY 1""", "v_scans")

# ---- usage and notifications
ORACLE["key_usage"] = """
    SELECT c.c_custkey AS request_id, ok AS valid, CASE WHEN ok THEN c_name END AS name,
           CASE WHEN ok THEN coalesce(n, 0) END AS scans_used, CASE WHEN ok THEN 500 END::BIGINT AS scans_limit,
           CASE WHEN ok THEN 500 - coalesce(n, 0) END AS scans_remaining
    FROM (SELECT *, c_custkey % 7 <> 0 AND c_acctbal > 0 AS ok FROM customer) c
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o_custkey"""
VIEWS["event_rows"] = """
    SELECT scan_id, user_id, 'scan.completed' AS event_type,
           to_json({'scan_id': scan_id, 'risk_level': risk_level})::VARCHAR AS payload FROM v_scans WHERE user_id IS NOT NULL
    UNION ALL SELECT scan_id, user_id, 'threat.critical', to_json({'scan_id': scan_id, 'threats': threats})::VARCHAR
    FROM v_scans WHERE user_id IS NOT NULL AND risk_level = 'critical'"""
DEPENDS["event_rows"] = ["v_scans"]
ORACLE["scan_events"] = sql("SELECT * FROM event_rows", "event_rows")
_PAD = lambda key, code: f"encode(array_to_string(list_transform(string_split({key}, ''), lambda x: chr(xor(ascii(x), {code}))), ''))"
ORACLE["webhook_fanout"] = sql(f"""
    SELECT scan_id, s.id AS subscription_id, event_type, payload,
           sha256({_PAD('secret_token', 92)} || unhex(sha256({_PAD('secret_token', 54)} || encode(payload)))) AS signature
    FROM event_rows e JOIN v_webhook_subs s ON e.user_id = s.user_id AND is_active AND listens IN (event_type, 'all')""",
                               "event_rows", "v_webhook_subs")
ORACLE["delivery_log"] = sql("""
    SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY triggered_at DESC, l.id DESC) AS rank,
                          l.id, url, event_type, response_status::BIGINT AS response_status, triggered_at
                   FROM v_webhook_logs l JOIN v_webhook_subs s ON l.subscription_id = s.id) WHERE rank <= 5""",
                             "v_webhook_logs", "v_webhook_subs")
ORACLE["profile_merge"] = """
    SELECT c_name || '@example.com' AS email, c_name AS username,
           CASE WHEN seen AND c_custkey % 4 <> 0 THEN 'New ' || c_name ELSE c_name END AS display_name,
           CASE WHEN seen AND c_custkey % 6 = 0 THEN 'https://img.example/a' END AS avatar_url, 'github' AS provider,
           CASE WHEN seen THEN 'g' ELSE 'p' END || c_custkey AS provider_id,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'FURNITURE' THEN 'enterprise' ELSE 'free' END AS plan,
           CASE WHEN seen THEN 'updated' ELSE 'kept' END AS change
    FROM (SELECT *, c_custkey % 2 = 0 AS seen FROM customer)
    UNION ALL
    SELECT c_name || '@new.example.com', c_name, 'New ' || c_name, NULL, 'google', 'g' || c_custkey, 'free', 'inserted'
    FROM customer WHERE c_custkey % 2 = 1"""

# ---- batch forms of the streaming operators
_STAGE = "CASE event_type " + " ".join(f"WHEN {lit(k)} THEN {lit(s)}" for k, s in STAGES.items()) + " END"
VIEWS["last_stage"] = f"""
    SELECT user_id::VARCHAR AS scan_id, {_STAGE} AS stage, (event_id % 101)::BIGINT AS progress, ts AS "timestamp",
           event_type IN ('purchase', 'error') AS closed
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
ORACLE["scan_progress_state"] = sql("SELECT * FROM last_stage", "last_stage")
ORACLE["live_stats"] = sql(f"""SELECT count(*) AS total_scans, count(*) FILTER ({_BAD}) AS threats_found,
    (SELECT count(*) FROM last_stage WHERE NOT closed) AS active_scans FROM v_scans""", "v_scans", "last_stage")
ORACLE["rate_limit_audit"] = """
    SELECT window_start, ip, endpoint, requests, requests - 1 AS over FROM (
        SELECT date_trunc(CASE WHEN event_type = 'signup' THEN 'hour' ELSE 'minute' END, ts)::TIMESTAMP AS window_start,
               '10.0.0.' || user_id % 40 AS ip, CASE WHEN event_type IN ('click', 'view') THEN 'scan_file'
               WHEN event_type = 'signup' THEN 'key_generate' ELSE 'scan_url' END AS endpoint, count(*) AS requests
        FROM events GROUP BY ALL) WHERE requests > 1"""
