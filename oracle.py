"""DuckDB statements that the queries of `__spark_entry__` are checked against."""

from __future__ import annotations

# The log derived from `events`, as in netsentry.sources.netlog.
NETLOG = """
netlog AS (
SELECT event_id,
  strftime(make_timestamp((1704067200 + event_id // 10) * 1000000), '%Y-%m-%dT%H:%M:%S') AS timestamp,
  make_timestamp((1704067200 + event_id // 10) * 1000000) AS event_time,
  make_timestamp((((1704067200 + event_id // 10) // 60) * 60 + 60) * 1000000) AS archived_at,
  CASE WHEN event_id % 10 < 6 THEN concat('185.10.10.', user_id % 24)
       WHEN event_id % 10 < 8 THEN concat('172.16.0.', (event_id // 10) % 127)
       ELSE concat('10.0.', (event_id * 7 + user_id) % 4, '.', (event_id // 10) % 251) END AS source_ip,
  concat('192.168.1.', (event_id * 7 + user_id) % 13) AS dest_ip,
  (['HTTP','TCP','SSH'])[1 + (event_id % 4) % 3] AS protocol,
  CASE WHEN event_type = 'error' OR (event_type = 'click' AND user_id % 4 = 0) THEN 'BLOCKED' ELSE 'Allowed' END AS action,
  CASE event_type WHEN 'error' THEN 'Malicious' WHEN 'click' THEN 'suspicious' WHEN 'purchase' THEN 'Suspicious' ELSE 'clean' END AS threat_label,
  (['firewall','ids','waf','application'])[1 + event_id % 4] AS log_type,
  CAST(floor(value * 1500) AS INTEGER) AS bytes_transferred,
  CASE WHEN event_id % 24 < 14 THEN 'Mozilla/5.0'
       ELSE (['curl/7.68.0','libssh','SQLMap/1.6','Nikto/2.1.6','Nmap Scripting Engine','masscan/1.3','Nessus/10','WPScan v3','Acunetix','Metasploit'])[1 + event_id % 24 - 14] END AS user_agent,
  CASE WHEN (event_id * 31 + user_id) % 64 < 36
       THEN (['/index.html','/login','/home','/api/v1/items','/styles.css','/assets/logo.png'])[1 + ((event_id * 31 + user_id) % 64) % 6]
       ELSE (['/s?id=1 OR 1=1','/s?q=UNION  SELECT a','/information_schema.tables','/s?sleep (5)','/s?benchmark(1)','/xp_cmdshell','/<script>x','/javascript:x','/x?onerror =1','/x?onload=1','/x?alert (1)','/../../x','/..%2F..%2fx','/etc/passwd','/win.ini','/proc/self/environ','/phpMyAdmin/','/wp-login.php','/xmlrpc.php','/backup.sql','/.env','/.git/config','/admin/x','/x?cmd=ls','/powershell','/x?wget http://e','/x?curl  http://e','/certutil'])[1 + (event_id * 31 + user_id) % 64 - 36] END AS request_path
FROM events)"""

LOGS = """
logs AS (
SELECT * REPLACE (lower(action) AS action, lower(threat_label) AS threat_label,
                  CAST(bytes_transferred AS BIGINT) AS bytes_transferred)
FROM netlog)"""

# The signatures as regular expressions over the original text, independent of how the engine tests them.
# Alert type and pattern, in priority order.
AGENT_PATTERNS = (
    ("SQLMAP", "sqlmap"), ("NIKTO", "nikto"), ("NMAP", "nmap"), ("MASSCAN", "masscan"), ("NESSUS", "nessus"),
    ("WPSCAN", "wpscan"), ("ACUNETIX", "acunetix"), ("METASPLOIT", "metasploit"),
)
PATH_PATTERNS = (
    ("SQLI_TAUTOLOGY", r"\bor\b\s+1=1"),
    ("SQLI_UNION", r"union\s+select"),
    ("SQLI_INFO_SCHEMA", r"information_schema"),
    ("SQLI_TIME_BASED", r"sleep\s*\("),
    ("SQLI_BENCHMARK", r"benchmark\s*\("),
    ("SQLI_XP_CMDSHELL", r"xp_cmdshell"),
    ("XSS_SCRIPT", r"<script"),
    ("XSS_JS_URI", r"javascript:"),
    ("XSS_ONERROR", r"onerror\s*="),
    ("XSS_ONLOAD", r"onload\s*="),
    ("XSS_ALERT", r"alert\s*\("),
    ("PATH_TRAVERSAL", r"\.\./"),
    ("PATH_TRAVERSAL_ENCODED", r"\.\.%2f"),
    ("ETC_PASSWD_ACCESS", r"/etc/passwd"),
    ("WIN_INI_ACCESS", r"win\.ini"),
    ("PROC_ENVIRON_ACCESS", r"/proc/self/environ"),
    ("PHPMYADMIN", r"phpmyadmin"),
    ("WP_LOGIN", r"wp-login\.php"),
    ("XMLRPC_PROBE", r"xmlrpc\.php"),
    ("BACKUP_FILE", r"backup\.sql"),
    ("ENV_FILE_ACCESS", r"\.env"),
    ("GIT_DISCLOSURE", r"\.git"),
    ("ADMIN_ACCESS", r"/admin"),
    ("CMD_INJECTION", r"(cmd|exec|command)\s*="),
    ("POWERSHELL_PAYLOAD", r"powershell"),
    ("WGET_PAYLOAD", r"wget\s+http"),
    ("CURL_PAYLOAD", r"curl\s+http"),
    ("CERTUTIL_PAYLOAD", r"certutil"),
)


def _path_cases(text: str) -> str:
    return " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{t}'" for t, p in PATH_PATTERNS)


_AGENT_CASES = " ".join(f"WHEN contains(lower(user_agent), '{p}') THEN '{t}'" for t, p in AGENT_PATTERNS)
SIGNATURE = f"CASE {_AGENT_CASES} {_path_cases('request_path')} END"

CATEGORY = """CASE
  WHEN alert_type LIKE 'SQLI%' OR alert_type = 'SQLMAP' THEN 'SQLI'
  WHEN alert_type LIKE 'XSS%' THEN 'XSS'
  WHEN alert_type IN ('NMAP','MASSCAN','NIKTO','NESSUS','WPSCAN','ACUNETIX') THEN 'SCAN'
  WHEN alert_type = 'REPEATED_BLOCKED_ACTIVITY' THEN 'BRUTE_FORCE'
  WHEN alert_type = 'DATA_EXFILTRATION' THEN 'EXFILTRATION'
  WHEN alert_type IN ('PATH_TRAVERSAL','PATH_TRAVERSAL_ENCODED','ETC_PASSWD_ACCESS','WIN_INI_ACCESS','PROC_ENVIRON_ACCESS') THEN 'FILE_ACCESS_ATTACK'
  WHEN alert_type IN ('ADMIN_ACCESS','WP_LOGIN','PHPMYADMIN','XMLRPC_PROBE') THEN 'ADMIN_PROBING'
  WHEN alert_type IN ('GIT_DISCLOSURE','ENV_FILE_ACCESS','BACKUP_FILE') THEN 'SENSITIVE_FILE_DISCLOSURE'
  WHEN alert_type IN ('CMD_INJECTION','POWERSHELL_PAYLOAD','WGET_PAYLOAD','CURL_PAYLOAD','CERTUTIL_PAYLOAD') THEN 'COMMAND_INJECTION'
  ELSE 'OTHER' END"""

ALERTS = f"""
matched AS (SELECT * FROM (SELECT *, {SIGNATURE} AS alert_type FROM logs) WHERE alert_type IS NOT NULL),
blocked_windows AS (
SELECT source_ip, protocol, w, count(*) AS n, CAST(sum(bytes_transferred) AS BIGINT) AS bytes,
       max(event_time) AS event_time, max(archived_at) AS archived_at
FROM (SELECT *, unnest([0,10,20,30,40,50]) AS back FROM logs WHERE action = 'blocked'),
     LATERAL (SELECT epoch_us(archived_at) // 10000000 * 10 - back AS w)
GROUP BY source_ip, protocol, w HAVING count(*) >= 5),
volumes AS (
SELECT source_ip, protocol, CAST(sum(bytes_transferred) AS BIGINT) AS bytes,
       max(event_time) AS event_time, max(archived_at) AS archived_at
FROM logs GROUP BY source_ip, protocol HAVING sum(bytes_transferred) > 10485760),
alerts AS (
SELECT source_ip AS src_ip, dest_ip, protocol, request_path AS path, alert_type, event_time, archived_at,
       bytes_transferred, threat_label, action FROM matched
UNION ALL
SELECT source_ip, '-', protocol, 'authentication-target', 'REPEATED_BLOCKED_ACTIVITY', event_time, archived_at,
       bytes, 'suspicious', 'blocked' FROM blocked_windows
UNION ALL
SELECT source_ip, '-', protocol, 'high-volume-transfer', 'DATA_EXFILTRATION', event_time, archived_at,
       bytes, 'malicious', 'allowed' FROM volumes),
cat AS (SELECT *, {CATEGORY} AS attack_category FROM alerts)"""

# Live alerts of a finished replay: inserted at the end of the minute of their event time. The byte threshold is
# lowered so that the data at hand has volume alerts.
LIVE_VOLUME_BYTES = 400_000
_ID_PARTS = (
    "source_ip", "dest_ip", "protocol", "user_agent", "request_path", "alert_type", "CAST(count_value AS VARCHAR)",
    "strftime(event_time, '%Y-%m-%d %H:%M:%S')",
)
_ESCAPED = ", ".join(rf"coalesce(replace(replace({part}, '\', '\\'), '|', '\|'), '\N')" for part in _ID_PARTS)
_LIVE_ID = f"sha256(concat_ws('|', {_ESCAPED}))"
LIVE = f"""
live_blocked AS (
SELECT source_ip, protocol, w, count(*) AS n
FROM (SELECT *, unnest([0,10,20,30,40,50]) AS back FROM logs WHERE action = 'blocked'),
     LATERAL (SELECT epoch_us(event_time) // 10000000 * 10 - back AS w)
GROUP BY source_ip, protocol, w HAVING count(*) >= 5),
live_volume AS (
SELECT source_ip, protocol, epoch_us(event_time) // 10000000 * 10 AS w, CAST(sum(bytes_transferred) AS BIGINT) AS bytes
FROM logs GROUP BY ALL HAVING sum(bytes_transferred) > {LIVE_VOLUME_BYTES}),
live_raw AS (
SELECT source_ip, dest_ip, protocol, user_agent, request_path, alert_type, CAST(NULL AS BIGINT) AS count_value, event_time
FROM (SELECT *, {SIGNATURE} AS alert_type FROM logs) WHERE alert_type IS NOT NULL
UNION ALL
SELECT source_ip, '-', protocol, '-', 'authentication-target', 'REPEATED_BLOCKED_ACTIVITY', n, make_timestamp((w + 60) * 1000000)
FROM live_blocked
UNION ALL
SELECT source_ip, '-', protocol, '-', 'high-volume-transfer', 'DATA_EXFILTRATION', bytes, make_timestamp((w + 10) * 1000000)
FROM live_volume),
live AS (
SELECT *, CAST(inserted_at AS DATE) AS alert_date, {_LIVE_ID} AS alert_id
FROM (SELECT *, date_trunc('minute', event_time) + INTERVAL 1 MINUTE AS inserted_at FROM live_raw))"""

ALL_FLAGS = (
    "malicious", "suspicious", "blocked", "sqli", "xss", "scan", "bruteforce", "exfiltration", "file_attack",
    "admin_probe", "sensitive_file", "command_injection",
)
_CATEGORY_OF = {
    "sqli": "SQLI", "xss": "XSS", "scan": "SCAN", "bruteforce": "BRUTE_FORCE", "exfiltration": "EXFILTRATION",
    "file_attack": "FILE_ACCESS_ATTACK", "admin_probe": "ADMIN_PROBING", "sensitive_file": "SENSITIVE_FILE_DISCLOSURE",
    "command_injection": "COMMAND_INJECTION",
}


def _flag(name: str) -> str:
    if name in ("malicious", "suspicious"):
        return f"threat_label = '{name}'"
    return "action = 'blocked'" if name == "blocked" else f"attack_category = '{_CATEGORY_OF[name]}'"


def _flags(*without: str) -> str:
    return ", ".join(f"count(*) FILTER ({_flag(n)}) AS {n}_count" for n in ALL_FLAGS if n not in without)


def text_time(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column}"


_BYTES = "CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes"
_LAST = f"{text_time('max(event_time)', 'last_seen')}, {text_time('max(archived_at)', 'last_archived_at')}"
_PAIR_SCORE = """alert_count + malicious_count * 5 + sqli_count * 4 + xss_count * 3 + scan_count * 3
  + exfiltration_count * 6 + file_attack_count * 4 + admin_probe_count * 2 + sensitive_file_count * 4
  + command_injection_count * 5"""

VIEWS = f"""
ip_reputation AS (
SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH'
               WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT *, least(100, malicious_count * 5 + suspicious_count * 2 + blocked_count + sqli_count * 4 + xss_count * 3
         + scan_count * 3 + bruteforce_count * 4 + exfiltration_count * 6 + file_attack_count * 4
         + admin_probe_count * 2 + sensitive_file_count * 4 + command_injection_count * 5
         + unique_targets * 2) AS risk_score
      FROM (SELECT src_ip, count(*) AS total_alerts, {_flags()}, {_BYTES},
              count(DISTINCT dest_ip) AS unique_targets, count(DISTINCT protocol) AS unique_protocols,
              {text_time('min(event_time)', 'first_seen')}, {text_time('max(event_time)', 'last_seen')},
              {text_time('min(archived_at)', 'first_archived_at')}, {text_time('max(archived_at)', 'last_archived_at')}
            FROM cat GROUP BY src_ip))),
ip_stats AS (SELECT src_ip, count(*) AS alert_count, {_flags('blocked')} FROM cat GROUP BY src_ip),
global_ip_stats AS (SELECT * FROM ip_stats ORDER BY alert_count DESC, src_ip LIMIT 50),
global_protocol_stats AS (
SELECT protocol, count(*) AS alert_count, {_flags()}, {_BYTES},
       round(sum(bytes_transferred) / count(*), 2) AS avg_bytes_per_alert FROM cat GROUP BY protocol),
global_attack_patterns AS (
SELECT alert_type, attack_category, count(*) AS alert_count, count(DISTINCT src_ip) AS unique_attackers,
       count(DISTINCT dest_ip) AS unique_targets, {_BYTES}, {_LAST} FROM cat GROUP BY alert_type, attack_category),
ip_attack_types AS (
SELECT src_ip, alert_type, attack_category, count(*) AS alert_count, count(DISTINCT dest_ip) AS unique_targets,
       count(DISTINCT protocol) AS unique_protocols, {_BYTES}, {_LAST}
FROM cat GROUP BY src_ip, alert_type, attack_category),
targets AS (
SELECT *, least(100, {_PAIR_SCORE} + unique_attackers * 3) AS target_risk_score
FROM (SELECT dest_ip, count(*) AS alert_count, count(DISTINCT src_ip) AS unique_attackers,
        count(DISTINCT protocol) AS unique_protocols, {_flags('blocked', 'bruteforce')}, {_BYTES}, {_LAST}
      FROM cat WHERE dest_ip <> '-' GROUP BY dest_ip)),
target_ip_stats AS (SELECT * FROM targets ORDER BY target_risk_score DESC, alert_count DESC, dest_ip LIMIT 50),
threat_timeline AS (
SELECT strftime(archived_at, '%Y-%m-%d %H:%M:00') AS time_bucket, count(*) AS total_alerts, {_flags('blocked')},
       count(DISTINCT src_ip) AS unique_attackers, count(DISTINCT dest_ip) AS unique_targets,
       {text_time('min(event_time)', 'first_event_time')}, {text_time('max(event_time)', 'last_event_time')},
       {text_time('min(archived_at)', 'first_archived_at')}, {text_time('max(archived_at)', 'last_archived_at')}
FROM cat GROUP BY time_bucket),
history AS (
SELECT sha256(concat_ws('|', src_ip, dest_ip, protocol, path, alert_type, CAST(event_time AS VARCHAR),
                        CAST(archived_at AS VARCHAR))) AS row_hash,
       src_ip, dest_ip, protocol, path, alert_type, attack_category, event_time, archived_at, bytes_transferred
FROM cat),
full_history AS (
SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
                  strftime(archived_at, '%Y-%m-%d %H:%M:%S') AS archived_at) FROM history),
ip_historical_alerts AS (
SELECT * FROM full_history ORDER BY archived_at DESC, event_time DESC, row_hash, bytes_transferred LIMIT 20000),
pairs AS (
SELECT *, least(100, {_PAIR_SCORE}) AS relation_risk_score
FROM (SELECT src_ip, dest_ip, count(*) AS alert_count, count(DISTINCT protocol) AS unique_protocols,
        {_flags('blocked', 'bruteforce')}, {_BYTES}, {_LAST}
      FROM cat WHERE dest_ip <> '-' GROUP BY src_ip, dest_ip)),
attacker_victim_stats AS (
SELECT * FROM pairs ORDER BY relation_risk_score DESC, alert_count DESC, src_ip, dest_ip LIMIT 50),
risky AS (SELECT * FROM ip_reputation WHERE risk_score >= 60),
high_risk_ips AS (SELECT * FROM risky ORDER BY risk_score DESC, src_ip LIMIT 50)"""

DAY = "2024-01-01"
TODAY = f"today AS (SELECT * FROM live WHERE alert_date = DATE '{DAY}')"
_UPPER = "upper(coalesce(alert_type, ''))"


def _family(*parts: str) -> str:
    return "(" + " OR ".join(f"contains({_UPPER}, '{p}')" for p in parts) + ")"


_FAMILIES = {
    "scan": _family("NMAP", "MASSCAN", "NIKTO", "NESSUS", "WPSCAN", "ACUNETIX", "SCAN"),
    "sqli": _family("SQL"),
    "xss": _family("XSS"),
    "bruteforce": _family("BRUTE", "BLOCKED", "LOGIN"),
    "exfiltration": _family("EXFIL"),
}
SUMMARY = f"""
summary AS (
SELECT source_ip AS src_ip, count(*) AS active_alerts, strftime(max(inserted_at), '%Y-%m-%d %H:%M:%S') AS last_seen,
       count(DISTINCT dest_ip) FILTER (dest_ip NOT IN ('-', '')) AS unique_targets_live,
       count(DISTINCT protocol) FILTER (protocol NOT IN ('-', '')) AS unique_protocols_live,
       {', '.join(f'count(*) FILTER ({c}) AS {f}_live' for f, c in _FAMILIES.items())}
FROM today GROUP BY source_ip)"""

_COUNTS = (
    "malicious", "suspicious", "sqli", "xss", "scan", "bruteforce", "exfiltration", "file_attack", "admin_probe",
    "sensitive_file", "command_injection",
)
_LIVE_COUNTS = (
    "active_alerts", "unique_targets_live", "unique_protocols_live", "scan_live", "sqli_live", "xss_live",
    "bruteforce_live", "exfiltration_live",
)
_LEVEL = """CASE WHEN risk_score >= 80 OR active_alerts >= 10 OR sqli_live >= 5 THEN 'CRITICAL'
  WHEN risk_score >= 60 OR active_alerts >= 5 OR scan_live >= 4 THEN 'HIGH'
  WHEN risk_score >= 30 OR active_alerts > 0 THEN 'MEDIUM' ELSE 'LOW' END"""


# Action and reason of each level, and the signals with their batch and live counts. Written here a second
# time, so that a change on either side shows.
_RECOMMENDED = (
    ("CRITICAL", "BLOCK_IP", "Score historique critique ou forte activité live détectée."),
    ("HIGH", "MONITOR_AND_RATE_LIMIT", "Risque élevé : surveiller activement et limiter le trafic."),
    ("MEDIUM", "MONITOR", "Score modéré ou activité live récente : garder sous surveillance."),
    ("LOW", "NO_ACTION", "Aucun signal critique dans les vues actuelles."),
)
_SIGNALS = (
    ("Logs malveillants", "malicious_count", "0"), ("Logs suspects", "suspicious_count", "0"),
    ("SQLi / SQLMap", "sqli_count", "sqli_live"), ("Scans", "scan_count", "scan_live"), ("XSS", "xss_count", "xss_live"),
    ("Bruteforce", "bruteforce_count", "bruteforce_live"), ("Exfiltration", "exfiltration_count", "exfiltration_live"),
    ("Accès fichiers", "file_attack_count", "0"), ("Admin probing", "admin_probe_count", "0"),
    ("Fichiers sensibles", "sensitive_file_count", "0"), ("Command injection", "command_injection_count", "0"),
)


def _by_level(position: int) -> str:
    cases = " ".join(f"WHEN '{row[0]}' THEN '{row[position + 1]}'" for row in _RECOMMENDED)
    return f"CASE recommended_level {cases} END"


PROFILE = f"""
base AS (
SELECT coalesce(r.src_ip, s.src_ip) AS src_ip, r.src_ip IS NOT NULL AS batch, coalesce(risk_score, 0) AS risk_score,
       risk_level, coalesce(unique_targets, 0) AS unique_targets, coalesce(unique_protocols, 0) AS unique_protocols,
       coalesce(total_alerts, 0) AS total_alerts, {', '.join(f'coalesce({n}_count, 0) AS {n}_count' for n in _COUNTS)},
       s.last_seen AS last_live, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _LIVE_COUNTS)}
FROM ip_reputation r FULL JOIN summary s ON r.src_ip = s.src_ip),
profile AS (
SELECT *, {_by_level(0)} AS recommended_action, {_by_level(1)} AS recommendation_reason
FROM (SELECT * EXCLUDE (batch), CASE WHEN batch THEN 'ip_reputation' ELSE 'none' END AS historical_source,
        total_alerts + active_alerts AS total_alerts_visible, scan_count + scan_live AS scan_total_visible,
        sqli_count + sqli_live AS sqli_total_visible, xss_count + xss_live AS xss_total_visible,
        {_LEVEL} AS recommended_level FROM base))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


_L = _with(NETLOG, LOGS)
_A = _with(NETLOG, LOGS, ALERTS)
_V = _with(NETLOG, LOGS, ALERTS, VIEWS)
_LIVE = _with(NETLOG, LOGS, LIVE, TODAY, SUMMARY)
_P = _with(NETLOG, LOGS, ALERTS, VIEWS, LIVE, TODAY, SUMMARY, PROFILE)

_FEED = """CASE WHEN inserted_at IS NULL THEN 'N/A' ELSE strftime(inserted_at, '%H:%M:%S') END AS display_time,
  strftime(inserted_at, '%Y-%m-%dT%H:%M:%S') AS raw_time, alert_type, source_ip AS src_ip, dest_ip, protocol,
  request_path AS path, count_value, user_agent"""
_NEWEST = "ORDER BY inserted_at DESC, alert_id DESC"
_LABELS = (
    ("SQLi", "sqli_count"), ("Scan", "scan_count"), ("XSS", "xss_count"), ("Exfiltration", "exfiltration_count"),
    ("Accès fichiers", "file_attack_count"), ("Admin probing", "admin_probe_count"),
    ("Fichiers sensibles", "sensitive_file_count"), ("Command injection", "command_injection_count"),
)
_ALERT_TEXT = f"""src_ip, dest_ip, protocol, path, alert_type, {text_time('event_time')}, {text_time('archived_at')},
  bytes_transferred, threat_label, action"""


def _list(name: str, key: str, value: str, limit: int, table: str = "") -> str:
    return f"""SELECT * FROM (SELECT '{name}' AS list, {key} AS row_key, CAST({value} AS BIGINT) AS value,
      row_number() OVER (ORDER BY {value} DESC, {key}) AS position FROM {table or name}) WHERE position <= {limit}"""


_PAIR_KEY = "concat_ws('|', src_ip, dest_ip)"
_TYPE_KEY = "concat_ws('|', src_ip, alert_type)"
_HISTORY_KEY = "concat_ws('|', src_ip, archived_at, event_time, row_hash)"


# The stored views with their key and the table that has all their rows.
_STORED = (
    ("ip_reputation", "src_ip", "ip_reputation"), ("global_ip_stats", "src_ip", "ip_stats"),
    ("global_protocol_stats", "protocol", "global_protocol_stats"), ("global_attack_patterns", "alert_type", "global_attack_patterns"),
    ("ip_attack_types", _TYPE_KEY, "ip_attack_types"), ("target_ip_stats", "dest_ip", "targets"),
    ("threat_timeline", "time_bucket", "threat_timeline"), ("ip_historical_alerts", _HISTORY_KEY, "full_history"),
    ("attacker_victim_stats", _PAIR_KEY, "pairs"), ("high_risk_ips", "src_ip", "risky"),
)


def _cells(*columns: str) -> str:
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-') AS {c}" for c in columns)


_REPUTATION_COLUMNS = (
    "src_ip", "total_alerts", *[f"{n}_count" for n in ALL_FLAGS], "total_bytes", "unique_targets", "unique_protocols",
    "first_seen", "last_seen", "first_archived_at", "last_archived_at", "risk_score", "risk_level",
)

# Windows a stream has closed: those that end before the last time it saw, less the watermark delay.
STREAM_BLOCKED_CLOSED = """SELECT source_ip AS src_ip, protocol, n AS count_value, make_timestamp((w + 60) * 1000000) AS event_time
FROM live_blocked WHERE make_timestamp((w + 60) * 1000000)
   <= (SELECT max(event_time) FROM logs WHERE action = 'blocked') - INTERVAL 2 MINUTE"""
STREAM_VOLUME_CLOSED = """SELECT source_ip AS src_ip, protocol, bytes AS count_value, make_timestamp((w + 10) * 1000000) AS event_time
FROM live_volume WHERE make_timestamp((w + 10) * 1000000) <= (SELECT max(event_time) FROM logs) - INTERVAL 30 SECOND"""


def _stream(closed: str) -> str:
    return f"{_LIVE} SELECT src_ip, protocol, count_value, {text_time('event_time')} FROM ({closed})"


SQL = {
    # sources
    "log_to_json_roundtrip": f"""{_with(NETLOG)} SELECT source_ip AS key, timestamp, source_ip, dest_ip, protocol, action,
        threat_label, log_type, bytes_transferred, user_agent, request_path FROM netlog""",
    "replay_slice": f"""{_with(NETLOG)} SELECT event_id, timestamp, source_ip, request_path FROM netlog
        ORDER BY event_id LIMIT 500 OFFSET 2000""",
    "csv_to_alerts": rf"""{_with(NETLOG, LOGS)}, hostile AS (
        SELECT * REPLACE ('/q?a="x",' || request_path || '\";b' AS request_path) FROM logs)
        SELECT source_ip AS src_ip, dest_ip, request_path AS path, alert_type, {text_time('event_time')}, bytes_transferred
        FROM (SELECT *, {SIGNATURE} AS alert_type FROM hostile) WHERE alert_type IS NOT NULL""",
    "reject_counts": f"""{_with(NETLOG)} SELECT count(*) AS messages, count(*) FILTER (event_id % 7 = 0) AS rejected FROM netlog""",
    "view_scan": f"""{_V} {' UNION ALL '.join(
        f'SELECT {chr(39)}{view}{chr(39)} AS view, count(DISTINCT {key}) AS "rows", count(DISTINCT {key}) AS "keys" FROM {table}'
        for view, key, table in _STORED)}""",
    "json_props_parse": """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "archive_scan_hour": f"""{_with(NETLOG)} SELECT {text_time("date_trunc('hour', event_time)", 'hour_start')},
        count(*) AS logs, count(*) FILTER (lower(action) = 'blocked') AS blocked_logs,
        CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes
        FROM netlog WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00' AND event_time < TIMESTAMP '2024-01-01 01:00:00'
        GROUP BY 1""",
    "event_time_fallback": f"""{_with(NETLOG)} SELECT event_id, {text_time('''coalesce(
        CASE WHEN event_id % 3 = 0 THEN event_time END,
        CASE WHEN event_id % 5 <> 0 THEN CAST(timestamp AS TIMESTAMP) END)''', 'event_time')} FROM netlog""",
    "live_feed_latest": f"{_LIVE} SELECT {_FEED} FROM (SELECT * FROM today {_NEWEST} LIMIT 100)",
    "live_feed_by_ip": f"""{_LIVE} SELECT {_FEED} FROM
        (SELECT * FROM today WHERE source_ip = '185.10.10.5' {_NEWEST} LIMIT 200)""",
    "view_point_lookup": f"""{_V} SELECT src_ip AS row_key, src_ip, total_alerts, risk_score, risk_level, last_seen
        FROM ip_reputation WHERE src_ip = '185.10.10.5'""",
    "view_prefix_scan": f"""{_V} SELECT {_TYPE_KEY} AS row_key, src_ip, alert_type, alert_count, last_seen FROM ip_attack_types
        WHERE src_ip = '185.10.10.5'""",
    "ip_history_prefix_scan": f"""{_V} SELECT {_HISTORY_KEY} AS row_key, src_ip, alert_type, event_time, archived_at
        FROM (SELECT DISTINCT ON (row_hash) * FROM full_history WHERE src_ip = '185.10.10.5')
        ORDER BY archived_at DESC, event_time DESC, row_hash LIMIT 200""",
    # sinks
    "stream_archive_counts": f"""{_with(NETLOG)} SELECT CAST(year(event_time) AS BIGINT) AS year,
        CAST(month(event_time) AS BIGINT) AS month, CAST(day(event_time) AS BIGINT) AS day,
        CAST(hour(event_time) AS BIGINT) AS hour, count(*) AS logs,
        CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes FROM netlog GROUP BY ALL""",
    "stream_alert_sink": f"""{_LIVE} SELECT alert_type, count(*) AS alerts, {text_time('max(event_time)', 'last_event')} FROM (
        SELECT alert_type, event_time FROM live WHERE alert_type NOT IN ('REPEATED_BLOCKED_ACTIVITY', 'DATA_EXFILTRATION')
        UNION ALL SELECT 'REPEATED_BLOCKED_ACTIVITY', event_time FROM ({STREAM_BLOCKED_CLOSED})
        UNION ALL SELECT 'DATA_EXFILTRATION', event_time FROM ({STREAM_VOLUME_CLOSED})) GROUP BY alert_type""",
    "live_compaction_counts": f"""{_LIVE} SELECT alert_type, source_ip, count(*) AS alerts, {text_time('max(event_time)', 'last_event')}
        FROM (SELECT alert_type, source_ip, event_time FROM live
            WHERE alert_type NOT IN ('REPEATED_BLOCKED_ACTIVITY', 'DATA_EXFILTRATION')
          UNION ALL SELECT 'REPEATED_BLOCKED_ACTIVITY', src_ip, event_time FROM ({STREAM_BLOCKED_CLOSED})
          UNION ALL SELECT 'DATA_EXFILTRATION', src_ip, event_time FROM ({STREAM_VOLUME_CLOSED})) GROUP BY alert_type, source_ip""",
    "expired_partitions": f"""{_LIVE} SELECT CAST(day AS VARCHAR) AS alert_date, count(*) AS alerts,
        count(DISTINCT source_ip) AS sources
        FROM (SELECT source_ip, alert_date + CAST(length(source_ip) % 3 AS INTEGER) AS day FROM live)
        WHERE day >= DATE '2024-01-02' GROUP BY day""",
    "alert_null_defaults": f"""{_LIVE}, gaps AS (
        SELECT event_id, source_ip, alert_type, archived_at AS inserted_at,
          coalesce(CASE WHEN event_id % 2 <> 0 THEN dest_ip END, '-') AS dest_ip,
          coalesce(CASE WHEN event_id % 3 <> 0 THEN request_path END, '-') AS request_path,
          coalesce(CASE WHEN event_id % 5 <> 0 THEN protocol END, '-') AS protocol,
          coalesce(CASE WHEN event_id % 7 <> 0 THEN user_agent END, '-') AS user_agent,
          coalesce(CASE WHEN event_id % 11 <> 0 THEN event_time END, archived_at) AS event_time,
          CAST(NULL AS BIGINT) AS count_value
        FROM (SELECT *, {SIGNATURE} AS alert_type FROM logs) WHERE alert_type IS NOT NULL)
        SELECT CAST(CAST(inserted_at AS DATE) AS VARCHAR) AS alert_date, {text_time('inserted_at')}, {_LIVE_ID} AS alert_id,
          source_ip, dest_ip, alert_type, request_path, {text_time('event_time')}, protocol, user_agent FROM gaps""",
    "view_export_text": f"""{_V} SELECT src_ip AS row_key, {_cells(*_REPUTATION_COLUMNS)} FROM ip_reputation""",
    "view_row_keys": f"""{_V} SELECT 'ip_reputation' AS view, src_ip AS row_key FROM ip_reputation
        UNION ALL SELECT 'global_ip_stats', src_ip FROM ip_stats
        UNION ALL SELECT 'global_protocol_stats', protocol FROM global_protocol_stats
        UNION ALL SELECT 'global_attack_patterns', alert_type FROM global_attack_patterns
        UNION ALL SELECT 'ip_attack_types', {_TYPE_KEY} FROM ip_attack_types
        UNION ALL SELECT 'target_ip_stats', dest_ip FROM targets
        UNION ALL SELECT 'threat_timeline', time_bucket FROM threat_timeline
        UNION ALL SELECT 'ip_historical_alerts', key FROM (SELECT DISTINCT {_HISTORY_KEY} AS key FROM full_history)
        UNION ALL SELECT 'attacker_victim_stats', {_PAIR_KEY} FROM pairs
        UNION ALL SELECT 'high_risk_ips', src_ip FROM risky""",
    "kpi_total_unique_targets": f"""{_A} SELECT count(DISTINCT dest_ip) AS total_unique_targets FROM alerts WHERE dest_ip <> '-'""",
    "view_kpi_row": f"""{_V} SELECT dest_ip AS row_key, CAST(NULL AS VARCHAR) AS row_type,
        CAST(alert_count AS VARCHAR) AS alert_count, CAST(target_risk_score AS VARCHAR) AS target_risk_score,
        CAST(NULL AS VARCHAR) AS total_unique_targets FROM targets
        UNION ALL SELECT '__KPI_TOTAL__', 'kpi', NULL, NULL, CAST((SELECT count(*) FROM targets) AS VARCHAR)""",
    "live_retention_24h": f"""{_LIVE} SELECT alert_id, source_ip, alert_type, {text_time('inserted_at')} FROM live
        WHERE inserted_at > TIMESTAMP '2024-01-02 00:10:00' - INTERVAL 24 HOUR""",
    # projections
    "archive_date_parts": f"""{_with(NETLOG)} SELECT event_id, CAST(year(event_time) AS BIGINT) AS year,
        CAST(month(event_time) AS BIGINT) AS month, CAST(day(event_time) AS BIGINT) AS day,
        CAST(hour(event_time) AS BIGINT) AS hour FROM netlog""",
    "normalize_logs": f"""{_L} SELECT event_id, source_ip, dest_ip, protocol, action, threat_label, user_agent, request_path,
        bytes_transferred FROM logs""",
    "alert_category": f"{_A} SELECT alert_type, attack_category, count(*) AS alerts FROM cat GROUP BY ALL",
    "alert_flags": f"""{_A} SELECT src_ip, alert_type, threat_label, action, {text_time('event_time')},
        {', '.join(f'CASE WHEN {_flag(n)} THEN 1 ELSE 0 END AS is_{n}' for n in ALL_FLAGS)} FROM cat""",
    "alert_row_hash": f"""{_V} SELECT row_hash, alert_type, bytes_transferred FROM history""",
    "alert_display_family": f"""{_A} SELECT alert_type, CASE
        WHEN contains(alert_type, 'SQL') OR contains(alert_type, 'XSS') OR contains(alert_type, 'CMD') THEN 'sql'
        WHEN contains(alert_type, 'NMAP') OR contains(alert_type, 'NIKTO') OR contains(alert_type, 'SCAN') THEN 'scan'
        WHEN contains(alert_type, 'BLOCKED') OR contains(alert_type, 'LOGIN') OR contains(alert_type, 'BRUTE') THEN 'brute'
        WHEN contains(alert_type, 'EXFIL') THEN 'exfil' ELSE 'default' END AS family, count(*) AS alerts
        FROM alerts GROUP BY ALL""",
    "relation_level": f"""{_V} SELECT src_ip, dest_ip, relation_risk_score, CASE WHEN relation_risk_score >= 80 THEN 'Critique'
        WHEN relation_risk_score >= 50 THEN 'Élevé' WHEN relation_risk_score >= 20 THEN 'Moyen' ELSE 'Faible' END AS level
        FROM pairs""",
    "target_dominant_type": f"""{_V} SELECT dest_ip, CASE WHEN n > 0 THEN concat(name, ' (', n, ')') ELSE '-' END AS dominant_type
        FROM (SELECT dest_ip, n, name, row_number() OVER (PARTITION BY dest_ip ORDER BY n DESC, pos) AS rank FROM (
        {' UNION ALL '.join(f"SELECT dest_ip, {c} AS n, '{l}' AS name, {i} AS pos FROM targets" for i, (l, c) in enumerate(_LABELS))}
        )) WHERE rank = 1""",
    "target_type_text": f"""{_V} SELECT dest_ip, coalesce(nullif(concat_ws(' | ',
        {', '.join(f"CASE WHEN {c} > 0 THEN concat('{l}=', {c}) END" for l, c in _LABELS)}), ''), '-') AS types FROM targets""",
    # detectors
    "signature_alerts": f"""{_A} SELECT {_ALERT_TEXT} FROM alerts
        WHERE alert_type NOT IN ('REPEATED_BLOCKED_ACTIVITY', 'DATA_EXFILTRATION')""",
    "signature_alert_counts": f"""{_L} SELECT alert_type, count(*) AS alerts FROM (SELECT {SIGNATURE} AS alert_type FROM logs)
        WHERE alert_type IS NOT NULL GROUP BY alert_type""",
    "page_signature_counts": f"""SELECT alert_type, count(*) AS pages FROM (SELECT CASE {_path_cases('html')} END AS alert_type
        FROM pages) WHERE alert_type IS NOT NULL GROUP BY alert_type""",
    "repeated_blocked_alerts": f"{_A} SELECT {_ALERT_TEXT} FROM alerts WHERE alert_type = 'REPEATED_BLOCKED_ACTIVITY'",
    "volume_alerts": f"{_A} SELECT {_ALERT_TEXT} FROM alerts WHERE alert_type = 'DATA_EXFILTRATION'",
    "activity_alerts": f"""{_A} SELECT {_ALERT_TEXT} FROM alerts
        WHERE alert_type IN ('REPEATED_BLOCKED_ACTIVITY', 'DATA_EXFILTRATION')""",
    "all_alerts_by_type": f"""{_A} SELECT alert_type, count(*) AS alerts, {_BYTES} FROM alerts GROUP BY alert_type""",
    "live_blocked_windows": f"""{_LIVE} SELECT source_ip, protocol, count_value, {text_time('event_time')} FROM live
        WHERE alert_type = 'REPEATED_BLOCKED_ACTIVITY'""",
    "live_volume_windows": f"""{_LIVE} SELECT source_ip, protocol, count_value, {text_time('event_time')} FROM live
        WHERE alert_type = 'DATA_EXFILTRATION'""",
    "stream_signature_counts": f"""{_LIVE} SELECT alert_type, count(*) AS alerts FROM live
        WHERE alert_type NOT IN ('REPEATED_BLOCKED_ACTIVITY', 'DATA_EXFILTRATION') GROUP BY alert_type""",
    "stream_repeated_blocked": _stream(STREAM_BLOCKED_CLOSED),
    "stream_volume": _stream(STREAM_VOLUME_CLOSED),
    # views
    "ip_reputation": f"{_V} SELECT * FROM ip_reputation",
    "global_ip_stats": f"{_V} SELECT * FROM global_ip_stats",
    "global_protocol_stats": f"{_V} SELECT * FROM global_protocol_stats",
    "global_attack_patterns": f"{_V} SELECT * FROM global_attack_patterns",
    "ip_attack_types": f"{_V} SELECT * FROM ip_attack_types",
    "target_ip_stats": f"{_V} SELECT * FROM target_ip_stats",
    "threat_timeline": f"{_V} SELECT * FROM threat_timeline",
    "ip_historical_alerts": f"{_V} SELECT * FROM ip_historical_alerts",
    "ip_historical_newest_500": f"""{_V} SELECT * FROM full_history
        ORDER BY archived_at DESC, event_time DESC, row_hash, bytes_transferred LIMIT 500""",
    "attacker_victim_stats": f"{_V} SELECT * FROM attacker_victim_stats",
    "high_risk_ips": f"{_V} SELECT * FROM high_risk_ips",
    "log_and_alert_counts": f"""{_A} SELECT 'logs' AS "table", count(*) AS "rows" FROM logs
        UNION ALL SELECT 'alerts', count(*) FROM alerts""",
    # serving
    "live_count_by_day": f"{_LIVE} SELECT CAST(alert_date AS VARCHAR) AS alert_date, count(*) AS alerts FROM live GROUP BY alert_date",
    "live_kpis": f"""{_LIVE} SELECT count(*) AS loaded, count(DISTINCT source_ip) AS live_ips,
        strftime(max(inserted_at), '%H:%M:%S') AS live_last, (SELECT count(*) FROM today) AS live_total
        FROM today""",
    "live_summary_by_ip": f"{_LIVE} SELECT * FROM summary",
    "live_dimension_counts": f"""{_LIVE} SELECT source_ip AS src_ip, dimension, value, count(*) AS alerts FROM (
        SELECT source_ip, 'alert_type' AS dimension, alert_type AS value FROM today
        UNION ALL SELECT source_ip, 'protocol', protocol FROM today
        UNION ALL SELECT source_ip, 'dest_ip', dest_ip FROM today) GROUP BY ALL""",
    "live_newest_per_ip": f"""{_LIVE} SELECT {_FEED}, position FROM (SELECT *,
        row_number() OVER (PARTITION BY source_ip {_NEWEST}) AS position FROM today) WHERE position <= 100""",
    "live_feed_page": f"""{_LIVE} SELECT {_FEED}, CAST(3 AS BIGINT) AS page, pages, position FROM (
        SELECT *, greatest(1, CAST(ceil(count(*) OVER () / 100) AS BIGINT)) AS pages,
          row_number() OVER ({_NEWEST}) AS position FROM today)
        WHERE position BETWEEN 201 AND 300""",
    "risk_distribution": f"""{_V} SELECT name, count(risk_level) AS value FROM
        (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) AS levels(name) LEFT JOIN ip_reputation ON risk_level = name
        GROUP BY name""",
    "reputation_with_last_live": f"""{_P} SELECT r.src_ip, risk_score, risk_level, total_alerts,
        {text_time('last_live')} FROM ip_reputation r LEFT JOIN (SELECT source_ip AS src_ip, max(inserted_at) AS last_live
        FROM today GROUP BY source_ip) l ON r.src_ip = l.src_ip""",
    "ip_profile": f"{_P} SELECT * FROM profile",
    "ip_profile_one": f"{_P} SELECT * FROM profile WHERE src_ip = '185.10.10.5'",
    "ip_profile_fallback": f"""{_P}, half AS (SELECT * FROM ip_reputation WHERE CAST(split_part(src_ip, '.', -1) AS INTEGER) % 2 = 0)
        SELECT coalesce(h.src_ip, s.src_ip) AS src_ip, CASE WHEN h.src_ip IS NOT NULL THEN 'ip_reputation'
            WHEN g.src_ip IS NOT NULL THEN 'global_ip_stats' ELSE 'none' END AS historical_source,
          coalesce(h.total_alerts, g.alert_count, 0) AS total_alerts, coalesce(h.risk_score, 0) AS risk_score,
          coalesce(h.sqli_count, g.sqli_count, 0) AS sqli_count, coalesce(s.active_alerts, 0) AS active_alerts,
          coalesce(h.total_alerts, g.alert_count, 0) + coalesce(s.active_alerts, 0) AS total_alerts_visible
        FROM half h FULL JOIN summary s ON h.src_ip = s.src_ip LEFT JOIN ip_stats g ON g.src_ip = coalesce(h.src_ip, s.src_ip)""",
    "ip_one": f"""{_P}
        SELECT 'relations' AS part, position, dest_ip AS value FROM (SELECT dest_ip, row_number() OVER (ORDER BY
            relation_risk_score DESC, alert_count DESC, dest_ip) AS position FROM pairs WHERE src_ip = '185.10.10.5')
          WHERE position <= 30
        UNION ALL SELECT 'types', position, alert_type FROM (SELECT alert_type, row_number() OVER (ORDER BY alert_count DESC,
            alert_type) AS position FROM ip_attack_types WHERE src_ip = '185.10.10.5') WHERE position <= 50
        UNION ALL SELECT 'history', position, row_hash FROM (SELECT row_hash, row_number() OVER (ORDER BY archived_at DESC,
            event_time DESC, row_hash, bytes_transferred) AS position FROM history WHERE src_ip = '185.10.10.5')
          WHERE position <= 200
        UNION ALL SELECT 'live', position, alert_type FROM (SELECT alert_type, row_number() OVER ({_NEWEST}) AS position
            FROM today WHERE source_ip = '185.10.10.5') WHERE position <= 100""",
    "ip_recommendation": f"""{_P} SELECT src_ip, risk_score, active_alerts, recommended_level, recommended_action,
        recommendation_reason FROM profile""",
    "ip_combined_totals": f"""{_P} SELECT src_ip, total_alerts_visible, scan_total_visible, sqli_total_visible,
        xss_total_visible FROM profile""",
    "ip_signal_matrix": f"""{_P} SELECT src_ip, signal, batch, live, batch + live AS total FROM (
        {' UNION ALL '.join(f"SELECT src_ip, '{l}' AS signal, {b} AS batch, {v} AS live FROM profile" for l, b, v in _SIGNALS)}
        ) WHERE batch + live >= 1""",
    "ip_relations": f"""{_V} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY relation_risk_score DESC,
        alert_count DESC, dest_ip) AS position FROM pairs) WHERE position <= 30""",
    "ip_top_types": f"""{_V} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY alert_count DESC,
        alert_type) AS position FROM ip_attack_types) WHERE position <= 50""",
    "ip_recent_history": f"""{_V} SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
        strftime(archived_at, '%Y-%m-%d %H:%M:%S') AS archived_at) FROM (SELECT *, row_number() OVER (PARTITION BY src_ip
        ORDER BY archived_at DESC, event_time DESC, row_hash, bytes_transferred) AS position FROM history) WHERE position <= 200""",
    "analytics_kpis": f"""{_V} SELECT 'ip_reputation' AS "table", count(*) AS "rows" FROM ip_reputation
        UNION ALL SELECT 'high_risk_ips', count(*) FROM ip_reputation WHERE risk_score >= 60
        UNION ALL SELECT 'attacker_victim_stats', count(*) FROM pairs
        UNION ALL SELECT 'threat_timeline', count(*) FROM threat_timeline
        UNION ALL SELECT 'global_attack_patterns', count(*) FROM global_attack_patterns
        UNION ALL SELECT 'global_protocol_stats', count(*) FROM global_protocol_stats
        UNION ALL SELECT 'target_ip_stats', count(*) FROM targets""",
    "analytics_lists": f"""{_V} {' UNION ALL '.join([
        _list('ip_reputation', 'src_ip', 'risk_score', 100), _list('high_risk_ips', 'src_ip', 'risk_score', 100, 'risky'),
        _list('target_ip_stats', 'dest_ip', 'target_risk_score', 100, 'targets'),
        _list('attacker_victim_stats', _PAIR_KEY, 'relation_risk_score', 100, 'pairs'),
        _list('global_protocol_stats', 'protocol', 'alert_count', 50),
        _list('global_attack_patterns', 'alert_type', 'alert_count', 80)])}""",
    "global_bundle": f"""{_V} {' UNION ALL '.join([
        _list('global_ip_stats', 'src_ip', 'alert_count', 100, 'ip_stats'), _list('global_protocol_stats', 'protocol', 'alert_count', 100),
        _list('global_attack_patterns', 'alert_type', 'alert_count', 100)])}""",
    "timeline_last_24": f"{_V} SELECT * FROM threat_timeline ORDER BY time_bucket DESC LIMIT 24",
    "sort_text_numeric": f"""{_V}, cells AS (
        SELECT src_ip AS row_key, CASE WHEN total_alerts % 7 = 0 THEN '-' WHEN total_alerts % 11 = 0 THEN 'n/a'
               ELSE CAST(risk_score AS VARCHAR) END AS risk_score FROM ip_reputation)
        SELECT row_key, risk_score, coalesce(TRY_CAST(risk_score AS DOUBLE), 0) AS number FROM cells
        ORDER BY number DESC, row_key LIMIT 100""",
}

# Messages that arrive in eight batches: every 13th two batches late, every 29th once more in the batch after.
_ARRIVALS = """arrivals AS (
SELECT * EXCLUDE (first), unnest(CASE WHEN event_id % 29 = 0 THEN [first, least(first + 1, 7)] ELSE [first] END) AS batch FROM (
    SELECT *, least((event_id - min(event_id) OVER ()) * 8 // (max(event_id) OVER () - min(event_id) OVER () + 1)
                    + CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END, 7) AS first FROM logs)),
-- Late rows are told by the watermark of the batch before, which knows the batches up to the second last.
marks AS (SELECT b.batch, coalesce(max(a.event_time) - INTERVAL 30 SECOND, TIMESTAMP '1970-01-01') AS mark
    FROM (SELECT unnest(range(8)) AS batch) b LEFT JOIN arrivals a ON a.batch <= b.batch - 2 GROUP BY b.batch),
timely AS (SELECT a.*, event_time <= mark AS late FROM arrivals a JOIN marks USING (batch))"""
_SIGNED = f"(SELECT *, {SIGNATURE} AS alert_type FROM logs)"
_REASONS = """CASE event_id % 23 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'no value' WHEN 2 THEN 'no value'
    WHEN 3 THEN 'no known field' WHEN 4 THEN 'a field of another type' WHEN 5 THEN 'not a JSON object' END"""

SQL |= {
    "stream_late_rows": f"""{_with(NETLOG, LOGS, _ARRIVALS)} SELECT CAST(batch AS BIGINT) AS batch, count(*) AS messages,
        count(*) FILTER (late) AS late_rows FROM timely GROUP BY batch""",
    "stream_late_windows": f"""{_with(NETLOG, LOGS, _ARRIVALS)},
        kept AS (SELECT DISTINCT ON (event_id) * FROM timely WHERE NOT late)
        SELECT source_ip AS src_ip, protocol, CAST(sum(bytes_transferred) AS BIGINT) AS count_value,
          {text_time('make_timestamp((epoch_us(event_time) // 10000000 * 10 + 10) * 1000000)', 'event_time')} FROM kept
        GROUP BY source_ip, protocol, epoch_us(event_time) // 10000000 HAVING sum(bytes_transferred) > {LIVE_VOLUME_BYTES}
          AND make_timestamp((epoch_us(any_value(kept.event_time)) // 10000000 * 10 + 10) * 1000000)
              <= (SELECT max(event_time) FROM logs) - INTERVAL 30 SECOND""",
    "stream_dual_delivery": f"""{_with(NETLOG, LOGS)} SELECT 'archive' AS job, count(*) AS due, count(*) AS delivered,
          CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS strange, CAST(0 AS BIGINT) AS doubled FROM logs
        UNION ALL SELECT 'alerts', count(*), count(*), 0, 0, 0 FROM {_SIGNED} WHERE alert_type IS NOT NULL""",
    "stream_retry": f"""{_with(NETLOG, LOGS)} SELECT alert_type, count(*) AS alerts, count(*) AS ids FROM {_SIGNED}
        WHERE alert_type IS NOT NULL AND event_id % 29 <> 0 GROUP BY alert_type""",
    "stream_alert_identity": f"""{_with(NETLOG, LOGS)} SELECT alert_type,
          count(*) + count(*) FILTER (event_id % 11 = 0) AS alerts, count(*) + count(*) FILTER (event_id % 11 = 0) AS ids
        FROM {_SIGNED} WHERE alert_type IS NOT NULL GROUP BY alert_type""",
    "rejected_messages": f"""{_with(NETLOG)}, spoiled AS (SELECT event_id AS position, {_REASONS} AS reason,
          CASE event_id % 23 WHEN 0 THEN 10 WHEN 1 THEN 1 WHEN 3 THEN 12 WHEN 5 THEN 6 WHEN 4 THEN
            length(to_json(struct_pack(timestamp, source_ip, dest_ip, protocol, action, threat_label, log_type,
                                       bytes_transferred := 'many', user_agent, request_path))) END AS length FROM netlog)
        SELECT reader, position, reason, CAST(length AS BIGINT) AS length
        FROM spoiled CROSS JOIN (VALUES ('batch'), ('stream')) AS readers(reader) WHERE reason IS NOT NULL""",
    "views_incremental": f"{_V} SELECT * FROM ip_reputation",
    "incremental_reads": f"""{_with(NETLOG)} SELECT CAST(least((event_id - low) * 3 // (high - low + 1) + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END, 2)
          AS BIGINT) AS refresh, count(DISTINCT date_trunc('hour', event_time)) AS files, count(*) AS logs
        FROM netlog, (SELECT min(event_id) AS low, max(event_id) AS high FROM events) GROUP BY 1""",
}
SQL |= {
    "replay_deep_slice": f"""{_with(NETLOG)} SELECT event_id, timestamp, source_ip, request_path FROM netlog
        QUALIFY row_number() OVER (ORDER BY event_id) > count(*) OVER () * 9 // 10
            AND row_number() OVER (ORDER BY event_id) <= count(*) OVER () * 9 // 10 + 500""",
    "view_scan_absent": f"""{_V} SELECT 'ip_reputation' AS "table", count(*) AS "rows" FROM ip_reputation
        UNION ALL SELECT 'target_ip_stats', count(*) FROM targets
        UNION ALL SELECT unnest([{', '.join(f"'{view}'" for view, _, _ in _STORED if view not in ('ip_reputation', 'target_ip_stats'))}]), 0""",
    "live_expired_rows": SQL["live_retention_24h"],
    "ip_profile_bucketed": SQL["ip_profile"],
}
