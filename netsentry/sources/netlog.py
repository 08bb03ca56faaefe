"""Security log derived from a plain `events` table.

The driver's tables hold no security log, so this projection turns each event
into one log record. Integer arithmetic only: the result is the same on any
SQL engine. It is row-wise, so it adds no shuffle and keeps column pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the projection.
EPOCH = 1704067200
AGENTS = (
    "curl/7.68.0", "libssh", "SQLMap/1.6", "Nikto/2.1.6", "Nmap Scripting Engine", "masscan/1.3",
    "Nessus/10", "WPScan v3", "Acunetix", "Metasploit",
)
CLEAN_PATHS = ("/index.html", "/login", "/home", "/api/v1/items", "/styles.css", "/assets/logo.png")
ATTACK_PATHS = (
    "/s?id=1 OR 1=1", "/s?q=UNION  SELECT a", "/information_schema.tables", "/s?sleep (5)", "/s?benchmark(1)",
    "/xp_cmdshell", "/<script>x", "/javascript:x", "/x?onerror =1", "/x?onload=1", "/x?alert (1)", "/../../x",
    "/..%2F..%2fx", "/etc/passwd", "/win.ini", "/proc/self/environ", "/phpMyAdmin/", "/wp-login.php", "/xmlrpc.php",
    "/backup.sql", "/.env", "/.git/config", "/admin/x", "/x?cmd=ls", "/powershell", "/x?wget http://e",
    "/x?curl  http://e", "/certutil",
)


def _pick(words: tuple[str, ...], index: str) -> str:
    quoted = ", ".join(f"'{word}'" for word in words)
    return f"get(array({quoted}), cast({index} AS int))"


def netlog(events: DataFrame) -> DataFrame:
    """One log record per event, with `event_id`, `event_time` and `archived_at`; mixed-case action and label."""
    second = f"({EPOCH} + event_id div 10)"
    seed = "(event_id * 31 + user_id) % 64"
    return events.select(
        "event_id",
        F.expr(f"date_format(timestamp_seconds({second}), \"yyyy-MM-dd'T'HH:mm:ss\")").alias("timestamp"),
        F.expr(f"timestamp_seconds({second})").alias("event_time"),
        F.expr(f"timestamp_seconds(({second} div 60) * 60 + 60)").alias("archived_at"),
        F.expr(
            """CASE WHEN event_id % 10 < 6 THEN concat('185.10.10.', user_id % 24)
                    WHEN event_id % 10 < 8 THEN concat('172.16.0.', (event_id div 10) % 127)
                    ELSE concat('10.0.', (event_id * 7 + user_id) % 4, '.', (event_id div 10) % 251) END"""
        ).alias("source_ip"),
        F.expr("concat('192.168.1.', (event_id * 7 + user_id) % 13)").alias("dest_ip"),
        F.expr(_pick(("HTTP", "TCP", "SSH"), "(event_id % 4) % 3")).alias("protocol"),
        F.expr(
            """CASE WHEN event_type = 'error' OR (event_type = 'click' AND user_id % 4 = 0)
                    THEN 'BLOCKED' ELSE 'Allowed' END"""
        ).alias("action"),
        F.expr(
            """CASE event_type WHEN 'error' THEN 'Malicious' WHEN 'click' THEN 'suspicious'
                               WHEN 'purchase' THEN 'Suspicious' ELSE 'clean' END"""
        ).alias("threat_label"),
        F.expr(_pick(("firewall", "ids", "waf", "application"), "event_id % 4")).alias("log_type"),
        F.expr("cast(floor(value * 1500) AS int)").alias("bytes_transferred"),
        F.expr(
            f"CASE WHEN event_id % 24 < 14 THEN 'Mozilla/5.0' ELSE {_pick(AGENTS, 'event_id % 24 - 14')} END"
        ).alias("user_agent"),
        F.expr(
            f"""CASE WHEN {seed} < 36 THEN {_pick(CLEAN_PATHS, f'({seed}) % 6')}
                     ELSE {_pick(ATTACK_PATHS, f'{seed} - 36')} END"""
        ).alias("request_path"),
    )
