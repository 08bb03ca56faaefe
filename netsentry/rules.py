"""Detection rules, category map, score weights and display labels.

Everything in this module is a fixed value: results are only right if these
tables hold exactly these entries in this order.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """One signature: a `literal` must occur in the lowercased text; where `pattern` is given it must match too.

    `literal` is one string or a tuple of alternatives.
    """

    alert_type: str
    literal: str | tuple[str, ...]
    pattern: str | None = None


# --- fixed values: signatures on the lowercased user agent, in priority order -------------------------------------
AGENT_RULES = (
    Rule("SQLMAP", "sqlmap"),
    Rule("NIKTO", "nikto"),
    Rule("NMAP", "nmap"),
    Rule("MASSCAN", "masscan"),
    Rule("NESSUS", "nessus"),
    Rule("WPSCAN", "wpscan"),
    Rule("ACUNETIX", "acunetix"),
    Rule("METASPLOIT", "metasploit"),
)

# --- fixed values: signatures on the lowercased request path, in priority order, after the user agent ones --------
PATH_RULES = (
    Rule("SQLI_TAUTOLOGY", "1=1", r"\bor\b\s+1=1"),
    Rule("SQLI_UNION", "union", r"union\s+select"),
    Rule("SQLI_INFO_SCHEMA", "information_schema"),
    Rule("SQLI_TIME_BASED", "sleep", r"sleep\s*\("),
    Rule("SQLI_BENCHMARK", "benchmark", r"benchmark\s*\("),
    Rule("SQLI_XP_CMDSHELL", "xp_cmdshell"),
    Rule("XSS_SCRIPT", "<script"),
    Rule("XSS_JS_URI", "javascript:"),
    Rule("XSS_ONERROR", "onerror", r"onerror\s*="),
    Rule("XSS_ONLOAD", "onload", r"onload\s*="),
    Rule("XSS_ALERT", "alert", r"alert\s*\("),
    Rule("PATH_TRAVERSAL", "../"),
    Rule("PATH_TRAVERSAL_ENCODED", "..%2f"),
    Rule("ETC_PASSWD_ACCESS", "/etc/passwd"),
    Rule("WIN_INI_ACCESS", "win.ini"),
    Rule("PROC_ENVIRON_ACCESS", "/proc/self/environ"),
    Rule("PHPMYADMIN", "phpmyadmin"),
    Rule("WP_LOGIN", "wp-login.php"),
    Rule("XMLRPC_PROBE", "xmlrpc.php"),
    Rule("BACKUP_FILE", "backup.sql"),
    Rule("ENV_FILE_ACCESS", ".env"),
    Rule("GIT_DISCLOSURE", ".git"),
    Rule("ADMIN_ACCESS", "/admin"),
    Rule("CMD_INJECTION", ("cmd", "exec", "command"), r"(cmd|exec|command)\s*="),
    Rule("POWERSHELL_PAYLOAD", "powershell"),
    Rule("WGET_PAYLOAD", "wget", r"wget\s+http"),
    Rule("CURL_PAYLOAD", "curl", r"curl\s+http"),
    Rule("CERTUTIL_PAYLOAD", "certutil"),
)

# --- fixed values: the two derived alerts --------------------------------------------------------------------------
REPEATED_BLOCKED = "REPEATED_BLOCKED_ACTIVITY"
REPEATED_BLOCKED_PATH = "authentication-target"
REPEATED_BLOCKED_MIN_EVENTS = 5
BLOCKED_WINDOW_SECONDS = 60
BLOCKED_SLIDE_SECONDS = 10
VOLUME = "DATA_EXFILTRATION"
VOLUME_PATH = "high-volume-transfer"
VOLUME_MIN_BYTES = 10 * 1024 * 1024
VOLUME_WINDOW_SECONDS = 10
NO_VALUE = "-"

# --- fixed values: category of an alert type; anything else is OTHER -----------------------------------------------
CATEGORY_PREFIXES = {"SQLI": "SQLI", "XSS": "XSS"}
CATEGORY_TYPES = {
    "SQLI": ("SQLMAP",),
    "XSS": (),
    "SCAN": ("NMAP", "MASSCAN", "NIKTO", "NESSUS", "WPSCAN", "ACUNETIX"),
    "BRUTE_FORCE": ("REPEATED_BLOCKED_ACTIVITY",),
    "EXFILTRATION": ("DATA_EXFILTRATION",),
    "FILE_ACCESS_ATTACK": (
        "PATH_TRAVERSAL",
        "PATH_TRAVERSAL_ENCODED",
        "ETC_PASSWD_ACCESS",
        "WIN_INI_ACCESS",
        "PROC_ENVIRON_ACCESS",
    ),
    "ADMIN_PROBING": ("ADMIN_ACCESS", "WP_LOGIN", "PHPMYADMIN", "XMLRPC_PROBE"),
    "SENSITIVE_FILE_DISCLOSURE": ("GIT_DISCLOSURE", "ENV_FILE_ACCESS", "BACKUP_FILE"),
    "COMMAND_INJECTION": (
        "CMD_INJECTION",
        "POWERSHELL_PAYLOAD",
        "WGET_PAYLOAD",
        "CURL_PAYLOAD",
        "CERTUTIL_PAYLOAD",
    ),
}
OTHER_CATEGORY = "OTHER"

# --- fixed values: indicator name -> category it marks --------------------------------------------------------------
CATEGORY_INDICATORS = {
    "sqli": "SQLI",
    "xss": "XSS",
    "scan": "SCAN",
    "bruteforce": "BRUTE_FORCE",
    "exfiltration": "EXFILTRATION",
    "file_attack": "FILE_ACCESS_ATTACK",
    "admin_probe": "ADMIN_PROBING",
    "sensitive_file": "SENSITIVE_FILE_DISCLOSURE",
    "command_injection": "COMMAND_INJECTION",
}

# --- fixed values: score weights -------------------------------------------------------------------------------------
IP_WEIGHTS = {
    "malicious_count": 5,
    "suspicious_count": 2,
    "blocked_count": 1,
    "sqli_count": 4,
    "xss_count": 3,
    "scan_count": 3,
    "bruteforce_count": 4,
    "exfiltration_count": 6,
    "file_attack_count": 4,
    "admin_probe_count": 2,
    "sensitive_file_count": 4,
    "command_injection_count": 5,
    "unique_targets": 2,
}
PAIR_WEIGHTS = {
    "alert_count": 1,
    "malicious_count": 5,
    "sqli_count": 4,
    "xss_count": 3,
    "scan_count": 3,
    "exfiltration_count": 6,
    "file_attack_count": 4,
    "admin_probe_count": 2,
    "sensitive_file_count": 4,
    "command_injection_count": 5,
}
TARGET_WEIGHTS = {**PAIR_WEIGHTS, "unique_attackers": 3}
SCORE_CAP = 100

# --- fixed values: lower bounds of the bands, highest first -----------------------------------------------------------
RISK_BANDS = ((80, "CRITICAL"), (60, "HIGH"), (30, "MEDIUM"))
LOWEST_RISK = "LOW"
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
HIGH_RISK_SCORE = 60
RELATION_BANDS = ((80, "Critique"), (50, "Élevé"), (20, "Moyen"))
LOWEST_RELATION = "Faible"

# --- fixed values: view sizes -----------------------------------------------------------------------------------------
TOP_N = 50
HISTORY_LIMIT = 20000
FEED_LIMITS = (20, 50, 100, 200, 300, 500, 1000)
FEED_DEFAULT = 100
LIVE_RETENTION_HOURS = 24

# --- fixed values: families of live alerts, by substring of the upper-case type -----------------------------------------
LIVE_FAMILIES = {
    "scan": ("NMAP", "MASSCAN", "NIKTO", "NESSUS", "WPSCAN", "ACUNETIX", "SCAN"),
    "sqli": ("SQL", "SQLMAP"),
    "xss": ("XSS",),
    "bruteforce": ("BRUTE", "BLOCKED", "LOGIN"),
    "exfiltration": ("EXFIL",),
}

# --- fixed values: display families, first match wins --------------------------------------------------------------------
DISPLAY_FAMILIES = (
    ("sql", ("SQL", "XSS", "CMD")),
    ("scan", ("NMAP", "NIKTO", "SCAN")),
    ("brute", ("BLOCKED", "LOGIN", "BRUTE")),
    ("exfil", ("EXFIL",)),
)
DEFAULT_FAMILY = "default"

# --- fixed values: display names of the attack counts, in display order ----------------------------------------------------
ATTACK_LABELS = (
    ("SQLi", "sqli_count"),
    ("Scan", "scan_count"),
    ("XSS", "xss_count"),
    ("Exfiltration", "exfiltration_count"),
    ("Accès fichiers", "file_attack_count"),
    ("Admin probing", "admin_probe_count"),
    ("Fichiers sensibles", "sensitive_file_count"),
    ("Command injection", "command_injection_count"),
)

# --- fixed values: rows of the signal matrix: label, batch count, live count (None: no live counterpart) --------------------
SIGNALS = (
    ("Logs malveillants", "malicious_count", None),
    ("Logs suspects", "suspicious_count", None),
    ("SQLi / SQLMap", "sqli_count", "sqli_live"),
    ("Scans", "scan_count", "scan_live"),
    ("XSS", "xss_count", "xss_live"),
    ("Bruteforce", "bruteforce_count", "bruteforce_live"),
    ("Exfiltration", "exfiltration_count", "exfiltration_live"),
    ("Accès fichiers", "file_attack_count", None),
    ("Admin probing", "admin_probe_count", None),
    ("Fichiers sensibles", "sensitive_file_count", None),
    ("Command injection", "command_injection_count", None),
)

# --- fixed values: recommendation per level ---------------------------------------------------------------------------------
RECOMMENDATIONS = {
    "CRITICAL": ("BLOCK_IP", "Score historique critique ou forte activité live détectée."),
    "HIGH": ("MONITOR_AND_RATE_LIMIT", "Risque élevé : surveiller activement et limiter le trafic."),
    "MEDIUM": ("MONITOR", "Score modéré ou activité live récente : garder sous surveillance."),
    "LOW": ("NO_ACTION", "Aucun signal critique dans les vues actuelles."),
}
