import pytest
from pyspark.sql import functions as F

from helpers import log, logs, plan
from netsentry import rules as R
from netsentry.functions.classify import attack_category, display_family, live_family_conditions
from netsentry.functions.match import signature_type
from netsentry.operators import detect, enrich

# Alert type: a path that must raise it and one that comes close but must not.
PATHS = {
    "SQLI_TAUTOLOGY": ("/a?id=5 OR  1=1", "/a?color 1=1"),
    "SQLI_UNION": ("/a?q=x UNION \t SELECT y", "/a?q=unionselect"),
    "SQLI_INFO_SCHEMA": ("/Information_Schema.tables", "/information-schema"),
    "SQLI_TIME_BASED": ("/a?SLEEP  (9)", "/sleep/9"),
    "SQLI_BENCHMARK": ("/a?benchmark(1,2)", "/benchmark/"),
    "SQLI_XP_CMDSHELL": ("/a;xp_CmdShell", "/xp_shell"),
    "XSS_SCRIPT": ("/a?q=<SCRIPT>", "/script"),
    "XSS_JS_URI": ("/a?u=JavaScript:x", "/javascript/x"),
    "XSS_ONERROR": ("/a?onerror \n=x", "/onerror"),
    "XSS_ONLOAD": ("/a?OnLoad=x", "/onloaded?x"),
    "XSS_ALERT": ("/a?Alert (1)", "/alerts"),
    "PATH_TRAVERSAL": ("/a/../b", "/a/..b"),
    "PATH_TRAVERSAL_ENCODED": ("/a/..%2Fb", "/a/.%2fb"),
    "ETC_PASSWD_ACCESS": ("/etc/PASSWD", "/etc-passwd"),
    "WIN_INI_ACCESS": ("/c/WIN.INI", "/winxini"),
    "PROC_ENVIRON_ACCESS": ("/proc/self/environ", "/proc/1/environ"),
    "PHPMYADMIN": ("/phpMyAdmin", "/php-my"),
    "WP_LOGIN": ("/wp-login.php", "/wp-loginxphp"),
    "XMLRPC_PROBE": ("/XMLRPC.php", "/xmlrpcxphp"),
    "BACKUP_FILE": ("/backup.SQL", "/backup_sql"),
    "ENV_FILE_ACCESS": ("/.ENV", "/env"),
    "GIT_DISCLOSURE": ("/.git/HEAD", "/git/head"),
    "ADMIN_ACCESS": ("/Admin", "/x-admin"),
    "CMD_INJECTION": ("/a?exec =ls", "/a?execs=ls"),
    "POWERSHELL_PAYLOAD": ("/PowerShell", "/power-shell"),
    "WGET_PAYLOAD": ("/a?wget  http://x", "/a?wget ftp://x"),
    "CURL_PAYLOAD": ("/a?curl http://x", "/a?curl/http"),
    "CERTUTIL_PAYLOAD": ("/CertUtil", "/cert-util"),
}


def found(spark, agent, path):
    typed = detect.signature(logs(spark, [log(user_agent=agent, request_path=path)])).collect()
    return typed[0]["alert_type"] if typed else None


def test_there_are_36_rules_and_each_has_a_case():
    assert len(R.AGENT_RULES) + len(R.PATH_RULES) == 36
    assert [r.alert_type for r in R.PATH_RULES] == list(PATHS)


def test_every_path_rule(spark):
    cases = [(name, text, True) for name, (text, _) in PATHS.items()]
    cases += [(name, text, False) for name, (_, text) in PATHS.items()]
    df = spark.createDataFrame(cases, "name string, path string, expected boolean").withColumn(
        "got", signature_type(F.lit("mozilla"), F.lower("path"))
    )
    for row in df.collect():
        assert (row["got"] == row["name"]) == row["expected"], row


def test_every_agent_rule(spark):
    df = spark.createDataFrame([(r.alert_type,) for r in R.AGENT_RULES], "name string").select(
        "name", signature_type(F.lower(F.concat(F.lit("x "), F.col("name"), F.lit("/1.0"))), F.lit("/")).alias("got")
    )
    assert all(row["name"] == row["got"] for row in df.collect())


def test_first_rule_wins(spark):
    assert found(spark, "sqlmap nikto", "/../etc/passwd") == "SQLMAP"
    assert found(spark, "Mozilla", "/../../etc/passwd") == "PATH_TRAVERSAL"
    assert found(spark, "Mozilla", "/admin?cmd=x") == "ADMIN_ACCESS"
    # A guarded rule whose pattern fails must let later rules through.
    assert found(spark, "Mozilla", "/union/.git") == "GIT_DISCLOSURE"


def test_null_texts(spark):
    assert found(spark, None, "/.git") == "GIT_DISCLOSURE"
    assert found(spark, "Nmap", None) == "NMAP"
    assert found(spark, None, None) is None
    assert found(spark, "Mozilla", "/index.html") is None


def test_signature_is_one_scan_without_shuffle_and_classifies_once(spark, tmp_path):
    logs(spark, [log()]).write.parquet(str(tmp_path / "logs"))
    text = plan(detect.signature(spark.read.parquet(str(tmp_path / "logs"))))
    assert "Exchange" not in text and text.count("FileScan") == 1
    assert text.count("Contains(_agent") == len(R.AGENT_RULES)
    assert "Python" not in text


def test_categories(spark):
    expected = {
        "SQLI_ANYTHING": "SQLI", "SQLMAP": "SQLI", "XSS_NEW": "XSS", "METASPLOIT": "OTHER", "WPSCAN": "SCAN",
        "REPEATED_BLOCKED_ACTIVITY": "BRUTE_FORCE", "DATA_EXFILTRATION": "EXFILTRATION",
        "PROC_ENVIRON_ACCESS": "FILE_ACCESS_ATTACK", "WP_LOGIN": "ADMIN_PROBING",
        "ENV_FILE_ACCESS": "SENSITIVE_FILE_DISCLOSURE", "CURL_PAYLOAD": "COMMAND_INJECTION",
    }
    df = spark.createDataFrame([(k,) for k in expected], "t string").select("t", attack_category(F.col("t")).alias("c"))
    assert dict(map(tuple, df.collect())) == expected


@pytest.mark.parametrize(
    "alert_type, family",
    [("SQLMAP", "sql"), ("CMD_INJECTION", "sql"), ("MASSCAN", "scan"), ("WP_LOGIN", "brute"),
     ("REPEATED_BLOCKED_ACTIVITY", "brute"), ("DATA_EXFILTRATION", "exfil"), ("GIT_DISCLOSURE", "default"), (None, "default")],
)
def test_display_family(spark, alert_type, family):
    df = spark.createDataFrame([(alert_type,)], "t string")
    assert df.select(display_family(F.col("t"))).first()[0] == family


def test_live_families_differ_from_categories(spark):
    df = spark.createDataFrame([("WP_LOGIN",)], "alert_type string")
    families = df.select(*[c.alias(n) for n, c in live_family_conditions(F.col("alert_type")).items()]).first().asDict()
    assert families == {"scan": False, "sqli": False, "xss": False, "bruteforce": True, "exfiltration": False}
    flags = enrich.with_indicators(
        enrich.categorize(df.withColumns({"threat_label": F.lit("brute-force"), "action": F.lit("blocked")}))
    ).first()
    assert flags["is_admin_probe"] == 1 and flags["is_bruteforce"] == 0
    # Labels other than malicious and suspicious count for nothing.
    assert flags["is_malicious"] == 0 and flags["is_suspicious"] == 0 and flags["is_blocked"] == 1
