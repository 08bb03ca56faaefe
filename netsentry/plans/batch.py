"""The batch job: logs to stored alerts, rollup and views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netsentry.operators.detect import all_alerts
from netsentry.operators.rollup import rollup
from netsentry.plans.store import materialize, new_version, publish, read_view, write_view
from netsentry.plans.views import all_views, high_risk_ips


def refresh_views(logs: DataFrame, path: str) -> str:
    """Recomputes all views from normalized logs and publishes them as one version.

    Logs are scanned twice (signatures; window and volume sums). The alerts and their rollup are stored tables of
    the same version, and the views read those; high_risk_ips reads the stored ip_reputation.
    """
    spark = logs.sparkSession
    version = new_version()
    alerts = materialize(all_alerts(logs), "alerts", f"{path}/alerts/version={version}")
    rolled = materialize(rollup(alerts), "rollup", f"{path}/rollup/version={version}")
    write_all_views(alerts, rolled, path, version)
    publish(spark, path, version)
    return version


def write_all_views(alerts: DataFrame, rolled: DataFrame, path: str, version: str) -> None:
    """Writes one version of the ten views, unpublished."""
    views = all_views(alerts, rolled)
    del views["high_risk_ips"]
    for name, view in views.items():
        write_view(name, view, path, version)
    reputation = read_view(alerts.sparkSession, path, "ip_reputation", version).drop("row_key")
    write_view("high_risk_ips", high_risk_ips(reputation, limit=None), path, version)
