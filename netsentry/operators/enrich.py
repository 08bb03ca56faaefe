"""Category, indicators and hash of batch alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.functions.classify import attack_category, indicator_conditions
from netsentry.functions.text import row_hash

HASHED = ("src_ip", "dest_ip", "protocol", "path", "alert_type", "event_time", "archived_at")


def categorize(alerts: DataFrame) -> DataFrame:
    """Adds `attack_category`."""
    return alerts.withColumn("attack_category", attack_category(F.col("alert_type")))


def with_indicators(categorized: DataFrame) -> DataFrame:
    """Adds the 12 columns `is_*`, each 0 or 1."""
    conditions = indicator_conditions(F.col("attack_category"), F.col("threat_label"), F.col("action"))
    return categorized.withColumns(
        {f"is_{name}": F.when(condition, 1).otherwise(0) for name, condition in conditions.items()}
    )


def with_row_hash(alerts: DataFrame) -> DataFrame:
    """Adds `row_hash` over the seven identifying fields."""
    return alerts.withColumn("row_hash", row_hash(*HASHED))
