"""Category, indicator and family expressions over an alert type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsentry.rules import (
    CATEGORY_INDICATORS,
    CATEGORY_PREFIXES,
    CATEGORY_TYPES,
    DEFAULT_FAMILY,
    DISPLAY_FAMILIES,
    LIVE_FAMILIES,
    OTHER_CATEGORY,
)


def _any(conditions) -> Column:
    return reduce(Column.__or__, conditions)


def attack_category(alert_type: Column) -> Column:
    """One of ten categories."""
    chain = F
    for category, types in CATEGORY_TYPES.items():
        tests = [alert_type.isin(*types)] if types else []
        if category in CATEGORY_PREFIXES:
            tests.insert(0, alert_type.startswith(CATEGORY_PREFIXES[category]))
        chain = chain.when(_any(tests), category)
    return chain.otherwise(OTHER_CATEGORY)


def indicator_conditions(category: Column, threat_label: Column, action: Column) -> dict[str, Column]:
    """The 12 indicators by name, as conditions: 9 on the category, 2 on the label, 1 on the action."""
    conditions = {name: category == wanted for name, wanted in CATEGORY_INDICATORS.items()}
    conditions["malicious"] = threat_label == "malicious"
    conditions["suspicious"] = threat_label == "suspicious"
    conditions["blocked"] = action == "blocked"
    return conditions


def display_family(alert_type: Column) -> Column:
    """Badge family of an alert type; the first match wins."""
    upper = F.upper(F.coalesce(alert_type, F.lit("")))
    chain = F
    for family, parts in DISPLAY_FAMILIES:
        chain = chain.when(_any(upper.contains(part) for part in parts), family)
    return chain.otherwise(DEFAULT_FAMILY)


def live_family_conditions(alert_type: Column) -> dict[str, Column]:
    """The five live families by substring. They differ from the categories on purpose: WP_LOGIN counts as
    bruteforce here but as ADMIN_PROBING there. One alert can belong to several families."""
    upper = F.upper(F.coalesce(alert_type, F.lit("")))
    return {family: _any(upper.contains(part) for part in parts) for family, parts in LIVE_FAMILIES.items()}
