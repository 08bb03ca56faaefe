"""Signature matching as one column expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsentry.rules import AGENT_RULES, PATH_RULES, Rule


def _hit(text: Column, rule: Rule) -> Column:
    # The substring test is a byte search without decoding the string; it keeps the regular expression,
    # where a rule has one, off nearly every row.
    literals = (rule.literal,) if isinstance(rule.literal, str) else rule.literal
    found = reduce(Column.__or__, [text.contains(literal) for literal in literals])
    return found if rule.pattern is None else found & text.rlike(rule.pattern)


def signature_type(
    user_agent: Column | None,
    path: Column | None,
    agent_rules: Sequence[Rule] = AGENT_RULES,
    path_rules: Sequence[Rule] = PATH_RULES,
) -> Column:
    """Alert type of the first rule that fires, null if none does. Both texts must be lowercase already.

    A null text fails its rules, because a null condition is not taken.
    """
    cases = [(user_agent, rule) for rule in agent_rules if user_agent is not None]
    cases += [(path, rule) for rule in path_rules if path is not None]
    (first_text, first_rule), *rest = cases
    return reduce(
        lambda chain, case: chain.when(_hit(*case), case[1].alert_type),
        rest,
        F.when(_hit(first_text, first_rule), first_rule.alert_type),
    )
