"""Every query of the core and its SQL."""

from __future__ import annotations

from filingloom.plans import analytics, answers, outcomes, records

# answers and outcomes add their queries to those of analytics
__all__ = ["analytics", "answers", "outcomes", "records"]


def queries() -> dict:
    return {name: q for m in (analytics, records) for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in (analytics, records) for name, s in m.oracle_sql().items()}
