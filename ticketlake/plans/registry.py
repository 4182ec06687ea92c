"""Query registry: every implemented operator as ``(spark builder, oracle SQL)``."""

from __future__ import annotations

import importlib

from ticketlake.plans.common import QueryFn

FAMILIES = [
    "ticketlake.plans.q_text",
    "ticketlake.plans.q_rules",
    "ticketlake.plans.q_chain",
    "ticketlake.plans.q_completions",
    "ticketlake.plans.q_retrieval",
    "ticketlake.plans.q_triage",
    "ticketlake.plans.q_eval",
    "ticketlake.plans.q_monitor",
    "ticketlake.plans.q_features",
    "ticketlake.plans.q_corpus",
]


def _load():
    items: dict[str, tuple[QueryFn, str | None]] = {}
    for mod in FAMILIES:
        try:
            fam = importlib.import_module(mod).fam
        except ModuleNotFoundError as e:
            if e.name == mod:
                continue
            raise
        for k, v in fam.items.items():
            if k in items:
                raise KeyError(f"duplicate query {k}")
            items[k] = v
    return items


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _load().items() if v[1]}
