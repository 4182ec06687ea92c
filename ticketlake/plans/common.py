"""Helpers shared by the query families of the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketlake.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]

# Float outputs are rounded to this many places in both engines, so that sums
# that differ only in the order of addition hash equal.
ROUND = 9


class Family:
    """Collects ``name -> (spark builder, oracle SQL or None)`` for one family."""

    def __init__(self) -> None:
        self.items: dict[str, tuple[QueryFn, str | None]] = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn: QueryFn) -> QueryFn:
            if name in self.items:
                raise KeyError(f"duplicate query {name}")
            self.items[name] = (fn, sql)
            return fn
        return deco


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scan, spread over the cores when the input is a single split."""
    from ticketlake.session import spread
    return spread(table(spark, sf, "documents"))


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_case_map(expr: str, mapping: dict[str, str]) -> str:
    """``CASE expr WHEN k THEN v ... ELSE expr END`` for a small dictionary."""
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {expr} END"
