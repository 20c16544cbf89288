"""A book of queries: each a function of (spark, sf_dir), with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that results keep, so that the order of a sum does not show.
PLACES = 6


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles at a fixed number of places."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(*columns: str) -> str:
    """The same in SQL: columns, or 'expression AS name'."""
    parts = (c.rpartition(" AS ") for c in columns)
    return ", ".join(f"round({a or n}, {PLACES}) AS {n}" for a, _, n in parts)


#: Named parts of SQL queries, each with those it needs.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    PARTS[name] = (needs, sql.strip())


def q(needs: tuple[str, ...], select: str, recursive: bool = False) -> str:
    """WITH the parts needed, in order, then the select."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in PARTS[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} AS (\n{PARTS[n][1]}\n)" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{select.strip()}" if parts else select.strip()
