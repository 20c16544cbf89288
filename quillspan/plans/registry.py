"""Registered queries with their independently written SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["calendar", "cells", "places"]


def _books():
    return [import_module(f"quillspan.plans.{m}").BOOK for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for b in _books() for k, v in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for b in _books() for k, v in b.sql.items()}
