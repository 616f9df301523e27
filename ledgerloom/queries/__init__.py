"""All queries of the core with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["retrieval", "units", "facts", "versions", "calculations", "documents", "planning", "service", "grading", "suites"]


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{m}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_search"](spark, sf_dir)
