"""The catalogue of queries and their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("relational", "inventory", "detect", "models", "signals", "graphs", "calls", "streams", "surface")


def _entries() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for family in FAMILIES:
        found.update(importlib.import_module(f"cipherlake.plans.{family}").QUERIES)
    return found


def flagship(spark: SparkSession) -> DataFrame:
    """De-duplicated findings of the sample source files: lines, noise filter, rule join, one finding per key."""
    from cipherlake.operators.detect import lines, match_text_rules
    from cipherlake.operators.relational import dedupe
    from cipherlake.sources.samples import files

    found = match_text_rules(lines(files(spark))).withColumnsRenamed({"path": "file_path", "line_no": "line_start"})
    return dedupe(found, ties=("algorithm",))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry[0] for name, entry in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for name, entry in _entries().items() if entry[1]}
