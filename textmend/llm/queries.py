"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("scans", "normalform", "residue", "names", "mojibake", "quality", "splitting", "leaks", "mixing", "subjects")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= importlib.import_module(f"textmend.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"textmend.llm.{m}"), "ORACLE", {})
    return out
