"""All queries of the core by name, and the SQL that each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("textmend.operators.typography", "textmend.operators.repairs", "textmend.operators.chapters", "textmend.operators.navigation", "textmend.operators.structure", "textmend.operators.paragraphs", "textmend.operators.markup", "textmend.operators.styles", "textmend.operators.classes", "textmend.operators.elements", "textmend.operators.containers")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= importlib.import_module(m).ORACLE
    return out
