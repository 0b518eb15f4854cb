"""Relational queries as SQL that reads the same in both engines.

A query names its tables in braces; for Spark they are bound to views of the tables, so that column
pruning and filters reach the scans. MATCH(x, 'p') is a regular-expression test, DECIMAL points are doubles.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textmend.plans.runtime import table

_TABLE = re.compile(r"\{([a-z_]+)\}")
_MATCH = re.compile(r"MATCH\((.+?), '((?:[^']|'')*)'\)")


def spark_text(sql: str) -> str:
    """The text with its tests as Spark has them."""
    return _MATCH.sub(lambda m: f"regexp_like({m[1]}, r\"{m[2].replace(chr(39) * 2, chr(39))}\")", sql)


def spark_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of a session and a folder of tables."""
    text = spark_text(sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a folder's tables are views of its own, so that queries over two folders don't meet
        mark = f"{zlib.crc32(sf_dir.encode()):08x}"
        for t in dict.fromkeys(_TABLE.findall(text)):
            table(spark, sf_dir, t).createOrReplaceTempView(f"textmend_{t}_{mark}")
        return spark.sql(_TABLE.sub(rf"textmend_\1_{mark}", text))

    run.__doc__ = sql
    return run


def duck_sql(sql: str) -> str:
    return _TABLE.sub(r"\1", _MATCH.sub(lambda m: f"regexp_matches({m[1]}, '{m[2]}')", sql))
