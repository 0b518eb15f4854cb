"""Views on the input tables that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.runtime import spread, table

#: Pages in eight ways of disrepair, so that every rule meets what it repairs; the same SQL in both engines.
WORN = """CASE chapter_id % 8
 WHEN 0 THEN replace(document, '. ', '... ')
 WHEN 1 THEN replace(replace(document, '. ', ' . . . '), ', ', ' ,')
 WHEN 2 THEN replace(replace(document, ' the ', ' don t '), ' de ', ' it s ')
 WHEN 3 THEN replace(document, '.' || chr(10), chr(10))
 WHEN 4 THEN replace(replace(document, ', ', ','), '. ', '.')
 WHEN 5 THEN replace(replace(document, ' of ', chr(9) || 'of  '), ' la ', '  la ')
 WHEN 6 THEN replace(replace(document, ' and ', ' dog s '), ' was ', ' IT IS HIS ')
 ELSE replace(replace(document, ' the ', ' "the" -- '), ' de ', ' twas — ') END"""

WORN_SQL = f"SELECT DISTINCT chapter_id, book_id, page_no, href, {WORN} AS t FROM chapters WHERE document IS NOT NULL"


def worn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter_id, book_id, page_no, href, t), a row for each row of the table: repeated rows are dropped by the caller,
    once the text is reduced to what is wanted of it."""
    return pages(spark, sf_dir).select("chapter_id", "book_id", "page_no", "href", F.expr(WORN).alias("t"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter_id, book_id, page_no, href, document) with the repeated rows."""
    return spread(table(spark, sf_dir, "chapters").where("document IS NOT NULL").select("chapter_id", "book_id", "page_no", "href", "document"))
