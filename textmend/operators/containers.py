"""Containers: checks and repairs over many files at once.

The tables hold no files; each page becomes a small book of its own, broken in one of eight ways, packed,
checked and repaired by one function over Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import table
from textmend.sources import container, epub


def broken(book: int, text: str, way: int) -> bytes:
    """A book of one page, broken in one of eight ways; 0 and 7 are sound."""
    files = {"mimetype": b"application/epub+zip", container.CONTAINER: container.container_xml("book.opf"), "book.opf": b'<package version="2.0"/>', "page.xhtml": text.encode("utf-8", "replace")}
    if way == 3:
        del files[container.CONTAINER]
    elif way == 4:
        files[container.CONTAINER] = container.container_xml("gone.opf")
    elif way == 5:
        files["second.opf"] = files["book.opf"]
        del files[container.CONTAINER]
    data = container.packed(files)
    if way == 1:
        return b"HTTP/1.1 200 OK\r\n\r\n" + data
    if way == 2:
        return data[: data.rfind(b"PK\x01\x02", 0, data.find(b"PK\x01\x02") + 4)]
    return b"no archive" if way == 6 else data


def small_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chapters").where("document IS NOT NULL").select("chapter_id", "document")

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"book": cols["chapter_id"], "content": [broken(k, d, k % 8) for k, d in zip(cols["chapter_id"], cols["document"], strict=True)]}

    return map_batches(rows, "book long, content binary", run)


def container_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failed check of every file."""
    return epub.checked(small_books(spark, sf_dir), repair=False).select("book", "valid", "failed").distinct()


def container_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done to every broken file, and whether it is sound now."""
    out = epub.checked(small_books(spark, sf_dir)).where("NOT valid")
    return out.select("book", F.col("content").isNotNull().alias("repaired"), F.array_join("actions", ", ").alias("actions")).distinct()


_C = "c AS (SELECT DISTINCT chapter_id AS book FROM chapters WHERE document IS NOT NULL)"
QUERIES = {"container_checks": container_checks, "container_repair": container_repair}
ORACLE = {
    "container_checks": f"WITH {_C} SELECT book, book % 8 IN (0, 7) AS valid, CASE book % 8 WHEN 1 THEN 'signature' WHEN 2 THEN 'opens' WHEN 3 THEN 'container' WHEN 4 THEN 'package' WHEN 5 THEN 'container' WHEN 6 THEN 'signature' END AS failed FROM c",
    "container_repair": f"WITH {_C} SELECT book, book % 8 IN (1, 2, 3, 4) AS repaired, CASE book % 8 WHEN 1 THEN 'trimmed' WHEN 2 THEN 'reindexed' WHEN 3 THEN 'container rewritten' WHEN 4 THEN 'container rewritten' WHEN 5 THEN '2 packages' ELSE 'index lost' END AS actions FROM c WHERE book % 8 NOT IN (0, 7)",
}
