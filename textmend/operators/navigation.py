"""Books, manifests, reading order and tables of contents.

Look-ups of the package become joins, "is not there" becomes an anti-join, "the one before" a window over an
explicit order. All dimension tables repeat rows; each query says what it drops them by. Null keys match
nothing; null labels and hrefs are kept where a row is about the entry itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.plans.relational import duck_sql, spark_sql
from textmend.plans.runtime import table

_ITEMS = "items AS (SELECT book_id, item_id, href, media_type, item_properties, min(spine_pos) AS spine_pos FROM {manifest} GROUP BY book_id, item_id, href, media_type, item_properties)"
_PAGE = "media_type IN ('application/xhtml+xml', 'text/html')"
_KIND = """CASE WHEN media_type IN ('application/xhtml+xml', 'text/html') THEN 'page' WHEN media_type = 'text/css' THEN 'style' WHEN media_type LIKE 'image/%' THEN 'image' WHEN media_type LIKE '%font%' THEN 'font'
 WHEN media_type LIKE 'audio/%' THEN 'audio' WHEN media_type LIKE 'video/%' THEN 'video' WHEN media_type = 'application/x-dtbncx+xml' THEN 'ncx' WHEN media_type IS NULL THEN 'unknown' ELSE 'other' END"""
_BOOK = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY loaded_at DESC NULLS LAST, source_path) AS latest FROM {books}) r WHERE latest = 1)"
_TOC = "t AS (SELECT DISTINCT book_id, entry_no, toc_depth, entry_label, href, target_file FROM {toc})"
_SPINE = f"""{_ITEMS}, ordered AS (SELECT book_id, item_id, href, spine_pos, spine_pos IS NOT NULL AS in_spine, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN spine_pos IS NULL THEN 1 ELSE 0 END, spine_pos, item_id, href) AS page_order
 FROM items WHERE {_PAGE})"""

SQL = {
    # pages in reading order: the spine's first, then those that only the manifest lists
    "spine_pages": f"WITH {_SPINE} SELECT book_id, item_id, href, in_spine, page_order FROM ordered",
    "manifest_only_pages": f"WITH {_SPINE} SELECT book_id, item_id, href FROM ordered WHERE NOT in_spine",
    "resource_kinds": f"WITH {_ITEMS} SELECT book_id, {_KIND} AS kind, count(*) AS files FROM items GROUP BY book_id, {_KIND}",
    "file_kind_counts": f"""WITH {_ITEMS}, k AS (SELECT book_id, {_KIND} AS kind FROM items)
SELECT book_id, count(*) AS files, count_if(kind = 'page') AS pages, count_if(kind = 'style') AS styles, count_if(kind = 'image') AS images, count_if(kind = 'font') AS fonts, count_if(kind IN ('audio', 'video')) AS media, count_if(kind NOT IN ('page', 'style', 'image', 'font', 'audio', 'video')) AS others FROM k GROUP BY book_id""",
    # a missing version counts as 1.2; versions below 3 need an upgrade
    "epub_versions": f"""WITH {_BOOK}, v AS (SELECT book_id, CASE WHEN trim(coalesce(epub_version, '')) = '' THEN '1.2' ELSE trim(epub_version) END AS version FROM b),
m AS (SELECT *, coalesce(TRY_CAST(split_part(version, '.', 1) AS INT), 0) AS major FROM v) SELECT book_id, version, CAST(major AS BIGINT) AS major, major < 3 AS needs_upgrade, '3.0' AS target FROM m""",
    "book_metadata": f"""WITH {_BOOK} SELECT book_id, coalesce(trim(title), '') AS title, coalesce(trim(creator), '') AS creator, coalesce(trim(lang_code), '') AS lang, coalesce(trim(publisher), '') AS publisher, coalesce(trim(book_identifier), '') AS identifier,
 coalesce(description, '') <> '' AS has_description, coalesce(rights, '') <> '' AS has_rights, coalesce(pub_date, '') AS pub_date, toc_source FROM b""",
    "summary_check": f"""WITH {_SPINE}, n AS (SELECT book_id, count(*) AS pages, count_if(in_spine) AS in_spine FROM ordered GROUP BY book_id), {_TOC}, e AS (SELECT book_id, count(*) AS entries, count_if(toc_depth = 1) AS top_entries FROM t GROUP BY book_id),
s AS (SELECT book_id, max(html_page_count) AS html_page_count, max(spine_entry_count) AS spine_entry_count, max(toc_entry_count) AS toc_entry_count FROM {{book_summaries}} GROUP BY book_id)
SELECT s.book_id, coalesce(n.pages, 0) AS pages, CAST(s.html_page_count AS BIGINT) AS pages_said, coalesce(n.in_spine, 0) AS in_spine, CAST(s.spine_entry_count AS BIGINT) AS in_spine_said, coalesce(e.entries, 0) AS entries, coalesce(e.top_entries, 0) AS top_entries, CAST(s.toc_entry_count AS BIGINT) AS entries_said
FROM s LEFT JOIN n ON s.book_id = n.book_id LEFT JOIN e ON s.book_id = e.book_id""",
    # flattened entries with file and fragment
    "toc_entries": f"WITH {_TOC} SELECT book_id, entry_no, toc_depth, entry_label, split_part(coalesce(href, ''), '#', 1) AS file, split_part(coalesce(href, ''), '#', 2) AS fragment, coalesce(lead(toc_depth) OVER (PARTITION BY book_id ORDER BY entry_no, href) > toc_depth, false) AS has_children FROM t",
    # entries whose file isn't in the book; an entry without an href is none
    "toc_missing_file": f"""WITH {_TOC}, {_ITEMS}, e AS (SELECT *, split_part(href, '#', 1) AS file FROM t WHERE coalesce(href, '') <> '')
SELECT e.book_id, e.entry_no, e.file FROM e LEFT ANTI JOIN items ON e.book_id = items.book_id AND e.file = items.href""",
    # entries whose file is there but without the anchor
    "toc_missing_anchor": f"""WITH {_TOC}, {_ITEMS}, e AS (SELECT *, split_part(href, '#', 1) AS file, split_part(href, '#', 2) AS fragment FROM t WHERE href LIKE '%#%'),
a AS (SELECT DISTINCT book_id, split_part(start_href, '#', 1) AS file, split_part(start_href, '#', 2) AS fragment FROM {{structure_nodes}} WHERE start_href LIKE '%#%'),
there AS (SELECT e.* FROM e LEFT SEMI JOIN items ON e.book_id = items.book_id AND e.file = items.href)
SELECT DISTINCT there.book_id, there.entry_no, there.file, there.fragment FROM there LEFT ANTI JOIN a ON there.book_id = a.book_id AND there.file = a.file AND there.fragment = a.fragment WHERE there.fragment <> ''""",
    # main pages that no entry points to; of a book without entries, all of them
    "toc_unreferenced_pages": f"""WITH {_TOC}, p AS (SELECT DISTINCT book_id, href FROM {{chapter_analyses}} WHERE matter_zone = 'main'), f AS (SELECT DISTINCT book_id, split_part(href, '#', 1) AS href FROM t WHERE href IS NOT NULL)
SELECT p.book_id, p.href FROM p LEFT ANTI JOIN f ON p.book_id = f.book_id AND p.href = f.href""",
    "toc_unreferenced_books": f"""WITH {_TOC}, p AS (SELECT DISTINCT book_id, href FROM {{chapter_analyses}} WHERE matter_zone = 'main'), f AS (SELECT DISTINCT book_id, split_part(href, '#', 1) AS href FROM t WHERE href IS NOT NULL),
u AS (SELECT p.book_id, p.href FROM p LEFT ANTI JOIN f ON p.book_id = f.book_id AND p.href = f.href) SELECT book_id, count(*) AS pages FROM u GROUP BY book_id""",
    # neighbours of one depth with the same target and no children are one entry; gaps and islands
    "toc_merged_labels": f"""WITH {_TOC}, w AS (SELECT *, lag(href) OVER (PARTITION BY book_id ORDER BY entry_no, href) AS h, lag(toc_depth) OVER (PARTITION BY book_id ORDER BY entry_no, href) AS d, lead(toc_depth) OVER (PARTITION BY book_id ORDER BY entry_no, href) AS next_d FROM t),
i AS (SELECT *, sum(CASE WHEN h = href AND d = toc_depth AND href <> '' AND coalesce(next_d, 0) <= toc_depth THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY entry_no, href ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM w)
SELECT book_id, min(entry_no) AS entry_no, min(href) AS href, count(*) AS merged, min_by(entry_label, entry_no) AS first_label FROM i GROUP BY book_id, island""",
    # a file's label is that of its first labelled entry
    "toc_first_label": f"""WITH {_TOC}, f AS (SELECT *, row_number() OVER (PARTITION BY book_id, split_part(href, '#', 1) ORDER BY entry_no, entry_label) AS first FROM t WHERE coalesce(href, '') <> '' AND coalesce(entry_label, '') <> '')
SELECT book_id, split_part(href, '#', 1) AS file, entry_label AS label FROM f WHERE first = 1""",
    # navigation document of books that need the upgrade: an entry for each page of the spine
    "nav_entries": f"""WITH {_BOOK}, {_SPINE}, {_TOC}, l AS (SELECT *, row_number() OVER (PARTITION BY book_id, split_part(href, '#', 1) ORDER BY entry_no, entry_label) AS first FROM t WHERE coalesce(href, '') <> '' AND coalesce(entry_label, '') <> ''),
c AS (SELECT book_id, href, max(title) AS title FROM {{chapters}} WHERE title IS NOT NULL GROUP BY book_id, href), old AS (SELECT book_id FROM b WHERE coalesce(TRY_CAST(split_part(epub_version, '.', 1) AS INT), 0) < 3)
SELECT o.book_id, o.page_order, o.href, coalesce(l.entry_label, c.title, o.href) AS label FROM ordered o JOIN old ON o.book_id = old.book_id
LEFT JOIN l ON l.book_id = o.book_id AND split_part(l.href, '#', 1) = o.href AND l.first = 1 LEFT JOIN c ON c.book_id = o.book_id AND c.href = o.href WHERE o.in_spine""",
    # the item marked as cover wins over one only named so; an image item that is no image is a problem
    "cover_check": f"""WITH {_BOOK}, {_ITEMS}, marked AS (SELECT book_id, min(item_id) AS item_id FROM items WHERE ' ' || coalesce(item_properties, '') || ' ' LIKE '% cover-image %' GROUP BY book_id),
named AS (SELECT book_id, min(item_id) AS item_id FROM items WHERE item_id LIKE '%cover%' AND media_type LIKE 'image/%' GROUP BY book_id)
SELECT b.book_id, coalesce(marked.item_id, named.item_id) AS cover_item, marked.item_id IS NULL AND named.item_id IS NULL AS missing, coalesce(marked.item_id <> named.item_id, false) AS mismatch,
 coalesce(i.media_type NOT LIKE 'image/%', false) AS not_an_image FROM b LEFT JOIN marked ON b.book_id = marked.book_id LEFT JOIN named ON b.book_id = named.book_id
LEFT JOIN (SELECT DISTINCT book_id, item_id, media_type FROM items) i ON i.book_id = b.book_id AND i.item_id = coalesce(marked.item_id, named.item_id)""",
    # pages of the chapters table that the manifest doesn't list, and the reverse
    "unlisted_pages": f"WITH {_ITEMS}, c AS (SELECT DISTINCT book_id, href FROM {{chapters}} WHERE href IS NOT NULL) SELECT c.book_id, c.href FROM c LEFT ANTI JOIN items ON c.book_id = items.book_id AND c.href = items.href",
    "listed_without_text": f"WITH {_ITEMS}, p AS (SELECT DISTINCT book_id, href FROM items WHERE {_PAGE}) SELECT p.book_id, p.href FROM p LEFT ANTI JOIN {{chapters}} c ON c.book_id = p.book_id AND c.href = p.href AND c.document IS NOT NULL",
}



def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each book that was loaded last."""
    order = Window.partitionBy("book_id").orderBy(F.desc_nulls_last("loaded_at"), "source_path")
    return table(spark, sf_dir, "books").withColumn("latest", F.row_number().over(order)).where("latest = 1")


def toc_merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one depth with the same target and no children are one entry: an entry goes to the last one before it that
    differs, or is one with children."""
    t = table(spark, sf_dir, "toc").select("book_id", "entry_no", "toc_depth", "entry_label", "href").distinct()
    w = Window.partitionBy("book_id").orderBy("entry_no", "href")
    same = (F.lag("href").over(w) == F.col("href")) & (F.lag("toc_depth").over(w) == F.col("toc_depth")) & (F.col("href") != "") & (F.coalesce(F.lead("toc_depth").over(w), F.lit(0)) <= F.col("toc_depth"))
    heads = t.withColumn("place", F.struct("entry_no", "href")).withColumn("head", F.when(~F.coalesce(same, F.lit(False)), F.struct("entry_no", "href"))).withColumn("head", F.last("head", ignorenulls=True).over(w))
    return heads.groupBy("book_id", "head").agg(F.min("entry_no").alias("entry_no"), F.min("href").alias("href"), F.count("*").alias("merged"), F.min_by("entry_label", "entry_no").alias("first_label")).drop("head")


def nav_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation document of the books that need the upgrade: an entry for each page of the spine, labelled by its first labelled
    entry, else by its title, else by its file."""
    old = _latest(spark, sf_dir).where(F.coalesce(F.substring_index("epub_version", ".", 1).try_cast("int"), F.lit(0)) < 3).select("book_id")
    items = table(spark, sf_dir, "manifest").where("media_type IN ('application/xhtml+xml', 'text/html')").groupBy("book_id", "item_id", "href", "media_type", "item_properties").agg(F.min("spine_pos").alias("spine_pos"))
    w = Window.partitionBy("book_id").orderBy(F.asc_nulls_last("spine_pos"), "item_id", "href")
    spine = items.withColumn("page_order", F.row_number().over(w)).where("spine_pos IS NOT NULL").join(old, "book_id")
    labels = table(spark, sf_dir, "toc").where("coalesce(href, '') <> '' AND coalesce(entry_label, '') <> ''").groupBy("book_id", F.substring_index("href", "#", 1).alias("href")).agg(F.min_by("entry_label", F.struct("entry_no", "entry_label")).alias("entry_label"))
    titles = table(spark, sf_dir, "chapters").where("title IS NOT NULL").groupBy("book_id", "href").agg(F.max("title").alias("title"))
    return spine.join(labels, ["book_id", "href"], "left").join(titles, ["book_id", "href"], "left").select("book_id", "page_order", "href", F.coalesce("entry_label", "title", "href").alias("label"))


def cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item marked as cover wins over one only named so; a cover that is no image, and two that differ, are problems."""
    items = table(spark, sf_dir, "manifest")
    marked = F.min(F.when(F.array_contains(F.split("item_properties", " "), "cover-image"), F.struct("item_id", "media_type")))
    named = F.min(F.when(F.contains("item_id", F.lit("cover")) & F.col("media_type").startswith("image/"), F.struct("item_id", "media_type")))
    per = items.groupBy("book_id").agg(marked.alias("m"), named.alias("n")).withColumn("c", F.coalesce("m", "n"))
    return _latest(spark, sf_dir).select("book_id").join(per, "book_id", "left").select(
        "book_id", F.col("c.item_id").alias("cover_item"), F.col("c").isNull().alias("missing"), F.coalesce(F.col("m.item_id") != F.col("n.item_id"), F.lit(False)).alias("mismatch"), F.coalesce(~F.col("c.media_type").startswith("image/"), F.lit(False)).alias("not_an_image")
    )


#: Queries with a form of their own; of the others both engines run the same text.
NATIVE = {"toc_merged_labels": toc_merged_labels, "nav_entries": nav_entries, "cover_check": cover_check}
QUERIES = {k: NATIVE.get(k) or spark_sql(v) for k, v in SQL.items()}
ORACLE = {k: duck_sql(v.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")) for k, v in SQL.items()}
