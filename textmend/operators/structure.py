"""Zones, labels and structure of books: front and back matter, thin pages, parts, confidence, boilerplate.

Reading order is page_no; pages without one come last. Three-valued flags are tested for true, false and null
one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.plans.relational import duck_sql, spark_sql, spark_text
from textmend.plans.runtime import spread, stage, table

LEAST_MARGIN, LEAST_WORDS = 3.0, 50
#: Pages in one bin of the running sum over a book.
PER_BIN = 1_000
#: A title is a line of so many signs at most.
TITLE = 120
_PAGES = "p AS (SELECT chapter_id, book_id, page_no, href, max(document) AS document FROM {chapters} GROUP BY chapter_id, book_id, page_no, href)"
_ORDER = "o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY coalesce(page_no, 2147483647), chapter_id) AS pos FROM p)"
_NODES = "n AS (SELECT DISTINCT node_id, book_id, parent_node_id, node_kind, title, start_href, start_page_no, in_winning_sequence, sequence_score, matched_anchor_id, content_length_ok, structurally_clean, split_confidence FROM {structure_nodes})"
_CONFIRMED = "confirmed AS (SELECT DISTINCT book_id, split_part(start_href, '#', 1) AS href FROM n WHERE in_winning_sequence = true AND node_kind = 'chapter')"
_ZONES = f"""{_PAGES}, {_ORDER}, {_NODES}, {_CONFIRMED}, bounds AS (SELECT o.book_id, min(pos) AS first_pos, max(pos) AS last_pos FROM o JOIN confirmed c ON o.book_id = c.book_id AND o.href = c.href GROUP BY o.book_id),
z AS (SELECT o.*, CASE WHEN b.first_pos IS NULL THEN 'unknown' WHEN o.pos < b.first_pos THEN 'front' WHEN o.pos > b.last_pos THEN 'back' ELSE 'main' END AS zone FROM o LEFT JOIN bounds b ON o.book_id = b.book_id)"""
_TEXT = "coalesce(document, '')"
# --- fixed values: what pages of front and back matter say, and how their files are named ------------------------
#: first pattern that a page's text shows; then the file name's hint; then the zone
_LABEL = f"""CASE WHEN MATCH({_TEXT}, '(?i)all rights reserved|copyright[ \\t\\n]*(?:©|[(]c[)])|(?:^|[^A-Za-z0-9_])isbn(?:$|[^A-Za-z0-9_])|library of congress|printed in the united states') THEN 'copyright'
 WHEN MATCH(substring({_TEXT}, 1, 200), '(?i)table of contents|^[ \\t\\n]*contents[ \\t\\n]*$') THEN 'table of contents' WHEN MATCH({_TEXT}, '(?i)acknowledge?ments') THEN 'acknowledgments' WHEN MATCH({_TEXT}, '(?i)(?:^|[^A-Za-z0-9_])afterword(?:$|[^A-Za-z0-9_])') THEN 'afterword'
 WHEN MATCH({_TEXT}, '(?i)about the author') THEN 'about the author' WHEN MATCH({_TEXT}, '(?i)(?:^|[^A-Za-z0-9_])colophon(?:$|[^A-Za-z0-9_])') THEN 'colophon' WHEN MATCH({_TEXT}, '(?i)(?:^|[^A-Za-z0-9_])dedicat(?:e|ed|ion)(?:$|[^A-Za-z0-9_])') THEN 'dedication'
 WHEN words <= 40 AND MATCH({_TEXT}, '(?i)^[ \\t\\n]*(?:for|to)[ \\t\\n]+[^ \\t\\n]') THEN 'dedication' WHEN words <= 60 AND MATCH({_TEXT}, '(?:^|\\n)[ \\t]*[—–-][ \\t]*[^ \\t\\n—–-][^\\n]*[ \\t\\n]*$') THEN 'epigraph' END"""
_HINT = "CASE " + " ".join(
    f"WHEN lower(href) LIKE '%{h}%' THEN '{label}'"
    for h, label in (("cover", "cover"), ("titlepage", "title page"), ("title-page", "title page"), ("copyright", "copyright"), ("dedicat", "dedication"), ("epigraph", "epigraph"), ("toc", "table of contents"), ("contents", "table of contents"),
                     ("acknowledg", "acknowledgments"), ("afterword", "afterword"), ("aboutauthor", "about the author"), ("about-author", "about the author"), ("colophon", "colophon"))
) + " END"
_WORDS = "WORDS(coalesce(document, ''))"
_LABELS = f"""{_ZONES}, w AS (SELECT *, {_WORDS} AS words FROM z), l AS (SELECT *, {_LABEL} AS text_label, {_HINT} AS href_label FROM w),
labels AS (SELECT chapter_id, book_id, href, zone, words, coalesce(text_label, href_label, CASE zone WHEN 'front' THEN 'front matter' WHEN 'back' THEN 'back matter' ELSE 'main content' END) AS label,
 CASE WHEN text_label IS NOT NULL THEN 'high' WHEN href_label IS NOT NULL THEN 'medium' WHEN zone IN ('front', 'back') THEN CASE WHEN words <= 150 THEN 'medium' ELSE 'low' END WHEN zone = 'main' THEN 'high' ELSE 'low' END AS confidence FROM l)"""
_THIN = f"{_LABELS}, a AS (SELECT chapter_id, max(paragraphs) AS paragraphs FROM {{chapter_analyses}} GROUP BY chapter_id), thin AS (SELECT l.*, a.paragraphs FROM labels l LEFT JOIN a ON l.chapter_id = a.chapter_id WHERE l.words < 50 OR a.paragraphs = 0)"
_TREE = f"""{_NODES}, placed AS (SELECT *, coalesce(start_page_no, 2147483647) AS p FROM n),
tree AS (SELECT *, CASE WHEN node_kind = 'chapter' THEN max(CASE WHEN node_kind = 'part' THEN node_id END) OVER (PARTITION BY book_id ORDER BY p, CASE WHEN node_kind = 'part' THEN 0 ELSE 1 END, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS part_before FROM placed)"""
_MARGIN = "m AS (SELECT book_id, max(CASE WHEN in_winning_sequence = true THEN sequence_score END) AS winner, max(CASE WHEN in_winning_sequence = false THEN sequence_score END) AS other FROM n GROUP BY book_id)"
_MARK = "(?i)[*]{2,}[ \\t\\n]*(?:START|END) OF (?:THIS|THE) PROJECT GUTENBERG EBOOK(?:[^A-Za-z0-9_*][^*]*)?[*]{2,}"
_MARKERS = f"""g AS (SELECT DISTINCT marker_id, book_id, href, detect_method, marker_side, marker_text FROM {{gutenberg_markers}}),
valid AS (SELECT *, CASE detect_method WHEN 'tag' THEN 0 ELSE 1 END AS method_rank FROM g WHERE detect_method = 'tag' OR MATCH(coalesce(marker_text, ''), '{_MARK}')),
{_PAGES}, {_ORDER}, v AS (SELECT valid.*, o.pos FROM valid LEFT JOIN o ON valid.book_id = o.book_id AND valid.href = o.href),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, marker_side ORDER BY method_rank, coalesce(pos, 2147483647), length(coalesce(marker_text, '')), marker_id) AS first FROM v) r WHERE first = 1)"""

_CUT = "cut AS (SELECT o.book_id, o.chapter_id, o.href FROM o JOIN picked k ON o.book_id = k.book_id AND k.marker_side = 'end' AND o.pos > k.pos WHERE EXISTS (SELECT 1 FROM {manifest} m WHERE m.book_id = o.book_id AND m.href = o.href AND m.spine_pos IS NOT NULL))"
_TOC_MATCH = f"""{_NODES}, c AS (SELECT *, split_part(start_href, '#', 1) AS file, split_part(start_href, '#', 2) AS fragment, coalesce(start_page_no, 2147483647) AS p FROM n WHERE node_kind = 'chapter' AND in_winning_sequence = true),
e AS (SELECT DISTINCT book_id, entry_no, split_part(href, '#', 1) AS file, split_part(href, '#', 2) AS fragment FROM {{toc}} WHERE coalesce(href, '') <> ''), a AS (SELECT *, row_number() OVER (PARTITION BY book_id, file, fragment ORDER BY p, node_id) AS nth, row_number() OVER (PARTITION BY book_id, file ORDER BY p, node_id) AS first FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY book_id, file, fragment ORDER BY entry_no) AS nth FROM e), m AS (SELECT node_id, min(entry_no) AS entry_no FROM (SELECT a.node_id, f.entry_no FROM a JOIN f ON a.book_id = f.book_id AND a.file = f.file AND a.fragment = f.fragment AND a.nth = f.nth WHERE f.fragment <> '' UNION ALL SELECT a.node_id, f.entry_no FROM a JOIN f ON a.book_id = f.book_id AND a.file = f.file WHERE f.fragment = '' AND a.first = 1) GROUP BY node_id)"""
_BOUNDARY_PARTS = f"""{_PAGES}, {_ORDER}, pw AS (SELECT *, {_WORDS} AS words, string_split(document, chr(10)) AS ls FROM o), ps AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pw),
pf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, href ORDER BY pos) AS first_of FROM ps) WHERE first_of = 1), nb AS (SELECT c.node_id, c.book_id, c.fragment, pf.pos, pf.start, pf.words AS page_words, CASE WHEN c.fragment <> '' THEN list_position([trim(x, ' ') FOR x IN pf.ls], trim(c.title, ' ')) END AS line, pf.ls FROM c JOIN pf ON c.book_id = pf.book_id AND c.file = pf.href),
no AS (SELECT *, CASE WHEN line > 1 THEN len(regexp_extract_all(array_to_string(ls[1:line - 1], chr(10)), '[^WORDCHARS]+')) ELSE 0 END AS off FROM nb), bw AS (SELECT node_id, book_id, CAST(coalesce(lead(start + off) OVER (PARTITION BY book_id ORDER BY pos, off, node_id), start + page_words) - start - off AS BIGINT) AS words FROM no)"""
_BOUNDARY_WORDS = f"{_TOC_MATCH}, {_BOUNDARY_PARTS}"
_EVIDENCE = f"""{_BOUNDARY_WORDS}, mg AS (SELECT book_id, max(CASE WHEN in_winning_sequence = true THEN sequence_score END) - max(CASE WHEN in_winning_sequence = false THEN sequence_score END) AS margin FROM n GROUP BY book_id),
sure AS (SELECT n.node_id, n.book_id, CASE WHEN n.in_winning_sequence IS NULL OR n.in_winning_sequence = false OR n.node_kind <> 'chapter' THEN 'none' WHEN mg.margin < {LEAST_MARGIN} THEN 'needs review' WHEN m.entry_no IS NULL AND n.matched_anchor_id IS NULL THEN 'sequence only'
 WHEN bw.words IS NULL OR bw.words < {LEAST_WORDS} OR n.structurally_clean IS NULL OR n.structurally_clean = false THEN 'needs review' ELSE 'corroborated' END AS confidence FROM n JOIN mg ON n.book_id = mg.book_id LEFT JOIN m ON n.node_id = m.node_id LEFT JOIN bw ON n.node_id = bw.node_id)"""


def _page_rows(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(chapter_id, book_id, href, place, words, more): pages once; their text is reduced before repeated rows are dropped."""
    place = F.struct(F.coalesce("page_no", F.lit(2**31 - 1)).alias("p"), F.col("chapter_id").alias("c"))
    rows = spread(table(spark, sf_dir, "chapters").select("chapter_id", "book_id", "page_no", "href", "document"))
    return rows.withColumn("words", F.coalesce(T.words(F.col("document")), F.lit(0).cast("long"))).select("chapter_id", "book_id", "href", place.alias("place"), "words", *more).dropDuplicates(["chapter_id"])


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "structure_nodes").drop("created_at").dropDuplicates(["node_id"]).withColumn("file", F.substring_index("start_href", "#", 1)).withColumn("fragment", F.when(F.contains("start_href", F.lit("#")), F.substring_index("start_href", "#", -1)).otherwise(""))


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where("in_winning_sequence = true AND node_kind = 'chapter'")


def zoned(pages: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The pages with their zone, by their place beside the first and the last page that a confirmed chapter begins in. No page
    is ranked: places are compared."""
    at = pages.select("book_id", "href", "place").join(confirmed.select("book_id", F.col("file").alias("href")).distinct(), ["book_id", "href"])
    bounds = at.groupBy("book_id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    zone = F.when(F.col("first").isNull(), "unknown").when(F.col("place") < F.col("first"), "front").when(F.col("place") > F.col("last"), "back").otherwise("main")
    return pages.join(bounds, "book_id", "left").withColumn("zone", zone).drop("first", "last")


def matter_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoned(_page_rows(spark, sf_dir), _confirmed(spark, sf_dir)).select("chapter_id", "book_id", "href", "zone")


def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matter_zone(spark, sf_dir).groupBy("book_id").agg(*[F.count_if(F.col("zone") == z).alias(z) for z in ("front", "main", "back", "unknown")])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with label and confidence: by the page's text, its file's name, its zone."""
    z = zoned(_page_rows(spark, sf_dir, F.expr(spark_text(_LABEL)).alias("text_label")), _confirmed(spark, sf_dir)).withColumn("href_label", F.expr(_HINT))
    label = F.coalesce("text_label", "href_label", F.when(F.col("zone") == "front", "front matter").when(F.col("zone") == "back", "back matter").otherwise("main content"))
    edge = F.col("zone").isin("front", "back")
    confidence = F.when(F.col("text_label").isNotNull(), "high").when(F.col("href_label").isNotNull(), "medium").when(edge & (F.col("words") <= 150), "medium").when(edge, "low").when(F.col("zone") == "main", "high").otherwise("low")
    return z.select("chapter_id", "book_id", "href", "zone", "words", label.alias("label"), confidence.alias("confidence"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("chapter_id", "book_id", "zone", "label", "confidence")


def thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "chapter_analyses").groupBy("chapter_id").agg(F.max("paragraphs").alias("paragraphs"))
    z = zoned(_page_rows(spark, sf_dir), _confirmed(spark, sf_dir)).join(a, "chapter_id", "left")
    return z.where(f"words < {LEAST_WORDS} OR paragraphs = 0").select("chapter_id", "book_id", "words", "zone")


def unexplained_thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thin_pages(spark, sf_dir).where("zone NOT IN ('front', 'back')")


def thin_flag_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose stored flag is wrong."""
    said = table(spark, sf_dir, "chapter_analyses").groupBy("chapter_id").agg(F.coalesce(F.bool_or("is_thin"), F.lit(False)).alias("said"))
    thin = thin_pages(spark, sf_dir).select("chapter_id", F.lit(True).alias("t"))
    return said.join(thin, "chapter_id", "left").withColumn("is_thin", F.coalesce("t", F.lit(False))).where("said <> is_thin").drop("t")


def corroborated(nodes: DataFrame, toc: DataFrame) -> DataFrame:
    """Confirmed chapters with the entry of the table of contents that stands for them, one for each: an entry with an anchor goes to
    the chapter that has it, one without to the first chapter of its file. nodes: (node_id, book_id, file, ids, place)."""
    entries = toc.where("coalesce(href, '') <> ''").select("book_id", "entry_no", F.substring_index("href", "#", 1).alias("file"), F.when(F.contains("href", F.lit("#")), F.substring_index("href", "#", -1)).otherwise("").alias("fragment")).distinct()
    by = lambda order, *keys: F.row_number().over(Window.partitionBy("book_id", "file", *keys).orderBy(order))
    # of several chapters with one anchor, or entries for one, the first ones go together
    anchors = nodes.select("node_id", "book_id", "file", "place", F.explode("ids").alias("fragment")).where("fragment <> ''").withColumn("nth", by("place", "fragment"))
    with_anchor = entries.where("fragment <> ''").withColumn("nth", by("entry_no", "fragment")).join(anchors, ["book_id", "file", "fragment", "nth"])
    first = nodes.withColumn("first", by("place")).where("first = 1")
    whole = entries.where("fragment = ''").join(first, ["book_id", "file"])
    return with_anchor.select("node_id", "entry_no").unionByName(whole.select("node_id", "entry_no")).groupBy("node_id").agg(F.min("entry_no").alias("entry_no"))


def _placed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("place", F.struct(F.coalesce("start_page_no", F.lit(2**31 - 1)).alias("p"), F.col("node_id").alias("n"))).withColumn("ids", F.array("fragment"))


def boundary_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed chapters with their entry of the table of contents, and whether a link names their anchor."""
    c = _placed(_confirmed(spark, sf_dir))
    return c.join(corroborated(c, table(spark, sf_dir, "toc")), "node_id", "left").select("node_id", "book_id", F.col("entry_no").cast("long").alias("toc_entry"), F.col("matched_anchor_id").isNotNull().alias("anchor_matched"))


def page_starts(pages: DataFrame) -> DataFrame:
    """The pages with the words of their book before them: a running sum over bins of pages, then inside the bin, so that no book
    is summed up in one task."""
    p = pages.withColumn("bin", F.floor(F.col("place.p") / PER_BIN))
    bins = p.groupBy("book_id", "bin").agg(F.sum("words").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("book_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("words").over(Window.partitionBy("book_id", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("inside", inside).join(bins.select("book_id", "bin", "before"), ["book_id", "bin"]).withColumn("start", F.col("before") + F.col("inside")).drop("bin", "before", "inside")


def boundary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from each confirmed chapter to the next one, from the line of its title where it stands in the page; the last one ends
    with its page."""
    # only lines as short as titles are kept, with the words before them
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("before"))
    before = lambda counts: F.aggregate(counts, zero, lambda a, n: F.struct((a["n"] + n).alias("n"), F.array_append(a["before"], a["n"]).alias("before")), lambda a: a["before"])
    numbered = lambda ls, offsets: F.filter(F.zip_with(ls, offsets, lambda x, n: F.struct(F.btrim(x, F.lit(" ")).alias("title"), n.alias("offset"))), lambda x: (x["title"] != "") & (F.length(x["title"]) <= TITLE))
    short = T.let(F.split("document", "\n"), lambda ls: numbered(ls, before(F.transform(ls, T.words))))
    pages = stage(_page_rows(spark, sf_dir, short.alias("lines")), "page-lines")
    at = pages.select("book_id", F.col("href").alias("file"), F.inline("lines")).groupBy("book_id", "file", "title").agg(F.min("offset").alias("offset"))
    starts = page_starts(pages.select("book_id", "href", "place", "words")).select("book_id", F.col("href").alias("file"), F.col("place").alias("page_place"), "start", F.col("words").alias("page_words"))
    # an href that several pages have is the first one's
    starts = starts.groupBy("book_id", "file").agg(F.min(F.struct("page_place", "start", "page_words")).alias("s")).select("book_id", "file", "s.*")
    c = _placed(_confirmed(spark, sf_dir)).withColumn("title", F.trim("title"))
    n = c.join(starts, ["book_id", "file"]).join(at, ["book_id", "file", "title"], "left").withColumn("offset", F.when(F.col("fragment") != "", F.coalesce("offset", F.lit(0))).otherwise(F.lit(0)))
    n = n.withColumn("begin", F.col("start") + F.col("offset"))
    following = F.lead("begin").over(Window.partitionBy("book_id").orderBy("page_place", "offset", "node_id"))
    words = F.coalesce(following, F.col("start") + F.col("page_words")) - F.col("begin")
    return n.select("node_id", "book_id", words.alias("words"), (words >= LEAST_WORDS).alias("long_enough"))


def confidence_of(winning: Column, margin: Column, corroboration: Column, long_enough: Column, clean: Column) -> Column:
    """How sure a boundary is, by the first rule that holds; a check that wasn't made is one that failed."""
    return (
        F.when(~F.coalesce(winning, F.lit(False)), "none").when(margin < LEAST_MARGIN, "needs review").when(~corroboration, "sequence only")
        .when(~F.coalesce(long_enough, F.lit(False)) | ~F.coalesce(clean, F.lit(False)), "needs review").otherwise("corroborated")
    )


def boundary_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of every node from evidence of its own: the table of contents, the words that follow and the stored anchor and
    cleanliness (the pages are plain text and have neither links nor elements)."""
    nodes = _nodes(spark, sf_dir)
    score = lambda w: F.max(F.when(F.col("in_winning_sequence") == w, F.col("sequence_score")))
    margin = nodes.groupBy("book_id").agg((score(True) - score(False)).alias("margin"))
    c = _placed(_confirmed(spark, sf_dir))
    n = nodes.join(margin, "book_id").join(corroborated(c, table(spark, sf_dir, "toc")), "node_id", "left").join(boundary_words(spark, sf_dir).select("node_id", "long_enough"), "node_id", "left")
    sure = confidence_of(F.col("in_winning_sequence") & (F.col("node_kind") == "chapter"), F.col("margin"), F.col("entry_no").isNotNull() | F.col("matched_anchor_id").isNotNull(), F.col("long_enough"), F.col("structurally_clean"))
    return n.select("node_id", "book_id", sure.alias("confidence"))


def split_eligible_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with a corroborated boundary, and how the computed confidences differ from the stored ones."""
    stored = _nodes(spark, sf_dir).select("node_id", "split_confidence")
    b = boundary_confidence(spark, sf_dir).join(stored, "node_id")
    return b.groupBy("book_id").agg(F.bool_or(F.col("confidence") == "corroborated").alias("eligible"), F.count_if(F.col("confidence") == "corroborated").alias("boundaries"), F.count_if(~F.col("confidence").eqNullSafe(F.col("split_confidence"))).alias("differ"))


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker of each book and side: tagged before text, then by place, then the shortest."""
    g = table(spark, sf_dir, "gutenberg_markers").dropDuplicates(["marker_id"]).where((F.col("detect_method") == "tag") | F.coalesce(F.col("marker_text"), F.lit("")).rlike(_MARK))
    places = _page_rows(spark, sf_dir).groupBy("book_id", "href").agg(F.min("place").alias("place"))
    order = F.struct((F.col("detect_method") != "tag").alias("m"), F.coalesce(F.col("place.p"), F.lit(2**31 - 1)).alias("p"), F.coalesce(F.col("place.c"), F.lit(2**62)).alias("c"), F.length(F.coalesce("marker_text", F.lit(""))).alias("n"), F.col("marker_id").alias("id"))
    v = g.join(places, ["book_id", "href"], "left")
    return v.groupBy("book_id", "marker_side").agg(F.min_by(F.struct("marker_id", "href", "detect_method", "place"), order).alias("k")).select("book_id", "marker_side", "k.*")


def boilerplate_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir).drop("place")


def boilerplate_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir).groupBy("book_id").agg(F.bool_or(F.col("marker_side") == "start").alias("front_found"), F.bool_or(F.col("marker_side") == "end").alias("back_found"))


def boilerplate_trailing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the spine after the page of the end marker."""
    end = _picked(spark, sf_dir).where("marker_side = 'end' AND place IS NOT NULL").select("book_id", F.col("place").alias("end"))
    spine = table(spark, sf_dir, "manifest").where("spine_pos IS NOT NULL").select("book_id", "href").distinct()
    return _page_rows(spark, sf_dir).join(end, "book_id").where(F.col("place") > F.col("end")).join(spine, ["book_id", "href"], "left_semi").select("book_id", "chapter_id", "href")


def boilerplate_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = boilerplate_trailing_pages(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("removed"))
    return _page_rows(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("pages")).join(cut, "book_id", "left").na.fill(0, ["removed"])


NATIVE = {
    "matter_zone": matter_zone, "zone_counts": zone_counts, "page_labels": page_labels, "thin_pages": thin_pages, "unexplained_thin_pages": unexplained_thin_pages, "thin_flag_check": thin_flag_check, "boundary_corroboration": boundary_corroboration, "boundary_words": boundary_words,
    "boundary_confidence": boundary_confidence, "split_eligible_books": split_eligible_books, "boilerplate_markers": boilerplate_markers, "boilerplate_books": boilerplate_books, "boilerplate_trailing_pages": boilerplate_trailing_pages, "boilerplate_removed": boilerplate_removed,
}

#: The same in SQL for DuckDB, by ranks and windows; the few that both engines run have no native form.
SQL = {
    "matter_zone": f"WITH {_ZONES} SELECT chapter_id, book_id, href, zone FROM z",
    "zone_counts": f"WITH {_ZONES} SELECT book_id, count_if(zone = 'front') AS front, count_if(zone = 'main') AS main, count_if(zone = 'back') AS back, count_if(zone = 'unknown') AS unknown FROM z GROUP BY book_id",
    "page_labels": f"WITH {_LABELS} SELECT chapter_id, book_id, zone, label, confidence FROM labels",
    "thin_pages": f"WITH {_THIN} SELECT chapter_id, book_id, words, zone FROM thin",
    "unexplained_thin_pages": f"WITH {_THIN} SELECT chapter_id, book_id, words, zone FROM thin WHERE zone NOT IN ('front', 'back')",
    "thin_flag_check": f"WITH {_THIN}, s AS (SELECT chapter_id, bool_or(is_thin) AS said FROM {{chapter_analyses}} GROUP BY chapter_id) SELECT s.chapter_id, coalesce(s.said, false) AS said, thin.chapter_id IS NOT NULL AS is_thin FROM s LEFT JOIN thin ON s.chapter_id = thin.chapter_id WHERE coalesce(s.said, false) <> (thin.chapter_id IS NOT NULL)",
    # a chapter belongs to the latest part before it
    "structure_tree": f"WITH {_TREE} SELECT node_id, book_id, node_kind, part_before, parent_node_id, part_before IS DISTINCT FROM parent_node_id AS differs FROM tree WHERE node_kind IN ('chapter', 'part')",
    "winning_chapters": f"WITH {_NODES} SELECT book_id, node_id, title, start_href, row_number() OVER (PARTITION BY book_id ORDER BY coalesce(start_page_no, 2147483647), node_id) AS chapter_no FROM n WHERE in_winning_sequence = true AND node_kind = 'chapter'",
    "first_chapter_of_file": f"WITH {_NODES}, r AS (SELECT *, split_part(start_href, '#', 1) AS file, row_number() OVER (PARTITION BY book_id, split_part(start_href, '#', 1) ORDER BY coalesce(start_page_no, 2147483647), node_id) AS first FROM n WHERE node_kind = 'chapter' AND start_href IS NOT NULL) SELECT book_id, file, node_id FROM r WHERE first = 1",
    "boundary_corroboration": f"""WITH {_TOC_MATCH} SELECT c.node_id, c.book_id, CAST(m.entry_no AS BIGINT) AS toc_entry, c.matched_anchor_id IS NOT NULL AS anchor_matched FROM c LEFT JOIN m ON c.node_id = m.node_id""",
    "boundary_words": f"WITH {_BOUNDARY_WORDS} SELECT node_id, book_id, words, words >= {LEAST_WORDS} AS long_enough FROM bw",
    "boundary_confidence": f"WITH {_EVIDENCE} SELECT node_id, book_id, confidence FROM sure",
    "split_eligible_books": f"WITH {_EVIDENCE} SELECT sure.book_id, bool_or(confidence = 'corroborated') AS eligible, count_if(confidence = 'corroborated') AS boundaries, count_if(confidence IS DISTINCT FROM split_confidence) AS differ FROM sure JOIN n ON n.node_id = sure.node_id GROUP BY sure.book_id",
    "boilerplate_markers": f"WITH {_MARKERS} SELECT book_id, marker_side, marker_id, href, detect_method FROM picked",
    "boilerplate_books": f"WITH {_MARKERS} SELECT book_id, bool_or(marker_side = 'start') AS front_found, bool_or(marker_side = 'end') AS back_found FROM picked GROUP BY book_id",
    # pages of the reading order after the page of the end marker
    "boilerplate_trailing_pages": f"WITH {_MARKERS}, {_CUT} SELECT book_id, chapter_id, href FROM cut",
    "boilerplate_removed": f"WITH {_MARKERS}, {_CUT} SELECT o.book_id, count(*) AS pages, count(cut.chapter_id) AS removed FROM o LEFT JOIN cut ON o.chapter_id = cut.chapter_id GROUP BY o.book_id",
}
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _spark(sql: str) -> str:
    return sql.replace(_WORDS, f"CAST(regexp_count(coalesce(document, ''), r'[^{_WS}]+') AS BIGINT)")


def _duck(sql: str) -> str:
    return sql.replace(_WORDS, f"CAST(len(regexp_extract_all(coalesce(document, ''), '[^{_WS}]+')) AS BIGINT)").replace("WORDCHARS", _WS)


QUERIES = {k: NATIVE.get(k) or spark_sql(_spark(v)) for k, v in SQL.items()}
ORACLE = {k: duck_sql(_duck(v)) for k, v in SQL.items()}
