"""Operators on marked-up pages: tags, headings, links, styles, spans, text slots and junk elements.

The pages of the tables are plain text; ``PAGE`` marks them up, with one defect of markup in each of four
pages, the same in both engines. A page is parsed once, to the fields a query wants; what the query says of a page is
computed in its row from the arrays of its elements, so that neither elements nor texts are shuffled. Repeated
rows of a page are dropped when it is reduced to that. Null documents are no pages; a null href is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators.paragraphs import JUNK, JUNK_LINKS, is_junk
from textmend.plans.runtime import spread, table
from textmend.sources import markup

#: Stands for a paragraph's end while a page is marked up; no text holds it.
_MARK = ""
_ESCAPED = "replace(replace(replace(document, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BODY = f"replace(replace({_ESCAPED}, chr(10) || chr(10), '</p>{_MARK}<p class=\"x b\">'), chr(10), '<br/>')"
_START = "'<html><head><title>page</title><style>.ad{color:inherit}</style></head><body class=\"w\">'"
PAGE = f"""CASE chapter_id % 4
 WHEN 0 THEN {_START} || '<h1 id="a1" class="title">' || coalesce(href, '') || '</h1><p class="x b"><span class="ad"><span>' || replace(replace({_BODY}, '</p>{_MARK}', '</span></span></p>{_MARK}'), '{_MARK}<p class="x b">', '<p class="x b"><span class="ad"><span>') || '</span></span></p></body></html>'
 WHEN 1 THEN {_START} || '<h1 class="title">' || coalesce(href, '') || '</h1><h3>notes</h3><a id="n1" href="notes.xhtml#n1">1</a><img src="missing.png"/><p class="x b">' || replace({_BODY}, '{_MARK}', '<span></span>') || '</p></body></html>'
 WHEN 2 THEN {_START} || '<h3 class="title">' || coalesce(href, '') || '</h3><pre>  code  </pre><p class="x b">' || replace({_BODY}, '{_MARK}', '<p> <i></i></p>') || '</p><p>Page 7</p><p>see <a href="http://www.abbyy.com/">here</a></p></body></html>'
 ELSE {_START} || '<h2 class="title">' || coalesce(href, '') || '</h2><h2>again</h2><ul><li>a</li><li>b</li></ul><table><tr><td>c</td></tr></table><p class="x b" style="height:2em">' || replace({_BODY}, '{_MARK}', '') || '</p><a href="#a1">up</a></body></html>' END"""
PAGES_SQL = f"SELECT DISTINCT chapter_id, book_id, href, {PAGE} AS html FROM chapters WHERE document IS NOT NULL"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "chapters").where("document IS NOT NULL").select("chapter_id", "book_id", "href", "document"))
    return rows.select("chapter_id", "book_id", "href", F.expr(PAGE).alias("html"))


def parsed(spark: SparkSession, sf_dir: str, *fields: str, slots: bool = False) -> DataFrame:
    return markup.parsed(pages(spark, sf_dir), "html", "chapter_id", "book_id", "href", fields=fields, slots=slots)


def once(df: DataFrame) -> DataFrame:
    """Each page once, when its text is reduced."""
    return df.dropDuplicates(["chapter_id"])


def count(array: str | Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def heading(e: Column) -> Column:
    return e["tag"].rlike("^h[1-6]$")


def page_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the main elements of every page."""
    n = lambda *tags: count("elements", lambda e: e["tag"].isin(*tags))
    return once(parsed(spark, sf_dir, "tag").select(
        "chapter_id", n("p").alias("paragraphs"), n("img").alias("images"), n("a").alias("links"), n("table").alias("tables"), n("ul", "ol").alias("lists"), n("span").alias("spans"), n("br").alias("breaks"), count("elements", heading).alias("headings")
    ))


def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = once(parsed(spark, sf_dir, "tag").select("chapter_id", "book_id", F.transform("elements", lambda e: e["tag"]).alias("tags")))
    return tags.select("book_id", F.explode("tags").alias("tag")).groupBy("book_id", "tag").agg(F.count("*").alias("n"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every page in order, and its classes with how often each is used."""
    rows = parsed(spark, sf_dir, "id", "classes").select(
        "chapter_id", F.array_join(F.filter(F.transform("elements", lambda e: e["id"]), lambda i: i != ""), " ").alias("ids"), F.flatten(F.transform("elements", lambda e: e["classes"])).alias("c")
    )
    used = F.transform(F.array_sort(F.array_distinct("c")), lambda x: F.concat(x, F.lit(":"), F.size(F.filter("c", lambda y: y == x))))
    return once(rows.select("chapter_id", "ids", F.array_join(used, " ").alias("classes")))


def heading_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every h1 after the first, and every heading more than one level below the one before it."""
    levels = F.transform(F.filter("elements", heading), lambda e: F.substring(e["tag"], 2, 1).cast("long"))
    rows = once(parsed(spark, sf_dir, "tag").select("chapter_id", levels.alias("levels")))
    more = F.greatest(count("levels", lambda x: x == 1) - 1, F.lit(0))
    steps = F.zip_with("levels", F.slice("levels", 2, F.greatest(F.size("levels"), F.lit(1))), lambda a, b: b > a + 1)
    found = rows.select("chapter_id", F.explode(F.array(F.struct(F.lit("multiple h1").alias("issue"), more.alias("n")), F.struct(F.lit("skipped level").alias("issue"), count(steps, lambda x: x).alias("n")))).alias("i"))
    return found.select("chapter_id", "i.issue", "i.n").where("n > 0")


def _links(e: Column) -> Column:
    return F.filter(F.transform(F.filter(e, lambda x: (x["tag"] == "a") & x["attrs"]["href"].isNotNull()), lambda x: x["attrs"]["href"]), lambda x: ~x.rlike("^(?:https?|mailto):"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages: file and fragment, one without a file goes to the page itself; links to other hosts are left out."""
    a = parsed(spark, sf_dir, "tag", "attrs").select("chapter_id", "href", F.explode(_links(F.col("elements"))).alias("link"))
    file = F.substring_index("link", "#", 1)
    return a.select("chapter_id", F.when(file == "", F.coalesce("href", F.lit(""))).otherwise(file).alias("file"), F.when(F.contains(F.col("link"), F.lit("#")), F.substring_index("link", "#", -1)).otherwise("").alias("fragment")).distinct()


def missing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page to its own anchors that aren't there."""
    rows = parsed(spark, sf_dir, "tag", "attrs", "id").withColumn("ids", F.transform("elements", lambda e: e["id"])).withColumn("links", _links(F.col("elements")))
    own = F.filter("links", lambda x: F.contains(x, F.lit("#")) & F.substring_index(x, "#", 1).isin("", F.col("href")))
    lost = F.filter(F.transform(own, lambda x: F.substring_index(x, "#", -1)), lambda x: (x != "") & ~F.array_contains(F.col("ids"), x))
    return rows.select("chapter_id", F.explode(lost).alias("fragment")).distinct()


def broken_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages that the book doesn't hold; remote and embedded ones are exempt."""
    sources = F.transform(F.filter("elements", lambda e: e["tag"] == "img"), lambda e: e["attrs"]["src"])
    img = parsed(spark, sf_dir, "tag", "attrs").select("chapter_id", "book_id", F.explode(sources).alias("src")).distinct()
    held = table(spark, sf_dir, "manifest").select("book_id", F.col("href").alias("src")).distinct()
    return img.where((F.col("src") != "") & ~F.col("src").rlike("^(?:https?:|data:)")).join(held, ["book_id", "src"], "left_anti").select("chapter_id", "src")


def image_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each book: broken images in pages, the pages that have them, and the images that the manifest lists for no page's use."""
    broken = broken_images(spark, sf_dir).join(table(spark, sf_dir, "chapters").select("chapter_id", "book_id").distinct(), "chapter_id").groupBy("book_id").agg(F.count("*").alias("broken"), F.countDistinct("chapter_id").alias("pages"))
    listed = table(spark, sf_dir, "manifest").where("media_type LIKE 'image/%' AND href IS NOT NULL").select("book_id", "href").distinct()
    sources = F.transform(F.filter("elements", lambda e: e["tag"] == "img"), lambda e: e["attrs"]["src"])
    used = parsed(spark, sf_dir, "tag", "attrs").select("book_id", F.explode(sources).alias("href")).distinct()
    unused = listed.join(used, ["book_id", "href"], "left_anti").groupBy("book_id").agg(F.count("*").alias("unused"))
    return broken.join(unused, "book_id", "full").na.fill(0)


def text_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text slots of every page: how many, protected, blank, beside an inline element, and protected ones that the
    white-space rules would change."""
    would = lambda s: s["protected"] & (T.whitespace(s["text"], s["lead_inline"], s["trail_inline"])["text"] != s["text"])
    return once(parsed(spark, sf_dir, slots=True).select(
        "chapter_id", F.size("slots").cast("long").alias("slots"), count("slots", lambda s: s["protected"]).alias("protected"), count("slots", lambda s: F.trim(s["text"]) == "").alias("blank"),
        count("slots", lambda s: s["lead_inline"] | s["trail_inline"]).alias("inline"), count("slots", would).alias("protected_skipped"),
    ))


def chain_levels(elements: Column, text: Column, no_op: Column) -> Column:
    """For each element in order: (span, wraps, empty, idle): it wraps if all it holds is one span; it is idle if it has no
    attribute, or only classes that change nothing. The only child of an element is the next one in order."""

    def level(e: Column) -> Column:
        child = F.get(elements, e["elem_no"] + 1)
        blank = lambda a, b: F.trim(F.substr(text, a + 1, b - a)) == ""
        span = e["tag"] == "span"
        wraps = span & (e["n_children"] == 1) & (child["tag"] == "span") & blank(e["text_from"], child["text_from"]) & blank(child["text_to"], e["text_to"])
        idle = (F.size(F.map_keys(e["attrs"])) == 0) | ((F.size(e["classes"]) > 0) & (F.size(F.map_keys(e["attrs"])) == 1) & F.forall(e["classes"], lambda c: F.array_contains(no_op, c)))
        empty = span & (e["n_children"] == 0) & (F.trim(markup.text_of(text, e)) == "")
        return F.struct(F.coalesce(wraps, F.lit(False)).alias("wraps"), empty.alias("empty"), idle.alias("idle"))

    return F.transform(elements, level)


def chains(levels: Column) -> Column:
    """(depth, idle levels) of each chain: a run of wrapping spans and the one it ends with."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("idle"), F.array().cast("array<struct<depth:int,idle:int>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        idle = F.when(x["idle"], 1).otherwise(0)
        depth, bad = F.when(a["depth"] > 0, a["depth"] + 1).otherwise(1), F.when(a["depth"] > 0, a["idle"] + idle).otherwise(idle)
        ends = (a["depth"] > 0) & ~x["wraps"]
        return F.struct(F.when(x["wraps"], depth).otherwise(0).alias("depth"), F.when(x["wraps"], bad).otherwise(0).alias("idle"), F.when(ends, F.array_append(a["done"], F.struct(depth.alias("depth"), bad.alias("idle")))).otherwise(a["done"]).alias("done"))

    return F.aggregate(levels, zero, step, lambda a: a["done"])


def span_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of spans that hold nothing but another span: how many, how deep, how many without any purpose (every level is
    idle); and empty spans outside them."""
    from textmend.operators.styles import no_op_classes

    # a book's idle classes are those of its sheets
    idle = no_op_classes(spark, sf_dir).groupBy("book_id").agg(F.collect_set("class").alias("no_op"))
    p = parsed(spark, sf_dir, "elem_no", "tag", "attrs", "classes", "text_from", "text_to", "n_children").join(idle, "book_id", "left")
    # an empty span at the end of a chain belongs to it
    alone = lambda levels: F.filter(F.transform(levels, lambda x, i: x["empty"] & ~F.coalesce(F.get(levels, i - 1)["wraps"], F.lit(False))), lambda x: x)
    counts = lambda levels, done: F.struct(
        F.size(done).cast("long").alias("chains"), F.coalesce(F.array_max(F.transform(done, lambda c: c["depth"])), F.lit(0)).cast("long").alias("deepest"), count(done, lambda c: c["depth"] == c["idle"]).alias("purposeless"), F.size(alone(levels)).cast("long").alias("empty_spans")
    )
    levels = T.let(F.col("elements"), lambda e: chain_levels(e, F.col("text"), F.coalesce("no_op", F.array().cast("array<string>"))))
    return once(p.select("chapter_id", T.let(levels, lambda x: T.let(chains(x), lambda done: counts(x, done))).alias("c")).select("chapter_id", "c.*"))


def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most used classes of every page; of equal ones the one seen first."""
    rows = once(parsed(spark, sf_dir, "classes").select("chapter_id", F.flatten(F.transform("elements", lambda e: e["classes"])).alias("c")))
    used = rows.select("chapter_id", F.posexplode("c").alias("at", "class")).groupBy("chapter_id", "class").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("chapter_id").orderBy(F.desc("n"), "first")).cast("long")
    return used.withColumn("rank", rank).where("rank <= 5").select("chapter_id", "class", "n", "rank")


def inline_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with style blocks and their rules, style attributes, and attributes that force a height or a page break."""
    e = F.col("elements")
    styles = F.transform(F.filter(e, lambda x: x["tag"] == "style"), lambda x: F.regexp_count(markup.text_of(F.col("text"), x), F.lit(r"[^{}]+\{[^{}]*\}")))
    return once(parsed(spark, sf_dir, "tag", "style", "text_from", "text_to").select(
        "chapter_id", count(e, lambda x: x["tag"] == "style").alias("style_blocks"), F.aggregate(styles, F.lit(0).cast("long"), lambda a, n: a + n).alias("style_rules"), count(e, lambda x: x["style"] != "").alias("style_attributes"),
        count(e, lambda x: x["style"].rlike(r"(?i)(?:^|;)\s*(?:max-|min-)?height\s*:")).alias("forced_heights"), count(e, lambda x: F.lower(x["style"]).rlike("page-break|break-before|break-after")).alias("page_breaks"),
    ))


def junk_numbers(elements: Column, text: Column) -> Column:
    """Numbers of the outermost div, p, a and b that are converter junk, by their text or a link inside."""
    linked = F.transform(F.filter(elements, lambda a: (a["tag"] == "a") & F.coalesce(F.trim(a["attrs"]["href"]).rlike(JUNK_LINKS), F.lit(False))), lambda a: a["elem_no"])
    junk = F.filter(elements, lambda e: e["tag"].isin("div", "p", "a", "b") & (is_junk(F.trim(markup.text_of(text, e))) | F.exists(linked, lambda n: n.between(e["elem_no"], e["end_no"]))))
    inner = lambda e: F.exists(junk, lambda o: (o["elem_no"] < e["elem_no"]) & (e["end_no"] <= o["end_no"]))
    return F.transform(F.filter(junk, lambda e: ~inner(e)), lambda e: e["elem_no"])


def empty_numbers(elements: Column, text: Column) -> Column:
    """Numbers of the paragraphs without text and image."""
    images = F.transform(F.filter(elements, lambda e: e["tag"] == "img"), lambda e: e["elem_no"])
    blank = lambda e: F.regexp_replace(markup.text_of(text, e), f"[{T.WS}]+", "") == ""
    return F.transform(F.filter(elements, lambda e: (e["tag"] == "p") & blank(e) & ~F.exists(images, lambda n: n.between(e["elem_no"], e["end_no"]))), lambda e: e["elem_no"])


def junk_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outermost elements that are converter junk, and empty paragraphs without an image."""
    e, t = F.col("elements"), F.col("text")
    return once(parsed(spark, sf_dir, "elem_no", "end_no", "tag", "attrs", "text_from", "text_to").select("chapter_id", F.size(junk_numbers(e, t)).cast("long").alias("junk"), F.size(empty_numbers(e, t)).cast("long").alias("empty")))


def _c(p: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT)"


_V = f"v AS ({PAGES_SQL})"
_PARAS, _SPANS = _c("<p[ >]"), _c("<span[ >]")
_CLASSES = "k AS (SELECT book_id, chapter_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)(?: id=\"[a-z0-9]+\")? class=\"[a-z ]+\"', 1)) AS tag, unnest(regexp_extract_all(html, '<[a-z0-9]+(?: id=\"[a-z0-9]+\")? class=\"([a-z ]+)\"', 1)) AS classes FROM v), u AS (SELECT book_id, chapter_id, tag, unnest(string_split(classes, ' ')) AS class FROM k)"
_HEADS = "h AS (SELECT chapter_id, [CAST(x AS BIGINT) FOR x IN regexp_extract_all(html, '<h([1-6])[ >]', 1)] AS l FROM v), i AS (SELECT chapter_id, greatest(len(list_filter(l, lambda x: x = 1)) - 1, 0) AS many, len(list_filter(range(2, len(l) + 1), lambda k: l[k] > l[k - 1] + 1)) AS skipped FROM h)"
_LINKS = "k AS (SELECT chapter_id, html, coalesce(href, '') AS href, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM v), own AS (SELECT chapter_id, html, href, CASE WHEN split_part(link, '#', 1) = '' THEN href ELSE split_part(link, '#', 1) END AS file, split_part(link, '#', 2) AS fragment FROM k WHERE NOT regexp_matches(link, '^(https?|mailto):'))"
_IMAGES = "s AS (SELECT DISTINCT chapter_id, book_id, unnest(regexp_extract_all(html, '<img src=\"([^\"]*)\"', 1)) AS src FROM v), lost AS (SELECT s.* FROM s ANTI JOIN manifest m ON s.book_id = m.book_id AND s.src = m.href WHERE src <> '' AND NOT regexp_matches(src, '^(https?:|data:)'))"
_PAIR = '<span class="ad"><span>'
QUERIES = {
    "page_tag_counts": page_tag_counts, "tag_histogram": tag_histogram, "page_lists": page_lists, "heading_audit": heading_audit, "page_links": page_links, "missing_anchors": missing_anchors, "broken_images": broken_images, "image_book": image_book, "text_slots": text_slots, "span_chains": span_chains,
    "top_classes": top_classes, "inline_styles": inline_styles, "junk_elements": junk_elements,
}
ORACLE = {
    "page_tag_counts": f"WITH {_V} SELECT chapter_id, {_PARAS} AS paragraphs, {_c('<img ')} AS images, {_c('<a ')} AS links, {_c('<table>')} AS tables, {_c('<[uo]l>')} AS lists, {_SPANS} AS spans, {_c('<br/>')} AS breaks, {_c('<h[1-6][ >]')} AS headings FROM v",
    "tag_histogram": f"WITH {_V}, k AS (SELECT book_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ />]', 1)) AS tag FROM v) SELECT book_id, tag, count(*) AS n FROM k GROUP BY book_id, tag",
    "page_lists": f"WITH {_V}, {_CLASSES}, n AS (SELECT chapter_id, class, count(*) AS n FROM u GROUP BY chapter_id, class), c AS (SELECT chapter_id, string_agg(class || ':' || n, ' ' ORDER BY class) AS classes FROM n GROUP BY chapter_id) SELECT v.chapter_id, array_to_string(regexp_extract_all(html, ' id=\"([^\"]*)\"', 1), ' ') AS ids, c.classes FROM v JOIN c ON v.chapter_id = c.chapter_id",
    "heading_audit": f"WITH {_V}, {_HEADS} SELECT chapter_id, 'multiple h1' AS issue, CAST(many AS BIGINT) AS n FROM i WHERE many > 0 UNION ALL SELECT chapter_id, 'skipped level', CAST(skipped AS BIGINT) FROM i WHERE skipped > 0",
    "page_links": f"WITH {_V}, {_LINKS} SELECT DISTINCT chapter_id, file, fragment FROM own",
    "missing_anchors": f"WITH {_V}, {_LINKS} SELECT DISTINCT chapter_id, fragment FROM own WHERE file = href AND fragment <> '' AND NOT contains(html, ' id=\"' || fragment || '\"')",
    "broken_images": f"WITH {_V}, {_IMAGES} SELECT DISTINCT chapter_id, src FROM lost",
    "image_book": f"WITH {_V}, {_IMAGES}, b AS (SELECT book_id, count(*) AS broken, count(DISTINCT chapter_id) AS pages FROM lost GROUP BY book_id), m AS (SELECT DISTINCT book_id, href FROM manifest WHERE media_type LIKE 'image/%' AND href IS NOT NULL), n AS (SELECT m.book_id, count(*) AS unused FROM m ANTI JOIN s ON m.book_id = s.book_id AND m.href = s.src GROUP BY m.book_id) SELECT coalesce(b.book_id, n.book_id) AS book_id, coalesce(broken, 0) AS broken, coalesce(pages, 0) AS pages, coalesce(unused, 0) AS unused FROM b FULL JOIN n ON b.book_id = n.book_id",
    "span_chains": f"""WITH {_V}, x AS (SELECT chapter_id, book_id % 4 = 0 AS idle, regexp_extract_all(html, '<span class="ad"><span>') AS pairs, regexp_extract_all(html, '<span></span>') AS empties, regexp_extract_all(html, '<span class="ad"><span></span></span>') AS inner_empty FROM v)
SELECT chapter_id, CAST(len(pairs) AS BIGINT) AS chains, CAST(CASE WHEN len(pairs) > 0 THEN 2 ELSE 0 END AS BIGINT) AS deepest, CAST(CASE WHEN idle THEN len(pairs) ELSE 0 END AS BIGINT) AS purposeless, CAST(len(empties) - len(inner_empty) AS BIGINT) AS empty_spans FROM x""",
    "top_classes": f"WITH {_V}, {_CLASSES}, o AS (SELECT chapter_id, generate_subscripts(c, 1) AS pos, unnest(c) AS class FROM (SELECT chapter_id, list(class) AS c FROM (SELECT chapter_id, unnest(string_split(array_to_string(regexp_extract_all(html, ' class=\"([a-z ]+)\"', 1), ' '), ' ')) AS class FROM v) GROUP BY chapter_id)), n AS (SELECT chapter_id, class, count(*) AS n, min(pos) AS first FROM o GROUP BY chapter_id, class) SELECT chapter_id, class, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY n DESC, first) AS rank FROM n) WHERE rank <= 5",
    "junk_elements": f"""WITH {_V}, l AS (SELECT chapter_id, regexp_extract_all(html, '<p(?: [^>]*)?>((?s:.*?))</p>', 1) AS ps FROM v), t AS (SELECT chapter_id, ps, [regexp_replace(p, '<[^>]*>', '', 'g') FOR p IN ps] AS texts FROM l)
SELECT chapter_id, CAST(len(list_filter(range(1, len(ps) + 1), lambda k: regexp_matches(regexp_replace(texts[k], '^[{T.WS}]+', ''), '{JUNK.replace(chr(92) + "s", "[" + chr(92) + "t" + chr(92) + "n" + chr(92) + "f" + chr(92) + "r ]")}') OR regexp_matches(ps[k], 'href="{JUNK_LINKS.removeprefix("(?i)")}'))) AS BIGINT) AS junk,
 CAST(len(list_filter(range(1, len(ps) + 1), lambda k: regexp_replace(texts[k], '[{T.WS}]+', '', 'g') = '' AND NOT contains(ps[k], '<img'))) AS BIGINT) AS empty FROM t""",
    "inline_styles": f"WITH {_V} SELECT chapter_id, {_c('<style>')} AS style_blocks, CAST(1 AS BIGINT) * len(regexp_extract_all(regexp_extract(html, '<style>(.*?)</style>', 1), '[^{{}}]+[{{][^{{}}]*[}}]')) AS style_rules, {_c(' style=')} AS style_attributes, {_c('style=.height:')} AS forced_heights, {_c('style=.[^>]*page-break')} AS page_breaks FROM v",
}
