"""Operators on the elements of marked-up pages: marker candidates, boilerplate, places to cut at, blocks before, texts between, and
pages written back, divided and standardised.

``PAGE`` marks the pages up with chapter headings and boilerplate in four ways, the same in both engines; the SQL reads the marked-up
text by patterns. Null documents are no pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators.markup import PAGES_SQL, count, once
from textmend.operators.markup import pages as marked_pages
from textmend.plans.arrow import map_batches
from textmend.plans.runtime import spread, table
from textmend.sources import edits, markup

# --- fixed values: elements that markers stand in, places that can't be cut at, boilerplate -------------------------
CANDIDATES = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "span"]
UNSAFE = ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "ul", "ol", "li", "dl", "dt", "dd"]
NOTES = "footnote|endnote|note|noteref"
WRAPPER_CLASS, FRONT_ID, BACK_ID = "pg-boilerplate", "pg-header", "pg-footer"
START = r"(?i)\*{2,}\s*START OF (?:THIS|THE) PROJECT GUTENBERG EBOOK\b[^*]*\*{2,}"
END = r"(?i)\*{2,}\s*END OF (?:THIS|THE) PROJECT GUTENBERG EBOOK\b[^*]*\*{2,}"

_TEXT = "replace(replace(replace(document, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BODY = f"'<p>' || replace({_TEXT}, chr(10) || chr(10), '</p><p>') || '</p>'"
_S, _E = "<p>*** START OF THE PROJECT GUTENBERG EBOOK X ***</p>", "<p>*** END OF THE PROJECT GUTENBERG EBOOK X ***</p>"
PAGE = f"""'<html><body>' || CASE chapter_id % 4
 WHEN 0 THEN '<header class="pg-boilerplate" id="pg-header"><p>Legal</p>{_S}</header><h1>T</h1><div><h2 id="c1">CHAPTER I</h2>' || {_BODY} || '<h2>CHAPTER <b>II</b></h2><p>end</p></div>'
 WHEN 1 THEN '<h1>T</h1><p>Legal</p>{_S}' || {_BODY} || '<h2><span>CHAPTER I</span></h2><p>one</p><ul><li>last</li></ul><h2>CHAPTER II</h2><p>two</p>{_E}<p>Licence</p>'
 WHEN 2 THEN {_BODY} || '<table><tr><td><h2>CHAPTER I</h2></td></tr></table><div class="endnotes"><h2>CHAPTER IV</h2></div>'
 ELSE '<footer class="pg-boilerplate" id="pg-footer">{_E}</footer>' END || '</body></html>'"""
SQL_PAGES = f"v AS (SELECT DISTINCT chapter_id, {PAGE} AS html FROM chapters WHERE document IS NOT NULL)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "chapters").where("document IS NOT NULL").select("chapter_id", "document"))
    return rows.select("chapter_id", F.expr(PAGE).alias("html"))


def parsed(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return markup.parsed(pages(spark, sf_dir), "html", "chapter_id", fields=fields, slots=False)


def candidates(elements: Column) -> Column:
    """Elements that may be markers: those that hold no other one. As they are in order, one holds another if the next ends inside."""
    inner = lambda c: F.filter(F.transform(c, lambda e, i: F.when(F.coalesce(F.get(c, i + 1)["elem_no"] <= e["end_no"], F.lit(False)), F.lit(None)).otherwise(e)), lambda e: e.isNotNull())
    return T.let(F.filter(elements, lambda e: e["tag"].isin(CANDIDATES)), inner)


def tagged_boilerplate(elements: Column, text: Column, pattern: str, own_id: str) -> Column:
    """Number of the first tagged element that says so itself or by its id."""
    found = F.filter(elements, lambda x: x["id"].isin(FRONT_ID, BACK_ID) | F.array_contains(x["classes"], WRAPPER_CLASS))
    return F.get(F.filter(found, lambda x: markup.text_of(text, x).rlike(pattern) | (x["id"] == own_id)), F.lit(0))["elem_no"]


def bare_boilerplate(elements: Column, text: Column, pattern: str) -> Column:
    """Number of the shortest element around the marker's text; of equal ones the outermost."""
    mark = F.regexp_substr(text, F.lit(pattern))
    around = lambda m: F.transform(F.filter(elements, lambda x: (x["text_from"] < m["at"]) & (x["text_to"] >= m["at"] + m["n"] - 1)), lambda x: F.struct((x["text_to"] - x["text_from"]).alias("n"), x["elem_no"].alias("no")))
    return F.when(mark.isNotNull(), F.array_min(T.let(F.struct(F.position(mark, text).alias("at"), F.length(mark).alias("n")), around))["no"])


def top_of(elements: Column, no: Column) -> tuple[Column, Column]:
    """(body, the child of the body that an element stands in)."""
    body = F.get(F.filter(elements, lambda x: x["tag"] == "body"), F.lit(0))
    return body, F.get(F.filter(elements, lambda x: (x["parent_no"] == body["elem_no"]) & (x["elem_no"] <= no) & (no <= x["end_no"])), F.lit(0))


def nothing_else(elements: Column, text: Column, no: Column) -> Column:
    """The body holds nothing but what an element stands in."""
    body, top = top_of(elements, no)
    blank = lambda a, z: F.substr(text, a + 1, z - a).rlike(r"^\s*\z")
    return F.coalesce(blank(body["text_from"], top["text_from"]) & blank(top["text_to"], body["text_to"]), F.lit(False))


def unclean(elements: Column, no: Column) -> Column:
    """An element stands in a table, a list or a note."""
    kind = lambda x: F.lower(F.concat_ws(" ", F.array_join(x["classes"], " "), x["attrs"]["epub:type"]))
    return F.exists(elements, lambda x: (x["elem_no"] <= no) & (no <= x["end_no"]) & (x["tag"].isin(UNSAFE) | kind(x).rlike(NOTES)))


def marker_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Innermost paragraphs, headings and spans of every page: how many, and the digest of their texts."""
    rows = parsed(spark, sf_dir, "elem_no", "end_no", "tag", "text_from", "text_to")
    texts = lambda c: F.transform(c, lambda e: F.concat(e["tag"], F.lit(":"), markup.text_of(F.col("text"), e)))
    return once(rows.select("chapter_id", T.let(candidates(F.col("elements")), lambda c: F.struct(F.size(c).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(texts(c)), "|")).alias("digest"))).alias("c")).select("chapter_id", "c.*"))


def boilerplate_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing boilerplate of every page: by tag or text, the element's tag, how many blocks go with it (before it up to a heading,
    or after it), and whether the page holds nothing else."""
    rows = parsed(spark, sf_dir, "elem_no", "end_no", "parent_no", "tag", "id", "classes", "text_from", "text_to")
    e, text = F.col("elements"), F.col("text")

    def side(pattern: str, own: str, front: bool) -> Column:
        no = F.struct(tagged_boilerplate(e, text, pattern, own).alias("tag"), bare_boilerplate(e, text, pattern).alias("bare"))

        def gone(n: Column) -> Column:
            at = F.coalesce(n["tag"], n["bare"])
            body, top = top_of(e, at)
            sisters = F.filter(e, lambda x: x["parent_no"] == body["elem_no"])
            before = F.filter(sisters, lambda x: x["elem_no"] <= top["elem_no"])
            head = F.coalesce(F.array_max(F.transform(F.filter(before, lambda x: x["tag"].rlike("^h[1-6]$") & (x["elem_no"] < top["elem_no"])), lambda x: x["elem_no"])), F.lit(-1))
            blocks = F.when(n["tag"].isNotNull(), 1).otherwise(F.size(F.filter(before, lambda x: x["elem_no"] > head))) if front else F.size(F.filter(sisters, lambda x: x["elem_no"] >= top["elem_no"]))
            return F.when(at.isNotNull(), F.struct(F.lit("front" if front else "back").alias("side"), F.when(n["tag"].isNotNull(), "tag").otherwise("text").alias("method"), F.get(e, at)["tag"].alias("tag"), blocks.cast("long").alias("blocks"), nothing_else(e, text, at).alias("alone")))

        return T.let(no, gone)

    both = rows.select("chapter_id", F.array_compact(F.array(side(START, FRONT_ID, True), side(END, BACK_ID, False))).alias("s"))
    return once(both.where("size(s) > 0")).select("chapter_id", F.inline("s"))


def chapter_headings(elements: Column, text: Column) -> Column:
    return F.filter(elements, lambda e: (e["tag"] == "h2") & markup.text_of(text, e).startswith("CHAPTER "))


def clean_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter headings of every page, and those that a page can't be cut at."""
    rows = parsed(spark, sf_dir, "elem_no", "end_no", "tag", "classes", "attrs", "text_from", "text_to")
    e = F.col("elements")
    heads = chapter_headings(e, F.col("text"))
    return once(rows.select("chapter_id", F.size(heads).cast("long").alias("headings"), count(heads, lambda h: unclean(e, h["elem_no"])).alias("unclean")))


def words_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from each chapter heading of a page to the next one, or to the page's end."""
    rows = parsed(spark, sf_dir, "elem_no", "tag", "text_from", "text_to")
    text = F.col("text")
    spans = lambda h: F.transform(h, lambda x, i: F.struct((i + 1).cast("long").alias("heading_no"), T.words(F.substr(text, x["text_from"] + 1, F.coalesce(F.get(h, i + 1)["text_from"], F.length(text)) - x["text_from"])).alias("words")))
    return once(rows.select("chapter_id", T.let(chapter_headings(F.col("elements"), text), spans).alias("s")).where("size(s) > 0")).select("chapter_id", F.inline("s"))


def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each chapter heading and of the two elements around it."""
    rows = parsed(spark, sf_dir, "elem_no", "parent_no", "tag", "id", "text_from", "text_to")
    e = F.col("elements")
    up = lambda x: F.get(e, x["parent_no"])
    ids = lambda x: F.array_join(F.filter(F.array(x["id"], up(x)["id"], up(up(x))["id"]), lambda i: i != ""), " ")
    found = F.filter(F.transform(chapter_headings(e, F.col("text")), ids), lambda i: i != "")
    return once(rows.select("chapter_id", found.alias("f")).where("size(f) > 0")).select("chapter_id", F.explode("f").alias("ids"))


def _by_page(spark: SparkSession, df: DataFrame, schema: str, fn) -> DataFrame:
    """One result row a page by ``fn`` (parsed page, number of its first chapter)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [fn(markup.Page(h)) for h in cols["html"]]
        return {"chapter_id": cols["chapter_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return once(map_batches(df.select("chapter_id", "html"), f"chapter_id long, {schema}", run))


def _markers(page: markup.Page) -> list[tuple[int, int]]:
    text = "".join(page.text)
    return [(n.no, k + 1) for k, n in enumerate(n for n in page.nodes if n.tag == "h2" and text[n.text_from :].startswith("CHAPTER "))]


def markup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written back after parsing: digest and signs."""
    import hashlib

    def back(page: markup.Page) -> tuple:
        html = markup.write(page, markup.Edits())
        return hashlib.md5(html.encode()).hexdigest(), len(html)

    return _by_page(spark, marked_pages(spark, sf_dir), "digest string, signs long", back)


def blocks_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that end right before the chapter headings of a page, by tag."""
    blocks = lambda p: (" ".join(b.tag if b is not None else "-" for b in (edits.block_before(p, p.nodes[n]) for n, _ in _markers(p))),)
    return _by_page(spark, pages(spark, sf_dir), "blocks string", blocks).where("blocks <> ''")


def divided_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their chapters in divisions of their own: how many, page breaks, and whether the text is the same."""

    def run(page: markup.Page) -> tuple:
        e = markup.Edits()
        edits.divide(page, e, _markers(page), False)
        new = markup.Page(markup.write(page, e))
        wrapped = [n for n in new.nodes if n.attrs.get("epub:type") == "chapter"]
        return len(wrapped), sum("page-break-after" in n.attrs.get("style", "") for n in new.nodes), "".join(new.text) == "".join(page.text)

    return _by_page(spark, pages(spark, sf_dir), "divisions long, breaks long, same_text boolean", run).where("divisions > 0")


def standard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two classes standardised: elements of each new class, and inline styles left."""
    mapping = {"x": ("body-text", "body"), "title": ("chapter-heading", "chapter-header")}

    def run(page: markup.Page) -> tuple:
        e = markup.Edits()
        edits.standardise(page, e, mapping)
        new = markup.Page(markup.write(page, e))
        has = lambda c: sum(c in n.attrs.get("class", "").split() for n in new.nodes)
        return has("body"), has("chapter-header"), has("x") + has("title"), sum("height" in n.attrs.get("style", "") for n in new.nodes)

    return _by_page(spark, marked_pages(spark, sf_dir), "body long, headings long, old long, heights long", run)


def _n(p: str) -> str:
    return f"len(regexp_extract_all(html, '{p}'))"


_PLAIN = "replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_HEAD = "<h2[^>]*>(?:<span>)?CHAPTER "
_ALONE = "'^<html><body>(<(header|footer)[^>]*>.*</(header|footer)>)</body></html>$'"
QUERIES = {
    "marker_elements": marker_elements, "boilerplate_elements": boilerplate_elements, "clean_boundaries": clean_boundaries, "words_between": words_between, "candidate_ids": candidate_ids, "markup_round_trip": markup_round_trip, "blocks_before": blocks_before, "divided_pages": divided_pages, "standard_pages": standard_pages,
}
ORACLE = {
    "marker_elements": f"""WITH {SQL_PAGES}, m AS (SELECT chapter_id, tag || ':' || {_PLAIN.format("regexp_replace(x, '</?b>', '', 'g')")} AS t FROM (SELECT chapter_id, 'p' AS tag, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) AS x FROM v UNION ALL SELECT chapter_id, 'h1', unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) FROM v
 UNION ALL SELECT chapter_id, 'h2', unnest(regexp_extract_all(html, '<h2[^>]*>((?:[^<]|</?b>)*)</h2>', 1)) FROM v UNION ALL SELECT chapter_id, 'span', unnest(regexp_extract_all(html, '<span>([^<]*)</span>', 1)) FROM v)) SELECT chapter_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS digest FROM m GROUP BY chapter_id""",
    "boilerplate_elements": f"""WITH {SQL_PAGES}, f AS (SELECT *, html LIKE '%id="pg-header"%' AS tagged, regexp_extract(html, '</h1>(.*?<p>[*]{{3}} START[^<]*</p>)', 1) AS swept FROM v WHERE html LIKE '%*** START OF THE PROJECT%'), b AS (SELECT *, html LIKE '%id="pg-footer"%' AS tagged, regexp_extract(html, '(<p>[*]{{3}} END OF.*)</body>', 1) AS swept FROM v WHERE html LIKE '%*** END OF THE PROJECT%')
SELECT chapter_id, 'front' AS side, CASE WHEN tagged THEN 'tag' ELSE 'text' END AS method, CASE WHEN tagged THEN 'header' ELSE 'p' END AS tag, CAST(CASE WHEN tagged THEN 1 ELSE len(regexp_extract_all(swept, '<p>')) END AS BIGINT) AS blocks, regexp_matches(html, {_ALONE}) AS alone FROM f
UNION ALL SELECT chapter_id, 'back', CASE WHEN tagged THEN 'tag' ELSE 'text' END, CASE WHEN tagged THEN 'footer' ELSE 'p' END, CAST(CASE WHEN tagged THEN 1 ELSE len(regexp_extract_all(swept, '<p>')) END AS BIGINT), regexp_matches(html, {_ALONE}) FROM b""",
    "clean_boundaries": f"WITH {SQL_PAGES} SELECT chapter_id, CAST({_n(_HEAD)} AS BIGINT) AS headings, CAST({_n('(?:<td>|<li>|notes.>)' + _HEAD)} AS BIGINT) AS unclean FROM v",
    "words_between": f"""WITH {SQL_PAGES}, s AS (SELECT chapter_id, string_split(regexp_replace(html, '{_HEAD}', '{chr(0xE003)}CHAPTER ', 'g'), '{chr(0xE003)}') AS parts FROM v), u AS (SELECT chapter_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS heading_no, unnest(parts) AS x FROM s)
SELECT chapter_id, heading_no, CAST(len(regexp_extract_all(regexp_replace(x, '<[^>]*>', '', 'g'), '[^{T.WS}]+')) AS BIGINT) AS words FROM u WHERE heading_no > 0""",
    "candidate_ids": f"WITH {SQL_PAGES} SELECT chapter_id, unnest(regexp_extract_all(html, '<h2 id=\"([^\"]*)\">CHAPTER ', 1)) AS ids FROM v",
    "markup_round_trip": f"WITH v AS ({PAGES_SQL}) SELECT DISTINCT chapter_id, md5(html) AS digest, CAST(length(html) AS BIGINT) AS signs FROM v",
    "blocks_before": f"""WITH {SQL_PAGES}, m AS (SELECT chapter_id, regexp_extract_all(html, '(?:</(p|h1|h2|li)>(?:</td></tr></table>|</ul>|</div>)*|<div>|<td>|<div class="endnotes">)(?:<div[^>]*>|<table><tr><td>)*{_HEAD}', 1) AS b FROM v) SELECT chapter_id, array_to_string([CASE x WHEN '' THEN 'h1' ELSE x END FOR x IN b], ' ') AS blocks FROM m WHERE len(b) > 0""",
    "divided_pages": f"WITH {SQL_PAGES}, n AS (SELECT chapter_id, CAST({_n(_HEAD)} AS BIGINT) AS n FROM v) SELECT chapter_id, n AS divisions, n AS breaks, true AS same_text FROM n WHERE n > 0",
    "standard_pages": f"WITH v AS ({PAGES_SQL}) SELECT DISTINCT chapter_id, CAST({_n('class=.x b.')} AS BIGINT) AS body, CAST({_n('class=.title.')} AS BIGINT) AS headings, CAST(0 AS BIGINT) AS old, CAST(0 AS BIGINT) AS heights FROM v",
}
