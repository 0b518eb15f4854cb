"""Whole runs over a folder of zipped books: analysis to tables, repair to new files.

Repairs of text are native expressions over the arrays of a page's slots. What is removed, merged, divided and renamed is
decided by plans over all pages and given to each page as lists of element numbers. Python opens and parses a page once and writes it
once; entries that no repair touches keep their bytes.
"""

from __future__ import annotations

import posixpath
from datetime import datetime, timezone
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators import chapters, classes, structure, styles
from textmend.operators import elements as X
from textmend.operators.markup import empty_numbers, junk_numbers
from textmend.operators.paragraphs import mid_sentence
from textmend.operators.repairs import RepairOptions, repaired
from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage
from textmend.sources import edits as E
from textmend.sources import epub, markup
from textmend.sources.config import Settings

LAST = 2**31 - 1

class Corpus:
    """The tables of a folder of books that runs share: written once, read by each plan that needs them."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings) -> None:
        self.settings = settings
        self.books = stage(epub.archives(spark, path, settings.repair_containers), "books")
        self.entries = stage(epub.entries(self.books), "entries")
        self.package = stage(epub.packages(self.books), "packages")
        self.html = epub.page_texts(self.entries)
        self.pages = stage(markup.parsed(self.html, "html", "book", "name"), "parsed")

    def order(self) -> DataFrame:
        """(book, name, pos, in_spine): pages in reading order, those outside the spine last."""
        items = self.package.where("kind = 'item'").select("book", "id", F.col("href").alias("name"))
        spine = self.package.where("kind = 'spine'").select("book", "id", F.col("n").alias("at")).join(items, ["book", "id"]).groupBy("book", "name").agg(F.min("at").alias("at"))
        return self.pages.select("book", "name").join(spine, ["book", "name"], "left").select("book", "name", F.coalesce("at", F.lit(LAST)).alias("pos"), F.col("at").isNotNull().alias("in_spine"))

    def markers(self) -> DataFrame:
        """Chapter markers among the elements: innermost candidates whose whole text is one."""
        marks = F.lower(F.concat_ws(" ", F.array_join("e.classes", " "), "e.id"))
        texts = self.pages.select("book", "name", "text", F.explode(X.candidates(F.col("elements"))).alias("e")).withColumn("text", T.sub(markup.text_of(F.col("text"), F.col("e")), r"^\s+|\s+\z", "")).where(chapters.likely(F.col("text")))
        rows = texts.select("book", "name", "text", F.col("e.elem_no").alias("line_no"), F.col("e.tag").rlike("^h[1-6]$").alias("heading"), marks.rlike("chapter|title|heading").alias("hint")).join(self.order(), ["book", "name"])
        return chapters.marked(rows.select(F.col("book").alias("book_id"), F.col("pos").alias("page_no"), F.col("name").alias("chapter_id"), F.col("name").alias("href"), "line_no", "text", "heading", "hint"))

    def boundaries(self) -> DataFrame:
        """(book, name, elem_no, number): the chapters of the winning run of each book."""
        best = chapters.sequences(self.markers()).where("rank = 1")
        return best.select(F.col("book_id").alias("book"), F.posexplode("members").alias("i", "m")).select("book", F.col("m.c").alias("name"), F.col("m.l").alias("elem_no"), (F.col("i") + 1).alias("number"))

    def boilerplate(self) -> DataFrame:
        """(book, front, back): where the opening and the closing boilerplate of a book are: tagged elements before bare text, the first
        page in reading order."""
        e, text = F.col("elements"), F.col("text")

        rows = self.pages.withColumn("ft", X.tagged_boilerplate(e, text, X.START, X.FRONT_ID)).withColumn("bt", X.tagged_boilerplate(e, text, X.END, X.BACK_ID))
        rows = rows.withColumn("fx", X.bare_boilerplate(e, text, X.START)).withColumn("bx", X.bare_boilerplate(e, text, X.END)).withColumn("whole", X.nothing_else(e, text, F.col("bt")))
        rows = rows.select("book", "name", "ft", "bt", "fx", "bx", "whole").where("coalesce(ft, bt, fx, bx) IS NOT NULL").join(self.order(), ["book", "name"])

        def first(no: str, tag: bool) -> Column:
            whole = F.col("whole") if no == "bt" else F.lit(False)
            return F.min(F.when(F.col(no).isNotNull(), F.struct("pos", "name", F.col(no).alias("no"), F.lit(tag).alias("tagged"), whole.alias("whole"))))

        return rows.groupBy("book").agg(F.coalesce(first("ft", True), first("fx", False)).alias("front"), F.coalesce(first("bt", True), first("bx", False)).alias("back"))


def analyze_corpus(spark: SparkSession, path: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Tables of a folder of books: containers, packages, pages, elements, slots, typography, classes, structure and issues."""
    c = Corpus(spark, path, settings)
    slots = c.pages.select("book", "name", F.inline("slots"))
    fixed = repaired(F.col("text"), F.col("lead_inline"), F.col("trail_inline"), options(settings))
    e = F.col("elements")
    tagged = lambda tag: F.size(F.filter(e, lambda x: x["tag"] == tag))
    counts = {"paragraphs": "p", "images": "img", "links": "a", "tables": "table", "spans": "span"}
    return {
        "containers": c.books.drop("content"),
        "packages": c.package,
        "files": c.entries.select("book", "name", "size"),
        "pages": c.pages.select("book", "name", T.words(F.col("text")).alias("words"), *[tagged(t).alias(n) for n, t in counts.items()], F.size(junk_numbers(e, F.col("text"))).alias("junk"), F.size(empty_numbers(e, F.col("text"))).alias("empty")),
        "elements": c.pages.select("book", "name", F.inline("elements")),
        "slots": slots,
        "typography": c.pages.select("book", "name", T.typography(F.col("text")).alias("m")).select("book", "name", "m.*"),
        "issues": slots.where(~F.col("protected")).withColumn("after", fixed).where("after <> text").select("book", "name", "slot_no", F.col("text").alias("before"), "after"),
        "boilerplate": c.boilerplate(),
        "classes": class_profiles(c),
        "structure": structure_of(c),
        "covers": covers(c),
    }


def options(settings: Settings, apostrophe: str = "'") -> RepairOptions:
    return RepairOptions(settings.ellipses, "…" if settings.ellipsis_style == "unicode" else "...", settings.apostrophes, "’" if settings.apostrophe_style == "curly" else apostrophe, T.RULES if settings.whitespace else ())


def sheet_rules(c: Corpus) -> DataFrame:
    """(book_id, rule_no, selector, body) of the style sheets in the archives."""
    css = c.entries.where(F.lower("name").endswith(".css")).select(F.col("book").alias("book_id"), F.decode("data", "UTF-8").alias("css"))
    return styles.rules_of(css)


def class_profiles(c: Corpus) -> DataFrame:
    used = c.pages.select(F.col("book").alias("book_id"), F.inline(F.flatten(F.transform("elements", lambda e: F.transform(e["classes"], lambda x: F.struct(e["tag"].alias("tag"), x.alias("class")))))))
    return classes.profiles(used, styles.properties_of(sheet_rules(c)))


def covers(c: Corpus) -> DataFrame:
    """The cover of each book: the item marked as one before the one that the metadata names; what is wrong with it, in one line."""
    items = c.package.where("kind = 'item'").select("book", "id", "href", "media_type", "properties")
    marked = items.where(F.array_contains(F.split("properties", " "), "cover-image")).groupBy("book").agg(F.min(F.struct("id", "href", "media_type")).alias("p"))
    named = c.package.where("kind = 'meta' AND label = 'cover'").select("book", F.col("value").alias("id"))
    by_meta = named.join(items.select("book", "id", F.struct("id", "href", "media_type").alias("m")), ["book", "id"], "left").groupBy("book").agg(F.first("id").alias("meta_id"), F.first("m").alias("m"))
    there = c.entries.select("book", F.col("name").alias("href"), F.lit(True).alias("there"))
    b = c.books.where("content IS NOT NULL").select("book").join(marked, "book", "left").join(by_meta, "book", "left").withColumn("cover", F.coalesce("p", "m"))
    b = b.withColumn("href", F.col("cover.href")).join(there, ["book", "href"], "left")
    status = (
        F.when(F.col("cover").isNull() & F.col("meta_id").isNull(), "no cover declared").when(F.col("cover").isNull(), F.concat(F.lit("dangling cover id "), "meta_id")).when(F.col("there").isNull(), F.concat(F.lit("missing file "), "href"))
        .when(~F.col("cover.media_type").startswith("image/"), F.concat(F.lit("no image: "), "cover.media_type")).when(F.col("p.id") != F.col("m.id"), "two covers declared").when(F.col("meta_id").isNotNull() & F.col("m").isNull(), F.concat(F.lit("dangling cover id "), "meta_id"))
    )
    return b.select("book", F.col("cover.id").alias("item"), "href", status.isNotNull().alias("problem"), F.coalesce(status, F.lit("ok")).alias("status"))


def structure_of(c: Corpus) -> DataFrame:
    """The chapters of each book with the evidence for each boundary and how sure it is."""
    found = c.markers()
    runs = chapters.sequences(found)
    margin = runs.groupBy("book_id").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("margin"))
    best = runs.where("rank = 1").select(F.col("book_id").alias("book"), F.posexplode("members").alias("i", "m")).select("book", F.col("m.c").alias("name"), F.col("m.l").alias("elem_no"), (F.col("i") + 1).alias("number"))
    titles = found.select(F.col("book_id").alias("book"), F.col("chapter_id").alias("name"), F.col("line_no").alias("elem_no"), F.col("text").alias("title"), "score")
    e = F.col("elements")
    up = lambda x: F.get(e, x["parent_no"])
    me = F.get(e, F.col("elem_no"))
    ids = F.filter(F.array(me["id"], up(me)["id"], up(up(me))["id"]), lambda i: i != "")
    unclean = X.unclean(e, F.col("elem_no"))
    order = c.order().withColumn("place", F.struct(F.col("pos").alias("p"), F.col("name").alias("c")))
    words = structure.page_starts(c.pages.select(F.col("book").alias("book_id"), "name", T.words(F.col("text")).alias("words")).join(order.select(F.col("book").alias("book_id"), "name", "place"), ["book_id", "name"]))
    b = best.join(titles, ["book", "name", "elem_no"]).join(c.pages.select("book", "name", "text", "elements"), ["book", "name"])
    b = b.select("book", "name", "elem_no", "number", "title", "score", ids.alias("ids"), (~unclean).alias("clean"), T.words(F.substr("text", F.lit(1), me["text_from"])).alias("offset"))
    b = b.join(words.select(F.col("book_id").alias("book"), "name", "start", "words"), ["book", "name"]).withColumn("begin", F.col("start") + F.col("offset"))
    following = F.lead("begin").over(Window.partitionBy("book").orderBy("number"))
    b = b.withColumn("content_words", F.coalesce(following, F.col("start") + F.col("words")) - F.col("begin")).withColumn("node_id", F.xxhash64("book", "name", "elem_no"))
    toc = c.package.where("kind = 'toc'").select(F.col("book").alias("book_id"), F.col("n").alias("entry_no"), "href")
    matched = structure.corroborated(b.select("node_id", F.col("book").alias("book_id"), F.col("name").alias("file"), "ids", F.col("number").alias("place")), toc)
    links = c.pages.select("book", "name", F.explode(F.transform(F.filter("elements", lambda x: (x["tag"] == "a") & F.coalesce(x["attrs"]["href"].rlike("^(?!https?:|mailto:)[^#]*#."), F.lit(False))), lambda x: x["attrs"]["href"])).alias("link"))
    file = F.substring_index("link", "#", 1)
    targets = links.select("book", F.when(file == "", F.col("name")).otherwise(T.normal_path(F.concat(F.regexp_replace("name", "[^/]*$", ""), file))).alias("name"), F.substring_index("link", "#", -1).alias("id")).distinct()
    anchors = b.select("node_id", "book", "name", F.explode("ids").alias("id")).join(targets, ["book", "name", "id"]).groupBy("node_id").agg(F.min("id").alias("anchor"))
    b = b.join(matched, "node_id", "left").join(anchors, "node_id", "left").join(margin.withColumnRenamed("book_id", "book"), "book", "left")
    long_enough = F.col("content_words") >= structure.LEAST_WORDS
    sure = structure.confidence_of(F.lit(True), F.col("margin"), F.col("entry_no").isNotNull() | F.col("anchor").isNotNull(), long_enough, F.col("clean"))
    return b.select("book", "number", "name", "elem_no", "title", "score", "entry_no", "anchor", "content_words", long_enough.alias("long_enough"), "clean", "margin", sure.alias("confidence"))


def structure_report(rows: DataFrame) -> list[str]:
    """The structure of a book for people: its margin, a line for each chapter with what speaks for it, and the verdict."""
    found = rows.orderBy("number").collect()
    if not found:
        return ["No chapters found."]
    margin = found[0]["margin"]
    lines = ["Margin: none, there is no other run." if margin is None else f"Margin over the next run: {margin:.1f}" + (" (below the limit)" if margin < structure.LEAST_MARGIN else "")]
    for r in found:
        why = [f"entry {r['entry_no']}"] * (r["entry_no"] is not None) + [f"anchor {r['anchor']}"] * (r["anchor"] is not None) + [f"only {r['content_words']} words"] * (not r["long_enough"]) + ["inside a table, list or note"] * (not r["clean"])
        lines.append(f"- {r['title']}: {r['confidence']}" + (f" ({'; '.join(why)})" if why else ""))
    lines.append("Some boundary can be split at." if any(r["confidence"] == "corroborated" for r in found) else "No boundary can be split at.")
    return lines


def merges(elements: Column, gone: Column, text: Column) -> Column:
    """Pairs of neighbouring paragraphs that one sentence runs through."""
    trimmed = lambda e: T.sub(markup.text_of(text, e), rf"^[{T.WS}]+|[{T.WS}]+\z", "")
    kept = F.transform(F.filter(elements, lambda e: (e["tag"] == "p") & ~F.array_contains(gone, e["elem_no"])), lambda e: F.struct(e["elem_no"].alias("no"), trimmed(e).alias("text")))
    n = lambda k: F.greatest(F.size(k) - 1, F.lit(0))
    pairs = T.let(kept, lambda k: F.zip_with(F.slice(k, 1, n(k)), F.slice(k, 2, n(k)), lambda a, b: F.struct(a["no"].alias("a"), b["no"].alias("b"), mid_sentence(a["text"], b["text"]).alias("split"))))
    return F.transform(F.filter(pairs, lambda p: p["split"]), lambda p: F.struct(p["a"], p["b"]))


def _work(c: Corpus) -> DataFrame:
    """Each page with all that is to be done to it."""
    s = c.settings
    pages, none = c.pages, F.array().cast("array<int>")
    names = c.entries.select("book", F.col("name").alias("file"))
    img = pages.select("book", "name", F.inline(F.transform(F.filter("elements", lambda e: e["tag"] == "img"), lambda e: F.struct(e["elem_no"].alias("elem_no"), e["attrs"]["src"].alias("src")))))
    local = img.where((F.col("src") != "") & ~F.col("src").rlike("^(?:https?:|data:)"))
    # the folder of the page that has the image
    folder = F.regexp_replace("name", "[^/]*$", "")
    broken = local.withColumn("file", T.normal_path(F.concat(folder, F.url_decode(F.replace("src", F.lit("+"), F.lit("%2B")))))).join(names, ["book", "file"], "left_anti")
    lost = broken.groupBy("book", "name").agg(F.collect_list("elem_no").alias("lost"))
    count_of = lambda signs: F.aggregate("slots", F.lit(0), lambda n, x: n + F.length(x["text"]) - F.length(F.translate(x["text"], signs, "")))
    curly = pages.select("book", count_of("'").alias("straight"), count_of("‘’").alias("curly")).groupBy("book").agg((F.sum("curly") > F.sum("straight")).alias("is_curly"))

    def fixed(x: Column) -> Column:
        plain = repaired(x["text"], x["lead_inline"], x["trail_inline"], options(s))
        if s.apostrophe_style == "auto":
            plain = F.when(F.col("is_curly"), repaired(x["text"], x["lead_inline"], x["trail_inline"], options(s, "’"))).otherwise(plain)
        return F.when(x["protected"], x["text"]).otherwise(plain)

    e, text = F.col("elements"), F.col("text")
    w = pages.join(lost, ["book", "name"], "left").join(curly, "book", "left").join(c.order(), ["book", "name"])
    w = w.withColumn("junk", junk_numbers(e, text) if s.junk_paragraphs else none).withColumn("empty", empty_numbers(e, text) if s.empty_paragraphs else none).withColumn("lost", F.coalesce("lost", none) if s.broken_images else none)
    w = w.withColumn("gone", F.concat("junk", "empty", "lost")).withColumn("pairs", merges(e, F.col("gone"), text) if s.split_sentences else F.array().cast("array<struct<a:int,b:int>>"))
    texts = F.filter(F.zip_with("slots", F.transform("slots", fixed), lambda a, b: F.struct(a["slot_no"].alias("n"), a["text"].alias("old"), b.alias("t"))), lambda x: x["old"] != x["t"])
    w = w.withColumn("texts", F.transform(texts, lambda x: F.struct(x["n"], x["t"])))
    bp = c.boilerplate()
    place = F.struct("pos", "name")
    end = F.struct(F.col("back.pos").alias("pos"), F.col("back.name").alias("name"))
    w = w.join(bp, "book", "left")
    mine = lambda side, on: F.when(F.lit(on) & (F.col(f"{side}.name") == F.col("name")), F.col(side))
    dropped = F.lit(s.boilerplate_back) & F.col("back").isNotNull() & ((F.col("in_spine") & (place > end)) | ((F.col("back.name") == F.col("name")) & F.col("back.whole")))
    w = w.withColumn("dropped", F.coalesce(dropped, F.lit(False))).withColumn("front", mine("front", s.boilerplate_front)).withColumn("back", mine("back", s.boilerplate_back))
    if s.chapter_marks:
        marks = c.boundaries().groupBy("book", "name").agg(F.array_sort(F.collect_list(F.struct("elem_no", "number"))).alias("marks"))
        w = w.join(marks, ["book", "name"], "left")
    else:
        w = w.withColumn("marks", F.lit(None).cast("array<struct<elem_no:int,number:int>>"))
    first = c.order().where("in_spine").groupBy("book").agg(F.min_by("name", "pos").alias("first_page"))
    nav = c.package.where("kind = 'item'").where(F.array_contains(F.split("properties", " "), "nav")).select("book", F.col("href").alias("name"), F.lit(True).alias("is_nav"))
    w = w.join(first, "book", "left").join(nav, ["book", "name"], "left")
    return stage(w.select("book", "name", "junk", "empty", "lost", "gone", "pairs", "texts", "front", "back", "dropped", "marks", (F.col("first_page") == F.col("name")).alias("is_first"), F.coalesce("is_nav", F.lit(False)).alias("is_nav")), "work")


def repair_report(spark: SparkSession, path: str, settings: Settings = Settings(), mapping: list[dict[str, str]] | None = None) -> DataFrame:
    """(book, location, category, n): what a repair would do, without writing a book."""
    c = Corpus(spark, path, settings)
    w = _work(c)
    by = {
        "empty paragraphs": F.size("empty"), "converter junk": F.size("junk"), "broken images": F.size("lost"), "split sentences": F.size("pairs"), "texts": F.size("texts"), "opening boilerplate": F.col("front").isNotNull().cast("int"),
        "closing boilerplate": F.col("back").isNotNull().cast("int"), "whole pages of boilerplate": F.col("dropped").cast("int"), "chapters": F.coalesce(F.size("marks"), F.lit(0)),
    }
    out = w.select("book", F.col("name").alias("location"), F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("n")) for k, v in by.items()])).alias("i")).select("book", "location", "i.*").where("n > 0")
    if mapping:
        old = [m["old_name"] for m in mapping]
        used = c.pages.select("book", F.col("name").alias("location"), F.size(F.filter("elements", lambda e: F.arrays_overlap(e["classes"], F.array(*map(F.lit, old))))).alias("n")).where("n > 0")
        out = out.unionByName(used.withColumn("category", F.lit("classes")))
    return out


def repair_corpus(spark: SparkSession, path: str, settings: Settings = Settings(), mapping: list[dict[str, str]] | None = None, now: str | None = None) -> DataFrame:
    """(book, content): the repaired books. ``mapping`` standardises classes, ``now`` is the time written into upgraded packages."""
    c = Corpus(spark, path, settings)
    w = _work(c)
    roles = {m["old_name"]: (m["role"], m["new_name"]) for m in mapping or []}
    removed = w.where("dropped").groupBy("book").agg(F.collect_set("name").alias("removed"))
    todo = w.where("NOT dropped").join(removed, "book", "left").where(
        (F.size("gone") > 0) | (F.size("pairs") > 0) | (F.size("texts") > 0) | F.col("front").isNotNull() | F.col("back").isNotNull() | F.col("marks").isNotNull() | (F.col("is_nav") & F.col("removed").isNotNull()) | F.lit(bool(roles))
    )

    def write(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"book": [], "name": [], "data": []}
        for r in zip(*(cols[k] for k in ("book", "name", "html", "texts", "gone", "pairs", "front", "back", "marks", "is_first", "is_nav", "removed")), strict=True):
            new = edited(*r[1:], roles)
            if new != r[2]:
                for k, x in zip(out, (r[0], r[1], new.encode()), strict=True):
                    out[k].append(x)
        return out

    changed = stage(map_batches(todo.join(c.html, ["book", "name"]).select("book", "name", "html", "texts", "gone", "pairs", "front", "back", "marks", "is_first", "is_nav", "removed"), "book string, name string, data binary", write), "changed")
    changed = changed.unionByName(packages_edited(c, removed, now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))
    if roles:

        def sheets(cols: dict[str, list]) -> dict[str, list]:
            return {"book": cols["book"], "name": cols["name"], "data": [E.standard_css(d.decode("utf-8", "replace"), roles).encode() for d in cols["data"]]}

        changed = changed.unionByName(map_batches(c.entries.where(F.lower("name").endswith(".css")).select("book", "name", "data"), "book string, name string, data binary", sheets))
    changed = stage(changed, "all-changed")
    gone = changed.select("book", "name").unionByName(w.where("dropped").select("book", "name"))
    kept = c.entries.select("book", "name", "data").join(gone, ["book", "name"], "left_anti")
    return epub.pack(kept.unionByName(changed))


def edited(name, html, texts, gone, pairs, front, back, marks, is_first, is_nav, removed, roles) -> str:
    """One page with its edits."""
    page = markup.Page(html)
    edits = markup.Edits({t["n"]: t["t"] for t in texts}, set(gone), [(p["a"], p["b"]) for p in pairs])
    if front:
        edits.removed |= E.without_front(page, front["no"], front["tagged"])
    if back:
        edits.removed |= E.without_back(page, back["no"])
    if roles:
        E.standardise(page, edits, roles)
    if marks:
        E.divide(page, edits, [(m["elem_no"], m["number"]) for m in marks], bool(is_first))
    if is_nav and removed:
        folder = posixpath.dirname(name)
        for a in page.nodes:
            if a.tag == "a" and epub.resolve(folder, a.attrs.get("href", "")).partition("#")[0] in removed:
                edits.removed.add(a.parent.no if a.parent is not None and a.parent.tag == "li" else a.no)
    return markup.write(page, edits) if edits else html


def packages_edited(c: Corpus, removed: DataFrame, now: str) -> DataFrame:
    """(book, name, data): package documents without the pages removed, and of books below version 3 that have no navigation yet upgraded,
    with a navigation document."""
    p = c.package
    version = p.where("kind = 'meta' AND label = 'version'").select("book", F.coalesce(F.expr("try_cast(split(value, '[.]')[0] as int)"), F.lit(0)).alias("major"))
    has_nav = p.where(F.array_contains(F.split("properties", " "), "nav")).select("book").distinct()
    old = version.where(F.lit(c.settings.upgrade) & (F.col("major") < 3)).join(has_nav, "book", "left_anti").select("book")
    items = p.where("kind = 'item'").select("book", "id", "href", "media_type")
    first = F.row_number().over(Window.partitionBy("book", "file").orderBy("n"))
    labels = p.where("kind = 'toc' AND label <> '' AND href <> ''").withColumn("file", F.substring_index("href", "#", 1)).withColumn("first", first).where("first = 1").select("book", F.col("file").alias("href"), "label")
    # a page without an entry is known by its first heading
    heading = F.get(F.filter("elements", lambda e: e["tag"].rlike("^h[1-6]$") & (F.trim(markup.text_of(F.col("text"), e)) != "")), F.lit(0))
    heads = c.pages.select("book", F.col("name").alias("href"), T.sub(F.trim(markup.text_of(F.col("text"), heading)), r"\s+", " ").alias("head"))
    gone = removed.select("book", F.explode("removed").alias("href"))
    spine = p.where("kind = 'spine'").select("book", "id", F.col("n").alias("pos")).join(items.where("media_type = 'application/xhtml+xml'"), ["book", "id"]).join(gone, ["book", "href"], "left_anti").join(labels, ["book", "href"], "left").join(heads, ["book", "href"], "left").join(old, "book", "left_semi")
    nav = spine.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href", F.coalesce("label", "head", "href").alias("label")))), lambda x: F.struct(x["href"].alias("href"), x["label"].alias("label"))).alias("nav"))
    names = c.entries.groupBy("book").agg(F.collect_set("name").alias("names"))
    opf = c.entries.where("lower(name) LIKE '%.opf'").select("book", "name", "data").join(nav, "book", "left").join(removed, "book", "left").where("nav IS NOT NULL OR removed IS NOT NULL").join(names, "book")

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"book": [], "name": [], "data": []}
        for book, name, data, rows, lost, taken in zip(*(cols[k] for k in ("book", "name", "data", "nav", "removed", "names")), strict=True):
            folder = posixpath.dirname(name)
            file = E.free_name({posixpath.relpath(n, folder or ".") for n in taken}, "nav.xhtml", lambda n: f"nav{n - 1}.xhtml") if rows else None
            parts = [(name, package(data.decode("utf-8-sig", "replace"), folder, set(lost or ()), file, now))]
            if rows:
                parts.append((posixpath.join(folder, file), navigation(folder, rows)))
            for n, d in parts:
                for k, x in zip(out, (book, n, d.encode()), strict=True):
                    out[k].append(x)
        return out

    return map_batches(opf, "book string, name string, data binary", run)


def package(opf: str, folder: str, removed: set[str], nav: str | None, now: str) -> str:
    """A package document without the removed files; with ``nav`` as version 3 with that navigation document."""
    page = markup.Page(opf)
    edits = markup.Edits()
    lost = {n.attrs.get("id") for n in page.nodes if n.tag == "item" and epub.resolve(folder, n.attrs.get("href", "")) in removed}
    edits.removed = {n.no for n in page.nodes if n.tag == "item" and n.attrs.get("id") in lost or n.tag == "itemref" and n.attrs.get("idref") in lost}
    if nav:
        root = next((n for n in page.nodes if n.tag == "package"), None)
        manifest = next((n for n in page.nodes if n.tag == "manifest"), None)
        metadata = next((n for n in page.nodes if n.tag == "metadata"), None)
        if root is not None:
            edits.attrs[root.no] = {"version": "3.0"}
        # what is put beside a removed element would go with it
        if manifest is not None and (kids := [k for k in page.children(manifest) if k.no not in edits.removed]):
            name = E.free_name({n.attrs.get("id", "") for n in page.nodes}, "nav", lambda n: f"nav{n - 1}")
            edits.after[kids[-1].no] = f'<item id="{name}" href="{escape(nav)}" media-type="application/xhtml+xml" properties="nav"/>'
        if metadata is not None and (kids := page.children(metadata)) and not any(n.attrs.get("property") == "dcterms:modified" for n in kids):
            edits.after[kids[-1].no] = f'<meta property="dcterms:modified">{now}</meta>'
    return markup.write(page, edits)


def navigation(folder: str, rows: list[dict]) -> str:
    entries = "".join(f'<li><a href="{escape(posixpath.relpath(r["href"], folder or "."), {chr(34): "&quot;"})}">{escape(r["label"])}</a></li>' for r in rows)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>'
