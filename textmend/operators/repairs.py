"""Repairs of text: ellipses, apostrophes and white space, as before -> after projections, one by one and composed.

Each finds its issues and writes the repaired text with the same expressions, so what is reported is what
is repaired. A line of a page is a text slot; every third line has an inline neighbour before it and every
third one after it, as slots of marked-up pages do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators.views import WORN_SQL, worn_pages
from textmend.plans.runtime import table


@dataclass(frozen=True)
class RepairOptions:
    """Which repairs are on, and their target forms."""

    ellipses: bool = True
    ellipsis: str = "…"
    apostrophes: bool = True
    apostrophe: str = "'"
    whitespace: tuple[str, ...] = T.RULES
    #: As an older tool did: white space is not repaired in a text that another repair has changed.
    once: bool = False


def repaired(t: Column, leading_glue: Column, trailing_glue: Column, options: RepairOptions = RepairOptions()) -> Column:
    """Ellipses, then apostrophes, then white space; blank texts become one blank."""

    def rest(out: Column) -> Column:
        if not options.whitespace:
            return out
        spaced = F.when(out.rlike(rf"^[{T.WS}]+\z"), F.lit(" ")).otherwise(T.whitespace(out, leading_glue, trailing_glue, options.whitespace)["text"])
        return F.when(out == t, spaced).otherwise(out) if options.once else spaced

    out = T.ellipses(t, options.ellipsis) if options.ellipses else t
    out = T.contractions(out, options.apostrophe) if options.apostrophes else out
    return T.let(out, rest)


RULE_COLUMNS = {"leading": "leading_indent", "trailing": "trailing_space"}


def _slots(fix) -> Column:
    """``fix`` (line, inline neighbour before, after) over the lines of a page: a repair is local to its page."""
    return F.transform(F.split("t", "\n"), lambda x, i: fix(x, i % 3 == 1, i % 3 == 2))


def ellipsis_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with three-dot or spaced ellipses and how many of each. A text without a full stop needs no search."""
    t = F.col("t")
    combined = f"{T.SPACED_ELLIPSIS}|{T.ASCII_ELLIPSIS}"
    found = worn_pages(spark, sf_dir).where(F.contains(t, F.lit("."))).select("chapter_id", "href", F.regexp_extract_all(t, F.lit(f"({combined})"), F.lit(1)).alias("m"))
    return found.where("size(m) > 0").select(
        "chapter_id", "href", F.size(F.filter("m", lambda x: x == "...")).cast("long").alias("ascii"), F.size(F.filter("m", lambda x: x != "...")).cast("long").alias("spaced")
    ).distinct()


def ellipsis_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages changed by the ellipsis repair: lengths before and after and the new text's digest."""
    out = worn_pages(spark, sf_dir).withColumn("after", T.ellipses(F.col("t"))).where("after <> t")
    return out.select("chapter_id", F.length("t").cast("long").alias("chars_before"), F.length("after").cast("long").alias("chars_after"), F.md5("after").alias("digest")).distinct()


def contraction_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with split contractions or archaic words without their apostrophe, and how many."""
    out = worn_pages(spark, sf_dir).withColumn("n", T.occurrences(T.contractions(F.col("t")), "'") - T.occurrences(F.col("t"), "'"))
    return out.where("n > 0").select("chapter_id", "href", "n").distinct()


def contraction_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages changed by the apostrophe repair."""
    out = worn_pages(spark, sf_dir).withColumn("after", T.contractions(F.col("t"))).where("after <> t")
    return out.select("chapter_id", F.length("after").cast("long").alias("chars_after"), F.md5("after").alias("digest")).distinct()


def possessive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before a lone s, with both readings; only reported, never changed."""
    out = worn_pages(spark, sf_dir).where(F.contains(F.lower("t"), F.lit(" s"))).select("chapter_id", F.explode(T.bare_s(F.col("t"))).alias("word"))
    return out.select("chapter_id", "word", F.concat("word", F.lit("'s")).alias("possessive_reading"), F.concat("word", F.lit("s")).alias("plural_reading")).distinct()


def whitespace_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that the white-space rules change: the main category and which rules applied."""
    steps = _slots(lambda x, before, after: T.let(T.whitespace(x, before, after), lambda s: F.struct((s["text"] != x).alias("changed"), *[s[r].alias(r) for r in T.RULES], T.whitespace_category(s).alias("category"))))
    numbered = F.filter(F.transform(steps, lambda s, i: F.struct(i.cast("long").alias("line_no"), s.alias("s"))), lambda x: x["s"]["changed"])
    rows = worn_pages(spark, sf_dir).select("chapter_id", numbered.alias("found")).where("size(found) > 0").dropDuplicates(["chapter_id"])
    return rows.select("chapter_id", F.inline("found")).select("chapter_id", "line_no", *[F.col(f"s.{r}").alias(RULE_COLUMNS.get(r, r)) for r in T.RULES], "s.category")


def whitespace_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the white-space issues by category."""
    return whitespace_issues(spark, sf_dir).groupBy("category").agg(F.count("*").alias("slots"), F.countDistinct("chapter_id").alias("pages"))


def _of_books(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    return found.join(table(spark, sf_dir, "chapters").select("chapter_id", "book_id").distinct(), "chapter_id")


def whitespace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each book how often each white-space rule applied, and the pages with issues."""
    names = [RULE_COLUMNS.get(r, r) for r in T.RULES]
    return _of_books(spark, sf_dir, whitespace_issues(spark, sf_dir)).groupBy("book_id").agg(*[F.count_if(n).alias(n) for n in names], F.count("*").alias("slots"), F.countDistinct("chapter_id").alias("pages"))


def ellipsis_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses of each book by form, and the pages that have them."""
    return _of_books(spark, sf_dir, ellipsis_issues(spark, sf_dir)).groupBy("book_id").agg(F.sum("ascii").alias("ascii"), F.sum("spaced").alias("spaced"), (F.sum("ascii") + F.sum("spaced")).alias("issues"), F.countDistinct("chapter_id").alias("pages"))


def apostrophe_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost apostrophes and possible possessives of each book, and the pages that have them."""
    c = _of_books(spark, sf_dir, contraction_issues(spark, sf_dir)).groupBy("book_id").agg(F.sum("n").alias("lost"), F.countDistinct("chapter_id").alias("lost_pages"))
    p = _of_books(spark, sf_dir, possessive_candidates(spark, sf_dir)).groupBy("book_id").agg(F.count("*").alias("possible"), F.countDistinct("chapter_id").alias("possible_pages"))
    return c.join(p, "book_id", "full").na.fill(0)


def possessive_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each possible possessive with the 25 signs before and after it on its line."""
    found = F.regexp_extract_all("t", F.lit(rf"[^\n]{{0,25}}?{T.EDGE_L}[A-Za-z0-9]{{2,}} [sS]{T.EDGE_R}(?![./,;:\-–—])[^\n]{{0,25}}"), F.lit(0))
    rows = worn_pages(spark, sf_dir).where(F.contains(F.lower("t"), F.lit(" s"))).select("chapter_id", found.alias("found")).where("size(found) > 0").dropDuplicates(["chapter_id"])
    return rows.select("chapter_id", F.posexplode("found").alias("n", "snippet")).select("chapter_id", F.col("n").cast("long").alias("n"), "snippet")


def _whole(spark: SparkSession, sf_dir: str, fix) -> DataFrame:
    """Pages with their slots repaired: digest and the number of slots changed. No text leaves its row."""
    rows = worn_pages(spark, sf_dir).select("chapter_id", F.split("t", "\n").alias("lines"), _slots(fix).alias("after"))
    changed = F.size(F.filter(F.zip_with("lines", "after", lambda a, b: a != b), lambda x: x)).cast("long")
    return rows.select("chapter_id", F.md5(F.array_join("after", "\n")).alias("digest"), changed.alias("changed")).dropDuplicates(["chapter_id"])


def whitespace_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after the white-space repair."""
    return _whole(spark, sf_dir, lambda x, before, after: T.whitespace(x, before, after)["text"])


def missing_space_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages changed by the missing-blank rules, and the blanks put in."""
    out = worn_pages(spark, sf_dir).withColumn("after", T.missing_spaces(F.col("t"))).where("after <> t")
    return out.select("chapter_id", (F.length("after") - F.length("t")).cast("long").alias("blanks"), F.md5("after").alias("digest")).distinct()


def text_repair_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after all text repairs, composed in their order."""
    return _whole(spark, sf_dir, repaired)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, category, description): every analyser's findings in one table."""
    e = ellipsis_issues(spark, sf_dir)
    return (
        e.where("ascii > 0").select(F.col("chapter_id").alias("location"), F.lit("ellipsis").alias("category"), F.lit("three dots").alias("description"))
        .unionByName(e.where("spaced > 0").select(F.col("chapter_id").alias("location"), F.lit("ellipsis").alias("category"), F.lit("spaced dots").alias("description")))
        .unionByName(contraction_issues(spark, sf_dir).select(F.col("chapter_id").alias("location"), F.lit("apostrophe").alias("category"), F.lit("lost apostrophe").alias("description")))
        .unionByName(whitespace_issues(spark, sf_dir).select(F.col("chapter_id").alias("location"), F.lit("white space").alias("category"), F.col("category").alias("description")))
    )


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and affected locations by category, most first."""
    return issues(spark, sf_dir).groupBy("category").agg(F.count("*").alias("issues"), F.countDistinct("location").alias("locations")).orderBy(F.desc("issues"), "category")


def issue_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each location by category."""
    return issues(spark, sf_dir).groupBy("location").agg(
        F.count("*").alias("issues"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )


def top_issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten locations of each category with most issues."""
    n = issues(spark, sf_dir).groupBy("category", "location").agg(F.count("*").alias("issues"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("issues"), "location"))
    return n.withColumn("rank", rank.cast("long")).where("rank <= 10")


# --- the same in SQL ----------------------------------------------------------------------------------------

_B = r"\p{L}\p{N}_"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(to)}, 'g')"


def ellipses_sql(t: str) -> str:
    # three dots exactly: runs of dots are marked at both ends first, and what was spaced dots, as a dot stood there; twice, as
    # neighbours share a sign
    spaced, run = chr(0xE002), chr(0xE001)
    t = rx(rx(t, r"\.(?:[ \t]+\.){2,}", f"{spaced}…{spaced}"), r"\.{4,}", f"{run}\\0{run}")
    for _ in range(2):
        t = rx(t, rf"(^|[^.{run}{spaced}])\.\.\.($|[^.{run}{spaced}])", r"\1…\2")
    return f"replace(replace({t}, '{run}', ''), '{spaced}', '')"


def contractions_sql(t: str) -> str:
    for _ in range(2):
        for fragment, heads in T.CONTRACTIONS.items():
            t = rx(t, rf"(?i)(^|[^{_B}])({'|'.join(heads)}) ({fragment})($|[^{_B}/])", r"\1\2'\3\4")
    for _ in range(2):
        t = rx(t, rf"(?i)(^|[^{_B}‘’'])({'|'.join(T.LEADING_WORDS)})($|[^{_B}])", r"\1'\2\3")
    return t


def missing_sql(t: str) -> str:
    for _ in range(2):
        t = rx(t, rf"(^|[^A-Za-z])((?i:{'|'.join(T.ABBREVIATIONS)}))\.([A-Z])", "\\1\\2.\\3")
    t = rx(t, r"([A-Za-z]{2,})([.!?])([A-Z][a-z])", r"\1\2 \3")
    t = f"replace({t}, chr(57346), '')"
    for sign in ",;:":
        t = rx(t, f"([A-Za-z]){sign}([A-Za-z])", rf"\1{sign} \2")
    return t


_SLOTS = f"""worn AS ({WORN_SQL}), slots AS (SELECT chapter_id, CAST(generate_subscripts(string_split(t, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(t, chr(10))) AS line FROM worn)"""
_STEPS = f"""s1 AS (SELECT *, contains(line, chr(9)) AS tabs, replace(line, chr(9), ' ') AS t1 FROM slots),
s2 AS (SELECT *, regexp_matches(t1, '^[ \\r\\n]') AS leading_indent, CASE WHEN regexp_matches(t1, '^[ \\r\\n]') THEN CASE WHEN line_no % 3 = 1 THEN ' ' ELSE '' END || regexp_replace(t1, '^[ \\r\\n]+', '') ELSE t1 END AS t2 FROM s1),
s3 AS (SELECT *, regexp_matches(t2, '[ \\r\\n]$') AS trailing_space, CASE WHEN regexp_matches(t2, '[ \\r\\n]$') THEN regexp_replace(t2, '[ \\r\\n]+$', '') || CASE WHEN line_no % 3 = 2 THEN ' ' ELSE '' END ELSE t2 END AS t3 FROM s2),
s4 AS (SELECT *, {rx('t3', '[ ' + chr(92) + 'r' + chr(92) + 'n]{2,}', ' ')} AS t4 FROM s3),
s5 AS (SELECT *, t4 <> t3 AS repeated, {rx('t4', '[ ' + chr(92) + 't]+([,.;:!?…])', chr(92) + '1')} AS t5 FROM s4),
s6 AS (SELECT *, t5 <> t4 AS before_punctuation, {missing_sql('t5')} AS after FROM s5),
s7 AS (SELECT *, after <> t5 AS missing FROM s6)"""
_CATEGORY = "CASE WHEN tabs THEN 'tab converted' WHEN missing THEN 'missing space' WHEN before_punctuation THEN 'space before punctuation' WHEN leading_indent THEN 'leading indent' WHEN trailing_space THEN 'trailing space' WHEN repeated THEN 'repeated space' END"
_ISSUES_SQL = f"WITH {_SLOTS}, {_STEPS} SELECT chapter_id, line_no, leading_indent, trailing_space, repeated, tabs, before_punctuation, missing, {_CATEGORY} AS category FROM s7 WHERE after <> line AND line <> ''"
_WHOLE = "md5(string_agg(after, chr(10) ORDER BY line_no)) AS digest, CAST(sum(CASE WHEN after <> line THEN 1 ELSE 0 END) AS BIGINT) AS changed"
_E = "SELECT chapter_id, href, len(list_filter(m, lambda x: x = '...')) AS ascii, len(list_filter(m, lambda x: x <> '...')) AS spaced FROM"
ELLIPSIS_SQL = f"""WITH worn AS ({WORN_SQL}), f AS (SELECT chapter_id, href, regexp_extract_all(t, {q(chr(92) + '.(?:[ ' + chr(92) + 't]+' + chr(92) + '.){2,}')}) AS sp, {rx('t', chr(92) + '.(?:[ ' + chr(92) + 't]+' + chr(92) + '.){2,}', '…')} AS rest FROM worn),
g AS (SELECT chapter_id, href, CAST(len(list_filter(regexp_extract_all(rest, '[.]+'), lambda x: length(x) = 3)) AS BIGINT) AS ascii, CAST(len(sp) AS BIGINT) AS spaced FROM f) SELECT * FROM g WHERE ascii + spaced > 0"""
_CONTR = f"WITH worn AS ({WORN_SQL}), f AS (SELECT *, {contractions_sql('t')} AS after FROM worn)"
_COUNT = "CAST((length(after) - length(replace(after, '''', ''))) - (length(t) - length(replace(t, '''', ''))) AS BIGINT)"
_POSS = f"""WITH worn AS ({WORN_SQL}), f AS (SELECT chapter_id, unnest(regexp_extract_all(replace(replace(t, ' s ', ' s  '), ' S ', ' S  '), {q(f'(?:^|[^{_B}])([A-Za-z0-9]{{2,}}) [sS](?:$|[^{_B}./,;:' + chr(92) + '-–—])')}, 1)) AS word FROM worn)
SELECT DISTINCT chapter_id, word, word || '''s' AS possessive_reading, word || 's' AS plural_reading FROM f WHERE lower(word) NOT IN ({', '.join(q(w) for w in T.CONTRACTIONS['s'])})"""
_ALL_ISSUES = f"""e AS ({ELLIPSIS_SQL}), c AS ({_CONTR} SELECT chapter_id FROM f WHERE {_COUNT} > 0), w AS ({_ISSUES_SQL}),
issues AS (SELECT chapter_id AS location, 'ellipsis' AS category FROM e WHERE ascii > 0 UNION ALL SELECT chapter_id, 'ellipsis' FROM e WHERE spaced > 0 UNION ALL SELECT chapter_id, 'apostrophe' FROM c UNION ALL SELECT chapter_id, 'white space' FROM w)"""
_REPAIRED = f"""WITH {_SLOTS.replace('slots AS', 'raw AS')}, f AS (SELECT chapter_id, line_no, line AS original, {contractions_sql(ellipses_sql('line'))} AS line FROM raw), slots AS (SELECT * FROM f), {_STEPS},
done AS (SELECT chapter_id, line_no, original AS line, CASE WHEN regexp_matches(line, {q(f'^[{T.WS}]+$')}) THEN ' ' ELSE after END AS after FROM s7) SELECT chapter_id, {_WHOLE} FROM done GROUP BY chapter_id"""

QUERIES = {
    "ellipsis_issues": ellipsis_issues, "ellipsis_fixed": ellipsis_fixed, "contraction_issues": contraction_issues, "contraction_fixed": contraction_fixed, "possessive_candidates": possessive_candidates, "whitespace_issues": whitespace_issues,
    "whitespace_book": whitespace_book, "whitespace_fixed": whitespace_fixed, "missing_space_fixed": missing_space_fixed, "text_repair_pipeline": text_repair_pipeline, "whitespace_totals": whitespace_totals, "ellipsis_totals": ellipsis_totals, "apostrophe_totals": apostrophe_totals, "possessive_snippets": possessive_snippets, "issue_summary": issue_summary, "issue_locations": issue_locations, "top_issue_pages": top_issue_pages,
}
ORACLE = {
    "ellipsis_issues": ELLIPSIS_SQL,
    "ellipsis_fixed": f"WITH worn AS ({WORN_SQL}), f AS (SELECT *, {ellipses_sql('t')} AS after FROM worn) SELECT chapter_id, CAST(length(t) AS BIGINT) AS chars_before, CAST(length(after) AS BIGINT) AS chars_after, md5(after) AS digest FROM f WHERE after <> t",
    "contraction_issues": f"{_CONTR} SELECT chapter_id, href, {_COUNT} AS n FROM f WHERE {_COUNT} > 0",
    "contraction_fixed": f"{_CONTR} SELECT chapter_id, CAST(length(after) AS BIGINT) AS chars_after, md5(after) AS digest FROM f WHERE after <> t",
    "possessive_candidates": _POSS,
    "whitespace_issues": _ISSUES_SQL,
    "whitespace_book": f"SELECT category, count(*) AS slots, count(DISTINCT chapter_id) AS pages FROM ({_ISSUES_SQL}) GROUP BY category",
    "whitespace_totals": f"WITH b AS (SELECT DISTINCT chapter_id, book_id FROM chapters), w AS ({_ISSUES_SQL}) SELECT book_id, count_if(leading_indent) AS leading_indent, count_if(trailing_space) AS trailing_space, count_if(repeated) AS repeated, count_if(tabs) AS tabs, count_if(before_punctuation) AS before_punctuation, count_if(missing) AS missing, count(*) AS slots, count(DISTINCT w.chapter_id) AS pages FROM w JOIN b ON w.chapter_id = b.chapter_id GROUP BY book_id",
    "ellipsis_totals": f"WITH b AS (SELECT DISTINCT chapter_id, book_id FROM chapters), e AS ({ELLIPSIS_SQL}) SELECT book_id, CAST(sum(ascii) AS BIGINT) AS ascii, CAST(sum(spaced) AS BIGINT) AS spaced, CAST(sum(ascii + spaced) AS BIGINT) AS issues, count(DISTINCT e.chapter_id) AS pages FROM e JOIN b ON e.chapter_id = b.chapter_id GROUP BY book_id",
    "apostrophe_totals": f"WITH b AS (SELECT DISTINCT chapter_id, book_id FROM chapters), e AS ({_CONTR} SELECT chapter_id, {_COUNT} AS n FROM f WHERE {_COUNT} > 0), q AS ({_POSS}), c AS (SELECT book_id, sum(n) AS lost, count(DISTINCT e.chapter_id) AS lost_pages FROM e JOIN b ON e.chapter_id = b.chapter_id GROUP BY book_id), p AS (SELECT book_id, count(*) AS possible, count(DISTINCT q.chapter_id) AS possible_pages FROM q JOIN b ON q.chapter_id = b.chapter_id GROUP BY book_id) SELECT coalesce(c.book_id, p.book_id) AS book_id, CAST(coalesce(lost, 0) AS BIGINT) AS lost, coalesce(lost_pages, 0) AS lost_pages, coalesce(possible, 0) AS possible, coalesce(possible_pages, 0) AS possible_pages FROM c FULL JOIN p ON c.book_id = p.book_id",
    "whitespace_fixed": f"WITH {_SLOTS}, {_STEPS} SELECT chapter_id, {_WHOLE} FROM s7 GROUP BY chapter_id",
    "missing_space_fixed": f"WITH worn AS ({WORN_SQL}), f AS (SELECT *, {missing_sql('t')} AS after FROM worn) SELECT chapter_id, CAST(length(after) - length(t) AS BIGINT) AS blanks, md5(after) AS digest FROM f WHERE after <> t",
    "text_repair_pipeline": _REPAIRED,
    "issue_summary": f"WITH {_ALL_ISSUES} SELECT category, count(*) AS issues, count(DISTINCT location) AS locations FROM issues GROUP BY category",
    "issue_locations": f"WITH {_ALL_ISSUES} SELECT location, count(*) AS issues, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM issues GROUP BY location",
    "top_issue_pages": f"WITH {_ALL_ISSUES}, n AS (SELECT category, location, count(*) AS issues FROM issues GROUP BY category, location) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY issues DESC, location) AS rank FROM n) WHERE rank <= 10",
}
