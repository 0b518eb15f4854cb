"""Style sheets: rules, classes declared and used, no-op classes, and rewriting to standard roles.

A sheet's rules are taken out by one pattern and exploded; everything else is grouping and anti-joins.
The tables hold no style sheets; ``SHEETS`` gives each book one of four, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.operators.markup import _CLASSES, _V, once, parsed
from textmend.plans.runtime import table

SHEETS = """CASE book_id % 4
 WHEN 0 THEN '/* base */ p{margin:0} .ad{color:inherit} .unused{line-height:2} .ad{color:inherit}'
 WHEN 1 THEN 'p.x{text-indent:1.2em; page-break-after:always} .title{font-size:1.5em;text-align:center !important} #a1{height:10px}'
 WHEN 2 THEN '.title, h3.big {font-weight:bold} .b{font-style:normal} .b{font-style:italic} @media print {.x{height:100%}'
 ELSE '@font-face{font-family:"Old"; src:url(fonts/old.ttf)} .w{} .calibre1{max-height:90%} .x{margin:0}' END"""
SHEETS_SQL = f"SELECT DISTINCT book_id, {SHEETS} AS css FROM books"

# --- fixed values: declarations that change nothing, and what standard classes look like --------------------------
NO_OP = [
    "color:inherit", "font-size:1em", "font-size:100%", "font-weight:normal", "font-weight:inherit", "font-weight:400", "font-style:normal", "font-style:inherit", "line-height:inherit", "line-height:normal", "font-family:inherit", "text-align:inherit",
    "text-decoration:inherit", "vertical-align:baseline", "vertical-align:inherit",
]
STANDARD = {
    "body-text": "text-align: left; text-indent: 1.2em; margin-top: 0; margin-bottom: 0.6em;",
    "chapter-heading": "text-align: center; font-weight: bold; text-indent: 0; margin-top: 2em; margin-bottom: 1em;",
}
STRIPPED = ["font-family", "color", "background", "background-color", "font-size", "height", "max-height", "min-height", "line-height"]
#: Roles that are standardised, and the class that each gets.
ROLE_CLASSES = {"chapter-heading": "chapter-header", "body-text": "body"}
_RULE = r"([^{}]+)\{([^{}]*)\}"
#: An optional element name and one class.
SIMPLE = r"^([a-zA-Z][a-zA-Z0-9]*)?\.([a-zA-Z_-][\w-]*)\z"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("book_id", F.expr(SHEETS).alias("css")).distinct()


def rules_of(css: DataFrame) -> DataFrame:
    """(book_id, rule_no, selector, body) of the rules of (book_id, css); at-rules themselves are none, rules inside them are."""
    clean = F.regexp_replace("css", r"(?s)/\*.*?\*/", "")
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(_RULE), F.lit(1)).alias("s"), F.regexp_extract_all(clean, F.lit(_RULE), F.lit(2)).alias("b"))
    r = css.select("book_id", F.posexplode(pairs).alias("rule_no", "r")).select("book_id", F.col("rule_no").cast("long").alias("rule_no"), F.trim("r.s").alias("selector"), F.trim("r.b").alias("body"))
    return r.where("selector <> '' AND NOT startswith(selector, '@')")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_of(sheets(spark, sf_dir))


def classes_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\.([a-zA-Z_-][\w-]*)"), F.lit(1))


def declarations(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, ";"), lambda d: F.regexp_replace(F.lower(F.trim(d)), r"\s*:\s*", ":")), lambda d: d != "")


def no_op(body: Column) -> Column:
    """Every declaration changes nothing; an empty rule doesn't either."""
    return F.forall(declarations(body), lambda d: d.isin(NO_OP))


def css_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark, sf_dir)


def css_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each book's sheet. A forced height is a height of its own or a largest one, no line height."""
    r = rules(spark, sf_dir).groupBy("book_id").agg(
        F.count("*").alias("rules"), F.sum(F.regexp_count("body", F.lit("!important"))).cast("long").alias("important"), F.count_if(F.col("body").rlike("page-break|break-before|break-after")).alias("page_breaks"),
        F.count_if(F.col("body").rlike(r"(?:^|[;\s])(?:max-)?height:")).alias("forced_heights"), (F.count("*") - F.countDistinct("selector")).alias("duplicate_selectors"),
    )
    s = sheets(spark, sf_dir).select("book_id", (F.regexp_count("css", F.lit(r"\{")) == F.regexp_count("css", F.lit(r"\}"))).alias("balanced"), F.regexp_count("css", F.lit("@font-face")).cast("long").alias("font_faces"))
    return s.join(r, "book_id", "left").na.fill(0)


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark, sf_dir).select("book_id", F.explode(classes_of(F.col("selector"))).alias("class"), "body", "rule_no")


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(parsed(spark, sf_dir, "classes").select("chapter_id", "book_id", F.flatten(F.transform("elements", lambda e: e["classes"])).alias("c")))
    return rows.select("book_id", F.explode("c").alias("class")).groupBy("book_id", "class").agg(F.count("*").alias("usage"))


def css_unused_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared(spark, sf_dir).select("book_id", "class").distinct().join(used(spark, sf_dir), ["book_id", "class"], "left_anti")


def css_undeclared_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return used(spark, sf_dir).join(declared(spark, sf_dir).select("book_id", "class"), ["book_id", "class"], "left_anti")


def no_op_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of which every rule that names them changes nothing."""
    d = declared(spark, sf_dir).groupBy("book_id", "class").agg(F.bool_and(no_op(F.col("body"))).alias("no_op"), F.min_by("body", "rule_no").alias("body"))
    return d.where("no_op").select("book_id", "class", "body")


def class_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties_of(rules(spark, sf_dir))


def properties_of(found: DataFrame) -> DataFrame:
    """Properties of simple class selectors; of repeated ones the last rule wins."""
    simple = found.select("book_id", "rule_no", F.explode(F.split("selector", ",")).alias("one"), "body").withColumn("class", F.regexp_extract(F.trim("one"), r"^\w*\.([a-zA-Z_-][\w-]*)\z", 1)).where("class <> ''")
    d = simple.select("book_id", "class", "rule_no", F.posexplode(declarations(F.col("body"))).alias("k", "d")).where("d LIKE '%:%'")
    last = d.groupBy("book_id", "class", F.substring_index("d", ":", 1).alias("property")).agg(F.max_by("d", F.struct("rule_no", "k")).alias("d"))
    return last.select("book_id", "class", "property", F.expr("substring(d, length(property) + 2)").alias("value"))


def stripped_style(style: Column, heading: bool = False) -> Column:
    """A style attribute without what the standard classes set."""
    drop = STRIPPED + (["page-break-before", "break-before"] if heading else [])
    kept = F.filter(F.transform(F.split(style, ";"), lambda d: F.trim(d)), lambda d: (d != "") & ~F.lower(F.trim(F.substring_index(d, ":", 1))).isin(drop))
    return F.array_join(F.transform(kept, lambda d: F.concat(d, F.lit(";"))), " ")


def page_break_after(style: Column) -> Column:
    """The style with a break after the block, added once."""
    added = F.concat_ws("; ", F.when(F.trim(style) != "", F.regexp_replace(F.trim(style), r";\s*\z", "")), F.lit("page-break-after: always"), F.lit("break-after: page"))
    return F.when(F.contains(F.lower(style), F.lit("page-break-after")), style).otherwise(added)


def renamed_classes(classes: Column, names: dict[str, str]) -> Column:
    """Classes under their new names, each once, in order."""
    if not names:
        return F.array_distinct(classes)
    by = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_distinct(F.transform(classes, lambda c: F.coalesce(F.element_at(by, c), c)))


def standard_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules after standardising: simple selectors of mapped classes take their role's rule, the others keep theirs."""
    roles = {"x": "body-text", "title": "chapter-heading"}
    names = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    one = rules(spark, sf_dir).select("book_id", "rule_no", "body", F.posexplode(F.split("selector", ",")).alias("k", "s")).withColumn("s", F.trim("s"))
    role = F.element_at(names(roles), F.regexp_extract("s", SIMPLE, 2))
    tag = F.regexp_extract("s", SIMPLE, 1)
    return one.select("book_id", F.coalesce(F.concat(tag, F.lit("."), F.element_at(names(ROLE_CLASSES), role)), F.col("s")).alias("selector"), F.coalesce(F.element_at(names(STANDARD), role), F.col("body")).alias("body")).distinct()


def missing_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font files that a sheet names and its book doesn't hold, by path or file name; remote and embedded ones are exempt."""
    faces = F.regexp_extract_all("css", F.lit(r"(?i)@font-face\s*\{([^}]*)\}"), F.lit(1))
    urls = sheets(spark, sf_dir).select("book_id", F.explode(faces).alias("face")).select("book_id", F.explode(F.regexp_extract_all("face", F.lit(r"(?i)url\(\s*['\"]?([^'\")]+)['\"]?\s*\)"), F.lit(1))).alias("src"))
    path = F.trim(F.substring_index(F.substring_index("src", "#", 1), "?", 1))
    local = urls.distinct().withColumn("path", path).withColumn("file", F.substring_index("path", "/", -1)).where(~F.lower("path").rlike("^(?:https?://|data:)"))
    fonts = table(spark, sf_dir, "manifest").where("media_type LIKE '%font%' AND href IS NOT NULL").select("book_id", F.col("href").alias("path"), F.substring_index("href", "/", -1).alias("file")).distinct()
    return local.join(fonts.select("book_id", "path"), ["book_id", "path"], "left_anti").join(fonts.select("book_id", "file"), ["book_id", "file"], "left_anti").select("book_id", "src")


#: Classes listed of each book, at most.
SAMPLE = 30
IDLE_SHOWN = 8


def css_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each book the first unused classes by name, and the undeclared ones most used; a report, the queries on unused and
    undeclared classes list all."""
    unused = css_unused_classes(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy("class"))).select("book_id", F.lit("unused").alias("kind"), "class", F.lit(0).cast("long").alias("usage"), "rank")
    undeclared = css_undeclared_classes(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("usage"), "class"))).select("book_id", F.lit("undeclared").alias("kind"), "class", "usage", "rank")
    return unused.unionByName(undeclared).where(F.col("rank") <= SAMPLE).withColumn("rank", F.col("rank").cast("long"))


def idle_classes_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of each book that change nothing: the first ones by name and how many more."""
    names = no_op_classes(spark, sf_dir).groupBy("book_id").agg(F.array_sort(F.collect_set("class")).alias("c"))
    more = F.size("c") - IDLE_SHOWN
    return names.select("book_id", F.concat(F.array_join(F.slice("c", 1, IDLE_SHOWN), ", "), F.when(more > 0, F.concat(F.lit(", +"), more, F.lit(" more"))).otherwise("")).alias("line"))


_R = f"""s AS ({SHEETS_SQL}), c AS (SELECT book_id, css, regexp_replace(css, '/[*].*?[*]/', '', 'gs') AS clean FROM s), raw AS (SELECT book_id, CAST(generate_subscripts(regexp_extract_all(clean, '([^{{}}]+)[{{]([^{{}}]*)[}}]', 1), 1) - 1 AS BIGINT) AS rule_no, trim(unnest(regexp_extract_all(clean, '([^{{}}]+)[{{]([^{{}}]*)[}}]', 1))) AS selector, trim(unnest(regexp_extract_all(clean, '([^{{}}]+)[{{]([^{{}}]*)[}}]', 2))) AS body FROM c),
r AS (SELECT * FROM raw WHERE selector <> '' AND NOT starts_with(selector, '@')), d AS (SELECT book_id, rule_no, body, unnest(regexp_extract_all(selector, '[.]([a-zA-Z_-][a-zA-Z0-9_-]*)', 1)) AS class FROM r)"""
_DECL = "list_filter([regexp_replace(lower(trim(x)), '[ ]*:[ ]*', ':') for x in string_split(body, ';')], lambda x: x <> '')"
_NOOP = f"len(list_filter({_DECL}, lambda x: x NOT IN ({', '.join(repr(x) for x in NO_OP)}))) = 0"
_U = f"{_V}, {_CLASSES}, used AS (SELECT book_id, class, count(*) AS usage FROM u GROUP BY book_id, class)"
QUERIES = {
    "css_rules": css_rules, "css_book": css_book, "css_unused_classes": css_unused_classes, "css_undeclared_classes": css_undeclared_classes, "no_op_classes": no_op_classes, "class_properties": class_properties, "standard_sheet": standard_sheet, "missing_fonts": missing_fonts, "css_samples": css_samples, "idle_classes_line": idle_classes_line,
}
ORACLE = {
    "css_rules": f"WITH {_R} SELECT book_id, rule_no, selector, body FROM r",
    "css_book": f"""WITH {_R}, a AS (SELECT book_id, count(*) AS rules, CAST(sum(len(regexp_extract_all(body, '!important'))) AS BIGINT) AS important, count_if(regexp_matches(body, 'page-break|break-before|break-after')) AS page_breaks, count_if(regexp_matches(body, '(?:^|[; ])(?:max-)?height:')) AS forced_heights, count(*) - count(DISTINCT selector) AS duplicate_selectors FROM r GROUP BY book_id)
SELECT s.book_id, length(replace(css, '{{', '')) = length(replace(css, '}}', '')) AS balanced, CAST(len(regexp_extract_all(css, '@font-face')) AS BIGINT) AS font_faces, coalesce(rules, 0) AS rules, coalesce(important, 0) AS important, coalesce(page_breaks, 0) AS page_breaks, coalesce(forced_heights, 0) AS forced_heights, coalesce(duplicate_selectors, 0) AS duplicate_selectors FROM s LEFT JOIN a ON s.book_id = a.book_id""",
    "css_unused_classes": f"WITH {_R}, {_U} SELECT DISTINCT d.book_id, d.class FROM d ANTI JOIN used ON d.book_id = used.book_id AND d.class = used.class",
    "css_undeclared_classes": f"WITH {_R}, {_U} SELECT used.book_id, used.class, used.usage FROM used ANTI JOIN d ON d.book_id = used.book_id AND d.class = used.class",
    "no_op_classes": f"WITH {_R} SELECT book_id, class, arg_min(body, rule_no) AS body FROM d GROUP BY book_id, class HAVING bool_and({_NOOP})",
    "class_properties": f"""WITH {_R}, one AS (SELECT book_id, rule_no, body, regexp_extract(trim(unnest(string_split(selector, ','))), '^[a-zA-Z0-9_]*[.]([a-zA-Z_-][a-zA-Z0-9_-]*)$', 1) AS class FROM r), p AS (SELECT book_id, class, rule_no, generate_subscripts({_DECL}, 1) AS k, unnest({_DECL}) AS d FROM one WHERE class <> ''),
l AS (SELECT book_id, class, split_part(d, ':', 1) AS property, arg_max(d, (rule_no, k)) AS d FROM p WHERE d LIKE '%:%' GROUP BY book_id, class, split_part(d, ':', 1)) SELECT book_id, class, property, substring(d, length(property) + 2) AS value FROM l""",
    "standard_sheet": f"""WITH {_R}, one AS (SELECT book_id, body, trim(unnest(string_split(selector, ','))) AS s FROM r), k AS (SELECT *, regexp_extract(s, '^([a-zA-Z][a-zA-Z0-9]*)?[.]([a-zA-Z_-][a-zA-Z0-9_-]*)$', 1) AS tag, regexp_extract(s, '^([a-zA-Z][a-zA-Z0-9]*)?[.]([a-zA-Z_-][a-zA-Z0-9_-]*)$', 2) AS class FROM one)
SELECT DISTINCT book_id, CASE class WHEN 'x' THEN tag || '.body' WHEN 'title' THEN tag || '.chapter-header' ELSE s END AS selector, CASE class WHEN 'x' THEN '{STANDARD['body-text']}' WHEN 'title' THEN '{STANDARD['chapter-heading']}' ELSE body END AS body FROM k""",
    "missing_fonts": f"WITH s AS ({SHEETS_SQL}) SELECT book_id, 'fonts/old.ttf' AS src FROM s WHERE css LIKE '%url(fonts/old.ttf)%' AND book_id NOT IN (SELECT book_id FROM manifest WHERE media_type LIKE '%font%' AND (href = 'fonts/old.ttf' OR href LIKE '%/old.ttf' OR href = 'old.ttf'))",
    "css_samples": f"""WITH {_R}, {_U}, a AS (SELECT DISTINCT d.book_id, d.class FROM d ANTI JOIN used ON d.book_id = used.book_id AND d.class = used.class), b AS (SELECT used.* FROM used ANTI JOIN d ON d.book_id = used.book_id AND d.class = used.class),
x AS (SELECT book_id, 'unused' AS kind, class, CAST(0 AS BIGINT) AS usage, row_number() OVER (PARTITION BY book_id ORDER BY class) AS rank FROM a UNION ALL SELECT book_id, 'undeclared', class, usage, row_number() OVER (PARTITION BY book_id ORDER BY usage DESC, class) FROM b) SELECT * FROM x WHERE rank <= {SAMPLE}""",
    "idle_classes_line": f"WITH {_R}, n AS (SELECT book_id, class FROM d GROUP BY book_id, class HAVING bool_and({_NOOP})), ls AS (SELECT book_id, list_sort(list(class)) AS c FROM n GROUP BY book_id) SELECT book_id, array_to_string(c[1:{IDLE_SHOWN}], ', ') || CASE WHEN len(c) > {IDLE_SHOWN} THEN ', +' || (len(c) - {IDLE_SHOWN}) || ' more' ELSE '' END AS line FROM ls",
}
