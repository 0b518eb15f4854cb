"""Classes of pages and what they are for: use, declared properties, guessed role, the map for people and the mapping file.

A class's profile joins its use in pages with the properties that simple selectors of the books' sheets declare; the
role is one expression over both. Classes with no declared properties are judged by their elements alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.operators.markup import _CLASSES, _V, once, parsed
from textmend.operators.styles import _DECL, _R, ROLE_CLASSES, class_properties

# --- fixed values: when a font size is large, and what a class map shows -----------------------------------------
LARGE = {"em": 1.15, "rem": 1.15, "%": 115.0, "pt": 14.0, "px": 18.0}
SHOWN = ["font-size", "font-weight", "font-style", "text-align", "text-indent", "margin-top", "margin-bottom"]
MAPPED_CONFIDENCE = ["high", "medium"]


def looks_large(size: Column) -> Column:
    """A font size larger than that of running text; a number without a unit says nothing."""
    n = F.regexp_extract(size, r"^\s*([0-9.]+)\s*(em|rem|%|pt|px)?", 1).try_cast("double")
    u = F.regexp_extract(size, r"^\s*([0-9.]+)\s*(em|rem|%|pt|px)?", 2)
    out = F.lit(False)
    for unit_name, least in LARGE.items():
        out = F.when(u == unit_name, n >= least).otherwise(out)
    return F.coalesce(out, F.lit(False))


def guessed(usage: Column, dominant: Column, top: Column, h: Column, p: Column, s: Column, prop) -> tuple[Column, Column]:
    """(role, confidence) by the first rule that fits. ``prop`` gives a declared property in lower case, empty if there is none."""
    share = lambda n: n / usage
    weight = prop("font-weight")
    bold = F.contains(weight, F.lit("bold")) | F.coalesce(weight.rlike("^[0-9]+$") & (weight.try_cast("int") >= 600), F.lit(False))
    centred = F.contains(prop("text-align"), F.lit("center"))
    large = looks_large(prop("font-size"))
    italic = prop("font-style").rlike("italic|oblique")
    no_indent = prop("text-indent").isin("0", "0px", "0em", "0pt", "0%")
    rules = [
        ((dominant == "body") & (share(top) >= 0.9), "body-wrapper", "low"), (dominant.isin("b", "strong") & (share(top) >= 0.6), "bold-text", "medium"), ((dominant == "a") & (share(top) >= 0.6), "link", "medium"),
        (share(h) >= 0.6, "chapter-heading", "high"), ((share(p) >= 0.5) & centred & (large | bold), "chapter-heading", "medium"), ((share(p) >= 0.6) & ~large & ~bold & ~italic & (usage >= 20), "body-text", "medium"),
        ((share(p) >= 0.6) & ~large & ~bold & ~italic, "body-text", "low"), (italic & (share(p) >= 0.3), "emphasis-text", "low"), (centred & (h == 0) & (usage < 20), "centered-text", "low"), (no_indent & (share(p) >= 0.3), "no-indent-paragraph", "low"),
        (share(s) >= 0.6, "inline-span", "low"),
    ]
    role, confidence = F.lit("unknown"), F.lit("low")
    for test, name, sure in reversed(rules):
        role, confidence = F.when(test, name).otherwise(role), F.when(test, sure).otherwise(confidence)
    return role, confidence


def profiles(uses: DataFrame, properties: DataFrame) -> DataFrame:
    """Profiles of the classes of every book from (book_id, tag, class) and (book_id, class, property, value)."""
    per = uses.groupBy("book_id", "class", "tag").agg(F.count("*").alias("n"))
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    p = per.groupBy("book_id", "class").agg(
        F.sum("n").alias("usage"), F.max_by("tag", F.struct("n", "tag")).alias("dominant"), F.max("n").alias("top"), of(F.col("tag").rlike("^h[1-6]$")).alias("h"), of(F.col("tag") == "p").alias("p"), of(F.col("tag") == "span").alias("s"),
    )
    declared = properties.groupBy("book_id", "class").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("declared"))
    joined = p.join(declared, ["book_id", "class"], "left")
    prop = lambda name: F.coalesce(F.lower(F.element_at("declared", F.lit(name))), F.lit(""))
    role, confidence = guessed(*[F.col(c) for c in ("usage", "dominant", "top", "h", "p", "s")], prop)
    shown = F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), F.element_at("declared", F.lit(k))) for k in SHOWN]))
    return joined.select("book_id", "class", "usage", "dominant", F.round(F.col("top") / F.col("usage") * 100).cast("long").alias("dominant_percent"), F.array_join(shown, "; ").alias("style"), role.alias("role"), confidence.alias("confidence"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(parsed(spark, sf_dir, "tag", "classes").select("chapter_id", "book_id", F.flatten(F.transform("elements", lambda e: F.transform(e["classes"], lambda c: F.struct(e["tag"].alias("tag"), c.alias("class"))))).alias("u")))
    return rows.select("book_id", F.inline("u"))


def class_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of every book with their use, most frequent element and its share, declared style, and the role guessed."""
    return profiles(uses(spark, sf_dir), class_properties(spark, sf_dir))


def map_line(p: DataFrame) -> DataFrame:
    """(book_id, usage, class, line): the class map for people, to be read by falling use."""
    style = F.when(F.col("style") == "", "(no declared style)").otherwise(F.col("style"))
    line = F.concat(F.lit("."), "class", F.lit(": used "), "usage", F.lit("x, mostly <"), "dominant", F.lit("> "), "dominant_percent", F.lit("%; guess: "), "role", F.lit(" ("), "confidence", F.lit("); style: "), style)
    return p.select("book_id", "usage", "class", line.alias("line"))


def class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_line(class_profiles(spark, sf_dir)).select("book_id", "class", "line")


def mapped(p: DataFrame) -> DataFrame:
    """The classes sure enough to be standardised, with the class of their role."""
    names = F.create_map(*[F.lit(x) for kv in ROLE_CLASSES.items() for x in kv])
    return p.where(F.col("role").isin(*ROLE_CLASSES) & F.col("confidence").isin(MAPPED_CONFIDENCE)).select("book_id", "usage", F.col("class").alias("old_name"), "role", F.element_at(names, F.col("role")).alias("new_name"))


def class_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(class_profiles(spark, sf_dir)).drop("usage")


def mapping_file(p: DataFrame) -> str:
    """The mapping of one book's classes as an editable TOML text; what is left out stands in comments, by falling use."""
    rows = p.orderBy(F.desc("usage"), "class").collect()
    lines = ["# Class mapping: check every entry, take out what should stay as it is.", ""]
    left = []
    for r in rows:
        note = f"{r['confidence']}, used {r['usage']}x, mostly <{r['dominant']}> {r['dominant_percent']}%"
        if r["role"] in ROLE_CLASSES and r["confidence"] in MAPPED_CONFIDENCE:
            lines += ["[[class]]", f'old_name = "{r["class"]}"', f'role = "{r["role"]}"  # {note}', f'new_name = "{ROLE_CLASSES[r["role"]]}"', ""]
        else:
            left.append(f"# {r['class']}: {r['role']} ({note})")
    return "\n".join([*lines, *(["# left out:", *left] if left else []), ""])


_PROPS = f"""one AS (SELECT book_id, rule_no, body, regexp_extract(trim(unnest(string_split(selector, ','))), '^[a-zA-Z0-9_]*[.]([a-zA-Z_-][a-zA-Z0-9_-]*)$', 1) AS class FROM r), pr AS (SELECT book_id, class, rule_no, generate_subscripts({_DECL}, 1) AS k, unnest({_DECL}) AS d FROM one WHERE class <> ''),
l AS (SELECT book_id, class, split_part(d, ':', 1) AS property, arg_max(d, (rule_no, k)) AS d FROM pr WHERE d LIKE '%:%' GROUP BY book_id, class, split_part(d, ':', 1)), props AS (SELECT book_id, class, map_from_entries(list((property, substring(d, length(property) + 2)))) AS m FROM l GROUP BY book_id, class)"""


def _v(name: str) -> str:
    return f"coalesce(m['{name}'], '')"


_STYLE = "concat_ws('; ', " + ", ".join(f"'{k}:' || m['{k}']" for k in SHOWN) + ")"
_PROFILES = f"""{_R}, {_V}, {_CLASSES}, {_PROPS}, per AS (SELECT book_id, class, tag, count(*) AS n FROM u GROUP BY book_id, class, tag), a AS (SELECT book_id, class, CAST(sum(n) AS BIGINT) AS usage, arg_max(tag, (n, tag)) AS dominant, max(n) AS top, sum(CASE WHEN tag LIKE 'h_' THEN n ELSE 0 END) AS h, sum(CASE WHEN tag = 'p' THEN n ELSE 0 END) AS p, sum(CASE WHEN tag = 'span' THEN n ELSE 0 END) AS s FROM per GROUP BY book_id, class),
b AS (SELECT a.*, props.m, {_v('text-align')} = 'center' OR {_v('text-align')} LIKE 'center %' AS centred, {_v('font-weight')} = 'bold' AS bold, {_v('font-style')} = 'italic' AS italic, {_v('font-size')} = '1.5em' AS large, {_v('text-indent')} = '0' AS flat FROM a LEFT JOIN props ON a.book_id = props.book_id AND a.class = props.class),
ro AS (SELECT *, CASE WHEN dominant = 'body' AND top >= 0.9 * usage THEN 'body-wrapper/low' WHEN dominant IN ('b', 'strong') AND top >= 0.6 * usage THEN 'bold-text/medium' WHEN dominant = 'a' AND top >= 0.6 * usage THEN 'link/medium' WHEN h >= 0.6 * usage THEN 'chapter-heading/high' WHEN p >= 0.5 * usage AND centred AND (large OR bold) THEN 'chapter-heading/medium'
 WHEN p >= 0.6 * usage AND NOT (large OR bold OR italic) THEN CASE WHEN usage >= 20 THEN 'body-text/medium' ELSE 'body-text/low' END WHEN italic AND p >= 0.3 * usage THEN 'emphasis-text/low' WHEN centred AND h = 0 AND usage < 20 THEN 'centered-text/low' WHEN flat AND p >= 0.3 * usage THEN 'no-indent-paragraph/low' WHEN s >= 0.6 * usage THEN 'inline-span/low' ELSE 'unknown/low' END AS role_pair FROM b),
prof AS (SELECT book_id, class, usage, dominant, CAST(round(top / usage * 100) AS BIGINT) AS dominant_percent, {_STYLE} AS style, split_part(role_pair, '/', 1) AS role, split_part(role_pair, '/', 2) AS confidence FROM ro)"""
QUERIES = {"class_profiles": class_profiles, "class_map": class_map, "class_mapping": class_mapping}
ORACLE = {
    "class_profiles": f"WITH {_PROFILES} SELECT * FROM prof",
    "class_map": f"WITH {_PROFILES} SELECT book_id, class, '.' || class || ': used ' || usage || 'x, mostly <' || dominant || '> ' || dominant_percent || '%; guess: ' || role || ' (' || confidence || '); style: ' || CASE style WHEN '' THEN '(no declared style)' ELSE style END AS line FROM prof",
    "class_mapping": f"WITH {_PROFILES} SELECT book_id, class AS old_name, role, CASE role WHEN 'body-text' THEN 'body' ELSE 'chapter-header' END AS new_name FROM prof WHERE role IN ('body-text', 'chapter-heading') AND confidence IN ('high', 'medium')",
}
