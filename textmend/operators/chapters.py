"""Chapter markers of books: candidates, repeated headers folded, parts, and the best numbered run.

Candidates are short lines of pages; a page's first line counts as a heading, one that opens with a label
word as hinted. Everything but the search of the best run is a declarative plan; the search is a grouped
function over the few numbers of a candidate, one group for each book and style.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.functions import markers as M
from textmend.operators.views import pages
from textmend.plans.arrow import map_batches


#: A cheap look at the first characters spares most lines the classification.
LIKELY = rf"(?i)^(?:[-–—]?\s*\d|[ivxlcdm]+\z|(?:{'|'.join(M.CHAPTER_LABELS + M.PART_LABELS)})\b|(?:{'|'.join(M.VALUES)})\b)"


def likely(text: Column) -> Column:
    """A text short enough for a marker that begins like one."""
    return (text != "") & (F.length(text) <= M.MOST_CHARS) & text.rlike(LIKELY) & (F.regexp_count(text, F.lit(r"\S+")) <= M.MOST_WORDS)


def marked(texts: DataFrame, compat: bool = False) -> DataFrame:
    """Marker candidates among short texts with ``text``, ``heading`` and ``hint``: their other columns, the marker's and a score."""
    found = texts.withColumn("marker", M.classify(F.col("text"), compat)).where("marker IS NOT NULL")
    return found.withColumn("score", M.score(F.col("marker"), F.col("text"), F.col("heading"), F.col("hint"))).select(*[c for c in texts.columns if c not in ("heading", "hint")], "marker.*", "score")


def candidates(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    """(book_id, page_no, chapter_id, href, line_no, text, style, number, label, kind, score) of all marker candidates."""
    numbered = F.transform(F.split("document", "\n"), lambda x, i: F.struct(i.alias("line_no"), M.trim(x).alias("text")))
    rows = pages(spark, sf_dir).select("book_id", "page_no", "chapter_id", "href", F.filter(numbered, lambda x: likely(x["text"])).alias("found")).where("size(found) > 0").dropDuplicates(["chapter_id"])
    first = F.col("line_no") == 0
    label = F.lower(F.regexp_extract("text", r"^[:.]*([^\s:.]+)", 1)).isin(M.CHAPTER_LABELS + M.PART_LABELS)
    return marked(rows.select("book_id", "page_no", "chapter_id", "href", F.inline("found")).withColumn("heading", first).withColumn("hint", first & label), compat)


def marker_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style, number, label and score of every candidate."""
    return candidates(spark, sf_dir).select("chapter_id", F.col("line_no").cast("long").alias("line_no"), "text", "style", F.col("number").cast("long").alias("number"), "label", "kind", "score")


def ordered(found: DataFrame) -> DataFrame:
    """Candidates in reading order: pages without a number come last."""
    return found.withColumn("place", F.struct(F.coalesce("page_no", F.lit(2**31 - 1)).alias("p"), F.col("chapter_id").alias("c"), F.col("line_no").alias("l")))


def merged(found: DataFrame) -> DataFrame:
    """Runs of equal markers of one style folded into their first one, with their number and the other pages."""
    same = F.lower(F.regexp_replace("text", r"\s+", " "))
    by_style = Window.partitionBy("book_id", "style").orderBy("place")
    new = ordered(found).withColumn("key", F.struct(same.alias("t"), "number")).withColumn("new", (~F.lag("key").over(by_style).eqNullSafe(F.col("key"))).cast("long"))
    runs = new.withColumn("run", F.sum("new").over(by_style))
    out = runs.groupBy("book_id", "style", "run").agg(F.min(F.struct("place", "text", "number", "label", "kind", "score", "href")).alias("first"), F.count("*").alias("occurrences"), F.collect_set("href").alias("hrefs"))
    return out.select("book_id", "style", "first.*", "occurrences", (F.size(F.array_remove("hrefs", F.col("first.href")))).cast("long").alias("other_pages"))


def marker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(candidates(spark, sf_dir)).select("book_id", "style", F.col("place.c").alias("chapter_id"), F.col("place.l").cast("long").alias("line_no"), F.col("number").cast("long").alias("number"), "occurrences", "other_pages")


def with_parts(found: DataFrame) -> DataFrame:
    """Chapter candidates with the number of part markers before them: markers and candidates on one line, summed up."""
    frame = Window.partitionBy("book_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stamped = merged(found).withColumn("part", F.sum((F.col("kind") == "part").cast("long")).over(frame))
    return stamped.withColumn("part", F.coalesce("part", F.lit(0))).where("kind IS NULL OR kind <> 'part'")


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(candidates(spark, sf_dir)).select("book_id", F.col("place.c").alias("chapter_id"), F.col("place.l").cast("long").alias("line_no"), "part")


def sequences(found: DataFrame) -> DataFrame:
    """(book_id, style, score, length, members, rank): the best run of each style of a book, at least three long, ranked by
    score; of equal ones the style seen first. A member is (page place, page, line)."""
    key = dict(found.dtypes)
    rows = with_parts(found).select("book_id", "style", F.struct(F.col("place.p").cast("long").alias("p"), F.col("place.c").alias("c"), F.col("place.l").alias("l"), "number", "score", "part").alias("r"))
    groups = rows.groupBy("book_id", "style").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    schema = f"book_id {key['book_id']}, style string, score double, length long, first_p long, first_l long, members array<struct<p:long,c:{key['chapter_id']},l:int>>"

    def run(cols: dict[str, list]) -> dict[str, list]:
        best = [M.best_run([(i, r["number"], r["score"], r["part"]) for i, r in enumerate(g)]) for g in cols["rows"]]
        return {
            "book_id": cols["book_id"], "style": cols["style"], "score": [b[0] for b in best], "length": [b[1] for b in best], "first_p": [g[0]["p"] for g in cols["rows"]], "first_l": [g[0]["l"] for g in cols["rows"]],
            "members": [[{k: g[i][k] for k in "pcl"} for i in b[2]] for g, b in zip(cols["rows"], best, strict=True)],
        }

    best = map_batches(groups, schema, run).where(f"length >= {M.LEAST_RUN}")
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "first_p", "first_l"))
    return best.withColumn("rank", rank.cast("long"))


def chapter_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning and the other runs of each book."""
    pages_of = F.transform("members", lambda m: m["c"])
    return sequences(candidates(spark, sf_dir)).select("book_id", "style", "score", "length", "rank", F.array_min(pages_of).alias("first_chapter"), F.array_max(pages_of).alias("last_chapter"))


def sequence_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the winning run leads; null without a runner-up."""
    lead = F.col("score") - F.lead("score").over(Window.partitionBy("book_id").orderBy("rank"))
    return sequences(candidates(spark, sf_dir)).withColumn("margin", lead).where("rank = 1").select("book_id", "style", "length", "score", "margin")


# --- the same in SQL ----------------------------------------------------------------------------------------


def _numbers_sql() -> str:
    rows = []
    for w, v in M.VALUES.items():
        rows.append((w, v, w in M.ORDINALS))
    for t in M.TENS:
        for o in M.ONES[:9]:
            rows.append((f"{t} {o}", M.VALUES[t] + M.VALUES[o], False))
        for o in M.ORDINAL_ONES[:9]:
            rows.append((f"{t} {o}", M.VALUES[t] + M.VALUES[o], True))
    return ", ".join(f"('{w}', {v}, {str(o).lower()})" for w, v, o in rows)


def _roman_list(one: str, five: str, ten: str) -> str:
    return "['', " + ", ".join(f"'{x}'" for x in (one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)) + "]"


_LABELS = "|".join(M.CHAPTER_LABELS + M.PART_LABELS)
_STYLE = "'" + "', '".join(M.STYLES.values()) + "'"
_MINOR = "|".join(M.MINOR)
CANDIDATES_SQL = rf"""romans AS (SELECT n, ['', 'M', 'MM', 'MMM'][n // 1000 + 1] || {_roman_list('C', 'D', 'M')}[n // 100 % 10 + 1] || {_roman_list('X', 'L', 'C')}[n // 10 % 10 + 1] || {_roman_list('I', 'V', 'X')}[n % 10 + 1] AS r FROM (SELECT unnest(range(1, 4000)) AS n)),
spelled(w, v, ordinal) AS (VALUES {_numbers_sql()}),
raw AS (SELECT DISTINCT chapter_id, book_id, page_no, href, document FROM chapters WHERE document IS NOT NULL),
all_lines AS (SELECT * EXCLUDE (document), generate_subscripts(string_split(document, chr(10)), 1) - 1 AS line_no, unnest(string_split(document, chr(10))) AS line FROM raw),
short AS (SELECT * EXCLUDE (line), regexp_replace(regexp_replace(line, '^[\t-\r ]+', ''), '[\t-\r ]+$', '') AS text FROM all_lines),
likely AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(text, '^[^\t-\r ]+'), '^[:.]+', ''), '[:.]+$', '')) AS head FROM short
 WHERE text <> '' AND length(text) <= {M.MOST_CHARS} AND len(regexp_extract_all(text, '[^\t-\r ]+')) <= {M.MOST_WORDS}),
cored AS (SELECT *, regexp_matches(head, '^(?:{_LABELS})$') AS labelled, trim(regexp_replace(regexp_replace(text, '^[^\t-\r ]+', ''), '^[\t-\r :.–—-]+', '')) AS rest FROM likely),
cut AS (SELECT *, CASE WHEN labelled THEN trim(regexp_replace(regexp_replace(rest, '[:.–—].*$', ''), '(^|[^A-Za-z])-.*$|-($|[^A-Za-z].*$)', '\1')) ELSE text END AS core FROM cored),
num AS (SELECT c.*, CASE WHEN regexp_matches(core, '^[-–—][\t-\r ]*[0-9]{{1,4}}[\t-\r ]*[-–—]$') THEN '{M.STYLES['hyphen']}' WHEN regexp_matches(core, '^[0-9]{{1,4}}$') THEN '{M.STYLES['arabic']}' WHEN r.n IS NOT NULL THEN '{M.STYLES['roman']}' WHEN s.v IS NOT NULL THEN CASE WHEN s.ordinal THEN '{M.STYLES['ordinal']}' ELSE '{M.STYLES['cardinal']}' END END AS style,
 CASE WHEN regexp_matches(core, '^[-–—]?[\t-\r ]*[0-9]{{1,4}}[\t-\r ]*[-–—]?$') AND (regexp_matches(core, '^[0-9]{{1,4}}$') OR regexp_matches(core, '^[-–—].*[-–—]$')) THEN CAST(regexp_extract(core, '[0-9]+') AS INT) WHEN r.n IS NOT NULL THEN r.n ELSE s.v END AS number
 FROM cut c LEFT JOIN romans r ON upper(c.core) = r.r LEFT JOIN spelled s ON s.w = regexp_replace(replace(lower(c.core), '-', ' '), '[\t-\r ]+', ' ', 'g')),
lead AS (SELECT chapter_id, line_no, max_by(v, length(w)) AS v, max_by(ordinal, length(w)) AS ordinal FROM num JOIN spelled ON starts_with(replace(lower(text), '-', ' ') || ' ', w || ' ') WHERE NOT labelled AND style IS NULL GROUP BY chapter_id, line_no),
titled AS (SELECT n.* EXCLUDE (style, number), coalesce(n.style, CASE WHEN ok AND l.v IS NOT NULL THEN CASE WHEN l.ordinal THEN '{M.STYLES['ordinal']}' ELSE '{M.STYLES['cardinal']}' END END) AS style, coalesce(n.number, CASE WHEN ok THEN l.v END) AS number
 FROM (SELECT *, trim(regexp_replace(text, '[^A-Za-z\t-\r ]', '', 'g')) AS letters, (letters <> '' AND (letters = upper(letters) OR (regexp_matches(letters, '^[A-Z]') AND len(list_filter(regexp_extract_all(letters, '[^\t-\r ]+')[2:], lambda x: NOT regexp_matches(x, '^[A-Z]') AND NOT regexp_matches(x, '(?i)^(?:{_MINOR})$'))) = 0))) AS ok FROM num) n LEFT JOIN lead l USING (chapter_id, line_no)),
cand AS (SELECT book_id, page_no, chapter_id, href, CAST(line_no AS BIGINT) AS line_no, text, style, CAST(number AS BIGINT) AS number, labelled AS label, CASE WHEN NOT labelled THEN NULL WHEN head IN ('book', 'part', 'volume') THEN 'part' ELSE 'chapter' END AS kind,
 CAST(CASE WHEN line_no = 0 THEN 3.0 ELSE 0 END + CASE WHEN labelled THEN 2.5 ELSE 0 END + CASE WHEN labelled AND line_no = 0 THEN 1.5 ELSE 0 END + CASE WHEN style IN ('{M.STYLES['roman']}', '{M.STYLES['hyphen']}') THEN 1.5 WHEN style = '{M.STYLES['arabic']}' THEN -0.5 ELSE 1.0 END + CASE WHEN len(regexp_extract_all(text, '[^\t-\r ]+')) <= 3 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
 FROM titled WHERE style IS NOT NULL AND (NOT labelled OR core <> ''))"""
_RUNS = f"""{CANDIDATES_SQL}, keyed AS (SELECT *, coalesce(page_no, 2147483647) AS p, lower(regexp_replace(text, '[\\t-\\r ]+', ' ', 'g')) AS k FROM cand),
changes AS (SELECT *, CASE WHEN lag(k) OVER w IS NOT DISTINCT FROM k AND lag(number) OVER w IS NOT DISTINCT FROM number THEN 0 ELSE 1 END AS fresh FROM keyed WINDOW w AS (PARTITION BY book_id, style ORDER BY p, chapter_id, line_no)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY book_id, style ORDER BY p, chapter_id, line_no) AS run FROM changes),
merged AS (SELECT book_id, style, run, arg_min(chapter_id, (p, chapter_id, line_no)) AS chapter_id, arg_min(line_no, (p, chapter_id, line_no)) AS line_no, min(p) AS p, any_value(number) AS number, arg_min(kind, (p, chapter_id, line_no)) AS kind0, count(*) AS occurrences, count(DISTINCT href) - 1 AS other_pages, bool_or(kind = 'part') AS is_part FROM runs GROUP BY book_id, style, run)"""

QUERIES = {"marker_classify": marker_classify, "marker_merge": marker_merge, "part_index": part_index, "chapter_sequence": chapter_sequence, "sequence_margin": sequence_margin}
ORACLE = {
    "marker_classify": f"WITH {CANDIDATES_SQL} SELECT chapter_id, line_no, text, style, number, label, kind, score FROM cand",
    "marker_merge": f"WITH {_RUNS} SELECT book_id, style, chapter_id, line_no, number, occurrences, other_pages FROM merged",
    "part_index": f"WITH {_RUNS} SELECT book_id, chapter_id, line_no, CAST(part AS BIGINT) AS part FROM (SELECT *, coalesce(sum(CASE WHEN is_part THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY p, chapter_id, line_no), 0) AS part FROM merged) WHERE NOT coalesce(is_part, false)",
}
