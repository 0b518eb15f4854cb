"""Paragraphs of pages: empty ones, converter junk, and sentences split over two paragraphs.

A paragraph is a line of a page. Pairs are tested after empty and junk paragraphs are dropped; a chain of split
paragraphs is one island. As the walk goes backwards, the second half of a pair is the already merged rest,
which keeps its first character and can only gain words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators.views import WORN_SQL, worn_pages

# --- fixed values: what converters leave behind ------------------------------------------------------------
JUNK = r"(?i)generated by abc amber lit converter|processtext\.com|^\s*page\s*[:.-]?\s*\d+\s*$"
JUNK_LINKS = r"(?i)https?://(?:www\.)?abbyy\.com(?:/|$)"
LEAST_WORDS = 4
_END = "[.!?\"')”’]"


def is_junk(c: Column) -> Column:
    return c.rlike(JUNK)


def mid_sentence(first: Column, second: Column) -> Column:
    """The second paragraph goes on with the sentence of the first."""
    # the cheap tests come first
    return second.rlike(r"^\p{Ll}") & ~F.right(first, F.lit(1)).rlike(_END) & (T.words(first) >= LEAST_WORDS) & (T.words(second) >= LEAST_WORDS)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(T.BLANKS))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter_id, book_id, p): each page with its paragraphs (line_no, text, words), in order; repeated rows repeat it."""
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.cast("long").alias("line_no"), trimmed(x).alias("text")))
    return worn_pages(spark, sf_dir).select("chapter_id", "book_id", lines.alias("p"))


def meaningful(p: Column) -> Column:
    return F.filter(p, lambda x: (x["text"] != "") & ~is_junk(x["text"]))


def once(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["chapter_id"])


def size(a: Column) -> Column:
    return F.size(a).cast("long")


def empty_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(paragraphs(spark, sf_dir).select("chapter_id", size(F.filter("p", lambda x: x["text"] == "")).alias("empty")).where("empty > 0"))


def junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(F.filter("p", lambda x: is_junk(x["text"])), lambda x: F.struct(x["line_no"].alias("line_no"), T.preview(x["text"]).alias("preview")))
    return once(paragraphs(spark, sf_dir).select("chapter_id", found.alias("found")).where("size(found) > 0")).select("chapter_id", F.inline("found"))


def splits(kept: Column) -> Column:
    """For each paragraph but the last whether the next one goes on with its sentence. The second half of a pair may itself be
    merged with what follows; it then has enough words as it stands, so the test of the two alone is the same."""
    return F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: mid_sentence(a["text"], b["text"]))


def _paired(body) -> Column:
    """``body`` (kept paragraphs, splits) of a page; both are computed once."""
    return T.let(meaningful(F.col("p")), lambda kept: T.let(splits(kept), lambda split: body(kept, split)))


def paragraph_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring paragraphs that are one."""
    numbered = lambda kept, split: F.filter(F.transform(split, lambda x, i: F.struct(x.alias("split"), F.get(kept, i)["line_no"].alias("line_no"), F.get(kept, i + 1)["line_no"].alias("next_line"))), lambda x: x["split"])
    return once(paragraphs(spark, sf_dir).select("chapter_id", _paired(numbered).alias("found")).where("size(found) > 0")).select("chapter_id", F.inline("found")).drop("split")


def joined(kept: Column, split: Column) -> Column:
    """Paragraphs after merging (line_no, merged, text): a chain of splits is one paragraph, from where none comes before to
    where none follows."""
    split_at = lambda i: F.coalesce(F.get(split, i), F.lit(False))
    first = F.filter(F.transform(kept, lambda x, i: F.when((i > 0) & split_at(i - 1), -1).otherwise(i)), lambda i: i >= 0)
    last = F.filter(F.transform(kept, lambda x, i: F.when(split_at(i), -1).otherwise(i)), lambda i: i >= 0)
    text = lambda a, z: F.array_join(F.transform(F.slice(kept, a + 1, z - a + 1), lambda x: x["text"]), " ")
    return F.zip_with(first, last, lambda a, z: F.struct(F.get(kept, a)["line_no"].alias("line_no"), (z - a + 1).cast("long").alias("merged"), text(a, z).alias("text")))


def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs after merging: first line, how many lines it takes, and the text's digest."""
    reduced = lambda kept, split: F.transform(joined(kept, split), lambda m: F.struct(m["line_no"].alias("line_no"), m["merged"].alias("merged"), F.md5(m["text"]).alias("digest")))
    return once(paragraphs(spark, sf_dir).select("chapter_id", _paired(reduced).alias("m")).where("size(m) > 0")).select("chapter_id", F.inline("m"))


def paragraph_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each book."""
    counts = lambda kept, split: F.struct(size(kept).alias("meaningful"), size(F.filter(split, lambda x: x)).alias("splits"))
    p = once(paragraphs(spark, sf_dir).select(
        "chapter_id", "book_id", size(F.filter("p", lambda x: x["text"] == "")).alias("empty"), size(F.filter("p", lambda x: is_junk(x["text"]))).alias("junk"), _paired(counts).alias("k")
    )).select("book_id", "empty", "junk", "k.*")
    return p.groupBy("book_id").agg(*[F.sum(c).alias(c) for c in ("empty", "junk", "meaningful", "splits")], F.count_if(F.col("splits") > 0).alias("pages_with_splits"))


_TRIM = f"regexp_replace(regexp_replace(line, '^[{T.WS}]+', ''), '[{T.WS}]+$', '')"


def _w(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{T.WS}]+'))"


_JUNK = JUNK.replace("\\s", "[\\t\\n\\f\\r ]")
_P = f"""worn AS ({WORN_SQL}), raw AS (SELECT chapter_id, book_id, CAST(generate_subscripts(string_split(t, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(t, chr(10))) AS line FROM worn), paras AS (SELECT DISTINCT chapter_id, book_id, line_no, {_TRIM} AS text FROM raw),
m AS (SELECT * FROM paras WHERE text <> '' AND NOT regexp_matches(text, '{_JUNK}')), n AS (SELECT *, lead(text) OVER (PARTITION BY chapter_id ORDER BY line_no) AS next_text, lead(line_no) OVER (PARTITION BY chapter_id ORDER BY line_no) AS next_line FROM m),
pairs AS (SELECT *, coalesce({_w('text')} >= 4 AND {_w('next_text')} >= 4 AND NOT regexp_matches(text, '[.!?"'')”’]$') AND regexp_matches(next_text, '^\\p{{Ll}}'), false) AS split FROM n)"""

QUERIES = {"empty_paragraphs": empty_paragraphs, "junk_lines": junk_lines, "paragraph_splits": paragraph_splits, "paragraph_merge": paragraph_merge, "paragraph_book": paragraph_book}
ORACLE = {
    "empty_paragraphs": f"WITH {_P} SELECT chapter_id, count(*) AS empty FROM paras WHERE text = '' GROUP BY chapter_id",
    "junk_lines": f"WITH {_P} SELECT chapter_id, line_no, CASE WHEN length(text) > 60 THEN regexp_replace(substring(text, 1, 60), '[{T.WS}]+$', '') || '...' ELSE text END AS preview FROM paras WHERE regexp_matches(text, '{_JUNK}')",
    "paragraph_splits": f"WITH {_P} SELECT chapter_id, line_no, next_line FROM pairs WHERE split",
    # a merged second half has at least the words of its first line: chains are islands, but a pair whose second line alone
    # is too short joins if that line is itself joined to what follows
    "paragraph_merge": f"""WITH RECURSIVE {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY line_no DESC) AS r FROM m), f AS (SELECT chapter_id, r, line_no AS first_line, line_no, text, text AS acc, CAST(1 AS BIGINT) AS n, true AS is_top FROM k WHERE r = 1
 UNION ALL SELECT k.chapter_id, k.r, k.line_no, k.line_no, k.text, CASE WHEN {_w('k.text')} >= 4 AND {_w('f.acc')} >= 4 AND NOT regexp_matches(k.text, '[.!?"'')”’]$') AND regexp_matches(f.acc, '^\\p{{Ll}}') THEN k.text || ' ' || f.acc ELSE k.text END,
 CASE WHEN {_w('k.text')} >= 4 AND {_w('f.acc')} >= 4 AND NOT regexp_matches(k.text, '[.!?"'')”’]$') AND regexp_matches(f.acc, '^\\p{{Ll}}') THEN f.n + 1 ELSE 1 END, true FROM f JOIN k ON k.chapter_id = f.chapter_id AND k.r = f.r + 1),
 g AS (SELECT *, lead(n) OVER (PARTITION BY chapter_id ORDER BY r) AS later FROM f) SELECT chapter_id, line_no, n AS merged, md5(acc) AS digest FROM g WHERE later IS NULL OR later = 1""",
    "paragraph_book": f"""WITH {_P}, a AS (SELECT book_id, count_if(text = '') AS empty, count_if(regexp_matches(text, '{_JUNK}')) AS junk, count_if(text <> '' AND NOT regexp_matches(text, '{_JUNK}')) AS meaningful FROM paras GROUP BY book_id),
b AS (SELECT book_id, count_if(split) AS splits, count(DISTINCT CASE WHEN split THEN chapter_id END) AS pages_with_splits FROM pairs GROUP BY book_id) SELECT a.*, coalesce(splits, 0) AS splits, coalesce(pages_with_splits, 0) AS pages_with_splits FROM a LEFT JOIN b USING (book_id)""",
}
