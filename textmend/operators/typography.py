"""Typography: measures of each page and totals of each book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.operators.views import WORN_SQL, worn_pages

SUMMED = [
    "words", "straight_double_quotes", "curly_double_quotes", "straight_apostrophes", "curly_apostrophes", "double_hyphens", "hyphens", "en_dashes", "em_dashes", "spaced_em_dashes", "double_space_after_sentence",
    "single_space_after_sentence", "nbsp", "unicode_ellipses", "ascii_ellipses", "zero_width_spaces", "soft_hyphens", "control_chars", "garbled", "all_caps_runs", "repeated_punctuation", "sentences", "sentence_words",
]


def typography_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of every page. The text is reduced to numbers before repeated rows are dropped."""
    measured = worn_pages(spark, sf_dir).select("chapter_id", "book_id", "href", T.typography(F.col("t")).alias("m")).select("chapter_id", "book_id", "href", "m.*")
    return measured.dropDuplicates(["chapter_id"])


def typography_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every book, its pages by quote style, and whether the style drifts: some page with only straight
    and some with only curly quotes."""
    p = typography_page(spark, sf_dir)
    only = lambda s: F.col("quote_style") == s
    return p.groupBy("book_id").agg(
        F.count("*").alias("pages"),
        *[F.sum(n).alias(n) for n in SUMMED],
        F.max("longest_sentence").alias("longest_sentence"),
        *[F.sum(only(s).cast("long")).alias(f"{s}_pages") for s in ("straight", "curly", "mixed", "none")],
        (F.bool_or(only("straight")) & F.bool_or(only("curly"))).alias("style_drifts"),
    )


#: Snippets of each kind that a page shows, and the signs around each.
SAMPLES, PAD = 5, 20
SAMPLED = {"repeated_punctuation": r"!{2,}|\?{2,}|\.{4,}", "double_hyphens": "--+"}


def typography_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first places of each page where punctuation is repeated or hyphens stand for a dash, with what stands around them
    on their line; a report, the counts are in typography_page."""
    def around(pattern: str) -> Column:
        return F.slice(F.regexp_extract_all("t", F.lit(rf"(?:[^\n]{{0,{PAD}}}?(?<![!?.-]))?(?:{pattern})[^\n]{{0,{PAD}}}"), F.lit(0)), 1, SAMPLES)

    rows = worn_pages(spark, sf_dir).select("chapter_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), around(p).alias("found")) for k, p in SAMPLED.items()])).alias("s"))
    return rows.select("chapter_id", "s.kind", F.size("s.found").cast("long").alias("samples"), F.array_join(F.transform("s.found", lambda x: F.trim(F.regexp_replace(x, rf"[{T.WS}]+", " "))), " | ").alias("text")).where("samples > 0").dropDuplicates(["chapter_id", "kind"])


def quote_style_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each book whose quotes are purely of one style, where the book has both."""
    p = typography_page(spark, sf_dir).where(F.col("quote_style").isin("straight", "curly"))
    both = p.groupBy("book_id").agg(F.countDistinct("quote_style").alias("styles")).where("styles = 2").select("book_id")
    return p.join(both, "book_id", "left_semi").select("book_id", "href", "quote_style").distinct()


_WS = T.WS


def _n(what: str) -> str:
    return f"CAST((length(t) - length(replace(t, '{what}', ''))) // {len(what)} AS BIGINT)"


def _m(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(t, '{pattern}')) AS BIGINT)"


def _runs(pattern: str, n: int) -> str:
    return f"CAST(len(list_filter(regexp_extract_all(t, '{pattern}'), lambda x: length(x) = {n})) AS BIGINT)"


def _style(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN 'mixed' WHEN {b} > 0 THEN 'curly' WHEN {a} > 0 THEN 'straight' ELSE 'none' END"


_SQ, _CQ, _SA, _CA = _n('"'), f"({_n('“')} + {_n('”')})", _n("''").replace("// 2", "// 1"), f"({_n('‘')} + {_n('’')})"
_LENGTHS = f"list_filter([len(regexp_extract_all(x, '[^{_WS}]+')) for x in string_split(regexp_replace(t, '([.!?])[{_WS}]+([A-Z\"“])', '\\1\ue000\\2', 'g'), '\ue000')], lambda n: n > 0)"
_GARBLED = " + ".join(_n(g) for g in T.GARBLED)
PAGE_SQL = f"""WITH worn AS ({WORN_SQL})
SELECT chapter_id, book_id, href, {_m(f'[^{_WS}]+')} AS words, {_SQ} AS straight_double_quotes, {_CQ} AS curly_double_quotes, {_style(_SQ, _CQ)} AS quote_style,
 {_SA} AS straight_apostrophes, {_CA} AS curly_apostrophes, {_style(_SA, _CA)} AS apostrophe_style, {_runs('-+', 2)} AS double_hyphens, {_runs('-+', 1)} AS hyphens, {_n('–')} AS en_dashes, {_n('—')} AS em_dashes,
 {_n(' — ')} AS spaced_em_dashes, {_m('[.!?] {2,}[A-Z"“‘]')} AS double_space_after_sentence, {_m('[.!?] [A-Z"“‘]')} AS single_space_after_sentence, {_n(chr(0xA0))} AS nbsp, {_n('…')} AS unicode_ellipses,
 {_runs('[.]+', 3)} AS ascii_ellipses, ({_n(chr(0x200B))} + {_n(chr(0x200C))}) AS zero_width_spaces, {_n(chr(0xAD))} AS soft_hyphens, contains(t, '{chr(0xFEFF)}') AS bom,
 {_m('[' + chr(92) + 'x01-' + chr(92) + 'x08' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x0e-' + chr(92) + 'x1f' + chr(92) + 'x7f-' + chr(92) + 'x{9f}]')} AS control_chars, {_GARBLED} AS garbled,
 CAST(len(regexp_extract_all(t, '(?:^|[^' || chr(92) || 'p{{L}}' || chr(92) || 'p{{N}}_])[A-Z]{{2,}}(?:[{_WS}]+[A-Z]{{2,}}){{2,}}(?:$|[^' || chr(92) || 'p{{L}}' || chr(92) || 'p{{N}}_])')) AS BIGINT) AS all_caps_runs,
 {_m('!{2,}|[?]{2,}|[.]{4,}')} AS repeated_punctuation, CAST(len({_LENGTHS}) AS BIGINT) AS sentences, CAST(coalesce(list_sum({_LENGTHS}), 0) AS BIGINT) AS sentence_words,
 CAST(coalesce(list_max({_LENGTHS}), 0) AS BIGINT) AS longest_sentence, CAST(coalesce(list_min({_LENGTHS}), 0) AS BIGINT) AS shortest_sentence
FROM worn"""

BOOK_SQL = f"""SELECT book_id, count(*) AS pages, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in SUMMED)}, max(longest_sentence) AS longest_sentence,
 {', '.join(f"CAST(sum(CASE WHEN quote_style = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}_pages" for s in ('straight', 'curly', 'mixed', 'none'))},
 bool_or(quote_style = 'straight') AND bool_or(quote_style = 'curly') AS style_drifts
FROM ({PAGE_SQL}) GROUP BY book_id"""

DRIFT_SQL = f"""WITH p AS (SELECT * FROM ({PAGE_SQL}) WHERE quote_style IN ('straight', 'curly'))
SELECT DISTINCT book_id, href, quote_style FROM p WHERE book_id IN (SELECT book_id FROM p GROUP BY book_id HAVING count(DISTINCT quote_style) = 2)"""

QUERIES = {"typography_page": typography_page, "typography_book": typography_book, "quote_style_drift": quote_style_drift, "typography_samples": typography_samples}
ORACLE = {"typography_page": PAGE_SQL, "typography_book": BOOK_SQL, "quote_style_drift": DRIFT_SQL}
