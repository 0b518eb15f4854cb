"""Problem 6: statistics of each page, and pages that are no natural prose.

One pass gives word count, mean word length, share of symbols, of lines that end in punctuation, of
common words, runs of capitals, shares of repeated lines and paragraphs, and for word n-grams of two to
four how much of the text the dominant one covers and the share of repeated ones. Combined rules on these and
on the shapes of the lines tell lists, tables, junk and boilerplate (the same readable lines or phrases
again and again) from prose. Common words are the most frequent ones of the whole corpus that together make
up ``COMMON_COVERAGE`` of its running words, ``COMMON_WORDS`` at most (so they may be sent to every task).

Null and blank pages have counts of zero, null shares and no shape; residue (problem 3) has no shape.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.llm.normalform import transducer
from textmend.llm.residue import classify
from textmend.llm.vocabulary import WORD, frequent, word_counts
from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

COMMON_WORDS = 3000
COMMON_COVERAGE = 0.99
THIN_WORDS = 50
CAPS_RUN = re.compile(r"\b[A-Z]{2,}(?:\s+[A-Z]{2,}){2,}\b")
_END = tuple(".!?…:;,”\"»“’'—)")

# shapes of a line
BULLET = re.compile(r"^\s*(?:[-*•–—‣▪◦·+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxlcIVXLC]{1,6}[.)])\s+\S")
LEADERS = re.compile(r"(?:\.\s?){4,}\s*[\divxlc]+\s*$|…{2,}\s*\d+\s*$")
INDEX = re.compile(r"^[^\d,;|\t]{1,60}(?:,\s*\d[\d–-]*)+\.?$")
PAIR = re.compile(r"^\s*[^()\n]{1,40}\([^()\n]{1,40}\)\s*$")
COLUMNS = re.compile(r"\t|\s?\|\s?|;|(?<=\S)\s{3,}(?=\S)")
VOWEL = re.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüãõåæœøAEIOUYÁÉÍÓÚÀÈÂÊÎÔÛÄËÏÖÜ]")

STATS = (
    "word_count long, mean_word_length double, symbol_share double, punctuated_line_share double, common_word_share double, "
    "all_caps_run_count long, duplicate_line_share double, duplicate_paragraph_share double, "
    "dominant_bigram_share double, dominant_trigram_share double, dominant_fourgram_share double, duplicate_bigram_share double, is_thin boolean, shape string"
)
NAMES = [x.split()[0] for x in STATS.split(", ")]


_STARTS = frozenset("-*•–—‣▪◦·+(")
_NUMBERED = re.compile(r",\s*\d")
_CAPITALS = re.compile("[A-Z]{2}")
_NGRAMS = (2, 3, 4)
#: A page says little more than a few words again and again: so many words, of whose bigrams so many are repeated, by so few
#: different words. Boilerplate: so many lines or paragraphs, or so much of the text, are repetitions.
REPEATED_WORDS, REPEATED_BIGRAMS, REPEATED_VOCABULARY = 12, 0.6, 4
BOILERPLATE = 0.5


class _Tokens(dict):
    """Token -> its row in a table of counts, remembered.

    Counts: word parts, of them common, letters, symbols, whether it holds capitals side by side, and characters.
    """

    def __init__(self, common: frozenset[str]) -> None:
        self.common = common
        self.table = np.zeros((1024, 6), dtype=np.int64)

    def __missing__(self, t: str) -> int:
        words = WORD.findall(t)
        common = sum(w in self.common or w.lower() in self.common for w in words)
        symbols = sum(1 for c in t if not c.isalnum() and (c in "#*@&%_\\/" or unicodedata.category(c)[0] != "P"))
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = len(words), common, sum(map(len, words)), symbols, bool(_CAPITALS.search(t)), len(t)
        self[t] = n
        return n

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


class Repetition:
    """How much of a text is repeated: by lines, paragraphs and word n-grams."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, lines: list[str], paragraphs: list[str]) -> None:
        self.lines = 1 - len(set(lines)) / len(lines)
        self.paragraphs = 1 - len(set(paragraphs)) / len(paragraphs)
        self.dominant = []
        self.bigrams = 0.0
        chars = int(lengths.sum())
        key = rows.astype(np.uint64)
        width = lengths
        for n in _NGRAMS:
            if len(key) < 2:
                self.dominant.append(0.0)
                continue
            key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + rows[n - 1 :].astype(np.uint64)
            width = width[:-1] + lengths[n - 1 :]
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            top = int(times.max())
            self.dominant.append(min(1.0, top * int(width[first[times == top]].max()) / chars) if top > 1 else 0.0)
            if n == 2:
                self.bigrams = 1 - len(times) / len(key)


class Measure:
    """Statistics and shape of a text, given the common words."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common = common
        self.tokens = _Tokens(common)

    def stats(self, text: str | None) -> tuple:
        if text is None or not text.strip():
            return (0, None, None, None, None, 0, *[None] * 6, True, None)
        tokens = text.split()
        n = len(tokens)
        rows = self.tokens.rows(tokens)
        counts = self.tokens.table[rows]
        parts, common, letters, symbols, caps, chars = counts.sum(axis=0).tolist()
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        ended = sum(x.endswith(_END) for x in lines) / len(lines)
        again = Repetition(rows, counts[:, 5], lines, [x for x in text.split("\n\n") if x.strip()])
        share = common / parts if parts else 0.0
        runs = len(CAPS_RUN.findall(text)) if caps >= 3 else 0
        shape = self.shape(text, tokens, lines, share, parts, letters, chars, ended, again)
        return (
            n, letters / parts if parts else 0.0, symbols / chars, ended, share, runs,
            again.lines, again.paragraphs, *again.dominant, again.bigrams, n < THIN_WORDS, shape,
        )

    def shape(self, text: str, tokens: list[str], lines: list[str], share: float, parts: int, letters: int, chars: int, ended: float, again: Repetition) -> str | None:
        """'list', 'table', 'junk', 'boilerplate' or None. Lists and tables are judged by the part of the words that stands
        in lines of their shape, junk by the want of words or of different ones, boilerplate by repetition."""
        n = len(tokens)
        if len(lines) <= 3 and text.count(";") >= 5 and self.run_in(text):
            return "list"
        if len(lines) >= 3 and (ended < 0.6 or len(text) / len(lines) < 45):
            # what no line of the text can be needn't be tried on each
            leaders = "..." in text or ". ." in text or "…" in text
            indexed = bool(_NUMBERED.search(text))
            paired = text.count(")") >= 0.5 * len(lines)
            celled_text = "\t" in text or "|" in text or "   " in text or text.count(";") >= len(lines)
            listed = celled = items = cells = 0
            widths: Counter[int] = Counter()
            for x in lines:
                if leaders and LEADERS.search(x) or indexed and INDEX.match(x) or paired and PAIR.match(x):
                    listed += len(x.split())
                    items += 1
                    continue
                if celled_text:
                    c = len([y for y in COLUMNS.split(x.strip("|").strip()) if y.strip()])
                    if c >= 2 and self.cells(x):
                        celled += len(x.split())
                        cells += 1
                        widths[c] += 1
                        continue
                if (x[0] in _STARTS or ")" in x[1:7] or "." in x[1:7]) and BULLET.match(x) and len(x.split()) <= 14:
                    listed += len(x.split())
                    items += 1
            if cells >= 3 and celled >= 0.6 * n and max(widths.values()) >= 0.5 * cells and sum(map(str.isalnum, text)) >= 0.5 * chars:
                return "table"
            if items >= 3 and listed >= 0.6 * n:
                return "list"
        sparse = parts == 0 or letters < 0.4 * chars or letters < 1.7 * parts
        # few words again and again; the share of repeated bigrams spares all other texts the count
        repeated = n >= REPEATED_WORDS and again.bigrams >= REPEATED_BIGRAMS and len(set(tokens)) <= max(2, min(REPEATED_VOCABULARY, n // 20))
        if repeated or ((share < 0.5 or sparse) and not self.readable(text, tokens, letters, chars)):
            if classify(text) is None:
                return "junk"
        elif (max(again.lines, again.paragraphs) >= BOILERPLATE or max(again.dominant) >= BOILERPLATE) and n >= REPEATED_WORDS and classify(text) is None:
            return "boilerplate"
        return None

    @staticmethod
    def run_in(text: str) -> bool:
        """Items set one after another in one paragraph, with nothing but semicolons between them."""
        items = [x.strip(" .\n") for x in text.split(";")]
        return len(items) >= 6 and sum(len(x.split()) <= 4 and not re.search(r"[.!?:]\s", x) for x in items) >= 0.9 * len(items)

    @staticmethod
    def cells(line: str) -> bool:
        """Cells hold words, numbers or dashes, no sentences."""
        parts = [y.strip() for y in COLUMNS.split(line.strip("|").strip()) if y.strip()]
        return all(len(y) <= 40 and y.count(" ") <= 4 for y in parts) and any(any(c.isalnum() for c in y) for y in parts)

    def readable(self, text: str, tokens: list[str], letters: int, chars: int) -> bool:
        """Text of uncommon or damaged words is still text: most of it are letters in words that can be spoken."""
        if any(ord(c) > 0x24F for c in text):
            text = transducer().apply(text)[0]
            tokens = text.split()
            words = [w for w in WORD.findall(text) if len(w) > 1]
            if sum(map(len, words)) >= 0.4 * chars and sum(w in self.common or w.lower() in self.common for w in words) >= 0.3 * len(words):
                return True
        words = WORD.findall(text)
        spoken = sum(len(w) for w in words if len(w) >= 2 and VOWEL.search(w)) if words else 0
        if spoken < 0.5 * chars:
            return False
        if max(map(len, tokens)) > 60 and sum(len(t) for t in tokens if len(t) > 40) > 0.3 * chars:
            return False
        distinct = {w.lower() for w in words}
        if len(words) >= 12 and len(distinct) <= max(2, len(words) // 10):
            return False
        odd = sum(1 for w in words if len(w) > 3 and re.search(r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{5,}|[a-z][A-Z]", w))
        return odd <= 0.25 * len(words)


def measured(pages: DataFrame, key: str, text: str, common: frozenset[str], shaped_only: bool = False) -> DataFrame:
    """(key, statistics) of every row; ``shaped_only`` keeps those that have a shape."""
    made: list[Measure] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Measure(common))
        keys, rows = [], []
        for k, s in zip(cols[key], cols[text], strict=True):
            r = made[0].stats(s)
            if r[-1] or not shaped_only:
                keys.append(k)
                rows.append(r)
        columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
        return {key: keys} | dict(zip(NAMES, map(list, columns), strict=True))

    return map_batches(pages.select(key, text), f"{key} long, {STATS}", run)


def common_words(pages: DataFrame, text: str) -> frozenset[str]:
    """The most frequent words of all pages, as far as they make up the common part of the running words; one seen once is none."""
    words = stage(word_counts(pages, text), "words")
    left = COMMON_COVERAGE * (words.select(F.sum("n")).first()[0] or 0)
    out = []
    for w, n in frequent(words, COMMON_WORDS, 2).items():
        if left <= 0:
            break
        out.append(w)
        left -= n
    return frozenset(out)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are lists, tables or junk; boilerplate is readable and so no case here."""
    pages = table(spark, sf_dir, "chapters")
    rows = measured(pages, "chapter_id", "document", common_words(pages, "document"), shaped_only=True)
    return rows.where("shape <> 'boilerplate'").select("chapter_id", "shape").distinct()


def p6_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every page once, beside the older analyser's word_count, is_thin and all_caps_run_count."""
    pages = table(spark, sf_dir, "chapters")
    rows = measured(pages, "chapter_id", "document", common_words(pages, "document")).dropDuplicates(["chapter_id"])
    # the analyses repeat rows; the latest one of a page counts
    old = (
        table(spark, sf_dir, "chapter_analyses").groupBy("chapter_id")
        .agg(F.max_by(F.struct("word_count", "is_thin", "all_caps_run_count"), F.struct(F.coalesce("analyzed_at", F.lit("1900-01-01").cast("timestamp_ntz")), "word_count")).alias("old"))
    )
    return rows.join(old, "chapter_id", "left").select(
        "chapter_id", *NAMES, F.col("old.word_count").alias("old_word_count"), F.col("old.is_thin").alias("old_is_thin"),
        F.col("old.all_caps_run_count").alias("old_all_caps_run_count"),
    )


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the statistics that SQL can express, of every page once."""
    return p6_statistics(spark, sf_dir).select("chapter_id", "word_count", "is_thin", "all_caps_run_count", "punctuated_line_share", "duplicate_line_share")


_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ENDS = ", ".join("'" + c.replace("'", "''") + "'" for c in _END)
ORACLE = {
    "p6_counts": rf"""WITH d AS (SELECT chapter_id, any_value(document) AS t FROM chapters GROUP BY chapter_id), l AS (SELECT *, len(regexp_extract_all(coalesce(t, ''), '[^{_WS}]+')) AS n,
 list_filter([regexp_replace(regexp_replace(x, '^[{_WS}]+', ''), '[{_WS}]+$', '') for x in string_split(coalesce(t, ''), chr(10))], lambda x: x <> '') AS lines FROM d)
SELECT chapter_id, CAST(n AS BIGINT) AS word_count, n < {THIN_WORDS} AS is_thin,
 CAST(len(regexp_extract_all(coalesce(t, ''), '(?:^|[^\p{{L}}\p{{N}}_])[A-Z]{{2,}}(?:[{_WS}]+[A-Z]{{2,}}){{2,}}(?:$|[^\p{{L}}\p{{N}}_])')) AS BIGINT) AS all_caps_run_count,
 CASE WHEN n > 0 THEN len(list_filter(lines, lambda x: right(x, 1) IN ({_ENDS}))) / len(lines) END AS punctuated_line_share, CASE WHEN n > 0 THEN 1 - len(list_distinct(lines)) / len(lines) END AS duplicate_line_share FROM l""",
}
QUERIES = {"p6_found": p6_found, "p6_statistics": p6_statistics, "p6_counts": p6_counts}
