"""Corpus vocabulary: how often each word occurs, counted over all pages.

Raw tokens are counted per Arrow batch at C speed; only the distinct ones are cleaned, and one row per
word and batch goes into the shuffle, so a word that makes up a third of the corpus costs no more
than a rare one.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches

#: A word: letters with inner apostrophes; compounds count by their parts and, under `whole`, as they stand.
WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
COMPOUND = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)+")


def word_counts(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """(word, n): words of all rows as written; rows repeated in the table are counted as often as they stand.

    Null and empty texts add nothing.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        raw: Counter[str] = Counter()
        for s in cols[text]:
            if s:
                raw.update(s.split())
        words: Counter[str] = Counter()
        for token, n in raw.items():
            for w in WORD.findall(token):
                words[w] += n
            if "-" in token:
                for w in COMPOUND.findall(token):
                    if "-" in w:
                        words[w] += n
        return {"word": list(words), "n": list(words.values())}

    out = map_batches(df.select(text), "word string, n long", run).groupBy("word").agg(F.sum("n").alias("n"))
    return out.where(F.col("n") >= min_count) if min_count > 1 else out


def frequent(counts: DataFrame, most: int, least: int) -> dict[str, int]:
    """The ``most`` most frequent words with at least ``least`` occurrences: a result of bounded size."""
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    return {r["word"]: r["n"] for r in rows}
