"""Problem 5: text decoded with a wrong encoding, found and restored.

Every distinct clean word of the corpus that holds a character beyond ASCII is put through all chains
of encodings; the garbled forms make a table ``garbled -> original``. The distinct tokens of each page
are joined with it, so the chain of a hit, done to its original, gives the garbled form. A word that several
clean words may have been is not restored but reported as lost. The same is done with the runs of characters
beyond ASCII inside the words, for words that occur nowhere in clean form.

Null and empty texts have no tokens and are never affected.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.llm.vocabulary import frequent
from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

#: Encodings by which UTF-8 was taken for something else, once or twice; and pairs (written, read) of one byte a character.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
READ_ONCE = ("cp1250", "cp1251", "iso8859_15")
ONE_BYTE = (("cp1252", "latin-1"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp437", "cp1252"))
#: Of the most frequent words, those that are no garbled form are known to every task and needn't be looked up; all others are joined.
FREQUENT = 50_000
LOST = "�"

_ASCII_ENDS = string.punctuation + " \t\r\n\f\v"
_C1 = re.compile(r"[\x80-\x9f�]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8});")


def _decode(data: bytes, encoding: str, undefined: str) -> str:
    """Decode as browsers do: bytes the encoding doesn't define stay control characters, or are dropped or replaced."""
    out = []
    for b in data:
        try:
            out.append(bytes((b,)).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b) if undefined == "keep" else "" if undefined == "drop" else LOST)
    return "".join(out)


_TABLES = {(e, u): [_decode(bytes((b,)), e, u) for b in range(256)] for e in {*READ_AS, *READ_ONCE, *(r for _, r in ONE_BYTE)} for u in ("keep", "drop", "lost")}


def _read(data: bytes, encoding: str, undefined: str = "keep") -> str:
    t = _TABLES[encoding, undefined]
    return "".join([t[b] for b in data])


def garbled(word: str) -> dict[str, str]:
    """garbled form -> chain, for all chains that change the word. Shorter chains win."""
    out: dict[str, str] = {}

    def put(form: str, chain: str) -> None:
        if form != word and form not in out:
            out[form] = chain

    raw = word.encode("utf-8")
    once = {}
    for e in (*READ_AS, *READ_ONCE):
        for u in ("keep", "drop", "lost"):
            form = _read(raw, e, u)
            put(form, f"utf-8>{e}" + ("" if u == "keep" else f"({u})"))
            if u == "keep":
                once[e] = form
    for a in READ_AS:
        again = once[a].encode("utf-8")
        for b in READ_AS:
            put(_read(again, b), f"utf-8>{a}>utf-8>{b}")
    for written, read in ONE_BYTE:
        try:
            put(_read(word.encode(written), read), f"{written}>{read}")
        except UnicodeEncodeError:
            pass
    put(_RUN.sub(lambda m: LOST * len(m.group()), word), "lost")
    put(_RUN.sub(LOST, word), "lost")
    lost = _RUN.sub(lambda m: LOST * len(m.group()), word).encode("utf-8")
    put(_read(lost, "cp1252"), "lost>cp1252")
    return out


def tokens(text: str) -> list[str]:
    """Tokens at ASCII white space only: other blanks may be parts of garbled characters."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ")


def bare(token: str) -> str:
    """Without escapes and without ASCII punctuation at both ends."""
    if "&" in token and _ENTITY.search(token):
        token = _ENTITY.sub(lambda m: html.unescape(m.group()), token)
    return token.strip(_ASCII_ENDS)


def foreign_words(pages: DataFrame, text: str) -> DataFrame:
    """(word, n) of all words that hold a character beyond ASCII."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        raw: Counter[str] = Counter()
        for s in cols[text]:
            if s and (not s.isascii() or "&" in s):
                raw.update(tokens(s))
        words: Counter[str] = Counter()
        for t, n in raw.items():
            if not t.isascii() or "&" in t:
                w = bare(t)
                if not w.isascii():
                    words[w] += n
        return {"word": list(words), "n": list(words.values())}

    return map_batches(pages.select(text), "word string, n long", run).groupBy("word").agg(F.sum("n").alias("n"))


#: What no clean word holds: control and replacement characters and signs that only garbling brings inside words.
_UNCLEAN = re.compile(r"[\x80-\x9f�]|[ÃÂâÅÄ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸŽ]|[├┬┼Γ╬]|[√¬≈∫∂‚][^\s\x00-\x7f]")


def garbled_table(words: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(key, original, chain, is_run) of all garbled forms of the clean words and of the runs inside them; with ``only``
    those of whole words that are among these keys."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "original": [], "chain": [], "n": [], "is_run": []}
        runs: Counter[str] = Counter()
        for w, n in zip(cols["word"], cols["n"], strict=True):
            if _UNCLEAN.search(w):
                continue
            for r in _RUN.findall(w):
                runs[r] += n
            for form, chain in garbled(w).items():
                # one byte a character gives letters again: a word too short says nothing
                if not chain.startswith(("utf-8", "lost")) and not _C1.search(form) and len(form) < 4:
                    continue
                if only is not None and form not in only:
                    continue
                for name, x in zip(out, (form, w, chain, n, False), strict=True):
                    out[name].append(x)
        for r, n in runs.items() if only is None else ():
            for form, chain in garbled(r).items():
                # one byte a character: a run of letters alone may be meant as it stands
                if ">" in chain and not chain.startswith("utf-8") and not _C1.search(form):
                    continue
                if len(form) == 1 and form != LOST and not 0x80 <= ord(form) <= 0x9F:
                    continue
                for name, x in zip(out, (form, r, chain, n, True), strict=True):
                    out[name].append(x)
        return out

    return map_batches(words, "key string, original string, chain string, n long, is_run boolean", run)


def page_tokens(pages: DataFrame, key: str, text: str, known: frozenset[str]) -> DataFrame:
    """(key, token, word, runs) of each page's distinct tokens beyond ASCII that aren't among the known clean words."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"page": [], "token": [], "word": [], "runs": []}
        cache: dict[str, str | None] = {}
        for k, s in zip(cols[key], cols[text], strict=True):
            if not s or s.isascii() and "&" not in s:
                continue
            for t in set(tokens(s)):
                if t.isascii() and "&" not in t:
                    continue
                w = cache.get(t, "")
                if w == "":
                    w = bare(t)
                    w = None if w.isascii() or w in known else w
                    cache[t] = w
                if w is not None:
                    for name, x in zip(out, (k, t, w, list(dict.fromkeys(_RUN.findall(w)))), strict=True):
                        out[name].append(x)
        return out

    return map_batches(pages.select(key, text), f"page {dict(pages.dtypes)[key]}, token string, word string, runs array<string>", run)


def known_words(words: DataFrame, most: int = FREQUENT) -> frozenset[str]:
    """Those of the ``most`` most frequent words that are no key of the table of garbled forms, nor any run in them.

    The joins would find nothing for them, so leaving them out changes no result.
    """
    common = frequent(words, most, 1)
    wanted = {False: frozenset(common), True: frozenset(r for w in common for r in _RUN.findall(w))}

    def run(cols: dict[str, list]) -> dict[str, list]:
        keys = {(k, is_run) for k, is_run in zip(cols["key"], cols["is_run"], strict=True) if k in wanted[is_run]}
        return {"key": [k for k, _ in keys], "is_run": [r for _, r in keys]}

    rows = map_batches(garbled_table(words).select("key", "is_run"), "key string, is_run boolean", run).distinct().collect()
    forms = {(r["key"], r["is_run"]) for r in rows}
    return frozenset(w for w in common if (w, False) not in forms and not any((r, True) in forms for r in _RUN.findall(w)))


def clean_originals(words: DataFrame, forms: DataFrame, found: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(key, least, greatest) of the originals of each garbled word found that are no garbled words themselves.

    Up to ``most`` keys are sent to the tasks that make the forms; more are joined.
    """
    keys = stage(found.select("key").distinct(), "garbled-keys")
    few = keys.limit(most + 1).collect()
    only = frozenset(r["key"] for r in few) if len(few) <= most else None
    pairs = garbled_table(words, only).where("NOT is_run").select("key", "original")
    if only is None:
        pairs = pairs.join(keys.hint("merge"), "key", "left_semi")
    pairs = stage(pairs, "originals")
    parts = F.concat(
        F.array(F.struct(F.col("original").alias("key"), F.lit(False).alias("is_run"))),
        F.transform(F.regexp_extract_all("original", F.lit("([^\\x00-\\x7f]+)")), lambda r: F.struct(r.alias("key"), F.lit(True).alias("is_run"))),
    )
    known = forms.where(F.col("o.chain").startswith("utf-8")).select("key", "is_run")
    bad = pairs.select("original").distinct().select("original", F.explode(parts).alias("p")).select("original", "p.*").join(known.hint("merge"), ["key", "is_run"], "left_semi").select("original").distinct()
    return pairs.join(bad.hint("merge"), "original", "left_anti").groupBy("key").agg(F.min("original").alias("least"), F.max("original").alias("greatest"))


def hits(spark: SparkSession, pages: DataFrame, key: str, text: str, certain: bool = False) -> DataFrame:
    """(page, token, garbled, original, chain, is_run): garbled tokens of each page with their originals, the most frequent
    one of several; with ``certain`` null for words of which several clean originals are possible."""
    # a file for each task that will make the forms
    words = stage(foreign_words(pages, text).repartition(spark.sparkContext.defaultParallelism), "foreign-words")
    suspects = stage(page_tokens(pages, key, text, known_words(words)), "suspect-tokens")
    # one row per garbled form: of several originals the most frequent one; a form that is itself a far more
    # frequent clean word is none
    forms = garbled_table(words).groupBy("key", "is_run").agg(
        F.max_by(F.struct("original", "chain", "n"), F.struct("n", F.negative(F.length("original")), "original")).alias("o")
    )
    by_word = suspects.select("page", "token", F.col("word").alias("key"), F.lit(False).alias("is_run")).join(forms.hint("shuffle_hash"), ["key", "is_run"])
    # a form of one byte a character is letters too; it counts only if it is rare beside its original. The words grow
    # with the corpus and are never broadcast, however small their files are
    counted = by_word.join(words.select(F.col("word").alias("key"), F.col("n").alias("own")).hint("merge"), "key", "left")
    by_word = counted.where(F.col("o.chain").startswith("utf-8") | F.col("key").rlike("[\\x{80}-\\x{9f}\\x{fffd}]") | (F.coalesce("own", F.lit(0)) * 20 < F.col("o.n")))
    by_run = suspects.select("page", "token", F.explode("runs").alias("key"), F.lit(True).alias("is_run")).join(forms.hint("shuffle_hash"), ["key", "is_run"])
    cols = ("page", "token", "key", "is_run", "o.original", "o.chain")
    if not certain:
        return by_word.select(*cols).unionByName(by_run.select(*cols))
    # the table of forms is used once more for the originals
    one = F.when(F.col("least").isNull(), F.col("o.original")).when(F.col("least") == F.col("greatest"), F.col("least"))
    by_word = stage(by_word, "garbled-words")
    by_word = by_word.join(clean_originals(words, forms, by_word).hint("merge"), "key", "left").select("page", "token", "key", "is_run", one.alias("original"), "o.chain")
    return by_word.unionByName(by_run.select(*cols))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with garbled characters anywhere."""
    pages = table(spark, sf_dir, "chapters")
    return hits(spark, pages, "chapter_id", "document").select(F.col("page").alias("chapter_id")).distinct()


def restore(text: str, found: list) -> tuple[str, int, int]:
    """(text with the originals in place of the garbled words, words restored, words whose original is lost)."""
    # whole words first; runs only in tokens that no word covers
    by_token: dict[str, list] = {}
    for r in found:
        by_token.setdefault(r["token"], []).append(r)
    done = lost = 0
    new: dict[str, str] = {}
    for token, rows in by_token.items():
        plain = _ENTITY.sub(lambda m: html.unescape(m.group()), token) if "&" in token else token
        whole = [r for r in rows if not r["is_run"]]
        use = whole or sorted(rows, key=lambda r: (-len(r["key"]), r["key"]))
        for r in use[:1] if whole else use:
            if r["original"] is None or r["is_run"] and LOST in r["key"]:
                lost += 1
                continue
            plain = plain.replace(r["key"], r["original"])
            done += 1
        new[token] = plain
    out = re.sub(r"[^ \n\t\r\f]+", lambda m: new.get(m.group(), m.group()), text)
    return out, done, lost


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected pages with the restored text, the number of words restored and of those whose original is lost."""
    pages = table(spark, sf_dir, "chapters").select("chapter_id", "document").dropDuplicates(["chapter_id"])
    # a page's hits are at most its distinct words
    found = (
        hits(spark, table(spark, sf_dir, "chapters"), "chapter_id", "document", certain=True).distinct()
        .groupBy(F.col("page").alias("chapter_id")).agg(F.collect_list(F.struct("token", "key", "is_run", "original", "chain")).alias("found"))
    )

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [restore(t, f) for t, f in zip(cols["document"], cols["found"], strict=True)]
        return {
            "chapter_id": cols["chapter_id"], "document": [r[0] for r in rows], "restored_words": [r[1] for r in rows], "lost_words": [r[2] for r in rows],
        }

    return map_batches(pages.join(found, "chapter_id"), "chapter_id long, document string, restored_words int, lost_words int", run)


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
