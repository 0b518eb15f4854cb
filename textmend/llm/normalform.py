"""Problem 2: equal-looking text in one consistent form.

A longest-match transducer over grapheme clusters (a base character and the marks after it) is
compiled once from a table ``cluster -> replacement`` and applied in one pass. The table is built by
rule, closed under further marks, and checked for conflicts: no cluster has two replacements, and no replacement contains a
cluster that the table would change again, so a second pass changes nothing. One automaton finds the longest
matches; what a match becomes is read off the table's states once and remembered.

Look-alike letters of other scripts are replaced only inside words that mix scripts; whole words of
another script stay. Null text gives null; empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import table

# --- fixed values: Cyrillic, Greek and other letters and the Latin letters they look like -------------------
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b",
    "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ԍ": "g", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "т": "t", "м": "m", "н": "h", "п": "n",
    "г": "r", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ό": "ó", "ά": "á",
    "έ": "é", "ή": "ή", "ί": "í", "ύ": "ú", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}

INVISIBLE = [0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010),
             *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0,
             *range(0xFFF9, 0xFFFC)]
#: Invisible too, but beyond the range in which a character class is one look-up: only texts with characters beyond it
#: run the automaton that knows them.
TAGS = range(0xE0000, 0xE0080)
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
WIDTHS = [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7)]
#: Half-width letters of scripts that are written full; the voicing marks after them are marks of their own.
HALF_WIDTHS = [*range(0xFF61, 0xFF9E), *range(0xFFA1, 0xFFBF), *range(0xFFC2, 0xFFC8), *range(0xFFCA, 0xFFD0), *range(0xFFD2, 0xFFD8), *range(0xFFDA, 0xFFDD), *range(0xFFE8, 0xFFEF)]
HALF_MARKS = {chr(0xFF9E): chr(0x3099), chr(0xFF9F): chr(0x309A)}
JOINED = [*range(0xFB00, 0xFB07), *range(0x0132, 0x0134), *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4)]
MARKS = [*range(0x0300, 0x0370), *range(0x1AB0, 0x1AD0), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x20F1), *range(0xFE20, 0xFE30)]
SOFT_HYPHEN = 0x00AD

KINDS = ("width", "accent", "joined", "invisible", "soft_hyphen", "space", "lookalike")


def build_table() -> dict[str, tuple[str, str]]:
    """cluster -> (replacement, kind), by rule; raises on a conflict."""
    out: dict[str, tuple[str, str]] = {}

    def put(cluster: str, to: str, kind: str) -> None:
        if cluster in out and out[cluster][0] != to:
            raise ValueError(f"two replacements for {cluster!r}")
        if cluster != to:
            out[cluster] = (to, kind)

    for cp in WIDTHS:
        to = unicodedata.normalize("NFKC", chr(cp))
        put(chr(cp), to, "width" if to.isalnum() else "width_sign")
    for cp in HALF_WIDTHS:
        put(chr(cp), unicodedata.normalize("NFKC", chr(cp)), "half_width")
    for half, mark in HALF_MARKS.items():
        put(half, mark, "half_width")
        for base in map(chr, range(0x3040, 0x3100)):
            whole = unicodedata.normalize("NFC", base + mark)
            if len(whole) == 1:
                put(base + mark, whole, "half_width")
    for cp in JOINED:
        put(chr(cp), unicodedata.normalize("NFKC", chr(cp)), "joined")
    for cp in INVISIBLE:
        put(chr(cp), "", "invisible")
    for cp in SPACES:
        put(chr(cp), " ", "space")
    put(chr(SOFT_HYPHEN), "", "soft_hyphen")
    # a base letter and one mark that have a common character, which may take a further mark
    bases = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if chr(c).isalpha()]
    seen = set(bases)
    while bases:
        new = []
        for base in bases:
            for mark in map(chr, MARKS):
                whole = unicodedata.normalize("NFC", base + mark)
                if len(whole) == 1:
                    put(base + mark, whole, "accent")
                    if whole not in seen:
                        seen.add(whole)
                        new.append(whole)
        bases = new
    for cluster, (to, _) in list(out.items()):
        again = [x for x in (to, *to) if x in out]
        if again:
            raise ValueError(f"the replacement of {cluster!r} would be changed again: {again}")
    for foreign, latin in LOOKALIKES.items():
        if foreign in out or any(x in out for x in latin):
            raise ValueError(f"look-alike {foreign!r} conflicts with the table")
    return out


def _class(cps) -> str:
    return "".join(re.escape(chr(c)) for c in cps)


def _script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0xFB00 <= cp < 0xFB07 or 0xFF21 <= cp < 0xFF5B:
        return "latin"
    return "other"


class Transducer:
    """Compiled form of the table; ``apply`` rewrites a text and counts what it changed, by kind."""

    def __init__(self) -> None:
        self.table = build_table()
        singles = _class(c for c in map(ord, (c for c in self.table if len(c) == 1)))
        look = "".join(map(re.escape, LOOKALIKES))
        marks = f"[{_class(MARKS)}{''.join(HALF_MARKS)}{''.join(HALF_MARKS.values())}]"
        drop = _class([*INVISIBLE, SOFT_HYPHEN])
        # alternatives in order of length: a word with a look-alike, a cluster with marks, one character. A word can only
        # begin where no letter stands before it, so the search doesn't restart inside words; what is invisible may stand
        # between a letter and its marks
        part = rf"(?:[^\W\d_]|{marks}|[{drop}])"
        self.word = re.compile(rf"(?<![^\W\d_]){part}*?[{look}]{part}*")
        cluster = rf"[^\W_](?:[{drop}]*{marks})+"
        self.inner = re.compile(rf"{cluster}|[{singles}]")
        self.outer = re.compile(rf"{self.word.pattern}|{cluster}|[{singles}]")
        self.beyond = re.compile(rf"{self.outer.pattern}|[{_class((TAGS[0],))}-{_class((TAGS[-1],))}]")
        self.look = re.compile(f"[{look}]")
        self.any = re.compile(rf"[{look}{singles}{marks[1:]}")
        self.known: dict[str, tuple[str, tuple[str, ...]]] = {}

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}
        known = self.known

        def replaced(m: re.Match) -> str:
            x = m.group()
            found = known.get(x)
            if found is None:
                if len(known) > 100_000:
                    known.clear()
                found = known[x] = self.match(x)
            for kind in found[1]:
                counts[kind] = counts.get(kind, 0) + 1
            return found[0]

        if len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text):
            return self.beyond.sub(replaced, text), counts
        if text.isascii() or not self.any.search(text):
            return text, counts
        # without a look-alike no word needs its context
        return (self.outer if self.look.search(text) else self.inner).sub(replaced, text), counts

    def match(self, x: str) -> tuple[str, tuple[str, ...]]:
        """(replacement, kinds of what was changed) of a longest match."""
        if ord(x[0]) in TAGS:
            return "", ("invisible",)
        kinds: list[str] = []
        if self.look.search(x) and self.word.fullmatch(x):
            letters = [ch for ch in x if ch.isalpha()]
            scripts = {unicodedata.name(ch, "?").split()[0] for ch in letters if _script(ch) == "other"}
            mixed = any(_script(ch) == "latin" for ch in letters) or len(scripts & {"CYRILLIC", "GREEK", "ARMENIAN"}) > 1
            if mixed and all(_script(ch) == "latin" or ch in LOOKALIKES for ch in letters):
                kinds += ["lookalike" for ch in letters if ch in LOOKALIKES and _script(ch) == "other"]
                x = "".join(LOOKALIKES[ch] if ch in LOOKALIKES and _script(ch) == "other" else ch for ch in x)
            return self.inner.sub(lambda m: self.states(m.group(), kinds), x), tuple(kinds)
        return self.states(x, kinds), tuple(kinds)

    def states(self, cluster: str, kinds: list[str]) -> str:
        """Run a cluster through the table: the state is the last character so far, each mark leads to the next state."""
        out = ""
        for ch in cluster:
            to, kind = self.table.get(ch, (ch, ""))
            if kind:
                kinds.append(kind)
            further = self.table.get(out[-1:] + to) if to else None
            out = out[:-1] + further[0] if further else out + to
        if len(cluster) > 1 and cluster[0].isalpha() and any(ord(c) in _MARKS for c in cluster):
            kinds.append("accent")
        # marks out of their order; done once for each distinct cluster
        return unicodedata.normalize("NFC", out)


_MARKS = frozenset(MARKS)
_TRANSDUCER: Transducer | None = None


def transducer() -> Transducer:
    """The compiled transducer, once per process."""
    global _TRANSDUCER
    if _TRANSDUCER is None:
        _TRANSDUCER = Transducer()
    return _TRANSDUCER


def normalise(df: DataFrame, key: str, text: str, changed_only: bool = False, with_text: bool = True) -> DataFrame:
    """(key, text, one count per kind): the text in normal form and what was changed in it.

    Null text: null text and counts of zero. ``changed_only`` keeps rows in which a countable case was found.
    """
    cols = ", ".join(f"{k}_count int" for k in KINDS)
    schema = f"{key} {dict(df.dtypes)[key]}, " + ("text string, " if with_text else "") + cols

    def run(cols: dict[str, list]) -> dict[str, list]:
        t = transducer()
        out: dict[str, list] = {key: [], **({"text": []} if with_text else {}), **{f"{k}_count": [] for k in KINDS}}
        for k, s in zip(cols[key], cols[text], strict=True):
            new, n = (None, {}) if s is None else t.apply(s)
            if changed_only and not any(n.get(x) for x in KINDS):
                continue
            out[key].append(k)
            if with_text:
                out["text"].append(new)
            for x in KINDS:
                out[f"{x}_count"].append(n.get(x, 0))
        return out

    return map_batches(df.select(key, text), schema, run)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold at least one character the transducer brings to its common form."""
    pages = table(spark, sf_dir, "chapters")
    return normalise(pages, "chapter_id", "document", changed_only=True, with_text=False).select("chapter_id").distinct()


def p2_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once, in normal form, with the right counts beside those of the older analyser's columns."""
    pages = table(spark, sf_dir, "chapters")
    out = normalise(pages, "chapter_id", "document")
    # repeated rows hold the same document: one of them is kept by a cheap aggregate over equal values
    return out.groupBy("chapter_id").agg(*[_any(c) for c in out.columns if c != "chapter_id"])


def _any(c: str):
    from pyspark.sql import functions as F

    return F.any_value(c).alias(c)


QUERIES = {"p2_found": p2_found, "p2_normal_form": p2_normal_form}
