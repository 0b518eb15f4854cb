"""Text functions as native columns: counts, typography measures and the repairs of single texts.

All take and return columns, so that they run inside whole-stage code generation and compose freely.
Null text gives null. Patterns use explicit character classes, which mean the same in every engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware splitting sees it (inside a character class).
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{WS}]+"
#: The same signs one by one.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Edges of words: letters, digits and underscores of any script are word characters, marks and joiners are none.
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# --- fixed values: words before a full stop that needs no blank after it ------------------------------------
ABBREVIATIONS = "mr mrs ms mx dr prof st jr sr rev gen col capt cpt lt sgt hon esq vs etc inc ltd co corp no vol ch pp ed eds al cf fig approx dept govt assn univ et".split()
# --- fixed values: words that lose their apostrophe before a fragment -----------------------------------------
CONTRACTIONS = {
    "t": "don doesn didn isn aren wasn weren hasn haven hadn couldn wouldn shouldn won can mustn needn ain".split(),
    "ll": "i you we they he she it that there who what".split(),
    "ve": "i you we they could would should might must".split(),
    "re": "you we they".split(),
    "d": "i you we they he she it who there".split(),
    "m": ["i"],
    "s": "it that there here what who let he she".split(),
    "all": ["y"],
    "clock": ["o"],
    "am": ["ma"],
}
# --- fixed values: words that lose the apostrophe at their head, in their order of use ---------------------------
LEADING_WORDS = ["tis", "twas", "twere", "twould", "tisn't", "twasn't", "gainst"]
# --- fixed values: sequences that show text read in a wrong encoding -------------------------------------------
GARBLED = ["\u00e2\u20ac\u201c", "\u00e2\u20ac\u2122", "\u00e2\u20ac\u0153", "Ã©", "Ã¨", "Ã¯", "Ã´", "Ã¼", "Â\xa0", "ï»¿"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: White space below U+0080, whose class is a look-up in a table; the rest is brought to blanks first.
_NARROW = r"\x09-\x0d\x1c-\x20"
_WIDE = [b for b in BLANKS if ord(b) > 0x7F]


def narrowed(c: Column) -> Column:
    """The text with blanks for all wide white space; a text of single bytes has none."""
    return let(c, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(reduce(lambda a, b: F.replace(a, F.lit(b), F.lit(" ")), _WIDE, t)))


def words(c: Column) -> Column:
    """Number of words: runs of anything but white space."""
    return F.regexp_count(narrowed(c), F.lit(f"[^{_NARROW}]+")).cast("long")


def occurrences(c: Column, what: str) -> Column:
    """Number of non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("long")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def style(straight: Column, curly: Column) -> Column:
    """mixed, curly, straight or none."""
    return F.when((straight > 0) & (curly > 0), "mixed").when(curly > 0, "curly").when(straight > 0, "straight").otherwise("none")


def sentences(c: Column) -> Column:
    """Words of each sentence: pieces between white space that follows . ! ? and precedes a capital or a quote."""
    pieces = F.split(narrowed(c), rf"(?<=[.!?])[{_NARROW}]+(?=[A-Z\"“])")
    return F.filter(F.transform(pieces, lambda p: F.regexp_count(p, F.lit(f"[^{_NARROW}]+")).cast("long")), lambda n: n > 0)


def typography(c: Column) -> Column:
    """The measures of one text as a struct. They are bound to one value, which keeps them out of a generated method too
    long to be compiled."""
    return let(F.struct(c.alias("t"), sentences(c).alias("lengths")), lambda v: F.struct(*[x.alias(n) for n, x in measures(v["t"], v["lengths"]).items()]))


def measures(c: Column, lengths: Column) -> dict[str, Column]:
    """The measures of one text by name, given the words of its sentences."""
    double_straight, double_curly = occurrences(c, '"'), occurrences(c, "“") + occurrences(c, "”")
    single_straight, single_curly = occurrences(c, "'"), occurrences(c, "‘") + occurrences(c, "’")
    return {
        # sentences are cut at white space, so theirs are all the words
        "words": F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n),
        "straight_double_quotes": double_straight,
        "curly_double_quotes": double_curly,
        "quote_style": style(double_straight, double_curly),
        "straight_apostrophes": single_straight,
        "curly_apostrophes": single_curly,
        "apostrophe_style": style(single_straight, single_curly),
        "double_hyphens": matches(c, "(?<!-)--(?!-)"),
        "hyphens": matches(c, "(?<!-)-(?!-)"),
        "en_dashes": occurrences(c, "–"),
        "em_dashes": occurrences(c, "—"),
        "spaced_em_dashes": occurrences(c, " — "),
        "double_space_after_sentence": matches(c, r"[.!?] {2,}(?=[A-Z\"“‘])"),
        "single_space_after_sentence": matches(c, r"[.!?] (?=[A-Z\"“‘])"),
        "nbsp": occurrences(c, "\xa0"),
        "unicode_ellipses": occurrences(c, "…"),
        "ascii_ellipses": matches(c, r"(?<!\.)\.\.\.(?!\.)"),
        "zero_width_spaces": occurrences(c, "\u200b") + occurrences(c, "\u200c"),
        "soft_hyphens": occurrences(c, "\xad"),
        "bom": F.contains(c, F.lit("\ufeff")),
        "control_chars": matches(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"),
        "garbled": total([occurrences(c, m) for m in GARBLED]),
        "all_caps_runs": matches(c, rf"[A-Z](?<![\p{{L}}\p{{N}}_][A-Z])[A-Z]+(?:[{WS}]+[A-Z]{{2,}}){{2,}}{EDGE_R}"),
        "repeated_punctuation": matches(c, r"!{2,}|\?{2,}|\.{4,}"),
        "sentences": F.size(lengths).cast("long"),
        "sentence_words": F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n),
        "longest_sentence": F.coalesce(F.array_max(lengths), F.lit(0)).cast("long"),
        "shortest_sentence": F.coalesce(F.array_min(lengths), F.lit(0)).cast("long"),
    }


# --- ellipses ------------------------------------------------------------------------------------------------

SPACED_ELLIPSIS = r"\.(?:[ \t]+\.){2,}"
ASCII_ELLIPSIS = r"(?<!\.)\.\.\.(?!\.)"


def ellipses(c: Column, target: str = "…") -> Column:
    """Spaced and three-dot ellipses in the target form; runs of four and more dots stay."""
    return sub(c, f"{SPACED_ELLIPSIS}|{ASCII_ELLIPSIS}", target)


# --- apostrophes ---------------------------------------------------------------------------------------------


def contractions(c: Column, apostrophe: str = "'") -> Column:
    """Apostrophes put back into split contractions and before archaic short forms; upper and lower case kept."""
    # few texts hold a lone fragment; one look for any of them spares the rest the whole chain
    lone = rf"(?i)[a-z] (?:t|ll|ve|re|d|m|s){EDGE_R}|y all{EDGE_R}|o clock{EDGE_R}|ma am{EDGE_R}"

    def chain(t: Column) -> Column:
        for fragment, heads in CONTRACTIONS.items():
            t = sub(t, rf"(?i){EDGE_L}({'|'.join(heads)}) (?={fragment}{EDGE_R}(?!/))", f"$1{apostrophe}")
        return t

    short = sorted(LEADING_WORDS, key=len, reverse=True)
    done = let(c, lambda t: F.when(t.rlike(lone), chain(t)).otherwise(t))
    return let(done, lambda t: F.when(t.rlike("(?i)t(?:is|was|were|would)|gainst"), sub(t, rf"(?i)(?<![‘’']){EDGE_L}({'|'.join(short)}){EDGE_R}", f"{apostrophe}$1")).otherwise(t))


def bare_s(c: Column) -> Column:
    """Words before a lone s that may be a possessive or a plural; words of contractions are left out."""
    found = F.regexp_extract_all(c, F.lit(rf"{EDGE_L}([A-Za-z0-9]{{2,}}) ([sS]){EDGE_R}(?![./,;:\-–—])"), F.lit(1))
    return F.filter(found, lambda w: ~F.lower(w).isin(CONTRACTIONS["s"]))


# --- white space ---------------------------------------------------------------------------------------------

RULES = ("leading", "trailing", "repeated", "tabs", "before_punctuation", "missing")


def missing_spaces(c: Column) -> Column:
    """A blank after . ! ? before a capitalised word, and after , ; : between letters."""

    def chain(t: Column) -> Column:
        t = sub(t, rf"(?:(?<![A-Za-z])|\G)(?!(?i:{'|'.join(ABBREVIATIONS)})\.)([A-Za-z]{{2,}})([.!?])([A-Z][a-z])", "$1$2 $3")
        for sign in ",;:":
            t = sub(t, f"([A-Za-z]){sign}([A-Za-z])", f"$1{sign} $2")
        return t

    return let(c, lambda t: F.when(t.rlike("[A-Za-z][.!?,;:][A-Za-z]"), chain(t)).otherwise(t))


def whitespace(c: Column, leading_glue: Column, trailing_glue: Column, rules: tuple[str, ...] = RULES) -> Column:
    """The white-space rules as a struct: whether each one applied, and the text after them. An inline neighbour on a side
    keeps one blank there. Without 'tabs' a tab is no white space for any rule."""
    ws = r"[ \t\r\n]" if "tabs" in rules else r"[ \r\n]"
    blank = lambda glue: F.when(glue, " ").otherwise("")
    changed = lambda s: s["a"] != s["b"]
    steps = {
        "tabs": (lambda t: F.replace(t, F.lit("\t"), F.lit(" ")), changed),
        "leading": (lambda t: F.regexp_replace(t, F.lit(f"^{ws}+"), blank(leading_glue)), lambda s: s["a"].rlike(f"^{ws}")),
        "trailing": (lambda t: F.regexp_replace(t, F.lit(rf"{ws}+\z"), blank(trailing_glue)), lambda s: s["a"].rlike(rf"{ws}\z")),
        "repeated": (lambda t: sub(t, f"{ws}{{2,}}", " "), changed),
        "before_punctuation": (lambda t: sub(t, r"[ \t]+([,.;:!?…])", "$1"), changed),
        "missing": (missing_spaces, changed),
    }
    order = [r for r in ("tabs", *RULES) if r in rules]
    order = list(dict.fromkeys(order))

    def go(t: Column, left: list[str], flags: list[Column]) -> Column:
        if not left:
            return F.struct(*flags, t.alias("text"))
        make, applied = steps[left[0]]
        return let(F.struct(t.alias("a"), make(t).alias("b")), lambda s: go(s["b"], left[1:], [*flags, applied(s).alias(left[0])]))

    return go(c, order, [])


def whitespace_category(steps: Column, rules: tuple[str, ...] = RULES) -> Column:
    """One label for a text, by precedence."""
    order = (("tabs", "tab converted"), ("missing", "missing space"), ("before_punctuation", "space before punctuation"), ("leading", "leading indent"), ("trailing", "trailing space"), ("repeated", "repeated space"))
    out = F.lit(None).cast("string")
    for rule, label in reversed(order):
        if rule in rules:
            out = F.when(steps[rule], label).otherwise(out)
    return out


def preview(c: Column, limit: int = 60) -> Column:
    """The text, or its beginning and three dots."""
    t = sub(c, rf"^[{WS}]+|[{WS}]+\z", "")
    return F.when(F.length(t) > limit, F.concat(sub(F.left(t, F.lit(limit)), rf"[{WS}]+\z", ""), F.lit("..."))).otherwise(t)


# --- paths ---------------------------------------------------------------------------------------------------


def normal_path(c: Column) -> Column:
    """A relative path without . and .. steps; steps above the root are dropped."""
    steps = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))
    done = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.array_join(done, "/")


def resolved(base_dir: Column, href: Column) -> Column:
    """href against the folder of its file, fragment kept; a bare fragment and an empty href stay as they are."""
    path, has = F.substring_index(href, "#", 1), F.contains(href, F.lit("#"))
    fragment = F.when(has, F.substr(href, F.instr(href, "#")))
    full = F.concat(normal_path(F.concat_ws("/", base_dir, path)), F.coalesce(fragment, F.lit("")))
    return F.when(href == "", "").when(F.startswith(href, F.lit("#")), href).otherwise(full)
