"""Chapter markers: a heading's style and number, as native columns.

``classify`` reads a text as label, number and title. With ``compat`` a labelled number written with a
hyphen loses what follows the hyphen ("Chapter Twenty-Seven" is 20), as an older tool had it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: number words -----------------------------------------------------------------------------
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ORDINAL_ONES = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINAL_TENS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
VALUES = {w: i + 1 for i, w in enumerate(ONES)} | {w: i + 1 for i, w in enumerate(ORDINAL_ONES)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)} | {w: 10 * (i + 2) for i, w in enumerate(ORDINAL_TENS)}
ORDINALS = ORDINAL_ONES + ORDINAL_TENS
# --- fixed values: labels, and words a title leaves in lower case ----------------------------------------------
CHAPTER_LABELS, PART_LABELS = ["chapter", "section"], ["book", "part", "volume"]
MINOR = "a an the of and or in on to for at by with".split()
MOST_WORDS, MOST_CHARS = 8, 60
MOST_GAP, LEAST_RUN, RESTART = 2, 3, 2

STYLES = {"roman": "roman numeral", "arabic": "arabic numeral", "hyphen": "hyphen-wrapped numeral", "cardinal": "spelled-out number", "ordinal": "spelled-out ordinal"}
ROMAN = r"^M*(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\z"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def roman(c: Column) -> Column:
    """Value of a canonical roman numeral, in any case; null for anything else."""
    up = F.upper(c)
    digits = F.transform(F.reverse(F.split(up, "")), lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for v in kv]), x))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    value = F.aggregate(
        F.filter(digits, lambda d: d.isNotNull()),
        start,
        lambda a, d: F.struct((a["total"] + F.when(d >= a["last"], d).otherwise(-d)).alias("total"), F.greatest(d, a["last"]).alias("last")),
        lambda a: a["total"],
    )
    return F.when((c != "") & up.rlike(ROMAN), value)


def spelled(words: Column) -> Column:
    """(used, total, ordinal) of the number words that a list of lower-case words begins with."""
    values = F.create_map(*[F.lit(v) for kv in VALUES.items() for v in kv])
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("total"), F.lit(False).alias("ordinal"), F.lit(False).alias("over"))

    def step(a: Column, w: Column) -> Column:
        v = F.element_at(values, w)
        joins = (w == "and") & (a["total"] > 0)
        hundred = (w == "hundred") & (a["total"] > 0)
        last = w.isin(ORDINALS)
        on = ~a["over"] & (joins | hundred | v.isNotNull())
        return F.struct(
            F.when(on, a["used"] + 1).otherwise(a["used"]).alias("used"),
            F.when(on, F.when(joins, a["total"]).when(hundred, a["total"] * 100).otherwise(a["total"] + v)).otherwise(a["total"]).alias("total"),
            (a["ordinal"] | (on & last)).alias("ordinal"),
            (a["over"] | ~on | last).alias("over"),
        )

    return F.aggregate(words, start, step)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")


def number_only(c: Column) -> Column:
    """(style, number) of a text that is a number and nothing else; null otherwise."""
    r, words = roman(c), _words(c)
    s = spelled(words)
    whole = (F.size(words) > 0) & (s["used"] == F.size(words)) & (s["total"] > 0)

    def is_a(style: str, n: Column) -> Column:
        return F.struct(F.lit(STYLES[style]).alias("style"), n.cast("int").alias("number"))

    return (
        F.when(c.rlike(r"^[-–—]\s*\d{1,4}\s*[-–—]\z"), is_a("hyphen", F.regexp_extract(c, r"(\d+)", 1)))
        .when(c.rlike(r"^\d{1,4}\z"), is_a("arabic", c))
        .when(r.isNotNull(), is_a("roman", r))
        .when(whole, F.struct(F.when(s["ordinal"], STYLES["ordinal"]).otherwise(STYLES["cardinal"]).alias("style"), s["total"].alias("number")))
    )


def titleish(c: Column) -> Column:
    """Reads like a title: all capitals, or every word but minor ones capitalised."""
    letters = trim(F.regexp_replace(c, r"[^A-Za-z\s]", ""))
    words = F.filter(F.split(letters, r"\s+"), lambda w: w != "")
    fine = F.forall(F.transform(words, lambda w, i: ((i > 0) & F.lower(w).isin(MINOR)) | w.rlike("^[A-Z]")), lambda b: b)
    return (letters != "") & ((letters == F.upper(letters)) | fine)


def classify(c: Column, compat: bool = False) -> Column:
    """(style, number, label, kind) of a marker; null if the text is none. kind is 'chapter', 'part' or null."""
    t = trim(c)
    head = F.regexp_extract(t, r"^(\S+)", 1)
    label = F.lower(F.regexp_replace(head, r"^[:.]+|[:.]+\z", ""))
    labelled = label.isin(CHAPTER_LABELS + PART_LABELS)
    rest = trim(F.regexp_replace(trim(F.substr(t, F.length(head) + 1)), r"^[:.\-–— ]+", ""))
    # the number ends at the first sign that begins a title; a hyphen inside a number word is none
    cut = r"[:.–—-].*\z" if compat else r"(?s)(?:[:.–—]|(?<![A-Za-z])-|-(?![A-Za-z])).*\z"
    core = trim(F.regexp_replace(rest, cut, ""))
    with_label, bare = number_only(core), number_only(t)
    lead = spelled(_words(t))
    kind = F.when(label.isin(PART_LABELS), "part").otherwise("chapter")

    def made(n: Column, has: Column, k: Column) -> Column:
        return F.struct(n["style"].alias("style"), n["number"].alias("number"), has.alias("label"), k.alias("kind"))

    none = F.lit(None).cast("string")
    spelled_out = F.struct(F.when(lead["ordinal"], STYLES["ordinal"]).otherwise(STYLES["cardinal"]).alias("style"), lead["total"].alias("number"))
    return (
        F.when(t == "", None)
        .when(labelled & (core != "") & with_label.isNotNull(), made(with_label, F.lit(True), kind))
        .when(labelled, None)
        .when(bare.isNotNull(), made(bare, F.lit(False), none))
        .when((lead["used"] > 0) & (lead["total"] > 0) & titleish(t), made(spelled_out, F.lit(False), none))
    )


def score(marker: Column, text: Column, heading: Column, css_hint: Column) -> Column:
    """Weight of a candidate by what speaks for it."""
    style = marker["style"]
    return (
        F.when(heading, 3.0).otherwise(0.0) + F.when(marker["label"], 2.5).otherwise(0.0) + F.when(css_hint, 1.5).otherwise(0.0)
        + F.when(style.isin(STYLES["roman"], STYLES["hyphen"]), 1.5).when(style.isin(STYLES["cardinal"], STYLES["ordinal"]), 1.0).when(style == STYLES["arabic"], -0.5).otherwise(0.0)
        + F.when(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= 3, 0.5).otherwise(0.0)
    )


def best_run(rows: list[tuple[int, int, float, int]]) -> tuple[float, int, list[int]]:
    """Best increasing run of candidates (order, number, score, part), given in order: (score, length, members).

    A step goes to a number one or two higher in the same part, or to at most two in a later one. Runs are compared by
    score, then by length; of equals the earliest wins. The best run that ends at each number of the current part and
    the best one of all earlier parts are all that has to be known, so the search is linear.
    """
    best: list[tuple[float, int, int]] = []
    at: dict[int, int] = {}
    part_now: int | None = None
    earlier, this = -1, -1
    for i, (_, number, value, part) in enumerate(rows):
        if part != part_now:
            # runs of the part that ends here can be gone on with at a restart
            if this >= 0 and (earlier < 0 or best[this][:2] > best[earlier][:2]):
                earlier = this
            part_now, at, this = part, {}, -1
        before = [j for j in (at.get(number - 1), at.get(number - 2), earlier if number <= RESTART and earlier >= 0 else None) if j is not None]
        top = (value, 1, -1)
        if before:
            j = min(before, key=lambda k: (-best[k][0], -best[k][1], k))
            if (best[j][0] + value, best[j][1] + 1) > top[:2]:
                top = (best[j][0] + value, best[j][1] + 1, j)
        best.append(top)
        if number not in at or top[:2] > best[at[number]][:2]:
            at[number] = i
        if this < 0 or top[:2] > best[this][:2]:
            this = i
    end = max(range(len(rows)), key=lambda k: best[k][:2])
    members, k = [], end
    while k >= 0:
        members.append(rows[k][0])
        k = best[k][2]
    return best[end][0], best[end][1], members[::-1]
