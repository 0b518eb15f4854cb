"""Problem 4: variant spellings of the names of persons and organisations.

Every distinct spelling is parsed (titles, life dates and notes dropped, parts put in order, nicknames and
abbreviations resolved) into a canonical form; equal forms need no comparison. The distinct forms are
then joined by the pigeonhole principle: for at most ``K`` edits a form is cut into ``K`` + 1 segments,
of which one must stand unchanged in the other form, shifted by at most ``K`` places; an inverted index of
the segments is probed with the other forms' substrings and candidates are verified by a banded edit
distance. Each rare form goes to the most frequent one that is near.

Initials go to the one person of that surname they fit; where several fit they are linked to none.
Null and blank names and strings that name nobody are in no pair. Repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

#: Edits that a candidate may need (an exchange of neighbours is two), and edits that are accepted (an exchange is one).
K = 2
ACCEPTED = 1
#: A segment that so many forms share is refined.
HOT = 1_000

# --- fixed values: given names and their short forms ---------------------------------------------------------
NICKNAMES = {
    "Alexander": "Alex Sandy Alec Xander Sasha", "Andrew": "Andy Drew", "Anthony": "Tony", "Benjamin": "Ben Benny Benji", "Catherine": "Cathy Cath",
    "Charles": "Charlie Chuck Charley Chas", "Christopher": "Chris Kit Topher", "Daniel": "Dan Danny", "David": "Dave Davy", "Dorothy": "Dot Dottie Dolly Dora",
    "Edward": "Ed Eddie Ted Teddy Ned", "Elizabeth": "Liz Lizzie Beth Betty Eliza Betsy Bess Lisa Libby", "Frances": "Fanny Fran Francie Frankie", "Francis": "Frank",
    "Frederick": "Fred Freddie Fritz", "Gabriel": "Gabe", "George": "Georgie", "Gerald": "Gerry", "Henry": "Harry Hank Hal Hen", "Ines": "", "Isabella": "Bella Izzy Isa Belle",
    "James": "Jim Jimmy Jamie", "John": "Jack Johnny", "Jonathan": "Jon", "Joseph": "Joe Joey", "Josephine": "Josie Jo Posy", "Jurgen": "Jupp Jurg", "Katherine": "Kate Kathy Kath Katie Kit Kitty Kay",
    "Lawrence": "Larry", "Leonard": "Len Lenny Leo", "Margaret": "Maggie Meg Peggy Madge Greta Daisy Rita", "Martha": "Mattie", "Mary": "Molly Polly", "Matthew": "Matt", "Michael": "Mike Mick Micky",
    "Nathaniel": "Nate Nat Nathan", "Nicholas": "Nick", "Olivia": "Liv Livvy Livia Ollie", "Patricia": "Pat Trish Patty Patsy", "Peter": "Pete", "Philip": "Phil", "Rebecca": "Becky", "Rene": "Rennie", "Richard": "Dick Rick Rich Ricky Richie",
    "Robert": "Bob Rob Bobby Robbie Bert", "Samuel": "Sam Sammy", "Sarah": "Sally", "Stephen": "Steve", "Susan": "Sue", "Theodore": "Theo", "Thomas": "Tom Tommy Thom", "Ursula": "Ulla Uschi Ursel", "Victoria": "Vicky Vicki Tori Vic Viv Tory",
    "William": "Bill Will Billy Willie Liam Wim", "Zachary": "Zach Zack Zak", "Zoe": "",
}
# --- fixed values: words that stand for nobody, around names, and in names of organisations --------------------
NOBODY = {
    "", "unknown", "various", "anonymous", "anon", "none", "null", "na", "n a", "nil", "not available", "not applicable", "not known", "not given", "no author", "author unknown", "unknown author", "various authors", "unnamed", "untitled",
    "several authors", "several", "diverse", "div", "unbekannt", "anonym", "inconnu", "anonyme", "desconocido", "anonimo", "sconosciuto", "no name", "name unknown", "s n", "sn", "tba", "tbd", "multiple authors", "multiple", "collective", "the author", "author", "to be announced",
}
#: Titles before a name; those that are names too only count before two more words. What follows a name.
TITLES = set("dr prof professor mr mrs ms miss rev revd reverend capt captain herr frau mme mlle by".split())
NAME_TITLES = set("sir lady lord fr father col colonel gen hon don dona".split())
SUFFIXES = set("jr sr esq phd md".split())
DEGREES = SUFFIXES | set("ma ba mp".split())
NOTES = re.compile(r"\((?:author|ed|eds|editor|trans|translator|illustrator|writer|pseud|pseudonym|comp|compiler)\.?\)|\[[^\]]*\]", re.I)
DATES = re.compile(r"[,;]?\s*\(?\b(?:b\.|born|c\.|ca\.|fl\.)?\s*\d{3,4}\s*[-–]\s*(?:\d{2,4})?\)?|[,;]?\s*\(?\b(?:b\.|born|d\.|died)\s*\d{3,4}\)?")
ABBREVIATIONS = {
    "inst": "institute", "univ": "university", "soc": "society", "hist": "historical", "co": "company", "corp": "corporation", "pr": "press", "pres": "press", "print": "printing", "pub": "publishing", "publ": "publishing", "bros": "brothers", "assoc": "association",
    "ltd": "", "limited": "", "inc": "", "incorporated": "", "llc": "", "messrs": "", "plc": "", "gmbh": "", "the": "", "of": "", "for": "", "and": "", "de": "", "stud": "studies", "dept": "department", "lib": "library", "mus": "museum", "acad": "academy", "son": "sons",
}
ORGANISATION = set(
    "university press institute society company sons studies printing historical publishing publishers brothers corporation association library museum academy foundation college ministry department office committee council group house".split()
)


def plain(text: str) -> str:
    """Lower case, without accents and with single blanks."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(t.lower().replace("ß", "ss").split())


GIVEN = {plain(n): plain(n) for n in NICKNAMES}
SHORT: dict[str, str] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        SHORT.setdefault(plain(_s), plain(_name))


def parse(name: str) -> tuple[str, str, str, str] | None:
    """(kind, form, key, middle): kind 'p' person with a given name, 'i' person with an initial, 'o' organisation.

    form is what is compared; for 'i' it is the surname and key the initial; None if the string names nobody.
    """
    text = DATES.sub(" ", NOTES.sub(" ", name))
    low = plain(text)
    words = re.findall(r"[^\W\d_]+", low)
    if not words or " ".join(words) in NOBODY:
        return None
    flat = re.sub(r"\bu\.\s?p\.|\bup\b", " university press ", low)
    if "(" in flat:
        flat = re.sub(r"\([^)]*\)", " ", flat)
    org = [ABBREVIATIONS.get(w, w) for w in re.findall(r"[^\W\d_]+", flat)]
    org = [w for w in org if w]
    marks = sum(near_word(w) for w in org)
    if marks >= 2 or "sons" in org or "&" in low or marks and org and org[-1] in ("company", "press", "institute", "society"):
        return "o", " ".join(sorted(dict.fromkeys(correct_word(w) for w in org))), "", ""
    # persons: "Last, First M." or "First M. Last"
    parts = [p for p in (p.strip() for p in low.split(",")) if p]
    # a degree or title of its own between commas; the surname stands first
    parts = parts[:1] + [p for p in parts[1:] if p.replace(".", "") not in DEGREES | TITLES | NAME_TITLES]

    def cut(p: str, whole: bool) -> list[str]:
        w = re.findall(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*", p)
        while len(w) >= 2 and w[0] in TITLES or len(w) >= 2 + whole and w[0] in NAME_TITLES:
            w = w[1:]
        while len(w) >= 2 + whole and w[-1] in SUFFIXES:
            w = w[:-1]
        return w

    if len(parts) >= 2:
        last, first = cut(parts[0], True), cut(parts[1], False)
    else:
        w = cut(parts[0] if parts else low, True)
        if not w:
            return None
        if len(w) >= 2 and len(w[-1]) > 1 and (known(w[-1]) or near_given(w[-1])) and not known(w[0]) and len(w[0]) > 1 and not (near_given(w[0]) and not known(w[-1])):
            # "Last First" without a comma
            last, first = w[:1], w[:0:-1] if len(w) == 2 else [w[-1], *w[1:-1]]
        else:
            last, first = w[-1:], w[:-1]
            if len(last[0]) == 1 and len(w) >= 2:
                # "Last F." or "Last F M"
                last, first = w[:1], w[1:]
    if not last or not first:
        return ("p", " ".join(last or first), "", "") if last or first else None
    surname = " ".join(last)
    middle = first[1][0] if len(first) > 1 else ""
    if len(first[0]) == 1:
        return "i", surname, first[0], middle
    given = first[0]
    given = GIVEN.get(given) or SHORT.get(given) or given
    return "p", f"{given} {surname}", f"{given[0]} {surname}", middle


def known(word: str) -> bool:
    return word in GIVEN or word in SHORT


def near_given(word: str) -> bool:
    """A given name with one typing error."""
    return len(word) >= 5 and any(abs(len(g) - len(word)) <= 1 and distance(g, word, 1) <= 1 for g in GIVEN if len(g) >= 5)


def near_word(word: str) -> bool:
    return word in ORGANISATION or len(word) >= 6 and any(distance(word, o, 1) <= 1 for o in ORGANISATION if len(o) >= 6 and abs(len(o) - len(word)) <= 1)


def correct_word(word: str) -> str:
    """An organisation's common words without their typing errors."""
    if word in ORGANISATION or len(word) < 5:
        return word
    return next((o for o in sorted(ORGANISATION) if len(o) >= 5 and abs(len(o) - len(word)) <= 1 and distance(word, o, 1) <= 1), word)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with exchanges of neighbours, within a band; most + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [i if i <= most else far] + [far] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            x = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[j - 2] + 1)
            new[j] = min(x, far)
        before, row = row, new
        if min(row) > most:
            return far
    return row[len(b)]


def segments(text: str, k: int = K) -> list[tuple[int, int, str]]:
    """(number, position, text) of k + 1 segments of about equal length."""
    n = len(text)
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((i, at, text[at : at + size]))
        at += size
    return out


def probes(text: str, k: int = K) -> set[tuple[int, int, int, str]]:
    """(length of the other text, segment number, position, substring): all shifted substrings in which a text of that length
    within k edits can have an unchanged segment."""
    out = set()
    n = len(text)
    for length in range(max(1, n - k), n + k + 1):
        base, more = divmod(length, k + 1)
        at = 0
        for i in range(k + 1):
            size = base + (i >= k + 1 - more)
            # shifts are bound by the edits left on either side of the segment
            for start in range(max(0, at - k, at + (n - length) - k), min(n - size, at + k, at + (n - length) + k) + 1):
                out.add((length, i, start, text[start : start + size]))
            at += size
    return out


def split_rows(names: tuple[str, ...], cuts, more: tuple[str, ...]):
    """A batch function: each row once for each of its cuts (a function of the row), with the cut in the columns ``more``."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in (*names, *more)}
        for row in zip(*(cols[c] for c in names), strict=True):
            for cut in cuts(row):
                for c, x in zip(out, (*row, *cut), strict=True):
                    out[c].append(x)
        return out

    return run


def near_pairs(forms: DataFrame, hot: int = HOT) -> DataFrame:
    """(form, other): pairs of distinct forms of one group within the accepted distance, both ways. forms: (grp, form).

    A segment that more than ``hot`` forms share (a common surname) would give all pairs among them: what is left of such
    a form without the segment is within the edits of what is left of the other, so it is cut and joined once more.
    """

    def verify(cols: dict[str, list]) -> dict[str, list]:
        keep = [(g, a, b) for g, a, b in zip(cols["grp"], cols["form"], cols["other"], strict=True) if distance(a, b, ACCEPTED) <= ACCEPTED]
        return {"grp": [x[0] for x in keep], "form": [x[1] for x in keep], "other": [x[2] for x in keep]}

    at = ("len", "no", "start", "seg")
    left = map_batches(forms, "grp string, form string, len int, no int, start int, seg string", split_rows(("grp", "form"), lambda r: [(len(r[1]), i, at, s) for i, at, s in segments(r[1])], at))
    right = map_batches(forms.withColumnRenamed("form", "other"), "grp string, other string, len int, no int, start int, seg string", split_rows(("grp", "other"), lambda r: probes(r[1]), at))
    left, right = stage(left, "segments"), stage(right, "probes")
    key = ["grp", "len", "no", "seg"]
    shared = stage(left.groupBy(*key).count().where(F.col("count") > hot).select(*key), "hot-segments")
    joined = left.join(shared, key, "left_anti").join(right, key).select("grp", "form", "other")
    if shared.limit(1).count():
        rest = lambda r: r[-1][: r[-3]] + "\0" + r[-1][r[-3] + len(r[-2]) :]
        cols = ("grp", "len", "no", "start", "seg", "text")
        schema = "grp string, len int, no int, start int, seg string, text string, len2 int, no2 int, seg2 string"
        again = ("len2", "no2", "seg2")
        a = map_batches(left.join(shared, key, "left_semi").select("grp", "len", "no", "start", "seg", F.col("form").alias("text")), schema, split_rows(cols, lambda r: [(len(rest(r)), i, s) for i, _, s in segments(rest(r))], again))
        b = map_batches(right.join(shared, key, "left_semi").select("grp", "len", "no", "start", "seg", F.col("other").alias("text")), schema, split_rows(cols, lambda r: {(n, i, s) for n, i, _, s in probes(rest(r))}, again))
        joined = joined.unionByName(a.withColumnRenamed("text", "form").drop("start").join(b.withColumnRenamed("text", "other").drop("start"), [*key, *again]).select("grp", "form", "other"))
    candidates = joined.where("form < other").distinct()
    found = map_batches(candidates, "grp string, form string, other string", verify)
    return found.unionByName(found.select("grp", F.col("other").alias("form"), F.col("form").alias("other")))


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n): distinct strings as stored."""
    both = table(spark, sf_dir, "books").select(F.col("creator").alias("name")).unionByName(table(spark, sf_dir, "book_summaries").select(F.col("author").alias("name")))
    return both.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))


def parsed(names: DataFrame) -> DataFrame:
    """(name, n, kind, form, key, middle) of the spellings that name somebody."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"name": [], "n": [], "kind": [], "form": [], "key": [], "middle": []}
        for name, n in zip(cols["name"], cols["n"], strict=True):
            p = parse(name)
            if p:
                for c, x in zip(out, (name, n, *p), strict=True):
                    out[c].append(x)
        return out

    return map_batches(names, "name string, n long, kind string, form string, key string, middle string", run)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, entity): the spellings and the person or organisation each one names."""
    rows = stage(parsed(spellings(spark, sf_dir)), "names")
    # surnames of initials are compared with surnames, whole names with whole names
    full = rows.where("kind <> 'i'")
    surname = F.regexp_extract("form", r"^\S+ (.*)$", 1)
    forms = full.groupBy(F.col("kind").alias("grp"), "form").agg(F.sum("n").alias("n"))
    last = (
        full.where("kind = 'p'").select(surname.alias("form"), "n").unionByName(rows.where("kind = 'i'").select("form", "n"))
        .where("form <> ''").groupBy("form").agg(F.sum("n").alias("n")).select(F.lit("s").alias("grp"), "form", "n")
    )
    all_forms = stage(forms.select("grp", "form", "n").unionByName(last), "forms")
    near = near_pairs(all_forms.select("grp", "form"))
    # every form goes to the most frequent near one that is more frequent than itself
    n_of = all_forms.select("grp", F.col("form").alias("other"), F.col("n").alias("m"))
    better = (
        near.join(n_of, ["grp", "other"]).join(all_forms, ["grp", "form"])
        .where("m > n OR (m = n AND other < form)")
        .groupBy("grp", "form").agg(F.max_by("other", F.struct("m", F.col("other"))).alias("base"))
    )
    base = stage(all_forms.join(better, ["grp", "form"], "left").select("grp", "form", F.coalesce("base", "form").alias("base")), "bases")
    # a base may itself have a base: every round doubles the links followed, until no base changes
    while True:
        up = base.select("grp", F.col("form").alias("base"), F.col("base").alias("top"))
        tops = stage(base.join(up, ["grp", "base"]).select("grp", "form", F.col("top").alias("base"), (F.col("top") != F.col("base")).alias("moved")), "tops")
        base = tops.select("grp", "form", "base")
        if tops.where("moved").limit(1).count() == 0:
            break
    named = full.join(base.select(F.col("grp").alias("kind"), "form", "base"), ["kind", "form"]).select("name", "kind", "base", "middle")
    # persons of one name with different middle initials are different; without one they are the only one there is
    known_middles = named.groupBy("kind", "base").agg(F.array_remove(F.collect_set("middle"), "").alias("middles"))
    named = named.join(known_middles, ["kind", "base"]).withColumn("only", F.when(F.size("middles") <= 1, F.coalesce(F.try_element_at("middles", F.lit(1)), F.lit(""))).otherwise(""))
    who = F.concat_ws("|", "kind", "base", F.when(F.col("middle") != "", F.col("middle")).otherwise(F.col("only")))
    persons = stage(named.select("name", "kind", "base", "middle", who.alias("entity")), "persons")
    # initials: the persons of that surname (or one near it) whose given name and middle name fit
    s_base = base.where("grp = 's'").select(F.col("form").alias("surname"), F.col("base").alias("s"))
    known_persons = (
        persons.where("kind = 'p'")
        .select(F.substring("base", 1, 1).alias("initial"), F.regexp_extract("base", r"^\S+ (.*)$", 1).alias("surname"), "entity").distinct()
        .withColumn("middle_known", F.element_at(F.split("entity", r"\|"), 3)).join(s_base, "surname").select("s", "initial", "middle_known", "entity").distinct()
    )
    initials = rows.where("kind = 'i'").select("name", F.col("form").alias("surname"), F.col("key").alias("initial"), "middle").join(s_base, "surname")
    fits = (
        initials.join(known_persons, ["s", "initial"]).where("middle = '' OR middle_known = '' OR middle = middle_known")
        .groupBy("name").agg(F.countDistinct("entity").alias("persons"), F.max("entity").alias("entity"), F.max(F.when(F.col("middle") == F.col("middle_known"), F.col("entity"))).alias("exact"),
                             F.countDistinct(F.when((F.col("middle") == F.col("middle_known")) & (F.col("middle") != ""), F.col("entity"))).alias("exacts"))
    )
    one = fits.select("name", F.when(F.col("exacts") == 1, F.col("exact")).when(F.col("persons") == 1, F.col("entity")).alias("entity"))
    alone = initials.join(one, "name", "left").select(
        "name", F.coalesce("entity", F.concat_ws("|", F.lit("i"), "s", "initial", F.when(F.col("entity").isNull(), F.col("middle")))).alias("entity")
    )
    return persons.select("name", "entity").unionByName(alone)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation; the statement of the problem asks for pairs."""
    e = stage(entities(spark, sf_dir), "entities")
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the number of its entity's spellings and the entity's name."""
    e = entities(spark, sf_dir)
    size = e.groupBy("entity").agg(F.count("*").alias("spellings"), F.min("name").alias("representative"))
    return e.join(size, "entity").select("name", "representative", "spellings")


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities}
