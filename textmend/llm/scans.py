"""Problem 1: noise of scanned pages, found and repaired.

1. The corpus vocabulary is counted over all pages.
2. Each page is split into printed lines. Lines at page edges are found by shape (numbers that run on
   from printed page to printed page, whatever signs stand around them and whatever digits were misread)
   and by fuzzy repetition: lines that come again and again in the page, in other pages of its book (within two edits), or
   that repeat its heading, its book's title or its author, compared by skeletons in which characters
   that scanners confuse are equal.
3. What is left is joined into paragraphs; a word divided over two lines is put together where the
   vocabulary knows the whole, kept with its hyphen where it knows the compound.
4. Words the vocabulary doesn't know are misread if undoing one confusion (two, where signs or digits
   stand in the word) gives a word that is far more frequent.

All words are counted; the ``FREQUENT`` most frequent ones are sent to the tasks. Of the others each page gets, by a join,
the counts of those it asks for and of those that its words may be misread for, so the bound changes no result.
Null and blank pages have no defects and no paragraphs.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from collections import ChainMap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.llm.mojibake import _UNCLEAN
from textmend.llm.names import probes, segments, split_rows
from textmend.llm.normalform import transducer
from textmend.llm.quality import BULLET, INDEX, LEADERS
from textmend.llm.vocabulary import frequent, word_counts
from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

FREQUENT = 60_000
#: A known word occurs so often at least; a word is so many times as frequent as each of its misread forms (a short one
#: SHORT times that), so that what is misread doesn't depend on the size of the corpus.
LEAST = 12
SHORT = 8

# --- fixed values: what is printed and what a scanner takes it for -----------------------------------------
CONFUSIONS = {
    "e": ["c", "o"], "a": ["o"], "i": ["!", "1", "l", "|"], "t": ["f", "l"], "o": ["0", "c"], "l": ["|", "1", "!", "I", "i"], "s": ["5"], "h": ["li", "b"],
    "d": ["cl"], "m": ["rn"], "u": ["ii"], "g": ["9"], "b": ["6", "h"], "w": ["vv"], "y": ["v"], "T": ["7"], "B": ["8"], "O": ["0"], "I": ["l", "1", "|", "!"],
    "S": ["5"], "Z": ["2"], "G": ["6"], "z": ["2"], "q": ["9"], "c": ["e"], "n": ["u", "ri"], "f": ["t"], "v": ["y"], "A": ["4"], "E": ["F"], "D": ["0"],
    "in": ["m"], "li": ["h"], "ri": ["n"], "rn": ["m"], "cl": ["d"], "vv": ["w"], "ii": ["u"], "é": ["6"], "ß": ["B"],
}
_SEEN: dict[str, list[str]] = {}
for _true, _forms in CONFUSIONS.items():
    for _form in _forms:
        _SEEN.setdefault(_form, []).append(_true)
_DIGITISH = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "O": "0", "o": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "g": "9", "q": "9", "Z": "2", "z": "2", "b": "6", "G": "6", "T": "7", "D": "0", "A": "4"})
_N = r"[\dlIO|!oSsBgqZzbG]{1,4}"
# page number alone in its line, by the signs around it
PAGE_LINE = re.compile(
    rf"^(?P<indent>\s*)(?:(?P<dash>[-–—~]\s*(?P<a>{_N})\s*[-–—~])|\[\s*(?P<b>{_N})\s*\]|\(\s*(?P<g>{_N})\s*\)|(?P<word>(?:[Pp]age|[Pp]\.|[Ss]eite|[Pp]ágina|[Pp]ág\.|S\.)\s*(?P<c>{_N}))|(?P<d>{_N})\s*/\s*{_N}|(?P<e>{_N})|(?P<roman>[ivxlc]{{1,8}}))\s*$"
)
HEAD_NUMBER = re.compile(rf"^\s*(?:(?P<a>{_N})\s{{3,}}(?P<ta>\S.*?)|(?P<tb>\S.*?)\s{{3,}}(?P<b>{_N}))\s*$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_SENTENCE_END = tuple(".!?…:;”\"»’“")
_DIVISION = "-¬­‐‑⁃"
_BREAKS = frozenset(_DIVISION)
BROKEN = re.compile(rf"(?P<left>[^\W\d_|!]*[^\W_])(?P<sign>[{_DIVISION}])[ \t]*$")
_TOKEN = re.compile(r"[\w|!]+(?:[’'][\w|!]+)*")
_SPACED = re.compile(r"(?:\S ){3,}\S")
#: A sentence ends inside the line: no title.
_INSIDE = re.compile(r"[^\W\d_]{3,}[.!?;:,][”\"»’“]? ")
_ENTRY = re.compile(r"^\(?\d{1,3}[.)]\s")
_CLOSING = re.compile(r"^[^\W\d_][^.!?]{1,30},$")
_ENDS = frozenset(".,;:!?”\"»“…" + _DIVISION)
_ITEM_SIGNS = frozenset("-*•–—0123456789")
_LETTERS = re.compile(r"[^\W\d_]")


def number(text: str) -> int | None:
    """The value of a number in which digits may be misread."""
    t = text.translate(_DIGITISH)
    return int(t) if t.isdigit() and any(c.isdigit() for c in text) else None


def roman(text: str) -> int | None:
    total, last = 0, 0
    for c in reversed(text):
        v = _ROMAN[c]
        total += v if v >= last else -v
        last = max(last, v)
    back, rest = "", total
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        back += s * (rest // v)
        rest %= v
    return total if back == text else None


def skeleton(line: str) -> str:
    """Letters only, without case, accents, blanks and what scanners confuse."""
    t = "".join(c for c in unicodedata.normalize("NFKD", line) if not unicodedata.combining(c)).lower()
    t = t.translate(str.maketrans("015897624|!", "olsbgtbza" "li"))
    t = re.sub(r"[\W\d_]+", "", t)
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("in", "m"), ("ri", "n")):
        t = t.replace(a, b)
    return t.translate(str.maketrans("ceayvftijhb", "oooyyllllbb"))


def close(a: str, b: str) -> bool:
    """Edit distance of at most a sixth of the length, by a band."""
    most = max(1, min(len(a), len(b)) // 6)
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [i] + [most + 1] * len(b)
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new[lo - 1 : hi + 1]) > most:
            return False
        row = new
    return row[len(b)] <= most


def corrections(token: str, twice: bool) -> list[str]:
    """What the token may have been before one confusion, or two."""
    once = []
    for i in range(len(token)):
        for w in (1, 2):
            for true in _SEEN.get(token[i : i + w], ()) if i + w <= len(token) else ():
                once.append((token[:i] + true + token[i + w :], i + len(true)))
    out = [t for t, _ in once]
    if twice:
        out += [x for t, at in once for x, _ in _from(t, at)]
    return out


def _from(token: str, start: int) -> list[tuple[str, int]]:
    return [
        (token[:i] + true + token[i + w :], i)
        for i in range(start, len(token))
        for w in (1, 2)
        if i + w <= len(token)
        for true in _SEEN.get(token[i : i + w], ())
    ]


def candidates(token: str, twice: bool) -> Iterator[tuple[str, str]]:
    """(correction, form to look up) of the corrections that are words by their shape."""
    for c in corrections(token, twice):
        if c.isalpha() or re.fullmatch(r"[^\W\d_]+(?:[’'][^\W\d_]+)*", c):
            for form in (c, c.lower(), c.capitalize()) if not c.islower() else (c,):
                yield c, form


class Vocabulary:
    """The frequent words with their counts, and which of them are misread forms of far more frequent ones."""

    def __init__(self, counts: Mapping[str, int], asked: set[str] | None = None) -> None:
        self.counts = counts
        #: where it is given, words looked for that aren't among the counts are put into it
        self.asked = asked
        self.misread: dict[str, str] = {}
        self.cache: dict[str, str | None] = {}
        #: chunks that hold nothing but known words
        self.plain: set[str] = set()
        # rarer words aren't known anyway, and are looked at when they are met
        self._judge(counts)

    def _judge(self, counts: Mapping[str, int]) -> None:
        for w in sorted((w for w, n in counts.items() if n >= LEAST and len(w) >= 3 and "-" not in w), key=lambda w: (-counts[w], w)):
            best = self._nearest(w, twice=len(w) >= 7)
            if best is not None:
                self.misread[w] = best

    def asking(self) -> Vocabulary:
        """The same words, keeping what is looked for in vain."""
        out = copy.copy(self)
        out.asked, out.cache, out.plain = set(), {}, set()
        return out

    def with_rare(self, rare: dict[str, int]) -> Vocabulary:
        """These words and the rarer ones of one page."""
        if not rare:
            return self
        out = copy.copy(self)
        out.counts, out.misread, out.cache, out.plain = ChainMap(rare, self.counts), ChainMap({}, self.misread), {}, set()
        out._judge(rare)
        return out

    def ask(self, *words: str) -> None:
        if self.asked is not None:
            self.asked.update(w for word in words for w in (word, word.lower()) if w not in self.counts)

    def often(self, word: str) -> bool:
        return self.counts.get(word, 0) >= LEAST

    def knows(self, word: str) -> bool:
        return self.often(word) and word not in self.misread or self.often(word.lower()) and word.lower() not in self.misread

    def _nearest(self, token: str, twice: bool) -> str | None:
        """The most frequent word that may have been misread as the token, if it is frequent enough beside it."""
        best, times = None, 0
        for c, form in candidates(token, twice):
            n = self.counts.get(form, 0)
            if n > times and form not in self.misread:
                best, times = c, n
        need = (LEAST if len(token) > 4 else SHORT * LEAST) * max(1, self.counts.get(token, 0))
        return best if times >= need and (len(token) > 2 or best.islower()) else None

    def corrected(self, token: str) -> str | None:
        """The word that the token was before it was misread; None if it is a word or nothing is near."""
        if token in self.cache:
            return self.cache[token]
        if len(self.cache) > 300_000:
            self.cache.clear()
        self.cache[token] = out = self._corrected(token)
        return out

    def _corrected(self, token: str) -> str | None:
        if self.knows(token):
            return None
        if token in self.misread:
            return self.misread[token]
        letters = len(_LETTERS.findall(token))
        odd = len(token) - letters
        if letters == 0 or letters < odd and not re.search(r"[a-zà-ÿ]", token):
            return None
        if odd == 0 and (len(token) < 3 or token.isupper()) or len(token) < 2:
            return None
        return self._nearest(token, twice=odd > 0 or len(token) >= 7)


@dataclass
class Edge:
    """A line at a page edge."""

    line: int
    value: int | None = None
    title: str = ""
    bare: bool = False
    roman: bool = False


@dataclass
class Page:
    """Printed lines of a page and what is known of each."""

    lines: list[str]
    width: int = 0
    printed: bool = False
    numbers: set[int] = field(default_factory=set)
    headers: set[int] = field(default_factory=set)
    #: lines that are headers if their skeleton is known from elsewhere
    candidates: dict[int, str] = field(default_factory=dict)
    numbered: set[int] = field(default_factory=set)
    feeds: set[int] = field(default_factory=set)


def _spaced(line: str) -> bool:
    """Set in spaced letters."""
    return line.count(" ") * 3 >= len(line) and bool(_SPACED.search(line))


def layout(text: str) -> Page:
    """Split into printed lines; a page is printed if most of its lines are about as long as the longest ones."""
    page = Page([])
    for i, line in enumerate(text.split("\n")):
        if "\f" in line:
            page.feeds.add(i)
            line = line.replace("\f", "")
        page.lines.append(line)
    lengths = sorted(len(x.rstrip()) for x in page.lines if x.strip())
    if len(lengths) >= 4:
        page.width = lengths[int(len(lengths) * 0.93)]
        full = sum(n >= 0.72 * page.width for n in lengths)
        page.printed = 24 <= page.width <= 110 and full >= 0.5 * len(lengths)
        if page.printed and ("..." in text or "\t" in text or "|" in text or any(x[:1] in _ITEM_SIGNS for x in page.lines)):
            listed = sum(bool(BULLET.match(x) or LEADERS.search(x) or INDEX.match(x) or x.count("|") > 1 or "\t" in x) for x in page.lines)
            page.printed = listed < 0.3 * len(lengths)
    return page


def _ended(line: str) -> bool:
    return line.rstrip().endswith(_SENTENCE_END)


def _around(page: Page, i: int) -> tuple[str, str]:
    """The nearest lines with text before and after that are no edge lines."""
    skip = page.numbers | page.headers | page.candidates.keys()
    before = next((page.lines[j] for j in range(i - 1, -1, -1) if page.lines[j].strip() and j not in skip), "")
    after = next((page.lines[j] for j in range(i + 1, len(page.lines)) if page.lines[j].strip() and j not in skip), "")
    return before, after


def _midway(page: Page, i: int) -> bool:
    """The line cuts a sentence in two."""
    before, after = _around(page, i)
    if not before or not after:
        return False
    b = before.rstrip()
    return b[-1] in _BREAKS or b[-1] == "," or not _ended(b) and after.lstrip()[:1].islower()


def edges(page: Page) -> None:
    """Find the page numbers and headers of a page; titles seen once are left as candidates."""
    if not page.printed and not page.feeds:
        return
    filled = [i for i, x in enumerate(page.lines) if x.strip()]
    if not filled:
        return
    first = filled[0]
    found: list[Edge] = []
    for i in filled:
        line = page.lines[i]
        if i == first or len(line) > page.width + 40:
            continue
        text = line.strip()
        if len(text) <= 24 and (m := PAGE_LINE.match(line)):
            sign = next((m[g] for g in "abgcde" if m[g]), None)
            value = number(sign) if sign else roman(m["roman"])
            if value is not None:
                bare = bool(m["e"] or m["roman"] or m["g"]) and len(m["indent"]) < 8
                found.append(Edge(i, value, bare=bare, roman=bool(m["roman"])))
        elif "   " in text and ".." not in line and (m := HEAD_NUMBER.match(line)):
            title = m["ta"] or m["tb"]
            value = number(m["a"] or m["b"])
            if value is not None and len(_LETTERS.findall(title)) >= 3 and not re.search(r"\d\s{3,}|\s{3,}\d|[|;\t]", title):
                found.append(Edge(i, value, title))
    # numbers that run on: each is followed or preceded by its neighbour, about a printed page away
    run = set()
    for a in found:
        for b in found:
            if b.line > a.line + 3 and b.value - a.value in (1, 2) and (not b.bare or b.value - a.value == 1):
                run |= {a.line, b.line}
    # of bare numbers a list of consecutive lines is no sequence of pages
    for e in found:
        i = e.line
        near_feed = bool({i - 1, i, i + 1} & page.feeds)
        if e.title:
            if i in run or near_feed:
                page.headers.add(i)
                page.numbers.add(i)
                page.numbered.add(i)
            else:
                page.candidates[i] = e.title
                page.numbered.add(i)
        elif i in run or not e.bare or near_feed:
            page.numbers.add(i)
        elif e.value < 1000 and i > first + 5 and (_midway(page, i) or i == filled[-1] and not e.roman):
            # a short line with a comma at its end closes a letter; what follows it is no page number
            if i != filled[-1] or len(filled) > 8 and not _CLOSING.match(page.lines[filled[-2]].strip()):
                page.numbers.add(i)
    # titles: lines that could stand at the top of a printed page
    marks: dict[int, tuple[str, bool]] = {}
    for pos, i in enumerate(filled):
        line = page.lines[i].strip()
        if pos == 0 or i in page.numbers or i in page.candidates or not line[0].isalnum() or len(line) > max(64, page.width + 8) or line[0].islower() or _INSIDE.search(line):
            continue
        loud = line.isupper() or _spaced(line)
        if line[-1] in _ENDS and (not loud or line[-1] in ".!?,;:") or ".." in line or _ENTRY.match(line):
            continue
        beside = bool({i - 1, i + 1, i - 2, i + 2} & page.numbers) or bool({i - 1, i, i + 1} & page.feeds)
        words = [w for w in line.split() if w[0].isalpha()]
        capital = len(words) >= 2 and all(w[0].isupper() for w in words if len(w) > 3)
        short = len(line) < 0.72 * page.width and len(words) <= 9
        blanks = (i > 0 and not page.lines[i - 1].strip()) or (i + 1 < len(page.lines) and not page.lines[i + 1].strip())
        sure = loud or (short or capital) and (beside or capital or blanks or _midway(page, i))
        if (sure or beside and len(words) <= 9) and len(_LETTERS.findall(line)) >= 3:
            marks[i] = skeleton(line), sure
    by: dict[str, list[int]] = {}
    for i, (s, _) in marks.items():
        same = s if s in by else next((k for k in by if len(s) > 6 and close(k, s)), s)
        by.setdefault(same, []).append(i)
    for at in by.values():
        far = len(at) >= 2 and min(b - a for a, b in pairwise(at)) > 4
        for i in at:
            if far and (marks[i][1] or any(marks[j][1] for j in at)):
                page.headers.add(i)
            else:
                page.candidates[i] = page.lines[i].strip()
    # what stands beside a page number or a feed in the middle of a sentence can't be text
    for i in list(page.candidates):
        line = page.lines[i].strip()
        loud = line.isupper() or _spaced(line)
        beside = bool({i - 1, i + 1} & page.numbers) or bool({i - 1, i} & page.feeds)
        if i not in page.numbered and beside and (loud or len(line) < 0.72 * page.width) and _midway(page, i):
            page.headers.add(i)
            del page.candidates[i]


def heading(page: Page) -> list[str]:
    """The heading's lines and their parts: number and title may stand in one line or two."""
    block: list[str] = []
    for line in page.lines:
        if line.strip():
            block.append(line.strip())
        elif block:
            break
    # what stands before the first blank line is a heading only if it is that short
    if len(block) > 3:
        return []
    return [y for x in block if len(x) <= 70 for y in (x, *re.split(r"^\S+ \S+\.\s+", x)[1:])]


def known_headers(page: Page, titles: list[str], skeletons: set[str] = frozenset()) -> None:
    """Turn candidates into headers whose skeleton is that of a title, an author or a header of other pages."""
    if not page.candidates:
        return
    known = {skeleton(t) for t in titles if t} | set(skeletons)
    known.discard("")
    names = [sorted(skeleton(w) for w in re.findall(r"[^\W\d_]+", t) if len(w) > 1) for t in titles if t]
    for i, line in list(page.candidates.items()):
        s = skeleton(line)
        parts = sorted(skeleton(w) for w in re.findall(r"[^\W_]+", line) if len(w) > 1)
        if any(s == k or min(len(s), len(k)) > 5 and close(s, k) for k in known) or (
            len(parts) >= 2 and any(len(n) >= 2 and all(any(x == y or min(len(x), len(y)) > 4 and close(x, y) for y in n) for x in parts) for n in names)
        ):
            page.headers.add(i)
            del page.candidates[i]
            if i in page.numbered:
                page.numbers.add(i)


@dataclass
class Repair:
    paragraphs: list[str]
    hyphens: int = 0
    misread: int = 0
    unknown: list[tuple[str, str]] = field(default_factory=list)


def repair(page: Page, vocabulary: Vocabulary) -> Repair:
    """Join the lines between the edges into paragraphs and put divided and misread words right."""
    out = Repair([])
    drop = page.numbers | page.headers
    dense = page.printed
    current = ""
    gap = edge = False
    previous = ""
    first = True
    # blank lines that stand around an edge anyway; one more of them is the end of a paragraph
    around: dict[int, int] = {}
    blanks, cut = 0, False
    for i, raw in enumerate([*page.lines, "."]):
        if i in drop:
            cut = True
        elif raw.strip():
            if cut:
                around[i] = blanks
            blanks, cut = 0, False
        else:
            blanks += 1
    usual = min(around.values(), default=0)

    def flush() -> None:
        nonlocal current
        if current.strip():
            out.paragraphs.append(current.strip())
        current = ""

    for i, raw in enumerate(page.lines):
        if i in drop or i in page.feeds and not raw.strip():
            edge = True
            continue
        if not raw.strip():
            gap = True
            continue
        line = raw.strip()
        m = BROKEN.search(previous) if previous.rstrip(" \t")[-1:] in _BREAKS else None
        if m and (line[0].isalpha() or line[0] in "|!" or line[0].isdigit()) and current:
            right = _TOKEN.match(line)
            vocabulary.ask(m["left"])
            if right and (not (gap and not edge) or not vocabulary.knows(m["left"])):
                out.hyphens += 1
                left, rest = m["left"], right.group()
                whole = left + rest
                vocabulary.ask(left, rest, whole, f"{left}-{rest}")
                tail = current.rstrip()
                tail = tail[: tail.rfind(m["sign"])] if m["sign"] in tail else tail
                if not vocabulary.knows(whole) and (vocabulary.often(f"{left}-{rest}".lower()) or vocabulary.often(f"{left}-{rest}")):
                    current = tail + "-" + line
                elif not vocabulary.knows(whole) and vocabulary.corrected(whole) is None and vocabulary.knows(left) and vocabulary.knows(rest) and m["sign"] in "-‐‑":
                    current = tail + "-" + line
                else:
                    current = tail + line
                previous, gap, edge = raw, False, False
                continue
        indented = len(raw) - len(raw.lstrip()) >= 2
        if first:
            new = True
        elif not dense:
            new = True if gap or indented or not page.printed else False
        elif edge:
            short = len(previous.rstrip()) < 0.72 * page.width
            new = indented or _ended(previous) and (short or around.get(i, 0) > usual)
        else:
            new = gap or indented
        if new:
            flush()
        current = f"{current} {line}" if current else line
        previous, gap, edge, first = raw, False, False, False
    flush()
    for k, text in enumerate(out.paragraphs):
        out.paragraphs[k], n = spell(text, vocabulary)
        out.misread += n
    return out


def spell(text: str, vocabulary: Vocabulary) -> tuple[str, int]:
    """The text with misread words put right, and how many there were; a heap of signs is left as it is."""
    wrong: dict[str, str] = {}
    strange = 0
    chunks = set(text.split())
    for chunk in chunks:
        if chunk in vocabulary.plain:
            continue
        if _UNCLEAN.search(chunk) or "&#" in chunk:
            continue
        fine = True
        for t in _TOKEN.findall(chunk):
            word = t.rstrip("!|")
            if not word or word.isdigit() or vocabulary.knows(word):
                continue
            vocabulary.ask(word, *re.split(r"[’']", word))
            fine = False
            better = vocabulary.corrected(word)
            if better is None and ("’" in word or "'" in word):
                parts = re.split(r"([’'])", word)
                fixed = [vocabulary.corrected(x) or x for x in parts]
                better = "".join(fixed) if fixed != parts and all(vocabulary.knows(x) or x in "’'" or len(x) < 3 for x in fixed) else None
            if better:
                wrong[word] = better
            else:
                strange += 1
        if fine:
            if len(vocabulary.plain) > 500_000:
                vocabulary.plain.clear()
            vocabulary.plain.add(chunk)
    if not wrong or len(wrong) + strange > 0.4 * len(chunks):
        return text, 0
    return _TOKEN.sub(lambda m: wrong.get(m.group().rstrip("!|"), m.group().rstrip("!|")) + m.group()[len(m.group().rstrip("!|")) :], text), len(wrong)


def prepared(text: str) -> str:
    """Soft hyphens at line ends are signs of division; other look-alikes are brought to one form."""
    text = text.replace("\r\n", "\n")
    if "­" in text:
        text = re.sub("­[ \t]*\n", "¬\n", text)
    return transducer().apply(text)[0]


def first_repair(page: Page, vocabulary: Vocabulary) -> Repair:
    """Before the candidates are decided: one of them may stand between the halves of a word."""
    return repair(Page(page.lines, page.width, page.printed, page.numbers | {i for i in page.candidates if _midway(page, i)}, page.headers, feeds=page.feeds), vocabulary)


def analysed(pages: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(chapter_id, book_id, defect, skeleton, line): defects of each page; defect 'candidate' or 'candidate_number' if it
    depends on what the line is elsewhere, 'header_seen' for the headers that are sure."""
    schema = "chapter_id long, book_id long, defect string, skeleton string, line string"

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"chapter_id": [], "book_id": [], "defect": [], "skeleton": [], "line": []}

        def put(*row) -> None:
            for name, x in zip(out, row, strict=True):
                out[name].append(x)

        for k, b, title, text, rare in zip(cols["chapter_id"], cols["book_id"], cols["title"], cols["document"], cols["rare"], strict=True):
            if not text or not text.strip():
                continue
            page = layout(prepared(text))
            edges(page)
            known_headers(page, [*heading(page), title or ""])
            kept = dict(page.candidates)
            r = first_repair(page, vocabulary.with_rare(counts_of(rare)))
            if r.hyphens:
                put(k, b, "hyphenation", None, None)
            if r.misread:
                put(k, b, "misread", None, None)
            if page.headers:
                put(k, b, "running_header", None, None)
                for i in page.headers:
                    put(k, b, "header_seen", skeleton(page.lines[i]), None)
            if page.numbers:
                put(k, b, "page_number", None, None)
            for i, line in kept.items():
                put(k, b, "candidate_number" if i in page.numbered else "candidate", skeleton(line), line)
        return out

    return map_batches(pages.select("chapter_id", "book_id", "title", "document", "rare"), schema, run)


def counts_of(rare: list | None) -> dict[str, int]:
    return {r["word"]: r["n"] for r in rare or ()}


RARE = "array<struct<word:string,n:bigint>>"


def with_vocabulary(spark: SparkSession, pages: DataFrame, headers: DataFrame | None = None, found: tuple | None = None) -> tuple[DataFrame, Vocabulary, DataFrame | None]:
    """(pages with the column ``rare``, frequent words, rarer words): ``rare`` has the counts of the rarer words of a page, null
    if there are none. With ``headers`` (chapter_id, headers) what is asked for is asked with these headers left out."""
    if found is None:
        words = stage(word_counts(pages, "document"), "words")
        counts = frequent(words, FREQUENT, 1)
        found = Vocabulary(counts), None
        if len(counts) == FREQUENT:
            last, n = list(counts.items())[-1]
            found = found[0], words.where((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > last))
    vocabulary, words = found
    none = F.lit(None).cast(RARE).alias("rare")
    columns = ["chapter_id", "book_id", "title", "document"]
    if words is None:
        return pages.select(*columns, none), vocabulary, None
    source = pages.select(*columns, F.lit(None).cast("array<string>").alias("headers")) if headers is None else pages.select(*columns).join(headers, "chapter_id", "left")

    undecided = headers is None

    def ask(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"chapter_id": [], "token": []}
        for k, title, text, more in zip(cols["chapter_id"], cols["title"], cols["document"], cols["headers"], strict=True):
            if not text or not text.strip():
                continue
            asking = vocabulary.asking()
            page = layout(prepared(text))
            edges(page)
            known_headers(page, [*heading(page), title or ""], set(more or []))
            if undecided:
                first_repair(page, asking)
            else:
                repair(page, asking)
            out["chapter_id"] += [k] * len(asking.asked)
            out["token"] += asking.asked
        return out

    asked = stage(map_batches(source.select("chapter_id", "title", "document", "headers"), "chapter_id long, token string", ask).distinct(), "asked-words")

    def expand(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"token": [], "word": []}
        for t in cols["token"]:
            forms = {f for _, f in candidates(t, len(t) >= 7 or len(_LETTERS.findall(t)) < len(t))} - vocabulary.counts.keys()
            out["token"] += [t] * len(forms)
            out["word"] += forms
        return out

    # only a word with LEAST occurrences corrects others; where all the rarer words have fewer, nothing comes of the join
    able = words.where(F.col("n") >= LEAST)
    tokens = asked.select("token").union(able.select(F.col("word").alias("token"))).distinct()
    near = stage(map_batches(tokens, "token string, word string", expand).join(able.hint("merge"), "word"), "near-words") if able.limit(1).count() else None
    own = asked.join(words.select(F.col("word").alias("token"), "n").hint("merge"), "token").select("chapter_id", F.col("token").alias("word"), "n")
    if near is not None:
        beside = able.withColumnRenamed("word", "token").withColumnRenamed("n", "own").join(near.groupBy("token").agg(F.collect_list(F.struct("word", "n")).alias("rare")), "token", "left")

        def misread(cols: dict[str, list]) -> dict[str, list]:
            return {"word": [t for t, n, rare in zip(cols["token"], cols["own"], cols["rare"], strict=True) if t in vocabulary.with_rare(counts_of(rare) | {t: n}).misread]}

        bad = map_batches(beside.select("token", "own", "rare"), "word string", misread)
        own = own.unionByName(asked.join(near.join(bad, "word", "left_anti").hint("merge"), "token").select("chapter_id", "word", "n"))
    rare = own.distinct().groupBy("chapter_id").agg(F.collect_list(F.struct("word", "n")).alias("rare"))
    return pages.select(*columns).join(rare, "chapter_id", "left"), vocabulary, words


def book_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, titles): titles and authors under which a book is known; a few strings a book."""
    books = table(spark, sf_dir, "books").select("book_id", F.explode(F.array("title", "creator")).alias("t"))
    old = table(spark, sf_dir, "book_summaries").select("book_id", F.explode(F.array("title", "author")).alias("t"))
    return books.unionByName(old).where("t IS NOT NULL").groupBy("book_id").agg(F.collect_set("t").alias("titles"))


def near_headers(candidates: DataFrame, headers: DataFrame) -> DataFrame:
    """(chapter_id, skeleton, defect) of the candidates near a header of their book: within two edits and ``close``. Skeletons of
    a book meet in a join of their segments."""
    shortest = 7
    at = ("len", "no", "seg")
    schema = "book_id long, {} string, len int, no int, seg string"
    known = headers.where(F.length("skeleton") >= shortest).select("book_id", F.col("skeleton").alias("header"))
    asked = candidates.where(F.length("skeleton") >= shortest - 2).select("book_id", "skeleton").distinct().join(headers, ["book_id", "skeleton"], "left_anti")
    left = map_batches(known, schema.format("header"), split_rows(("book_id", "header"), lambda r: [(len(r[1]), i, s) for i, _, s in segments(r[1])], at))
    right = map_batches(asked, schema.format("skeleton"), split_rows(("book_id", "skeleton"), lambda r: {(n, i, s) for n, i, _, s in probes(r[1])}, at))
    pairs = left.join(right, ["book_id", *at]).select("book_id", "skeleton", "header").distinct()

    def verify(cols: dict[str, list]) -> dict[str, list]:
        keep = [(b, a) for b, a, h in zip(cols["book_id"], cols["skeleton"], cols["header"], strict=True) if close(a, h)]
        return {"book_id": [b for b, _ in keep], "skeleton": [a for _, a in keep]}

    near = map_batches(pairs, "book_id long, skeleton string", verify).distinct()
    return candidates.join(near, ["book_id", "skeleton"]).select("chapter_id", "skeleton", "defect")


def settled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """(chapter_id, skeleton, numbered) of the candidates that are headers: known from the book or from its other pages."""
    candidates = rows.where(F.col("defect").startswith("candidate"))
    # headers of other pages of the book: sure ones, and lines that come again in other pages
    other = (
        rows.where("skeleton IS NOT NULL AND length(skeleton) > 3").groupBy("book_id", "skeleton")
        .agg(F.countDistinct("chapter_id").alias("pages"), F.max((F.col("defect") == "header_seen").cast("int")).alias("sure"))
        .where("sure = 1 OR pages >= 3")
    )
    exact = candidates.join(other, ["book_id", "skeleton"], "left_semi").select("chapter_id", "skeleton", "defect")
    exact = exact.unionByName(near_headers(candidates, other))
    titles = book_titles(spark, sf_dir)

    def run(cols: dict[str, list]) -> dict[str, list]:
        keep = []
        for n, (line, t) in enumerate(zip(cols["line"], cols["titles"], strict=True)):
            page = Page([line], candidates={0: line})
            known_headers(page, t or [])
            if page.headers:
                keep.append(n)
        return {c: [cols[c][n] for n in keep] for c in ("chapter_id", "skeleton", "defect")}

    by_title = map_batches(
        candidates.join(titles, "book_id", "left").select("chapter_id", "skeleton", "defect", "line", "titles"), "chapter_id long, skeleton string, defect string", run
    )
    return exact.unionByName(by_title).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with each kind of scan damage it shows."""
    pages = table(spark, sf_dir, "chapters")
    asked, vocabulary, _ = with_vocabulary(spark, pages)
    rows = stage(analysed(asked, vocabulary), "scan-lines")
    sure = rows.where(F.col("defect").isin("hyphenation", "misread", "running_header", "page_number")).select("chapter_id", "defect")
    more = settled(spark, sf_dir, rows).select(
        "chapter_id", F.explode(F.when(F.col("defect") == "candidate_number", F.array(F.lit("running_header"), F.lit("page_number"))).otherwise(F.array(F.lit("running_header")))).alias("defect")
    )
    return sure.unionByName(more).distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once as continuous paragraphs, and their number."""
    pages = table(spark, sf_dir, "chapters")
    asked, vocabulary, words = with_vocabulary(spark, pages)
    rows = stage(analysed(asked, vocabulary), "scan-lines")
    headers = settled(spark, sf_dir, rows).groupBy("chapter_id").agg(F.collect_set("skeleton").alias("headers"))
    if words is not None:
        headers = stage(headers, "headers")
    once = pages.select("chapter_id", "book_id", "title", "document").dropDuplicates(["chapter_id"])
    once = with_vocabulary(spark, once, headers, (vocabulary, words))[0].join(headers, "chapter_id", "left")

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts, counts = [], []
        for title, text, more, rare in zip(cols["title"], cols["document"], cols["headers"], cols["rare"], strict=True):
            if not text or not text.strip():
                texts.append(text)
                counts.append(0)
                continue
            page = layout(prepared(text))
            edges(page)
            known_headers(page, [*heading(page), title or ""], set(more or []))
            r = repair(page, vocabulary.with_rare(counts_of(rare)))
            texts.append("\n\n".join(r.paragraphs))
            counts.append(len(r.paragraphs))
        return {"chapter_id": cols["chapter_id"], "document": texts, "paragraphs": counts}

    return map_batches(once, "chapter_id long, document string, paragraphs int", run)


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
