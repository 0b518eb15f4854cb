"""Problem 10: subject areas of each document.

Only a commit's message and changed lines count. The labelled snippets give the first terms of each area;
how the other words go together with the areas is counted over all documents (two rounds, each knowing
the terms of the one before), which adds the rest of the areas' vocabulary, in every language of the
corpus. Terms, source and structure of a document (merge, automatic author, binary, changes of white space
only) are the features of a classifier chain: one logistic model per area, each seeing the decisions of
those before it, so that subjects that go together are modelled. The chain is first trained on the labelled
snippets, set into commits (in the message, in changed lines, two together, beside a borrowed word). What it then says
of at most ``SAMPLE`` documents, chosen by hash, with a probability of ``SURE`` or more joins the snippets in
its second training. A fifth is held out to calibrate it. Combinations are decoded by a beam search over the
chain; a document with no other area is software.

Each document is parsed once: the words of its sentences that count are written to the shared folder, and the counts, the
sample and the labels are made of these.

The ``TERMS`` most frequent terms are sent to the tasks; of the others each document gets its own by a join, so
the bound changes no result. Sources are hashed into ``SOURCES`` features.

Null and empty texts are about nothing else either and so are software. Repeated rows are labelled alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

DEFAULT = "software"
#: Most training documents, and how sure the chain has to be of their labels.
SAMPLE = 6_000
SURE = 0.9
#: Terms sent to the tasks; sentences a term is counted in at least, as fewer say nothing; features of the sources.
TERMS = 6_000
LEAST = 8
#: Bits of the filter that the tasks ask only for words by which may be terms that aren't sent.
MARKS = 1 << 23
SOURCES = 64
BEAM = 6
#: A word is a term of an area if so much of its use falls into that area, and so many times more than chance.
SHARE = 0.3
LIFT = 3.0

_WORD = re.compile(r"[^\W\d_]+")
#: Sentences that say what a commit isn't about, or what it was found beside.
PASSING = re.compile(r"(?i)^\W*(?:(?:not|un) ?related to|found (?:while|when|during)|noticed (?:while|when)|reported (?:together|along) with|see also|by the way|inspired by|as with)\b")
_AUTOMATIC = re.compile(r"(?i)\[bot\]|\bbot\b|-bot\b|\bci-|runner|automat|robot|noreply")
_TRAILER = re.compile(r"^(?:[A-Z][\w-]+-by|Closes|Fixes|Refs|See|Issue|Cc|Change-Id)\b[:# ]")


# --- fixed values: words that say nothing of a subject ---------------------------------------------------------
COMMON = frozenset(
    "a about after all also an and any are as at be been before between both but by can could did do does done each either every few for from had has have he her here his how if in into is it its itself just keep keeps least less many may "
    "might missing more most much must neither next no nor not note of off on once one only or other our out over own same shall she should shows since so some still such than that the their them then there these they this those through to "
    "together too under until up us used very was we were what when where which while who why will with without would yet you your smallest first near counted asked wrong usual case list number numbers wip oops tmp asdf fix update misc stuff "
    "test more add".split()
)


class Commit:
    """The parts of a document that say what it is about."""

    __slots__ = ("automatic", "binary", "blank_only", "changed", "lines", "merge", "message")

    def __init__(self, text: str | None) -> None:
        self.message: list[str] = []
        self.changed: list[str] = []
        self.merge = self.automatic = self.binary = self.blank_only = False
        if not text:
            return
        lines = text.split("\n")
        header = True
        message = False
        hunk = False
        minus: list[str] = []
        plus: list[str] = []
        is_commit = text.startswith("commit ") or "\ndiff --git" in text
        if not is_commit:
            self.message = [x.strip() for x in lines if x.strip()]
            return
        for line in lines:
            first = line[:1]
            if not header:
                # most lines: context and changes of a hunk
                if first == " ":
                    continue
                if hunk and first == "+":
                    if line.startswith("+++ b/"):
                        continue
                    plus.append(line[1:])
                elif hunk and first == "-":
                    if line.startswith("--- a/"):
                        continue
                    minus.append(line[1:])
                elif first == "@":
                    hunk = hunk or line.startswith("@@")
                elif first in "dGB" and line.startswith(("diff --git", "GIT binary patch", "Binary files")):
                    hunk = False
                    self.binary = self.binary or first != "d"
                continue
            if line.startswith("diff --git"):
                header = hunk = False
            elif line.startswith("    ") or message and first == "\t":
                message = True
                if line.strip():
                    self.message.append(line.strip())
            elif line.startswith("Merge:"):
                self.merge = True
            elif line.startswith("Author:"):
                self.automatic = bool(_AUTOMATIC.search(line))
            elif message and line.strip() and not re.match(r"^[A-Z][A-Za-z]+:", line):
                self.message.append(line.strip())
        # lines that only changed their white space say nothing
        if not (minus and plus):
            self.changed = [x for x in minus or plus if x.strip()]
            return
        same = Counter("".join(x.split()) for x in minus) & Counter("".join(x.split()) for x in plus)
        self.blank_only = sum(same.values()) == max(len(minus), len(plus))
        if not any(same):
            self.changed = [x for x in minus + plus if x.strip()]
            return
        for side in (minus, plus):
            left = Counter(same)
            for x in side:
                key = "".join(x.split())
                if left[key] > 0:
                    left[key] -= 1
                elif x.strip():
                    self.changed.append(x)

    def told(self) -> list[tuple[bool, str]]:
        """(in the message, line) of all lines that count."""
        # merges and changes of white space are about no area
        if self.merge or self.blank_only:
            return []
        out = [(True, x) for x in self.message if not PASSING.match(x) and not _TRAILER.match(x)]
        return out + [(False, x) for x in self.changed if not PASSING.match(x.lstrip(" #/*-"))]


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sentences(line: str) -> list[str]:
    """The distinct words of each of a line's sentences, with blanks between them; a word holds letters only."""
    low = line.lower()
    if ". " not in low and "? " not in low and "! " not in low:
        w = dict.fromkeys(_WORD.findall(low))
        return [" ".join(w)] if w else []
    return [" ".join(w) for s in _SENTENCE.split(low) if (w := dict.fromkeys(_WORD.findall(s)))]


#: What a document says: sentences of the message's first line, of its other lines and of the changed lines, one below the
#: other; structure has a bit for each of merge, automatic, binary, blank_only, nothing changed, short message.
SAID = ("subject", "message", "changed")


def said(text: str | None) -> tuple[str, str, str, int]:
    """The columns of ``SAID`` and the structure of a document."""
    c = Commit(text)
    parts: tuple[list[str], list[str], list[str]] = ([], [], [])
    k = 0
    for message, line in c.told():
        parts[k if message else 2].extend(sentences(line))
        k = 1
    structure = (c.merge, c.automatic, c.binary, c.blank_only, not c.changed, len(c.message) <= 1)
    return "\n".join(parts[0]), "\n".join(parts[1]), "\n".join(parts[2]), sum(x << i for i, x in enumerate(structure))


class Terms:
    """Terms with their weight in each area."""

    def __init__(self, areas: list[str], weights: Mapping[str, list[float]], rare: DataFrame | None = None) -> None:
        self.areas = areas
        self.weights: dict[str, tuple[tuple[int, float], ...]] | Both = {w: _positive(v) for w, v in weights.items()}
        self.seen: dict[str, tuple[int, int, float]] = {}
        #: (word, weights) of the terms that aren't sent to the tasks, and their filter
        self.rare = rare
        self.marks = b"" if rare is None else marks(rare)

    def with_rare(self, rare: list | None) -> Terms:
        """These terms and the rarer ones of one document."""
        if not rare:
            return self
        out = Terms(self.areas, {})
        out.weights = Both({r["word"]: _positive(r["weights"]) for r in rare}, self.weights)
        return out

    def get(self, word: str) -> tuple[tuple[int, float], ...] | None:
        """(area, weight) pairs of a term; plural and singular forms share one."""
        v = self.weights.get(word)
        if v is None and word[-1] == "s" and len(word) > 3:
            v = self.weights.get(word[:-1])
        return v

    def joined(self, other: Terms) -> Terms:
        """These terms where the other ones have none."""
        out = Terms(self.areas, {})
        out.weights = dict(self.weights) | dict(other.weights)
        return out

    def score(self, words: list[str]) -> tuple[int, int, float]:
        """(best area or -1, distinct terms of it, margin over the next one) of a sentence."""
        total: dict[int, float] = {}
        n: dict[int, int] = {}
        get = self.weights.get
        for w in words:
            v = get(w)
            if v is None:
                if w[-1] != "s" or (v := get(w[:-1])) is None or len(w) <= 3:
                    continue
            for i, x in v:
                total[i] = total.get(i, 0.0) + x
                if x >= SHARE:
                    n[i] = n.get(i, 0) + 1
        if not total:
            return -1, 0, 0.0
        if len(total) == 1:
            best = next(iter(total))
            return best, n.get(best, 0), total[best]
        best = min(total, key=lambda i: (-total[i], i))
        return best, n.get(best, 0), total[best] - max(x for i, x in total.items() if i != best)

    def sentence(self, sentence: str) -> tuple[int, int, float]:
        """Score of a sentence; sentences are often repeated and so are remembered."""
        out = self.seen.get(sentence)
        if out is None:
            out = self.score(sentence.split(" "))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[sentence] = out
        return out

    def __getstate__(self) -> dict:
        return {"areas": self.areas, "weights": self.weights, "seen": {}, "rare": None, "marks": self.marks}


class Both:
    """Lookup in a document's own terms, then in those sent."""

    __slots__ = ("own", "sent")

    def __init__(self, own: dict, sent: dict) -> None:
        self.own = own
        self.sent = sent

    def get(self, word: str) -> tuple[tuple[int, float], ...] | None:
        v = self.own.get(word)
        return self.sent.get(word) if v is None else v


def marks(words: DataFrame) -> bytes:
    """A bit for each word, at its checksum: other words may share it, but no word is without."""
    at = words.select(F.pmod(F.crc32("word"), F.lit(MARKS)).alias("at"))
    rows = at.groupBy(F.expr("at div 64").alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).collect()
    out = bytearray(MARKS // 8)
    for k, bits in rows:
        out[8 * k : 8 * k + 8] = (bits & (1 << 64) - 1).to_bytes(8, "little")
    return bytes(out)


def marked(word: str, bits: bytes) -> int:
    at = zlib.crc32(word.encode()) % MARKS
    return bits[at >> 3] >> (at & 7) & 1


def _positive(v: list[float]) -> tuple[tuple[int, float], ...]:
    return tuple((i, x) for i, x in enumerate(v) if x > 0)


FEATURES = 6


def features(text: str | None, terms: Terms) -> np.ndarray:
    """(areas, FEATURES) of a document: strong and weak sentences of the message and of the changed lines, in the
    subject line, and the share of the document's evidence; the last row holds its structure."""
    *parts, structure = said(text)
    return dense(evidence(*parts, terms), structure, len(terms.areas))


def evidence(subject: str, message: str, changed: str, terms: Terms) -> tuple[tuple[int, int], ...]:
    """(place in the features, number of sentences) of what a document says, in order."""
    out: dict[int, int] = {}
    for k, part in enumerate((subject, message, changed)):
        if part:
            for sentence in part.split("\n"):
                best, n, margin = terms.sentence(sentence)
                if n and margin > 0.05:
                    at = best * FEATURES + (0 if n >= 2 else 2) + (k == 2)
                    out[at] = out.get(at, 0) + 1
                    if k == 0:
                        at = best * FEATURES + 4
                        out[at] = out.get(at, 0) + 1
    return tuple(sorted(out.items()))


def dense(found: tuple[tuple[int, int], ...], structure: int, areas: int) -> np.ndarray:
    """The features of a document by its evidence and structure."""
    out = np.zeros((areas + 1, FEATURES))
    for at, n in found:
        out.flat[at] = n
    total = out[:-1, :4].sum()
    if total:
        out[:-1, 5] = out[:-1, :4].sum(axis=1) / total
    out[-1] = [structure >> i & 1 for i in range(FEATURES)]
    return out


def source_feature(source: str | None) -> int:
    return -1 if source is None else zlib.crc32(source.encode()) % SOURCES


def matrix(f: np.ndarray, area: int, previous: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Inputs of one model of the chain for documents f (n, areas + 1, FEATURES); the earlier decisions come last."""
    n = len(f)
    mine = f[:, area, :5]
    others = np.delete(f[:, :-1], area, axis=1)
    hot = np.zeros((n, SOURCES))
    hot[np.nonzero(source >= 0)[0], source[source >= 0]] = 1
    rest = np.stack([np.log1p(others[:, :, 0].sum(axis=1)), np.log1p(others[:, :, 1:4].sum(axis=(1, 2))), (others[:, :, :5].sum(axis=(1, 2)) == 0).astype(float)], axis=1)
    return np.concatenate([np.ones((n, 1)), np.log1p(mine), f[:, area, 5:6], mine > 0, rest, f[:, -1], hot, previous], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """Classifier chain with calibrated probabilities and beam search."""

    def __init__(self, areas: list[str]) -> None:
        self.areas = areas
        # the default area comes last, when all others are decided
        self.order = [i for i, a in enumerate(areas) if a != DEFAULT] + [areas.index(DEFAULT)]
        self.models: list[np.ndarray] = []
        self.scale: list[tuple[float, float]] = []

    def fit(self, docs: np.ndarray, source: np.ndarray, labels: np.ndarray) -> None:
        n = len(docs)
        held = np.arange(n) % 5 == 0
        for k, a in enumerate(self.order):
            done = np.zeros((n, len(self.areas)))
            for b in self.order[:k]:
                done[:, b] = labels[:, b]
            x = matrix(docs, a, done, source)
            y = labels[:, a].astype(float)
            w = fit_logistic(x[~held], y[~held])
            # Platt scaling on the held-out part
            z = x[held] @ w
            a1, a0 = fit_logistic(np.stack([z, np.ones_like(z)], axis=1), y[held], penalty=1e-2) if 0 < y[held].sum() < held.sum() else (1.0, 0.0)
            self.models.append(w)
            self.scale.append((float(a1), float(a0)))

    def decode_all(self, docs: np.ndarray, source: np.ndarray) -> list[list[int]]:
        """The most probable combination of areas of each document."""
        return [y for y, _ in self.decoded(docs, source)]

    def decoded(self, docs: np.ndarray, source: np.ndarray) -> list[tuple[list[int], float]]:
        """The most probable combination of areas of each document, with its probability."""
        areas = len(self.areas)
        none = self.areas.index(DEFAULT)
        if not len(docs) or not self.models:
            return [([none], 1.0) for _ in docs]
        # the part of each model's sum that earlier decisions don't touch, for all documents at once
        nothing = np.zeros((len(docs), areas))
        base = [(matrix(docs, a, nothing, source) @ w).tolist() for w, a in zip(self.models, self.order, strict=True)]
        after = [w[-areas:].tolist() for w in self.models]
        silent = ~docs[:, :-1, :4].any(axis=(1, 2))
        return [([none], 1.0) if silent[n] else self._beam([b[n] for b in base], after) for n in range(len(docs))]

    def _beam(self, base: list[float], after: list[list[float]]) -> tuple[list[int], float]:
        beam: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for k, a in enumerate(self.order):
            a1, a0 = self.scale[k]
            wider = []
            for logp, y in beam:
                z = a1 * (base[k] + sum([after[k][i] for i in y])) + a0
                p = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
                if p < 0.999:
                    wider.append((logp + math.log(max(1 - p, 1e-9)), y))
                if p > 0.001:
                    wider.append((logp + math.log(max(p, 1e-9)), (*y, a)))
            beam = sorted(wider, key=lambda t: -t[0])[:BEAM] if len(wider) > 1 else wider
        best = next(((sorted(y), math.exp(p)) for p, y in beam if y), None)
        return best or ([self.areas.index(DEFAULT)], math.exp(beam[0][0]))

    def decode(self, f: np.ndarray, source: int) -> list[int]:
        return self.decode_all(f[None], np.array([source]))[0]


def first_terms(samples: list[tuple[str, str]]) -> Terms:
    """Terms of the labelled snippets: words used in one area only."""
    areas = sorted({a for a, _ in samples})
    used: dict[str, Counter[str]] = defaultdict(Counter)
    for a, t in samples:
        for w in set(_WORD.findall(t.lower())):
            used[w][a] += 1
    weights = {w: [float(c[a] > 0) for a in areas] for w, c in used.items() if len(c) == 1 and len(w) > 2}
    return Terms(areas, weights)


def parsed(documents: DataFrame) -> DataFrame:
    """What each document says, with its structure, written once."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        parts = zip(*map(said, cols["text"]), strict=True) if cols["text"] else [[]] * 4
        return {"doc_id": cols["doc_id"], "source": cols["source"], **dict(zip((*SAID, "structure"), map(list, parts), strict=True))}

    schema = "doc_id long, source string, subject string, message string, changed string, structure int"
    return stage(map_batches(documents.select("doc_id", "text", "source"), schema, run), "said")


def term_counts(documents: DataFrame, terms: Terms) -> DataFrame:
    """(word, area, n) of parsed documents: sentences with the word that go to the area; area '' counts all sentences with it.
    A sentence goes to the area of its known terms, or else to that of its document if one area has most of that."""
    areas = terms.areas

    def run(cols: dict[str, list]) -> dict[str, list]:
        every: Counter[str] = Counter()
        going: list[Counter[str]] = [Counter() for _ in areas]
        for *parts, rare in zip(*(cols[x] for x in SAID), cols["rare"], strict=True):
            known = terms.with_rare(rare)
            told = [x for part in parts if part for x in part.split("\n")]
            scores = [known.sentence(x) for x in told]
            votes: dict[int, int] = {}
            for best, k, m in scores:
                if k and m > 0.05:
                    votes[best] = votes.get(best, 0) + k
            top = max(votes, key=votes.__getitem__, default=-1)
            whole = top if top >= 0 and votes[top] >= 3 and votes[top] >= 0.75 * sum(votes.values()) else -1
            for x, (best, k, m) in zip(told, scores, strict=True):
                words = x.split(" ")
                every.update(words)
                to = best if best >= 0 and (k >= 2 or best == whole) and m > 0.05 else whole if best < 0 else -1
                if to < 0:
                    continue
                # a word doesn't speak for itself: its sentence or document has to go to the area without it
                if k < 2 and not (to == whole and votes[to] >= 4):
                    words = [w for w in words if not any(i == to and share >= SHARE for i, share in known.get(w) or ())]
                going[to].update(words)
        counts = [(w, a, n) for a, c in [("", every), *zip(areas, going, strict=True)] for w, n in c.items() if w not in COMMON]
        return {"word": [w for w, _, _ in counts], "area": [a for _, a, _ in counts], "n": [n for _, _, n in counts]}

    return map_batches(attach(documents, terms).select(*SAID, "rare"), "word string, area string, n long", run).groupBy("word", "area").agg(F.sum("n").alias("n"))


RARE = "array<struct<word:string,weights:array<double>>>"


def attach(documents: DataFrame, terms: Terms) -> DataFrame:
    """The parsed documents with the column ``rare``: those of their terms that aren't sent to the tasks, null if there are none."""
    asks: dict[str, bool] = {}
    if terms.rare is None:
        return documents.withColumn("rare", F.lit(None).cast(RARE))

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "word": []}
        if len(asks) > 200_000:
            asks.clear()
        for k, *parts in zip(cols["doc_id"], *(cols[x] for x in SAID), strict=True):
            found = {w for part in parts for w in part.split()}
            found |= {w[:-1] for w in found if w[-1] == "s" and len(w) > 3}
            for w in found:
                ask = asks.get(w)
                if ask is None:
                    ask = asks[w] = w not in terms.weights and w not in COMMON and bool(marked(w, terms.marks))
                if ask:
                    out["doc_id"].append(k)
                    out["word"].append(w)
        return out

    asked = map_batches(documents.select("doc_id", *SAID), "doc_id long, word string", run)
    # a document has at most its own words
    own = asked.join(terms.rare.hint("merge"), "word").groupBy("doc_id").agg(F.collect_set(F.struct("word", "weights")).alias("rare"))
    return documents.join(own.hint("merge"), "doc_id", "left")


def more_terms(counts: DataFrame, areas: list[str], most: int | None = None) -> Terms:
    """The words whose use falls mostly into few areas, the ``most`` most frequent ones (``TERMS``) apart from the rest."""
    most = TERMS if most is None else most
    by_area = counts.where("area <> ''")
    sums = {r["area"]: r["n"] for r in by_area.groupBy("area").agg(F.sum("n").alias("n")).collect()}
    all_n = sum(sums.values()) or 1
    # the expected shares are those of the areas; a general word has about these
    least = [max(SHARE, min(0.85, LIFT * (sums.get(a, 0) + 1) / (all_n + len(areas)))) for a in areas]
    share = [F.coalesce(F.element_at("c", F.lit(a)), F.lit(0)) / F.col("n") for a in areas]
    found = (
        by_area.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("area", "n"))).alias("c"), F.sum("n").alias("n"))
        .where((F.col("n") >= LEAST) & (F.length("word") > 2))
        .join(counts.where("area = ''").select("word", F.col("n").alias("all")), "word")
        .where("n >= 0.25 * all")
        .select("word", "n", F.array(*[F.when(s >= x, s).otherwise(0.0) for s, x in zip(share, least, strict=True)]).alias("weights"))
        .where(F.exists("weights", lambda x: x > 0))
    )
    found = stage(found, "terms")
    rows = found.orderBy(F.desc("n"), "word").limit(most + 1).collect()
    sent = rows[:most]
    rest = None
    if len(rows) > most:
        last = (sent[-1]["n"], sent[-1]["word"]) if sent else (None, None)
        rest = (found.where((F.col("n") < last[0]) | (F.col("n") == last[0]) & (F.col("word") > last[1])) if sent else found).select("word", "weights")
    return Terms(areas, {r["word"]: r["weights"] for r in sent}, rest)


def learn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Terms, Chain]:
    """The parsed documents, terms from all of them, and the chain trained on the snippets and a bounded sample of the documents."""
    samples = [(r["subject_area"], r["sample_text"]) for r in table(spark, sf_dir, "subject_samples").where("subject_area IS NOT NULL AND sample_text IS NOT NULL").orderBy("sample_id").collect()]
    documents = parsed(table(spark, sf_dir, "documents"))
    terms = first_terms(samples)
    for _ in range(2):
        terms = more_terms(stage(term_counts(documents, terms), "term-counts"), terms.areas)
    total = documents.count()
    part = min(1.0, SAMPLE / max(1, total))
    chosen = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [dense(evidence(*parts, terms.with_rare(r)), t, len(terms.areas)).ravel().tolist() for *parts, t, r in zip(*(cols[x] for x in SAID), cols["structure"], cols["rare"], strict=True)]
        return {"doc_id": cols["doc_id"], "source": [source_feature(s) for s in cols["source"]], "x": rows}

    rows = map_batches(attach(chosen, terms), "doc_id long, source int, x array<double>", run).orderBy("doc_id").limit(SAMPLE).collect()
    # the snippets' own words are terms of their areas here too, whatever their use elsewhere
    given = composed(samples, first_terms(samples).joined(terms))
    docs = np.array([np.reshape(r["x"], (-1, FEATURES)) for r in rows]) if rows else np.zeros((0, len(terms.areas) + 1, FEATURES))
    return documents, terms, trained(terms.areas, docs, np.array([r["source"] for r in rows], dtype=np.int64), given)


def trained(areas: list[str], docs: np.ndarray, source: np.ndarray, given: list[tuple[np.ndarray, np.ndarray]]) -> Chain:
    """A chain trained on labelled rows, then on them and on the documents that it is sure of."""
    first = Chain(areas)
    if not given:
        return first
    x, y = np.array([f for f, _ in given]), np.array([y for _, y in given])
    none = np.full(len(x), -1, dtype=np.int64)
    first.fit(x, none, y)
    sure = [(n, labels) for n, (labels, p) in enumerate(first.decoded(docs, source)) if p >= SURE]
    more = np.zeros((len(sure), len(areas)), dtype=bool)
    for k, (_, labels) in enumerate(sure):
        more[k, labels] = True
    at = [n for n, _ in sure]
    chain = Chain(areas)
    chain.fit(np.concatenate([x, docs[at]]), np.concatenate([none, source[at]]), np.concatenate([y, more]))
    return chain


def as_commit(message: list[str], changed: list[str]) -> str:
    body = "\n\n".join(f"    {m}" for m in message)
    return f"commit 0\nAuthor: a <a@x>\n\n{body}\n\ndiff --git a/x b/x\n@@ -1 +1 @@\n" + "\n".join(f"+{c}" for c in changed)


def composed(samples: list[tuple[str, str]], terms: Terms) -> list[tuple[np.ndarray, np.ndarray]]:
    """The labelled snippets as training rows: set into commits alone, beside one of another area (with both labels), and
    beside a line with one borrowed word of another area (without its label)."""
    out = []
    by_area: dict[int, list[str]] = defaultdict(list)
    for w, v in terms.weights.items():
        if len(v) == 1 and v[0][1] >= SHARE:
            by_area[v[0][0]].append(w)
    for i, (a, t) in enumerate(samples):
        subject, *rest = [x for x in _SENTENCE.split(t) if x] or [t]
        texts = [(t, [a]), (as_commit([subject, *rest], ["value"]), [a]), (as_commit([subject], rest), [a]), (as_commit(["Update"], [subject, *rest]), [a])]
        # each sentence alone is about the area too: as the subject line, below another one, and twice
        for x in (subject, *rest):
            texts += [(as_commit([x], ["value"]), [a]), (as_commit(["Update", x], ["value"]), [a]), (as_commit(["Update", x, x], ["value"]), [a])]
        for step in (9, 17, 31):
            b, u = samples[(i + step) % len(samples)]
            if a != b:
                texts += [(f"{t}\n{u}", [a, b]), (as_commit([t, u], ["value"]), [a, b]), (as_commit([t], _SENTENCE.split(u)), [a, b])]
                texts += [(as_commit([subject, x], ["value"]), [a, b]) for x in _SENTENCE.split(u) if x]
                texts += [(as_commit([subject, *rest, x], ["value"]), [a, b]) for x in _SENTENCE.split(u) if x]
                texts += [(as_commit([subject, *rest, x], [subject, *rest] * (1 + k)), [a, b]) for k, x in enumerate(x for x in _SENTENCE.split(u) if x)]
                texts += [(as_commit([subject, *_SENTENCE.split(u)], rest * 4), [a, b]), (as_commit([subject, *rest], [subject, *rest, *_SENTENCE.split(u)]), [a, b])]
                words = sorted(by_area[terms.areas.index(b)])
                if words:
                    borrowed = f"and then the {words[(7 * i + step) % len(words)]} of it"
                    texts += [(as_commit([t], [*rest, borrowed]), [a]), (as_commit([t, borrowed], rest), [a])]
        for text, labels in texts:
            y = np.zeros(len(terms.areas), dtype=bool)
            y[[terms.areas.index(x) for x in labels]] = True
            out.append((features(text, terms), y))
    return out


def labelled(documents: DataFrame, terms: Terms, chain: Chain) -> DataFrame:
    """(doc_id, source, subject_area) of every parsed document and area."""
    remembered: dict[tuple, list[int]] = {}

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "source": [], "subject_area": []}
        if len(remembered) > 200_000:
            remembered.clear()
        # documents with the same features are decoded once
        names = [(evidence(*parts, terms.with_rare(r)), t, source_feature(s)) for *parts, t, s, r in zip(*(cols[x] for x in SAID), cols["structure"], cols["source"], cols["rare"], strict=True)]
        new = list(dict.fromkeys(n for n in names if n not in remembered))
        if new:
            found = chain.decode_all(np.array([dense(e, t, len(terms.areas)) for e, t, _ in new]), np.array([s for _, _, s in new]))
            remembered.update(zip(new, found, strict=True))
        for k, s, n in zip(cols["doc_id"], cols["source"], names, strict=True):
            for a in remembered[n]:
                for name, v in zip(out, (k, s, terms.areas[a]), strict=True):
                    out[name].append(v)
        return out

    return map_batches(attach(documents, terms), "doc_id long, source string, subject_area string", run)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each of its subject areas."""
    documents, terms, chain = learn(spark, sf_dir)
    return labelled(documents, terms, chain).select("doc_id", "subject_area").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and subject area; a document counts in each of its areas."""
    documents, terms, chain = learn(spark, sf_dir)
    return labelled(documents, terms, chain).distinct().groupBy("source", "subject_area").agg(F.count("*").alias("documents"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
