"""Problem 8: evaluation items that stand in the training text.

Texts become sequences of words (runs of letters and digits, case dropped), so that punctuation, line
breaks and the marks of diff lines and comments don't count. Items are put into classes by the length of
their shortest passage that counts (half of the item); each class has windows of two thirds of that
length, laid over items at every word and over documents at a stride that every passage must contain in
full. Each window is embedded by a CGK random walk (edit distance of sequences becomes Hamming distance of
their embeddings); repeated bit-sampling LSH puts a window into one bucket per repetition, and a document
window in an item's bucket is a candidate. Equal windows always meet; of windows with a tenth of their
words edited at least nine in ten do (tests/llm measures it).

A candidate is verified exactly: banded edit distance of the windows, then the least edit distance between
a passage of half of the item and the document. Distance 0 is a leak; up to a tenth of the passage is an
edited leak. Whole texts are read; nothing is capped.

Items of at most ``BROADCAST_KEYS`` bucket keys, by a bound from their lengths, are sent to the tasks; more
are joined with the documents' windows by bucket. Null and empty texts have no windows; repeated rows count once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

#: Repetitions and sampled positions of the LSH (short windows: half of their words), and the share of words that may be edited.
REPETITIONS = 14
SAMPLED = 7
EDITS = 0.1
#: Passages of one class differ in length by less than this factor.
CLASS = 1.5
BROADCAST_KEYS = 4_000_000
SEED = 20240817

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w, SEED) >> 1
        if len(self) > 1_000_000:
            self.clear()
        self[w] = h
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: well-mixed bits of x and a salt."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def need(n: int) -> int:
    """Words of an item of n words that have to stand in a document."""
    return (n + 1) // 2


def length_class(passage: int) -> int:
    c = int(math.log(passage, CLASS))
    return c + (math.ceil(CLASS ** (c + 1)) <= passage) - (math.ceil(CLASS**c) > passage)


def window(c: int) -> tuple[int, int]:
    """(words, stride) of the windows of a class: its shortest passage holds a whole window at every stride."""
    shortest = max(1, math.ceil(CLASS**c))
    w = max(1, (2 * shortest + 2) // 3)
    return w, max(1, shortest - w + 1)


class Walks:
    """The random bits of the words of a sequence of hashes: 64 steps of a repetition at a time, made once."""

    def __init__(self, h: np.ndarray) -> None:
        self.h = h
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def bits(self, repetition: int, block: int) -> np.ndarray:
        key = repetition, block
        if key not in self.made:
            self.made[key] = _mix(self.h, SEED + 7919 * repetition + 104729 * (block + 1))
        return self.made[key]

    def buckets(self, starts: np.ndarray, w: int) -> np.ndarray:
        """(n, REPETITIONS) bucket keys of the windows of w words that begin at ``starts``.

        CGK: the walk copies the word it stands on and goes on by one or none, by a random bit of step and word. A walk
        of w steps can't leave its window. Each repetition hashes a sample of positions of its own embedding.
        """
        keys = np.empty((len(starts), REPETITIONS), dtype=np.uint64)
        one, times = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
        for r in range(REPETITIONS):
            sample = set(np.random.default_rng(SEED + r).choice(w, size=min(SAMPLED, (w + 1) // 2), replace=False).tolist())
            at = starts.astype(np.int64)
            key = np.full(len(starts), SEED + 31 * w + r, dtype=np.uint64)
            last = max(sample)
            for j in range(last + 1):
                if j in sample:
                    key = key * times + self.h[at]
                if j < last:
                    at += (self.bits(r, j // 64)[at] >> np.uint64(j % 64) & one).view(np.int64)
            keys[:, r] = _mix(key, 0)
        return keys


def document_starts(n: int, c: int) -> np.ndarray:
    """Where the windows of a class begin in a document of n words; the last one ends with the document."""
    w, stride = window(c)
    if n < w:
        return np.empty(0, dtype=np.int64)
    at = np.arange(0, n - w + 1, stride)
    return at if at[-1] == n - w else np.append(at, n - w)


def within(a: list[str], b: list[str], most: int) -> bool:
    """Edit distance of word sequences of at most ``most``, by a band."""
    if a == b:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def placed(passage: list[str], text: list[str], most: int) -> int:
    """Least edit distance between the passage and any part of the text; most + 1 if it is larger."""
    row = [0] * (len(text) + 1)
    for x in passage:
        new = [row[0] + 1]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row)


def longest_run(item: list[str], doc: list[str], shifts: set[int]) -> int:
    """Longest run of item words that stands without a gap in the document, over the given alignments."""
    best = 0
    for s in shifts:
        run = 0
        for p in range(max(0, -s), min(len(item), len(doc) - s)):
            run = run + 1 if item[p] == doc[p + s] else 0
            best = max(best, run)
    return best


def verify(item: list[str], doc: list[str], near: list[tuple[int, int]], w: int) -> tuple[int, int] | None:
    """(edits, longest run) of an item in a document, given the (item position, document position) of candidate windows;
    None if no passage of half of the item stands there with at most a tenth of it edited."""
    size = need(len(item))
    most = int(EDITS * size)
    near = [(p, d) for p, d in near if within(item[p : p + w], doc[d : d + w], max(1, most))]
    if not near:
        return None
    run = longest_run(item, doc, {d - p + e for p, d in near for e in range(-most, most + 1)})
    if run >= size:
        return 0, run
    best = most + 1
    for p, d in near:
        for q in range(max(0, p + w - size), min(p, len(item) - size) + 1):
            if best <= 1:
                break
            begin = max(0, d - p + q - most)
            best = min(best, placed(item[q : q + size], doc[begin : d - p + q + size + most], best - 1))
    return (best, run) if best <= most else None


def signatures(windows: np.ndarray) -> np.ndarray:
    """(n, 2) two times 64 bits, one set by each word of a window."""
    one = np.uint64(1)
    return np.stack([np.bitwise_or.reduce(one << (windows >> np.uint64(s) & np.uint64(63)), axis=1) for s in (0, 6)], axis=1)


class Items:
    """The items' words and the buckets of their windows, by class."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.words = {i: w for i, t in rows if t and (w := words(t))}
        self.ids = sorted(self.words)
        hashes = _Hashes()
        classes: dict[int, list[int]] = defaultdict(list)
        for n, i in enumerate(self.ids):
            classes[length_class(need(len(self.words[i])))].append(n)
        self.index: dict[int, tuple[np.ndarray, ...]] = {}
        for c, numbers in classes.items():
            w, _ = window(c)
            keys, item, pos, views = [], [], [], []
            for n in numbers:
                h = hashes.of(self.words[self.ids[n]])
                starts = np.arange(len(h) - w + 1)
                keys.append(Walks(h).buckets(starts, w))
                item.append(np.full(len(starts), n))
                pos.append(starts)
                views.append(np.lib.stride_tricks.sliding_window_view(h, w))
            flat = np.concatenate(keys)
            order = np.argsort(flat, axis=None, kind="stable")
            view = np.concatenate(views)
            flat = flat.ravel()[order]
            # most keys of documents end at a look at one bit
            maybe = np.zeros(1 << max(16, int(np.log2(len(flat))) + 5), dtype=bool)
            maybe[flat & np.uint64(len(maybe) - 1)] = True
            self.index[c] = (flat, order // REPETITIONS, np.concatenate(item), np.concatenate(pos), signatures(view), maybe)
        #: words of a window that may be missing in a document
        self.missing = np.array([max(1, int(EDITS * need(len(self.words[i])))) for i in self.ids], dtype=np.int64)


class Search:
    """Looks documents' windows up among the items' buckets and verifies what it finds."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.hashes = _Hashes()

    def batch(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(position in the batch, item, edits, longest run) of all verified candidates."""
        it = self.items
        all_words = [words(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in all_words], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        h = self.hashes.of([x for ws in all_words for x in ws])
        walks = Walks(h)
        out = []
        for c, (keys, at_key, item, pos, signs, maybe) in it.index.items():
            w, _ = window(c)
            own = [document_starts(n, c) for n in sizes.tolist()]
            doc = np.repeat(np.arange(len(own)), [len(s) for s in own])
            if not len(doc):
                continue
            start = np.concatenate(own)
            absolute = start + offsets[doc]
            limit = it.missing[item]
            near: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for some in np.array_split(np.arange(len(doc)), len(doc) // 20_000 + 1):
                found = walks.buckets(absolute[some], w).ravel()
                hit = np.nonzero(maybe[found & np.uint64(len(maybe) - 1)])[0]
                lo = np.searchsorted(keys, found[hit])
                many = np.searchsorted(keys, found[hit], "right") - lo
                slot = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                pairs = np.unique(np.repeat(hit // REPETITIONS, many) * len(item) + at_key[slot])
                x, y = some[pairs // len(item)], pairs % len(item)
                # as many words may be missing as may be edited; most candidates end here
                mine = signatures(h[absolute[some][:, None] + np.arange(w)])[pairs // len(item)]
                keep = np.nonzero(np.bitwise_count(signs[y] & ~mine).max(axis=1, initial=0) <= limit[y])[0]
                for k in keep.tolist():
                    near[int(doc[x[k]]), int(item[y[k]])].append((int(pos[y[k]]), int(start[x[k]])))
            for (n, i), at in near.items():
                r = verify(it.words[it.ids[i]], all_words[n], at, w)
                if r:
                    out.append((n, it.ids[i], *r))
        return out


LEAKS = "item_id long, doc_id long, edits int, run int"


def leaks(documents: DataFrame, items: DataFrame, most_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(item_id, doc_id, edits, run): items of which at least half the words stand in a document with at most a tenth of
    that passage edited; edits 0 for those that stand there as they are."""
    once = items.select("item_id", "item_text").where("item_text <> ''").dropDuplicates(["item_id"])
    # a word takes two characters at least
    keys = (once.select(F.sum(F.length("item_text"))).first()[0] or 0) // 2 * REPETITIONS
    if keys > most_keys:
        return joined(documents, once)
    query = Items([(r["item_id"], r["item_text"]) for r in once.collect()])
    made: list[Search] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Search(query))
        hits = made[0].batch(cols["text"])
        return {"item_id": [h[1] for h in hits], "doc_id": [cols["doc_id"][h[0]] for h in hits], "edits": [h[2] for h in hits], "run": [h[3] for h in hits]}

    return map_batches(documents.select("doc_id", "text"), LEAKS, run)


def joined(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same for items too many to be sent to the tasks: windows meet in a join of their buckets."""

    def classes(cols: dict[str, list]) -> dict[str, list]:
        return {"c": sorted({length_class(need(len(w))) for t in cols["item_text"] if (w := words(t))})}

    used = sorted(r["c"] for r in map_batches(items.select("item_text"), "c int", classes).distinct().collect())

    def keyed(key: str, text: str, own: bool):
        def run(cols: dict[str, list]) -> dict[str, list]:
            hashes = _Hashes()
            out: dict[str, list] = {"c": [], "bucket": [], key: [], f"{key}_at": []}
            for k, t in zip(cols[key], cols[text], strict=True):
                w = words(t) if t else []
                if not w:
                    continue
                h = hashes.of(w)
                walks = Walks(h)
                for c in [length_class(need(len(w)))] if own else used:
                    size, _ = window(c)
                    starts = np.arange(len(h) - size + 1) if own else document_starts(len(h), c)
                    if len(starts):
                        b = walks.buckets(starts, size).view(np.int64)
                        out["bucket"] += b.ravel().tolist()
                        out[f"{key}_at"] += np.repeat(starts, REPETITIONS).tolist()
                        out["c"] += [c] * b.size
                        out[key] += [k] * b.size
            return out

        return run

    left = map_batches(items, "c int, bucket long, item_id long, item_id_at int", keyed("item_id", "item_text", True))
    right = map_batches(documents.select("doc_id", "text"), "c int, bucket long, doc_id long, doc_id_at int", keyed("doc_id", "text", False))
    # a window that many documents share is split by the adaptive skew join; the windows of a pair are at most its words
    met = left.join(right.hint("merge"), ["c", "bucket"]).groupBy("item_id", "doc_id").agg(F.collect_set(F.struct(F.col("item_id_at").alias("p"), F.col("doc_id_at").alias("d"))).alias("near"))
    texts = documents.select("doc_id", "text").groupBy("doc_id").agg(F.any_value("text").alias("text"))
    rows = met.join(items, "item_id").join(texts.hint("merge"), "doc_id")

    def check(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "doc_id": [], "edits": [], "run": []}
        for i, k, a, d, near in zip(cols["item_id"], cols["doc_id"], cols["item_text"], cols["text"], cols["near"], strict=True):
            item = words(a)
            r = verify(item, words(d), [(x["p"], x["d"]) for x in near], window(length_class(need(len(item))))[0])
            if r:
                for name, v in zip(out, (i, k, *r), strict=True):
                    out[name].append(v)
        return out

    return map_batches(rows.select("item_id", "doc_id", "item_text", "text", "near"), LEAKS, check)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items that leaked into them as they are."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("edits = 0").select("item_id", "doc_id").distinct()


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items that leaked into them with at most a tenth of the passage edited, and the edits."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents it leaked into and the longest passage found; 0 where none."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "benchmark_name").dropDuplicates(["item_id"])
    hits = stage(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("edits = 0"), "leaks")
    n = hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("run").alias("longest_run"))
    return items.join(n, "item_id", "left").na.fill(0, ["docs", "longest_run"])


_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
ORACLE = {
    "p8_found": f"""WITH i AS (SELECT DISTINCT item_id, {_W.format("item_text")} AS w FROM eval_items WHERE item_text IS NOT NULL), p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[s:s + (len(w) + 1) // 2 - 1], ' ') || ' ' AS passage FROM (SELECT item_id, w, unnest(range(1, len(w) - (len(w) + 1) // 2 + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT DISTINCT doc_id, ' ' || array_to_string({_W.format("text")}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL) SELECT DISTINCT item_id, doc_id FROM d JOIN p ON contains(d.t, p.passage)""",
}
QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_edited": p8_edited}
