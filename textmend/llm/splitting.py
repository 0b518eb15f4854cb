"""Problem 7: oversized pages cut into pieces at natural boundaries.

Every boundary of an oversized page is joined to its farthest legal successor (a piece that begins up
to ``OVERLAP`` characters before the boundary, at a word, ends at most ``LIMIT`` characters later);
among the successors in reach the most natural kind wins: section, paragraph, sentence, word. Then
successor tables are squared (pointer doubling): with ``reached`` the boundaries known to be cuts and
``jump`` the successor 2^k steps on, every round doubles the number of known cuts of all pages at
once. The number of rounds is the logarithm of the most pieces a page has.

Words are boundaries only where no sentence ends in reach, characters only where no word does, which
leaves the choice of every cut as it is and keeps the tables small. Null, empty and short texts are
not cut; a repeated row is cut once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.plans.runtime import stage, table

LIMIT = 8000
OVERLAP = 200

_SENTENCE = re.compile(r"[.!?…]+[”\"’'»“)\]]*\s+(?=\S)")
_PARAGRAPH = re.compile(r"\n[ \t\f]*\n\s*|\n(?=[ \t]{2,}\S)")
_WORD_START = re.compile(r"\s+(?=\S)")


def boundaries(text: str, titles: list[str], limit: int, overlap: int) -> tuple[list[int], list[int], list[int]]:
    """(positions, kinds, begins): where a piece may end, how natural it is there (0 section, 1 paragraph, 2
    sentence, 3 word, 4 any character), and where the next piece would begin, overlap included."""
    kind: dict[int, int] = {}
    for m in _SENTENCE.finditer(text):
        kind[m.end()] = 2
    for m in _PARAGRAPH.finditer(text):
        kind[m.end()] = 1
    wanted = {t.strip().casefold() for t in titles if t and t.strip()}
    if wanted:
        at = 0
        for line in text.split("\n"):
            if at and line.strip().casefold() in wanted:
                kind[at] = 0
            at += len(line) + 1
    kind.pop(0, None)
    kind[0] = 0
    kind[len(text)] = 0
    # finer boundaries only in gaps that a piece can't span
    reach = limit - overlap
    marks = sorted(kind)
    for a, b in zip(marks, marks[1:], strict=False):
        if b - a > reach:
            words = [m.end() for m in _WORD_START.finditer(text, a, b) if a < m.end() < b]
            for w in words:
                kind.setdefault(w, 3)
            inner = [a, *words, b]
            for c, d in zip(inner, inner[1:], strict=False):
                if d - c > reach:
                    for x in range(c + reach // 2, d, max(1, reach // 2)):
                        kind.setdefault(x, 4)
    positions = sorted(kind)
    begins = []
    for p in positions:
        if p == 0:
            begins.append(0)
            continue
        b = max(0, p - overlap)
        if b and not text[b - 1].isspace():
            m = _WORD_START.search(text, b, p)
            # where no word begins in the overlap it is kept whole, in the middle of a word
            b = m.end() if m and m.end() < p else b
        while b < p and text[b].isspace():
            b += 1
        begins.append(b)
    return positions, [kind[p] for p in positions], begins


def successors(text: str, titles: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(boundary, begin of the piece after it, farthest legal successor, kind of that)."""
    positions, kinds, begins = boundaries(text, titles, limit, overlap)
    last: list[dict[int, int]] = []  # for each boundary the nearest one of each kind at or before it
    now: dict[int, int] = {}
    for i, k in enumerate(kinds):
        now = now | {k: i}
        last.append(now)
    out = []
    j = 0
    for i, p in enumerate(positions[:-1]):
        end = begins[i] + limit
        while j + 1 < len(positions) and positions[j + 1] <= end:
            j += 1
        if positions[-1] <= end:
            best = len(positions) - 1
        else:
            # a piece should not be a scrap: the natural cut has to lie past the overlap of the next piece
            best = next((x for k in range(5) if (x := last[j].get(k, -1)) > i and positions[x] - p > overlap), -1)
            if best < 0:
                best = max(j, i + 1)
        out.append((p, begins[i], positions[best], kinds[best]))
    return out


def oversized(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    """Oversized pages once, with the titles of the sections that begin inside them."""
    pages = (
        table(spark, sf_dir, "chapters").where(F.length("document") > limit)
        .select("chapter_id", "book_id", "href", "document").dropDuplicates(["chapter_id"])
    )
    nodes = (
        table(spark, sf_dir, "structure_nodes").where(F.col("title").isNotNull() & F.contains("start_href", F.lit("#")))
        .select("book_id", F.substring_index("start_href", "#", 1).alias("href"), "title")
        .join(pages.select("book_id", "href").distinct(), ["book_id", "href"], "left_semi")
        .groupBy("book_id", "href").agg(F.collect_set("title").alias("titles"))
    )
    return pages.join(nodes, ["book_id", "href"], "left").select("chapter_id", "document", "titles")


def successor_table(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chapter_id, at, begin, next, kind) of every boundary of every page."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"chapter_id": [], "at": [], "begin": [], "next": [], "kind": []}
        for k, text, titles in zip(cols["chapter_id"], cols["document"], cols["titles"], strict=True):
            for row in successors(text, titles or [], limit, overlap):
                for name, x in zip(out, (k, *row), strict=True):
                    out[name].append(x)
        return out

    return map_batches(pages, "chapter_id long, at int, begin int, next int, kind int", run)


def cuts(spark: SparkSession, successor: DataFrame) -> DataFrame:
    """(chapter_id, at) of all boundaries that greedy cutting from 0 reaches, by pointer doubling."""
    reached = successor.where("at = 0").select("chapter_id", "at")
    jump = successor.select("chapter_id", "at", "next")
    while True:
        # reached grows to twice its length: what lies 2^k steps after each known cut
        more = reached.join(jump, ["chapter_id", "at"]).select("chapter_id", F.col("next").alias("at"))
        grown = stage(reached.unionByName(more).distinct(), "cuts")
        if grown.count() == reached.count():
            return grown
        reached = grown
        to = jump.select("chapter_id", F.col("at").alias("next"), F.col("next").alias("then"))
        # boundaries whose doubled jump would leave the page are done
        jump = stage(jump.join(to, ["chapter_id", "next"]).select("chapter_id", "at", F.col("then").alias("next")), "jump")


def pieces(spark: SparkSession, sf_dir: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chapter_id, piece_no, begin, end, kind) of every piece of every oversized page."""
    pages = oversized(spark, sf_dir, limit)
    successor = stage(successor_table(pages, limit, overlap), "successors")
    from pyspark.sql import Window

    # a page has few cuts; the window's partitions are as small as that
    number = F.row_number().over(Window.partitionBy("chapter_id").orderBy("at"))
    return successor.join(cuts(spark, successor), ["chapter_id", "at"]).select(
        "chapter_id", number.cast("int").alias("piece_no"), "begin", F.col("next").alias("end"), "kind"
    )


KINDS = ("section", "paragraph", "sentence", "word", "character")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that had to be cut: those with more than one piece."""
    return pieces(spark, sf_dir).where("piece_no = 2").select("chapter_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their text, numbered; each after the first repeats the end of the one before."""
    texts = table(spark, sf_dir, "chapters").where(F.length("document") > LIMIT).select("chapter_id", "document").dropDuplicates(["chapter_id"])
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return pieces(spark, sf_dir).join(texts, "chapter_id").select(
        "chapter_id", "piece_no", "begin", "end", kind.alias("cut_at"),
        F.substring("document", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("piece"),
    )


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces}
ORACLE = {"p7_found": f"SELECT DISTINCT chapter_id FROM chapters WHERE length(document) > {LIMIT}"}
