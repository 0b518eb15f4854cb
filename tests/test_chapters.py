"""Chapter runs of small books, by hand; no rows and empty documents give no rows."""

from __future__ import annotations

import pytest

from textmend import catalog

CHAPTERS = "chapter_id long, book_id long, page_no int, item_id string, href string, media_type string, title string, document string, modified boolean, extracted_at timestamp, loaded_at timestamp"


def page(k, text, book=1, no=None):
    return (k, book, no, None, f"p{k}.xhtml", None, None, text, None, None, None)


def test_the_labelled_run_wins_over_page_numbers(spark, tables):
    rows = [page(k, f"{k}\nSome text of the page.", no=k) for k in range(1, 6)]
    rows += [page(10 + k, f"CHAPTER {n}\nSome text.", no=10 + k) for k, n in enumerate(("I", "II", "IV"))]
    d = tables(chapters=([*rows, rows[0]], CHAPTERS))
    got = {(r["style"], r["rank"]): (r["length"], r["score"], r["first_chapter"], r["last_chapter"]) for r in catalog.queries()["chapter_sequence"](spark, d).collect()}
    # a labelled heading with a roman numeral of two words: 3 + 2.5 + 1.5 + 1.5 + 0.5; a bare number at a page's head: 3 - 0.5 + 0.5
    assert got == {("roman numeral", 1): (3, 27.0, 10, 12), ("arabic numeral", 2): (5, 15.0, 1, 5)}
    margin = catalog.queries()["sequence_margin"](spark, d).first()
    assert (margin["length"], margin["margin"]) == (3, 12.0)


def test_parts_restart_the_numbers(spark, tables):
    lines = ["BOOK ONE", "CHAPTER I", "CHAPTER II", "CHAPTER III", "BOOK TWO", "CHAPTER I", "CHAPTER II"]
    d = tables(chapters=([page(k, x, no=k) for k, x in enumerate(lines, 1)], CHAPTERS))
    rows = catalog.queries()["chapter_sequence"](spark, d).collect()
    assert [(r["length"], r["first_chapter"], r["last_chapter"]) for r in rows] == [(5, 2, 7)]


def test_repeated_headers_are_one_marker(spark, tables):
    d = tables(chapters=([page(k, "CHAPTER I\ntext", no=k) for k in range(1, 5)], CHAPTERS))
    row = catalog.queries()["marker_merge"](spark, d).first()
    assert (row["occurrences"], row["other_pages"]) == (4, 3) and catalog.queries()["chapter_sequence"](spark, d).count() == 0


@pytest.mark.parametrize("name", ["typography_page", "typography_samples", "text_repair_pipeline", "whitespace_issues", "possessive_snippets", "marker_classify", "chapter_sequence", "paragraph_merge", "page_tag_counts", "text_slots", "junk_elements", "markup_round_trip", "boilerplate_elements", "divided_pages"])
def test_empty_tables_and_documents(spark, tables, name):
    d = tables(chapters=([], CHAPTERS), books=([], "book_id long"))
    assert catalog.queries()[name](spark, d).count() == 0
    d = tables(chapters=([page(1, None), page(2, ""), page(3, " \n "), page(4, "x" * 100_000), page(4, "x" * 100_000)], CHAPTERS), books=([], "book_id long"))
    rows = [r["chapter_id"] for r in catalog.queries()[name](spark, d).select("chapter_id").collect()] if name != "chapter_sequence" else []
    assert set(rows) <= {2, 3, 4}
    if name in ("typography_page", "text_repair_pipeline", "page_tag_counts", "text_slots", "junk_elements", "markup_round_trip"):
        # one row for each page, however often its row is repeated
        assert sorted(rows) == [2, 3, 4]
