"""Repairs and measures of single texts, case by case."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmend.functions import markers as M
from textmend.functions import text as T
from textmend.operators.repairs import RepairOptions, repaired


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(expr(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("before", "after"), [
    ("Wait... don t stop", "Wait… don't stop"), ("a . . . b", "a… b"), ("four....", "four...."), ("tis late", "'tis late"), ("yes ma am", "yes ma'am"), ("that s/he does", "that s/he does"), ("", ""),
    ("hello,world", "hello, world"), ("3.14 and 1,000", "3.14 and 1,000"), ("U.S.A.", "U.S.A."), ("Mr.Smith came", "Mr.Smith came"), ("end.Next one", "end. Next one"), ("  lead\tand  gap ,", "lead and gap,"), (None, None),
])
def test_repairs(spark, before, after):
    assert one(spark, lambda c: repaired(c, F.lit(False), F.lit(False)), before) == after


@pytest.mark.parametrize("text", ["Wait... don t stop", " a  b ,c.Dd ", "it s . . . x", "“q”  — r"])
def test_repairing_twice_changes_nothing(spark, text):
    fix = lambda c: repaired(c, F.lit(False), F.lit(False))
    first = one(spark, fix, text)
    assert one(spark, fix, first) == first


def test_glue_keeps_one_blank(spark):
    assert one(spark, lambda c: T.whitespace(c, F.lit(True), F.lit(True))["text"], "  a  b  ") == " a b "
    assert one(spark, lambda c: T.whitespace(c, F.lit(False), F.lit(False), ("leading",))["text"], "\ta") == "\ta"


def test_once_leaves_texts_that_another_repair_changed(spark):
    fix = lambda c: repaired(c, F.lit(False), F.lit(False), RepairOptions(once=True))
    assert one(spark, fix, "a...  b") == "a…  b"
    assert one(spark, fix, "a  b") == "a b"


def test_possessives_are_only_reported(spark):
    assert one(spark, T.bare_s, "the dog s tail, it s 1990 s and Michael S. Hart") == ["dog", "1990"]


@pytest.mark.parametrize(("base", "href", "want"), [("a/b", "../c.xhtml#x", "a/c.xhtml#x"), ("", "./d.html", "d.html"), ("a", "#top", "#top"), ("a", "", "")])
def test_paths(spark, base, href, want):
    assert one(spark, T.resolved, base, href) == want


@pytest.mark.parametrize(("text", "want"), [
    ("Chapter Four: The Long Way Home", ("spelled-out number", 4, True, "chapter")), ("IV", ("roman numeral", 4, False, None)), ("— 12 —", ("hyphen-wrapped numeral", 12, False, None)), ("Part II", ("roman numeral", 2, True, "part")),
    ("Chapter Twenty-Seven", ("spelled-out number", 27, True, "chapter")), ("FOURTH MACHINATION", ("spelled-out ordinal", 4, False, None)), ("Four days later", None), ("IIII", None), ("Chapter", None), ("", None), ("one hundred and two", ("spelled-out number", 102, False, None)),
])
def test_markers(spark, text, want):
    got = one(spark, M.classify, text)
    assert (tuple(got) if got else None) == want


def test_compatible_markers_lose_the_unit(spark):
    assert one(spark, lambda c: M.classify(c, compat=True), "Chapter Twenty-Seven")["number"] == 20


def brute(rows):
    best = []
    for i, (_, n, v, p) in enumerate(rows):
        top = (v, 1, -1)
        for j in range(i):
            _, m, _, o = rows[j]
            if (1 <= n - m <= 2 if p == o else p > o and n <= 2) and (best[j][0] + v, best[j][1] + 1) > top[:2]:
                top = (best[j][0] + v, best[j][1] + 1, j)
        best.append(top)
    end = max(range(len(rows)), key=lambda k: best[k][:2])
    out, k = [], end
    while k >= 0:
        out.append(rows[k][0])
        k = best[k][2]
    return best[end][0], best[end][1], out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from([-0.5, 1.0, 2.5]), st.booleans()), min_size=1, max_size=14))
def test_best_run_is_that_of_the_full_search(steps):
    rows, part = [], 0
    for i, (n, v, up) in enumerate(steps):
        part += up
        rows.append((i, n, v, part))
    assert M.best_run(rows) == brute(rows)
