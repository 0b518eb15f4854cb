"""Operators on names and documents: entities, leaks, mixing, subjects."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmend.llm import leaks, mixing, names, subjects

DOCS = "doc_id long, text string, lang string, source string, item_id long, tokens long"
ITEMS = "item_id long, benchmark_name string, item_text string, answer string"
TARGETS = "source string, target_share double, max_repeats int"
SAMPLES = "sample_id long, subject_area string, sample_text string"
BOOKS = "book_id long, creator string, name string"
SUMMARIES = "book_id long, author string, n long"


def doc(k, text, source="a"):
    return (k, text, None, source, 0, 0)


# --- names ---------------------------------------------------------------------------------------------------


def found(spark, tables, *spellings):
    d = tables(books=([(i, s, "x") for i, s in enumerate(spellings)], BOOKS), book_summaries=([(1, spellings[0] if spellings else None, 1)], SUMMARIES))
    return {(r["name_a"], r["name_b"]) for r in names.p4_found(spark, d).collect()}


def test_names(spark, tables):
    same = [
        ["Samuel S. Tudesokim", "Tudesokim, Samuel S.", "Sameul S. Tudesokim", "S. Tudesokim", "TUDESOKIM, SAMUEL", "Dr. Samuel Tudesokim", "Tudesokim, Sam", "Tudesokim, Samuel S., 1841-1891", "by Samuel Tudesokim", "Tudesokm, Samuel", "Tudesokim Samuel"],
        ["Zoë Pobolatold", "Zoe Pobolatold", "Pobolatold, Z.", "zoë  pobolatold "], ["Henry Sinufunal", "Harry Sinufunal"], ["Victoria Sinufunal", "V. Sinufunal"], ["Institute of Bopo Studies", "Inst. of Bopo Studies", "Bopo Studies, Institute of"],
        ["Panodo University Press", "University Press of Panodo", "Panodo U.P. (University Press)", "Panodo University Pres"], ["Bapo & Sons", "Messrs. Bapo and Sons Limited"], ["Pobolatold & Sons"], ["M. L. Sopubedi", "Margaret Sopubedi"],
    ]
    want = {(min(a, b), max(a, b)) for g in same for a, b in itertools.combinations(g, 2)}
    got = found(spark, tables, *[s for g in same for s in g], "Unknown", "Various", "N/A", "—", "", None, "Anonymous", *same[0][:2])
    assert got == want


def test_long_chains_of_spellings_have_one_end(spark, tables):
    # each is one edit from the next and two from the one after it
    chain = [f"Samuel {'Tadabagadakafa'.replace('a', 'o', i)}" for i in range(8)]
    assert found(spark, tables, *chain) == set(itertools.combinations(sorted(chain), 2))


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_refined_segments_lose_no_pair(spark, hot):
    rng = np.random.default_rng(4)
    forms = sorted({"".join(rng.choice(list("abc"), rng.integers(3, 9))) + tail for tail in (" tadabaga", " tadabago", "") for _ in range(40)})
    want = {(a, b) for a in forms for b in forms if a != b and names.distance(a, b, 1) <= 1}
    rows = spark.createDataFrame([("p", f) for f in forms], "grp string, form string")
    assert {(r["form"], r["other"]) for r in names.near_pairs(rows, hot).collect()} == want


@pytest.mark.parametrize(("name", "form"), [
    ("Jack Ma", "john ma"), ("St. John, Henry", "henry st john"), ("Lady Gaga", "lady gaga"), ("Sir Henry Bapo", "henry bapo"), ("Bapo, Dr. Henry", "henry bapo"), ("Henry Bapo, Jr.", "henry bapo"), ("Henry Bapo PhD", "henry bapo"), ("Bapo, Henry, M.A.", "henry bapo"),
    ("Mr. Bapo", "bapo"), ("Don Juan", "don juan"), ("Agnes Grey", "agnes grey"), ("Ines Grey", "ines grey"),
])
def test_titles_are_no_surnames(name, form):
    assert names.parse(name)[1] == form


def test_no_names(spark, tables):
    assert found(spark, tables) == set()


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=1, max_size=9), st.text("abcd", min_size=1, max_size=9))
def test_pigeonhole_misses_nothing(a, b):
    def levenshtein(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        return row[-1]

    if levenshtein(a, b) <= names.K:
        index = {(len(a), i, s) for i, _, s in names.segments(a)}
        assert index & {(n, i, s) for n, i, _, s in names.probes(b)}


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_distance_counts_exchanges(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert names.distance(a, b, 2) == min(3, d[-1][-1])


# --- leaks ---------------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(400)]


def test_leaks_against_brute_force(spark, tables):
    rng = np.random.default_rng(5)
    items = [(i, "b", " ".join(rng.choice(WORDS, rng.integers(30, 70))), None) for i in range(12)] + [(90, "b", None, None), (91, "b", "", None)]
    docs = []
    for k in range(150):
        body = list(rng.choice(WORDS, rng.integers(0, 300)))
        w = items[k % 12][2].split()
        n = int(len(w) * rng.choice([0.3, 0.45, 0.5, 0.55, 0.9, 1.0]))
        at = int(rng.integers(0, len(w) - n + 1))
        p = int(rng.integers(0, len(body) + 1))
        docs.append(doc(k, "+# " + ",\n+ // ".join(body[:p] + [x.upper() for x in w[at : at + n]] + body[p:])))
    docs += [doc(900, None), doc(901, ""), doc(902, "short"), docs[5]]
    d = tables(documents=(docs, DOCS), eval_items=(items, ITEMS))
    want = set()
    for i, _, t, _ in items:
        w = (t or "").split()
        need = (len(w) + 1) // 2
        for k, text, *_ in docs:
            have = " " + " ".join(leaks.words(text or "")) + " "
            if w and any(" " + " ".join(w[s : s + need]) + " " in have for s in range(len(w) - need + 1)):
                want.add((i, k))
    assert {(r["item_id"], r["doc_id"]) for r in leaks.p8_found(spark, d).collect()} == want
    assert leaks.p8_items(spark, d).count() == len(items)


def test_no_items(spark, tables):
    d = tables(documents=([doc(1, "a b c")], DOCS), eval_items=([], ITEMS))
    assert leaks.p8_found(spark, d).count() == 0


def edited(rng, row, edits):
    row = list(row)
    for _ in range(edits):
        p, kind = int(rng.integers(len(row))), rng.integers(3)
        if kind == 0:
            row[p] = int(rng.integers(1, 2**62))
        elif kind == 1:
            row.insert(p, int(rng.integers(1, 2**62)))
        else:
            row.pop(p)
    return row


@pytest.mark.parametrize("c", [5, 6, 7, 8, 9, 10])
def test_nine_of_ten_edited_windows_share_a_bucket(c):
    rng = np.random.default_rng(c)
    w, _ = leaks.window(c)
    a = rng.integers(1, 2**62, (600, w)).astype(np.uint64)
    n = max(1, int(leaks.EDITS * w))
    b = np.array([(edited(rng, row, n) + list(rng.integers(1, 2**62, w)))[:w] for row in a], dtype=np.uint64)
    at = np.arange(600) * w

    def keys(x):
        return leaks.Walks(x.ravel()).buckets(at, w)

    assert (keys(a) == keys(a.copy())).all()
    assert (keys(a) == keys(b)).any(axis=1).mean() >= 0.9
    assert (keys(a) == keys(b[::-1].copy())).any(axis=1).mean() < 0.02


def test_windows_fit_every_passage():
    for n in range(1, 400):
        c = leaks.length_class(n)
        w, stride = leaks.window(c)
        assert w + stride - 1 <= n < leaks.CLASS * (w + stride)


@pytest.fixture
def edited_leaks(tables):
    """Documents with half of an item or more, up to a tenth of it edited, between other words; and items of 1 to 90 words."""
    rng = np.random.default_rng(8)
    items = [(i, "b", " ".join(rng.choice(WORDS, n)), None) for i, n in enumerate([1, 2, 3, 7, *rng.integers(20, 90, 20).tolist()])]
    docs, want = [], {}
    for k in range(300):
        i = int(rng.integers(4, len(items)))
        w = items[i][2].split()
        size = leaks.need(len(w))
        at = int(rng.integers(0, len(w) - size + 1))
        n = int(rng.integers(0, int(leaks.EDITS * size) + 1))
        body = [f"x{x}" for x in rng.integers(0, 10**6, rng.integers(0, 200))]
        p = int(rng.integers(0, len(body) + 1))
        docs.append(doc(k, " ".join([*body[:p], *map(str, edited(rng, w[at : at + size], n)), *body[p:]])))
        want[i, k] = n
    return tables(documents=(docs, DOCS), eval_items=(items, ITEMS)), want


def test_edited_leaks(spark, edited_leaks):
    d, want = edited_leaks
    got = {(r["item_id"], r["doc_id"]): r["edits"] for r in leaks.p8_edited(spark, d).collect()}
    assert sum(k in got and got[k] <= n for k, n in want.items()) >= 0.9 * len(want)
    assert {k for k, n in want.items() if n == 0} <= {k for k, n in got.items() if n == 0}
    long = {k: n for k, n in got.items() if k[0] >= 4}
    assert set(long) <= set(want)


def test_items_joined_by_bucket_give_the_same(spark, edited_leaks):
    d, _ = edited_leaks
    documents, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    rows = [{tuple(r) for r in leaks.leaks(documents, items, keys).collect()} for keys in (leaks.BROADCAST_KEYS, 0)]
    assert rows[0] == rows[1] and rows[0]


# --- mixing --------------------------------------------------------------------------------------------------


def cost(tokens, uses):
    full, rest = divmod(uses, tokens)
    return tokens * full * (full - 1) // 2 + rest * full


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(1, 5), st.integers(0, 8), st.integers(0, 8))
def test_flow_is_the_best_one(t1, t2, t3, q1, q2):
    patterns = {("a",): t1, ("b",): t2, ("a", "b"): t3}
    total = 100
    targets = {"a": (q1 / total, 2), "b": (q2 / total, 3)}
    flow = mixing.route(patterns, targets, total)
    got = sum(flow.values())
    best = None
    for x in range(2 * t1 + 1):
        for y in range(3 * t2 + 1):
            for za in range(min(2, 3) * t3 + 1):
                for zb in range(3 * t3 + 1):
                    if x + za <= int(q1 / total * total) and y + zb <= int(q2 / total * total) and za + zb <= 3 * t3:
                        key = (-(x + y + za + zb), cost(t1, x) + cost(t2, y) + cost(t3, za + zb))
                        best = key if best is None or key < best else best
    mine = cost(t1, flow.get((("a",), "a"), 0)) + cost(t2, flow.get((("b",), "b"), 0)) + cost(t3, flow.get((("a", "b"), "a"), 0) + flow.get((("a", "b"), "b"), 0))
    assert (-got, mine) == best


def test_mix(spark, tables):
    pytest.importorskip("tiktoken")
    docs = [doc(k, f"text number {k} " + "word " * (k % 17), "abc"[k % 3] if k % 10 else "c") for k in range(600)] + [doc(1000 + k, f"text number {k} " + "word " * (k % 17), "b") for k in range(0, 60)]
    docs += [doc(5000, None), doc(5001, ""), doc(5002, "no source", None), doc(5003, "no target", "z")]
    d = tables(documents=(docs, DOCS), mix_targets=([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("d", 0.1, 2)], TARGETS))
    rows = {r["source"]: r for r in mixing.p9_mix(spark, d).collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["d"]["tokens"] == 0 and sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    longest = 40
    for s, r in rows.items():
        assert r["most_uses"] <= {"a": 1, "b": 2, "c": 3, "d": 2}[s] and r["tokens"] <= r["quota"] + longest
    assert abs(rows["b"]["tokens"] - rows["b"]["quota"]) <= longest
    chosen = mixing.p9_documents(spark, d).collect()
    assert sorted((r["text_id"], r["source"], r["uses"]) for r in chosen) == sorted((r["text_id"], r["source"], r["uses"]) for r in mixing.p9_documents(spark, d).collect())


def test_mix_of_nothing(spark, tables):
    d = tables(documents=([], DOCS), mix_targets=([("a", 1.0, 1)], TARGETS))
    assert [(r["source"], r["tokens"]) for r in mixing.p9_mix(spark, d).collect()] == [("a", 0)]


# --- subjects ------------------------------------------------------------------------------------------------


def commit(message, *changes):
    body = "\n".join(f"    {m}" for m in message)
    return f"commit 00\nAuthor: Ann <a@x>\nDate:   now\n\n{body}\n\ndiff --git a/x.md b/x.md\n--- a/x.md\n+++ b/x.md\n@@ -1,2 +1,3 @@\n the tide of context\n" + "\n".join(changes)


AREAS = {"sea": ["tide", "harbour", "sail", "anchor", "reef", "wave"], "sky": ["cloud", "comet", "star", "moon", "dawn", "orbit"], "software": ["buffer", "parser", "cache", "thread", "heap", "socket"]}


def sentence(rng, area):
    a, b, c = rng.choice(AREAS[area], 3, replace=False)
    return f"The {a} should meet the {b} before the next {c} is shown."


@pytest.fixture
def labelled(spark, tables):
    rng = np.random.default_rng(3)
    samples = [(i, a, f"{sentence(rng, a)}") for i, a in enumerate(list(AREAS) * 8)]
    docs, want = [], {}
    for k in range(400):
        areas = [list(AREAS)[k % 3]] + ([list(AREAS)[(k + 1) % 3]] if k % 5 == 0 else [])
        docs.append(doc(k, commit([f"Add a note {k}", *[sentence(rng, a) for a in areas]], *["+" + sentence(rng, a) for a in areas])))
        want[k] = set(areas)
    extra = {900: None, 901: "", 902: "commit 1\nMerge: a b\nAuthor: Ann <a@x>\n\n    Merge branch tide", 903: commit(["wip"], "-  the tide and the reef ", "+  the tide and the  reef")}
    docs += [doc(k, t) for k, t in extra.items()] + [docs[3]]
    return tables(documents=(docs, DOCS), subject_samples=(samples, SAMPLES)), want | {k: {"software"} for k in extra}


def test_subjects(spark, labelled):
    d, want = labelled
    got = {}
    for r in subjects.p10_found(spark, d).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_area"])
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert all(got[k] == {"software"} for k in (900, 901, 902, 903))
    assert subjects.p10_composition(spark, d).count() > 0


def test_passing_mentions_and_context_dont_count():
    c = subjects.Commit(commit(["Add", "Not related to a cell in the spreadsheet.", "Closes #3"], "+new line", "-old line"))
    assert [x for _, x in c.told()] == ["Add", "old line", "new line"] or [x for _, x in c.told()] == ["Add", "new line", "old line"]


def test_empty_subjects(spark, tables):
    d = tables(documents=([], DOCS), subject_samples=([(1, "software", "a parser of the cache"), (2, "sea", "the tide of the reef")], SAMPLES))
    assert subjects.p10_found(spark, d).count() == 0


@pytest.mark.parametrize("bound", [0, 4])
def test_joined_terms_change_no_result(spark, labelled, monkeypatch, bound):
    d, _ = labelled
    want = sorted(tuple(r) for r in subjects.p10_found(spark, d).collect())
    monkeypatch.setattr(subjects, "TERMS", bound)
    assert sorted(tuple(r) for r in subjects.p10_found(spark, d).collect()) == want


def test_texts_are_parsed_once(spark, labelled, monkeypatch):
    """The counts, the sample and the labels share one pass over the texts; each pass costs about as much as all the rest."""
    d, _ = labelled
    texts = []
    mapped = subjects.map_batches
    monkeypatch.setattr(subjects, "map_batches", lambda df, *a: texts.append("text" in df.columns) or mapped(df, *a))
    assert subjects.p10_found(spark, d).count() > 0
    assert texts.count(True) == 1


def test_what_a_document_says():
    text = commit(["Add a reef. The tide, the TIDE!", "İstanbul x² 12_a", "Closes #3"], "+  tide and reef", "-old", "+123")
    assert subjects.said(text) == ("add a reef\nthe tide", "i stanbul x² a", "old\ntide and reef", 0)
    assert subjects.said(commit(["wip"], "-a b", "+a  b")) == ("", "", "", 0b111000)
    assert [subjects.said(x) for x in (None, "")] == [("", "", "", 0b110000)] * 2
    terms = subjects.Terms(["sea", "software"], {"reef": [1.0, 0.0], "tide": [1.0, 0.0], "stanbul": [0.0, 1.0]})
    assert subjects.features(text, terms).tolist() == [[0, 1, 2, 0, 2, 0.75], [0, 0, 1, 0, 0, 0.25], [0] * 6]


def test_only_words_that_may_be_terms_are_joined(spark, tables):
    """Every term that isn't sent passes the filter, in any script; of 3,000 other words few do, and the join drops these."""
    rare = spark.createDataFrame([(w, [1.0, 0.0]) for w in ["reef", "łódź", "海", "𐐷𐐷", *(f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(500))]], "word string, weights array<double>")
    terms = subjects.Terms(["sea", "software"], {}, rare)
    assert all(subjects.marked(r["word"], terms.marks) for r in rare.collect())
    assert sum(subjects.marked(f"other{k}", terms.marks) for k in range(3000)) < 30
    texts = [doc(1, "reefs and 海 other"), doc(1, "reefs and 海 other"), doc(2, "nothing"), doc(3, None)]
    rows = subjects.attach(subjects.parsed(spark.createDataFrame(texts, DOCS)), terms).collect()
    assert sorted((r["doc_id"], sorted(x["word"] for x in r["rare"] or [])) for r in rows) == [(1, ["reef", "海"]), (1, ["reef", "海"]), (2, []), (3, [])]


def test_held_out_snippets():
    """Trained on seven snippets of each area, the rest are labelled by their terms, as they are and set into commits."""
    rng = np.random.default_rng(9)
    train = [(a, sentence(rng, a)) for a in AREAS for _ in range(7)]
    terms = subjects.first_terms(train)
    chain = subjects.trained(terms.areas, np.zeros((0, len(terms.areas) + 1, subjects.FEATURES)), np.zeros(0, dtype=np.int64), subjects.composed(train, terms))
    test = [(a, sentence(rng, a)) for a in AREAS for _ in range(20)]
    for form in (lambda t: t, lambda t: subjects.as_commit(["Update"], [t, t]), lambda t: subjects.as_commit([t], ["value"])):
        right = sum([terms.areas[i] for i in chain.decode(subjects.features(form(t), terms), -1)] == [a] for a, t in test)
        assert right >= 0.9 * len(test)
