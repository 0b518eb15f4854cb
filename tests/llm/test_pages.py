"""Operators on pages: scans, normal form, residue, encodings, statistics, splitting."""

from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmend.llm import mojibake, normalform, quality, residue, scans, splitting

CHAPTERS = "chapter_id long, book_id long, page_no int, item_id string, href string, media_type string, title string, document string, modified boolean, extracted_at timestamp, loaded_at timestamp, text string, key string, n long"
BOOKS = "book_id long, title string, creator string"
SUMMARIES = "book_id long, title string, author string"
NODES = "book_id long, start_href string, title string"
MARKERS = "marker_id long, marker_text string"


def page(k, text, book=1, title=None, href=None):
    # extra columns have names that the operators use inside
    return (k, book, k, None, href or f"p{k}.xhtml", None, title, text, None, None, None, "extra", "extra", 7)


@pytest.fixture
def chapters(tables):
    def write(rows, books=((1, "The Quiet Road", "Ann Writer"),), nodes=()):
        return tables(
            chapters=(rows, CHAPTERS), books=(list(books), BOOKS), book_summaries=([], SUMMARIES), structure_nodes=(list(nodes), NODES), gutenberg_markers=([], MARKERS), chapter_analyses=([], "chapter_id long, word_count int, is_thin boolean, all_caps_run_count int, analyzed_at timestamp_ntz")
        )

    return write


PROSE = "The old harbour was quiet when the sailor carried the lantern over the bridge. Nobody noticed the narrow window until the morning opened it. She remembered the letter and polished the mirror again. "
EDGE_ROWS = [page(1, None), page(2, ""), page(3, " \n "), page(4, "x" * 100_000), page(5, PROSE), page(5, PROSE)]
ALL = [scans.p1_found, scans.p1_repaired, normalform.p2_found, normalform.p2_normal_form, residue.p3_found, residue.p3_clean_pages, residue.p3_kinds, mojibake.p5_found, mojibake.p5_restored, quality.p6_found, quality.p6_statistics, splitting.p7_found, splitting.p7_pieces]


@pytest.mark.parametrize("query", ALL, ids=lambda q: q.__name__)
def test_edges(spark, chapters, query):
    d = chapters(EDGE_ROWS)
    rows = query(spark, d).collect()
    if query in (scans.p1_found, normalform.p2_found, residue.p3_found, mojibake.p5_found):
        assert rows == []
    if query is splitting.p7_found:
        assert [r["chapter_id"] for r in rows] == [4]
    if query is quality.p6_found:
        assert [(r["chapter_id"], r["shape"]) for r in rows] == [(4, "junk")]
    if query in (scans.p1_repaired, normalform.p2_normal_form, quality.p6_statistics):
        assert sorted(r["chapter_id"] for r in rows) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("query", ALL, ids=lambda q: q.__name__)
def test_empty_tables(spark, chapters, query):
    assert query(spark, chapters([])).count() == 0


# --- normal form ---------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeé Ａｂ１́​\xad\xa0ﬁсаοВ中ø.", max_size=30))
def test_normal_form_is_reached_in_one_pass(text):
    t = normalform.transducer()
    once = t.apply(text)[0]
    assert t.apply(once)[0] == once


@pytest.mark.parametrize(("text", "want"), [
    ("Ｔｈｅ １", "The 1"), ("café", "café"), ("ﬁsh", "fish"), ("a​b\xad", "ab"), ("a\xa0b c", "a b c"), ("hаrbour", "harbour"), ("свобода λόγος 月", "свобода λόγος 月"), ("“œuvre” — é", "“œuvre” — é"), ("ｃаfé", "café"),
])
def test_normal_forms(text, want):
    assert normalform.transducer().apply(text)[0] == want


def test_table_agrees_with_unicode():
    for cluster, (to, kind) in normalform.build_table().items():
        if kind in ("width", "joined"):
            assert to == unicodedata.normalize("NFKC", cluster)
        if kind == "accent":
            assert to == unicodedata.normalize("NFC", cluster)


# --- residue -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "kind"), [
    ("Chapter {{ n }}\n\n" + PROSE, "placeholder"), ("© [[year]] <%= publisher %>", "placeholder"), ("*** START OF THE EBOOK [TITLE TBD] ***", "placeholder"), ("__TITLE__", "placeholder"), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
    ("Sample text. Sample text. Sample text.", "filler"), ("Error 404\n\nNot Found", "error"), ("Please enable JavaScript to continue.", "scripts"), ("THE [ILLUSTRATED] MILL", None), ("the printer had left {name} between braces", None), ("The tag “{{title}}” stood in it.", None),
    ("Her grammar gave “ipsum” and “dolor” as examples, and the pupils yawned.", None), ("An error of the server, who spilled the soup, was forgiven at once.", None), ("***", None), (None, None), ("", None), ("Set it so:\n\n    print(\"{{title}}\");\n", None), ("a `{{ x }}` b", None),
])
def test_residue(text, kind):
    assert residue.classify(text) == kind


# --- encodings -----------------------------------------------------------------------------------------------

WORDS = ["naïve", "café", "l’église", "„Ich", "compañera", "größte"]


@pytest.mark.parametrize("chain", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_garbled_forms_go_back(chain):
    for w in WORDS:
        form = mojibake._read(w.encode(), chain)
        assert mojibake.garbled(w)[form].startswith("utf-8>")
        back = mojibake._TABLES[chain, "keep"]
        assert bytes(back.index(c) for c in form).decode() == w


def test_restored(spark, chapters):
    clean = " ".join(WORDS) + " were there. "
    rows = [page(k, clean * 3) for k in range(1, 60)]
    bad = {
        70: clean.encode().decode("cp1252", "replace"), 71: clean.encode().decode("latin-1"), 72: mojibake._read(mojibake._read(clean.encode(), "cp1252").encode(), "cp1252"), 73: clean.encode("cp1252").decode("utf-8", "replace"),
        74: "".join(c if c.isascii() else f"&#{ord(c)};" for c in mojibake._read(clean.encode(), "cp1252")), 75: clean.encode("cp1252").decode("latin-1"),
    }
    fine = [page(80, "They said SÃO TOMÉ, then ÂNCORA, ±5°, with √2 and Ñ.")]
    d = chapters(rows + [page(k, t) for k, t in bad.items()] + fine)
    assert {r["chapter_id"] for r in mojibake.p5_found(spark, d).collect()} == set(bad)
    back = {r["chapter_id"]: r["document"] for r in mojibake.p5_restored(spark, d).collect()}
    assert back[71] == clean and back[72] == clean and back[74] == clean and back[75] == clean


def test_frequent_garbled_words_are_found(spark, chapters):
    clean = [page(k, "They didn’t go, they wasn’t „Ich and c’est. " * 3) for k in range(1, 40)]
    bad = [page(100 + k, f"They {w} go. ") for k, w in enumerate(["didnÔÇÖt", "Ð”а", "wasnвЂ™t", "cÔÇÖest"] * 60) if k % 4 != 1]
    assert {r["chapter_id"] for r in mojibake.p5_found(spark, chapters(clean + bad)).collect()} == {r[0] for r in bad}


def test_words_of_several_originals_are_lost(spark, chapters):
    clean = [page(k, "Der größte Mann grüßte den naïve Gast. " * 2) for k in range(1, 30)]
    d = chapters([*clean, page(50, "Der gr��te Mann na�ve"), page(51, "xÔÇÖy na├»ve")])
    rows = {r["chapter_id"]: (r["document"], r["restored_words"], r["lost_words"]) for r in mojibake.p5_restored(spark, d).collect()}
    assert rows[50] == ("Der gr��te Mann naïve", 1, 1)


def test_known_words_change_no_result(spark):
    words = spark.createDataFrame([("didn’t", 500), ("didnÔÇÖt", 400), ("größte", 300), ("xÔÇÖy", 200), ("naïve", 100)], "word string, n long")
    assert mojibake.known_words(words) == {"didn’t", "größte", "naïve"}


# --- statistics ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "shape"), [
    ("- old road\n- quiet bridge\n- narrow window\n- lantern", "list"), ("Index\n\nbridge, 12, 40\nharbour, 7\nlantern, 9, 88", "list"), ("The Road ........ 3\nThe Bridge ...... 17\nThe End ........ 29", "list"), ("old road; quiet bridge; narrow window; old lantern; letter; mirror", "list"),
    ("bridge | 12 | old\nroad | 7 | —\nwindow | 8 | quiet", "table"), ("bridge\t12\told\nroad\t7\t—\nwindow\t8\tquiet", "table"), ("#$% |^~ @@ ## $$ %^& *~ |", "junk"), ("zzz " * 40, "junk"), ("bphwx jsclxh xlvpqxsm kb tz qkdlnvsvgfz dpzgh", "junk"),
    (PROSE, None), ("The road was quiet,\nThe bridge was old;\nNobody noticed\nThe letter again.", None), ("THE END", None), (None, None), (" ", None), (PROSE * 3 + "\n\n- old road\n- bridge", None),
])
def test_shapes(text, shape):
    common = frozenset(w.strip(".,;").lower() for w in (PROSE * 2 + " the road end index old three nobody and").split())
    assert quality.Measure(common).stats(text)[-1] == shape


def test_statistics_by_hand():
    s = dict(zip(quality.NAMES, quality.Measure(frozenset(["the", "cat"])).stats("THE BIG CAT sat.\nTHE BIG CAT sat.\n\nthe dog"), strict=True))
    assert s["word_count"] == 10 and s["all_caps_run_count"] == 2 and s["is_thin"] and s["duplicate_line_share"] == pytest.approx(1 / 3)
    assert s["punctuated_line_share"] == pytest.approx(2 / 3) and s["common_word_share"] == pytest.approx(0.5)
    assert s["dominant_bigram_share"] == pytest.approx(14 / 32) and s["dominant_fourgram_share"] == pytest.approx(26 / 32) and s["duplicate_bigram_share"] == pytest.approx(1 / 3)


def test_counts_have_no_bound():
    s = dict(zip(quality.NAMES, quality.Measure(frozenset()).stats("a" * (1 << 25) + " b"), strict=True))
    assert s["word_count"] == 2 and s["mean_word_length"] == pytest.approx(((1 << 25) + 1) / 2)


def test_capitals_beside_signs_are_runs():
    s = dict(zip(quality.NAMES, quality.Measure(frozenset()).stats("TO ALL MINE, and “THE OLD MAN”"), strict=True))
    assert s["all_caps_run_count"] == 2


@pytest.mark.parametrize(("text", "shape"), [
    ("Back to the contents of this old book.\n" * 9 + PROSE, "boilerplate"), ("You are reading the old road. " * 30, "boilerplate"), ("a b c d " * 30, "junk"), (PROSE + "\n\nThe road was quiet.\n\n" + PROSE[:40], None),
])
def test_repetition_decides(text, shape):
    common = frozenset(w.strip(".,;").lower() for w in (PROSE + " back to the contents of this old book you are reading road a").split())
    assert quality.Measure(common).stats(text)[-1] == shape


def test_common_words_are_those_of_most_of_the_text(spark):
    rows = [("the road " * 500 + "of " * 90 + f"odd{c} strange{c}",) for c in "abcdef"]
    assert quality.common_words(spark.createDataFrame(rows, "document string"), "document") == {"the", "road", "of"}


# --- splitting -----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "sentence. ", "\n\n", "longerwordhere ", "A title\n", "x" * 37 + " "]), min_size=1, max_size=120).map("".join), st.integers(30, 80))
def test_pieces_cover_the_text(text, limit):
    overlap = limit // 5
    at, cuts = 0, []
    table = {p: (b, n) for p, b, n, _ in splitting.successors(text, ["A title"], limit, overlap)}
    while at < len(text):
        begin, end = table[at]
        assert 0 <= at - begin <= overlap and end - begin <= limit and end > at
        cuts.append((begin, end))
        at = end
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)


def test_pointer_doubling_is_greedy_cutting(spark, chapters):
    text = "".join(f"Sentence number {i} of the page goes here. " + ("\n\n" if i % 9 == 8 else "") for i in range(900))
    d = chapters([page(1, text), page(1, text), page(2, "y" * 8001), page(3, "z" * 8000)], nodes=[(1, "p1.xhtml#s", "Sentence number 9 of the page goes here.")])
    got = {(r["chapter_id"], r["piece_no"]): (r["begin"], r["end"], r["piece"]) for r in splitting.p7_pieces(spark, d).collect()}
    table = {p: (b, n) for p, b, n, _ in splitting.successors(text, [])}
    at, k = 0, 1
    while at < len(text):
        b, e = table[at]
        assert got[1, k] == (b, e, text[b:e])
        at, k = e, k + 1
    assert {c for c, _ in got} == {1, 2}


# --- scans ---------------------------------------------------------------------------------------------------


def printed(paragraphs, width=52, lines=14, header="THE QUIET ROAD", first=117, broken=True):
    """Set paragraphs in printed lines and pages, words divided at line ends."""
    out, page_lines, number = [], 0, first
    for text in paragraphs:
        words, line, rows = text.split(), "", []
        for w in words:
            if len(line) + len(w) + 1 > width:
                room = width - len(line) - 2
                if broken and len(w) > 5 and 1 < room < len(w) - 1:
                    line += " " + w[:room] + "-"
                    w = w[room:]
                rows.append(line.strip())
                line = ""
            line += " " + w
        rows.append(line.strip())
        for r in rows:
            out.append(r)
            page_lines += 1
            if page_lines % lines == 0:
                out += [f"- {number} -", header]
                number += 1
        out.append("")
    return "\n".join(out)


def test_scan_is_repaired(spark, chapters):
    paragraphs = [(PROSE * 3).strip(), (PROSE * 2).strip(), (PROSE * 4).strip()]
    clean = [page(k, "\n\n".join(paragraphs)) for k in range(1, 40)]
    scan = printed(paragraphs).replace("harbour", "harb0ur", 1)
    wrapped = printed(paragraphs, header="", lines=10_000, broken=False)
    d = chapters([*clean, page(50, scan), page(51, wrapped), page(52, "Dear Ann,\n\n" + PROSE + "\n\nYours\n\n1916")])
    found = {(r["chapter_id"], r["defect"]) for r in scans.p1_found(spark, d).collect()}
    assert found == {(50, x) for x in ("hyphenation", "misread", "running_header", "page_number")}
    out = {r["chapter_id"]: (r["document"], r["paragraphs"]) for r in scans.p1_repaired(spark, d).collect()}
    assert out[50] == ("\n\n".join(paragraphs), 3)
    assert out[51] == ("\n\n".join(paragraphs), 3)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_close_is_the_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert scans.close(a, b) == (row[-1] <= max(1, min(len(a), len(b)) // 6))


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_misread_words_dont_depend_on_the_size_of_the_corpus(size):
    counts = {"moon": 400, "rnoon": 4, "Collected": 36, "Collectecl": 2, "Olivia": 33, "Olivio": 2, "modern": 60, "modem": 30}
    v = scans.Vocabulary({w: n * size for w, n in counts.items()})
    assert [v.corrected(w) for w in ("rnoon", "Collectecl", "Olivio", "modem", "moon")] == ["moon", "Collected", "Olivia", None, None]


@pytest.mark.parametrize("bound", [1, 12, 25])
def test_rarer_words_are_joined(spark, chapters, monkeypatch, bound):
    paragraphs = [(PROSE * 3).strip(), (PROSE * 2).strip()]
    clean = [page(k, "\n\n".join(paragraphs) + (" The chimney." if k < 21 else " One chirnney and one lantem.") * (k % 2)) for k in range(1, 40)]
    scan = printed(paragraphs).replace("harbour", "harb0ur", 1).replace("lantern", "lantem", 1)
    d = chapters([*clean, page(50, scan), page(52, "Dear Ann,\n\n" + PROSE.replace("mirror", "rnirror") + "\n\nYours\n\n1916")])

    def results():
        return sorted(scans.p1_found(spark, d).collect()), sorted(scans.p1_repaired(spark, d).collect())

    want = results()
    assert {(50, "misread"), (52, "misread")} <= {tuple(r) for r in want[0]}
    monkeypatch.setattr(scans, "FREQUENT", bound)
    assert results() == want


def test_headers_known_from_the_book_need_no_repetition(spark, chapters):
    paragraphs = [(PROSE * 3).strip()]
    clean = [page(k, PROSE * 3, book=2) for k in range(1, 40)]
    one = printed(paragraphs, header="Ann Writer", lines=8).split("\n")
    first = one.index("Ann Writer")
    text = "\n".join([x for i, x in enumerate(one) if x != "Ann Writer" or i == first])
    d = chapters([*clean, page(60, text)])
    assert (60, "running_header") in {(r["chapter_id"], r["defect"]) for r in scans.p1_found(spark, d).collect()}


def test_counts_are_those_of_the_whole_corpus(spark, chapters):
    from textmend.llm.vocabulary import word_counts

    d = chapters([page(1, "a b-c a’s"), page(2, "a"), page(2, "a"), page(3, None)])
    got = {r["word"]: r["n"] for r in word_counts(spark.read.parquet(f"{d}/chapters.parquet"), "document").collect()}
    assert got == {"a": 3, "b": 1, "c": 1, "b-c": 1, "a’s": 1}
    assert F is not None


LONG_ERROR = (
    "404 Not Found\n\nThe page you are looking for could not be found. It might have been removed, had its name changed, or be temporarily unavailable. If you typed the address yourself, please make sure that the URL is spelled correctly. "
    "Click the back button of your browser to try another link, or go to the home page and look for the information there. If the error stays, write to the webmaster of this web site and say at what time it happened and which browser you used. We apologize for any inconvenience that this may have caused you today."
)


def test_messages_are_found_at_any_length():
    assert len(LONG_ERROR.split()) > 90
    assert residue.classify(LONG_ERROR) == "error"
    assert residue.classify(LONG_ERROR + "\n\n" + LONG_ERROR) == "error"
    prose = "The old joke went: a page not found is a page not read, said Pascoe. " + "Few had answered so patient a cellar as the one that the lantern lit that night. " * 8
    assert residue.classify(prose) is None
    assert residue.classify(prose * 20) is None
    assert residue.classify(prose + LONG_ERROR[:120]) is None


@pytest.mark.parametrize(("text", "kind"), [
    ("Dear {{ name }}, this is a tag of the old house and we will see you there", "placeholder"), ("Dear {{ name }}, this is a cat of the old house and we will see you there", "placeholder"),
    ("In such a template the tag {{ name }} means the reader", None), ("Write the tag {{ name }} where the reader should stand.", None), ("It was written that ${place} lay by the sea", "placeholder"),
    ("Use the placeholder {{ a }} here.\nThen {{ b }} comes.\nAnd the variable {{ c }} follows it.", None),
])
def test_what_a_sentence_speaks_of_is_no_residue(text, kind):
    assert residue.classify(text) == kind


def test_damaged_headers_are_known_from_other_pages(spark):
    headers = spark.createDataFrame([(1, "theoldlighthouse"), (1, "short"), (2, "annwriterofbooks")], "book_id long, skeleton string")
    rows = [(10, 1, "theoldlighthose"), (11, 1, "tholdlighthous"), (12, 1, "shrt"), (13, 2, "theoldlighthose"), (14, 1, "theoldmillhouse"), (15, 1, "theoldlighthouse"), (16, None, "theoldlighthose")]
    asked = spark.createDataFrame(rows, "chapter_id long, book_id long, skeleton string").selectExpr("*", "'candidate' AS defect")
    want = {k for k, b, s in rows for h in [r["skeleton"] for r in headers.collect() if r["book_id"] == b] if len(h) >= 7 and s != h and scans.close(s, h)}
    assert {r["chapter_id"] for r in scans.near_headers(asked, headers).collect()} == want == {10, 11}


def test_joined_keys_give_the_same_originals(spark, chapters):
    from textmend.llm import mojibake as m

    d = chapters([page(1, "größte grüßte grÃ¶ÃŸte gr��te café cafÃ© naïve"), page(2, "nothing here"), page(3, "cafÃ© cafÃ© gr??te")])
    words = spark.createDataFrame([("größte", 3), ("grüßte", 2), ("café", 2), ("grÃ¶ÃŸte", 1), ("gr��te", 1)], "word string, n long")
    forms = m.garbled_table(words).groupBy("key", "is_run").agg(F.max_by(F.struct("original", "chain", "n"), "n").alias("o"))
    found = spark.createDataFrame([("gr��te",), ("grÃ¶ÃŸte",)], "key string")
    sent, joined = ({tuple(r) for r in m.clean_originals(words, forms, found, most).collect()} for most in (10, 0))
    assert sent == joined and ("gr��te", "größte", "grüßte") in sent
    assert m.p5_restored(spark, d).count() == 2


@pytest.mark.parametrize(("text", "want"), [("ｶﾞｷﾞ ﾊﾟ", "ガギ パ"), ("ế", "ế"), ("ộ", "ộ"), ("ẹ́", "ẹ́"), ("a᷄", "a᷄"), ("\U000e0041x", "x"), ("ﬁ́", "fí")])
def test_further_marks_and_widths(text, want):
    import unicodedata as u

    out = normalform.transducer().apply(text)[0]
    assert out == want and u.is_normalized("NFC", out) and normalform.transducer().apply(out)[0] == out
