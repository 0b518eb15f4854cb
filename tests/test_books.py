"""Synthetic books from container to repaired file."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmend.operators.containers import broken
from textmend.plans import corpus
from textmend.sources import config, container, edits, epub, markup
from textmend.streaming import watch

OPF = """<package version="2.0" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> T </dc:title><dc:subject>Letters</dc:subject></metadata>
<manifest><item id="a" href="text/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="i" href="img/i.png" media-type="image/png"/></manifest>
<spine><itemref idref="b"/><itemref idref="a"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>First</text></navLabel><content src="text/b.xhtml#x"/><navPoint><navLabel><text>In</text></navLabel><content src="text/a.xhtml"/></navPoint></navPoint></navMap></ncx>"""
A = '<html><body><p>Wait... don t stop</p><p></p><p>Page 7</p><img src="../img/i.png"/><img src="no.png"/>tail<pre> a  b... </pre></body></html>'
B = "<html><body><p>The sentence that began here</p><p>went on with four words.</p><p>New one &amp; all</p></body></html>"


def book() -> bytes:
    return container.packed({"mimetype": b"application/epub+zip", container.CONTAINER: container.container_xml("O/p.opf"), "O/p.opf": OPF.encode(), "O/toc.ncx": NCX.encode(), "O/text/a.xhtml": A.encode(), "O/text/b.xhtml": B.encode(), "O/img/i.png": b"\x89PNG"})


def test_checks_and_repairs():
    assert container.valid(container.check(book()))
    fine = {0, 7}
    for way in range(8):
        data = broken(1, "text", way)
        assert container.valid(container.check(data)) == (way in fine)
        new, done = container.repair(data)
        assert (new is not None) == (way in fine | {1, 2, 3, 4})
        assert bool(done) != (way in fine)
    assert container.repair(None)[0] is None
    bad = bytearray(book())
    bad[60] ^= 255
    assert not container.valid(container.check(bytes(bad)))


def test_streamed_entries_are_not_guessed():
    out = io.BytesIO()

    class Pipe:  # not seekable: sizes go behind the data
        def write(self, b):
            return out.write(b)

        def flush(self):
            pass

    with zipfile.ZipFile(Pipe(), "w") as z:
        z.writestr("x", "y" * 50)
    assert container.rebuilt_index(out.getvalue()[: out.getvalue().find(b"PK\x01\x02")]) is None


def test_parse_is_tolerant():
    e, s = markup.parse('<div><p>a<b>c</p><p>d<br>e<script>x</p>y</script></div>&copy;')
    assert [x["tag"] for x in e] == ["div", "p", "b", "p", "br", "script"]
    assert e[0]["end_no"] == 5 and e[2]["parent_no"] == 1
    assert [x["protected"] for x in s if x["host_tag"] == "script"] == [True]
    assert markup.parse(None) == ([], []) and markup.parse("") == ([], [])


def test_packages(spark):
    rows = epub.package_rows(book())
    assert [r["id"] for r in rows if r["kind"] == "spine"] == ["b", "a"]
    assert [(r["depth"], r["label"], r["href"]) for r in rows if r["kind"] == "toc"] == [(1, "First", "O/text/b.xhtml#x"), (2, "In", "O/text/a.xhtml")]
    assert {r["label"]: r["value"] for r in rows if r["kind"] == "meta"}["title"] == "T"


def test_repair_corpus(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.epub").write_bytes(b"junk" + book())
    (tmp_path / "in" / "y.epub").write_bytes(b"nothing")
    out = corpus.repair_corpus(spark, str(tmp_path / "in")).collect()
    assert len(out) == 1
    with zipfile.ZipFile(io.BytesIO(out[0]["content"])) as z:
        assert z.namelist()[0] == "mimetype"
        a, b, opf, nav = (z.read(f"O/{n}").decode() for n in ("text/a.xhtml", "text/b.xhtml", "p.opf", "nav.xhtml"))
        assert z.read("O/img/i.png") == b"\x89PNG"
    assert "Wait… don't stop" in a and "no.png" not in a and "i.png" in a and "tail" in a and "Page 7" not in a and "<pre> a  b... </pre>" in a
    assert "began here went on with four words." in b and "&amp;" in b
    assert 'version="3.0"' in opf and nav.index("First") < nav.index("In")
    assert container.valid(container.check(bytes(out[0]["content"])))


def test_analysis(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(book())
    t = corpus.analyze_corpus(spark, str(tmp_path))
    assert t["containers"].first()["valid"]
    assert {r["name"]: r["ascii_ellipses"] for r in t["typography"].collect()} == {"O/text/a.xhtml": 2, "O/text/b.xhtml": 0}
    assert t["issues"].where("before LIKE 'Wait%'").count() == 1


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.epub").write_bytes(book())
    for _ in range(2):
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    config.write_default(str(f))
    assert config.load(str(f)) == config.Settings() == config.load()
    with pytest.raises(FileExistsError):
        config.write_default(str(f))
    f.write_text("[repair]\nnope = true\n")
    with pytest.raises(ValueError, match="unknown"):
        config.load(str(f))
    f.write_text('[[class]]\nold_name = "a"\nnew_name = "b"\nrole = "body-text"\n[[class]]\nold_name = "a"\nnew_name = "c"\nrole = "body-text"\n')
    with pytest.raises(ValueError, match="twice"):
        config.load_mapping(str(f))
    assert config.apostrophe("auto", 1, 2) == "’"


# --- markup ------------------------------------------------------------------------------------------------------

SVG = '<?xml version="1.0"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "x.dtd">\n<html xmlns="http://www.w3.org/1999/xhtml"><!-- kept --><body><svg viewBox="0 0 9 9" preserveAspectRatio="none"><linearGradient id=\'g\'/></svg><p>a &amp; b&nbsp;</p><p>Two</p>tail</body></html>\n'


def test_markup_stays_as_it_stands():
    page = markup.Page(SVG)
    assert markup.write(page, markup.Edits()) == SVG == markup.render(SVG, [s["text"] for s in page.slots], set(), [])
    new = markup.render(SVG, [s["text"].replace("Two", "2 < 3") for s in page.slots], set(), [])
    assert new == SVG.replace("Two", "2 &lt; 3")


def test_deep_pages_are_no_trouble():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    page = markup.Page(deep)
    assert page.nodes[-1].depth == 19_999 and markup.write(page, markup.Edits()) == deep and page.slots[0]["text"] == "x"


@settings(max_examples=200, deadline=None)
@given(st.text("<>/ab=\"'!-& ;x", max_size=60))
def test_any_text_parses(text):
    page = markup.Page(text)
    markup.write(page, markup.Edits())
    assert all(n.no <= n.end < len(page.nodes) and n.text_from <= n.text_to for n in page.nodes)


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.text("ab &<", max_size=4).map(escape), lambda kids: st.lists(kids, max_size=4).map(lambda k: "<p class='c'>" + "".join(k) + "</p >").map(lambda x: x.replace("<p", "<b").replace("</p", "</b")), max_leaves=12))
def test_well_formed_markup_round_trips(body):
    source = f"<div>{body}</div>"
    page = markup.Page(source)
    assert markup.write(page, markup.Edits()) == source
    assert "".join(page.text) == "".join(s["text"] for s in page.slots)


def test_slots_by_hand():
    _, slots = markup.parse("<p>a<b>c</b> d <pre> x </pre></p>")
    assert [(s["text"], s["host_tag"], s["attr"], s["protected"], s["lead_inline"], s["trail_inline"]) for s in slots] == [
        ("a", "p", "text", False, False, True), ("c", "b", "text", False, True, True), (" d ", "b", "tail", False, True, False), (" x ", "pre", "text", True, False, False),
    ]


# --- edits ---------------------------------------------------------------------------------------------------------


def divided(html, markers, first=True):
    page, e = markup.Page(html), markup.Edits()
    edits.divide(page, e, markers, first)
    return markup.write(page, e)


def test_chapters_are_divided_once():
    html = '<html><body><p>CHAPTER I</p><p>one</p><p>end<a id="two"/></p><p>CHAPTER <b>II</b></p><p>two</p></body></html>'
    out = divided(html, [(2, 1), (6, 2)])
    assert out.count("<div ") == 2 and 'id="chapter-1" class="chapter-wrapper">' in out
    assert '<p style="page-break-after: always; break-after: page;">end</p>' in out and out.index('<a id="two"/>') > out.index('id="chapter-2"')
    again = markup.Page(out)
    assert divided(out, [(n.no, k) for k, n in enumerate(again.nodes) if edits.DONE in n.attrs]) == out
    assert 'id="chapter-1-2"' in divided('<body><p id="chapter-1">x</p><p>I</p></body>', [(2, 1)], False)


def test_classes_are_standardised():
    mapping = {"c1": ("body-text", "body"), "c2": ("chapter-heading", "chapter-header")}
    css = "/* x */ p.c1, .other {color: red} .c3 {a: b} @media print {.c2 {c: d}}"
    out = edits.standard_css(css, mapping)
    assert "p.body { text-align: left;" in out and ".other {color: red}" in out and ".chapter-header { text-align: center;" in out and ".c3 {a: b}" in out
    assert edits.standard_css(out, mapping) == out and edits.standard_css("/* a */ .z{}", mapping) == "/* a */ .z{}"
    page, e = markup.Page('<body><p>before</p><p class="c2 c1 c2" style="color: red; page-break-before: always; margin: 0">T</p></body>'), markup.Edits()
    edits.standardise(page, e, mapping)
    assert markup.write(page, e) == '<body><p style="page-break-after: always; break-after: page;">before</p><p class="chapter-header body" style="margin: 0;">T</p></body>'


def test_boilerplate_of_a_page():
    html = "<html><body><h1>Title</h1><p>The Project</p><p>*** START ***</p><p>text</p></body></html>"
    page = markup.Page(html)
    assert edits.without_front(page, 4, False) == {3, 4} and edits.without_front(page, 4, True) == {4} and edits.without_back(page, 4) == {4, 5}
    assert not edits.only_boilerplate(page, 4) and edits.only_boilerplate(markup.Page("<body> <footer><p>x</p></footer>\n</body>"), 2)
    assert edits.without_front(markup.Page("<p>x</p>"), 0, True) == set()


START, END = "*** START OF THE PROJECT GUTENBERG EBOOK T ***", "*** END OF THE PROJECT GUTENBERG EBOOK T ***"
CHAPTER = "".join(f"<p>{'word ' * 60}{k}.</p>" for k in range(2))


def whole_book():
    pages = {
        "p1": f"<html><body><h1>T</h1><p>legal</p><p>{START}</p><p>preface</p></body></html>",
        "p2": "<html><body>" + "".join(f'<p class="h">CHAPTER {n}</p>{CHAPTER}' for n in ("I", "II", "III")) + "</body></html>",
        "p3": f"<html><body><p>last</p><p>{END}</p><p>licence</p></body></html>", "p4": "<html><body><p>small print</p></body></html>",
        "nav": '<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="p2.xhtml">Text</a></li><li><a href="p4.xhtml">Licence</a></li></ol></nav></body></html>',
    }
    items = "".join(f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml"{" properties=" + chr(34) + "nav" + chr(34) if k == "nav" else ""}/>' for k in pages)
    opf = f'<package version="3.0" xmlns="http://www.idpf.org/2007/opf"><metadata><meta name="cover" content="gone"/></metadata><manifest>{items}<item id="s" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="p1"/><itemref idref="p2"/><itemref idref="p3"/><itemref idref="p4"/></spine></package>'
    return container.packed({"mimetype": b"application/epub+zip", container.CONTAINER: container.container_xml("p.opf"), "p.opf": opf.encode(), "s.css": b".h{font-weight:bold}", **{f"{k}.xhtml": v.encode() for k, v in pages.items()}})


def test_boilerplate_chapters_and_classes_of_a_book(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(whole_book())
    mapping = [{"old_name": "h", "role": "chapter-heading", "new_name": "chapter-header"}]
    with zipfile.ZipFile(io.BytesIO(corpus.repair_corpus(spark, str(tmp_path), mapping=mapping).first()["content"])) as z:
        names = set(z.namelist())
        p1, p2, p3, nav, opf, css = (z.read(n).decode() for n in ("p1.xhtml", "p2.xhtml", "p3.xhtml", "nav.xhtml", "p.opf", "s.css"))
    assert "p4.xhtml" not in names and 'idref="p4"' not in opf and 'href="p4.xhtml"' not in opf + nav and 'href="p2.xhtml"' in nav
    assert "<h1>T</h1><p>preface</p>" in p1 and "<p>last</p></body>" in p3
    assert p2.count('epub:type="chapter"') == 3 and p2.count('class="chapter-header"') == 3 and ".chapter-header {" in css
    report = {(r["location"], r["category"]): r["n"] for r in corpus.repair_report(spark, str(tmp_path)).collect()}
    assert report["p2.xhtml", "chapters"] == 3 and report["p4.xhtml", "whole pages of boilerplate"] == 1 and ("p1.xhtml", "opening boilerplate") in report
    off = config.Settings(boilerplate_front=False, boilerplate_back=False, chapter_marks=False)
    assert corpus.repair_report(spark, str(tmp_path), off).count() == 0


def test_structure_classes_and_covers_of_a_book(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(whole_book())
    t = corpus.analyze_corpus(spark, str(tmp_path))
    rows = t["structure"].orderBy("number").collect()
    assert [(r["title"], r["name"], r["clean"], r["entry_no"]) for r in rows] == [("CHAPTER I", "p2.xhtml", True, 0), ("CHAPTER II", "p2.xhtml", True, None), ("CHAPTER III", "p2.xhtml", True, None)]
    # no blank stands between the texts of two elements: their words run together
    assert all(120 <= r["content_words"] <= 124 for r in rows)
    assert [r["confidence"] for r in rows] == ["corroborated", "sequence only", "sequence only"]
    assert corpus.structure_report(t["structure"])[-1] == "Some boundary can be split at."
    assert t["covers"].first()["status"] == "dangling cover id gone"
    assert {r["class"]: r["role"] for r in t["classes"].collect()} == {"h": "unknown"}


def test_file_and_id_of_the_navigation_are_free():
    opf = '<package version="2.0"><manifest><item id="nav" href="nav.xhtml"/></manifest></package>'
    assert '<item id="nav1" href="nav1.xhtml"' in corpus.package(opf, "", set(), "nav1.xhtml", "now")
    assert edits.free_name({"nav.xhtml", "nav1.xhtml"}, "nav.xhtml", lambda n: f"nav{n - 1}.xhtml") == "nav2.xhtml"


def test_a_batch_run_again_repeats_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("x", bytearray(book()))], "book string, content binary")
    for _ in range(2):
        watch.write_batch(batch, 7, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 1


def test_commands(spark, tmp_path, capsys):
    from textmend.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.epub").write_bytes(whole_book())
    (tmp_path / "in" / "y.epub").write_bytes(b"junk" + book())
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert main(["validate", folder]) == 1 and main(["validate", folder, "--repair"]) == 0
    assert "failed: signature; trimmed; repaired" in capsys.readouterr().out
    assert main(["map-structure", folder]) == 0
    assert "- CHAPTER II: sequence only" in capsys.readouterr().out
    mapping = str(tmp_path / "m.toml")
    assert main(["map-css", folder, "--write-mapping", mapping]) == 0 and ".h: used 3x, mostly <p> 100%" in capsys.readouterr().out
    assert config.load_mapping(mapping) == []
    assert main(["repair", folder]) == 2
    assert main(["repair", folder, "--dry-run", "--verbose"]) == 0 and "p2.xhtml: chapters: 3" in capsys.readouterr().out
    assert main(["repair", folder, "-o", out, "--class-mapping", mapping]) == 0 and spark.read.parquet(out).count() == 2
    assert main(["analyze", folder, "-o", out, "--json", "--details"]) == 0 and main(["analyze", folder, "-o", out, "--json"]) == 0
    assert main(["init-config", "-o", str(tmp_path / "c.toml")]) == 0


def test_intermediate_tables_are_removed(spark, tmp_path):
    import os

    from textmend.plans import runtime

    df = runtime.stage(spark.range(3).toDF("x"), "some")
    folder = runtime.stage_dir(spark)
    assert df.count() == 3 and os.listdir(folder)
    runtime.clean(spark)
    assert not os.path.exists(folder)
