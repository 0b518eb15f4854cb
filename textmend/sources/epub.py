"""Zipped books as tables, and tables as zipped books.

``archives`` reads files, ``entries`` opens them (one row an entry), ``packages`` parses package document,
reading order and table of contents into rows. Files that can't be repaired come out of ``archives`` with their
checks and no content, so that nothing is lost silently. Undecodable bytes of pages are replaced, not dropped.
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches
from textmend.sources import container

PACKAGE = "book string, kind string, n int, depth int, id string, href string, media_type string, properties string, label string, value string"
_FIELDS = [x.split()[0] for x in PACKAGE.split(", ")]
_META = ("title", "creator", "language", "publisher", "identifier", "description", "date", "rights", "subject")


def archives(spark: SparkSession, path: str, repair: bool = True) -> DataFrame:
    """(book, content, valid, failed, actions): every file below the path, repaired where needed and allowed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return checked(files.select(F.col("path").alias("book"), "content"), repair)


def checked(files: DataFrame, repair: bool = True) -> DataFrame:
    """Checks and repairs of (book, content)."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"book": cols["book"], "content": [], "valid": [], "failed": [], "actions": []}
        for data in cols["content"]:
            checks = container.check(data)
            ok = container.valid(checks)
            out["valid"].append(ok)
            out["failed"].append(next((n for n, passed, _ in checks if not passed), None))
            new, done = (data, []) if ok or not repair else container.repair(data)
            out["content"].append(new if ok or repair else None)
            out["actions"].append(done)
        return out

    key = dict(files.dtypes)["book"]
    return map_batches(files, f"book {key}, content binary, valid boolean, failed string, actions array<string>", run)


def entries(books: DataFrame) -> DataFrame:
    """(book, name, size, data): one row an entry of every readable book."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"book": [], "name": [], "size": [], "data": []}
        for book, content in zip(cols["book"], cols["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        for name, x in zip(out, (book, i.filename, i.file_size, z.read(i)), strict=True):
                            out[name].append(x)
        return out

    return map_batches(books.where("content IS NOT NULL").select("book", "content"), f"book {dict(books.dtypes)['book']}, name string, size long, data binary", run)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def resolve(base: str, href: str) -> str:
    """href against the folder of the file that has it; the fragment is kept."""
    if not href or href.startswith("#"):
        return href
    path, mark, fragment = href.partition("#")
    return posixpath.normpath(posixpath.join(base, path)) + mark + fragment


def package_rows(content: bytes) -> list[dict]:
    """Rows of one book: 'meta', 'item', 'spine' and 'toc'."""
    rows: list[dict] = []

    def put(kind: str, n: int, **more: object) -> None:
        rows.append({"kind": kind, "n": n} | more)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        path = container.root_file(z.read(container.CONTAINER)) if container.CONTAINER in names else None
        if not path or path not in names:
            return rows
        opf = ET.fromstring(z.read(path))
        base = posixpath.dirname(path)
        put("meta", 0, label="version", value=opf.get("version") or "")
        for i, e in enumerate(opf.iter()):
            if _local(e.tag) in _META and "purl.org/dc" in e.tag:
                put("meta", i + 1, label=_local(e.tag), value=(e.text or "").strip())
        cover = next((e.get("content", "") for e in opf.iter() if _local(e.tag) == "meta" and e.get("name") == "cover"), "")
        if cover:
            put("meta", 9_999, label="cover", value=cover)
        items = [e for e in opf.iter() if _local(e.tag) == "item"]
        for i, e in enumerate(items):
            put("item", i, id=e.get("id", ""), href=resolve(base, e.get("href", "")), media_type=e.get("media-type", ""), properties=e.get("properties", ""))
        for i, e in enumerate(e for e in opf.iter() if _local(e.tag) == "itemref"):
            put("spine", i, id=e.get("idref", ""))
        toc: list[tuple[int, str, str]] = []
        ncx = next((resolve(base, e.get("href", "")) for e in items if e.get("media-type") == "application/x-dtbncx+xml"), None)
        nav = next((resolve(base, e.get("href", "")) for e in items if "nav" in (e.get("properties") or "").split()), None)
        source = ""
        for source, file in (("ncx", ncx), ("nav", nav)):
            if toc or not file or file not in names:
                continue
            try:
                tree = ET.fromstring(z.read(file))
            except ET.ParseError:
                continue
            folder = posixpath.dirname(file)
            toc = _ncx(tree, folder) if source == "ncx" else _nav(tree, folder)
            if toc:
                put("meta", 10_000, label="toc_source", value=source)
        for i, (depth, label, href) in enumerate(toc):
            put("toc", i, depth=depth, label=label, href=href)
    return rows


def _ncx(tree: ET.Element, folder: str) -> list[tuple[int, str, str]]:
    out: list[tuple[int, str, str]] = []

    def walk(e: ET.Element, depth: int) -> None:
        for p in e:
            if _local(p.tag) == "navPoint":
                label = "".join(next((x for x in p if _local(x.tag) == "navLabel"), ET.Element("x")).itertext()).strip()
                src = next((x.get("src", "") for x in p if _local(x.tag) == "content"), "")
                out.append((depth, label, resolve(folder, src)))
                walk(p, depth + 1)

    for m in tree.iter():
        if _local(m.tag) == "navMap":
            walk(m, 1)
            break
    return out


def _nav(tree: ET.Element, folder: str) -> list[tuple[int, str, str]]:
    out: list[tuple[int, str, str]] = []

    def walk(ol: ET.Element, depth: int) -> None:
        for li in ol:
            a = next((x for x in li if _local(x.tag) == "a"), None)
            label = a if a is not None else next((x for x in li if _local(x.tag) == "span"), None)
            if label is not None:
                out.append((depth, "".join(label.itertext()).strip(), resolve(folder, a.get("href", "") if a is not None else "")))
            for inner in li:
                if _local(inner.tag) == "ol":
                    walk(inner, depth + 1)

    for n in tree.iter():
        if _local(n.tag) == "nav" and any(k.rpartition("}")[2] == "type" and v == "toc" for k, v in n.attrib.items()):
            for ol in n:
                if _local(ol.tag) == "ol":
                    walk(ol, 1)
            break
    return out


def packages(books: DataFrame) -> DataFrame:
    """Rows of all books' packages; a book whose package doesn't parse has none."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f: [] for f in _FIELDS}
        for book, content in zip(cols["book"], cols["content"], strict=True):
            try:
                rows = package_rows(content)
            except (ET.ParseError, zipfile.BadZipFile, KeyError):
                rows = []
            for r in rows:
                for f in _FIELDS:
                    out[f].append(book if f == "book" else r.get(f))
        return out

    return map_batches(books.where("content IS NOT NULL").select("book", "content"), PACKAGE, run)


def page_texts(files: DataFrame) -> DataFrame:
    """(book, name, html) of the pages among the entries."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"book": cols["book"], "name": cols["name"], "html": [d.decode("utf-8-sig", "replace") for d in cols["data"]]}

    return map_batches(files.where(F.lower("name").rlike(r"\.x?html?$")).select("book", "name", "data"), "book string, name string, html string", run)


def pack(files: DataFrame) -> DataFrame:
    """(book, content): books packed from (book, name, data). A book is one file, so its entries meet in one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"book": [g["book"].iloc[0]], "content": [container.packed(dict(zip(g["name"], map(bytes, g["data"]), strict=True)))]})

    return files.groupBy("book").applyInPandas(run, "book string, content binary")
