"""Integrity of zipped books: ordered checks, and repair of the container where it is safe.

Works on the bytes of one file. Checks stop at the first failure. A repair only changes the container (junk
before the first entry, a lost index, a missing or dangling pointer to the package), never an entry's data.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

CONTAINER = "META-INF/container.xml"
CHECKS = ("signature", "opens", "intact", "container", "package")
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"


def root_file(xml: bytes) -> str | None:
    """Path of the package document that a container file names."""
    try:
        tree = ET.fromstring(xml)
    except ET.ParseError:
        return None
    node = next((e for e in tree.iter() if e.tag.rpartition("}")[2] == "rootfile"), None)
    return node.get("full-path") if node is not None else None


def check(data: bytes | None) -> list[tuple[str, bool, str]]:
    """(name, passed, detail) of the checks made."""
    out: list[tuple[str, bool, str]] = []

    def said(name: str, passed: bool, detail: str = "") -> bool:
        out.append((name, passed, detail))
        return passed

    if not said("signature", bool(data) and data[:2] == b"PK", "" if data and data[:2] == b"PK" else "no ZIP file"):
        return out
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError, struct.error) as e:
        said("opens", False, str(e))
        return out
    said("opens", True)
    with archive:
        try:
            names = archive.namelist()
            bad = archive.testzip() if names else "no entries"
        except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError, RuntimeError) as e:
            bad, names = str(e), []
        except Exception as e:  # broken compressed data raises errors of the decompressor
            bad, names = type(e).__name__, []
        if not said("intact", bad is None, bad or ""):
            return out
        if not said("container", CONTAINER in names, "" if CONTAINER in names else "missing"):
            return out
        path = root_file(archive.read(CONTAINER))
        said("package", path in names if path else False, path or "no rootfile")
    return out


def valid(checks: list[tuple[str, bool, str]]) -> bool:
    return len(checks) == len(CHECKS) and all(ok for _, ok, _ in checks)


def _clean(data: bytes) -> bool:
    return [ok for _, ok, _ in check(data)][:3] == [True] * 3


def rebuilt_index(data: bytes) -> bytes | None:
    """The file with an index made anew by walking its local headers; None where sizes can't be trusted."""
    entries, at = [], 0
    while at < len(data) and data[at : at + 4] not in (_CENTRAL, _END):
        head = data[at : at + 30]
        if head[:4] != _LOCAL or len(head) < 30:
            return None
        _, flags, method, time, date, crc, packed, size, n, extra = struct.unpack("<HHHHHIIIHH", head[4:])
        stop = at + 30 + n + extra + packed
        # sizes written after the data can't be known before it
        if flags & 8 or stop > len(data):
            return None
        entries.append((data[at + 30 : at + 30 + n], flags, method, time, date, crc, packed, size, at))
        at = stop
    if not entries:
        return None
    body, index = data[:at], b""
    for name, flags, method, time, date, crc, packed, size, offset in entries:
        index += _CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, flags, method, time, date, crc, packed, size, len(name), 0, 0, 0, 0, 0, offset) + name
    return body + index + _END + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(index), len(body), 0)


def with_entry(data: bytes, name: str, content: bytes) -> bytes:
    """The archive with one entry replaced or added; the type declaration stays first and unpacked."""
    with zipfile.ZipFile(io.BytesIO(data)) as old:
        files = {i: old.read(i) for i in old.namelist()}
    return packed(files | {name: content})


def packed(files: dict[str, bytes]) -> bytes:
    """A ZIP of the files: the type declaration first and stored, the rest packed, with fixed times."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files, key=lambda n: n != "mimetype"):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, files[name])
    return out.getvalue()


def container_xml(package: str) -> bytes:
    return (
        '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
        f'<rootfile full-path={quoteattr(package)} media-type="application/oebps-package+xml"/></rootfiles></container>'
    ).encode()


def repair(data: bytes | None) -> tuple[bytes | None, list[str]]:
    """(valid file or None, what was done). A valid file is returned as it is."""
    if valid(check(data)):
        return data, []
    done: list[str] = []
    if not data:
        return None, done
    if data[:2] != b"PK" and (start := data.find(_LOCAL)) > 0:
        data = data[start:]
        done.append("trimmed")
    if not _clean(data):
        new = rebuilt_index(data)
        if new is None or not _clean(new):
            return None, [*done, "index lost"]
        data = new
        done.append("reindexed")
    if not valid(check(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            packages = [n for n in z.namelist() if re.search(r"(?i)\.opf$", n)]
        if len(packages) != 1:
            return None, [*done, f"{len(packages)} packages"]
        data = with_entry(data, CONTAINER, container_xml(packages[0]))
        done.append("container rewritten")
    return (data, done) if valid(check(data)) else (None, done)
