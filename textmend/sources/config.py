"""Settings: which repairs run and how, read from TOML; unknown keys and values are errors."""

from __future__ import annotations

import re
import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Every switch is on unless turned off."""

    empty_paragraphs: bool = True
    junk_paragraphs: bool = True
    split_sentences: bool = True
    broken_images: bool = True
    boilerplate_front: bool = True
    boilerplate_back: bool = True
    upgrade: bool = True
    chapter_marks: bool = True
    ellipses: bool = True
    ellipsis_style: str = "unicode"
    apostrophes: bool = True
    apostrophe_style: str = "auto"
    whitespace: bool = True
    repair_containers: bool = True


#: Roles that a mapping may give a class.
ROLE_CLASSES = ("chapter-heading", "body-text")
_CHOICES = {"ellipsis_style": ("unicode", "ascii"), "apostrophe_style": ("auto", "straight", "curly")}


def load(path: str | None = None) -> Settings:
    """Settings of a file; the defaults without one. A named file has to exist."""
    if path is None:
        return Settings()
    with open(path, "rb") as f:
        given = tomllib.load(f).get("repair", {})
    known = {x.name: x.type for x in fields(Settings)}
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"unknown setting: {key}")
        if key in _CHOICES and value not in _CHOICES[key]:
            raise ValueError(f"{key} must be one of {', '.join(_CHOICES[key])}")
        if key not in _CHOICES and not isinstance(value, bool):
            raise ValueError(f"{key} must be true or false")
    return Settings(**given)


def write_default(path: str) -> None:
    """Write the defaults; an existing file is never overwritten."""
    lines = ["[repair]", *(f"{k} = {str(v).lower() if isinstance(v, bool) else repr(v).replace(chr(39), chr(34))}" for k, v in asdict(Settings()).items())]
    with open(path, "x", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def load_mapping(path: str) -> list[dict[str, str]]:
    """Class mapping: [[class]] tables with old_name, new_name and role; names must be class tokens, old ones unique."""
    rows = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("class", [])
    seen: set[str] = set()
    for r in rows:
        if r.get("role") not in ROLE_CLASSES:
            raise ValueError(f"unknown role: {r.get('role')}")
        for k in ("old_name", "new_name"):
            if not re.fullmatch(r"[A-Za-z_-][\w-]*", r.get(k, "")):
                raise ValueError(f"{k} is no class name: {r.get(k)!r}")
        if r["old_name"] in seen:
            raise ValueError(f"{r['old_name']} is mapped twice")
        seen.add(r["old_name"])
    return rows


def apostrophe(style: str, straight: int, curly: int) -> str:
    """The apostrophe to write: as forced, or as the book mostly has it."""
    return "’" if style == "curly" or style == "auto" and curly > straight else "'"
