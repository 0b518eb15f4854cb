"""Edits of one page or style sheet: chapter divisions, standard classes, page breaks, boilerplate.

Which pages and elements are concerned is decided by plans over all books; what an edit does to a page is local to it.
All edits are idempotent.
"""

from __future__ import annotations

import re

from textmend.operators.styles import STANDARD, STRIPPED
from textmend.sources.markup import BLOCKS, HEADINGS, Edits, Node, Page

#: An element that a chapter begins with, and what marks one that has been divided.
CHAPTER_BLOCKS = frozenset("p div li blockquote h1 h2 h3 h4 h5 h6".split())
DONE = "data-textmend-chapter"
WRAPPER = "chapter-wrapper"
OPS = "http://www.idpf.org/2007/ops"

_DECLARATION = re.compile(r"([a-zA-Z-]+)\s*:\s*([^;]+)")
_SIMPLE = re.compile(r"^([a-zA-Z][a-zA-Z0-9]*)?\.([a-zA-Z_-][\w-]*)$")
_SHEET_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMMENT = re.compile(r"(?s)/\*.*?\*/")


def free_name(taken: set[str], wish: str, next_name) -> str:
    """The first name that isn't taken: the wish, then ``next_name(2)`` and so on."""
    n, name = 1, wish
    while name in taken:
        n += 1
        name = next_name(n)
    return name


def ancestors(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def last_block(page: Page, node: Node) -> Node | None:
    """The last block that one meets in reading an element, itself included."""
    path = [node]
    while (inner := page.children(path[-1])):
        path.append(inner[-1])
    return next((n for n in reversed(path) if n.tag in BLOCKS), None)


def block_before(page: Page, node: Node) -> Node | None:
    """The nearest block that ends before an element, in reading order; its ancestors are none."""
    for up in ancestors(node):
        sisters = page.children(up.parent)
        for other in reversed(sisters[: sisters.index(up)]):
            found = last_block(page, other)
            if found is not None:
                return found
    return None


def styled(edits: Edits, node: Node) -> str:
    """The style attribute as it is after the edits made so far."""
    return edits.attrs.get(node.no, {}).get("style", node.attrs.get("style", "")) or ""


def break_after(edits: Edits, node: Node | None) -> None:
    """A page break after a block, unless it has one."""
    if node is None:
        return
    style = styled(edits, node)
    if "page-break-after" not in style.lower():
        parts = [p.strip() for p in style.split(";") if p.strip()] + ["page-break-after: always", "break-after: page"]
        edits.attrs.setdefault(node.no, {})["style"] = "; ".join(parts) + ";"


def chapter_block(node: Node) -> Node:
    """The block that a marker stands in; the outermost element if there is none."""
    up = list(ancestors(node))
    return next((n for n in up if n.tag in CHAPTER_BLOCKS), up[-1])


def divide(page: Page, edits: Edits, markers: list[tuple[int, int]], first_page: bool) -> None:
    """Put each chapter into a division of its own, with a page break before it. markers: (element number, chapter number), in order;
    a chapter goes to the next marker among the same sisters, or to their end. The first chapter of a book that begins its
    first page gets no break."""
    used = {n.attrs["id"] for n in page.nodes if n.attrs.get("id")}
    groups: dict[int, list[tuple[Node, int]]] = {}
    for no, number in markers:
        block = chapter_block(page.nodes[no])
        if block.parent is not None and DONE not in block.attrs and block.no not in edits.removed:
            group = groups.setdefault(block.parent.no, [])
            if all(b is not block for b, _ in group):
                group.append((block, number))
    for parent, blocks in groups.items():
        sisters = page.children(page.nodes[parent])
        for k, (block, number) in enumerate(blocks):
            until = blocks[k + 1][0] if k + 1 < len(blocks) else None
            at = sisters.index(block)
            last = sisters[sisters.index(until) - 1] if until is not None else sisters[-1]
            name = free_name(used, f"chapter-{number}", lambda n, w=f"chapter-{number}": f"{w}-{n}")
            used.add(name)
            attrs = {DONE: "true"}
            style = ""
            if not (first_page and at == 0 and number == 1):
                style = ' style="display: block !important; margin-top: 0 !important; padding-top: 1px !important;"'
                attrs["style"] = f"clear: both; {styled(edits, block)}".strip()
                break_after(edits, block_before(page, block))
            edits.attrs.setdefault(block.no, {}).update(attrs)
            # anchors at the end of what stands before belong to the chapter
            moved = ""
            if at:
                before = sisters[at - 1]
                for a in page.nodes[before.no : before.end + 1]:
                    if a.tag == "a" and a.no != before.no and (a.attrs.get("id") or a.attrs.get("name")) and not any(u.no in edits.removed for u in ancestors(a)):
                        moved += page.source(a)
                        edits.removed.add(a.no)
            edits.before[block.no] = edits.before.get(block.no, "") + f'<div xmlns:epub="{OPS}" epub:type="chapter" id="{name}" class="{WRAPPER}"{style}>{moved}'
            edits.after[last.no] = "</div>" + edits.after.get(last.no, "")


def stripped_style(style: str, heading: bool) -> str:
    drop = {*STRIPPED, *(("page-break-before", "break-before") if heading else ())}
    return " ".join(f"{m[1]}: {m[2].strip()};" for m in _DECLARATION.finditer(style) if m[1].lower() not in drop)


def standard_css(text: str, mapping: dict[str, tuple[str, str]]) -> str:
    """A style sheet in which the rules of mapped classes (old name -> role, new name) take the standard of their role; the other
    selectors of a rule keep its body. Comments are dropped where something changes."""

    def rule(m: re.Match) -> str:
        selectors = [s.strip() for s in m[1].split(",")]
        if m[1].strip()[:1] in ("", "@"):
            return m.group()
        by_role: dict[str, list[str]] = {}
        rest = []
        for s in selectors:
            simple = _SIMPLE.match(s)
            if simple and simple[2] in mapping:
                role, new = mapping[simple[2]]
                by_role.setdefault(role, []).append(f"{simple[1] or ''}.{new}")
            else:
                rest.append(s)
        if not by_role:
            return m.group()
        rules = [f"{', '.join(dict.fromkeys(s))} {{ {STANDARD[role]} }}" for role, s in by_role.items()]
        return "\n" + "\n".join([*rules, *([f"{', '.join(rest)} {{{m[2]}}}"] if rest else [])])

    clean = _COMMENT.sub("", text)
    new = _SHEET_RULE.sub(rule, clean)
    return text if new == clean else new


def standardise(page: Page, edits: Edits, mapping: dict[str, tuple[str, str]]) -> None:
    """Mapped classes under their new names, without inline styles that fight the standard, and a page break before headings."""
    headings = {new for role, new in mapping.values() if role == "chapter-heading"}
    breaks = []
    for n in page.nodes:
        if n.tag == "style":
            continue
        old = n.attrs.get("class", "").split()
        new = list(dict.fromkeys(mapping[c][1] if c in mapping else c for c in old))
        roles = {mapping[c][0] for c in old if c in mapping}
        if roles:
            if new != old:
                edits.attrs.setdefault(n.no, {})["class"] = " ".join(new)
            style = styled(edits, n)
            kept = stripped_style(style, "chapter-heading" in roles)
            if style and kept != style:
                edits.attrs.setdefault(n.no, {})["style"] = kept or None
        if headings & set(new):
            breaks.append(n)
    for n in breaks:
        break_after(edits, block_before(page, n))
    for s in page.slots:
        if s["host_tag"] == "style" and s["attr"] == "text":
            css = standard_css(s["text"], mapping)
            if css != s["text"]:
                edits.texts[s["slot_no"]] = css


def under_body(page: Page, no: int) -> tuple[list[Node], Node] | None:
    """(children of the body, the one that an element stands in)."""
    body = next((n for n in page.nodes if n.tag == "body"), None)
    top = next((n for n in ancestors(page.nodes[no]) if n.parent is body and body is not None), None)
    return (page.children(body), top) if top is not None else None


def without_front(page: Page, no: int, tagged: bool) -> set[int]:
    """What goes with the opening boilerplate: its wrapper, or its block and what stands before it up to a heading."""
    found = under_body(page, no)
    if found is None:
        return set()
    sisters, top = found
    gone = {top.no}
    if not tagged:
        for other in reversed(sisters[: sisters.index(top)]):
            if other.tag in HEADINGS:
                break
            gone.add(other.no)
    return gone


def without_back(page: Page, no: int) -> set[int]:
    """The block of the closing boilerplate and all that follows it."""
    found = under_body(page, no)
    return {n.no for n in found[0] if n.no >= found[1].no} if found else set()


def only_boilerplate(page: Page, no: int) -> bool:
    """The body holds nothing but the element that the boilerplate stands in."""
    found = under_body(page, no)
    if found is None:
        return False
    top = found[1]
    body = top.parent
    text = "".join(page.text)
    return not (text[body.text_from : top.text_from] + text[top.text_to : body.text_to]).strip()


