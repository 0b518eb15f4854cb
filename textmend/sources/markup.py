"""Tolerant parsing of XHTML pages into elements and text slots, and writing them back.

One scan splits a page into pieces of its source; elements and slots are numbered over them, so that what no repair
touches is written as it stood: names in their case, comments, declarations and entities stay. Elements come
with pre-order numbers and the number of the last descendant, so that "inside" is an interval test, and with
the interval of the page's text that is theirs, so that no ancestor repeats its descendants' text. Slots come in
reading order with their protection and inline neighbours. HTML rules hold: script and style are raw text,
void elements have no content, entities are decoded, elements left open end with their parent. Nothing
recurses, so pages may be nested as deeply as they like. Null and empty pages have no elements.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape, unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.plans.arrow import map_batches

# --- fixed values: elements by what they do --------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROTECTED = frozenset("pre code style script svg math".split())
INLINE = frozenset("a abbr b bdi bdo br cite data dfn em i img kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr".split())
BLOCKS = frozenset("p div blockquote ul ol li table pre section h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_RAW = frozenset(("script", "style"))

#: Columns of an element and how each is read off its node.
FIELDS = {
    "elem_no": ("int", lambda n: n.no), "end_no": ("int", lambda n: n.end), "parent_no": ("int", lambda n: n.parent.no if n.parent else None), "depth": ("int", lambda n: n.depth), "sib_no": ("int", lambda n: n.sib), "tag": ("string", lambda n: n.tag),
    "id": ("string", lambda n: n.attrs.get("id", "")), "classes": ("array<string>", lambda n: n.attrs.get("class", "").split()), "style": ("string", lambda n: n.attrs.get("style", "")), "attrs": ("map<string,string>", lambda n: list(n.attrs.items())),
    "text_from": ("int", lambda n: n.text_from), "text_to": ("int", lambda n: n.text_to), "n_children": ("int", lambda n: n.n_children),
}
SLOTS = "array<struct<slot_no:int,elem_no:int,host_tag:string,attr:string,text:string,protected:boolean,lead_inline:boolean,trail_inline:boolean>>"

_PIECE = re.compile(
    r"(?s)(?P<other><!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z](?:\[[^\]]*\]|\"[^\"]*\"|'[^']*'|[^>\[\"'])*>?)"
    r"|</(?P<end>[A-Za-z][^\s>/]*)[^>]*>"
    r"|<(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|(?P<text>[^<]+(?:<(?![A-Za-z/!?])[^<]*)*|<(?![A-Za-z/!?])[^<]*|<)"
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def _local(name: str) -> str:
    return name.rpartition(":")[2].lower()


class Node:
    """An element: its numbers, and the places of its tags among the pieces."""

    __slots__ = ("attrs", "depth", "end", "first", "last", "n_children", "name", "no", "parent", "sib", "tag", "text_from", "text_to")

    def __init__(self, no: int, name: str, attrs: dict[str, str], parent: Node | None, first: int) -> None:
        self.no, self.name, self.tag, self.attrs, self.parent = no, name, _local(name), attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.sib = parent.n_children if parent else 0
        if parent:
            parent.n_children += 1
        self.n_children = 0
        self.end, self.first, self.last = no, first, first
        self.text_from = self.text_to = 0


class Page:
    """A page as pieces of its source with the elements and slots over them."""

    def __init__(self, source: str) -> None:
        #: (kind, source): 's' start tag, 'e' end tag (empty where it is missing), 't' text, 'o' anything else
        self.pieces: list[tuple[str, str]] = []
        self.nodes: list[Node] = []
        self.slots: list[dict] = []
        #: slot number of each text piece that is one, node of each start tag
        self.slot_at: dict[int, int] = {}
        self.node_at: dict[int, Node] = {}
        self.text: list[str] = []
        self._scan(source)

    def _scan(self, source: str) -> None:
        opened: list[Node] = []
        names: dict[str, int] = {}
        #: last child of each open element, and the slots that wait for what comes after them
        before: list[Node | None] = []
        waiting: list[int | None] = []
        chars = 0

        def settle(inline: bool) -> None:
            if waiting and waiting[-1] is not None:
                self.slots[waiting[-1]]["trail_inline"] = inline
                waiting[-1] = None

        def close(end: str) -> None:
            node = opened.pop()
            settle(node.tag in INLINE)
            waiting.pop()
            before.pop()
            names[node.tag] -= 1
            node.last = len(self.pieces)
            node.end = len(self.nodes) - 1
            node.text_to = chars
            self.pieces.append(("e", end))

        def text(raw: str, value: str) -> None:
            nonlocal chars
            if opened and value:
                n = opened[-1]
                b = before[-1]
                self.slot_at[len(self.pieces)] = len(self.slots)
                settle(n.tag in INLINE)
                waiting[-1] = len(self.slots)
                self.slots.append({
                    "slot_no": len(self.slots), "elem_no": b.no if b else n.no, "host_tag": b.tag if b else n.tag, "attr": "tail" if b else "text", "text": value, "protected": any(names.get(t) for t in PROTECTED),
                    "lead_inline": b.tag in INLINE if b else n.tag in INLINE, "trail_inline": n.tag in INLINE,
                })
                self.text.append(value)
                chars += len(value)
            self.pieces.append(("t", raw))

        at = 0
        while at < len(source):
            # every place matches: a sign that begins no piece is text
            m = _PIECE.match(source, at)
            assert m is not None
            at = m.end()
            if m["text"] is not None:
                text(m.group(), unescape(m.group()))
            elif m["start"]:
                name = m["start"]
                tag = _local(name)
                inside = m["attrs"]
                if opened and tag in _CLOSES.get(opened[-1].tag, ()):
                    close("")
                parent = opened[-1] if opened else None
                attrs = {a[1].lower(): unescape(a[2].strip("\"'")) if a[2] else "" for a in _ATTRIBUTE.finditer(inside)}
                node = Node(len(self.nodes), name, attrs, parent, len(self.pieces))
                node.text_from = node.text_to = chars
                if opened:
                    settle(tag in INLINE)
                    before[-1] = node
                self.nodes.append(node)
                self.node_at[len(self.pieces)] = node
                self.pieces.append(("s", m.group()))
                if tag in VOID or inside.rstrip().endswith("/"):
                    continue
                opened.append(node)
                before.append(None)
                waiting.append(None)
                names[tag] = names.get(tag, 0) + 1
                if tag in _RAW:
                    stop = re.compile(rf"(?i)</{re.escape(name)}\s*>").search(source, at)
                    end = stop.start() if stop else len(source)
                    if end > at:
                        text(source[at:end], source[at:end])
                    at = end
            elif m["end"]:
                tag = _local(m["end"])
                if names.get(tag):
                    while opened[-1].tag != tag:
                        close("")
                    close(m.group())
                else:
                    self.pieces.append(("o", ""))
            elif m["cdata"] is not None:
                text(m.group(), m["cdata"])
            else:
                self.pieces.append(("o", m.group()))
        while opened:
            close("")

    def elements(self, fields: tuple[str, ...] = tuple(FIELDS)) -> list[dict]:
        read = [(f, FIELDS[f][1]) for f in fields]
        return [{f: get(n) for f, get in read} for n in self.nodes]

    def children(self, node: Node | None) -> list[Node]:
        """Child elements in order; those of None are the outermost ones."""
        out = []
        k = node.no + 1 if node else 0
        stop = node.end if node else len(self.nodes) - 1
        while k <= stop:
            out.append(self.nodes[k])
            k = self.nodes[k].end + 1
        return out

    def source(self, node: Node) -> str:
        """An element as it stands in the page."""
        return "".join(raw for _, raw in self.pieces[node.first : node.last + 1])


@dataclass
class Edits:
    """What is changed in a page: by slot or element number."""

    texts: dict[int, str] = field(default_factory=dict)
    removed: set[int] = field(default_factory=set)
    #: (first, second): the second one's content goes to the end of the first
    merged: list[tuple[int, int]] = field(default_factory=list)
    #: new values of attributes; None takes one away
    attrs: dict[int, dict[str, str | None]] = field(default_factory=dict)
    before: dict[int, str] = field(default_factory=dict)
    after: dict[int, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.texts or self.removed or self.merged or self.attrs or self.before or self.after)


def start_tag(raw: str, changes: dict[str, str | None]) -> str:
    """The start tag with attributes changed, added or taken away; the others stay as they are."""
    left = dict(changes)

    def one(m: re.Match) -> str:
        name = m[1].lower()
        if name not in changes:
            return m.group()
        left.pop(name, None)
        value = changes[name]
        return "" if value is None else f'{m[1]}="{escape(value, quote=True)}"'

    m = _PIECE.match(raw)
    assert m is not None
    head = raw[: m.start("attrs")]
    attrs = m["attrs"].rstrip()
    slash = attrs.endswith("/")
    attrs = re.sub(r"\s+(?=\s|$)", "", _ATTRIBUTE.sub(one, attrs.removesuffix("/").rstrip()))
    more = "".join(f' {k}="{escape(v, quote=True)}"' for k, v in left.items() if v is not None)
    return f"{head}{attrs}{more}{'/' if slash else ''}>"


def write(page: Page, edits: Edits) -> str:
    """The page with its edits; elements left open are closed. What stands after a removed element stays."""
    ends = {n.last: n for n in page.nodes if n.last > n.first}
    second = {b for _, b in edits.merged} - edits.removed
    follows = {a: b for a, b in edits.merged if b not in edits.removed}
    out: list[str] = []
    #: ranges of pieces to write: [place, end, element whose content it is, at its beginning]
    todo: list[list] = [[0, len(page.pieces), None, False]]
    while todo:
        frame = todo[-1]
        place, stop, whose, fresh = frame
        if place >= stop:
            todo.pop()
            if whose is not None and whose in follows:
                z = page.nodes[follows.pop(whose)]
                out.append(" ")
                todo.append([z.first + 1, z.last, z.no, True])
            continue
        frame[0], frame[3] = place + 1, False
        kind, raw = page.pieces[place]
        if kind == "s":
            node = page.node_at[place]
            if node.no in edits.removed or node.no in second:
                frame[0] = node.last + 1
                continue
            out.append(edits.before.get(node.no, ""))
            if node.no in edits.attrs:
                raw = start_tag(raw, edits.attrs[node.no])
            if node.tag in VOID and not raw[:-1].rstrip().endswith("/"):
                raw = raw[:-1] + "/>"
            out.append(raw)
            if node.last == node.first:
                out.append(edits.after.get(node.no, ""))
        elif kind == "e":
            node = ends[place]
            if node.no in follows:
                z = page.nodes[follows.pop(node.no)]
                frame[0] = place
                out.append(" ")
                todo.append([z.first + 1, z.last, z.no, True])
                continue
            out.append(raw or f"</{node.name}>")
            out.append(edits.after.get(node.no, ""))
        elif kind == "t" and place in page.slot_at:
            slot = page.slots[page.slot_at[place]]
            new = edits.texts.get(slot["slot_no"], slot["text"])
            if fresh:
                new = new.lstrip()
            if new != slot["text"]:
                raw = new if slot["host_tag"] in _RAW and slot["attr"] == "text" else escape(new, quote=False)
            out.append(raw)
        else:
            out.append(raw)
    return "".join(out)


def render(html: str, texts: list[str], removed: set[int], merged: list[tuple[int, int]]) -> str:
    """The page with its text slots replaced, elements removed and paragraphs merged; as it was if nothing changes."""
    page = Page(html)
    edits = Edits({s["slot_no"]: t for s, t in zip(page.slots, texts, strict=False) if s["text"] != t}, set(removed), list(merged))
    return write(page, edits) if edits else html


def parse(html: str | None) -> tuple[list[dict], list[dict]]:
    """(elements, slots) of a page."""
    if not html:
        return [], []
    page = Page(html)
    return page.elements(), page.slots


def parsed(pages: DataFrame, html: str, *keys: str, fields: tuple[str, ...] = tuple(FIELDS), slots: bool = True) -> DataFrame:
    """(keys, text, elements, slots) of each page: the elements' ``fields`` that are wanted, slots unless they aren't.

    Prune columns and rows before, nothing can be pushed through the parser.
    """
    types = dict(pages.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", text string"
    schema += f", elements array<struct<{','.join(f'{f}:{FIELDS[f][0]}' for f in fields)}>>" if fields else ""
    schema += f", slots {SLOTS}" if slots else ""

    def run(cols: dict[str, list]) -> dict[str, list]:
        all_pages = [Page(x or "") for x in cols[html]]
        out = {k: cols[k] for k in keys} | {"text": ["".join(p.text) for p in all_pages]}
        if fields:
            out["elements"] = [p.elements(fields) for p in all_pages]
        if slots:
            out["slots"] = [p.slots for p in all_pages]
        return out

    return map_batches(pages.select(*keys, html), schema, run)


def text_of(page_text: Column, element: Column) -> Column:
    """The text of an element: an interval of its page's."""
    return F.substr(page_text, element["text_from"] + 1, element["text_to"] - element["text_from"])


def elements(pages: DataFrame, html: str, *keys: str, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """One row an element."""
    return parsed(pages, html, *keys, fields=fields, slots=False).select(*keys, F.inline("elements"))


def slots(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """One row a text slot."""
    return parsed(pages, html, *keys, fields=()).select(*keys, F.inline("slots"))
