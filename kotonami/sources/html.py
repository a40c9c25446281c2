"""Records from captured web pages, through a small tree over the standard library's parser.

The pages are not well-formed (unclosed tags), so XPath cannot read them. Each extraction is a
function of an Arrow batch of pages; a page that breaks, in whatever way, gives null, which callers report as an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element, a text (tag ``#text``) or a comment (``#comment``)."""

    __slots__ = ("tag", "attrs", "children", "parent", "data", "place", "following")

    def __init__(self, tag: str, parent: Node | None = None, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.parent, self.attrs, self.data = tag, parent, attrs or {}, data
        self.children: list[Node] = []
        self.place = len(parent.children) if parent is not None else 0
        self.following: dict[str, list[Node | None]] = {}
        if parent is not None:
            parent.children.append(self)

    def walk(self) -> Iterator[Node]:
        """All descendants in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find(self, tag: str, cls: str | None = None, where: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        for node in self.walk():
            if node.tag == tag and (cls is None or cls in node.classes) and (where is None or where(node)):
                yield node

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def direct(self, tag: str) -> list[Node]:
        return [c for c in self.children if c.tag == tag]

    def next_sibling(self, tag: str) -> Node | None:
        """The next element ``tag`` under the same parent, which remembers them for all of its children."""
        if tag not in self.parent.following:
            after, last = [], None
            for child in reversed(self.parent.children):
                after.append(last)
                last = child if child.tag == tag else last
            self.parent.following[tag] = after[::-1]
        return self.parent.following[tag][self.place]

    def comments(self) -> list[str]:
        return [n.data for n in self.walk() if n.tag == "#comment"]

    def text(self, separator: str = "", strip: bool = True) -> str:
        parts = (n.data for n in self.walk() if n.tag == "#text")
        return separator.join(p for x in parts if (p := x.strip() if strip else x))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, self.at, {k: v or "" for k, v in reversed(attrs)})
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        Node(tag, self.at, {k: v or "" for k, v in reversed(attrs)})

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        Node("#text", self.at, data=data)

    def handle_comment(self, data):
        Node("#comment", self.at, data=data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.top


def _extract(read: Callable[[Node], object], kind: pa.DataType, ddl: str) -> Callable[[Column], Column]:
    def one(page: str | None):
        if page is None:
            return None
        try:
            return read(parse(page))
        except Exception:  # whatever a foreign page makes the parser or the reader raise
            return None

    def batch(pages: pa.Array) -> pa.Array:
        return pa.array([one(page) for page in pages.to_pylist()], kind)

    # Made at the call: parsing the type needs a session, importing this module does not.
    def extract(page: Column) -> Column:
        return F.arrow_udf(batch, ddl)(page)

    return extract


def _text_list() -> pa.DataType:
    return pa.list_(pa.string())


def _number(text: str) -> int:
    """The number in ``text``; a number beyond 64 bits counts as unreadable."""
    value = int(text)
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError("number out of range")
    return value


def _entry_ids(page: Node) -> list[str]:
    rows = []
    for tr in page.find("tr", "resrow"):
        field = next(tr.find("input", where=lambda n: n.attrs.get("name") == "e"), None)
        if field is not None and "value" in field.attrs:
            rows.append(field.attrs["value"])
    return rows


def _entry(page: Node) -> dict:
    def inside(node: Node, outer: str, inner: str) -> list[Node]:
        """Different ``span.inner`` below a ``span.outer``, in order."""
        seen: dict[int, Node] = {}
        for out in node.find("span", outer):
            seen |= {id(n): n for n in out.find("span", inner)}
        return list(seen.values())

    senses = [
        {
            "pos": [n.text(" ") for n in inside(sense, "pos", "abbr")],
            "meanings": [n.text(" ").replace("▶", "").strip() for n in sense.find("span", "glossx")],
        }
        for sense in page.find("tr", "sense")
    ]
    link = next(page.find("a", where=lambda n: n.attrs.get("href", "").startswith("srchres.py")), None)
    return {
        "kanji": [n.text() for n in page.find("span", "kanj")],
        "furigana": [n.text() for n in page.find("span", "rdng")],
        "definitions": senses,
        "id": _number(link.text()) if link is not None else 0,
    }


def _example_blocks(page: Node) -> list[dict]:
    blocks = []
    for block in page.find("div", where=lambda n: "clear" in n.attrs.get("style", "")):
        fonts = (br.next_sibling("font") for br in block.find("br"))
        lines = [f.text(" ") for f in fonts if f is not None and f.attrs.get("size") == "-1"]
        blocks.append({"comments": block.comments(), "lines": lines})
    return blocks


def _phrases(page: Node) -> list[dict]:
    texts, subscripts = list(page.find("div", "phrasing_text")), list(page.find("div", "phrasing_subscript"))
    out = []
    for above, below in zip(texts, subscripts, strict=False):
        morae = [{"text": m.text(strip=False), "classes": m.classes} for m in above.direct("span")]
        if any(not m["classes"] for m in morae):
            raise ValueError("a mora without a class")
        out.append({"surface": "".join(s.text(strip=False) for s in below.direct("span")), "morae": morae})
    return out


ENTRY = "struct<kanji:array<string>,furigana:array<string>,definitions:array<struct<pos:array<string>,meanings:array<string>>>,id:bigint>"
_SENSE = pa.struct([("pos", _text_list()), ("meanings", _text_list())])
_ENTRY = pa.struct([("kanji", _text_list()), ("furigana", _text_list()), ("definitions", pa.list_(_SENSE)), ("id", pa.int64())])
_BLOCK = pa.struct([("comments", _text_list()), ("lines", _text_list())])
_MORA = pa.struct([("text", pa.string()), ("classes", _text_list())])
_PHRASE = pa.struct([("surface", pa.string()), ("morae", pa.list_(_MORA))])

#: Values of the entry fields of a search page's result rows.
entry_ids = _extract(_entry_ids, _text_list(), "array<string>")
#: A dictionary entry page as a record.
entry = _extract(_entry, _ENTRY, ENTRY)
#: Blocks of example sentences: their comments, and the lines that follow line breaks.
example_blocks = _extract(_example_blocks, pa.list_(_BLOCK), "array<struct<comments:array<string>,lines:array<string>>>")
#: Phrases of an accent page, texts and subscripts paired up to the shorter list; null if a mora has no class.
phrases = _extract(
    _phrases, pa.list_(_PHRASE), "array<struct<surface:string,morae:array<struct<text:string,classes:array<string>>>>>"
)
#: Texts of all elements ``div.ad``.
ad_texts = _extract(lambda page: [n.text(" ") for n in page.find("div", "ad")], _text_list(), "array<string>")
