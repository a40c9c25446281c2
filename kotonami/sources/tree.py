"""Pages as a table of numbered nodes, and selectors matched while the nodes are numbered.

``nodes`` parses each page once. A node's ``pre`` is its place in document order and ``last`` that of its last
descendant, so that descendants are a range, children and siblings equal parents; these are joins and windows
over the table. Selectors are lists of steps; all of them are followed in one walk, as states in a bit mask.

Each use of the table is a parse of all pages. A query that would join the table with itself takes ``gathered`` instead:
texts know the selected elements they are below, so that one grouping of one use brings them together.

A page that is null, or that breaks the parser, is one row with the tag ``#broken`` and no places. Keys must tell pages apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from . import html

#: Places in a block of the range join.
BLOCK = 256
_FIELDS = "pre int, last int, parent int, depth int, tag string, classes array<string>, attrs map<string,string>, data string, matched array<string>, within array<int>"
#: Rows, and places in ``within``, of an Arrow batch of nodes.
_MOST = 1 << 14


@dataclass(frozen=True)
class Step:
    """What an element must be, and how it stands to that of the step before.

    ``how``: ``" "`` below it, ``">"`` its child, ``"+"`` the next element beside it, ``"~"`` a later one.
    ``attrs``: (name, test, value), the test one of ``=`` equal, ``^=`` begins with, ``*=`` contains, ``?`` present.
    """

    tag: str | None = None
    cls: str | None = None
    attrs: tuple[tuple[str, str, str], ...] = ()
    how: str = " "

    def fits(self, node: html.Node) -> bool:
        if self.cls is not None and self.cls not in node.classes:
            return False
        for name, test, value in self.attrs:
            own = node.attrs.get(name)
            if own is None:
                return False
            if not {"=": own == value, "^=": own.startswith(value), "*=": value in own, "?": True}[test]:
                return False
        return True


class Automaton:
    """All selectors as states: bit k is set where the k-th of all steps is met."""

    def __init__(self, selectors: dict[str, list[Step]]):
        self.steps, self.first, self.final = [], 0, {}
        self.reached = dict.fromkeys(" >+~", 0)
        for name, steps in selectors.items():
            for k, step in enumerate(steps):
                bit = 1 << len(self.steps)
                if k == 0:
                    self.first |= bit
                else:
                    self.reached[step.how] |= bit
                self.steps.append(step)
            self.final[1 << (len(self.steps) - 1)] = name
        self.by_tag: dict[str, int] = {}

    def _of_tag(self, tag: str) -> int:
        if tag not in self.by_tag:
            self.by_tag[tag] = sum(1 << k for k, s in enumerate(self.steps) if s.tag in (None, tag))
        return self.by_tag[tag]

    def met(self, node: html.Node, above: int, parent: int, before: int, beside: int) -> int:
        """States of a node: from those of all nodes above, of its parent, of all elements before it, and of the one before it."""
        ways = ((" ", above), (">", parent), ("~", before), ("+", beside))
        open_ = self.first
        for how, states in ways:
            open_ |= (states << 1) & self.reached[how]
        open_ &= self._of_tag(node.tag)
        out = 0
        while open_:
            bit = open_ & -open_
            open_ ^= bit
            if self.steps[bit.bit_length() - 1].fits(node):
                out |= bit
        return out

    def names(self, states: int) -> list[str]:
        return [name for bit, name in self.final.items() if states & bit]


def _numbered(page: str | None, automaton: Automaton, texts_of: frozenset[str], only: bool) -> Iterator[tuple]:
    top = None
    if page is not None:
        try:
            top = html.parse(page)
        except Exception:  # whatever a foreign page makes the parser raise
            pass
    if top is None:
        if not only:
            yield None, None, None, None, "#broken", [], None, None, [], []
        return
    kept: list[tuple] = []
    parents: list[int | None] = []
    stack = [(top, None, 0, 0, None)]
    states: list[int] = []  # of each place
    sides: list[list[int]] = []  # of each place: states of its element children so far, of the last of them
    over: list[int | None] = []  # of each place: the nearest element above whose texts are asked for
    while stack:
        node, parent, depth, above, inside = stack.pop()
        place = len(states)
        own, matched = 0, []
        if node.tag[0] != "#":
            side = sides[parent]
            own = automaton.met(node, above, states[parent], *side)
            side[:] = side[0] | own, own
            matched = automaton.names(own)
        states.append(own)
        sides.append([0, 0])
        parents.append(parent)
        over.append(inside)
        if not only or matched or node.tag == "#comment" or (node.tag == "#text" and inside is not None):
            kept.append((place, depth, node, matched))
        below_ = place if not texts_of.isdisjoint(matched) else inside
        stack.extend((child, place, depth + 1, above | own, below_) for child in reversed(node.children))
    last = list(range(len(parents)))
    for place in range(len(last) - 1, 0, -1):
        last[parents[place]] = max(last[parents[place]], last[place])
    for place, depth, node, matched in kept:
        element, within, at = node.tag[0] != "#", [], over[place] if node.tag == "#text" else None
        while at is not None:
            within.append(at)
            at = over[at]
        yield place, last[place], parents[place], depth, node.tag, node.classes if element else [], list(node.attrs.items()) if element else None, None if element else node.data, matched, within[::-1]


def _number_batches(selectors: dict[str, list[Step]], schema: pa.Schema, texts_of: frozenset[str], only: bool):
    def made(keys: pa.Array, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of, pa.int32())), *columns], schema.names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(selectors)
        for batch in batches:
            keys, pages = batch.columns
            of, rows, held = [], [], 0
            for i in range(batch.num_rows):
                for row in _numbered(pages[i].as_py(), automaton, texts_of, only):
                    of.append(i)
                    rows.append(row)
                    held += 1 + len(row[-1])
                    if held >= _MOST:
                        yield made(keys, of, rows)
                        of, rows, held = [], [], 0
            if rows:
                yield made(keys, of, rows)

    return run


def nodes(
    pages: DataFrame, key: str, page: str = "html", selectors: dict[str, list[Step]] | None = None, texts_of: tuple[str, ...] = (), only: bool = False
) -> DataFrame:
    """A row for each node of each page: ``key``, its numbers and content, and the names of the selectors that it meets.

    ``parent`` is the parent's ``pre``; texts and comments have the tags ``#text`` and ``#comment`` and ``data``. ``within`` of a text:
    the places of the elements above it that meet a selector of ``texts_of``. With ``only`` no rows but those of elements that meet a
    selector, of texts within one of ``texts_of``, and of comments; numbers stay those of the whole page.
    """
    rows = pages.select(pages[key].alias("key"), pages[page].alias("page"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL(_FIELDS)])
    return rows.mapInArrow(_number_batches(selectors or {}, to_arrow_schema(schema), frozenset(texts_of), only), schema)


def gathered(table: DataFrame, name: str, of_texts: Column) -> DataFrame:
    """(key, pre, parent, tag, matched, attrs, data, ``name``) of each node but texts, by one use of ``table``, dealt by ``key``.

    ``of_texts`` aggregates the texts within the node: ``at``, their places, and ``said``, their data.
    """
    is_text = F.col("tag") == "#text"
    own = F.when(~is_text, F.struct("parent", "tag", "matched", "attrs", "data"))
    said = F.when(is_text, F.struct(F.col("pre").alias("at"), F.col("data").alias("said")))
    tops = F.explode(F.when(is_text, F.col("within")).otherwise(F.array("pre")))
    each = table.select("key", tops.alias("top"), own.alias("own"), said.alias("text")).repartition("key").select("key", "top", "own", "text.*")
    grouped = each.groupBy("key", F.col("top").alias("pre")).agg(F.first("own", ignorenulls=True).alias("own"), of_texts.alias(name))
    return grouped.select("key", "pre", "own.*", name)


def joined(separator: str = "") -> Column:
    """For ``gathered``: the texts in order, stripped, without empty ones; no text at all is empty."""
    data = text.strip(F.col("said"))
    parts = F.array_sort(F.collect_list(F.when(data != "", F.struct("at", data.alias("data")))))
    return F.array_join(F.transform(parts, lambda x: x["data"]), separator)


def _block(place: str) -> Column:
    return F.floor(F.col(place) / BLOCK)


def below(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(key, top, and the columns of ``inner``) of nodes of ``inner`` below nodes of ``outer``, whose ``pre`` is ``top``.

    A range join: an outer node meets inner ones in the blocks of places it reaches over.
    """
    reach = outer.where("last > pre").select("key", F.col("pre").alias("top"), F.col("last").alias("end"), F.explode(F.sequence(_block("pre"), _block("last"))).alias("block"))
    met = reach.join(inner.withColumn("block", _block("pre")), ["key", "block"])
    return met.where("pre > top AND pre <= end").drop("block", "end")


def children(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(key, top, and the columns of ``inner``) of nodes of ``inner`` whose parent is in ``outer``."""
    return outer.select("key", F.col("pre").alias("top")).join(inner.withColumn("top", F.col("parent")), ["key", "top"])


def with_next(table: DataFrame, tag: str, name: str = "next", value: Column | None = None) -> DataFrame:
    """``table`` with the ``pre``, or ``value``, of the next sibling element ``tag``, whatever lies between; null for none.

    The table has at least all elements ``tag`` beside the nodes asked for.
    """
    later = Window.partitionBy("key", "parent").orderBy(F.col("pre").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn(name, F.last(F.when(F.col("tag") == tag, F.col("pre") if value is None else value), ignorenulls=True).over(later))


def texts(table: DataFrame, tops: DataFrame, separator: str = "", strip: bool = True) -> DataFrame:
    """(key, pre, text) of the nodes ``tops``: the texts below each, in order, without empty ones; no text at all is empty."""
    data = text.strip(F.col("data")) if strip else F.col("data")
    parts = table.where("tag = '#text'").select("key", "pre", data.alias("data")).where("data != ''")
    listed = below(tops, parts).groupBy("key", F.col("top").alias("pre")).agg(F.array_sort(F.collect_list(F.struct(F.col("pre").alias("at"), "data"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["data"]), separator)
    return tops.select("key", "pre").join(listed, ["key", "pre"], "left").select("key", "pre", F.coalesce(joined, F.lit("")).alias("text"))
