"""Ordered alignment of a sentence's tokens with the morae of its accented reading.

Each token is sought from where the one before it ended, which no built-in function can do in linear time (a
fold copies its state for every token). So an Arrow batch function carries the position among the morae and returns
spans only, found by binary search among the sorted places of each mora's text; what is put
in and what the spans become are built-in functions.
"""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

_SUB = "array<struct<furigana:string,surface:string>>"
TOKENS = f"array<struct<surface:string,furigana:string,subword:{_SUB}>>"
MORAE = "array<struct<text:string,accent:int>>"
_MARK = "struct<furigana:string,accent_marking_type:int,length:int>"
_ACCENT = f"array<{_MARK}>"
RESULT = f"array<struct<furigana:string,surface:string,accent:{_ACCENT},subword:{_SUB}>>"
#: Marks that a skipped token may step over.
PAUSES = ("、", "。", ",", ".")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Where the morae of a token begin and end, and which way the token goes.
SPANS = "array<struct<q:int,e:int,kind:string>>"


class _Texts:
    """Texts of morae: running lengths, and the sorted places of each text."""

    def __init__(self, texts: list[str | None]):
        self.sums = [0, *itertools.accumulate(len(t or "") for t in texts)]
        self.places: dict[str, list[int]] = {}
        for k, t in enumerate(texts):
            if t is not None:
                self.places.setdefault(t, []).append(k)
        self.widths = sorted({len(t) for t in self.places})

    def beginning(self, reading: str | None, begin: int) -> int:
        """The first place from ``begin`` on whose text begins ``reading``, else the number of texts."""
        first = len(self.sums) - 1
        if reading is None:
            return first
        for width in self.widths:
            if width > len(reading):
                break
            places = self.places.get(reading[:width], ())
            k = bisect.bisect_left(places, begin)
            if k < len(places):
                first = min(first, places[k])
        return first

    def reaching(self, length: int | None, begin: int) -> int:
        """The first place from ``begin`` on before which texts of ``length`` characters or more lie, else the number of texts."""
        n = len(self.sums) - 1
        return n if length is None else min(n, bisect.bisect_left(self.sums, self.sums[begin] + length, begin))


def _walk(tokens: list[dict], raw: list, folded: list, bare: list) -> list[dict]:
    """Spans of the tokens of one request, the cursor going from each to the next."""
    n, p, out = len(raw), 0, []
    lengths, starts, bares = _Texts(raw), _Texts(folded), _Texts(bare)
    for token, after in zip(tokens, [*tokens[1:], {"reading": ""}], strict=False):
        reading, number = token["reading"], token["numeric"]
        if number:
            q = p
            e = bares.reaching(max(4 * token["surface"], 12) + 1, q)
            if after["reading"]:
                e = min(e, bares.beginning(after["reading"], q))
            matched = bares.sums[e] > bares.sums[q]
        else:
            q = starts.beginning(reading, p)
            e = lengths.reaching(token["length"], q)
            matched = lengths.sums[e] - lengths.sums[q] == token["length"] and "".join(t or "" for t in folded[q:e]) == reading
        kind = "skip" if token["skipped"] else "match" if matched else "fallback"
        out.append({"q": q, "e": e, "kind": kind})
        if matched and not token["skipped"]:
            p = e
        elif p < n:
            p += not token["skipped"] or bare[p] in PAUSES
    return out


def _spans(tokens: Column, raw: Column, folded: Column, bare: Column) -> Column:
    """``SPANS`` of each row: one pass over its tokens, each placed by binary search, so long requests take linear time."""

    def batch(*arrays: pa.Array) -> pa.Array:
        rows = zip(*[a.to_pylist() for a in arrays], strict=True)
        kind = pa.list_(pa.struct([("q", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
        return pa.array([None if None in row else _walk(*row) for row in rows], kind)

    return F.arrow_udf(batch, SPANS)(tokens, raw, folded, bare)


def align(tokens: Column, morae: Column) -> Column:
    """``RESULT``: each token of ``tokens`` (``TOKENS``) with the accents of the morae it covers.

    * A token that is not all kana or kanji, has no subwords and is no number is passed on with accent
      0 over its surface; a pause mark at the cursor is stepped over.
    * Any other seeks the first mora with which its reading begins, takes morae up to the length of
      its reading, and matches if both read alike. A number takes morae up to where the next
      token's reading begins, or a limit of length.
    * Without a match the reading gets accent 0, subwords go, and the cursor moves by one.
    """
    tokens, morae = tokens.cast(TOKENS), morae.cast(MORAE)
    raw = F.transform(morae, lambda m: m["text"])
    folded = F.transform(raw, text.to_hiragana)
    bare = F.transform(raw, lambda t: text.to_hiragana(text.strip(t)))
    return let(
        F.struct(
            tokens.alias("tokens"),
            _spans(F.transform(tokens, _known), raw, folded, bare).alias("spans"),
            F.transform(morae, lambda m: F.struct(m["text"], m["accent"], F.char_length(m["text"])).cast(_MARK)).alias("raw"),
            F.zip_with(bare, morae, lambda t, m: F.struct(t, m["accent"], F.char_length(t)).cast(_MARK)).alias("bare"),
        ),
        lambda s: F.zip_with(s["tokens"], s["spans"], lambda token, span: _emit(s, token, span)),
    )


def _known(token: Column) -> Column:
    """What the walk needs of a token."""
    numeric = F.coalesce(text.is_numeric(token["surface"]), F.lit(False))
    skipped = (F.size(token["subword"]) <= 0) & text.has_other_script(token["furigana"]) & ~numeric
    return F.struct(
        text.to_hiragana(token["furigana"]).alias("reading"),
        F.char_length(token["furigana"]).alias("length"),
        F.coalesce(F.char_length(token["surface"]), F.lit(0)).alias("surface"),
        numeric.alias("numeric"),
        F.coalesce(skipped, F.lit(False)).alias("skipped"),
    )


def _emit(s: Column, token: Column, span: Column) -> Column:
    match, skip, numeric = span["kind"] == "match", span["kind"] == "skip", text.is_numeric(token["surface"])

    def flat(word: Column) -> Column:
        return F.array(F.struct(word, F.lit(0), F.char_length(word))).cast(_ACCENT)

    def taken(marks: Column) -> Column:
        return F.slice(marks, span["q"] + 1, F.greatest(span["e"] - span["q"], F.lit(0)))

    none = F.array().cast(_SUB)
    read = F.array_join(F.transform(taken(s["bare"]), lambda m: m["furigana"]), "")
    marks = F.when(numeric, taken(s["bare"])).otherwise(taken(s["raw"]))
    return F.struct(
        F.when(match & numeric, read).otherwise(token["furigana"]).alias("furigana"),
        token["surface"].alias("surface"),
        F.when(match, marks).when(skip, flat(token["surface"])).otherwise(flat(token["furigana"])).alias("accent"),
        F.when(match, F.coalesce(token["subword"], none)).otherwise(none).alias("subword"),
    )
