"""Lexicon search: a term meets rows by one exact and two suffix keys of its script's class."""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, web

EQ, EW = "eq", "ew"
#: Reversed keys of a block, about, and the most blocks: a lexicon of more than 16 million keys has larger ones.
BLOCK_KEYS = 4_096
MOST_BLOCKS = 4_096
#: Characters of a key by which blocks are cut.
SPLIT_CHARS = 256
#: Terms of a part of a block.
PART_TERMS = 100_000
#: Class of a term -> (field, operation) rules, any of which suffices.
RULES = {
    text.YOMI: (("yomi1", EQ), ("yomi2", EW), ("yomi3", EW)),
    text.ROMAJI: (("romaji1", EQ), ("romaji2", EW), ("romaji3", EW)),
    text.HEADWORD: (("headword", EQ),),
}
RESULT = ("id", "headword_id", "headword", "yomi_display", "romaji_display", "freq")


def search_key(word: Column) -> Column:
    """What a word is compared as: kana in katakana, anything else as it is."""
    return F.when(text.text_type(word) == text.YOMI, text.to_katakana(word)).otherwise(word)


def rule_json(word: Column) -> Column:
    """The rules of a word as the JSON filter that a search service takes; null for an empty word."""
    out, key = None, search_key(word)
    for kind, rules in RULES.items():
        own = F.to_json(
            F.struct(
                F.lit("OR").alias("groupOp"),
                F.array(
                    *[F.struct(F.lit(f).alias("field"), F.lit(op).alias("op"), key.alias("data")) for f, op in rules]
                ).alias("rules"),
            )
        )
        hit = text.text_type(word) == kind
        out = F.when(hit, own) if out is None else out.when(hit, own)
    return out


def matches_term(term: str, kind: str) -> Column:
    """Predicate for one literal term; reaches the scan as a pushed filter. Null fields do not match."""
    hits = [F.col(f) == term if op == EQ else F.col(f).endswith(term) for f, op in RULES[kind]]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def is_valid() -> Column:
    """Rows whose six result fields are all there: no null, no empty text, no zero."""
    return (
        (F.col("id") != 0)
        & (F.col("freq") != 0)
        & (F.col("headword_id") != "")
        & (F.col("headword") != "")
        & (F.col("yomi_display") != "")
        & (F.col("romaji_display") != "")
    )


def _suffixes(field: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(field)), lambda i: F.substr(F.col(field), i))


def _fields(op: str) -> list[tuple[str, str]]:
    return [(kind, field) for kind, rules in RULES.items() for field, own in rules if own == op]


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def suffix_keys(lexicon: DataFrame) -> DataFrame:
    """(kind, key, row): every key under which a lexicon row can be met, suffixes spelt out; for a stream of terms."""
    # An empty field has no suffixes; sequence(1, 0) would count down.
    spelt = [
        lexicon.select(F.lit(kind).alias("kind"), F.explode(F.when(F.char_length(field) > 0, _suffixes(field))).alias("key"), "row")
        for kind, field in _fields(EW)
    ]
    return _union([exact_keys(lexicon), *spelt]).distinct()


def exact_keys(lexicon: DataFrame) -> DataFrame:
    """(kind, key, row): what a lexicon row is met by as a whole, one row a field."""
    parts = [lexicon.select(F.lit(kind).alias("kind"), F.col(field).alias("key"), "row") for kind, field in _fields(EQ)]
    return _union(parts).where("key IS NOT NULL")


def _backwards(kind: Column, key: Column) -> Column:
    """Where a key stands in the order of reversed keys: keys of one ending follow each other."""
    return F.concat(kind, F.lit(":"), F.reverse(key))


def reversed_keys(lexicon: DataFrame) -> DataFrame:
    """(place, tie, row): what a lexicon row is met by from its end, one row a field."""
    parts = [lexicon.select(_backwards(F.lit(kind), F.col(field)).alias("place"), "row", F.col(field).alias("key")) for kind, field in _fields(EW)]
    return _union(parts).where("key != ''").select("place", F.xxhash64("row").alias("tie"), "row")


def _splits(keys: DataFrame) -> list[tuple[str, int]]:
    """Places at which the order of ``keys`` is cut: one key of ``BLOCK_KEYS``, by a hash, so that rereading cuts alike.

    Their number and lengths are bounded; equal keys are cut by their ties.
    """
    step = max(BLOCK_KEYS, keys.count() // MOST_BLOCKS)
    drawn = keys.where(F.pmod(F.xxhash64("place", "tie"), F.lit(step)) == 0)
    return sorted(map(tuple, drawn.select(F.substring("place", 1, SPLIT_CHARS), "tie").distinct().collect()))


def _rows_to_blocks(splits: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            block = [bisect_right(splits, at) for at in zip(places, ties, strict=True)]
            yield pa.record_batch([pa.array(block, pa.int64()), batch.column(0), batch.column(2)], names=["block", "place", "row"])

    return run


def _terms_to_blocks(splits: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_pylist()
            reach = [
                range(bisect_left(splits, p, key=lambda s: s[0]), bisect_right(splits, p, key=lambda s, n=len(p): s[0][:n]) + 1)
                for p in places
            ]
            of = pa.array([k for k, blocks in enumerate(reach) for _ in blocks], pa.int64())
            yield pa.record_batch([pa.array([b for blocks in reach for b in blocks], pa.int64()), batch.column(0).take(of)], names=["block", "place"])

    return run


def _meet(terms: pa.Table, rows: pa.Table) -> pa.Table:
    """Terms of a block with its rows that begin with them: a run of the sorted rows for each term."""
    places = rows.column("place").to_pylist()
    order = sorted(range(len(places)), key=places.__getitem__)
    places = [places[k] for k in order]
    asked, met = [], []
    for k, term in enumerate(terms.column("place").to_pylist()):
        first = bisect_left(places, term)
        end = bisect_right(places, term, lo=first, key=lambda p, n=len(term): p[:n])
        asked.extend([k] * (end - first))
        met.extend(order[first:end])
    return pa.table({"place": terms.column("place").take(pa.array(asked, pa.int64())), "row": rows.column("row").take(pa.array(met, pa.int64()))})


def suffix_hits(wanted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(kind, key, row): different terms (kind, key) with the rows of which a field ends with them.

    Reversed keys are cut into blocks of their order, and a term is a range of it: it goes to the blocks that the range
    touches, and each block is searched by bisection. So the index has one row a field, however long fields are. Blocks with
    very many terms are searched in parts.
    """
    terms = wanted.where(F.col("kind").isin([kind for kind, _ in _fields(EW)])).withColumn("place", _backwards(F.col("kind"), F.col("key")))
    keys = reversed_keys(lexicon)
    splits = _splits(keys)
    text_type_, row = terms.schema["place"].dataType, lexicon.schema["row"].dataType
    kept = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", text_type_)])
    cut = terms.select("place").mapInArrow(_terms_to_blocks(splits), kept)
    blocks = keys.mapInArrow(_rows_to_blocks(splits), T.StructType([*kept, T.StructField("row", row)]))
    # At most one row a block.
    parts = F.broadcast(cut.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART_TERMS).alias("parts")))
    cut = cut.join(parts, "block").select("block", F.pmod(F.xxhash64("place"), "parts").alias("part"), "place")
    blocks = blocks.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "place", "row")
    met = cut.groupBy("block", "part").cogroup(blocks.groupBy("block", "part")).applyInArrow(
        _meet, T.StructType([T.StructField("place", text_type_), T.StructField("row", row)])
    )
    return terms.join(met, "place").select("kind", "key", "row")


def search(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Terms (request_id, word) with every lexicon row they match, each row once.

    The disjunction of equality and suffix tests becomes an equi-join on whole keys and ranges of reversed keys; ``lexicon``
    needs a unique column ``row``. A term that many requests ask for is searched once.
    """
    asked = terms.select(
        "request_id", "word", text.text_type(F.col("word")).alias("kind"), search_key(F.col("word")).alias("key")
    ).where("kind IS NOT NULL")
    wanted = asked.select("kind", "key").distinct()
    exact = wanted.join(exact_keys(lexicon), ["kind", "key"])
    found = exact.unionByName(suffix_hits(wanted, lexicon)).distinct()
    return asked.join(found, ["kind", "key"]).select("request_id", "word", "row").join(lexicon, "row")


def search_nested_loop(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same by testing every pair; only for cross-checks on small tables."""
    asked = terms.select("request_id", "word", text.text_type(F.col("word")).alias("kind"), search_key(F.col("word")).alias("key"))
    hit = None
    for kind, rules in RULES.items():
        for field, op in rules:
            own = (F.col("kind") == kind) & (
                F.col(field) == F.col("key") if op == EQ else F.col(field).endswith(F.col("key"))
            )
            hit = own if hit is None else hit | own
    return asked.join(lexicon, F.coalesce(hit, F.lit(False))).drop("kind", "key")


def headword_urls(found: DataFrame, site: Column) -> DataFrame:
    """Valid rows of a search as (request_id, headword, url)."""
    return found.where(is_valid()).select(
        "request_id", F.col("headword").alias("word"), web.headword_url(site, F.col("headword_id")).alias("url")
    )
