"""Which of many words each of many texts mentions, as substrings, without testing pairs.

Few words become one automaton that is built once and read by every task; beyond ``MOST_CHARS`` characters the words are a
table, keyed by their last characters, which texts meet by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of all words that one automaton may hold (about 20 MB).
MOST_CHARS = 1 << 19
#: Last characters of a word by which texts meet it; longer words are verified.
GRAM = 12


def _search_batches(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            of, words = [], []
            for i, data in enumerate(batch.column(2).to_pylist()):
                if data:
                    own = {word for _, word in automaton.iter(data)}
                    of.extend([i] * len(own))
                    words.extend(own)
            at = pa.array(of, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.string())], names=schema)

    return run


def by_automaton(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, pos, word), for words whose number has been checked."""
    automaton = ahocorasick.Automaton()
    for (word,) in words.collect():
        automaton.add_word(word, word)
    rows = texts.select("key", "pos", "data")
    schema = T.StructType([rows.schema["key"], rows.schema["pos"], T.StructField("word", T.StringType())])
    if not len(automaton):
        return rows.limit(0).select("key", "pos", F.lit("").alias("word"))
    automaton.make_automaton()
    return rows.mapInArrow(_search_batches(texts.sparkSession.sparkContext.broadcast(automaton), schema.names), schema)


def _grams(size: int) -> Column:
    """All parts of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.char_length("data") - size + 1)
    parts = F.transform(starts, lambda i: F.substr(F.col("data"), i, F.lit(size)))
    return F.when(F.char_length("data") >= size, parts).otherwise(F.array().cast("array<string>"))


def by_grams(words: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for any number of words: texts meet them by their last ``GRAM`` characters, longer words are verified."""
    size = F.least(F.char_length("word"), F.lit(GRAM))
    keyed = words.select("word", size.alias("size"), F.right("word", size).alias("gram"))
    lengths = [n for (n,) in words.select(F.char_length("word")).distinct().collect()]
    sizes = sorted({min(n, GRAM) for n in lengths})
    if not sizes:
        return texts.limit(0).select("key", "pos", F.lit("").alias("word"))
    each = F.array_distinct(F.flatten(F.array(*[_grams(n) for n in sizes])))
    texts = texts.where("data != ''")
    met = texts.select("key", "pos", F.explode(each).alias("gram")).join(keyed.select("gram", "word"), "gram").drop("gram")
    if max(lengths) <= GRAM:  # nothing to verify: the texts are read once
        return met.select("key", "pos", "word")
    whole = met.where(F.char_length("word") <= GRAM)
    longer = met.where(F.char_length("word") > GRAM).join(texts, ["key", "pos"]).where(F.contains("data", "word"))
    return whole.select("key", "pos", "word").unionByName(longer.select("key", "pos", "word"))


def mentions(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, pos, word): texts (key, pos, data) with each different word (word) that they contain.

    Words within words are met too: of the ids 138799 and 1387990 the text "ent_seq=1387990" mentions both. A null or empty
    word meets nothing, a null or empty text mentions nothing. Neither ``key`` nor ``pos`` is null, and they tell texts apart.
    """
    own = words.where("word != ''").select("word").distinct()
    held = own.agg(F.sum(F.char_length("word"))).first()[0] or 0
    return by_automaton(own, texts) if held <= MOST_CHARS else by_grams(own, texts)
