"""Suffix search by ranges of reversed keys, and many words against many texts, each against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from kotonami.operators import mentions, search
from kotonami.plans import queries as plans

SF = "/root/testdata/sf0.001"
LEXICON = "row long, id int, headword_id string, headword string, yomi1 string, yomi2 string, yomi3 string, romaji1 string, romaji2 string, romaji3 string, yomi_display string, romaji_display string, freq int"


def lexicon_of(spark, words):
    rows = [(k, k, "h", w, w, w, w, w, w, w, "y", "r", 1) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, LEXICON)


def pairs(frame):
    return sorted((r.request_id, r.word, r.row) for r in frame.collect())


@pytest.mark.parametrize(("block", "part"), [(1, 1), (3, 2), (50, 3), (4_096, 100_000)])
def test_suffix_ranges_against_the_nested_loop(spark, monkeypatch, block, part):
    monkeypatch.setattr(search, "BLOCK_KEYS", block)
    monkeypatch.setattr(search, "PART_TERMS", part)
    draw = random.Random(block)
    words = ["".join(draw.choice("abあイ") for _ in range(draw.randint(0, 6))) for _ in range(300)]
    words += ["aba"] * 100 + [None, "", "ハハ", "𠮷", "a" * 400, "b" + "a" * 400]  # a hot key, and keys that agree beyond the cut
    own = lexicon_of(spark, words)
    asked = [(k, "".join(draw.choice("abあイ") for _ in range(draw.randint(0, 3)))) for k in range(120)]
    asked += [(200, "a"), (201, "a"), (201, "a"), (202, None), (203, ""), (204, "は"), (205, "a" * 400)]
    terms = spark.createDataFrame(asked, "request_id int, word string")
    assert pairs(search.search(terms, own)) == pairs(search.search_nested_loop(terms, own))


def test_the_index_has_a_row_a_field_however_long(spark):
    own = lexicon_of(spark, ["x" * 1_000, "い" * 5_000, "ab"])
    assert search.reversed_keys(own).count() == 4 * 3
    assert search.exact_keys(own).count() == 3 * 3


def test_cuts_do_not_depend_on_how_the_lexicon_is_read(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_KEYS", 20)
    own = plans.lexicon(spark, SF)
    cuts = search._splits(search.reversed_keys(own))
    assert cuts and cuts == search._splits(search.reversed_keys(own.repartition(7)))


def test_search_of_nothing(spark):
    none = lexicon_of(spark, [])
    assert search.search(plans._terms(spark), none).count() == 0
    assert search.search(plans._terms(spark).limit(0), plans.lexicon(spark, SF)).count() == 0


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_mentions_against_contains(spark, monkeypatch, most):
    monkeypatch.setattr(mentions, "MOST_CHARS", most)
    draw = random.Random(5)
    make = lambda n: "".join(draw.choice("ab𠮷") for _ in range(n))
    words = ["ent_seq=138799", "ent_seq=1387990", "8799", "", None, "a", "a", "b" * 20, "ab" * 10] + [make(draw.randint(1, 5)) for _ in range(60)]
    texts = [" ent_seq=1387990 ", "ent_seq=138799", "", None, "b" * 30, "ab" * 200, "ba" * 6 + "x"] + [make(draw.randint(0, 40)) for _ in range(40)]
    frame = spark.createDataFrame([(k % 7, k, t) for k, t in enumerate(texts)], "key int, pos int, data string")
    got = mentions.mentions(spark.createDataFrame([(w,) for w in words], "word string"), frame)
    assert got.columns == ["key", "pos", "word"]
    want = {(k % 7, k, w) for k, t in enumerate(texts) if t for w in words if w and w in t}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {(0, 0, "ent_seq=138799"), (0, 0, "ent_seq=1387990")} <= want


@pytest.mark.parametrize("most", [1 << 19, -1])
def test_mentions_of_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(mentions, "MOST_CHARS", most)
    texts = spark.createDataFrame([(1, 0, "a")], "key int, pos int, data string")
    words = spark.createDataFrame([("",), (None,)], "word string")
    assert mentions.mentions(words, texts).collect() == []
    assert mentions.mentions(spark.createDataFrame([("a",)], "word string"), texts.where(F.lit(False))).collect() == []
