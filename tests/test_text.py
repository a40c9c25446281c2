"""Scalar functions against Python's own notions of script, digit and white space."""

import re
import sys

from pyspark.sql import functions as F

from kotonami.functions import text


def values(spark, rows, use):
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, s string")
    return [r[0] for r in frame.orderBy("i").select(use(F.col("s"))).collect()]


def test_is_kana_or_kanji_over_the_basic_plane(spark):
    chars = [chr(c) for c in range(0x2E00, 0xA000)] + [chr(0x20BB7), "a", "ｱ"]
    want = [(0x3040 <= ord(c) <= 0x30FF or 0x4E00 <= ord(c) <= 0x9FFF) and c not in "゠・ーヽヾヿ" for c in chars]
    assert values(spark, chars, text.is_kana_or_kanji) == want


def test_numbers_as_python_reads_them(spark):
    pattern = re.compile(r"^-?\d+(\.\d+)?$")
    rows = ["12", "-1.5", "１２", "12\n", "12\r", "12 ", "", "1.", "٣٤", "1\n\n", "--1", "x"]
    assert values(spark, rows, text.is_numeric) == [bool(pattern.match(r)) for r in rows]


def test_strip_is_unicode_strip(spark):
    spaces = [chr(c) for c in range(sys.maxunicode) if chr(c).isspace()]
    rows = [s + "a b" + s for s in spaces] + ["", "   "]
    assert values(spark, rows, text.strip) == [r.strip() for r in rows]


def test_text_type(spark):
    rows = ["はしる", "ハシル", "走る", "hashiru", "", None, "コーヒー", "ﾊｼﾙ", "ab\n", "はしる\n"]
    want = ["yomi", "yomi", "headword", "romaji", None, None, "yomi", "headword", "headword", "headword"]
    assert values(spark, rows, text.text_type) == want


def test_kana_folds_are_inverse_and_leave_the_rest(spark):
    assert values(spark, ["はしるー漢a"], text.to_katakana) == ["ハシルー漢a"]
    assert values(spark, ["ハシルーヷ"], text.to_hiragana) == ["はしるーヷ"]


def test_shapes_of_the_documentation(spark):
    frame = spark.createDataFrame([([0, 1, 1, 1],), ([2, 0],), ([0, 1, 2, 0],), ([0, 2],), ([],)], "a array<int>")
    got = [r[0] for r in frame.select(text.accent_shape(F.col("a"))).collect()]
    assert got == ["Heiban", "Atamadaka", "Nakadaka", "Odaka", None]


def test_int_or_zero(spark):
    assert values(spark, [None, " 7 ", "x", "99999999999", "٤２"], text.int_or_zero) == [0, 7, None, 99999999999, 42]


def test_normalise_subset(spark):
    rows = ["Ａｂｃ１２３", "ｶﾞｷﾞﾊﾟ", "らーーめん", "a‐b", "～x~", "　空　"]
    assert values(spark, rows, text.normalise) == ["Abc123", "ガギパ", "らーめん", "a-b", "～x～", "空"]


def test_long_numbers_need_no_stack(spark):
    assert values(spark, ["1" + "_1" * 20_000, "1_2", "1__2", "_1", "1_", "-1_0"], text.int_or_zero) == [None, 12, None, None, None, -10]
