"""Script, kana, number and string functions as Spark columns.

Python's notions of digit, white space and end of text differ from Java's; every pattern here is
written so that both agree (``\\A...\\z``, ``\\p{Nd}``, ``(?U)\\s`` with the four separators it lacks).
"""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hiragana with a katakana counterpart at a distance of 0x60, in order.
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))

YOMI, ROMAJI, HEADWORD = "yomi", "romaji", "headword"

#: The symbols of the kana blocks that count as punctuation.
KANA_SYMBOLS = "゠・ーヽヾヿ"

#: Marks that count as punctuation, the empty text among them.
PUNCTUATION = [
    "。", "，", "、", "・", "——", "……", "—", "…", "「", "」", "『", "』", "（", "）", "、、、", "————",
    "？", "！", ".", ",", "：", "；", "(", ")", '"', "--", "-", "", "/", ":", ";", "＂", "＃", "＄", "％",
    "＆", "＼", "’", "＊", "＋", "－", "．", "／", "＜", "＝", "＞", "＠", "［", "］", "︿", "＿", "‵", "｛",
    "｝", "｜", "～", "“", "”", *string.punctuation,
]

_NOT_KANA_OR_KANJI = r"[^぀-ヿ一-鿿]|[゠・-ヿ]"
_SPACE = r"[\s\x1c-\x1f]"


def text_type(text: Column) -> Column:
    """``yomi`` (kana only), ``romaji`` (ASCII letters only), else ``headword``; null for empty text."""
    return (
        F.when(text == "", None)
        .when(text.rlike(r"\A[぀-ゟ゠-ヿ]+\z"), YOMI)
        .when(text.rlike(r"\A[A-Za-z]+\z"), ROMAJI)
        .when(text.isNotNull(), HEADWORD)
    )


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def to_hiragana(text: Column) -> Column:
    """Folds katakana; the long-vowel mark and ``ヷヸヹヺ`` have no single counterpart and stay."""
    return F.translate(text, KATAKANA, HIRAGANA)


def is_kana_or_kanji(char: Column) -> Column:
    return (F.char_length(char) == 1) & ~char.rlike(_NOT_KANA_OR_KANJI)


def has_other_script(text: Column) -> Column:
    """Whether any character is neither kana nor kanji; false for empty text."""
    return text.rlike(_NOT_KANA_OR_KANJI)


def is_numeric(text: Column) -> Column:
    """Decimal digits of any script, with an optional minus, fraction and one final line feed."""
    return text.rlike(r"\A-?\p{Nd}+(\.\p{Nd}+)?\n?\z")


def strip_latin(text: Column) -> Column:
    return F.regexp_replace(text, "[A-Za-z]", "")


def is_punctuation(text: Column) -> Column:
    return text.isin(PUNCTUATION)


def accent_of_classes(classes: Column) -> Column:
    """Accent of a mora by the first of its classes: plain 1, top 2, others 0; null without a class."""
    first = F.get(classes, F.lit(0))
    return F.when(first == "accent_plain", 1).when(first == "accent_top", 2).when(first.isNotNull(), 0)


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def strip_ordinal(text: Column) -> Column:
    """A leading ``(n)`` and the white space after it go."""
    return F.regexp_replace(text, r"(?U)\A\(\d+\)[\s\x1c-\x1f]*", "")


def split_pair(text: Column) -> Column:
    """At the first run of tabs, or of two or more white-space characters: one or two parts."""
    return F.split(text, r"\t+|(?U)[\s\x1c-\x1f]{2,}", 2)


def clean_gloss(text: Column) -> Column:
    return strip(F.replace(text, F.lit("▶"), F.lit("")))


#: Decimal digits of every script that has ten in a row, and what each stands for.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def int_or_zero(text: Column) -> Column:
    """The number in ``text``, with digits of any script, a sign, and single underscores between digits; 0 if there is no text.

    Null means: there is text, but no number, or one beyond 64 bits.
    """
    own = F.translate(strip(text), _DIGITS, _VALUES)
    number = F.when(own.rlike(r"\A[+-]?[0-9]++(?:_[0-9]++)*+\z"), F.replace(own, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(number)


def accent_shape(accents: Column) -> Column:
    """Pitch shape of a word from its morae's accents, as the accent documentation defines it.

    Where the definitions overlap (a single mora that falls) the first that fits holds; null for none.
    """
    fall = F.array_position(accents, 2)
    return (
        F.when(fall == 1, "Atamadaka")
        .when((fall > 1) & (fall == F.size(accents)), "Odaka")
        .when(fall > 1, "Nakadaka")
        .when(F.array_contains(accents, 1), "Heiban")
    )


# Full-width forms of ASCII and their half-width counterparts.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
# Half-width katakana in the order of their code points, and the full-width ones.
_HALF_KANA = "".join(map(chr, range(0xFF66, 0xFF9E)))
_FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_VOICED = ("カキクケコサシスセソタチツテトハヒフヘホウ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ")
_HALF_VOICED = ("ハヒフヘホ", "パピプペポ")


def normalise(text: Column) -> Column:
    """A documented subset of Japanese text normalisation.

    Full-width ASCII becomes half-width, half-width katakana full-width (voicing marks joined),
    hyphens and long-vowel marks are folded, a run of long-vowel marks becomes one, tildes the full-width one, and
    the ends are stripped.
    """
    out = F.translate(text, _WIDE.replace("～", ""), _NARROW.replace("~", ""))
    out = F.translate(out, _HALF_KANA, _FULL_KANA)
    for mark, (plain, marked) in (("[ﾞ゛]", _VOICED), ("[ﾟ゜]", _HALF_VOICED)):
        for a, b in zip(plain, marked, strict=True):
            out = F.regexp_replace(out, f"{a}{mark}", b)
    out = F.regexp_replace(out, "[˗֊‐‑‒–⁃⁻₋−]+", "-")
    out = F.regexp_replace(out, "[﹣－ｰ—―─━ー]+", "ー")
    out = F.regexp_replace(out, "[~∼∾〜〰～]+", "～")
    return strip(out)
