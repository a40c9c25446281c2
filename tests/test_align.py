"""The alignment fold against a plain model of its rules, and the documented example."""

import random
import re
import time

from pyspark.sql import functions as F

from kotonami.functions import text
from kotonami.operators import align

FOLD = str.maketrans(text.KATAKANA, text.HIRAGANA)
NUMBER = re.compile(r"^-?\d+(\.\d+)?$")


def kana_or_kanji(c):
    return (0x3040 <= ord(c) <= 0x30FF or 0x4E00 <= ord(c) <= 0x9FFF) and c not in "゠・ーヽヾヿ"


def model(tokens, morae):
    """One pass over the tokens with a cursor among the morae."""
    p, out = 0, []
    for i, (surface, reading, sub) in enumerate(tokens):
        folded, number = reading.translate(FOLD), bool(NUMBER.match(surface))
        if not sub and not number and any(not kana_or_kanji(c) for c in reading):
            out.append((reading, surface, [(surface, 0, len(surface))], []))
            p += p < len(morae) and morae[p][0].strip().translate(FOLD) in align.PAUSES
            continue
        q = p
        if not number:
            while q < len(morae) and not folded.startswith(morae[q][0].translate(FOLD)):
                q += 1
        ahead = tokens[i + 1][1].translate(FOLD) if i + 1 < len(tokens) else ""
        e, taken = q, []
        while e < len(morae):
            length = sum(len(t) for t, _ in taken)
            bare = morae[e][0].strip().translate(FOLD)
            if number and ((ahead and ahead.startswith(bare)) or length > max(4 * len(surface), 12)):
                break
            if not number and length >= len(reading):
                break
            taken.append((bare if number else morae[e][0], morae[e][1]))
            e += 1
        read = "".join(t for t, _ in taken)
        if (read != "") if number else (len(read) == len(reading) and read.translate(FOLD) == folded):
            out.append((read if number else reading, surface, [(t, a, len(t)) for t, a in taken], sub))
            p = e
        else:
            out.append((reading, surface, [(reading, 0, len(reading))], []))
            p += p < len(morae)
    return out


def run(spark, rows):
    frame = spark.createDataFrame(rows, f"id int, tokens {align.TOKENS}, morae {align.MORAE}")
    got = frame.select("id", align.align(F.col("tokens"), F.col("morae")).alias("r")).collect()
    return {
        row.id: [(t.furigana, t.surface, [tuple(a) for a in t.accent], [tuple(s) for s in t.subword]) for t in row.r]
        for row in got
    }


def test_random_sentences(spark):
    rng = random.Random(7)
    morae = ["か", "カ", "き", "", " く ", "ー", "、", "きゃ", "。", "7", "ん"]
    readings = ["か", "かき", "カキ", "", "きゃん", "くー", "、", "7", "んか", "かきく"]
    surfaces = ["金", "７", "12", "7\n", "x", "、", "かき"]
    rows = []
    for i in range(400):
        tokens = [
            (rng.choice(surfaces), rng.choice(readings), [("か", "金")] if rng.random() < 0.2 else [])
            for _ in range(rng.randint(0, 6))
        ]
        rows.append((i, tokens, [(rng.choice(morae), rng.randint(0, 2)) for _ in range(rng.randint(0, 12))]))
    got = run(spark, rows)
    for i, tokens, sounds in rows:
        assert got[i] == model(tokens, sounds), (tokens, sounds)


def test_documented_example(spark):
    tokens = [("お金", "おかね", [("お", "お"), ("かね", "金")]), ("を", "を", []), ("稼ぐ", "かせぐ", [("かせ", "稼"), ("ぐ", "ぐ")])]
    morae = [("お", 0), ("か", 1), ("ね", 1), ("を", 1), ("か", 1), ("せ", 2), ("ぐ", 0)]
    got = run(spark, [(1, tokens, morae)])[1]
    assert [[(t, a) for t, a, _ in word[2]] for word in got] == [[("お", 0), ("か", 1), ("ね", 1)], [("を", 1)], [("か", 1), ("せ", 2), ("ぐ", 0)]]
    assert got[0][3] == [("お", "お"), ("かね", "金")]


def test_long_requests_take_linear_time(spark):
    """Tokens that match, that match nowhere and numbers, 8,000 of them in one request."""
    rng = random.Random(2)
    kana = "かきくけこさしすせそ"
    tokens, morae = [], []
    for i in range(8000):
        reading = "".join(rng.choice(kana) for _ in range(rng.randint(1, 4)))
        tokens.append(("文", "んんん", []) if i % 3 == 1 else ("12", "12", []) if i % 7 == 3 else ("文", reading, []))
        morae += [(c, 1) for c in reading]
    run(spark, [(0, tokens[:10], morae[:20])])
    began = time.time()
    got = run(spark, [(1, tokens, morae)])
    assert time.time() - began < 3
    assert len(got[1]) == 8000
    assert run(spark, [(2, tokens[:1500], morae[:3000])])[2] == model(tokens[:1500], morae[:3000])


def test_null_parts_of_requests(spark):
    assert run(spark, [(1, [("文", None, None), ("x", "か", None)], [(None, 1), ("か", 2)])])[1][1] == ("か", "x", [("か", 2, 1)], [])
    frame = spark.createDataFrame([(1, None, None)], f"id int, tokens {align.TOKENS}, morae {align.MORAE}")
    assert frame.select(align.align(F.col("tokens"), F.col("morae")).alias("r")).first().r is None
