"""SentencePiece table, source divergence and periodic runs: the library, brute force, edge rows."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kotonami.llm import periodic_runs, registry, sentence_pieces, source_divergence, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op11


def library(text):
    own = sentence_pieces.processor(sentence_pieces.MODEL)
    ids = own.encode(text or "")
    return ids, own.decode(ids)


def test_pieces_agree_with_the_library(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "   ", "▁", "▁▁", "\n", "\t", "a", "the", "Straße", "日本", "　", "\0", "<s>", "</s>", "<0x0A>", "🙂", "é", "x" * 40, "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", " ", "▁", "same", "same", " " * 70, "ab" * 40_000, "word " * 60_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)})
    got = {r.doc_id: r for r in sentence_pieces.encode(frame).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert (got[i].ids, got[i].decoded) == library(text), repr(text)[:200]
    assert sentence_pieces.encode(frame.where("false")).count() == 0
    assert sentence_pieces.encode(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().doc_id is None


def test_table_is_emptied_without_loss(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 10)
    table = sentence_pieces.Table(sentence_pieces.MODEL)
    for text in ("one two three", "two three four", "one two three"):
        ids, decoded = table.encode([text])
        assert (ids[0].tolist(), decoded[0]) == library(text)


def test_piece_query_agrees_with_the_library(spark):
    got = {r.doc_id: r for r in registry.queries()["op11_sentence_pieces"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, decoded = library(row.text)
        own = got[row.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))


# op12


def brute_divergence(rows, least):
    groups, docs, counts = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for t in set(found):
            docs[lang, t] = docs.get((lang, t), 0) + 1
        for t in found:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (of, t), n in docs.items() if of == lang and n >= least]

        def shares(own):
            total = sum(own.values())
            return {t: 1 + 10**9 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: {t: counts.get((lang, s, t), 0) for t in kept} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("least", [1, 3, 10_000])
def test_divergence_by_brute_force(spark, least):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefÄé日" for b in "ghiJKLßö本"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for _ in range(120)]
    rows += [("xx", "only", None), ("xx", "other", ""), ("yy", "alone", "1 2 3"), ("en", "hot", "Word-word_WORD " * 30_000)] + [("en", "a", "same row")] * 5
    frame = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("clash"), "n": F.lit(0), "value": F.lit(1)})
    got = [tuple(r) for r in source_divergence.divergence(frame, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least)


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_counts_are_handed_on_in_steps(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "STEP_TERMS", 2)
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 3, "source": ["s"] * 3, "text": ["x y z x", "x", "y"]})
    out = pa.Table.from_batches(source_divergence._count_batches([batch])).to_pandas()
    assert out.groupby("term")[["n", "docs"]].sum().to_dict("index") == {"x": {"n": 3, "docs": 2}, "y": {"n": 2, "docs": 2}, "z": {"n": 1, "docs": 1}}


# op13


def brute_runs(words):
    """Every stretch of each period that goes no further, the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def some_words(rng):
    words = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
    for _ in range(rng.randint(0, 3)):
        part = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        words += (part * rng.randint(1, 7))[: rng.randint(1, 60)] + [rng.choice("abx") for _ in range(rng.randint(0, 3))]
    return words


def test_runs_by_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        words = some_words(rng)
        s, n, q = periodic_runs.find_runs(np.array([ord(w) for w in words], np.int64))
        assert list(zip(s.tolist(), n.tolist(), q.tolist())) == brute_runs(words), words


def test_run_blocks_of_candidates(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 50)
    rng = random.Random(8)
    for words in [some_words(rng) for _ in range(100)] + [list("a" * 3000), list("abcab" * 500)]:
        s, n, q = periodic_runs.find_runs(np.array([ord(w) for w in words], np.int64))
        assert list(zip(s.tolist(), n.tolist(), q.tolist())) == brute_runs(words)


def expected(doc_id, text, tail):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if tail and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (
        len(found),
        *top,
        1000 * top[1] // top[2] if found else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_run_query_by_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in registry.queries()["op13_periodic_runs"](spark, SF).collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    short = [r for r in rows if len(r.text or "") < 20_000]
    assert len(short) > 100 and sum(got[r.doc_id][0] > 0 for r in short) > 5
    for r in short:
        assert got[r.doc_id] == expected(r.doc_id, r.text, True), r.doc_id


def test_runs_of_edge_rows(spark):
    texts = [None, "", " \t\x0b\n", "a", "a " * 5, "a " * 6, "\x1ca b\x85 " * 5, "x y " * 50_000, "w" * 100_000, "a　b " * 6, "q r s " * 4, "q r s " * 4]
    rows = list(enumerate(texts)) + [(None, "a a a a a a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "top": F.lit(1), "collapsed": F.lit(2)})
    for tail in (False, True):
        got = {r.doc_id: r for r in periodic_runs.runs(frame, tail=tail).collect()}
        for doc_id, text in rows:
            want = expected(doc_id, text, tail) if len(text or "") < 100_000 else None
            own = got[doc_id]
            if want:
                assert (len(own.runs), sha(own.collapsed)) == (want[0], want[-1]), (doc_id, tail)
    assert [tuple(r) for r in periodic_runs.runs(frame.where("doc_id = 7")).first().runs] == [(0, 100_000, 2)]
    assert periodic_runs.runs(frame.where("false")).count() == 0


# earlier operators: rows that were left out or took too long


def test_many_special_strings_in_a_huge_text():
    text = "<|endoftext|> a b c " * 40_000
    began = time.time()
    n, _ = token_counts.spliced(text, token_counts.VOCABULARY)
    assert time.time() - began < 2.5
    assert n == len(token_counts.tokenizer(token_counts.VOCABULARY).encode(text, add_special_tokens=False))


def test_lexicon_learns_long_words(spark):
    insult = "q" * 30 + "z" * 30
    rows = [(f"a{i} b {insult}", 1) for i in range(60)] + [(f"a{i} b", 0) for i in range(120)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert any("qz" in unit or unit == insult for unit in lexicon)


def test_member_with_a_long_name_is_read():
    body = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = body.compress(b"hello") + body.flush()
    member = b"\x1f\x8b\x08\x08\0\0\0\0\0\x03" + b"n" * 10_000 + b"\0" + data
    member += zlib.crc32(b"hello").to_bytes(4, "little") + (5).to_bytes(4, "little")
    assert warc.Members(member)._body(0) == 10 + 10_001
