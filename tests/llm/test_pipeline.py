"""The pipeline stage by stage against a brute-force version on a small corpus."""

import random
import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from kotonami.llm import common
from test_operators import base_spans, grams, words


def corpus(rng):
    base = [words(rng, 60) for _ in range(30)]
    items = [words(rng, 25) for _ in range(4)]
    texts = list(base)
    texts += [base[0], base[1] + " tail", base[2].upper(), " ".join(base[3].split()[1:])]
    texts += [base[4][:80] + " " + items[0] + " " + words(rng, 30), words(rng, 40) + " " + items[1].upper()]
    texts += [words(rng, 20) + " mail a.b@c.org or +1 (988) 555-2485", "12 34 !!", None, ""]
    return texts, items


def test_pipeline(spark, tmp_path):
    texts, items = corpus(random.Random(9))
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)}
    kept = {}
    sets = {i: grams(t) for i, t in left.items()}
    link = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    group = {i: i for i in left}
    for _ in left:
        group = {i: min(group[j] for j in left if link(i, j)) for i in left}
    kept = {i: t for i, t in left.items() if group[i] == i}
    clean = {i: t for i, t in kept.items() if not any(len(grams(x) & sets[i]) >= 0.8 * len(grams(x)) for x in items)}
    assert len(clean) < len(kept) < len(left) < len(texts)
    private = {}
    for i, t in clean.items():
        for kind, a, b in reversed([s.split(":") for s in base_spans(t)]):
            t = t[: int(a)] + f"<{kind.upper()}>" + t[int(b) :]
        private[i] = t

    docs = common.read(spark, str(tmp_path), "documents")
    for (name, stage), want in zip(pipeline.STAGES, [left, kept, clean, private, None], strict=True):
        docs = common.staged(stage(spark, docs, str(tmp_path)), name)
        got = {r.doc_id: r for r in docs.collect()}
        if want is not None:
            assert docs.columns == list(pipeline.COLUMNS)
            assert {i: r.text for i, r in got.items()} == want, name
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert set(got) <= set(private) and all(0 < r.taken <= 3 * r.size for r in got.values())
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.taken) for r in whole} == {(i, r.taken) for i, r in got.items()}


def test_language_stage_rejects_texts_in_no_language(spark):
    rng = random.Random(4)
    syllables = {l: ["".join(rng.choice(letters) for _ in range(3)) for _ in range(15)] for l, letters in {"a": "abcdefgh", "b": "ijklmnop", "c": "qrstuvwx", "d": "aeioulmn", "e": "bdgptkre", "f": "szcfhaei"}.items()}
    written = lambda l, n: " ".join(rng.choice(syllables[l]) + rng.choice(syllables[l]) for _ in range(n))
    junk = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    for languages in ("ab", "abcdef"):
        clean = [(l, written(l, n)) for l in languages for n in (1, 3, *[40] * 60, 4000)] + [("a", "abc"), ("b", "k")]
        # A fiftieth of the labelled texts are junk, too: they are no measure for the others.
        foul = [(l, junk(n)) for l in languages for n in (40, 4000)] + [("a", "すべての人間は、生まれながらにして自由である。" * 3)]
        rows = [(i, t, l, "s", len(t)) for i, (l, t) in enumerate(clean + foul)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = {r.doc_id for r in pipeline.known_language(spark, frame, "").collect()}
        assert got == set(range(len(clean)))


def test_near_duplicates_with_repeated_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 0), (1, "a b c d e f g", "en", "s", 0), (1, "other words in this one here", "en", "s", 0), (None, "third text without an id at all", "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.one_of_each(spark, frame, "").collect()
    assert sorted(r.text[:5] for r in got) == ["a b c", "other", "third"]


def test_registered_with_the_entry():
    import __spark_entry__ as entry_module

    names = entry_module.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    rng = random.Random(2)
    long = words(rng, 60_000) + " a.b@c.org " + words(rng, 60_000)
    rows = [(1, long, "en", "s", 0), (2, long + " more", "en", None, 0), (None, words(rng, 30), None, "s", 0), (4, None, "en", "s", 7), (5, "", None, None, None), (6, words(rng, 30), "de", "t", 0)]
    clash = ["row", "size", "hash", "kind", "key", "component_id", "positions", "score", "lang_pred", "pii_row", "at", "start", "id", "digest"]
    full = spark.createDataFrame(rows, SCHEMA)
    for name in clash:
        full = full.withColumn(name, F.lit("clash"))
    spark.createDataFrame([], "item_id long, text string").withColumn("shingle", F.lit("clash")).write.parquet(str(tmp_path / "benchmark.parquet"))
    for (name, stage), want in zip(pipeline.STAGES, [4, 5, 6, 6, 4], strict=True):
        assert stage(spark, full.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, full, str(tmp_path))
        got = out.collect()
        assert len(got) == want, name
        if name != "source_mixing":
            assert out.columns == list(pipeline.COLUMNS)
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in got) == ["1", "4", "5", "6", "None"]
        if name == "personal_data":
            own = {r.doc_id: r for r in got}
            assert "<EMAIL>" in own[1].text and own[1].n_chars == len(own[1].text) and own[4].n_chars == 7 and own[4].text is None
