"""The ten operators on small fixtures: brute force, edge rows, empty tables, clashing columns."""

import hashlib
import random
import re
import string
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kotonami.llm import (
    common,
    components,
    decontamination,
    embedding_dedup,
    jaccard_join,
    language_id,
    mixing,
    pii,
    shingles,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# op1


def test_mixing_shares_caps_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(0, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(7, "same row", "a")] * 3 + [(None, "x y", "b"), (401, None, "c"), (402, "", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    size, target, taken = {}, {}, {}
    for r in got:
        assert r.taken <= 3 * r.size and len(r.positions) == -(-r.taken // r.size if r.size else 0)
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        size[r.source] = r.source_size
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6
    want, free, left = {}, dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), float(total)
    while free:
        over = [s for s, w in free.items() if left * w / sum(free.values()) > 3 * size[s]]
        if not over:
            want |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            want[s] = 3.0 * size[s]
        left -= sum(want[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 0.5
    firsts = [r.positions[0] for r in got if r.positions]
    assert firsts == sorted(firsts)
    again = mixing.mix(frame.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken, tuple(r.positions))
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)


def test_schedule_inverse_gives_back_the_area(spark):
    schedule = ((0.0, 0.0), (0.3, 2.0), (1.0, 1.0))
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    frame = spark.createDataFrame([(s,) for s in shares], "s double")
    times = [r[0] for r in frame.select(mixing._inverse(schedule, F.col("s"))).collect()]
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, [0, 0.3, 1], [0, 2, 1])
    for share, t in zip(shares, times, strict=True):
        assert abs(weight[grid <= t].mean() * t - share * mixing.area(schedule)) < 1e-3 if t else share == 0


def test_passes_follow_the_schedules(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(600)] + [(900, None, "a"), (901, "x " * 500_000, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.place(frame, schedules=mixing.SCHEDULES)
    whole = placed.collect()
    got = mixing.by_pass(placed).collect()
    assert len(got) == sum(len(r.positions) for r in whole) and all(r["pass"] in (0, 1, 2) for r in got)
    assert [r.position for r in got] == sorted(r.position for r in got)
    # By half of the time the heavy source has had 5/8 of its words, the light one 3/8 of them.
    for source, schedule in zip("ab", mixing.SCHEDULES, strict=False):
        own = [r for r in got if r.source == source]
        target = own[0].target
        before = sum(r.size for r in own if r.position < 0.5)
        half = (schedule[0][1] + (schedule[0][1] + schedule[1][1]) / 2) / 4 / mixing.area(schedule)
        assert abs(before / target - half) < 0.02


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0
    assert pii.find(empty.withColumn("row", F.lit(1).cast("long")), "row").count() == 0
    assert pii.redacted(empty).count() == 0
    model = language_id.fit(empty.select("doc_id", "text", "lang"))
    assert language_id.predict(empty, model).count() == 0
    assert language_id.predict(docs_of(spark, ["abc"]), model).first().lang_pred == "und"
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.train(toxicity.training_sample(empty, labels))
    assert scorer.score(empty.select("doc_id", "text")).count() == 0
    assert jaccard_join.jaccard_links(empty).count() == 0
    assert decontamination.contained_items(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert token_counts.count_tokens(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty.select("doc_id", "text")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(vectors).count() == 0


# op2


def pages(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/\n", big), (5, "u", big), (3, None, big), (3, "again", big), (9, "u", "small"), (8, "u", "small"), (10, "u", None), (11, "u", other), (None, "u", other), (12, "u", "c" * 999), (13, "u", "c" * 999)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def test_warc_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(warc.prepared(pages(spark)), folder)
    got = warc.read_archives(spark, folder, manifest).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == 11
    by = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert by == [(-1, 1000, "revisit", 11), (1, 1200, "revisit", 5), (3, 1200, "revisit", 5), (3, 1200, "revisit", 5), (5, 1200, "response", None), (8, 5, "response", None), (9, 5, "response", None), (10, 0, "response", None), (11, 1000, "response", None), (12, 999, "response", None), (13, 999, "response", None)]
    assert all(r.payload_digest == hashlib.sha1("é".encode() * 600).hexdigest() for r in got if r.payload_bytes == 1200)


def record(n, compressed=True):
    import gzip

    raw = warc.encode({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{n}>"}, bytes([65 + n]) * 5000 + b"\x1f\x8b\x08 WARC/1.1\r\n")
    return gzip.compress(raw, mtime=0) if compressed else raw


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_what_follows_damage(compressed):
    parts = [record(n, compressed) for n in range(6)]
    archive = bytearray(b"".join(parts))
    second = len(parts[0])
    archive[second + 30 : second + 40] = b"\0" * 10  # in the second record
    fourth = sum(map(len, parts[:3]))
    lost = fourth + (20 if compressed else 400)
    del archive[lost : lost + 5]  # bytes lost in the fourth
    archive += b"trailing"
    got = list(warc.salvage(bytes(archive)))
    ids = [fields["warc-record-id"] for kind, _, _, fields, _ in got if kind == "record"]
    assert ids == [f"<urn:page:{n}>" for n in (0, 2, 4, 5)]
    gaps = [(a, b) for kind, a, b, _, _ in got if kind == "gap"]
    assert len(gaps) == 3 and gaps[0] == (second, second + len(parts[1])) and gaps[-1][1] == len(archive)
    covered = sorted({(a, b) for _, a, b, _, _ in got})
    assert covered[0][0] == 0 and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_salvage_of_junk_and_nothing():
    assert list(warc.salvage(b"")) == []
    assert [(k, a, b) for k, a, b, _, _ in warc.salvage(b"WARC/1.1\r\nbroken" * 3)] == [("gap", 0, 48)]


def test_salvage_searches_inside_a_member():
    import gzip

    parts = [record(n, False) for n in range(4)]
    parts[1] = parts[1].replace(b"B" * 5000, b"B" * 4999 + b"x")
    whole = gzip.compress(b"".join(parts), mtime=0)
    cut = gzip.compress(b"".join(bytes(random.Random(n).randbytes(3000)).hex().encode() + record(n, False) for n in range(4)), mtime=0)[:-2000]
    got = list(warc.salvage(whole + cut + record(5)))
    ids = [f["warc-record-id"] for k, _, _, f, _ in got if k == "record"]
    assert ids[:3] == [f"<urn:page:{n}>" for n in (0, 2, 3)] and ids[-1] == "<urn:page:5>" and "<urn:page:0>" in ids[3:-1]
    gaps = [(a, b) for k, a, b, _, _ in got if k == "gap"]
    assert gaps == [(0, len(whole)), (len(whole), len(whole) + len(cut))]


@pytest.mark.parametrize(
    "false_start", [b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"WARC/1.1\r\na: b\r\n", b"\x1f\x8b\x08\0abcdef\0", b"x: WARC/1.1\r\n", b"\x1f\x8b\x08\0\0\0\0\0\0\3"]
)
def test_salvage_passes_false_starts_in_linear_time(false_start):
    raw = false_start * ((8 << 20) // len(false_start)) + record(3)
    began = time.time()
    got = [(k, a, f.get("warc-record-id")) for k, a, _, f, _ in warc.salvage(raw)]
    assert got == [("gap", 0, None), ("record", len(raw) - len(record(3)), "<urn:page:3>")]
    assert time.time() - began < 30


def test_plain_archives_are_read_and_losses_raise(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, False) + b"junk" + record(2, False))
    folder = f"file://{tmp_path}"
    assert sorted(r.kind for r in warc.read_archives(spark, folder).collect()) == ["gap", "record", "record"]
    manifest = spark.createDataFrame([("a.warc", 3)], "archive string, records long")
    with pytest.raises(Exception, match="2 records could be read of 3"):
        warc.read_archives(spark, folder, manifest).collect()


@pytest.mark.parametrize("few", [0, 1_000])
def test_revisits_by_either_join(spark, few, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    long = "x" * 2_000_000
    rows = [(k, "u", "ab" * 600) for k in range(40)] + [(39, "u", "ab" * 600), (39, None, "ab" * 600), (None, "v", "q" * 1000), (None, "v", "q" * 1000), (50, "u", long), (51, "u", long)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, len(r.payload)) for r in warc.prepared(frame).collect()]
    assert len(got) == len(rows) and sum(r[1] == "response" for r in got) == 3
    assert sorted(r for r in got if r[0] == 39) == [(39, "response", None, 1200, 1200)] + [(39, "revisit", 39, 1200, 0)] * 2
    assert sum(r[:3] == (None, "revisit", None) for r in got) == 1
    assert (50, "revisit", 51, 2_000_000, 0) in got and (51, "response", None, 2_000_000, 2_000_000) in got


def test_no_pages_give_no_records(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.query(spark, str(tmp_path)).count() == 0


# op3

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), r, m.end(), k) for r, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "") if passes(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_pii_against_plain_patterns(spark, tmp_path):
    rng = random.Random(5)
    atoms = ["a", "b.", "@", "1", "2", " ", "-", ".", "+1", "(", ")", "_", "c@d.e", "1.2.3.4", "4111 1111 1111 1111", "\U00020bb7", "é", "255.", "at ", "x at y dot com", "(212) 555-1234"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "a" * 50_000, "1." * 5_000, "1 " * 5_000, "+1" + " " * 50_000, "a.a@" * 2_000, "12"]
    frame = docs_of(spark, texts).select("doc_id", "text", F.lit("clash").alias("kind"))
    frame.union(frame.where("doc_id = 3")).write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.query(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) | {""}
        for kind in BASE:
            assert r[f"n_{kind}"] == sum(w.startswith(kind) for w in want)


def test_pii_adds_spans_where_labelers_agree():
    patterns = [("phone", (1, 1, 0, 1, 0), 50), ("phone", (-1, 1, 0, 1, 0), 20), ("phone", (-1, -1, -1, -1, -1), 60)]
    posterior = pii.estimate(patterns)
    assert posterior["phone", (1, 1, 0, 1, 0)] > posterior["phone", (-1, 1, 0, 1, 0)] > posterior["phone", (-1, -1, -1, -1, -1)]
    weights = pii.train_classifier([(k, v, 1, posterior[k, v], n) for k, v, n in patterns])
    score = lambda v: sum(a * b for a, b in zip(weights, pii._features("phone", v, 1), strict=True))
    assert score((1, 1, 0, 1, 0)) > 0 > score((-1, -1, -1, -1, -1))


def test_pii_redaction(spark):
    texts = ["mail x@y.com now +1 (988) 555-2485!", None, "é 1.2.3.4", "clean"]
    got = {r.doc_id: r.text for r in pii.redacted(docs_of(spark, texts)).collect()}
    assert got == {0: "mail <EMAIL> now <PHONE>!", 1: None, 2: "é <IP>", 3: "clean"}


def test_pii_redaction_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    rng = random.Random(8)
    atoms = ["a@b.de ", "1.2.3.4 ", "+1 (988) 555-2485", "é\n", "word ", "\U00020bb7", "4111 1111 1111 1111 "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    frame = docs_of(spark, texts)
    got = {r.doc_id: r.text for r in pii.redacted(frame).collect()}
    found = pii.find(frame.withColumn("row", F.col("doc_id")), "row").where("kind IS NOT NULL").collect()
    for i, text in enumerate(texts):
        out, at = "", 0
        for start, end, kind in sorted((r.start, r.end, r.kind) for r in found if r.row == i):
            if end > at:
                out += text[at : max(start, at)] + f"<{kind.upper()}>"
                at = end
        assert got[i] == out + text[at:]


def test_pii_of_one_document_with_very_many_spans(spark):
    text = "".join(f"u{k}@mail{k % 9}.com " for k in range(100_000))
    began = time.time()
    frame = docs_of(spark, [text])
    got = pii.redacted(frame).first().text
    assert got == "<EMAIL> " * 100_000
    assert time.time() - began < 60


def test_pii_main_path_is_native(spark):
    frame = docs_of(spark, ["x@y.com"]).withColumn("row", F.col("doc_id"))
    plan = pii.votes(pii.candidates(frame, "row"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# op4


def toxic_corpus(rng, n=600):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = words(rng, 40, 300).split()
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilest", "grobian", "scumlord"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus(random.Random(4))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (1, rows[1][1])], "doc_id long, text string").withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    scorer = toxicity.train(toxicity.training_sample(docs, labels))
    got = scorer.score(docs.select("doc_id", "text")).collect()
    assert len(got) == len(docs.collect()) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows}
    held = [(r.score >= 0.7) == bool(truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id % 3 == 0]
    assert sum(held) >= 0.97 * len(held)


def test_toxicity_counts_lexicon_words_of_the_whole_text():
    tokens = toxicity.Tokens(frozenset(["idiot", *(f"bad{c}" for c in "abcdefgh")]))
    found = toxicity.features("idiot ok " * 300 + " ".join(f"bad{c}" for c in "abcdefgh"), tokens)
    assert found[toxicity.FEATURES.index("hits")] == 308 and found[toxicity.FEATURES.index("variety")] == 9


def test_toxicity_features_see_disguise_and_second_person():
    tokens = toxicity.Tokens(frozenset(["idiot"]))
    clean, bad = toxicity.features("hello there", tokens), toxicity.features("YOU 1d10t!", tokens)
    names = toxicity.FEATURES
    assert bad[names.index("disguised")] > 0 and bad[names.index("near_you")] > 0 and bad[names.index("shouted")] > 0
    assert clean[names.index("hits")] == 0 and toxicity.features("", tokens)[names.index("length")] == 0


def slow_features(text, lexicon):
    """The features word by word, as the docstring has them."""
    words = text.split()
    strip = toxicity._STRIP
    known = lambda w: w in lexicon or any(len(w) >= n and w[:n] + "-" in lexicon for n in (4, 5))
    kinds = []
    for token in words:
        word, kind = token.strip(strip).lower(), set()
        if word.isalpha():
            kind |= {"hit"} if known(word) else set()
            kind |= {"you"} if word in toxicity.SECOND_PERSON else set()
            kind |= {"loud"} if len(word) > 2 and token.strip(strip) == token.strip(strip).upper() else set()
        elif any(c.isalpha() for c in word):
            kind.add("mixed")
            for worn in (word, token.lower()):
                plain = "".join(c for c in worn.translate(toxicity.DISGUISE) if c.isalnum())
                kind |= {"hit", "worn"} if plain and known(plain) else set()
        kinds.append(kind)
    hits = [k for k, kind in enumerate(kinds) if "hit" in kind]
    yous = [k for k, kind in enumerate(kinds) if "you" in kind]
    n, raw = max(1, len(words)), text.encode()
    share = lambda what: sum(what in kind for kind in kinds) / n
    ascii_share = lambda chars: sum(chr(b) in chars for b in raw if b < 128) / max(1, len(raw))
    return (
        len(hits) / n, float(len(hits)), float(len({words[k].strip(strip).lower() for k in hits})),
        float(max((sum(k <= j < k + toxicity.STRETCH for j in hits) for k in hits), default=0)),
        sum(any(abs(k - j) <= toxicity.NEAR for j in yous) for k in hits) / n, share("worn"),
        ascii_share(string.ascii_uppercase), share("loud"), ascii_share("!?"), ascii_share(string.punctuation), share("mixed"), np.log1p(len(words)),
    )


def test_toxicity_features_against_word_by_word():
    rng = random.Random(6)
    lexicon = frozenset(["idiot", "vile-", "scuml-", "bad"])
    atoms = ["you", "YOU!", "idiot", "1d10t", "vilest", "VILE?", "scumlords,", "b@d", "bad.", "tu", "Café", "abc1", "...", "hello", "DU", "x", "é", "¡idiot!"]
    for _ in range(200):
        text = " ".join(rng.choice(atoms) for _ in range(rng.randint(0, 160)))
        assert np.allclose(toxicity.features(text, toxicity.Tokens(lexicon)), slow_features(text, lexicon)), text
    long = "you idiot " * 200_000
    assert np.allclose(toxicity.features(long, toxicity.Tokens(lexicon))[:3], (0.5, 200_000, 1))


def test_lexicon_against_counting(spark):
    rows = [(i, text, toxic) for i, text, toxic in toxic_corpus(random.Random(5), 300)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    seen = {}
    for _, text, toxic in rows:
        for u in {u for w in text.split() if w.isalpha() for u in toxicity.units(w)}:
            seen.setdefault(u, [0, 0])[toxic] += 1
    n = [sum(1 - r[2] for r in rows), sum(r[2] for r in rows)]
    want = {u for u, c in seen.items() if c[1] >= max(4, 0.02 * n[1]) and (c[1] + 0.1) / n[1] >= 20 * (c[0] + 0.1) / n[0]}
    assert want and set(got) == want


def test_calibration_against_pooled_violators(spark):
    rows = toxic_corpus(random.Random(7), 400)
    rows = [(i, t if rng % 9 else "plain words", y) for rng, (i, t, y) in enumerate(rows)]
    scorer = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    folded = frame.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)))
    margins = toxicity._margin(scorer.trees.transform(toxicity.with_features(folded, scorer.lexicon))).select("doc_id", "fold", "margin", "toxic").collect()
    held = {}
    for r in margins:
        if r.fold == 0:
            held.setdefault(r.margin, []).append(r.toxic)
    pools = []  # [sum, count, least margin, greatest margin]
    for m in sorted(held):
        pools.append([sum(held[m]), len(held[m]), m, m])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, b = pools[-2:]
            pools[-2:] = [[a[0] + b[0], a[1] + b[1], a[2], b[3]]]
    at = [m for p in pools for m in p[2:]]
    value = [p[0] / p[1] for p in pools for _ in range(2)]
    scores = {r.doc_id: r.score for r in scorer.score(frame.select("doc_id", "text")).collect()}
    for r in margins:
        assert abs(scores[r.doc_id] - np.interp(r.margin, at, value)) < 1e-9


def test_toxicity_query_holds_out(spark, tmp_path):
    rows = toxic_corpus(random.Random(8), 300)
    docs = rows + [(2000, None, 0), (2001, "", 0), (2002, "you vilest " * 100_000, 0), (3, rows[3][1], 1)]
    spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # Held-out labels are wrong on purpose: they must not be seen. One id has both labels.
    labels = [(i, 1 - y if out(i) else y) for i, _, y in rows] + [(4, 0), (4, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r.held_out == out(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert sum(right) >= 0.95 * len(right)
    assert len({r.score for r in got if r.doc_id == 3}) == 1


# op5


def test_kernel_ridge_against_explicit_kernel():
    rng = random.Random(5)
    alphabets = {"a": "abcde ", "b": "defgh ", "c": "ghijé "}
    make = lambda lang: "".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(3, 60)))
    languages = [rng.choice("aaabc") for _ in range(60)]
    texts = [make(lang) for lang in languages]
    names = sorted(set(languages))
    model = language_id.train(np.packbits(language_id.presence(texts), axis=1), languages)
    cells = lambda t: {(n, t.lower()[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    own = [cells(t) for t in texts]
    k = np.array([[kernel(x, y) for y in own] for x in own])
    y = np.array([[float(lang == name) for name in names] for lang in languages])
    w = np.array([1 / (len(names) * languages.count(lang)) for lang in languages])
    n = len(texts)
    system = np.block([[w[:, None] * k + language_id.RIDGE * np.eye(n), w[:, None]], [(w @ k)[None, :], np.array([[w.sum()]])]])
    solved = np.linalg.solve(system, np.vstack([w[:, None] * y, (w @ y)[None, :]]))
    fresh = [make(lang) for lang in "abcabc"] + ["a", texts[0]]
    want = np.array([[kernel(cells(t), x) for x in own] for t in fresh]) @ solved[:-1] + solved[-1]
    # Hashed cells collide now and then.
    assert np.abs(language_id.scores(model, fresh) - want).max() < 0.02


def test_rare_languages_are_in_the_sample(spark):
    assert language_id.quotas({"a": 10_000, "b": 3, "c": 500}, 300) == {"b": 3, "c": 148, "a": 149}
    rows = [(i, f"common text {i}", "a") for i in range(3_000)] + [(5_000 + i, f"öäü ßßß {i}", "b") for i in range(3)]
    frame = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    bits, languages, last = language_id._sample(language_id._usable(frame), 100)
    assert languages.count("b") == 3 and languages.count("a") == 97 and len(bits) == 100 and last.count() == 2
    model = language_id.fit(frame, 100)
    assert language_id.predict(docs_of(spark, ["ßäß öü"]), model).first().lang_pred == "b"


def test_language_model_shares_and_thresholds_come_from_all_rows(spark):
    rng = random.Random(6)
    sounds = {"a": "abcd ", "b": "cdef "}
    rows = [(i, "".join(rng.choice(sounds["b" if i % 40 == 0 else "a"]) for _ in range(12)) + ("ß" if i % 500 == 1 else "k"), "b" if i % 40 == 0 else "a") for i in range(5_000)]
    frame = spark.createDataFrame(rows + [(9_000, "q", None), (9_001, None, "a"), (9_002, "12", "zz")], "doc_id long, text string, lang string").repartition(7)
    model, known = language_id.fit_both(frame, 60)
    cells = language_id.presence([t for _, t, _ in rows])
    of = np.array(["ab".index(lang) for *_, lang in rows])
    size = [int((of == k).sum()) for k in (0, 1)]
    counts = [cells[of == k].sum(axis=0) for k in (0, 1)]
    assert (known.shares == np.maximum(counts[0] / size[0], counts[1] / size[1]).astype(np.float32)).all()
    for k, name in enumerate("ab"):
        own = np.maximum(counts[1 - k] / size[1 - k], (counts[k] - 1) / (size[k] - 1)).astype(np.float32)
        middle = np.median(language_id.familiarity([t for _, t, lang in rows if lang == name], own)[0])
        assert abs(known.least[name] - language_id.LEAST_PART * middle) < 1 / language_id.STEPS
    # The same landmarks, weighted least squares over the features of all rows.
    marks = np.unpackbits(language_id._sample(language_id._usable(frame), 60)[0], axis=1)
    values, vectors = np.linalg.eigh(language_id._kernel(marks, marks))
    phi = language_id._kernel(cells, marks) @ (vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]]))
    w2, y = 1 / (2 * np.array(size)[of]), np.eye(2)[of]
    x, t = phi - w2 @ phi, y - w2 @ y
    w = np.linalg.solve((x.T * w2) @ x + language_id.RIDGE * np.eye(x.shape[1]), (x.T * w2) @ t)
    want = x @ w + w2 @ y
    got = language_id.scores(model, [t for _, t, _ in rows])
    assert model.languages == ("a", "b") and np.abs(got - want).max() < 1e-3
    # The order and number of the parts do not matter.
    assert np.abs(language_id.fit(frame.repartition(3), 60).weights - model.weights).max() < 1e-6


def test_language_query_holds_out(spark, tmp_path):
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    sounds = {"xx": "abc", "yy": "cde"}
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lang = rng.choice(list(sounds))
        rows.append((i, "".join(rng.choice(sounds[lang] + " ") for _ in range(40)), lang))
    # Languages of held-out rows must not be seen.
    written = [(i, t, "zz" if out(i) else lang, "s") for i, t, lang in rows] + [(900, None, "xx", None), (901, "!", None, "s"), (902, "ab" * 400_000, "xx", "s"), (0, rows[0][1], None, "s")]
    spark.createDataFrame(written, "doc_id long, text string, lang string, lang_pred string").write.parquet(str(tmp_path / "documents.parquet"))
    got = language_id.query(spark, str(tmp_path)).collect()
    assert len(got) == len(written) and all(r.held_out == out(r.doc_id) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == "xx"
    assert all(by[i].lang_pred == lang for i, _, lang in rows)


def test_language_id_held_out(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ba", "na", "ka", "la"], "ee": ["be", "ne", "ke", "le"], "oo": ["bo", "nö", "kö", "lo"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randint(1, 20)))
        rows.append((i, text, lang))
    train = spark.createDataFrame([r for r in rows if r[0] % 3] + [(900, "abc", None), (901, None, "aa")], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    test = spark.createDataFrame([r for r in rows if not r[0] % 3] + [(800, None, "aa"), (801, "12 !", "aa"), (802, "", "ee")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.predict(test, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (800, 801, 802))
    assert all(got[i].lang_pred == lang for i, _, lang in rows if not i % 3)


def test_presence_of_a_long_text_equals_its_pieces():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdé ") for _ in range(5000))
    whole = language_id.presence([text])
    old, language_id.PIECE_CHARS = language_id.PIECE_CHARS, 97
    try:
        assert (language_id.presence([text]) == whole).all()
    finally:
        language_id.PIECE_CHARS = old


# op6 and op7


def grams(text, width=5):
    own = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    if not own:
        return set()
    return {" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))}


def test_shingles_of_any_piece_size():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 5, 90]))) for _ in range(rng.choice([0, 1, 3, 5, 6, 60]))) for _ in range(60)]
    column, seen = pa.array(texts), {}
    old = shingles.PIECE_BYTES
    try:
        for piece in (old, 64, 300):
            shingles.PIECE_BYTES = piece
            raw, _ = shingles.buffers(column)
            got = {}
            for of, own, first, last in shingles.hashed_shingles(column, 5):
                for o, h, a, b in zip(of, own, first, last, strict=True):
                    text = raw[a:b].tobytes().decode()
                    got.setdefault(int(o), []).append(text)
                    if max(map(len, text.split())) * 3 < 64:
                        assert seen.setdefault(text, h) == h
            for i, text in enumerate(texts):
                own = text.split(" ") if text else []
                want = [" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))] if own else []
                assert got.get(i, []) == want
    finally:
        shingles.PIECE_BYTES = old


def test_decontamination_against_sets(spark):
    rng = random.Random(6)
    items = [(k, words(rng, rng.choice([2, 4, 5, 9, 20, 50]))) for k in range(25)] + [(25, None), (26, "!!"), (3, "one more text under an id that repeats")]
    texts = [None, "", "short"]
    for _ in range(120):
        own = words(rng, rng.randint(0, 200)).split()
        copied = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 2)):  # some words are lost
            if copied:
                copied[rng.randrange(len(copied))] = "zz"
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + copied + own[at:]).upper())
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(0))
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contained_items(docs_of(spark, texts).withColumn("shingle", F.lit(1)), frame).collect()}
    want = {}
    for i, text in enumerate(texts):
        for item, body in items:
            width = min(5, len(grams(body, 1)) if body and len(body.split()) < 5 else 5)
            own = re.sub(r"[\W_]+", " ", (body or "").lower()).split()
            width = min(5, len(own)) or 5
            asked, held = grams(body, width), grams(text, width) if len(re.sub(r"[\W_]+", " ", (text or "").lower()).split()) >= width else set()
            if asked and len(asked & held) >= 0.8 * len(asked) - 1e-9:
                want[i, item] = max(want.get((i, item), 0), len(asked & held) / len(asked))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def near_copies(rng):
    texts = []
    for _ in range(12):
        own = words(rng, rng.randint(1, 90)).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(own)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["zz", "yy"])
            texts.append(" ".join(copy))
    return texts + [None, "", "?!", "a", "A.", "one two three four", texts[0], texts[0].upper()]


@pytest.mark.parametrize("rows_in_group", [1_000, 5])
def test_jaccard_join_against_sets(spark, rows_in_group, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", rows_in_group)
    texts = near_copies(random.Random(8))
    sets = [grams(t) for t in texts]
    links = [[j for j in range(len(texts)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(texts))]
    component = list(range(len(texts)))
    for _ in texts:
        component = [min([component[i], *(component[j] for j in links[i])]) for i in range(len(texts))]
    frame = docs_of(spark, texts).withColumn("key", F.lit("clash"))
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(frame).collect()}
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].component_id) == (len(links[i]), component[i])


def test_near_copies_hand_on_no_pairs(spark, monkeypatch):
    """What is staged between the stages grows with classes and chunks they meet, not with pairs, and holds no lists."""
    handed, stage = {}, common.staged

    def staged(frame, label):
        out = stage(frame, label)
        handed[label] = (out.count(), out.dtypes)
        return out

    monkeypatch.setattr(jaccard_join.common, "staged", staged)
    own = words(random.Random(2), 300).split()
    grown = []
    for n in (400, 800, 1_600):
        frame = docs_of(spark, [" ".join([*own, f"end{k}"]) for k in range(n)])
        rows = jaccard_join.jaccard_links(frame).groupBy("n_links", "component_id").count().collect()
        assert [tuple(r) for r in rows] == [(n - 1, 0, n)]
        most = max(count for label, (count, _) in handed.items() if label in ("jaccard-candidates", "jaccard-links", "jaccard-group-pairs"))
        assert not any("array" in kind for _, types in handed.values() for _, kind in types)
        chunks = -(-n // jaccard_join.GROUP_ROWS)
        assert most <= n * chunks
        grown.append((n, most, n * (n - 1) // 2))
    print("near copies, rows handed on, pairs:", grown)


def test_equal_signatures_of_sets_too_different_in_size():
    sig = np.zeros(jaccard_join.BANDS * jaccard_join.ROWS, dtype=np.uint16).tobytes()
    sets = [np.arange(n, dtype=np.uint64).tobytes() for n in (10, 100)]
    table = pa.table({"key": [1, 2], "first": [True, True], "size": [1, 1], "sig": [sig, sig], "shingles": sets})
    assert jaccard_join._verify(0.8, 1e-5)((pa.scalar(5), pa.scalar(5)), table).num_rows == 0


def test_posterior_bound():
    needed = jaccard_join.least_matches(0.8, 1e-5)
    assert list(needed.values()) == sorted(needed.values())
    assert 0 < needed[20] < needed[120] < 0.8 * 120


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# op8


def test_token_counts_equal_the_library(spark):
    rng = random.Random(1)
    tok = token_counts.tokenizer(token_counts.VOCABULARY)
    parts = ["  ", " ", "\n\n", "<|endoftext|>", "<|endof", "é日本", "don't", "123456", "!!!", " word", "\t", "\x1c", "\xa0"]
    texts = ["".join(rng.choice(parts + ["a" * rng.randint(1, 80)]) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    texts += [None, "", "<|endoftext|>", "plain words here", "plain words here"]
    frame = docs_of(spark, texts).withColumn("n_bytes", F.lit("clash"))
    got = {r.doc_id: r for r in token_counts.count_tokens(frame, chunk_chars=200, overlap_chars=40).collect()}
    for i, text in enumerate(texts):
        assert got[i].n_tokens == len(tok.encode(text or "", add_special_tokens=False))
        assert got[i].n_bytes == len((text or "").encode())


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "ab " * 3000, "<|endoftext|>" * 400])
def test_overlaps_widen_where_nothing_aligns(text):
    count, _ = token_counts.spliced(text, token_counts.VOCABULARY, chunk=300, overlap=48)
    assert count == len(token_counts.tokenizer(token_counts.VOCABULARY).encode(text, add_special_tokens=False))


# op9


@pytest.mark.parametrize("rows_in_cell", [1_000, 3])
def test_embedding_join_against_all_pairs(spark, rows_in_cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_VALUES", rows_in_cell * 20)
    rng = np.random.default_rng(5)
    rows, number = [], 0
    for _ in range(25):
        centre = rng.standard_normal(20)
        for _ in range(rng.integers(1, 7)):
            vector = (centre + rng.standard_normal(20) * 0.12) * rng.choice([1, 3])
            rows.append((number, [float(np.float32(x)) for x in vector], int(rng.integers(0, 2))))
            number += 1
    rows += [(number + k, rows[0][1], rows[0][2]) for k in range(4)]
    odd = [None, [], [0.0] * 20, [float("nan")] * 20, [None] * 20, [float("inf")] * 20, [1.0, 0.0]]
    rows += [(500 + k, v, 0) for k, v in enumerate(odd)] + [(600, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    sound = [r for r in rows if r[1] and r[2] is not None and len(r[1]) == 20 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: [] for r in rows}
    for a in sound:
        for b in sound:
            x, y = np.array(a[1]), np.array(b[1])
            if a[0] != b[0] and a[2] == b[2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a[0]].append(b[0])
    component = {k: k for k in links}
    for _ in links:
        component = {k: min([component[k], *(component[j] for j in links[k])]) for k in links}
    assert got == {k: (len(links[k]), component[k]) for k in links}


# op10


def repeats(rows):
    """(bytes, removed, spans, digest) of each document, string by string."""
    seen, gone = set(), {k: np.zeros(len(t), bool) for k, t in rows}
    for k, text in rows:
        for i in range(len(text) - 99):
            own = text[i : i + 100]
            if own in seen:
                gone[k][i : i + 100] = True
            seen.add(own)
    out = {}
    for k, text in rows:
        g = gone[k]
        kept = np.frombuffer(text, np.uint8)[~g].tobytes()
        out[k] = (len(text), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeated_corpus(rng):
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    blocks = [make(rng.choice([90, 100, 101, 130, 250, 400])) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice([rng.choice(blocks), make(rng.randint(0, 120)), rng.choice(blocks)[: rng.randint(1, 300)], "a" * rng.randint(0, 300), "ab" * rng.randint(0, 200)]) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 - 50, "".join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, "a" * 99), (1003, "a" * 1500), (1004, make(50) * 40)]


@pytest.mark.parametrize("memory", [100_000, 40, 7])
def test_suffix_removal_against_every_string(spark, memory):
    rows = repeated_corpus(random.Random(2))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame, memory).collect()}
    assert got == repeats(sorted((k, (t or "").encode()) for k, t in rows))


def test_suffix_removal_in_a_very_long_text(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    parts = [make(30_000) for _ in range(12)]
    long = "".join(parts) + parts[3] + "z" * 9_000 + parts[7][200:] + make(100_000) + parts[0][:99]
    assert len(long.encode()) > suffix_dedup.PIECE_BYTES
    rows = [(1, parts[5][100:700]), (2, long), (3, parts[11][:1_000] + make(200)), (4, "z" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame, 1_000).collect()}
    assert got == repeats([(k, t.encode()) for k, t in rows])


def test_priority_queue_of_preceding_bytes(tmp_path):
    rng = np.random.default_rng(4)
    n = 3_000
    t = suffix_dedup.Tuples(np.arange(n), np.zeros(n, np.int64), rng.integers(97, 101, (n, suffix_dedup.HALF)).astype(np.uint8), np.full(n, 34, np.uint8), rng.integers(70, 101, n).astype(np.uint8))
    t.lcp[0] = 0
    queue = suffix_dedup.PriorityQueue(suffix_dedup.Store(str(tmp_path / "queues")), 500)
    for k in range(0, n, 250):
        queue.insert(t.take(slice(k, k + 250)), 0, k + 250 < n)
    got = [suffix_dedup.joined(list(own)) for own in queue]
    for byte, own in zip(range(97, 101), got, strict=True):
        rows = np.flatnonzero((t.before[:, 0] == byte) & suffix_dedup._usable(t, 0))
        assert set(rows) <= set(own.seq) and (np.diff(own.seq) > 0).all()
        for before, here, lcp in zip(own.seq, own.seq[1:], own.lcp[1:]):
            assert lcp == t.lcp[before + 1 : here + 1].min() + 1


def test_suffix_removal_with_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "x" * 10 + "abc" * 50), (1, "x" * 10 + "abc" * 50), (None, "y" * 120)], "doc_id long, text string").withColumn("seq", F.lit("clash"))
    got = suffix_dedup.remove_repeats(frame).collect()
    assert sorted(r.n_removed for r in got if r.doc_id == 1)[-1] == 160 and len(got) == 3


def test_anchor_pieces_give_the_anchors_of_the_whole():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 105, 5000).astype(np.uint8)
    whole, hashes = suffix_dedup.anchors(raw)
    old, suffix_dedup.PIECE_BYTES = suffix_dedup.PIECE_BYTES, 700
    try:
        parts = list(suffix_dedup.text_anchors(raw))
    finally:
        suffix_dedup.PIECE_BYTES = old
    at = np.concatenate([p[0] for p in parts])
    assert set(whole) <= set(at) and len(set(at)) == len(at)
    starts = np.arange(len(raw) - 99)
    nearest = whole[np.minimum(np.searchsorted(whole, starts), len(whole) - 1)]
    assert (nearest - starts <= suffix_dedup.BEFORE).all()


# The registered queries and edge rows


def test_decontamination_sql_and_query_on_short_items_and_long_texts(spark, tmp_path):
    rng = random.Random(10)
    items = [(1, "one"), (2, "two words"), (3, words(rng, 30)), (4, "a b c d"), (5, None), (6, " "), (7, words(rng, 6))]
    long = words(rng, 3_000)
    docs = [(1, "ONE more"), (2, "two, words"), (None, "one"), (3, long + " " + items[2][1] + " " + long), (4, "c d a b c d"), (4, "a b c d"), (5, items[6][1]), (6, None), (7, "")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").withColumn("width", F.lit(9)).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(decontamination.SQL).fetchall()
    got = [tuple(r) for r in decontamination.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[1] for r in got} == {1, 2, 3, 4, 7}
    long = words(rng, 150_000)
    frame = docs_of(spark, [long + " " + items[2][1] + " " + long, long])
    found = decontamination.contained_items(frame, spark.createDataFrame(items[2:3], "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(0, 3, 1.0)]


def test_jaccard_join_of_long_texts_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 1_000)
    rng = random.Random(11)
    long = words(rng, 120_000)
    short = words(rng, 50)
    rows = [(1, long), (2, long + " tail"), (5, short), (5, short + " x"), (None, short), (None, None), (8, ""), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.jaccard_links(frame).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None), (8, 0, 8), (8, 0, 8)], key=repr)


def test_embeddings_with_repeated_and_missing_ids(spark):
    near, far = [1.0, 0.0, 0.01], [0.0, 1.0, 0.0]
    rows = [(3, near, 1), (3, [1.0, 0.0, 0.0], 1), (None, near, 1), (None, far, 1), (7, far, 2), (9, near, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 0, None), (7, 0, 7), (9, 3, 3)], key=repr)


def test_queries_of_token_counts_and_repeats(spark, tmp_path):
    rng = random.Random(13)
    block = words(rng, 60)
    docs = [(1, block), (2, block + " tail"), (3, "word " * 512), (4, "word " * 513 + "."), (5, None), (6, ""), (7, "word " * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("seq", F.lit("clash"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    tok = token_counts.tokenizer(token_counts.VOCABULARY)
    got = {r.doc_id: r for r in token_counts.query(spark, str(tmp_path)).collect()}
    for i, text in docs:
        n = len(tok.encode(text or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 512, len((text or "").encode()))
    assert {got[i].over_limit for i in (3, 4)} == {True, False} or got[3].n_tokens != 512
    left = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.query(spark, str(tmp_path)).collect()}
    assert left == repeats([(i, (t or "").encode()) for i, t in docs])


def test_staged_folders_go(spark):
    import os

    other, since = common.staged(spark.range(3), "test"), common.staged_folders()
    first = common.staged(spark.range(3), "test")
    kept = common.finished(spark, lambda: common.staged(spark.range(5), "test").where("id > 1"), "test", since)
    folder = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 3 and os.path.isdir(folder(kept)) and other.count() == 3
    with pytest.raises(Exception):
        first.count()
