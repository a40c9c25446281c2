"""Toxicity scores: boosted trees over dense features, with isotonic calibration (op4).

Features of a whole text, all found in one pass over its tokens: density, number and variety of
lexicon words, their densest stretch of 50 tokens, lexicon words near a second-person word, lexicon words in
disguise (digits and signs for letters), capitals, shouted tokens, exclamation and other
punctuation, tokens that mix letters with digits or signs, and length.

The lexicon is learnt: words and word beginnings (4 and 5 letters) that occur in a fiftieth of the
toxic and hardly any other document, all of them: a text of n such units has a part in no more than 50 n entries.
Lexicon and gradient-boosted trees come from two thirds of the sample; isotonic regression on the rest, which neither has
seen, turns the trees' margin into a probability.

The sample is bounded: the ``MAX_TRAINING`` labelled ids that come first by a hash. Everything
else runs over all rows. Scores never see labels, language, source or id.

Defined results: a null or empty text has the features of no tokens and is scored like any other;
rows without a label are scored, not learnt from; an id with labels of both kinds counts as toxic; repeated rows get equal scores; an empty table
gives no rows. Without both classes in the sample the score is the sample's share of toxic rows (0
without labels).
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_TRAINING = 6_000
LEAST_DOCS = 4
LEAST_SHARE = 0.02
LEAST_ODDS = 20.0
TREES = 15
DEPTH = 3
THRESHOLD = 0.7
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton vous votre tú ti usted ustedes vosotros".split()
)
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("01345@$!|", "oieasasil")
REMEMBERED = 500_000
NEAR = 3
STRETCH = 50
FEATURES = (
    "density hits variety stretch near_you disguised capitals shouted exclaimed punctuation mixed length".split()
)
_HIT, _DISGUISED, _YOU, _MIXED, _SHOUTED = 1, 2, 4, 8, 16
_STRIP = string.punctuation + "¡¿«»„“”"
_TABLE = np.zeros((3, 256), dtype=np.uint8)
_TABLE[0, 65:91] = 1
_TABLE[1, [ord("!"), ord("?")]] = 1
_TABLE[2, [ord(c) for c in string.punctuation]] = 1


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings."""
    return [word, *(word[:n] + "-" for n in (4, 5) if len(word) >= n)]


class Tokens(dict):
    """Token -> code; the codes of tokens seen before are remembered."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        word = token.strip(_STRIP).lower()
        code = 0
        if word.isalpha():
            if any(u in self.lexicon for u in units(word)):
                code |= _HIT
            if word in SECOND_PERSON:
                code |= _YOU
            if len(word) > 2 and token.strip(_STRIP).isupper():
                code |= _SHOUTED
        elif any(c.isalpha() for c in word):
            code |= _MIXED
            for worn in (word, token.lower()):
                plain = re.sub(r"[\W_]+", "", worn.translate(DISGUISE))
                if plain and any(u in self.lexicon for u in units(plain)):
                    code |= _HIT | _DISGUISED
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = code
        return code


def features(text: str, tokens: Tokens) -> tuple[float, ...]:
    """The dense features of a whole text, in the order of ``FEATURES``."""
    words = text.split()
    n = max(1, len(words))
    codes = np.fromiter(map(tokens.__getitem__, words), dtype=np.uint8, count=len(words))
    hit = np.flatnonzero(codes & _HIT)
    you = np.flatnonzero(codes & _YOU)
    near = 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        before = np.abs(hit - you[np.maximum(at - 1, 0)])
        after = np.abs(you[np.minimum(at, len(you) - 1)] - hit)
        near = int((np.minimum(before, after) <= NEAR).sum())
    dense = int((np.searchsorted(hit, hit + STRETCH) - np.arange(len(hit))).max()) if len(hit) else 0
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    size = max(1, len(raw))
    capitals, exclaimed, punctuation = (int(row[raw].sum(dtype=np.int64)) / size for row in _TABLE)
    return (
        len(hit) / n,
        float(len(hit)),
        float(len({w.strip(_STRIP).lower() for w in {words[i] for i in hit}})),
        float(dense),
        near / n,
        int(((codes & _DISGUISED) > 0).sum()) / n,
        capitals,
        int(((codes & _SHOUTED) > 0).sum()) / n,
        exclaimed,
        punctuation,
        int(((codes & _MIXED) > 0).sum()) / n,
        math.log1p(len(words)),
    )


def _units_of(batches) -> Iterator[pd.DataFrame]:
    """The different lexicon units of each text, counted over the batch by label."""
    for pdf in batches:
        for k in range(0, len(pdf), 200):
            part = pdf.iloc[k : k + 200]
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                own: set[str] = set()
                for token in set(text.split()):
                    word = token.strip(_STRIP).lower()
                    if word.isalpha():
                        own.update(units(word))
                for u in own:
                    counts.setdefault(u, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame(
                {"unit": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}
            )


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Units frequent in toxic and rare in other texts of ``sample`` (text, toxic)."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = (
        sample.select("text", "toxic")
        .mapInPandas(_units_of, "unit string, clean long, toxic long")
        .groupBy("unit")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    odds = (F.col("toxic") + 0.1) / sizes.get(1, 1) / ((F.col("clean") + 0.1) / max(1, sizes.get(0, 1)))
    rows = (
        counts.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * sizes.get(1, 1))) & (odds >= LEAST_ODDS))
        .orderBy(F.desc("toxic"), "unit")
        .collect()
    )
    return [r["unit"] for r in rows]


def _feature_batches(lexicon: list[str]):
    def run(batches) -> Iterator[pd.DataFrame]:
        tokens = Tokens(frozenset(lexicon))
        for pdf in batches:
            rows = np.array([features(t, tokens) for t in pdf["text"]], dtype=np.float64).reshape(-1, len(FEATURES))
            out = pdf.drop(columns="text")
            for k, name in enumerate(FEATURES):
                out[f"f_{name}"] = rows[:, k]
            yield out

    return run


def with_features(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """``docs`` with its column ``text`` replaced by the dense features (``f_...``)."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    schema = T.StructType([f for f in rows.schema if f.name != "text"])
    for name in FEATURES:
        schema = schema.add(f"f_{name}", "double")
    return rows.mapInPandas(_feature_batches(lexicon), schema)


def training_sample(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, text, toxic) of the labelled ids that come first by a hash, at most ``max_training``."""
    ids = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_training)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return common.staged(texts.join(ids, "doc_id").select("doc_id", "text", "toxic"), "toxicity-sample")


class Scorer:
    """A trained model: lexicon, boosted trees and calibration."""

    def __init__(self, lexicon: list[str], trees: PipelineModel | None, curve, constant: float = 0.0):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` replaced by ``score`` (0..1)."""
        if self.trees is None:
            return docs.drop("text").withColumn("score", F.lit(self.constant))
        kept = [c for c in docs.columns if c != "text"]
        margin = _margin(self.trees.transform(with_features(docs, self.lexicon)))
        return self.curve.transform(margin).select(
            *kept, F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)).alias("score")
        )


def _margin(rows: DataFrame) -> DataFrame:
    return rows.withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))


def train(sample: DataFrame) -> Scorer:
    """Learn from ``sample`` (doc_id, text, toxic 0/1)."""
    shares = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not shares["n"] or not 0 < shares["toxic"] < shares["n"]:
        return Scorer([], None, None, float(bool(shares["toxic"])))
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)))
    learnt_from = sample.where("fold > 0")
    if learnt_from.select("toxic").distinct().count() < 2:
        learnt_from = sample
    lexicon = learn_lexicon(learnt_from)
    rows = common.staged(with_features(sample, lexicon), "toxicity-features")
    assembler = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features")
    vectors = assembler.transform(rows).select("fold", "features", F.col("toxic").cast("double").alias("label"))
    fitted = vectors.where("fold > 0")
    if fitted.select("label").distinct().count() < 2:
        fitted = vectors
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=64).fit(fitted.coalesce(4))
    trees = PipelineModel([assembler, model])
    held = vectors.where("fold = 0")
    held = vectors if held.select("label").distinct().count() < 2 else held
    margins = _margin(model.transform(held)).select("margin", "label")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins.coalesce(1))
    return Scorer(lexicon, trees, curve)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows that are not held out."""
    docs = common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = common.bucket_of(F.col("doc_id"), 3) == 1
    labels = common.only(common.read(spark, sf_dir, "labels"), "doc_id", "toxic").where(~held_out)
    scorer = train(training_sample(docs, labels))
    scored = scorer.score(docs.withColumn("held_out", held_out))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
