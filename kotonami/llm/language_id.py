"""Language identification with a blended-spectrum string kernel (op5).

Two texts are as alike as the character n-grams (n = 1..3) that occur in both: the presence kernel
k(x, y) = |X and Y| / sqrt(|X| |Y|). N-grams are hashed into ``DIMENSIONS`` cells. A kernel ridge
regression, one language against the rest, is trained on Nyström features: with landmarks L,
phi(x) = k(x, L) K(L, L)^(-1/2). All of it after the presence vectors is linear, so the trained
model is one matrix (cells by languages) and a batch of texts is scored by one matrix product.

Training reads every row with a language and a letter, whole texts. The regression needs of the rows only sums: each task adds up
the weighted products of its rows' kernels with the landmarks, and, for ``familiar``, the rows of each language that have a cell. The
sums of the tasks are added as whole numbers (``UNIT`` parts), so their order does not matter. Landmarks are but the basis of the
features: ``LANDMARKS`` rows, shared evenly among the languages (what a rare one cannot fill goes to the others), of each those that come
first in an order by a hash of id and text. Every language is learnt, up to the ``MAX_LANGUAGES`` most frequent: the model has a column for each.
Scoring reads every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without training
rows every text is ``und``; ties go to the language that comes first by name; repeated rows are
scored alike. Lengths are not limited: a text's n-grams are gathered piece by piece.

The outputs of a text sum to 1 over the languages, so the best one says nothing of texts in none of
them. ``familiar`` tells these: see ``Familiarity``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMENSIONS = 1 << 14
MAX_LANGUAGES = 3_000
LANDMARKS = 240
#: Parts of 1 in which sums of weighted kernels, 1 at most, pass from the tasks to the driver.
UNIT = 1 << 60
#: Parts of 1 in which familiarities are counted for their median.
STEPS = 1 << 16
RIDGE = 1e-2
UNKNOWN = "und"
PIECE_CHARS = 1 << 18
BATCH = 128
#: A text is familiar from this part of the middle training text's familiarity on.
LEAST_PART = 0.35


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: DIMENSIONS x languages, to be multiplied with a presence vector of length 1.
    weights: np.ndarray
    bias: np.ndarray


@dataclass(frozen=True)
class Familiarity:
    """How far the 3-grams of a text are those of the training texts, however many languages there are.

    A cell's share is the part of a language's training texts that have it, the largest over the
    languages; a text's familiarity is the mean share over all its 3-grams, so its length does not
    matter. Texts go whose familiarity, two standard errors added, is below the predicted
    language's least one.
    """

    shares: np.ndarray
    #: Language -> least familiarity: ``LEAST_PART`` of the median of all its training texts, each left out of the shares.
    least: dict[str, float]


def _grams(rows: list[int], pieces: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, row, cell) of the hashed n-grams of ``pieces``, n = 1..3."""
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    joined = "".join(pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    of = np.repeat(np.asarray(rows, dtype=np.int64), lengths)
    whole = np.repeat(np.arange(len(pieces)), lengths)
    total = (codes + np.uint32(7)) * np.uint32(0x9E3779B1)
    for n in range(1, 4):
        fits = slice(None)
        if n > 1:
            total = (total[:-1] ^ (total[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :]
            total *= np.uint32(0xC2B2AE3D)
            fits = whole[: len(total)] == whole[n - 1 :]
        if len(total) == 0:
            break
        yield n, of[: len(total)][fits], (total >> shift).astype(np.int64)[fits]


def _in_pieces(texts: list[str], mark) -> None:
    """Call ``mark`` with rows and pieces of all lower-cased texts; each n-gram is whole in one piece at least."""
    rows: list[int] = []
    pieces: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        text = text.lower()
        for k in range(0, max(1, len(text)), PIECE_CHARS):
            piece = text[max(0, k - 2) : k + PIECE_CHARS]
            rows.append(i)
            pieces.append(piece)
            held += len(piece)
            if held >= PIECE_CHARS:
                mark(rows, pieces)
                rows, pieces, held = [], [], 0
    if pieces:
        mark(rows, pieces)


def presence(texts: list[str]) -> np.ndarray:
    """One row of cells per text: which hashed 1- to 3-grams of its lower-cased characters occur."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=bool)
    flat = out.reshape(-1)

    def mark(rows: list[int], pieces: list[str]) -> None:
        for _, row, cell in _grams(rows, pieces):
            flat[row * DIMENSIONS + cell] = True

    _in_pieces(texts, mark)
    return out


def familiarity(texts: list[str], shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean share of the 3-grams of each text (a space at both ends) and the standard error of that mean."""
    n, total, square = np.zeros((3, len(texts)))

    def mark(rows: list[int], pieces: list[str]) -> None:
        for k, row, cell in _grams(rows, pieces):
            if k == 3:
                share = shares[cell].astype(np.float64)
                n[:] += np.bincount(row, minlength=len(texts))
                total[:] += np.bincount(row, weights=share, minlength=len(texts))
                square[:] += np.bincount(row, weights=share**2, minlength=len(texts))

    _in_pieces([f" {t} " for t in texts], mark)
    n = np.maximum(n, 1)
    mean = total / n
    # One part in n more: the spread of a few 3-grams says little.
    return mean, np.sqrt((np.maximum(square / n - mean**2, 0) + 1 / n) / n)


def _unit(cells: np.ndarray) -> np.ndarray:
    x = cells.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def _kernel(cells: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The kernel of each row of ``cells`` with each of ``marks``, from whole numbers."""
    common = cells.astype(np.float32) @ marks.astype(np.float32).T
    return common / np.sqrt(np.maximum(np.outer(cells.sum(axis=1), marks.sum(axis=1)), 1))


class Sums:
    """What the regression and the shares need of training rows; the sums of parts are those of the whole.

    ``products``: k k' of the rows' kernels k with the landmarks, weighted. ``kernels``: k, weighted, by language.
    ``counts``: rows that have a cell, by language. Each language weighs the same, all together 1.
    """

    def __init__(self, marks: np.ndarray, sizes: list[int], counted: bool = False):
        self.marks, self.counted = marks.astype(np.float32), counted
        self.weights = 1 / (len(sizes) * np.asarray(sizes, dtype=np.float64))
        self.products = np.zeros((len(marks), len(marks)))
        self.kernels: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}

    def add(self, cells: np.ndarray, of: np.ndarray) -> None:
        """Rows of cells and the place of each one's language."""
        own = _kernel(cells, self.marks)
        weighted = own * self.weights[of][:, None]
        self.products += own.T @ weighted
        for k in np.unique(of):
            self.kernels[k] = self.kernels.get(k, 0) + weighted[of == k].sum(axis=0)
            if self.counted:
                self.counts[k] = self.counts.get(k, 0) + cells[of == k].sum(axis=0)

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(language, places, whole numbers): counts by cell, behind them kernels by landmark; products as language -1."""
        whole = lambda x: np.rint(x * UNIT).astype(np.int64)
        if self.kernels:
            at = np.triu_indices(len(self.marks))
            yield -1, at[0] * len(self.marks) + at[1], whole(self.products[at])
        for k, own in self.kernels.items():
            yield k, DIMENSIONS + np.arange(len(own)), whole(own)
        for k, own in self.counts.items():
            at = np.flatnonzero(own)
            yield k, at, own[at]


def _solved(names: tuple[str, ...], marks: np.ndarray, products: np.ndarray, kernels: np.ndarray, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression by the sums over its rows; ``kernels`` has a row for each language."""
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    sound = values > 1e-6 * values[-1]
    root = vectors[:, sound] / np.sqrt(values[sound])
    centre, middle = kernels.sum(axis=0) @ root, np.full(len(names), 1 / len(names))
    spread = root.T @ products @ root - np.outer(centre, centre)
    w = np.linalg.solve(spread + ridge * np.eye(len(spread)), (kernels @ root).T - np.outer(centre, middle))
    return Model(names, (_unit(marks).T.astype(np.float64) @ (root @ w)).astype(np.float32), (middle - centre @ w).astype(np.float32))


def _nothing() -> Model:
    return Model((), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.float32))


def train(bits: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nyström features of presence vectors (packed), rows in a fixed order, landmarks in turn by language."""
    names = tuple(sorted(set(languages)))
    if not names:
        return _nothing()
    turn: list[int] = []
    by = [[i for i, own in enumerate(languages) if own == name] for name in names]
    for k in range(max(map(len, by))):
        turn += [rows[k] for rows in by if k < len(rows)]
    marks = np.unpackbits(bits[turn[:landmarks]], axis=1)
    sums, of = Sums(marks, [len(rows) for rows in by]), np.array([names.index(own) for own in languages])
    for k in range(0, len(bits), BATCH):
        sums.add(np.unpackbits(bits[k : k + BATCH], axis=1), of[k : k + BATCH])
    return _solved(names, marks, sums.products, np.array([sums.kernels[k] for k in range(len(names))]), ridge)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Ridge outputs, one row per text and one column per language."""
    return _unit(presence(texts)) @ model.weights + model.bias


def _packed(batches) -> Iterator:
    for pdf in batches:
        for k in range(0, len(pdf), BATCH):
            part = pdf.iloc[k : k + BATCH]
            bits = np.packbits(presence(part["text"].tolist()), axis=1)
            yield part.drop(columns="text").assign(cells=[row.tobytes() for row in bits])


def _usable(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")


def quotas(counts: dict[str, int], bound: int) -> dict[str, int]:
    """Rows of each language: even parts of ``bound``; what a rare language leaves over is shared again."""
    out: dict[str, int] = {}
    left = sorted(counts, key=lambda name: (counts[name], name))
    while left:
        part = max(1, (bound - sum(out.values())) // len(left))
        name = left.pop(0)
        out[name] = min(counts[name], part)
    return out


def _counts(usable: DataFrame) -> dict[str, int]:
    """Rows of each language, the most frequent first."""
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    return {r["lang"]: r["n"] for r in counted.collect()}


def _sample(usable: DataFrame, bound: int, counts: dict[str, int] | None = None) -> tuple[np.ndarray, list[str], DataFrame]:
    """Packed presence vectors and languages of ``bound`` rows, and (lang, last): the greatest hash among them of each language."""
    spark = usable.sparkSession
    place = F.xxhash64("doc_id", "text")
    counts = _counts(usable) if counts is None else counts
    wanted = quotas(dict(list(counts.items())[:bound]), bound)
    # The hash below which about twice the rows wanted of a language lie.
    below = [(name, _share(counts[name], n)) for name, n in wanted.items()]
    limits = spark.createDataFrame(below, "lang string, below long")
    found = (
        usable.withColumn("place", place)
        .join(F.broadcast(limits), "lang")
        .where("place <= below")
        .select("doc_id", "lang", "place", "text")
        .mapInPandas(_packed, "doc_id long, lang string, place long, cells binary")
        .orderBy("place", "doc_id", "cells", "lang")
        .limit(4 * bound)  # only rows that repeat very often can pass it
        .collect()
    )
    taken = dict.fromkeys(wanted, 0)
    rows, last = [], {}
    for r in found:
        if taken[r["lang"]] < wanted[r["lang"]]:
            taken[r["lang"]] += 1
            rows.append(r)
            last[r["lang"]] = r["place"]
    bits = np.frombuffer(b"".join(r["cells"] for r in rows), dtype=np.uint8).reshape(len(rows), DIMENSIONS // 8)
    return bits, [r["lang"] for r in rows], spark.createDataFrame(list(last.items()), "lang string, last long")


def _sum_batches(bits: np.ndarray, names: tuple[str, ...], sizes: list[int], counted: bool):
    def run(batches) -> Iterator[pd.DataFrame]:
        sums = Sums(np.unpackbits(bits, axis=1), sizes, counted)
        place = {name: k for k, name in enumerate(names)}
        for pdf in batches:
            for k in range(0, len(pdf), BATCH):
                part = pdf.iloc[k : k + BATCH]
                sums.add(presence(part["text"].tolist()), part["lang"].map(place).to_numpy())
        for k, at, value in sums.parts():
            yield pd.DataFrame({"of": np.full(len(at), k, np.int32), "at": at.astype(np.int32), "value": value})

    return run


def _learnt(usable: DataFrame, landmarks: int, counted: bool = False) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model of all rows, and by language the number of rows and, if ``counted``, that of the rows with each cell."""
    sizes = _counts(usable)
    names = tuple(sorted(sizes))
    if not names:
        return _nothing(), np.zeros(0), np.zeros((0, DIMENSIONS))
    bits, *_ = _sample(usable, landmarks, sizes)
    size, m = [sizes[name] for name in names], len(bits)
    rows = usable.where(F.col("lang").isin(list(names))).select("lang", "text")
    parts = rows.mapInPandas(_sum_batches(bits, names, size, counted), "of int, at int, value long")
    table = parts.groupBy("of", "at").agg(F.sum("value").alias("value")).toArrow()
    of, at, value = (table[name].to_numpy() for name in ("of", "at", "value"))
    products, kernels, counts = np.zeros((m, m)), np.zeros((len(names), m)), np.zeros((len(names), DIMENSIONS))
    own, count = of < 0, (of >= 0) & (at < DIMENSIONS)
    kernel = ~own & ~count
    products.reshape(-1)[at[own]] = value[own] / UNIT
    products = np.maximum(products, products.T)  # one half was added up, none of it below 0
    kernels[of[kernel], at[kernel] - DIMENSIONS] = value[kernel] / UNIT
    counts[of[count], at[count]] = value[count]
    return _solved(names, np.unpackbits(bits, axis=1), products, kernels), np.array(size), counts


def fit(labelled: DataFrame, landmarks: int = LANDMARKS) -> Model:
    """Train on all rows of ``labelled`` (doc_id, text, lang) that have a language and a letter."""
    return _learnt(_usable(labelled), landmarks)[0]


def fit_both(labelled: DataFrame, landmarks: int = LANDMARKS) -> tuple[Model, Familiarity]:
    """``fit``, and what is familiar by the same rows."""
    usable = _usable(labelled)
    model, size, count = _learnt(usable, landmarks, counted=True)
    share = count / size[:, None]
    most = share.max(axis=0, initial=0.0)
    if not model.languages:
        return model, Familiarity(most.astype(np.float32), {})
    # The largest share in another language: the second one where the language's own is the largest.
    best = share.argmax(axis=0)
    rest = share.copy()
    rest[best, np.arange(DIMENSIONS)] = 0
    second = rest.max(axis=0)
    # Without the text itself: all its cells have been counted once for it.
    without: dict[str, np.ndarray] = {}
    for k, name in enumerate(model.languages):
        if size[k] > 1:
            others = np.where(best == k, second, most)
            without[name] = np.maximum(others, (count[k] - 1) / (size[k] - 1)).astype(np.float32)

    def measured(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("lang"):
                for k in range(0, len(part), BATCH):
                    own = part.iloc[k : k + BATCH]
                    value = familiarity(own["text"].tolist(), without[name])[0]
                    yield own[["lang"]].assign(step=np.rint(value * STEPS).astype(np.int32))

    rows = usable.where(F.col("lang").isin(list(without))).select("lang", "text")
    steps = rows.mapInPandas(measured, "lang string, step int").groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    middle = steps.groupBy("lang").agg((F.percentile("step", F.lit(0.5), F.col("n")) / STEPS).alias("m"))
    least = {r["lang"]: LEAST_PART * r["m"] for r in middle.collect()} if without else {}
    return model, Familiarity(most.astype(np.float32), least)


def _share(total: int, wanted: int) -> int:
    """The hash below which about twice the wanted number of ``total`` rows lies."""
    part = min(1.0, 2 * wanted / max(total, 1))
    return int(-(1 << 63) + part * ((1 << 64) - 1)) if part < 1 else (1 << 63) - 1


def _predict_batches(model: Model, known: Familiarity | None):
    def run(batches) -> Iterator:
        for pdf in batches:
            texts = pdf["scored_text"].tolist()
            best = np.zeros(len(texts), dtype=np.int64)
            value = np.zeros(len(texts))
            for k in range(0, len(texts), BATCH):
                out = scores(model, texts[k : k + BATCH])
                best[k : k + BATCH] = out.argmax(axis=1)
                value[k : k + BATCH] = out.max(axis=1)
            names = np.asarray(model.languages, dtype=object)
            letters = pdf["scored_letters"].to_numpy()
            pdf["lang_pred"] = np.where(letters, names[best], UNKNOWN)
            pdf["score"] = np.where(letters, np.clip(value, 0.0, 1.0), 0.0)
            if known is not None:
                least = np.array([known.least.get(name, 0.0) for name in model.languages])
                familiar = np.zeros(len(texts), dtype=bool)
                for k in range(0, len(texts), BATCH):
                    mean, error = familiarity(texts[k : k + BATCH], known.shares)
                    familiar[k : k + BATCH] = mean + 2 * error >= least[best[k : k + BATCH]]
                pdf["familiar"] = familiar & letters
            yield pdf.drop(columns=["scored_text", "scored_letters"])

    return run


def predict(
    docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), known: Familiarity | None = None
) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (0..1) of each row's whole text, and ``familiar`` by ``known``."""
    body = F.coalesce(docs[text], F.lit(""))
    if not model.languages:
        return docs.select(
            *[docs[c] for c in keep],
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            *([] if known is None else [F.lit(False).alias("familiar")]),
        )
    rows = docs.select(
        *[docs[c] for c in keep], body.alias("scored_text"), body.rlike(r"\p{L}").alias("scored_letters")
    )
    schema = T.StructType([f for f in rows.schema if f.name not in ("scored_text", "scored_letters")])
    schema = schema.add("lang_pred", "string").add("score", "double")
    if known is not None:
        schema = schema.add("familiar", "boolean")
    return rows.mapInPandas(_predict_batches(model, known), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id leaves another remainder than 2 by 4."""
    return docs.where(common.bucket_of(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the rows that are not held out."""
    docs = common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = fit(training_rows(docs))
    rows = docs.withColumn("held_out", common.bucket_of(F.col("doc_id"), 4) == 2)
    return predict(rows, model, keep=("doc_id", "held_out"))
