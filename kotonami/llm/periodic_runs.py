"""Runs of repeated words: power-of-two naming, grid candidates, extension by common prefixes (op13).

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` long, that no neighbouring
word extends. Per document:

* Naming after Karp, Miller and Rosenberg: level k names the 2^k words from each position, equal names
  for equal words; level k + 1 names pairs of level k names. Positions whose name is their own get no
  further naming, and the levels end where all are such. Names hold within a document, so
  a batch of documents is named at once and no match crosses from one into the next.
* A run of period q has at least three whole periods after one of its first q positions, and one of
  these is a multiple of q (the grid). So candidates are the pairs (g, g + q) of the grid whose names agree
  on the level of the largest power of two that 2 q words hold.
* Each candidate is extended both ways by the longest common extension, in descending levels. A stretch
  found with several periods is a run of the smallest.

All is exact: names are compared, never hashes. Memory is linear in a document's words times the levels,
time n log n candidates at most, taken in blocks. A null text has no words. Rows that repeat are judged
each on its own; nothing meets across documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words of whole documents named at once, candidates extended at once.
BATCH_WORDS = 200_000
BLOCK = 1_000_000


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Names of all 2^k words from each position, for k = 0, 1, …, as long as any name occurs twice.

    A name that occurs once, as one beyond the end, is negative and no other position's.
    """
    n = len(words)
    own = -np.arange(1, n + 2, dtype=np.int32)
    levels, alive, pairs = [], np.arange(n), np.asarray(words, np.int64)
    while len(alive):
        _, inverse, count = np.unique(pairs, return_inverse=True, return_counts=True)
        repeated = count[inverse] > 1
        alive = alive[repeated]
        if not len(alive):
            break
        level = own.copy()
        level[alive] = inverse[repeated]
        levels.append(level)
        step = 1 << (len(levels) - 1)
        alive = alive[alive + 2 * step <= n]
        # A pair whose second half is its position's own is not repeated either.
        alive = alive[level[alive + step] >= 0]
        pairs = level[alive].astype(np.int64) * (n + 1) + level[alive + step]
    return levels


def _extended(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree before and from the positions ``left`` < ``right``."""
    n = len(levels[0]) - 1
    i, j = left.copy(), right.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i += step
        j = np.minimum(j + step, n)
    after = i - left
    i, j = left.copy(), right.copy()
    for k in range(len(levels) - 1, -1, -1):
        far = 1 << k
        step = ((i >= far) & (levels[k][np.maximum(i - far, 0)] == levels[k][j - np.minimum(i, far)])).astype(np.int64) << k
        i -= step
        j -= step
    return left - i, after


def _grid(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """All (g, q), q from first to last and g a multiple of q with three periods after it."""
    periods = np.arange(first, last + 1, dtype=np.int64)
    counts = np.maximum(n // periods - 2, 0)
    q = np.repeat(periods, counts)
    at = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
    return at * q, q


def find_runs(words: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs among ``words``, by start, then period; none is above ``longest`` words."""
    n, levels = len(words), name_levels(words)
    found = [np.empty((0, 3), np.int64)]
    # Two periods are a repeated stretch; of the 2^levels words from a position none is.
    most = min((n if longest is None else longest) // LEAST_PERIODS, ((1 << len(levels)) - 1) // 2)
    first = 1
    while first <= most:
        last = min(most, first + max(0, BLOCK // (n // first + 1) - 1))
        left, q = _grid(n, first, last)
        wanted = np.frexp(2.0 * q)[1] - 1
        keep = np.zeros(len(q), bool)
        for k in np.unique(wanted):
            of = np.flatnonzero(wanted == k)
            keep[of] = levels[k][left[of]] == levels[k][left[of] + q[of]]
        left, q = left[keep], q[keep]
        before, after = _extended(levels, left, left + q)
        length = before + after + q
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        if long.any():
            found.append(np.unique(np.stack([(left - before)[long], length[long], q[long]], 1), axis=0))
        first = last + 1
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)  # of one stretch the smallest period
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def repeated_tail(words: list, doc_id) -> list:
    """``words`` of a document drawn by its id with its tail replaced by repetitions of a part of it."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _best(length: list[int], period: list[int]) -> int:
    """The first run of the greatest exact length / period."""
    best = 0
    for k in range(1, len(length)):
        if length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def _rows(docs: list[list[bytes]]) -> Iterator[tuple]:
    """For each document its runs, (start, length, period) lists, and its words without repetitions."""
    codes, begins = [], [0]
    for words in docs:
        own: dict[bytes, int] = {}
        base = begins[-1]
        codes.extend([own.setdefault(w, base + len(own)) for w in words])
        begins.append(base + len(words))
    start, length, period = find_runs(np.array(codes, np.int64), max(map(len, docs), default=0))
    change = np.zeros(begins[-1] + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    cuts = np.searchsorted(start, begins)
    for d, words in enumerate(docs):
        a, b = begins[d], begins[d + 1]
        s, e = cuts[d], cuts[d + 1]
        left = words if s == e else [words[i] for i in np.flatnonzero(kept[a:b]).tolist()]
        yield (start[s:e] - a).tolist(), length[s:e].tolist(), period[s:e].tolist(), b" ".join(left).decode()


def _run_batches(tail: bool, schema: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts, ids = batch.columns
            begin = size = 0
            docs: list[list[bytes]] = []
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                docs.append(repeated_tail(words, ids[i].as_py()) if tail else words)
                size += len(words)
                if size >= BATCH_WORDS or i + 1 == batch.num_rows:
                    found, tops, collapsed = [], [], []
                    for start, length, period, left in _rows(docs):
                        own = [{"start": s, "length": n, "period": q} for s, n, q in zip(start, length, period, strict=True)]
                        found.append(own)
                        tops.append(own[_best(length, period)] if own else None)
                        collapsed.append(left)
                    made = zip((found, tops, collapsed), list(schema)[-3:], strict=True)
                    columns = [c.slice(begin, i + 1 - begin) for c in kept] + [pa.array(c, f.type) for c, f in made]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                    begin, size, docs = i + 1, 0, []

    return run


_RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), tail: bool = False) -> DataFrame:
    """``keep`` columns with ``runs``, ``top`` (the run with most periods, null for none) and ``collapsed`` (words, repetitions left out).

    ``tail`` first puts repetitions into the documents that ``repeated_tail`` draws.
    """
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("text of words"), docs[doc_id].cast("string").alias("number of text"))
    schema = T.StructType(rows.schema.fields[:-2]).add("runs", T.ArrayType(_RUN)).add("top", _RUN).add("collapsed", "string")
    return rows.mapInArrow(_run_batches(tail, to_arrow_schema(schema)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, after the drawn ones got a repeating tail."""
    rows = runs(common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text"), tail=True)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
