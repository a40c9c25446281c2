"""N-gram Jaccard join with Bayesian candidate pruning (op7).

Documents are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

* Documents with the same words are one class, met once and counted with its size.
* Each class has ``BANDS * ROWS`` MinHash values. Classes that agree in one band of ``ROWS`` values at least are
  candidates: at similarity 0.8 all but one pair in ten million are.
* Candidates are compared in groups. A class's leader is the least class it shares a bucket with; leader groups
  of more than ``GROUP_ROWS`` classes or ``GROUP_SHINGLES`` shingles are cut into chunks, and each pair of chunks that share a bucket
  is a task's work of its own. So no bucket is gathered whole and no pair is lost.
* Within a group, candidates compare their MinHash values ``STEP`` at a time. With a uniform prior, m
  equal values of n give the posterior Beta(m + 1, n - m + 1); a pair whose probability of
  reaching the threshold is below ``TOLERANCE`` is dropped. What a group hands on is which of its classes still have
  partners, never the pairs: n near copies make a row for each class and chunk that it meets.
* The rest is verified on whole shingle sets: the texts of the classes that still have partners are read again and,
  grouped as before, the same pruning finds the pairs again, whose sets are intersected at once, up to 256 classes at a time.
  Shingles are compared by hashes of 64 bits. The links are counted, and each group's links are reduced to a forest for
  the components.

Defined results: a null text, or one without a letter or digit, has no shingles and links with
nothing; a text of one to four words is one shingle of all its words; rows with equal ids are
documents of their own, a component is named by its smallest id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 4
STEP = 20
TOLERANCE = 1e-5
GROUP_ROWS = 300
GROUP_SHINGLES = 1 << 19
SEED = 11

_rng = np.random.default_rng(SEED)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_NO_ID = -(1 << 63)


def signatures(norm: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash values as uint16, number of shingles, repeated ones included), a row per text."""
    least = np.full((len(norm), BANDS * ROWS), np.iinfo(np.uint64).max, dtype=np.uint64)
    number = np.zeros(len(norm), dtype=np.int64)
    with np.errstate(over="ignore"):
        for of, own, _, _ in shingles.hashed_shingles(norm, WIDTH):
            if not len(of):
                continue
            edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            docs = of[edges]
            number[docs] += np.diff(np.append(edges, len(of)))
            part = np.empty((len(edges), BANDS * ROWS), dtype=np.uint64)
            for p in range(BANDS * ROWS):
                part[:, p] = np.minimum.reduceat(own * _MULTIPLIERS[p] + _ADDENDS[p], edges)
            least[docs] = np.minimum(least[docs], part)
        return (shingles.mix(least) >> np.uint64(48)).astype(np.uint16), number


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 2_000):
            part = batch.slice(k, 2_000)
            values, number = signatures(part.column(2).cast(pa.large_string()))
            packed = [row.tobytes() if n else None for row, n in zip(values, number, strict=True)]
            columns = [part.column(0), part.column(1), pa.array(packed, pa.binary()), pa.array(number)]
            yield pa.record_batch(columns, names=["doc_id", "digest", "sig", "shingles"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), BANDS * ROWS)


def _bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    return np.ascontiguousarray(values).view(np.uint64).reshape(len(values), BANDS)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        with np.errstate(over="ignore"):
            keys = shingles.mix(_bands(_matrix(pa.chunked_array([batch.column(1)]))) ^ number)
        of = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(of)], names=["bucket", "key"])


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """n compared values -> matches below which P(similarity >= threshold) is under ``tolerance``.

    The tail of Beta(m + 1, n - m + 1) above t is the chance of at most m successes in n + 1 trials.
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _candidates(
    values: np.ndarray, first: np.ndarray, within: bool, needed: dict[int, int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``values`` that share a band and may reach the threshold, 256 left rows at a time.

    Pairs are of a ``first`` row and another one, or ``within`` a chunk of any two rows, once.
    """
    bands = _bands(values)
    rows = np.arange(len(values)) if within else np.flatnonzero(first)
    others = np.arange(len(values)) if within else np.flatnonzero(~first)
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        shared = np.zeros((len(part), len(others)), dtype=bool)
        for b in range(BANDS):
            shared |= bands[part, b][:, None] == bands[others, b][None, :]
        i, j = np.nonzero(shared)
        i, j = part[i], others[j]
        if within:
            i, j = i[i < j], j[i < j]
        same = np.zeros(len(i), dtype=np.int32)
        for n in range(0, BANDS * ROWS, STEP):
            same += (values[i, n : n + STEP] == values[j, n : n + STEP]).sum(axis=1, dtype=np.int32)
            let = same >= needed[n + STEP]
            i, j, same = i[let], j[let], same[let]
        yield i, j


def _prune(threshold: float, tolerance: float):
    """The classes of a group that have a partner whose similarity may still reach the threshold."""
    needed = least_matches(threshold, tolerance)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        first = table.column("gid").to_numpy() == low
        active = np.zeros(len(first), dtype=bool)
        for i, j in _candidates(_matrix(table.column("sig")), first, low == high, needed):
            active[i] = active[j] = True
        n = int(active.sum())
        return pa.table(
            {
                "low": pa.array(np.full(n, low, dtype=np.int64)),
                "high": pa.array(np.full(n, high, dtype=np.int64)),
                "key": pa.array(table.column("key").to_numpy()[active]),
                "first": pa.array(first[active]),
            }
        )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, norm) -> (key, sorted different shingle hashes as bytes)."""
    for batch in batches:
        for k in range(0, len(batch), 500):
            part = batch.slice(k, 500)
            own: list[list[np.ndarray]] = [[] for _ in range(len(part))]
            for of, hashes, _, _ in shingles.hashed_shingles(part.column(1).cast(pa.large_string()), WIDTH):
                edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
                for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
                    own[of[a]].append(hashes[a:b])
            packed = [np.unique(np.concatenate(x)).tobytes() if x else b"" for x in own]
            yield pa.record_batch([part.column(0), pa.array(packed, pa.large_binary()).cast(pa.binary())], names=["key", "shingles"])


def _verify(threshold: float, tolerance: float):
    """A group's exact links: by class the number of linked documents and a root of its forest."""
    needed = least_matches(threshold, tolerance)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("key").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        once = np.concatenate(([True], ids[1:] != ids[:-1]))  # a text read twice counts once
        order, ids = order[once], ids[once]
        sizes = table.column("size").to_numpy()[order]
        first = table.column("first").to_numpy(zero_copy_only=False)[order]
        signed = _matrix(table.column("sig"))[order]
        packed = table.column("shingles")
        sets = [np.frombuffer(packed[int(k)].as_py(), dtype=np.uint64) for k in order]
        lengths = np.array([len(x) for x in sets], dtype=np.int64)
        values, own = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        links = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        mark = np.zeros(len(values) + 1, dtype=np.int32)

        def meet(u: int, at: np.ndarray) -> None:
            mine = own[starts[u] : ends[u]]
            mark[mine] = 1
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                edges = np.concatenate(([0], np.cumsum(lengths[part])))
                joined = np.concatenate([own[starts[v] : ends[v]] for v in part])
                both = np.add.reduceat(mark[joined], edges[:-1])
                hit = part[both >= threshold * (lengths[part] + lengths[u] - both) - 1e-9]
                links[u] += sizes[hit].sum()
                links[hit] += sizes[u]
                for v in hit:
                    a, b = find(u), find(int(v))
                    root[max(a, b)] = min(a, b)
            mark[mine] = 0

        for i, j in _candidates(signed, first, key[0].as_py() == key[1].as_py(), needed):
            # Similar sets are of similar size; the others cannot reach the threshold.
            near = np.minimum(lengths[i], lengths[j]) >= np.maximum(threshold * np.maximum(lengths[i], lengths[j]) - 1e-9, 1)
            i, j = i[near], j[near]
            if not len(i):
                continue
            # Pairs come ordered by their left row.
            left, begin = np.unique(i, return_index=True)
            for u, start, end in zip(left, begin, np.append(begin[1:], len(i)), strict=True):
                meet(int(u), j[start:end])
        roots = np.array([find(k) for k in range(len(ids))], dtype=np.int64)
        let = links > 0
        return pa.table(
            {"key": pa.array(ids[let]), "links": pa.array(links[let]), "root": pa.array(ids[roots][let])}
        )

    return run


def jaccard_links(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(doc_id, class_id, n_links, component_id), one row per document.

    ``class_id`` is the smallest id with the same words, ``n_links`` the number of other documents
    linked directly (copies included), ``component_id`` the smallest id reachable.
    """
    norm = common.normalised(docs[text])
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), norm.alias("norm"))
    signed = rows.select("doc_id", F.md5("norm").alias("digest"), "norm").mapInArrow(
        _sign, "doc_id long, digest string, sig binary, shingles long"
    )
    signed = common.staged(signed, "jaccard-signatures")
    classes = signed.where("sig IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles")
    )
    classes = common.staged(classes.withColumn("key", F.monotonically_increasing_id()), "jaccard-classes")

    banded = classes.select("key", "sig").select("key", "sig").mapInArrow(_buckets, "bucket long, key long")
    shared = (
        banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("leader")).where("n > 1")
    )
    members = common.staged(banded.join(shared.select("bucket", "leader"), "bucket"), "jaccard-buckets")
    led = members.groupBy("key").agg(F.min("leader").alias("leader"))
    chunks = led.join(classes.select("key", "shingles"), "key").groupBy("leader").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_ROWS, F.sum("shingles") / GROUP_SHINGLES)).alias("chunks")
    )
    groups = led.join(chunks, "leader").select(
        "key", F.xxhash64("leader", F.pmod(F.xxhash64("key"), F.col("chunks"))).alias("gid")
    )
    groups = common.staged(groups, "jaccard-groups")
    of_bucket = members.select("bucket", "key").join(groups, "key").select("bucket", "gid").distinct()
    met = (
        of_bucket.select("bucket", F.col("gid").alias("low"))
        .join(of_bucket.select("bucket", F.col("gid").alias("high")), "bucket")
        .where("low <= high")
        .select("low", "high")
        .distinct()
    )
    met = common.staged(met, "jaccard-group-pairs")
    held = classes.select("key", "sig").join(groups, "key")
    sides = held.join(met, F.col("gid") == F.col("low")).unionByName(
        held.join(met.where("low != high"), F.col("gid") == F.col("high"))
    )
    active = sides.groupBy("low", "high").applyInArrow(
        _prune(threshold, tolerance), "low long, high long, key long, first boolean"
    )
    active = common.staged(active, "jaccard-candidates")

    wanted = active.select("key").distinct().join(classes.select("key", "id", "digest"), "key")
    wanted = wanted.select("key", F.coalesce("id", F.lit(_NO_ID)).alias("id"), F.col("digest").alias("of"))
    texts = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(_NO_ID)).alias("id"), docs[text].alias("text"))
    again = texts.join(wanted, "id").select("key", "of", common.normalised(F.col("text")).alias("norm"))
    sets = again.where(F.md5("norm") == F.col("of")).select("key", "norm").mapInArrow(_sets, "key long, shingles binary")
    found = (
        active.join(classes.select("key", "size", "sig"), "key")
        .join(sets, "key")
        .groupBy("low", "high")
        .applyInArrow(_verify(threshold, tolerance), "key long, links long, root long")
    )
    found = common.staged(found, "jaccard-links")

    number = found.groupBy("key").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), "jaccard")
    by_class = classes.select("digest", "key", "id", "size").join(number, "key", "left")
    by_class = by_class.join(group.withColumnRenamed("id", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    least = by_class.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = by_class.join(least, "component").select(
        "digest",
        F.col("id").alias("class_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
    )
    alone = signed.where("sig IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")
    )
    linked = signed.where("sig IS NOT NULL").select("doc_id", "digest").join(by_class, "digest")
    return linked.select("doc_id", "class_id", "n_links", "component_id").unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and component of every document at a similarity of 0.8."""
    docs = common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    return jaccard_links(docs)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
  FROM documents),
w AS (SELECT doc_id, norm, string_split(norm, ' ') AS w FROM d WHERE norm <> ''),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.a, x.b
  FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id
        GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b
  WHERE x.both * 5 >= (na.n + nb.n - x.both) * 4),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM d
  UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
e AS (SELECT norm, min(doc_id) AS class_id FROM d WHERE norm <> '' GROUP BY norm)
SELECT d.doc_id, coalesce(e.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id
FROM d JOIN c ON c.id = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN e ON e.norm = d.norm
"""
