"""Benchmark decontamination by a least-hash prefix filter and exact containment (op6).

A benchmark item is short, a document may be long, so their Jaccard similarity says little; asked is
the containment |item and document| / |item| of word shingles, 0.8 or more.

* An item of n shingles has a sketch: the ``n - ceil(0.8 n) + 1`` with the least hash values. A
  document that contains 0.8 of the item misses at most ``n - ceil(0.8 n)`` shingles, so it holds
  one of the sketch at least: the search loses nothing.
* This one prefix filter over all items replaces a MinHash search partitioned by size: there are no
  partitions and no check of a document's size. The sketches together only drop documents; pairs
  come from joining the shingles left with those of all items. The filter is exact where MinHash
  estimates, and counting decides every pair, so its sketch excludes none that holds enough.
* Two bitmaps of 16 bits for each of the benchmark's shingles (``LEAST_BITS`` at least; ``MOST_BITS`` at most, beyond which they
  only let more through to the join) say which shingle hashes the items and their sketches have. Documents are read once; a document that holds nothing of a
  sketch is dropped in the scan, of the others the shingles that some item has leave it.
* Candidates are verified by counting the item's different shingles in the document exactly, as
  texts and not as hashes.

Items of fewer than five words are one shingle of all their words, looked for among the documents'
shingles of that many words. Defined results: null or wordless items and documents match nothing;
items with equal ids count as one item for each different text, documents with equal ids as one
document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, shingles

WIDTH = 5
THRESHOLD = 0.8
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 30


def bitmap_of(hashes: DataFrame, size: int) -> np.ndarray:
    """Which values ``hash mod size`` occur; no more rows reach the driver than there are shingles, nor than ``size``."""
    bits = hashes.select(F.col("hash").bitwiseAND(F.lit(size - 1)).alias("bit")).distinct()
    flags = np.zeros(size, dtype=np.uint8)
    flags[bits.toArrow().column("bit").to_numpy().astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little")


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def _emit(widths: tuple[int, ...], wanted: np.ndarray | None = None, sketch: np.ndarray | None = None):
    """Batches of (id, norm) -> (id, shingle, hash, width).

    With bitmaps, only shingles that an item has, and only of documents that hold one of a sketch. Rows with a third
    column, their own width, give shingles of that width alone.
    """

    def by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[int, ...]]]:
        for batch in batches:
            if batch.num_columns == 2:
                yield batch, widths
                continue
            for width in widths:
                yield batch.filter(pc.equal(batch.column(2), width)), (width,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, widths in by_width(batches):
            ids, norm = batch.column(0), batch.column(1).cast(pa.large_string())
            raw, _ = shingles.buffers(norm)
            kept: list[tuple[np.ndarray, ...]] = []
            candidate = np.zeros(len(norm), dtype=bool)
            for width in widths:
                for of, own, first, last in shingles.hashed_shingles(norm, width):
                    if wanted is not None:
                        let = _has(wanted, own)
                        of, own, first, last = of[let], own[let], first[let], last[let]
                        candidate[of[_has(sketch, own)]] = True
                    kept.append((of, own, first, last, np.full(len(of), width, np.int32)))
            for of, own, first, last, width in kept:
                if wanted is not None:
                    let = candidate[of]
                    of, own, first, last, width = of[let], own[let], first[let], last[let], width[let]
                for k in range(0, len(of), 20_000):
                    part = slice(k, k + 20_000)
                    texts = [raw[a:b].tobytes().decode() for a, b in zip(first[part], last[part], strict=True)]
                    columns = [
                        ids.take(pa.array(of[part].astype(np.int64))),
                        pa.array(texts, pa.string()),
                        pa.array(own[part].view(np.int64)),
                        pa.array(width[part]),
                    ]
                    yield pa.record_batch(columns, names=["id", "shingle", "hash", "width"])

    return run


def _shingled(rows: DataFrame, widths: tuple[int, ...], *bitmaps: np.ndarray) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_emit(widths, *bitmaps), f"id {kind}, shingle string, hash long, width int")


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, item_id, shingle, hash, width, n) of the different shingles of each different item.

    ``item`` tells apart different texts under one id; ``n`` counts its shingles.
    """
    rows = items.select("item_id", common.normalised(F.col("text")).alias("norm")).where("norm != ''").distinct()
    rows = rows.select(F.struct("item_id", F.md5("norm").alias("digest")).alias("id"), "norm")
    # Fewer words than a shingle has: one shingle of all of them, whose width is their number.
    rows = rows.withColumn("width", F.least(F.size(F.split("norm", " ")), F.lit(width)))
    out = _shingled(rows, tuple(range(1, width + 1))).distinct()
    counts = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return out.join(counts, "id").select(
        F.col("id.digest").alias("item"), F.col("id.item_id").alias("item_id"), "shingle", "hash", "width", "n"
    )


def with_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``items`` with ``need`` (shingles that make the threshold) and ``sketch`` (of its sketch or not).

    The length of a sketch depends on the number of the item's shingles alone.
    """
    need = F.ceil(F.col("n") * threshold - 1e-9).cast("long")
    rank = F.row_number().over(Window.partitionBy("item_id", "item").orderBy("hash", "shingle"))
    return items.withColumn("need", need).withColumn("sketch", rank <= F.col("n") - F.col("need") + 1)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    width: int = WIDTH,
) -> DataFrame:
    """(doc_id, item_id, containment) of every document that holds ``threshold`` of an item's shingles."""
    wanted = common.staged(with_sketches(item_shingles(items, width), threshold), "decontamination-items")
    widths = tuple(sorted(r["width"] for r in wanted.select("width").distinct().collect()))
    kind = docs.schema[doc_id].dataType.simpleString()
    if not widths:
        empty = f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, containment double"
        return docs.sparkSession.createDataFrame([], empty)
    rows = docs.select(docs[doc_id].alias("id"), common.normalised(docs[text]).alias("norm")).where("norm != ''")
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    found = _shingled(rows, widths, bitmap_of(wanted, size), bitmap_of(wanted.where("sketch"), size))
    found = found.select(F.col("id").alias("doc_id"), "shingle", "width").distinct()
    counted = (
        found.join(wanted, ["shingle", "width"])
        .groupBy("doc_id", "item_id", "item", "n", "need")
        .agg(F.count(F.lit(1)).alias("held"), F.max("sketch").alias("candidate"))
    )
    return (
        counted.where(F.col("candidate") & (F.col("held") >= F.col("need")))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.col("held") / F.col("n")).alias("containment"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a benchmark item's five-word shingles."""
    docs = common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    items = common.only(common.read(spark, sf_dir, "benchmark"), "item_id", "text")
    found = contained_items(docs, items)
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE w <> ['']),
ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN k ON len(w) >= k WHERE w <> [''])),
bs AS (
  SELECT DISTINCT item_id, w, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE w <> [''])),
n AS (SELECT item_id, w, count(*) AS n FROM bs GROUP BY item_id, w),
h AS (SELECT ds.doc_id, bs.item_id, bs.w, count(*) AS held FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k GROUP BY ALL)
SELECT h.doc_id, h.item_id, round(max(held / n), 6) AS containment
FROM h JOIN n ON h.item_id = n.item_id AND h.w = n.w
WHERE held >= ceil(n * 0.8 - 1e-9)
GROUP BY h.doc_id, h.item_id
"""
