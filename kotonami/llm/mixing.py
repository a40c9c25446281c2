"""Mixing sources to target weights along a time-varying curriculum (op1).

Each source has a weight schedule over training time 0..1, linear between knots. The area under it
is the source's weight; the areas share all words of the corpus, but no source is repeated more than
``max_repeats`` times: what a capped source cannot take is shared again by weight among the others.

A source's cumulative demand at time t is its target times the share of its schedule's area that
lies before t. Its documents, in an order fixed by a digest of their ids, follow each other on that
demand curve, pass after pass; inverting the curve at the word where a document begins gives its
training position. Rows are range-partitioned and sorted by position.

The running word counts come from two levels (sums by source and digest bucket, then within
buckets), so a source that holds a third of all rows is not gathered in one task. Rows under one id share a bucket: ids are
taken to be mostly different. The table of
sources has one row for each source name and is the only thing that is ordered as a whole.

Defined results: null or empty texts have size 0, take nothing and have no position; a null source
is a source of its own, ordered last; repeated rows each count on their own; an empty table gives
no rows; a corpus without words has targets of 0. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: A word: a run of other characters than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Schedules of the classes of sources, in turn by source name: knots (time, weight). Their areas
#: are 5, 2 and 1; the heavy class is met early, the light class late.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
MAX_REPEATS = 3
#: Digest buckets for the running counts, as many as keep about this many rows in each.
ROWS_PER_BUCKET = 2_000

Schedule = tuple[tuple[float, float], ...]


def area(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))


def _inverse(schedule: Schedule, share: Column) -> Column:
    """The time at which ``share`` (0..1) of the schedule's area has passed."""
    want, passed, out = share * area(schedule), 0.0, None
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        own = (t1 - t0) * (w0 + w1) / 2
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(want - passed, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        step = F.when(rest <= 0, 0.0).otherwise(2 * rest / (F.lit(w0) + root))
        passed += own
        pieces.append((passed, F.least(F.lit(t0) + step, F.lit(t1))))
    for until, when in reversed(pieces):
        out = when if out is None else F.when(want <= until, when).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules: tuple[Schedule, ...], max_repeats: int) -> DataFrame:
    """``sizes`` (source, source_size) with class, target: the shares by area, none above its cap.

    Resharing the excess by weight until none is above ends where the sources with the least room
    for their weight take their cap and all others the same number of words for a unit of weight.
    """
    areas = F.array(*[F.lit(float(area(s))) for s in schedules])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = (
        sizes.withColumn("class", (F.row_number().over(by_name) - 1) % len(schedules))
        .withColumn("weight", F.element_at(areas, F.col("class") + 1))
        .withColumn("cap", F.col("source_size") * max_repeats)
    )
    room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        table.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn(
            "weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        )
        .withColumn("share", F.col("left") * F.col("weight") / F.col("weights"))
    )
    # Capped sources form a prefix of the order by room; the first uncapped one sets the level.
    capped = F.col("share") >= F.col("cap")
    first = F.min(F.when(~capped, F.struct(F.col("cap") / F.col("weight"), "left", "weights"))).over(whole)
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        "class",
        F.when(capped, F.col("cap").cast("double"))
        .otherwise(F.col("first.left") * F.col("weight") / F.col("first.weights"))
        .alias("target"),
    )


def in_order(placed: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted by the position of their first pass; those without come last."""
    first = F.get("positions", F.lit(0)).asc_nulls_last()
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, first, F.col("doc_id")).sortWithinPartitions(first, "doc_id")


def by_pass(placed: DataFrame) -> DataFrame:
    """A row for each pass of each document of ``placed``, with ``pass`` and ``position``, in training order."""
    each = placed.select("*", F.posexplode("positions").alias("pass", "position")).drop("positions")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("position", "doc_id", "pass")
    return each.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``place`` with its rows in training order."""
    return in_order(place(docs, **options))


def place(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = (),
    schedules: tuple[Schedule, ...] = SCHEDULES,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document. ``keep`` is carried through every shuffle, so keep it narrow.

    Columns: ``doc_id``, ``source``, those of ``keep``, ``size`` (words), ``source_size``,
    ``target`` (of its source), ``taken`` (words of it the mix takes, all passes together; the
    document on which a source's target falls is cut there) and ``positions``, the training
    positions of its passes.
    """
    words = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        docs[source].alias("source"),
        *[docs[c].alias(f"kept_{c}") for c in keep],
        words.alias("size"),
        F.md5(F.coalesce(docs[doc_id].cast("string"), F.lit(""))).alias("digest"),
    )
    rows = common.staged(rows, "mixing-sizes")
    buckets = max(1, rows.count() // ROWS_PER_BUCKET)
    bucket = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets / 2**32)
    rows = rows.withColumn("bucket", bucket)

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)))
    plan = targets(
        sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), schedules, max_repeats
    )
    sums = sums.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    sums = sums.select("s.source", "bucket", "bucket_start", "source_size", "class", "target")

    within = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size")
    rows = rows.withColumn(
        "inner", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    joined = rows.alias("r").join(
        sums.alias("s"),
        (F.col("r.bucket") == F.col("s.bucket")) & F.col("r.source").eqNullSafe(F.col("s.source")),
    )
    start, goal = F.col("bucket_start") + F.col("inner"), F.round("target").cast("long")
    passes = [start + n * F.col("source_size") for n in range(max_repeats)]
    taken = sum(
        (F.greatest(F.lit(0), F.least(F.col("size"), goal - at)) for at in passes[1:]),
        F.greatest(F.lit(0), F.least(F.col("size"), goal - passes[0])),
    )
    when = None
    for k, schedule in reversed(list(enumerate(schedules))):
        own = F.array(
            *[
                F.when((at < goal) & (F.col("size") > 0), F.round(_inverse(schedule, at / F.col("target")), 9))
                for at in passes
            ]
        )
        when = own if when is None else F.when(F.col("class") == k, own).otherwise(when)
    return joined.select(
        "doc_id",
        "r.source",
        *[F.col(f"kept_{c}").alias(c) for c in keep],
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.array_compact(when).alias("positions"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources weigh 5, 2, 1 in turn and repeat at most 3 times.

    With the number of its passes and the training positions of the first and the last one, in their order.
    """
    docs = common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.size("positions").cast("long").alias("passes"),
        F.get("positions", F.lit(0)).alias("first_position"),
        F.get("positions", F.size("positions") - 1).alias("last_position"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         [7.5, 2.0, 0.5][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w0,
         source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total
  FROM s),
l AS (
  SELECT *, total - coalesce(sum(cap) OVER before, 0)::BIGINT AS room,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0) AS weights
  FROM w
  WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, room * weight / weights >= cap AS capped FROM l),
f AS (SELECT room AS f_room, weights AS f_weights FROM c WHERE NOT capped
      ORDER BY cap / weight, source IS NULL, source LIMIT 1),
t AS (
  SELECT source, source_size, weight, w0,
         CASE WHEN capped THEN cap::DOUBLE ELSE f_room * weight / f_weights END AS target
  FROM c LEFT JOIN f ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, t.w0, 2 * (t.weight - t.w0) AS slope,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         round(t.target)::BIGINT AS goal
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (start < goal)::BIGINT + (start + source_size < goal)::BIGINT
            + (start + 2 * source_size < goal)::BIGINT END AS passes,
         start / target * weight AS first_area, (start + (passes - 1) * source_size) / target * weight AS last_area
  FROM r)
-- A schedule is w0 + slope * t: the time at which an area has passed solves a quadratic equation.
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size))
        + greatest(0, least(size, goal - start - 2 * source_size)))::BIGINT AS taken,
       passes,
       CASE WHEN passes > 0 THEN round(least(1.0, 2 * first_area / (w0 + sqrt(w0 * w0 + 2 * slope * first_area))), 9) END AS first_position,
       CASE WHEN passes > 0 THEN round(least(1.0, 2 * last_area / (w0 + sqrt(w0 * w0 + 2 * slope * last_area))), 9) END AS last_position
FROM p
"""
