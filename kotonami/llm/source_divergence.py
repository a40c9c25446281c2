r"""How the sources of a language differ in their terms, by wide term vectors (op12).

Terms are counted within each task, so that of a frequent term or a hot source only one row for each step and group
is shuffled. Per language and kept term the counts are pivoted into one array, indexed by the
language's sources; the arrays become smoothed probabilities (parts of 10^9, in decimal integers), and higher-order functions
emit what the term adds to each pair of sources, which map-side aggregation sums.

Values are exact: counts are long, products decimal. A null text, lang or source counts as ''. Groups without terms
are vectors of zeros; a language without a kept term has pairs of value 0 and no terms. Repeated rows count each.
The result has a row for every ordered pair of a language's sources, so it is square in these by its contract;
the arrays are as long as a language has sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_DOCS = 30
SCALE = 1_000_000_000
SMOOTHING = 5
TOP_TERMS = 50
#: Distinct terms of a task's groups after which their counts are handed on.
STEP_TERMS = 500_000
#: A document in a term's count, above its occurrences between two steps.
_DOC = 1 << 40
#: ASCII letters lower-cased, all other ASCII as space, bytes of other characters as they are.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_BYTES).split()


def _count_batches(batches) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], dict[bytes, int]] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            own = counts.setdefault((lang, source), {})
            before, get = len(own), own.get
            for term, n in Counter(terms_of(text)).items():
                own[term] = get(term, 0) + n + _DOC
            held += len(own) - before
            if held >= STEP_TERMS:
                yield from _counted(counts)
                counts, held = {}, 0
    yield from _counted(counts)


def _counted(counts: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in counts.items():
        columns = [pa.repeat(lang, len(own)), pa.repeat(source, len(own)), pa.array(list(own), pa.binary()).cast(pa.string())]
        columns += [pa.array([x % _DOC for x in own.values()], pa.int64()), pa.array([x // _DOC for x in own.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    rows = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), in integers."""
    above = (count + SMOOTHING).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = total + SMOOTHING * kept
    return F.call_function("div", above, below.cast("decimal(28,0)")) + 1


def vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, wide): (lang, sources) of each language, and for each kept term (lang, term, counts, p, q, sources).

    ``counts`` and ``p`` are indexed as ``sources``; ``q`` is the language's own share.
    """
    groups = docs.select(F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source")).distinct()
    groups = common.staged(groups.groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources")), "divergence-sources")
    by_term = term_counts(docs).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("own")
    )
    kept = by_term.where(F.col("docs") >= least_docs).drop("docs").join(groups, "lang")
    counts = F.transform("sources", lambda s: F.coalesce(F.element_at(F.col("own"), s), F.lit(0).cast("long")))
    kept = common.staged(kept.select("lang", "term", "n", counts.alias("counts"), "sources"), "divergence-counts")
    each = kept.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kept"))
    totals = each.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("totals"),
        F.sum("total").alias("all"),
        F.max("kept").alias("kept"),
    )
    shares = F.zip_with("counts", "totals", lambda c, t: _share(c, t, F.col("kept")))
    wide = kept.join(common.staged(totals, "divergence-totals"), "lang")
    return groups, wide.select("lang", "term", "counts", shares.alias("p"), _share(F.col("n"), F.col("all"), F.col("kept")).alias("q"), "sources")


def pair_values(groups: DataFrame, wide: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    size = F.size("p")
    first = F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>"))
    # One array of contributions for each source: with the sources after it.
    emitted = F.flatten(
        F.transform(
            first,
            lambda i: F.transform(
                F.sequence(i + 1, size - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.abs(F.get("p", i) - F.get("p", j)).alias("f"))
            ),
        )
    )
    summed = wide.select("lang", F.explode(emitted).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("value"))
    sides = groups.select("lang", F.posexplode("sources").alias("i", "source"), "sources")
    pairs = sides.select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i != j")
    mirrored = summed.unionByName(summed.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return pairs.join(mirrored, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def term_values(wide: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has and uses more than its language."""
    above = F.filter(
        F.transform("sources", lambda s, k: F.struct(s.alias("source"), F.get("counts", k).alias("n"), (F.get("p", k) - F.col("q")).alias("value"))),
        lambda x: (x["n"] > 0) & (x["value"] > 0),
    )
    return wide.select("lang", F.col("term").alias("item"), F.explode(above).alias("x")).select("lang", "x.source", "item", "x.value")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms that tell a source from its language."""
    groups, wide = vectors(docs, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(groups, wide).withColumn("rank", F.row_number().over(order))
    terms = term_values(wide).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.only(common.read(spark, sf_dir, "documents"), "lang", "source", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0)::HUGEINT AS n FROM g JOIN kept k ON k.lang = g.lang
    LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM c),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM kept),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
v AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM v)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
