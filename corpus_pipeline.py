"""From documents to a training mix: language, near duplicates, benchmarks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet and reread as the
next one's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonami.llm import common, decontamination, jaccard_join, language_id, mixing, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the training rows; texts without letters and texts unlike those of every language go.

    Null texts have no letters. Rows with a null ``lang`` are judged as others, but nothing is learnt from them.
    """
    docs = common.only(docs, *COLUMNS)
    model, known = language_id.fit_both(language_id.training_rows(docs))
    if not model.languages:  # nothing to learn from: only texts without a letter are rejected
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return language_id.predict(docs, model, keep=COLUMNS, known=known).where("familiar").select(*COLUMNS)


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``row``: the id, or, where ids repeat or are missing, a number in the order of the ids, null last."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").take(1):
        ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        return common.staged(ordered.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    return docs.withColumn("row", F.col("doc_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    A component bears the number of its first row, so a row that bears another one goes: nothing is gathered by
    component. Documents without a word, null texts among them, are like no other and stay; of rows under one id each is a document.
    """
    rows = _told_apart(common.only(docs, *COLUMNS))
    links = jaccard_join.jaccard_links(rows, doc_id="row")
    dropped = links.where("doc_id != component_id").select(F.col("doc_id").alias("row"))
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's shingles.

    Null and empty texts hold nothing and stay; with an empty benchmark all stay. An item of fewer than five words
    is one shingle of all its words, so a document that holds it goes, too.
    """
    docs = common.only(docs, *COLUMNS)
    items = common.only(common.read(spark, sf_dir, "benchmark"), "item_id", "text")
    # By text, not by id: of documents under one id only those that hold an item go.
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.select(F.struct("doc_id", digest.alias("digest")).alias("of"), "text")
    found = decontamination.contained_items(marked, items, doc_id="of").select("doc_id").distinct()
    found = found.select(F.coalesce("doc_id.doc_id", F.lit(-1)).alias("id"), F.col("doc_id.digest").alias("held"))
    same = (F.coalesce(docs["doc_id"], F.lit(-1)) == found["id"]) & (digest == found["held"])
    return docs.join(found, same, "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found personal data replaced by its kind; n_chars follows the text. A null text stays null, with its n_chars."""
    out = pii.redacted(common.only(docs, *COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, in training order, with the words taken and their positions.

    Null and empty texts have no words to take and go; a null source is a source of its own.
    """
    rows = _told_apart(common.only(docs, *COLUMNS))
    placed = mixing.place(rows, keep=("row",)).where("taken > 0").drop("doc_id", "source")
    return mixing.in_order(rows.join(placed, "row")).select(*COLUMNS, "size", "source_size", "target", "taken", "positions")


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed),
]
#: The stages learn models and follow links to any depth; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage staged on its way, and the stage before it, is deleted when it is written.
    """
    docs, since = common.read(spark, sf_dir, "documents"), common.staged_folders()
    for name, stage in STAGES[:-1]:
        docs = common.finished(spark, lambda own=docs, stage=stage: stage(spark, own, sf_dir), f"pipeline-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)
