"""The seven services as plans over request and payload tables; each gives (request_id, envelope).

Every request gets an answer: without a captured payload it counts as one whose transport failed (status 500).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, web
from ..operators import align, envelope, records, search
from ..sources import html
from ..sources import requests as sources


def mark_furigana(requests: DataFrame, payload: DataFrame) -> DataFrame:
    rows = envelope.answered(requests, payload, "request_id").withColumn("words", records.furigana_words(F.col("body")))
    status = envelope.furigana_status(F.col("words"), F.try_parse_json("body").isNotNull())
    return envelope.enveloped(rows, status, F.col("words"))


def mark_accent(requests: DataFrame, payload: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests are normalised before they are sent, so ``payload`` belongs to ``text.normalise(text)``."""
    rows = envelope.answered(requests, payload, "request_id").withColumn("words", records.furigana_words(F.col("body")))
    rows = rows.withColumn("furigana_status", envelope.furigana_status(F.col("words"), F.try_parse_json("body").isNotNull()))
    page = pages.select(
        "request_id",
        (F.col("transport_error").isNotNull() | (F.col("http_status") != 200)).alias("page_failed"),
        records.morae(F.col("html")).alias("morae"),
    )
    rows = rows.join(page, "request_id", "left").withColumn("page_failed", F.coalesce("page_failed", F.lit(True)))
    status = envelope.accent_status(F.col("furigana_status"), F.col("words"), F.col("page_failed"), F.col("morae"))
    aligned = F.when(F.size("words") > 0, align.align(F.col("words"), F.col("morae")))
    return envelope.enveloped(rows, status, aligned)


def headwords(requests: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Searches the lexicon itself; a request whose hits are all invalid has an empty result."""
    found = search.search(requests, lexicon)
    hits = found.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_sort(F.collect_list(F.when(search.is_valid(), F.struct("row", *search.RESULT)))).alias("result"),
    )
    rows = requests.join(hits, "request_id", "left").withColumns(
        {"transport_error": F.lit(None).cast("string"), "http_status": F.lit(200)}
    )
    return envelope.enveloped(rows, envelope.usage_status(F.col("word"), F.lit(True), F.col("rows")), F.col("result"))


def headword_links(requests: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Headword search, projected to (word, url)."""
    found = headwords(requests, lexicon).join(requests.select("request_id", "site"), "request_id")
    urls = F.transform(
        "envelope.result",
        lambda r: F.struct(r["headword"].alias("word"), web.headword_url(F.col("site"), r["headword_id"]).alias("url")),
    )
    return found.select("request_id", F.struct("envelope.status", urls.alias("result"), "envelope.error").alias("envelope"))


def headword_details(requests: DataFrame, payloads: DataFrame) -> DataFrame:
    """Seven payloads per headword as one record; the first that failed decides the status.

    A request without a site or a headword id has no payloads and fails (500).
    """
    keys = ["site", "headword_id"]
    whole = [e for e, (_, target, _) in records.DETAILS.items() if not target]
    status = envelope.first_failure(requests, payloads, list(records.DETAILS), sources.detail_endpoints(), whole)
    rows = requests.join(status, keys, "left").join(records.details(payloads), keys, "left")
    status_of = F.coalesce("status", F.lit(500))
    fields = [f for f, _, _ in records.DETAILS.values()]
    shaped = F.coalesce(F.col("base").startswith("{"), F.lit(False))
    for field in fields[1:]:
        shaped = shaped & records.is_list_of_objects(F.col(field))
    final = F.when((status_of == 200) & ~shaped, 500).otherwise(status_of)
    return envelope.enveloped(rows, final, F.struct(*fields))


def dictionary(requests: DataFrame, search_pages: DataFrame, entry_pages: DataFrame) -> DataFrame:
    found = records.searched_entries(requests, search_pages, entry_pages)
    listed = F.col("pos").isNotNull()
    per = found.groupBy("request_id").agg(
        F.count("pos").alias("n"),
        F.bool_or("unread").alias("unread"),
        F.bool_or(listed & F.col("missing")).alias("broken"),
        F.transform(F.array_sort(F.collect_list(F.when(listed, F.struct("pos", "entry")))), lambda x: x["entry"]).alias("result"),
    )
    failed = search_pages.select("request_id", F.col("transport_error").isNotNull().alias("failed"))
    rows = requests.join(failed, "request_id", "left").join(per, "request_id", "left")
    rows = rows.withColumn("failed", F.coalesce("failed", F.lit(True)) | F.coalesce("unread", F.lit(False)))
    return envelope.enveloped(rows, envelope.dictionary_status(F.col("failed"), F.col("n"), F.col("broken")), F.col("result"))


def example_sentences(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Errors of this service are plain strings."""
    rows = envelope.answered(requests, pages, "request_id").withColumn("blocks", html.example_blocks(F.col("html")))
    rows = rows.withColumn("pairs", records.sentences(F.col("blocks"), F.col("id")))
    unread = F.col("transport_error").isNotNull() | F.col("blocks").isNull()
    status = envelope.sentence_status(unread, F.col("pairs"))
    result = F.struct("word", "id", F.col("pairs").alias("sentence"))
    return envelope.enveloped(rows, status, result, plain_error=True)


def normalised_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("text", text.normalise(F.col("text")))
