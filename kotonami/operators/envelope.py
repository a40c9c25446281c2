"""Status envelopes: one row per request, the first condition that holds decides.

Statuses and codes follow the services' rules; texts of exceptions are not reproduced. What would
end a request with an uncaught error there is status 500 here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUT = "timeout"


def _chain(*cases: tuple[Column, Column | int]) -> Column:
    out = None
    for condition, value in cases:
        hit = F.coalesce(condition, F.lit(False))
        value = F.lit(value) if isinstance(value, int) else value
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(200)).cast("int")


def fetch_failed(on_timeout: int) -> list[tuple[Column, Column | int]]:
    """Transport errors and upstream statuses, in the order in which they are looked at."""
    return [
        (F.col("transport_error") == TIMEOUT, on_timeout),
        (F.col("transport_error").isNotNull(), 500),
        (F.col("http_status") != 200, F.col("http_status")),
    ]


def furigana_status(words: Column, readable: Column) -> Column:
    """Furigana marking: 408 on timeouts, 500 for what cannot be read, else 200."""
    return _chain(*fetch_failed(408), (~readable | words.isNull(), 500))


def usage_status(word: Column, readable: Column, rows: Column) -> Column:
    """Headword search: an empty word fails, timeouts are 504, no rows before validation are 404."""
    return _chain((F.coalesce(word, F.lit("")) == "", 500), *fetch_failed(504), (~readable, 500), (F.coalesce(rows, F.lit(0)) == 0, 404))


def accent_status(furigana: Column, words: Column, page_failed: Column, morae: Column) -> Column:
    """Accent marking: copies a furigana error; no tokens are a 200 without result; page errors are 500."""
    return _chain((furigana != 200, furigana), (F.size(words) == 0, 200), (page_failed | morae.isNull(), 500))


def dictionary_status(search_failed: Column, entries: Column, broken: Column) -> Column:
    """Dictionary lookup: no entries are 404, one unreadable entry fails the request."""
    return _chain((search_failed, 500), (F.coalesce(entries, F.lit(0)) == 0, 404), (broken, 500))


def sentence_status(failed: Column, pairs: Column) -> Column:
    """Example sentences: none are 404; a line without two parts fails the request."""
    return _chain(
        (failed, 500), (F.exists(pairs, lambda p: p["en"].isNull()), 500), (F.coalesce(F.size(pairs), F.lit(0)) <= 0, 404)
    )


#: What a request counts as whose payload was not captured.
UNANSWERED = "unanswered"


def answered(requests: DataFrame, payloads: DataFrame, *keys: str) -> DataFrame:
    """All ``requests`` with their payloads; one without a payload gets the transport error ``UNANSWERED``."""
    seen = payloads.withColumn("captured", F.lit(True))
    failed = F.when(F.col("captured").isNull(), UNANSWERED).otherwise(F.col("transport_error"))
    return requests.join(seen, list(keys), "left").withColumn("transport_error", failed).drop("captured")


def first_failure(headwords: DataFrame, payloads: DataFrame, order: list[str], of_site: Column, whole: list[str]) -> DataFrame:
    """(site, headword_id, status): the status of the first endpoint in ``order`` that failed, else 200.

    ``of_site`` gives the endpoints that a headword's site has; payloads of others are not looked at. One that was not
    captured failed, and so did a document that is no object, unless it is one of ``whole``, which are taken as they are.
    """
    place = F.array_position(F.array(*[F.lit(e) for e in order]), F.col("endpoint"))
    asked = headwords.select("site", "headword_id").distinct().select("*", F.explode(of_site).alias("endpoint"))
    rows = answered(asked, payloads, "site", "headword_id", "endpoint")
    document = F.try_parse_json("body")
    shapeless = ~F.col("endpoint").isin(whole) & ~F.schema_of_variant(document).startswith("OBJECT")
    own = _chain(*fetch_failed(504), (document.isNull() | shapeless, 500))
    failed = F.min(F.when(own != 200, F.struct(place.alias("place"), own.alias("status"))))
    return rows.groupBy("site", "headword_id").agg(F.coalesce(failed["status"], F.lit(200)).alias("status"))


def enveloped(rows: DataFrame, status: Column, result: Column, plain_error: bool = False) -> DataFrame:
    """``request_id`` with ``envelope``: status, result (null unless 200) and error."""
    kind = "string" if plain_error else "struct<code:int,message:string>"
    message = F.when(status == 404, "No results found").otherwise("Request failed")
    error = message if plain_error else F.struct(status.alias("code"), message.alias("message"))
    return rows.select(
        "request_id",
        F.struct(
            status.alias("status"), F.when(status == 200, result).alias("result"), F.when(status != 200, error).cast(kind).alias("error")
        ).alias("envelope"),
    )
