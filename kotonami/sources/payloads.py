"""Tables of requests and captured payloads: schemas, readers, and a sink for answers."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "requests_text": "request_id bigint, text string",
    "requests_word": "request_id bigint, word string, site string, id int",
    "furigana_payload": "request_id bigint, transport_error string, http_status int, body string",
    "accent_payload": "request_id bigint, transport_error string, http_status int, html string",
    "search_payload": "request_id bigint, transport_error string, http_status int, body string",
    "detail_payload": "site string, headword_id string, endpoint string, transport_error string, http_status int, body string",
    "dict_search_page": "request_id bigint, transport_error string, final_url string, html string",
    "dict_entry_page": "entry_id string, transport_error string, html string",
    "sentence_page": "request_id bigint, transport_error string, html string",
}


def read(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A payload table below ``folder``, with its declared schema (JSON lines or Parquet)."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{folder}/{name}")


def stream(spark: SparkSession, folder: str, name: str, fmt: str = "json") -> DataFrame:
    """The same as a stream of the files that arrive in the folder."""
    return spark.readStream.schema(SCHEMAS[name]).format(fmt).load(f"{folder}/{name}")


def table(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """A payload table from literal rows."""
    return spark.createDataFrame(rows, SCHEMAS[name])


def _decoded(bodies: pa.Array, charsets: pa.Array) -> pa.Array:
    out = []
    for body, charset in zip(bodies.to_pylist(), charsets.to_pylist(), strict=True):
        try:
            codec = codecs.lookup(charset or "utf-8")
        except LookupError:
            codec = codecs.lookup("utf-8")
        out.append(None if body is None else codec.decode(body, "replace")[0])
    return pa.array(out, pa.string())


def decoded(body: Column, charset: Column) -> Column:
    """The text of a captured body (bytes) by the charset of its header; UTF-8 where none, or none known, is named.

    Bytes that do not fit become the replacement character. Spark's own decoder takes one charset for a
    whole column and few of them, so this is a function of an Arrow batch.
    """
    return F.arrow_udf(_decoded, "string")(body, charset)


def from_bytes(captured: DataFrame, text: str = "html", body: str = "body", charset: str = "charset") -> DataFrame:
    """A payload table from one with bodies as they came: ``text`` instead of ``body`` and ``charset``."""
    return captured.withColumn("decoded_text", decoded(F.col(body), F.col(charset))).drop(body, charset).withColumnRenamed("decoded_text", text)


def write_answers(answers: DataFrame, path: str) -> None:
    """Envelopes as JSON lines, one request a line."""
    answers.select("request_id", F.to_json("envelope", {"ignoreNullFields": "false"}).alias("answer")).write.json(path)
