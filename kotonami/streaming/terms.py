"""Headword search over a stream of terms: the lexicon's key table is static, nothing is kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text, web
from ..operators import search


def headword_urls(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Like the batch search, for a streaming ``terms``: every micro-batch joins the static keys."""
    asked = terms.select(
        "request_id", "site", text.text_type(F.col("word")).alias("kind"), search.search_key(F.col("word")).alias("key")
    )
    found = asked.join(search.suffix_keys(lexicon), ["kind", "key"]).join(lexicon, "row").where(search.is_valid())
    return found.select(
        "request_id", "row", F.col("headword").alias("word"), web.headword_url(F.col("site"), F.col("headword_id")).alias("url")
    )


def write_each_once(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch without the rows that two rules found twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["request_id", "row"]).drop("row").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
