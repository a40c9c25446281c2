"""JSON and page payloads as typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, web
from ..sources import html

_SUB = "array<struct<furigana:string,surface:string>>"
_WORD = f"array<struct<surface:string,furigana:string,subword:{_SUB}>>"

#: Endpoint -> (field of the record, target key, fetched for every site).
DETAILS = {
    "basicinfob": ("base", "", True),
    "basicinfosc": ("subcorpus", "subcorpus", False),
    "basicinfosj": ("shojikei", "shojikei", True),
    "basicinfoss": ("subcorpus_shojikei", "subcorpus", False),
    "basicinfoky": ("katuyokei", "katuyokei", False),
    "basicinfojs": ("setuzoku", "setuzoku", True),
    "patternfreqorder": ("patternfreqorder", "rows", True),
}


def furigana_words(body: Column) -> Column:
    """Words of a furigana service's JSON answer; null if they are missing or a word lacks a key.

    A word's reading defaults to its surface, unless it has subwords.
    """
    words = F.try_variant_get(F.try_parse_json(body), "$.result.word", "array<variant>")

    def word(w: Column) -> Column:
        sub = F.try_variant_get(w, "$.subword", _SUB)
        surface, reading = (F.try_variant_get(w, f"$.{k}", "string") for k in ("surface", "furigana"))
        return F.struct(
            surface.alias("surface"),
            F.when(sub.isNull(), F.coalesce(reading, surface)).otherwise(reading).alias("furigana"),
            F.coalesce(sub, F.array().cast(_SUB)).alias("subword"),
        )

    out = F.transform(words, word)
    broken = F.exists(
        out,
        lambda w: w["surface"].isNull()
        | w["furigana"].isNull()
        | F.exists(w["subword"], lambda s: s["furigana"].isNull() | s["surface"].isNull()),
    )
    return F.when(~broken, out).cast(_WORD)


def morae(page: Column) -> Column:
    """All morae of an accent page in order; null if the page breaks."""
    return F.transform(
        F.flatten(F.transform(html.phrases(page), lambda p: p["morae"])),
        lambda m: F.struct(m["text"].alias("text"), text.accent_of_classes(m["classes"]).alias("accent")),
    )


def paragraph(phrases: Column) -> Column:
    """The surfaces of an accent page's phrases, one after the other."""
    return F.array_join(F.transform(phrases, lambda p: p["surface"]), "")


def sentences(blocks: Column, entry_id: Column) -> Column:
    """(jp, en) of the example sentences of a page whose block (``html.example_blocks``) mentions the
    entry; a pair without a second part has a null ``en``. The mention is a substring, so an id also
    meets longer ids it begins."""
    blocks = F.filter(
        blocks,
        lambda b: F.exists(b["comments"], lambda c: F.contains(c, F.concat(F.lit("ent_seq="), entry_id.cast("string")))),
    )

    def pair(line: Column) -> Column:
        parts = text.split_pair(text.strip_ordinal(line))
        return F.struct(
            text.strip(F.replace(F.get(parts, F.lit(0)), F.lit(" "), F.lit(""))).alias("jp"),
            text.strip(F.get(parts, F.lit(1))).alias("en"),
        )

    return F.transform(F.flatten(F.transform(blocks, lambda b: b["lines"])), pair)


def is_list_of_objects(field: Column) -> Column:
    """Whether JSON text is a list of objects and nothing else."""
    items = F.try_variant_get(F.try_parse_json(field), "$", "array<variant>")
    return F.coalesce(F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(False))


def details(payloads: DataFrame) -> DataFrame:
    """(site, headword_id, and a JSON column for each field) from payloads (…, endpoint, body).

    One row per headword: the seven payloads become columns in one aggregation. Fields that a site
    does not have are empty lists.
    """
    columns = []
    for endpoint, (field, target, everywhere) in DETAILS.items():
        document = F.try_parse_json(F.when(F.col("endpoint") == endpoint, F.col("body")))
        own = F.to_json(web.target_or_whole(document, target) if target else document)
        value = F.max(own)
        columns.append((F.when(F.col("site") == "NLT", F.lit("[]")).otherwise(value) if not everywhere else value).alias(field))
    return payloads.groupBy("site", "headword_id").agg(*columns)


def entries(requests: DataFrame, search_pages: DataFrame, entry_pages: DataFrame) -> DataFrame:
    """(request_id, pos, entry_id, entry, missing): dictionary entries of each request in order."""
    return searched_entries(requests, search_pages, entry_pages).where("pos IS NOT NULL").drop("unread")


def searched_entries(requests: DataFrame, search_pages: DataFrame, entry_pages: DataFrame) -> DataFrame:
    """``entries`` with ``unread``; a search without any has one row, with a null ``pos``, which is unread if its page breaks.

    An entry page that was not captured, or not got, is missing, as one that cannot be read.

    A search that was redirected names its entry in the address; others list theirs on the page.
    """
    found = requests.join(search_pages, "request_id").select(
        "request_id",
        F.when(
            F.contains("final_url", F.lit("entr.py")),
            F.filter(F.array(web.query_param(F.col("final_url"), "e")), lambda x: x.isNotNull()),
        )
        .otherwise(html.entry_ids(F.col("html")))
        .alias("ids"),
    )
    listed = found.select("request_id", F.col("ids").isNull().alias("unread"), F.posexplode_outer("ids").alias("pos", "entry_id"))
    got = F.when(F.col("transport_error").isNull(), F.col("html"))
    pages = entry_pages.select("entry_id", html.entry(got).alias("entry"), F.lit(True).alias("read"))
    return listed.join(pages, "entry_id", "left").withColumn("missing", F.col("read").isNull() | F.col("entry").isNull()).drop("read")
