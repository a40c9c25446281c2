"""Outgoing requests as columns: what a capture job sends to fill the payload tables.

Words are escaped in addresses and forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..operators import records, search

# The services' addresses.
FURIGANA = "https://jlp.yahooapis.jp/FuriganaService/V2/furigana"
ACCENT = "https://www.gavo.t.u-tokyo.ac.jp/ojad/phrasing/index"
DICTIONARY = "https://www.edrdg.org/jmwsgi/"
SENTENCES = "https://www.edrdg.org/cgi-bin/wwwjdic/wwwjdic?1E"

# The settings an accent request is sent with.
ACCENT_SETTINGS = {
    "curve": "advanced",
    "accent": "advanced",
    "accent_mark": "all",
    "estimation": "crf",
    "analyze": "true",
    "phrase_component": "invisible",
    "param": "invisible",
    "subscript": "visible",
    "jeita": "invisible",
}
#: Detail endpoints that are asked by POST.
POSTED = ("basicinfoss", "patternfreqorder")


def form(fields: dict[str, Column]) -> Column:
    """An URL-encoded form body."""
    return F.array_join(F.array(*[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v)) for k, v in fields.items()]), "&")


def furigana_body(text: Column) -> Column:
    params = F.struct(text.alias("q"), F.lit(1).alias("grade"))
    return F.to_json(
        F.struct(
            F.lit("1234-1").alias("id"),
            F.lit("2.0").alias("jsonrpc"),
            F.lit("jlp.furiganaservice.furigana").alias("method"),
            params.alias("params"),
        )
    )


def accent_body(text: Column) -> Column:
    fields = {"text": text} | {k: F.lit(v) for k, v in ACCENT_SETTINGS.items()}
    return form({f"data[Phrasing][{k}]": v for k, v in fields.items()})


def headword_url(site: Column) -> Column:
    return F.concat(web.site_url(site), F.lit("/headwordlist_all/"))


def headword_body(word: Column) -> Column:
    return form({"_search": F.lit("true"), "filters": search.rule_json(word)})


def dictionary_url(word: Column) -> Column:
    return F.concat(
        F.lit(f"{DICTIONARY}srchres.py?s1=1&y1=1&t1="), F.url_encode(word), F.lit("&src=1&search=Search&svc=jmdict")
    )


def entry_url(entry_id: Column) -> Column:
    return F.concat(F.lit(f"{DICTIONARY}entr.py?svc=jmdict&e="), entry_id)


def sentence_body(word: Column) -> Column:
    return form({"dsrchkey": word, "dicsel": F.lit("1")})


def detail_endpoints() -> Column:
    """The endpoints that a row's ``site`` has."""
    everywhere = [e for e, (_, _, all_sites) in records.DETAILS.items() if all_sites]
    return F.when(F.col("site") == "NLT", F.array(*map(F.lit, everywhere))).otherwise(F.array(*map(F.lit, records.DETAILS)))


def detail_requests(headwords: DataFrame) -> DataFrame:
    """(site, headword_id, endpoint, method, url) of every detail that a site has, from (site, headword_id)."""
    each = headwords.select("site", "headword_id", F.explode(detail_endpoints()).alias("endpoint"))
    return each.select(
        "*",
        F.when(F.col("endpoint").isin(*POSTED), "POST").otherwise("GET").alias("method"),
        F.concat(web.site_url(F.col("site")), F.lit("/"), F.col("endpoint"), F.lit("/"), F.col("headword_id"), F.lit("/")).alias("url"),
    )
