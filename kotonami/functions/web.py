"""URL and JSON functions, and the regular patterns of web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base address of each corpus site.
SITES = {"NLB": "https://nlb.ninjal.ac.jp", "NLT": "https://tsukubawebcorpus.jp"}


def site_url(site: Column) -> Column:
    """Base address of a site; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in SITES.items() for x in pair]), site)


def headword_url(site: Column, headword_id: Column) -> Column:
    return F.concat(site_url(site), F.lit("/headword/"), headword_id, F.lit("/"))


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; null if there is none or it is empty."""
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(rf"\A{name}=."))
    value = F.regexp_replace(F.get(pairs, F.lit(0)), rf"\A{name}=", "")
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%20")))


#: An anchor up to its address: quoted values, and other characters before the end, the address or the next anchor.
_LINK = r'(?i)<a\s(?:"[^"]*+"|(?!\bhref\s*+=\s*+"|<a\s)[^>"])*+\bhref\s*+=\s*+"([^"]*+)"'


def links(html: Column) -> Column:
    """Addresses of all anchors, in order, whatever attributes come first; a pattern, for pages whose values stand in double quotes.

    Its repetitions are possessive, so long tags need no stack, and a search ends where the next tag begins, so it is linear.
    """
    return F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))


def comments(html: Column) -> Column:
    """Bodies of all comments, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))


def truthy(value: Column, path: str) -> Column:
    """Whether a JSON field is present and neither null, "", 0, false, nor an empty array or object."""
    text, kind = F.try_variant_get(value, path, "string"), F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    number = kind.isin("BIGINT", "INT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(
        F.when(kind == "STRING", text != "")
        .when(number, F.try_variant_get(value, path, "double") != 0)
        .when(kind == "BOOLEAN", F.try_variant_get(value, path, "boolean"))
        .when(kind == "VOID", False)
        .otherwise(text.isNull() | ~text.isin("[]", "{}")),
        F.lit(False),
    )


def target_or_whole(document: Column, target: str) -> Column:
    """Field ``target`` of a JSON document, or the whole document where it is missing or null."""
    own = F.try_variant_get(document, f"$.{target}", "variant")
    return F.when(own.isNull() | F.is_variant_null(own), document).otherwise(own)
