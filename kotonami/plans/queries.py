"""The registered queries of the engine with equivalent SQL for an independent check.

Scripts that the driver's tables lack come from literal rows, and at scale from spelling Latin
letters as kana (``translate``), which both engines do alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, web
from ..operators import align, envelope, mentions, records, search
from ..sources import html, payloads, requests, tree
from ..sources.tree import Step
from . import endpoints, fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Latin letters and digits spelt as kana, one for one.
LATIN = "abcdefghijklmnopqrstuvwxyz0123456789"
KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも"
_SPELT = f"'{LATIN}', '{KANA}'"
_KATA = f"'{text.HIRAGANA}', '{text.KATAKANA}'"
_HIRA = f"'{text.KATAKANA}', '{text.HIRAGANA}'"
_TYPE = (
    "CASE WHEN {0} = '' THEN NULL WHEN regexp_full_match({0}, '[\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}]+') THEN 'yomi' "
    "WHEN regexp_full_match({0}, '[A-Za-z]+') THEN 'romaji' WHEN {0} IS NOT NULL THEN 'headword' END"
)
_NOT_KK = r"[^\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]|[\x{30A0}\x{30FB}-\x{30FF}]"
_NUMBER = r"-?\p{Nd}+(\.\p{Nd}+)?\n?"
_WS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = rf"regexp_replace({{0}}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def at(sql: str, value: str) -> str:
    """A SQL pattern with its place ``{0}`` filled."""
    return sql.replace("{0}", value)


def quoted(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    """Literal rows as a SQL table."""
    body = ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _of_words(name: str, rows: list[str | None], use: Callable[[Column], Column], sql: str) -> None:
    """A scalar function over literal texts."""
    pairs = list(enumerate(rows))
    register(name, f"SELECT id, {at(sql, 's')} AS value FROM {values(pairs, 'id', 's')}")(
        lambda spark, _: literal(spark, pairs, "id int, s string").select("id", use(F.col("s")).alias("value"))
    )


_WORDS = [
    "はしる", "ハシル", "走る", "hashiru", "Hashiru", "", None, "はしる1", "ﾊｼﾙ", "コーヒー", "゛", "・", "a b", "ab\n", "はしる\n",
    "１２", "𠮷野", "々", "naïve", "あA",
]
_of_words("text_type_literals", _WORDS, text.text_type, _TYPE)
_of_words("numeric_tokens", ["12", "-3.5", "１２３", "12\n", "12\r", "1.", ".5", "", None, "٣", "1,2", "--1", "十二", "7\n\n"], text.is_numeric, rf"regexp_full_match({{0}}, '{_NUMBER}')")
_of_words("ordinal_strip", ["(1) 先生です", "(12)\t　x", "1) x", "(a) x", "", None, "((1)) x", "(3)x"], text.strip_ordinal, rf"regexp_replace({{0}}, '\A\([0-9]+\){_WS}*', '')")
_of_words("unicode_strip", ["  a ", "　先生　", "\x1ca\x1f", "a b", "", None, " x ", "\n\t"], text.strip, _STRIP)
_of_words("gloss_clean", ["▶ to run", "run ▶ fast", "▶", "", None, " 　▶x▶ "], text.clean_gloss, at(_STRIP, "replace({0}, '▶', '')"))
_of_words(
    "int_or_zero", ["12", " 7 ", None, "x", "", "1387990", "99999999999", "１２", "٣٤", "1_000", "1__0", "+5", "-0", "1.0", "9223372036854775808", "9223372036854775807"], text.int_or_zero,
    f"CASE WHEN {{0}} IS NULL THEN 0 WHEN regexp_full_match(translate({_STRIP}, '０１２３４５６７８９٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '[+-]?[0-9]+(_[0-9]+)*') THEN try_cast(replace(translate({_STRIP}, '０１２３４５６７８９٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '_', '') AS BIGINT) END",
)
_of_words("script_class_chars", list("あアー・ヽ゠漢々ｱａA1、𠮷ゝヿ㐀鿿") + ["", None, "ああ"], text.is_kana_or_kanji, f"length({{0}}) = 1 AND NOT regexp_matches({{0}}, '{_NOT_KK}')")
_of_words("punct_membership", ["。", "——", "", None, "a", "!", "～", "、、、", "ー", "$", "....", "‵"], text.is_punctuation, "list_contains([" + ", ".join(map(quoted, dict.fromkeys(text.PUNCTUATION))) + "], {0})")


def _normalise_sql(value: str) -> str:
    """The normalisation as replacements one after the other."""
    out = f"translate(translate({value}, {quoted(text._WIDE.replace('～', ''))}, {quoted(text._NARROW.replace('~', ''))}), {quoted(text._HALF_KANA)}, {quoted(text._FULL_KANA)})"
    for marks, (plain, marked) in (("ﾞ゛", text._VOICED), ("ﾟ゜", text._HALF_VOICED)):
        for a, b in zip(plain, marked, strict=True):
            for mark in marks:
                out = f"replace({out}, {quoted(a + mark)}, {quoted(b)})"
    for these, one in (("˗֊‐‑‒–⁃⁻₋−", "-"), ("﹣－ｰ—―─━ー", "ー"), ("~∼∾〜〰～", "～")):
        first, *others = these
        out = f"regexp_replace(translate({out}, {quoted(''.join(others))}, {quoted(first * len(others))}), '{first}+', {quoted(one)}, 'g')"
    return at(_STRIP, out)


_of_words("normalise_literals", ["Ａｂｃ１２３", "ｶﾞｷﾞﾊﾟ", "らーーめん", "a‐b", "a-–b--", "～x~", "　空　", "ﾊﾞﾅﾅ", "ｳﾞｧ", "ｰ-ー", None, ""], text.normalise, _normalise_sql("{0}"))
#: Latin letters and digits spelt in what the normaliser folds.
_FOLDED = "ｶﾞｷﾟﾊﾎーｰ―‐−-～~〜Ａｚ１！　ヲﾜﾝ゛゜うウハヴ─–⁃"
_FOLD = f"'{LATIN[: len(_FOLDED)]}', '{_FOLDED}'"


@register("normalise_parts", f"SELECT p_partkey, {_normalise_sql(f'translate(lower(p_name), {_FOLD})')} AS normalised FROM part")
def normalise_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = F.translate(F.lower("p_name"), LATIN[: len(_FOLDED)], _FOLDED)
    return read(spark, sf_dir, "part").select("p_partkey", text.normalise(spelt).alias("normalised"))


_BODIES = [(1, "先生".encode(), None), (2, "先生".encode("euc_jp"), "euc-jp"), (3, "先生".encode("shift_jis"), "Shift_JIS"), (4, "é".encode("latin-1"), "iso-8859-1"), (5, b"a\xffb", None), (6, None, "utf-8"), (7, b"x", "no-such-charset"), (8, b"", "")]
_DECODED = [(1, "先生"), (2, "先生"), (3, "先生"), (4, "é"), (5, "a\ufffdb"), (6, None), (7, "x"), (8, "")]


@register("payload_charsets", f"SELECT id, html FROM {values(_DECODED, 'id', 'html')}")
def payload_charsets(spark: SparkSession, _: str) -> DataFrame:
    return payloads.from_bytes(literal(spark, _BODIES, "id int, body binary, charset string")).select("id", "html")


@register("text_type_tokens", f"SELECT type, count(*) AS n FROM (SELECT {at(_TYPE, 'w')} AS type FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY type")
def text_type_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(text.text_type(F.col("w")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@register("kana_fold_roundtrip", f"SELECT p_partkey, translate(k, {_KATA}) AS kata, translate(translate(k, {_KATA}), {_HIRA}) AS hira FROM (SELECT p_partkey, translate(lower(p_name), {_SPELT}) AS k FROM part)")
def kana_fold_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = read(spark, sf_dir, "part").select("p_partkey", F.translate(F.lower("p_name"), LATIN, KANA).alias("k"))
    kata = text.to_katakana(F.col("k"))
    return spelt.select("p_partkey", kata.alias("kata"), text.to_hiragana(kata).alias("hira"))


@register("numeric_words", rf"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '{_NUMBER}') GROUP BY ALL")
def numeric_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.where(text.is_numeric(F.col("w"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("latin_strip", "SELECT conv_id, turn, regexp_replace(text, '[A-Za-z]', '', 'g') AS stripped FROM conversations")
def latin_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_latin(F.col("text")).alias("stripped"))


_CLASSES = [(0, "accent_plain x"), (1, "accent_top"), (2, "mora"), (3, "x accent_top"), (4, None)]


@register("accent_class_map", f"SELECT id, CASE WHEN c IS NULL THEN NULL WHEN split_part(c, ' ', 1) = 'accent_plain' THEN 1 WHEN split_part(c, ' ', 1) = 'accent_top' THEN 2 ELSE 0 END AS accent FROM {values(_CLASSES, 'id', 'c')}")
def accent_class_map(spark: SparkSession, _: str) -> DataFrame:
    return literal(spark, _CLASSES, "id int, c string").select("id", text.accent_of_classes(F.split("c", " ")).alias("accent"))


_PAIRS = list(enumerate(["先生 だ\tHe is a teacher.", "a\t\tb\tc", "x  y  z", "alone", "", None, "　　x", "a \tb"]))


@register("pair_split", rf"""SELECT id, CASE WHEN p = '' THEN s ELSE substr(s, 1, instr(s, p) - 1) END AS jp,
    CASE WHEN p <> '' THEN substr(s, instr(s, p) + length(p)) END AS en
    FROM (SELECT id, s, regexp_extract(s, '\t+|{_WS}{{2,}}') AS p FROM {values(_PAIRS, 'id', 's')})""")
def pair_split(spark: SparkSession, _: str) -> DataFrame:
    parts = text.split_pair(F.col("s"))
    return literal(spark, _PAIRS, "id int, s string").select("id", F.get(parts, F.lit(0)).alias("jp"), F.get(parts, F.lit(1)).alias("en"))


_SHAPES = [(0, "0111"), (1, "20"), (2, "0120"), (3, "02"), (4, "2"), (5, "000"), (6, ""), (7, "0212")]


@register("accent_shape", f"""SELECT id, CASE WHEN instr(a, '2') = 1 THEN 'Atamadaka' WHEN instr(a, '2') > 1 AND instr(a, '2') = length(a) THEN 'Odaka'
    WHEN instr(a, '2') > 1 THEN 'Nakadaka' WHEN instr(a, '1') > 0 THEN 'Heiban' END AS shape FROM {values(_SHAPES, 'id', 'a')}""")
def accent_shape(spark: SparkSession, _: str) -> DataFrame:
    accents = F.transform(F.filter(F.split("a", ""), lambda x: x != ""), lambda x: x.cast("int"))
    return literal(spark, _SHAPES, "id int, a string").select("id", text.accent_shape(accents).alias("shape"))


# Search. The lexicon is the part table, its readings spelt as kana.
TERMS = [(1, "widget"), (2, "ふうしくおて"), (3, "フウシクオテ"), (4, "steel"), (5, ""), (6, None), (7, "t"), (8, "ぬ"), (9, "blue widget"), (10, "ー")]
_LEXICON = f"""(SELECT p_partkey AS id, p_brand || '-' || p_partkey AS headword_id, p_name AS headword,
    translate(translate(replace(lower(p_name), ' ', ''), {_SPELT}), {_KATA}) AS yomi1,
    translate(translate(split_part(lower(p_name), ' ', 2), {_SPELT}), {_KATA}) AS yomi2,
    translate(translate(split_part(lower(p_name), ' ', 1), {_SPELT}), {_KATA}) AS yomi3,
    split_part(lower(p_name), ' ', 1) AS romaji1, split_part(lower(p_name), ' ', 2) AS romaji2,
    CASE WHEN p_partkey % 10 <> 3 THEN replace(lower(p_name), ' ', '') END AS romaji3,
    translate(lower(p_name), {_SPELT}) AS yomi_display,
    CASE WHEN p_partkey % 7 <> 1 THEN lower(p_name) ELSE '' END AS romaji_display,
    p_size % 50 AS freq FROM part)"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    spelt = lambda c: text.to_katakana(F.translate(c, LATIN, KANA))
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    joined = F.replace(name, F.lit(" "), F.lit(""))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row"),
        F.col("p_partkey").alias("id"),
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("headword_id"),
        F.col("p_name").alias("headword"),
        spelt(joined).alias("yomi1"), spelt(second).alias("yomi2"), spelt(first).alias("yomi3"),
        first.alias("romaji1"), second.alias("romaji2"),
        F.when(F.col("p_partkey") % 10 != 3, joined).alias("romaji3"),
        F.translate(name, LATIN, KANA).alias("yomi_display"),
        F.when(F.col("p_partkey") % 7 != 1, name).otherwise("").alias("romaji_display"),
        (F.col("p_size") % 50).alias("freq"),
    )


_HITS = f"""(SELECT t.request_id, t.word, l.* FROM {values(TERMS, 'request_id', 'word')} t0
    JOIN LATERAL (SELECT t0.request_id, t0.word, {at(_TYPE, 't0.word')} AS kind, CASE WHEN {at(_TYPE, 't0.word')} = 'yomi' THEN translate(t0.word, {_KATA}) ELSE t0.word END AS key) t ON true
    JOIN {_LEXICON} l ON coalesce(
      (kind = 'yomi' AND (yomi1 = key OR ends_with(yomi2, key) OR ends_with(yomi3, key)))
      OR (kind = 'romaji' AND (coalesce(romaji1 = key, false) OR coalesce(ends_with(romaji2, key), false) OR coalesce(ends_with(romaji3, key), false)))
      OR (kind = 'headword' AND headword = key), false))""".replace("AS v(request_id, word) t0", "AS t0(request_id, word)")
_VALID = "id <> 0 AND freq <> 0 AND headword_id <> '' AND headword <> '' AND yomi_display <> '' AND romaji_display <> ''"


def _terms(spark: SparkSession) -> DataFrame:
    return literal(spark, TERMS, "request_id int, word string")


@register("search_rules", f"""SELECT request_id, CASE {at(_TYPE, 'word')}
    WHEN 'yomi' THEN '{{"groupOp":"OR","rules":[{{"field":"yomi1","op":"eq","data":"' || translate(word, {_KATA}) || '"}},{{"field":"yomi2","op":"ew","data":"' || translate(word, {_KATA}) || '"}},{{"field":"yomi3","op":"ew","data":"' || translate(word, {_KATA}) || '"}}]}}'
    WHEN 'romaji' THEN '{{"groupOp":"OR","rules":[{{"field":"romaji1","op":"eq","data":"' || word || '"}},{{"field":"romaji2","op":"ew","data":"' || word || '"}},{{"field":"romaji3","op":"ew","data":"' || word || '"}}]}}'
    WHEN 'headword' THEN '{{"groupOp":"OR","rules":[{{"field":"headword","op":"eq","data":"' || word || '"}}]}}' END AS filters
    FROM {values(TERMS, 'request_id', 'word')}""")
def search_rules(spark: SparkSession, _: str) -> DataFrame:
    return _terms(spark).select("request_id", search.rule_json(F.col("word")).alias("filters"))


@register("headword_search_eq", f"SELECT id, headword FROM {_LEXICON} WHERE headword = (SELECT min(p_name) FROM part WHERE p_partkey = 5)")
def headword_search_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lexicon(spark, sf_dir)
    term = own.where("id = 5").agg(F.min("headword").alias("key"))
    asked = term.select(F.lit(1).alias("request_id"), F.col("key").alias("word"))
    return search.search(asked, own).select("id", "headword")


@register("headword_search_suffix", f"SELECT id, headword FROM {_LEXICON} WHERE coalesce(romaji1 = 'widget', false) OR coalesce(ends_with(romaji2, 'widget'), false) OR coalesce(ends_with(romaji3, 'widget'), false)")
def headword_search_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark, sf_dir).where(search.matches_term("widget", text.ROMAJI)).select("id", "headword")


@register("headword_search_join", f"SELECT request_id, id, headword FROM {_HITS}")
def headword_search_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_terms(spark), lexicon(spark, sf_dir)).select("request_id", "id", "headword")


@register("headword_valid_rows", f"""SELECT t.request_id, count(h.id) AS n_rows, count(h.id) FILTER ({_VALID}) AS n_valid
    FROM {values(TERMS, 'request_id', 'word').replace('AS v(', 'AS t(')} LEFT JOIN {_HITS} h ON h.request_id = t.request_id GROUP BY t.request_id""")
def headword_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(_terms(spark), lexicon(spark, sf_dir)).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(search.is_valid()).alias("valid")
    )
    zero = F.lit(0).cast("long")
    return _terms(spark).join(hits, "request_id", "left").select(
        "request_id", F.coalesce("rows", zero).alias("n_rows"), F.coalesce("valid", zero).alias("n_valid")
    )


@register("headword_urls", f"SELECT request_id, headword AS word, 'https://nlb.ninjal.ac.jp/headword/' || headword_id || '/' AS url FROM {_HITS} WHERE {_VALID}")
def headword_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_terms(spark), lexicon(spark, sf_dir))
    return search.headword_urls(found, F.lit("NLB"))


# JSON.
@register("json_truthy_filter", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT <> 0")
def json_truthy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.where(web.truthy(F.col("v"), "$.k")).select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"))


_TARGETS = [(0, '{"rows":[1,2]}'), (1, '{"rows":null,"x":1}'), (2, '{"x":1}'), (3, '[3]'), (4, '{"rows":[]}'), (5, 'broken'), (6, None)]


@register("json_target_fallback", f"""SELECT id, CASE WHEN NOT json_valid(d) THEN NULL WHEN json_type(d, '$.rows') IS NULL OR json_type(d, '$.rows') = 'NULL' THEN json(d)::VARCHAR
    ELSE (d->'rows')::VARCHAR END AS target FROM {values(_TARGETS, 'id', 'd')}""")
def json_target_fallback(spark: SparkSession, _: str) -> DataFrame:
    rows = literal(spark, _TARGETS, "id int, d string")
    return rows.select("id", F.to_json(web.target_or_whole(F.try_parse_json("d"), "rows")).alias("target"))


@register("detail_assembly", fixtures.DETAIL_SQL)
def detail_assembly(spark: SparkSession, _: str) -> DataFrame:
    return records.details(payloads.table(spark, "detail_payload", fixtures.DETAIL_PAYLOAD))


#: The words of a furigana answer that can be read, null if it cannot.
_SUBWORDS = "list_transform(CASE WHEN json_type(w, '$.subword') = 'ARRAY' THEN (w->'subword')::JSON[] ELSE [] END, lambda s: {'furigana': s->>'furigana', 'surface': s->>'surface'})"
_READING = "CASE WHEN json_type(w, '$.subword') IS NULL THEN coalesce(w->>'furigana', w->>'surface') ELSE w->>'furigana' END"
_FURIGANA = f"""(SELECT *, CASE WHEN len(list_filter(words, lambda w: w->>'surface' IS NULL OR {_READING} IS NULL)) = 0 THEN list_transform(words, lambda w:
    {{'surface': w->>'surface', 'furigana': {_READING}, 'subword': {_SUBWORDS}}}) END AS read
  FROM (SELECT *, CASE WHEN json_valid(body) AND json_type(body, '$.result.word') = 'ARRAY' THEN (body->'$.result.word')::JSON[] END AS words
    FROM {values(fixtures.FURIGANA_PAYLOAD, 'request_id', 'transport_error', 'http_status', 'body')}))"""


@register("furigana_tokens", f"""SELECT request_id::BIGINT AS request_id, (pos - 1)::INT AS pos, w.surface AS surface, w.furigana AS furigana, len(w.subword)::INT AS n_subwords
    FROM (SELECT request_id, unnest(read) AS w, generate_subscripts(read, 1) AS pos FROM {_FURIGANA})""")  # fmt: skip
def furigana_tokens(spark: SparkSession, _: str) -> DataFrame:
    rows = payloads.table(spark, "furigana_payload", fixtures.FURIGANA_PAYLOAD)
    words = rows.select("request_id", F.posexplode(records.furigana_words(F.col("body"))).alias("pos", "w"))
    return words.select("request_id", "pos", "w.surface", "w.furigana", F.size("w.subword").alias("n_subwords"))


_SPANS = r'<span class="([^"]*)"><span class=inner>([^<]*)</span></span>'


@register("accent_morae", f"""SELECT request_id::BIGINT AS request_id, (k - 1)::INT AS pos, t[k] AS text, CASE split_part(c[k], ' ', 1) WHEN 'accent_plain' THEN 1 WHEN 'accent_top' THEN 2 ELSE 0 END AS accent
    FROM (SELECT request_id, c, t, unnest(range(1, len(c) + 1)) AS k FROM (SELECT request_id, regexp_extract_all(html, {quoted(_SPANS)}, 1) AS c, regexp_extract_all(html, {quoted(_SPANS)}, 2) AS t
      FROM {values(fixtures.ACCENT_PAYLOAD, 'request_id', 'transport_error', 'http_status', 'html')} WHERE html NOT LIKE '%<span><span class=inner>%'))""")  # fmt: skip
def accent_morae(spark: SparkSession, _: str) -> DataFrame:
    pages = payloads.table(spark, "accent_payload", fixtures.ACCENT_PAYLOAD)
    each = pages.select("request_id", F.posexplode(records.morae(F.col("html"))).alias("pos", "m"))
    return each.select("request_id", "pos", "m.text", "m.accent")


@register("accent_phrases", f"""SELECT id, (k - 1)::INT AS pos, regexp_replace(below[k], '<[^>]*>', '', 'g') AS surface, len(regexp_extract_all(above[k], '<span class="'))::INT AS n_morae,
    array_to_string(list_transform(below[1:least(len(above), len(below))], lambda b: regexp_replace(b, '<[^>]*>', '', 'g')), '') AS paragraph
    FROM (SELECT id, above, below, unnest(range(1, least(len(above), len(below)) + 1)) AS k FROM (SELECT id, regexp_extract_all(html, '<div class="phrasing_text">(.*?)</div>', 1) AS above,
      regexp_extract_all(html, '<div class="phrasing_subscript">(.*?)</div>', 1) AS below FROM {values(fixtures.PHRASE_PAGES, 'id', 'html')}))""")
def accent_phrases(spark: SparkSession, _: str) -> DataFrame:
    pages = literal(spark, fixtures.PHRASE_PAGES, "id int, html string").select("id", html.phrases(F.col("html")).alias("p"))
    each = pages.select("id", records.paragraph(F.col("p")).alias("paragraph"), F.posexplode("p").alias("pos", "phrase"))
    return each.select("id", "pos", "phrase.surface", F.size("phrase.morae").alias("n_morae"), "paragraph")


# Alignment at scale: the words of a part's name and its size are tokens, their kana the morae.
_PARTS = f"""(SELECT p_partkey AS id, string_split(lower(p_name), ' ') || [(p_size)::VARCHAR] || CASE WHEN p_partkey % 5 = 0 THEN ['cafe-ー'] ELSE [] END AS words,
    string_split(CASE WHEN p_partkey % 7 = 0 THEN substr(kana, 2) WHEN p_partkey % 11 = 0 THEN 'う' || kana WHEN p_partkey % 13 = 0 THEN kana || '、ん' ELSE kana END, '') AS morae
    FROM (SELECT *, translate(replace(lower(p_name), ' ', '') || p_size::VARCHAR, {_SPELT}) AS kana FROM part))"""


def part_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tokens, morae) made from the part table."""
    size = F.col("p_size").cast("string")
    kana = F.translate(F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")), size), LATIN, KANA)
    key = F.col("p_partkey")
    spoken = (
        F.when(key % 7 == 0, F.substr(kana, F.lit(2)))
        .when(key % 11 == 0, F.concat(F.lit("う"), kana))
        .when(key % 13 == 0, F.concat(kana, F.lit("、ん")))
        .otherwise(kana)
    )
    extra = F.when(key % 5 == 0, F.array(F.lit("cafe-ー"))).otherwise(F.array().cast("array<string>"))
    words = F.concat(F.split(F.lower("p_name"), " "), F.array(size), extra)
    none = F.array().cast("array<struct<furigana:string,surface:string>>")
    tokens = F.transform(
        words, lambda w: F.struct(w.alias("surface"), F.translate(w, LATIN, KANA).alias("furigana"), none.alias("subword"))
    )
    morae = F.transform(F.split(spoken, ""), lambda m, i: F.struct(m.alias("text"), (i % 3).alias("accent")))
    return read(spark, sf_dir, "part").select(key.alias("id"), tokens.alias("tokens"), morae.alias("morae"))


def _flat(rows: DataFrame) -> DataFrame:
    """One row per token and mora of an aligned sentence."""
    tokens = rows.select("id", F.posexplode(align.align(F.col("tokens"), F.col("morae"))).alias("pos", "t"))
    return tokens.select(
        "id", "pos", "t.surface", "t.furigana", F.size("t.subword").alias("n_sub"), F.posexplode_outer("t.accent").alias("mora", "a")
    ).select("id", "pos", "surface", "furigana", "n_sub", "mora", "a.*")


def _align_sql(source: str) -> str:
    """The alignment of ``source`` (id, surf[], read[], nsub[], txt[], acc[]) as a recursive query."""
    hira = lambda x: f"translate({x}, {_HIRA})"
    strip = at(_STRIP, "x")
    return rf"""WITH RECURSIVE b AS (
  SELECT id, surf, read, nsub, txt, acc, len(surf) AS nt, len(txt) AS n,
    list_transform(read, lambda x: {hira('x')}) AS rh, list_transform(txt, lambda x: {hira('x')}) AS mh,
    list_transform(txt, lambda x: {hira(strip)}) AS ms FROM ({source})),
c AS (SELECT *, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(list_transform(txt[1:k], lambda x: length(x))), 0)::INT) AS cr,
    list_transform(range(0, n + 1), lambda k: coalesce(list_sum(list_transform(ms[1:k], lambda x: length(x))), 0)::INT) AS cs FROM b),
t AS (
  SELECT id, 0 AS i, 0 AS p, 0 AS q, 0 AS e, 0 AS nextp, '' AS kind, false AS num FROM c
  UNION ALL
  SELECT id, i, p, q, e, CASE kind WHEN 'match' THEN e WHEN 'skip' THEN p + CASE WHEN p < n AND ms[p + 1] IN ('、', '。', ',', '.') THEN 1 ELSE 0 END
      ELSE p + CASE WHEN p < n THEN 1 ELSE 0 END END AS nextp, kind, num
  FROM (SELECT *, CASE WHEN nsub[i] = 0 AND regexp_matches(read[i], '{_NOT_KK}') AND NOT num THEN 'skip'
        WHEN num AND array_to_string(ms[q + 1:e], '') <> '' THEN 'match'
        WHEN NOT num AND cr[e + 1] - cr[q + 1] = length(read[i]) AND {hira("array_to_string(txt[q + 1:e], '')")} = rh[i] THEN 'match'
        ELSE 'fallback' END AS kind
    FROM (SELECT *, CASE WHEN num THEN list_filter(range(q, n + 1), lambda k: k = n OR (i < nt AND rh[i + 1] <> '' AND starts_with(rh[i + 1], ms[k + 1])) OR cs[k + 1] - cs[q + 1] > greatest(4 * length(surf[i]), 12))[1]
          ELSE list_filter(range(q, n + 1), lambda k: k = n OR cr[k + 1] - cr[q + 1] >= length(read[i]))[1] END AS e
      FROM (SELECT *, CASE WHEN num THEN p ELSE list_filter(range(p, n + 1), lambda k: k = n OR starts_with(rh[i], mh[k + 1]))[1] END AS q
        FROM (SELECT c.*, t.i + 1 AS i, t.nextp AS p, regexp_full_match(c.surf[t.i + 1], '{_NUMBER}') AS num FROM t JOIN c ON t.id = c.id WHERE t.i < c.nt)))))
SELECT id, (i - 1)::INT AS pos, surf[i] AS surface,
  CASE WHEN kind = 'match' AND num THEN array_to_string(ms[q + 1:e], '') ELSE read[i] END AS furigana,
  (CASE WHEN kind = 'match' THEN nsub[i] ELSE 0 END)::INT AS n_sub,
  k::INT AS mora, CASE WHEN k IS NULL THEN NULL WHEN kind <> 'match' THEN CASE WHEN kind = 'skip' THEN surf[i] ELSE read[i] END WHEN num THEN ms[q + 1 + k] ELSE txt[q + 1 + k] END AS furigana_1,
  (CASE WHEN k IS NULL THEN NULL WHEN kind = 'match' THEN acc[q + 1 + k] ELSE 0 END)::INT AS accent_marking_type,
  (CASE WHEN k IS NULL THEN NULL WHEN kind <> 'match' THEN length(CASE WHEN kind = 'skip' THEN surf[i] ELSE read[i] END) WHEN num THEN length(ms[q + 1 + k]) ELSE length(txt[q + 1 + k]) END)::INT AS length
FROM (SELECT t.*, c.surf, c.read, c.nsub, c.txt, c.acc, c.ms,
    unnest(CASE WHEN kind <> 'match' THEN [0] WHEN q < e THEN range(0, e - q) ELSE [NULL] END) AS k
  FROM t JOIN c ON t.id = c.id WHERE t.i > 0)"""


def _named(rows: DataFrame) -> DataFrame:
    return rows.toDF("id", "pos", "surface", "furigana", "n_sub", "mora", "furigana_1", "accent_marking_type", "length")


@register("align_kana_parts", _align_sql(f"""SELECT id, words AS surf, list_transform(words, lambda w: translate(w, {_SPELT})) AS read,
    list_transform(words, lambda w: 0) AS nsub, morae AS txt, list_transform(range(0, len(morae)), lambda k: k % 3) AS acc FROM {_PARTS}"""))
def align_kana_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_flat(part_sentences(spark, sf_dir)))


@register("align_golden", _align_sql(fixtures.ALIGN_SQL))
def align_golden(spark: SparkSession, _: str) -> DataFrame:
    return _named(_flat(literal(spark, fixtures.ALIGN_ROWS, f"id int, tokens {align.TOKENS}, morae {align.MORAE}")))


@register("token_lookahead", f"""SELECT id, (k - 1)::INT AS pos, translate(words[k], {_SPELT}) AS furigana, translate(words[k + 1], {_SPELT}) AS ahead
    FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS k FROM {_PARTS})""")
def token_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_sentences(spark, sf_dir)
    each = rows.select("id", "tokens", F.posexplode("tokens").alias("pos", "t"))
    return each.select("id", "pos", "t.furigana", F.get("tokens", F.col("pos") + 1)["furigana"].alias("ahead"))


_ZIP = [(0, "abc", "xy"), (1, "a", "xyz"), (2, "", "x"), (3, "ab", "")]


@register("positional_zip", f"""SELECT id, (k - 1)::INT AS pos, substr(a, k, 1) AS left_part, substr(b, k, 1) AS right_part
    FROM (SELECT *, unnest(range(1, least(length(a), length(b)) + 1)) AS k FROM {values(_ZIP, 'id', 'a', 'b')})""")
def positional_zip(spark: SparkSession, _: str) -> DataFrame:
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = literal(spark, _ZIP, "id int, a string, b string").select("id", chars("a").alias("a"), chars("b").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    both = F.arrays_zip(F.slice("a", F.lit(1), n).alias("l"), F.slice("b", F.lit(1), n).alias("r"))
    return rows.select("id", F.posexplode(both).alias("pos", "z")).select("id", "pos", F.col("z.l").alias("left_part"), F.col("z.r").alias("right_part"))


# URLs and pages.
def _escaped(value: str) -> str:
    """DuckDB's escaping, with a plus sign for a space."""
    return f"replace(url_encode({value}), '%20', '+')"


def _form_sql(fields: dict[str, str]) -> str:
    return " || '&' || ".join(f"{_escaped(quoted(k))} || '=' || {_escaped(v)}" for k, v in fields.items())


@register("url_build", f"""SELECT p_partkey, 'https://www.edrdg.org/jmwsgi/srchres.py?s1=1&y1=1&t1=' || {_escaped('p_name')} || '&src=1&search=Search&svc=jmdict' AS url,
    'https://www.edrdg.org/jmwsgi/entr.py?svc=jmdict&e=' || p_partkey AS entry FROM part""")
def url_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return read(spark, sf_dir, "part").select(
        "p_partkey", requests.dictionary_url(F.col("p_name")).alias("url"), requests.entry_url(key).alias("entry")
    )


@register("request_bodies", f"""SELECT t.request_id, '{{"id":"1234-1","jsonrpc":"2.0","method":"jlp.furiganaservice.furigana","params":{{"q":"' || word || '","grade":1}}}}' AS furigana,
    {_form_sql({'data[Phrasing][text]': 'word'} | {f'data[Phrasing][{k}]': quoted(v) for k, v in requests.ACCENT_SETTINGS.items()})} AS accent,
    {_form_sql({'_search': "'true'", 'filters': 'r.filters'})} AS headwords, {_form_sql({'dsrchkey': 'word', 'dicsel': "'1'"})} AS sentences
    FROM {values(TERMS, 'request_id', 'word').replace('AS v(', 'AS t(')} JOIN ({SQL['search_rules']}) r ON r.request_id = t.request_id WHERE word <> ''""")
def request_bodies(spark: SparkSession, _: str) -> DataFrame:
    word = F.col("word")
    return _terms(spark).where("word != ''").select(
        "request_id",
        requests.furigana_body(word).alias("furigana"),
        requests.accent_body(word).alias("accent"),
        requests.headword_body(word).alias("headwords"),
        requests.sentence_body(word).alias("sentences"),
    )


@register("detail_requests", """SELECT site, headword_id, endpoint, CASE WHEN endpoint IN ('basicinfoss', 'patternfreqorder') THEN 'POST' ELSE 'GET' END AS method,
    CASE site WHEN 'NLB' THEN 'https://nlb.ninjal.ac.jp' ELSE 'https://tsukubawebcorpus.jp' END || '/' || endpoint || '/' || headword_id || '/' AS url
    FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'NLB' ELSE 'NLT' END AS site, p_brand || '-' || p_partkey AS headword_id,
      unnest(CASE WHEN p_partkey % 2 = 0 THEN ['basicinfob', 'basicinfosc', 'basicinfosj', 'basicinfoss', 'basicinfoky', 'basicinfojs', 'patternfreqorder']
        ELSE ['basicinfob', 'basicinfosj', 'basicinfojs', 'patternfreqorder'] END) AS endpoint FROM part)""")
def detail_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.when(F.col("id") % 2 == 0, "NLB").otherwise("NLT").alias("site")
    return requests.detail_requests(lexicon(spark, sf_dir).select(site, "headword_id"))


@register("url_param_first", r"SELECT page_id, nullif(regexp_extract(url, '\?(?:[^#]*&)?utm_source=([^&#]+)', 1), '') AS value FROM pages")
def url_param_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", web.query_param(F.col("url"), "utm_source").alias("value"))


@register("html_links", """SELECT page_id, (k - 1)::INT AS pos, l[k] AS link FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k
    FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s(?:[^>"]*"[^"]*")*?[^>"]*?\\bhref\\s*=\\s*"([^"]*)"', 1) AS l FROM pages))""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(web.links(F.col("html"))).alias("pos", "link"))


@register("html_comment_filter", """SELECT page_id, len(c) AS n_comments, len(list_filter(c, lambda x: contains(x, 'ad ' || (page_id % 10)::VARCHAR))) > 0 AS mentioned
    FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS c FROM pages)""")
def html_comment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = web.comments(F.col("html"))
    wanted = F.concat(F.lit("ad "), (F.col("page_id") % 10).cast("string"))
    return read(spark, sf_dir, "pages").select(
        "page_id", F.size(own).cast("long").alias("n_comments"), F.exists(own, lambda c: F.contains(c, wanted)).alias("mentioned")
    )


@register("html_class_select", """SELECT page_id, len(regexp_extract_all(html, '<div class="ad">'))::INT AS n_ads FROM pages""")
def html_class_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.size(html.ad_texts(F.col("html"))).alias("n_ads"))


# Pages as trees.
def _plain_sql(value: str) -> str:
    """Text of a page without its entities."""
    for entity, own in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', '{own}')"
    return value


def _place(*keys: str) -> Column:
    return (F.row_number().over(Window.partitionBy(*keys).orderBy("pre")) - 1).alias("pos")


_LISTED = "'<li><a href=\"([^\"]*)\">([^<]*)</a></li>'"


@register("tree_list_items", f"""SELECT page_id, pos, href, item, lead(item) OVER (PARTITION BY page_id ORDER BY pos) AS next_item FROM (
    SELECT page_id, (k - 1)::INT AS pos, {_plain_sql("h[k]")} AS href, {_plain_sql("t[k]")} AS item FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k
      FROM (SELECT page_id, regexp_extract_all(html, {_LISTED}, 1) AS h, regexp_extract_all(html, {_LISTED}, 2) AS t FROM pages)))""")
def tree_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the lists of each page's navigation: address and text of the link, text of the next item."""
    item = [Step("nav"), Step("ul", how=">"), Step("li", how=">")]
    table = tree.nodes(read(spark, sf_dir, "pages"), "page_id", selectors={"item": item, "link": [*item, Step("a", how=">")]}, texts_of=("item",), only=True)
    rows = tree.gathered(table, "text", tree.joined()).where("tag != '#comment'")
    is_link = F.array_contains("matched", "link")
    links = F.array_sort(F.collect_list(F.when(is_link, F.struct("pre", F.col("attrs")["href"].alias("href"))))).alias("links")
    own = F.first(F.when(~is_link, F.struct("parent", "text")), ignorenulls=True).alias("own")
    items = rows.groupBy("key", F.when(is_link, F.col("parent")).otherwise(F.col("pre")).alias("pre")).agg(own, links)
    # The next element of the list is an item, too.
    after = F.lead("own.text").over(Window.partitionBy("key", "own.parent").orderBy("pre"))
    each = items.withColumn("next_item", after).select("key", "pre", "own.text", "next_item", F.posexplode("links").alias("nth", "link"))
    pos = (F.row_number().over(Window.partitionBy("key").orderBy("pre", "nth")) - 1).alias("pos")
    return each.select(F.col("key").alias("page_id"), pos, F.col("link.href").alias("href"), F.col("text").alias("item"), "next_item")


@register("tree_break_lines", f"""SELECT page_id, (k - 1)::INT AS pos, nullif({_plain_sql("l[k]")}, '') AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k
    FROM (SELECT page_id, regexp_extract_all(html, '<br>(?:<p>(?:<b>)?([^<]*))?', 1) AS l FROM pages))""")
def tree_break_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line break of a page the first text of the next paragraph beside it."""
    table = tree.nodes(read(spark, sf_dir, "pages"), "page_id", selectors={"p": [Step("p")], "br": [Step("br")]}, texts_of=("p",), only=True)
    rows = tree.gathered(table, "line", F.min_by("said", "at"))
    breaks = tree.with_next(rows, "p", value=F.struct("line")).where("tag = 'br'")
    return breaks.select(F.col("key").alias("page_id"), _place("key"), F.col("next.line").alias("line"))


_AD = "'<!--([^>]*)--><div class=\"ad\">([^<]*)</div>'"


def _announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, data, next: pre and text): comments of pages with the block beside them that they announce."""
    table = tree.nodes(read(spark, sf_dir, "pages"), "page_id", selectors={"div": [Step("div")], "ad": [Step("div", "ad")]}, texts_of=("ad",), only=True)
    rows = tree.with_next(tree.gathered(table, "text", tree.joined()), "div", value=F.struct("pre", "matched", "text"))
    return rows.where(F.col("tag") == "#comment").where(F.array_contains("next.matched", "ad")).select("key", "data", F.struct("next.pre", "next.text").alias("next"))


@register("tree_comment_blocks", f"""SELECT page_id, trim(c[k]) AS comment, {_plain_sql("t[k]")} AS block FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k
    FROM (SELECT page_id, regexp_extract_all(html, {_AD}, 1) AS c, regexp_extract_all(html, {_AD}, 2) AS t FROM pages))""")
def tree_comment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of pages with the text of the block beside them that they announce."""
    return _announced(spark, sf_dir).select(F.col("key").alias("page_id"), text.strip(F.col("data")).alias("comment"), F.col("next.text").alias("block"))


_COMMENTS = "(SELECT page_id, (k - 1)::INT AS pos, c[k] AS c FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS c FROM pages)))"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a comment of the given pages says of each id."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("ad "), F.col("page_id").cast("string")).alias("word"))


@register("comment_mentions", f"SELECT c.page_id, c.pos, p.page_id AS id FROM {_COMMENTS} c JOIN pages p ON contains(c.c, 'ad ' || p.page_id)")
def comment_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with every id that it contains, as a part of a longer one, too."""
    ids = _ids(spark, sf_dir)
    comments = read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.posexplode(web.comments(F.col("html"))).alias("pos", "data"))
    return mentions.mentions(ids, comments).join(ids, "word").select(F.col("key").alias("page_id"), "pos", "id")


@register("entry_blocks", f"""SELECT p.page_id AS id, b.page_id, b.block FROM (SELECT page_id, c[k] AS c, {_plain_sql("t[k]")} AS block FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k
    FROM (SELECT page_id, regexp_extract_all(html, {_AD}, 1) AS c, regexp_extract_all(html, {_AD}, 2) AS t FROM pages))) b JOIN pages p ON contains(b.c, 'ad ' || p.page_id)""")
def entry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each id the blocks of all pages whose comment contains it: entries with the blocks that are theirs."""
    ids = _ids(spark, sf_dir)
    comments = _announced(spark, sf_dir).withColumnRenamed("next", "pos")
    met = mentions.mentions(ids, comments).join(ids, "word")
    return met.select("id", F.col("key").alias("page_id"), F.col("pos.text").alias("block"))


#: Selectors with the pattern that finds the same elements of the given pages. Those of the dictionary and accent
#: pages, below, meet nothing there; all are followed in the one walk.
_SELECTED = {
    "nav > ul > li": ([Step("nav"), Step("ul", how=">"), Step("li", how=">")], "<li>"),
    "li a[href^=/]": ([Step("li"), Step("a", attrs=(("href", "^=", "/"),))], '<li><a href="/'),
    "div.ad": ([Step("div", "ad")], '<div class="ad">'),
    "br + p": ([Step("br"), Step("p", how="+")], "<br><p>"),
    "article h1": ([Step("article"), Step("h1")], "<h1>"),
    "title + style": ([Step("title"), Step("style", how="+")], "</title><style>"),
    "meta[charset=utf-8]": ([Step("meta", attrs=(("charset", "=", "utf-8"),))], '<meta charset="utf-8">'),
    "nav ~ article": ([Step("nav"), Step("article", how="~")], "<article>"),
    "[class*=a]": ([Step(attrs=(("class", "*=", "a"),))], 'class="[^"]*a'),
    "html[lang]": ([Step("html", attrs=(("lang", "?", ""),))], "<html lang="),
}
SELECTORS = {name: steps for name, (steps, _) in _SELECTED.items()} | {
    "tr.resrow input[name=e]": [Step("tr", "resrow"), Step("input", attrs=(("name", "=", "e"),))],
    "span.kanj": [Step("span", "kanj")],
    "span.rdng": [Step("span", "rdng")],
    "tr.sense span.pos span.abbr": [Step("tr", "sense"), Step("span", "pos"), Step("span", "abbr")],
    "tr.sense span.glossx": [Step("tr", "sense"), Step("span", "glossx")],
    "a[href^=srchres.py]": [Step("a", attrs=(("href", "^=", "srchres.py"),))],
    "div[style*=clear] br ~ font[size=-1]": [Step("div", attrs=(("style", "*=", "clear"),)), Step("br"), Step("font", attrs=(("size", "=", "-1"),), how="~")],
    "div.phrasing_text > span": [Step("div", "phrasing_text"), Step("span", how=">")],
    "div.phrasing_subscript > span": [Step("div", "phrasing_subscript"), Step("span", how=">")],
}


@register("selector_matches", " UNION ALL ".join(
    f"SELECT page_id, '{name}' AS selector, len(regexp_extract_all(html, '{pattern}')) AS n FROM pages WHERE regexp_matches(html, '{pattern}')" for name, (_, pattern) in _SELECTED.items()))
def selector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each page every selector meets: one parse and one walk a page for all of them."""
    table = tree.nodes(read(spark, sf_dir, "pages"), "page_id", selectors=SELECTORS)
    met = table.select(F.col("key").alias("page_id"), F.explode("matched").alias("selector"))
    return met.groupBy("page_id", "selector").agg(F.count(F.lit(1)).alias("n"))


# The scalar functions over whole tables.
def _table_of_words(name: str, source: str, key: str, word: str, use: Callable[[Column], Column], sql: str) -> None:
    """A scalar function over ``word``, an expression that both engines read, of every row of a table."""
    register(name, f"SELECT {key}, {at(sql, 's')} AS value FROM (SELECT {key}, {word} AS s FROM {source})")(
        lambda spark, sf_dir: read(spark, sf_dir, source).select(*key.split(", "), F.expr(word).alias("s")).select(*key.split(", "), use(F.col("s")).alias("value"))
    )


_TURN = "conv_id, turn"
_table_of_words("strip_turns", "conversations", _TURN, "'　 ' || text || '  '", text.strip, _STRIP)
_table_of_words("ordinal_turns", "conversations", _TURN, "'(' || turn || ')　 ' || text", text.strip_ordinal, rf"regexp_replace({{0}}, '\A\([0-9]+\){_WS}*', '')")
_table_of_words("gloss_parts", "part", "p_partkey", "' ▶ ' || p_name || '▶　'", text.clean_gloss, at(_STRIP, "replace({0}, '▶', '')"))
_table_of_words("kanji_parts", "part", "p_partkey", f"translate(substr(lower(p_name), 1 + p_partkey % 9, 1), {_SPELT})", text.is_kana_or_kanji, f"length({{0}}) = 1 AND NOT regexp_matches({{0}}, '{_NOT_KK}')")
_DIGITS = "translate({0}, '０１２３４５６７８９', '0123456789')"
_table_of_words(
    "int_or_zero_orders", "orders", "o_orderkey",
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || translate(CAST(o_orderkey AS STRING), '0123456789', '０１２３４５６７８９') WHEN 2 THEN '-' || o_orderkey || '_0' ELSE o_orderkey || '_' END", text.int_or_zero,
    at("CASE WHEN {0} IS NULL THEN 0 WHEN regexp_full_match(#, '[+-]?[0-9]+(_[0-9]+)*') THEN try_cast(replace(#, '_', '') AS BIGINT) END".replace("#", at(_DIGITS, _STRIP)), "{0}"),
)


@register("pair_turns", rf"""SELECT conv_id, turn, CASE WHEN p = '' THEN s ELSE substr(s, 1, instr(s, p) - 1) END AS jp, CASE WHEN p <> '' THEN substr(s, instr(s, p) + length(p)) END AS en
    FROM (SELECT conv_id, turn, s, regexp_extract(s, '\t+|{_WS}{{2,}}') AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN role || chr(9) || text ELSE text || '  ' || role END AS s FROM conversations))""")
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat("role", F.lit("\t"), "text")).otherwise(F.concat("text", F.lit("  "), "role"))
    parts = text.split_pair(F.col("s"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("s")).select("conv_id", "turn", F.get(parts, F.lit(0)).alias("jp"), F.get(parts, F.lit(1)).alias("en"))


@register("punct_characters", f"""SELECT c AS mark, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations)
    WHERE c <> '' AND list_contains([{", ".join(map(quoted, dict.fromkeys(text.PUNCTUATION)))}], c) GROUP BY c""")
def punct_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "conversations").select(F.explode(F.split("text", "")).alias("mark")).where("mark != ''")
    return each.where(text.is_punctuation(F.col("mark"))).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


@register("accent_shape_orders", """SELECT o_orderkey, CASE WHEN instr(a, '2') = 1 THEN 'Atamadaka' WHEN instr(a, '2') > 1 AND instr(a, '2') = length(a) THEN 'Odaka'
    WHEN instr(a, '2') > 1 THEN 'Nakadaka' WHEN instr(a, '1') > 0 THEN 'Heiban' END AS shape FROM (SELECT o_orderkey, translate(o_orderkey::VARCHAR, '3456789', '0101012') AS a FROM orders)""")
def accent_shape_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = F.translate(F.col("o_orderkey").cast("string"), "3456789", "0101012")
    accents = F.transform(F.filter(F.split(spelt, ""), lambda x: x != ""), lambda x: x.cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.accent_shape(accents).alias("shape"))


@register("props_target", """SELECT event_id, CASE WHEN NOT json_valid(props) THEN NULL WHEN json_type(props, t) IS NULL OR json_type(props, t) = 'NULL' THEN json(props)::VARCHAR ELSE json_extract(props, t)::VARCHAR END AS target
    FROM (SELECT event_id, props, CASE WHEN event_id % 2 = 0 THEN '$.k' ELSE '$.none' END AS t FROM events)""")
def props_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.try_parse_json("props")
    own = F.when(F.col("event_id") % 2 == 0, F.to_json(web.target_or_whole(document, "k"))).otherwise(F.to_json(web.target_or_whole(document, "none")))
    return read(spark, sf_dir, "events").select("event_id", own.alias("target"))


#: A word of each part: a name in Latin letters, a part of it as kana, the whole.
_WORD = f"CASE p_partkey % 3 WHEN 0 THEN split_part(lower(p_name), ' ', 1) WHEN 1 THEN translate(replace(lower(p_name), ' ', ''), {_SPELT}) ELSE p_name END"
_PART_RULES = SQL["search_rules"].split(" FROM (VALUES")[0] + f" FROM (SELECT p_partkey AS request_id, {_WORD} AS word FROM part)"


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.expr(_WORD).alias("word"))


@register("search_rules_parts", _PART_RULES)
def search_rules_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_words(spark, sf_dir).select("request_id", search.rule_json(F.col("word")).alias("filters"))


@register("request_bodies_parts", SQL["request_bodies"].split(" FROM (VALUES")[0] + f" FROM (SELECT p_partkey AS request_id, {_WORD} AS word FROM part) t JOIN ({_PART_RULES}) r ON r.request_id = t.request_id")
def request_bodies_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("word")
    bodies = (requests.furigana_body(word).alias("furigana"), requests.accent_body(word).alias("accent"), requests.headword_body(word).alias("headwords"), requests.sentence_body(word).alias("sentences"))
    return _part_words(spark, sf_dir).select("request_id", *bodies)


# Payload fixtures: dictionary and envelopes.
@register("dict_entries", fixtures.ENTRIES_SQL)
def dict_entries(spark: SparkSession, _: str) -> DataFrame:
    found = records.entries(
        payloads.table(spark, "requests_word", fixtures.DICT_REQUESTS),
        payloads.table(spark, "dict_search_page", fixtures.SEARCH_PAGES),
        payloads.table(spark, "dict_entry_page", fixtures.ENTRY_PAGES),
    )
    each = found.select("request_id", "pos", "entry_id", "missing", "entry.id", F.posexplode_outer("entry.definitions").alias("sense", "d"))
    joined = lambda c: F.array_join(c, "|")
    return each.select("request_id", "pos", "entry_id", "missing", "id", "sense", joined("d.pos").alias("parts"), joined("d.meanings").alias("meanings"))


@register("dict_sentence_chain", fixtures.CHAIN_SQL)
def dict_sentence_chain(spark: SparkSession, _: str) -> DataFrame:
    found = records.entries(
        payloads.table(spark, "requests_word", fixtures.DICT_REQUESTS),
        payloads.table(spark, "dict_search_page", fixtures.SEARCH_PAGES),
        payloads.table(spark, "dict_entry_page", fixtures.ENTRY_PAGES),
    )
    # An entry's id is asked for by a request for sentences, whose page has the sentences of more entries.
    asked = payloads.table(spark, "requests_word", fixtures.SENTENCE_REQUESTS).select(F.col("request_id").alias("asked"), "id")
    pages = payloads.table(spark, "sentence_page", fixtures.SENTENCE_PAGES).select(
        F.col("request_id").alias("asked"), html.example_blocks(F.col("html")).alias("blocks")
    )
    entries = found.where("NOT missing").select("request_id", F.col("entry.id").alias("ent_seq")).distinct()
    pairs = entries.join(asked, F.col("ent_seq") == F.col("id")).join(pages, "asked").select(
        "request_id", "ent_seq", F.posexplode(records.sentences(F.col("blocks"), F.col("ent_seq"))).alias("pos", "s")
    )
    return pairs.select("request_id", "ent_seq", "pos", "s.jp", "s.en")


def _answers(rows: DataFrame, result: Column | None = None) -> DataFrame:
    """Status, code of the error, and the whole result as text."""
    code = F.col("envelope.error.code") if "struct" in dict(rows.select("envelope.error").dtypes)["error"] else F.when(F.col("envelope.status") != 200, F.col("envelope.status"))
    text_of = F.to_json("envelope.result", {"ignoreNullFields": "false"}) if result is None else result
    return rows.select(
        "request_id", F.col("envelope.status").alias("status"), code.alias("code"), F.when(F.col("envelope.result").isNotNull(), text_of).alias("result")
    )


def _expected(name: str, rows: list[tuple[int, int, str | None]]):
    """Answers as they are written in the fixtures."""
    return register(name, f"SELECT request_id::BIGINT AS request_id, status, CASE WHEN status <> 200 THEN status END AS code, result FROM {values(rows, 'request_id', 'status', 'result')}")


@register("envelope_furigana", f"""SELECT request_id::BIGINT AS request_id, status, CASE WHEN status <> 200 THEN status END AS code, CASE WHEN status = 200 THEN to_json(read)::VARCHAR END AS result
    FROM (SELECT r.request_id, read, CASE WHEN p.request_id IS NULL THEN 500 WHEN transport_error = 'timeout' THEN 408 WHEN transport_error IS NOT NULL THEN 500 WHEN http_status <> 200 THEN http_status
      WHEN read IS NULL THEN 500 ELSE 200 END AS status FROM {values(fixtures.TEXT_REQUESTS, 'request_id', 'text').replace('AS v(', 'AS r(')} LEFT JOIN {_FURIGANA} p ON p.request_id = r.request_id)""")
def envelope_furigana(spark: SparkSession, _: str) -> DataFrame:
    requests = payloads.table(spark, "requests_text", fixtures.TEXT_REQUESTS)
    return _answers(endpoints.mark_furigana(requests, payloads.table(spark, "furigana_payload", fixtures.FURIGANA_PAYLOAD)))


@_expected("envelope_accent", [(i, s, fixtures.ACCENT_ANSWERS.get(i) if r else None) for i, s, r in fixtures.ACCENT_STATUS])
def envelope_accent(spark: SparkSession, _: str) -> DataFrame:
    return _answers(
        endpoints.mark_accent(
            endpoints.normalised_requests(payloads.table(spark, "requests_text", fixtures.TEXT_REQUESTS)),
            payloads.table(spark, "furigana_payload", fixtures.FURIGANA_PAYLOAD),
            payloads.table(spark, "accent_payload", fixtures.ACCENT_PAYLOAD),
        )
    )


_USAGE = f"""(SELECT t.request_id, CASE WHEN coalesce(t.word, '') = '' THEN 500 WHEN count(h.id) = 0 THEN 404 ELSE 200 END AS status,
    coalesce(list({{'row': h.id, 'id': h.id, 'headword_id': h.headword_id, 'headword': h.headword, 'yomi_display': h.yomi_display, 'romaji_display': h.romaji_display, 'freq': h.freq}} ORDER BY h.id)
      FILTER (h.id IS NOT NULL AND {_VALID.replace('id <>', 'h.id <>', 1)}), []) AS hits
    FROM {values(TERMS, 'request_id', 'word').replace('AS v(', 'AS t(')} LEFT JOIN {_HITS} h ON h.request_id = t.request_id GROUP BY t.request_id, t.word)"""


@register("envelope_usage", f"SELECT request_id, status, CASE WHEN status <> 200 THEN status END AS code, CASE WHEN status = 200 THEN to_json(hits)::VARCHAR END AS result FROM {_USAGE}")
def envelope_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(endpoints.headwords(_terms(spark), lexicon(spark, sf_dir)))


@register("envelope_links", f"""SELECT request_id, status, CASE WHEN status <> 200 THEN status END AS code,
    CASE WHEN status = 200 THEN to_json(list_transform(hits, lambda h: {{'word': h.headword, 'url': CASE WHEN request_id % 2 = 0 THEN 'https://nlb.ninjal.ac.jp' ELSE 'https://tsukubawebcorpus.jp' END || '/headword/' || h.headword_id || '/'}}))::VARCHAR END AS result FROM {_USAGE}""")
def envelope_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _terms(spark).withColumn("site", F.when(F.col("request_id") % 2 == 0, "NLB").otherwise("NLT"))
    return _answers(endpoints.headword_links(asked, lexicon(spark, sf_dir)))


@register("envelope_details", fixtures.DETAIL_ENVELOPE_SQL)
def envelope_details(spark: SparkSession, _: str) -> DataFrame:
    requests = literal(spark, fixtures.DETAIL_REQUESTS, "request_id bigint, site string, headword_id string")
    rows = endpoints.headword_details(requests, payloads.table(spark, "detail_payload", fixtures.DETAIL_PAYLOAD))
    fields = [f"envelope.result.{f}" for f, _, _ in records.DETAILS.values()]
    return _answers(rows, F.concat_ws("|", *fields))


@_expected("envelope_dict", fixtures.DICT_STATUS)
def envelope_dict(spark: SparkSession, _: str) -> DataFrame:
    return _answers(
        endpoints.dictionary(
            payloads.table(spark, "requests_word", fixtures.DICT_REQUESTS),
            payloads.table(spark, "dict_search_page", fixtures.SEARCH_PAGES),
            payloads.table(spark, "dict_entry_page", fixtures.ENTRY_PAGES),
        )
    )


@_expected("envelope_sentence", fixtures.SENTENCE_STATUS)
def envelope_sentence(spark: SparkSession, _: str) -> DataFrame:
    requests = payloads.table(spark, "requests_word", fixtures.SENTENCE_REQUESTS)
    return _answers(endpoints.example_sentences(requests, payloads.table(spark, "sentence_page", fixtures.SENTENCE_PAGES)))
