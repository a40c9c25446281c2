"""Hand-written captured payloads with the edge rows that the services' rules speak of."""

from __future__ import annotations

import json

# Furigana and accent marking.
TEXT_REQUESTS = [(i, "お金を稼ぐ") for i in range(1, 14)]  # nothing was captured for the last one


def _word(surface: str, furigana: str | None = None, subword: list[tuple[str, str]] | None = None) -> dict:
    out = {"surface": surface}
    if furigana is not None:
        out["furigana"] = furigana
    if subword is not None:
        out["subword"] = [{"furigana": f, "surface": s} for f, s in subword]
    return out


def _body(words: list[dict]) -> str:
    return json.dumps({"id": "1234-1", "jsonrpc": "2.0", "result": {"word": words}}, ensure_ascii=False)


_MONEY = _body([_word("お金", "おかね", [("お", "お"), ("かね", "金")]), _word("を"), _word("稼ぐ", "かせぐ", [("かせ", "稼"), ("ぐ", "ぐ")])])
_MIXED = _body([_word("漢字", "かんじ"), _word("かな交じり", "かなまじり", [("かな", "かな"), ("ま", "交"), ("じり", "じり")]), _word("文", "ぶん")])
FURIGANA_PAYLOAD = [
    (1, None, 200, _MONEY),
    (2, None, 200, _MIXED),
    (3, "timeout", None, None),
    (4, "http", None, None),
    (5, None, 503, "busy"),
    (6, None, 200, "no json"),
    (7, None, 200, '{"error": {"code": -1}}'),
    (8, None, 200, _body([_word("金", None, [("かね", "金")])])),  # a word with subwords needs its reading
    (9, None, 200, _body([])),
    (10, None, 200, _MONEY),
    (11, None, 200, _MONEY),
    (12, None, 200, _MONEY),
]
#: (request, status, result present)
FURIGANA_STATUS = [(1, 200, True), (2, 200, True), (3, 408, False), (4, 500, False), (5, 503, False), (6, 500, False), (7, 500, False), (8, 500, False), (9, 200, True), (10, 200, True), (11, 200, True), (12, 200, True), (13, 500, False)]


def _accent_page(morae: list[tuple[str, str | None]]) -> str:
    spans = "".join(f"<span{'' if c is None else f' class="{c}"'}><span class=inner>{t}</span></span>" for t, c in morae)
    return f'<html><div class="phrasing_text">{spans}</div><div class="phrasing_subscript"><span>お金</span></div><br><div class="phrasing_text"><span>extra'


def _phrase(surfaces: list[str], morae: list[tuple[str, str]]) -> str:
    above = "".join(f'<span class="{c}"><span class=inner>{t}</span></span>' for t, c in morae)
    below = "".join(f"<span>{s}</span>" for s in surfaces)
    return f'<div class="phrasing_text">{above}</div><p><div class="phrasing_subscript">{below}</div></p>'


_WALK = _phrase(["山", "道", "を"], [("や", "mora"), ("ま", "accent_plain"), ("み", "accent_top"), ("ち", "mora"), ("を", "mora")])
_RUN = _phrase(["走<b>る</b>"], [("は", "mora"), ("し", "accent_top"), ("る", "mora")])
#: Pages of several phrases; the last page's second phrase has nothing below it, its third is no phrase.
PHRASE_PAGES = [(1, _WALK + _RUN), (2, _RUN), (3, ""), (4, _WALK + '<div class="phrasing_text"><span class="mora">x</span></div>'), (5, None), (6, _phrase([], [("あ", "accent_top")]))]

_MORAE = [("お", "mora"), ("か", "accent_plain"), ("ね", "accent_plain"), ("を", "accent_plain"), ("か", "accent_plain"), ("せ", "accent_top x"), ("ぐ", "mora")]
ACCENT_PAYLOAD = [
    *((i, None, 200, _accent_page(_MORAE)) for i in range(1, 10)),
    (10, "timeout", None, None),
    (11, None, 404, "gone"),
    (12, None, 200, _accent_page([*_MORAE[:3], ("を", None)])),  # a mora without a class
]
#: As above; no tokens are a 200 without result.
ACCENT_STATUS = [(1, 200, True), (2, 200, True), (3, 408, False), (4, 500, False), (5, 503, False), (6, 500, False), (7, 500, False), (8, 500, False), (9, 200, False), (10, 500, False), (11, 500, False), (12, 500, False), (13, 500, False)]

_SUBWORDS = {"お金": [("お", "お"), ("かね", "金")], "稼ぐ": [("かせ", "稼"), ("ぐ", "ぐ")]}


def _marked(*words: tuple[str, str, list[tuple[str, int]]]) -> str:
    """Marked words (reading, surface, accents) as JSON; one that is not matched has lost its subwords."""
    out = []
    for reading, surface, accents in words:
        sub = [{"furigana": f, "surface": s} for f, s in _SUBWORDS.get(surface, [])] if len(accents) > 1 else []
        marks = [{"furigana": t, "accent_marking_type": a, "length": len(t)} for t, a in accents]
        out.append({"furigana": reading, "surface": surface, "accent": marks, "subword": sub})
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


#: Marked words of the requests that have any; the morae of request 2 are those of another sentence.
ACCENT_ANSWERS = {
    1: _marked(("おかね", "お金", [("お", 0), ("か", 1), ("ね", 1)]), ("を", "を", [("を", 1)]), ("かせぐ", "稼ぐ", [("か", 1), ("せ", 2), ("ぐ", 0)])),
    2: _marked(("かんじ", "漢字", [("かんじ", 0)]), ("かなまじり", "かな交じり", [("かなまじり", 0)]), ("ぶん", "文", [("ぶん", 0)])),
}

_T = lambda surface, furigana, *sub: (surface, furigana, list(sub))
#: Sentences for the alignment: (id, tokens, morae).
ALIGN_ROWS = [
    (1, [_T("お金", "おかね", ("お", "お"), ("かね", "金")), _T("を", "を"), _T("稼ぐ", "かせぐ", ("かせ", "稼"), ("ぐ", "ぐ"))],
     [("お", 0), ("か", 1), ("ね", 1), ("を", 1), ("か", 1), ("せ", 2), ("ぐ", 0)]),
    (2, [_T("コーヒー", "こーひー"), _T("、", "、"), _T("を", "を")], [("コ", 0), ("ー", 1), ("、", 0), ("ヲ", 1), ("を", 2)]),
    (3, [_T("１２", "12"), _T("日", "にち")], [("じゅ", 1), ("う", 1), ("に", 2), ("に", 1), ("ち", 0)]),
    (4, [_T("日", "にち"), _T("7\n", "なな")], [("に", 1), ("ち", 0), ("な", 2), (" な ", 0)]),
    (5, [_T("空", ""), _T("文", "ぶん")], [("ぶ", 1), ("ん", 0)]),
    (6, [_T("文", "ぶん")], []),
    (7, [_T("x", "x"), _T("金", "かね", ("かね", "金"))], [(".", 0), ("う", 0), ("か", 2), ("ね", 0)]),
]


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]" + ("::VARCHAR[]" if not items else "")


ALIGN_SQL = " UNION ALL ".join(
    f"SELECT {i} AS id, {_list([t[0] for t in tokens])} AS surf, {_list([t[1] for t in tokens])} AS read, "
    f"{[len(t[2]) for t in tokens]} AS nsub, {_list([m[0] for m in morae])} AS txt, {[m[1] for m in morae]}::INT[] AS acc"
    for i, tokens, morae in ALIGN_ROWS
)

# Headword details.
_ENDPOINTS = ["basicinfob", "basicinfosc", "basicinfosj", "basicinfoss", "basicinfoky", "basicinfojs", "patternfreqorder"]
_BODIES = ['{"freq":3}', '{"subcorpus":[{"a":1}]}', '{"shojikei":[{"b":"x"}]}', '{"subcorpus":[{"c":2}]}', '{"katuyokei":[]}', '{"setuzoku":[{"d":null}],"n":1}', '{"rows":[{"e":5}],"total":1}']


def _details(site: str, headword_id: str, **other: tuple[str | None, int, str]) -> list[tuple]:
    """Payloads of all endpoints, some of them other ones."""
    return [(site, headword_id, e, *other.get(e, (None, 200, b))) for e, b in zip(_ENDPOINTS, _BODIES, strict=True)]


DETAIL_PAYLOAD = [
    *(("NLB", "V.1", e, None, 200, b) for e, b in zip(_ENDPOINTS, _BODIES, strict=True)),
    *(("NLT", "V.2", e, None, 200, b) for e, b in zip(_ENDPOINTS, _BODIES, strict=True) if e not in ("basicinfosc", "basicinfoss", "basicinfoky")),
    *(("NLB", "V.3", e, "timeout" if e == "basicinfosj" else None, 404 if e == "basicinfojs" else 200, b) for e, b in zip(_ENDPOINTS, _BODIES, strict=True)),
    *(("NLB", "V.4", e, None, 200, "[1]" if e == "basicinfob" else b) for e, b in zip(_ENDPOINTS, _BODIES, strict=True)),
    *(("NLB", "V.5", e, None, 200, "oops" if e == "basicinfoky" else b) for e, b in zip(_ENDPOINTS, _BODIES, strict=True)),
    *(("NLB", "V.6", e, None, 200, '{"rows":null}' if e == "patternfreqorder" else b) for e, b in zip(_ENDPOINTS, _BODIES, strict=True)),
    *_details("NLT", "V.7", basicinfosc=("timeout", 0, ""), basicinfoky=(None, 404, "")), ("NLT", "V.7", "unheard", "http", 0, ""),
    *_details("NLB", "V.8", basicinfosj=(None, 200, '[{"b":"x"}]')),
    *_details("NLB", "V.10")[:-1],
    *_details("NLB", "V.11", patternfreqorder=(None, 200, '{"rows":[1]}')),
    *_details("NLB", "V.12", basicinfob=(None, 200, "[1]"), basicinfosj=("timeout", 0, "")),
]
DETAIL_REQUESTS = [(1, "NLB", "V.1"), (2, "NLT", "V.2"), (3, "NLB", "V.3"), (4, "NLB", "V.4"), (5, "NLB", "V.5"), (6, "NLB", "V.6"), (7, "NLT", "V.7"), (8, "NLB", "V.8"), (9, "NLB", "V.9"), (10, "NLB", "V.10"), (11, "NLB", "V.11"), (12, "NLB", "V.12"), (13, "NLB", "V.1"), (14, None, "V.1"), (15, "NLB", None), (16, None, None)]
#: V.3 times out first; V.4 has no object as base; V.5 is unreadable; V.6 falls back to a whole document that is no list; V.7 fails only where
#: its site is not asked; V.8 is a list where an object is due; nothing was captured of V.9, not all of V.10; V.11 lists no objects; V.12 times out before its base is looked at; the last three name no headword.
DETAIL_STATUS = [(1, 200), (2, 200), (3, 504), (4, 500), (5, 500), (6, 500), (7, 200), (8, 500), (9, 500), (10, 500), (11, 500), (12, 504), (13, 200), (14, 500), (15, 500), (16, 500)]


_FIELDS = [("basicinfob", "base", "", 1), ("basicinfosc", "subcorpus", "subcorpus", 0), ("basicinfosj", "shojikei", "shojikei", 1), ("basicinfoss", "subcorpus_shojikei", "subcorpus", 0), ("basicinfoky", "katuyokei", "katuyokei", 0), ("basicinfojs", "setuzoku", "setuzoku", 1), ("patternfreqorder", "patternfreqorder", "rows", 1)]


def _detail_sql() -> str:
    rows = ", ".join("(" + ", ".join("'" + str(x) + "'" for x in (s, h, e, b)) + ")" for s, h, e, _, _, b in DETAIL_PAYLOAD)
    columns = []
    for endpoint, field, target, everywhere in _FIELDS:
        whole = "CASE WHEN json_valid(body) THEN json(body)::VARCHAR END"
        own = f"CASE WHEN json_valid(body) AND coalesce(json_type(body, '$.{target}'), 'NULL') <> 'NULL' THEN (body->'{target}')::VARCHAR ELSE {whole} END" if target else whole
        value = f"max({own}) FILTER (endpoint = '{endpoint}')"
        columns.append(f"{value} AS {field}" if everywhere else f"CASE WHEN site = 'NLT' THEN '[]' ELSE {value} END AS {field}")
    return f"SELECT site, headword_id, {', '.join(columns)} FROM (VALUES {rows}) AS v(site, headword_id, endpoint, body) GROUP BY site, headword_id"


DETAIL_SQL = _detail_sql()


def _literals(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: Status and fields of every request for details, worked out from the payloads.
DETAIL_ENVELOPE_SQL = f"""WITH req(request_id, site, headword_id) AS (VALUES {_literals(DETAIL_REQUESTS)}),
pay(site, headword_id, endpoint, transport_error, http_status, body) AS (VALUES {_literals(DETAIL_PAYLOAD)}),
ep(place, endpoint, field, target, everywhere) AS (VALUES {_literals([(i, *f) for i, f in enumerate(_FIELDS)])}),
one AS (SELECT r.request_id, e.place, CASE WHEN p.endpoint IS NULL THEN 500 WHEN transport_error = 'timeout' THEN 504 WHEN transport_error IS NOT NULL THEN 500
    WHEN http_status <> 200 THEN http_status WHEN NOT json_valid(body) THEN 500 WHEN target <> '' AND json_type(body) <> 'OBJECT' THEN 500 ELSE 200 END AS status
  FROM req r JOIN ep e ON e.everywhere = 1 OR r.site <> 'NLT' LEFT JOIN pay p ON p.site = r.site AND p.headword_id = r.headword_id AND p.endpoint = e.endpoint),
first AS (SELECT request_id, coalesce(arg_min(status, place) FILTER (status <> 200), 200) AS status FROM one GROUP BY request_id),
d AS ({DETAIL_SQL}),
f AS (SELECT r.request_id, first.status, d.*, d.base LIKE '{{%' AND {" AND ".join(f"coalesce(json_type({x}) = 'ARRAY' AND len(list_filter(CASE WHEN json_type({x}) = 'ARRAY' THEN {x} ELSE '[]' END::JSON[], lambda i: json_type(i) <> 'OBJECT')) = 0, false)" for _, x, _, _ in _FIELDS[1:])} AS shaped
  FROM req r JOIN first ON first.request_id = r.request_id LEFT JOIN d ON d.site = r.site AND d.headword_id = r.headword_id)
SELECT request_id::BIGINT AS request_id, s AS status, CASE WHEN s <> 200 THEN s END AS code,
  CASE WHEN s = 200 THEN concat_ws('|', {", ".join(x for _, x, _, _ in _FIELDS)}) END AS result
FROM (SELECT *, CASE WHEN status = 200 AND NOT coalesce(shaped, false) THEN 500 ELSE status END AS s FROM f)"""

# Dictionary.
DICT_REQUESTS = [(1, "先生", "NLB", 0), (2, "みたび", "NLB", 0), (3, "none", "NLB", 0), (4, "down", "NLB", 0), (5, "gap", "NLB", 0), (6, "bad", "NLB", 0), (7, "unanswered", "NLB", 0), (8, "huge", "NLB", 0), (9, "broken", "NLB", 0)]
_RESULTS = '<table><tr class="resrow odd"><td><input type=checkbox name="e" value="101"><td>x<tr class="resrow"><td><input name="q" value="9"><input name="e" value="102"></tr><tr class="resrow"><td><input name="e"></tr><tr class="other"><input name="e" value="7"></table>'
SEARCH_PAGES = [
    (1, None, "https://www.edrdg.org/jmwsgi/srchres.py?s1=1", _RESULTS),
    (2, None, "https://www.edrdg.org/jmwsgi/entr.py?svc=jmdict&e=103&e=104", "<p>redirected"),
    (3, None, "https://www.edrdg.org/jmwsgi/srchres.py?s1=1", "<p>nothing</p>"),
    (4, "http", None, None),
    (5, None, "https://www.edrdg.org/jmwsgi/entr.py?svc=jmdict&e=999", "<p>redirected"),
    (6, None, "https://www.edrdg.org/jmwsgi/entr.py?svc=jmdict&e=105", "<p>redirected"),
    (8, None, "https://www.edrdg.org/jmwsgi/entr.py?svc=jmdict&e=106", "<p>redirected"),
    (9, None, "https://www.edrdg.org/jmwsgi/srchres.py?s1=1", "<p><![foo[ the parser cannot read this ]]>"),
]
_ENTRY = '<span class="kanj"> 先生 </span><span class="rdng">せんせい</span><table><tr class="sense"><td><span class="pos">[<span class="abbr">n</span>,<span class="abbr">suf</span>]</span><span class="glossx">▶ teacher</span><span class="glossx">▶ <b>master</b></span></tr><tr class="sense"><span class="glossx">sensei</span></tr></table><a href="srchres.py?x">1387990</a><a href="srchres.py?y">5</a>'
ENTRY_PAGES = [
    ("101", None, _ENTRY),
    ("102", None, '<span class="rdng">x</span>'),
    ("103", None, '<tr class="sense"><span class="glossx">thrice</span></tr><a href="srchres.py">138799</a>'),
    ("105", None, '<a href="srchres.py">not a number</a>'),
    ("106", None, '<span class="kanj">多</span><a href="srchres.py">９９９９９９９９９９９</a>'),
]
_NOTHING = '{"kanji":[],"furigana":[],"definitions":[],"id":0}'
#: (request, status, result)
DICT_STATUS = [
    (1, 200, '[{"kanji":["先生"],"furigana":["せんせい"],"definitions":[{"pos":["n","suf"],"meanings":["teacher","master"]},{"pos":[],"meanings":["sensei"]}],"id":1387990},' + _NOTHING.replace('"furigana":[]', '"furigana":["x"]') + "]"),
    (2, 200, '[{"kanji":[],"furigana":[],"definitions":[{"pos":[],"meanings":["thrice"]}],"id":138799}]'),
    (3, 404, None), (4, 500, None), (5, 500, None), (6, 500, None), (7, 500, None),
    (8, 200, '[{"kanji":["多"],"furigana":[],"definitions":[],"id":99999999999}]'),
    (9, 500, None),
]
ENTRIES_SQL = """SELECT * REPLACE (request_id::BIGINT AS request_id, id::BIGINT AS id) FROM (VALUES (1, 0, '101', false, 1387990, 0, 'n|suf', 'teacher|master'), (1, 0, '101', false, 1387990, 1, '', 'sensei'),
    (1, 1, '102', false, 0, NULL, NULL, NULL), (2, 0, '103', false, 138799, 0, '', 'thrice'),
    (5, 0, '999', true, NULL, NULL, NULL, NULL), (6, 0, '105', true, NULL, NULL, NULL, NULL), (8, 0, '106', false, 99999999999, NULL, NULL, NULL)) AS v(request_id, pos, entry_id, missing, id, sense, parts, meanings)"""

# Example sentences: a block with two line breaks before one sentence, and an id that begins another.
_BLOCKS = '<div style="clear: both"><!-- ent_seq=1387990 --><br>\n<br><font size="-1">(1) 彼 は 先生 だ。\tHe is a <i>teacher</i>.</font><br><font size="2">skip</font></div><div style="clear:left"><!-- ent_seq=5 --><br><font size="-1">犬  A dog.</font></div>'
SENTENCE_REQUESTS = [(1, "先生", "NLB", 1387990), (2, "x", "NLB", 138799), (3, "犬", "NLB", 42), (4, "x", "NLB", 1), (5, "x", "NLB", 7), (6, "x", "NLB", 8), (7, "x", "NLB", 9), (8, "x", "NLB", 0)]
SENTENCE_PAGES = [
    (1, None, _BLOCKS),
    (2, None, _BLOCKS),
    (3, None, _BLOCKS),
    (4, "timeout", None),
    (5, None, '<div style="clear:both"><!--ent_seq=7--><br><font size="-1">only one part</font></div>'),
    (6, None, '<div style="clear:both"><!--ent_seq=8--></div>'),
    (8, None, "<p><![foo[ the parser cannot read this ]]>"),
]
_TEACHER = '{"jp":"彼は先生だ。","en":"He is a teacher ."}'
#: (request, status, result); nothing was captured for request 7.
SENTENCE_STATUS = [
    (1, 200, f'{{"word":"先生","id":1387990,"sentence":[{_TEACHER},{_TEACHER}]}}'),
    (2, 200, f'{{"word":"x","id":138799,"sentence":[{_TEACHER},{_TEACHER}]}}'),
    (3, 404, None), (4, 500, None), (5, 500, None), (6, 404, None), (7, 500, None), (8, 500, None),
]
CHAIN_SQL = """SELECT * REPLACE (request_id::BIGINT AS request_id, ent_seq::BIGINT AS ent_seq) FROM (VALUES (1, 1387990, 0, '彼は先生だ。', 'He is a teacher .'), (1, 1387990, 1, '彼は先生だ。', 'He is a teacher .'),
    (2, 138799, 0, '彼は先生だ。', 'He is a teacher .'), (2, 138799, 1, '彼は先生だ。', 'He is a teacher .')) AS v(request_id, ent_seq, pos, jp, en)"""
