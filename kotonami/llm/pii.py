"""Personal data by weak supervision (op3), in DataFrame and SQL functions only.

Spans of four kinds (email, ip, card, phone) come in two sorts. Base spans match a fixed pattern and its check (octets,
Luhn, number of digits) and always stay. Weak candidates (written-out addresses, numbers without
a plus sign, long digit runs that fail the check, IPv6) are added if the model accepts them and no base
span overlaps them.

* Labelers vote on each candidate, for (1), against (-1) or not at all (0): strict pattern, loose shape, a
  gazetteer (top-level domains, card issuers, area codes, address ranges), words before and words after.
* Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability
  and each kind's share of true spans. A vote pattern is a row; there are at most 4 * 3^5, however many candidates.
* A logistic span classifier is trained on the posteriors over all different feature rows (also
  a fixed number at most) and applied to every candidate as a column expression.

Positions are code points, end exclusive. They are running sums of the lengths of matches and of the gaps
between them. The patterns are written so that no text, however long, makes them backtrack.

Defined results: a null text is empty; a text without spans has counts of 0 and the digest of the empty
string; rows with equal ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

# An atom is entered at its first character or where the last match ended, and never given back;
# that finds the same leftmost, longest matches as the plain patterns, in one pass.
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns of the kinds.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Weak candidates of the kinds.
WEAK = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_OCTET = r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\z"

# Gazetteers, fixed values: common top-level domains, issuer prefixes, private address ranges.
DOMAINS = "com org net edu gov info io de fr es uk jp eu".split()
ISSUERS = r"\A(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
PRIVATE = r"\A(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|255\.)"
#: Words near a span that speak for or against its kind.
FOR = {
    "email": "mail|e-mail|email|contact|write|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|addr|adresse",
    "card": "card|visa|mastercard|amex|payment|credit|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|fax|cell|telefon|portable",
}
AGAINST = "version|release|isbn|issn|order|invoice|ticket|section|chapter|sku|serial|build|id"
LABELERS = ("strict", "loose", "gazetteer", "before", "after")
ROUNDS = 30
#: Characters of a piece when a text is cut at its spans.
PIECE = 4_096
ACCEPT = 0.5


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Matches of one pattern with the lengths and ends of the gaps before and after them."""
    needle = {"email": ["@"] if base else ["at"], "phone": ["+"] if base else [], "ip": ["."] if base else [":"]}
    likely = F.lit(True)
    for one in needle.get(kind, []):
        likely = likely & F.contains(text, F.lit(one))
    matches = F.when(likely, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def pieces(found: Column) -> Column:
        n = F.size(found)
        return F.when(n > 0, _let(F.split(text, pattern, -1), lambda gaps: zipped(found, gaps, n)))

    def zipped(found: Column, gaps: Column, n: Column) -> Column:
        pairs = F.zip_with(found, F.slice(gaps, 1, n), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
        return F.transform(F.zip_with(pairs, F.slice(gaps, 2, n), lambda p, g: F.struct(p.alias("p"), g.alias("g"))), row)

    def row(x: Column, i: Column) -> Column:
        gap = x["p"]["gap"]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            i.alias("i"),
            F.char_length(gap).alias("gap"),
            F.right(gap, F.lit(30)).alias("before"),
            x["p"]["match"].alias("match"),
            F.left(x["g"], F.lit(20)).alias("after"),
        )

    return F.coalesce(_let(matches, pieces), F.expr("array()"))


def candidates(docs: DataFrame, row: str, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """One row per candidate span of ``docs``, and one with a null kind for a row without any.

    ``row`` names a column that tells the rows of ``docs`` apart. Columns: ``row``, ``keep``, kind,
    base (matches the base pattern and its check), start, end, match, before, after.
    """
    body = F.coalesce(docs[text], F.lit(""))
    found = F.concat(
        *[_found(body, k, p, True) for k, p in BASE.items()], *[_found(body, k, p, False) for k, p in WEAK.items()]
    )
    rows = docs.select(docs[row], *[docs[c] for c in keep], F.explode_outer(found).alias("s"))
    length = F.char_length("s.match")
    along = Window.partitionBy(row, "s.kind", "s.base").orderBy("s.i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("s.gap") + length).over(along)
    rows = rows.select(row, *keep, "s.*", (end - length).alias("start"), end.alias("end"))
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.split("match", r"\."), lambda x: x.rlike(_OCTET))
    strict = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", n.between(12, 19) & F.call_function("luhn_check", digits))
        .when(F.col("kind") == "phone", n.between(9, 15))
    )
    rows = rows.withColumn("digits", n).withColumn("strict", F.coalesce(F.col("base") & strict, F.lit(False)))
    # Short numbers are no candidates; neither is what overlaps a base span.
    # Both windows only grow, one from either end: their work is linear in a row's spans.
    places = ["start", "end", "kind", "base"]
    ahead = Window.partitionBy(row).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(row).orderBy(*map(F.desc, places)).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("strict"), F.col("end"))).over(ahead)
    coming = F.min(F.when(F.col("strict"), F.col("start"))).over(behind)
    likely = F.col("strict") | ~F.col("base") | (F.col("kind").isin("card", "phone") & (F.col("digits") >= 9))
    # The first match of a pattern stays, without a kind, so that no row of ``docs`` is lost.
    rows = rows.withColumn("likely", F.coalesce(likely, F.lit(False))).where("likely OR kind IS NULL OR i = 0")
    rows = rows.withColumn("free", (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end")))
    let = F.col("likely") & (F.col("strict") | F.col("free"))
    return rows.select(
        row, *keep, *[F.when(let, F.col(c)).alias(c) for c in ("kind", "start", "end", "match", "before", "after", "digits")],
        F.when(let, F.col("strict")).alias("base"),
    )


def votes(rows: DataFrame) -> DataFrame:
    """``rows`` with a column of -1, 0 or 1 for each labeler (null where there is no candidate)."""

    def near(column: str) -> Column:
        word = F.lower(F.col(column))
        good = F.lit(False)
        for kind, words in FOR.items():
            good = good | ((F.col("kind") == kind) & word.rlike(rf"(?:\A|[^a-z])(?:{words})(?:[^a-z]|\z)"))
        bad = word.rlike(rf"(?:\A|[^a-z])(?:{AGAINST})(?:[^a-z]|\z)")
        return F.when(good, 1).when(bad, -1).otherwise(0)

    digits = F.regexp_replace("match", "[^0-9]", "")
    domain = F.lower(F.regexp_extract("match", r"([A-Za-z0-9-]+)\z", 1))
    gazetteer = (
        F.when(F.col("kind") == "email", F.when(domain.isin(DOMAINS), 1).otherwise(0))
        .when(F.col("kind") == "card", F.when(digits.rlike(ISSUERS), 1).otherwise(-1))
        .when(F.col("kind") == "ip", F.when(F.col("match").rlike(PRIVATE), 0).otherwise(1))
        .otherwise(F.when(F.substring(digits, -10, 1).isin("0", "1"), -1).otherwise(0))
    )
    loose = (
        F.when(F.col("kind") == "phone", F.when(F.col("digits").between(9, 15), 1).otherwise(-1))
        .when(F.col("kind") == "card", F.when(F.col("digits").between(13, 16), 1).otherwise(-1))
        .otherwise(1)
    )
    clean = F.when(F.left("after", F.lit(1)).rlike(r"[A-Za-z0-9_/=]") | F.right("before", F.lit(1)).rlike(r"[A-Za-z0-9_/=]"), -1)
    own = {
        "strict": F.when(F.col("base"), 1).otherwise(-1),
        "loose": loose,
        "gazetteer": gazetteer,
        "before": near("before"),
        "after": F.coalesce(clean, near("after")),
    }
    present = F.col("kind").isNotNull()
    return rows.withColumns({f"v_{k}": F.when(present, v.cast("int")) for k, v in own.items()})


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) pattern being a true span, by expectation-maximisation.

    ``patterns`` holds (kind, votes, count). Labelers are taken as independent given the truth; counts
    are smoothed, so a labeler that never votes stays uninformative.
    """
    kinds = sorted({k for k, _, _ in patterns})
    share = dict.fromkeys(kinds, 0.5)
    table = [
        {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.3, -1: 0.6}} for _ in LABELERS
    ]  # of each labeler: P(vote | truth)
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, own, _ in patterns:
            yes = math.log(share[kind]) + sum(math.log(t[1][v]) for t, v in zip(table, own, strict=True))
            no = math.log(1 - share[kind]) + sum(math.log(t[0][v]) for t, v in zip(table, own, strict=True))
            posterior[kind, own] = 1 / (1 + math.exp(min(700.0, max(-700.0, no - yes))))
        for kind in kinds:
            rows = [(posterior[k, v], n) for k, v, n in patterns if k == kind]
            share[kind] = (1 + sum(p * n for p, n in rows)) / (2 + sum(n for _, n in rows))
        for j, t in enumerate(table):
            for truth in (0, 1):
                seen = {v: 1.0 + 4.0 * (v == (1 if truth else -1)) for v in (-1, 0, 1)}
                for kind, own, n in patterns:
                    p = posterior[kind, own]
                    seen[own[j]] += n * (p if truth else 1 - p)
                total = sum(seen.values())
                for v in seen:
                    t[truth][v] = seen[v] / total
    return posterior


def _features(kind: str, own: tuple[int, ...], length: int) -> list[float]:
    """Of a candidate: bias, kinds, votes and coarse length."""
    return [1.0, *(float(kind == k) for k in KINDS), *map(float, own), length / 4]


def train_classifier(rows: list[tuple[str, tuple[int, ...], int, float, int]], rounds: int = 60) -> list[float]:
    """Weights of a logistic classifier from (kind, votes, length class, posterior, count)."""
    data = [(_features(k, v, size), p, math.log1p(n)) for k, v, size, p, n in rows]
    w = [0.0] * (2 + len(KINDS) + len(LABELERS))
    total = sum(n for _, _, n in data) or 1.0
    for _ in range(rounds * 5):
        slope = [0.01 * x for x in w]
        for f, p, n in data:
            z = max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True))))
            gap = n / total * (1 / (1 + math.exp(-z)) - p)
            slope = [s + gap * b for s, b in zip(slope, f, strict=True)]
        w = [a - 0.8 * s for a, s in zip(w, slope, strict=True)]
    return w


def _length_class() -> Column:
    return F.least(F.char_length("match"), F.lit(40)) / 10


def fit(voted: DataFrame) -> list[float]:
    """Classifier weights from all candidates; what reaches the driver is a row per feature pattern."""
    names = [f"v_{k}" for k in LABELERS]
    counted = (
        voted.where("kind IS NOT NULL")
        .groupBy("kind", *names, F.floor(_length_class()).alias("length"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", *names, "length")
        .collect()
    )
    sums: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in counted:
        key = (r["kind"], tuple(r[n] for n in names))
        sums[key] = sums.get(key, 0) + r["n"]
    posterior = estimate([(k, v, n) for (k, v), n in sums.items()])
    rows = [(r["kind"], v := tuple(r[n] for n in names), r["length"], posterior[r["kind"], v], r["n"]) for r in counted]
    return train_classifier(rows)


def accepted(voted: DataFrame, weights: list[float], accept: float = ACCEPT) -> DataFrame:
    """``voted`` with ``probability``; candidates below ``accept`` that are no base spans get a null kind."""
    terms = [F.lit(1.0), *((F.col("kind") == k).cast("double") for k in KINDS)]
    terms += [F.col(f"v_{k}").cast("double") for k in LABELERS] + [F.floor(_length_class()) / 4]
    score = sum((F.lit(w) * t for w, t in zip(weights[1:], terms[1:], strict=True)), F.lit(weights[0]))
    rows = voted.withColumn("probability", 1 / (1 + F.exp(-score)))
    return rows.withColumn("kind", F.when(F.col("base") | (F.col("probability") >= accept), F.col("kind")))


def find(docs: DataFrame, row: str, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Accepted spans of ``docs``: the rows of ``candidates`` with votes and probability."""
    found = common.staged(votes(candidates(docs, row, keep, text)), "pii-candidates")
    return accepted(found, fit(found))


def _listed(which: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = F.array_sort(F.collect_list(F.when(which, F.struct("start", rank.alias("rank"), "end", "kind"))))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _cut(pieces: Column, begin: Column, end: Column) -> Column:
    """Characters ``begin`` to ``end`` of a text given in pieces of ``PIECE`` characters.

    Only the pieces in the range are touched, so cutting a text into all its parts stays linear.
    """
    first, last = F.floor(begin / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    head = F.substr(F.get(pieces, first), (begin % PIECE + 1).cast("int"), F.least(end - begin, F.lit(PIECE)).cast("int"))
    between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.left(F.get(pieces, last), (end - F.lit(PIECE).cast("long") * last).cast("int"))
    return F.when(end <= begin, "").when(first == last, head).otherwise(F.concat(head, between, tail))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every accepted span of ``text`` replaced by its kind in angle brackets.

    Where spans overlap, the later one is shortened to what is left of it.
    """
    rows = common.staged(docs.withColumn("pii_row", F.monotonically_increasing_id()), "pii-rows")
    found = find(rows, "pii_row", text=text).where("kind IS NOT NULL")
    along = Window.partitionBy("pii_row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(
        "pii_row", F.coalesce(F.max("end").over(along), F.lit(0).cast("long")).alias("at"), "start", "end", "kind"
    ).where(F.col("end") > F.col("at"))
    spans = found.groupBy("pii_row").agg(
        F.array_sort(F.collect_list(F.struct("at", "start", "end", "kind"))).alias("pii_spans")
    )
    joined = rows.join(spans, "pii_row", "left")

    def made(pieces: Column) -> Column:
        parts = F.transform(
            "pii_spans",
            lambda s: F.concat(_cut(pieces, s["at"], F.greatest(s["start"], s["at"])), F.lit("<"), F.upper(s["kind"]), F.lit(">")),
        )
        rest = _cut(pieces, F.element_at("pii_spans", -1)["end"], F.char_length(text).cast("long"))
        return F.concat(F.array_join(parts, ""), rest)

    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = F.when(F.col("pii_spans").isNull(), F.col(text)).otherwise(_let(pieces, made))
    return joined.withColumn(text, clean).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    docs = common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    found = find(docs, "row", keep=("doc_id",))
    base = F.coalesce(F.col("base"), F.lit(False))
    counts = [F.count_if(base & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    out = found.groupBy("row", "doc_id").agg(
        *counts, _listed(base & F.col("kind").isNotNull()).alias("base_list"), _listed(F.col("kind").isNotNull()).alias("spans")
    )
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_list", 256).alias("base_sha256"), "spans")
