"""Token counts with overlap resynchronisation of huge documents (op8).

``count_tokens`` gives, for every text, the number of tokens that a public byte-level BPE
vocabulary makes of it. Three ways lead to the same number:

* A text whose characters all lie where the pre-tokenizer's character classes are beyond doubt
  (ASCII and Latin letters) is cut into pre-tokens, and each different pre-token is encoded once by
  the library. A byte-level BPE never merges across pre-tokens, so the counts add up.
* Other texts, and those holding a special token's string, are encoded whole by the library.
* A text above ``chunk_chars`` characters is encoded in overlapping chunks with offsets. Two
  neighbouring chunks are spliced at a character where both start a new pre-token. The cutter
  looks only forward from the start of a pre-token, so from such a common start both chunks go on
  alike: the boundary is stable. Starts near the cut ends of the chunks and inside or beside
  a special token's string are not used, since a cut could change them. Where no common boundary
  is found the overlap is doubled, up to the whole rest of the document.

Null counts as empty text (0 bytes, 0 tokens). Rows that repeat are counted each on its own.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Iterator

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 512
#: Pre-tokens that a worker remembers; beyond it the memory is emptied, never the count.
REMEMBERED = 800_000
#: Starts so near a cut end of a chunk are not trusted (longer than any special string).
MARGIN = 32
PLAIN = r"\A[\t\n\r\x20-\x7e¡-ɏ]*\z"


@functools.cache
def tokenizer(vocabulary: str):
    """The library's tokenizer, one for each Python worker."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


@functools.cache
def pre_tokens():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN).findall


def special_strings(vocabulary: str) -> list[str]:
    return [t.content for t in tokenizer(vocabulary).get_added_tokens_decoder().values()]


class Counter:
    """Counts of texts, with the pre-tokens seen so far."""

    def __init__(self, vocabulary: str):
        self.tok, self.known, self.split = tokenizer(vocabulary), {}, pre_tokens()

    def plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings whose character classes are beyond doubt."""
        cut = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in set().union(*cut) if w not in self.known]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.known.update(
                zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True)
            )
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in cut]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]


def _starts(encoding, begin: int) -> dict[int, int]:
    """Character position of each pre-token's start -> number of tokens before it."""
    out, last = {}, None
    for n, (word, (first, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            out.setdefault(begin + first, n)
        last = word
    return out


def spliced(text: str, vocabulary: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """(tokens of ``text``, times an overlap had to be widened), encoding chunk by chunk."""
    tok, specials = tokenizer(vocabulary), special_strings(vocabulary)
    forbidden = [(m.start() - 1, m.end() + 1) for s in specials for m in regex.finditer(regex.escape(s), text)]
    forbidden.sort()
    begins, reach = [a for a, _ in forbidden], list(itertools.accumulate((b for _, b in forbidden), max))

    def allowed(p: int) -> bool:
        k = bisect.bisect_right(begins, p)
        return k == 0 or reach[k - 1] < p

    total = widened = 0
    begin, end, trusted = 0, min(len(text), chunk), 0
    left = tok.encode(text[begin:end], add_special_tokens=False)
    counted_from = 0  # tokens of ``left`` before it belong to the chunk before
    while end < len(text):
        own, wide = _starts(left, begin), overlap
        while True:
            start = max(trusted, end - wide)
            stop = min(len(text), start + chunk + wide)
            right = tok.encode(text[start:stop], add_special_tokens=False)
            other = _starts(right, start)
            common_starts = [
                p
                for p in own.keys() & other.keys()
                if start + MARGIN <= p <= end - MARGIN and p > trusted and allowed(p)
            ]
            if common_starts:
                break
            widened += 1
            if start <= trusted:
                # Nothing in the whole left chunk agrees: encode both chunks as one.
                chunk = chunk * 2
                end = min(len(text), begin + chunk)
                left = tok.encode(text[begin:end], add_special_tokens=False)
                own, wide = _starts(left, begin), overlap
                if end == len(text):
                    break
                continue
            wide *= 2
        if end == len(text):
            break
        middle = (max(common_starts) + min(common_starts)) // 2
        p = min(common_starts, key=lambda x: (abs(x - middle), x))
        total += own[p] - counted_from
        counted_from, trusted = other[p], p
        begin, end, left = start, stop, right
    return total + len(left) - counted_from, widened


def _count_batches(vocabulary: str, chunk: int, overlap: int):
    plain = regex.compile(PLAIN.replace(r"\z", r"\Z")).match

    def run(batches) -> Iterator:
        counter, marks = Counter(vocabulary), special_strings(vocabulary)
        for pdf in batches:
            texts = pdf["text"].tolist()
            counts = [0] * len(texts)
            for k in range(0, len(texts), 256):
                fast, slow = [], []
                for i in range(k, min(len(texts), k + 256)):
                    t = texts[i]
                    if len(t) > chunk:
                        counts[i] = spliced(t, vocabulary, chunk, overlap)[0]
                    elif plain(t) and not any(s in t for s in marks):
                        fast.append(i)
                    else:
                        slow.append(i)
                for rows, way in ((fast, counter.plain), (slow, counter.whole)):
                    for i, n in zip(rows, way([texts[i] for i in rows]), strict=True):
                        counts[i] = n
            yield pdf.drop(columns="text").assign(n_tokens=counts)

    return run


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str = VOCABULARY,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``keep`` columns with ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text."""
    body: Column = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        *[docs[c] for c in keep], F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text")
    )
    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("n_tokens", "long")
    return rows.mapInPandas(_count_batches(vocabulary, chunk_chars, overlap_chars), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it passes the limit of 512 tokens."""
    counted = count_tokens(common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
