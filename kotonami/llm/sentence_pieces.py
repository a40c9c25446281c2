"""SentencePiece encoding and decoding through a table of distinct chunks (op11).

The vocabulary is a BPE whose pieces hold whitespace markers only at their front, so no merge joins
a marker to the character before it. A text, its spaces turned into markers and one marker put before
it, therefore falls into marked words (markers, then characters other than markers) that are segmented
independently. Each worker keeps a table of the distinct marked words it has met: the library segments
each once, and the ids are put back by position. Decoding goes by the same words, each decoded once.

The table belongs to a worker, not to the cluster: nothing is shuffled, a frequent word is no hot key,
and a lost executor costs the rereading of its own rows. It is emptied when it holds ``REMEMBERED``
characters, which costs time and changes no result. ``splits_at_markers`` tells whether a vocabulary allows
all this; another one is refused.

Null counts as empty text: no ids, empty decoded text. Repeated rows are encoded each on its own.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of the chunks that a worker's table holds at most.
REMEMBERED = 16_000_000
#: Characters of text that are encoded before their rows are handed on.
STEP_CHARS = 2_000_000
#: Marked words; a run of markers at the end is one of its own.
CHUNKS = re.compile(f"{MARK}*+[^{MARK}]+|{MARK}+")


@functools.cache
def processor(model: str):
    """The library's processor, one for each Python worker."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


@functools.cache
def splits_at_markers(model: str) -> bool:
    """Whether no piece has a marker after another character, and normalising only puts markers for spaces and one before the text."""
    own = processor(model)
    pieces = map(own.id_to_piece, range(own.get_piece_size()))
    kept = own.encode("  a 　b  ", out_type=str)
    return all(MARK not in p.lstrip(MARK) for p in pieces) and "".join(kept) == f"{MARK * 3}a{MARK}　b{MARK * 2}"


def chunks(text: str) -> list[str]:
    """The marked words of ``text``, in order."""
    return CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else []


class Table:
    """Distinct marked words with their ids and their decoded text."""

    def __init__(self, model: str):
        if not splits_at_markers(model):
            raise ValueError(f"pieces of {model} cross whitespace markers")
        self.own, self.held = processor(model), 0
        self.known: dict[str, tuple[np.ndarray, str]] = {}
        self.mark, self.lead = self.own.piece_to_id(MARK), self.own.piece_to_id("a")

    def learn(self, words: set[str]) -> None:
        """Segment those of ``words`` that are new, each once."""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        new = [w for w in words if w not in self.known]
        # The library puts the first marker itself; for a lone marker there would be no text.
        ids = self.own.encode([w[1:] for w in new], num_threads=1)
        ids = [own or [self.mark] for own in ids]
        # A letter before them keeps the library from taking away the first marker.
        texts = self.own.decode([[self.lead, *own] for own in ids], num_threads=1)
        for word, own, text in zip(new, ids, texts, strict=True):
            self.known[word] = np.array(own, np.int32), text[1:]
            self.held += len(word)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids and decoded text of each text."""
        cut = [chunks(t) for t in texts]
        self.learn(set().union(*cut))
        ids, decoded = [], []
        for words in cut:
            found = [self.known[w] for w in words]
            ids.append(np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int32))
            decoded.append("".join([f[1] for f in found])[1:])  # the marker before the text goes again
        return ids, decoded


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STEP_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _encode_batches(model: str, names: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        table = Table(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for begin, end in _steps(texts):
                ids, decoded = table.encode(texts[begin:end])
                offsets = np.concatenate([[0], np.cumsum([len(own) for own in ids])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                kept = [batch.column(k).slice(begin, end - begin) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, listed, pa.array(decoded, pa.string())], names)

    return run


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """``keep`` columns with ``ids`` (array of int) of each row's whole text and ``decoded``, the text of these ids."""
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("text of pieces"))
    schema = T.StructType(rows.schema.fields[:-1]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return rows.mapInArrow(_encode_batches(model, schema.names), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and digests of the ids and of the decoded text."""
    rows = encode(common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
