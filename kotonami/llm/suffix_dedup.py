"""Removal of repeated byte strings by external induced suffix sorting (op10).

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus is removed.

* Anchors. In each string of ``LENGTH`` bytes the ``GRAM``-byte substrings of least hash are its anchors; they
  depend on its content alone. An anchor's context is the bytes of all strings that can hold it. One pass over the texts
  gives every anchor with its place and a digest of its context; what repeats within a batch leaves at once.
* Classes. Sorted by anchor, digest and place, equal contexts stand together: the first place has all their strings
  earlier, so every other one is covered as a whole. Anchors that occur once end here. Equality is that of
  the anchor's hash (64 bits) and of two digests of the context (89 bits), not of bytes.
* Samples. Where an anchor stands in different contexts, their first places send suffix tuples to the sort. A string
  has at most ``HALF`` bytes before the anchor or at most ``HALF`` before the place ``HALF`` bytes earlier, so
  each context gives two tuples, one for either place: the suffix there and the ``HALF`` bytes before it. Strings that
  hold the place share ``SHARED`` bytes from it on: tuples meet by the hash of these, which
  splits a common phrase by what follows it. Spark's external sort orders the tuples by suffix.
* Induction. The sorted tuples, with the common prefix of each and the one before, enter a queue. From it the order of
  the suffixes one byte earlier follows: tuples are taken in order and put into a priority queue by their preceding
  byte, equal bytes in order of arrival; the common prefix of neighbours there is one more than the least one between
  them before. Each byte's tuples, in turn, are induced in the same way: the recursion ends
  ``HALF`` bytes before the place. At each depth a string's copies are the runs whose common prefix reaches ``LENGTH``;
  all but the first are marked. Queues hold some ``MEMORY_ROWS`` tuples in memory and the rest in files of the shared folder, and
  tuples carry their place, so a group far larger than memory is never held as a whole.

Only ``LENGTH`` bytes are ever compared, so the samples are in order after one sort. Tuples whose common prefix cannot
reach ``LENGTH`` any more leave early.

Defined results: a null text is empty; texts under ``LENGTH`` bytes stay whole; rows under one id are put in
order by their text and count as documents of their own, a null id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

LENGTH = 100
GRAM = 32
BEFORE = LENGTH - GRAM
HALF = BEFORE // 2
SHARED = LENGTH - HALF
#: Tuples that the queues of a task hold in memory.
MEMORY_ROWS = 50_000
#: ``at`` holds a second digest, the position and the number of bytes from it on, up to ``LENGTH``.
POSITION_BITS, AFTER_BITS = 31, 7
PIECE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UP = shingles._powers(_BASE, PIECE_BYTES + 4 * LENGTH)
_DOWN = shingles._powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), PIECE_BYTES + 4 * LENGTH)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER_UP = shingles._powers(_OTHER, PIECE_BYTES + 4 * LENGTH)
_OTHER_DOWN = shingles._powers(np.uint64(pow(int(_OTHER), -1, 1 << 64)), PIECE_BYTES + 4 * LENGTH)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` values in a row."""
    have, out = 1, values
    while have * 2 <= width:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    return best(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all anchors of a text of ``LENGTH`` bytes or more, given whole or as a piece."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=sums[1:])
        hashes = shingles.mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(raw) - GRAM + 1])
    order = (hashes >> np.uint64(32)).astype(np.uint32)
    width = BEFORE + 1
    least = _sliding(order, width, np.minimum)
    # A gram is an anchor if it is the least of any string that holds it.
    padded = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == order)
    return at, hashes[at]


def text_anchors(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Anchors of a text of any length, piece by piece; pieces overlap, no anchor comes twice."""
    for begin in range(0, max(1, len(raw) - LENGTH + 1), PIECE_BYTES):
        piece = raw[max(0, begin - LENGTH) : begin + PIECE_BYTES + 2 * LENGTH]
        if len(piece) < LENGTH:
            return
        at, hashes = anchors(piece)
        at = at + max(0, begin - LENGTH)
        own = (at >= begin) & (at < begin + PIECE_BYTES)
        if begin + PIECE_BYTES > len(raw) - LENGTH:
            own = at >= begin
        yield at[own], hashes[own]
        if begin + PIECE_BYTES > len(raw) - LENGTH:
            return


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        raw, at = shingles.buffers(batch.column(1))
        for seq, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
            yield seq, raw[a:b]


def _slices(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of ``raw`` as a binary array, in one copy."""
    sizes = end - begin
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[index])])


def _range_hashes(raw: np.ndarray, low: np.ndarray, high: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; ranges are in order and lie within a piece."""
    base = int(low.min())
    with np.errstate(over="ignore"):
        own = raw[base : int(high.max())].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(own * up[: len(own)], out=sums[1:])
        return (sums[high - base] - sums[low - base]) * down[low - base]


def _pieces_of(at: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted positions in parts that lie within ``PIECE_BYTES``."""
    begin = 0
    while begin < len(at):
        end = int(np.searchsorted(at, at[begin] + PIECE_BYTES))
        yield at[begin:end]
        begin = end


def _context_digests(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of the bytes around each anchor of a piece and of where in them it stands."""
    low, high = np.maximum(at - BEFORE, 0), np.minimum(at + LENGTH, len(raw))
    with np.errstate(over="ignore"):
        shape = shingles.mix(((at - low) * 256 + (high - at)).astype(np.uint64))
        return (
            shingles.mix(_range_hashes(raw, low, high, _UP, _DOWN) ^ shape),
            shingles.mix(_range_hashes(raw, low, high, _OTHER_UP, _OTHER_DOWN) ^ shape),
        )


def _context(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of the context of each packed place."""
    pos = (at >> AFTER_BITS) & ((1 << POSITION_BITS) - 1)
    return np.maximum(pos - BEFORE, 0), pos + (at & ((1 << AFTER_BITS) - 1))


def _merged(seq: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that hold a string at all, those that overlap or touch put together."""
    long = high - low >= LENGTH
    order = np.lexsort((high[long], low[long], seq[long]))
    seq, low, high = seq[long][order], low[long][order], high[long][order]
    # In a text the last bytes are in the order of the first.
    begin = np.ones(len(seq), dtype=bool)
    begin[1:] = (seq[1:] != seq[:-1]) | (low[1:] > high[:-1])
    first = np.flatnonzero(begin)
    return seq[first], low[first], high[np.append(first[1:], len(seq)) - 1] if len(first) else high[:0]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, text) -> (known, h, digest, seq, at) of every anchor.

    Where an anchor's context stands earlier in the same batch, its range is ``known``: these ranges are put together to
    rows that hold their ends (``digest``, ``at``) and may go to any task, so that a context that repeats very often is no hot key.
    """
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def out() -> pa.RecordBatch:
        h, digest, seq, at = (np.concatenate(c) for c in zip(*held, strict=True))
        check = at >> (POSITION_BITS + AFTER_BITS)
        order = np.lexsort((at, seq, check, digest, h))
        h, digest, seq, at, check = h[order], digest[order], seq[order], at[order], check[order]
        known = np.zeros(len(h), dtype=bool)
        known[1:] = (h[1:] == h[:-1]) & (digest[1:] == digest[:-1]) & (check[1:] == check[:-1])
        own, low, high = _merged(seq[known], *_context(at[known]))
        with np.errstate(over="ignore"):
            any_task = shingles.mix(low.view(np.uint64) + own.view(np.uint64) * _BASE).view(np.int64)
        new = ~known
        columns = [np.arange(len(own) + new.sum()) < len(own)]
        columns += [np.concatenate(c) for c in ((any_task, h[new]), (low, digest[new]), (own, seq[new]), (high, at[new]))]
        return pa.record_batch([pa.array(c) for c in columns], names=["known", "h", "digest", "seq", "at"])

    for seq, raw in _texts(batches):
        if len(raw) < LENGTH:
            continue
        for at, hashes in text_anchors(raw):
            if not len(at):
                continue
            digest, check = _context_digests(raw, at)
            packed = check.astype(np.int64) << (POSITION_BITS + AFTER_BITS)
            packed |= (at.astype(np.int64) << AFTER_BITS) | np.minimum(len(raw) - at, LENGTH)
            held.append((hashes.view(np.int64), digest.view(np.int64), np.full(len(at), seq, dtype=np.int64), packed))
            n += len(at)
            if n >= 50_000:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted anchors -> (asked, seq, low, high).

    The ranges of contexts that stand earlier, and, ``asked``, the places (``low``) whose anchor has different contexts.
    """
    last: tuple[int, int, int] | None = None  # anchor and digests of the row before
    waiting: tuple[int, int] | None = None  # place of the only context so far of that anchor
    for batch in batches:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        h, digest, seq, at = (batch.column(c).to_numpy() for c in ("h", "digest", "seq", "at"))
        check = at >> (POSITION_BITS + AFTER_BITS)
        pos = (at >> AFTER_BITS) & ((1 << POSITION_BITS) - 1)
        low, high = _context(at)
        low, high = np.where(known, digest, low), np.where(known, at, high)
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])
        if len(h) and last is not None:
            first[0] = last != (int(h[0]), int(digest[0]), int(check[0]))
        first &= ~known
        other = ~first
        other &= high - low >= LENGTH
        begin = np.flatnonzero(first)
        asked_seq, asked_pos = [], []
        if len(begin):
            own = h[begin]
            same = np.zeros(len(begin) + 1, dtype=bool)  # as the anchor of the class before
            same[1:-1] = own[1:] == own[:-1]
            same[0] = last is not None and last[0] == int(own[0])
            if same[0] and waiting is not None:
                asked_seq.append([waiting[0]])
                asked_pos.append([waiting[1]])
            asked = same[:-1] | same[1:]
            asked_seq.append(seq[begin[asked]])
            asked_pos.append(pos[begin[asked]])
            end = begin[-1]
            waiting = None if asked[-1] else (int(seq[end]), int(pos[end]))
        if (~known).any():
            end = int(np.flatnonzero(~known)[-1])
            last = (int(h[end]), int(digest[end]), int(check[end]))
        points = np.concatenate(asked_pos).astype(np.int64) if asked_pos else np.zeros(0, np.int64)
        of = np.concatenate(asked_seq).astype(np.int64) if asked_seq else np.zeros(0, np.int64)
        columns = [
            pa.array(np.arange(len(of) + other.sum()) < len(of)),
            pa.array(np.concatenate([of, seq[other]])),
            pa.array(np.concatenate([points, low[other]])),
            pa.array(np.concatenate([points, high[other]])),
        ]
        yield pa.record_batch(columns, names=["asked", "seq", "low", "high"])


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, doc_id, text, asked positions) -> (key, seq, pos, before, after): the suffix tuples of each context."""
    for batch in batches:
        raw_all, at_all = shingles.buffers(batch.column("text"))
        for n, seq in enumerate(batch.column("seq").to_pylist()):
            raw = raw_all[at_all[n] : at_all[n + 1]]
            asked = batch.column("asked")[n].values.to_numpy()
            points = np.unique(np.concatenate([asked, asked - HALF]))
            points = points[(points >= 0) & (points + SHARED <= len(raw))]
            for part in _pieces_of(points):
                for k in range(0, len(part), 20_000):
                    p = part[k : k + 20_000]
                    columns = [
                        pa.array(shingles.mix(_range_hashes(raw, p, p + SHARED, _UP, _DOWN)).view(np.int64)),
                        pa.array(np.full(len(p), seq, dtype=np.int64)),
                        pa.array(p),
                        _slices(raw, np.maximum(p - HALF, 0), p),
                        _slices(raw, p, np.minimum(p + LENGTH, len(raw))),
                    ]
                    yield pa.record_batch(columns, names=["key", "seq", "pos", "before", "after"])


@dataclass
class Tuples:
    """Suffix tuples in sorted order, with the common prefix of each with the one before."""

    seq: np.ndarray  # document and
    pos: np.ndarray  # place in it
    before: np.ndarray  # (n, HALF) bytes before the place, nearest first
    length: np.ndarray  # how many of them there are
    lcp: np.ndarray  # uint8

    def take(self, index, lcp: np.ndarray | None = None) -> Tuples:
        return Tuples(self.seq[index], self.pos[index], self.before[index], self.length[index], self.lcp[index] if lcp is None else lcp)

    def __len__(self) -> int:
        return len(self.seq)


def joined(parts: list[Tuples]) -> Tuples:
    return Tuples(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("seq", "pos", "before", "length", "lcp")))


class RangeMin:
    """Least value of any range, by tables of doubling width."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 ** len(self.tables) <= len(values):
            last, half = self.tables[-1], 2 ** (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of ``begin`` to ``end`` inclusive."""
        out = np.empty(len(begin), dtype=self.tables[0].dtype)
        level = np.log2(end - begin + 1).astype(np.int64)
        for k in np.unique(level):
            own = level == k
            table = self.tables[k]
            out[own] = np.minimum(table[begin[own]], table[end[own] - 2**k + 1])
        return out


def _step(byte: np.ndarray, lcp: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One induction: (old places in the new order, common prefixes there) of the usable tuples."""
    place = np.flatnonzero(usable)
    place = place[np.argsort(byte[place], kind="stable")]
    out = np.zeros(len(place), dtype=np.uint8)
    if len(place) > 1:
        same = np.flatnonzero(byte[place[1:]] == byte[place[:-1]])
        out[same + 1] = RangeMin(lcp)(place[same] + 1, place[same + 1]) + 1
    return place, out


def _usable(t: Tuples, depth: int, beyond: int = 0) -> np.ndarray:
    """Tuples with a byte further before, whose common prefix with a neighbour can still reach LENGTH.

    ``beyond`` stands for the common prefix of the last one and what follows it.
    """
    after = np.append(t.lcp[1:], np.uint8(beyond))
    return (t.length > depth) & (np.maximum(t.lcp, after).astype(np.int32) + (HALF - depth) >= LENGTH)


Place = tuple[int, int]


def _firsts(t: Tuples, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place (document, position) of each run."""
    seq = np.minimum.reduceat(t.seq, runs)
    size = np.diff(np.append(runs, len(t)))
    pos = np.minimum.reduceat(np.where(t.seq == np.repeat(seq, size), t.pos, np.iinfo(np.int64).max), runs)
    return seq, pos


def _marked(t: Tuples, head: Place | None = None, tail: Place | None = None) -> np.ndarray:
    """Which tuples start a string at this depth that an earlier place has, too.

    ``head`` and ``tail`` are the first places of the runs that go on beyond either end.
    """
    runs = np.flatnonzero(t.lcp < LENGTH)
    if len(runs) == len(t) and tail is None:
        return np.zeros(len(t), dtype=bool)
    open_head = not len(runs) or runs[0] != 0
    if open_head:
        runs = np.concatenate(([0], runs))
    seq, pos = _firsts(t, runs)
    if tail is not None:
        seq[-1], pos[-1] = tail
    if open_head and head is not None:
        seq[0], pos[0] = head
    size = np.diff(np.append(runs, len(t)))
    seq, pos = np.repeat(seq, size), np.repeat(pos, size)
    return (t.seq > seq) | ((t.seq == seq) & (t.pos > pos))


class Store:
    """Files of a task in the folder that all machines share; nothing is made before something is written."""

    def __init__(self, folder: str):
        self.folder, self.files, self.written = folder, None, 0

    def write(self, parts: Iterable[np.ndarray]) -> str:
        if self.files is None:
            self.files, self.base = pyarrow.fs.FileSystem.from_uri(self.folder)
            self.files.create_dir(self.base, recursive=True)
        name = f"{self.base}/{self.written}"
        self.written += 1
        with self.files.open_output_stream(name, compression=None) as out:
            for part in parts:
                out.write(np.ascontiguousarray(part).tobytes())
        return name

    def read(self, name: str, sizes: Iterable[int]) -> Iterator[bytes]:
        with self.files.open_input_file(name) as file:
            for size in sizes:
                yield file.read(size)

    def delete(self, name: str) -> None:
        self.files.delete_file(name)

    def close(self) -> None:
        if self.files is not None:
            self.files.delete_dir(self.base)


class Queue:
    """A queue of tuples: appended in order, read in order as often as needed; in the store once spilled."""

    WIDE = ((np.int64, 1), (np.int64, 1), (np.uint8, HALF), (np.uint8, 1), (np.uint8, 1))

    def __init__(self, store: Store):
        self.store = store
        self.spilled: list[tuple[str, list[int]]] = []  # file and sizes of its parts
        self.parts: list[Tuples] = []

    def append(self, t: Tuples) -> None:
        self.parts.append(t)

    def spill(self) -> None:
        if self.parts:
            columns = (c for t in self.parts for c in (t.seq, t.pos, t.before, t.length, t.lcp))
            self.spilled.append((self.store.write(columns), [len(t) for t in self.parts]))
        self.parts = []

    def __iter__(self) -> Iterator[Tuples]:
        for name, sizes in self.spilled:
            widths = [n * wide * np.dtype(kind).itemsize for n in sizes for kind, wide in self.WIDE]
            read = self.store.read(name, widths)
            for n in sizes:
                columns = [np.frombuffer(next(read), dtype=kind).reshape((n, wide) if wide > 1 else n) for kind, wide in self.WIDE]
                yield Tuples(*columns)
        yield from self.parts

    def __len__(self) -> int:
        return sum(sum(sizes) for _, sizes in self.spilled) + sum(map(len, self.parts))

    def close(self) -> None:
        for name, _ in self.spilled:
            self.store.delete(name)
        self.parts, self.spilled = [], []


class PriorityQueue:
    """Tuples by priority, their preceding byte; those of equal priority in order of arrival. Disk-backed:
    when twice ``memory`` tuples are held all of them go to the store."""

    def __init__(self, store: Store, memory: int):
        self.store, self.memory, self.held = store, memory, 0
        self.by: dict[int, Queue] = {}
        # Of each priority: the last tuple's common prefix with what has come since, None before the first.
        self.carried = np.zeros(256, dtype=np.uint8)
        self.met = np.zeros(256, dtype=bool)

    def insert(self, t: Tuples, depth: int, more: bool) -> None:
        """All usable tuples of the next chunk in order, with their common prefixes one byte earlier."""
        place, lcp = _step(t.before[:, depth], t.lcp, _usable(t, depth, 255 if more else 0))
        own = t.before[place, depth]
        edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(own))
        upto = np.minimum.accumulate(t.lcp)
        for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
            c = int(own[a])
            lcp[a] = min(int(self.carried[c]), int(upto[place[a]])) + 1 if self.met[c] else 0
            self.by.setdefault(c, Queue(self.store)).append(t.take(place[a:b], lcp[a:b]))
        behind = np.minimum.accumulate(t.lcp[::-1])[::-1]
        self.carried = np.minimum(self.carried, upto[-1])
        for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
            last = int(place[b - 1])
            self.met[own[a]] = True
            self.carried[own[a]] = behind[last + 1] if last + 1 < len(t) else 255
        self.held += len(place)
        if self.held > 2 * self.memory:
            for queue in self.by.values():
                queue.spill()
            self.held = 0

    def __iter__(self) -> Iterator[Queue]:
        """The queue of each priority, least first."""
        for c in sorted(self.by):
            yield self.by.pop(c)


def _edges(queue: Queue) -> list[tuple[Place | None, Place | None]]:
    """By chunk: first place of the run that it begins in, and of the run that it ends in, over all chunks."""
    ends: list[tuple[Place | None, Place | None]] = []
    for t in queue:
        runs = np.flatnonzero(t.lcp < LENGTH)
        least = lambda part: min(zip(part.seq.tolist(), part.pos.tolist(), strict=True))
        head = None if len(runs) and runs[0] == 0 else least(t.take(slice(0, runs[0] if len(runs) else None)))
        ends.append((head, least(t.take(slice(int(runs[-1]), None))) if len(runs) else None))
    out: list[list[Place | None]] = [[None, None] for _ in ends]
    group: list[tuple[int, int]] = []  # (chunk, side) of one run over several chunks
    first: Place | None = None
    for k, (head, tail) in enumerate(ends):
        if head is not None:
            group.append((k, 0))
            first = head if first is None else min(first, head)
            if tail is None:  # the whole chunk is of this run
                group.append((k, 1))
        if tail is not None:
            for i, side in group:
                out[i][side] = first
            group, first = [(k, 1)], tail
    for i, side in group:
        out[i][side] = first
    return [(a, b) for a, b in out]


def induce_in_memory(t: Tuples, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first, last byte) of the marked strings, from ``depth`` bytes before the places on.

    The marked depths of a tuple are put together: they lie less than a string's length apart.
    """
    seq, pos, row = t.seq, t.pos, np.arange(len(t))
    low, high = np.full(len(t), 255), np.full(len(t), -1)
    while len(t):
        rows = row[_marked(t)]
        low[rows] = np.minimum(low[rows], depth)
        high[rows] = np.maximum(high[rows], depth)
        if depth == HALF:
            break
        place, lcp = _step(t.before[:, depth], t.lcp, _usable(t, depth))
        t, row = t.take(place, lcp), row[place]
        depth += 1
    hit = high >= 0
    if hit.any():
        yield seq[hit], pos[hit] - high[hit], pos[hit] - low[hit] + LENGTH


def induce(queue: Queue, depth: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of a queue of any length, which is closed when done."""
    if len(queue) <= memory:
        parts = list(queue)
        queue.close()
        if parts:
            yield from induce_in_memory(joined(parts), depth)
        return
    for t, (head, tail) in zip(queue, _edges(queue), strict=True):
        hit = _marked(t, head, tail)
        if hit.any():
            yield t.seq[hit], t.pos[hit] - depth, t.pos[hit] - depth + LENGTH
    if depth < HALF:
        earlier, left = PriorityQueue(queue.store, memory), len(queue)
        for t in queue:
            left -= len(t)
            earlier.insert(t, depth, left > 0)
        queue.close()
        for own in earlier:
            yield from induce(own, depth + 1, memory)
    queue.close()


def _matrix(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as rows of ``width`` bytes (zeros fill up) and its lengths."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    sizes = np.diff(offsets)
    step = np.arange(width)
    index = offsets[1:, None] - 1 - step if backwards else offsets[:-1, None] + step
    return np.where(step < sizes[:, None], raw[np.clip(index, 0, len(raw) - 1)], 0).astype(np.uint8), sizes


def _sorted_tuples(batch: pa.RecordBatch, last: tuple[int, np.ndarray, int] | None):
    """(key, tuples of a sorted batch, state of its last row); ``last`` is the state of the batch before."""
    key = batch.column("key").to_numpy()
    before, length = _matrix(batch.column("before"), HALF, True)
    after, size = _matrix(batch.column("after"), LENGTH, False)
    lcp = np.zeros(len(key), dtype=np.uint8)
    unlike = after[1:] != after[:-1]
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), LENGTH)
    lcp[1:] = np.where(key[1:] == key[:-1], np.minimum(first, np.minimum(size[1:], size[:-1])), 0)
    if last is not None and last[0] == key[0]:
        unlike = after[0] != last[1]
        lcp[0] = min(int(unlike.argmax()) if unlike.any() else LENGTH, int(size[0]), last[2])
    t = Tuples(batch.column("seq").to_numpy(), batch.column("pos").to_numpy(), before, length.astype(np.uint8), lcp)
    return key, t, (int(key[-1]), after[-1], int(size[-1]))


def _induced(folder: str, memory: int):
    """Batches sorted by key and suffix -> (asked, seq, low, high) of the strings that stand earlier."""

    def induced(queue: Queue) -> Iterator[pa.RecordBatch]:
        for seq, low, high in induce(queue, 0, memory):
            columns = [pa.array(np.zeros(len(seq), dtype=bool)), pa.array(seq), pa.array(low), pa.array(high)]
            yield pa.record_batch(columns, names=["asked", "seq", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store = Store(f"{folder}/{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}")
        queue, state, held = Queue(store), None, 0
        for batch in batches:
            for k in range(0, len(batch), 20_000):
                key, t, state = _sorted_tuples(batch.slice(k, 20_000), state)
                # What fills the memory is worked off where a key begins.
                new = np.flatnonzero(np.concatenate(([t.lcp[0] == 0], key[1:] != key[:-1])))
                cut = int(new[-1]) if len(new) and len(queue) + new[-1] >= memory else 0
                if cut or (len(new) and new[0] == 0 and len(queue) >= memory):
                    queue.append(t.take(slice(0, cut)))
                    yield from induced(queue)
                    queue, held, t = Queue(store), 0, t.take(slice(cut, None))
                queue.append(t)
                held += len(t)
                if held > 2 * memory:
                    queue.spill()
                    held = 0
        yield from induced(queue)
        store.close()

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, doc_id, text, ranges) -> counts and digest of what stays."""
    for batch in batches:
        out = []
        raw, at = shingles.buffers(batch.column("text"))
        for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            own = raw[at[k] : at[k + 1]]
            ranges = batch.column("ranges")[k].values
            if ranges is None or not len(ranges):
                out.append((doc_id, len(own), 0, 0, hashlib.sha256(own).hexdigest()))
                continue
            low, high = (ranges.field(n).to_numpy() for n in (0, 1))
            change = np.zeros(len(own) + 1, dtype=np.int32)
            np.add.at(change, low, 1)
            np.add.at(change, high, -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((doc_id, len(own), int(gone.sum()), spans, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names) if out else pa.record_batch([pa.array([], t) for t in kinds], names=names)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``seq``, unique and in the order of the documents."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").take(1):
        ordered = docs.orderBy("doc_id", F.sha2("text", 256)).withColumn("seq", F.monotonically_increasing_id())
        return common.staged(ordered, "suffix-rows")
    return docs.withColumn("seq", F.col("doc_id").cast("long"))


_RANGES = "asked boolean, seq long, low long, high long"


def repeated_ranges(texts: DataFrame, memory: int = MEMORY_ROWS) -> DataFrame:
    """(seq, low, high): byte ranges of ``texts`` (seq, doc_id, text) covered by strings that start earlier."""
    check = F.shiftright("at", POSITION_BITS + AFTER_BITS)
    anchors_of = texts.select("seq", "text").mapInArrow(_anchor_rows, "known boolean, h long, digest long, seq long, at long")
    classes = anchors_of.repartition("h").sortWithinPartitions("known", "h", "digest", check, "seq", "at").mapInArrow(_classes, _RANGES)
    classes = common.staged(classes, "suffix-classes")
    asked = classes.where("asked").groupBy("seq").agg(F.collect_list("low").alias("asked"))
    tuples = texts.join(asked, "seq").select("seq", "doc_id", "text", "asked").mapInArrow(
        _tuples, "key long, seq long, pos long, before binary, after binary"
    )
    folder = common.passing_folder(texts.sparkSession, common.new_folder(texts.sparkSession, "suffix-queues"))
    induced = tuples.repartition("key").sortWithinPartitions("key", "after").mapInArrow(_induced(folder, memory), _RANGES)
    return classes.where("NOT asked").unionByName(induced).select("seq", "low", "high")


def remove_repeats(docs: DataFrame, memory: int = MEMORY_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("seq", "doc_id", "text")
    rows = rows.where("seq IS NOT NULL")  # drops nothing; both joins below then see the same texts
    ranges = repeated_ranges(rows, memory).groupBy("seq").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    # Joined by seq as in ``repeated_ranges``, so that the texts are shuffled once for both.
    joined_rows = rows.join(ranges, "seq", "left").select("seq", "doc_id", "text", "ranges")
    return joined_rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when strings of 100 bytes that start earlier are removed."""
    return remove_repeats(common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text"))
