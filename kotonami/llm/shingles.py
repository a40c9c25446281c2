"""Word shingles of normalised texts, hashed batch-wise with numpy.

``hashed_shingles`` takes an Arrow string column of texts made by ``common.normalised`` (words
separated by one space) and gives a 64-bit hash of every run of ``width`` words. A text with fewer
words gives one shingle of all its words, an empty one none. Batches are worked off in pieces of a
few MB, so the memory does not follow the batch; a document longer than a piece is cut with an
overlap of ``width - 1`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, PIECE_BYTES + 1)
_DOWN = _powers(_INVERSE, PIECE_BYTES + 1)


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``raw`` (bytes, words parted by single spaces)."""
    gap = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gap + 1))
    ends = np.concatenate((gap, [len(raw)]))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * _DOWN[starts]
    return starts, ends, mix(own + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def word_pieces(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(document index of each word, starts, ends, hashes, offset of the piece) piece by piece.

    A text longer than a piece is given in several; each later one begins ``width - 1`` words early.
    """
    raw, at = buffers(column)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(at, at[i] + PIECE_BYTES, side="right")) - 1
        if j > i:
            # Spaces between the texts keep the last word of one and the first of the next apart.
            filled = [k for k in range(i, j) if at[k + 1] > at[k]]
            if filled and sum(int(at[k + 1] - at[k]) + 1 for k in filled) <= PIECE_BYTES + 1:
                joined = np.full(sum(int(at[k + 1] - at[k]) + 1 for k in filled) - 1, 32, dtype=np.uint8)
                place, shift = 0, np.empty(len(filled), dtype=np.int64)
                edge = np.empty(len(filled), dtype=np.int64)
                for n, k in enumerate(filled):
                    size = int(at[k + 1] - at[k])
                    joined[place : place + size] = raw[at[k] : at[k + 1]]
                    edge[n], shift[n] = place, int(at[k]) - place
                    place += size + 1
                starts, ends, own = _word_hashes(joined)
                which = np.searchsorted(edge, starts, side="right") - 1
                move = shift[which]
                yield np.asarray(filled)[which], starts + move, ends + move, own, 0
                i = j
                continue
            if not filled:
                i = j
                continue
            j = i + max(1, (j - i) // 2)
            sub = range(i, j)
        else:
            sub = range(i, i + 1)
        for k in sub:
            begin, end = int(at[k]), int(at[k + 1])
            while begin < end:
                stop = min(end, begin + PIECE_BYTES)
                if stop < end:
                    back = np.flatnonzero(raw[begin:stop] == 32)
                    if len(back) >= width:
                        stop = begin + int(back[-1])
                    else:
                        # Words longer than a piece: hash them alone, byte ranges of any length.
                        yield from _long_words(raw, begin, end, k, width)
                        break
                starts, ends, own = _word_hashes(raw[begin:stop])
                yield np.full(len(starts), k), starts + begin, ends + begin, own, 0
                if stop >= end:
                    break
                begin = begin + int(starts[len(starts) - width + 1]) if width > 1 else stop + 1
        i = sub[-1] + 1


def _long_words(raw: np.ndarray, begin: int, end: int, k: int, width: int):
    """The rest of a text whose words do not fit a piece: each is hashed over its slices."""
    gap = np.flatnonzero(raw[begin:end] == 32) + begin
    starts = np.concatenate(([begin], gap + 1))
    ends = np.concatenate((gap, [end]))
    own = np.empty(len(starts), dtype=np.uint64)
    for n, (s, e) in enumerate(zip(starts, ends, strict=True)):
        value = np.uint64(0)
        for p in range(int(s), int(e), PIECE_BYTES):
            part = raw[p : min(int(e), p + PIECE_BYTES)]
            value = value * np.uint64(31) + (
                (part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)]
            ).sum(dtype=np.uint64)
        own[n] = value + np.uint64(e - s)
    yield np.full(len(starts), k), starts, ends, mix(own), 0


def hashed_shingles(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document index, hash, first byte, last byte) of each shingle, piece by piece.

    Indices of documents never fall; a document's shingles may repeat.
    """
    with np.errstate(over="ignore"):
        for which, starts, ends, own, _ in word_pieces(column, width):
            n = len(which)
            if n >= width:
                total = own[: n - width + 1].copy()
                for k in range(1, width):
                    total = total * np.uint64(0xD6E8FEB86659FD93) + own[k : n - width + 1 + k]
                whole = which[: n - width + 1] == which[width - 1 :]
                hashes = mix(total[whole] + np.uint64(width))
                first, last = starts[: n - width + 1][whole], ends[width - 1 :][whole]
                of = which[: n - width + 1][whole]
            else:
                hashes, first, last, of = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
            # Texts shorter than a shingle: one of all their words.
            edges = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            counts = np.diff(np.concatenate((edges, [n])))
            short = np.flatnonzero(counts < width)
            if len(short):
                extra = np.zeros(len(short), dtype=np.uint64)
                for m, s in enumerate(short):
                    for k in range(int(counts[s])):
                        extra[m] = extra[m] * np.uint64(0xD6E8FEB86659FD93) + own[edges[s] + k]
                    extra[m] += np.uint64(counts[s])
                e = edges[short]
                of = np.concatenate((of, which[e]))
                hashes = np.concatenate((hashes, mix(extra)))
                first = np.concatenate((first, starts[e]))
                last = np.concatenate((last, ends[e + counts[short] - 1]))
                order = np.argsort(of, kind="stable")
                of, hashes, first, last = of[order], hashes[order], first[order], last[order]
            yield of, hashes, first, last
