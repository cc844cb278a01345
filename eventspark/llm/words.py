"""Words of many texts at once as 64-bit hashes, by numpy over the UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2**64, taken as a difference of running sums, then mixed. Equal
words get equal hashes everywhere. Two of n different words share one with a chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes hashed at a time, and bytes of text handled at a time by the operators.
STEP, SLICE = 1 << 19, 4 << 20

#: Byte classes, as numpy lookup tables: everything but space and the controls 9 to 13; digits, a-z and all above ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over the word."""
    h = (h ^ (h >> U(30))) * _MIX1
    h = (h ^ (h >> U(27))) * _MIX2
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


_P = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_P, STEP + 1), _powers(pow(_P, -1, 1 << 64), STEP + 1)
_LETTER = mix(np.arange(1, 257, dtype=U) * _BASE)


def word_hashes(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every maximal run of letters in the bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = letters[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    del inside, edge
    out = np.empty(len(start), U)
    k = 0
    while k < len(start):
        base = start[k]
        last = max(int(np.searchsorted(end, base + STEP, "right")), k + 1)
        stop = int(end[last - 1])
        if stop - base > STEP:  # one word beyond a step: fold its steps
            h = U(0)
            for at in range(base, stop, STEP):
                part = _LETTER[data[at : min(at + STEP, stop)]]
                h = _fold(h, part)
            out[k] = h
        else:
            total = np.zeros(stop - base + 1, U)
            np.cumsum(_LETTER[data[base:stop]] * _UP[: stop - base], out=total[1:])
            s, e = start[k:last] - base, end[k:last] - base
            out[k:last] = (total[e] - total[s]) * _DOWN[s] + (e - s).astype(U)
        k = last
    return mix(out), start, end


def _fold(h: np.uint64, part: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return U(h * _BASE + (part * _UP[: len(part)]).sum(dtype=U))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, by its first word; shorter input gives none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _BASE
        out += words[k : k + n]
    return mix(out)


class Texts:
    """Some texts as one byte array, a line feed after each."""

    def __init__(self, texts: list[bytes], lower: bool):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate([[0], np.cumsum(size)])

    def words(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start, end of the words, and for each text the number of words before it (one more at the end)."""
        h, start, end = word_hashes(self.data, letters)
        return h, start, end, np.searchsorted(start, self.offset)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], place: int, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows with about `size` bytes of text, which is column number `place`; one row may be larger."""
    for batch in batches:
        values = utf8(batch.column(place))
        at = held = 0
        for k, value in enumerate(values):
            n = len(value) if value else 0
            if held and held + n > size:
                yield batch.slice(at, k - at), values[at:k]
                at, held = k, 0
            held += n + 16
        if at < len(values):
            yield batch.slice(at), values[at:]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])[:-1]


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i; an empty run gives 0. Sums run within a segment only."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out
