"""Words of whole Arrow batches as numpy arrays: borders, documents, 64-bit hashes, hashes of word runs.

A task handles its rows in slices of a few megabytes of text, so memory follows the slice (or the one
longest text), never the batch or the partition. Words are runs of allowed bytes of the UTF-8 form, which
is the same as runs of allowed characters when all bytes from 0x80 up are allowed together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def byte_table(allowed) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(allowed)] = True
    return table


#: Everything but space and the control characters 9 to 13.
SPACED = ~byte_table([0x20, *range(9, 14)])
#: Letters, digits and everything beyond ASCII; ``lower_ascii`` comes first.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = base
        np.cumprod(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix finalizer, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a few texts: byte borders in ``data``, and for text i the words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: differences of one prefix sum of weighted bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", _P, n), out=total[1:])
        return mix((total[self.stops] - total[self.starts]) * _power("down", _P_INVERSE, n + 1)[self.starts])

    def text(self, a: int, b: int) -> bytes:
        """The words a to b - 1, joined by one space."""
        data, starts, stops = self.data, self.starts, self.stops
        return b" ".join(data[starts[i] : stops[i]].tobytes() for i in range(a, b))


def split(texts: pa.Array, table: np.ndarray, lower_ascii: bool = False) -> Words:
    """Words of each text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower_ascii:
        data = _LOWER[data]
    n = len(data)
    inside = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places hold nothing of use."""
    total = np.zeros(len(hashes), np.uint64)
    n = len(hashes)
    for j in range(min(k, n)):
        total *= _P
        total[: n - j] += hashes[j:]
    return mix(total)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in groups of about ``most`` bytes of text; a longer text is a group of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(borders, borders[1:]):
        yield batch.slice(a, b - a)


def stretch_hash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each stretch of values a to b - 1, whatever stands before it; stretches may overlap."""
    n = len(hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power("up", _P, n), out=total[1:])
    return mix((total[b] - total[a]) * _power("down", _P_INVERSE, n + 1)[a])


def total_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each group ``first[i]`` to ``first[i + 1]`` of values, in their order."""
    place = np.arange(len(values)) - np.repeat(first[:-1], np.diff(first))
    weighted = mix(values + place.astype(np.uint64) * _P)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
