"""Words, shingles and their hashes for whole Arrow batches of texts.

A word is a run of ASCII letters and digits and any characters beyond ASCII; A-Z count as a-z. All work is done on
the UTF-8 bytes of many texts at once. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on together; one longer text is taken alone.
SLICE_BYTES = 1 << 18
_STEP, _BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    letters = np.arange(256)
    upper = (letters >= 65) & (letters <= 90)
    word = upper | ((letters >= 97) & (letters <= 122)) | ((letters >= 48) & (letters <= 57)) | (letters >= 128)
    folded = np.where(upper, letters + 32, letters)
    values = mix(folded.astype(U) + U(1))
    return word, values


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


WORD, VALUE = _classes()
_powers = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of some texts: `first` and `end` are byte places, `bounds[i]:bounds[i + 1]` are the words of text i."""

    first: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray
    rows: range

    def hashes(self, length: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first bytes."""
        end = self.end if length is None else np.minimum(self.end, self.first + length)
        back = _tables(len(self.sums))[1]
        return mix((self.sums[end] - self.sums[self.first]) * back[self.first])


def plain_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text begins and ends in them."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def slices(places: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many bytes, or one text."""
    i, n = 0, len(places) - 1
    while i < n:
        j = int(np.searchsorted(places, places[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(column: pa.Array) -> Iterator[Words]:
    """The words of all texts of a column, some texts at a time."""
    raw, places = plain_bytes(column)
    for i, j in slices(places):
        part, at = raw[places[i] : places[j]], places[i : j + 1] - places[i]
        inside = np.zeros(len(part) + 1, bool)
        inside[:-1] = WORD[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = at[(at > 0) & (at < len(part))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(VALUE[part] * _tables(len(part) + 1)[0][: len(part)], out=sums[1:])
        yield Words(first, end, np.searchsorted(first, at), sums, range(i, j))


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words inside each text, and each text's bounds among them.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    one = found.hashes()
    sizes = np.diff(found.bounds)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, U), bounds
    start = np.repeat(found.bounds[:-1], counts) + np.arange(total) - np.repeat(bounds[:-1], counts)
    last = np.repeat(found.bounds[1:], counts)
    padded = np.concatenate((one, np.zeros(width, U)))
    out = np.zeros(total, U)
    with np.errstate(over="ignore"):
        for k in range(width):
            here = padded[start + k]
            if k:
                here = np.where(start + k < last, here, U(0))
            out = out * U(0xD6E8FEB86659FD93) + here + U(k)
    return mix(out), bounds
