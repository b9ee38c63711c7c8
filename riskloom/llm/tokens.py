"""Words of whole texts as Arrow arrays and their hashes as numpy arrays.

Two word classes are used by the corpus operators: runs of non-white-space
(``[^\\x20\\x09-\\x0D]+``) and runs of ASCII letters, digits and non-ASCII
characters (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z).
Both are found by translating single bytes and one vectorised split, never by
a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .frames import byte_offsets

#: lower-cases A-Z and turns every ASCII character that is no letter or digit
#: into a space
ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
              else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: lower-cases A-Z only
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_U = np.uint64


def translated(texts: pa.Array, table: bytes | None) -> pa.Array:
    """The texts (null: empty) with every byte mapped by ``table``."""
    texts = texts.fill_null("") if texts.null_count else texts
    if table is None:
        return texts
    offs = byte_offsets(texts)
    data = texts.buffers()[2]
    raw = b"" if data is None else memoryview(data)[int(offs[0]):int(offs[-1])].tobytes()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    cls = pa.LargeStringArray if kind is np.int64 else pa.StringArray
    return cls.from_buffers(len(texts), pa.py_buffer((offs - offs[0]).astype(kind)),
                            pa.py_buffer(raw.translate(table)))


def split_words(texts: pa.Array, table: bytes | None = None):
    """(words of all texts, one after another; offsets[i]:offsets[i+1] are
    those of text i)."""
    lists = pc.ascii_split_whitespace(translated(texts, table))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(
        zero_copy_only=False))]).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)[ends]
    return (flat if full.all() else flat.filter(pa.array(full))), offsets


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, the same in every process: the distinct words
    are hashed by summing a mixed (byte, place) value over their bytes, then
    spread by their dictionary codes."""
    if not len(words):
        return np.zeros(0, dtype=_U)
    coded = words.dictionary_encode()
    offs = byte_offsets(coded.dictionary)
    data = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)[int(offs[0]):int(offs[-1])]
    starts, lens = offs[:-1] - offs[0], np.diff(offs)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        each = mix(data.astype(_U) + (place.astype(_U) << _U(8)) + _U(0x51ED270B))
        h = mix(np.add.reduceat(each, starts) + lens.astype(_U) * _U(0x9E3779B97F4A7C15))
    return h[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def window_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every ``k`` consecutive entries of ``h`` (length n - k + 1),
    composed from windows of 1, 2, 4, 8.. entries."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    mult = _U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    levels, width = {1: h}, 1
    with np.errstate(over="ignore"):
        while width * 2 <= k:
            b = levels[width]
            levels[width * 2] = mix(b[:-width] * mult + b[width:])
            width *= 2
        out, pos, w = None, 0, width
        while w:
            if k & w:
                part = levels[w][pos:pos + m]
                out = part if out is None else mix(out * mult + part)
                pos += w
            w >>= 1
        return mix(out + _U(seed)) if k == 1 else out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Index of the text each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Members:
    """Membership of 64-bit hashes in a fixed sorted set: a byte table on the
    top 20 bits rejects nearly all, a binary search decides the rest."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(_U))
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(self.values >> _U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray):
        """(positions in ``h`` that are members, their index in ``values``)."""
        if not len(self.values) or not len(h):
            z = np.zeros(0, dtype=np.int64)
            return z, z
        at = np.flatnonzero(self.table[(h >> _U(44)).astype(np.int64)])
        j = np.searchsorted(self.values, h[at])
        j[j == len(self.values)] = 0
        ok = self.values[j] == h[at]
        return at[ok], j[ok]
