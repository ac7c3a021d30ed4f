"""Words of text buffers as numbers, told apart by their bytes (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestar.llm.shingles import _word_hashes

_LETTERS = np.random.Generator(np.random.PCG64(20240301)).integers(0, 2**64, 256, np.uint64)
#: The last bytes of an eight-byte word that belong to a word of 0 to 8 bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, the first byte lowest; zeros follow the end."""
    held = np.zeros(len(raw) + 8, np.uint8)
    held[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", held, strides=(1,))


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word raw[start:end], every byte for itself."""
    return _word_hashes(raw, start, end, _LETTERS)


def numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for equal bytes only, and the place in start of each number's first word.

    Words come in ascending order of their starts and of their ends; they may overlap. They
    are grouped by hash; every word is then compared with its group's first by its bytes, and those
    that differ (a collision) form groups of their own by their bytes."""
    _, first, number = np.unique(hashes(raw, start, end), return_index=True, return_inverse=True)
    length, view = end - start, eights(raw)
    model = first[number]
    differ = length != length[model]
    at, k = np.flatnonzero(model != np.arange(len(model))), 0
    while len(at := at[length[at] > k]):
        mask = _MASKS[np.minimum(length[at] - k, 8)]
        differ[at] |= (view[start[at] + k] ^ view[np.minimum(start[model[at]] + k, len(raw))]) & mask != 0
        k += 8
    if differ.any():
        own: dict[bytes, int] = {}
        more = list(first)
        for i in np.flatnonzero(differ).tolist():
            word = raw[start[i] : end[i]].tobytes()
            if word not in own:
                own[word] = len(more)
                more.append(i)
            number[i] = own[word]
        first = np.array(more)
    return number, first


def slices(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices raw[start:end] joined, and their offsets."""
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return raw[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as a string column."""
    data, offsets = slices(raw, start, end)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
