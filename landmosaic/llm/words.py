"""Words of many texts at once, in numpy: each distinct word is looked at once per batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BATCH_BYTES = 4 << 20
SHORT = 16  # bytes; words up to here are told apart by two integers
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def byte_kinds(kind) -> np.ndarray:
    """The kind of each byte: 0 between words, and small numbers."""
    return np.array([int(kind(b)) for b in range(256)], np.uint8)


def distinct(texts: list[bytes], kinds: np.ndarray, single: int | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of its distinct word for every word in turn, and where each text's words begin and end.

    A word is a run of bytes of one kind, or one byte of the kind `single`; the byte 32 must be of kind 0."""
    data = b" " + b" ".join(texts) + b" " * (SHORT + 1)
    a = np.frombuffer(data, np.uint8)
    k = kinds[a]
    edge = np.append(True, k[1:] != k[:-1])
    if single is not None:
        edge |= k == single
    inside = k != 0
    starts, ends = np.flatnonzero(edge & inside), np.flatnonzero(edge[1:] & inside[:-1]) + 1
    text_starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, text_starts)
    if not len(starts):
        return [], np.empty(0, np.int64), bounds
    size = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    one, two = eight[starts] & MASKS[np.minimum(size, 8)], eight[starts + 8] & MASKS[np.clip(size - 8, 0, 8)]
    mixed = one * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31)) ^ two) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    new = np.append(True, s[1:] != s[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    pick = first[which]
    other = np.flatnonzero((one[pick] != one) | (two[pick] != two) | (size > SHORT) | (size[pick] != size))
    words = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    if len(other):  # long words, and those whose mixed integers only happen to be equal
        numbers: dict[bytes, int] = {}
        for k, i, j in zip(other.tolist(), starts[other].tolist(), ends[other].tolist(), strict=True):
            which[k] = numbers.setdefault(data[i:j], len(words) + len(numbers))
        words += numbers
    return words, which, bounds


def batches(texts: Iterable, most: int = BATCH_BYTES) -> Iterator[tuple[int, list]]:
    """Lists of some texts, with the number of the first; only one list is held at a time."""
    start, size, part = 0, 0, []
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield start, part
            start, size, part = start + len(part), 0, []
    if part:
        yield start, part


def gathered(parts: list[bytes], which: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of the parts that `which` names, joined, and where each begins (one more entry at the end)."""
    sizes = np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize
    base = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    flat = np.frombuffer(b"".join(parts), kind)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(base[which] - (ends - n), n)
    return flat[at], np.append(0, ends)
