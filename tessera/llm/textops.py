"""Vectorised text handling on the flat UTF-8 buffers of Arrow string columns.

All functions work on one flat byte array that holds many documents, with an
offsets array (n_docs + 1).  Words are maximal runs of bytes other than space
and 0x09-0x0D; hashes are 64 bits, so equality of texts is up to a chance
collision of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; only memory depends on it, not results.
SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))


class _Powers:
    """Powers of the hash multiplier and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                up = np.full(size, _M, dtype=np.uint64)
                down = np.full(size, _M_INV, dtype=np.uint64)
                up[0] = down[0] = 1
                cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about ``size`` bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word."""
    ink = ~_SPACE[data]
    if not len(ink):
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begin[edge] = ink[edge]
    end = np.zeros(len(ink) + 1, dtype=bool)
    end[1:-1] = ink[:-1] & ~ink[1:]
    end[-1] = ink[-1]
    inner = edge[edge > 0]
    end[inner] = ink[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    if lower:
        data = _LOWER[data]
    up, down = _Powers.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, docs: np.ndarray, n_docs: int, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of ``width`` words within a document.

    With ``short``, a document of fewer words (one at least) gives one window
    of them all; a window's hash depends on its number of words.
    """
    counts = np.bincount(docs, minlength=n_docs) if len(docs) else np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        n = len(hashes) - width + 1
        if n > 0:
            value = np.zeros(n, dtype=np.uint64)
            for k in range(width):
                value = (value + hashes[k : k + n]) * _M
            keep = docs[:n] == docs[width - 1 :]
            out, of = mix(value[keep] + np.uint64(width)), docs[:n][keep]
        else:
            out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if short and (few := np.flatnonzero((counts > 0) & (counts < width))).size:
            first = np.concatenate([[0], np.cumsum(counts)])[few]
            value = np.zeros(len(few), dtype=np.uint64)
            for k in range(width - 1):
                has = counts[few] > k
                value[has] = (value[has] + hashes[first[has] + k]) * _M
            out = np.concatenate([out, mix(value + counts[few].astype(np.uint64))])
            of = np.concatenate([of, few])
    return out, of


def per_doc_distinct(values: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted within it, and offsets."""
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        first = np.ones(len(values), dtype=bool)
        first[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
        values, docs = values[first], docs[first]
    return values, np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n_docs))]).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    out[0] = s[0]
    return np.cumsum(out)
