"""Words of whole Arrow columns as 64-bit hashes, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at in one step; words that go beyond a step are put together from their parts.
STEP = 1 << 16
_WRAP = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.full(STEP, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers of the base and of its inverse modulo 2**64.
_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges): the UTF-8 bytes of all texts one after the other; text i lies between edges i and i + 1. Null: empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), edges - edges[0]
    return np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def hashed_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words between ASCII white space, in order; no word goes over an edge.

    The hash is a polynomial over the bytes, modulo 2**64, scrambled: with running sums of
    byte * base**position the sum over a word is the difference of two, divided by a power.
    """
    starts, hashes, lengths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    open_word = False  # the byte before this step belongs to a word
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        gap = (part == 32) | (part - np.uint8(9) <= 4)
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[edges[np.searchsorted(edges, at) : np.searchsorted(edges, at + len(part), "right")] - at] = True
        goes_on = open_word and not edge[0] and not gap[0]
        open_word = not gap[-1]
        first = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
        last = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:]))
        sums = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], dtype=np.uint64)
        value = (sums[last] - np.where(first > 0, sums[first - 1], np.uint64(0))) * _DOWN[first]
        length = (last - first + 1).astype(np.uint64)
        if goes_on:
            k = next(k for k in range(len(hashes) - 1, -1, -1) if len(hashes[k]))
            more = pow(_BASE, int(lengths[k][-1]), 1 << 64) * int(value[0])
            hashes[k][-1] = (int(hashes[k][-1]) + more) & _WRAP
            lengths[k][-1] += length[0]
            first, value, length = first[1:], value[1:], length[1:]
        starts.append(first + at)
        hashes.append(value)
        lengths.append(length)
    return np.concatenate(starts), scrambled(np.concatenate(hashes) + np.concatenate(lengths) * np.uint64(0xD1B54A32D192ED03))


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of the string column, or of a single row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end
