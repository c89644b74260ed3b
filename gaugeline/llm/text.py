"""Whole-batch text work in numpy: word borders, word hashes, n-gram hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All functions take the UTF-8
bytes of a slice of documents and their offsets, so no Python object is made per word.
A slice holds about SLICE_BYTES of text, or one document if that is longer; the
temporaries take some 20 times the bytes of the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
U64 = np.uint64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part has at most about `limit` bytes of text, or one row."""
    _, at = utf8(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~IS_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    heads, tails = at[:-1][at[:-1] < n], at[1:][at[1:] > 0] - 1
    begin[heads] = solid[heads]
    end[tails] = solid[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long_word: int = 64) -> np.ndarray:
    """64-bit hash of each word, from 8 bytes at a time; words over `long_word` bytes are hashed one by one."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
    out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    active, done = np.flatnonzero(size <= long_word), 0
    while len(active):
        left = size[active] - done
        active, left = active[left > 0], left[left > 0]
        if not len(active):
            break
        lane = lanes[starts[active] + done]
        short = left < 8
        keep = U64(1) << (U64(8) * left[short].astype(U64))
        lane[short] &= keep - U64(1)
        out[active] = mix(out[active] * U64(0x9E3779B97F4A7C15) + lane)
        done += 8
    for i in np.flatnonzero(size > long_word):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n-1 words have none."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.full(len(h) - n + 1, n, U64)
    for j in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """As ngrams, in about log2(n) passes: the hashes of k words at two places give that of 2k words, mixed at each step."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, k = h, 1
    while k < n:
        step = min(k, n - k)
        out = mix(out[: len(out) - step] * U64(0x9E3779B97F4A7C15) + mix(out[step:] + U64(step)))
        k += step
    return out


def inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that start an n-word window within one document, and their document."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + offset, doc


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """For each document, its words under the mask `keep`, joined by one space."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    begin, size = starts[keep], (ends - starts)[keep] + 1
    out = np.full(int(size.sum()), 0x20, np.uint8)
    head = np.cumsum(size) - size
    move = np.repeat(begin - head, size - 1)
    place = np.flatnonzero(np.bincount(head + size - 1, minlength=len(out)) == 0) if len(out) else head
    out[place] = data[place + move]
    # the space after a document's last word is not its own
    stop = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=len(first) - 1).astype(np.int64))])
    own = np.ones(len(out), bool)
    own[stop[1:][np.diff(stop) > 0] - 1] = False
    lengths = np.diff(stop) - (np.diff(stop) > 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[own].tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, buffers).cast(pa.string())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
