"""Words of whole Arrow columns at once: split and hashed without a step in Python for each word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are looked at together; a longer text is looked at alone.
SLICE = 1 << 22
#: Words of more bytes are hashed one by one.
LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_held: dict[str, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def only(name: str, make: Callable[[], object]) -> object:
    """What a worker remembers under name. It remembers one thing at a time, so that operators that follow each other don't add up."""
    if name not in _held:
        _held.clear()
        tidy()
        _held[name] = make()
    return _held[name]


def tidied(run: Callable, holds: bool = False) -> Callable:
    """A function over batches that hands back the memory it has used once it is through, as workers live on for other steps.

    Unless it holds something itself, it first forgets what the worker remembers for another step.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch], *args, **more) -> Iterator[pa.RecordBatch]:
        if _held and not holds:
            _held.clear()
            tidy()
        try:
            yield from run(batches, *args, **more)
        finally:
            tidy()

    return whole


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """A column in runs of about so many bytes of text, with the row each begins at; nulls as empty texts."""
    texts = texts.fill_null("")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most, "right")))
        yield start, texts.slice(start, end - start)
        start = end


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of anything but ASCII spaces of all texts, in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    blank = pc.equal(pc.binary_length(texts), 0) if not len(flat) else pc.equal(pc.binary_length(flat), 0)
    if pc.any(blank).as_py():  # a text of spaces gives one empty word
        count = np.bincount(pc.list_parent_indices(lists).to_numpy()[~blank.to_numpy(zero_copy_only=False)], minlength=len(texts))
        flat = flat.filter(pc.invert(blank))
    return flat, count


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at a time."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type) else np.int32
    off = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2] if len(words) else None
    raw = np.zeros(int(off[-1] - off[0]) + 8, np.uint8)
    if data is not None:
        raw[:-8] = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    at, left = off[:-1] - off[0], np.diff(off)
    h = mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[at] & _MASK[np.minimum(left, 8)]))
    done, rest = 8, np.flatnonzero((left > 8) & (left <= LONG))
    while len(rest):
        h[rest] = mixed(h[rest] ^ (eight[at[rest] + done] & _MASK[np.minimum(left[rest] - done, 8)]))
        done += 8
        rest = rest[left[rest] > done]
    for i in np.flatnonzero(left > LONG):
        h[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + left[i]].tobytes())
    return h


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every size words in a row."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mixed(h)


def blobs(rows: list[np.ndarray], rest: np.ndarray) -> pa.Array:
    """Arrays as one binary value each; null where rest is false."""
    return pa.array([r.tobytes() if keep else None for r, keep in zip(rows, rest, strict=True)], pa.binary())


def unblob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of such values, which has no null, and where each row's begin and end."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.int64), (off - off[0]) // 8
