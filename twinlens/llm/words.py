"""Words of many texts at once, as 64-bit hashes, straight from Arrow string buffers.

Functions here run inside Spark tasks on one Arrow batch. They look at bytes, so a text of any
length costs time and memory in proportion to its bytes, and a null counts as an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def spaced() -> np.ndarray:
    """Which bytes belong to a word when only 0x20 and 0x09-0x0D separate words."""
    inside = np.ones(256, bool)
    inside[0x09:0x0E] = False
    inside[0x20] = False
    return inside


def alphanumeric() -> np.ndarray:
    """Which bytes belong to a word of ASCII letters, digits and non-ASCII characters."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = True
    inside[0x41:0x5B] = True
    inside[0x61:0x7B] = True
    inside[0x80:] = True
    return inside


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence extended by one more item; order matters."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)) ^ mix(right + np.uint64(0x2545F4914F6CDD1D))


def byte_values(fold: bool = True) -> np.ndarray:
    """One scrambled value per byte; with `fold`, capital ASCII letters share the value of their small letter."""
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    ahead = np.full(size, BASE, np.uint64)
    back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `size` bytes of text, one row at least."""
    whole = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    for part in whole.combine_chunks().to_batches():
        column = part.column(part.schema.names.index(text))
        _, at = buffers(column)
        begin = 0
        while begin < part.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
            yield part.slice(begin, end - begin)
            begin = end


def bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each text the number of words before it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: tuple | None = None, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, with `fold` blind to the case of A-Z. Memory follows CHUNK and the longest word."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    values = byte_values(fold)
    longest = int((ends - starts).max())
    ahead, back = tables if tables and len(tables[0]) > longest else powers(max(CHUNK, longest) + 1)
    size, i = len(ahead) - 1, 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * ahead[: high - low], dtype=np.uint64, out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * back[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def words_of(column: pa.Array, inside: np.ndarray, tables: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and for each text the number of words before it."""
    data, at = buffers(column)
    starts, ends, first = bounds(data, at, inside)
    return hashes(data, starts, ends, tables), first


def hash_word(word: str | bytes) -> int:
    """The hash of one whole word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]), powers(len(raw) + 2))[0])


def owner_of(index_starts: np.ndarray, total: int) -> np.ndarray:
    """For `total` items dealt to texts that begin at `index_starts`, the text of each item."""
    return np.repeat(np.arange(len(index_starts) - 1), np.diff(index_starts)) if total else np.zeros(0, np.int64)


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among sorted distinct keys, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.searchsorted(sorted_keys, keys)
    place[place == len(sorted_keys)] = 0
    return place, sorted_keys[place] == keys
