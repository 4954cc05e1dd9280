"""Vectorised text primitives on Arrow buffers (NumPy only, no per-word Python).

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``.  A word's
fingerprint chains its length and its bytes, eight at a time, through a 64-bit
avalanche mix, so that no arithmetic relation between the bytes of two words
makes theirs equal; the fingerprint of ``k`` consecutive words is a multilinear
combination of theirs, mixed again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLDEN = U(0x9E3779B97F4A7C15)
_STEP, _LANE = U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)
#: Masks of the first 0 to 8 bytes of a lane.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
#: Bytes beyond which a word is hashed by itself.
LONG_WORD = 256
#: Bytes of text hashed at once; a longer single text is hashed alone.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fingerprint of each ``data[start:end]``; those of two seeds are independent."""
    length = ends - starts
    out = np.zeros(len(starts), dtype=U)
    long = np.flatnonzero(length > LONG_WORD)
    if len(long):
        out[long] = mix(np.array([xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed) for i in long], dtype=U))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    own = np.flatnonzero(length <= LONG_WORD) if len(long) else np.arange(len(starts))
    at, left = (starts[own], length[own]) if len(long) else (starts, length)
    out[own] = mix(left.astype(U) + _GOLDEN + mix(np.array([seed], dtype=U)))
    while len(own):
        block = lanes[at] & _MASK[np.minimum(left, 8)]
        out[own] = mix(out[own] * _STEP ^ block * _LANE)
        more = np.flatnonzero(left > 8)
        own, at, left = own[more], at[more] + 8, left[more] - 8
    return out


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on between
    tasks, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable) -> Callable:
    """A batch function that ends by releasing memory."""

    def done(batches):
        yield from run(batches)
        release()

    return done


def releasing_group(run: Callable) -> Callable:
    def done(key, rows):
        out = run(key, rows)
        release()
        return out

    return done


def releasing_cogroup(run: Callable) -> Callable:
    def done(key, left, right):
        out = run(key, left, right)
        release()
        return out

    return done


class Words:
    """Words of some texts: ``hashes``, byte ``starts`` and ``ends`` within
    ``data``, and ``first[i]:first[i + 1]``, the words of text ``i``."""

    __slots__ = ("data", "hashes", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        offsets = offsets.astype(np.int64)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        word = ~SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_words(data, self.starts, self.ends)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space between those of a text, and where each starts and ends there."""
        word = ~SPACE[self.data]
        keep = word.copy()
        keep[1:] |= word[:-1]
        place = np.cumsum(keep)
        plain = self.data[keep]
        plain[SPACE[plain]] = 0x20
        return plain, place[self.starts] - 1, place[self.ends - 1]

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all runs of ``k`` words inside one text, and the
        index of each run's first word; of another seed from the words anew."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))
        at = np.flatnonzero(left[:n] >= k)
        own = hash_words(self.data, self.starts, self.ends, seed) if seed else self.hashes
        return combine([own[j : n + j] for j in range(k)], seed)[at], at


def combine(columns: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One fingerprint for each row of equally long fingerprint columns."""
    with np.errstate(over="ignore"):
        odd = mix(np.arange(1 + 1000 * seed, 1 + 1000 * seed + len(columns), dtype=U)) | U(1)
        total = np.full(len(columns[0]), mix(np.array([len(columns) + 7919 * seed], dtype=U))[0], dtype=U)
        for c, m in zip(columns, odd, strict=True):
            total += c * m
        return mix(total)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large-string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string()).fill_null("")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array that ``strings`` has made."""
    _, offsets, data = column.buffers()
    found = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)), found


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (or one row) that cover the column."""
    _, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def words(column: pa.Array, at: int, end: int, lower: bool = False) -> Words:
    data, offsets = buffers(column)
    return Words(data, offsets[at : end + 1], lower)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned values as compressed byte planes of their gaps."""
    import zstandard

    gaps = np.diff(values, prepend=U(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=8 * n), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(U).ravel(), dtype=U)


def pack_bytes(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint8).tobytes())


def unpack_bytes(blob: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(n, 1)), dtype=np.uint8)


def pack_rows(table: pa.Table | pa.RecordBatch) -> bytes:
    """Rows as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()
